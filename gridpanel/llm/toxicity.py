"""Toxicity by a small bidirectional gated recurrent network over overlapping windows of words.

A word enters with hashed character n-grams (with word ends marked) and with itself: learned
embeddings of both, and how strongly the n-grams and the word lean to toxic texts in the
fitting sample. Two recurrent layers read a window from both ends, attention pools their
states, and a linear layer gives the window's logit. The logits of all windows of a text give
its score through a logistic curve. Everything is fitted in numpy on a bounded sample.

Null and empty texts, and texts without a letter, get the share of toxic rows. Very long
texts are read whole, window after window. Repeated rows score alike. An empty table gives no
rows; without labels of both kinds every score is the share of toxic rows. Extra columns pass
through; outputs replace columns of the same name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpanel.llm.arrowtext import filled, give_back, handing_back, slices
from gridpanel.llm.bpe import gather

#: Labelled rows of each kind that are fitted on at most, and the longest text among them in bytes.
SAMPLE_ROWS = 1500
SAMPLE_TEXT_BYTES = 60_000
WINDOW, STRIDE = 32, 24
HIDDEN, EMBEDDED, ATTENTION = 8, 4, 4
BUCKETS = 1 << 15
GRAMS = (3, 4, 5, 6, 7)
EPOCHS, BATCH, RATE = 10, 64, 0.012
#: A text's leanings while fitting come from the other folds, or it would be judged by itself.
FOLDS = 4
#: Steps the network is fitted for at least, and the share of learned embeddings left out of each.
LEAST_STEPS, DROPPED = 400, 0.3
#: How sure (likelihood ratio, as chi-squared) a bucket's leaning must be.
SURE = 18.0
#: Texts of the sample that a bucket must occur in to have an embedding of its own.
KNOWN_TEXTS = 30
#: Windows scored at once, and words a task remembers before it starts anew.
SCORED, STORE_WORDS = 2048, 150_000
#: Words whose n-grams are held at once.
HELD_WORDS = 4000

_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of all words, the word of each, and each word's own bucket."""
    marked = [f"<{w}>".encode("utf-32-le") for w in words]
    lengths = np.array([len(m) // 4 for m in marked], np.int64)
    data = np.frombuffer(b"".join(marked), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    starts = np.cumsum(lengths) - lengths
    left = (np.repeat(lengths + starts, lengths) - np.arange(len(data))).astype(np.int32)
    h = np.zeros(len(data), np.uint64)
    grams, owners = [], []
    whole = np.zeros(len(words), np.uint64)
    for n in range(1, int(lengths.max(initial=0)) + 1):
        at = np.flatnonzero(left >= n)
        if n > max(GRAMS):
            at = np.intersect1d(at, starts, assume_unique=True)
        h[at] = (h[at] ^ data[at + n - 1]) * np.uint64(0x100000001B3)
        h[at] ^= h[at] >> np.uint64(31)
        if n in GRAMS:
            grams.append((h[at] % np.uint64(BUCKETS)).astype(np.int32))
            owners.append(owner[at])
        ended = np.flatnonzero(lengths == n)
        whole[ended] = h[starts[ended]]
    if not grams:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(grams), np.concatenate(owners), (whole % np.uint64(BUCKETS)).astype(np.int64)


def buckets_by_word(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams word after word, their number for each word, and each word's own bucket."""
    parts = []
    for begin in range(0, max(len(words), 1), HELD_WORDS):
        some = words[begin : begin + HELD_WORDS]
        grams, owner, own = gram_buckets(some)
        # two bytes hold a bucket's number
        parts.append((grams[np.argsort(owner, kind="stable")].astype(np.uint16), np.bincount(owner, minlength=len(some)), own))
    return tuple(np.concatenate(p) for p in zip(*parts))


def hits_of(documents: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Texts of either kind that each bucket occurs in; a text's buckets are distinct."""
    hits = np.zeros((2, BUCKETS))
    for found, kind in zip(documents, toxic):
        hits[int(kind), found] += 1
    return hits


def leanings(documents: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Per bucket the log-ratio of its document shares in both kinds; what is rare or unsure stays 0."""
    hits = hits_of(documents, toxic)
    n = np.bincount(toxic.astype(int), minlength=2)
    share = (hits + 0.5) / (n[:, None] + 1.0)
    ratio = np.log(share[1] / share[0])
    spread = np.sqrt(1 / (hits[1] + 0.5) + 1 / (hits[0] + 0.5))
    # likelihood-ratio test of each bucket: with so many buckets only what is far from chance counts
    expected = hits.sum(0) * (n / max(n.sum(), 1))[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        test = 2 * np.where(hits > 0, hits * np.log(hits / expected), 0.0).sum(0)
    sure = test > SURE
    return np.where(sure, np.sign(ratio) * np.maximum(np.abs(ratio) - spread, 0), 0.0)


@dataclass
class Network:
    gram_lean: np.ndarray
    word_lean: np.ndarray
    share: float
    gram_known: np.ndarray
    word_known: np.ndarray
    p: dict[str, np.ndarray] = field(default_factory=dict)
    curve: np.ndarray = field(default_factory=lambda: np.zeros(4))
    fitted: bool = False

    def start(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        d, h = 4 + 2 * EMBEDDED, HIDDEN
        self.p = {
            "gram": rng.normal(0, 0.05, (BUCKETS, EMBEDDED)), "word": rng.normal(0, 0.05, (BUCKETS, EMBEDDED)),
            "attend": rng.normal(0, 0.3, (2 * h, ATTENTION)), "query": rng.normal(0, 0.3, ATTENTION),
            "out": rng.normal(0, 0.3, 2 * h), "bias": np.array(-1.0),
        }
        for side in "fb":
            self.p[f"in_{side}"] = rng.normal(0, 0.3, (d, 3 * h))
            self.p[f"rec_{side}"] = rng.normal(0, 0.25, (h, 3 * h))
            self.p[f"add_{side}"] = np.concatenate([np.full(h, 1.0), np.zeros(2 * h)])

    def inputs(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        """Inputs of distinct words, and what their gradient needs."""
        grams, owner, own = gram_buckets(words)
        n = len(words)
        counts = np.maximum(np.bincount(owner, minlength=n), 1)
        lean = self.gram_lean[grams]
        top = np.zeros(n)
        np.maximum.at(top, owner, lean)
        mean = np.bincount(owner, lean, n) / counts
        fixed = np.stack([top / 4, mean / 2, self.word_lean[own] / 4, (self.word_lean[own] > 0) * 0.5], 1)
        # buckets of too few texts would only let the network learn those texts by heart
        known = self.gram_known[grams]
        grams, owner, counts = grams[known], owner[known], counts[:, None]
        chars = np.stack([np.bincount(owner, self.p["gram"][grams, k], n) for k in range(EMBEDDED)], 1) / counts
        kept = self.word_known[own][:, None]
        return np.concatenate([fixed, chars, self.p["word"][own] * kept], 1), (grams, owner, own, counts, kept)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def _read(x: np.ndarray, rec: np.ndarray, mask: np.ndarray, keep: bool):
    """States of one layer over ``x`` (time, windows, 3 * hidden); with ``keep`` also what going back needs."""
    steps, n, _ = x.shape
    h = HIDDEN
    state = np.zeros((n, h), x.dtype)
    states, saved = np.empty((steps, n, h), x.dtype), []
    full = bool(mask.all())
    for t in range(steps):
        u = state @ rec
        gates = _sigmoid(x[t, :, : 2 * h] + u[:, : 2 * h])
        z, r = gates[:, :h], gates[:, h:]
        new = np.tanh(x[t, :, 2 * h :] + r * u[:, 2 * h :])
        after = new + z * (state - new)
        if not full:
            after *= mask[t][:, None]
        if keep:
            saved.append((state, u, z, r, new))
        state = states[t] = after
    return states, saved


def _back(grad: np.ndarray, rec: np.ndarray, mask: np.ndarray, saved: list):
    """Gradients of a layer's inputs and recurrent weights from those of its states."""
    steps, n, h = grad.shape
    gx, grec, carry = np.empty((steps, n, 3 * h)), np.zeros_like(rec), np.zeros((n, h))
    for t in range(steps - 1, -1, -1):
        before, u, z, r, new = saved[t]
        g = (grad[t] + carry) * mask[t][:, None]
        gz = g * (before - new) * z * (1 - z)
        gn = g * (1 - z) * (1 - new * new)
        gr = gn * u[:, 2 * h :] * r * (1 - r)
        gx[t] = np.concatenate([gz, gr, gn], 1)
        gu = np.concatenate([gz, gr, gn * r], 1)
        grec += before.T @ gu
        carry = g * z + gu @ rec.T
    return gx, grec


def windows_of(count: int) -> list[int]:
    """Starts of overlapping windows over ``count`` words; the last one ends with the text."""
    if count <= WINDOW:
        return [0] if count else []
    return [*range(0, count - WINDOW, STRIDE), count - WINDOW]


def _pool(p: dict, fore: np.ndarray, aft: np.ndarray, mask: np.ndarray):
    both = np.concatenate([fore, aft], 2)
    inner = np.tanh(both @ p["attend"])
    weight = np.where(mask, inner @ p["query"], -1e9)
    weight = np.exp(weight - weight.max(0))
    weight /= weight.sum(0)
    pooled = np.einsum("tb,tbh->bh", weight, both)
    return both, inner, weight, pooled, pooled @ p["out"] + p["bias"]


def _batches(fold: np.ndarray, toxic: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """Shuffled batches within folds; toxic windows come again until they are a third of all."""
    out = []
    for f in np.unique(fold):
        one, rest = np.flatnonzero((fold == f) & (toxic > 0)), np.flatnonzero((fold == f) & (toxic == 0))
        again = max(1, min(3, len(rest) // max(2 * len(one), 1)))
        order = rng.permutation(np.concatenate([np.tile(one, again), rest]))
        out += [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
    return [out[i] for i in rng.permutation(len(out))]


def _train(nets: list[Network], words: list[str], windows: np.ndarray, fold: np.ndarray, toxic: np.ndarray) -> None:
    """Adam over batches; ``windows`` holds word numbers, -1 beyond a text's end.

    ``nets`` share their weights and differ in leanings: one for each fold of texts.
    """
    rng = np.random.default_rng(11)
    shared = nets[0].p
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in shared.items()}
    step = 0
    epochs = max(EPOCHS, -(-LEAST_STEPS // max(1, len(_batches(fold, toxic, rng)))))
    for epoch in range(epochs):
        rate = RATE * (0.4 if epoch >= 0.6 * epochs else 1.0)
        for part in _batches(fold, toxic, rng):
            net = nets[int(fold[part[0]])]
            used, inverse = np.unique(windows[part].T, return_inverse=True)
            inverse, mask = inverse.reshape(WINDOW, len(part)), windows[part].T >= 0
            known = used >= 0
            x_words = np.zeros((len(used), 4 + 2 * EMBEDDED))
            x_known, (grams, owner, own, counts, kept) = net.inputs([words[i] for i in used[known]])
            room = np.ones((len(x_known), 4 + 2 * EMBEDDED))
            room[:, 4:] = rng.random((len(x_known), 2 * EMBEDDED)) >= DROPPED
            x_words[known] = x_known * room
            x = x_words[inverse]
            p = net.p
            side = {"f": slice(None), "b": slice(None, None, -1)}
            states, saved = {}, {}
            for s, turn in side.items():
                got, saved[s] = _read((x @ p[f"in_{s}"] + p[f"add_{s}"])[turn], p[f"rec_{s}"], mask[turn], True)
                states[s] = got[turn]
            both, inner, weight, pooled, logit = _pool(p, states["f"], states["b"], mask)
            g = (_sigmoid(logit) - toxic[part]) / len(part)
            grads = {"out": pooled.T @ g, "bias": g.sum()}
            gpool = g[:, None] * p["out"]
            gweight = np.einsum("bh,tbh->tb", gpool, both)
            gscore = weight * (gweight - (weight * gweight).sum(0))
            grads["query"] = np.einsum("tb,tba->a", gscore, inner)
            ginner = gscore[:, :, None] * p["query"] * (1 - inner * inner)
            grads["attend"] = np.einsum("tbh,tba->ha", both, ginner)
            gboth = weight[:, :, None] * gpool + ginner @ p["attend"].T
            gx = np.zeros_like(x)
            for s, turn in side.items():
                own_part = gboth[:, :, :HIDDEN] if s == "f" else gboth[:, :, HIDDEN:]
                gin, grads[f"rec_{s}"] = _back(own_part[turn], p[f"rec_{s}"], mask[turn], saved[s])
                gin = gin[turn]
                grads[f"in_{s}"] = np.einsum("tbd,tbg->dg", x, gin)
                grads[f"add_{s}"] = gin.sum((0, 1))
                gx += gin @ p[f"in_{s}"].T
            gwords = np.zeros_like(x_words)
            np.add.at(gwords, inverse, gx)
            gwords = gwords[known] * room
            grads["gram"], grads["word"] = np.zeros_like(p["gram"]), np.zeros_like(p["word"])
            np.add.at(grads["gram"], grams, gwords[owner, 4 : 4 + EMBEDDED] / counts[owner])
            np.add.at(grads["word"], own, gwords[:, 4 + EMBEDDED :] * kept)
            step += 1
            for k, grad in grads.items():
                decayed = grad + 1e-4 * p[k]
                m, v = moments[k]
                m += 0.1 * (decayed - m)
                v += 0.001 * (decayed * decayed - v)
                p[k] = p[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


class Scorer:
    """Window logits of texts; keeps each word's input to both layers while it remembers the word."""

    def __init__(self, net: Network):
        self.net = net
        self.p = {k: np.asarray(v, np.float32) for k, v in net.p.items() if k not in ("gram", "word")}
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        # row 0 stands for the room beyond a text's end
        self.table = {s: np.zeros((1, 3 * HIDDEN), np.float32) for s in "fb"}

    def numbers(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self.known) > STORE_WORDS:
            self.forget()
        every = [w for text in texts for w in text]
        new = [w for w in dict.fromkeys(every) if w not in self.known]
        for begin in range(0, len(new), HELD_WORDS):
            some = new[begin : begin + HELD_WORDS]
            x, _ = self.net.inputs(some)
            for s in "fb":
                self.table[s] = np.concatenate([self.table[s], (x.astype(np.float32) @ self.p[f"in_{s}"] + self.p[f"add_{s}"])])
            for w in some:
                self.known[w] = len(self.known) + 1
        flat = np.fromiter(map(self.known.__getitem__, every), np.int64, len(every))
        return np.split(flat, np.cumsum([len(t) for t in texts])[:-1]) if texts else []

    def logits(self, index: np.ndarray) -> np.ndarray:
        """``index``: windows x WINDOW word numbers, 0 beyond the end."""
        index = index.T
        mask = index > 0
        fore, _ = _read(self.table["f"][index], self.p["rec_f"], mask, False)
        aft, _ = _read(self.table["b"][index[::-1]], self.p["rec_b"], mask[::-1], False)
        return _pool(self.p, fore, aft[::-1], mask)[4]

    def windows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The logit of every window of every text, and the text of each."""
        numbers = self.numbers([words_of(t) for t in texts])
        sizes = np.array([len(n) for n in numbers], np.int64)
        starts = [windows_of(n) for n in sizes.tolist()]
        owner = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
        if not len(owner):
            return np.zeros(0), owner
        flat = np.concatenate(numbers + [np.zeros(1, np.int64)])
        offset = np.cumsum(sizes) - sizes
        at = np.array([x for s in starts for x in s], np.int64)
        out = []
        for begin in range(0, len(owner), SCORED):
            who = owner[begin : begin + SCORED]
            place = at[begin : begin + SCORED, None] + np.arange(WINDOW)
            inside = place < sizes[who][:, None]
            index = np.where(inside, flat[np.where(inside, place + offset[who][:, None], 0)], 0)
            # whole windows first, so that only the shorter ones need masks
            short = ~inside[:, -1]
            part = np.empty(len(who))
            for group in (np.flatnonzero(~short), np.flatnonzero(short)):
                if len(group):
                    part[group] = self.logits(index[group])
            out.append(part)
        return np.concatenate(out), owner

    def features(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text: 1, largest logit, log of the sum of their exponentials, log of their number; and that number."""
        logit, owner = self.windows(texts)
        count = np.bincount(owner, minlength=len(texts))
        top = np.full(len(texts), -30.0)
        np.maximum.at(top, owner, logit)
        soft = top + np.log(np.maximum(np.bincount(owner, np.exp(logit - top[owner]), len(texts)), 1e-12))
        return np.stack([np.ones(len(texts)), top, soft, np.log(np.maximum(count, 1))], 1), count

    def __call__(self, texts: list[str]) -> np.ndarray:
        if not self.net.fitted:
            return np.full(len(texts), self.net.share)
        x, count = self.features(texts)
        return np.where(count > 0, _sigmoid(x @ self.net.curve), self.net.share)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton steps with a small ridge."""
    beta, ridge = np.zeros(x.shape[1]), np.diag([1e-3, 1e-2, 1e-2, 1e-1])
    for _ in range(50):
        p = _sigmoid(np.clip(x @ beta, -30, 30))
        slope = x.T @ (weight * (y - p)) - ridge @ beta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        beta = beta + np.clip(np.linalg.solve(curve, slope), -2, 2)
    return beta


def fit(texts: list[str], toxic: list[int], share: float) -> Network:
    """Fit on labelled texts; ``share`` is the part of toxic rows among all labelled rows."""
    kind = np.array(toxic, int)
    number: dict[str, int] = {}
    cut = [np.array([number.setdefault(w, len(number)) for w in words_of(t)], np.int32) for t in texts]
    every = list(number)
    grams, counts, own = buckets_by_word(every)
    starts = np.cumsum(counts) - counts
    gram_sets, word_sets = [], []
    for c in cut:
        n = np.unique(c).astype(np.int64)
        gram_sets.append(np.unique(gather(grams, starts[n], counts[n])))
        word_sets.append(np.unique(own[n]).astype(np.uint16))
    often = [hits_of(sets, kind).sum(0) >= KNOWN_TEXTS for sets in (gram_sets, word_sets)]
    net = Network(leanings(gram_sets, kind), leanings(word_sets, kind), share, *often)
    del grams
    if len(np.unique(kind)) < 2 or not every:
        return net
    net.start()
    folds = np.random.default_rng(5).permutation(len(cut)) % FOLDS
    others = [np.flatnonzero(folds != f) for f in range(FOLDS)]
    nets = [
        Network(leanings([gram_sets[i] for i in o], kind[o]), leanings([word_sets[i] for i in o], kind[o]), share, *often, net.p)
        for o in others
    ]
    # from every text the windows that lean most, and one other
    leans = []
    for part in nets:
        tops = []
        for begin in range(0, len(every), HELD_WORDS):
            x, _ = part.inputs(every[begin : begin + HELD_WORDS])
            tops.append(np.maximum(x[:, 0], x[:, 2]))
        leans.append(np.concatenate(tops))
    rng = np.random.default_rng(3)
    windows, labels, of = [], [], []
    for n, k, f in zip(cut, kind, folds):
        lean = leans[f]
        starts = windows_of(len(n))
        if not starts:
            continue
        sums = [lean[n[s : s + WINDOW]].sum() for s in starts]
        best = np.argsort(sums)[::-1][: 1 if k else 2].tolist()
        if not k:
            best.append(int(rng.integers(len(starts))))
        for i in dict.fromkeys(best):
            w = n[starts[i] : starts[i] + WINDOW]
            windows.append(np.pad(w, (0, WINDOW - len(w)), constant_values=-1))
            labels.append(k)
            of.append(f)
    _train(nets, every, np.array(windows), np.array(of), np.array(labels, float))
    x, count = np.zeros((len(texts), 4)), np.zeros(len(texts), np.int64)
    for f, part in enumerate(nets):
        scorer = Scorer(part)
        own_fold = np.flatnonzero(folds == f)
        for some in np.array_split(own_fold, max(1, len(own_fold) // 200)):
            x[some], count[some] = scorer.features([texts[i] for i in some])
    use = count > 0
    part = kind.mean()
    weight = np.where(kind == 1, share / part, (1 - share) / (1 - part))
    net.curve, net.fitted = _logistic(x[use], kind[use].astype(float), weight[use]), True
    return net


def train(docs: DataFrame, labels: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS, max_bytes: int = SAMPLE_TEXT_BYTES) -> Network:
    """Fit on at most ``rows`` labelled texts of each kind, those with the smallest hashes of their id.

    ``labels`` holds ``doc_id`` and ``toxic``; rows without either, and texts above
    ``max_bytes``, are not fitted on.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    fitting = docs.where(F.octet_length(text) <= max_bytes).select("doc_id")
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = n.get(1, 0) / max(sum(n.values()), 1)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    # texts too long to fit on are left out before the draw, so that they take no other's place
    short = known.join(fitting, "doc_id", "left_semi")
    drawn = short.where("toxic = 1").orderBy(*order).limit(rows).union(short.where("toxic = 0").orderBy(*order).limit(rows))
    found = docs.select("doc_id", F.col(text).alias("text")).where(F.octet_length("text") <= max_bytes).join(F.broadcast(drawn), "doc_id")
    picked = found.orderBy(*order, F.xxhash64("text")).limit(2 * rows).select("text", "toxic").collect()
    texts, toxic = [r["text"] for r in picked], [r["toxic"] for r in picked]
    del picked
    net = fit(texts, toxic, share)
    del texts, toxic
    give_back()
    return net


def score(df: DataFrame, net: Network, text: str = "text", out: str = "score") -> DataFrame:
    """Add the score (0 to 1) of each text."""
    shared = df.sparkSession.sparkContext.broadcast(net)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value) if shared.value.fitted else None
        for batch in batches:
            for part in slices(batch, text, 1 << 20):
                texts = filled(part.column(text)).to_pylist()
                values = scorer(texts) if scorer else np.full(len(texts), shared.value.share)
                kept = {n: part.column(i) for i, n in enumerate(part.schema.names) if n != out}
                yield pa.RecordBatch.from_pydict(kept | {out: pa.array(values, pa.float64())})

    fields = [f for f in df.schema.fields if f.name != out]
    return df.mapInArrow(handing_back(read), T.StructType([*fields, T.StructField(out, T.DoubleType())]))
