"""Language identification by unigram pieces whose segmentations are summed out.

A fixed public vocabulary of byte pieces gives every language one distribution over the same
pieces. The probability of a word is the sum over all ways to cut it into pieces, found by a
forward pass; a text's is the product over its words. Piece probabilities come from expected
counts (forward-backward, a few rounds) on a bounded sample of labelled texts, smoothed with
the counts of all languages together.

A text that is null or has no letter gets ``und`` and the score 0. Very long texts are read
whole; repeated rows are judged alike; an empty table, or one without labels, gives ``und``
for every row. Extra columns pass through, outputs replace columns of the same name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpanel.llm.arrowtext import filled, slices

#: Labelled texts per language that the model is fitted on; up to about 1.3 times as many are drawn.
SAMPLE_ROWS = 600
#: Bytes of text in the whole sample at most, an equal part of it for each language; texts beyond a language's part are left out as a whole.
SAMPLE_BYTES = 16 << 20
ROUNDS = 3
#: Pieces longer than this are not used.
LONGEST = 12
#: Weight, in counts, of the distribution over all languages.
SMOOTHING = 400.0
#: Bytes of distinct words whose segmentations are held at once.
BLOCK_BYTES = 100_000
#: Words a task remembers before it starts anew.
STORE_WORDS = 300_000

_LETTERS = re.compile(r"[^\W\d_]+")
_ANY_LETTER = re.compile(r"[^\W\d_]")


def words_of(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


@dataclass
class Pieces:
    """Sorted hashes of the pieces, with the number of each."""

    hashes: np.ndarray
    numbers: np.ndarray
    count: int
    longest: int

    @classmethod
    def of(cls, vocabulary: Mapping[bytes, int], longest: int = LONGEST) -> Pieces:
        """Every single byte is a piece, so every word has a segmentation."""
        used = sorted({p for p in vocabulary if 1 <= len(p) <= longest and not p[:1].isspace()} | {bytes([b]) for b in range(256)})
        data, lengths = np.frombuffer(b"".join(used), np.uint8), np.array([len(p) for p in used])
        starts = np.cumsum(lengths) - lengths
        hashes = np.zeros(len(used), np.uint64)
        for k in range(1, longest + 1):
            of_k = lengths == k
            hashes[of_k] = _hash(data, starts[of_k], k)
        order = np.argsort(hashes)
        return cls(hashes[order], order, len(used), longest)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each piece, or -1."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.numbers[at], -1)


def _hash(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    h = np.full(len(starts), length, np.uint64)
    for i in range(length):
        h = (h ^ data[starts + i].astype(np.uint64)) * np.uint64(0x100000001B3)
        h ^= h >> np.uint64(29)
    return h


class Lattice:
    """All pieces at all places of a list of distinct words.

    Position 0 of a word lies before its first byte. An edge ``k`` bytes long leads from
    position ``i`` to ``i + k``; words are ordered by length so that each step of a pass
    handles one distance from the start, or from the end, of all words at once.
    """

    def __init__(self, words: list[bytes], pieces: Pieces):
        lengths = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lengths) - lengths
        self.lengths, self.nodes = lengths, starts + np.arange(len(words))  # each word has one node more than bytes
        self.total = int(lengths.sum()) + len(words)
        inside = np.arange(len(data)) - np.repeat(starts, lengths)
        left = np.repeat(lengths, lengths) - inside
        node = np.repeat(self.nodes, lengths) + inside
        froms, tos, names = [], [], []
        for k in range(1, pieces.longest + 1):
            at = np.flatnonzero(left >= k)
            if not len(at):
                break
            piece = pieces.find(_hash(data, at, k))
            hit = piece >= 0
            froms.append(node[at[hit]])
            tos.append(froms[-1] + k)
            names.append(piece[hit])
        self.source, self.target, self.piece = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (froms, tos, names))
        place = np.arange(self.total) - np.repeat(self.nodes, lengths + 1)
        self.by_target = self._steps(place[self.target])
        self.by_source = self._steps(place[self.source])
        self.ends = self.nodes + lengths

    @staticmethod
    def _steps(place: np.ndarray) -> list[np.ndarray]:
        order = np.argsort(place, kind="stable")
        return np.split(order, np.cumsum(np.bincount(place))[:-1]) if len(place) else []

    def forward(self, log_p: np.ndarray) -> np.ndarray:
        """Log sum over all paths from each word's start, per node and language."""
        reached = np.full((self.total, log_p.shape[1]), -np.inf)
        reached[self.nodes] = 0.0
        for edges in self.by_target:
            if len(edges):
                self._add(reached, self.target[edges], reached[self.source[edges]] + log_p[self.piece[edges]])
        return reached

    def backward(self, log_p: np.ndarray) -> np.ndarray:
        reached = np.full((self.total, log_p.shape[1]), -np.inf)
        reached[self.ends] = 0.0
        for edges in reversed(self.by_source):
            if len(edges):
                self._add(reached, self.source[edges], reached[self.target[edges]] + log_p[self.piece[edges]])
        return reached

    @staticmethod
    def _add(reached: np.ndarray, nodes: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(nodes, kind="stable")
        nodes, values = nodes[order], values[order]
        first = np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1]]))
        top = np.maximum.reduceat(values, first)
        size = np.diff(np.append(first, len(nodes)))
        with np.errstate(invalid="ignore"):
            spread = np.exp(values - np.repeat(top, size, axis=0))
        spread[np.isnan(spread)] = 0.0
        with np.errstate(divide="ignore"):
            reached[nodes[first]] = top + np.log(np.add.reduceat(spread, first))


@dataclass
class Model:
    languages: list[str]
    pieces: Pieces
    log_p: np.ndarray  # pieces x languages
    prior: np.ndarray

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word in each language."""
        out = [np.zeros((0, len(self.languages)))]
        for block in blocks([w.encode() for w in words]):
            lattice = Lattice(block, self.pieces)
            out.append(lattice.forward(self.log_p)[lattice.ends])
        return np.concatenate(out)


def blocks(words: list[bytes]) -> Iterator[list[bytes]]:
    """Runs of words that memory holds with all their segmentations; a longer word stands alone."""
    begin = held = 0
    for i, w in enumerate(words):
        if held and held + len(w) > BLOCK_BYTES:
            yield words[begin:i]
            begin, held = i, 0
        held += len(w)
    if begin < len(words):
        yield words[begin:]


def fit(rows: list[tuple[str, str]], vocabulary: Mapping[bytes, int], rounds: int = ROUNDS, smoothing: float = SMOOTHING) -> Model:
    """Fit on ``(text, language)`` rows. The rows, the vocabulary and so the work are bounded."""
    pieces = Pieces.of(vocabulary)
    counts: dict[str, Counter] = {}
    for text, language in rows:
        counts.setdefault(language, Counter()).update(words_of(text))
    languages = sorted(counts)
    texts = Counter(language for _, language in rows)
    prior = np.log(np.array([texts[x] + 1.0 for x in languages])) if languages else np.zeros(0)
    every = sorted(set().union(*counts.values())) if counts else []
    coded = [w.encode() for w in every]
    log_p = np.full((pieces.count, len(languages)), -np.log(pieces.count))
    for _ in range(rounds if languages else 0):
        expected, done = np.zeros((pieces.count, len(languages))), 0
        for block in blocks(coded):
            words = every[done : done + len(block)]
            done += len(block)
            weight = np.array([[counts[x][w] for x in languages] for w in words], float)
            lattice = Lattice(block, pieces)
            ahead, behind = lattice.forward(log_p), lattice.backward(log_p)
            word = np.repeat(np.arange(len(block)), lattice.lengths + 1)[lattice.source]
            used = np.exp(ahead[lattice.source] + log_p[lattice.piece] + behind[lattice.target] - ahead[lattice.ends][word]) * weight[word]
            for k in range(len(languages)):
                expected[:, k] += np.bincount(lattice.piece, used[:, k], pieces.count)
        shared = expected.sum(1) + 0.01
        shared /= shared.sum()
        log_p = np.log((expected + smoothing * shared[:, None]) / (expected.sum(0) + smoothing))
    return Model(languages, pieces, log_p, prior)


def sample(labelled: DataFrame, text: str, lang: str, rows: int, max_bytes: int) -> list[tuple[str, str]]:
    """A bounded sample: per language (the 1,000 most frequent) about 1.3 times ``rows`` rows in a fixed part of the range
    of a row hash, in order of that hash, as far as the language's equal part of ``max_bytes`` goes; single texts above
    1/64 of ``max_bytes`` are left out."""
    known = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    coded = known.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(*known.columns).alias("_h"), F.octet_length(text).alias("_n"))
    coded = coded.where(F.col("_n") <= max_bytes // 64)
    sizes = coded.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(1000).collect()
    if not sizes:
        return []
    share = coded.join(F.broadcast(coded.sparkSession.createDataFrame([(r["lang"], r["n"]) for r in sizes], "lang string, n long")), "lang")
    # a fixed part of the hash range holds about the wanted number of each language's rows
    span = F.least(F.lit(1.0), F.lit(1.3) * rows / F.col("n"))
    drawn = share.where(F.pmod("_h", F.lit(1 << 30)) < span * (1 << 30))
    picked, held, part = [], Counter(), max_bytes // len(sizes)
    for r in drawn.select("lang", "text", "_h", "_n").orderBy("_h", "lang").toLocalIterator():
        language = r["lang"]
        # the first text of a language is always taken, or many languages would leave some without any
        if not held[language] or held[language] + r["_n"] <= part:
            picked.append((r["text"], language))
            held[language] += r["_n"]
    return picked


def train(labelled: DataFrame, vocabulary: Mapping[bytes, int], text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS, max_bytes: int = SAMPLE_BYTES) -> Model:
    return fit(sample(labelled, text, lang, rows, max_bytes), vocabulary)


class Reader:
    """Scores texts; remembers the words it has seen."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.languages)))

    def __call__(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if len(self.known) > STORE_WORDS:
            self.forget()
        cut = [words_of(t) for t in texts]
        every = [w for text in cut for w in text]
        new = [w for w in dict.fromkeys(every) if w not in self.known]
        if new:
            self.scores = np.concatenate([self.scores, self.model.word_scores(new)])
            for w in new:
                self.known[w] = len(self.known)
        at = np.fromiter(map(self.known.__getitem__, every), np.int64, len(every))
        owner = np.repeat(np.arange(len(texts)), [len(c) for c in cut])
        languages = len(self.model.languages)
        total = np.stack([np.bincount(owner, self.scores[at, k], len(texts)) for k in range(languages)], 1) if languages else np.zeros((len(texts), 0))
        names, best = [], []
        for i, text in enumerate(texts):
            if not languages or not (cut[i] or _ANY_LETTER.search(text)):
                names.append("und")
                best.append(0.0)
                continue
            row = total[i] + self.model.prior
            row = np.exp(row - row.max())
            k = int(row.argmax())
            names.append(self.model.languages[k])
            best.append(float(row[k] / row.sum()))
        return names, best


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score``, the posterior of that language."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            for part in slices(batch, text):
                names, best = reader(filled(part.column(text)).to_pylist())
                kept = {n: part.column(i) for i, n in enumerate(part.schema.names) if n not in ("lang_pred", "score")}
                yield pa.RecordBatch.from_pydict(kept | {"lang_pred": pa.array(names, pa.string()), "score": pa.array(best, pa.float64())})

    fields = [f for f in df.schema.fields if f.name not in ("lang_pred", "score")]
    return df.mapInArrow(read, T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def held_out(doc_id: Column) -> Column:
    """Rows no model may learn from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))
