"""N-gram Jaccard self-join with rare-first prefix, length, positional and suffix filters.

A document's set holds its distinct shingles of five words as 64-bit hashes; documents with equal
sets form one class, so copies are never expanded. A table of shingle counts, sized by the
texts, orders the shingles of every set from rare to frequent. Two sets of enough overlap share a shingle
among the first ones of both, so classes meet on these prefix shingles only. Pairs must pass
bounds from their lengths, from the positions of the shared shingle, and from the sizes of the
parts into which fixed pivots split both sets. Each surviving pair is verified once, on the
whole sets.

Components need no link within them: the first rounds compare the members of a shingle's group
with one of them each, first the same for all shingles, then one drawn per shingle. What then
still lies in different components of a group is compared pair by pair, within bands of equal
length and bounded by parity maps of both sets, so no link between components is lost.

With ``every_link`` all links between classes are counted: every pair of a shingle's group is a
candidate, large groups are dealt in blocks so that no task holds a whole one, and a pair is
verified once however many shingles it shares.

Null and empty texts, and texts without words, have no shingles and link with nothing; fewer than five words
are one shingle. Rows with one ``doc_id`` are one node, whatever their texts; rows without are returned unlinked, with
a null component. Empty tables give no rows. Extra columns are ignored, except by
:func:`one_per_component`, which passes them on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpanel.llm.arrowtext import WORD_BYTE, RangeHash, byte_codes, filled, flat, handing_back, mix, runs, slices
from gridpanel.llm.components import JOIN, connected_components, kept
from gridpanel.session import written

WORDS = 5
#: Similarity as a fraction: documents link from 80 of 100 on.
NUM, DEN = 80, 100
#: Text per counter of the shingle table, and the least and most counters (of two bytes) it has.
BYTES_PER_COUNTER, LEAST_COUNTERS, MOST_COUNTERS = 256, 1 << 16, 1 << 25
#: Bytes of text whose shingles are held at once; a longer text is handled alone. Its arrays are some fifty times as large.
SLICE_BYTES = 1 << 20
#: Bits of the table of shared shingles.
SHARED_BITS = 1 << 25
#: Parts that the suffix filter splits a set into.
PARTS = 32
#: Bits of a set's parity map, in words of 64: every shingle turns one over.
WORDS_OF_BITS = 8
_MAP = [f"m{i}" for i in range(WORDS_OF_BITS)]
#: Rounds of one comparison per member before all pairs of different components are compared.
ROUNDS = 2
#: Members of a shingle's group that one block holds of either side of its pairs.
BLOCK_ROWS = 500

_CODES = byte_codes(fold_case=True)
_PLACE = mix(np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted within each, and the number of each text's."""
    texts = len(offsets) - 1
    starts, ends, owner = runs(WORD_BYTE[data], offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(texts, np.int64)
    word = RangeHash(data, _CODES)(starts, ends)
    count = np.bincount(owner, minlength=texts)
    first = np.cumsum(count) - count
    place = np.arange(len(word)) - first[owner]
    whole = np.flatnonzero(place <= count[owner] - WORDS)
    h = np.full(len(whole), WORDS, np.uint64)
    for k in range(WORDS):
        h += word[whole + k] * _PLACE[k]
    short = np.flatnonzero((count > 0) & (count < WORDS))
    g = count[short].astype(np.uint64)
    for k in range(WORDS - 1):
        has = count[short] > k
        g[has] += word[first[short[has]] + k] * _PLACE[k]
    h, who = np.concatenate([mix(h), mix(g)]), np.concatenate([owner[whole], short])
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(who[order].astype(np.int16 if texts < 1 << 15 else np.int64), kind="stable")]
    h, who = h[order], who[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (who[1:] != who[:-1])])
    return h[new], np.bincount(who[new], minlength=texts)


def fixed_table(df: DataFrame, fill: Callable[[np.ndarray, pa.RecordBatch], None], size: int, dtype: str, join: np.ufunc) -> np.ndarray:
    """One array of a fixed size over all rows: filled per task, joined per piece, then on the driver."""
    pieces = 32

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size, dtype)
        for batch in batches:
            fill(table, batch)
        cut = np.array_split(table, pieces)
        used = [i for i, c in enumerate(cut) if c.any()]
        yield pa.RecordBatch.from_pydict({"piece": pa.array(used, pa.int32()), "data": pa.array([cut[i].tobytes() for i in used], pa.binary())})

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(data.as_buffer(), dtype)
                held[i] = join(held[i], part) if i in held else part.copy()
        yield pa.RecordBatch.from_pydict({"piece": pa.array(list(held), pa.int32()), "data": pa.array([v.tobytes() for v in held.values()], pa.binary())})

    schema = "piece int, data binary"
    rows = df.mapInArrow(handing_back(partial), schema).repartition(pieces, "piece").mapInArrow(handing_back(total), schema).collect()
    found = {r["piece"]: np.frombuffer(bytes(r["data"]), dtype) for r in rows}
    return np.concatenate([found.get(i, np.zeros(len(c), dtype)) for i, c in enumerate(np.array_split(np.zeros(size, dtype), pieces))])


def counters_for(text_bytes: int) -> int:
    """Counters for texts of so many bytes: about forty shingles each, up to ``MOST_COUNTERS``."""
    return min(max(1 << (text_bytes // BYTES_PER_COUNTER).bit_length(), LEAST_COUNTERS), MOST_COUNTERS)


def shingle_counts(docs: DataFrame) -> np.ndarray:
    """How many documents have a shingle of each hash class, up to 65,535.

    Every task fills a table of its own, so the texts are read in a few tasks per core.
    """
    tasks = 2 * docs.sparkSession.sparkContext.defaultParallelism
    width = counters_for(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    most = np.iinfo(np.uint16).max

    def fill(table: np.ndarray, batch: pa.RecordBatch) -> None:
        for part in slices(batch, "text", SLICE_BYTES):
            h, _ = shingles(*flat(filled(part.column("text"))))
            at, n = np.unique((h & np.uint64(width - 1)).astype(np.int64), return_counts=True)
            table[at] = np.minimum(table[at] + n, most)

    def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.minimum(a.astype(np.uint32) + b, most).astype(np.uint16)

    return fixed_table(docs.select("text").coalesce(tasks), fill, width, "uint16", add)


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))


def index(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """``doc_id, n, sig_a, sig_b`` (the set's signature), ``prefix`` (rarest shingles first), ``parts`` and parity map."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                h, n = shingles(*flat(filled(part.column("text"))))
                rows = len(n)
                who = np.repeat(np.arange(rows), n)
                ends = np.concatenate([[0], np.cumsum(n)])
                sums = []
                for salt in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
                    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(salt)))])
                    sums.append((running[ends[1:]] - running[ends[:-1]]).view(np.int64))
                size = np.bincount(who * PARTS + (h >> np.uint64(59)).astype(np.int64), minlength=rows * PARTS)
                turned = np.bincount(who * 64 * WORDS_OF_BITS + (mix(h + np.uint64(0xA24BAED4963EE407)) % np.uint64(64 * WORDS_OF_BITS)).astype(np.int64), minlength=rows * 64 * WORDS_OF_BITS) & 1
                maps = np.packbits(turned.astype(np.uint8).reshape(rows, -1), axis=1, bitorder="little").view("<i8")
                # one order for all sets: the count of a shingle's class, then its hash
                rare = (counts[(h & np.uint64(len(counts) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(32)) | (h >> np.uint64(32))
                order = np.argsort(rare, kind="stable")
                order = order[np.argsort(who[order].astype(np.int16 if rows < 1 << 15 else np.int64), kind="stable")]
                place = np.arange(len(h)) - ends[who]
                prefix = n - (NUM * n + DEN - 1) // DEN + 1
                prefix[n == 0] = 0
                first = h[order][place < prefix[who]].view(np.int64)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "n": pa.array(n, pa.int64()), "sig_a": pa.array(sums[0]), "sig_b": pa.array(sums[1]),
                    "prefix": _lists(first, prefix, pa.int64()),
                    "parts": _lists(np.minimum(size, 1 << 30), np.full(rows, PARTS), pa.int32()),
                } | {name: pa.array(maps[:, i]) for i, name in enumerate(_MAP)})

    schema = "doc_id long, n long, sig_a long, sig_b long, prefix array<long>, parts array<int>, " + ", ".join(f"{m} long" for m in _MAP)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(handing_back(read), schema)


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tuple((mix(h + np.uint64(s)) & np.uint64(SHARED_BITS - 1)).astype(np.int64) for s in (1, 2))


def shared_shingles(found: DataFrame, classes: DataFrame) -> DataFrame:
    """``h, sig, id, n, pos`` of prefix shingles that different sets share, and of a few others."""
    spark = found.sparkSession
    rows = found.where("n > 0 AND doc_id IS NOT NULL")
    meeting = (
        rows.select("sig_a", F.explode("prefix").alias("h")).groupBy("h").agg(F.min("sig_a").alias("lo"), F.max("sig_a").alias("hi")).where("lo <> hi").select("h")
    )
    meeting = kept(meeting)

    def fill(table: np.ndarray, batch: pa.RecordBatch) -> None:
        for bit in _bits(batch.column(0).to_numpy().view(np.uint64)):
            np.bitwise_or.at(table, bit >> 3, (1 << (bit & 7)).astype(np.uint8))

    # a table of fixed size thins the rows before they are dealt by shingle; it keeps too many, never too few
    shared = spark.sparkContext.broadcast(fixed_table(meeting, fill, SHARED_BITS // 8, "uint8", np.bitwise_or))

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            lists = batch.column("prefix")
            h, counts = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            who = np.repeat(np.arange(batch.num_rows), counts)
            pos = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
            keep = np.ones(len(h), bool)
            for bit in _bits(h.view(np.uint64)):
                keep &= (table[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
            row = pa.array(who[keep])
            yield pa.RecordBatch.from_pydict({"h": pa.array(h[keep]), "sig": batch.column("sig_a").take(row), "id": batch.column("doc_id").take(row), "n": batch.column("n").take(row).cast(pa.int32()), "pos": pa.array(pos[keep], pa.int32())})

    thinned = rows.select("doc_id", "sig_a", "n", "prefix").mapInArrow(handing_back(thin), "h long, sig long, id long, n int, pos int")
    # of equal sets only the one that stands for their class
    return thinned.join(classes.select(F.col("sig_a").alias("sig"), "id"), ["id", "sig"], "left_semi").select("h", "sig", "id", "n", "pos")


def distinct_groups(group: DataFrame) -> DataFrame:
    """``group`` with one shingle for each set of members, and none that a single class holds.

    Shingles that the same classes share bring up the same pairs. The one that comes first in the order of
    all sets stays: there the members have the most behind it, so no filter loses a pair by it.
    """
    members = group.groupBy("h").agg(
        F.count(F.lit(1)).alias("_n"), F.bit_xor(F.xxhash64("id")).alias("_a"), F.bit_xor(F.xxhash64("id", F.lit(7))).alias("_b"), F.sum("pos").alias("_p"))
    first = members.where("_n > 1").groupBy("_n", "_a", "_b").agg(F.min(F.struct("_p", "h")).alias("_f")).select("_f.h")
    return group.join(first.hint(JOIN), "h", "left_semi")


def sets_of(docs: DataFrame, ids: DataFrame, small: bool) -> DataFrame:
    """``id, sig_a, set`` of the documents ``ids`` (``id, sig_a``); a repeated id comes as often as it has that set."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                h, n = shingles(*flat(filled(part.column("text"))))
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(0x2545F4914F6CDD1D)))])
                ends = np.concatenate([[0], np.cumsum(n)])
                sig = (sums[ends[1:]] - sums[ends[:-1]]).view(np.int64)
                yield pa.RecordBatch.from_pydict({"id": part.column("id"), "sig_a": part.column("sig_a"), "own": pa.array(sig), "set": _lists(h.view(np.int64), n, pa.int64())})

    wanted = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(ids) if small else ids, "id").select("id", "sig_a", "text")
    return wanted.mapInArrow(handing_back(read), "id long, sig_a long, own long, set array<long>").where("own = sig_a").select("id", "sig_a", "set")


def _near(n: str, m: str, pos: str, at: str) -> Column:
    """The length and positional filters."""
    need = F.ceil(F.lit(NUM) * (F.col(n) + F.col(m)) / F.lit(NUM + DEN))
    most = F.least(F.col(n) - F.col(pos), F.col(m) - F.col(at))  # this shingle and all behind it
    return (F.lit(DEN) * F.least(n, m) >= F.lit(NUM) * F.greatest(n, m)) & (most >= need)


def _across(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of different components that share a prefix shingle and pass the filters."""
    return _ordered(left.join(right.hint(JOIN), "h").where((F.col("comp") != F.col("other")) & _near("n", "m", "pos", "at")))


def _ordered(passed: DataFrame) -> DataFrame:
    """Pairs by signature, each once however many shingles it shares."""
    first = F.col("sig") < F.col("with")
    ends = (("a", "sig", "with"), ("b", "with", "sig"), ("a_id", "id", "with_id"), ("b_id", "with_id", "id"), ("a_comp", "comp", "other"), ("b_comp", "other", "comp"))
    return passed.select(*[F.when(first, F.col(x)).otherwise(F.col(y)).alias(n) for n, x, y in ends]).distinct()


def _pairs_across(group: DataFrame, maps: DataFrame) -> DataFrame:
    """All pairs of different components that share a prefix shingle and pass the filters, each once.

    Sets that can link have lengths of one band or of two neighbouring ones, so members meet by
    shingle and band, the shorter one first. Two parity maps differ in at most as many bits as the sets
    differ in shingles, which bounds the overlap of a pair before it leaves the join.
    """
    group = group.join(maps.hint(JOIN), ["id", "sig"])
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(DEN / NUM + 1e-4))).cast("int")
    left = group.select("h", F.explode(F.array(band, band + 1)).alias("band"), "sig", "id", "n", "pos", "comp", *_MAP)
    right = group.select(
        "h", band.alias("band"), F.col("sig").alias("with"), F.col("id").alias("with_id"), F.col("n").alias("m"), F.col("pos").alias("at"),
        F.col("comp").alias("other"), *[F.col(m).alias(f"o_{m}") for m in _MAP])
    shorter = (F.col("n") < F.col("m")) | (F.col("n") == F.col("m")) & (F.col("sig") < F.col("with"))
    apart = reduce(lambda a, b: a + b, [F.bit_count(F.col(m).bitwiseXOR(F.col(f"o_{m}"))) for m in _MAP])
    total = (F.col("n") + F.col("m")).cast("long")
    # twice the overlap is at most the total less what differs
    alike = F.lit(NUM + DEN) * (total - apart) >= F.lit(2 * NUM) * total
    passed = left.join(right.hint(JOIN), ["h", "band"]).where((F.col("comp") != F.col("other")) & shorter & _near("n", "m", "pos", "at") & alike)
    return _ordered(passed)


def _every_pair(group: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All pairs of different sets that share a prefix shingle and pass the filters.

    A group is dealt into blocks of about ``block_rows`` and joined block by block.
    """
    sized = group.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("_of")).where("_of > 1")
    dealt = group.join(sized.hint(JOIN), "h", "left").withColumn("_of", F.coalesce("_of", F.lit(1)))
    dealt = dealt.withColumn("_own", F.pmod(F.xxhash64("sig"), F.col("_of")).cast("int"))
    left = dealt.select("h", F.col("_own").alias("_i"), F.explode(F.sequence("_own", F.col("_of") - 1)).alias("_j"), "sig", "id", "n", "pos")
    right = dealt.select(
        "h", F.explode(F.sequence(F.lit(0), "_own")).alias("_i"), F.col("_own").alias("_j"),
        F.col("sig").alias("with"), F.col("id").alias("with_id"), F.col("n").alias("m"), F.col("pos").alias("at"),
    )
    once = (F.col("_i") < F.col("_j")) & (F.col("sig") != F.col("with")) | (F.col("_i") == F.col("_j")) & (F.col("sig") < F.col("with"))
    passed = left.join(right.hint(JOIN), ["h", "_i", "_j"]).where(once & _near("n", "m", "pos", "at"))
    first = F.col("sig") < F.col("with")
    ends = (("a", "sig", "with"), ("b", "with", "sig"), ("a_id", "id", "with_id"), ("b_id", "with_id", "id"))
    return passed.select(*[F.when(first, F.col(x)).otherwise(F.col(y)).alias(n) for n, x, y in ends]).distinct()


def _verified(pairs: DataFrame, count: int, found: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs that link: first bounded by the sizes of their parts, then compared as whole sets.

    ``a`` and ``b`` are signatures, ``a_id`` and ``b_id`` documents that have these sets. ``count``, the
    number of pairs, bounds what is broadcast; more pairs are joined by a shuffle.
    """
    small = count <= 1_000_000
    def side(table: DataFrame, name: str, *cols: str) -> DataFrame:
        return table.select(F.col("sig_a").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in cols])

    def ends(table: DataFrame) -> DataFrame:
        both = F.array(*[F.struct(F.col(f"{e}_id").alias("id"), F.col(e).alias("sig_a")) for e in ("a", "b")])
        return table.select(F.inline(both)).distinct()

    facts = found.where("n > 0").select(F.col("doc_id").alias("id"), "n", "parts", "sig_a")
    facts = facts.join(F.broadcast(ends(pairs)) if small else ends(pairs), ["id", "sig_a"], "left_semi")
    sized = pairs.join(side(facts, "a", "n", "parts").hint(JOIN), "a").join(side(facts, "b", "n", "parts").hint(JOIN), "b")
    total = F.col("a_n") + F.col("b_n")
    enough = lambda overlap: F.lit(DEN) * overlap >= F.lit(NUM) * (total - overlap)
    most = F.aggregate(F.zip_with("a_parts", "b_parts", lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda s, x: s + x)
    likely = kept(sized.where(enough(most)).drop("a_parts", "b_parts").distinct())
    sets = sets_of(docs, ends(likely), small)
    both = (F.broadcast(likely) if count <= 200_000 else likely).join(side(sets, "a", "set"), "a").join(side(sets, "b", "set"), "b")
    overlap = F.size(F.array_intersect("a_set", "b_set")).cast("long")
    return both.where(enough(overlap)).select(*pairs.columns).distinct()


def _relabelled(labels: DataFrame, group: DataFrame, joins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with components drawn together along ``joins`` (``a, b``)."""
    to = connected_components(joins).select(F.col("node").alias("component"), F.col("component").alias("_to")).hint(JOIN)
    labels = labels.join(to, "component", "left").select("id", F.coalesce("_to", "component").alias("component"))
    group = group.join(to.withColumnRenamed("component", "comp").hint(JOIN), "comp", "left").select("h", "sig", "id", "n", "pos", F.coalesce("_to", "comp").alias("comp"))
    return labels, group


def components(docs: DataFrame, text: str = "text", rounds: int = ROUNDS, every_link: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id``.

    ``every_link`` adds ``n_links``: the other sets, held by rows with a ``doc_id``, that the
    row's set links with; documents of equal sets count as one. Without it ``rounds`` of one comparison
    per member find most of every component, and links within one are not looked for.
    """
    docs = docs.select("doc_id", F.col(text).alias("text"))
    found = written(index(docs, shingle_counts(docs)), "jaccard-index")
    members = found.select("doc_id", "n", "sig_a", "sig_b")
    classes = members.where("n > 0 AND doc_id IS NOT NULL").groupBy("sig_a", "sig_b").agg(F.min("doc_id").alias("id"))
    classes = kept(classes)
    group = written(shared_shingles(found, classes), "jaccard-shared")
    group = written(distinct_groups(group), "jaccard-groups").withColumn("comp", F.col("id"))
    tried = None
    labels = classes.select("id", F.col("id").alias("component"))
    # a doc_id with several texts joins their classes
    held = members.where("n > 0 AND doc_id IS NOT NULL").join(classes, ["sig_a", "sig_b"]).select("doc_id", "id")
    spread = held.groupBy("doc_id").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi")
    tied = kept(held.join(spread, "doc_id").where("id <> lo").select(F.col("id").alias("a"), F.col("lo").alias("b")).distinct())
    if every_link:
        pairs = kept(_every_pair(group))
        links = kept(_verified(pairs, pairs.count(), found, docs))
        labels, group = _relabelled(labels, group, links.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).unionByName(tied))
    elif not tied.isEmpty():
        labels, group = _relabelled(labels, group, tied)
    for turn in range(0 if every_link else rounds + 1):
        rank = F.xxhash64("id") if turn == 0 else F.xxhash64("id", "h", F.lit(turn))
        one = F.min(F.struct(rank.alias("rank"), F.col("sig").alias("with"), F.col("id").alias("with_id"), F.col("n").alias("m"), F.col("pos").alias("at"), F.col("comp").alias("other")))
        # groups that lie in more than one component, and one member of each
        open_ = group.groupBy("h").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), one.alias("_o")).where("_lo <> _hi")
        if turn < rounds:
            pairs = _across(group, open_.select("h", "_o.with", "_o.with_id", "_o.m", "_o.at", "_o.other"))
        else:
            group = kept(group.join(open_.select("h"), "h", "left_semi"))
            maps = found.where("n > 0").select(F.col("doc_id").alias("id"), F.col("sig_a").alias("sig"), *_MAP).dropDuplicates(["id", "sig"])
            pairs = _pairs_across(group, maps)
        if tried is not None:
            pairs = pairs.join(tried.hint(JOIN), ["a", "b"], "left_anti")
        pairs = kept(pairs)
        count = pairs.count()
        if not count:
            continue
        tried = pairs.select("a", "b") if tried is None else tried.union(pairs.select("a", "b"))
        new = kept(_verified(pairs, count, found, docs))
        if new.isEmpty():
            continue
        # components of components: only what this round joins is looked at
        labels, group = _relabelled(labels, group, new.select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b")))
    of_class = classes.join(labels.distinct(), "id").withColumnRenamed("component", "component_id")
    if every_link:
        ends = links.select(F.explode(F.array("a", "b")).alias("sig_a")).groupBy("sig_a").agg(F.count(F.lit(1)).alias("n_links"))
        of_class = of_class.join(ends, "sig_a", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long")))
    else:
        of_class = of_class.withColumn("n_links", F.lit(0).cast("long"))
    told = members.join(of_class, ["sig_a", "sig_b"], "left")
    linked = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    told = told.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(linked, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(linked, F.col("n_links")).otherwise(F.lit(0).cast("long")).alias("n_links"),
    )
    return told if every_link else told.drop("n_links")


def one_per_component(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without those that have an earlier near copy: the smallest id of each component stays."""
    told = components(docs, text)
    gone = kept(told.groupBy("doc_id").agg(F.min("component_id").alias("_c")).where("_c < doc_id").select("doc_id"))
    return docs.join(gone, "doc_id", "left_anti")
