"""Document fingerprints as invertible Bloom lookup tables over hashed paragraphs.

A text is cut into paragraphs: lines, longer lines after words whose hash has three zero bits, so
that the cuts depend on the words alone, and each of a text's first words, so that short texts
have several paragraphs too.
Each paragraph's digest holds 48 hash bits, which tell apart repeats within a text, and 16 bits
of its length in bytes. A table keeps, per cell, the number, the sum of digests and the sum of
their checks. Subtracting the tables of two versions leaves what differs; cells with a single
digest are peeled off until none is left. If digests remain, both tables are made four times
as large and the subtraction is tried again, until it succeeds.

The fingerprint is the smallest table, in base64. Likeness is 1 minus the bytes of the
recovered digests over the bytes of all paragraphs of both texts; two empty texts are alike (1).

Null texts count as empty. Rows are ordered by ``doc_id``, a null one first, equal ones by a hash of
their text; the last row's next is the first, also if it is the only one. Extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpanel.llm.arrowtext import WORD_BYTE, RangeHash, byte_codes, filled, flat, mix, runs, slices
from gridpanel.llm.bpe import gather

#: Cells of each of a table's three parts, at first; and how much larger each retry is.
CELLS, GROWTH = 4, 4
#: So many words at the head of a text are paragraphs of their own.
HEAD_WORDS = 12
#: Bytes of text in a range of rows that one task compares.
RANGE_BYTES = 128 << 20

#: Bytes of a paragraph that a digest counts.
LONGEST = 0xFFFF

_CODES = byte_codes()
_STEPS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_LOWEST = -(1 << 63)


def digests(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Paragraph digests of all texts, one text after the other, and the number of each text's."""
    texts = len(offsets) - 1
    starts, ends, owner = runs(WORD_BYTE[data], offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(texts, np.int64)
    ranged = RangeHash(data, _CODES)
    word = ranged(starts, ends)
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    last = np.append((owner[1:] != owner[:-1]) | (lines[starts[1:]] != lines[ends[:-1]]), True)
    place = np.arange(len(starts)) - np.searchsorted(owner, owner)
    cut = last | (word & np.uint64(7) == 0) | (place < HEAD_WORDS)
    to = np.flatnonzero(cut)
    first = np.concatenate([[0], to[:-1] + 1])
    begin, end, owner = _bounded(starts[first], ends[to], owner[to])
    h = ranged(begin, end)
    length = (end - begin).astype(np.uint64)
    key = _numbered(h, owner, np.uint64(0xFFFF), length)
    return key, np.bincount(owner, minlength=texts)


def _bounded(begin: np.ndarray, end: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Paragraphs whose length does not fit a digest are cut into pieces that do."""
    parts = -(-(end - begin) // LONGEST)
    if (parts <= 1).all():
        return begin, end, owner
    piece = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    begin, end = np.repeat(begin, parts) + piece * LONGEST, np.repeat(end, parts)
    return begin, np.minimum(begin + LONGEST, end), np.repeat(owner, parts)


def _repeats(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which occurrence (from 0) of its key in its text each is."""
    order = np.lexsort((keys, owner))
    same = np.concatenate([[False], (keys[order][1:] == keys[order][:-1]) & (owner[order][1:] == owner[order][:-1])])
    at = np.arange(len(keys))
    turn = np.empty(len(keys), np.int64)
    turn[order] = at - np.maximum.accumulate(np.where(same, 0, at))
    return turn


def _numbered(h: np.ndarray, owner: np.ndarray, low: np.uint64, length: np.ndarray) -> np.ndarray:
    """Digests, the length in their low bits, all different within a text.

    Repeats of a paragraph get a number; digests that still agree move on to the next ones
    that are free, so equal texts have equal digests whatever collides.
    """
    key = (mix(h + _repeats(h, owner).astype(np.uint64) * _STEPS[1]) & ~low) | length
    while (turn := _repeats(key, owner)).any():
        key += turn.astype(np.uint64) * (low + np.uint64(1))
    return key


def _places(keys: np.ndarray, cells: int) -> list[np.ndarray]:
    return [i * cells + (mix(keys + step) % np.uint64(cells)).astype(np.int64) for i, step in enumerate(_STEPS)]


def _check(keys: np.ndarray) -> np.ndarray:
    return mix(keys ^ np.uint64(0x5851F42D4C957F2D))


class Tables:
    """Tables of many texts, or differences of many pairs, side by side."""

    def __init__(self, rows: int, cells: int):
        self.cells, self.width = cells, 3 * cells
        self.count = np.zeros(rows * self.width, np.int64)
        self.keys = np.zeros(rows * self.width, np.uint64)
        self.checks = np.zeros(rows * self.width, np.uint64)

    def add(self, row: np.ndarray, keys: np.ndarray, sign: np.ndarray) -> None:
        signed = sign.astype(np.uint64)  # -1 wraps round, as all sums do
        values, checks = keys * signed, _check(keys) * signed
        for place in _places(keys, self.cells):
            at = row * self.width + place
            np.add.at(self.count, at, sign)
            np.add.at(self.keys, at, values)
            np.add.at(self.checks, at, checks)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows, digests and signs recovered; and which rows are left with nothing."""
        found: list[tuple[np.ndarray, ...]] = []
        open_ = np.flatnonzero(np.abs(self.count) == 1)
        for _ in range(64 + 4 * self.width):
            sign = self.count[open_]
            keys = self.keys[open_] * sign.astype(np.uint64)
            pure = (np.abs(sign) == 1) & (_check(keys) * sign.astype(np.uint64) == self.checks[open_])
            if not pure.any():
                break
            row, keys, sign = open_[pure] // self.width, keys[pure], sign[pure]
            order = np.lexsort((keys, row))
            row, keys, sign = row[order], keys[order], sign[order]
            new = np.concatenate([[True], (row[1:] != row[:-1]) | (keys[1:] != keys[:-1])])
            row, keys, sign = row[new], keys[new], sign[new]
            found.append((row, keys, sign))
            self.add(row, keys, -sign)
            open_ = np.unique(np.concatenate([row * self.width + p for p in _places(keys, self.cells)]))
        blank = (self.count == 0) & (self.keys == 0) & (self.checks == 0)
        rows, keys, signs = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return rows, keys, signs, blank.reshape(-1, self.width).all(1)

    def pack(self) -> list[str]:
        """Each row as text: little-endian counts, sums and half of each check."""
        parts = [
            self.count.astype("<i4").reshape(-1, self.width).view(np.uint8),
            self.keys.astype("<u8").reshape(-1, self.width).view(np.uint8),
            (self.checks & np.uint64(0xFFFFFFFF)).astype("<u4").reshape(-1, self.width).view(np.uint8),
        ]
        return [base64.b64encode(r.tobytes()).decode() for r in np.concatenate(parts, 1)]


class Pool:
    """Digests of a list of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.keys, self.counts = digests(data, offsets)
        self.starts = np.cumsum(self.counts) - self.counts
        self.owner = np.repeat(np.arange(len(self.counts)), self.counts)
        self.bytes = np.bincount(self.owner, (self.keys & np.uint64(0xFFFF)).astype(float), len(self.counts))

    def of(self, i: int) -> np.ndarray:
        return self.keys[self.starts[i] : self.starts[i] + self.counts[i]]

    def fingerprints(self) -> list[str]:
        tables = Tables(len(self.counts), CELLS)
        tables.add(self.owner, self.keys, np.ones(len(self.keys), np.int64))
        return tables.pack()


def _exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests and signs by which two lists differ as multisets."""
    keys, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    sign = np.bincount(at, np.concatenate([np.ones(len(a)), -np.ones(len(b))]), len(keys)).astype(np.int64)
    times = np.abs(sign)
    return np.repeat(keys, times), np.repeat(np.sign(sign), times)


def differences(a: Pool, at_a: np.ndarray, b: Pool, at_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pair number, digest and sign (1: only in a, -1: only in b) of all that differs; and each pair's cells."""
    left = np.arange(len(at_a))
    needed = np.zeros(len(at_a), np.int64)
    out: list[tuple[np.ndarray, ...]] = []
    cells = CELLS
    while len(left):
        # a difference of d digests at least needs more than d cells
        apart = np.abs(a.counts[at_a[left]] - b.counts[at_b[left]])
        now = left[apart < 3 * cells] if len(left) else left
        failed = [left[apart >= 3 * cells]]
        for part in np.array_split(now, max(1, len(now) * cells * 3 // 400_000)):
            tables = Tables(len(part), cells)
            for pool, at, sign in ((a, at_a, 1), (b, at_b, -1)):
                sizes = pool.counts[at[part]]
                keys = gather(pool.keys, pool.starts[at[part]], sizes)
                tables.add(np.repeat(np.arange(len(part)), sizes), keys, np.full(len(keys), sign))
            row, keys, sign, done = tables.peel()
            whole = done[row]
            out.append((part[row[whole]], keys[whole], sign[whole]))
            needed[part[done]] = 3 * cells
            failed.append(part[~done])
        left = np.concatenate(failed)
        cells *= GROWTH
        # a table larger than both lists of digests has no advantage over them; what it could not part is compared as it is
        listed = a.counts[at_a[left]] + b.counts[at_b[left]] < cells
        for i in left[listed].tolist():
            keys, signs = _exact(a.of(at_a[i]), b.of(at_b[i]))
            out.append((np.full(len(keys), i), keys, signs))
            needed[i] = 3 * cells
        left = left[~listed]
    pair, keys, sign = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return pair, keys, sign, needed


def likeness(a: Pool, at_a: np.ndarray, b: Pool, at_b: np.ndarray) -> np.ndarray:
    pair, keys, _, _ = differences(a, at_a, b, at_b)
    apart = np.bincount(pair, (keys & np.uint64(0xFFFF)).astype(float), len(at_a))
    whole = a.bytes[at_a] + b.bytes[at_b]
    return np.where(whole > 0, 1.0 - apart / np.maximum(whole, 1.0), 1.0)


def edited(data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Every text but the last with its last quarter replaced by the beginning of the next; and code points."""
    points = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    at = np.searchsorted(points, offsets)
    chars = np.diff(at)
    n = chars[:-1]
    quarter = n // 4
    keep = points[at[:-2] + n - quarter] if len(n) else np.zeros(0, np.int64)
    take = points[at[1:-1] + np.minimum(quarter, chars[1:])] if len(n) else np.zeros(0, np.int64)
    raw = data.tobytes()
    bounds = zip(offsets[:-2].tolist(), keep.tolist(), offsets[1:-1].tolist(), take.tolist())
    return [raw[a:b] + raw[c:d] for a, b, c, d in bounds], chars


OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])


def compare(ids: pa.Array, data: np.ndarray, offsets: np.ndarray, use: np.ndarray) -> pa.RecordBatch:
    """Results of the rows ``use`` of a run of rows; each is compared with the row after it."""
    texts, chars = edited(data, offsets)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    old, new = Pool(data, offsets), Pool(np.frombuffer(b"".join(texts), np.uint8), bounds)
    prints, others = old.fingerprints(), new.fingerprints()
    return pa.RecordBatch.from_arrays(
        [
            ids.take(pa.array(use)),
            pa.array(chars[use], pa.int64()),
            pa.array([hashlib.sha256(texts[i]).hexdigest() for i in use], pa.string()),
            pa.array([prints[i] for i in use], pa.string()),
            pa.array([others[i] for i in use], pa.string()),
            pa.array(likeness(old, use, new, use), pa.float64()),
            pa.array(likeness(old, use, old, use + 1), pa.float64()),
        ],
        schema=OUT,
    )


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one or more ranges; every range ends with a copy of the row that follows it."""
    carry = None
    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            if carry is not None:
                part = pa.Table.from_batches([carry, part]).combine_chunks().to_batches()[0]
            n = part.num_rows - 1
            ranges, copy = part.column("_range").to_numpy(), part.column("_copy").to_numpy(zero_copy_only=False)
            use = np.flatnonzero(~copy[:-1] & (ranges[:-1] == ranges[1:]))
            if len(use):
                yield compare(part.column("doc_id"), *flat(filled(part.column("text"))), use)
            carry = part.slice(n)


def fingerprint_versions(docs: DataFrame, text: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Each text's fingerprint, its edited version's, and their likeness; likewise the next text's.

    The texts are shuffled once, into ranges of ``doc_id`` that begin at ids found in the table. A
    range's first row is also sent to the range before, so that every row stands beside its next.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id"), F.lit(_LOWEST))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), key.cast("long").alias("_key"))
    held = rows.agg(F.sum(F.octet_length("text")).alias("n"), F.min("_key").alias("low")).first()
    if held["low"] is None:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held["n"] // range_bytes))
    shares = [i / wanted for i in range(1, wanted)]
    cuts = rows.agg(F.percentile_approx("_key", shares, 20 * wanted).alias("c")).first()["c"] if shares else []
    bounds = sorted({held["low"], *cuts})  # ids that occur; as many as there are tasks

    @F.pandas_udf("long")
    def range_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(bounds, np.int64), keys.to_numpy(), "right") - 1)

    last = len(bounds) - 1
    placed = rows.withColumn("_own", range_of("_key"))
    first = F.col("_key").isin(bounds)
    before = F.when(F.col("_own") == 0, F.lit(last)).otherwise(F.col("_own") - 1)
    homes = F.array(F.struct(F.col("_own").alias("_range"), F.lit(False).alias("_copy")))
    homes = F.when(first, F.concat(homes, F.array(F.struct(before.alias("_range"), F.lit(True).alias("_copy"))))).otherwise(homes)
    sent = placed.select("doc_id", "text", "_key", F.inline(homes))
    dealt = sent.repartitionById(len(bounds), F.col("_range").cast("int"))
    ordered = dealt.sortWithinPartitions("_range", "_copy", "_key", F.xxhash64("text"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.select("doc_id", "text", "_range", "_copy").mapInArrow(_walk, schema)


def version_diff(df: DataFrame, before: str, after: str) -> DataFrame:
    """Add ``removed`` and ``added``, the digests that the peeling recovers between two text columns, and ``cells``."""
    from pyspark.sql import types as T

    def diff(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, before):
                a, b = (Pool(*flat(filled(part.column(c)))) for c in (before, after))
                at = np.arange(part.num_rows)
                pair, keys, sign, cells = differences(a, at, b, at)
                lists = {}
                for name, s in (("removed", 1), ("added", -1)):
                    of = sign == s
                    order = np.lexsort((keys[of], pair[of]))
                    ends = np.concatenate([[0], np.cumsum(np.bincount(pair[of], minlength=part.num_rows))])
                    lists[name] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[of][order].view(np.int64), pa.int64()))
                kept = {n: part.column(i) for i, n in enumerate(part.schema.names) if n not in ("removed", "added", "cells")}
                yield pa.RecordBatch.from_pydict(kept | lists | {"cells": pa.array(cells, pa.int64())})

    fields = [f for f in df.schema.fields if f.name not in ("removed", "added", "cells")]
    digest = T.ArrayType(T.LongType())
    return df.mapInArrow(diff, T.StructType([*fields, T.StructField("removed", digest), T.StructField("added", digest), T.StructField("cells", T.LongType())]))
