"""Exact deduplication of an incoming batch against an immutable snapshot.

The snapshot's distinct digests are dealt to shards of bounded size; each shard gets one
static binary-fuse filter, built once. Incoming digests are grouped among themselves first,
then each shard screens its own. What the filter rejects is new for certain; positives join
the snapshot's exact digests. Every group of two or more rows is then checked byte by byte.

Null texts count as empty, and empty texts equal each other. Of equal rows with one
``doc_id`` exactly one is kept. A null ``doc_id`` is smaller than all others. Empty tables give
no rows. Extra columns are ignored, except by :func:`drop_duplicates`, which passes them on.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpanel.llm.arrowtext import mix
from gridpanel.session import broadcast_if_small, materialize

#: Digests a shard holds on average; its filter takes a little over one byte for each.
SHARD_KEYS = 50_000


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class BinaryFuse:
    """A static filter over distinct 64-bit keys: no false negatives, about 1 in 256 false positives.

    Every key owns one slot in each of three neighbouring segments; its 8-bit fingerprint is
    the XOR of the three. Slots are assigned in the reverse order of a peeling that takes, in
    one numpy step, all slots which a single remaining key owns.
    """

    def __init__(self, keys: np.ndarray):
        keys = np.unique(keys.astype(np.uint64))
        n = max(len(keys), 1)
        self.segment = 1 << max(2, int(np.floor(np.log(n) / np.log(3.33) + 2.25)))
        factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
        self.segments = max(1, int(np.ceil(n * factor / self.segment)) - 2)
        for seed in range(1, 200):
            self.seed = seed
            if self._assign(keys):
                return
            if seed % 20 == 0:  # small sets sometimes need more room
                self.segments += 1
        raise RuntimeError("the filter could not be built")

    def _slots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix(keys + np.uint64(self.seed) * np.uint64(0x9E3779B97F4A7C15))
        first = ((h >> np.uint64(32)) * np.uint64(self.segments) >> np.uint64(32)).astype(np.int64) * self.segment
        low, mask = h & np.uint64(0xFFFFFFFF), np.uint64(self.segment - 1)
        inside = [(low & mask), (low >> np.uint64(9)) & mask, (mix(low + np.uint64(1)) & mask)]
        slots = np.stack([first + i * self.segment + x.astype(np.int64) for i, x in enumerate(inside)])
        return slots, (mix(h) & np.uint64(0xFF)).astype(np.uint8)

    def _assign(self, keys: np.ndarray) -> bool:
        size = (self.segments + 2) * self.segment
        slots, prints = self._slots(keys)
        count = np.bincount(slots.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)
        index = np.arange(len(keys))
        for row in slots:
            np.bitwise_xor.at(owner, row, index)
        left, layers = len(keys), []
        single = np.flatnonzero(count == 1)
        while len(single):
            key, pick = np.unique(owner[single], return_index=True)
            layers.append((key, single[pick]))
            left -= len(key)
            gone = slots[:, key]
            np.subtract.at(count, gone.ravel(), 1)
            for row in gone:
                np.bitwise_xor.at(owner, row, key)
            touched = np.unique(gone)
            single = touched[count[touched] == 1]
        self.table = np.zeros(size, np.uint8)
        if left:
            return False
        for key, slot in reversed(layers):
            at = slots[:, key]
            others = self.table[at[0]] ^ self.table[at[1]] ^ self.table[at[2]] ^ self.table[slot]
            self.table[slot] = prints[key] ^ others
        return True

    def __contains__(self, key: int) -> bool:
        return bool(self.test(np.array([key], np.uint64))[0])

    def test(self, keys: np.ndarray) -> np.ndarray:
        slots, prints = self._slots(keys.astype(np.uint64))
        return (self.table[slots[0]] ^ self.table[slots[1]] ^ self.table[slots[2]]) == prints

    def pack(self) -> bytes:
        return np.array([self.segment, self.segments, self.seed], "<u8").tobytes() + self.table.tobytes()

    @classmethod
    def unpack(cls, blob: bytes) -> BinaryFuse:
        self = cls.__new__(cls)
        self.segment, self.segments, self.seed = map(int, np.frombuffer(blob[:24], "<u8"))
        self.table = np.frombuffer(blob[24:], np.uint8)
        return self


def build_filters(groups: DataFrame, shards: int) -> DataFrame:
    """One packed filter per shard of the snapshot's distinct ``digest`` values."""
    def build(part: pd.DataFrame) -> pd.DataFrame:
        packed = BinaryFuse(part["_key"].to_numpy().view(np.uint64)).pack()
        return pd.DataFrame({"_shard": part["_shard"].iloc[:1], "filter": [packed]})

    keyed = groups.select(_shard(shards), F.xxhash64("digest").alias("_key"))
    return keyed.groupBy("_shard").applyInPandas(build, "_shard long, filter binary")


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("digest", F.lit("shard")), F.lit(shards)).cast("long").alias("_shard")


def screen(incoming: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """Incoming distinct digests that their shard's filter lets through."""
    def test(new: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(known) or not len(new):
            return new.iloc[:0][["digest"]]
        passed = BinaryFuse.unpack(known["filter"].iloc[0]).test(new["_key"].to_numpy().view(np.uint64))
        return new.loc[passed, ["digest"]]

    keyed = incoming.select("digest", _shard(shards), F.xxhash64("digest").alias("_key"))
    return keyed.groupBy("_shard").cogroup(filters.groupBy("_shard")).applyInPandas(test, "digest binary")


def _groups(rows: DataFrame) -> DataFrame:
    """One row per digest; the partial aggregate takes care of digests that many rows share."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def duplicate_groups(
    snapshot: DataFrame,
    incoming: DataFrame,
    text: str = "text",
    digest: Callable[[Column], Column] = sha256,
    shard_keys: int = SHARD_KEYS,
) -> DataFrame:
    """One row per row of both tables: ``doc_id, keep_id, group_size, kept, digest``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = materialize(
        snapshot.select("doc_id", digest(whole).alias("digest"), F.lit(True).alias("_old")).unionByName(
            incoming.select("doc_id", digest(whole).alias("digest"), F.lit(False).alias("_old"))
        )
    )
    old, new = materialize(_groups(rows.where("_old"))), materialize(_groups(rows.where("NOT _old")))
    shards = max(1, -(-max(old.count(), new.count()) // shard_keys))
    hits = screen(new, build_filters(old, shards), shards)
    # exact buckets: a filter's false positives find no partner here
    met = materialize(
        new.join(hits, "digest").join(old.select("digest", F.col("keep_id").alias("_k"), F.col("group_size").alias("_n")), "digest")
    ).select("digest", F.greatest("keep_id", "_k").alias("keep_id"), (F.col("group_size") + F.col("_n")).alias("group_size"))
    seen = met.select("digest")
    groups = old.join(seen, "digest", "left_anti").unionByName(new.join(seen, "digest", "left_anti")).unionByName(met)
    groups = materialize(groups)

    # byte check of every group with more than one row
    several = broadcast_if_small(groups.where("group_size > 1").select("digest"))
    both = snapshot.select("doc_id", whole.alias("_text")).unionByName(incoming.select("doc_id", whole.alias("_text")))
    suspects = both.withColumn("digest", digest(F.col("_text"))).join(several, "digest", "left_semi")
    bytes_ = suspects.groupBy("digest", "_text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    clash = materialize(
        bytes_.groupBy("digest").agg(F.count(F.lit(1)).alias("_variants")).where("_variants > 1").select("digest")
    )
    # equal doc_ids with equal texts are counted, so that no window has to hold the rows of one digest together
    told = rows.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("_rows")).join(groups, "digest")
    if not clash.isEmpty():  # equal digests of unequal bytes: those rows are grouped by their bytes
        apart = bytes_.join(clash, "digest", "left_semi")
        again = suspects.join(clash, "digest", "left_semi").join(apart, ["digest", "_text"])
        again = again.groupBy("doc_id", "digest", "keep_id", "group_size", "_text").agg(F.count(F.lit(1)).alias("_rows")).select(*told.columns)
        told = told.join(clash, "digest", "left_anti").unionByName(again)
    # of equal doc_ids with equal texts one is kept
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_turn") == 1)
    return told.withColumn("_turn", F.explode(F.sequence(F.lit(1).cast("long"), "_rows"))).select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest")


def split_snapshot(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A stable split of one table into an older and a newer half, by a hash of ``doc_id``."""
    old = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    return docs.where(old), docs.where(~old)


def drop_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    told = duplicate_groups(*split_snapshot(docs), text=text)
    counted = materialize(
        told.groupBy("doc_id").agg(
            F.count(F.lit(1)).alias("_rows"), F.sum(F.col("kept").cast("long")).alias("_kept")
        ).where("_kept < _rows")
    )
    gone = counted.where("_kept = 0").select("doc_id")
    # a doc_id with several rows of which only some stay: choose among those rows by their bytes
    unsure = counted.where("_kept > 0").select("doc_id")
    same = lambda other: docs["doc_id"].eqNullSafe(other["doc_id"])
    clear = docs.join(gone, same(gone), "left_anti").join(unsure, same(unsure), "left_anti")
    if unsure.isEmpty():
        return clear
    digest = sha256(F.coalesce(F.col(text), F.lit("")))
    stays = told.where("kept").select("doc_id", "digest")
    keep = stays.join(unsure, stays["doc_id"].eqNullSafe(unsure["doc_id"]), "left_semi").distinct()
    rest = docs.withColumn("_digest", digest)
    rest = rest.join(keep, (rest["doc_id"].eqNullSafe(keep["doc_id"])) & (rest["_digest"] == keep["digest"]), "left_semi")
    return clear.unionByName(rest.dropDuplicates(["doc_id", "_digest"]).drop("_digest"))
