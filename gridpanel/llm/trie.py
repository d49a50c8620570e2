"""Prefix trie of conversations: exact groups for prefixes that may be shared, the rest told where they lie.

Texts never leave their scan: a turn becomes a 64-bit pair of hashes and its code points. Turns are
dealt by ranges of ``(conv_id, turn)`` and read in order; a prefix digest is the sum of turn hashes times
powers of an odd base, so what earlier ranges hold of a conversation is added afterwards from one row per range, and no
conversation has to fit one task.

A count-min table with two rows of saturating counters, sized by the number of prefixes (up to
``SKETCH_CELLS``; beyond that more prefixes count as possibly shared, with the same result), is
broadcast. It never counts too low: an estimate of one proves that a single conversation has the prefix. The
tail behind such a prefix needs no other row and is emitted where it is. Only prefixes
that may be shared are grouped.

A node is named by its smallest member and its depth. Along a conversation the nodes that it names are a
chain from some depth to its end; above stands a node of a smaller conversation. So children, leaves and saved tokens follow
from one row per chain: leaves and sums of chains are added up over members, sums below a node of its own chain by a running sum.

Rows of one turn come in the order of their hashes. Null roles and texts are empty, null turns
first; rows without ``conv_id`` belong to no conversation and are left out. Repeated rows are turns of their own. Empty
tables give no nodes. Extra columns are ignored. Depth, counts and code points are whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpanel.llm.arrowtext import mix
from gridpanel.llm.jaccard import fixed_table
from gridpanel.operators.prefix import prefix_sum
from gridpanel.operators.skew import salted_join
from gridpanel.session import broadcast_if_small, materialize, written

#: Turns of a base conversation that others may start with.
HEAD = 5
#: Cells of one row of the count-min table at most: 64 MB in a task for each of its two rows.
SKETCH_CELLS = 1 << 26
#: Ids of one group that are joined to one string before a group is hashed.
BLOCK_IDS = 4096
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))


def powers(base: np.uint64, exponents: np.ndarray) -> np.ndarray:
    """``base ** exponents`` modulo 2^64; negative exponents are powers of the inverse."""
    out, inverse = np.ones(len(exponents), np.uint64), np.uint64(pow(int(base), -1, 1 << 64))
    size, square = np.abs(exponents).astype(np.uint64), np.where(exponents < 0, inverse, base)
    while size.any():
        out = np.where(size & np.uint64(1) == 1, out * square, out)
        size, square = size >> np.uint64(1), square * square
    return out


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, x1, x2`` (hashes of role and text) and ``n`` (code points of the text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", F.col("turn").cast("long").alias("turn"), digest.alias("_h"), F.length(text).cast("long").alias("n"))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(F.lit(1), "_h").alias("x1"), F.xxhash64(F.lit(2), "_h").alias("x2"), "n")


def _u(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def positions(rows: DataFrame) -> DataFrame:
    """``conv_id, pos`` (from 1), ``n``, digests ``k1, k2`` of the prefix that ends here and ``q1, q2`` of the one before."""
    dealt = rows.repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), "x1", "x2", "n")
    dealt = dealt.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "x1", "x2", "n").withColumn("part", F.spark_partition_id())

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, sums = None, 0, [np.uint64(0), np.uint64(0)]
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv_id").to_numpy(zero_copy_only=False)
            first = np.concatenate([[True], conv[1:] != conv[:-1]])
            begin = np.flatnonzero(first)
            group = np.cumsum(first) - 1
            goes_on = last is not None and conv[0] == last
            pos = np.arange(len(conv)) - begin[group] + 1
            if goes_on:
                pos[group == 0] += held
            out = {}
            for i, (name, base) in enumerate(zip(("x1", "x2"), BASES)):
                # running sums over the batch, less what stands before a conversation's first row
                term = _u(batch, name) * powers(base, pos)
                run = np.cumsum(term, dtype=np.uint64)
                before = np.concatenate([np.zeros(1, np.uint64), run])[begin[group]]
                key = run - before
                if goes_on:
                    key[group == 0] += sums[i]
                out[f"k{i + 1}"], out[f"q{i + 1}"] = key, key - term
                sums[i] = key[-1]
            last, held = conv[-1], int(pos[-1])
            yield pa.RecordBatch.from_pydict({"part": batch.column("part"), "conv_id": batch.column("conv_id"), "pos": pa.array(pos, pa.int64()), "n": batch.column("n")} | {k: _long(out[k]) for k in ("k1", "k2", "q1", "q2")})

    found = materialize(dealt.mapInArrow(local, "part int, conv_id long, pos long, n long, k1 long, k2 long, q1 long, q2 long"))
    # one row per range: its first and last conversation, and what it holds of the last
    ends = found.groupBy("part").agg(F.min("conv_id").alias("first"), F.max_by(F.struct("conv_id", "pos", "k1", "k2"), F.struct("conv_id", "pos")).alias("last")).orderBy("part").collect()
    carried: dict[int, tuple[int, int, int, int]] = {}
    open_: tuple[int, int, int, int] | None = None
    for r in ends:
        conv, pos, k1, k2 = r["last"]
        if open_ is not None and open_[0] == r["first"]:
            carried[r["part"]] = open_
            if conv == open_[0]:
                k = [(open_[2 + i] + int(powers(BASES[i], np.array([open_[1]]))[0]) * (k1, k2)[i]) % (1 << 64) for i in range(2)]
                conv, pos, k1, k2 = conv, open_[1] + pos, *k
        open_ = (conv, pos, k1 % (1 << 64), k2 % (1 << 64))
    if not carried:
        return found.drop("part")
    shared = rows.sparkSession.sparkContext.broadcast(carried)

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = shared.value
        for batch in batches:
            columns = {n: batch.column(n) for n in ("conv_id", "pos", "n", "k1", "k2", "q1", "q2")}
            conv, part = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("conv_id", "part"))
            pos = batch.column("pos").to_numpy(zero_copy_only=False).copy()
            keys = {n: _u(batch, n).copy() for n in ("k1", "k2", "q1", "q2")}
            for p in np.unique(part).tolist():
                if p not in carried:
                    continue
                who, off, *add = carried[p]
                rows = (part == p) & (conv == who)
                pos[rows] += off
                for i in range(2):
                    scale, base = powers(BASES[i], np.array([off]))[0], np.uint64(add[i])
                    for n in (f"k{i + 1}", f"q{i + 1}"):
                        keys[n][rows] = base + scale * keys[n][rows]
            yield pa.RecordBatch.from_pydict(columns | {"pos": pa.array(pos)} | {n: _long(v) for n, v in keys.items()})

    return found.mapInArrow(moved, "conv_id long, pos long, n long, k1 long, k2 long, q1 long, q2 long")


def rebuilt(conversations: DataFrame, share: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The conversations ``conv_id, size`` and their prefixes ``conv_id, depth, size, n, k1, k2, q1, q2`` from depth 1 on.

    A conversation starts with the first ``share`` turns (0 to ``HEAD``) of the conversation at its hundred.
    """
    share = F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % (HEAD + 1) if share is None else share
    rows = written(positions(turns(conversations)), "trie-turns")
    heads = [F.max(F.when(F.col("pos") == p, F.struct("k1", "k2", "n"))).alias(f"t{p}") for p in range(1, HEAD + 1)]
    convs = rows.groupBy("conv_id").agg(F.max("pos").alias("own"), *heads)
    convs = written(convs.withColumn("h", share.cast("int")), "trie-conversations")
    top = [F.col(f"t{p}") for p in range(1, HEAD + 1)]
    base = convs.where("conv_id % 100 = 0").select(F.col("conv_id").alias("_b"), F.least("own", F.lit(HEAD)).alias("_n"), F.array(*top).alias("_head"))
    told = convs.join(base, F.col("_b") == F.col("conv_id") - F.col("conv_id") % 100, "left")
    told = told.withColumn("b", F.least("h", F.coalesce("_n", F.lit(0))).cast("int")).withColumn("size", F.col("b") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    zero = F.struct(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), F.lit(0).cast("long").alias("n"))
    skipped = F.when(F.col("own") > F.col("h"), F.when(F.col("h") > 0, F.get(F.array(*top), F.col("h") - 1)).otherwise(zero))
    reached = F.when(F.col("b") > 0, F.get("_head", F.col("b") - 1)).otherwise(zero)
    told = written(told.select("conv_id", "own", "h", "b", "size", skipped.alias("skipped"), reached.alias("reached"), F.when(F.col("b") > 0, F.slice("_head", 1, F.col("b"))).alias("head")), "trie-plans")
    cell = F.col("head")[F.col("_i")]
    above = F.when(F.col("_i") > 0, F.get("head", F.col("_i") - 1)).otherwise(zero)
    taken = told.where("b > 0").select("conv_id", "size", "head", F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("_i")).select(
        "conv_id", (F.col("_i") + 1).cast("long").alias("depth"), "size", cell["n"].alias("n"), cell["k1"].alias("k1"), cell["k2"].alias("k2"), above["k1"].alias("q1"), above["k2"].alias("q2"))
    plans = told.where("own > h").select("conv_id", "h", "b", "size", "own", *[F.col(c)[k].alias(f"{c[0]}{k}") for c in ("skipped", "reached") for k in ("k1", "k2")])
    tails = salted_join(rows, plans.drop("own"), ["conv_id"], key_counts=convs, n_col="own").where("pos > h")

    def shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, h, pos = (batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("b", "h", "pos"))
            made = {"conv_id": batch.column("conv_id"), "depth": pa.array(pos + b - h), "size": batch.column("size"), "n": batch.column("n")}
            for end in ("k", "q"):
                for i in (1, 2):
                    moved = (_u(batch, f"{end}{i}") - _u(batch, f"sk{i}")) * powers(BASES[i - 1], b - h)
                    made[f"{end}{i}"] = _long(_u(batch, f"rk{i}") + moved)
            yield pa.RecordBatch.from_pydict(made)

    schema = "conv_id long, depth long, size long, n long, k1 long, k2 long, q1 long, q2 long"
    return told.select("conv_id", "size"), taken.unionByName(tails.mapInArrow(shifted, schema))


def _cells(k1: np.ndarray, k2: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple((mix(k) & np.uint64(width - 1)).astype(np.int64) for k in (k1 ^ (k2 << np.uint64(1)), k2 ^ (k1 >> np.uint64(1))))


def screened(prefixes: DataFrame, count: int) -> DataFrame:
    """``prefixes`` with ``alone`` (a single conversation has it, proven) and ``tail`` (also the prefix before)."""
    width = min(max(1 << int(2 * count).bit_length(), 1 << 10), SKETCH_CELLS)

    def fill(table: np.ndarray, batch: pa.RecordBatch) -> None:
        for row, cell in enumerate(_cells(_u(batch, "k1"), _u(batch, "k2"), width)):
            at, n = np.unique(cell, return_counts=True)
            at += row * width
            table[at] = np.minimum(table[at] + np.minimum(n, 2), 2)

    def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.minimum(a + b, 2)

    context = prefixes.sparkSession.sparkContext
    # every task fills a table of its own, so the keys are read in a few tasks per core
    keys = prefixes.select("k1", "k2").coalesce(2 * context.defaultParallelism)
    shared = context.broadcast(fixed_table(keys, fill, 2 * width, "uint8", add))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            ones = []
            for a, b in (("k1", "k2"), ("q1", "q2")):
                one, two = _cells(_u(batch, a), _u(batch, b), width)
                ones.append(np.minimum(table[one], table[two + width]) == 1)
            tail = ones[1] & (batch.column("depth").to_numpy(zero_copy_only=False) > 1)
            kept = {n: batch.column(n) for n in ("conv_id", "depth", "size", "n", "k1", "k2")}
            yield pa.RecordBatch.from_pydict(kept | {"alone": pa.array(ones[0] | tail), "tail": pa.array(tail)})

    return prefixes.mapInArrow(judge, "conv_id long, depth long, size long, n long, k1 long, k2 long, alone boolean, tail boolean")


def ends_digests(ends: DataFrame) -> DataFrame:
    """``conv_id, depth, ends_sha256`` of ``(conv_id, depth, member)``: ids ascending, comma-joined, hashed piece by piece.

    Ranges of members become strings of at most ``BLOCK_IDS`` ids first, so the task that hashes a
    group reads few rows and holds one of them.
    """
    order = ["conv_id", "depth", "member"]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK_IDS):
                part = batch.slice(begin, BLOCK_IDS)
                conv, depth, member = (part.column(n).to_numpy(zero_copy_only=False) for n in order)
                first = np.flatnonzero(np.concatenate([[True], (conv[1:] != conv[:-1]) | (depth[1:] != depth[:-1])]))
                texts = [",".join(map(str, ids.tolist())) for ids in np.split(member, first[1:])]
                yield pa.RecordBatch.from_pydict({"conv_id": pa.array(conv[first]), "depth": pa.array(depth[first]), "member": pa.array(member[first]), "ids": pa.array(texts, pa.string())})

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            out: dict[str, list] = {"conv_id": [], "depth": [], "ends_sha256": []}
            for conv, depth, ids in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "depth", "ids"))):
                if (conv, depth) == at:
                    held.update(b"," + ids.encode())
                    continue
                if at is not None:
                    for n, v in zip(out, (*at, held.hexdigest())):
                        out[n].append(v)
                at, held = (conv, depth), hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array(out["conv_id"], pa.int64()), "depth": pa.array(out["depth"], pa.int64()), "ends_sha256": pa.array(out["ends_sha256"], pa.string())})
        if at is not None:
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array([at[0]], pa.int64()), "depth": pa.array([at[1]], pa.int64()), "ends_sha256": [held.hexdigest()]})

    dealt = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = dealt.mapInArrow(joined, "conv_id long, depth long, member long, ids string")
    return pieces.repartition("conv_id", "depth").sortWithinPartitions(*order).mapInArrow(hashed, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, share: Column | None = None) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    convs, prefixes = rebuilt(conversations, share)
    prefixes = written(prefixes, "trie-prefixes")
    zero = F.lit(0).cast("long")
    judged = written(screened(prefixes, prefixes.count()), "trie-screened")
    root = convs.select("conv_id", zero.alias("depth"), "size", zero.alias("n"), zero.alias("k1"), zero.alias("k2"))
    maybe = judged.where("NOT alone").select(*root.columns).unionByName(root)
    key = ["depth", "k1", "k2"]
    groups = written(maybe.groupBy(*key).agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n_convs")), "trie-groups")
    rows = salted_join(maybe, groups, key, key_counts=groups, n_col="n_convs").select(
        "conv_id", "depth", "size", "rep", "n_convs", ((F.col("n_convs") - 1) * F.col("n")).alias("saves"))
    rows = written(rows, "trie-rows")

    # chains: from the first depth that a conversation names to its end, below a node of another one
    own = F.col("rep") == F.col("conv_id")
    chains = rows.groupBy("conv_id").agg(
        F.max("size").alias("size"), F.sum(F.when(own, 0).otherwise(1)).alias("begin"), F.max(F.when(~own, F.col("rep"))).alias("above"),
        F.sum(F.when(own, F.col("saves")).otherwise(0)).alias("chain_saves"))
    chains = written(chains, "trie-chains")
    hung = chains.where("begin <= size AND above IS NOT NULL").groupBy(F.col("above").alias("conv_id"), (F.col("begin") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("hung"))
    hung = written(hung, "trie-hung")
    bare = chains.where("begin <= size").join(hung.select("conv_id", F.col("depth").alias("size"), "hung"), ["conv_id", "size"], "left")
    facts = written(bare.select("conv_id", F.when(F.col("hung").isNull(), 1).otherwise(0).cast("long").alias("leaf"), "chain_saves"), "trie-leaves")

    # what a shared node gets from its members' chains, what hangs below it, what its own chain saves
    many = rows.where("n_convs > 1")
    summed = many.select("conv_id", "rep", "depth", "n_convs").join(facts, "conv_id").groupBy("rep", "depth").agg(
        F.sum("leaf").alias("n_leaves"), F.sum(F.when(own, 0).otherwise(F.col("chain_saves"))).alias("other_saves"))
    nodes = rows.where(own)
    below = prefix_sum(nodes.where("n_convs > 1").select("conv_id", "depth", "saves"), ["-depth"], {"deeper": F.col("saves")}, ["conv_id"])
    ends = ends_digests(many.where("depth = size").select(F.col("rep").alias("conv_id"), "depth", F.col("conv_id").alias("member")))
    empty = F.lit(None)

    def piece(df: DataFrame, **cols: Column) -> DataFrame:
        names = {"size": "long", "n_convs": "long", "hung": "long", "n_leaves": "long", "saved": "long", "ends": "string"}
        return df.select("conv_id", "depth", *[cols.get(n, empty).cast(t).alias(n) for n, t in names.items()])

    parts = piece(nodes, size=F.col("size"), n_convs=F.col("n_convs"))
    for part in (
        piece(hung, hung=F.col("hung")),
        piece(summed.withColumnRenamed("rep", "conv_id"), n_leaves=F.col("n_leaves"), saved=F.col("other_saves")),
        piece(below, saved=F.col("deeper") + F.col("saves")),
        piece(ends, ends=F.col("ends_sha256")),
    ):
        parts = parts.unionByName(part)
    exact = parts.groupBy("conv_id", "depth").agg(F.max("size").alias("size"), F.max("n_convs").alias("n_convs"), F.max("hung").alias("hung"), F.max("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"), F.max("ends").alias("ends"))
    # a node behind a chain's first has its parent on the chain
    chain = broadcast_if_small(chains.select("conv_id", "begin", "above"))
    parent = F.when(F.col("depth") == 0, None).when(F.col("depth") > F.col("begin"), F.col("conv_id")).otherwise(F.col("above"))
    goes_on, alone, nobody = (F.col("depth") < F.col("size")), F.sha2(F.encode(F.col("conv_id").cast("string"), "UTF-8"), 256), F.sha2(F.lit(b""), 256)
    shared = exact.where("n_convs IS NOT NULL").join(chain, "conv_id").select(
        "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", (goes_on.cast("long") + F.coalesce("hung", zero)).alias("n_children"),
        F.when(F.col("n_convs") == 1, 1).otherwise(F.col("n_leaves")).cast("long").alias("n_leaves"), F.coalesce("saved", zero).alias("saved_tokens"),
        F.when(F.col("n_convs") > 1, F.coalesce("ends", nobody)).when(goes_on, nobody).otherwise(alone).alias("ends_sha256"))
    one = F.lit(1).cast("long")
    told = ("conv_id", "depth", "parent_conv_id", one.alias("n_convs"), goes_on.cast("long").alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"), F.when(goes_on, nobody).otherwise(alone).alias("ends_sha256"))
    tails = judged.where("tail").withColumn("parent_conv_id", F.col("conv_id")).select(*told)
    firsts = judged.where("alone AND NOT tail").join(chain, "conv_id").withColumn("parent_conv_id", parent).select(*told)
    return shared.unionByName(tails).unionByName(firsts)
