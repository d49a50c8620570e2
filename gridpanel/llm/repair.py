"""Cheapest repair of a conversation's turn structure, with an audit letter per edit.

A conversation is to have the role initials ``(s?(ua)+)?``. Rows may be kept (K), given another
role (R) or deleted (D), and empty rows inserted (I). One integer weighs a suffix of edits: its
high digits carry the cost, below them stand the audit letters as octal digits, D=1 to R=4 in
ASCII order, from the left in places of a fixed width, with zeros behind the end. So the smallest
integer is the cheapest repair with the ASCII-least audit, and an ordinary minimum over a chain of
grammar states, from the last row to the first, decides everything. Rows are taken in blocks of
``BLOCK`` rows, which fixes the width: behind the letters of a block one digit ranks the audits of
all that follows. Inserts before a row belong to its block, so no block's letters begin another's.

Spark damages and judges rows column by column, deals facts without texts by conversation, and
streams them in order; a second stream carries the texts past the audit. A task holds the facts of one
conversation at a time (a few dozen bytes a row), never its texts.

Null roles and texts are one space, so such rows are blank and deleted; a null turn comes first and
prints as one space where a row's damage is drawn, as does a null ``conv_id``, which is a conversation of its
own. Rows of one turn are ordered by the SHA-256 of their first role and text, repeated rows one after another. A
conversation without rows after damage gives zeros, an empty audit and the empty string's hash; an empty table gives no
rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows whose letters share one integer.
BLOCK = 256
#: Inserts in a row that can still lead to a new state.
INSERTS = 3
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
D, I, K, R = 1, 2, 3, 4
LETTER = " DIKR"

# Grammar states: 0 nothing yet, 1 after s, 2 after u, 3 after a.
FOLLOWS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: State behind an added user or assistant row, whichever the state asks for.
ADDED = (2, 2, 3, 2)
ENDS = (True, False, False, True)


class Weights:
    """Integers of ``cost | letters | rank`` with room for ``places`` letters."""

    def __init__(self, places: int):
        self.low = 3 * places + 2
        self.mask = (1 << self.low) - 1

    def start(self, cost: int, rank: int) -> int:
        return cost << self.low | rank

    def edit(self, weight: int, cost: int, letter: int) -> int:
        """``letter`` in front: the letters move one place to the right, their last place is a zero."""
        held = weight & self.mask
        return ((weight >> self.low) + cost) << self.low | letter << (self.low - 3) | held >> 5 << 2 | held & 3

    def inserts(self, weights: list[int]) -> list[int]:
        found = weights
        for _ in range(INSERTS):
            found = [min(weights[q], self.edit(found[ADDED[q]], INSERT, I)) for q in range(4)]
        return found

    def letters(self, weight: int) -> list[int]:
        held, place, told = (weight & self.mask) >> 2, self.low - 5, []
        while place >= 0 and (code := held >> place & 7):
            told.append(code)
            place -= 3
        return told


def _handed_on(weights: list[int], old: Weights, new: Weights) -> list[int]:
    """The weights behind a block, for the block before: cost and rank of the audit that follows."""
    order = sorted({w & old.mask for w in weights})
    return [new.start(w >> old.low, order.index(w & old.mask)) for w in weights]


def cheapest(rows: list[tuple[str, bool, bool]], block: int = BLOCK) -> tuple[int, str]:
    """Cost and audit of ``(initial, must go, is cut)`` rows."""
    end = Weights(INSERTS)
    far = end.start(INSERT * (INSERTS + 1), 0)  # more than any state needs to end
    tail = end.inserts([end.start(0, 0) if ok else far for ok in ENDS])
    weights, of, kept = tail, end, [(len(rows), tail, end)]
    for begin in range((len(rows) - 1) // block * block, -1, -block) if rows else ():
        part = rows[begin : begin + block]
        own = Weights(len(part) * (INSERTS + 1))
        weights = _handed_on(weights, of, own)
        for initial, gone, cut in reversed(part):
            ahead, extra = [], CUT if cut else 0
            for q in range(4):
                best = own.edit(weights[q], DELETE, D)
                if not gone:
                    best = min(best, own.edit(weights[ADDED[q]], REROLE + extra, R))
                    to = FOLLOWS.get((q, initial))
                    if to is not None:
                        best = min(best, own.edit(weights[to], KEEP + extra, K))
                ahead.append(best)
            weights = own.inserts(ahead)
        of = own
        kept.append((begin, weights, own))
    q, audit = 0, []
    for begin, found, width in reversed(kept):
        row = begin
        for code in width.letters(found[q]):
            audit.append(LETTER[code])
            if code == K:
                q = FOLLOWS[q, rows[row][0]]
            elif code != D:
                q = ADDED[q]
            row += code != I
    return weights[0] >> of.low, "".join(audit)


def drawn(divisor: int = 20) -> Column:
    """The damage of a row: ``crc32(conv_id:turn) % divisor``."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    return F.crc32(F.encode(F.concat(said[0], F.lit(":"), said[1]), "UTF-8")) % divisor


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, tie, copy, gone, role, text``: rows dropped stay, marked ``gone``."""
    named = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), drawn().alias("_d"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    )
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return named.select(
        "conv_id", "turn", F.unhex(F.sha2(F.concat_ws(":", "role", "text"), 256)).alias("tie"),
        F.explode(F.when(F.col("_d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        (F.col("_d") == 0).alias("gone"), F.when(F.col("_d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
    )


def _dealt(df: DataFrame, *order: str) -> DataFrame:
    """Whole conversations to a task, in order."""
    ways = [F.col(c).asc_nulls_first() for c in ("conv_id", *order)]
    return df.repartition("conv_id").sortWithinPartitions(*ways)


_FACTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
LEGAL = {"su", "ua", "au"}


def _counts(rows: list[tuple]) -> dict[str, object]:
    """Facts of one conversation; ``rows`` are ``(turn, initial, blank, cut, digest)`` in order."""
    seen: set[bytes] = set()
    count, judged = {"blank": 0, "duplicate": 0, "truncated": 0}, []
    for _, initial, blank, cut, digest in rows:
        again = digest in seen
        seen.add(digest)
        fault = "blank" if blank else "duplicate" if again else "truncated" if cut else None
        if fault:
            count[fault] += 1
        judged.append((initial, blank or again, fault == "truncated"))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = turns[-1] - turns[0] + 1 - (1 + sum(a != b for a, b in zip(turns, turns[1:]))) if turns else 0
    illegal = sum(a[1] + b[1] not in LEGAL for a, b in zip(rows, rows[1:]))
    cost, audit = cheapest(judged)
    return {"gaps": gaps, **count, "illegal": illegal, "cost": cost, "audit": audit}


def judged(rows: DataFrame) -> DataFrame:
    """One row per conversation of :func:`damaged` rows: its faults, the repair's cost and its audit."""
    space = r"[\x20\x09-\x0D]"
    facts = rows.select(
        "conv_id", "turn", "tie", "copy", "gone", F.substring("role", 1, 1).alias("initial"),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~F.col("text").rlike(rf"[.!?]{space}*\z")).alias("cut"),
        F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)).alias("digest"),
    )
    names = [f.split()[0] for f in _FACTS.split(", ")]
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, {_FACTS}"

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        out: dict[str, list] = {n: [] for n in ("conv_id", *names)}

        def close() -> None:
            out["conv_id"].append(at[0])
            for name, value in _counts(held).items():
                out[name].append(value)

        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("conv_id", "turn", "gone", "initial", "blank", "cut", "digest")]
            for conv, turn, gone, *rest in zip(*columns):
                if at is not None and at[0] != conv:
                    close()
                    held = []
                at = (conv,)
                if not gone:
                    held.append((turn, *rest))
            if len(out["conv_id"]) >= 1000:
                yield _batch(out, schema_of)
        if at is not None:
            close()
        yield _batch(out, schema_of)

    schema_of = _arrow(kind, names)
    return _dealt(facts, "turn", "tie", "copy").drop("tie", "copy").mapInArrow(told, schema)


def _arrow(kind: str, names: list[str], *more: tuple[str, pa.DataType]) -> pa.Schema:
    whole = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    return pa.schema([("conv_id", whole), *[(n, pa.string() if n == "audit" else pa.int64()) for n in names], *more])


def _batch(out: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    made = pa.RecordBatch.from_pydict({n: pa.array(out[n], schema.field(n).type) for n in schema.names}, schema=schema)
    for values in out.values():
        values.clear()
    return made


class Repaired:
    """SHA-256 of the repaired rows, fed in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.sum, self.first = audit, 0, 0, hashlib.sha256(), True

    def _say(self, role: str, text: str) -> None:
        self.sum.update((("" if self.first else "\n") + f"{role}:{text}").encode())
        self.first = False

    def _add(self, text: str) -> None:
        self.state = ADDED[self.state]
        self._say("user" if self.state == 2 else "assistant", text)

    def _inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._add("")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "R":
            self._add(text)
        elif letter == "K":
            self.state = FOLLOWS[self.state, role[:1]]
            self._say(role, text)

    def close(self) -> str:
        self._inserted()
        if self.at != len(self.audit):
            raise ValueError("an audit names more rows than its conversation has")
        return self.sum.hexdigest()


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of :func:`damaged` rows: what :func:`judged` tells, and ``repaired_sha256``."""
    names = [f.split()[0] for f in _FACTS.split(", ")]
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = _arrow(kind, names, ("repaired_sha256", pa.string()))
    head = judged(rows).withColumn("_kind", F.lit(0))
    body = rows.where(~F.col("gone")).select("conv_id", "turn", "tie", "copy", "role", "text", F.lit(1).alias("_kind"))
    every = head.unionByName(body, allowMissingColumns=True)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {n: [] for n in schema.names}
        now = None
        for batch in batches:
            column = {n: batch.column(n) for n in batch.schema.names}
            for i, which in enumerate(column["_kind"].to_pylist()):
                if which:
                    now.row(column["role"][i].as_py(), column["text"][i].as_py())
                    continue
                if now is not None:
                    out["repaired_sha256"].append(now.close())
                for n in ("conv_id", *names):
                    out[n].append(column[n][i].as_py())
                now = Repaired(out["audit"][-1])
            if len(out["repaired_sha256"]) >= 1000:
                last = {n: v.pop() for n, v in out.items() if n != "repaired_sha256"}
                yield _batch(out, schema)
                for n, v in last.items():
                    out[n].append(v)
        if now is not None:
            out["repaired_sha256"].append(now.close())
        yield _batch(out, schema)

    dealt = _dealt(every, "_kind", "turn", "tie", "copy").drop("turn", "tie", "copy")
    return dealt.mapInArrow(told, f"conv_id {kind}, {_FACTS}, repaired_sha256 string")
