"""Conversation trie and structure repair against plain versions."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from gridpanel.llm import repair, trie
from gridpanel.llm.queries import ORACLES, QUERIES
from gridpanel.session import ship_package
from tests.conftest import SF

SCHEMA = "conv_id long, turn long, role string, text string, depth int, key string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_trie(rows):
    """Ties of one turn must not occur in ``rows``."""
    convs = {}
    for c, t, role, text, *_ in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    made = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        made[c] = tuple(turns.get(base, [])[:h] + own[h:])
    nodes = {}
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    out = []
    for key, members in nodes.items():
        below = [k for k in nodes if k[: len(key)] == key]
        kids = [k for k in below if len(k) == len(key) + 1]
        leaves = [k for k in below if not any(len(x) == len(k) + 1 and x[: len(k)] == k for x in below)]
        saved = sum((len(nodes[k]) - 1) * len(k[-1][1]) for k in below if k)
        ends = ",".join(map(str, sorted(c for c in members if len(made[c]) == len(key))))
        out.append((min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), len(kids), len(leaves), saved, sha(ends)))
    return sorted(out, key=repr)


def told_trie(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[n] for n in names) for r in trie.prefix_trie(df).collect()), key=repr)


def talk(seed, convs=60):
    rng, rows = random.Random(seed), []
    for c in [*range(convs), 100, 101, 205, -3, -100, 3000]:
        n = rng.choice([1, 2, 3, 5, 8])
        for t in rng.sample(range(20), n):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "", None, "é😀"]), 7, "x"))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_of_short_talks(spark, seed, monkeypatch):
    ship_package(spark)
    rows = talk(seed) + [(None, 1, "user", "nobody", 1, "x"), (7, None, "system", "first", 1, "x"), (400, 0, "user", "alone", 0, "")]
    if seed == 2:  # every prefix may be shared: the table proves nothing
        monkeypatch.setattr(trie, "SKETCH_CELLS", 1)
    assert told_trie(spark.createDataFrame(rows, SCHEMA)) == plain_trie(rows)


def test_long_and_equal_conversations_cross_ranges(spark, monkeypatch):
    ship_package(spark)
    monkeypatch.setattr(trie, "BLOCK_IDS", 3)
    long_ = [(c, t, "user", f"t{t % 7}" if t < 300 or c == 901 else f"{c}-{t}", 0, "") for c in (900, 901, 907) for t in range(330)]
    equal = [(1000 + i, t, "user", f"same {t}", 0, "") for i in range(60) for t in range(4)]
    rows = long_ + equal
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    assert told_trie(df) == plain_trie(rows)


def test_trie_is_empty_without_rows(spark):
    ship_package(spark)
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x", 0, "")], SCHEMA)).count() == 0


def test_repeated_rows_are_turns_of_their_own(spark):
    ship_package(spark)
    rows = [(9, 1, "user", "x", 0, ""), (9, 1, "user", "x", 0, "")]  # crc32("9") % 6 = 3
    told = trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), share=F.lit(0)).collect()
    assert sorted((r["depth"], r["n_convs"], r["n_children"]) for r in told) == [(0, 1, 1), (1, 1, 1), (2, 1, 0)]


LETTER_ROLE = {"u": "user", "a": "assistant"}


def plain_repair(rows):
    convs = {}
    for c, t, role, text, *_ in rows:
        convs.setdefault(c, []).append((t, role if role is not None else " ", text if text is not None else " "))
    out = {}
    for c, own in convs.items():
        made = []
        for t, role, text in sorted(own, key=lambda x: (x[0] is not None, x[0] or 0, sha(f"{x[1]}:{x[2]}"))):
            d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
            text = "" if d == 1 else text.translate({ord(x): None for x in ".!?"}) if d == 2 else text
            made += [(t, "user" if d == 4 else role, text)] * {0: 0, 3: 2}.get(d, 1)
        seen, faults, facts = set(), [], []
        for t, role, text in made:
            bare = text.strip(" \t\n\r\x0b\x0c")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            faults.append(fault)
            facts.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit = plain_audit(facts)
        lines, state, at = [], 0, 0
        for letter in audit:
            if letter != "I":
                _, role, text = made[at]
                at += 1
            if letter == "D":
                continue
            name = "u" if state in (0, 1, 3) else "a"
            if letter == "K":
                name = role[:1]
            lines.append(f"{role if letter == 'K' else LETTER_ROLE[name]}:{'' if letter == 'I' else text}")
            state = {"s": 1, "u": 2, "a": 3}[name]
        turns = [t for t, *_ in made if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        bad = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(facts, facts[1:]))
        out[c] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), bad, cost, audit, sha("\n".join(lines)))
    return out


def plain_audit(facts):
    """All cheapest audits as strings, row by row."""
    grammar = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    best = {0: (0, "")}

    def better(table, q, value):
        if q not in table or value < table[q]:
            table[q] = value

    def inserted(table):
        out = dict(table)
        for _ in range(4):
            for (q, role), to in grammar.items():
                if role != "s" and q in out:
                    better(out, to, (out[q][0] + 5, out[q][1] + "I"))
        return out

    for initial, gone, cut in facts:
        after = {}
        for q, (cost, audit) in inserted(best).items():
            better(after, q, (cost + 2, audit + "D"))
            for (p, role), to in grammar.items():
                if p == q and not gone:
                    if role != "s":
                        better(after, to, (cost + 1 + 5 * cut, audit + "R"))
                    if role == initial:
                        better(after, to, (cost + 5 * cut, audit + "K"))
        best = after
    return min(v for q, v in inserted(best).items() if q in (0, 3))


@pytest.mark.parametrize("block", [1, 3, 256])
def test_cheapest_audits(block):
    rng = random.Random(block)
    for _ in range(300):
        rows = [(rng.choice("suua t"), rng.random() < 0.15, rng.random() < 0.2) for _ in range(rng.randint(0, 25))]
        assert repair.cheapest(rows, block) == plain_audit(rows), rows


def told_repair(df):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r["conv_id"]: tuple(r[n] for n in names) for r in repair.repair(repair.damaged(df)).collect()}


def test_repair_of_odd_conversations(spark):
    ship_package(spark)
    rng, rows = random.Random(5), []
    texts = ["Yes.", "No", "", " \t", None, "Is it?  ", "a.b", "é!\n", " ", "Yes."]
    for c in [*range(60), None, -5]:
        for t in rng.choices([*range(12), None], k=rng.randint(1, 14)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "tool", "", None, "User"]), rng.choice(texts), 3, "k"))
    rows += [(777, t, "user" if t % 2 == 0 else "assistant", f"line {t}." * 50, 1, "") for t in range(900)]
    rows += [(778, 0, "user", "long. " * 40_000, 1, ""), (778, 1, "assistant", "ok.", 1, "")]
    assert told_repair(spark.createDataFrame(rows, SCHEMA)) == plain_repair(rows)
    assert told_repair(spark.createDataFrame([], SCHEMA)) == {}


def test_a_conversation_that_loses_all_rows_stays(spark):
    ship_package(spark)
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    told = told_repair(spark.createDataFrame([(gone, 0, "user", "Hi.", 0, "")], SCHEMA))
    assert told == {gone: (0, 0, 0, 0, 0, 0, "", sha(""))}


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op13_conversation_repair"])
def test_queries_equal_their_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    left = sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
    result = duck.execute(ORACLES[name])
    order = [[d[0] for d in result.description].index(n) for n in names]
    assert left == sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=repr)
