"""Exact and near copies and fingerprints against brute force."""

import hashlib
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridpanel.llm import dedup, fingerprints, jaccard
from gridpanel.llm.arrowtext import byte_codes
from gridpanel.llm.components import connected_components
from gridpanel.llm.queries import QUERIES
from gridpanel.session import ship_package
from tests.conftest import SF

SCHEMA = "doc_id long, text string, digest int, id string"


def test_filter_has_no_false_negatives():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 10, 1000, 60_000):
        keys = rng.integers(0, 2**63, n).astype(np.uint64)
        built = dedup.BinaryFuse.unpack(dedup.BinaryFuse(keys).pack())
        assert built.test(keys).all()
        assert built.test(rng.integers(0, 2**63, 20_000).astype(np.uint64)).mean() < 0.01


@pytest.mark.parametrize("digest", [dedup.sha256, lambda c: F.substring(F.encode(c, "UTF-8"), 1, 1)])
def test_groups_with_and_without_colliding_digests(spark, digest):
    ship_package(spark)
    texts = ["", None, "a", "ab", "ac", "a", "b", "ab" * 50_000] * 3 + ["hot"] * 40
    rows = [(i, t, 0, "x") for i, t in enumerate(texts)] + [(3, "ab", 1, "y"), (None, "a", 1, None), (None, "alone", 1, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    told = dedup.duplicate_groups(*dedup.split_snapshot(df), digest=digest, shard_keys=3).collect()
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    want = sorted((i if i is not None else -1, max((x for x in g if x is not None), default=-1), len(g)) for g in groups.values() for i in g)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], -1 if r["keep_id"] is None else r["keep_id"], r["group_size"]) for r in told) == want
    assert sum(r["kept"] for r in told) == len(groups)
    assert dedup.duplicate_groups(df.limit(0), df.limit(0)).count() == 0


def test_dropping_keeps_one_row_of_each_text(spark):
    ship_package(spark)
    rows = [(1, "a", 0, "x"), (1, "a", 0, "y"), (1, "b", 0, "x"), (2, "b", 0, "x"), (None, "c", 0, "x"), (None, "c", 0, "z"), (3, None, 0, None), (4, "", 0, None)]
    left = dedup.drop_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r["doc_id"] or 0), r["text"] or "") for r in left) == [(0, "c"), (1, "a"), (2, "b"), (4, "")]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (100, 100), (200, 7), (None, 5), (300, 300)]
    told = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {told[i] for i in (*range(1, 41), 200)} == {1} and told[101] == 100 and told[300] == 300
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def classes(rows):
    sets, parent = [(i, shingle_set(t)) for i, t, *_ in rows if i is not None], {i: i for i, *_ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    return {i: root(i) for i in parent}


def near_copies():
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(400)]
    base = list(rng.choice(words, 90))
    rows = []
    for i in range(60):  # a large group, in which not all pairs link
        own = list(base)
        for at in rng.choice(90, rng.integers(0, 4), replace=False):
            own[at] = f"x{i}-{at}"
        rows.append((i, " ".join(own), 0, "a"))
    for i in range(60, 100):
        own = list(rng.choice(words, rng.integers(1, 30)))
        rows += [(i, " ".join(own), 0, "a"), (i + 100, " ".join(own[: rng.integers(1, len(own) + 1)]).upper(), 0, None)]
    rows += [(300, None, 0, "a"), (301, "", 0, "a"), (302, " \n\t", 0, "a"), (303, "é" * 100_000, 0, "a"), (304, "é" * 100_000, 0, "a"), (305, "one two", 0, ""), (306, "ONE\vtwo", 0, "")]
    rows += [(307, "one two three", 0, ""), rows[0], (None, "one two", 0, "")]
    return rows


def test_near_copies(spark):
    ship_package(spark)
    rows = near_copies()
    df = spark.createDataFrame(rows, SCHEMA)
    want = classes(rows)
    told = jaccard.components(df).collect()
    assert len(told) == len(rows)
    for r in told:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert r["component_id"] == want[r["doc_id"]], r
    sizes = {r["doc_id"]: r["n_shingles"] for r in told}
    assert all(sizes[i] == len(shingle_set(t)) for i, t, *_ in rows if i is not None)
    assert {r["component_id"] for r in jaccard.components(df, rounds=0).where("doc_id < 60").collect()} == {r["component_id"] for r in told if r["doc_id"] is not None and r["doc_id"] < 60}
    left = jaccard.one_per_component(df)
    assert {r["doc_id"] for r in left.collect()} == {want[i] for i in want} | {None} and left.columns == df.columns
    assert jaccard.components(df.limit(0)).count() == 0


def test_one_id_with_several_texts(spark):
    ship_package(spark)
    rows = [(1, "a b c", 0, ""), (9, "a b c", 0, ""), (9, "d e f", 0, ""), (9, "d e f g", 0, ""), (12, "d e f g", 0, ""), (13, "x", 0, "")]
    told = [(r["doc_id"], r["component_id"]) for r in jaccard.components(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(told) == [(1, 1), (9, 1), (9, 1), (9, 1), (12, 1), (13, 13)]


def link_counts(rows):
    """Per text of a row with an id the number of other sets it links with."""
    sets = {shingle_set(t) for i, t, *_ in rows if i is not None} - {frozenset()}
    return {x: sum(y != x and 100 * len(x & y) >= 80 * len(x | y) for y in sets) for x in sets}


def test_every_link_is_counted(spark, monkeypatch):
    ship_package(spark)
    base = [f"w{i}" for i in range(60)]
    mutual = [(k, " ".join([*base[:59], f"end{k}"]), 0, "") for k in range(400, 412)]  # twelve texts that all link with each other
    several = [(500, " ".join(base[:40]), 0, ""), (500, " ".join(base[:39]), 0, ""), (501, " ".join(base[:38]), 0, ""), (None, " ".join(base[:37]), 0, "")]
    rows = near_copies() + mutual + several
    want = link_counts(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    assert min(want[shingle_set(t)] for _, t, *_ in mutual) == 11

    def check():
        told = jaccard.components(df, every_link=True).collect()
        got = {}
        for r in told:
            got.setdefault((r["doc_id"], r["n_shingles"]), []).append(r["n_links"])
        expected = {}
        for i, t, *_ in rows:
            expected.setdefault((i, len(shingle_set(t))), []).append(0 if i is None else want.get(shingle_set(t), 0))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}

    check()
    monkeypatch.setattr(jaccard._every_pair, "__defaults__", (3,))  # groups that take several blocks
    check()


@pytest.mark.parametrize("rounds", [0, 1, 2])
def test_components_without_every_link(spark, rounds):
    ship_package(spark)
    rows = near_copies()
    told = jaccard.components(spark.createDataFrame(rows, SCHEMA), rounds=rounds)
    assert "n_links" not in told.columns
    want = classes(rows)
    assert all(r["component_id"] == want[r["doc_id"]] for r in told.collect() if r["doc_id"] is not None)


def test_all_pairs_meet_within_bands_of_length(spark):
    ship_package(spark)
    texts = [" ".join(f"w{i}" for i in range(k)) for k in (8, 9, 10, 11, 12, 14, 17, 21, 26, 32, 40, 50, 62, 63)]
    rows = [(i, t, 0, "") for i, t in enumerate(texts)] + [(90, "w0 w1 w2 w3 w4", 0, ""), (91, "w0 w1", 0, "")]
    want = classes(rows)
    told = jaccard.components(spark.createDataFrame(rows, SCHEMA), rounds=0).collect()
    assert all(r["component_id"] == want[r["doc_id"]] for r in told) and len({r["component_id"] for r in told}) > 3


def test_counters_grow_with_the_texts():
    sizes = [jaccard.counters_for(10**k) for k in range(0, 13)]
    assert sizes == sorted(sizes) and sizes[0] == jaccard.LEAST_COUNTERS and sizes[-1] == jaccard.MOST_COUNTERS
    assert all(n & (n - 1) == 0 for n in sizes) and jaccard.counters_for(10**9) * jaccard.BYTES_PER_COUNTER >= 10**9


def test_links_of_the_table(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    want = link_counts(rows)
    text = dict(rows)
    ship_package(spark)
    for r in jaccard.components(spark.read.parquet(f"{SF}/documents.parquet"), every_link=True).collect():
        assert r["n_links"] == want.get(shingle_set(text[r["doc_id"]]), 0), r


def test_near_copies_of_the_table(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    want = classes(rows)
    assert {r["doc_id"]: r["component_id"] for r in QUERIES["op4_ngram_jaccard"](spark, SF).collect()} == want


def test_tables_peel_what_differs():
    rng = np.random.default_rng(2)
    for common, apart in ((0, 0), (0, 5), (300, 3), (2000, 150)):
        keys = rng.integers(1, 2**63, common + apart).astype(np.uint64)
        a, b = fingerprints.Pool.__new__(fingerprints.Pool), fingerprints.Pool.__new__(fingerprints.Pool)
        a.keys, b.keys = keys, keys[:common]
        for pool in (a, b):
            pool.counts, pool.starts = np.array([len(pool.keys)]), np.array([0])
        pair, got, sign, cells = fingerprints.differences(a, np.array([0]), b, np.array([0]))
        assert sorted(got.tolist()) == sorted(keys[common:].tolist()) and (sign == 1).all() and (pair == 0).all() and cells[0] >= 12


def edit(rows):
    for i, (d, t) in enumerate(rows):
        t, n = t or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(t) // 4
        yield d, len(t), hashlib.sha256((t[: len(t) - k] + n[:k]).encode()).hexdigest()


def test_versions_of_the_table(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY 1").fetchall()
    told = {r["doc_id"]: r for r in QUERIES["op3_fingerprints"](spark, SF).collect()}
    assert [(d, told[d]["n_chars"], told[d]["edited_sha256"]) for d, _ in rows] == list(edit(rows))
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in told.values())
    assert np.median([r["near_edited"] for r in told.values()]) > 0.6 and np.median([r["near_next"] for r in told.values()]) < 0.05
    by_text = {}
    for d, t in rows:
        by_text.setdefault(t, set()).add(told[d]["fingerprint"])
    assert all(len(f) == 1 for f in by_text.values())


def test_versions_of_odd_rows(spark):
    ship_package(spark)
    rows = [(None, "null id"), (1, None), (2, ""), (3, "äöü 🎉" * 30_000), (4, "one two three four"), (9, "one two three four"), (9, "zwei")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], SCHEMA)
    told = fingerprints.fingerprint_versions(df, range_bytes=1000).collect()
    assert len(told) == len(rows)
    fixed = rows[:5]  # the order of the two rows with id 9 is that of a hash
    want = list(edit(rows))[:4]
    assert [(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in sorted(told, key=lambda r: r["doc_id"] or 0)][:4] == want and len(fixed) == 5
    assert {r["near_next"] for r in told if r["doc_id"] == 1} == {1.0}
    one = fingerprints.fingerprint_versions(df.where("doc_id = 4")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert fingerprints.fingerprint_versions(df.limit(0)).count() == 0


def test_version_digests(spark):
    ship_package(spark)
    df = spark.createDataFrame([("a\nb\nc", "a\nx\nc\nc"), (None, "a"), ("same", "same")], "old string, new string")
    told = [(len(r["removed"]), len(r["added"])) for r in fingerprints.version_diff(df, "old", "new").collect()]
    assert told == [(1, 2), (0, 1), (0, 0)]


def test_codes_differ():
    assert len(set(byte_codes().tolist())) == 256 and len(set(byte_codes(True).tolist())) == 230


def pool(*texts):
    parts = [t.encode() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in parts])]).astype(np.int64)
    return fingerprints.Pool(np.frombuffer(b"".join(parts), np.uint8), bounds)


def test_colliding_digests_come_to_an_end(monkeypatch):
    monkeypatch.setattr(fingerprints, "mix", lambda x: x & np.uint64(1 << 40))  # nearly all digests agree
    a, b = pool("one two\nthree four\nfive six\none two\n" * 5), pool("three four\none two\nfive six\none two\n" * 5)
    assert len(set(a.keys.tolist())) == len(a.keys)
    assert sorted(a.keys.tolist()) == sorted(b.keys.tolist())


def test_tables_that_never_peel_give_exact_differences(monkeypatch):
    a, b = pool("a b c\nd e f\n" * 30, "", "x\n" * 9), pool("a b c\n" * 31, "new", "x\n" * 9)
    at = np.arange(3)
    want = fingerprints.likeness(a, at, b, at)
    monkeypatch.setattr(fingerprints.Tables, "peel", lambda self: (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(self.count) // self.width, bool)))
    assert fingerprints.likeness(a, at, b, at).tolist() == want.tolist() and want[2] == 1 and want[1] == 0


def test_long_paragraphs_count_with_their_whole_length():
    a = pool("x" * 300_000, "y" * 65_535, "z" * 65_536 + " w")
    assert a.bytes.tolist() == [300_000, 65_535, 65_537]
    assert 0.5 < fingerprints.likeness(a, np.array([0]), pool("x" * 200_000), np.array([0]))[0] < 0.9


def test_likeness_by_plain_counting():
    rng = np.random.default_rng(3)
    texts = ["\n".join(" ".join(rng.choice(list("abcdefgh"), 3)) for _ in range(rng.integers(0, 30))) for _ in range(40)]
    a, b = pool(*texts), pool(*texts[1:], texts[0])
    at = np.arange(len(texts))
    for i, told in enumerate(fingerprints.likeness(a, at, b, at)):
        one, two = set(a.of(i).tolist()), set(b.of(i).tolist())
        weigh = lambda keys: sum(k & 0xFFFF for k in keys)
        whole = weigh(one) + weigh(two)
        assert told == (1 - weigh(one ^ two) / whole if whole else 1)
