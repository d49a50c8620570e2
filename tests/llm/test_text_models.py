"""Language identification and toxicity: brute force on words, held-out rows, odd rows."""

import itertools
import math
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest

from gridpanel.llm import langid, toxicity
from gridpanel.llm.bpe import ranks_of
from gridpanel.llm.queries import QUERIES
from gridpanel.session import ship_package
from tests.conftest import SF

ODD = [
    (1, None, "a"), (2, "", "b"), (3, "123 !?", "c"), (4, "Der Hund und die Katze " * 3000, "d"), (5, "the cat", "e"), (5, "the cat", "e"), (None, "the dog", None),
]
SCHEMA = "doc_id long, text string, score string"


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


@pytest.fixture(scope="module")
def model():
    rows = [("the cat and the dog ran to the house", "en"), ("der hund und die katze sind im haus", "de"), ("le chat et le chien sont dans la maison", "fr")]
    return langid.fit(rows * 3, ranks_of(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))


def test_forward_sums_all_segmentations(model):
    names = {}
    vocabulary = ranks_of(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    for word in ("cat", "haus", "ñandú", "x"):
        data = word.encode()
        total = np.zeros(len(model.languages))
        for cuts in itertools.product([0, 1], repeat=len(data) - 1):
            ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(data)]
            pieces = [data[a:b] for a, b in zip([0, *ends], ends)]
            if all(len(p) == 1 or p in vocabulary for p in pieces):
                at = []
                for p in pieces:
                    if p not in names:
                        raw = np.frombuffer(p, np.uint8)
                        names[p] = int(model.pieces.find(langid._hash(raw, np.array([0]), len(p)))[0])
                    at.append(names[p])
                total += np.exp(model.log_p[at].sum(0))
        assert np.allclose(model.word_scores([word])[0], np.log(total))


def test_probabilities_sum_to_one(model):
    assert np.allclose(np.exp(model.log_p).sum(0), 1.0)


def test_odd_rows(spark, model):
    ship_package(spark)
    df = spark.createDataFrame(ODD, SCHEMA)
    told = langid.identify(df, model).collect()
    by = {(r["doc_id"], r["text"]): (r["lang_pred"], r["score"]) for r in told}
    assert len(told) == len(ODD)
    assert by[1, None] == by[2, ""] == by[3, "123 !?"] == ("und", 0.0)
    assert by[4, ODD[3][1]][0] == "de" and by[5, "the cat"][0] == "en"
    assert langid.identify(df.limit(0), model).count() == 0
    bare = langid.fit([], {})
    assert {r["lang_pred"] for r in langid.identify(df, bare).collect()} == {"und"}


def test_language_accuracy(spark):
    rows = QUERIES["op1_language_id"](spark, SF).collect()
    known = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").fetchall())
    out = [r for r in rows if r["held_out"]]
    assert len(rows) == len(known) and all(r["held_out"] == held_out(r["doc_id"]) for r in rows)
    assert sum(r["lang_pred"] == known[r["doc_id"]] for r in out) >= 0.95 * len(out)
    assert all(0 <= r["score"] <= 1 for r in rows)


def texts(n, seed):
    rng = np.random.default_rng(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    toxic = np.arange(n) % 4 == 0
    out = []
    for t in toxic:
        own = list(rng.choice(words, rng.integers(3, 120)))
        if t:
            for _ in range(3):
                own.insert(int(rng.integers(len(own))), str(rng.choice(["vile", "vilest", "viler"])))
        out.append(" ".join(own))
    return out, toxic.astype(int).tolist()


@pytest.fixture(scope="module")
def net():
    return toxicity.fit(*texts(240, 1), 0.25)


def test_network_generalises(net):
    more, toxic = texts(200, 2)
    scores = toxicity.Scorer(net)(more)
    said = scores >= 0.3
    assert np.mean(said == np.array(toxic, bool)) > 0.95


def test_windows_cover_every_word():
    for n in (*range(0, 120), 1000):
        seen = set(itertools.chain.from_iterable(range(s, min(n, s + toxicity.WINDOW)) for s in toxicity.windows_of(n)))
        assert seen == set(range(n))


def test_gradients():
    """Back-propagation through time against finite differences."""
    rng = np.random.default_rng(0)
    x, rec = rng.normal(size=(5, 3, 24)), rng.normal(size=(8, 24)) * 0.3
    mask = np.ones((5, 3), bool)
    mask[4, 1] = False
    goal = rng.normal(size=(5, 3, 8))
    states, saved = toxicity._read(x, rec, mask, True)
    gx, grec = toxicity._back(goal, rec, mask, saved)
    value = lambda: float((toxicity._read(x, rec, mask, False)[0] * goal).sum())
    for array, grad, at in ((x, gx, (1, 2, 5)), (x, gx, (3, 0, 20)), (rec, grec, (2, 3)), (rec, grec, (7, 18))):
        kept = array[at]
        array[at] = kept + 1e-6
        up = value()
        array[at] = kept - 1e-6
        down = value()
        array[at] = kept
        assert math.isclose((up - down) / 2e-6, grad[at], rel_tol=1e-4, abs_tol=1e-7)


def test_toxicity_odd_rows(spark, net):
    ship_package(spark)
    df = spark.createDataFrame(ODD, SCHEMA)
    told = toxicity.score(df, net).collect()
    by = {(r["doc_id"], r["text"]): r["score"] for r in told}
    assert len(told) == len(ODD) and all(0 <= r["score"] <= 1 for r in told)
    assert by[1, None] == by[2, ""] == by[3, "123 !?"] == 0.25
    assert toxicity.score(df.limit(0), net).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    bare = toxicity.train(df, labels)
    assert {r["score"] for r in toxicity.score(df, bare).collect()} == {0.0}


def test_every_language_has_its_part_of_the_sample(spark):
    rows = [(f"{k} " + "x" * 900, "en") for k in range(400)] + [(f"{k} court", "fr") for k in range(40)] + [(f"{k} kurz", "de") for k in range(40)]
    picked = langid.sample(spark.createDataFrame(rows, "text string, lang string"), "text", "lang", 600, 90_000)
    held = {x: sum(len(t.encode()) for t, y in picked if y == x) for x in ("en", "fr", "de")}
    assert sum(y == "fr" for _, y in picked) == 40 and sum(y == "de" for _, y in picked) == 40
    assert 29_000 <= held["en"] <= 30_000
    assert langid.sample(spark.createDataFrame([], "text string, lang string"), "text", "lang", 600, 90_000) == []


def test_long_texts_take_no_place_in_the_sample(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "long " * 30 if k % 2 else f"short {k}") for k in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 40)) for k in range(80)], "doc_id long, toxic int")
    seen = {}
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic, share: seen.update(texts=texts, toxic=toxic, share=share))
    toxicity.train(docs, labels, rows=15, max_bytes=100)
    assert len(seen["texts"]) == 30 and sum(seen["toxic"]) == 15 and seen["share"] == 0.5


def test_bounds_of_the_samples():
    assert langid.SAMPLE_ROWS >= 600 and langid.SAMPLE_BYTES >= 16 << 20 and toxicity.SAMPLE_ROWS >= 1500
