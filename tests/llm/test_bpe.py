"""BPE against the tokenizers library, and as a round trip."""

import struct

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridpanel.llm import bpe
from gridpanel.llm.queries import WORD_RULE
from gridpanel.session import ship_package

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = bpe.Encoder(bpe.Vocabulary(PATH), WORD_RULE)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text("aAx !'\n\té9<|endoftext|>", max_size=60)), min_size=1, max_size=4))
def test_same_ids(texts):
    ids, counts = ENCODER(texts)
    want = [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_columns(spark):
    ship_package(spark)
    rows = [(1, None, "x"), (2, "", "y"), (3, "a<|endoftext|>b", "z"), (4, "aaaa" * 20_000 + " Ünï 🎉", None), (4, "aaaa", None), (4, "aaaa", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    told = bpe.bpe_decode(bpe.bpe_encode(df, PATH, WORD_RULE), PATH).collect()
    both = bpe.bpe_codec(df, PATH, WORD_RULE).collect()
    assert len(told) == len(both) == len(rows)
    for r in told + both:
        want = LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids
        assert list(struct.unpack(f"<{r['n_tokens']}I", r["ids"])) == want
        assert r["decoded"] == (r["text"] or "")
    assert bpe.bpe_encode(df.limit(0), PATH, WORD_RULE).count() == 0


def test_decoding_broken_bytes(spark):
    ship_package(spark)
    half = LIBRARY.encode("🎉", add_special_tokens=False).ids[:1]
    df = spark.createDataFrame([(bytearray(struct.pack("<I", half[0])),), (None,)], "ids binary")
    told = sorted(r["decoded"] for r in bpe.bpe_decode(df, PATH).collect())
    assert told == ["", LIBRARY.decode(half, skip_special_tokens=False)]
