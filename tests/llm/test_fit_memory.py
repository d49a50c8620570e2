"""What the fit holds at once in the driver's Python."""

import tracemalloc

import numpy as np

from gridpanel.llm import toxicity as T


def test_buckets_of_many_words_are_found_in_parts():
    words = [f"word{i:06d}abcdef" for i in range(T.HELD_WORDS * 5 + 7)]
    grams, owner, own = T.gram_buckets(words)
    tracemalloc.start()
    flat, counts, mine = T.buckets_by_word(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(flat, grams[np.argsort(owner, kind="stable")]) and np.array_equal(counts, np.bincount(owner))
    assert np.array_equal(mine, own)
    # the result twice, and what a part needs
    assert peak < 3 * flat.nbytes + (30 << 20)
    assert [len(p) for p in T.buckets_by_word([])] == [0, 0, 0]
