"""Byte-level BPE encoding and decoding by batched merge rounds.

All distinct words of a chunk lie behind one another in one flat symbol array. A round looks
up the rank of every neighbouring pair by binary search over the sorted pair keys, takes each
word's lowest rank and joins all its occurrences; words without a known pair leave the array.
Spark deals the rows; each task keeps a bounded store of words it has already encoded.

Null texts encode as empty; empty texts have no ids. Other columns pass through unchanged,
also those with the names of outputs, which the outputs replace. Repeated rows stay.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gridpanel.llm.arrowtext import filled, flat, handing_back, slices

#: Bytes of text encoded at once; a longer text is encoded alone. The words of a slice cost some hundred times as much.
SLICE_BYTES = 1 << 19
#: Words a task remembers before it starts anew.
STORE_WORDS = 200_000
_NONE = np.int64(1) << 40


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files of this kind."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """What encoding needs, as arrays: sorted pair keys with ranks and products, and each id's bytes."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or spec["normalizer"] or pre["add_prefix_space"]:
            raise ValueError(f"{path} is no plain byte-level BPE")
        letters, vocab = byte_letters(), model["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens that take in their surroundings")
        spelled = {i: bytes(letters[c] for c in word) for word, i in vocab.items()} | {i: s.encode() for s, i in special.items()}
        self.size = max(spelled) + 1
        pieces = [spelled.get(i, b"") for i in range(self.size)]
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.byte_ids = np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.special = special

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and product of each pair; unknown pairs have the rank ``_NONE``."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = self.keys[at] == key
        return np.where(known, self.ranks[at], _NONE), self.made[at]


def merge_rounds(vocabulary: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in one array and the number of ids of each word."""
    lengths = np.array([len(w) for w in words], np.int64)
    symbols = vocabulary.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    word = np.repeat(np.arange(len(words)), lengths)
    done_symbols, done_words = [], []
    while len(symbols):
        rank = np.full(len(symbols), _NONE)
        made = np.zeros(len(symbols), np.int64)
        if len(symbols) > 1:
            together = np.flatnonzero(word[:-1] == word[1:])
            rank[together], made[together] = vocabulary.pair(symbols[together], symbols[together + 1])
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        size = np.diff(np.append(first, len(word)))
        low = np.repeat(np.minimum.reduceat(rank, first), size)
        open_ = low < _NONE
        if not open_.all():
            done_symbols.append(symbols[~open_])
            done_words.append(word[~open_])
        hit = open_ & (rank == low)
        # x x x holds the pair x x twice, one over the other: of such a run every second one counts, from the left
        start = hit & ~np.concatenate([[False], hit[:-1]])
        at = np.arange(len(hit))
        since = at - np.maximum.accumulate(np.where(start, at, 0))
        hit &= since % 2 == 0
        gone = np.concatenate([[False], hit[:-1]])
        symbols = np.where(hit, made, symbols)
        stay = open_ & ~gone
        symbols, word = symbols[stay], word[stay]
    if not done_symbols:
        return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
    ids, owner = np.concatenate(done_symbols), np.concatenate(done_words)
    return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ranges ``values[start : start + length]`` behind one another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    step = np.repeat(starts - (ends - lengths), lengths)
    return values[step + np.arange(total)]


class Grown:
    """An array that doubles its room when it is full."""

    def __init__(self, dtype):
        self.data, self.size = np.zeros(1024, dtype), 0

    def add(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(max(need, 2 * len(self.data)) - len(self.data), self.data.dtype)])
        self.data[self.size : need] = values
        self.size = need


class Encoder:
    """Texts to ids. ``pattern`` cuts a text into words that merge on their own."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary = vocabulary
        self.cut = regex.compile(pattern).findall
        named = sorted(vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, named)) + ")") if named else None
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.starts, self.lengths = Grown(np.int32), Grown(np.int64), Grown(np.int64)

    def learn(self, new: list[str]) -> None:
        plain = [w for w in new if w not in self.vocabulary.special]
        ids, counts = merge_rounds(self.vocabulary, [w.encode() for w in plain])
        marks = [w for w in new if w in self.vocabulary.special]
        ids = np.concatenate([ids, [self.vocabulary.special[w] for w in marks]])
        counts = np.concatenate([counts, np.ones(len(marks), np.int64)]).astype(np.int64)
        begin = self.ids.size + np.cumsum(counts) - counts
        for w in plain + marks:
            self.known[w] = len(self.known)
        self.ids.add(ids)
        self.starts.add(begin)
        self.lengths.add(counts)

    def words(self, text: str) -> list[str]:
        if self.special is None or not self.special.search(text):
            return self.cut(text)
        parts = self.special.split(text)
        return [w for part in parts for w in ([part] if part in self.vocabulary.special else self.cut(part))]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array and the number of ids of each text."""
        if len(self.known) > STORE_WORDS:
            self.forget()
        cut = [self.words(t) for t in texts]
        words = [w for text in cut for w in text]
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if new:
            self.learn(new)
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        sizes = self.lengths.data[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        bounds = np.concatenate([[0], np.cumsum([len(text) for text in cut])]).astype(np.int64)
        return gather(self.ids.data, self.starts.data[at], sizes), np.diff(ends[bounds])


def _binary(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary column from flat bytes; a chunk stays far below what 32-bit offsets hold."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _replaced(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    names = {f.name for f in fields}
    return T.StructType([f for f in schema.fields if f.name not in names] + list(fields))


def _with(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    kept = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n not in columns}
    return pa.RecordBatch.from_pydict(kept | columns)


def _encoded(encoder: Encoder, part: pa.RecordBatch, text: str) -> pa.RecordBatch:
    ids, counts = encoder(filled(part.column(text)).to_pylist())
    return _with(part, ids=_binary(ids.astype("<u4").view(np.uint8), counts * 4), n_tokens=pa.array(counts, pa.int64()))


def _decoded(vocabulary: Vocabulary, part: pa.RecordBatch, ids: str, out: str) -> pa.RecordBatch:
    data, offsets = flat(filled(part.column(ids)))
    codes = np.frombuffer(data.tobytes(), "<u4").astype(np.int64)
    if len(codes) and codes.max() >= vocabulary.size:
        raise ValueError("an id is not in the vocabulary")
    sizes = vocabulary.lengths[codes]
    spelled = gather(vocabulary.bytes, vocabulary.starts[codes], sizes).tobytes()
    ends = np.concatenate([[0], np.cumsum(sizes)])[offsets // 4]
    texts = [spelled[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
    return _with(part, **{out: pa.array(texts, pa.string())})


def bpe_encode(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Add ``ids`` (binary: little-endian unsigned 32-bit ids) and ``n_tokens`` (long).

    ``path`` names the tokenizer's JSON file on the driver, ``pattern`` its word rule. The
    tables built from it are broadcast; their size is that of the vocabulary file.
    """
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, pattern)
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                yield _encoded(encoder, part, text)

    return df.mapInArrow(handing_back(encode), _replaced(df.schema, T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())))


def bpe_decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text of packed ``ids``; bytes that are no UTF-8 become replacement characters."""
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, ids, SLICE_BYTES):
                yield _decoded(shared.value, part, ids, out)

    return df.mapInArrow(handing_back(decode), _replaced(df.schema, T.StructField(out, T.StringType())))


def bpe_codec(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "decoded") -> DataFrame:
    """:func:`bpe_encode` and :func:`bpe_decode` of its ids in one pass, so a task has one worker for both."""
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, pattern)
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                yield _decoded(shared.value, _encoded(encoder, part, text), "ids", out)

    added = [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField(out, T.StringType())]
    return df.mapInArrow(handing_back(both), _replaced(df.schema, *added))


def ranks_of(path: str) -> dict[bytes, int]:
    """Pieces and ids of a vocabulary file with one base64 piece and its number per line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
