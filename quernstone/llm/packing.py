"""Concatenate-and-cut packing: two passes of prefix sums, then fixed windows with boundary records."""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import bounded_batches, materialise

#: Words of a generation of a Python worker's memo, of which it keeps two.
MEMO_WORDS = 400_000
#: Words tokenized in one call.
CALL_WORDS = 2000
#: ASCII marks, a run of which is tokenized apart from letters beside it; an apostrophe may begin a contraction.
MARKS = string.punctuation.replace("'", "")
#: A mark between an ASCII letter and white space: a pre-token of its own, so a blank may go before it.
_MARK = re.compile(rb"(?<=[a-z])([,.])(?=\s)")


class WordIds:
    """Ids by word, as little-endian bytes.

    The tokenizer folds case, drops white space and never joins across it, so a text's ids are its words' ids in
    order (any other tokenizer gets whole texts). New words are tokenized many at a time: plain ones are told apart by the ids that end a word, of which a run
    of letters has one at its end and a mark is another, any others by a special token between them.
    Words live in two generations: a full young one becomes the old one, and words met again return.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        special = sorted((i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items())
        probe = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in ("Ab", "ab c.", "ab", "c.", "c", ".", " ab \n\tc . ")]
        self.by_word = probe[0] == probe[2] and probe[1] == probe[2] + probe[3] == probe[6] and probe[3] == probe[4] + probe[5]
        self.mark, self.between = special[-1] if special else (None, "")
        self.special = tuple(t.encode() for _, t in special)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def alone(self, word: bytes) -> bytes:
        return np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def parted(self, words: list[bytes]) -> list[bytes]:
        """The ids of any words, told apart by a special token between them."""
        if self.mark is None or any(t in w for t in self.special for w in words):
            return list(map(self.alone, words))
        text = self.between.encode().join(words).decode()
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(ids == self.mark) * 4
        data = ids.tobytes()
        return [data[i:j] for i, j in zip([0, *(cuts + 4).tolist()], [*cuts.tolist(), len(data)], strict=True)]

    def spelled(self, words: list[str], ends: list[int]) -> list[bytes]:
        """The ids of words of Latin letters and marks, told apart by how many of their ids end a word."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        stops, last = np.flatnonzero(self.ends[ids]), np.cumsum(ends) - 1
        if len(stops) != last[-1] + 1:  # a letter that lower-cases to more than letters
            return self.parted([w.encode() for w in words])
        cuts, data = ((stops[last] + 1) * 4).tolist(), ids.tobytes()
        return [data[i:j] for i, j in zip([0, *cuts], cuts, strict=False)]

    @staticmethod
    def parts(word: str) -> int:
        """The pre-tokens of a run of letters with marks before or behind it; 0 for any other word."""
        core = word.strip(MARKS)
        if not core:
            return 1
        return 1 + (word[0] in MARKS) + (word[-1] in MARKS) if core.isalpha() else 0

    def together(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of each word."""
        out: dict[bytes, bytes] = {}
        for at in range(0, len(words), CALL_WORDS):
            some = words[at : at + CALL_WORDS]
            text = b"\n".join(some).decode()
            names = text.split("\n")
            latin = max(text) < "\u0250"
            ends = [self.parts(w) if latin or max(w) < "\u0250" else 0 for w in names]
            plain = [i for i, n in enumerate(ends) if n]
            odd = [w for w, n in zip(some, ends, strict=True) if not n]
            if plain:
                out |= zip([some[i] for i in plain], self.spelled([names[i] for i in plain], [ends[i] for i in plain]), strict=True)
            if odd:
                out |= zip(odd, self.parted(odd), strict=True)
        return out

    def texts(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text."""
        if not self.by_word:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast([(t or b"").decode() for t in texts], add_special_tokens=False)]
        if len(self.young) > MEMO_WORDS:
            self.young, self.old = {}, self.young
        # folding must not make a special token
        words = [(t if b"<|" in t else _MARK.sub(rb" \1", t.lower())).split() for t in (t or b"" for t in texts)]
        flat = list(chain.from_iterable(words))
        found = list(map(self.young.get, flat))
        gaps = [i for i, ids in enumerate(found) if ids is None]
        if gaps:
            missing = dict.fromkeys([flat[i] for i in gaps])
            back = {w: self.old[w] for w in missing if w in self.old}
            rest = [w for w in missing if w not in back]
            new = back | self.together(rest)
            for i in gaps:
                found[i] = new[flat[i]]
            self.young |= {w: ids for w, ids in new.items() if len(w) <= 64}
        ends = np.cumsum([len(w) for w in words]).tolist()
        return [b"".join(found[i:j]) for i, j in zip([0, *ends], ends, strict=False)]


_memos: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """This worker's memo for a tokenizer file."""
    if path not in _memos:
        _memos[path] = WordIds(path)
    return _memos[path]


def tokenize(docs: DataFrame, tokenizer: str, end_id: int, key: str, text: str) -> DataFrame:
    """(key, part, local_start, n, ids): each row's ids with ``end_id`` after them, and its start within its partition."""
    bounded_batches(docs.sparkSession)
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, part, start = word_ids(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = [i + end for i in memo.texts(batch.column(1).cast(pa.binary()).to_pylist())]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            starts = start + np.cumsum(n) - n
            start += int(n.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(n), part), pa.int64()), pa.array(starts), pa.array(n), pa.array(ids, pa.binary())], ["key", "part", "local_start", "n", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key), F.col(text).cast("string"))
    return rows.mapInArrow(run, f"key {kind}, part long, local_start long, n long, ids binary").withColumnRenamed("key", key)


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, length: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Boundary records (key, start, length, doc_tokens, sequence_id, offset, ids) of all rows.

    Pass one tokenizes each partition and sums its tokens; prefix sums over the partitions' totals (one
    number a partition) give every row its global offset. Pass two cuts the one long stream at
    multiples of ``length``; only the last sequence can be short. ids are the piece's ids as
    little-endian unsigned 32-bit integers. The order is that of the scan, kept in a written table, so
    retried tasks see the same offsets. Null and empty texts are just the end id; equal rows are
    each packed; other columns are ignored; an empty table gives no pieces.
    """
    tokenizer = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    tokens = materialise(tokenize(docs, tokenizer, end_id, key, text), "packed-tokens")
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    placed = tokens.join(F.broadcast(before), "part").withColumn("at", F.col("before") + F.col("local_start"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ns, ats = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            rows = [(i, max(at, w * length) - at, min(at + n, (w + 1) * length) - max(at, w * length), n, w, max(at, w * length) - w * length) for i, (n, at) in enumerate(zip(ns, ats, strict=True)) for w in range(at // length, (at + n - 1) // length + 1)]
            ids = batch.column(3)
            texts = [memoryview(ids[i].as_buffer())[s * 4 : (s + m) * 4] for i, s, m, *_ in rows]
            numbers = np.array(rows, np.int64).reshape(-1, 6)
            keys = batch.column(0).take(pa.array(numbers[:, 0]))
            yield pa.RecordBatch.from_arrays([keys, *[pa.array(numbers[:, c]) for c in range(1, 6)], pa.array([bytes(t) for t in texts], pa.binary())], ["key", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    pieces = placed.select(key, "n", "at", "ids").mapInArrow(cut, f"key {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
    return pieces.withColumnRenamed("key", key)
