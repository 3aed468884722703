"""Which tokens of two tokenizers cover the same bytes, counted by documents over the corpus: a cogroup of postings."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import bounded_batches, materialise

#: Segments that a worker remembers, and bytes of text it takes on at a time.
MEMO_SEGMENTS = 300_000
SLICE_CHARS = 2_000_000
#: Postings and documents of a block of postings; documents fit 16 bits.
BLOCK_POSTINGS = 2_000_000
BLOCK_DOCS = 65_536
#: Postings of one side id that one piece of it takes; a busier id is dealt over several.
PIECE_POSTINGS = 4_000_000
#: Contributions that a task gathers before it sums them by document and passes them on, a row per 2 ** RANGE neighbouring documents.
GATHERED = 2_000_000
RANGE = 12

#: A blank between two signs that aren't white space: neither tokenizer joins across it, and both put it before what follows.
_CUT = re.compile(r"(?<=\S) (?=\S)")


def _byte_letters() -> dict[str, int]:
    """The sign that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Aligner:
    """Two tokenizers, and the alignment of every segment met.

    A segment is what lies between two cuts. Its tokens, their groups and the pairs that these link depend on it
    alone, so a text's are its segments' in order. New segments are encoded many in one call and told apart by bytes.
    """

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = _byte_letters()
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(map(letters.get, token)) if all(c in letters for c in token) else token.encode()
        self.b_bytes = []
        for i in range(self.b.vocab_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in tokens], np.int64) for tokens in (self.a_bytes, self.b_bytes))
        self.forget()

    def forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.numbers = np.zeros((1024, 4), np.int64)
        self.starts, self.sizes = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.pairs, self.n_pairs = np.zeros(4096, np.int64), 0
        self.groups: list[str | None] = []

    def _grown(self, array: np.ndarray, need: int) -> np.ndarray:
        while len(array) < need:
            array = np.concatenate([array, np.zeros_like(array)])
        return array

    def _keep(self, segments: list[str], numbers: np.ndarray, sizes: np.ndarray, pairs: np.ndarray, groups: list[str | None]) -> None:
        at, n = len(self.groups), len(segments)
        self.slots |= zip(segments, range(at, at + n), strict=True)
        self.numbers, self.starts, self.sizes = (self._grown(x, at + n) for x in (self.numbers, self.starts, self.sizes))
        self.pairs = self._grown(self.pairs, self.n_pairs + len(pairs))
        self.numbers[at : at + n] = numbers
        self.starts[at : at + n] = self.n_pairs + np.cumsum(sizes) - sizes
        self.sizes[at : at + n] = sizes
        self.pairs[self.n_pairs : self.n_pairs + len(pairs)] = pairs
        self.n_pairs += len(pairs)
        self.groups += groups

    def _learn(self, segments: list[str]) -> None:
        """Align segments in one call; where the bytes or the cuts don't come back, in halves, and a lone segment whose bytes differ has no tokens."""
        text = " ".join(segments)
        want = (" " + text).encode()
        a = np.array(self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, np.int64)
        b = np.array(self.b.encode(text, num_threads=1), np.int64)
        same = all(b"".join(map(tokens.__getitem__, ids.tolist())) == want for tokens, ids in ((self.a_bytes, a), (self.b_bytes, b)))
        if same:
            a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
            ends = np.cumsum([len(s.encode()) + 1 for s in segments])
            common = np.intersect1d(a_ends, b_ends)
            same = bool(np.isin(ends, common).all())
        if not same and len(segments) > 1:
            self._learn(segments[: len(segments) // 2])
            self._learn(segments[len(segments) // 2 :])
            return
        if not same:
            self._keep(segments, np.zeros((1, 4), np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64), [None])
            return
        a_group, b_group = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
        in_a, in_b = (np.bincount(g, minlength=len(common)) for g in (a_group, b_group))
        links = in_a * in_b
        # all pairs of each group: its A tokens, each as often as it has B tokens, against those in turn
        first_a, first_b, first = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b, np.cumsum(links) - links
        turn = np.arange(int(links.sum())) - np.repeat(first, links)
        wide = np.repeat(in_b, links)
        pairs = a[np.repeat(first_a, links) + turn // wide] * len(self.b_bytes) + b[np.repeat(first_b, links) + turn % wide]
        of = np.searchsorted(ends, common)
        numbers = np.stack([np.bincount(of, x, len(segments)) for x in (in_a, in_b, np.ones(len(common)), links)], axis=1).astype(np.int64)
        a_names, b_names = list(map(str, a.tolist())), list(map(str, b.tolist()))
        texts = [",".join(a_names[i : i + n]) + "|" + ",".join(b_names[j : j + m]) for i, n, j, m in zip(first_a.tolist(), in_a.tolist(), first_b.tolist(), in_b.tolist(), strict=True)]
        cuts = np.cumsum(numbers[:, 2]).tolist()
        self._keep(segments, numbers, numbers[:, 3], pairs, [";".join(texts[i:j]) for i, j in zip([0, *cuts], cuts, strict=False)])

    def learn(self, segments: list[str]) -> None:
        """Align segments not met before. White space at an end would run into the next one's blank, so those go alone."""
        loose = [s for s in segments if s[0].isspace() or s[-1].isspace()]
        kept = set(loose)
        rest = [s for s in segments if s not in kept]
        for at in range(0, len(rest), 4096):
            self._learn(rest[at : at + 4096])
        for s in loose:
            self._learn([s])

    def texts(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of texts that aren't empty: (n_a, n_b, n_groups, n_links) each, the digest of the groups each, and the distinct (text, pair, times)."""
        if len(self.groups) > MEMO_SEGMENTS or self.n_pairs > 16 * MEMO_SEGMENTS:
            self.forget()
        cut = [_CUT.split(t) for t in texts]
        flat = list(chain.from_iterable(cut))
        if missing := [s for s in dict.fromkeys(flat) if s not in self.slots]:
            self.learn(missing)
        slots = np.array(list(map(self.slots.__getitem__, flat)), np.int64)
        ends = np.cumsum([len(c) for c in cut])
        begins = [0, *ends[:-1].tolist()]
        numbers = np.add.reduceat(self.numbers[slots], begins, axis=0)
        digests, bad = [], np.zeros(len(texts), bool)
        at = slots.tolist()
        for k, (i, j) in enumerate(zip(begins, ends.tolist(), strict=True)):
            parts = [self.groups[s] for s in at[i:j]]
            bad[k] = None in parts
            digests.append("" if bad[k] else hashlib.sha256(";".join(parts).encode()).hexdigest())
        numbers[bad] = 0
        of = np.repeat(np.arange(len(texts)), np.diff([0, *ends]))
        good = ~bad[of]
        slots, of = slots[good], of[good]
        sizes = self.sizes[slots]
        places = np.repeat(self.starts[slots] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        span = len(self.a_bytes) * len(self.b_bytes)
        found, times = np.unique(np.repeat(of, sizes) * span + self.pairs[places], return_counts=True)
        return numbers, digests, found // span, found % span, times


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """This worker's aligner of two tokenizer files."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


_DOC = ("n_a", "n_b", "n_groups", "n_links")


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Cuts of an array as binaries, without a copy."""
    offsets = (np.concatenate([[0], ends]) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def postings(docs: DataFrame, a_path: str, b_path: str, key: str, text: str) -> DataFrame:
    """Two kinds of rows: a document's numbers (kind 0, with its place ``row``), and blocks of postings (kind 1).

    A block has a pair (a, b), the documents of at most BLOCK_DOCS places from ``row`` on that hold it linked, as 16-bit
    distances, how often each does, as 32-bit numbers, and how many they are (n).
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, place = aligner(a_path, b_path), TaskContext.get().partitionId() << 33
        base, held, count = place, [], 0

        def row_batch(size: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(size, f.type) for f in out], schema=out)

        def block() -> Iterator[pa.RecordBatch]:
            where, pairs, times = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(pairs, kind="stable")
            where, pairs, times = where[order], pairs[order], times[order]
            ends = np.append(np.flatnonzero(np.diff(pairs)) + 1, len(pairs))
            distinct, n = pairs[ends - 1], np.diff([0, *ends])
            wide = len(at.b_bytes)
            for i in range(0, len(ends), 20_000):
                j = min(i + 20_000, len(ends))
                low, high = (ends[i - 1] if i else 0), ends[j - 1]
                yield row_batch(
                    j - i, kind=pa.array(np.ones(j - i, np.int32)), row=pa.array(np.full(j - i, base)), a=pa.array((distinct[i:j] // wide).astype(np.int32)), b=pa.array((distinct[i:j] % wide).astype(np.int32)),
                    n=pa.array(n[i:j].astype(np.int64)), docs=_binary(where[low:high].astype("<u2"), ends[i:j] - low), times=_binary(times[low:high].astype("<u4"), ends[i:j] - low),
                )

        def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            start, total = 0, 0
            sizes = [len(t or "") for t in batch.column(1).to_pylist()]
            for i, size in enumerate(sizes):
                if i > start and (total + size > SLICE_CHARS or i - start == 500):
                    yield batch.slice(start, i - start)
                    start, total = i, 0
                total += size
            if start < len(sizes):
                yield batch.slice(start)

        for batch in batches:
            out = pa.schema([("kind", pa.int32()), ("key", batch.schema.field(0).type), ("row", pa.int64()), *[(c, pa.int64()) for c in _DOC], ("digest", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64()), ("docs", pa.binary()), ("times", pa.binary())])
            for part in slices(batch):
                texts = part.column(1).to_pylist()
                full = [i for i, t in enumerate(texts) if t]
                numbers, digests = np.zeros((len(texts), 4), np.int64), [""] * len(texts)
                if full:
                    got, found, where, pairs, times = at.texts([texts[i] for i in full])
                    numbers[full] = got
                    for i, digest in zip(full, found, strict=True):
                        digests[i] = digest
                    held.append((np.array(full)[where] + place - base, pairs, times))
                    count += len(pairs)
                rows = np.arange(place, place + len(texts))
                place += len(texts)
                yield row_batch(len(texts), kind=pa.array(np.zeros(len(texts), np.int32)), key=part.column(0), row=pa.array(rows), digest=pa.array(digests, pa.string()), **{c: pa.array(numbers[:, k]) for k, c in enumerate(_DOC)})
                if count and (count > BLOCK_POSTINGS or place - base > BLOCK_DOCS - 1000):
                    yield from block()
                    held, count = [], 0
                if not count:
                    base, held = place, []
        if count:
            yield from block()

    rows = docs.select(F.col(key), F.col(text).cast("string"))
    return rows.mapInArrow(run, f"kind int, key {kind.simpleString()}, row long, n_a long, n_b long, n_groups long, n_links long, digest string, a int, b int, n long, docs binary, times binary")


def _contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(range, docs, best, total): sums of the documents that side ids' postings name, packed by ranges of documents.

    A partition comes sorted: of each id first its pairs' counts, then its blocks of postings. Counts of one id, at most
    a vocabulary, are held; postings stream by, whatever their number.
    """
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    gathered = 0
    ids, counts = np.zeros((0, 2), np.int64), np.zeros(0, np.int64)

    def summed() -> pa.RecordBatch:
        row, best, total = (np.concatenate(x) for x in zip(*held, strict=True))
        distinct, of = np.unique(row, return_inverse=True)
        sums = [np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)]
        for out, values in zip(sums, (best, total), strict=True):
            np.add.at(out, of, values)
        ranges = distinct >> RANGE
        ends = np.append(np.flatnonzero(np.diff(ranges)) + 1, len(ranges))
        packed = [(distinct & (1 << RANGE) - 1).astype("<u2"), *(x.astype("<i8") for x in sums)]
        return pa.RecordBatch.from_arrays([pa.array(ranges[ends - 1]), *(_binary(x, ends) for x in packed)], ["range", "docs", "best", "total"])

    for batch in batches:
        a, kind, b, n, row = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        head = kind == 0
        ids = np.concatenate([ids, np.stack([a[head], b[head]], axis=1).astype(np.int64)])
        counts = np.concatenate([counts, n[head]])
        keys, first = np.unique(ids[:, 0] << 32 | ids[:, 1], return_index=True)
        ids, counts = ids[first], counts[first]
        at = np.flatnonzero(~head)
        if len(at):
            places = np.searchsorted(keys, a[at].astype(np.int64) << 32 | b[at])
            starts = np.append(0, np.flatnonzero(np.diff(ids[:, 0])) + 1)
            most = np.repeat(np.maximum.reduceat(counts, starts), np.diff(np.append(starts, len(ids))))
            blocks = batch.take(pa.array(at))
            docs, times = (np.frombuffer(b"".join(blocks.column(i).to_pylist()), t).astype(np.int64) for i, t in ((5, "<u2"), (6, "<u4")))
            sizes = np.array([len(x) // 2 for x in blocks.column(5).to_pylist()])
            each, best = np.repeat(counts[places], sizes), np.repeat(counts[places] == most[places], sizes)
            held.append((np.repeat(row[at], sizes) + docs, times * best, times * each))
            gathered += len(docs)
            if gathered > GATHERED:
                yield summed()
                held, gathered = [], 0
        if len(a):
            ids, counts = ids[ids[:, 0] == a[-1]], counts[ids[:, 0] == a[-1]]
    if held:
        yield summed()


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, n_best, count_sum): packed contributions, sorted by range, added up. One range's sums are held."""
    at, sums, seen = None, np.zeros((2, 1 << RANGE), np.int64), np.zeros(1 << RANGE, bool)

    def done() -> pa.RecordBatch:
        docs = np.flatnonzero(seen)
        return pa.RecordBatch.from_arrays([pa.array((at << RANGE) + docs), pa.array(sums[0, docs]), pa.array(sums[1, docs])], ["row", "n_best", "count_sum"])

    for batch in batches:
        for place, docs, best, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if place != at:
                if at is not None:
                    yield done()
                at = place
                sums[:] = 0
                seen[:] = False
            docs = np.frombuffer(docs, "<u2")
            seen[docs] = True
            sums[0, docs] += np.frombuffer(best, "<i8")  # a row names a document once
            sums[1, docs] += np.frombuffer(total, "<i8")
    if at is not None:
        yield done()


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row per row of ``docs``.

    A is a byte-level vocabulary's file, B a piece model's. Postings of linked pairs are written once, then shuffled by
    their A id, whose pairs' counts come before them in the sort order; each task has an id's counts and their
    maximum when its postings stream by, and passes on sums by document, packed, which one more shuffle adds up. An id of over
    PIECE_POSTINGS postings is dealt over several pieces, each with all its counts; which ids those are is broadcast, a row an
    id of the vocabulary at most.

    Null and empty texts, and texts that a tokenizer doesn't give back byte for byte (with U+2581, say), have zeros and an
    empty digest. Rows that repeat each count as a document; null keys are kept; other columns are ignored; an empty table gives
    an empty result. Texts of any length are whole: they are cut only where both tokenizers do.
    """
    a_path, b_path = a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")
    made = materialise(postings(docs, a_path, b_path, key, text), "aligned-postings")
    blocks = made.where("kind = 1")
    counts = materialise(blocks.groupBy("a", "b").agg(F.sum("n").alias("n")), "aligned-counts")
    busy = F.broadcast(counts.groupBy("a").agg(F.ceil(F.sum("n") / PIECE_POSTINGS).cast("int").alias("pieces")).where("pieces > 1"))
    pieces = F.coalesce("pieces", F.lit(1))
    heads = counts.join(busy, "a", "left").select("a", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"), F.lit(0).alias("kind"), "b", "n", F.lit(0).cast("long").alias("row"), F.lit(None).cast("binary").alias("docs"), F.lit(None).cast("binary").alias("times"))
    dealt = blocks.join(busy, "a", "left").select("a", F.pmod(F.xxhash64("b", "row"), pieces).cast("int").alias("piece"), "kind", "b", "n", "row", "docs", "times")
    streams = heads.unionByName(dealt).repartition("a", "piece").sortWithinPartitions("a", "piece", "kind", "b")
    sums = streams.select("a", "kind", "b", "n", "row", "docs", "times").mapInArrow(_contributions, "range long, docs binary, best binary, total binary")
    sums = sums.repartition("range").sortWithinPartitions("range").mapInArrow(_by_document, "row long, n_best long, count_sum long")
    out = made.where("kind = 0").select("key", "row", *_DOC, "digest").join(sums, "row", "left")
    return out.select(F.col("key").alias(key), *_DOC, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")], F.col("digest").alias("groups_sha256"))
