"""Substring dedup by sliding sentence spans."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialise

#: A sentence ends after its closing marks and the white space behind them, full-width marks need none, or with its line.
#: A run of marks is tried from its first one only, so that a long run costs its length.
_END = re.compile(r"(?<![.!?])[.!?]++\s+|[。！？]+\s*|\n+")
#: Scripts written without blanks: each of their characters counts as a word.
_SIGN = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]")
_WORD = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]|[^\s\u3040-\u30ff\u3400-\u9fff]+")

#: Distinct spans that a task remembers; a full memory is emptied, which only costs shuffled rows.
MEMORY = 1_000_000


def sentences(text: str) -> list[str]:
    """The text's sentences in order, white space kept: joined they are the text."""
    out, at = [], 0
    for end in [*[m.end() for m in _END.finditer(text)], len(text)]:
        if end > at:
            out.append(text[at:end])
            at = end
    return out


def words(sentence: str) -> list[str]:
    """The sentence's lower-case words."""
    low = sentence.lower()
    return _WORD.findall(low) if _SIGN.search(low) else low.split()


def spans(text: str, least_sentences: int, least_words: int) -> Iterator[tuple[int, int, int]]:
    """(hash, first sentence, sentences) of the shortest runs that have at least so many sentences and words, by their first sentence.

    These are the shortest run from each sentence and the shortest run up to each: together those inside
    any longer run cover all of it. Runs start with a word, and those up to a sentence also end with one, so no two are the
    same words in the same place. The hash is of the words, case and white space aside.
    """
    units = [" ".join(words(s)) for s in sentences(text)]
    sizes = [u.count(" ") + 1 if u else 0 for u in units]
    ends: list[list[int]] = [[] for _ in units]
    end = total = 0
    for i, size in enumerate(sizes):
        while end < len(units) and (end - i < least_sentences or total < least_words):
            total += sizes[end]
            end += 1
        if end - i < least_sentences or total < least_words:
            break
        if size:
            ends[i].append(end)
        total -= size
    before = list(accumulate(sizes, initial=0))
    following, at = [0] * len(units), len(units)  # the next sentence with a word
    for i in range(len(units) - 1, -1, -1):
        following[i] = at
        at = i if sizes[i] else at
    start = 0
    for end in range(1, len(units) + 1):
        while (at := following[start]) < end and end - at >= least_sentences and before[end] - before[at] >= least_words:
            start = at  # the last start with a word from which the run is long enough
        if sizes[end - 1] and sizes[start] and end - start >= least_sentences and before[end] - before[start] >= least_words and end not in ends[start]:
            ends[start].append(end)
    for i, found in enumerate(ends):
        for end in sorted(found):
            yield xxhash.xxh3_64_intdigest(" ".join(units[i:end]).encode()) - (1 << 63), i, end - i


def repeated_spans(docs: DataFrame, least_sentences: int = 2, least_words: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text_hash, covered): for each document the (first, count) sentence runs that repeat an earlier one.

    The first occurrence of a span is that of the smallest key (nulls last), then text hash, then place; every
    other one is covered. A task passes on only its first occurrence of a span and marks later
    ones itself, so a passage that a third of all documents share costs the global join a row a task.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple] = {}
        for batch in batches:
            rows = []
            for doc, text_hash, body in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for h, first, count in spans(body or "", least_sentences, least_words):
                    place = (doc is None, () if doc is None else (doc,), text_hash, first)
                    was = seen.get(h)
                    if was == place:
                        continue
                    later = was is not None and was < place
                    if not later:
                        if len(seen) >= MEMORY:
                            seen.clear()
                        seen[h] = place
                    rows.append((doc, text_hash, h, first, count, later))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc", "text_hash", "span", "first", "count", "later"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc"), F.xxhash64(F.col(text).cast("string")).alias("text_hash"), F.col(text).cast("string").alias("body"))
    found = materialise(rows.mapInArrow(run, f"doc {kind}, text_hash long, span long, first int, count int, later boolean"), "spans")
    place = Window.partitionBy("span").orderBy(F.col("doc").asc_nulls_last(), "text_hash", "first")
    rest = found.where("not later").withColumn("nth", F.rank().over(place)).where("nth > 1").select("doc", "text_hash", "first", "count")
    covered = found.where("later").select("doc", "text_hash", "first", "count").unionByName(rest)
    return covered.groupBy(F.col("doc").alias(key), "text_hash").agg(F.sort_array(F.collect_set(F.struct("first", "count"))).alias("covered"))


def remove_repeats(docs: DataFrame, least_sentences: int = 2, least_words: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, n_sentences, n_removed, removed_chars) for every row, repeated sentences taken out.

    A span is a run of at least ``least_sentences`` consecutive sentences and ``least_words`` words. Every
    sentence that any non-first repeated span covers is removed, the rest of the text stays as it was. A passage that
    begins or ends within a sentence keeps that sentence, which is as a whole no repeat.
    Null text stays null with counts 0, empty text has no sentences; rows that repeat key and
    text are the same document and are cleaned alike; an empty table gives an empty result; other
    columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    spanned = repeated_spans(docs, least_sentences, least_words, key, text).withColumnsRenamed({key: "_doc", "text_hash": "_hash"})
    rows = docs.select(F.col(key).alias("doc"), F.col(text).cast("string").alias("body"))
    both = rows.join(spanned, F.col("doc").eqNullSafe(F.col("_doc")) & (F.xxhash64("body") == F.col("_hash")), "left").select("doc", "body", "covered.first", "covered.count")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body, first, count in zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True):
                if body is None:
                    out.append((None, 0, 0, 0))
                    continue
                units = sentences(body)
                gone = {i for f, c in zip(first or (), count or (), strict=True) for i in range(f, f + c)}
                kept = "".join(u for i, u in enumerate(units) if i not in gone) if gone else body
                out.append((kept, len(units), len(gone), len(body) - len(kept)))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.string()), *[pa.array(c, pa.int64()) for c in cols[1:]]], ["key", "text", "n_sentences", "n_removed", "removed_chars"])

    kind = docs.schema[key].dataType.simpleString()
    return both.mapInArrow(clean, f"key {kind}, text string, n_sentences long, n_removed long, removed_chars long").withColumnRenamed("key", key)
