"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Components of a hypervector, and symbols of the folded alphabet (0: anything but a letter).
DIMENSIONS = 512
SYMBOLS = 64
SEED = 7

_TABLE_SIZE = 0x3000


def _symbol(code: int) -> int:
    """A letter's symbol: a-z have their own, other letters share 27 to 63."""
    if 97 <= code <= 122:
        return code - 96
    return 27 + code % 37 if chr(code).isalpha() else 0


class Space:
    """The random letter vectors, and every letter trigram's bound vector, made when first needed."""

    def __init__(self, dimensions: int = DIMENSIONS):
        letters = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SYMBOLS, dimensions))
        self.first, self.second, self.third = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1), letters
        self.bound = np.zeros((1024, dimensions), np.int8)
        self.made = 0
        self.slot = np.full(SYMBOLS**3, -1, np.int32)
        self.symbols = np.array([_symbol(c) for c in range(_TABLE_SIZE)], np.int64)

    def vectors(self, trigrams: np.ndarray) -> np.ndarray:
        new = np.unique(trigrams[self.slot[trigrams] < 0])
        if len(new):
            while self.made + len(new) > len(self.bound):
                self.bound = np.concatenate([self.bound, np.zeros_like(self.bound)])
            self.slot[new] = np.arange(self.made, self.made + len(new))
            self.bound[self.made : self.made + len(new)] = self.first[new >> 12] * self.second[new >> 6 & 63] * self.third[new & 63]
            self.made += len(new)
        return self.bound[self.slot[trigrams]]

    def trigrams(self, text: str) -> np.ndarray:
        """Ids of the letter trigrams of a text, a run of other characters counting as one blank."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        symbols = self.symbols[np.minimum(codes, _TABLE_SIZE - 1)]
        far = codes >= _TABLE_SIZE
        if far.any():
            symbols[far] = [_symbol(int(c)) for c in codes[far]]
        symbols = np.concatenate([[0], symbols, [0]])
        symbols = symbols[np.concatenate([[True], (symbols[1:] != 0) | (symbols[:-1] != 0)])]
        if len(symbols) < 3:
            return np.empty(0, np.int64)
        return symbols[:-2] << 12 | symbols[1:-1] << 6 | symbols[2:]

    def bundle(self, text: str) -> np.ndarray | None:
        """The sum of a text's trigram vectors; None if it has no letter."""
        ids, counts = np.unique(self.trigrams(text), return_counts=True)
        if not len(ids):
            return None
        out = np.zeros(self.bound.shape[1], np.float32)
        for at in range(0, len(ids), 1024):  # bounds what a long text takes
            out += counts[at : at + 1024].astype(np.float32) @ self.vectors(ids[at : at + 1024]).astype(np.float32)
        return out


_spaces: dict[int, Space] = {}


def space(dimensions: int) -> Space:
    """This worker's vectors."""
    if dimensions not in _spaces:
        _spaces[dimensions] = Space(dimensions)
    return _spaces[dimensions]


def train(docs: DataFrame, dimensions: int = DIMENSIONS, lang: str = "lang", text: str = "text") -> dict[str, np.ndarray]:
    """A language's prototype: the normalised bundle of all its documents' bundles.

    By linearity each task counts trigrams by language and bundles once; sums over tasks are exact
    integers. Reaches the driver: one vector a language. Rows with a null language or text are no examples.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, counts = space(dimensions), {}
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = at.trigrams(body)
                if len(ids):
                    counts.setdefault(name, np.zeros(SYMBOLS**3, np.int64))
                    found, n = np.unique(ids, return_counts=True)
                    counts[name][found] += n
        for name, n in counts.items():
            ids = np.flatnonzero(n)
            total = np.zeros(dimensions, np.int64)
            for k in range(0, len(ids), 1024):
                total += n[ids[k : k + 1024]] @ at.vectors(ids[k : k + 1024]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([name] * dimensions, pa.string()), pa.array(np.arange(dimensions), pa.int64()), pa.array(total)], ["lang", "at", "total"])

    rows = docs.select(F.col(lang).cast("string"), F.col(text).cast("string")).where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    parts = rows.mapInArrow(run, "lang string, at long, total long")
    out: dict[str, np.ndarray] = {}
    for name, at, total in parts.groupBy("lang", "at").agg(F.sum("total").alias("total")).toLocalIterator():
        out.setdefault(name, np.zeros(dimensions))[at] = total
    return {name: v / max(np.linalg.norm(v), 1e-12) for name, v in sorted(out.items())}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], dimensions: int = DIMENSIONS, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, lang_pred, score) for every row: the nearest prototype by cosine, and that cosine (0 if negative).

    ``und`` with score 0 for null texts, texts without a letter, and where nothing was learned. Ties go
    to the first language by name. Only the text decides.
    """
    bounded_batches(docs.sparkSession)
    names = list(prototypes)
    matrix = np.array([prototypes[n] for n in names], np.float32).reshape(len(names), dimensions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = space(dimensions)
        for batch in batches:
            langs, scores = [], []
            for body in batch.column(0).to_pylist():
                v = at.bundle(body) if body and names else None
                if v is None:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                cosines = matrix @ v / max(float(np.linalg.norm(v)), 1e-12)
                best = int(cosines.argmax())
                langs.append(names[best])
                scores.append(min(1.0, max(0.0, float(cosines[best]))))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*kept, "lang_pred", "score"])

    kept = [f"c{i}" for i in range(len(keep) + 1)]
    rows = docs.select(F.col(text).cast("string").alias("body"), *[F.col(c).alias(n) for c, n in zip((key, *keep), kept, strict=True)])
    kinds = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip((key, *keep), kept, strict=True))
    out = rows.mapInArrow(run, f"{kinds}, lang_pred string, score double")
    return out.withColumnsRenamed(dict(zip(kept, (key, *keep), strict=True)))


def fold(key: Column) -> Column:
    """crc32 of a key as text; null counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))


def identify(docs: DataFrame, folds: int = 4, held: int = 2, key: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """(key, held_out, lang_pred, score) for every row, learned from the rows outside the held-out fold.

    Empty tables give an empty result; repeated rows each keep theirs; other columns are ignored.
    """
    out = fold(F.col(key)) % folds == held
    prototypes = train(docs.where(~out), lang=lang, text=text)
    found = predict(docs, prototypes, key=key, text=text)
    return found.select(key, out.alias("held_out"), "lang_pred", "score")
