"""Toxicity of texts: subword-bag embeddings, averaged over passages, under a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .langid import fold

#: Letters of a subword, rows and columns of the embedding, words of a passage.
LEAST_GRAM, MOST_GRAM = 3, 5
BUCKETS = 1 << 17
DIMENSIONS = 8
PASSAGE = 2
#: Training takes at most so many labelled rows of each class, those whose ids hash lowest, and so many signs of text in all.
EXAMPLES = 1_500
EXAMPLE_CHARS = 12_000_000
EPOCHS = 60
RATE = 0.1
#: Share of the loss that toxic examples make up, and the pull of embeddings towards zero.
TOXIC_WEIGHT = 0.3
DECAY = 1e-5
#: How sharply a document's passages are pooled in training: from nearly their mean to nearly their maximum.
SHARPNESS = (0.5, 8.0)
SEED = 12

#: Signs of a text worked on at a time.
CHUNK = 1 << 20
_TABLE_SIZE = 0x3000
_MULTIPLIERS = (np.random.default_rng(SEED).integers(0, 2**63, MOST_GRAM + 1, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def _signs() -> np.ndarray:
    return np.array([c if chr(c).isalnum() else 0 for c in range(_TABLE_SIZE)], np.uint32)


_KEPT = _signs()


def subwords(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of a text, and the index of each one's word, in order of words.

    Words are runs of letters and digits, in lower case. A word's subwords are its runs of LEAST_GRAM to MOST_GRAM
    signs, a mark before the first and behind the last one counting as signs; so even a lone letter has one.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    kept = _KEPT[np.minimum(codes, _TABLE_SIZE - 1)]
    far = codes >= _TABLE_SIZE
    if far.any():
        kept[far] = [c if chr(c).isalnum() else 0 for c in codes[far].tolist()]
    at = np.flatnonzero(kept)
    word_of = np.cumsum(np.diff(at, prepend=-2) > 1) - 1
    sizes = np.bincount(word_of) + 2 if len(at) else np.zeros(0, np.int64)
    word = np.repeat(np.arange(len(sizes)), sizes)
    signs = np.full(len(word), 2, np.uint64)
    signs[np.cumsum(sizes) - sizes] = 1
    signs[np.arange(len(at)) + 2 * word_of + 1] = kept[at]
    found, of = [], []
    for size in range(LEAST_GRAM, MOST_GRAM + 1):
        count = len(signs) - size + 1
        if count <= 0:
            break
        hashed = np.zeros(count, np.uint64)
        for k in range(size):
            hashed += signs[k : k + count] * _MULTIPLIERS[k]
        hashed = (hashed ^ (hashed >> np.uint64(29))) * _MULTIPLIERS[MOST_GRAM]
        at = np.flatnonzero(word[:count] == word[size - 1 :])
        found.append((hashed[at] >> np.uint64(40)).astype(np.int64) % BUCKETS)
        of.append(word[at])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams, words = np.concatenate(found), np.concatenate(of)
    order = np.argsort(words, kind="stable")
    return grams[order], words[order]


def chunks(text: str) -> Iterator[str]:
    """A text in pieces of about CHUNK signs, cut at white space where there is any within as many more."""
    at = 0
    while at < len(text):
        end = at + CHUNK
        while end < len(text) and end < at + 2 * CHUNK and not text[end].isspace():
            end += 1
        yield text[at:end]
        at = end


@dataclass
class Model:
    """Embeddings of subword buckets, and the softmax over classes 0 and 1 above their mean."""

    embedding: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def scores(self) -> np.ndarray:
        """What a subword adds to the difference of the two classes' logits, were it alone: all that two classes need of the embedding."""
        return self.embedding @ (self.weights[:, 1] - self.weights[:, 0])

    def offset(self) -> float:
        return float(self.bias[1] - self.bias[0])


def passage_means(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Means over each PASSAGE consecutive words; over all words where there are fewer."""
    if len(sums) <= PASSAGE:
        return np.array([sums.sum() / counts.sum()]) if len(sums) else np.zeros(0)
    s, c = np.cumsum(np.append(0.0, sums)), np.cumsum(np.append(0, counts))
    return (s[PASSAGE:] - s[:-PASSAGE]) / (c[PASSAGE:] - c[:-PASSAGE])


def document_score(text: str, scores: np.ndarray, offset: float) -> float:
    """The softmax's probability of class 1 for a text's most toxic passage; a text without a word is an empty bag, whose mean is 0."""
    best, sums, counts = None, np.zeros(0), np.zeros(0, np.int64)
    for piece in chunks(text):
        grams, words = subwords(piece)
        if not len(grams):
            continue
        n = int(words[-1]) + 1
        sums = np.concatenate([sums, np.bincount(words, scores[grams], n)])
        counts = np.concatenate([counts, np.bincount(words, minlength=n)])
        if len(sums) > PASSAGE:
            top = float(passage_means(sums, counts).max())
            best = top if best is None else max(best, top)
            sums, counts = sums[1 - PASSAGE :], counts[1 - PASSAGE :]
    if best is None:
        best = float(passage_means(sums, counts)[0]) if len(sums) else 0.0
    return float(1 / (1 + np.exp(-np.clip(best + offset, -500, 500))))


class Bags:
    """Training texts as passages of words, and words as bags of subwords: words that repeat are kept once."""

    def __init__(self, texts: list[str]):
        grams, sizes, words, ends = [], [], [], []
        known: dict[int, int] = {}
        for text in texts:
            g, w = subwords(text)
            starts = np.flatnonzero(np.diff(w, prepend=-1))
            # the same bag has the same sum of its subwords' scrambled numbers
            mixed = (g.astype(np.uint64) + np.uint64(1)) * _MULTIPLIERS[0]
            mixed = (mixed ^ (mixed >> np.uint64(31))) * _MULTIPLIERS[1]
            names = np.add.reduceat(mixed ^ (mixed >> np.uint64(29)), starts) if len(g) else np.zeros(0, np.uint64)
            stops = np.append(starts[1:], len(g))
            distinct, first, back = np.unique(names, return_index=True, return_inverse=True)
            ids = []
            for name, k in zip(distinct.tolist(), first.tolist(), strict=True):
                if name not in known:
                    known[name] = len(known)
                    grams.append(g[starts[k] : stops[k]].astype(np.int32))
                    sizes.append(len(grams[-1]))
                ids.append(known[name])
            words.append(np.array(ids, np.int32)[back])
            ends.append(len(back))
        self.sizes = np.array(sizes, np.int64)
        self.grams = np.concatenate(grams) if grams else np.zeros(0, np.int32)
        self.of = np.repeat(np.arange(len(sizes)), self.sizes)
        # passages: start and end within the run of all words, and their document
        lengths = np.array(ends, np.int64)
        n = np.where(lengths > PASSAGE, lengths - PASSAGE + 1, np.minimum(lengths, 1))
        self.document = np.repeat(np.arange(len(texts)), n)
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        self.start = np.repeat(np.cumsum(lengths) - lengths, n) + inside
        self.end = self.start + np.repeat(np.minimum(lengths, PASSAGE), n)
        self.run = np.concatenate(words) if words else np.zeros(0, np.int32)
        held = np.append(0, np.cumsum(self.sizes[self.run]))
        self.total = held[self.end] - held[self.start]
        self.first = np.cumsum(n) - n
        self.full = n > 0


def fit(texts: list[str], labels: list[int], seed: int = SEED) -> Model:
    """Embedding and softmax trained together by Adam on the log loss.

    A document's logit pools its passages' logits by a soft maximum that sharpens from epoch to epoch, so that at first all passages
    of a toxic document learn, in the end the one that made it so. Both classes weigh the same. Without examples of
    both classes nothing can be told apart, and the model's score is the share of class 1 for every text (a half without any example).
    """
    rng = np.random.default_rng(seed)
    model = Model((rng.standard_normal((BUCKETS, DIMENSIONS)) * 0.1).astype(np.float64), np.zeros((DIMENSIONS, 2)), np.zeros(2))
    y = np.array(labels, np.float64)
    if len(set(labels)) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros((BUCKETS, 1)), np.zeros((1, 2)), np.array([0.0, np.log(share / (1 - share))]))
    model.weights[:, 1] = rng.standard_normal(DIMENSIONS) * 0.1
    bags = Bags(texts)
    weight = np.where(y == 1, TOXIC_WEIGHT / y.sum(), (1 - TOXIC_WEIGHT) / (len(y) - y.sum()))
    used, slot = np.unique(bags.grams, return_inverse=True)
    table = model.embedding[used]
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in (("table", table), ("weights", model.weights), ("bias", model.bias))}

    def step(name: str, value: np.ndarray, gradient: np.ndarray, epoch: int) -> None:
        mean, square = state[name]
        mean += 0.1 * (gradient - mean)
        square += 0.01 * (gradient**2 - square)
        value -= RATE * (mean / (1 - 0.9**epoch)) / (np.sqrt(square / (1 - 0.99**epoch)) + 1e-9)

    for epoch in range(1, EPOCHS + 1):
        sharp = SHARPNESS[0] + (SHARPNESS[1] - SHARPNESS[0]) * min(1.0, 1.5 * (epoch - 1) / (EPOCHS - 1))
        direction = model.weights[:, 1] - model.weights[:, 0]
        by_word = np.bincount(bags.of, (table @ direction)[slot], len(bags.sizes))
        held = np.append(0.0, np.cumsum(by_word[bags.run]))
        means = (held[bags.end] - held[bags.start]) / bags.total
        top = np.full(len(y), 0.0)
        top[bags.full] = np.maximum.reduceat(means, bags.first[bags.full]) if len(means) else 0.0
        share = np.exp(sharp * (means - top[bags.document]))
        norm = np.bincount(bags.document, share, len(y))
        share /= norm[bags.document]
        pooled = np.bincount(bags.document, share * means, len(y))
        p = 1 / (1 + np.exp(-(pooled + model.bias[1] - model.bias[0])))
        error = weight * (p - y)
        # d pooled / d mean, then down to words and subwords: sums over passages by differences
        down = error[bags.document] * share * (1 + sharp * (means - pooled[bags.document])) / bags.total
        ends = np.bincount(bags.start, down, len(bags.run) + 1) - np.bincount(bags.end, down, len(bags.run) + 1)
        by_word = np.bincount(bags.run, np.cumsum(ends)[:-1], len(bags.sizes))
        by_gram = np.bincount(slot, by_word[bags.of], len(used))
        turn = table.T @ by_gram
        step("table", table, by_gram[:, None] * direction + DECAY * table, epoch)
        step("weights", model.weights, np.stack([-turn, turn], axis=1), epoch)
        step("bias", model.bias, np.array([-error.sum(), error.sum()]), epoch)
    model.embedding[:] = 0
    model.embedding[used] = table
    return model


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", examples: int = EXAMPLES) -> Model:
    """A model from labelled documents: at most ``examples`` of each class and EXAMPLE_CHARS signs, in order of a hash of their ids.

    Labels other than 0 and 1 teach nothing, nor do null texts, or labels of documents that aren't there; a document with two labels is two examples.
    """
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("id"), F.col(label).cast("int").alias("y"))
    of_class = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(examples) for y in (0, 1)]
    known = of_class[0].unionByName(of_class[1])
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("body")).where("body is not null").join(F.broadcast(known), "id")
    rows = rows.orderBy(F.xxhash64("id"), "y", "body")
    texts, ys, total = [], [], 0
    for row in rows.toLocalIterator():
        if total + len(row.body) <= EXAMPLE_CHARS:
            texts.append(row.body)
            ys.append(row.y)
            total += len(row.body)
    return fit(texts, ys)


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row: only the text decides. Null texts are empty ones."""
    bounded_batches(docs.sparkSession)
    scores, offset = model.scores(), model.offset()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [document_score(t or "", scores, offset) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(key, held_out, score, predicted) of every row, learned from labels outside the held-out fold.

    Null and empty texts score as an empty bag. Empty tables give an empty result; labels may be empty too, then every score is a half;
    repeated rows and null ids each keep theirs; other columns are ignored. Texts of any length are whole, in pieces.
    """
    out = fold(F.col(key)) % folds == held
    model = train(docs, labels.where(~out), key, text, label)
    found = predict(docs, model, key, text)
    return found.select(key, out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
