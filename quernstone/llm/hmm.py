"""A hidden Markov language model: Baum-Welch over all partitions, exact likelihood by scaled forward recursion."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, materialise
from .langid import fold

STATES = 6
ROUNDS = 4
#: Words with an observation class of their own, and classes that the other words share by checksum.
OWN_CLASSES = 4096
SHARED_CLASSES = 1024
CLASSES = OWN_CLASSES + SHARED_CLASSES
#: Words whose counts go to every worker at most; all rarer ones are joined.
LEXICON = 200_000
#: Training takes texts of up to so many tokens together and longer ones together, so many tokens at once.
LONG = 1024
TOKENS = 1_000_000
#: Tokens of which a task holds the vectors at once; a longer stretch of steps keeps those at its cuts and makes the others again.
STRETCH = 1_500_000
#: Distinct words that a task counts before it passes them on.
MEMORY = 300_000
#: Expected counts are summed as multiples of 1/QUANTUM, so that sums don't depend on their order.
QUANTUM = 1 << 20
#: The end of a text, a token that is no word.
END = b"\n"
SEED = 11


def text_tokens(text: bytes | None) -> list[bytes]:
    return [*(text or b"").lower().split(), END]


def count_tokens(docs: DataFrame, text: str) -> DataFrame:
    """(word, n) over all tokens of ``docs``, added up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for body in batch.column(0).cast(pa.binary()).to_pylist():
                counts.update(text_tokens(body))
            if len(counts) > MEMORY:
                yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"])
                counts.clear()
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    parts = docs.select(F.col(text).cast("string")).mapInArrow(run, "word binary, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


class Lexicon:
    """The commonest words with their counts, and the classes' totals."""

    def __init__(self, words: list[bytes], counts: np.ndarray, tokens: int, distinct: int, totals: np.ndarray, kinds: np.ndarray):
        self.at = {w: i for i, w in enumerate(words)}
        self.tokens, self.distinct = tokens, distinct
        self.class_tokens = totals + 0.1 * (kinds + 1)
        self.log_base = np.log10((counts + 0.1) / (tokens + 0.1 * (distinct + 1))) if len(words) else np.zeros(0)
        self.classes = np.array([i if i < OWN_CLASSES else OWN_CLASSES + zlib.crc32(w) % SHARED_CLASSES for i, w in enumerate(words)], np.int64)
        self.log_share = np.zeros(len(words))
        shared = np.arange(len(words)) >= OWN_CLASSES
        self.log_share[shared] = np.log10((counts[shared] + 0.1) / self.class_tokens[self.classes[shared] - OWN_CLASSES])
        own = np.zeros(OWN_CLASSES)
        own[: min(OWN_CLASSES, len(words))] = counts[:OWN_CLASSES]
        weight = np.concatenate([own, totals]) + 0.1
        self.marginal = weight / weight.sum()


def make_lexicon(counts: DataFrame) -> Lexicon:
    """Collects the words above a count at which at most LEXICON remain, found from a histogram of rounded counts."""
    tokens, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    scale = F.pow(F.lit(10.0), F.greatest(F.floor(F.log10(F.col("n").cast("double"))) - 2, F.lit(0)))
    histogram = counts.groupBy((F.floor(F.col("n") / scale) * scale).cast("long").alias("least")).count().collect()
    left, least = LEXICON, 1 << 62
    for row in sorted(histogram, reverse=True):
        left -= row["count"]
        if left < 0:
            break
        least = row["least"]
    common = sorted(((-r["n"], bytes(r["word"])) for r in counts.where(F.col("n") >= least).toLocalIterator()))
    words, numbers = [w for _, w in common], np.array([-n for n, _ in common], np.int64)
    totals, kinds = np.zeros(SHARED_CLASSES, np.int64), np.zeros(SHARED_CLASSES, np.int64)
    for c, n, k in counts.groupBy((F.crc32("word") % SHARED_CLASSES).alias("c")).agg(F.sum("n"), F.count("*")).collect():
        totals[c], kinds[c] = n, k
    for w, n in zip(words[:OWN_CLASSES], numbers, strict=False):
        totals[zlib.crc32(w) % SHARED_CLASSES] -= n
        kinds[zlib.crc32(w) % SHARED_CLASSES] -= 1
    return Lexicon(words, numbers, int(tokens or 0), int(distinct or 0), totals, kinds)


def encode(docs: DataFrame, lexicon: Lexicon, key: str, text: str, folds: int) -> DataFrame:
    """A row a document: its tokens' classes, the known part of its sums, and its words outside the lexicon."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, row = shared.value, TaskContext.get().partitionId() << 33
        for batch in batches:
            out = []
            for body in batch.column(2).cast(pa.binary()).to_pylist():
                tokens = text_tokens(body)
                at = np.fromiter(map(lex.at.get, tokens, repeat(-1)), np.int64, len(tokens))
                known = at[at >= 0]
                classes = np.empty(len(tokens), "<u2")
                classes[at >= 0] = lex.classes[known]
                missing = np.flatnonzero(at < 0)
                rare: Counter[bytes] = Counter()
                for i in missing.tolist():
                    classes[i] = OWN_CLASSES + zlib.crc32(tokens[i]) % SHARED_CLASSES
                    rare[tokens[i]] += 1
                out.append((row, len(tokens), len(known), float(lex.log_base[known].sum()), float(lex.log_share[known].sum()), classes.tobytes(), [{"word": w, "n": n} for w, n in rare.items()]))
                row += 1
            cols = list(zip(*out, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names)

    names = ["key", "held_out", "row", "n_tokens", "known", "base", "share", "classes", "rare"]
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key), (fold(F.col(key)) % folds == 0).alias("held_out"), F.col(text).cast("string"))
    return rows.mapInArrow(run, f"key {kind}, held_out boolean, row long, n_tokens long, known long, base double, share double, classes binary, rare array<struct<word: binary, n: long>>")


class Model:
    """Start, transition and emission probabilities, and the states' occupancy."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray, occupied: np.ndarray):
        self.start, self.move, self.emit, self.occupied = start, move, emit, occupied

    @classmethod
    def first(cls, marginal: np.ndarray, states: int) -> Model:
        emit = marginal[:, None] * np.exp(np.random.default_rng(SEED).normal(0, 1, (len(marginal), states)))
        even = np.full(states, 1 / states)
        return cls(even, np.eye(states) * 0.9 + 0.1 / states, emit / emit.sum(0), even)


def expected_counts(model: Model, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch: expected starts, moves and emissions over whole texts, all texts a step at a time.

    Texts lie longest first, so step t's rows are those of the texts of more than t tokens, and rows of all
    steps follow each other without a gap. Steps are cut into stretches of at most STRETCH rows: a forward pass
    keeps the vectors at the cuts, the backward pass makes those of a stretch again, so the longest text doesn't decide
    what a task holds.
    """
    states = len(model.start)
    texts = sorted((t for t in texts if len(t)), key=lambda t: -len(t))
    starts, moves, emits = np.zeros(states), np.zeros((states, states)), np.zeros((CLASSES, states))
    if not texts:
        return starts, moves, emits
    lengths = np.array([len(t) for t in texts])
    live = len(texts) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), "right")
    begin = np.concatenate([[0], np.cumsum(live)])
    seen = np.empty(begin[-1], np.uint16)
    for i, t in enumerate(texts):
        seen[begin[: len(t)] + i] = t
    cuts = [0]
    while cuts[-1] < lengths[0]:
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(begin, begin[cuts[-1]] + STRETCH, "right")) - 1))

    def sweep(first: int, last: int, now: np.ndarray | None) -> tuple[np.ndarray, ...]:
        """A stretch's emissions, scaled forward vectors and scales, and its last step's vectors."""
        emit = model.emit[seen[begin[first] : begin[last]]]
        forward, scale = np.empty_like(emit), np.empty(len(emit))
        for t in range(first, last):
            here = slice(begin[t] - begin[first], begin[t + 1] - begin[first])
            now = (now[: live[t]] @ model.move if t else model.start) * emit[here]
            scale[here] = total = now.sum(1)
            now = now / total[:, None]
            forward[here] = now
        return emit, forward, scale, now

    entries: list[np.ndarray | None] = [None]
    for first, last in zip(cuts[:-2], cuts[1:-1], strict=True):
        entries.append(sweep(first, last, entries[-1])[-1])
    onward = np.ascontiguousarray(model.move.T)
    beyond = None  # what the step behind the stretch passes back
    for first, last, entry in zip(cuts[-2::-1], cuts[:0:-1], entries[::-1], strict=True):
        emit, forward, scale, _ = sweep(first, last, entry)
        back, later, rows = np.ones_like(emit), emit / scale[:, None], begin[first : last + 1] - begin[first]
        if beyond is not None:
            back[rows[-2] : rows[-2] + len(beyond)] = beyond @ onward
        for t in range(last - first - 2, -1, -1):
            after = slice(rows[t + 1], rows[t + 2])
            later[after] *= back[after]
            back[rows[t] : rows[t] + live[first + t + 1]] = later[after] @ onward
        before = np.arange(rows[1], rows[-1]) - np.repeat(live[first : last - 1], live[first + 1 : last])  # the row of the same text a step earlier
        moves += forward[before].T @ later[rows[1] :]
        if first:
            beyond = later[: rows[1]] * back[: rows[1]]
            moves += entry[: rows[1]].T @ beyond
        both = forward * back
        both /= both.sum(1)[:, None]
        for k in range(states):
            emits[:, k] += np.bincount(seen[begin[first] : begin[last]], both[:, k], CLASSES)
        if not first:
            starts += both[: live[0]].sum(0)
    return starts, moves * model.move, emits


def baum_welch(coded: DataFrame, marginal: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Trains on every row's classes, whole texts. Each task sends its sums of expected counts; their number depends on the model alone."""
    spark, model = coded.sparkSession, Model.first(marginal, states)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros(states + states * states + CLASSES * states)
            waiting: tuple[list[np.ndarray], ...] = ([], [])
            tokens = [0, 0]

            def flush(kind: int) -> None:
                total[:] += np.concatenate([p.ravel() for p in expected_counts(shared.value, waiting[kind])])
                waiting[kind].clear()
                tokens[kind] = 0

            for batch in batches:
                for classes in batch.column(0).to_pylist():
                    text = np.frombuffer(classes, "<u2")
                    kind = int(len(text) > LONG)
                    waiting[kind].append(text)
                    tokens[kind] += len(text)
                    if tokens[kind] >= TOKENS:
                        flush(kind)
            flush(0)
            flush(1)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.rint(total[at] * QUANTUM).astype(np.int64))], ["at", "n"])

        sums = np.zeros(states + states * states + CLASSES * states)
        for at, n in coded.select("classes").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n")).collect():
            sums[at] = n / QUANTUM
        shared.unpersist()
        starts, moves, emits = sums[:states] + 1, sums[states : states + states**2].reshape(states, states) + 1, sums[states + states**2 :].reshape(CLASSES, states)
        emits = emits + 100 * marginal[:, None]
        occupied = emits.sum(0)
        model = Model(starts / starts.sum(), moves / moves.sum(1)[:, None], emits / occupied, occupied / occupied.sum())
    return model


def log_likelihoods(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Each text's exact log10 probability of its classes, by the scaled forward recursion, all texts a step at a time."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    lengths = np.array([len(texts[i]) for i in order])
    flat = np.concatenate([texts[i] for i in order]).astype(np.int64)
    begin = np.cumsum(lengths) - lengths
    logs = np.zeros(len(texts))
    now = model.start * model.emit[flat[begin]]
    m = len(texts)
    for t in range(lengths[0]):
        while lengths[m - 1] <= t:
            m -= 1
        if t:
            now = (now[:m] @ model.move) * model.emit[flat[begin[:m] + t]]
        total = now.sum(1)
        logs[:m] += np.log10(total)
        now /= total[:, None]
    out = np.empty(len(texts))
    out[order] = logs
    return out


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 10, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Learns from the rows whose key's checksum mod ``folds`` isn't 0. A token is observed as its class: the
    OWN_CLASSES commonest words and the end have their own, other words share one by checksum, within
    which a word has its smoothed share of the class's training tokens (an unseen one that of one more
    word). The score is the exact log10 probability of the text: the forward recursion over its
    classes times its words' shares, proper over all words. Counts cover every training token; the rare
    words that the lexicon leaves out are looked up by a join. Null and empty texts are just the end;
    a null key counts as the empty text for its fold; repeated rows each keep theirs; an empty table gives
    an empty result; other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    train = docs.where(fold(F.col(key)) % folds != 0)
    counts = materialise(count_tokens(train, text), "token-counts")
    lexicon = make_lexicon(counts)
    coded = materialise(encode(docs, lexicon, key, text, folds), "coded")
    model = baum_welch(coded.where("not held_out"), lexicon.marginal, states, rounds)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [np.frombuffer(c, "<u2") for c in batch.column(6).to_pylist()]
            logs = log_likelihoods(shared.value, texts) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(np.array(batch.column(7)) + logs)], [*names, "chain"])

    names = ["key", "held_out", "row", "n_tokens", "known", "base"]
    kind = docs.schema[key].dataType.simpleString()
    chained = coded.select(*names, "classes", "share").mapInArrow(run, f"key {kind}, held_out boolean, row long, n_tokens long, known long, base double, chain double")
    rare = coded.select("row", F.explode("rare").alias("r")).select("row", "r.word", F.col("r.n").alias("times"))
    totals = spark.createDataFrame([(i, float(t)) for i, t in enumerate(lexicon.class_tokens)], "c int, class_tokens double")
    looked = rare.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("c", (F.crc32("word") % SHARED_CLASSES).cast("int")).join(F.broadcast(totals), "c")
    space = lexicon.tokens + 0.1 * (lexicon.distinct + 1)
    sums = looked.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("times") * F.log10((F.col("n") + 0.1) / space)).alias("rare_base"),
        F.sum(F.col("times") * F.log10((F.col("n") + 0.1) / F.col("class_tokens"))).alias("rare_share"),
    )
    out = chained.join(sums, "row", "left").na.fill(0, ["rare_known", "rare_base", "rare_share"])
    return out.select(
        F.col("key").alias(key), "held_out", "n_tokens", (F.col("known") + F.col("rare_known")).cast("long").alias("n_known"), F.lit(lexicon.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("rare_base")).alias("base_score"), (F.col("chain") + F.col("rare_share")).alias("score"),
    )
