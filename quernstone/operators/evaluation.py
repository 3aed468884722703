"""Scores of answers, retrieval, classification and benchmark responses, as aggregations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def bag_scores(rows: DataFrame, keys: list[str], predicted: Column, gold: Column) -> DataFrame:
    """(keys, em, f1) of normalised answers: token multisets meet by their smaller counts.

    Tokens are counted a row and side first; no pair of tokens is ever formed.
    """
    both = rows.select(*keys, predicted.alias("_p"), gold.alias("_g"))
    sides = [both.select(*keys, F.explode(T.tokens(F.col(c))).alias("_t"), F.lit(int(c == "_p")).alias("_a"), F.lit(int(c == "_g")).alias("_b")) for c in ("_p", "_g")]
    counts = sides[0].unionByName(sides[1]).groupBy(*keys, "_t").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    sums = counts.groupBy(*keys).agg(F.sum(F.least("_a", "_b")).alias("_m"), F.sum("_a").alias("_na"), F.sum("_b").alias("_nb"))
    scored = both.join(sums, keys, "left")
    f1 = F.when(F.coalesce("_m", F.lit(0)) == 0, F.lit(0.0)).otherwise(2.0 * F.col("_m") / (F.col("_na") + F.col("_nb")))
    return scored.select(*keys, (F.col("_p") == F.col("_g")).cast("int").alias("em"), f1.alias("f1"))


def yes_no_scores(rows: DataFrame, keys: list[str], predicted: Column, gold: Column) -> DataFrame:
    """As ``bag_scores``, but an answer of yes, no or noanswer on either side earns no partial credit."""
    flat = rows.withColumns({"_np": predicted, "_ng": gold})
    closed = F.col("_np").isin("yes", "no", "noanswer") | F.col("_ng").isin("yes", "no", "noanswer")
    marks = flat.select(*keys, (closed & (F.col("_np") != F.col("_ng"))).alias("_closed"))
    return bag_scores(flat, keys, F.col("_np"), F.col("_ng")).join(marks, keys).select(*keys, "em", F.when(F.col("_closed"), 0.0).otherwise(F.col("f1")).alias("f1"))


def recall_at(retrieved: DataFrame, references: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """(qid, recall_at_k...): the share of a question's references that contain a text among its first k.

    ``retrieved`` (qid, rank from 1, text), ``references`` (qid, ref). The containment runs within a question.
    """
    both = references.join(retrieved, "qid", "left")
    inside = F.contains(T.normalise_for_retrieval(F.col("ref")), T.normalise_for_retrieval(F.col("text")))
    best = both.groupBy("qid", "ref").agg(F.min(F.when(inside, F.col("rank"))).alias("best"))
    return best.groupBy("qid").agg(*[F.avg((F.coalesce("best", F.lit(1 << 30)) <= k).cast("int")).alias(f"recall_at_{k}") for k in ks])


def support_scores(retrieved: DataFrame, gold: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """(qid, support_recall_k, all_support_k): over distinct gold titles, of the titles in first-seen order."""
    first = retrieved.groupBy("qid", "title").agg(F.min("rank").alias("rank"))
    want = gold.select("qid", "title").distinct().join(first, ["qid", "title"], "left")
    aggs = []
    for k in ks:
        hit = F.coalesce(F.col("rank") <= k, F.lit(False))
        aggs += [F.avg(hit.cast("int")).alias(f"support_recall_{k}"), F.bool_and(hit).cast("int").alias(f"all_support_{k}")]
    return want.groupBy("qid").agg(*aggs)


def confusion(rows: DataFrame, by: str, predicted: str, gold: str) -> DataFrame:
    """Counts, class recalls, balanced accuracy and the negative class's P, R, F1 by group and, as ``ALL``, over all.

    One pass with a rollup; a zero denominator gives null.
    """
    hit = lambda p, g: F.count_if((F.col(predicted) == p) & (F.col(gold) == g))
    counts = rows.rollup(by).agg(hit(1, 1).alias("tp"), hit(0, 0).alias("tn"), hit(1, 0).alias("fp"), hit(0, 1).alias("fn"))
    ratio = lambda a, b: F.try_divide(F.col(a), F.col(a) + F.col(b))
    out = counts.withColumns({"recall_1": ratio("tp", "fn"), "recall_0": ratio("tn", "fp"), "precision_0": ratio("tn", "fn")})
    f1 = F.try_divide(2 * F.col("precision_0") * F.col("recall_0"), F.col("precision_0") + F.col("recall_0"))
    return out.withColumns({by: F.coalesce(by, F.lit("ALL")), "balanced": (F.col("recall_1") + F.col("recall_0")) / 2, "f1_0": f1})


def majority(rows: DataFrame, keys: list[str], vote: str, order: str) -> DataFrame:
    """(keys, vote): the most frequent vote, ties to the one seen first."""
    counts = rows.groupBy(*keys, vote).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy(*keys).agg(F.max_by(vote, F.struct("n", -F.col("first"))).alias(vote))


def matthews(tp: Column, tn: Column, fp: Column, fn: Column) -> Column:
    bottom = F.sqrt((tp + fp).cast("double") * (tp + fn) * (tn + fp) * (tn + fn))
    return F.when(bottom == 0, 0.0).otherwise((tp.cast("double") * tn - fp.cast("double") * fn) / bottom)


def class_f1(rows: DataFrame, predicted: Column, gold: Column, keys: list[str] | None = None) -> DataFrame:
    """(keys, weighted_f1, macro_f1, accuracy) over any number of classes.

    A class's F1 is 2 tp / (2 tp + fp + fn), 0 where nothing was right; the weighted mean goes by how often a class is the gold one, the
    plain mean over all classes that were said or gold. Rows with a null on either side aren't items. Each row counts once as said and once
    as gold, so what shuffles is a count a class and task, and a frequent class is no hot key.
    """
    keys = keys or []
    pairs = rows.select(*keys, predicted.alias("_p"), gold.alias("_g")).where("_p is not null and _g is not null")
    sides = pairs.select(*keys, F.explode(F.array(F.struct(F.col("_g").alias("c"), F.lit(1).alias("g"), (F.col("_p") == F.col("_g")).cast("int").alias("hit")), F.struct(F.col("_p").alias("c"), F.lit(0).alias("g"), F.lit(0).alias("hit")))).alias("s"))
    counts = sides.groupBy(*keys, "s.c").agg(F.sum("s.g").alias("gold"), F.sum(1 - F.col("s.g")).alias("said"), F.sum("s.hit").alias("tp"))
    f1 = 2 * F.col("tp") / (F.col("said") + F.col("gold"))
    out = counts.groupBy(*keys) if keys else counts
    return out.agg((F.sum(f1 * F.col("gold")) / F.sum("gold")).alias("weighted_f1"), F.avg(f1).alias("macro_f1"), (F.sum("tp") / F.sum("gold")).alias("accuracy"))


def pooled_stderr(rows: DataFrame, group: str, size: str, stderr: str) -> DataFrame:
    """(group, pooled): standard error of parts put together, from theirs."""
    n, e = F.col(size), F.col(stderr)
    inner = F.sum((n - 1) * e * e * n) / (F.sum(n) - F.count("*"))
    return rows.groupBy(group).agg(F.sqrt(inner / F.sum(n)).alias("pooled"))


def weighted_mean(rows: DataFrame, group: str, size: str, value: str, by_size: bool = True) -> DataFrame:
    """(group, value): mean of parts, by their sizes or each alike."""
    w = F.col(size) if by_size else F.lit(1)
    return rows.groupBy(group).agg((F.sum(F.col(value) * w) / F.sum(w)).alias(value))


def bootstrap_stderr(rows: DataFrame, value: str, resamples: int, seed: int = 1234) -> DataFrame:
    """(stderr): spread of the means of ``resamples`` resamples with replacement, in one pass.

    A row is in a resample a Poisson(1) number of times, drawn where the row lies; values that a batch repeats draw together, as sums of
    such numbers are Poisson too. A task passes on one array of weights and one of weighted sums, whatever its rows, seeded by its
    partition. The spread of so many resamples is itself off by one part in sqrt(2 x resamples), and the drawn size of a resample adds
    nothing in first order, as each mean is over the size drawn. Nulls and NaN aren't items; without an item the result is null.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng, weights, sums = np.random.default_rng([seed, TaskContext.get().partitionId()]), np.zeros(resamples), np.zeros(resamples)
        for pdf in batches:
            values, counts = np.unique(pdf["v"].dropna().to_numpy(float), return_counts=True)
            for at in range(0, len(values), 1024):
                drawn = rng.poisson(counts[at : at + 1024, None], (len(values[at : at + 1024]), resamples))
                weights += drawn.sum(axis=0)
                sums += values[at : at + 1024] @ drawn
        if weights.any():
            yield pd.DataFrame({"resample": np.arange(resamples), "weight": weights, "total": sums})

    parts = rows.select(F.col(value).cast("double").alias("v")).mapInPandas(run, "resample int, weight double, total double")
    means = parts.groupBy("resample").agg((F.sum("total") / F.sum("weight")).alias("mean"))
    return means.agg(F.stddev_samp("mean").alias("stderr"))


def assignment(matrix: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of the largest total similarity between rows and columns (shortest augmenting paths)."""
    flipped = matrix.shape[0] > matrix.shape[1]
    cost = -(matrix.T if flipped else matrix)
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for row in range(1, n + 1):
        match[0], column = row, 0
        least, back, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while match[column]:
            used[column] = True
            here, step, following = match[column], np.inf, 0
            for j in range(1, m + 1):
                if not used[j]:
                    slack = cost[here - 1, j - 1] - u[here] - v[j]
                    if slack < least[j]:
                        least[j], back[j] = slack, column
                    if least[j] < step:
                        step, following = least[j], j
            u[match[used]] += step
            v[used] -= step
            least[~used] -= step
            column = following
        while column:
            match[column], column = match[back[column]], back[column]
    pairs = [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((b, a) for a, b in pairs) if flipped else sorted(pairs)


def matched_scores(rows: DataFrame, key: str) -> DataFrame:
    """(key, precision, recall, f1) of the best one-to-one matching; ``rows`` (key, gold, predicted, similarity) holds a group's matrix."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot_table(index="gold", columns="predicted", values="similarity", aggfunc="max", fill_value=0.0).to_numpy()
        total = sum(m[i, j] for i, j in assignment(m))
        p, r = total / m.shape[1], total / m.shape[0]
        return pd.DataFrame({"k": [pdf[key].iloc[0]], "precision": [p], "recall": [r], "f1": [2 * p * r / (p + r) if p + r else 0.0]})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "gold", "predicted", "similarity").groupBy(key).applyInPandas(one, f"k {kind}, precision double, recall double, f1 double").withColumnRenamed("k", key)


def ngram_overlap(rows: DataFrame, key: str, n: int, predicted: str = "predicted", gold: str = "gold", chars: bool = False) -> DataFrame:
    """(matches, predicted_grams, gold_grams) of clipped n-gram counts over the whole corpus, from which BLEU and chrF follow."""

    def grams(column: str):
        units = F.split(F.regexp_replace(column, r"\s+", ""), "") if chars else T.tokens(F.col(column))
        return T.ngrams(units, n)

    sides = [rows.select(F.col(key).alias("_k"), F.explode(grams(c)).alias("_g"), F.lit(int(c == predicted)).alias("_p"), F.lit(int(c == gold)).alias("_q")) for c in (predicted, gold)]
    counts = sides[0].unionByName(sides[1]).groupBy("_k", "_g").agg(F.sum("_p").alias("p"), F.sum("_q").alias("q"))
    return counts.agg(F.sum(F.least("p", "q")).alias("matches"), F.sum("p").alias("predicted_grams"), F.sum("q").alias("gold_grams"))


def bleu(rows: DataFrame, key: str, predicted: str = "predicted", gold: str = "gold") -> DataFrame:
    """(bleu): corpus BLEU-4 with the brevity penalty, in percent; 0 if an order has no match."""
    parts = None
    for n in range(1, 5):
        part = ngram_overlap(rows, key, n, predicted, gold).withColumn("n", F.lit(n))
        parts = part if parts is None else parts.unionByName(part)
    logs = parts.agg(F.sum(F.log(F.try_divide("matches", "predicted_grams")) / 4).alias("l"), F.max(F.when(F.col("n") == 1, F.col("predicted_grams"))).alias("p"), F.max(F.when(F.col("n") == 1, F.col("gold_grams"))).alias("g"), F.min("matches").alias("m"))
    return logs.select(F.when(F.coalesce("m", F.lit(0)) == 0, 0.0).otherwise(100 * F.exp(F.col("l") + F.least(F.lit(0.0), 1 - F.try_divide("g", "p")))).alias("bleu"))


def regex_pick(response: Column, pattern: str, group: int = 0, select: int = 0, fallback: str = "[invalid]") -> Column:
    """The ``select``-th match of a pattern (negative from the end), stripped, or the fallback."""
    found = F.regexp_extract_all(response, F.lit(pattern), F.lit(group))
    at = select + 1 if select >= 0 else select
    return F.coalesce(F.trim(F.try_element_at(found, F.lit(at))), F.lit(fallback))


def filter_chain(response: Column, *steps) -> Column:
    """Filters applied in order, each a function of the column before it."""
    for step in steps:
        response = step(response)
    return response


FILTERS = {"lstrip": F.ltrim, "lowercase": F.lower, "uppercase": F.upper, "take_first": lambda c: F.try_element_at(c, F.lit(1))}


def choice_requests(items: DataFrame, key: str, context: Column, choices: Column, mutual: bool = False) -> DataFrame:
    """A request a choice (key, kind, choice, context, continuation); with ``mutual`` also one without the context, told apart by kind."""
    rows = items.select(key, F.lit("conditional").alias("kind"), F.posexplode(choices).alias("choice", "continuation"), context.alias("context"))
    if mutual:
        rows = rows.unionByName(rows.withColumns({"kind": F.lit("unconditional"), "context": F.lit("")}))
    return rows.select(key, "kind", "choice", "context", "continuation")


def mutual_information_choices(scored: DataFrame, key: str, gold: str) -> DataFrame:
    """(key, acc_mutual_info): whether the gold choice gains most by the context, its log likelihood with it less the one without; ties to the first choice.

    ``scored`` (key, gold, choice, kind, loglik), as ``choice_requests`` with ``mutual`` asks for; a choice that lacks one of the two takes no part.
    """
    side = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("loglik")))
    gains = scored.groupBy(key, gold, "choice").agg((side("conditional") - side("unconditional")).alias("gain")).where("gain is not null")
    best = gains.groupBy(key, gold).agg(F.max_by("choice", F.struct("gain", -F.col("choice"))).alias("a"))
    return best.select(key, (F.col("a") == F.col(gold)).cast("int").alias("acc_mutual_info"))


def choice_scores(scored: DataFrame, key: str, gold: str) -> DataFrame:
    """(key, acc, acc_norm): whether the gold choice has the highest log likelihood, as it is and per character; ties to the first choice.

    ``scored`` (key, gold, choice, continuation, loglik).
    """
    norm = F.col("loglik") / F.length("continuation")
    best = scored.groupBy(key, gold).agg(F.max_by("choice", F.struct("loglik", -F.col("choice"))).alias("a"), F.max_by("choice", F.struct(norm, -F.col("choice"))).alias("b"))
    return best.select(key, (F.col("a") == F.col(gold)).cast("int").alias("acc"), (F.col("b") == F.col(gold)).cast("int").alias("acc_norm"))
