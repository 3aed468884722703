"""Retrievers and judges made of the parts: path exploration with a stop test, fact filters with a trace, model calls with a cost."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import cut
from . import graph as G
from . import hooks as H
from . import retrieval as Q
from . import search as S
from .relational import top_per_group


def explore(edges: DataFrame, topics: DataFrame, width: int, depth: int, score: Column, enough: Column, most_topics: int | None = None, topic_score: Column | None = None, both_ways: bool = False) -> DataFrame:
    """(qid, rounds, nodes, relations): each question's best paths when they were enough, or after ``depth`` steps.

    ``topics`` (qid, name) are where a question begins, its ``most_topics`` best by ``topic_score`` if it has more. A round grows
    all open questions' paths a step, keeps the ``width`` best by ``score`` (over nodes and relations) and closes the
    questions of which a path is ``enough``.
    """
    if most_topics is not None:
        order = [topic_score.desc(), F.col("name")] if topic_score is not None else [F.col("name")]
        topics = top_per_group(topics.distinct(), ["qid"], order, most_topics).select("qid", "name")
    steps, at, done = cut(G.path_steps(edges, both_ways), "steps"), G.path_starts(topics), None
    for d in range(1, depth + 1):
        at = G.grow_paths(steps, at, width, score)
        ready = cut(at.where(enough).select("qid").distinct(), "ready")
        over = at if d == depth else at.join(ready, "qid", "left_semi")
        over = over.select("qid", F.lit(d).alias("rounds"), "nodes", "relations")
        done = over if done is None else done.unionByName(over)
        at = at.join(ready, "qid", "left_anti")  # open questions go on from where they are
    return done


def path_texts(nodes: Column, relations: Column) -> Column:
    """A path as ``a -r-> b -s-> c``."""
    steps = F.transform(relations, lambda r, i: F.concat(F.lit(" -"), r, F.lit("-> "), F.element_at(nodes, i + 2)))
    return F.concat(F.element_at(nodes, 1), F.array_join(steps, ""))


def path_passages(paths: DataFrame, mentions: DataFrame, top: int) -> DataFrame:
    """(qid, rank, text_id, score): passages by the number of nodes of a question's paths that they name.

    ``mentions`` (name, text_id). A node counts by the inverse of the passages that name it, so a hub tells little.
    """
    rarity = mentions.groupBy("name").agg((1.0 / F.count_distinct("text_id")).alias("w"))
    nodes = paths.select("qid", F.explode("nodes").alias("name")).distinct().join(rarity, "name")
    scores = nodes.join(mentions.distinct(), "name").groupBy("qid", "text_id").agg(F.round(F.sum("w"), 9).alias("score"))
    return top_per_group(scores, ["qid"], [F.desc("score"), F.col("text_id")], top).select("qid", "rank", "text_id", "score")


def filtered_facts(candidates: DataFrame, chosen: DataFrame) -> DataFrame:
    """(qid, fact, score, kept): the candidate facts (qid, fact, score), and whether a model's choice (qid, fact) names them.

    Only candidates count: what else a reply names is dropped. A question whose reply names no candidate keeps all.
    """
    picked = candidates.join(chosen.select("qid", "fact").distinct().withColumn("named", F.lit(True)), ["qid", "fact"], "left")
    some = chosen.join(candidates, ["qid", "fact"], "left_semi").select("qid").distinct().withColumn("some", F.lit(True))
    kept = F.coalesce("named", F.isnull("some"))
    return picked.join(some, "qid", "left").select("qid", "fact", "score", kept.alias("kept"))


def strict_passages(edges: DataFrame, facts: DataFrame, chosen: DataFrame, passage_scores: DataFrame, candidates: int = 5, top: int = 5, iterations: int = 20) -> tuple[DataFrame, DataFrame]:
    """(passages, trace): ``retrieval.graph_passages`` from the facts that a filter leaves, with each question's trace.

    ``facts`` (qid, fact, src, dst, score); of the ``candidates`` best those ``chosen`` stay (``filtered_facts``).
    The trace (qid, candidates, kept, seeds) counts what each step left.
    """
    best = top_per_group(facts, ["qid"], [F.desc("score"), F.col("fact")], candidates)
    kept = cut(filtered_facts(best.select("qid", "fact", "score"), chosen), "facts")
    scored = best.drop("rank").join(kept.where("kept").select("qid", "fact"), ["qid", "fact"], "left_semi").select("qid", "src", "dst", "score")
    seeds = Q.edge_seeds(scored)
    found = Q.graph_passages(edges, scored, passage_scores, top=top, iterations=iterations)
    trace = kept.groupBy("qid").agg(F.count("*").alias("candidates"), F.count_if("kept").alias("kept")).join(seeds.groupBy("qid").agg(F.count("*").alias("seeds")), "qid", "left")
    return found, trace.select("qid", "candidates", "kept", F.coalesce("seeds", F.lit(0)).alias("seeds"))


def linked_names(wanted: DataFrame, names: DataFrame) -> DataFrame:
    """(term, name, how): terms that are names, and for the others the name of the nearest encoding.

    ``wanted`` (term), ``names`` (name). Only the misses are encoded and searched for.
    """
    known = names.select("name").distinct()
    exact = wanted.select("term").distinct().join(known, F.col("term") == F.col("name")).select("term", "name", F.lit("exact").alias("how"))
    missed = wanted.select("term").distinct().join(exact, "term", "left_anti")
    vectors = known.select("name", S.encode("name").alias("embedding"))
    near = S.top_k(vectors, missed.select(F.col("term").alias("qid"), S.encode("term").alias("query")), 1, key="name", largest_id_first=False)
    return exact.unionByName(near.select(F.col("qid").alias("term"), "name", F.lit("nearest").alias("how")))


#: Characters that count as one token in a cost.
CHARS = 4


def judged(rows: DataFrame, prompt: str, model: Callable[[], H.Model], tries: int = 10, price_in: float = 0.0, price_out: float = 0.0) -> DataFrame:
    """``rows`` with the judge's ``reply``, ``verdict`` and ``cost``.

    A call that fails ``tries`` times has the verdict ``invalid``; a reply is read by its first word, lower-cased.
    The cost counts tokens by characters, asked and answered.
    """
    called = H.generate(rows, prompt, model, tries)
    verdict = F.when(F.col("reply").isNull(), "invalid").otherwise(F.lower(F.regexp_extract("reply", r"(\w+)", 1)))
    cost = F.ceil(F.length(prompt) / CHARS) * price_in + F.coalesce(F.ceil(F.length("reply") / CHARS), F.lit(0)) * price_out
    return called.withColumn("verdict", verdict).withColumn("cost", cost.cast("double"))


def token_score(previous: Column, token: Column) -> Column:
    """A seeded stand-in for a model's log10 probability of a token behind another: between -1 and -2, by their digest."""
    digits = F.conv(F.substring(F.md5(F.concat_ws(" ", previous, token).cast("binary")), 1, 4), 16, 10).cast("double")
    return -1 - digits / 65536


def log_likelihood(context: Column, continuation: Column) -> Column:
    """The sum of token scores of the continuation's words, each behind the word before it."""
    words = F.split(F.trim(continuation), r"\s+")
    before = F.concat(F.array(F.element_at(F.split(F.trim(context), r"\s+"), -1)), words)
    return F.aggregate(F.transform(words, lambda w, i: token_score(F.element_at(before, i + 1), w)), F.lit(0.0), lambda s, x: s + x)


def until(text: Column, *stops: str) -> Column:
    """A generation cut before the first of its stop strings."""
    for stop in stops:
        text = F.substring_index(text, stop, 1)
    return text
