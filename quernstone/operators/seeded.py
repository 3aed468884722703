"""Ranks from single seeds, each in a sample of the graph of its own, and passages by them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import cut, few
from .graph import undirected, walk_sample
from .relational import top_per_group
from .retrieval import link_names


def sampled_links(edges: DataFrame, samples: DataFrame) -> DataFrame:
    """(sid, u, v): both ways, the edges with both ends in a sample (sid, name).

    Only edges between nodes of samples are ordered at all. One is looked up at its end of the lower degree among these, so a hub in many
    samples doesn't open all its edges in each.
    """
    some = few(cut(samples.select("name").distinct(), "sample-nodes"))
    inside = edges.join(some.select(F.col("name").alias("src")), "src", "left_semi").join(some.select(F.col("name").alias("dst")), "dst", "left_semi")
    both = cut(undirected(inside).where("u <> v"), "sample-edges")
    degree = both.groupBy("u").agg(F.count("*").alias("d"))
    ends = both.where("u < v").join(degree, "u").join(degree.select(F.col("u").alias("v"), F.col("d").alias("e")), "v")
    low = ends.select(F.when(F.col("d") <= F.col("e"), F.col("u")).otherwise(F.col("v")).alias("low"), F.when(F.col("d") <= F.col("e"), F.col("v")).otherwise(F.col("u")).alias("high"))
    held = samples.select("sid", "name").distinct()
    found = held.withColumnRenamed("name", "low").join(low, "low").join(held.withColumnRenamed("name", "high"), ["sid", "high"], "left_semi")
    return found.select("sid", F.col("low").alias("u"), F.col("high").alias("v")).unionByName(found.select("sid", F.col("high").alias("u"), F.col("low").alias("v")))


def push_ranks(links: DataFrame, starts: DataFrame, alpha: float = 0.85, epsilon: float = 1e-4, max_rounds: int = 200) -> DataFrame:
    """(sid, name, rank, left): PageRank with restarts at a start (sid, name), for all starts together, each over its own links (sid, u, v).

    A node holds a rank and a residual. A round takes every residual over ``epsilon``, keeps 1 - alpha of it as rank and pushes the rest evenly
    along the node's links; where there is none it is lost. Nodes that nothing has reached have no row. Ranks are short of the
    exact ones, in sum over a start's nodes by ``left`` at most, which is what residuals are left; no round changes that bound's sense.
    """
    degree = links.groupBy("sid", "u").agg(F.count("*").alias("out"))
    steps = cut(links.join(degree, ["sid", "u"]).select("sid", F.col("u").alias("name"), "v", "out"), "push-links")
    state = cut(starts.select("sid", "name", F.lit(0.0).alias("rank"), F.lit(1.0).alias("residual")).distinct(), "push-state")
    for _ in range(max_rounds):
        active = state.where(F.col("residual") > epsilon)
        if active.isEmpty():
            break
        held = state.select("sid", "name", F.when(F.col("residual") > epsilon, F.col("rank") + (1 - alpha) * F.col("residual")).otherwise(F.col("rank")).alias("rank"), F.when(F.col("residual") > epsilon, 0.0).otherwise(F.col("residual")).alias("residual"))
        pushed = active.join(steps, ["sid", "name"]).select("sid", F.col("v").alias("name"), F.lit(0.0).alias("rank"), (alpha * F.col("residual") / F.col("out")).alias("residual"))
        state = cut(held.unionByName(pushed).groupBy("sid", "name").agg(F.sum("rank").alias("rank"), F.sum("residual").alias("residual")), "push-state")
    left = state.groupBy("sid").agg(F.sum("residual").alias("left"))
    return state.join(left, "sid").select("sid", "name", "rank", "left")


def seed_ranks(edges: DataFrame, starts: DataFrame, walkers: int = 20, steps: int = 4, restart: float = 0.4, alpha: float = 0.85, epsilon: float = 1e-4, seed: int = 7) -> DataFrame:
    """(qid, seed, name, rank, left): for each start (qid, name, number) ranks over the nodes that its own random walks met."""
    sid = F.concat_ws("\x1f", F.col("qid").cast("string"), "name")
    known = cut(starts.select(sid.alias("sid"), "qid", "name", "number"), "seed-starts")
    samples = cut(walk_sample(edges, known.select(F.col("sid").alias("qid"), "name", "number"), walkers, steps, restart, seed).withColumnRenamed("qid", "sid"), "seed-samples")
    ranks = push_ranks(sampled_links(edges, samples), known.select("sid", "name"), alpha, epsilon)
    return ranks.join(known.select("sid", "qid", F.col("name").alias("seed")), "sid").select("qid", "seed", "name", "rank", "left")


def keyword_passages(keywords: DataFrame, edges: DataFrame, mentions: DataFrame, top: int = 5, per_seed: int = 50, nodes: int = 25, ratio: float = 0.8, **walk) -> DataFrame:
    """(qid, rank, text, score): each question's passages from its keywords (qid, term), over a graph too large to rank as a whole.

    A keyword is linked to the node of its name, or the most alike. A node weighs one over the passages that mention it (``mentions``: name,
    text); a node that none mentions is no seed. Each seed ranks a sample of its own; its ``per_seed`` best, times its weight, are put
    together, a question keeps the ``nodes`` best of all, and a passage scores the sum over those that it mentions. Ties go by name.
    """
    linked = link_names(keywords.select("term"), edges.select(F.col("src").alias("name")).union(edges.select("dst")), ratio)
    linked = cut(linked, "keyword-nodes")
    of = lambda names: mentions.select("name", "text").join(few(names.select("name").distinct()), "name", "left_semi").distinct()
    weight = of(linked).groupBy("name").agg((1.0 / F.count("*")).alias("weight"))
    seeds = cut(keywords.join(linked, "term").select("qid", "name").distinct().join(weight, "name").withColumn("number", F.lit(0).cast("long")), "keyword-seeds")
    ranks = seed_ranks(edges, seeds.select("qid", "name", "number"), **walk).where("rank > 0")
    best = top_per_group(ranks, ["qid", "seed"], [F.desc(F.round("rank", 12)), F.col("name")], per_seed, "place")
    scored = best.join(seeds.select("qid", F.col("name").alias("seed"), "weight"), ["qid", "seed"]).withColumn("score", F.col("rank") * F.col("weight"))
    kept = top_per_group(scored.drop("rank"), ["qid"], [F.desc(F.round("score", 12)), F.col("seed"), F.col("name")], nodes, "place")
    kept = cut(kept, "keyword-best")
    texts = kept.join(of(kept), "name").groupBy("qid", "text").agg(F.sum("score").alias("score"))
    return top_per_group(texts, ["qid"], [F.desc(F.round("score", 12)), F.col("text")], top).select("qid", "rank", "text", "score")
