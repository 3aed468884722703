"""Approximate vector search on a neighbour graph: made by joining neighbours of neighbours, walked by all questions together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scratch import cut, few
from ..functions.vector import dot
from .relational import top_per_group

#: Rows of a run of the first orderings, all of which are compared with each other.
RUN = 32
#: Rounds of joining end when fewer than this share of the links changed.
SETTLED = 0.01
#: Lists of neighbours that a task compares before it passes proposals on.
LISTS = 128
#: Bytes of questions' vectors that a round of a search sends to all tasks, and so through the driver; of more, they are shuffled.
SENT = 32 << 20


def _first_links(rows: DataFrame, dimensions: int, neighbours: int, orders: int, seed: int) -> DataFrame:
    """(u, v, score): the best links within runs of RUN rows, in ``orders`` orderings by random directions.

    Rows are sorted by their projection and their id, so that rows which are alike, however many, still make runs of one length.
    """
    kind = rows.schema["id"].dataType
    out = None
    for k in range(orders):
        direction = np.random.default_rng([seed, k]).standard_normal(dimensions).tolist()
        placed = rows.withColumn("at", dot(F.col("v"), F.array(*map(F.lit, direction)))).repartitionByRange("at", "id").sortWithinPartitions("at", "id").select("id", "v")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            left = None
            for pdf in batches:
                pdf = pdf if left is None else pd.concat([left, pdf], ignore_index=True)
                whole = len(pdf) // RUN * RUN if len(pdf) >= 2 * RUN else 0
                yield from links(pdf.iloc[:whole])
                left = pdf.iloc[whole:]
            if left is not None:
                yield from links(left)

        def links(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
            for at in range(0, len(pdf), RUN):
                some = pdf.iloc[at : at + RUN]
                if len(some) > 1:
                    ids, m = some["id"].to_numpy(), np.stack(some["v"].to_numpy()).astype(float)
                    scores = m @ m.T
                    np.fill_diagonal(scores, -np.inf)
                    best = np.argsort(-scores, axis=1, kind="stable")[:, : min(neighbours, len(some) - 1)]
                    yield pd.DataFrame({"u": np.repeat(ids, best.shape[1]), "v": ids[best].ravel(), "score": np.take_along_axis(scores, best, 1).ravel()})

        part = placed.mapInPandas(run, T.StructType().add("u", kind).add("v", kind).add("score", "double"))
        out = part if out is None else out.unionByName(part)
    return out


def _best(links: DataFrame, neighbours: int) -> DataFrame:
    """(u, v, score, new): each node's best links, once each; new if no copy of the link is known as old."""
    once = links.groupBy("u", "v").agg(F.max("score").alias("score"), F.min("new").alias("new"))
    return top_per_group(once, ["u"], [F.desc(F.round("score", 9)), F.col("v")], neighbours).select("u", "v", "score", "new")


def _joined(links: DataFrame, rows: DataFrame, neighbours: int, turn: int) -> DataFrame:
    """(u, v, score): links that pairs of neighbours of a common node propose to each other.

    A node gathers its own links and as many that lead to it, new ones first, so a list has at most 2 * ``neighbours`` vectors,
    and a proposal is passed on only where it beats the worst link that its receiver has.
    """
    kind = rows.schema["id"].dataType
    back = top_per_group(links.select(F.col("v").alias("u"), F.col("u").alias("v"), "score", "new"), ["u"], [F.desc("new"), F.xxhash64(F.lit(turn), "u", "v"), F.col("v")], neighbours).drop("rank")
    around = links.unionByName(back).select("u", "v").distinct()
    worst = links.groupBy(F.col("u").alias("id")).agg(F.when(F.count("*") >= neighbours, F.min("score")).otherwise(float("-inf")).alias("worst"))
    known = rows.join(worst, "id", "left").select(F.col("id").alias("v"), "worst", F.col("v").alias("vector"))
    lists = around.join(known, "v").groupBy("u").agg(F.collect_list(F.struct("v", "worst", "vector")).alias("near")).select("near")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, LISTS):
                near = batch.column(0).slice(at, LISTS)
                sizes, rows = near.value_lengths().to_numpy(zero_copy_only=False), near.flatten()
                ids, worst, vectors = (rows.field(f) for f in ("v", "worst", "vector"))
                worst = worst.fill_null(-np.inf).to_numpy(zero_copy_only=False)
                m = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), -1)
                us, vs, scores, first = [], [], [], 0
                for size in sizes:
                    own = m[first : first + size]
                    s = own @ own.T
                    np.fill_diagonal(s, -np.inf)
                    i, j = np.nonzero(s > worst[first : first + size, None] + 1e-12)
                    us.append(i + first)
                    vs.append(j + first)
                    scores.append(s[i, j])
                    first += size
                found = (ids.take(pa.array(np.concatenate(x))) for x in (us, vs))
                yield pa.RecordBatch.from_arrays([*found, pa.array(np.concatenate(scores))], ["u", "v", "score"])

    return lists.mapInArrow(run, T.StructType().add("u", kind).add("v", kind).add("score", "double"))


def neighbour_links(vectors: DataFrame, neighbours: int = 16, orders: int = 3, rounds: int = 8, key: str = "vec_id", vector: str = "embedding", seed: int = 7) -> DataFrame:
    """(u, v, score): about the ``neighbours`` rows of the largest inner product with each row.

    Orderings by random directions give each row its first links. Then, round by round, nodes that a common neighbour links are
    compared, until hardly a link changes. A round is a written table. Null vectors and ids take no part; of rows that repeat an id one does.
    """
    rows = cut(vectors.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("id"), F.transform(vector, lambda x: x.cast("float")).alias("v")).dropDuplicates(["id"]), "graph-rows")
    first = rows.select(F.size("v").alias("d")).first()
    if first is None:
        return rows.select(F.col("id").alias("u"), F.col("id").alias("v"), F.lit(0.0).alias("score"))
    links = cut(_best(_first_links(rows, first.d, neighbours, orders, seed).withColumn("new", F.lit(True)), neighbours), "graph-links")
    for turn in range(rounds):
        proposed = _joined(links, rows, neighbours, turn).withColumn("new", F.lit(True))
        links = cut(_best(links.withColumn("new", F.lit(False)).unionByName(proposed), neighbours), "graph-links")
        counted = links.agg(F.count_if("new").alias("new"), F.count("*").alias("all")).first()
        if counted.new <= SETTLED * counted.all:
            break
    return links.select("u", "v", "score")


def save_graph(vectors: DataFrame, folder: str, neighbours: int = 16, back: int = 1, entries: int = 16, key: str = "vec_id", vector: str = "embedding", seed: int = 7, **build) -> None:
    """An index that can be opened again: ``nodes`` (id, v, neighbours) and ``entries``, the ids where questions start.

    Half as many links again are looked for, which makes the kept ones better. A node's neighbours are its own links and the ``back`` best ones that lead to it, which a walk needs to leave a group of copies.
    """
    links = neighbour_links(vectors, neighbours * 3 // 2, key=key, vector=vector, seed=seed, **build)
    links = cut(top_per_group(links, ["u"], [F.desc(F.round("score", 9)), F.col("v")], neighbours).drop("rank"), "graph-kept")
    back = top_per_group(links.select(F.col("v").alias("u"), F.col("u").alias("v"), "score"), ["u"], [F.desc(F.round("score", 9)), F.col("v")], back).drop("rank")
    lists = links.unionByName(back).groupBy(F.col("u").alias("id")).agg(F.collect_set("v").alias("neighbours"))
    rows = vectors.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("id"), F.transform(vector, lambda x: x.cast("float")).alias("v")).dropDuplicates(["id"])
    rows.join(lists, "id", "left").select("id", "v", F.coalesce("neighbours", F.array().cast(f"array<{rows.schema['id'].dataType.simpleString()}>")).alias("neighbours")).write.parquet(f"{folder}/nodes")
    rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(entries).select("id").write.parquet(f"{folder}/entries")


def search_graph(spark: SparkSession, folder: str, questions: DataFrame, k: int, beam: int = 8, width: int = 2, rounds: int = 200, key: str = "vec_id") -> DataFrame:
    """(qid, rank, key, score, scored): each question's best rows as its walk has met them, and how many rows it was compared with.

    All questions move together. A round opens the ``width`` best nodes of every question's beam that aren't open, scores their neighbours
    that the question hasn't met, and keeps the ``beam`` best; it ends when no beam has a node to open. A round is a
    written table of one row a question; what it looks up in the index are single rows by id. Questions are the stated side:
    what they ask of a round is sent to the index's tasks where it is counted to be at most SENT bytes, and shuffled by id otherwise.
    """
    nodes = spark.read.parquet(f"{folder}/nodes")
    size = questions.select(F.size("query").alias("d")).first()
    most = max(1, SENT // (8 * max((size.d if size else 0) or 0, 0) + 64))  # rows of a question's vector, its id and a node's
    beam = max(beam, k)
    starts = spark.read.parquet(f"{folder}/entries").agg(F.collect_set("id").alias("wanted"))
    state = questions.select("qid", F.transform("query", lambda x: x.cast("double")).alias("query")).join(F.broadcast(starts))  # one row of a few ids
    none = F.array().cast(T.ArrayType(T.StructType().add("score", "double").add("id", nodes.schema["id"].dataType)))
    state = state.select("qid", "query", none.alias("pool"), F.array().cast(nodes.schema["neighbours"].dataType).alias("open"), F.col("wanted").alias("seen"), "wanted")
    for _ in range(rounds):
        asked = cut(state.select("qid", "query", F.explode("wanted").alias("id")), "graph-asked")
        scored = few(asked, most).join(nodes, "id").groupBy("qid").agg(F.collect_list(F.struct(dot(F.col("v"), F.col("query")).alias("score"), F.col("id"))).alias("met"))
        pool = F.slice(F.sort_array(F.concat("pool", F.coalesce("met", none)), asc=False), 1, beam)
        state = state.join(scored, "qid", "left").select("qid", "query", "open", "seen", pool.alias("pool"))
        fresh = F.slice(F.array_except(F.transform("pool", lambda x: x["id"]), F.col("open")), 1, width)
        state = cut(state.withColumn("fresh", fresh), "graph-state")
        if state.where(F.size("fresh") > 0).isEmpty():
            break
        opened = cut(state.select("qid", F.explode("fresh").alias("id")), "graph-opened")
        around = few(opened).join(nodes.select("id", "neighbours"), "id").groupBy("qid").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("around"))
        state = state.join(around, "qid", "left").withColumn("wanted", F.array_except(F.coalesce("around", "fresh"), F.col("seen")))
        state = cut(state.select("qid", "query", "pool", F.array_union("open", "fresh").alias("open"), F.array_union("seen", "wanted").alias("seen"), "wanted"), "graph-state")
    best = state.select("qid", F.size("seen").cast("long").alias("scored"), F.posexplode(F.slice("pool", 1, k)).alias("place", "x"))
    return best.select("qid", (F.col("place") + 1).alias("rank"), F.col("x.id").alias(key), F.col("x.score").alias("score"), "scored")
