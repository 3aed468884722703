"""Shared pieces: scratch tables, bounded Arrow batches, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import scratch_path, ship_package

#: Rows and bytes of an Arrow batch sent to Python: they bound a worker's memory when texts are long.
BATCH_ROWS = 500
BATCH_BYTES = 16 << 20


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote, once nothing that is still to run reads them."""
    for df in tables:
        if path := getattr(df, "_scratch", None):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Make ready for Python stages: batches of ``rows`` rows and BATCH_BYTES at most, so that a worker's memory doesn't follow the longest texts.

    Plans read both when they run, long after an operator has returned its result, so they stay set in the session.
    """
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def spare_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def fold_ascii(col):
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Edges up to which one task finishes a contracted graph: two longs each, counted first.
SMALL_GRAPH = 1_000_000


def _finish(live: DataFrame) -> DataFrame:
    """(c, component) of a graph of at most SMALL_GRAPH edges, by union-find in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict = {}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                root.setdefault(a, a)
                root.setdefault(b, b)
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
        if root:
            yield pa.RecordBatch.from_arrays([pa.array(root.keys(), kind), pa.array([find(x) for x in root], kind)], ["c", "component"])

    kind = live.schema["a"].dataType.simpleString()
    return materialise(live.coalesce(1).mapInArrow(run, f"c {kind}, component {kind}"), "cc-finish")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph: (node, component), component the smallest node.

    ``edges`` has the columns a and b of one comparable type; null ends are no edges, self loops keep
    their node. Each round sends every node to its smallest neighbour, follows those pointers four
    steps, and contracts the edges to the nodes reached, so that the graph at least halves and rounds grow
    with the logarithm of its size; a graph of at most SMALL_GRAPH edges is finished in one task. Every
    round's tables are written; only the number of edges left reaches the driver. An empty input gives
    an empty result.
    """
    live = edges.where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    live = materialise(live, "cc-edges")
    label = None
    for _ in range(max_rounds):
        if live.count() <= SMALL_GRAPH:
            done = _finish(live)
            discard(live)
            if label is None:
                return done.withColumnRenamed("c", "node")
            moved = label.withColumnRenamed("component", "c").join(done, "c", "left")
            return moved.select("node", F.coalesce("component", "c").alias("component"))
        ends = live.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(live.select(F.col("b").alias("u"), F.col("a").alias("v")))
        up = ends.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("p"))
        for _ in range(2):
            above = up.select(F.col("u").alias("p"), F.col("p").alias("q"))
            up = up.join(above, "p").select("u", F.col("q").alias("p"))
        up = materialise(up, "cc-pointers")
        to = up.select(F.col("u").alias("c"), F.col("p").alias("component"))
        was = label
        if label is None:
            label = materialise(to.withColumnRenamed("c", "node"), "cc-labels")
        else:
            moved = was.withColumnRenamed("component", "c").join(to, "c", "left")
            label = materialise(moved.select("node", F.coalesce("component", "c").alias("component")), "cc-labels")
            discard(was)
        pairs = live.where("a <> b").join(up.select(F.col("u").alias("a"), F.col("p").alias("pa")), "a").join(up.select(F.col("u").alias("b"), F.col("p").alias("pb")), "b").where("pa <> pb")
        contracted = materialise(pairs.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "cc-edges")
        discard(live, up)
        live = contracted
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
