"""Single files, concatenated tables, compressed line archives and array files, on whatever file system Hadoop knows."""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .buckets import qualified
from .readers import _hadoop_files


def _hadoop(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def one_file(lines: DataFrame, path: str, order: list[str] | None = None) -> None:
    """The ``value`` column as one text file, in ``order`` if given. One task writes it, so it is for files that a single reader opens.

    It is written aside and renamed, so a reader sees the old file or the new one.
    """
    spark, part = lines.sparkSession, f"{path}.{uuid.uuid4().hex}"
    whole = lines.repartition(1)
    (whole.sortWithinPartitions(*order) if order else whole).select("value").write.text(part)
    target, store = _hadoop(spark, path)
    source = spark._jvm.org.apache.hadoop.fs.Path(next(f for f in _hadoop_files(spark, part) if "/part-" in f))
    store.mkdirs(target.getParent())
    store.delete(target, False)
    store.rename(source, target)
    store.delete(spark._jvm.org.apache.hadoop.fs.Path(part), True)


def write_json(spark: SparkSession, path: str, value) -> None:
    """A JSON file that is either the old or the new one."""
    one_file(spark.createDataFrame([(json.dumps(value, ensure_ascii=False, sort_keys=True),)], "value string"), path)


def concatenated(spark: SparkSession, folder: str, ending: str = ".csv") -> DataFrame:
    """(file, line, value): the lines of a folder's files by name, the header that all begin with once."""
    names = [f for f in _hadoop_files(spark, folder) if f.endswith(ending)]
    if not names:
        return spark.createDataFrame([], "file int, line int, value string")
    order = F.create_map(*[F.lit(x) for i, f in enumerate(names) for x in (f.rsplit("/", 1)[-1], i)])
    whole = spark.read.text(names, wholetext=True).select(order[F.element_at(F.split(F.input_file_name(), "/"), -1)].alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
    return whole.where("value <> '' and (line > 0 or file = 0)")


def compress_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, lines): each text file rewritten as .zst, a task a file; ``path`` is the new one's.

    All are written before any goes: tasks may fail or run twice, and only when every new file is whole does the driver put them in place and
    delete the old ones. Called again after a crash it goes on: a file that is gone and has its .zst counts as done.
    """
    uris = [qualified(spark, p) for p in paths]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        for pdf in batches:
            for uri in pdf["uri"]:
                store, path = fs.FileSystem.from_uri(uri)
                lines, half = 0, f"{path}.{uuid.uuid4().hex}.half"
                if not store.get_file_info(path).is_file and store.get_file_info(f"{path}.zst").is_file:
                    with store.open_input_file(f"{path}.zst") as raw, zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True) as plain:
                        while block := plain.read(1 << 20):
                            lines += block.count(b"\n")
                    yield pd.DataFrame({"uri": [uri], "half": [""], "lines": [lines]})
                    continue
                with store.open_input_stream(path) as raw, store.open_output_stream(half) as sink, zstandard.ZstdCompressor().stream_writer(sink, closefd=False) as out:
                    while block := raw.read(1 << 20):
                        lines += block.count(b"\n")
                        out.write(block)
                yield pd.DataFrame({"uri": [uri], "half": [half], "lines": [lines]})

    listed = spark.createDataFrame([(p,) for p in uris], "uri string").repartition(max(1, len(uris)))
    done = listed.mapInPandas(run, "uri string, half string, lines bigint").collect()  # a row a file that was asked for
    for row in done:
        store, path = fs.FileSystem.from_uri(row.uri)
        if row.half:
            store.move(row.half, f"{path}.zst")
            store.delete_file(path)
    return spark.createDataFrame([(f"{r.uri}.zst", r.lines) for r in done], "path string, lines bigint")


#: Vectors of an array file.
ARRAY_ROWS = 65_536


def array_files(df: DataFrame, vector: str, folder: str, rows: int = ARRAY_ROWS) -> DataFrame:
    """(path, n, dimensions): the vectors as float32 .npy files of up to ``rows`` each, and an index of them, which this returns.

    The index is a table that Spark commits: files of tasks that failed or ran twice aren't in it. A task holds one file's rows.
    """
    uri = qualified(df.sparkSession, folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)
        held: list = []

        def flush() -> pd.DataFrame:
            data, at = np.stack(held).astype(np.float32), f"{uuid.uuid4().hex}.npy"
            body = io.BytesIO()
            np.save(body, data)
            with store.open_output_stream(f"{root}/{at}") as out:
                out.write(body.getvalue())
            held.clear()
            return pd.DataFrame({"path": [f"{uri}/{at}"], "n": [len(data)], "dimensions": [data.shape[1]]})

        for pdf in batches:
            for v in pdf["v"]:
                held.append(v)
                if len(held) == rows:
                    yield flush()
        if held:
            yield flush()

    df.select(F.col(vector).alias("v")).mapInPandas(run, "path string, n bigint, dimensions int").write.parquet(f"{folder}/index")
    return df.sparkSession.read.parquet(f"{folder}/index")


def read_arrays(spark: SparkSession, folder: str) -> DataFrame:
    """(vector) of every .npy file that a folder's index names, a task a few files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for uri in pdf["path"]:
                store, path = fs.FileSystem.from_uri(uri)
                with store.open_input_file(path) as f:
                    yield pd.DataFrame({"vector": list(np.load(io.BytesIO(f.read())))})

    index = spark.read.parquet(f"{folder}/index").select("path")
    return index.repartition("path").mapInPandas(run, "vector array<float>")


def bulk_import(nodes: DataFrame, edges: DataFrame, folder: str, key: str = "name", label: str = "type") -> None:
    """Node and relation tables with the header that graph stores import: the typed key, ends, label and type columns.

    Relations without both ends among the nodes are left out, as an import would skip them.
    """
    known = nodes.select(F.col(key).alias("k"))
    whole = edges.join(known.withColumnRenamed("k", "src"), "src", "left_semi").join(known.withColumnRenamed("k", "dst"), "dst", "left_semi")
    csv = lambda df, name: df.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{folder}/{name}")
    csv(nodes.select(F.col(key).alias(f"{key}:ID"), F.col(label).alias(":LABEL")), "nodes")
    csv(whole.select(F.col("src").alias(":START_ID"), F.col("dst").alias(":END_ID"), F.col("relation").alias(":TYPE")), "relations")
