"""Archives of compressed JSON lines that many tasks write and read: files of whole zstd frames, and an index of the frames.

Rows are dealt by ranges of (archive, order), so one archive of any size is written by many tasks, in its order. A task writes a file an archive, made of
frames that can be read alone; put one after the other, an archive's files are a plain zstd stream of its lines. The index is a table that Spark
commits, so files of tasks that failed or ran twice aren't in it; it says where each frame lies and which lines it has, and a range
of frames is a partition when they are read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .buckets import qualified

#: Bytes of lines that a frame takes before it ends.
FRAME = 1 << 20

INDEX = "archive string, part long, file string, offset long, length long, first long, lines long"


def write_frames(df: DataFrame, folder: str, archive: str, text: str, order: list[str], frame: int = FRAME) -> None:
    """Each value of ``archive`` as an archive of lines {"text": ...}, in ``order``. Null archives are no archive's, null texts are lines with null.

    Rows of one archive that are equal in ``order`` can't be dealt apart, so an order that tells rows apart is best.
    """
    import zstandard

    uri = qualified(df.sparkSession, folder)
    keys = [f"o{i}" for i in range(len(order))]
    rows = df.where(F.col(archive).isNotNull()).select(F.col(archive).cast("string").alias("archive"), F.to_json(F.struct(F.col(text).alias("text")), {"ignoreNullFields": "false"}).alias("line"), *[F.col(c).alias(k) for c, k in zip(order, keys, strict=True)])
    dealt = rows.repartitionByRange("archive", *keys).sortWithinPartitions("archive", *keys).select("archive", "line", F.spark_partition_id().cast("long").alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(f"{root}/data", recursive=True)
        out, name, file, first, held, size = None, None, None, 0, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal first, held, size
            if held:
                body = zstandard.ZstdCompressor().compress("".join(f"{line}\n" for line in held).encode())
                row = [[name], [part], [file], [out.tell()], [len(body)], [first], [len(held)]]
                out.write(body)
                first, held, size = first + len(held), [], 0
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, [pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 4], strict=True)], ["archive", "part", "file", "offset", "length", "first", "lines"])

        part = None
        for batch in batches:
            for at, line, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):  # noqa: B007, B020
                if at != name:
                    yield from flush()
                    if out is not None:
                        out.close()
                    name, first, file = at, 0, f"{quote(at, safe='')[:80]}-{part:06d}-{uuid.uuid4().hex}.jsonl.zst"
                    out = store.open_output_stream(f"{root}/data/{file}", compression=None)
                held.append(line)
                size += len(line)
                if size >= frame:
                    yield from flush()
        yield from flush()
        if out is not None:
            out.close()

    dealt.mapInArrow(run, INDEX).write.parquet(f"{folder}/index")


def totals(spark: SparkSession, folder: str) -> DataFrame:
    """(archive, lines): how long each archive is, from the index alone."""
    return spark.read.parquet(f"{folder}/index").groupBy("archive").agg(F.sum("lines").alias("lines"))


def read_frames(spark: SparkSession, folder: str, archives: list[str] | None = None, after: int | None = None) -> DataFrame:
    """(archive, place, text): the lines and their places in their archive from 0; a list of paragraphs is joined by blank lines.

    Frames are dealt to tasks by their bytes. Of archives that aren't asked for, and of frames that end at ``after`` or before it, nothing is read.
    """
    import zstandard

    uri = qualified(spark, folder)
    index = spark.read.parquet(f"{folder}/index")
    if archives is not None:
        index = index.where(F.col("archive").isin(archives))
    parts = index.groupBy("archive", "part").agg(F.sum("lines").alias("n"))  # a row an archive and task that wrote it
    before = parts.select("archive", "part", (F.sum("n").over(Window.partitionBy("archive").orderBy("part")) - F.col("n")).alias("before"))
    wanted = index.join(before, ["archive", "part"]).withColumn("first", F.col("before") + F.col("first"))
    if after is not None:
        wanted = wanted.where(F.col("first") + F.col("lines") > after + 1)
    dealt = wanted.select("archive", "file", "offset", "length", "first").repartition("file", F.floor(F.col("offset") / (16 << 20)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for name, file, offset, length, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_file(f"{root}/data/{file}") as f:
                    f.seek(offset)
                    body = zstandard.ZstdDecompressor().decompress(f.read(length)).decode()
                texts = [json.loads(line)["text"] for line in body.split("\n")[:-1]]
                texts = ["\n\n".join(t) if isinstance(t, list) else t for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(texts), pa.string()), pa.array(range(first, first + len(texts)), pa.int64()), pa.array(texts, pa.string())], ["archive", "place", "text"])

    lines = dealt.mapInArrow(run, "archive string, place long, text string")
    return lines if after is None else lines.where(F.col("place") > after)
