"""Readers of corpora, extraction records, graphs, bundles and archives."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path, PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.relational import number_rows

CORPUS = "id string, text string, metadata map<string, string>"
TRIPLE = "array<struct<Head: string, Relation: string, Tail: string>>"
RECORD = f"id string, original_text string, metadata map<string, string>, entity_relation_dict {TRIPLE}, event_entity_dict array<struct<Event: string, Entity: array<string>>>, event_entity_relation_dict array<struct<Event: string, Entity: array<string>>>, event_relation_dict {TRIPLE}"
GRAPH_NODES = "key string, id string, type string, file_id string"
GRAPH_EDGES = "src string, dst string, relation string, type string"


def _hadoop_files(spark: SparkSession, folder: str) -> list[str]:
    """The files of a folder on whatever file system it is, by name."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(str(f.getPath().toString()) for f in found if f.isFile())


def corpus(spark: SparkSession, folder: str, prefix: str) -> DataFrame:
    """Documents from the files whose name starts with ``prefix`` and ends in .json or .jsonl, plain or .gz.

    A .json file holds one array over many lines, or an object a line: the first file tells for all. The
    language defaults to en.
    """
    names = [f for f in _hadoop_files(spark, folder) if PurePosixPath(f).name.startswith(prefix)]
    lines = [f for f in names if f.removesuffix(".gz").endswith(".jsonl")]
    arrays = [f for f in names if f.removesuffix(".gz").endswith(".json")]
    if arrays and not (spark.read.text(arrays[0]).first() or [""])[0].lstrip().startswith("["):
        lines, arrays = lines + arrays, []
    out = spark.createDataFrame([], CORPUS)
    if lines:
        out = out.unionByName(spark.read.schema(CORPUS).json(lines))
    if arrays:
        out = out.unionByName(spark.read.schema(CORPUS).option("multiLine", True).json(arrays))
    lang = F.coalesce(F.col("metadata")["lang"], F.lit("en"))
    return out.withColumn("lang", lang)


def extraction_records(spark: SparkSession, folder: str, part: str, first_files: int | None = None) -> DataFrame:
    """Extraction records from every file whose name contains ``part``, with their place (file, line).

    Lines that aren't JSON become rows of nulls but for ``corrupt``. Either name of the participation field counts.
    ``first_files`` takes the first files by name only. Each file is numbered on its own, so files are
    what scales; within one, lines keep their order.
    """
    names = [f for f in _hadoop_files(spark, folder) if part in PurePosixPath(f).name][:first_files]
    if not names:
        return spark.createDataFrame([], f"file int, line bigint, {RECORD}, corrupt string").drop("event_entity_relation_dict")
    order = F.create_map(*[F.lit(x) for i, f in enumerate(names) for x in (PurePosixPath(f).name, i)])
    text = spark.read.text(names, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), "value")
    lines = text.select(order[F.col("name")].alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "value")).where("value <> ''")
    parsed = lines.select("file", F.col("line").cast("long").alias("line"), F.from_json("value", f"{RECORD}, corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}).alias("r")).select("file", "line", "r.*")
    return parsed.withColumn("event_entity_dict", F.coalesce("event_entity_dict", "event_entity_relation_dict")).drop("event_entity_relation_dict")


def csv_table(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",") -> DataFrame:
    """A CSV with a header, quoted fields over many lines and doubled quotes."""
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("sep", sep).option("maxCharsPerColumn", -1)
    return (reader.schema(schema) if schema else reader).csv(path)


def header_probe(spark: SparkSession, path: str) -> tuple[list[str], list]:
    """A CSV's column names and first row."""
    head = csv_table(spark, path)
    return head.columns, [list(r) for r in head.limit(1).collect()]


def vectors_of_csv(spark: SparkSession, path: str, column: str = "embedding:STRING") -> DataFrame:
    """Only the vector column of a CSV, parsed to array<float>."""
    return csv_table(spark, path).select(F.from_json(F.col(f"`{column}`"), "array<float>").alias("embedding"))


def tsv_triples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").schema("h string, r string, t string").csv(path)


def ragged_steps(spark: SparkSession, path: str) -> DataFrame:
    """(action, object, step, event) of lines whose last two fields are action and object and all before them events."""
    fields = spark.read.text(path).select(F.split("value", "\t").alias("f")).where(F.size("f") >= 3)
    steps = F.posexplode(F.slice("f", F.lit(1), F.size("f") - 2)).alias("step", "event")
    return fields.select(F.element_at("f", -2).alias("action"), F.element_at("f", -1).alias("object"), steps)


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    """A document a Markdown file, id from its name."""
    files = spark.read.text(f"{folder}/*.md", wholetext=True)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return files.select(F.regexp_replace(name, r"\.md$", "").alias("id"), F.col("value").alias("text"), F.create_map(F.lit("lang"), F.lit("en")).alias("metadata"))


def zstd_json_lines(spark: SparkSession, paths: list[str], text_key: str = "text") -> DataFrame:
    """(file, line, text) of zstd-compressed JSON lines, streamed; a list of paragraphs is joined by blank lines.

    A file is one task's stream, as the format can't be split; its memory is one line.
    """
    import pyarrow.fs as fs

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        for pdf in batches:
            for number, uri in zip(pdf["file"], pdf["uri"], strict=True):
                store, path = fs.FileSystem.from_uri(uri)
                rows: list[tuple[int, int, str]] = []
                with store.open_input_file(path) as raw, zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True) as plain:
                    for at, line in enumerate(io.TextIOWrapper(plain, "utf-8")):
                        body = json.loads(line)
                        body = body[text_key] if isinstance(body, dict) else body
                        rows.append((number, at, "\n\n".join(body) if isinstance(body, list) else body))
                        if len(rows) == 500:
                            yield pd.DataFrame(rows, columns=["file", "line", "text"])
                            rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["file", "line", "text"])

    listed = spark.createDataFrame(list(enumerate(paths)), "file int, uri string").repartition(max(1, len(paths)))
    return listed.mapInPandas(run, "file int, line bigint, text string")


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a GraphML file by Spark's XML reader, keys resolved to their names."""
    data = "data array<struct<_key: string, _VALUE: string>>"
    keys = spark.read.format("xml").option("rowTag", "key").schema("_id string, `_attr.name` string").load(path).collect()
    names = F.create_map(*[F.lit(x) for k in keys for x in (k[0], k[1])]) if keys else F.create_map().cast("map<string, string>")

    def attributes(column: str):
        return F.map_from_entries(F.transform(F.coalesce(column, F.array().cast("array<struct<_key: string, _VALUE: string>>")), lambda d: F.struct(names[d["_key"]], d["_VALUE"])))

    nodes = spark.read.format("xml").option("rowTag", "node").schema(f"_id string, {data}").load(path).select(F.col("_id").alias("key"), attributes("data").alias("a"))
    edges = spark.read.format("xml").option("rowTag", "edge").schema(f"_source string, _target string, {data}").load(path).select(F.col("_source").alias("src"), F.col("_target").alias("dst"), attributes("data").alias("a"))
    return nodes.select("key", *[F.col("a")[c].alias(c) for c in ("id", "type", "file_id")]), edges.select("src", "dst", *[F.col("a")[c].alias(c) for c in ("relation", "type")])


MEMBER_BYTES = 1 << 30


def _files_below(spark: SparkSession, source: str) -> list[str]:
    """Every file of a folder and of those in it, or the file itself; only the paths are read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source).select("path")
    return sorted(r[0] for r in found.collect())


def _bytes_of(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def bundle(spark: SparkSession, source: str, members: dict[str, str]) -> dict[str, DataFrame]:
    """Tables of a ZIP or folder: ``members`` maps a table's name to the end of its file's name, of which there must be just one.

    JSON arrays, JSON lines and single objects all do; a member over 1 GiB is refused, and nothing is
    unpacked to disk. A bundle is one archive that the driver opens, on whatever file system it is.
    """
    files = _files_below(spark, source)
    if source.endswith(".zip"):
        archive = zipfile.ZipFile(io.BytesIO(_bytes_of(spark, files[0])))
        sizes = {i.filename: i.file_size for i in archive.infolist()}
        read = lambda name: archive.read(name)
    else:
        sizes = dict.fromkeys(files, 0)
        read = lambda name: _bytes_of(spark, name)
    out = {}
    for name, ending in members.items():
        found = [f for f in sizes if f.endswith(ending)]
        if len(found) != 1:
            raise ValueError(f"{len(found)} files end in {ending}")
        if sizes[found[0]] > MEMBER_BYTES:
            raise ValueError(f"{found[0]} is too large")
        out[name] = spark.createDataFrame([(json.dumps(r, ensure_ascii=False),) for r in json_rows(read(found[0]).decode())], "value string")
    return out


def questions(spark: SparkSession, path: str, schema: str, head: int | None = None) -> DataFrame:
    """(place, q): the objects of a JSON array file in their order, the first ``head`` if given."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", T.ArrayType(T.StructType.fromDDL(schema))).alias("q"))
    kept = F.slice("q", 1, head) if head is not None else F.col("q")
    return rows.select(F.posexplode(kept).alias("place", "q"))


def text_lines(spark: SparkSession, path: str, offset: int = 0, limit: int | None = None) -> DataFrame:
    """(line, value): the lines of a text file from number ``offset`` on, at most ``limit`` of them, by their place in the file."""
    at = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    place = number_rows(at, ["block", "id"], "line")
    return place.where((F.col("line") >= offset) & (F.lit(True) if limit is None else F.col("line") < offset + limit)).select("line", "value")


def stays_inside(name: Column) -> Column:
    """Whether a member's name leads nowhere out of the folder that it is unpacked to."""
    state = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least"))

    def step(s: Column, part: Column) -> Column:
        depth = s["depth"] + F.when(part == "..", -1).when(part.isin("", "."), 0).otherwise(1)
        return F.struct(depth.alias("depth"), F.least(s["least"], depth).alias("least"))

    return ~F.startswith(name, F.lit("/")) & (F.aggregate(F.split(name, "/"), state, step)["least"] >= 0)


def json_rows(text: str) -> list:
    """The objects of a JSON array, of JSON lines, or of a single object."""
    try:
        value = json.loads(text)
    except json.JSONDecodeError:
        return [json.loads(line) for line in text.splitlines() if line.strip()]
    return value if isinstance(value, list) else [value]


def safe_extract(archive: str, folder: str) -> list[str]:
    """Unpack a ZIP, refusing names that lead out of ``folder``."""
    root = Path(folder).resolve()
    with zipfile.ZipFile(archive) as z:
        for name in z.namelist():
            if not (root / name).resolve().is_relative_to(root):
                raise ValueError(f"{name} leads out of the folder")
        z.extractall(root)
        return z.namelist()


def numbered_page(offset: int, size: int, rows: int = 230) -> list[dict]:
    """A stand-in for a paged service: numbered rows, the last page short."""
    return [{"n": n} for n in range(offset, min(offset + size, rows))]


class PagedSource(DataSource):
    """A service that gives rows by page: one partition a page, read until a short page.

    Options: ``pages`` (how many to plan), ``size`` (rows a page), and ``fetch``, the import path ``module:function``
    of ``fetch(offset, size) -> list of dicts``.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "page int, row string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _PagedReader(self.options)


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.pages, self.size, self.where = int(options.get("pages", 1)), int(options.get("size", 100)), options["fetch"]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.pages)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import importlib

        module, _, function = self.where.partition(":")
        fetch: Callable = getattr(importlib.import_module(module), function)
        for row in fetch(partition.value * self.size, self.size):
            yield partition.value, json.dumps(row, ensure_ascii=False)
