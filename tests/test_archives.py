"""Archives in frames, compressed files and array files: whole, in order, and the same when tasks fail or run again."""

import json
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from quernstone.sources import archives, frames


def rows(spark, n):
    """A third archive of two rows in three, a small one, an empty name, nulls."""
    at = [("big" if i % 3 else "small/é", i, f"line {i} " * (i % 40)) for i in range(n)] + [("one", 0, None), (None, 1, "nowhere"), ("", 5, "x\ny z")]
    return spark.createDataFrame(at, "archive string, n long, text string").repartition(5)


@pytest.fixture
def all_partitions(spark):
    """Small partitions stay apart, as large ones would."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_frames_come_back_in_order(spark, tmp_path, all_partitions):
    at = f"file://{tmp_path}/a"
    df = rows(spark, 3000)
    frames.write_frames(df, at, "archive", "text", ["n"], frame=2000)
    want = defaultdict(list)
    for r in sorted((r for r in df.collect() if r.archive is not None), key=lambda r: r.n):
        want[r.archive].append(r.text)
    got = defaultdict(dict)
    for r in frames.read_frames(spark, at).collect():
        assert r.place not in got[r.archive]
        got[r.archive][r.place] = r.text
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == want
    assert {r.archive: r["lines"] for r in frames.totals(spark, at).collect()} == {k: len(v) for k, v in want.items()}
    index = spark.read.parquet(f"{at}/index")
    assert index.where("archive = 'big'").select("part").distinct().count() > 1 and index.count() > 100
    files = [r.file for r in index.where("archive = 'big'").select("part", "file").distinct().orderBy("part").collect()]
    plain = b"".join((tmp_path / "a/data" / f).read_bytes() for f in files)
    with zstandard.ZstdDecompressor().stream_reader(plain, read_across_frames=True) as r:
        assert [json.loads(line)["text"] for line in r.read().decode().split("\n")[:-1]] == want["big"]


def test_frames_are_read_from_a_place_on(spark, tmp_path, all_partitions):
    at = f"file://{tmp_path}/a"
    frames.write_frames(rows(spark, 1500), at, "archive", "text", ["n"], frame=3000)
    whole = {r.place: r.text for r in frames.read_frames(spark, at, ["big"]).collect()}
    for f in (tmp_path / "a/data").iterdir():  # frames before the place aren't opened: spoil one
        first = spark.read.parquet(f"{at}/index").where((F.col("archive") == "big") & (F.col("file") == f.name)).orderBy("part", "first").first()
        if first is not None and first.part == spark.read.parquet(f"{at}/index").where("archive = 'big'").agg(F.min("part")).first()[0]:
            data = bytearray(f.read_bytes())
            data[: first.length] = b"\0" * first.length
            f.write_bytes(bytes(data))
    assert {r.place: r.text for r in frames.read_frames(spark, at, ["big"], after=600).collect()} == {p: t for p, t in whole.items() if p > 600}
    with pytest.raises(Exception):  # noqa: B017
        frames.read_frames(spark, at, ["big"]).collect()
    frames.write_frames(rows(spark, 9).where("false"), f"file://{tmp_path}/none", "archive", "text", ["n"])
    assert frames.read_frames(spark, f"file://{tmp_path}/none").collect() == []


def test_failed_write_is_no_archive(spark, tmp_path):
    df = rows(spark, 600)
    bad = df.withColumn("text", F.when(F.col("n") == 599, F.raise_error(F.lit("stop"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="stop"):
        frames.write_frames(bad, f"file://{tmp_path}/a", "archive", "text", ["n"], frame=500)
    frames.write_frames(df, f"file://{tmp_path}/b", "archive", "text", ["n"], frame=500)
    (tmp_path / "b/data/big-000000-rubble.jsonl.zst").write_bytes(b"half a frame")
    assert frames.read_frames(spark, f"file://{tmp_path}/b", ["big"]).count() == 400


def test_compressing_again_changes_nothing(spark, tmp_path):
    paths = []
    for i in range(3):
        (tmp_path / f"{i}.txt").write_text("line\n" * i * 1000)
        paths.append(f"{tmp_path}/{i}.txt")
    made = archives.compress_files(spark, paths)
    assert sorted((r.path.rsplit("/", 1)[-1], r["lines"]) for r in made.collect()) == [(f"{i}.txt.zst", i * 1000) for i in range(3)]
    assert made.count() == 3 and sorted(p.name for p in tmp_path.iterdir()) == [f"{i}.txt.zst" for i in range(3)]
    again = archives.compress_files(spark, paths)  # as after a crash of the caller
    assert sorted(r["lines"] for r in again.collect()) == [0, 1000, 2000]
    (tmp_path / "0.txt.zst").unlink()
    with pytest.raises(Exception):  # noqa: B017
        archives.compress_files(spark, paths)


def test_array_files_of_their_index(spark, tmp_path):
    at = f"file://{tmp_path}/v"
    vectors = [np.float32([i, -i, i / 7]).tolist() for i in range(500)]
    df = spark.createDataFrame([(v,) for v in vectors], "v array<float>").repartition(3)
    made = archives.array_files(df, "v", at, rows=64)
    assert made.agg(F.sum("n")).first()[0] == 500 and made.agg(F.max("n")).first()[0] == 64
    np.save(tmp_path / "v" / "rubble.npy", np.zeros((9, 3), np.float32))
    assert Counter(tuple(r.vector) for r in archives.read_arrays(spark, at).collect()) == Counter(map(tuple, vectors))
