"""The neighbour graph and the transactional buckets: recall, restarts after kills, equal to what never stopped."""

import os
import signal
import subprocess
import sys
import textwrap
import time
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.operators import neighbour_graph as NG
from quernstone.operators import search as S
from quernstone.plans import views as V
from quernstone.sources import buckets


def test_graph_search_recall(spark, tmp_path):
    sf = "/root/testdata/sf0.1"
    vectors, questions = V.vectors(spark, sf), V.vector_questions(spark, sf)
    NG.save_graph(vectors, f"file://{tmp_path}/graph")
    found = NG.search_graph(spark, f"file://{tmp_path}/graph", questions, 5).collect()
    exact = {(r.qid, r.vec_id) for r in S.top_k(vectors, questions, 5).collect()}
    assert len(found) == len(exact) and sum((r.qid, r.vec_id) in exact for r in found) >= 0.95 * len(exact)
    n, scored = vectors.count(), {r.qid: r.scored for r in found}
    assert sum(scored.values()) < 0.1 * n * len(scored)
    by = defaultdict(list)
    for r in sorted(found):
        by[r.qid].append(r)
    assert all([r.rank for r in rs] == [1, 2, 3, 4, 5] and rs == sorted(rs, key=lambda r: -r.score) for rs in by.values())
    lists = spark.read.parquet(f"file://{tmp_path}/graph/nodes").select(F.size("neighbours").alias("n")).agg(F.max("n"), F.min("n"), F.count("*")).first()
    assert lists[0] <= 17 and lists[1] >= 1 and lists[2] == n


def test_graph_links_are_nearly_exact(spark):
    rng = np.random.default_rng(2)
    m = rng.standard_normal((400, 12))
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(None, m[0].tolist()), (1000, None), (3, m[3].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    links = {(r.u, r.v) for r in NG.neighbour_links(df, neighbours=12).collect()}
    m = m.astype(np.float32).astype(float)
    s = m @ m.T
    np.fill_diagonal(s, -np.inf)
    want = {(i, int(j)) for i in range(400) for j in np.argsort(-s[i])[:8]}
    assert len(links) == 4800 and len(links & want) >= 0.97 * 3200


def test_graph_of_copies_and_of_nothing(spark, tmp_path):
    """A third of all rows alike: lists stay bounded, and the walk gets out of them."""
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(300)] + [(1000 + i, [float(np.cos(i / 99)), float(np.sin(i / 99)), 0.1]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    NG.save_graph(df, f"file://{tmp_path}/g", neighbours=6)
    asked = spark.createDataFrame([(1, [0.0, 1.0, 0.0])], "qid long, query array<double>")
    got = NG.search_graph(spark, f"file://{tmp_path}/g", asked, 3, beam=10).collect()
    assert len(got) == 3 and all(r.score > 0.99 for r in got)
    NG.save_graph(df.where("false"), f"file://{tmp_path}/none")
    assert NG.search_graph(spark, f"file://{tmp_path}/none", asked, 3).collect() == []


ROWS = "bucket int, word string"


def words(n):
    return [(i % 7, f"w{i}") for i in range(n)]


def test_batches_in_buckets(spark, tmp_path):
    at = f"file://{tmp_path}/b"
    df = spark.createDataFrame(words(1000), ROWS).repartition(4)
    buckets.write_buckets(df, at, "first")
    buckets.write_buckets(df, at, "first")  # once, however often
    buckets.write_buckets(spark.createDataFrame(words(10), ROWS), at)
    want = Counter(words(1000) + words(10))
    assert Counter(map(tuple, buckets.read_buckets(spark, at, ROWS).collect())) == want
    some = buckets.read_buckets(spark, at, ROWS, [2, 5]).collect()
    assert Counter(map(tuple, some)) == Counter({k: n for k, n in want.items() if k[0] in (2, 5)})
    assert buckets.read_buckets(spark, f"file://{tmp_path}/nothing", ROWS).count() == 0
    buckets.write_buckets(df.where("false"), at)
    assert buckets.read_buckets(spark, at, ROWS).count() == 1010


def test_failed_batch_leaves_nothing(spark, tmp_path):
    at = f"file://{tmp_path}/b"
    df = spark.createDataFrame(words(1000), ROWS).repartition(4)
    buckets.write_buckets(df, at)
    bad = df.withColumn("word", F.when(F.col("word") == "w999", F.raise_error(F.lit("no"))).otherwise(F.col("word")))
    with pytest.raises(Exception, match="no"):
        buckets.write_buckets(bad, at)
    store = buckets.Store(buckets.qualified(spark, at))
    assert buckets.read_buckets(spark, at, ROWS).count() == 1000
    (tmp_path / "b/data/rubble").write_bytes(b"half a segment")
    long = next(iter(store.committed()))
    with open(tmp_path / "b/data" / long, "ab") as f:
        f.write(b"a tail that no manifest counts")
    assert buckets.read_buckets(spark, at, ROWS).count() == 1000
    assert "rubble" in store.recover() and set(store.names("data")) == set(store.committed())
    buckets.write_buckets(spark.createDataFrame(words(5), ROWS), at)
    assert buckets.read_buckets(spark, at, ROWS).count() == 1005


STREAM = """
    import sys, time
    sys.path.insert(0, {repo!r})
    from pyspark.sql import SparkSession, functions as F
    from quernstone.sources import buckets
    from quernstone.streaming import ingest
    spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", "file://{at}/shared").getOrCreate()
    stream = ingest.read_folder(spark, "file://{at}/in", "bucket int, word string", 1)
    if {slow}:
        stream = stream.mapInPandas(lambda batches: (time.sleep(0.4) or b for b in batches), "bucket int, word string")
    buckets.stream_buckets(stream, "file://{at}/{out}", "file://{at}/{out}-checkpoint")
"""


def test_killed_stream_goes_on(spark, tmp_path):
    """A stream killed hard between batches' commits, then started again, has each row once, as one that never stopped."""
    spark.createDataFrame(words(4000), ROWS).repartition(8).write.parquet(f"file://{tmp_path}/in")
    repo = str(Path(__file__).resolve().parents[1])

    def start(out, slow):
        code = textwrap.dedent(STREAM.format(repo=repo, at=tmp_path, out=out, slow=slow))
        return subprocess.Popen([sys.executable, "-c", code], stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, start_new_session=True)

    killed = start("a", True)
    commits = tmp_path / "a/commits"
    until = time.time() + 120
    while time.time() < until and not (commits.exists() and len([f for f in commits.iterdir() if f.suffix == ".json"]) >= 2):
        time.sleep(0.05)
    os.killpg(killed.pid, signal.SIGKILL)
    killed.wait()
    done = len(list(commits.glob("batch-*.json")))
    assert 2 <= done < 8
    (tmp_path / "a/data/stream-rubble").write_bytes(b"cut off")
    assert start("a", False).wait(timeout=180) == 0
    assert start("b", False).wait(timeout=180) == 0
    read = lambda out: Counter(map(tuple, buckets.read_buckets(spark, f"file://{tmp_path}/{out}", ROWS).collect()))
    assert read("a") == read("b") == Counter(words(4000))
    assert not (tmp_path / "a/data/stream-rubble").exists() and len(list(commits.glob("batch-*.json"))) == 8


def test_latest_table_of_a_stream(spark, tmp_path):
    """An aggregate over several batches, gone on with after more has come, is that of all rows; without any it is empty."""
    from quernstone.streaming import ingest

    at = f"file://{tmp_path}/s"
    run = lambda: {r.bucket: r.n for r in ingest.latest_table(ingest.read_folder(spark, f"{at}/in", ROWS, 1).groupBy("bucket").agg(F.count("*").alias("n")), f"{at}/out", f"{at}/checkpoint").collect()}
    (tmp_path / "s/in").mkdir(parents=True)
    assert run() == {}
    for n in (100, 40):
        spark.createDataFrame(words(n), ROWS).repartition(3).write.mode("append").parquet(f"{at}/in")
        found = run()
    assert found == Counter(b for b, _ in words(100) + words(40))
