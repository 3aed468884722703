"""Counts without their pairs, searches without their scores: the same results as brute force, and no rows that grow with the square."""

import os
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quernstone.operators import graph as G
from quernstone.operators import search as S
from quernstone.operators import shape as H


def _random_edges(spark, seed, nodes=25, n=120):
    rng = np.random.default_rng(seed)
    rows = [(f"n{a}", f"n{b}", f"r{r}") for a, b, r in zip(rng.integers(0, nodes, n), rng.integers(0, nodes, n), rng.integers(0, 2, n), strict=True)]
    return rows, spark.createDataFrame(rows, "src string, dst string, relation string")


def test_hop_counts(spark):
    """Arrays, and rows for the questions of many steps, count what shortest_hops lists."""
    rows, edges = _random_edges(spark, 1)
    seeds = edges.select(F.col("src").alias("qid"), F.col("src").alias("name"))
    for cutoff in (1, 3):
        want = {r.hop: r["count"] for r in G.shortest_hops(edges, seeds, cutoff).groupBy("hop").count().collect()}
        for held in (1_000_000, 12):
            assert {r.hop: r.pairs for r in G.hop_counts(edges, cutoff, held).collect()} == want
    assert G.hop_counts(edges.where("false"), 2).collect() == []


def test_two_step_paths(spark):
    rows, edges = _random_edges(spark, 2)
    for both_ways in (False, True):
        starts = edges.select(F.col("src").alias("qid"), F.col("src").alias("name")).unionAll(edges.select("dst", "dst"))
        want = G.paths(edges, starts, 2, both_ways=both_ways).where(F.size("nodes") == 3).count()
        assert G.two_step_paths(edges, both_ways).collect()[0].paths == want > 0
    hub = spark.range(100_000).select(F.concat(F.lit("n"), "id").alias("src"), F.lit("hub").alias("dst"), F.lit("").alias("relation"))
    assert G.two_step_paths(hub, True).first().paths == 100_000 * 99_999  # a row a path would not end
    assert G.two_step_paths(hub.where("false")).first().paths == 0


def test_triangles_open_no_wedge_between_hubs(spark):
    rows, edges = _random_edges(spark, 3)
    links = {frozenset((a, b)) for a, b, _ in rows if a != b}
    names = sorted({n for e in links for n in e})
    want = Counter(x for i, x in enumerate(names) for y in names for z in names if y < z and {frozenset((x, y)), frozenset((x, z)), frozenset((y, z))} <= links)
    assert {r["name"]: r.triangles for r in G.triangles(edges).collect() if r.triangles} == dict(want)
    shared = spark.range(300).crossJoin(spark.range(40).toDF("h")).select(F.concat(F.lit("n"), "id").alias("src"), F.concat(F.lit("hub"), "h").alias("dst"))
    up = G.upward_edges(G.undirected(shared))
    assert up.count() == 12_000 and up.join(up.select(F.col("u").alias("v")), "v", "left_semi").count() == 0
    assert G.triangle_corners(up).count() == 0


def test_probed_search_keeps_best_of_probed_cells(spark, tmp_path):
    """Exact among the probed cells, ties to the larger id, and no row a question and vector."""
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.standard_normal((200, 8)), np.repeat(rng.standard_normal((1, 8)), 40, 0)])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))
    S.save_index(df, f"file://{tmp_path}/index", 6)
    want = {(r.qid, r.rank, r.vec_id) for r in S.top_k(df, asked, 7).collect()}
    found = S.search_index(spark, f"file://{tmp_path}/index", asked, 7, probes=6)
    assert {(r.qid, r.rank, r.vec_id) for r in found.collect()} == want
    assert "MapInPandas" in found._jdf.queryExecution().toString()  # kept in the task, not scored as joined rows
    named = df.select(F.concat(F.lit("v"), F.lpad(F.col("vec_id").cast("string"), 3, "0")).alias("vec_id"), "embedding")
    S.save_index(named, f"file://{tmp_path}/named", 6)
    assert {(r.qid, r.rank, int(r.vec_id[1:])) for r in S.search_index(spark, f"file://{tmp_path}/named", asked, 7, probes=6).collect()} == want
    at = np.array([r.centroid for r in spark.read.parquet(f"file://{tmp_path}/index/centroids").orderBy("cell").collect()])
    cell = (v @ at.T).argmax(1)
    got = S.search_index(spark, f"file://{tmp_path}/index", asked, 7, probes=2).collect()
    for q in range(0, 240, 20):
        rows = [i for i in range(240) if cell[i] in np.argsort(-(v[q] @ at.T), kind="stable")[:2]]
        best = sorted(rows, key=lambda i: (-round(float(v[i] @ v[q]), 9), -i))[:7]
        assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.qid == q] == best


def test_build_shares_its_triples(spark):
    """Every table of a build reads the written triples or nodes; none extracts them again."""
    from quernstone.operators import build as B
    from quernstone.plans.io_queries import _records

    made = B.tables(_records(spark, "/root/testdata/sf0.001"))
    assert all("entity_relation_dict" not in made[t]._jdf.queryExecution().optimizedPlan().toString() for t in ("nodes", "edges", "mentions", "worklist"))


def test_build_records_hold_whole_texts(spark, tmp_path):
    """Every line of a text is in its record's triples as a whole, and every line but the first takes part in its event."""
    from quernstone.plans.io_queries import _records

    text = "one two three four\n\n five  six seven\nlast line of all\nend"
    spark.createDataFrame([(1, text, "en", "web", len(text)), (2, "a single line", "en", "web", 13)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    r, single = _records(spark, f"file://{tmp_path}").orderBy("line").collect()
    lines = ["one two three four", "five six seven", "last line of all", "end"]
    assert [(t.Head, t.Tail) for t in r.entity_relation_dict] == list(zip(lines, lines[1:]))
    assert [(e.Event, e.Entity) for e in r.event_entity_dict] == [(lines[0], lines[1:])]
    assert single.entity_relation_dict == [] and [(e.Event, e.Entity) for e in single.event_entity_dict] == [("a single line", [])]


def test_three_cycles_make_no_paths_between_hubs(spark):
    rows, edges = _random_edges(spark, 5)
    e = {(a, b) for a, b, _ in rows}
    names = sorted({n for r in e for n in r})
    three = sum((a, b) in e and (b, c) in e and (c, a) in e for a in names for b in names for c in names if a < b and a < c and b != c)
    two = sum((a, b) in e and (b, a) in e for a in names for b in names if a < b)
    assert {r.length: r.cycles for r in H.simple_cycles(edges, 3).collect()} == {1: sum(a == b for a, b in e), 2: two, 3: three} and three
    hubs = spark.range(3000).crossJoin(spark.range(40).toDF("h")).select(F.concat(F.lit("n"), "id").alias("src"), F.concat(F.lit("hub"), "h").alias("dst"))
    both = hubs.unionAll(hubs.select("dst", "src"))
    assert {r.length: r.cycles for r in H.simple_cycles(both, 3).collect()} == {1: 0, 2: 120_000, 3: 0}  # paths of two steps would be 180 million


def test_written_tables_leave_no_shuffle_files(spark):
    """A cut's shuffle files go with it, and the setting that does it is left as it was; a discarded table's files go too."""
    from quernstone.functions import scratch

    jvm, before = spark._jvm.org.apache.spark.SparkEnv, spark.conf.get(scratch.CLEANUP, None)
    held = lambda: jvm.get().mapOutputTracker().shuffleStatuses().size()
    n = held()
    table = scratch.cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "kept")
    assert held() <= n and spark.conf.get(scratch.CLEANUP, None) == before
    assert table.count() == 7
    at = table.inputFiles()[0].removeprefix("file://")
    scratch.discard(table)
    assert not os.path.exists(at)


def test_an_edge_moves_once_to_each_end(spark, monkeypatch):
    """Triangles join half of what both directions are, and of the tables of a search for cycles one of the edges is left."""
    plans, real = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df, name: plans.append((name, df)) or real(df, name))
    rows, edges = _random_edges(spark, 12)
    pairs = {(min(a, b), max(a, b)) for a, b, _ in rows if a != b}
    assert sum(r.degree for r in G.triangles(edges).collect()) == 2 * len(pairs)
    assert next(df.count() for name, df in plans if name == "simple-pairs") == len(pairs)
    gone, real_discard = [], H.discard
    monkeypatch.setattr(H, "discard", lambda table: gone.append(table.inputFiles()) or real_discard(table))
    H.simple_cycles(edges, 3).collect()
    assert gone and all(not os.path.exists(f.removeprefix("file://")) for files in gone for f in files)


def test_sketches_are_not_broadcast(spark, monkeypatch):
    """However small their files, tables of sketches and of reached nodes are merged: the driver holds none."""
    plans, real = [], H.cut
    monkeypatch.setattr(H, "cut", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or real(df, name))
    _, edges = _random_edges(spark, 6)
    H.path_lengths(edges)
    H.diameter(edges)
    assert len([n for n, p in plans if n == "reach"]) > 1 and not [n for n, p in plans if "BroadcastHashJoin" in p]


def test_sketches_are_united_in_tasks(spark, monkeypatch):
    """A round joins a node's sketch with its list of neighbours, never with a row an edge; unions are right where runs end in a batch or outgrow it."""
    import pyarrow as pa

    plans, real = [], H.cut
    monkeypatch.setattr(H, "cut", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or real(df, name))
    _, edges = _random_edges(spark, 9)
    H.neighbourhood_function(edges)
    rounds = [p for n, p in plans if n == "reach"][1:]
    assert rounds and all("hll" not in p and "to#" in p and "MapInArrow" in p for p in rounds)
    rng = np.random.default_rng(9)
    sketches = rng.integers(0, 30, (500, 1 << H.REGISTERS)).astype(np.uint8)
    ids = np.sort(np.append(rng.integers(0, 40, 200), [7] * 300))
    starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    want = np.maximum.reduceat(sketches, starts)
    assert (H._unions(sketches, starts) == want).all()
    own = np.isin(np.arange(500), starts)
    batch = pa.RecordBatch.from_arrays([pa.array(ids), H._sketch_column(sketches), pa.array(own)], ["u", "sketch", "own"])
    monkeypatch.setattr(H, "UNITED", 16)
    got = pa.Table.from_batches(H._united(iter([batch.slice(0, 111), batch.slice(111)])))
    assert got["u"].to_pylist() == ids[starts].tolist()
    assert (H._matrix(got["sketch"].combine_chunks()) == want).all()
    assert got["grew"].to_pylist() == (want != sketches[starts]).any(axis=1).tolist()


def test_restarted_buckets_fill_every_core(spark, monkeypatch, tmp_path):
    """A batch takes as many files as tasks run at once, not one after the other."""
    from quernstone.plans import io_queries as Q

    docs = [(i, " ".join(f"w{i % 9} x{j}" for j in range(20)), "en", "web", 9) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(6).write.option("parquet.block.size", 1024).parquet(f"file://{tmp_path}/documents.parquet")
    batches, real = [], Q.buckets.stream_buckets
    monkeypatch.setattr(Q.buckets, "stream_buckets", lambda stream, out, checkpoint: (real(stream, out, checkpoint), batches.append((out, checkpoint))))
    got = Q.z4(spark, f"file://{tmp_path}").agg(F.sum("n")).first()[0]
    assert got == 60 * 28
    (out, checkpoint), = set(batches)
    files = len(spark.read.parquet(f"{out.removesuffix('/out')}/in").inputFiles())
    commits = spark.read.format("binaryFile").load(f"{checkpoint}/commits").count()
    assert files > 4 and len(batches) == 2 and commits <= 2 * -(-files // 2 // spark.sparkContext.defaultParallelism)


def test_many_vectors_are_not_broadcast(spark, monkeypatch, tmp_path):
    """What questions ask of a round is bounded in bytes, not rows, before it goes through the driver; results are the same."""
    from quernstone.operators import neighbour_graph as NG

    v = np.random.default_rng(11).standard_normal((300, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))
    NG.save_graph(df, f"file://{tmp_path}/graph", neighbours=6)
    want = NG.search_graph(spark, f"file://{tmp_path}/graph", asked, 3).collect()
    bounds, real = [], NG.few
    monkeypatch.setattr(NG, "few", lambda rows, most=1_000_000: bounds.append((rows.columns, most)) or real(rows, most))
    monkeypatch.setattr(NG, "SENT", 4 * 128)
    assert sorted(NG.search_graph(spark, f"file://{tmp_path}/graph", asked, 3).collect()) == sorted(want)
    assert {most for columns, most in bounds if "query" in columns} == {4}


def test_bucket_totals_move_no_grams(spark):
    """Equal to distinct counts, null documents included; a gram is never copied for each of them."""
    from quernstone.plans.io_queries import _bucket_totals

    rows = [(1, "a b", 1), (1, "a b", 2), (1, "c", 2), (2, "d", None), (2, "d", 3), (2, "d", 3)]
    got = _bucket_totals(spark.createDataFrame(rows, "bucket int, gram string, doc_id long"))
    assert sorted(map(tuple, got.collect())) == [(1, 3, 2, 2), (2, 3, 1, 1)]
    assert "Expand" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_names_are_compared_by_bags(spark):
    """Bounds hold for every pair, and 1,000 terms meet their own bags among 20,000 names, not all of them."""
    from quernstone.operators import retrieval as Q

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    rng = np.random.default_rng(8)
    word = lambda n: "".join(rng.choice(list("abcdé\U0001f600"), int(n)))
    for most in (6, 14, 30, 80):
        terms, names = ([word(n) for n in rng.integers(0, most, 100)] for _ in range(2))
        want = [1.0 if len(a) > Q.BITS or not a + b else 2 * longest(a, b) / (len(a) + len(b)) for a, b in zip(terms, names, strict=True)]
        assert np.allclose(Q.common_bounds(terms, names), want)
    wanted = spark.range(1000).select(F.concat(F.lit("suplier "), "id").alias("term"))
    names = spark.range(10_000).select(F.concat(F.lit("supplier "), "id").alias("name")).unionAll(spark.range(10_000).select(F.concat(F.lit("order "), "id")))
    bags = names.select(Q._bag("name").alias("bag")).distinct()
    asked = [r[0] for r in wanted.select(Q._bag("term")).distinct().collect()]
    assert bags.count() < 2100 and len(asked) < 300 and Q.bag_bounds(bags, asked, 0.8).count() < 100_000
    got = {r.term: r["name"] for r in Q.link_names(wanted, names).collect()}
    assert got == {f"suplier {i}": f"supplier {i}" for i in range(1000)}


def test_walks_number_only_where_they_are(spark, monkeypatch):
    """Neighbours far from every walk are neither numbered nor ordered, and mentions of other names aren't gathered."""
    from quernstone.operators import seeded as W

    far = spark.range(5000).select(F.concat(F.lit("far "), "id").alias("src"), F.concat(F.lit("far "), F.col("id") * 7 % 5000).alias("dst"))
    near = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d")], "src string, dst string")
    starts = spark.createDataFrame([(1, "a", 0), (2, "c", 1)], "qid long, name string, number long")
    alone = {tuple(r) for r in G.walk_sample(near, starts, 10, 3, 0.4, 7).collect()}
    written, real = [], G.cut
    for module in (G, W):
        monkeypatch.setattr(module, "cut", lambda df, name: written.append((name, real(df, name))) or written[-1][1])
    both = near.unionAll(far)
    assert {tuple(r) for r in G.walk_sample(both, starts, 10, 3, 0.4, 7).collect()} == alone
    links = W.sampled_links(both, spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "a")], "sid long, name string"))
    assert {tuple(r) for r in links.collect()} == {(1, "a", "b"), (1, "b", "a"), (2, "a", "c"), (2, "c", "a")}
    assert {n for n, _ in written} >= {"walk-neighbours", "sample-edges"} and max(df.count() for _, df in written) < 100


def test_ranks_walk_links_placed_once(spark, monkeypatch):
    """As walked over all nodes by hand; later rounds leave out the links of nodes that nothing leads to, and don't shuffle links."""
    plans, real = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString(), real(df, name))) or plans[-1][2])
    rows = [(f"o{i}", f"p{i % 3}") for i in range(60)] + [("p0", "s"), ("p1", "s"), ("s", "p2"), ("p2", None), (None, "s"), ("p0", "s")]
    edges = spark.createDataFrame(rows, "src string, dst string")
    seeds = spark.createDataFrame([(1, "o1", 2.0), (1, "p0", 1.0), (2, "s", 1.0), (2, "none", 5.0)], "qid long, name string, weight double")
    got = {(r.qid, r["name"]): r["rank"] for r in G.personalised_pagerank(edges, seeds, 0.9, 4).collect()}
    links = {(a, b) for a, b in rows if a is not None}
    out = Counter(a for a, _ in links)
    names = {x for e in rows for x in e}
    for qid, p in ((1, {"o1": 2 / 3, "p0": 1 / 3}), (2, {"s": 1.0})):
        x = dict.fromkeys(names, 1 / len(names))
        for _ in range(4):
            lost = sum(v for n, v in x.items() if not out[n]) + sum(x[a] / out[a] for a, b in links if b is None)
            x = {n: 0.9 * (sum(x[a] / out[a] for a, b in links if b == n and n is not None) + lost * p.get(n, 0)) + 0.1 * p.get(n, 0) for n in names}
        for (q, n), rank in got.items():
            if q == qid:
                assert abs(rank - x[n]) < 1e-12, (q, n)
    assert {n for q, n in got if q == 1} == {"o1", "p0", "p1", "p2", "s"}
    assert [df.count() for n, _, df in plans if n == "ppr-links"] == [64, 5]
    assert all("InMemoryTableScan" in p for n, p, _ in [x for x in plans if x[0] == "ppr-flow"][1:])


def test_search_holds_few_scores():
    """The best columns as a stable sort by rounded scores has them, ties and NaN among them; only those near the best are sorted."""
    rng = np.random.default_rng(9)
    for shape in ((50, 40), (3, 2), (20, 400)):
        scores = rng.integers(0, 9, shape) / 8 + rng.integers(-1, 2, shape) * 1e-12
        scores[0, :2] = np.nan
        rounded = np.where(np.isnan(scores), -np.inf, np.round(scores, 9))
        assert (S.best_columns(scores, 5) == np.argsort(-rounded, axis=1, kind="stable")[:, :5]).all()


def test_search_multiplies_in_bounded_blocks(spark, monkeypatch):
    rng = np.random.default_rng(10)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.integers(-2, 3, (300, 4)).astype(float))], "vec_id long, embedding array<double>")
    asked = df.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))
    want = S.top_k(df, asked, 6).collect()
    monkeypatch.setattr(S, "HELD_SCORES", 700)
    assert sorted(S.top_k(df, asked, 6).collect()) == sorted(want) and len(want) == 1800


def test_neighbours_propose_in_slices(spark):
    """Proposals as by hand from every list, however few lists a task compares at once."""
    from quernstone.operators import neighbour_graph as NG

    rng = np.random.default_rng(11)
    v = rng.standard_normal((300, 4)).astype(np.float32)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<float>")
    links = [(u, int(w), float(v[u].astype(float) @ v[w].astype(float)), True) for u in range(300) for w in rng.choice(300, 3, replace=False) if u != w]
    df = spark.createDataFrame(links, "u long, v long, score double, new boolean")
    worst, count, around = {}, Counter(u for u, *_ in links), {}
    for a, b, score, _ in links:
        worst[a] = min(worst.get(a, np.inf), score)
        around.setdefault(a, set()).add(b)
        around.setdefault(b, set()).add(a)
    limit = {n: worst[n] if count[n] >= 30 else -np.inf for n in range(300)}
    score = lambda a, b: float(v[a].astype(float) @ v[b].astype(float))
    want = Counter((a, b) for near in around.values() for a in near for b in near if a != b and score(a, b) > limit[a])
    joined = NG._joined(df, rows, 30, 0)
    got = joined.collect()
    assert Counter((r.u, r.v) for r in got) == want and all(abs(r.score - score(r.u, r.v)) < 1e-9 for r in got)
    assert "MapInArrow" in joined._jdf.queryExecution().optimizedPlan().toString() and NG.LISTS <= 1000


def _below(plan, what, parent):
    """Whether a line of a plan with ``what`` lies below one that begins with ``parent``."""
    over = []
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        over = [(d, t) for d, t in over if d < depth]
        if what in line and any(t.startswith(parent) for _, t in over):
            return True
        over.append((depth, line[depth:]))
    return False


def test_assembled_edges_move_names(spark):
    """Of parallel edges the first, whatever ids the mentions have; names are told apart first and hashed after they have moved."""
    from hashlib import sha256

    nodes = spark.createDataFrame([("a", "entity"), ("b", "event")], "name string, type string")
    texts = spark.createDataFrame([("t1", "text")], "text_id string, original_text string")
    edges = spark.createDataFrame([("a", "b", "later", 9), ("a", "b", "first", 2), ("b", "a", "back", 5)], "src string, dst string, relation string, pos long")
    mentions = spark.createDataFrame([("a", "t1"), ("a", "t1"), ("b", "t1")], "name string, text_id string")
    concepts = spark.createDataFrame([("a", "c"), ("a", "c"), ("none", "c")], "name string, concept string")
    h = lambda x, kind: sha256(f"{x}_{kind}".encode()).hexdigest()
    a, b = h("a", "entity"), h("b", "entity")
    found = G.assemble(nodes, texts, edges, mentions, concepts)[1]
    want = [(a, b, "first", "Relation"), (b, a, "back", "Relation"), (a, "t1", "mention in", "Source"), (b, "t1", "mention in", "Source"), (a, h("c", "concept"), "has_concept", "Concept")]
    assert sorted(map(tuple, found.select("src", "dst", "relation", "type").collect())) == sorted(want)
    assert not _below(found._jdf.queryExecution().optimizedPlan().toString(), "sha2(", "Aggregate")


def test_first_sights_and_typed_edges(spark):
    """Nodes by hash aggregation where their order is a number; edges between types are joined twice, not four times, and targets move as counts."""
    rows = [(7, "a", "b", "event", "entity", 1), (3, "b", "a", "event", "entity", 2), (3 + 1, "b", "c", "entity", "entity", 3), (9, "c", "c", "event", "other", 4), (9 + 1, "d", "a", "event", "entity", 5)]
    triples = spark.createDataFrame(rows, "at long, head string, tail string, head_type string, tail_type string, doc long")
    for order in (F.col("at"), F.struct("at")):
        nodes = G.first_seen_nodes(triples, order)
        assert {tuple(r) for r in nodes.collect()} == {("a", "entity", 2), ("b", "event", 2), ("c", "entity", 3), ("d", "event", 5)}
    plan = G.first_seen_nodes(triples, F.col("at"))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[name" in plan and not any("SortAggregate" in line and "side" in line.partition("keys=")[2].partition("]")[0] for line in plan.splitlines())
    _, edges = _random_edges(spark, 12)
    e = {(r.src, r.relation, r.dst) for r in edges.collect()}
    types = {f"n{i}": "xy"[i % 2] for i in range(20)}  # five names have none
    named = spark.createDataFrame(list(types.items()), "name string, type string")
    want = Counter((types[a], r, types[b]) for a, r, b in e if a in types and b in types)
    got = G.typed_counts(edges.unionAll(edges), named)
    assert {tuple(r)[:3]: r.edges for r in got.collect()} == dict(want)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2


def test_induced_edges_are_counted_where_they_are_placed(spark):
    rows, edges = _random_edges(spark, 13)
    named = spark.createDataFrame([(f"n{i}",) for i in range(15)], "name string")
    inside = {f"n{i}" for i in range(15)}
    want = Counter((a, r, b) for a, b, r in rows if a in inside and b in inside)
    got = G.induced_counts(edges, named)
    assert {tuple(r)[:3]: r.n for r in got.collect()} == dict(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert [line.lstrip(" :+-").split()[0] for line in plan if "Join" in line or "Aggregate" in line] == ["Join", "Aggregate", "Join"]


def _gram_rows(spark, seed):
    """Rows with null texts and keys, keys of several texts, copies and a text of one word again and again."""
    rng = np.random.default_rng(seed)
    texts = [" ".join(rng.choice(list("abc"), int(n))) for n in rng.integers(0, 12, 60)] + ["A, b. c"] * 5 + ["a " * 40, None, "c c c"]
    keys = [None if i % 17 == 5 else i // 3 if i % 4 == 0 else i + 100 for i in range(len(texts))]
    words = [[] if t is None else "".join(c for c in t.lower() if c not in ",.").split() for t in texts]
    grams = [(k, " ".join(w[i : i + 3])) for k, w in zip(keys, words, strict=True) for i in range(len(w) - 2)]
    return spark.createDataFrame(list(zip(keys, texts, strict=True)), "doc_id long, text string"), grams


def test_frequent_grams_move_once(spark, monkeypatch):
    """As SQL counts them: keys of several rows once, null keys never; grams are strings only in one document each."""
    from quernstone.operators import decontamination as D

    docs, grams = _gram_rows(spark, 14)
    seen = Counter(g for _, g in {(k, g) for k, g in grams if k is not None})
    for held in (D.HELD_GRAMS, 20):
        monkeypatch.setattr(D, "HELD_GRAMS", held)
        monkeypatch.setattr(D, "STRETCH", held)
        for above in (1, 3):
            for df in (docs, docs.repartition(3)):
                got = D.frequent_grams(df, 3, above).collect()
                assert len(got) == len({r.gram for r in got}) and {r.gram: r.docs for r in got} == {g: k for g, k in seen.items() if k > above}
    same = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"))
    monkeypatch.undo()
    assert D.task_counts(same.coalesce(2), 3, "doc_id", "text").count() <= 4  # a gram that all rows have is a row a task
    assert {(r.gram, r.docs) for r in D.frequent_grams(same, 3, 1).collect()} == {("a b c", 2000), ("b c d", 2000)}


def test_gram_totals_are_placed_once(spark):
    from quernstone.operators import decontamination as D

    docs, grams = _gram_rows(spark, 15)
    got = D.gram_counts(docs, 3)
    assert tuple(got.first()) == (len(grams), len({g for _, g in grams}))
    assert tuple(D.gram_counts(docs.where("false"), 3).first()) == (0, 0)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and _below(plan, "MapInArrow", "Exchange") and not _below(plan, "HashAggregate(keys=[h0", "Exchange hashpartitioning")


def test_colliding_hashes_stay_apart():
    from quernstone.operators import decontamination as D

    rows, h0, h1 = np.array([0, 0, 0, 1, 1]), np.array([7, 7, 7, 7, 5]), np.array([1, 2, 1, 1, 1])
    first, often, within = D.combined(rows, h0, h1)
    assert sorted(zip(h0[first], h1[first], often, within, strict=True)) == [(5, 1, 1, 1), (7, 1, 3, 2), (7, 2, 1, 1)]


def test_gram_places_make_no_row_a_word(spark, monkeypatch):
    """As a regular expression finds the words, in stretches of any size; repeated rows once, null keys too, null texts never; nothing is shuffled for the places."""
    import re

    from quernstone.operators import decontamination as D

    texts = ["a bb  ccc\td e", "  x y\U0001f600 z w ", "one two", "", None, "q r s t u v", "a bb  ccc\td e"]
    keys = [1, 2, 3, 4, 5, None, 1]
    rows = list(zip(keys, texts, strict=True)) + [(1, "other text of one"), (None, "q r s t u v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = Counter()
    for k, t in set(rows):
        spans = [m.span() for m in re.finditer(r"\S+", t or "")]
        want.update((k, i, spans[i][0], spans[i + 2][1]) for i in range(len(spans) - 2))
    for stretch in (D.STRETCH, 4):
        monkeypatch.setattr(D, "STRETCH", stretch)
        got = D.gram_places(docs, 3)
        assert Counter((r.doc_id, r.place, r.start, r.stop) for r in got.collect()) == want
    plan = D.gram_places(docs.where("doc_id > 1"), 3)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan and "Generate" not in plan


def test_lexical_search_counts_only_ends_that_can_win(spark, monkeypatch):
    """As by hand from all edges; edges of kinds that no question's best can have are neither moved nor counted."""
    from quernstone.operators import retrieval as Q

    rng = np.random.default_rng(16)
    name = lambda i: f"{'abc'[i % 3]} {i}"
    rows = [(name(int(a)), f"r{int(r)}", name(int(b))) for a, b, r in zip(rng.integers(0, 20, 300), rng.integers(0, 20, 300), rng.integers(0, 2, 300), strict=True)]
    edges = spark.createDataFrame([*rows, *[("a 3", "r0", None)] * 60], "src string, relation string, dst string")
    words = {1: ["a", "3", "r0"], 2: ["b", "c", "7", "11"], 3: ["none"], 4: ["19"], 5: ["a", "3", "r0"], 6: []}
    asked = spark.createDataFrame(list(words.items()), "qid long, words array<string>")
    degree = Counter(x for a, _, b in rows for x in (a, b)) + Counter({"a 3": 60})
    want = set()
    for q, w in words.items():
        found = [(len(set(w) & set(" ".join(e).split())), degree[e[0]] + degree[e[2]], " ".join(e)) for e in set(rows)]
        want |= {(q, i + 1, t, o) for i, (o, _, t) in enumerate(sorted((x for x in found if x[0]), reverse=True)[:4])}
    written, real = [], Q.cut
    monkeypatch.setattr(Q, "cut", lambda df, n: written.append((n, real(df, n))) or written[-1][1])
    for kinds in (Q.KINDS, 0):
        monkeypatch.setattr(Q, "KINDS", kinds)
        got = Q.lexical_edges(edges, asked, 4)
        assert {(r.qid, r.rank, r.triple, r.overlap) for r in got.collect()} == {(q, i, t, o) for q, i, t, o in want}
        sizes = {n: df.count() for n, df in written}
        assert (sizes["lexical-edges"] < len(set(rows)) / 2) == (kinds > 0)


def test_first_neighbours(spark):
    """Both sides of a node by brute force: repeats, loops, hubs and names without edges one way."""
    rows, edges = _random_edges(spark, 9)
    rows += [("n1", "n1", "r"), ("n1", "n1", "again"), *[(f"m{i}", "hub", "r") for i in range(500)]]
    edges = spark.createDataFrame(rows, "src string, dst string, relation string").repartition(5)
    want = {x: sorted(sorted({b for a, b, _ in rows if a == x})[:3] + sorted({a for a, b, _ in rows if b == x})[:3]) for x in {n for r in rows for n in r[:2]}}
    assert {r["name"]: r.near for r in G.first_neighbours(edges, 3).collect()} == want


def test_typed_concepts_rank_both_sides_at_once(spark, tmp_path):
    """One ranking of all ends, and the SQL's rows where foreign keys are null or point to one hub."""
    import duckdb

    from quernstone.plans import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t, change in {"nation": "", "customer": "", "orders": "replace (case when o_orderkey % 5 = 0 then null when o_orderkey % 3 = 0 then 1 else o_custkey end as o_custkey)", "lineitem": "replace (case when l_orderkey % 7 = 0 then null else l_partkey end as l_partkey)"}.items():
        con.execute(f"copy (select * {change} from '/root/testdata/sf0.001/{t}.parquet') to '{tmp_path}/{t}.parquet' (format parquet)")
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    found = QUERIES["m19_typed_concepts"](spark, str(tmp_path))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
    by = lambda r: (r[0] or "", r[1] or "")
    assert sorted([(r["name"], r.concept) for r in found.collect()], key=by) == sorted(con.sql(ORACLE_SQL["m19_typed_concepts"]).fetchall(), key=by)
