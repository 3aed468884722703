"""Ranks from single seeds, the shape of a graph and open model calls, against brute force."""

import threading
import time
from collections import defaultdict, deque
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.operators import graph as G
from quernstone.operators import hooks as H
from quernstone.operators import seeded as W
from quernstone.operators import shape

EDGES = "src string, dst string, relation string"


def random_edges(n, m, seed):
    rng = np.random.default_rng(seed)
    return sorted({(f"n{a}", f"n{b}") for a, b in rng.integers(0, n, (m, 2))} | {("n0", f"n{i}") for i in range(1, n, 3)})


def frame(spark, edges):
    return spark.createDataFrame([(a, b, "r") for a, b in edges], EDGES).repartition(3)


def exact_ranks(links, seed, alpha):
    nodes = sorted({x for e in links for x in e} | {seed})
    at = {x: i for i, x in enumerate(nodes)}
    out = defaultdict(set)
    for u, v in links:
        out[u].add(v)
    p = np.zeros((len(nodes), len(nodes)))
    for u, vs in out.items():
        for v in vs:
            p[at[v], at[u]] = 1 / len(vs)
    start = np.zeros(len(nodes))
    start[at[seed]] = 1 - alpha
    return dict(zip(nodes, np.linalg.solve(np.eye(len(nodes)) - alpha * p, start), strict=True))


def test_seed_ranks_are_within_their_bound(spark):
    edges = random_edges(60, 150, 1)
    starts = spark.createDataFrame([(1, "n0", 0), (1, "n5", 1), (2, "n5", 2), (3, "elsewhere", 3)], "qid long, name string, number long")
    got = W.seed_ranks(frame(spark, edges), starts, epsilon=1e-4).collect()
    sid = starts.select(F.concat_ws("\x1f", F.col("qid").cast("string"), "name").alias("qid"), "name", "number")
    samples = defaultdict(set)
    for r in G.walk_sample(frame(spark, edges), sid, 20, 4, 0.4, 7).collect():
        samples[r.qid].add(r["name"])
    assert {(r.qid, r.seed) for r in got} == {(1, "n0"), (1, "n5"), (2, "n5"), (3, "elsewhere")}
    for qid, seed in [(1, "n0"), (1, "n5"), (2, "n5")]:
        held = samples[f"{qid}\x1f{seed}"]
        links = {(a, b) for a, b in edges if {a, b} <= held and a != b}
        want = exact_ranks(links | {(b, a) for a, b in links}, seed, 0.85)
        mine = {r["name"]: r for r in got if (r.qid, r.seed) == (qid, seed)}
        left = next(iter(mine.values())).left
        short = [want[n] - (mine[n].rank if n in mine else 0.0) for n in want]
        assert 0 < left < 1e-4 * len(held) and min(short) > -1e-9 and sum(short) <= left + 1e-9
    assert [(r["name"], round(r.rank, 9)) for r in got if r.qid == 3] == [("elsewhere", 0.15)]


def test_passages_by_keywords(spark):
    edges = random_edges(40, 90, 2)
    mentions = [(n, f"text {i % 7}") for i, n in enumerate(sorted({x for e in edges for x in e})) if n != "n7"] + [("n0", "text 1"), ("n0", "text 1")]
    asked = [(1, "n0"), (1, "n11"), (2, "n7"), (3, "nothing like it")]
    keywords = spark.createDataFrame(asked, "qid long, term string")
    got = W.keyword_passages(keywords, frame(spark, edges), spark.createDataFrame(mentions, "name string, text string"), top=3, nodes=6).collect()
    by_text, count = defaultdict(set), defaultdict(set)
    for n, t in mentions:
        by_text[t].add(n)
        count[n].add(t)
    starts = spark.createDataFrame([(1, "n0", 0), (1, "n11", 0)], "qid long, name string, number long")
    ranks = [(r.rank / len(count[r.seed]), r.seed, r["name"]) for r in W.seed_ranks(frame(spark, edges), starts).collect() if r.rank > 0]
    kept = sorted(ranks, key=lambda x: (-round(x[0], 12), x[1], x[2]))[:6]
    want = sorted(((-sum(s for s, _, n in kept if n in by_text[t]), t) for t in by_text if any(n in by_text[t] for _, _, n in kept)))[:3]
    assert [(r.qid, r.rank, r.text, round(r.score, 9)) for r in sorted(got)] == [(1, i + 1, t, round(-s, 9)) for i, (s, t) in enumerate(want)]


def distances(edges, both):
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
        if both:
            out[b].add(a)
    found = {}
    for s in {x for e in edges for x in e}:
        seen, todo = {s: 0}, deque([s])
        while todo:
            x = todo.popleft()
            for y in out[x]:
                if y not in seen:
                    seen[y] = seen[x] + 1
                    todo.append(y)
        found[s] = seen
    return found


@pytest.mark.parametrize("directed", [False, True])
def test_reach_and_path_lengths(spark, directed):
    edges = random_edges(300, 420, 3) + [(f"m{i}", f"m{i + 1}") for i in range(12)]
    hops = [h for seen in distances(edges, not directed).values() for h in seen.values()]
    got = {r.hop: r.pairs for r in shape.neighbourhood_function(frame(spark, edges), directed).collect()}
    for h, n in got.items():
        assert n == pytest.approx(sum(x <= h for x in hops), rel=0.1)
    row = shape.path_lengths(frame(spark, edges), directed).first()
    assert row["mean"] == pytest.approx(np.mean(hops), rel=0.1) and abs(row.effective - np.quantile(hops, 0.9)) <= 1


def test_diameter_bounds(spark):
    edges = random_edges(80, 90, 4)
    edges += [("n1", "tail0")] + [(f"tail{i}", f"tail{i + 1}") for i in range(5)]
    far = distances(edges, True)
    hub = max(far, key=lambda n: (len([e for e in {frozenset(e) for e in edges if e[0] != e[1]} if n in e]), [-ord(c) for c in n]))
    true = max(max(far[n].values()) for n in far[hub])
    row = shape.diameter(frame(spark, edges)).first()
    assert row.lower <= true <= row.upper and row.lower >= true - 1
    line = [(f"a{i:02}", f"a{i + 1:02}") for i in range(9)]
    assert shape.diameter(frame(spark, line)).first().lower == 9
    assert shape.diameter(frame(spark, [("x", "x")])).first() == (None, None)


def test_simple_cycles(spark):
    edges = random_edges(9, 34, 5) + [("n3", "n3")]
    known = set(edges)
    nodes = sorted({x for e in edges for x in e})
    want = {1: sum(a == b for a, b in known)}
    for k in (2, 3, 4, 5):
        want[k] = sum(p[0] == min(p) and all((p[i], p[(i + 1) % k]) in known for i in range(k)) for p in permutations(nodes, k))
    got = {r.length: r.cycles for r in shape.simple_cycles(frame(spark, edges + edges[:5]), 5).collect()}
    assert got == want and want[5] > 0
    tree = [(f"t{i}", f"t{i // 2}") for i in range(1, 30)]
    assert {r.cycles for r in shape.simple_cycles(frame(spark, tree), 4).collect()} == {0}


def test_calls_overlap_and_keep_their_order():
    open_now, most, lock = [0], [0], threading.Lock()

    def slow(text):
        with lock:
            open_now[0] += 1
            most[0] = max(most[0], open_now[0])
        time.sleep(0.05 if int(text) % 8 else 0.2)
        with lock:
            open_now[0] -= 1
        return text * 2

    from concurrent.futures import ThreadPoolExecutor

    began = time.monotonic()
    with ThreadPoolExecutor(8) as pool:
        assert list(H.windowed(map(str, range(64)), slow, 8, pool)) == [str(i) * 2 for i in range(64)]
    assert most[0] == 8 and time.monotonic() - began < 64 * 0.069 / 2


def test_calls_are_patient_within_a_budget():
    said = []

    def third_time(text):
        said.append(text)
        if said.count(text) < 3:
            raise ValueError(text)
        return "ok"

    began = time.monotonic()
    assert H.patient(third_time, 5, 0.05, 10)("a") == ("ok", None) and 0.15 <= time.monotonic() - began < 1
    assert H.patient(third_time, 2, 0, 10)("b") == (None, "ValueError: b") and said.count("b") == 2
    began = time.monotonic()
    assert H.patient(third_time, 50, 0.2, 0.3)("c") == (None, "ValueError: c") and time.monotonic() - began < 0.5


def test_generate_runs_calls_side_by_side(spark):
    def client():
        import time

        def call(text):
            time.sleep(0.1)
            if text == "7":
                raise RuntimeError("never")
            return text[::-1]

        return call

    rows = spark.createDataFrame([(i, str(i)) for i in range(40)], "id long, prompt string").coalesce(1)
    H.generate(rows, "prompt", client, tries=1).collect()
    began = time.monotonic()
    got = {r.id: (r.reply, r.error) for r in H.generate(rows, "prompt", client, tries=2).collect()}
    assert time.monotonic() - began < 2.5
    assert got == {i: (None, "RuntimeError: never") if i == 7 else (str(i)[::-1], None) for i in range(40)}


def test_quick_calls_are_not_handed_over_one_by_one():
    from concurrent.futures import ThreadPoolExecutor

    class Counted(ThreadPoolExecutor):
        handed = 0

        def submit(self, *args, **more):
            self.handed += 1
            return super().submit(*args, **more)

    with Counted(8) as pool:
        assert list(H.windowed((f"a{i}" for i in range(1000)), str.upper, 8, pool)) == [f"A{i}" for i in range(1000)]
        assert pool.handed <= 8
        assert list(H.windowed([], str.upper, 8, pool)) == []


def test_generate_leaves_other_columns_as_they_are(spark):
    rows = spark.sql("select id, if(id % 3 = 0, null, id + 9007199254740993) as n, if(id = 4, null, concat('p', id)) as prompt, array(named_struct('a', id, 'b', date'1500-01-01')) as s, timestamp'2020-01-01 01:02:03' as t from range(40)")
    found = H.generate(rows, "prompt", lambda: H.stub_model, tries=1)
    assert found.drop("reply", "error").schema == rows.schema
    assert sorted(found.drop("reply", "error").collect(), key=lambda r: r.id) == sorted(rows.collect(), key=lambda r: r.id)
    assert {r.id: r.reply for r in found.collect()} == {i: None if i == 4 else f"p{i}" for i in range(40)}
    assert [r.id for r in found.where("error is not null").collect()] == [4]
    assert "MapInPandas" not in found._jdf.queryExecution().toString()
