"""Golden cases and brute force for what SQL can't say."""

import json
import re
import string
import zipfile
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.functions import vector as N
from quernstone.operators import build as B
from quernstone.operators import decontamination as D
from quernstone.operators import evaluation as E
from quernstone.operators import graph as G
from quernstone.operators import hooks as H
from quernstone.operators import relational as R
from quernstone.operators import retrieval as Q
from quernstone.operators import search as S
from quernstone.sources import readers, writers
from quernstone.streaming import ingest


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return row.select(column).first()[0]


def chunks_of(text, size, overlap):
    out, cur, length = [], [], 0
    if not text:
        return []
    for w in text.split(" "):
        if length + len(w) + 1 > size and cur:
            out.append(" ".join(cur))
            start, over = len(cur), 0
            while start > 0 and over < overlap:
                start -= 1
                over += len(cur[start]) + 1
            cur, length = cur[start:], over
        cur.append(w)
        length += len(w) + 1
    return out + ([" ".join(cur)] if cur else [])


@pytest.mark.parametrize(("text", "size", "overlap"), [("a bb ccc dddd eeeee", 8, 0), ("a bb ccc dddd eeeee", 8, 3), ("x" * 30 + " y z", 10, 4), ("", 5, 0), ("a  b", 3, 2), (" ".join(map(str, range(200))), 37, 11)])
def test_chunker(spark, text, size, overlap):
    assert one(spark, T.chunk(F.col("t"), size, overlap), t=text) == chunks_of(text, size, overlap)


def test_chunker_refuses_odd_sizes():
    with pytest.raises(ValueError):
        T.chunk(None, 5, 5)


@pytest.mark.parametrize(("n", "longest", "context", "want"), [(0, 4, 1, []), (3, 4, 1, [(0, 3, 3)]), (10, 4, 1, [(0, 4, 4), (4, 8, 4), (6, 10, 2)]), (10, 4, 3, [(0, 4, 4), (2, 6, 2), (4, 8, 2), (6, 10, 2)])])
def test_rolling_windows(spark, n, longest, context, want):
    assert [tuple(w) for w in one(spark, T.rolling_windows(F.col("n"), longest, context), n=n)] == want


def test_text_cards(spark):
    assert one(spark, T.clean_text(F.col("t")), t="a;b\x00c\\e d\t\n e ") == "a,bc d e"
    assert one(spark, T.normalise_answer(F.col("t")), t="The Größe-é1 naïve x, ok!") == "the größe é1 naïve x ok"
    assert one(spark, T.normalise_answer_no_articles(F.col("t")), t="The United States.") == "united states"
    assert one(spark, T.split_answer(F.col("t")), t="why Answer: x Answer:  ") == "none"
    assert one(spark, T.passage_of_prompt(F.col("t")), t="q Here is the passage.a\x00b<|eot_id|>c") == "ab"
    assert one(spark, T.xml_safe(F.col("t")), t="a\x01b￾c😀") == "abc😀"
    assert one(spark, T.question_of(F.col("t")), t="a Question: b Question: c ") == "c"


@pytest.mark.parametrize(("p", "g", "em", "f1"), [("The United States.", "United States", 1, 1.0), ("yes indeed", "yes", 0, 0.0), ("New York", "York", 0, 2 / 3)])
def test_answer_scores(spark, p, g, em, f1):
    rows = spark.createDataFrame([(1, p, g)], "q int, p string, g string")
    got = E.yes_no_scores(rows, ["q"], T.normalise_answer_no_articles(F.col("p")), T.normalise_answer_no_articles(F.col("g"))).first()
    assert got["em"] == em and got["f1"] == pytest.approx(f1)


def test_support_scores(spark):
    got = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b")], "qid int, rank int, title string")
    gold = spark.createDataFrame([(1, "a"), (1, "b")], "qid int, title string")
    row = E.support_scores(got, gold, (2, 5)).first()
    assert (row["support_recall_2"], row["all_support_2"], row["support_recall_5"], row["all_support_5"]) == (0.5, 0, 1.0, 1)


def test_parts_together(spark):
    rows = spark.createDataFrame([("g", 2, 0.1), ("g", 1, 0.3), ("g", 5, 0.5)], "g string, n int, m double")
    assert E.weighted_mean(rows, "g", "n", "m", False).first()["m"] == pytest.approx(0.3)
    assert E.weighted_mean(rows, "g", "n", "m").first()["m"] == pytest.approx((0.2 + 0.3 + 2.5) / 8)


def test_bootstrap_is_near_the_closed_form(spark):
    rows = spark.range(1000).select((F.col("id") % 7).cast("double").alias("x"))
    closed = rows.agg(F.stddev_samp("x") / F.sqrt(F.count("*"))).first()[0]
    assert E.bootstrap_stderr(rows, "x", 2000).first()["stderr"] == pytest.approx(closed, rel=0.1)


def test_assignment_is_the_best():
    from itertools import permutations

    rng = np.random.default_rng(4)
    for shape in ((3, 3), (2, 5), (5, 2), (4, 6)):
        m = rng.random(shape)
        got = sum(m[i, j] for i, j in E.assignment(m))
        small, large = min(shape), max(shape)
        best = max(sum((m if shape[0] <= shape[1] else m.T)[i, j] for i, j in enumerate(p)) for p in permutations(range(large), small))
        assert got == pytest.approx(best)


def test_matched_scores_and_bleu(spark):
    rows = spark.createDataFrame([(1, "a", "x", 1.0), (1, "a", "y", 0.2), (1, "b", "x", 0.9), (1, "b", "y", 0.1)], "k int, gold string, predicted string, similarity double")
    got = E.matched_scores(rows, "k").first()
    assert got["precision"] == pytest.approx(0.55) and got["f1"] == pytest.approx(0.55)
    same = spark.createDataFrame([(1, "the cat sat on the mat", "the cat sat on the mat")], "q int, predicted string, gold string")
    assert E.bleu(same, "q").first()[0] == pytest.approx(100)
    assert E.bleu(same.withColumn("predicted", F.lit("dog")), "q").first()[0] == 0


def plain_slices(text, dirty, n, window, cutoff, least):
    """The slices by their definition: intervals around hits, then what lies between them."""
    words = [(m.start(), m.end(), m[0].lower().translate(str.maketrans("", "", string.punctuation))) for m in re.finditer(r"\S+", text)]
    hits = [(words[i][0], words[i + n - 1][1]) for i in range(len(words) - n + 1) if tuple(w for _, _, w in words[i : i + n]) in dirty]
    if len(hits) > cutoff or not hits:
        return [text] if not hits and len(text) >= least else []
    begins, ends = [max(0, b - window) for b, _ in hits], [min(len(text), e + window) for _, e in hits]
    between = [text[e:b] for e, b in zip([0, *ends], begins, strict=False) if b - e > least]
    return between + ([text[ends[-1] + 1 :]] if len(text) - ends[-1] > least else [])


def dirty_runs(texts, n):
    lists = [[w for w in t.lower().translate(str.maketrans("", "", string.punctuation)).split() if w] for t in texts]
    return {tuple(w[i : i + n]) for w in lists for i in range(len(w) - n + 1)}


LINE = "Here stands a +row+ whose #length# in signs is known, seventy-eight it has. "


@pytest.mark.parametrize(("text", "filth", "n", "window", "cutoff", "least", "want"), [
    ("aaa bbb ccc ddd eee fff", "ccc ddd", 2, 0, 10, 2, ["aaa bbb ", "eee fff"]),
    ("short", "nothing here", 2, 0, 10, 200, []),
    ("x" * 201, "nothing here", 2, 0, 10, 200, ["x" * 201]),
    ("a b a b a b", "a b", 2, 0, 2, 1, []),
    ("aaa , bbb", "aaa bbb", 2, 0, 10, 2, ["aaa , bbb"]),
    ("\U0001f600 é aaa bbb tail of it", "aaa bbb", 2, 1, 10, 1, ["\U0001f600 é", "ail of it"]),
    (LINE * 6 + "MUD. " + LINE * 5, "mud", 1, 200, 10, 200, [(LINE * 6)[:-200]]),
])
def test_janitor(spark, text, filth, n, window, cutoff, least, want):
    docs, bad = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string"), spark.createDataFrame([(filth,)], "text string")
    got = [r["slice"] for r in D.clean(docs, bad, n, window, cutoff, least).where("doc_id = 1").orderBy("slice_id").collect()]
    assert got == want == plain_slices(text, dirty_runs([filth], n), n, window, cutoff, least)


def test_clean_whole_table(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    dirty = dirty_runs([r["text"] for r in items.collect()], 13)
    got = {(r["doc_id"], r["slice_id"]): r["slice"] for r in D.clean(docs, items, 13).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    slices = {d: plain_slices(t, dirty, 13, 200, 10, 200) for d, t in texts.items()}
    assert got == {(d, i): s for d, some in slices.items() for i, s in enumerate(some)}
    assert sum(some != [texts[d]] for d, some in slices.items() if len(texts[d]) >= 200) > 5


def plain_ppr(edges, p, alpha, rounds):
    nodes = sorted({x for e in edges for x in e})
    out = {n: sorted({b for a, b in edges if a == n}) for n in nodes}
    x = {n: 1 / len(nodes) for n in nodes}
    for _ in range(rounds):
        lost = sum(x[n] for n in nodes if not out[n])
        x = {n: alpha * (sum(x[m] / len(out[m]) for m in nodes if n in out[m]) + lost * p.get(n, 0)) + (1 - alpha) * p.get(n, 0) for n in nodes}
    return x


def test_pagerank(spark):
    edges = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("c", "d"), ("a", "b")]
    df = spark.createDataFrame([(a, b, "r") for a, b in edges], "src string, dst string, relation string")
    seeds = spark.createDataFrame([(1, "a", 2.0), (1, "d", 6.0), (2, "b", 1.0), (2, "nowhere", 9.0)], "qid int, name string, weight double")
    got = {(r["qid"], r["name"]): r["rank"] for r in G.personalised_pagerank(df, seeds, 0.85, 12).collect()}
    for q, p in ((1, {"a": 0.25, "d": 0.75}), (2, {"b": 1.0})):
        for n, v in plain_ppr(edges, p, 0.85, 12).items():
            assert got[q, n] == pytest.approx(v)
    settled = G.personalised_pagerank(df, seeds, 0.5, 100, 1e-9)
    assert settled.groupBy("qid").agg(F.sum("rank").alias("s")).where("abs(s - 1) > 1e-6").count() == 0


def test_walks(spark):
    df = spark.createDataFrame([("a", "b", "r"), ("b", "7", "r"), ("7", "z", "r"), ("b", "c", "s"), ("c", "a", "t")], "src string, dst string, relation string")
    seeds = spark.createDataFrame([(1, "a")], "qid int, name string")
    digits = F.col("name").rlike("^[0-9]+$")
    reached = {r["name"]: r["hop"] for r in G.breadth_first(df, seeds, 3, digits).collect()}
    assert reached == {"a": 0, "b": 1, "c": 1, "7": 2}
    got = {tuple(r["nodes"]) for r in G.paths(df, seeds, 3).collect()}
    assert got == {("a", "b", "7", "z"), ("a", "b", "c")}
    tri = {r["name"]: (r["triangles"], r["degree"]) for r in G.triangles(df).collect()}
    assert tri["a"] == (1, 2) and tri["z"] == (0, 1) and tri["b"] == (1, 3)


def test_components_of_long_chains(spark):
    df = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}", "r") for i in range(100)] + [("x", "y", "r"), ("w", "w", "r")], "src string, dst string, relation string")
    got = {r["name"]: r["component"] for r in G.weak_components(df).collect()}
    assert {got[f"n{i:03}"] for i in range(101)} == {"n000"} and got["y"] == "x" and got["w"] == "w"


RECORD = {"id": "1", "original_text": "Here is the passage.P", "entity_relation_dict": [{"Head": "A", "Relation": "likes", "Tail": "B"}, {"Head": " ", "Relation": "x", "Tail": "C"}, {"Head": "A", "Relation": "", "Tail": "D"}], "event_relation_dict": [{"Head": "B", "Relation": "before", "Tail": "E1"}], "event_entity_relation_dict": [{"Event": "E1", "Entity": ["A", "Z"]}]}


def test_build_is_first_seen(spark, tmp_path):
    (tmp_path / "x_demo_1.json").write_text(json.dumps(RECORD) + "\nnot json\n")
    (tmp_path / "y_demo_2.json").write_text(json.dumps(RECORD | {"original_text": "Q", "entity_relation_dict": [{"Head": "E1", "Relation": "likes", "Tail": "N"}]}) + "\n")
    records = readers.extraction_records(spark, f"file://{tmp_path}", "demo")
    assert records.count() == 3
    made = B.tables(records)
    assert {(r["name"], r["type"]) for r in made["nodes"].collect()} == {("A", "entity"), ("B", "entity"), ("E1", "event"), ("Z", "entity"), ("N", "entity")}
    texts = {r["name"]: r["text_id"] for r in made["mentions"].collect()}
    assert texts["A"] != texts["N"] and made["mentions"].count() == 5
    assert {(r["name"], r["type"]) for r in made["worklist"].collect()} >= {("likes", "Relation"), ("E1", "Event")}
    shuffled = B.tables(records.repartition(4))
    assert {tuple(r) for r in shuffled["nodes"].collect()} == {tuple(r) for r in made["nodes"].collect()}
    assert readers.extraction_records(spark, f"file://{tmp_path}", "demo", 1).count() == 2


def test_chunks_of_a_config(spark):
    docs = spark.createDataFrame([(1, "a b a b", "en"), (2, "un", "fr"), (3, "c", None)], "doc_id int, text string, lang string")
    got = B.chunks(docs, B.Config(chunk_size=4, deduplicate=True)).collect()
    assert {(r["doc_id"], r["chunk_id"], r["text"]) for r in got} == {(1, 0, "a b"), (3, 0, "c")}
    assert sum(B.chunks(docs, B.Config(shard=i, shards=2)).count() for i in range(2)) == 2


def test_replies():
    assert H.repair_json('x ```json\n[{"a": 1,}]\n``` y') == [{"a": 1}]
    assert H.repair_json('[{"a": "b"') == [{"a": "b"}] and H.repair_json("none") is None and H.repair_json(None) is None
    assert H.fix_rows({" head entity ": "x ", "Relation": "r", "tail": 5, "z": 0}, ("Head", "Relation", "Tail")) == [{"Head": "x", "Relation": "r", "Tail": "5"}]
    assert H.fix_rows([{"Head": "a"}, 3, {"Event": "e", "Entity": "p"}, {"Event": "e", "Entity": ["p"]}], ("Event", "Entity"), ("Entity",)) == [{"Event": "e", "Entity": ["p"]}]
    assert H.flat_triplets([[["a", "b", "c"]], {"x": ["d", "e", "f"]}, "no"]) == [["a", "b", "c"], ["d", "e", "f"]]
    assert H.flat_keywords({"k": ["a", ["b", "c" * 201]]}) == ["a", "b"]
    assert H.compile_schema({"items": {"properties": {"s": {"type": "string"}, "relation": {"type": "string"}, "o": {"type": "array"}}}})[1]
    with pytest.raises(ValueError):
        H.compile_schema({"properties": {"a": {"type": "string"}}})


def test_failed_calls_keep_their_error(spark):
    def broken():
        def call(prompt):
            raise RuntimeError("down")

        return call

    rows = H.generate(spark.createDataFrame([("p",)], "prompt string"), "prompt", broken, 2).first()
    assert rows["reply"] is None and rows["error"] == "RuntimeError: down"


def test_react_words(spark):
    assert one(spark, H.next_query(F.col("t")), t="Thought. Search for: old maps") == "old maps"
    assert one(spark, H.next_query(F.col("t")), t="done") is None
    assert one(spark, H.fit_context(F.split("t", ";"), 5), t="abc;de;f") == ["abc", "de"]
    assert one(spark, H.fit_context(F.split("t", ";"), 2), t="abc;de;f") == ["ab"]


def test_vectors(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))
    exact = {(r["qid"], r["vec_id"]) for r in S.top_k(vectors, asked, 10, block=7).collect()}
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in vectors.collect()}
    for q in list(rows)[:: 20][:5]:
        best = sorted(rows, key=lambda k: (-float(rows[q] @ rows[k]), -k))[:10]
        assert {v for a, v in exact if a == q} == set(best)
    probed = {(r["qid"], r["vec_id"]) for r in S.probe_top_k(vectors, asked, 10, 16, 12).collect()}
    assert len(exact & probed) >= 0.9 * len(exact)
    with pytest.raises(Exception, match="zero vector"):
        spark.createDataFrame([([0.0, 0.0],)], "v array<double>").select(N.l2_normalise(F.col("v"))).collect()


def test_encoder_stub(spark):
    v = S.fixture_vector("text")
    assert len(v) == 8 and np.linalg.norm(v) == pytest.approx(1)
    assert spark.createDataFrame([("text",), (None,)], "t string").select(S.encode("t")).collect()[0][0] == pytest.approx(v)


def test_graph_passages_fall_back(spark):
    edges = spark.createDataFrame([("a", "p1"), ("b", "p2")], "src string, dst string")
    facts = spark.createDataFrame([(1, "a", "b", 1.0), (1, "b", "a", 0.5)], "qid int, src string, dst string, score double")
    passages = spark.createDataFrame([(q, p, s) for q in (1, 2) for p, s in (("p1", 0.1), ("p2", 0.9))], "qid int, name string, score double")
    got = {(r["qid"], r["rank"]): r["name"] for r in Q.graph_passages(edges, facts, passages, 2, iterations=5).collect()}
    assert got[2, 1] == "p2" and {got[1, 1], got[1, 2]} == {"p1", "p2"}


def test_row_numbers_without_a_global_task(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k")).repartition(7)
    got = R.number_rows(df, ["k"]).orderBy("k").collect()
    assert [r["row_number"] for r in got] == list(range(1000))
    parts = R.shard_slices(df, ["k"], 7).groupBy("shard").agg(F.count("*").alias("n"), F.min("k").alias("m")).orderBy("shard").collect()
    assert [r["n"] for r in parts] == [143] * 6 + [142] and [r["m"] for r in parts] == [143 * i for i in range(7)]


def test_files(spark, tmp_path):
    import zstandard

    (tmp_path / "a.jsonl.zst").write_bytes(zstandard.compress(b'{"text": "x\\u00e9"}\n{"text": ["p", "q"]}\n'))
    assert [r["text"] for r in readers.zstd_json_lines(spark, [f"file://{tmp_path}/a.jsonl.zst"]).orderBy("line").collect()] == ["xé", "p\n\nq"]
    (tmp_path / "n.md").write_text("# T")
    assert readers.markdown(spark, str(tmp_path)).first()["id"] == "n"
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("d/corpus.json", '[{"a": 1}, {"a": 2}]')
        z.writestr("d/manifest.jsonl", '{"b": 1}\n')
    got = readers.bundle(spark, str(tmp_path / "b.zip"), {"corpus": "corpus.json", "manifest": "manifest.jsonl"})
    assert got["corpus"].count() == 2 and got["manifest"].count() == 1
    with pytest.raises(ValueError, match="0 files"):
        readers.bundle(spark, str(tmp_path / "b.zip"), {"x": "none.json"})
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../evil", "x")
    with pytest.raises(ValueError, match="leads out"):
        readers.safe_extract(str(tmp_path / "bad.zip"), str(tmp_path / "out"))
    (tmp_path / "v1_x.json").write_text(json.dumps([{"id": "1", "text": "t", "metadata": {"lang": "zh-CN"}}, {"id": "2", "text": "u", "metadata": {}}]))
    assert {r["lang"] for r in readers.corpus(spark, f"file://{tmp_path}", "v1").collect()} == {"zh-CN", "en"}
    writers.atomic_json(str(tmp_path / "r.json"), {"a": 1})
    writers.package(str(tmp_path / "out"), str(tmp_path / "p.zip"))
    table = spark.createDataFrame([("a_b", 1)], "x string, n int")
    assert writers.markdown_table(table) == "| x | n |\n|---|---|\n| a_b | 1 |" and r"a\_b & 1 \\" in writers.latex_table(table)
    writers.csv_files({"t": spark.createDataFrame([("a\n\"b\"", [1, 2])], "x string, y array<int>")}, f"{tmp_path}/csv")
    assert readers.header_probe(spark, f"{tmp_path}/csv/t") == (["x", "y"], [['a\n"b"', "[1,2]"]])


def fetch_page(offset, size):
    return [{"row": i} for i in range(offset, min(offset + size, 25))]


def test_paged_source(spark):
    spark.dataSource.register(readers.PagedSource)
    got = spark.read.format("paged").option("pages", 3).option("size", 10).option("fetch", "tests.test_units:fetch_page").load()
    assert got.count() == 25


def test_graphml_keeps_odd_text(spark, tmp_path):
    nodes = spark.createDataFrame([("a&b", "<x>\x01", "entity", None)], "key string, id string, type string, file_id string")
    edges = spark.createDataFrame([("a&b", "c", 'says "hi"', "Relation")], "src string, dst string, relation string, type string")
    writers.graphml(nodes, edges, f"file://{tmp_path}/g.graphml")
    n, e = readers.graphml(spark, f"file://{tmp_path}/g.graphml")
    assert tuple(n.first()) == ("a&b", "<x>", "entity", None) and tuple(e.first()) == ("a&b", "c", 'says "hi"', "Relation")


def test_streams_go_on_and_refuse_other_configs(spark, tmp_path):
    rows = spark.createDataFrame([(i % 3, datetime(2024, 1, 1, 0, i), 1.0) for i in range(9)], "k long, ts timestamp, value double")
    rows.write.parquet(f"{tmp_path}/in")
    stream = lambda: ingest.read_folder(spark, f"{tmp_path}/in", rows.schema)
    first = ingest.run_to_end(ingest.first_seen(stream(), "k"), f"{tmp_path}/out", f"{tmp_path}/c")
    assert first.count() == 3
    rows.where("k < 2").withColumn("k", F.col("k") + 5).write.mode("append").parquet(f"{tmp_path}/in")
    assert ingest.run_to_end(ingest.first_seen(stream(), "k"), f"{tmp_path}/out", f"{tmp_path}/c").count() == 5
    done = ingest.process_batches(stream(), lambda b: b, f"{tmp_path}/b", f"{tmp_path}/bc", {"v": 1})
    assert done.count() == 15
    assert ingest.process_batches(stream(), lambda b: b, f"{tmp_path}/b", f"{tmp_path}/bc", {"v": 1}).count() == 15
    with pytest.raises(ingest.ConfigChanged):
        ingest.process_batches(stream(), lambda b: b, f"{tmp_path}/b", f"{tmp_path}/bc", {"v": 2})
