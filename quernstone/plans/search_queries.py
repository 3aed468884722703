"""Vector search and retrieval as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as N
from ..operators import graph as G
from ..operators import relational as R
from ..operators import retrieval as Q
from ..functions.scratch import scratch_path
from ..operators import neighbour_graph as NG
from ..operators import search as S
from . import views as V
from .graph_queries import DEGREE, MENTIONS, SEEN, _mentions
from .registry import query, table

SCORED = f"scored as (select q.qid, e.vec_id, e.label, {V.DOT} as score from questions q, embeddings e)"


@query("o1_vector_topk", f"with {V.VECTORS}, {SCORED} select qid, r::int as rank, vec_id, round(score, 6) as score from (select *, row_number() over (partition by qid order by round(score, 9) desc, vec_id desc) as r from scored) where r <= 5")
def o1(spark, sf):
    found = S.top_k(V.vectors(spark, sf), V.vector_questions(spark, sf), 5)
    return found.select("qid", "rank", "vec_id", F.round("score", 6).alias("score"))


@query("v3_cell_probe_topk")
def v3(spark, sf):
    return S.probe_top_k(V.vectors(spark, sf), V.vector_questions(spark, sf), 5, None, 0.6).select("qid", "rank", "vec_id", F.round("score", 6).alias("score"))


@query("v2_neighbour_graph_topk")
def v2(spark, sf):
    """An index of all vectors written and opened again, and all questions' walks in it."""
    at = scratch_path(spark, "neighbour-graph")
    NG.save_graph(V.vectors(spark, sf), at)
    return NG.search_graph(spark, at, V.vector_questions(spark, sf), 5).select("qid", "rank", "vec_id", F.round("score", 6).alias("score"), "scored")


@query("f21_l2_norm", "select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 5) as norm from embeddings")
def f21(spark, sf):
    return V.vectors(spark, sf).select("vec_id", F.round(N.norm(N.l2_normalise(F.col("embedding"))), 5).alias("norm"))


@query("f23_softmax", "with x as (select vec_id, list_transform(embedding, lambda x: exp(x::double - list_max(embedding))) as e from embeddings) select vec_id, round(list_max(e) / list_sum(e), 6) as top from x")
def f23(spark, sf):
    return V.vectors(spark, sf).select("vec_id", F.round(F.array_max(N.softmax(F.col("embedding"))), 6).alias("top"))


@query("w2_minmax", "select event_id, round(case when max(value) over w = min(value) over w then 1 else (value - min(value) over w) / (max(value) over w - min(value) over w) end, 6) as scaled from events window w as (partition by event_type)")
def w2(spark, sf):
    return N.min_max(table(spark, sf, "events"), "value", "event_type").select("event_id", F.round("scaled", 6).alias("scaled"))


@query("v6_label_scores", f"with {V.VECTORS}, {SCORED} select qid, label, round(max(score), 6) as best from scored group by 1, 2")
def v6(spark, sf):
    return S.best_by_label(V.vectors(spark, sf), V.vector_questions(spark, sf)).select("qid", "label", F.round("best", 6).alias("best"))


@query("v7_label_similarity", """with m as (select label, i, avg(x) as x from (select label, unnest(range(len(embedding))) as i, unnest(embedding)::double as x from embeddings) group by 1, 2)
    select a.label as a, b.label as b, round(sum(a.x * b.x), 6) as similarity from m a join m b on a.i = b.i group by 1, 2""")  # fmt: skip
def v7(spark, sf):
    means = V.vectors(spark, sf).select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.toDF("a", "i", "xa").join(means.toDF("b", "i", "xb"), "i").groupBy("a", "b").agg(F.round(F.sum(F.col("xa") * F.col("xb")), 6).alias("similarity"))


@query("j15_pairwise_sim", "with w as (select distinct p_brand, unnest(string_split(p_type, ' ')) as gold from part), n as (select distinct p_brand, unnest(string_split(p_name, ' ')) as pred from part) select p_brand, gold, pred, levenshtein(gold, pred)::int as distance from w join n using (p_brand)")
def j15(spark, sf):
    words = table(spark, sf, "part").select("p_brand", F.explode(F.split("p_type", " ")).alias("gold")).distinct()
    names = table(spark, sf, "part").select("p_brand", F.explode(F.split("p_name", " ")).alias("pred")).distinct()
    return words.join(names, "p_brand").select("p_brand", "gold", "pred", F.levenshtein("gold", "pred").alias("distance"))


@query("w3_topk_per_group", "select * from (select user_id, event_id, value, (row_number() over (partition by user_id order by value desc, event_id))::int as rank from events) where rank <= 3")
def w3(spark, sf):
    return R.top_per_group(table(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id"], [F.desc("value"), F.col("event_id")], 3)


@query("o6_weighted_top", "with b as (select *, row_number() over (partition by user_id, event_type order by value desc, event_id) as r from events), s as (select user_id as qid, event_id as name, sum(value * 0.5) as score from b where r <= 2 group by 1, 2) select qid, (row_number() over (partition by qid order by score desc, name))::int as rank, name, round(score, 6) as score from s qualify rank <= 3")
def o6(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("qid"), F.col("event_type").alias("source"), F.col("event_id").alias("name"), F.col("value").alias("score"), F.lit(0.5).alias("weight"))
    return Q.weighted_top(rows, 2, 3).select("qid", "rank", "name", F.round("score", 6).alias("score"))


@query("o10_restore_order", "select doc_id, row_number() over (order by length(text) desc, doc_id) - 1 as place from documents")
def o10(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", (-F.length("text")).alias("shorter"))
    return R.number_rows(rows, ["shorter", "doc_id"], "place").select("doc_id", "place")


@query("o11_head_responses", "select conv_id, string_agg(role, ',' order by turn) as roles from conversations where turn < 3 group by conv_id")
def o11(spark, sf):
    grouped = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("s"))
    return grouped.select("conv_id", F.array_join(F.transform(F.filter("s", lambda x: x["turn"] < 3), lambda x: x["role"]), ",").alias("roles")).where("roles <> ''")


@query("a12_idf_weight", f"with {V.TRIPLES} select name, 1.0::double / count(distinct doc) as weight from (select head as name, doc from triples union all select tail, doc from triples) group by name")
def a12(spark, sf):
    t = V.triples(spark, sf)
    both = t.select(F.col("head").alias("name"), "doc").unionAll(t.select("tail", "doc"))
    return both.groupBy("name").agg((1.0 / F.count_distinct("doc")).alias("weight"))


@query("a9_node_score_mean", f"with {V.GRAPH}, s as (select src, dst, length(src || relation || dst)::double as score from edges) select name, round(avg(score), 6) as score from (select src as name, score from s union all select dst, score from s) group by name")
def a9(spark, sf):
    scored = V.graph_edges(spark, sf).select("src", "dst", F.length(F.concat("src", "relation", "dst")).cast("double").alias("score"))
    return scored.select(F.explode(F.array("src", "dst")).alias("name"), "score").groupBy("name").agg(F.round(F.avg("score"), 6).alias("score"))


@query("a10_passage_score_sum", f"with {V.TRIPLES}, s as (select distinct head as name, doc from triples), r as (select name, doc, round(length(name) / 7.0, 4)::double as pr from s) select doc::bigint as doc, round(sum(pr), 4) as score from r where pr >= 0.001 group by doc")
def a10(spark, sf):
    nodes = V.triples(spark, sf).select(F.col("head").alias("name"), "doc").distinct()
    ranked = nodes.withColumn("pr", F.round(F.length("name") / F.lit(7.0), 4)).where("pr >= 0.001")
    return ranked.groupBy("doc").agg(F.round(F.sum("pr"), 4).alias("score"))


@query("j6_text_score_topn", f"with {V.TRIPLES}, {SEEN}, {MENTIONS} select text_id, round(sum(length(name)), 4)::double as score from mentions group by text_id order by score desc, text_id limit 25")
def j6(spark, sf):
    scores = _mentions(spark, sf).groupBy("text_id").agg(F.round(F.sum(F.length("name")).cast("double"), 4).alias("score"))
    return scores.orderBy(F.desc("score"), "text_id").limit(25)


@query("j11_file_fanout", f"with {V.TRIPLES}, f as (select name, string_agg(distinct doc::varchar, ',') as file_id from (select head as name, doc from triples) group by name) select file, count(*) as nodes from (select name, unnest(string_split(file_id, ',')) as file from f) group by file")
def j11(spark, sf):
    t = V.triples(spark, sf).groupBy(F.col("head").alias("name")).agg(F.array_join(F.collect_set(F.col("doc").cast("string")), ",").alias("file_id"))
    return t.select("name", F.explode(F.split("file_id", ",")).alias("file")).groupBy("file").agg(F.count("*").alias("nodes"))


@query("j14_fuzzy_names")
def j14(spark, sf):
    """Misspelt names of suppliers, customers and nations, linked to all names of the graph."""
    key = lambda c: F.col(c).cast("string")
    supplier, customer, nation = (table(spark, sf, t) for t in ("supplier", "customer", "nation"))
    terms = supplier.select(F.concat(F.lit("suplier "), key("s_suppkey")).alias("term"))
    terms = terms.unionByName(customer.where("c_custkey % 20 = 0").select(F.concat(F.lit("cust. "), key("c_custkey"), F.lit("r")).alias("term")))
    terms = terms.unionByName(nation.select(F.concat(F.lit("nation "), key("n_nationkey")).alias("term"))).unionByName(nation.select(F.concat(F.lit("the nation of "), key("n_nationkey")).alias("term")))
    edges = V.graph_edges(spark, sf)
    names = edges.select(F.col("src").alias("name")).union(edges.select("dst"))
    return Q.link_names(terms, names).select("term", "name", F.round("ratio", 6).alias("ratio"))


@query("j18_title_overlap", "with g as (select distinct o_custkey as qid, o_orderpriority as t from orders where o_totalprice > 100000), r as (select distinct o_custkey as qid, o_orderpriority as t from orders where o_orderstatus = 'F') select g.qid, count(*) as shared from g join r on g.qid = r.qid and g.t = r.t group by g.qid")
def j18(spark, sf):
    pick = lambda c: table(spark, sf, "orders").where(c).select(F.col("o_custkey").alias("qid"), F.col("o_orderpriority").alias("t"))
    return pick("o_totalprice > 100000").intersect(pick("o_orderstatus = 'F'")).groupBy("qid").agg(F.count("*").alias("shared"))


@query("u3_word_intersection", "with a as (select distinct unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from documents), b as (select distinct unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from benchmark) select count(*) as shared from a join b using (w)")
def u3(spark, sf):
    words = lambda t: table(spark, sf, t).select(F.explode(T.word_set(F.col("text"))).alias("w"))
    return words("documents").intersect(words("benchmark")).agg(F.count("*").alias("shared"))


@query("u5_new_contexts", "select distinct conv_id as qid, role as name from conversations where turn >= 1 except select conv_id, role from conversations where turn = 0")
def u5(spark, sf):
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("qid"), F.col("role").alias("name"), "turn")
    return Q.new_contexts(rows.where("turn >= 1").drop("turn").distinct(), rows.where("turn = 0").drop("turn"))


@query("u6_merge_seeds", "with n as (select c_custkey as qid, c_mktsegment as name, 0.5::double as weight from customer where c_custkey % 2 = 0 or c_custkey % 3 = 0), p as (select c_custkey as qid, c_mktsegment as name, 0.9::double as weight from customer where c_custkey % 3 <> 1) select qid, name, coalesce(p.weight, n.weight) as weight from n full join p using (qid, name)")
def u6(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("qid"), F.col("c_mktsegment").alias("name"))
    n = rows.where("qid % 2 = 0 or qid % 3 = 0").withColumn("weight", F.lit(0.5))
    return Q.merge_seeds(n, rows.where("qid % 3 <> 1").withColumn("weight", F.lit(0.9)))


@query("r2_dense_passages", f"with {V.VECTORS}, {SCORED} select qid, r::int as rank, vec_id, round(s, 6) as scaled from (select *, (score - min(score) over w) / (max(score) over w - min(score) over w) as s, row_number() over (partition by qid order by round(score, 9) desc, vec_id) as r from scored window w as (partition by qid)) where r <= 5")
def r2(spark, sf):
    asked = V.vector_questions(spark, sf)
    best = S.top_k(V.vectors(spark, sf), asked, 5, largest_id_first=False)
    flipped = V.vectors(spark, sf).withColumn("embedding", F.transform("embedding", lambda x: -x))
    least = S.top_k(flipped, asked, 1).select("qid", (-F.col("score")).alias("low"))
    top = best.where("rank = 1").select("qid", F.col("score").alias("high"))
    both = best.join(least, "qid").join(top, "qid")
    return both.select("qid", "rank", "vec_id", F.round((F.col("score") - F.col("low")) / (F.col("high") - F.col("low")), 6).alias("scaled"))


QUESTION_WORDS = "q as (select item_id as qid, list_distinct(regexp_extract_all(lower('order placed by customer ' || (item_id * 7 % 50) || ' located in nation ' || (item_id % 25)), '[a-z0-9]+')) as words from benchmark)"


@query("r10_lexical_triples", f"""with {V.GRAPH}, {DEGREE}, {QUESTION_WORDS}, e as (select distinct src, relation, dst from edges),
    t as (select src, relation, dst, a.out_degree + a.in_degree + b.out_degree + b.in_degree as degree, list_distinct(regexp_extract_all(lower(src || ' ' || relation || ' ' || dst), '[a-z0-9]+')) as words from e join degree a on a.name = src join degree b on b.name = dst),
    h as (select qid, src || ' ' || relation || ' ' || dst as triple, degree, len(list_intersect(q.words, t.words)) as overlap from q, t where list_has_any(q.words, t.words))
    select qid, r::int as rank, triple, overlap::bigint as overlap from (select *, row_number() over (partition by qid order by overlap desc, degree desc, triple desc) as r from h) where r <= 10""")  # fmt: skip
def r10(spark, sf):
    edges = V.graph_edges(spark, sf)
    said = F.concat(F.lit("order placed by customer "), (F.col("item_id") * 7 % 50).cast("string"), F.lit(" located in nation "), (F.col("item_id") % 25).cast("string"))
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), T.word_set(said).alias("words"))
    return Q.lexical_edges(edges, q, 10)


@query("r5_graph_passages")
def r5(spark, sf):
    edges, facts, passages = _retrieval_tables(spark, sf)
    return Q.graph_passages(edges, facts, passages, top=5, iterations=10)


def _retrieval_tables(spark, sf):
    """Edges with passages attached, each region's scores of all facts, and of all passages."""
    geo = V.graph_edges(spark, sf).select("src", "dst")
    mentions = V.triples(spark, sf).select(F.col("head").alias("src"), F.concat(F.lit("passage "), F.col("doc").cast("string")).alias("dst"))
    edges = geo.unionByName(mentions).distinct()
    regions = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("qid"))

    def score(*parts):
        return F.conv(F.substring(F.md5(F.concat_ws(":", F.col("qid").cast("string"), *parts).cast("binary")), 1, 6), 16, 10).cast("double")

    facts = regions.crossJoin(geo.distinct()).withColumn("score", score("src", "dst"))  # stated questions against all facts
    passages = regions.crossJoin(mentions.select(F.col("dst").alias("name")).distinct()).withColumn("score", score("name"))
    return edges, facts, passages


@query("a9_edge_seeds", f"""with {V.GRAPH}, e as (select distinct src, dst from edges), s as (select r_regionkey::bigint as qid, src, dst, ('0x' || md5(r_regionkey || ':' || src || ':' || dst)[1:6])::bigint::double as score from region, e),
    m as (select *, (score - min(score) over w) / (max(score) over w - min(score) over w) as x from s window w as (partition by qid)), k as (select *, row_number() over (partition by qid order by x desc, src, dst) as r from m),
    n as (select qid, name, avg(x) as weight from (select qid, src as name, x from k where r <= 50 union all select qid, dst, x from k where r <= 50) group by 1, 2)
    select qid, name, round(weight, 9) as weight from (select *, row_number() over (partition by qid order by weight desc, name) as r from n) where r <= 10""")  # fmt: skip
def a9_seeds(spark, sf):
    return Q.edge_seeds(_retrieval_tables(spark, sf)[1]).select("qid", "name", F.round("weight", 9).alias("weight"))


@query("r4_entity_passages")
def r4(spark, sf):
    edges = V.graph_edges(spark, sf).select("src", "dst")
    files = V.triples(spark, sf).select(F.col("head").alias("name"), F.col("doc").cast("string").alias("file"))
    seeds = V.geography(spark, sf).where("relation = 'part of'").select(F.substring_index("dst", " ", -1).cast("long").alias("qid"), F.col("src").alias("name"))
    return Q.entity_passages(edges, seeds, files, top=5, iterations=10)


@query("r11_upper_bound", "with g as (select conv_id as qid, turn as name from conversations where role = 'assistant'), d as (select conv_id as qid, turn as name from conversations), b as (select qid, name, 0 as tier from g union all select qid, name, 1 from d where (qid, name) not in (select qid, name from g)) select qid, (row_number() over (partition by qid order by tier, md5(qid || ':' || name), name))::int as rank, name from b qualify rank <= 3")
def r11(spark, sf):
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("qid"), F.col("turn").alias("name"), "role")
    return Q.upper_bound(turns.where("role = 'assistant'").drop("role"), turns.drop("role"), 3)


@query("s22_node_lookup", f"with {V.TRIPLES}, {SEEN}, n as (select name, type, row_number() over (order by name) - 1 as numeric_id from nodes) select numeric_id, name, type from n where numeric_id % 20 = 0")
def s22(spark, sf):
    nodes = G.first_seen_nodes(V.triples(spark, sf), F.struct("stage", "pos")).select("name", "type")
    numbered = R.number_rows(nodes, ["name"], "numeric_id")
    wanted = numbered.where("numeric_id % 20 = 0").select("numeric_id")  # the stated question set
    return numbered.join(wanted, "numeric_id", "left_semi").select("numeric_id", "name", "type")


@query("v9_cached_encodings", "select count(*) as all_texts, count(*) filter (not cached) as fresh from (select text, bool_or(doc_id % 2 = 0) as cached from documents group by text)")
def v9(spark, sf):
    docs = table(spark, sf, "documents")
    cache = docs.where("doc_id % 2 = 0").select("text").distinct().select(F.sha2("text", 256).alias("key"), S.encode("text").alias("vector"))
    full, fresh = S.cached_encode(docs, cache)
    return full.agg(F.count("*").alias("all_texts")).crossJoin(fresh.agg(F.count("*").alias("fresh")))  # one row each
