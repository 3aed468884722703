"""The inventory's remaining rows: selections, joins, scalar functions, retrievers and request handling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scratch import scratch_path
from ..operators import decontamination as D
from ..operators import evaluation as E
from ..operators import graph as G
from ..operators import hooks as H
from ..operators import relational as R
from ..operators import retrieval as Q
from ..operators import search as S
from ..operators import seeded as W
from . import views as V
from .graph_queries import SEEN
from .registry import query, table


@query("p11_resume", "select doc_id from documents where doc_id not in (select doc_id from labels)")
def p11(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("p17_weight_threshold", "select event_id, value / 1e5 as weight from events where value / 1e5 >= 5e-5")
def p17(spark, sf):
    weight = F.col("value") / 1e5
    return table(spark, sf, "events").where(weight >= 5e-5).select("event_id", weight.alias("weight"))


@query("p20_supporting_only", "select doc_id from documents where doc_id in (select doc_id from labels where quality = 1)")
def p20(spark, sf):
    gold = table(spark, sf, "labels").where("quality = 1").select("doc_id")
    return table(spark, sf, "documents").select("doc_id").join(gold, "doc_id", "left_semi")


@query("p22_draws_with_replacement", "with n as (select doc_id, row_number() over (order by doc_id) - 1 as r, count(*) over () as n from documents) select d.draw::bigint as draw, n.doc_id from (select range as draw from range(100)) d join n on n.r = ('0x' || md5('8:' || d.draw)[1:8])::bigint % n.n")
def p22(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    numbered = R.number_rows(docs, ["doc_id"], "r")
    draws = spark.range(100).select(F.col("id").alias("draw"), F.conv(F.substring(F.md5(F.concat(F.lit("8:"), F.col("id").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long").alias("h"))
    placed = draws.crossJoin(docs.agg(F.count("*").alias("n"))).select("draw", (F.col("h") % F.col("n")).alias("r"))  # a hundred draws, one count
    return numbered.join(F.broadcast(placed), "r").select("draw", "doc_id")


@query("p29_drop_raw_columns", "select doc_id, lang, n_chars from documents")
def p29(spark, sf):
    return table(spark, sf, "documents").drop("text", "source")


@query("p30_typed_records", "select event_id from events where json_valid(props) and json_type(props) = 'OBJECT'")
def p30(spark, sf):
    parsed = F.from_json("props", "map<string, string>")
    return table(spark, sf, "events").where(parsed.isNotNull()).select("event_id")


@query("j7_text_lookup", f"with {V.PASSAGES} select p.text_id, p.original_text from passages p where p.text_id in (select sha256(text || '_text') from benchmark union select sha256(text || '_text') from documents where lang = 'de')")
def j7(spark, sf):
    wanted = table(spark, sf, "benchmark").select(T.hash_id(F.col("text"), "_text").alias("text_id")).union(table(spark, sf, "documents").where("lang = 'de'").select(T.hash_id(F.col("text"), "_text")))
    return V.passages(spark, sf).join(wanted, "text_id", "left_semi")


@query("j8_hashed_expansion", f"with {V.GRAPH}, b as (select src as u, dst as v from edges union select dst, src from edges), f as (select distinct dst as u from edges where relation = 'part of'), x as (select b.u, b.v, row_number() over (partition by b.u order by md5('1:' || b.v), b.v) as r from b join f using (u)) select u, v from x where r <= 3")
def j8(spark, sf):
    edges = V.graph_edges(spark, sf)
    front = edges.where("relation = 'part of'").select(F.col("dst").alias("u")).distinct()
    step = G.undirected(edges).join(front, "u")
    return R.top_per_group(step, ["u"], [F.md5(F.concat(F.lit("1:"), "v").cast("binary")), F.col("v")], 3).select("u", "v")


@query("o2_fact_top", f"with {V.GRAPH}, e as (select distinct src, relation, dst from edges), s as (select r_regionkey::bigint as qid, src || ' ' || relation || ' ' || dst as fact, ('0x' || md5(r_regionkey || ':' || src || dst)[1:6])::bigint as score from region, e) select qid, r::int as rank, fact from (select *, row_number() over (partition by qid order by score desc, fact) as r from s) where r <= 50")
def o2(spark, sf):
    facts = V.graph_edges(spark, sf).distinct()
    regions = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("qid"))
    both = facts.crossJoin(F.broadcast(regions))  # five stated questions
    score = F.conv(F.substring(F.md5(F.concat(F.col("qid").cast("string"), F.lit(":"), "src", "dst").cast("binary")), 1, 6), 16, 10).cast("long")
    scored = both.select("qid", F.concat_ws(" ", "src", "relation", "dst").alias("fact"), score.alias("score"))
    return R.top_per_group(scored, ["qid"], [F.desc("score"), F.col("fact")], 50).select("qid", "rank", "fact")


@query("o3_positive_top", "select * from (select user_id, event_id, (row_number() over (partition by user_id order by value desc, event_id))::int as rank from events where value > 0) where rank <= 5")
def o3(spark, sf):
    rows = table(spark, sf, "events").where("value > 0")
    return R.top_per_group(rows, ["user_id"], [F.desc("value"), F.col("event_id")], 5).select("user_id", "event_id", "rank")


@query("o5_rated_paths", "with p as (select c_nationkey as qid, 'customer ' || c_custkey || '>' || 'nation ' || c_nationkey as path, (c_custkey % 6)::int as rating from customer) select * from (select *, (row_number() over (partition by qid order by rating desc, path desc))::int as rank from p where rating > 0) where rank <= 3")
def o5(spark, sf):
    c = table(spark, sf, "customer")
    path = F.concat(F.lit("customer "), F.col("c_custkey").cast("string"), F.lit(">nation "), F.col("c_nationkey").cast("string"))
    rated = c.select(F.col("c_nationkey").alias("qid"), path.alias("path"), (F.col("c_custkey") % 6).cast("int").alias("rating")).where("rating > 0")
    return R.top_per_group(rated, ["qid"], [F.desc("rating"), F.desc("path")], 3)


@query("o8_sorted_grams", "with w as (select list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '') as w from benchmark), g as (select unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as gram from w where len(w) >= 2) select gram, row_number() over (order by gram) - 1 as place from (select distinct gram from g)")
def o8(spark, sf):
    grams = table(spark, sf, "benchmark").select(F.explode(T.ngrams(F.array_remove(F.split(F.lower("text"), "[^a-z]+"), ""), 2)).alias("gram")).distinct()
    return R.number_rows(grams, ["gram"], "place")


@query("o12_fewshot_pick", "select item_id from benchmark order by md5('1234:' || item_id), item_id limit 5")
def o12(spark, sf):
    return R.hash_sample(table(spark, sf, "benchmark").select("item_id"), "item_id", 5, 1234)


@query("f2_remove_nul", "select doc_id, replace(text, chr(0), '') as text from documents")
def f2(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.remove_nul(F.col("text")).alias("text"))


@query("f7_concept_lists", "select p_partkey, array_to_string(list_filter(list_transform(string_split(replace(p_type, ' ', ' ,, '), ','), lambda x: trim(x)), lambda x: x <> ''), '|') as concepts from part")
def f7(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(T.concept_list(F.replace("p_type", F.lit(" "), F.lit(" ,, "))), "|").alias("concepts"))


@query("f12_canonical_json", "select p_partkey, '{\"brand\":\"' || p_brand || '\",\"size\":' || p_size || '}' as j from part")
def f12(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))).alias("j"))


@query("f20_whitespace", "select page_id, trim(regexp_replace(html, '[\\s\\p{Z}]+', ' ', 'g')) as html from pages")
def f20(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.collapse_spaces(F.col("html")).alias("html"))


@query("f24_detokenise", "select conv_id, turn, replace(replace(replace(text, ' .', '.'), ' ,', ','), ' !', '!') as text from conversations")
def f24(spark, sf):
    said = F.col("text")
    for mark in (".", ",", "!"):
        said = F.replace(said, F.lit(f" {mark}"), F.lit(mark))
    return table(spark, sf, "conversations").select("conv_id", "turn", said.alias("text"))


@query("f27_zip_pairs", "select l_orderkey, unnest(list(l_partkey order by l_linenumber, l_partkey)) as part, unnest(list(l_quantity order by l_linenumber, l_partkey)) as quantity from lineitem group by l_orderkey")
def f27(spark, sf):
    rows = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity")))
    lists = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(rows.alias("s")).select("l_orderkey", F.col("s.l_partkey").alias("part"), F.col("s.l_quantity").alias("quantity"))
    return lists.select("l_orderkey", F.explode(F.arrays_zip("part", "quantity")).alias("z")).select("l_orderkey", "z.part", "z.quantity")


@query("f31_dated_names", "select distinct 'run_' || strftime(ts, '%Y%m%d') as name from events")
def f31(spark, sf):
    return table(spark, sf, "events").select(F.concat(F.lit("run_"), F.date_format("ts", "yyyyMMdd")).alias("name")).distinct()


@query("f33_label_tokens", "select distinct unnest(list_filter(string_split_regex(replace(p_type, ' ', ';'), '[;\\s]+'), lambda x: x <> '')) as token from part")
def f33(spark, sf):
    return table(spark, sf, "part").select(F.explode(F.array_remove(F.split(F.replace("p_type", F.lit(" "), F.lit(";")), r"[;\s]+"), "")).alias("token")).distinct()


WALK = "('0x' || md5('7:' || qid || ':' || walker || ':' || {step})[1:8])::bigint"


@query("g6_walk_sample", f"""with {V.GRAPH}, p as (select src as u, dst as v from edges union select dst, src from edges), n as (select u, v, row_number() over (partition by u order by v) - 1 as i, count(*) over (partition by u) as k from p),
    w0 as (select (n_nationkey % 5)::bigint as qid, 'nation ' || n_nationkey as start, (n_nationkey * 20 + w)::bigint as walker, 'nation ' || n_nationkey as name from nation, unnest(range(20)) t(w)),
    """ + ",\n".join(f"""w{t} as (select qid, start, walker, case when h % 1000 < 400 then start else v end as name from (select *, {WALK.format(step=t)} as h from w{t - 1}) w join n on n.u = w.name and n.i = (h // 1000) % n.k)""" for t in range(1, 5)) + """
    select distinct qid, name from (""" + " union all ".join(f"select qid, name from w{t}" for t in range(5)) + ")")  # fmt: skip
def g6_sample(spark, sf):
    return G.walk_sample(V.graph_edges(spark, sf), _walk_starts(spark, sf), 20, 4, 0.4, 7)


def _walk_starts(spark, sf):
    n = table(spark, sf, "nation")
    return n.select((F.col("n_nationkey") % 5).cast("long").alias("qid"), F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")).alias("name"), F.col("n_nationkey").cast("long").alias("number"))


@query("g6_sampled_pagerank")
def g6(spark, sf):
    """For every nation, ranks over the nodes that its own random walks have met."""
    ranks = W.seed_ranks(V.graph_edges(spark, sf), _walk_starts(spark, sf), epsilon=5e-4)
    return R.top_per_group(ranks, ["qid", "seed"], [F.desc(F.round("rank", 9)), F.col("name")], 25, "place").select("qid", "seed", "place", "name", F.round("rank", 6).alias("rank"))


@query("r8_sampled_passages")
def r8_sampled(spark, sf):
    """Passages for misspelt keywords: linked by name, ranked in a sample for each, summed by passage."""
    t = V.triples(spark, sf)
    mentions = t.select(F.col("head").alias("name"), F.col("doc").alias("text")).union(t.select("tail", "doc"))
    n = table(spark, sf, "nation")
    asked = n.select((F.col("n_nationkey") % 5).cast("long").alias("qid"), F.concat(F.lit("natoin "), F.col("n_nationkey").cast("string")).alias("term"))
    found = W.keyword_passages(asked, V.graph_edges(spark, sf), mentions, epsilon=5e-4)
    return found.select("qid", "rank", "text", F.round("score", 9).alias("score"))


@query("g9_relation_pruned_paths", f"""with {V.GEOGRAPHY}, e as (select src as u, dst as v, relation from edges union select dst, src, relation from edges),
    k as (select u, relation from (select u, relation, row_number() over (partition by u order by length(relation) desc, relation) as r from (select distinct u, relation from e)) where r <= 1),
    s as (select distinct dst as u from edges where relation = 'part of') select s.u as qid, count(*) as paths from s join k using (u) join e on e.u = s.u and e.relation = k.relation group by 1""")  # fmt: skip
def g9(spark, sf):
    both = V.geography(spark, sf).select(F.col("src").alias("u"), F.col("dst").alias("v"), "relation").union(V.geography(spark, sf).select("dst", "src", "relation")).distinct()
    kept = R.top_per_group(both.select("u", "relation").distinct(), ["u"], [F.length("relation").desc(), F.col("relation")], 1).select("u", "relation")
    starts = V.geography(spark, sf).where("relation = 'part of'").select(F.col("dst").alias("u")).distinct()
    return both.join(kept, ["u", "relation"], "left_semi").join(starts, "u", "left_semi").groupBy(F.col("u").alias("qid")).agg(F.count("*").alias("paths"))


@query("g13_numbered_graph", f"with {V.TRIPLES}, {SEEN}, n as (select name, row_number() over (order by name) - 1 as id from nodes) select a.id as src, b.id as dst, count(*) as n from triples t join n a on a.name = head join n b on b.name = tail group by 1, 2")
def g13(spark, sf):
    nodes = R.number_rows(G.first_seen_nodes(V.triples(spark, sf), F.struct("stage", "pos")).select("name"), ["name"], "id")
    edges = V.graph_edges(spark, sf)
    a, b = nodes.toDF("src", "s"), nodes.toDF("dst", "d")
    return edges.join(a, "src").join(b, "dst").groupBy(F.col("s").alias("src"), F.col("d").alias("dst")).agg(F.count("*").alias("n"))


@query("v1_encode_batches", """with b as (select doc_id, list_transform(range(8), lambda i: (('0x' || sha256(text)[(2 * i + 1)::int:(2 * i + 2)::int])::int + 1)::double) as w from documents)
    select doc_id, round(w[1] / sqrt(list_inner_product(w, w)), 6) as first, round(w[8] / sqrt(list_inner_product(w, w)), 6) as last from b""")
def v1(spark, sf):
    coded = table(spark, sf, "documents").select("doc_id", S.encode("text").alias("v"))
    return coded.select("doc_id", F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[7], 6).alias("last"))


@query("v8_cosine_rerank", f"with {V.VECTORS} select qid, r::int as rank, vec_id from (select q.qid, e.vec_id, row_number() over (partition by q.qid order by round({V.DOT} / (sqrt(list_sum(list_transform(e.embedding, lambda x: x::double * x::double))) * sqrt(list_sum(list_transform(q.query, lambda x: x::double * x::double)))), 9) desc, e.vec_id desc) as r from questions q join embeddings e on e.label = (select label from embeddings f where f.vec_id = q.qid)) where r <= 5")
def v8(spark, sf):
    vectors = V.vectors(spark, sf)
    asked = V.vector_questions(spark, sf).join(vectors.select(F.col("vec_id").alias("qid"), "label"), "qid")
    return S.top_k_within(vectors, asked, 5, "label").select("qid", "rank", "vec_id")


@query("v12_bundle_index", f"with {V.TRIPLES}, n as (select distinct head as name from triples) select name as qid, name, 1.0::double as score from n where name like 'nation %'")
def v12(spark, sf):
    """An index over a bundle's nodes without passages, saved, opened and asked for names that are in it."""
    names = V.triples(spark, sf).select(F.col("head").alias("name")).distinct().withColumn("embedding", S.encode("name"))
    at = scratch_path(spark, "index")
    S.save_index(names, at)
    asked = names.where("name like 'nation %'").select(F.col("name").alias("qid"), F.col("embedding").alias("query"))
    return S.search_index(spark, at, asked, 1, probes=1, key="name").select("qid", "name", F.round("score", 9).alias("score"))


@query("r1_dense_edges", f"""with {V.GRAPH}, e as (select distinct src || ' ' || relation || ' ' || dst as x from edges),
    b as (select true as is_edge, x, row_number() over (order by x) - 1 as id from e union all select false, text, item_id from benchmark),
    v as (select *, list_transform(range(8), lambda i: (('0x' || sha256(x)[(2 * i + 1)::int:(2 * i + 2)::int])::int + 1)::double) as w from b),
    u as (select is_edge, id, x, list_transform(w, lambda y: y / sqrt(list_inner_product(w, w))) as w from v),
    s as (select q.id as qid, a.id, a.x as edge, list_inner_product(a.w, q.w) as score from u q join u a on a.is_edge and not q.is_edge)
    select qid, r::int as rank, edge, round(score, 6) as score from (select *, row_number() over (partition by qid order by round(score, 9) desc, id desc) as r from s) where r <= 3""")  # fmt: skip
def r1(spark, sf):
    """Edges by the inner product of their encoded text with each question's."""
    edges = V.graph_edges(spark, sf).select(F.concat_ws(" ", "src", "relation", "dst").alias("edge")).distinct()
    coded = R.number_rows(edges, ["edge"], "edge_id").withColumn("v", S.encode("edge"))
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), S.encode("text").alias("query"))
    found = S.top_k(coded, asked, 3, "edge_id", "v")
    return found.join(coded.select("edge_id", "edge"), "edge_id").select("qid", "rank", "edge", F.round("score", 6).alias("score"))


@query("r8_keyword_passages", f"with {V.TRIPLES}, k as (select distinct 'nation ' || n_nationkey as name from nation), d as (select distinct head as name, doc from triples union select distinct tail, doc from triples), w as (select name, 1.0::double / count(*) as weight from d group by name) select doc::bigint as doc, round(sum(weight), 6) as score from d join w using (name) join k using (name) group by doc")
def r8(spark, sf):
    t = V.triples(spark, sf)
    links = t.select(F.col("head").alias("name"), "doc").union(t.select("tail", "doc")).distinct()
    terms = table(spark, sf, "nation").select(F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")).alias("term"))
    names = Q.link_names(terms, links.select("name").distinct(), 1.0).select("name")
    weights = links.groupBy("name").agg((1.0 / F.count("*")).alias("weight"))
    return links.join(names, "name", "left_semi").join(weights, "name").groupBy("doc").agg(F.round(F.sum("weight"), 6).alias("score"))


@query("x1_filter_ensemble", "select conv_id, turn, lower(ltrim(text)) as plain, coalesce(trim(regexp_extract_all(text, '[A-Z][a-z]+')[1]), '[invalid]') as first_name from conversations")
def x1(spark, sf):
    ensemble = {"plain": (E.FILTERS["lstrip"], E.FILTERS["lowercase"]), "first_name": (lambda c: E.regex_pick(c, "[A-Z][a-z]+"),)}
    return table(spark, sf, "conversations").select("conv_id", "turn", *[E.filter_chain(F.col("text"), *steps).alias(n) for n, steps in ensemble.items()])


@query("x12_document_mappers", "select item_id, 'Q: ' || text || chr(10) || 'A:' as prompt, string_split(text, ' ')[1] as target from benchmark")
def x12(spark, sf):
    prompt = H.render(F.lit("Q: {text}\nA:"), text=F.col("text"))
    return table(spark, sf, "benchmark").select("item_id", prompt.alias("prompt"), F.substring_index("text", " ", 1).alias("target"))


@query("x14_restore_order", "select conv_id, turn, row_number() over (order by conv_id, turn) - 1 as place from conversations")
def x14(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn").repartition(5, "turn")
    return R.number_rows(rows, ["conv_id", "turn"], "place")


@query("x16_sample_tables", "select 'turn' as kind, conv_id * 1000 + turn as id, length(text)::bigint as size from conversations union all select 'item', item_id, length(text) from benchmark")
def x16(spark, sf):
    turns = table(spark, sf, "conversations").select(F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.length("text").cast("long").alias("size"))
    return turns.unionByName(table(spark, sf, "benchmark").select(F.lit("item").alias("kind"), F.col("item_id").alias("id"), F.length("text").cast("long").alias("size")))


@query("d6_gram_places", """with w as (select doc_id, unnest(regexp_extract_all(text, '[\\s\\p{Z}]*[^\\s\\p{Z}]+')) as piece, generate_subscripts(regexp_extract_all(text, '[\\s\\p{Z}]*[^\\s\\p{Z}]+'), 1) as i from documents),
    p as (select *, sum(length(piece)) over (partition by doc_id order by i) as stop from w),
    g as (select doc_id, i, stop - length(regexp_replace(piece, '^[\\s\\p{Z}]+', '')) as start, lead(stop, 12) over (partition by doc_id order by i) as stop from p)
    select doc_id, (i - 1)::bigint as place, start::bigint as start, stop::bigint as stop from g where stop is not null""")
def d6(spark, sf):
    return D.gram_places(table(spark, sf, "documents"), 13).select("doc_id", F.col("place").cast("long").alias("place"), "start", "stop")


@query("d2_gram_runs", "with w as (select doc_id, list_filter(string_split_regex(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[!-/:-@\\[-`{-~]', '', 'g'), '[\\s\\p{Z}]+'), lambda x: x <> '') as w from documents), g as (select doc_id, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) as gram from w where len(w) >= 13) select gram, count(distinct doc_id) as docs from g group by gram having count(distinct doc_id) > 1")
def d2(spark, sf):
    return D.frequent_grams(table(spark, sf, "documents"), 13, 1)


@query("k12_result_summary", "select role, count(*) as n, round(avg(length(text)) + 1e-9, 4) as mean_chars from conversations group by role")
def k12(spark, sf):
    return table(spark, sf, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.round(F.avg(F.length("text")) + 1e-9, 4).alias("mean_chars"))
