"""Sources, sinks, parsers, model calls and composed retrievers, each as a query over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scratch import scratch_path as _folder
from ..operators import catalogue as C
from ..operators import composed as P
from ..operators import graph as G
from ..operators import hooks as H
from ..operators import relational as R
from ..operators import search as S
from ..sources import archives, frames, readers, writers
from . import views as V
from .registry import query, table


def _hash(*parts):
    """A score from a digest: six hexadecimal digits as a number."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 6), 16, 10).cast("double")


def _records(spark, sf, at: str, files: int):
    """Extraction records of the benchmark's items, item i in file i mod ``files``, in order of items."""
    items = table(spark, sf, "benchmark").select("item_id", F.to_json(F.struct(F.col("item_id").cast("string").alias("id"), F.col("text").alias("original_text"))).alias("value"))
    for i in range(files):
        archives.one_file(items.where(F.col("item_id") % files == i), f"{at}/model_items_{i}.jsonl", ["item_id"])


@query("s3_first_files", "select (item_id % 5)::int as file, (row_number() over (partition by item_id % 5 order by item_id) - 1)::bigint as line, item_id::varchar as id from benchmark where item_id % 5 < 3")
def s3(spark, sf):
    at = _folder(spark, "records")
    _records(spark, sf, at, 5)
    return readers.extraction_records(spark, at, "items", first_files=3).select("file", "line", "id")


@query("s18_question_file", "select place, item_id, question from (select (row_number() over (order by item_id) - 1)::int as place, item_id, text as question from benchmark) where place < 7")
def s18(spark, sf):
    at = f"{_folder(spark, 'questions')}/questions.json"
    rows = table(spark, sf, "benchmark").select(F.sort_array(F.collect_list(F.struct("item_id", F.col("text").alias("question")))).alias("q"))  # one file, one row
    archives.one_file(rows.select(F.to_json("q").alias("value")), at)
    return readers.questions(spark, at, "item_id bigint, question string", head=7).select("place", "q.*")


@query("s19_segment_records", "select conv_id, count(*) as segments, count(*) filter (where role = 'assistant') as labelled from conversations group by conv_id")
def s19(spark, sf):
    at = f"{_folder(spark, 'segments')}/records.jsonl"
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    row = F.struct(F.col("conv_id").alias("index"), F.transform("t", lambda x: x["text"]).alias("segmented_response"), F.transform("t", lambda x: x["role"] == "assistant").alias("labels"))
    archives.one_file(turns.select("conv_id", F.to_json(row).alias("value")), at, ["conv_id"])
    back = spark.read.schema("index bigint, segmented_response array<string>, labels array<boolean>").json(at)
    return back.select(F.col("index").alias("conv_id"), F.size("segmented_response").cast("long").alias("segments"), F.size(F.filter("labels", lambda x: x)).cast("long").alias("labelled"))


@query("s7_bundle_scan", "select n_name as nation, r_name as region from nation join region on n_regionkey = r_regionkey")
def s7(spark, sf):
    at = _folder(spark, "bundle")
    n = table(spark, sf, "nation").select(F.to_json(F.struct("n_name", "n_regionkey")).alias("value"))
    r = table(spark, sf, "region").select(F.to_json(F.struct("r_name", "r_regionkey")).alias("value"))
    archives.one_file(n, f"{at}/deep/all_nations.jsonl")
    archives.one_file(r, f"{at}/all_regions.jsonl")
    found = readers.bundle(spark, at, {"n": "nations.jsonl", "r": "regions.jsonl"})
    n = found["n"].select(F.from_json("value", "n_name string, n_regionkey int").alias("v")).select("v.*")
    r = found["r"].select(F.from_json("value", "r_name string, r_regionkey int").alias("v")).select("v.*")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


@query("s8_safe_names", "select n_name as name, n_nationkey % 3 <> 1 as safe from nation")
def s8(spark, sf):
    name = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("a/b/../"), "n_name")).when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit("a/../../"), "n_name")).otherwise(F.concat(F.lit("./x/"), "n_name"))
    return table(spark, sf, "nation").select(F.col("n_name").alias("name"), readers.stays_inside(name).alias("safe"))


@query("s10_paged_scan", "select (i // 100)::int as page, i::bigint as n from (select unnest(range(230)) as i)")
def s10(spark, sf):
    spark.dataSource.register(readers.PagedSource)
    rows = spark.read.format("paged").option("pages", 4).option("size", 100).option("fetch", "quernstone.sources.readers:numbered_page").load()
    return rows.select("page", F.get_json_object("row", "$.n").cast("long").alias("n"))


@query("s13_archive_scan", "select doc_id, (row_number() over (order by doc_id % 3, doc_id) - 1)::bigint as place, length(text)::bigint as chars from documents qualify doc_id % 3 >= 1")
def s13(spark, sf):
    at = _folder(spark, "archives")
    docs = table(spark, sf, "documents").select(F.concat(F.lit("part"), (F.col("doc_id") % 3).cast("string")).alias("archive"), F.to_json(F.struct("doc_id", "text")).alias("body"), "doc_id")
    frames.write_frames(docs, at, "archive", "body", ["doc_id"])
    sizes = frames.totals(spark, at)  # three rows
    w = Window.orderBy("archive")
    before = F.broadcast(sizes.select("archive", (F.sum("lines").over(w) - F.col("lines")).alias("before")))  # places count the archives before the first one taken, too
    lines = frames.read_frames(spark, at, ["part1", "part2"]).join(before, "archive")
    parsed = lines.select(F.from_json("text", "doc_id bigint, text string").alias("d"), (F.col("before") + F.col("place")).alias("place"))
    return parsed.select("d.doc_id", "place", F.length("d.text").cast("long").alias("chars"))


@query("k16_compressed_files", "select (item_id % 4)::int as file, count(*) as lines from benchmark group by 1")
def k16(spark, sf):
    at = _folder(spark, "compress")
    _records(spark, sf, at, 4)
    made = archives.compress_files(spark, [f"{at}/model_items_{i}.jsonl" for i in range(4)])
    return made.select(F.regexp_extract("path", r"_(\d+)\.jsonl\.zst$", 1).cast("int").alias("file"), "lines")


@query("s14_archive_paragraphs", "select conv_id, string_agg(text, chr(10) || chr(10) order by turn) as text from conversations group by conv_id")
def s14(spark, sf):
    at = _folder(spark, "paragraphs")
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    frames.write_frames(turns.select(F.lit("talk").alias("archive"), "conv_id", F.transform("t", lambda x: x["text"]).alias("paragraphs")), at, "archive", "paragraphs", ["conv_id"])
    order = R.number_rows(turns.select("conv_id"), ["conv_id"], "place")
    return frames.read_frames(spark, at).join(order, "place").select("conv_id", "text")


@query("s23_header_probe", "select unnest(['c_custkey', 'c_name']) as name, unnest([min(c_custkey)::varchar, min_by(c_name, c_custkey)]) as first from customer")
def s23(spark, sf):
    at = f"{_folder(spark, 'probe')}/customer.csv"
    rows = table(spark, sf, "customer").select("c_custkey", F.concat_ws(",", "c_custkey", F.concat(F.lit('"'), "c_name", F.lit('"'))).alias("value"))
    head = spark.createDataFrame([(-1, "c_custkey,c_name")], "c_custkey bigint, value string")
    archives.one_file(rows.unionByName(head), at, ["c_custkey"])
    names, first = readers.header_probe(spark, at)
    return spark.createDataFrame(list(zip(names, first[0], strict=True)), "name string, first string")


@query("s20_task_configs", "select n_name as task, coalesce(case when n_nationkey % 2 = 0 then 'own' end, r_name) as metric, 'base' as split from nation join region on n_regionkey = r_regionkey union all select r_name, r_name, 'base' from region union all select 'all', null, 'base'")
def s20(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    base = spark.createDataFrame([("all", None, {"split": "base"})], "name string, include string, settings map<string, string>")
    regions = r.select(F.col("r_name").alias("name"), F.lit("all").alias("include"), F.create_map(F.lit("metric"), "r_name").alias("settings"))
    none = F.create_map().cast("map<string, string>")
    own = F.when(F.col("n_nationkey") % 2 == 0, F.create_map(F.lit("metric"), F.lit("own"))).otherwise(none)
    tasks = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_name").alias("name"), F.col("r_name").alias("include"), own.alias("settings"))
    found = C.resolve(base.unionByName(regions).unionByName(tasks))
    return found.select(F.col("name").alias("task"), F.col("settings")["metric"].alias("metric"), F.col("settings")["split"].alias("split"))


@query("m10_task_groups", "select r_name as \"group\", n_name as task from nation join region on n_regionkey = r_regionkey union all select 'all', n_name from nation")
def m10_groups(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    leaves = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("r_name").alias("group"), F.col("n_name").alias("member"))
    return C.members(leaves.unionByName(r.select(F.lit("all").alias("group"), F.col("r_name").alias("member"))))


@query("m10_named_metrics", f"with {V.ANSWERS}, x as (select split_part(trim(lower(answer)), ' ', 1) as p, split_part(question, ' ', 1) as g from answers) select round(avg((trim(lower(p)) = trim(lower(g)))::int::double), 6) as exact_mean, sum((length(p) = length(g))::int::double) as same_length_sum, median(contains(lower(p), lower(g))::int::double) as contains_median from x")
def m10_metrics(spark, sf):
    rows = V.answers(spark, sf).select(F.col("answer").alias("predicted"), F.substring_index("question", " ", 1).alias("gold"))
    found = C.evaluate(rows, ["strip", "lowercase", "first_word"], [("exact", "mean"), ("same_length", "sum"), ("contains", "median")])
    return found.withColumn("exact_mean", F.round("exact_mean", 6))


@query("s21_saved_index", f"with {V.VECTORS}, scored as (select q.qid, e.vec_id, {V.DOT} as score from questions q, embeddings e) select qid, r::int as rank, vec_id, round(score, 6) as score from (select *, row_number() over (partition by qid order by round(score, 9) desc, vec_id desc) as r from scored) where r <= 5")
def s21(spark, sf):
    at = _folder(spark, "index")
    S.save_index(V.vectors(spark, sf), at, 8)
    return S.search_index(spark, at, V.vector_questions(spark, sf), 5, probes=8).select("qid", "rank", "vec_id", F.round("score", 6).alias("score"))


@query("k1_record_files", "select 'gpt_items_output_2_in_3' as folder, item_id::varchar as id from benchmark")
def k1(spark, sf):
    at = _folder(spark, "output")
    rows = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("id"), "text")
    made = writers.record_lines(rows, at, "gpt", "items", 1, 3)
    return spark.read.schema("id string").json(made).select(F.lit(made.rsplit("/", 1)[1]).alias("folder"), "id")


@query("k4_concatenated_csv", "select value from (select 'key,name' as value union all select n_nationkey || ',' || n_name from nation)")
def k4(spark, sf):
    at = _folder(spark, "shards")
    lines = table(spark, sf, "nation").select("n_nationkey", F.concat_ws(",", F.col("n_nationkey").cast("string"), "n_name").alias("value"))
    head = spark.createDataFrame([(-1, "key,name")], "n_nationkey int, value string")
    for i in range(3):
        archives.one_file(lines.where(F.col("n_nationkey") % 3 == i).unionByName(head), f"{at}/shard{i}.csv", ["n_nationkey"])
    archives.one_file(archives.concatenated(spark, at), f"{at}/all.txt", ["file", "line"])
    return spark.read.text(f"{at}/all.txt")


@query("k8_embedding_csv", "select vec_id, round(embedding[1]::double, 4) as first, len(embedding)::int as dimensions, (row_number() over (order by vec_id) - 1) // 2048 as batch from embeddings")
def k8(spark, sf):
    at = _folder(spark, "embedding-csv")
    rows = R.number_rows(V.vectors(spark, sf), ["vec_id"], "place").select("vec_id", F.expr("place div 2048").alias("batch"), F.col("embedding").alias("embedding:STRING"))
    writers.csv_files({"nodes": rows}, at)
    back = readers.csv_table(spark, f"{at}/nodes", "vec_id bigint, batch bigint, `embedding:STRING` string").withColumn("v", F.from_json("`embedding:STRING`", "array<float>"))
    return back.select("vec_id", F.round(F.col("v")[0].cast("double"), 4).alias("first"), F.size("v").alias("dimensions"), "batch")


@query("k9_array_files", "select count(*) as n, sum(round(embedding[1]::double * 1000)::bigint)::bigint as total, max(len(embedding))::int as dimensions from embeddings")
def k9(spark, sf):
    at = _folder(spark, "arrays")
    made = archives.array_files(V.vectors(spark, sf), "embedding", at)
    sizes = made.agg(F.max("dimensions").alias("dimensions"))
    sizes = spark.createDataFrame(sizes.collect(), sizes.schema)
    back = archives.read_arrays(spark, at).agg(F.count("*").alias("n"), F.sum(F.round(F.col("vector")[0].cast("double") * 1000).cast("long")).alias("total"))
    return back.crossJoin(sizes)  # one row each


@query("k11_bulk_import", f"with {V.TRIPLES}, n as (select distinct head as name from triples) select ':START_ID' as first_column, count(*) as relations from triples where head in (from n) and tail in (from n)")
def k11(spark, sf):
    at = _folder(spark, "bulk")
    t = V.triples(spark, sf)
    nodes = t.select(F.col("head").alias("name"), F.col("head_type").alias("type")).distinct()
    archives.bulk_import(nodes, t.select(F.col("head").alias("src"), F.col("tail").alias("dst"), "relation"), at)
    back = readers.csv_table(spark, f"{at}/relations")
    return back.agg(F.lit(back.columns[0]).alias("first_column"), F.count("*").alias("relations"))


@query("k13_checkpoint_file", "select 'step' as key, max(item_id)::bigint as value from benchmark")
def k13(spark, sf):
    at = f"{_folder(spark, 'state')}/checkpoint.json"
    archives.write_json(spark, at, {"step": 0})
    archives.write_json(spark, at, {"step": table(spark, sf, "benchmark").agg(F.max("item_id")).first()[0]})
    return spark.read.text(at).select(F.explode(F.from_json("value", "map<string, bigint>")).alias("key", "value"))


@query("k17_report_files", "select quality::int as quality, count(*) as n, round(avg(toxic), 6) as toxic from labels group by 1")
def k17(spark, sf):
    at = _folder(spark, "report")
    rows = table(spark, sf, "labels").groupBy(F.col("quality").cast("int").alias("quality")).agg(F.count("*").alias("n"), F.round(F.avg("toxic"), 6).alias("toxic"))
    writers.csv_files({"report": rows}, at)
    return readers.csv_table(spark, f"{at}/report", "quality int, n bigint, toxic double")


@query("k18_sampled_accuracy", "select doc_id, round(length(text) / (length(text) + 100.0), 4)::double as precision from documents where lang is not null order by md5('8:' || doc_id), doc_id limit 20")
def k18(spark, sf):
    at = _folder(spark, "accuracy")
    picked = R.hash_sample(table(spark, sf, "documents").where("lang is not null").select("doc_id", F.length("text").alias("n")), "doc_id", 20, 8)
    writers.csv_files({"rows": picked.select("doc_id", F.round(F.col("n") / (F.col("n") + 100.0), 4).alias("precision"))}, at, quote_all=True)
    return readers.csv_table(spark, f"{at}/rows", "doc_id bigint, precision double")


@query("k21_sample_lines", "select 'sample' as kind, conv_id * 1000 + turn as id, length(text)::double as value from conversations union all select 'mean', conv_id, round(avg(length(text)), 4) from conversations group by conv_id")
def k21(spark, sf):
    at = _folder(spark, "samples")
    turns = table(spark, sf, "conversations")
    samples = turns.select(F.lit("sample").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.length("text").cast("double").alias("value"))
    means = turns.groupBy("conv_id").agg(F.round(F.avg(F.length("text")), 4).alias("value")).select(F.lit("mean").alias("kind"), F.col("conv_id").alias("id"), "value")
    samples.write.json(f"{at}/kind=sample")
    means.write.json(f"{at}/kind=mean")
    return spark.read.schema("kind string, id bigint, value double").json(f"{at}/kind=*")


@query("k22_result_tables", "select (row_number() over (order by r_regionkey))::int as line, '| ' || r_regionkey || ' | ' || r_name || ' |' as markdown, r_regionkey || ' & ' || r_name || ' \\\\' as latex from region")
def k22(spark, sf):
    rows = table(spark, sf, "region").select("r_regionkey", "r_name").orderBy("r_regionkey")
    lines = zip(writers.markdown_table(rows).splitlines()[2:], writers.latex_table(rows).splitlines()[2:-1], strict=True)
    return spark.createDataFrame([(i + 1, *pair) for i, pair in enumerate(lines)], "line int, markdown string, latex string")


@query("f5_uuids", "select count(*) as n, count(distinct gen_random_uuid()) as distinct_ids, true as well_formed from documents")
def f5(spark, sf):
    ids = table(spark, sf, "documents").select(F.expr("uuid()").alias("u"))
    return ids.agg(F.count("*").alias("n"), F.count_distinct("u").alias("distinct_ids"), F.bool_and(F.col("u").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")).alias("well_formed"))


@query("f9_list_attributes", "select user_id, string_agg(distinct event_type, ', ' order by event_type) as kinds from events group by user_id")
def f9(spark, sf):
    lists = table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("kinds"))
    return lists.select("user_id", T.attribute_text(F.col("kinds")).alias("kinds"))


@query("f14_nested_triplets", "select item_id, 'a' || item_id as head, 'r' as relation, text[1:5] as tail from benchmark where item_id % 4 <> 3")
def f14(spark, sf):
    head, tail = F.concat(F.lit("a"), F.col("item_id").cast("string")), F.substring("text", 1, 5)
    triple = F.to_json(F.array(head, F.lit("r"), tail))
    nested = F.when(F.col("item_id") % 4 == 0, F.concat(F.lit("["), triple, F.lit("]"))).when(F.col("item_id") % 4 == 1, F.concat(F.lit('[{"x": [["one"], '), triple, F.lit("]}]"))).when(F.col("item_id") % 4 == 2, F.concat(F.lit("[[[1, 2, 3], "), triple, F.lit(', ["b", "s", "c"]]]'))).otherwise(F.lit('[["only", "two"], 5]'))
    found = table(spark, sf, "benchmark").select("item_id", F.explode(H.triplets_of(nested)).alias("t"))
    return found.select("item_id", F.col("t")[0].alias("head"), F.col("t")[1].alias("relation"), F.col("t")[2].alias("tail"))


@query("f15_nested_keywords", "select item_id, unnest(case when length(text) <= 200 then [text, 'k' || item_id] else ['k' || item_id] end) as keyword from benchmark")
def f15(spark, sf):
    nested = F.concat(F.lit('{"keywords": ['), F.to_json(F.array(F.array("text"))), F.lit(', ["k'), F.col("item_id").cast("string"), F.lit('"], 7]}'))
    return table(spark, sf, "benchmark").select("item_id", F.explode(H.keywords_of(nested)).alias("keyword"))


@query("f16_key_names", "select n_nationkey as key, lower(trim(n_name)) as name from nation")
def f16(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), H.key_name(F.concat(F.lit("  "), "n_name", F.lit(" "))).alias("name"))


@query("f32_penalties", "select item_id, round(least(greatest((p - 1) * 2, 0.0::double), 2.0::double) * 0.7, 6)::double as frequency, round(least(greatest((p - 1) * 2, 0.0::double), 2.0::double) * 0.3, 6)::double as presence from (select item_id, item_id % 60 / 10.0::double - 1 as p from benchmark)")
def f32(spark, sf):
    p = F.col("item_id") % 60 / F.lit(10.0) - 1
    return table(spark, sf, "benchmark").select("item_id", *[c.alias(n) for n, c in H.penalties(p).items()])


@query("m2_checked_extraction", "select item_id, 'item' as head, 'has' as relation, length(text)::varchar as tail from benchmark where item_id % 3 <> 2")
def m2(spark, sf):
    items = table(spark, sf, "benchmark")
    good = F.concat(F.lit('[{"Head": "item", "Relation": "has", "Tail": "'), F.length("text").cast("string"), F.lit('"}]'))
    said = F.when(F.col("item_id") % 3 == 0, good).when(F.col("item_id") % 3 == 1, F.concat(F.lit("Here: "), good)).otherwise(F.lit('[{"Head": "item"}]'))
    replies = H.generate(items.select("item_id", F.concat(F.lit("Extract.\n"), said).alias("prompt")), "prompt", lambda: H.stub_model)
    rows = H.parse_triples(replies, "reply").select("item_id", F.explode("rows").alias("r"))
    return rows.select("item_id", F.col("r.Head").alias("head"), F.col("r.Relation").alias("relation"), F.col("r.Tail").alias("tail"))


CANDIDATES = "c as (select l_orderkey % 50 as qid, 'part ' || l_partkey as fact, max(l_quantity) as score from lineitem group by 1, 2), chosen as (select qid, fact from c where length(fact) % 3 = 0 and qid % 5 <> 0)"


@query("m4_fact_filter", f"with {CANDIDATES} select qid, fact, (qid, fact) in (select qid, fact from chosen) or qid not in (select qid from chosen) as kept from c")
def m4(spark, sf):
    c = table(spark, sf, "lineitem").groupBy((F.col("l_orderkey") % 50).alias("qid"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("fact")).agg(F.max("l_quantity").alias("score"))
    named = c.where("length(fact) % 3 = 0 and qid % 5 <> 0").select("qid", "fact")
    return P.filtered_facts(c, named.unionByName(c.select("qid", F.lit("a fact of its own").alias("fact")))).select("qid", "fact", "kept")


@query("m6_fitted_context", """with p as (select conv_id, text, turn, sum(length(text)) over (partition by conv_id order by turn) as upto from conversations)
    select conv_id, 'Facts: ' || case when count(*) filter (upto <= 300) > 0 then string_agg(text, ' | ' order by turn) filter (upto <= 300) else min_by(text, turn)[1:300] end as prompt from p group by conv_id""")  # fmt: skip
def m6(spark, sf):
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    kept = H.fit_context(F.transform("t", lambda x: x["text"]), 300)
    return turns.select("conv_id", H.render(F.lit("Facts: {facts}"), facts=F.array_join(kept, " | ")).alias("prompt"))


@query("m9_custom_schema", "select item_id, 's' || item_id as subject, 'o' as object from benchmark")
def m9(spark, sf):
    kind, many = H.compile_schema({"type": "array", "items": {"properties": {"subject": {"type": "string"}, "relation": {"type": "string"}, "object": {"type": "string"}}}})
    reply = F.concat(F.lit('[{"subject": "s'), F.col("item_id").cast("string"), F.lit('", "relation": "r", "object": "o"}]'))
    rows = table(spark, sf, "benchmark").select("item_id", F.explode(F.from_json(reply, kind)).alias("r"))
    return rows.where(F.lit(not many)).select("item_id", "r.subject", "r.object")


@query("m15_entity_replies", "select c_custkey, unnest(['customer ' || c_custkey, 'nation ' || c_nationkey]) as entity from customer")
def m15(spark, sf):
    a, b = F.concat(F.lit("customer "), F.col("c_custkey").cast("string")), F.concat(F.lit("nation "), F.col("c_nationkey").cast("string"))
    said = F.when(F.col("c_custkey") % 2 == 0, F.concat(a, F.lit(" , "), b, F.lit(","))).otherwise(F.concat(F.lit('```json\n{"entities": '), F.to_json(F.array(a, b)), F.lit("}\n```")))
    return table(spark, sf, "customer").select("c_custkey", F.explode(H.entities_of(said)).alias("entity"))


JUDGE = "j as (select item_id, 'Judge.' || chr(10) || case when item_id % 7 = 0 then 'FAIL' when text like '%a%' then 'Yes, it is' else 'no' end as prompt, case when item_id % 7 = 0 then null when text like '%a%' then 'Yes, it is' else 'no' end as reply from benchmark)"


@query("m20_judged_items", f"with {JUDGE} select item_id, case when reply is null then 'invalid' when reply = 'no' then 'no' else 'yes' end as verdict, (ceil(length(prompt) / 4.0) * 2 + coalesce(ceil(length(reply) / 4.0), 0) * 6)::double as cost from j")
def m20(spark, sf):
    said = F.when(F.col("item_id") % 7 == 0, "FAIL").when(F.contains("text", F.lit("a")), "Yes, it is").otherwise("no")
    rows = table(spark, sf, "benchmark").select("item_id", F.concat(F.lit("Judge.\n"), said).alias("prompt"))
    return P.judged(rows, "prompt", lambda: H.failing_model, tries=3, price_in=2.0, price_out=6.0).select("item_id", "verdict", "cost")


@query("m17_judged_triples", "select n_regionkey::bigint as region, count(*) as triples, count(*) filter (where n_nationkey % 4 = 0) as invented, sum(ceil(length('nation ' || n_nationkey || ' part of region ' || n_regionkey) / 4.0) + 1)::double as cost from nation group by 1")
def m17(spark, sf):
    n = table(spark, sf, "nation")
    text = F.concat(F.lit("nation "), F.col("n_nationkey").cast("string"), F.lit(" part of region "), F.col("n_regionkey").cast("string"))
    replied = P.judged(n.select(F.col("n_regionkey").cast("long").alias("region"), "n_nationkey", text.alias("prompt")), "prompt", lambda: H.parity_judge, price_in=1.0, price_out=1.0)
    return replied.groupBy("region").agg(F.count("*").alias("triples"), F.count_if(F.col("verdict") == "no").alias("invented"), F.sum("cost").alias("cost"))


@query("m18_made_questions", "select item_id, w as answer, (ascii(substr('ABCD', 1 + (item_id % 4)::int, 1)) - 65)::int as place from (select item_id, string_split(text, ' ')[1] as w from benchmark)")
def m18(spark, sf):
    items = table(spark, sf, "benchmark").select("item_id", F.substring_index("text", " ", 1).alias("answer"))
    asked = items.select("item_id", H.choice_question(F.col("answer"), F.array(F.lit("none"), F.lit("other"), F.lit("all")), (F.col("item_id") % 4).cast("int")).alias("q"))
    found = H.generate(asked.select("item_id", F.col("q.choices").alias("choices"), F.concat(F.col("q.prompt"), F.lit("\n"), F.col("q.key")).alias("prompt")), "prompt", lambda: H.stub_model)
    place = F.ascii("reply") - 65
    return found.select("item_id", F.get("choices", place).alias("answer"), place.alias("place"))


@query("m19_typed_concepts", f"with {V.TRIPLES}, e as (select distinct head as src, tail as dst from triples), n as (select name, sum(o) as o, sum(i) as i from (select src as name, 1 as o, 0 as i from e union all select dst, 0, 1 from e) group by name) select name, split_part(name, ' ', 1) || ' with ' || (least(o, 3) + least(i, 3))::bigint as concept from n")
def m19(spark, sf):
    near = G.first_neighbours(V.graph_edges(spark, sf), 3)
    prompt = H.render(F.lit("Name a concept for {name} ({context}).\n{kind} with {n}"), name=F.col("name"), context=F.array_join("near", ", "), kind=F.substring_index("name", " ", 1), n=F.size("near"))
    return H.generate(near.select("name", prompt.alias("prompt")), "prompt", lambda: H.stub_model).select("name", F.when(F.col("name").isNotNull(), F.col("reply")).alias("concept"))


@query("m21_bundle_answers", "select c_custkey as qid, 'nation ' || c_nationkey as answer, 1.0::double as f1 from customer")
def m21(spark, sf):
    at = _folder(spark, "kg-bundle")
    t = V.triples(spark, sf).where("stage = 2")
    archives.one_file(t.select(F.to_json(F.struct("head", "relation", "tail")).alias("value")), f"{at}/edges.jsonl")
    edges = readers.bundle(spark, at, {"edges": "edges.jsonl"})["edges"].select(F.from_json("value", "head string, relation string, tail string").alias("e")).select("e.*")
    asked = table(spark, sf, "customer").select(F.col("c_custkey").alias("qid"), F.concat(F.lit("customer "), F.col("c_custkey").cast("string")).alias("head"), F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")).alias("gold"))
    facts = asked.join(edges, "head").select("qid", "gold", H.render(F.lit("{h} {r} {t}. Where is {h}?\n{t}"), h=F.col("head"), r=F.col("relation"), t=F.col("tail")).alias("prompt"))
    said = H.generate(facts, "prompt", lambda: H.stub_model)
    from ..operators import evaluation as E

    scored = E.bag_scores(said, ["qid", "reply"], F.col("reply"), F.col("gold"))
    return scored.select("qid", F.col("reply").alias("answer"), F.col("f1").cast("double").alias("f1"))


TOG = f"""{V.TRIPLES}, e as materialized (select distinct head as src, relation, tail as dst from triples),
    l0 as (select (n_nationkey % 5)::bigint as qid, ['order ' || (n_nationkey * 7 + 1)] as nodes, []::varchar[] as rels from nation where ('order ' || (n_nationkey * 7 + 1)) in (select src from e)),
    g1 as (select qid, list_append(nodes, e.dst) as nodes, list_append(rels, e.relation) as rels from l0 join e on e.src = nodes[-1]),
    l1 as (select * from (select *, row_number() over (partition by qid order by ('0x' || md5(array_to_string(nodes, ':'))[1:6])::bigint desc, array_to_string(nodes, chr(31)), array_to_string(rels, chr(31))) as r from g1) where r <= 2),
    s1 as (select distinct qid from l1 where nodes[-1] like '%7'),
    g2 as (select qid, list_append(nodes, e.dst) as nodes, list_append(rels, e.relation) as rels from l1 join e on e.src = nodes[-1] where qid not in (from s1)),
    l2 as (select * from (select *, row_number() over (partition by qid order by ('0x' || md5(array_to_string(nodes, ':'))[1:6])::bigint desc, array_to_string(nodes, chr(31)), array_to_string(rels, chr(31))) as r from g2) where r <= 2)"""


def _explored(spark, sf):
    edges = V.graph_edges(spark, sf)
    topics = table(spark, sf, "nation").select((F.col("n_nationkey") % 5).cast("long").alias("qid"), F.concat(F.lit("order "), (F.col("n_nationkey") * 7 + 1).cast("string")).alias("name"))
    topics = topics.join(edges.select(F.col("src").alias("name")).distinct(), "name", "left_semi")
    score = _hash(F.array_join("nodes", ":"))
    return P.explore(edges, topics, 2, 2, score, F.element_at("nodes", -1).endswith("7"))


@query("r7_explored_paths", f"with {TOG} select qid, 1 as rounds, array_to_string(nodes, ' > ') as path from l1 where qid in (from s1) union all select qid, 2, array_to_string(nodes, ' > ') from l2")
def r7(spark, sf):
    return _explored(spark, sf).select("qid", "rounds", F.array_join("nodes", " > ").alias("path"))


@query("r9_path_passages", f"""with {TOG}, f as (select qid, nodes from l1 where qid in (from s1) union all select qid, nodes from l2), n as (select distinct qid, unnest(nodes) as name from f),
    m as (select distinct head as name, doc::bigint as text_id from triples), w as (select name, 1.0::double / count(distinct text_id) as w from m group by name),
    s as (select qid, text_id, round(sum(w), 9) as score from n join w using (name) join m using (name) group by 1, 2)
    select qid, r::int as rank, text_id, score from (select *, row_number() over (partition by qid order by score desc, text_id) as r from s) where r <= 5""")  # fmt: skip
def r9(spark, sf):
    mentions = V.triples(spark, sf).select(F.col("head").alias("name"), F.col("doc").cast("long").alias("text_id")).distinct()
    return P.path_passages(_explored(spark, sf), mentions, 5)


@query("m16_topic_pruning", """with t as (select distinct (c_nationkey % 5)::bigint as qid, 'customer ' || c_custkey as name, 'nation ' || c_nationkey as tip from customer)
    select qid, name, tip from (select *, row_number() over (partition by qid order by ('0x' || md5(name)[1:6])::bigint desc, name) as r from t) where r <= 4""")  # fmt: skip
def m16(spark, sf):
    topics = table(spark, sf, "customer").select((F.col("c_nationkey") % 5).cast("long").alias("qid"), F.concat(F.lit("customer "), F.col("c_custkey").cast("string")).alias("name"))
    kept = P.explore(V.graph_edges(spark, sf), topics, 9, 1, F.lit(0.0), F.lit(True), most_topics=4, topic_score=_hash(F.col("name")))
    return kept.select("qid", F.element_at("nodes", 1).alias("name"), F.element_at("nodes", -1).alias("tip"))


@query("r6_filtered_trace", """with f as (select r_regionkey::bigint as qid, n_name as fact, ('0x' || md5(r_regionkey || ':' || n_name)[1:6])::bigint as score from region, nation),
    b as (select *, row_number() over (partition by qid order by score desc, fact) as r from f), c as (select * from b where r <= 6),
    k as (select qid, fact, score, length(fact) % 2 = 0 or not bool_or(length(fact) % 2 = 0) over (partition by qid) as kept from c)
    select qid, count(*) as candidates, count(*) filter (where kept) as kept, least(2 * count(*) filter (where kept), 10)::bigint as seeds from k group by qid""")  # fmt: skip
def r6(spark, sf):
    regions = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("qid"))
    facts = regions.crossJoin(F.broadcast(table(spark, sf, "nation").select(F.col("n_name").alias("fact"))))  # five stated questions
    facts = facts.select("qid", "fact", F.concat("fact", F.lit(" a")).alias("src"), F.concat("fact", F.lit(" b")).alias("dst"), _hash(F.col("qid").cast("string"), "fact").alias("score"))
    edges = facts.select("src", "dst").unionByName(facts.select("src", F.concat(F.lit("passage "), F.col("fact")).alias("dst"))).distinct()
    passages = facts.select("qid", F.concat(F.lit("passage "), F.col("fact")).alias("name"), "score")
    chosen = facts.where(F.length("fact") % 2 == 0).select("qid", "fact")
    return P.strict_passages(edges, facts, chosen, passages, candidates=6, iterations=3)[1]


@query("r6_strict_passages")
def r6_strict(spark, sf):
    """Passages ranked from the facts that a filter leaves: where customers live, and the passages that say so. A region is a question."""
    lives = V.triples(spark, sf).where("relation = 'located in'")
    regions = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("qid"))  # five stated questions
    facts = lives.select(F.col("head").alias("src"), F.col("tail").alias("dst"), F.concat_ws(" ", "head", "relation", "tail").alias("fact")).join(F.broadcast(regions))
    facts = facts.select("qid", "fact", "src", "dst", _hash(F.col("qid").cast("string"), "fact").alias("score"))
    said = F.concat(F.lit("passage "), F.col("doc").cast("string"))
    edges = lives.select(F.col("head").alias("src"), F.col("tail").alias("dst")).unionByName(lives.select(F.col("head").alias("src"), said.alias("dst")))
    passages = lives.select(said.alias("name")).distinct().join(F.broadcast(regions)).select("qid", "name", _hash(F.col("qid").cast("string"), "name").alias("score"))
    chosen = facts.where(F.substring_index("src", " ", -1).cast("long") % 2 == 0).select("qid", "fact")
    return P.strict_passages(edges, facts, chosen, passages, candidates=6, iterations=3)[0]


@query("j13_nearest_names", """with n as (select distinct source as name from documents), t as (select name as term from n union select 'nowhere' union select 'some place'),
    enc as (select x, list_transform(range(8), lambda i: ('0x' || sha256(x)[(2 * i + 1)::int:(2 * i + 2)::int])::int + 1) as v from (select name as x from n union select term from t)),
    u as (select x, list_transform(v, lambda y: y / sqrt(list_sum(list_transform(v, lambda z: z * z)))) as v from enc),
    s as (select t.term, n.name, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) as score from t join u a on a.x = t.term, n join u b on b.x = n.name where t.term not in (from n))
    select term, term as name, 'exact' as how from t where term in (from n) union all select term, name, 'nearest' from (select *, row_number() over (partition by term order by round(score, 9) desc, name) as r from s) where r = 1""")  # fmt: skip
def j13(spark, sf):
    sources = table(spark, sf, "documents").select(F.col("source").alias("name")).distinct()
    return P.linked_names(sources.select(F.col("name").alias("term")).unionByName(spark.createDataFrame([("nowhere",), ("some place",)], "term string")), sources)


@query("x13_model_primitives", """with w as (select item_id, list_concat(['Q:'], string_split_regex(trim(text), '\\s+')) as w from benchmark)
    select item_id, round(list_sum(list_transform(range(1, len(w)), lambda i: -1 - ('0x' || md5(w[i] || ' ' || w[i + 1])[1:4])::int / 65536.0::double)), 6) as loglik, len(w)::bigint - 1 as tokens, string_split(string_split(array_to_string(w[2:], ' '), '.')[1], ',')[1] as generated from w""")  # fmt: skip
def x13(spark, sf):
    plain = F.regexp_replace(F.trim("text"), r"\s+", " ")
    return table(spark, sf, "benchmark").select("item_id", F.round(P.log_likelihood(F.lit("Q:"), F.col("text")), 6).alias("loglik"), F.size(F.split(F.trim("text"), r"\s+")).cast("long").alias("tokens"), P.until(plain, ".", ",").alias("generated"))


@query("x8_custom_filter", "select conv_id, turn, replace(reverse(text), ' ', '_') as kept from conversations where text not like '%zz%'")
def x8(spark, sf):
    from ..operators import evaluation as E

    steps = (F.reverse, lambda c: F.translate(c, " ", "_"), lambda c: F.when(F.contains(F.lower(c), F.lit("zz")), None).otherwise(c))
    kept = table(spark, sf, "conversations").select("conv_id", "turn", E.filter_chain(F.col("text"), *steps).alias("kept"))
    return kept.where("kept is not null")


@query("f12_checked_replies", "select item_id, case when item_id % 3 = 2 then 'invalid' when item_id % 3 = 1 then 'empty' else '{\"a\":' || item_id || ',\"b\":[\"x\",\"y\"]}' end as canonical from benchmark")
def f12_checked(spark, sf):
    reply = F.when(F.col("item_id") % 3 == 2, F.lit('{"a": "no number"}')).when(F.col("item_id") % 3 == 1, F.lit('{"a": 1, "b": []}')).otherwise(F.concat(F.lit('{ "b" : ["x", "y"], "a":'), F.col("item_id").cast("string"), F.lit("}")))
    return table(spark, sf, "benchmark").select("item_id", H.canonical_json(reply, "a bigint, b array<string>").alias("canonical"))


@query("k20_packaged_files", "select name from (values ('a/one.txt'), ('two.txt')) v(name)")
def k20(spark, sf):
    at = _folder(spark, "package")
    for name in ("a/one.txt", "two.txt"):
        archives.one_file(table(spark, sf, "region").select(F.col("r_name").alias("value")), f"{at}/in/{name}", ["value"])
    return writers.packaged(spark, f"{at}/in", f"{at}/out.zip")


@query("s15_text_lines", "select (row_number() over (order by n_nationkey) - 1)::bigint as line, n_name as value from nation qualify line >= 5 and line < 15")
def s15(spark, sf):
    at = f"{_folder(spark, 'lines')}/names.txt"
    archives.one_file(table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("value")), at, ["n_nationkey"])
    return readers.text_lines(spark, at, 5, 10)


