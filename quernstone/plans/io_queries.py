"""Readers, writers, builds, hooks and streams, as queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scratch import scratch_path
from ..operators import build as B
from ..operators import decontamination as D
from ..operators import hooks as H
from ..operators import relational as R
from ..sources import buckets, readers, writers
from ..streaming import ingest
from . import views as V
from .registry import query, table
from .text_queries import GRAMS


_folder = scratch_path


@query("s1_corpus_scan", "select doc_id::varchar as id, coalesce(lang, 'en') as lang, length(text)::bigint as chars from documents")
def s1(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("metadata"))
    at = _folder(spark, "corpus")
    docs.write.option("compression", "gzip").json(at)
    return readers.corpus(spark, at, "part-").select("id", "lang", F.length("text").cast("long").alias("chars"))


@query("k2_csv_round_trip", "select doc_id, md5(text) as digest, source from documents")
def k2(spark, sf):
    at = _folder(spark, "csv")
    writers.csv_files({"documents": table(spark, sf, "documents").select("doc_id", "text", "source")}, at, quote_all=True)
    back = readers.csv_table(spark, f"{at}/documents", "doc_id bigint, text string, source string")
    return back.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "source")


@query("s5_vector_column", "select count(*) as n, round(sum(embedding[1]::double), 4) as first from embeddings")
def s5(spark, sf):
    at = _folder(spark, "vectors")
    rows = table(spark, sf, "embeddings").select("vec_id", F.to_json("embedding").alias("embedding:STRING"), "label")
    rows.write.option("header", True).option("escape", '"').csv(at)
    v = readers.vectors_of_csv(spark, at)
    return v.agg(F.count("*").alias("n"), F.round(F.sum(F.col("embedding")[0].cast("double")), 4).alias("first"))


@query("s16_tsv_triples", f"with {V.GRAPH} select src as h, relation as r, dst as t from edges")
def s16(spark, sf):
    at = _folder(spark, "tsv")
    V.graph_edges(spark, sf).select("src", "relation", "dst").write.option("sep", "\t").csv(at)
    return readers.tsv_triples(spark, at)


@query("s17_ragged_steps", "select 'act ' || (l_orderkey % 5) as action, 'order ' || l_orderkey as object, (row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) - 1)::int as step, 'part ' || l_partkey as event from lineitem")
def s17(spark, sf):
    at = _folder(spark, "steps")
    items = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("s"))
    parts = F.transform("s", lambda x: F.concat(F.lit("part "), x["l_partkey"].cast("string")))
    tail = F.array(F.concat(F.lit("act "), (F.col("l_orderkey") % 5).cast("string")), F.concat(F.lit("order "), F.col("l_orderkey").cast("string")))
    items.select(F.array_join(F.concat(parts, tail), "\t").alias("value")).write.text(at)
    return readers.ragged_steps(spark, at)


def _records(spark, sf):
    """Documents as extraction records: each line, whole, is an entity triple with the line after it, and the first line an event in which all others take part."""
    docs = table(spark, sf, "documents")
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: T.clean_text(x)), lambda x: x != "")
    triple = lambda a: F.transform(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), lambda x, i: F.struct(x.alias("Head"), F.lit("then").alias("Relation"), F.try_element_at(a, i + 2).alias("Tail")))
    rows = docs.select("doc_id", F.col("text").alias("original_text"), lines.alias("c")).where(F.size("c") > 0)
    event = F.array(F.struct(F.element_at("c", 1).alias("Event"), F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(0))).alias("Entity")))
    once = F.element_at(F.transform(F.array("c"), triple), 1)  # bound, or every element would make all lines anew
    return rows.select(F.lit(0).alias("file"), F.col("doc_id").alias("line"), "original_text", once.alias("entity_relation_dict"), F.array().cast(readers.TRIPLE).alias("event_relation_dict"), event.alias("event_entity_dict"))


@query("g4_build_tables")
def g4(spark, sf):
    made = B.tables(_records(spark, sf))
    out = None
    for name, df in made.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("s2_record_order", "select (doc_id // 100)::int as file, count(*) as n from documents group by 1")
def s2(spark, sf):
    at = _folder(spark, "records")
    docs = table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 100).alias("f"), "doc_id", F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("original_text"))).alias("value"))
    numbered = docs.repartition("f").sortWithinPartitions("f", "doc_id").select(F.concat(F.lit("f"), F.lpad(F.col("f").cast("string"), 12, "0")).alias("file"), "value")
    numbered.write.partitionBy("file").text(at)
    back = spark.read.text(at).where("value <> ''").select(F.regexp_extract("file", "f0*([0-9]+)$", 1).cast("int").alias("file"), F.from_json("value", readers.RECORD).alias("r"))
    return back.where("r.id is not null").groupBy("file").agg(F.count("*").alias("n"))


@query("k6_graphml_round_trip", f"with {V.TRIPLES} select head as src, tail as dst, relation from triples where stage in (2, 3)")
def k6(spark, sf):
    edges = V.triples(spark, sf).where("stage in (2, 3)").select(F.col("head").alias("src"), F.col("tail").alias("dst"), "relation")
    nodes = edges.select(F.col("src").alias("key")).union(edges.select("dst")).distinct()
    at = _folder(spark, "graph") + ".graphml"
    writers.graphml(nodes, edges, at)
    return readers.graphml(spark, at)[1].select("src", "dst", "relation")


@query("k3_shard_partitions", "select shard, count(*) as n from (select ntile(4) over (order by doc_id) - 1 as s, (ntile(4) over (order by doc_id) - 1)::int as shard from documents) group by shard")
def k3(spark, sf):
    at = _folder(spark, "shards")
    R.shard_slices(table(spark, sf, "documents").select("doc_id"), ["doc_id"], 4).write.partitionBy("shard").parquet(at)
    return spark.read.parquet(at).groupBy("shard").agg(F.count("*").alias("n"))


BUCKETS = 500
BUCKETED = f"""with {GRAMS}, b as (select ('0x' || md5(gram)[1:4])::int % 500 as bucket, gram, doc_id from dg) select bucket, count(*) as n, count(distinct gram) as grams, count(distinct doc_id) as docs from b group by bucket"""


def _grams_by_bucket(docs):
    """(bucket, gram, doc_id): every 13-gram, in the bucket of its hash."""
    number = F.conv(F.substring(F.md5(F.col("gram").cast("binary")), 1, 4), 16, 10).cast("int") % BUCKETS
    return D.document_grams(docs, 13).select(number.alias("bucket"), "gram", "doc_id")


def _bucket_totals(rows):
    """Totals a bucket; grams are told apart by two independent 64-bit hashes, and neither they nor documents are dealt by bucket."""
    grams = rows.groupBy("bucket", F.xxhash64("gram").alias("h"), F.xxhash64(F.lit(1), "gram").alias("g")).agg(F.count("*").alias("n"))
    grams = grams.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("grams"))
    docs = rows.select("bucket", "doc_id").distinct().groupBy("bucket").agg(F.count("doc_id").alias("docs"))
    return grams.join(docs, "bucket").select("bucket", "n", "grams", "docs")


@query("k14_hash_buckets", BUCKETED)
def k14(spark, sf):
    at = _folder(spark, "buckets")
    grams = _grams_by_bucket(table(spark, sf, "documents"))
    buckets.write_buckets(grams, at)
    return _bucket_totals(buckets.read_buckets(spark, at, grams.schema))


@query("z4_restarted_buckets", BUCKETED)
def z4(spark, sf):
    """The same buckets from a stream of document files that is stopped half way and started again on its checkpoint. A batch takes as many files as tasks run at once."""
    at, files = _folder(spark, "bucket-stream"), max(1, spark.sparkContext.defaultParallelism)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    halves = docs.withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2)))
    for half in (0, 1):
        halves.where(F.col("half") == half).drop("half").write.mode("append").parquet(f"{at}/in")
        grams = _grams_by_bucket(ingest.read_folder(spark, f"{at}/in", docs.schema, files))
        buckets.stream_buckets(grams, f"{at}/out", f"{at}/checkpoint")
    return _bucket_totals(buckets.read_buckets(spark, f"{at}/out", grams.schema))


@query("f13_fix_replies", "select item_id, 'item ' || item_id as head, 'has' as relation, length(text)::varchar as tail from benchmark")
def f13(spark, sf):
    items = table(spark, sf, "benchmark")
    good = F.to_json(F.array(F.struct(F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("Head"), F.lit("has").alias(" relation "), F.length("text").cast("string").alias("the tail"))))
    reply = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("Sure:\n```json\n"), good, F.lit("\n```"))).when(F.col("item_id") % 3 == 1, F.regexp_replace(good, r"\}\]$", "},]")).otherwise(F.regexp_replace(good, r"\]$", ""))
    rows = H.parse_triples(items.select("item_id", reply.alias("reply")), "reply").select("item_id", F.explode("rows").alias("r"))
    return rows.select("item_id", F.col("r.Head").alias("head"), F.col("r.Relation").alias("relation"), F.col("r.Tail").alias("tail"))


@query("m1_generate", "select item_id, 'reply to ' || item_id as reply from benchmark")
def m1(spark, sf):
    items = table(spark, sf, "benchmark").select("item_id", H.render(F.lit("Say\nreply to {id}"), id=F.col("item_id")).alias("prompt"))
    return H.generate(items, "prompt", lambda: H.stub_model).select("item_id", "reply")


@query("m3_named_entities", "select item_id, len(list_distinct(list_filter(regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}_]+'), lambda w: regexp_full_match(w, '\\p{Lu}\\p{Ll}+'))))::bigint as entities from benchmark")
def m3(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.size(H.named_entities(F.col("text"))).cast("long").alias("entities"))


@query("m13_prompts", "select conv_id, turn, 'Answer in ' || role || ': ' || text as prompt from conversations")
def m13(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", H.render(F.lit("Answer in {role}: {text}"), role=F.col("role"), text=F.col("text")).alias("prompt"))


@query("r13_react", "select conv_id as qid, string_agg(distinct role, ',' order by role) as answer, case when conv_id % 2 = 0 then 1 else 2 end as rounds from conversations group by conv_id")
def r13(spark, sf):
    turns = table(spark, sf, "conversations")
    asked = turns.select(F.col("conv_id").alias("qid")).distinct().withColumn("query", F.lit("first"))
    roles = turns.select(F.col("conv_id").alias("qid"), F.col("role").alias("name")).distinct()

    def retrieve(q):
        return roles.join(q.select("qid"), "qid", "left_semi")

    def reason(q):
        ready = (F.col("qid") % 2 == 0) | (F.col("query") != "first")
        return q.select("qid", F.when(ready, F.array_join("names", ",")).alias("answer"), H.next_query(F.lit("Search for: more")).alias("query"))

    return H.react(asked, retrieve, reason)


@query("z5_stream_first_seen", "select text_id, count(*) as n from (select distinct sha256(text || '_text') as text_id from documents) group by 1")
def z5(spark, sf):
    at = _folder(spark, "stream")
    docs = table(spark, sf, "documents")
    docs.repartition(4).write.parquet(f"{at}/in")
    stream = ingest.read_folder(spark, f"{at}/in", docs.schema, 2).select(T.hash_id(F.col("text"), "_text").alias("text_id"))
    return ingest.run_to_end(ingest.first_seen(stream, "text_id"), f"{at}/out", f"{at}/checkpoint").groupBy("text_id").agg(F.count("*").alias("n"))


@query("z3_stream_batches", "select event_type, count(*) as n from events group by 1")
def z3(spark, sf):
    at = _folder(spark, "batches")
    events = table(spark, sf, "events")
    events.repartition(3).write.parquet(f"{at}/in")
    stream = ingest.read_folder(spark, f"{at}/in", events.schema, 1)
    done = ingest.process_batches(stream, lambda b: b.select("event_id", "event_type"), f"{at}/out", f"{at}/checkpoint", {"version": 1})
    return done.groupBy("event_type").agg(F.count("*").alias("n"))


@query("z1_stream_windows", "select strftime(date_trunc('day', ts), '%Y-%m-%d') as start, event_type, count(*) as n from events group by 1, 2")
def z1(spark, sf):
    at = _folder(spark, "windows")
    events = table(spark, sf, "events")
    events.repartition(4).write.parquet(f"{at}/in")
    stream = ingest.read_folder(spark, f"{at}/in", events.schema, 2)
    counts = ingest.window_counts(stream, "ts", "event_type", "1 day", "3650 days")
    return ingest.latest_table(counts, f"{at}/out", f"{at}/checkpoint").select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n")
