"""Text hygiene, chunking, n-grams and row selection as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import decontamination as D
from ..operators import relational as R
from . import views as V
from .registry import query, table

#: White space and word characters as Python's, spelled for RE2.
WS = r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"
NOT_WORD = r"[^\p{L}\p{M}\p{N}_\s\p{Z}]"


def _docs(spark, sf):
    return table(spark, sf, "documents")


@query("p1_lang_filter", "select doc_id, coalesce(lang, 'en') as lang from documents where coalesce(lang, 'en') in ('en', 'zh-CN', 'zh-HK')")
def p1(spark, sf):
    lang = F.coalesce("lang", F.lit("en"))
    return _docs(spark, sf).where(lang.isin("en", "zh-CN", "zh-HK")).select("doc_id", lang.alias("lang"))


@query("p2_space_norm", f"select doc_id, trim(regexp_replace(text, '{WS}', ' ', 'g')) as text from documents")
def p2(spark, sf):
    return _docs(spark, sf).select("doc_id", T.collapse_spaces(F.col("text")).alias("text"))


@query("p3_shard_slice", "select doc_id, (ntile(7) over (order by doc_id) - 1)::int as shard from documents")
def p3(spark, sf):
    return R.shard_slices(_docs(spark, sf).select("doc_id"), ["doc_id"], 7).select("doc_id", "shard")


@query("p4_hash_shard", "select ('0x' || md5(doc_id::varchar)[1:8])::bigint % 7 as shard, count(*) as n from documents group by 1")
def p4(spark, sf):
    shard = F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 7
    return _docs(spark, sf).groupBy(shard.alias("shard")).agg(F.count("*").alias("n"))


@query("p5_head_chunks", "select doc_id from documents order by doc_id limit 100")
def p5(spark, sf):
    return _docs(spark, sf).select("doc_id").orderBy("doc_id").limit(100)


@query("p8_prompt_strip", "with p as (select doc_id, case when doc_id % 3 = 0 then text else 'System' || chr(10) || 'Here is the passage.' || text || '<|eot_id|> tail' end as prompt from documents) select doc_id, string_split(string_split(prompt, 'Here is the passage.')[-1], '<|eot_id|>')[1] as passage from p")
def p8(spark, sf):
    prompt = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("System\nHere is the passage."), "text", F.lit("<|eot_id|> tail")))
    return _docs(spark, sf).select("doc_id", T.passage_of_prompt(prompt).alias("passage"))


@query("p10_batches", "select batch, count(*) as n, min(doc_id) as first from (select doc_id, (row_number() over (order by doc_id) - 1) // 64 as batch from documents) group by batch")
def p10(spark, sf):
    return R.batches(_docs(spark, sf).select("doc_id"), ["doc_id"], 64).groupBy("batch").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query("p16_stop_words", "with w as (select doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) as word from documents) select word, count(*) as n from w where word <> '' and word not in ('the', 'of', 'and', 'to', 'in', 'a', 'is', 'for') group by word")
def p16(spark, sf):
    stop = spark.createDataFrame([(w,) for w in ("the", "of", "and", "to", "in", "a", "is", "for")], "word string")
    words = _docs(spark, sf).select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("n")).join(F.broadcast(stop), "word", "left_anti")  # eight words


@query("p18_keyword_overlap", "with w as (select doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as words from documents) select doc_id from w where list_has_any(words, ['error', 'password', 'license', 'that'])")
def p18(spark, sf):
    wanted = F.array(*[F.lit(w) for w in ("error", "password", "license", "that")])
    return _docs(spark, sf).where(F.arrays_overlap(T.word_set(F.col("text")), wanted)).select("doc_id")


@query("p23_hash_sample", "select doc_id from documents order by md5('8:' || doc_id), doc_id limit 200")
def p23(spark, sf):
    return R.hash_sample(_docs(spark, sf).select("doc_id"), "doc_id", 200, 8)


@query("p25_rank_slice", "select doc_id from (select doc_id, row_number() over (order by doc_id) - 1 as r from documents) where r % 4 = 1")
def p25(spark, sf):
    return R.rank_slice(_docs(spark, sf).select("doc_id"), ["doc_id"], 1, 4)


@query("p26_glob", "select source, count(*) as n from documents where source glob 'src1*' group by source")
def p26(spark, sf):
    return _docs(spark, sf).where(F.col("source").like("src1%")).groupBy("source").agg(F.count("*").alias("n"))


@query("p27_xml_safe", "select doc_id, regexp_replace(text || chr(1) || 'x', '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g') as text from documents")
def p27(spark, sf):
    return _docs(spark, sf).select("doc_id", T.xml_safe(F.concat("text", F.lit("\x01x"))).alias("text"))


@query("p28_question_suffix", "select conv_id, turn, trim(string_split('Context. Question: ' || text, 'Question:')[-1]) as question from conversations where role = 'user'")
def p28(spark, sf):
    turns = table(spark, sf, "conversations").where("role = 'user'")
    return turns.select("conv_id", "turn", T.question_of(F.concat(F.lit("Context. Question: "), "text")).alias("question"))


@query("p31_limit_fraction", "select item_id from (select item_id, row_number() over (order by item_id) as r, count(*) over () as n from benchmark) where r <= ceil(n * 0.33)")
def p31(spark, sf):
    return R.fraction(table(spark, sf, "benchmark").select("item_id"), [F.col("item_id")], 0.33)


@query("p32_split_selection", "select doc_id, case when doc_id % 10 = 0 then 'test' when doc_id % 10 = 1 then 'validation' else 'train' end as split from documents where doc_id % 10 <= 1")
def p32(spark, sf):
    split = F.when(F.col("doc_id") % 10 == 0, "test").when(F.col("doc_id") % 10 == 1, "validation").otherwise("train")
    return _docs(spark, sf).select("doc_id", split.alias("split")).where("split in ('test', 'validation')")


@query("f1_clean_text", f"select doc_id, trim(regexp_replace(replace(replace(regexp_replace(text, '[\\n\\r\\t\\x0B\\f\\x08\\x07]|\\\\e', ' ', 'g'), ';', ','), chr(0), ''), '{WS}', ' ', 'g')) as text from documents")
def f1(spark, sf):
    return _docs(spark, sf).select("doc_id", T.clean_text(F.col("text")).alias("text"))


@query("f3_hash_ids", "select doc_id, sha256(text || '_text') as text_id, sha256(source || '_entity') as entity_id, sha256(lang || '_concept') as concept_id from documents")
def f3(spark, sf):
    return _docs(spark, sf).select("doc_id", T.hash_id(F.col("text"), "_text").alias("text_id"), T.hash_id(F.col("source"), "_entity").alias("entity_id"), T.hash_id(F.col("lang"), "_concept").alias("concept_id"))


@query("f4_short_ids", "select doc_id, 'n' || md5(source)[1:16] as node_id, sha256(source || chr(0) || text)[1:16] as stable_id from documents")
def f4(spark, sf):
    return _docs(spark, sf).select("doc_id", T.node_md5(F.col("source")).alias("node_id"), T.short_hash(F.col("source"), F.col("text")).alias("stable_id"))


@query("f6_chunk", """with words as (select doc_id, string_split(text, ' ') as w from documents where text <> ''),
    folded as (select doc_id, list_reduce(list_transform(w, lambda x: {'done': []::varchar[], 'cur': [x], 'len': length(x) + 1}),
        lambda s, x: case when s.len + x.len > 400 then {'done': list_append(s.done, array_to_string(s.cur, ' ')), 'cur': x.cur, 'len': x.len} else {'done': s.done, 'cur': list_concat(s.cur, x.cur), 'len': s.len + x.len} end) as s from words),
    chunks as (select doc_id, list_append(s.done, array_to_string(s.cur, ' ')) as c from folded)
    select doc_id, (unnest(range(len(c))))::int as chunk_id, unnest(c) as chunk from chunks""")  # fmt: skip
def f6(spark, sf):
    return _docs(spark, sf).select("doc_id", F.posexplode(T.chunk(F.col("text"), 400)).alias("chunk_id", "chunk"))


@query("a4_chunk_dedup", """with words as (select doc_id, string_split(text, ' ') as w from documents where text <> ''),
    folded as (select doc_id, list_reduce(list_transform(w, lambda x: {'done': []::varchar[], 'cur': [x], 'len': length(x) + 1}),
        lambda s, x: case when s.len + x.len > 60 then {'done': list_append(s.done, array_to_string(s.cur, ' ')), 'cur': x.cur, 'len': x.len} else {'done': s.done, 'cur': list_concat(s.cur, x.cur), 'len': s.len + x.len} end) as s from words),
    chunks as (select doc_id, unnest(range(len(c))) as chunk_id, unnest(c) as chunk from (select doc_id, list_append(s.done, array_to_string(s.cur, ' ')) as c from folded))
    select doc_id, min(chunk_id)::int as chunk_id, chunk from chunks group by doc_id, chunk""")  # fmt: skip
def a4(spark, sf):
    chunks = _docs(spark, sf).select("doc_id", F.posexplode(T.chunk(F.col("text"), 60)).alias("chunk_id", "chunk"))
    return chunks.groupBy("doc_id", "chunk").agg(F.min("chunk_id").alias("chunk_id")).select("doc_id", "chunk_id", "chunk")


@query("f8_split_labels", "select p_partkey, unnest(list_transform(string_split(replace(p_type, ' ', ' , '), ','), lambda x: lower(trim(x)))) as label from part")
def f8(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.explode(T.split_labels(F.replace("p_type", F.lit(" "), F.lit(" , ")))).alias("label"))


@query("f17_answer_norm", f"select conv_id, turn, trim(regexp_replace(regexp_replace(replace(lower(text), '-', ' '), '{NOT_WORD}', '', 'g'), '{WS}', ' ', 'g')) as answer from conversations")
def f17(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.normalise_answer(F.col("text")).alias("answer"))


@query("f17_split_answer", "with t as (select conv_id, turn, case when turn % 2 = 0 then 'Reasoning. Answer: ' || text when turn % 3 = 0 then 'answer:' else text end as a from conversations) select conv_id, turn, case when s = '' then 'none' else s end as answer from (select *, trim(regexp_replace(case when contains(a, 'Answer:') then string_split(a, 'Answer:')[-1] when contains(a, 'answer:') then string_split(a, 'answer:')[-1] else a end, '\\s+', ' ', 'g')) as s from t)")
def f17_split(spark, sf):
    said = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Reasoning. Answer: "), "text")).when(F.col("turn") % 3 == 0, F.lit("answer:")).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", T.split_answer(said).alias("answer"))


@query("f18_no_articles", """with b as (select conv_id, turn, regexp_replace(lower(text), '[!-/:-@\\[-`{-~]', '', 'g') as t from conversations),
    c as (select conv_id, turn, regexp_replace(t, '(^|[^\\p{L}\\p{M}\\p{N}_])(a|an|the)($|[^\\p{L}\\p{M}\\p{N}_])', '\\1 \\3', 'g') as t from b),
    d as (select conv_id, turn, regexp_replace(t, '(^|[^\\p{L}\\p{M}\\p{N}_])(a|an|the)($|[^\\p{L}\\p{M}\\p{N}_])', '\\1 \\3', 'g') as t from c)
    select conv_id, turn, trim(regexp_replace(t, '[\\s\\p{Z}]+', ' ', 'g')) as answer from d""")
def f18(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.normalise_answer_no_articles(F.col("text")).alias("answer"))


@query("f19_word_sets", "select doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')))::bigint as words from documents")
def f19(spark, sf):
    return _docs(spark, sf).select("doc_id", F.size(T.word_set(F.col("text"))).cast("long").alias("words"))


@query("f25_counts", f"select doc_id, strlen(text)::bigint as bytes, len(list_filter(string_split_regex(text, '{WS}'), lambda x: x <> ''))::bigint as words from documents")
def f25(spark, sf):
    return _docs(spark, sf).select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.size(T.tokens(F.col("text"))).cast("long").alias("words"))


@query("f26_path_strings", "select c_custkey, 'customer ' || c_custkey || ' --->located in --->' || n_name as path from customer join nation on n_nationkey = c_nationkey")
def f26(spark, sf):
    both = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return both.select("c_custkey", F.array_join(F.array(F.concat(F.lit("customer "), F.col("c_custkey").cast("string")), F.lit("located in"), "n_name"), " --->").alias("path"))


@query("f28_name_parts", "select distinct regexp_extract(source, '([a-z]+)([0-9]+)', 1) as stem, regexp_extract(source, '([a-z]+)([0-9]+)', 2)::int as number from documents")
def f28(spark, sf):
    return _docs(spark, sf).select(F.regexp_extract("source", "([a-z]+)([0-9]+)", 1).alias("stem"), F.regexp_extract("source", "([a-z]+)([0-9]+)", 2).cast("int").alias("number")).distinct()


JANITOR = "regexp_replace(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[!-/:-@\\[-`{{-~]', '', 'g')"


@query("f29_janitor_norm", f"select doc_id, {JANITOR.format('text')} as text from documents")
def f29(spark, sf):
    return _docs(spark, sf).select("doc_id", T.janitor_normalise(F.col("text")).alias("text"))


@query("f30_error_ids", "with r as (select doc_id, 'Thought. Answer: ' || (doc_id % 4) || ', ' || (doc_id % 7) as reply from documents) select doc_id, id from (select doc_id, unnest(regexp_extract_all(string_split(reply, 'Answer: ')[-1], '[0-9]+'))::int as id from r) where id between 1 and 4")
def f30(spark, sf):
    reply = F.concat(F.lit("Thought. Answer: "), (F.col("doc_id") % 4).cast("string"), F.lit(", "), (F.col("doc_id") % 7).cast("string"))
    ids = _docs(spark, sf).select("doc_id", F.explode(F.regexp_extract_all(F.substring_index(reply, "Answer: ", -1), F.lit("[0-9]+"), F.lit(0))).alias("id")).select("doc_id", F.col("id").cast("int").alias("id"))
    return ids.where("id between 1 and 4")


@query("w1_numeric_id", f"with {V.PASSAGES} select text_id, row_number() over (order by text_id) - 1 as numeric_id from passages")
def w1(spark, sf):
    return R.number_rows(V.passages(spark, sf).select("text_id"), ["text_id"], "numeric_id")


@query("w4_running_offsets", "select source, n, (sum(n) over (order by source) - n)::bigint as start from (select source, count(*) as n from documents group by source)")
def w4(spark, sf):
    from pyspark.sql import Window

    counts = _docs(spark, sf).groupBy("source").agg(F.count("*").alias("n"))
    return counts.select("source", "n", (F.sum("n").over(Window.orderBy("source")) - F.col("n")).alias("start"))  # a row a source


@query("w5_rolling_windows", """with n as (select doc_id, len(list_filter(string_split_regex(text, '[\\s\\p{Z}]+'), lambda x: x <> ''))::bigint as n from documents),
    w as (select doc_id, n, unnest(range(greatest(ceil((n - 128) / 120.0), 0)::bigint + 1)) as i from n where n > 0)
    select doc_id, greatest(least(128 + i * 120, n) - 128, 0)::int as first, least(128 + i * 120, n)::int as last, (case when i = 0 then least(n, 128) else least(128 + i * 120, n) - (128 + (i - 1) * 120) end)::int as scored from w""")  # fmt: skip
def w5(spark, sf):
    n = F.size(T.tokens(F.col("text")))
    return _docs(spark, sf).select("doc_id", F.explode(T.rolling_windows(n, 128, 9)).alias("w")).select("doc_id", "w.first", "w.last", "w.scored")


@query("w6_word_ngrams", "with w as (select doc_id, list_filter(string_split_regex(text, '[\\s\\p{Z}]+'), lambda x: x <> '') as w from documents) select doc_id, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) as gram from w where len(w) >= 4")
def w6(spark, sf):
    return _docs(spark, sf).select("doc_id", F.explode(T.ngrams(T.tokens(F.col("text")), 4)).alias("gram"))


GRAMS = f"""dw as (select doc_id, list_filter(string_split_regex({JANITOR.format('text')}, '[\\s\\p{{Z}}]+'), lambda x: x <> '') as w from documents),
    dg as (select doc_id, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) as gram from dw where len(w) >= 13),
    bw as (select item_id, list_filter(string_split_regex({JANITOR.format('text')}, '[\\s\\p{{Z}}]+'), lambda x: x <> '') as w from benchmark),
    bg as (select item_id, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) as gram from bw where len(w) >= 13)"""


@query("d1_ngram_buckets", f"with {GRAMS} select count(*) as grams, count(distinct gram) as distinct_grams from dg")
def d1(spark, sf):
    return D.gram_counts(_docs(spark, sf), 13)


@query("a42_ngram_df", f"with {GRAMS} select gram, count(distinct doc_id) as docs from dg group by gram having count(distinct doc_id) > 3")
def a42(spark, sf):
    return D.frequent_grams(_docs(spark, sf), 13, 3)


@query("d4_contaminated_items", f"with {GRAMS} select distinct item_id from bg where gram in (select gram from dg)")
def d4(spark, sf):
    return D.contaminated_items(table(spark, sf, "benchmark"), _docs(spark, sf), 13)


@query("j12_ngram_semi", f"with {GRAMS} select doc_id, count(*) as hits from dg where gram in (select gram from bg) group by doc_id")
def j12(spark, sf):
    return D.gram_hits(_docs(spark, sf), table(spark, sf, "benchmark"), 13).groupBy("doc_id").agg(F.count("*").alias("hits"))


@query("d5_janitor_clean")
def d5(spark, sf):
    return D.clean(_docs(spark, sf), table(spark, sf, "benchmark").select("text"), 13)


@query("a43_corpus_stats", "select count(*) as docs, sum(length(text))::bigint as chars, sum(strlen(text))::bigint as bytes, max(length(text))::bigint as longest from documents")
def a43(spark, sf):
    return _docs(spark, sf).agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"), F.sum(F.octet_length("text")).alias("bytes"), F.max(F.length("text")).cast("long").alias("longest"))


@query("s9_page_text", "select page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[\\s\\p{Z}]+', ' ', 'g')) as text from pages")
def s9(spark, sf):
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]*>", " ")
    return table(spark, sf, "pages").select("page_id", T.collapse_spaces(bare).alias("text"))


@query("s11_page_sample", "select page_id from pages order by md5('42:' || page_id), page_id limit 25")
def s11(spark, sf):
    return R.hash_sample(table(spark, sf, "pages").select("page_id"), "page_id", 25, 42)


@query("s12_offset_limit", "select doc_id from documents order by doc_id limit 50 offset 100")
def s12(spark, sf):
    return _docs(spark, sf).select("doc_id").orderBy("doc_id").offset(100).limit(50)


@query("u1_union_shards", "select 'documents' as part, count(*) as n, sum(length(text))::bigint as chars from documents union all select 'benchmark', count(*), sum(length(text))::bigint from benchmark")
def u1(spark, sf):
    both = _docs(spark, sf).select(F.lit("documents").alias("part"), "text").unionByName(table(spark, sf, "benchmark").select(F.lit("benchmark").alias("part"), "text"))
    return both.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("u4_missing_docs", "select doc_id from documents except select doc_id from labels")
def u4(spark, sf):
    return _docs(spark, sf).select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left_anti").distinct()


@query("u7_distinct_concepts", "select distinct unnest(string_split(p_type, ' ')) as concept from part")
def u7(spark, sf):
    return table(spark, sf, "part").select(F.explode(F.split("p_type", " ")).alias("concept")).distinct()


@query("j4_passage_documents", "with n as (select doc_id, trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g')) as t from documents) select p.t as passage, count(*) as docs, min(n.doc_id) as first from (select distinct t from n) p join n on n.t = p.t group by p.t")
def j4(spark, sf):
    docs = _docs(spark, sf).select("doc_id", T.collapse_spaces(F.col("text")).alias("passage"))
    return docs.groupBy("passage").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first"))


@query("j5_unmapped_passages", f"with {V.PASSAGES} select count(*) as unmapped from passages p where not exists (select 1 from documents d where d.text = p.original_text)")
def j5(spark, sf):
    docs = _docs(spark, sf).select(F.col("text").alias("original_text")).distinct()
    return V.passages(spark, sf).join(docs, "original_text", "left_anti").agg(F.count("*").alias("unmapped"))


@query("j19_names_or_ids", "select d.doc_id, coalesce('labelled ' || l.quality, 'document ' || d.doc_id) as name from documents d left join labels l on l.doc_id = d.doc_id")
def j19(spark, sf):
    both = _docs(spark, sf).select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return both.select("doc_id", F.coalesce(F.concat(F.lit("labelled "), F.col("quality").cast("string")), F.concat(F.lit("document "), F.col("doc_id").cast("string"))).alias("name"))


@query("p21_integrity", "select (select count(*) from (select doc_id from documents group by doc_id having count(*) > 1)) as repeated_ids, (select count(*) from labels where doc_id not in (select doc_id from documents)) as unmapped_labels, (select count(*) from documents where text is null or text = '') as empty_texts")
def p21(spark, sf):
    docs, labels = _docs(spark, sf), table(spark, sf, "labels")
    repeated = docs.groupBy("doc_id").count().where("count > 1").agg(F.count("*").alias("repeated_ids"))
    unmapped = labels.join(docs, "doc_id", "left_anti").agg(F.count("*").alias("unmapped_labels"))
    empty = docs.agg(F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("empty_texts"))
    return repeated.crossJoin(unmapped).crossJoin(empty)  # one row each
