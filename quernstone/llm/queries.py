"""The pipeline operators as queries over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontam, hmm, langid, mpegts, packing, pii, sharding, simhash, span_dedup, toxicity, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(_table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "shared", "item_shingles", "containment")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mpegts.media_features(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "timestamps", "random_access")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation as long)"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash, op2_sharding, op3_packing, op4_substring_dedup, op5_warc, op6_lm_scoring, op7_language_id, op8_pii, op9_decontamination, op10_media, op11_alignment, op12_toxicity, op13_whitening)
}

#: What DuckDB can say about them; the others are held against brute force in the tests.
ORACLE_SQL: dict[str, str] = {
    "op5_warc": """
        with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
        g as (select *, max(page_id) over (partition by payload_digest) as last_id from p)
        select page_id, payload_bytes, payload_digest,
            case when payload_bytes >= 1000 and page_id <> last_id then 'revisit' else 'response' end as record_type,
            case when payload_bytes >= 1000 and page_id <> last_id then last_id end as refers_to
        from g""",
    "op9_decontamination": """
        with words as (
            select doc_id as id, true as is_doc, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as w from documents
            union all
            select item_id, false, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') from benchmark),
        runs as (
            select id, is_doc, unnest(list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as s from words),
        sizes as (select id, count(*) as item_shingles from runs where not is_doc group by id)
        select d.id as doc_id, b.id as item_id, count(*) as shared, any_value(z.item_shingles) as item_shingles, count(*) / any_value(z.item_shingles) as containment
        from runs d join runs b on d.s = b.s and d.is_doc and not b.is_doc join sizes z on z.id = b.id
        group by d.id, b.id having count(*) >= any_value(z.item_shingles) * 0.8 - 1e-9""",
}
