"""From documents to the graph's tables: filter, chunk, extract, explode, number, join."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scratch import cut
from . import graph as G
from . import relational as R


@dataclass(frozen=True)
class Config:
    """What a build takes; the sizes are in characters and rows."""

    languages: tuple[str, ...] = ("en", "zh-CN", "zh-HK")
    chunk_size: int = 8192
    chunk_overlap: int = 0
    collapse_spaces: bool = False
    deduplicate: bool = False
    shard: int = 0
    shards: int = 1
    include_concepts: bool = True


def chunks(docs: DataFrame, config: Config, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, chunk_id, text) of this shard's documents in the wanted languages; with ``deduplicate``, a chunk once a document."""
    kept = docs.where(F.coalesce(lang, F.lit("en")).isin(*config.languages))
    if config.shards > 1:
        kept = R.shard_slices(kept.select(key, text), [key], config.shards).where(F.col("shard") == config.shard)
    body = T.collapse_spaces(F.col(text)) if config.collapse_spaces else F.col(text)
    out = kept.select(key, F.posexplode(T.chunk(body, config.chunk_size, config.chunk_overlap)).alias("chunk_id", "text"))
    if config.deduplicate:
        out = out.groupBy(key, "text").agg(F.min("chunk_id").alias("chunk_id")).select(key, "chunk_id", "text")
    return out


def record_triples(records: DataFrame) -> DataFrame:
    """(at, head, relation, tail, head_type, tail_type, doc) of extraction records (file, line, ...), in the order they are seen.

    Entity triples come first, then event triples, then participations; ``at`` is a total order, ``doc`` the passage's hash.
    """
    passage = T.hash_id(T.passage_of_prompt(F.col("original_text")), "_text")
    base = records.select("file", "line", passage.alias("doc"), "entity_relation_dict", "event_relation_dict", "event_entity_dict")

    def stage(number: int, column: str, kind: str):
        rows = base.select("file", "line", "doc", F.posexplode(column).alias("pos", "t"))
        return rows.select(F.struct("file", "line", F.lit(number).alias("stage"), "pos", F.lit(0).alias("sub")).alias("at"), F.col("t.Head").alias("head"), F.col("t.Relation").alias("relation"), F.col("t.Tail").alias("tail"), F.lit(kind).alias("head_type"), F.lit(kind).alias("tail_type"), "doc")

    parts = base.select("file", "line", "doc", F.posexplode("event_entity_dict").alias("pos", "t")).select("file", "line", "doc", "pos", "t.Event", F.posexplode("t.Entity").alias("sub", "entity"))
    parts = parts.select(F.struct("file", "line", F.lit(2).alias("stage"), "pos", "sub").alias("at"), F.col("Event").alias("head"), F.lit("is participated by").alias("relation"), F.col("entity").alias("tail"), F.lit("event").alias("head_type"), F.lit("entity").alias("tail_type"), "doc")
    return G.valid_triples(stage(0, "entity_relation_dict", "entity").unionByName(stage(1, "event_relation_dict", "event")).unionByName(parts))


def tables(records: DataFrame) -> dict[str, DataFrame]:
    """The five tables of a build: nodes, edges, passages, mentions and the work list. Triples and nodes, which several of them share, are made once and written."""
    triples = cut(record_triples(records), "build-triples")
    nodes = cut(G.first_seen_nodes(triples, F.col("at")), "build-nodes")
    text = T.passage_of_prompt(F.col("original_text"))
    passages = records.select(T.hash_id(text, "_text").alias("text_id"), text.alias("original_text")).distinct()
    edges = triples.select(F.col("head").alias("src"), F.col("tail").alias("dst"), "relation", "at")
    return {"nodes": nodes.select("name", "type"), "edges": edges, "passages": passages, "mentions": nodes.select("name", F.col("doc").alias("text_id")), "worklist": G.worklist(nodes, triples)}
