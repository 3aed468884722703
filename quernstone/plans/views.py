"""The graph, text and question tables that the queries run on, as views of the given tables, with the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .registry import table


def _name(kind: str, key: str):
    return F.concat(F.lit(kind + " "), F.col(key).cast("string"))


def triples(spark: SparkSession, sf: str) -> DataFrame:
    """(stage, pos, head, relation, tail, head_type, tail_type, doc): foreign keys as extracted triples.

    stage and pos give the order in which they were seen, doc the passage that states them.
    """
    orders, customer, nation = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    placed = orders.select(F.lit(1).alias("stage"), (F.col("o_orderkey") * 10).alias("pos"), _name("order", "o_orderkey").alias("head"), F.lit("placed by").alias("relation"), _name("customer", "o_custkey").alias("tail"), F.lit("event").alias("head_type"), F.lit("entity").alias("tail_type"), F.pmod("o_orderkey", F.lit(200)).cast("long").alias("doc"))
    located = customer.select(F.lit(2), F.col("c_custkey") * 10, _name("customer", "c_custkey"), F.lit("located in"), _name("nation", "c_nationkey"), F.lit("entity"), F.lit("entity"), F.pmod("c_custkey", F.lit(200)).cast("long"))
    part_of = nation.select(F.lit(3), F.col("n_nationkey").cast("long"), _name("nation", "n_nationkey"), F.lit("part of"), _name("region", "n_regionkey"), F.lit("entity"), F.lit("entity"), F.col("n_nationkey").cast("long"))
    lineitem = table(spark, sf, "lineitem")
    line = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    contains = lineitem.select(F.lit(4), line, _name("order", "l_orderkey"), F.lit("contains"), _name("part", "l_partkey"), F.lit("event"), F.lit("entity"), F.pmod("l_orderkey", F.lit(200)).cast("long"))
    supplied = lineitem.select(F.lit(5), line, _name("part", "l_partkey"), F.lit("supplied by"), _name("supplier", "l_suppkey"), F.lit("entity"), F.lit("entity"), F.pmod("l_orderkey", F.lit(200)).cast("long"))
    return placed.union(located).union(part_of).union(contains).union(supplied)


TRIPLES = """triples as (
    select 1 as stage, o_orderkey * 10 as pos, 'order ' || o_orderkey as head, 'placed by' as relation, 'customer ' || o_custkey as tail, 'event' as head_type, 'entity' as tail_type, o_orderkey % 200 as doc from orders
    union all select 2, c_custkey * 10, 'customer ' || c_custkey, 'located in', 'nation ' || c_nationkey, 'entity', 'entity', c_custkey % 200 from customer
    union all select 3, n_nationkey, 'nation ' || n_nationkey, 'part of', 'region ' || n_regionkey, 'entity', 'entity', n_nationkey from nation
    union all select 4, l_orderkey * 10 + l_linenumber, 'order ' || l_orderkey, 'contains', 'part ' || l_partkey, 'event', 'entity', l_orderkey % 200 from lineitem
    union all select 5, l_orderkey * 10 + l_linenumber, 'part ' || l_partkey, 'supplied by', 'supplier ' || l_suppkey, 'entity', 'entity', l_orderkey % 200 from lineitem)"""


def geography(spark: SparkSession, sf: str) -> DataFrame:
    """(src, dst, relation): the part of the graph above orders, small in degree below its hubs."""
    return triples(spark, sf).where("stage <= 3").select(F.col("head").alias("src"), F.col("tail").alias("dst"), "relation")


GEOGRAPHY = TRIPLES + ", edges as (select head as src, tail as dst, relation from triples where stage <= 3)"


def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    """(src, dst, relation): the whole graph, repeats kept."""
    return triples(spark, sf).select(F.col("head").alias("src"), F.col("tail").alias("dst"), "relation")


GRAPH = TRIPLES + ", edges as (select head as src, tail as dst, relation from triples)"


def passages(spark: SparkSession, sf: str) -> DataFrame:
    """(text_id, original_text): documents by the hash of their text, once each."""
    docs = table(spark, sf, "documents")
    return docs.select(T.hash_id(F.col("text"), "_text").alias("text_id"), F.col("text").alias("original_text")).distinct()


PASSAGES = "passages as (select distinct sha256(text || '_text') as text_id, text as original_text from documents)"


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """(qid, question, answer): every assistant turn as the answer to the turn before it."""
    turns = table(spark, sf, "conversations")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    both = turns.where("role = 'assistant'").join(before, ["conv_id", "turn"])
    return both.select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), "question", F.col("text").alias("answer"))


ANSWERS = "answers as (select a.conv_id * 1000 + a.turn as qid, q.text as question, a.text as answer from conversations a join conversations q on a.conv_id = q.conv_id and a.turn = q.turn + 1 where a.role = 'assistant')"


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings")


def vector_questions(spark: SparkSession, sf: str) -> DataFrame:
    """(qid, query): the search's questions, every vector whose id is divisible by 20."""
    return vectors(spark, sf).where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))


VECTORS = "questions as (select vec_id as qid, embedding as query from embeddings where vec_id % 20 = 0)"
DOT = "list_sum(list_transform(list_zip(e.embedding, q.query), lambda z: z[1]::double * z[2]::double))"
