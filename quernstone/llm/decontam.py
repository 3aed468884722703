"""Benchmark decontamination: size-partitioned MinHash containment search, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, spare_names

#: Sketch rows up to which the sketch is broadcast (16 bytes each); above, the join shuffles.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits. Null gives none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles(words: Column, width: int, hashed: bool) -> Column:
    """Shingles of an array of words, repeats included; an array of fewer words is one shingle, an empty one none.

    The array is bound to a variable first, so that it is made once and not again for every shingle.
    """
    kind = "array<bigint>" if hashed else "array<string>"

    def make(parts: list[Column]) -> Column:
        return F.xxhash64(*parts) if hashed else F.concat_ws(" ", *parts)

    def runs(w: Column) -> Column:
        several = F.transform(F.sequence(F.lit(1), F.size(w) - width + 1), lambda i: make([F.element_at(w, i + j) for j in range(width)]))
        whole = F.array_join(w, " ")
        one = F.array(F.xxhash64(whole) if hashed else whole)
        return F.when(F.size(w) >= width, several).when(F.size(w) > 0, one).otherwise(F.array().cast(kind))

    return F.element_at(F.transform(F.array(words), runs), 1)


def sketches(items: DataFrame, width: int, similarity: float, item_key: str, text: str) -> DataFrame:
    """(item, hash, needed): each item's bottom hashes, as many as its size class asks for.

    Items are partitioned by size, class k those of 2^k to 2^(k+1)-1 distinct shingles. A document
    that holds a share s of an item's n shingles misses at most n - ceil(s n) of any subset. The
    class's sketch size exceeds that for its largest items, so at least ``needed`` >= 1 of the item's
    bottom hashes are then in the document: no contained item escapes.
    """
    sized = items.select(F.col(item_key).alias("item"), F.array_sort(F.array_distinct(shingles(words(F.col(text)), width, True))).alias("hashes"))
    sized = sized.where(F.size("hashes") > 0).withColumn("n", F.size("hashes"))
    sized = sized.withColumn("class", F.floor(F.log2(F.col("n").cast("double"))).cast("int"))
    missed = F.col("n") - F.ceil(F.col("n") * similarity - 1e-9)
    class_size = F.floor((F.pow(F.lit(2.0), F.col("class") + 1) - 1) * (1 - similarity) + 1e-9) + 1
    sized = sized.withColumn("size", F.least(F.col("n"), F.greatest(class_size, missed + 1)).cast("int"))
    return sized.select("item", (F.col("size") - missed).cast("int").alias("needed"), F.explode(F.slice("hashes", 1, F.col("size"))).alias("hash"))


def contained_items(docs: DataFrame, items: DataFrame, width: int = 5, similarity: float = 0.8, key: str = "doc_id", item_key: str = "item_id", text: str = "text", item_text: str = "text") -> DataFrame:
    """(key, text_hash, item_key, shared, item_shingles, containment) of documents that contain an item.

    An item counts as contained if at least ``similarity`` of its distinct ``width``-word shingles are
    in the document. Candidates come from the items' MinHash sketches, probed with every shingle of every
    whole document and tallied; each is verified on the shingles themselves. The sketch is broadcast if
    it has at most BROADCAST_ROWS rows, else both sides shuffle on the hash. Items without words are
    contained nowhere; null and empty documents contain none. One row for each (key, text, item),
    however often the row repeats; items with equal keys are taken as they come. Other columns are ignored.
    """
    wanted = materialise(sketches(items, width, similarity, item_key, item_text), "sketches")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    body = docs.select(F.col(key).alias("doc"), F.col(text).cast("string").alias("body"), F.xxhash64(F.col(text).cast("string")).alias("text_hash"))
    probes = body.select("doc", "text_hash", F.explode(shingles(words(F.col("body")), width, True)).alias("hash"))
    hits = probes.join(wanted, "hash").groupBy("doc", "text_hash", "item", "needed").agg(F.count_distinct("hash").alias("hits"))
    pairs = materialise(hits.where("hits >= needed").select("doc", "text_hash", "item"), "candidates")
    texts = body.join(pairs.select("doc", "text_hash").distinct().withColumnsRenamed({"doc": "d", "text_hash": "h"}), F.col("doc").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left_semi")
    texts = texts.dropDuplicates(["doc", "text_hash"]).withColumnsRenamed({"doc": "d", "text_hash": "h"})
    both = pairs.join(texts, F.col("doc").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")))
    own = items.select(F.col(item_key).alias("i"), F.array_distinct(shingles(words(F.col(item_text)), width, False)).alias("item_set"))
    both = both.join(own, F.col("item").eqNullSafe(F.col("i")))
    held = F.size(F.array_intersect("item_set", shingles(words(F.col("body")), width, False)))
    found = both.select("doc", "text_hash", "item", F.size("item_set").cast("long").alias("item_shingles"), held.cast("long").alias("shared"))
    found = found.withColumn("containment", F.col("shared") / F.col("item_shingles")).where(F.col("shared") >= F.col("item_shingles") * similarity - 1e-9)
    return found.select(F.col("doc").alias(key), "text_hash", F.col("item").alias(item_key), "shared", "item_shingles", "containment")


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that contain no item, with their columns as they were, whatever their names."""
    bad, hashed = spare_names(docs, "bad", "hash")
    found = contained_items(docs, items, width, similarity, key, text=text).select(F.col(key).alias(bad), F.col("text_hash").alias(hashed)).distinct()
    return docs.join(found, F.col(key).eqNullSafe(F.col(bad)) & (F.xxhash64(F.col(text).cast("string")) == F.col(hashed)), "left_anti")
