"""SimHash near-duplicates through a byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import few
from .common import bounded_batches, connected_components, discard, materialise, spare_names

#: Postings of up to this many distinct fingerprints are tallied pair by pair; the fingerprints of longer ones meet in a finer index.
POSTING_PAIRS = 32
#: Shingles whose bits are tallied at once.
BLOCK = 255 * 64


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each word shingle of a UTF-8 text, A-Z lower-cased; repeats stay.

    A text with fewer words than ``width`` gives one shingle of all its words, one without words none.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= width:
        joined: Iterable[bytes] = [b" ".join(words)]
        n = 1
    else:
        joined = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
        n = len(words) - width + 1
    return np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(42)), np.uint64, n)


def majority_bits(hashes: np.ndarray) -> int:
    """The 64-bit fingerprint: a bit is 1 if it is set in over half the hashes."""
    if not len(hashes):
        return 0
    tally = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        block = hashes[at : at + BLOCK]
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        if whole:
            tally += bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        tally += bits[whole:].sum(0, dtype=np.uint8)
    return int.from_bytes(np.packbits(tally * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): the signed long of each text's fingerprint. Null and wordless texts get 0."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            fps = np.array([majority_bits(shingle_hashes(t, width)) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key), F.col(text).cast("string"))
    return rows.mapInArrow(run, f"key {kind}, fp long").withColumnRenamed("key", key)


def positional_bytes(fps: DataFrame, bytes_: int) -> DataFrame:
    """(posting, fp): the inverted index, a posting being ``bytes_`` of the eight byte positions and the bytes there."""
    masks = [sum(0xFF << 8 * i for i in chosen) for chosen in combinations(range(8), bytes_)]
    masked = [F.xxhash64(F.lit(n), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) * (m >> 63)).cast("long"))) for n, m in enumerate(masks)]
    return fps.select(F.explode(F.array(*masked)).alias("posting"), "fp")


def tallied_pairs(fps: DataFrame, bytes_: int, least: int, name: str) -> tuple[DataFrame, DataFrame]:
    """(pairs, crowded): pairs (a, b), a < b, that share ``least`` postings of ``bytes_`` positional bytes, and the fingerprints in postings of over POSTING_PAIRS.

    Such a long posting is not paired up, so two crowded fingerprints may be missing: they go another way.
    """
    index = positional_bytes(fps, bytes_)
    sizes = materialise(index.groupBy("posting").agg(F.count("*").alias("n")).where("n > 1"), f"{name}-sizes")
    shared = materialise(index.join(sizes, "posting"), f"{name}-shared")
    discard(sizes)
    met = shared.where(F.col("n") <= POSTING_PAIRS).groupBy("posting").agg(F.sort_array(F.collect_list("fp")).alias("m"))
    later = F.transform("m", lambda a, i: F.struct(a.alias("a"), F.slice("m", i + 2, POSTING_PAIRS).alias("bs")))
    pairs = met.select(F.explode(later).alias("p")).select("p.a", F.explode("p.bs").alias("b"))
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("tally")).where(F.col("tally") >= least).select("a", "b")
    return pairs, shared.where(F.col("n") > POSTING_PAIRS).select("fp").distinct()


def near_fingerprints(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct ``fp`` within ``max_bits`` (at most 2).

    Differing bits spoil at most ``max_bits`` of the 8 positional bytes, so a pair has at least 6 in common and with
    them C(6, 5) = 6 postings of five bytes each: the tally that a candidate must reach before its bits are compared.
    Fingerprints in postings of over POSTING_PAIRS meet again in the finer index of as many bytes as any
    pair has in common, where one posting is enough. In postings that are too long even there they meet in the values
    one bit away from them (any two within 2 bits have one in common, and a value has at most 65
    fingerprints at that distance), each linked to the smallest there and nothing lost.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits is 0, 1 or 2")
    common = 8 - max_bits
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    pairs, crowded = tallied_pairs(fps, common - 1, common, "postings")
    crowded = materialise(crowded, "crowded")
    finer, dense = tallied_pairs(crowded, common, 1, "finer-postings")
    pairs = pairs.unionByName(finer).where(close)
    dense = materialise(dense, "dense")
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64) * (i == 63)).cast("long")) for i in range(64)])
    around = dense.select("fp", F.explode(flips).alias("value"))
    if max_bits == 2:
        met = around.groupBy("value").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
        met = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    else:
        met = around.join(dense.withColumnRenamed("fp", "value"), "value", "left_semi").where("fp < value" if max_bits else "false").select(F.col("fp").alias("a"), F.col("value").alias("b"))
    return pairs.unionByName(met).distinct()


def near_duplicates(docs: DataFrame, width: int = 3, max_bits: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id) for every row.

    Fingerprints link at ``max_bits`` or fewer differing bits; component_id is the smallest key
    reachable, the row's own included. Null, empty and wordless texts have fingerprint zero and link like
    any other. Rows with equal keys each keep their row. A null key keeps its row and never names a
    component that has another key. An empty table gives an empty result; other columns are ignored.
    """
    base = materialise(fingerprints(docs, width, key, text), "fingerprints")
    fps = materialise(base.groupBy("fp").agg(F.min(key).alias("least")), "distinct-fingerprints")
    parts = connected_components(near_fingerprints(fps.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    classes = fps.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = classes.join(least, "component").select("fp", "component_id")
    out = base.join(classes, "fp")
    return out.select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Bytes of a wide fingerprint.
WIDE_BYTES = 64
#: Bytes of a signature, index tables, and positional bytes of a table's key. A signature's byte agrees as often as two shingle sets are similar,
#: whatever the edit: a pair at 0.8 meets in no table with a chance of 1.3 in ten thousand.
MIN_BYTES = 128
TABLES = 64
KEY_BYTES = 7
#: Positions that a candidate pair must share. Of the WIDE_BYTES a pair at 0.8 has 17 in common at the mean (sets of four and five, where bits tie, 12),
#: of the MIN_BYTES 102 with a deviation of 4.5: the least is 4.5 deviations below.
LEAST_SHARED = 3
LEAST_AGREED = 82
#: Texts of a block, and bytes of text at which it is cut smaller.
BLOCK_TEXTS = 512
BLOCK_BYTES = 8 << 20
#: Postings that hold more than this share of all index rows, so at most ten thousand, are dealt by broadcast.
HOT_SHARE = 1e-4


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """WIDE_BYTES bytes: each distinct hash votes on eight times its bits, stretched by odd multipliers."""
    out = np.zeros(WIDE_BYTES, np.uint8)
    if len(hashes):
        mixed = np.unique(hashes)
        for i in range(WIDE_BYTES // 8):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + np.uint64(2 * i + 1)
            word = mixed ^ mixed >> np.uint64(29)
            word = word * np.uint64(0xBF58476D1CE4E5B9)
            out[i * 8 : i * 8 + 8] = np.frombuffer(majority_bits(word ^ word >> np.uint64(32)).to_bytes(8, "little"), np.uint8)
    return out


def min_signature(hashes: np.ndarray) -> np.ndarray:
    """MIN_BYTES bytes: for each odd multiplier a byte of the hash whose product is the smallest."""
    factors = np.random.default_rng(7).integers(0, 1 << 64, MIN_BYTES, np.uint64) | np.uint64(1)
    if not len(hashes):
        return np.zeros(MIN_BYTES, np.uint8)
    mixed, least = np.unique(hashes), np.full(MIN_BYTES, np.iinfo(np.uint64).max)
    for at in range(0, len(mixed), 1024):
        least = np.minimum(least, (factors[:, None] * mixed[at : at + 1024]).min(1))
    return (least * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.uint8)


def _tables() -> np.ndarray:
    """The positions that make up each table's key, the same everywhere."""
    rng = np.random.default_rng(5)
    return np.array([rng.permutation(MIN_BYTES)[:KEY_BYTES] for _ in range(TABLES)])


def _wide(docs: DataFrame, width: int, key: str, text: str) -> DataFrame:
    """(doc, text_hash, size, node, fp, sig) for every row, of the sets that decide; texts of equal words have equal nodes."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            nodes = [xxhash.xxh3_64_intdigest(b" ".join((t or b"").lower().split())) - (1 << 63) for t in texts]
            sets = (shingle_hashes(t, width) for t in texts)
            prints = [(wide_fingerprint(s).tobytes(), min_signature(s).tobytes()) for s in sets]
            fps, sigs = (pa.array([p[i] for p in prints], pa.binary()) for i in (0, 1))
            sizes = pa.array([len(t or b"") for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sizes, pa.array(nodes, pa.int64()), fps, sigs], ["doc", "text_hash", "size", "node", "fp", "sig"])

    kind = docs.schema[key].dataType.simpleString()
    body = F.col(text).cast("string")
    return docs.select(F.col(key), F.xxhash64(body), body).mapInArrow(run, f"doc {kind}, text_hash long, size long, node long, fp binary, sig binary")


def _postings(nodes: DataFrame) -> DataFrame:
    """(posting, node): TABLES rows a text, a posting being a table and the bytes at its positions."""
    tables = _tables()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, MIN_BYTES)
            keys = np.broadcast_to(np.arange(TABLES, dtype=np.int64), (len(sigs), TABLES)).copy()
            for b in range(KEY_BYTES):
                keys = keys << 8 | sigs[:, tables[:, b]]
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(np.array(batch.column(0)), TABLES))], ["posting", "node"])

    return nodes.select("node", "sig").mapInArrow(run, "posting long, node long")


def _shared_postings(nodes: DataFrame) -> DataFrame:
    """(posting, node, n) of the postings that n > 1 texts share. Of those that hold a notable share of all rows only the counts move."""
    index = materialise(_postings(nodes), "postings")
    sizes = materialise(index.groupBy("posting").agg(F.count("*").alias("n")).where("n > 1"), "posting-sizes")
    hot = F.col("n") > max(1000, int(index.count() * HOT_SHARE))
    crowded = F.broadcast(sizes.where(hot))
    rest = index.join(crowded.select("posting"), "posting", "left_anti").join(sizes.where(~hot), "posting")
    out = materialise(rest.unionByName(index.join(crowded, "posting")), "shared-postings")
    discard(index, sizes)
    return out


def spanning_links(n: int, firsts: Iterable[int], alike: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links among rows 0 to n - 1 that bring together what all pairs with one end in ``firsts`` would for which ``alike(i, rows)`` holds.

    A row is compared only with rows that haven't come together with it yet, so there are fewer than n links.
    """
    label, done, links = np.arange(n), np.zeros(n, bool), []
    for i in firsts:
        done[i] = True
        rest = np.flatnonzero((label != label[i]) & ~done)
        if not len(rest):
            continue
        for j in rest[alike(i, rest)]:
            if label[j] != label[i]:
                links.append((i, int(j)))
                label[label == label[j]] = label[i]
    return links


def _block_links(dealt: DataFrame, nodes: DataFrame) -> DataFrame:
    """(posting, a, b): links whose components are those of all pairs of a block (posting, i, j, node, first) with one end ``first`` whose tallies of shared positional bytes reach their least."""
    members = dealt.join(nodes.select("node", "fp", "sig"), "node").groupBy("posting", "i", "j").agg(F.collect_list(F.struct("node", "first", "fp", "sig")).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, m = batch.column(1).offsets.to_numpy(), batch.column(1).values
            ids, firsts = m.field("node").to_numpy(), m.field("first").to_numpy(zero_copy_only=False)
            fps = np.frombuffer(b"".join(m.field("fp").to_pylist()), np.uint8).reshape(-1, WIDE_BYTES)
            sigs = np.frombuffer(b"".join(m.field("sig").to_pylist()), np.uint8).reshape(-1, MIN_BYTES)
            links: set[tuple[int, int, int]] = set()
            for posting, begin, end in zip(batch.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                node, at = np.unique(ids[begin:end], return_index=True)
                fp, sig = fps[begin:end][at], sigs[begin:end][at]
                first = np.unique(np.searchsorted(node, ids[begin:end][firsts[begin:end]]))

                def alike(i: int, rows: np.ndarray, fp=fp, sig=sig) -> np.ndarray:
                    return ((sig[rows] == sig[i]).sum(1) >= LEAST_AGREED) & ((fp[rows] == fp[i]).sum(1) >= LEAST_SHARED)

                for i, j in spanning_links(len(node), first.tolist(), alike):
                    a, b = int(node[i]), int(node[j])
                    links.add((posting, min(a, b), max(a, b)))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in range(3)], ["posting", "a", "b"])

    return members.select("posting", "m").mapInArrow(run, "posting long, a long, b long")


def _candidate_links(shared: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): links whose components are those of all pairs that meet in a posting and whose tallies of shared positional bytes reach their least.

    In a posting of over BLOCK_TEXTS texts all are first compared with its hub, the smallest node, which every block of them gets. Those
    that it isn't linked to must still meet all of the posting, and only they are dealt in blocks, so rows grow with
    the posting where its texts are alike, and with its texts times the blocks of outsiders where they aren't.
    """
    parts = F.ceil(F.col("n") / BLOCK_TEXTS)
    none = F.lit(0).cast("long")
    numbers = lambda n: F.explode(F.sequence(none, F.col(n) - 1))
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    sized = shared.select("posting", "node", parts.alias("parts"))
    single = sized.where("parts = 1").select("posting", none.alias("i"), none.alias("j"), "node", F.lit(True).alias("first"))
    crowd = sized.where("parts > 1")
    if crowd.isEmpty():
        return _block_links(single, nodes).select("a", "b").distinct()
    hubs = crowd.groupBy("posting").agg(F.min("node").alias("node"), F.first("parts").alias("parts"))
    rays = crowd.select("posting", block("parts").alias("i"), none.alias("j"), "node", F.lit(False).alias("first"))
    rays = rays.unionByName(hubs.select("posting", numbers("parts").alias("i"), none.alias("j"), "node", F.lit(True).alias("first")))
    near = materialise(_block_links(single.unionByName(rays), nodes), "near-links")
    # only hubs' links matter here; those of single postings name no crowd's
    joined = near.select("posting", F.explode(F.array("a", "b")).alias("node")).distinct()
    outside = materialise(crowd.join(joined, ["posting", "node"], "left_anti"), "outsiders")
    high = few(outside.groupBy("posting").agg(F.ceil(F.count("*") / BLOCK_TEXTS).alias("high")))  # a posting may be a hot key; few have outsiders
    left = outside.join(high, "posting").select("posting", block("high").alias("i"), numbers("parts").alias("j"), "node", F.lit(True).alias("first"))
    right = crowd.join(high, "posting").select("posting", numbers("high").alias("i"), block("parts").alias("j"), "node", F.lit(False).alias("first"))
    far = materialise(_block_links(left.unionByName(right), nodes), "far-links")
    out = materialise(near.unionByName(far).select("a", "b").distinct(), "met-links")
    discard(near, far, outside)
    return out


def _texts_of(members: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """``members`` (with doc and text_hash) and the body of each."""
    body = F.col(text).cast("string")
    texts = docs.select(F.col(key).alias("d"), F.xxhash64(body).alias("h"), body.alias("body"))
    both = members.join(texts, F.col("doc").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")))
    return both.drop("d", "h", "doc", "text_hash").dropDuplicates(["node"])


def _verified_links(blocks: DataFrame, width: int, similarity: float) -> DataFrame:
    """(a, b): links whose components are those of all similar pairs of a row's ``m``, arrays of (node, first, body), with one end ``first``.

    Pairs are compared by their whole sets of ``width``-word shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                m = batch.column(0)[row].values
                found: dict[int, tuple[bool, bytes]] = {}
                for node, first, body in zip(m.field("node").to_pylist(), m.field("first").to_pylist(), m.field("body").cast(pa.binary()).to_pylist(), strict=True):
                    found[node] = (first or node in found and found[node][0], body)
                ids = sorted(found)
                sets = [np.unique(shingle_hashes(found[node][1], width)) for node in ids]
                sizes = np.array([len(s) for s in sets])
                _, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
                own = np.repeat(np.arange(len(ids)), sizes)
                met = often[at] > 1  # a shingle of one text alone is in no pair
                own, at = own[met], at[met]
                begin = np.searchsorted(own, np.arange(len(ids) + 1))
                mark = np.zeros(len(often), bool)

                def alike(i: int, rows: np.ndarray, sizes=sizes, own=own, at=at, begin=begin, mark=mark, n=len(ids)) -> np.ndarray:
                    mark[at[begin[i] : begin[i + 1]]] = True
                    if len(rows) < 8:
                        both = np.array([mark[at[begin[r] : begin[r + 1]]].sum() for r in rows])
                    else:
                        both = np.bincount(own[mark[at]], minlength=n)[rows]
                    mark[at[begin[i] : begin[i + 1]]] = False
                    return both >= similarity * (sizes[i] + sizes[rows] - both) - 1e-9

                links = [(ids[i], ids[j]) for i, j in spanning_links(len(ids), [i for i, node in enumerate(ids) if found[node][0]], alike)]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

    bounded_batches(blocks.sparkSession, 20)
    out = materialise(blocks.mapInArrow(run, "a long, b long"), "verified")
    bounded_batches(blocks.sparkSession)
    return out


def _crowd_links(crowd: DataFrame, degrees: DataFrame, width: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(links, blocks) of the members (cluster, node, size, body, parts) of clusters that are no single block.

    All are first compared with their cluster's hub, the text with most candidate links; ``links`` are those
    found. The others must still meet all members, these too: ``blocks`` are dealt so that any such pair is in one.
    """
    hubs = crowd.select("cluster", "node", "body", "parts").join(degrees, "node").groupBy("cluster").agg(F.max_by(F.struct("node", "body", "parts"), F.struct("degree", "node")).alias("h"))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    hub = hubs.select("cluster", "h.*").select("cluster", numbers("parts").alias("i"), "node", F.lit(True).alias("first"), "body")
    rays = crowd.select("cluster", block("parts").alias("i"), "node", F.lit(False).alias("first"), "body").unionByName(hub)
    links = _verified_links(rays.groupBy("cluster", "i").agg(F.collect_list(F.struct("node", "first", "body")).alias("m")).select("m"), width, similarity)
    joined = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    outside = crowd.join(joined, "node", "left_anti")
    high = outside.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("size") / BLOCK_BYTES)).alias("high"))
    left = outside.join(high, "cluster").select("cluster", block("high").alias("i"), numbers("parts").alias("j"), "node", F.lit(True).alias("first"), "body")
    right = crowd.join(high, "cluster").select("cluster", numbers("high").alias("i"), block("parts").alias("j"), "node", F.lit(False).alias("first"), "body")
    blocks = left.unionByName(right).groupBy("cluster", "i", "j").agg(F.collect_list(F.struct("node", "first", "body")).alias("m")).select("m")
    return links, blocks


def similar_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, text_hash, node, component) for every row: groups of texts similar by their word shingles.

    Candidates are texts that agree in the signature bytes of one of TABLES keys of the positional index
    and whose tallies of shared bytes reach LEAST_AGREED positions of the signature and LEAST_SHARED of the wide
    SimHash fingerprint. Both are of the sets that decide, so a candidate's chance hangs on its
    similarity alone and not on the kind of edit; a pair at 0.8 is missed with a chance of a few in ten thousand,
    more in sets of five. Texts of equal words are one node.

    A posting passes on a spanning forest of its candidate pairs, never the pairs themselves (``_candidate_links``), and the
    texts that such forests join are a cluster. Within a cluster any two texts are compared by the Jaccard
    similarity of their ``width``-word shingle sets unless they have come together by other links, so no unlike texts are
    linked and no candidate is left out; this too gives a forest. Clusters of more than a block are dealt
    in blocks (``_crowd_links``). Rows grow with the texts and, in a cluster of several blocks, with the blocks that each meets.
    """
    base = materialise(_wide(docs, width, key, text), "wide")
    nodes = base.groupBy("node").agg(F.min(F.struct("doc", "text_hash", "size", "fp", "sig")).alias("r")).select("node", "r.*")
    nodes = materialise(nodes, "wide-nodes")
    shared = _shared_postings(nodes)
    met = materialise(_candidate_links(shared, nodes), "candidate-links")
    discard(shared)
    clusters = connected_components(met).withColumnRenamed("component", "cluster")
    members = nodes.select("node", "doc", "text_hash", "size").join(clusters, "node")
    counts = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("size") / BLOCK_BYTES)).alias("parts"))
    members = materialise(_texts_of(members.join(counts, "cluster"), docs, key, text), "cluster-texts")
    single = members.where("parts <= 1").groupBy("cluster").agg(F.collect_list(F.struct("node", F.lit(True).alias("first"), "body")).alias("m")).select("m")
    crowd = members.where("parts > 1")
    links = [_verified_links(single, width, similarity)]
    if crowd.limit(1).count():
        degrees = met.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
        rays, blocks = _crowd_links(crowd, degrees, width, similarity)
        links += [rays, _verified_links(blocks, width, similarity)]
    labels = connected_components(reduce(DataFrame.unionByName, links))
    out = base.select("doc", "text_hash", "node").join(labels, "node", "left")
    out = materialise(out.select("doc", "text_hash", "node", F.coalesce("component", "node").alias("component")), "groups")
    discard(base, nodes, met, members, *links)
    return out


def drop_near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` of which one document a group stays, the one of the smallest key (nulls last).

    Null and wordless texts are one group. Rows that repeat both key and text are the same document and
    stay or go together. An empty table stays empty; columns are as they were, whatever their names.
    """
    groups = similar_groups(docs, width, similarity, key, text)
    first = groups.groupBy("component").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "text_hash")).alias("r"))
    kept, hashed = spare_names(docs, "kept", "hash")
    chosen = first.select(F.col("r.doc").alias(kept), F.col("r.text_hash").alias(hashed))
    return docs.join(chosen, F.col(key).eqNullSafe(F.col(kept)) & (F.xxhash64(F.col(text).cast("string")) == F.col(hashed)), "left_semi")
