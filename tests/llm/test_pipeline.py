"""The corpus pipeline, stage by stage, against brute force."""

from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from quernstone.llm import decontam, packing, pii, simhash
from quernstone.llm.common import materialise

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def shingle_set(text, width=5):
    return set(simhash.shingle_hashes(text.encode(), width).tolist())


def similar_pairs(texts, width=5, similarity=0.8):
    """All pairs at or over the similarity, through an index of shared shingles."""
    sets = {d: shingle_set(t, width) for d, t in texts}
    index, shared = defaultdict(list), Counter()
    for d, s in sets.items():
        for h in s:
            index[h].append(d)
    for members in index.values():
        for i, a in enumerate(members):
            for b in members[i + 1 :]:
                shared[min(a, b), max(a, b)] += 1
    return {(a, b) for (a, b), n in shared.items() if n >= similarity * (len(sets[a]) + len(sets[b]) - n) - 1e-9}


def components(keys, pairs):
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def test_near_duplicate_groups(docs):
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    pairs = similar_pairs(texts)
    want = components([d for d, _ in texts], pairs)
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()}
    firsts = set(want.values())
    assert firsts <= kept and len(kept - firsts) <= 0.01 * len(pairs) + 1


def test_recall_on_the_larger_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    first = {}  # one of each text is enough for brute force
    for d in sorted(texts):
        first.setdefault(" ".join(texts[d].lower().split()), d)
    sets = {d: shingle_set(t) for t, d in first.items()}
    index, shared = defaultdict(list), Counter()
    for d, s in sets.items():
        for h in s if len(s) < 60 else [h for h in s if h % 4 == 0]:
            index[h].append(d)
    for members in index.values():
        if len(members) <= 50:  # a pair at 0.8 shares rarer shingles too: overlaps are counted anew below
            shared.update((a, b) for i, a in enumerate(members) for b in members[i + 1 :])
    pairs = [(a, b) for a, b in shared if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    found = {r["doc"]: r["component"] for r in simhash.similar_groups(docs).select("doc", "component").collect()}
    assert len(pairs) >= 40
    assert sum(found[a] == found[b] for a, b in pairs) >= 0.99 * len(pairs)
    want = components(sets, pairs)
    groups = defaultdict(set)
    for d in sets:
        groups[found[d]].add(want[d])
    assert sum(len(g) - 1 for g in groups.values()) == 0  # nothing unlike has come together


def test_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_TEXTS", 16)  # also in the workers: what is dealt in blocks is planned here
    rng = np.random.default_rng(2)
    words = [f"w{x}" for x in rng.integers(0, 3000, 200)]
    rows = []
    for i in range(120):
        w = list(words)
        w[int(rng.integers(0, 200))] = f"new{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"v{x}" for x in rng.integers(0, 3000, 150))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = sorted(r["doc_id"] for r in simhash.drop_near_duplicates(df).collect())
    assert kept == [0, *range(1000, 1030)]


def test_spanning_links():
    rng = np.random.default_rng(8)
    for _ in range(50):
        n = int(rng.integers(1, 30))
        alike = rng.random((n, n)) < 0.06
        alike |= alike.T
        firsts = list(range(n)) if rng.random() < 0.5 else sorted(rng.choice(n, int(rng.integers(1, n + 1)), replace=False).tolist())
        links = simhash.spanning_links(n, firsts, lambda i, rows, alike=alike: alike[i][rows])
        pairs = [(i, j) for i in firsts for j in range(n) if i != j and alike[i, j]]
        assert len(links) < max(n, 1) and all(alike[i, j] for i, j in links)
        assert components(range(n), links) == components(range(n), pairs)


@pytest.mark.parametrize("block", [512, 24])
def test_hub_of_copies_unlike_each_other(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK_TEXTS", block)
    rng = np.random.default_rng(3)
    words = [f"w{x}" for x in rng.integers(0, 3000, 200)]
    rows = [(0, " ".join(words))]
    for i in range(1, 200):
        w = list(words)
        for n, at in enumerate(rng.choice(40, 3, replace=False) * 5):
            w[int(at)] = f"new{i}x{n}"
        rows.append((i, " ".join(w)))
    sets = [shingle_set(t) for _, t in rows]
    alike = [len(sets[0] & s) / len(sets[0] | s) for s in sets[1:]]
    between = [len(sets[1] & s) / len(sets[1] | s) for s in sets[2:]]
    assert min(alike) >= 0.8 and np.mean(np.array(between) < 0.8) > 0.9
    made = {}
    was = simhash.materialise

    def counted(df, name):
        out = was(df, name)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(simhash, "materialise", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert [r["doc_id"] for r in simhash.drop_near_duplicates(df).collect()] == [0]
    n = len(rows)  # no table is as long as the pairs; in blocks each may bring as many links as it has texts
    assert made["shared-postings"] <= n * simhash.TABLES and made["cluster-texts"] <= n
    if block > n:
        assert made["candidate-links"] <= 16 * n and made["verified"] < n


@pytest.mark.parametrize("edit", ["appended", "replaced"])
def test_contiguous_changes_are_found(spark, edit):
    rng = np.random.default_rng(4)
    rows, n = [], 300
    for i in range(n):
        length = int(rng.integers(100, 400))
        words = [f"w{x}" for x in rng.integers(0, 50_000, length)]
        more = [f"v{x}" for x in rng.integers(0, 50_000, length)]
        share = float(rng.uniform(0.8, 0.85))
        if edit == "appended":
            one, two = words, words + more[: int((length - 4) * (1 / share - 1))]
        else:
            cut = int((length - 4) * (1 - share) / (1 + share)) - 4
            at = int(rng.integers(0, length - cut))
            one, two = words, words[:at] + more[:cut] + words[at + cut :]
        a, b = shingle_set(" ".join(one)), shingle_set(" ".join(two))
        assert 0.8 <= len(a & b) / len(a | b) < 0.9
        rows += [(2 * i, " ".join(one)), (2 * i + 1, " ".join(two))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(df).collect()}
    assert kept >= {2 * i for i in range(n)} and len(kept) <= n + 1


def test_pipeline_stages(spark, docs):
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in at.collect()}
        at = materialise(stage(spark, at, SF), name)
        after = {r["doc_id"]: r["text"] for r in at.collect()}
        assert at.columns == docs.columns and set(after) <= set(before)
        if name == "language_id":
            assert all(not any(c.isalpha() for c in before[d]) for d in set(before) - set(after))
        if name != "pii":
            assert all(after[d] == before[d] for d in after)
        if name == "benchmark_decontamination":
            bad = {r["doc_id"] for r in decontam.contained_items(spark.createDataFrame(list(before.items()), "doc_id long, text string"), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            assert bad and set(before) - set(after) == bad
        if name == "pii":
            assert not any(pii.base_spans(t) for t in after.values())
    pieces = corpus_pipeline.STAGES[-1][1](spark, at, SF)
    tokens = packing.word_ids(packing.public_tokenizers.path("word_bpe_49k.json"))
    assert sum(r["length"] for r in pieces.collect()) == sum(len(i) // 4 + 1 for i in tokens.texts([t.encode() for t in after.values()]))


def test_run_and_odd_tables(spark, tmp_path):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "one two three four five six seven", "en", "s", 1), (3, "one two three four five six seven", "en", "s", 1), (None, "un deux trois quatre cinq", "fr", "s", 2)]
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([(1, "nothing of the kind")], "item_id long, text string").write.parquet(f"{tmp_path}/a/benchmark.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    assert {r["doc_id"] for r in got} == {3, None}
    spark.createDataFrame([], columns).write.parquet(f"{tmp_path}/b/documents.parquet")
    duckdb.sql(f"copy (select 1 as item_id, 'x' as text) to '{tmp_path}/b/benchmark.parquet'")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0


def test_language_stage_on_odd_columns(spark):
    rows = [(1, "the quick brown fox jumps over the lazy dog", "en", "x", 1.0, "a"), (2, None, "en", "y", 2.0, "b"), (3, "123 456", "en", "z", 3.0, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double, c1 string")
    got = corpus_pipeline.language_id(spark, df, SF)
    assert got.columns == df.columns and [tuple(r) for r in got.collect()] == rows[:1]
    bare = df.drop("lang")
    assert [tuple(r) for r in corpus_pipeline.language_id(spark, bare, SF).collect()] == [(1, rows[0][1], "x", 1.0, "a")]


def test_letter_junk_is_rejected(spark, docs):
    rng = np.random.default_rng(9)
    junk = [(10**9 + i, "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz     "), int(rng.integers(300, 3000)))), None, "junk", 1) for i in range(60)]
    more = docs.unionByName(spark.createDataFrame(junk, docs.schema))
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, more, SF).select("doc_id").collect()}
    assert sum(d >= 10**9 for d in kept) <= 9
    assert {r["doc_id"] for r in docs.select("doc_id", "text").collect() if any(c.isalpha() for c in r["text"] or "")} <= kept


@pytest.mark.parametrize("block", [16, 512])
def test_candidates_of_crowded_postings(spark, monkeypatch, block):
    """Components of all pairs of a posting that are alike, for members near the hub, chained to it, apart from it together, and alone."""
    monkeypatch.setattr(simhash, "BLOCK_TEXTS", block)
    rng = np.random.default_rng(11)
    fp = rng.integers(0, 256, simhash.WIDE_BYTES).astype(np.uint8)
    base = rng.integers(0, 256, simhash.MIN_BYTES).astype(np.uint8)

    def changed(sig, n):
        out = sig.copy()
        at = rng.permutation(simhash.MIN_BYTES)[:n]
        out[at] = out[at] + 1 + rng.integers(0, 200, n).astype(np.uint8)
        return out

    apart = rng.integers(0, 256, simhash.MIN_BYTES).astype(np.uint8)
    sigs = [base] + [changed(base, int(n)) for n in rng.integers(0, 60, 90)]
    sigs += [changed(sigs[int(i)], 40) for i in rng.integers(1, 91, 40)]  # alike to some member, mostly not to the hub
    sigs += [changed(apart, int(n)) for n in rng.integers(0, 30, 30)] + [rng.integers(0, 256, simhash.MIN_BYTES).astype(np.uint8) for _ in range(20)]
    ids = rng.permutation(len(sigs)) * 7 - 300
    nodes = spark.createDataFrame([(int(i), bytearray(fp.tobytes()), bytearray(s.tobytes())) for i, s in zip(ids, sigs)], "node long, fp binary, sig binary").repartition(3)
    shared = nodes.selectExpr("10L as posting", "node", f"{len(sigs)}L as n").union(nodes.where("node % 2 = 0").selectExpr("11L", "node", f"{int((ids % 2 == 0).sum())}L"))
    root = {int(i): int(i) for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p in range(len(sigs)):
        for q in range(p):
            if (sigs[p] == sigs[q]).sum() >= simhash.LEAST_AGREED:
                root[find(int(ids[p]))] = find(int(ids[q]))
    want = {frozenset(x for x in root if find(x) == r) for r in root.values() if find(r) == r}
    links = [(r.a, r.b) for r in simhash._candidate_links(shared, nodes).collect()]
    alike = {frozenset((int(ids[p]), int(ids[q]))) for p in range(len(sigs)) for q in range(p) if (sigs[p] == sigs[q]).sum() >= simhash.LEAST_AGREED}
    assert {frozenset(e) for e in links} <= alike
    root = {int(i): int(i) for i in ids}
    for a, b in links:
        root[find(a)] = find(b)
    assert {frozenset(x for x in root if find(x) == find(r)) for r in root} == want


def test_like_texts_are_dealt_once(spark, monkeypatch):
    """What a crowded posting deals grows with its texts where they are alike: twice and the hub's copies, not a block for each of its blocks."""
    monkeypatch.setattr(simhash, "BLOCK_TEXTS", 32)
    dealt = []
    plain = simhash._block_links
    monkeypatch.setattr(simhash, "_block_links", lambda d, n: dealt.append(d.count()) or plain(d, n))
    rng = np.random.default_rng(3)
    sig = rng.integers(0, 256, simhash.MIN_BYTES).astype(np.uint8)
    rows = []
    for i in range(2000):
        s = sig.copy()
        s[rng.permutation(simhash.MIN_BYTES)[:20]] = i % 251
        rows.append((i, bytearray(bytes(simhash.WIDE_BYTES)), bytearray(s.tobytes())))
    nodes = spark.createDataFrame(rows, "node long, fp binary, sig binary")
    links = simhash._candidate_links(nodes.selectExpr("1L as posting", "node", "2000L as n"), nodes)
    assert links.count() == 1999 and sum(dealt) <= 2000 + 2000 // 32 + 2
