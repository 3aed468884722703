"""The pipeline operators against brute force on whole small tables, and on awkward rows."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import types as T
from tokenizers import Tokenizer

from quernstone.llm import common, decontam, hmm, langid, mpegts, packing, pii, queries, sharding, simhash, span_dedup, warc

SF = "/root/testdata/sf0.01"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("key", T.StringType()), T.StructField("fp", T.LongType()), T.StructField("text_hash", T.LongType()), T.StructField("size", T.LongType())])
LONG = " ".join(f"word{i % 977}x{i % 13}." for i in range(30_000))
ODD = [
    (1, None, "en", None, None, "k", 1, 2, 3),
    (2, "", None, "s", 0, "k", 1, 2, 3),
    (3, "the quick brown fox jumps over the lazy dog and runs away", "en", "s", 1, None, None, None, None),
    (4, "the quick brown fox jumps over the lazy dog and runs away", "en", "s", 1, None, None, None, None),
    (4, "the quick brown fox jumps over the lazy dog and runs away", "en", "s", 1, None, None, None, None),
    (5, LONG, "fr", "s", 1, None, None, None, None),
    (6, " \t\n ", "fr", "s", 1, None, None, None, None),
    (7, "été Ü 中文 ！", "de", "s", 1, None, None, None, None),
    (None, "mail a.b@c.de or +49 (30) 1234567 now", None, None, None, None, None, None, None),
    (8, "12345 !! 4111 1111 1111 1111 and 10.0.0.1 and 999.1.1.1", "de", "s", 1, None, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows():
    return duckdb.sql(f"select doc_id, text, lang from '{SF}/documents.parquet' order by doc_id").fetchall()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).repartition(2)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    runs = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints):
    """Union-find over all pairs of (id, fingerprint)."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    fps = np.array([f for _, f in prints], np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 2):
            root[find(i + 1 + int(j))] = find(i)
    least = defaultdict(list)
    for i, (key, _) in enumerate(prints):
        least[find(i)].append(key)
    return [min((k for k in least[find(i)] if k is not None), default=None) for i in range(len(prints))]


def check_simhash(got, texts):
    want = [(k, brute_fingerprint(t)) for k, t in texts]
    parts = brute_components(want)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted([(k, f"{f:016x}", c) for (k, f), c in zip(want, parts, strict=True)], key=key)


def test_simhash_matches_all_pairs(docs, rows):
    check_simhash([tuple(r) for r in simhash.near_duplicates(docs).collect()], [(d, t) for d, t, _ in rows])


def test_simhash_odd_rows(odd, none):
    check_simhash([tuple(r) for r in simhash.near_duplicates(odd).collect()], [(r[0], r[1]) for r in ODD])
    assert simhash.near_duplicates(none).count() == 0


def test_long_postings_lose_no_link(spark):
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 1 << 63))
    fps = {centre}
    for _ in range(400):
        f = centre
        for b in rng.integers(0, 64, rng.integers(1, 4)):
            f ^= 1 << int(b)
        fps.add(f)
    fps |= {int(x) for x in rng.integers(0, 1 << 63, 50)}
    fps = sorted(fps)
    signed = spark.createDataFrame([(f - (1 << 64) * (f >> 63),) for f in fps], "fp long")
    parts = {r["node"]: r["component"] for r in common.connected_components(simhash.near_fingerprints(signed)).collect()}
    want = brute_components(list(zip(fps, fps, strict=True)))
    groups, got = defaultdict(set), defaultdict(set)
    for f, w in zip(fps, want, strict=True):
        s = f - (1 << 64) * (f >> 63)
        groups[w].add(f)
        got[parts.get(s, s)].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


@pytest.mark.parametrize("small", [0, 5, common.SMALL_GRAPH])
def test_components_of_chains(spark, monkeypatch, small):
    monkeypatch.setattr(common, "SMALL_GRAPH", small)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001), (7, 7), (2000, 2000)]
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(201), 0) | {1000: 1000, 1001: 1000, 2000: 2000}


def brute_hilbert(point, bits):
    """Index on the curve by following its recursive definition through Skilling's transform on plain integers."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    return sum((x[i] >> b & 1) << (b * n + n - 1 - i) for b in range(bits) for i in range(n))


def test_hilbert_curve(spark):
    from pyspark.sql import functions as F

    grid = spark.range(512).select((F.col("id") % 8).alias("a"), (F.floor(F.col("id") / 8) % 8).alias("b"), F.floor(F.col("id") / 64).alias("c"))
    got = {(a, b, c): h for a, b, c, h in grid.select("a", "b", "c", sharding.hilbert_index([F.col("a"), F.col("b"), F.col("c")], 3)).collect()}
    assert got == {p: brute_hilbert(p, 3) for p in got}
    path = [p for p, _ in sorted(got.items(), key=lambda x: x[1])]
    assert all(sum(abs(i - j) for i, j in zip(a, b, strict=True)) == 1 for a, b in zip(path, path[1:], strict=False))


def check_shards(got, texts):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts)
    shards = defaultdict(list)
    for r in got:
        assert r["law"] == "rows" and r["grown_shard"] is None
        shards[r["shard"]].append(r)
    counts = [len(shards.get(i, [])) for i in range(16)]
    assert max(counts) - min(counts) <= 1 and set(shards) <= set(range(16))
    last = None
    for i in sorted(shards):
        run = sorted(shards[i], key=lambda r: r["slot"])
        assert [r["slot"] for r in run] == list(range(len(run)))
        places = [(r["hilbert"], r["doc_id"] is not None, r["doc_id"] or 0) for r in run]
        assert places == sorted(places) and (last is None or last <= places[0])
        last = places[-1]


def test_shards(docs, rows, odd, none):
    check_shards(sharding.shard(docs).collect(), [(d, t) for d, t, _ in rows])
    check_shards(sharding.shard(odd).collect(), [(r[0], r[1]) for r in ODD])
    assert sharding.shard(none).count() == 0
    assert sharding.shard_manifest(sharding.shard(docs)).count() == 16


def check_pieces(got, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = Counter()
    for d, t in texts:
        ids[d, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])] += 1
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for key in {d for d, _ in texts}:
        stream = sorted(by_doc[key], key=lambda r: (r["sequence_id"], r["offset"]))
        at, found = 0, Counter()
        current: list[int] = []
        for r in stream:
            assert r["start"] == len(current)
            current += np.frombuffer(r["ids"], "<u4").tolist()
            assert r["length"] * 4 == len(r["ids"])
            if len(current) == r["doc_tokens"]:
                found[key, tuple(current)] += 1
                current = []
        assert not current and not at
        assert found == Counter({k: n for k, n in ids.items() if k[0] == key})
    total = sum(len(k[1]) * n for k, n in ids.items())
    assert sorted(by_seq) == list(range(-(-total // 2048)))
    for s, pieces in by_seq.items():
        end = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == end
            end += r["length"]
        assert end == (2048 if s < len(by_seq) - 1 else total - 2048 * s)


def test_packing(docs, rows, odd, none):
    check_pieces(packing.pack(docs.repartition(5)).collect(), [(d, t) for d, t, _ in rows])
    check_pieces(packing.pack(odd).collect(), [(r[0], r[1]) for r in ODD])
    assert packing.pack(none).count() == 0


@pytest.mark.parametrize("text", ["İstanbul İ ÇA ça's don't we'll", "a.b c,, d!! (e) f| \"g\" '' '", "x1 2y ßẞ ǅ ŉ ﬁ ½ ²", "e\u0301a \u0301 a\xa0b a\x1cb a\u2028b", "<|endoftext|> a<|startoftext|>b.", "The THE the. tHe," * 3, "<|ENDOFTEXT|> a, b. c,. d!, e., (f) 'g.' h.\n_i_ --j-- |k| l", "a.b, c, d , . e\u0301, É. é.", "中文 字 ñandú ÑANDÚ. Σας ΣΑΣ"])
def test_word_ids_are_the_tokenizers(text):
    path = public_tokenizers.path("word_bpe_49k.json")
    memo = packing.WordIds(path)
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    for _ in range(2):
        assert [np.frombuffer(i, "<u4").tolist() for i in memo.texts([text.encode(), None])] == [want, []]


def plain_sentences(text):
    """Sentences by walking over the characters: marks and the white space behind them, or line ends, close one."""
    out, begin, i = [], 0, 0
    while i < len(text):
        j = i
        if text[i] in ".!?":
            while j < len(text) and text[j] in ".!?":
                j += 1
            k = j
            while k < len(text) and text[k].isspace():
                k += 1
            if k == j:
                i = j
                continue
            j = k
        elif text[i] == "\n":
            while j < len(text) and text[j] == "\n":
                j += 1
        else:
            i += 1
            continue
        out.append(text[begin:j])
        begin = i = j
    return out + [text[begin:]] * (begin < len(text))


def test_repeated_spans(docs, rows):
    """All runs of 2 to 24 sentences and 20 words or more: longer ones hold a shorter one wherever sentences have a word."""
    got = {r["doc_id"]: r for r in span_dedup.remove_repeats(docs).collect()}
    seen, removed = set(), 0
    for d, t, _ in rows:
        units = plain_sentences(t)
        words = [u.lower().split() for u in units]
        gone = set()
        for i in range(len(units)):
            run, size = list(words[i]), 1
            while size < 24 and i + size < len(units) and words[i]:
                run += words[i + size]
                size += 1
                if len(run) >= 20 and words[i + size - 1]:
                    key = tuple(run)
                    if key in seen:
                        gone |= set(range(i, i + size))
                    seen.add(key)
        assert "".join(units) == t and got[d]["text"] == "".join(u for i, u in enumerate(units) if i not in gone)
        assert (got[d]["n_sentences"], got[d]["n_removed"]) == (len(units), len(gone))
        removed += len(gone)
    assert removed > 100


def test_signs_are_words(spark):
    body = "我们今天去公园散步。天气很好，大家都很开心！晚上一起吃饭。"
    rows = [(1, "第一篇。" + body), (2, "另外一篇文章！" + body), (3, "没有重复。")]
    got = {r[0]: r for r in span_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2]["text"] == "另外一篇文章！" and got[1]["n_removed"] == got[3]["n_removed"] == 0


def test_empty_string_keys(spark):
    body = sentence(np.random.default_rng(1), 12, "p") + sentence(np.random.default_rng(2), 12, "q")
    df = spark.createDataFrame([("", body), ("a", body), (None, body)], "doc_id string, text string").coalesce(1)
    assert {r["doc_id"]: r["n_removed"] for r in span_dedup.remove_repeats(df).collect()} == {"": 0, "a": 2, None: 2}


def all_runs_covered(texts, least_sentences=2, least_words=20):
    """The covered sentences of each text, by every run of enough sentences and words; runs start and end with a word."""
    seen, covered = set(), []
    for t in texts:
        units = [s.lower().split() for s in span_dedup.sentences(t)]
        gone = set()
        for i in range(len(units)):
            for j in range(i + least_sentences, len(units) + 1):
                words = " ".join(sum(units[i:j], []))
                if units[i] and units[j - 1] and words.count(" ") + 1 >= least_words:
                    if words in seen:
                        gone |= set(range(i, j))
                    seen.add(words)
        covered.append(gone)
    return covered


def sentence(rng, size, name):
    return " ".join(f"{name}{x}" for x in rng.integers(0, 10**6, size)) + ". "


def test_all_runs_of_repeated_passages(spark):
    rng = np.random.default_rng(6)
    passages = [[12, 12, 3, 3], [3, 3, 12, 12], [5, 5, 5, 5, 5, 2], [2, 2, 12, 9, 1, 1, 4], *[rng.integers(1, 12, 9).tolist() for _ in range(30)]]
    texts, tail = [], []
    for sizes in passages:
        body = "".join(sentence(rng, n, "p") for n in sizes)
        texts += [sentence(rng, 11, "a") + body + sentence(rng, 9, "b") + sentence(rng, 4, "c") for _ in range(2)]
        tail += [sentence(rng, 11, "d") + body]
    texts += tail
    want = all_runs_covered(texts)
    got = {r[0]: r for r in span_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    for i, t in enumerate(texts):
        assert got[i]["text"] == "".join(u for n, u in enumerate(span_dedup.sentences(t)) if n not in want[i])
    assert got[1]["n_removed"] == 4


def test_runs_cover_any_longer_run():
    rng = np.random.default_rng(8)
    for _ in range(300):
        t = "".join(sentence(rng, int(n), "w") if n else " \n" for n in rng.choice([0, 1, 3, 6, 9, 11], int(rng.integers(1, 14))))
        units = [s.split() for s in span_dedup.sentences(t)]
        found = [(i, i + n) for _, i, n in span_dedup.spans(t, 2, 20)]
        assert len({h for h, _, _ in span_dedup.spans(t, 2, 20)}) == len(found) and found == sorted(found)
        for a in range(len(units)):
            for b in range(a + 2, len(units) + 1):
                if units[a] and units[b - 1] and sum(map(len, units[a:b])) >= 20:
                    inside = set().union(*[set(range(i, j)) for i, j in found if a <= i and j <= b])
                    assert {i for i in range(a, b) if units[i]} <= inside


def test_planted_passage_is_cut(spark):
    passage = "Alpha beta gamma delta epsilon zeta. Eta theta iota kappa lambda mu nu. " * 2 + "".join(f"unit{i}" + (". " if i % 10 == 9 else " ") for i in range(60))
    rows = [(i, f"start{i} of text {i} " + passage + f"ending number {i} here.") for i in range(5)] + [(9, "A clean text. It stays as it is. Nothing repeats here at all.")]
    got = {r[0]: r for r in span_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert "unit30" in got[0]["text"] and got[9]["text"] == rows[5][1] and got[9]["n_removed"] == 0
    assert all("unit30 unit31" not in got[i]["text"] and len(got[i]["text"]) < len(rows[i][1]) / 3 for i in range(1, 5))


def test_repeats_odd_rows(odd, none):
    got = span_dedup.remove_repeats(odd).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in ODD)
    assert {r["text"] for r in got if r["doc_id"] == 1} == {None}
    assert len({r["text"] for r in got if r["doc_id"] == 4}) == 1
    assert span_dedup.remove_repeats(none).count() == 0


def oracle(name, tables=("documents", "pages", "benchmark")):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con.sql(queries.ORACLE_SQL[name])


def test_warc_matches_sql(spark):
    got = queries.op5_warc(spark, SF)
    want = oracle("op5_warc")
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_warc_odd_pages(spark):
    big = "x" * 1200
    pages = [(1, "http://A.Example.com/b?c=1#d", big), (2, None, big), (3, "http://a.example.com/b?c=1", big), (4, "::bad url\n[", None), (5, "http://h/é ü", ""), (6, "http://h/", "é" * 500), (7, "http://h/", "small"), (8, "http://h/", "small"), (8, "http://h/", "small"), (None, None, big)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    got = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"], r["payload_digest"]) for r in warc.round_trip(df).collect())
    want = Counter()
    for i, _, h in pages:
        data = (h or "").encode()
        revisit = h == big and i != 3
        want[i, len(data), "revisit" if revisit else "response", 3 if revisit else None, hashlib.sha1(data).hexdigest()] += 1
    assert got == want
    captures, files, folder = warc.archive(df)
    found = warc.lookup(df.where("page_id = 6"), files, folder)
    assert [r["payload"] for r in warc.read_captures(found, folder, True).collect()] == [("é" * 500).encode()]
    assert warc.lookup(spark.createDataFrame([("http://h/", 77)], "url string, page_id long"), files, folder).count() == 0
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_index_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 2)
    assert warc.url_key("HTTP://www.Example.COM:80/P?q=1#f") == "com,example,www:80)/p?q=1"
    record = warc.write_record(5, "http://h/", b"abc", hashlib.sha1(b"abc").hexdigest(), None, False)
    fields, full, payload = warc.read_record(record)
    assert (fields["WARC-Type"], full, payload) == ("response", 3, b"abc")
    assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"abc").digest()).decode()


def brute_unigrams(texts):
    train = Counter()
    for d, t in texts:
        if zlib.crc32(str("" if d is None else d).encode()) % 10:
            train.update([*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), b"\n"])
    return train


def check_scores(got, texts, fair):
    train = brute_unigrams(texts)
    n, v = sum(train.values()), len(train)
    want = {}
    for d, t in texts:
        tokens = [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), b"\n"]
        want[d] = (zlib.crc32(str("" if d is None else d).encode()) % 10 == 0, len(tokens), sum(x in train for x in tokens), n, sum(math.log10((train[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens))
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in texts)
    for r in got:
        w = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
        assert math.isclose(r["base_score"], w[4], rel_tol=1e-9, abs_tol=1e-9)
        assert r["score"] < 0
    if fair:
        held = [r for r in got if r["held_out"]]
        assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) * 0.97


def test_hmm_base_and_gain(docs, rows):
    got = hmm.score(docs).collect()
    check_scores(got, [(d, t) for d, t, _ in rows], True)


def test_hmm_rare_words_are_joined(docs, rows, monkeypatch):
    monkeypatch.setattr(hmm, "LEXICON", 500)
    got = hmm.score(docs.limit(200), rounds=1).collect()
    check_scores(got, [(d, t) for d, t, _ in rows[:200]], False)


def test_hmm_odd_rows(odd, none):
    check_scores(hmm.score(odd, rounds=1).collect(), [(r[0], r[1]) for r in ODD], False)
    assert hmm.score(none).count() == 0


def plain_forward(model, classes):
    alpha = model.start * model.emit[classes[0]]
    for c in classes[1:]:
        alpha = (alpha @ model.move) * model.emit[c]
    return math.log10(alpha.sum())


def test_forward_and_baum_welch(monkeypatch):
    monkeypatch.setattr(hmm, "CLASSES", 5)
    rng = np.random.default_rng(1)
    model = hmm.Model.first(np.full(5, 0.2), 3)
    texts = [rng.integers(0, 5, n) for n in (1, 4, 9, 9, 30)]
    assert np.allclose(hmm.log_likelihoods(model, texts), [plain_forward(model, t) for t in texts])
    starts, moves, emits = hmm.expected_counts(model, texts)
    assert np.isclose(starts.sum(), 5) and np.isclose(moves.sum(), sum(map(len, texts)) - 5) and np.allclose(emits.sum(1), np.bincount(np.concatenate(texts), minlength=5))
    # expected counts by enumerating every state path of one short text
    text, total, want = texts[1], 0.0, np.zeros((3, 3))
    for path in np.ndindex(3, 3, 3, 3):
        p = model.start[path[0]] * model.emit[text[0], path[0]]
        for a, b, c in zip(path, path[1:], text[1:], strict=False):
            p *= model.move[a, b] * model.emit[c, b]
        total += p
        for a, b in zip(path, path[1:], strict=False):
            want[a, b] += p
    assert np.allclose(hmm.expected_counts(model, [text])[1], want / total)
    assert np.isclose(model.emit.sum(0), 1).all()


def plain_hmm(texts, trained, own, shared, states, rounds, first):
    """Scores by the definitions, text by text: unscaled sums would underflow, so texts are short."""
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "\n"] for t in texts]
    counts = Counter(w for i in trained for w in tokens[i])
    ranked = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))]
    mine = {w: i for i, w in enumerate(ranked[:own])}
    group = lambda w: zlib.crc32(w.encode()) % shared
    klass = lambda w: mine.get(w, own + group(w))
    of = defaultdict(list)
    for w in counts:
        if w not in mine:
            of[group(w)].append(counts[w])
    share = lambda w: 0.0 if w in mine else math.log10((counts[w] + 0.1) / (sum(of[group(w)]) + 0.1 * (len(of[group(w)]) + 1)))
    weight = np.full(own + shared, 0.1)
    for w, n in counts.items():
        weight[klass(w)] += n
    marginal = weight / weight.sum()
    model = first(marginal)
    start, move, emit = model.start, model.move, model.emit
    for _ in range(rounds):
        starts, moves, emits = np.ones(states), np.ones((states, states)), 100 * np.repeat(marginal[:, None], states, 1)
        for i in trained:
            seen = [klass(w) for w in tokens[i]]
            alpha, beta = [start * emit[seen[0]]], [np.ones(states)]
            for c in seen[1:]:
                alpha.append(alpha[-1] @ move * emit[c])
            for c in seen[:0:-1]:
                beta.insert(0, move @ (emit[c] * beta[0]))
            p = alpha[-1].sum()
            starts += alpha[0] * beta[0] / p
            for t, c in enumerate(seen):
                emits[c] += alpha[t] * beta[t] / p
                if t:
                    moves += np.outer(alpha[t - 1], emit[c] * beta[t]) * move / p
        start, move, emit = starts / starts.sum(), moves / moves.sum(1)[:, None], emits / emits.sum(0)
    out = []
    for i, words in enumerate(tokens):
        alpha = start * emit[klass(words[0])]
        for w in words[1:]:
            alpha = alpha @ move * emit[klass(w)]
        out.append(math.log10(alpha.sum()) + sum(map(share, words)))
    return out


def test_scores_by_brute_force(spark, rows):
    """Enough words that some share classes; workers have the module's own constants, so these aren't patched."""
    texts = [" ".join(t.split()[:70]) for _, t, _ in rows[:350]] + ["", None, "Zq"]
    trained = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 10]
    assert len({w for i in trained for w in (texts[i] or "").lower().split()}) > hmm.OWN_CLASSES + 500
    got = {r["doc_id"]: r for r in hmm.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), states=3, rounds=2).collect()}
    want = plain_hmm(texts, trained, hmm.OWN_CLASSES, hmm.SHARED_CLASSES, 3, 2, lambda m: hmm.Model.first(m, 3))
    assert [got[i]["score"] for i in range(len(texts))] == pytest.approx(want, rel=1e-4)


def test_counts_do_not_depend_on_blocks():
    rng = np.random.default_rng(2)
    model = hmm.Model.first(np.full(hmm.CLASSES, 1 / hmm.CLASSES), 4)
    texts = [rng.integers(0, hmm.CLASSES, n) for n in (1, 2, 700, 3000, 3000, 40)]
    whole = hmm.expected_counts(model, texts)
    alone = [hmm.expected_counts(model, [t]) for t in texts]
    assert all(np.allclose(whole[i], sum(a[i] for a in alone)) for i in range(3))
    assert np.isclose(whole[1].sum(), sum(len(t) - 1 for t in texts))  # every move is counted, none is cut off


def test_language_accuracy(docs, rows):
    got = langid.identify(docs).collect()
    lang = {d: (x, t) for d, t, x in rows}
    held = [r for r in got if r["held_out"] and r["lang_pred"] != "und"]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang_pred"] == lang[r["doc_id"]][0] for r in held) / len(held) > 0.97
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in lang[r["doc_id"]][1])) and 0 <= r["score"] <= 1 for r in got)


def test_hypervectors_are_bound_and_bundled():
    at = langid.Space(64)
    ids = at.trigrams("Ab, c")
    letters = {c: langid._symbol(ord(c)) for c in "abc"} | {" ": 0}
    want = [" ab", "ab ", "b c", " c "]
    assert ids.tolist() == [letters[a] << 12 | letters[b] << 6 | letters[c] for a, b, c in want]
    total = sum(np.roll(at.third[letters[a]], 2) * np.roll(at.third[letters[b]], 1) * at.third[letters[c]] for a, b, c in want)
    assert np.array_equal(at.bundle("Ab, c"), total)
    assert at.bundle("12 !") is None


def test_language_odd_rows(odd, none):
    got = {r["doc_id"]: r for r in langid.identify(odd).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 6)] == ["und"] * 3 and got[7]["lang_pred"] != "und"
    assert langid.identify(none).count() == 0


def brute_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def check_pii(got, texts):
    want = defaultdict(set)
    for d, t in texts:
        s = brute_spans(t or "")
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in s)
        want[d].add((*(sum(x[0] == k for x in s) for k in ("email", "ip", "card", "phone")), hashlib.sha256(line.encode()).hexdigest(), line))
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in texts)
    for r in got:
        base = [w for w in want[r["doc_id"]] if w[:5] == (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"])]
        assert base and any(r["spans"] == w[5] or r["spans"].startswith(tuple(w[5] + "," * bool(w[5]) + k for k in ("secret:", "term:"))) for w in base)


def test_pii_base_spans(docs, rows, odd, none):
    check_pii(pii.report(docs).collect(), [(d, t) for d, t, _ in rows])
    check_pii(pii.report(odd).collect(), [(r[0], r[1]) for r in ODD])
    assert pii.report(none).count() == 0


def test_revealing_terms(spark):
    names = ["harbour", "meadow", "lantern", "cobalt", "juniper"]
    rows = [(i, f"{names[i % 5]} {names[(i + 2) % 5]} said Zorblatt called +49 30 1234567 near the {names[(i + 1) % 5]} again") for i in range(5)]
    rows += [(10 + i, f"plain talk about the {names[i % 5]} and nothing else number {i}") for i in range(30)]
    rows += [(50, "Here zorblatt alone."), (51, None), (52, "mail bob@site.org please")]
    rows += [(100 + i, f"write to person{i}@site.org soon") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["spans"] for r in pii.report(df).collect()}
    assert got[50] == "term:5:13" and got[51] == "" and got[52].startswith("email:5:17")
    assert all("term" not in got[10 + i] for i in range(30))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert clean[50] == "Here [TERM] alone." and clean[51] is None and "[PHONE]" in clean[0] and clean[10] == rows[5][1]


def test_terms_by_brute_force(docs, rows):
    """Co-occurrence counted over the whole table by its definition; terms with their places in every text."""
    word = re.compile(r"[^\W\d_]{2,}")
    times, near, joint, contexts, places = Counter(), Counter(), Counter(), defaultdict(set), {}
    for d, t, _ in rows:
        times.update(m[0].lower() for m in word.finditer(t))
        found = [(k, a, b) for k, a, b in brute_spans(t)]
        for m in re.finditer(r"[A-Za-z0-9_+=-]{24,}", t):
            shares = [n / len(m[0]) for n in Counter(m[0]).values()]
            mixed = min(len(re.findall("[0-9]", m[0])), len(re.findall("[A-Za-z]", m[0]))) >= 4
            if mixed and -sum(p * math.log2(p) for p in shares) >= 3 and not any(a < m.end() and m.start() < b for _, a, b in found):
                found.append(("secret", *m.span()))
        places[d] = found
        inside = {i for _, a, b in found for i in range(a, b)}
        masked = "".join(" " if i in inside else c for i, c in enumerate(t))
        for k, a, b in found:
            low, high = max(0, a - 80), min(len(t), b + 80)
            while low and t[low - 1].isalpha() and t[low].isalpha():
                low -= 1
            while high < len(t) and t[high].isalpha() and t[high - 1].isalpha():
                high += 1
            terms = {x.lower() for x in word.findall(masked[low:high])}
            value, digits = t[a:b].lower(), re.sub("[^0-9]", "", t[a:b])
            part = {"email": value.split("@")[-1], "ip": ".".join(value.split(".")[:2]), "secret": None}.get(k, digits[:6])
            for e in {(k, "value", value), (k,), *([(k, "part", part)] if part else [])}:
                if terms:
                    near[e] += len(terms)
                    joint.update((e, x) for x in terms)
                    for x in terms:
                        contexts[e, x].add(" ".join(sorted(terms)))
    total, revealing = sum(times.values()), set()
    for (e, x), n in joint.items():
        given = min(1.0, n / times[x])
        if len(contexts[e, x]) >= 3 and given >= 0.5 and ("value" in e or len(contexts[e, x]) * math.log2(given / min(1.0, near[e] / total)) >= 30):
            revealing.add(x)
    assert "token" in revealing
    got, terms = {r["doc_id"]: r["spans"] for r in pii.report(docs).collect()}, 0
    for d, t, _ in rows:
        own = [("term", *m.span()) for m in word.finditer(t) if m[0].lower() in revealing]
        order = ("email", "ip", "card", "phone", "secret", "term")
        want = sorted(places[d] + own, key=lambda s: (order.index(s[0]), s[1]))
        assert got[d] == ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        terms += len(own)
    assert terms >= 10


@pytest.mark.parametrize("others", [40, 0])
def test_terms_of_a_frequent_entity(spark, others):
    names = [f"{a}{b}" for a in ("harb", "mead", "lant", "juni") for b in ("our", "ow", "ern", "per", "alt")]
    rows = [(i, f"{names[i]} then Zorblatt wrote to bob@site.org about {names[(i + 3) % 20]}") for i in range(20)]
    rows += [(100 + i, f"{names[i % 20]} wrote to person{i}@site.org about {names[(i + 7) % 20]} then left") for i in range(others)]
    rows += [(200 + i, f"then she wrote about the {names[i % 20]} number {i}") for i in range(60)] + [(300, "Here zorblatt alone.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["spans"] for r in pii.report(df).collect()}
    assert got[300] == "term:5:13" and all(got[200 + i] == "" for i in range(60))


def test_decontamination_matches_sql(spark):
    got = queries.op9_decontamination(spark, SF)
    want = oracle("op9_decontamination")
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
    assert got.count() > 10


def test_partial_containment(spark):
    rng = np.random.default_rng(5)
    items, texts, want = [], [], set()
    for i in range(60):
        w = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(3, 60))]
        items.append((i, " ".join(w)))
        cut = w[: int(len(w) * rng.uniform(0.6, 1.0))]
        texts.append((i, " ".join([f"z{x}" for x in rng.integers(0, 5000, 40)] + cut)))
        s = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
        t = texts[-1][1].split()
        have = {tuple(t[k : k + 5]) for k in range(max(1, len(t) - 4))}
        if len(s & have) >= 0.8 * len(s) - 1e-9:
            want.add((i, i))
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([*items, (99, None), (98, " ")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contained_items(docs, bench).collect()} == want
    assert {r["doc_id"] for r in decontam.drop_contaminated(docs, bench).collect()} == {d for d, _ in texts} - {d for d, _ in want}


def test_decontamination_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog")], "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontam.contained_items(odd, bench).collect()) == [3, 4]
    kept = decontam.drop_contaminated(odd, bench)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 3
    assert decontam.contained_items(none, bench).count() == 0 and decontam.contained_items(odd, bench.limit(0)).count() == 0


def check_media(got, texts):
    want = defaultdict(set)
    for d, t in texts:
        data = (t or "").encode()
        payload = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        want[d].add((len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in texts)
    assert all((r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) in want[r["doc_id"]] for r in got)


def test_media_round_trip(docs, rows, odd, none):
    check_media(mpegts.media_features(docs).collect(), [(d, t) for d, t, _ in rows])
    check_media(mpegts.media_features(odd).collect(), [(r[0], r[1]) for r in ODD])
    assert mpegts.media_features(none).count() == 0


@pytest.mark.parametrize("size", [64, 128, 1, 16_383, 16_384, 16_385, 400_000, *range(150, 400)])
def test_transport_stream(size):
    payload = bytes(i * 7 & 255 for i in range(size))
    stream = mpegts.mux(payload)
    back, seen = mpegts.demux(stream)
    assert back == payload and seen["units"] == -(-size // mpegts.UNIT) and len(seen["random_access"]) == -(-seen["units"] // mpegts.ACCESS)
    assert seen["timestamps"] == [(i + 1) * mpegts.TICKS for i in range(seen["units"])]
    assert plain_reader(stream) == (payload, seen["timestamps"], seen["random_access"])


def plain_reader(stream):
    """A second reader by the standard's bit layout, for fixed PIDs: payload, presentation times, random-access times."""
    bits = lambda data, at, n: int.from_bytes(data, "big") >> 8 * len(data) - at - n & (1 << n) - 1
    counters, tables, units, clocks = defaultdict(list), Counter(), [], []
    for at in range(0, len(stream), 188):
        p = stream[at : at + 188]
        assert bits(p, 0, 8) == 0x47 and len(p) == 188 and bits(p, 24, 2) == 0  # sync, not scrambled
        pid, start, control = bits(p, 11, 13), bits(p, 9, 1), bits(p, 26, 2)
        body, flags, clock = 4, 0, None
        if control & 2:
            body = 5 + p[4]
            flags = p[5] if p[4] else 0
            if flags & 0x10:
                clock = bits(p, 48, 33) + bits(p, 87, 9) / 300
                assert bits(p, 81, 6) == 0x3F
        if control & 1:
            counters[pid].append(bits(p, 28, 4))
        if pid in (0, 0x100):
            size = bits(p, (body + 1) * 8 + 12, 12)
            section, crc = p[body + 1 : body + 4 + size], 0xFFFFFFFF
            for b in section:
                for i in range(7, -1, -1):
                    top = crc >> 31 ^ b >> i & 1
                    crc = crc << 1 & 0xFFFFFFFF ^ 0x04C11DB7 * top
            assert crc == 0 and section[0] == (0 if pid == 0 else 2)
            assert bits(section, (10 if pid == 0 else 13) * 8 + 3, 13) == (0x100 if pid == 0 else 0x101)
            tables[pid] += 1
        else:
            assert pid == 0x101 and tables[0] and tables[0x100]
            if start:
                units.append([flags & 0x40, b""])
                clocks.append(clock)
            units[-1][1] += p[body:]
    assert all(c == [i % 16 for i in range(len(c))] for c in counters.values())
    data, stamps, points = b"", [], []
    for (access, pes), clock in zip(units, clocks, strict=True):
        assert pes[:3] == b"\0\0\1" and len(pes) == 6 + int.from_bytes(pes[4:6], "big") and pes[8] == 5 and pes[7] >> 6 == 2
        stamps.append(bits(pes, 76, 3) << 30 | bits(pes, 80, 15) << 15 | bits(pes, 96, 15))
        assert clock is not None and clock <= stamps[-1]
        data += pes[14:]
        if access:
            points.append(stamps[-1])
    assert tables[0] == tables[0x100] == len(points)
    return data, stamps, points


def test_broken_streams():
    stream = mpegts.mux(bytes(2000))
    lost = stream[: 188 * 4] + stream[188 * 5 :]
    tables = mpegts.mux(bytes(9 * mpegts.UNIT))
    again = tables.rindex(b"\x47\x40\x00")
    with pytest.raises(mpegts.StreamError):  # a table's counter breaks
        mpegts.demux(tables[: again + 3] + b"\x17" + tables[again + 4 :])
    for bad in (lost, stream[:-1], b"\0" + stream[1:], stream[:20] + b"\1" + stream[21:]):
        with pytest.raises(mpegts.StreamError):
            mpegts.demux(bad)


def test_clashing_names(spark):
    body = "one two three four five six seven eight nine ten"
    rows = [(1, body, "en", "a@b.org", 1, 2, 3, 4, 5), (2, body, "en", "x", 1, 2, 3, 4, 5), (3, "mail bob@site.org and stay in touch with all of them", "en", "y", 1, 2, 3, 4, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, hash string, _kept long, _hash long, doc long, spans long, bad long")
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(df).collect()) == [1, 3]
    assert simhash.drop_near_duplicates(df).columns == df.columns
    items = spark.createDataFrame([(1, body)], "item_id long, text string")
    assert [r["doc_id"] for r in decontam.drop_contaminated(df, items).collect()] == [3]
    clean = {r["doc_id"]: r for r in pii.sanitise(df).collect()}
    assert clean[3]["text"].startswith("mail [EMAIL]") and clean[1]["kept"] == "en" and pii.sanitise(df).columns == df.columns
    assert common.spare_names(df, "KEPT", "free") == ["__KEPT", "free"]


def test_batches_are_bounded_by_bytes(spark):
    common.bounded_batches(spark)
    text = "x" * (common.BATCH_BYTES // 4)
    df = spark.range(12).selectExpr("id", f"concat(id, '{text}') as t").coalesce(1)

    def sizes(batches):
        for b in batches:
            yield type(b).from_pydict({"n": [b.num_rows]})

    assert max(r["n"] for r in df.mapInArrow(sizes, "n long").collect()) < 12
