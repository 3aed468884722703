"""Alignment, toxicity and whitening against brute force on whole small tables, and on awkward rows."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import types as T
from tokenizers import Tokenizer

from quernstone.llm import alignment, queries, toxicity, whitening

from test_operators import DOCS, LONG, ODD, SF

BYTE_SIGNS = {b: chr(b) for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
BYTE_SIGNS |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in BYTE_SIGNS)}


@pytest.fixture(scope="module")
def brute():
    """Rows of the alignment of (key, text) pairs: whole texts, one at a time, two pointers, plain dictionaries."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    back = {c: n for n, c in BYTE_SIGNS.items()}

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    def rows(texts):
        docs, df = [], Counter()
        for key, text in texts:
            want = (" " + (text or "")).encode()
            x = a.encode(want.decode(), add_special_tokens=False).ids if text else []
            y = b.encode(text) if text else []
            xs, ys = [bytes(back[c] for c in a.id_to_token(i)) for i in x], [piece(i) for i in y]
            if not text or b"".join(xs) != want or b"".join(ys) != want:
                docs.append((key, 0, 0, [], Counter()))
                continue
            groups, i, j = [], 0, 0
            while i < len(x):
                ga, gb, ea, eb = [x[i]], [y[j]], len(xs[i]), len(ys[j])
                i, j = i + 1, j + 1
                while ea != eb:
                    if ea < eb:
                        ga.append(x[i])
                        ea += len(xs[i])
                        i += 1
                    else:
                        gb.append(y[j])
                        eb += len(ys[j])
                        j += 1
                groups.append((ga, gb))
            links = Counter((p, q) for ga, gb in groups for p in ga for q in gb)
            df.update(links.keys())
            docs.append((key, len(x), len(y), groups, links))
        best = defaultdict(int)
        for (p, _), n in df.items():
            best[p] = max(best[p], n)
        out = []
        for key, n_a, n_b, groups, links in docs:
            said = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
            n_best, total = sum(m for p, m in links.items() if df[p] == best[p[0]]), sum(m * df[p] for p, m in links.items())
            out.append((key, n_a, n_b, len(groups), sum(links.values()), n_best, total, hashlib.sha256(said.encode()).hexdigest() if groups else ""))
        return sorted(out, key=repr)

    return rows


def test_alignment_matches_brute_force(spark, brute):
    texts = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    got = queries.op11_alignment(spark, SF)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(texts)


SPECIAL = [
    "<|endoftext|> and <s> </s> <unk> <0x0A>", "  two  blanks   three \n\n lines\r\n\ttab ", " ", "\n", "a▁b", "word ▁ word", "\x00 nul", "café café 中文 \U0001f600 \U0001f468‍\U0001f469‍\U0001f467",
    "don't we'll I'm they've 12 345 6789", "x y 　z \x1c q\x85r", "a" * 5000, "� ﻿ ‮", "ab " * 2000, "The the THE tHe",
]


def test_alignment_odd_rows(spark, brute):
    texts = [(i, t) for i, t in enumerate(SPECIAL)] + [(r[0], r[1]) for r in ODD] + [(None, None), (77, LONG)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("doc_id", "text", "1 as row", "2 as a", "3 as n", "4 as kind").repartition(3)
    assert sorted(map(tuple, alignment.align(docs).collect()), key=repr) == brute(texts)
    assert alignment.align(docs.where("false")).count() == 0


def test_alignment_deals_busy_ids_and_blocks(spark, brute, monkeypatch):
    """Busy ids over many pieces, blocks of a few postings, a memo that is forgotten: the same rows."""
    monkeypatch.setattr(alignment, "PIECE_POSTINGS", 7)
    texts = [(i, f"the same line of all and number {i % 5} or {i}") for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, alignment.align(docs).collect()), key=repr) == brute(texts)
    at = alignment.Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    whole = at.texts([t for _, t in texts])
    monkeypatch.setattr(alignment, "MEMO_SEGMENTS", 3)
    for k, (_, t) in enumerate(texts[:20]):
        n, digest, _, pairs, times = at.texts([t])
        assert n[0].tolist() == whole[0][k].tolist() and digest[0] == whole[1][k]
        assert pairs.tolist() == whole[3][whole[2] == k].tolist() and times.tolist() == whole[4][whole[2] == k].tolist()


def held(key, folds, at):
    return zlib.crc32(b"" if key is None else str(key).encode()) % folds == at


def slow_score(text, model):
    """The score by its definition: strings, loops and the whole embedding."""
    words, run = [], ""
    for c in (text or "").lower() + " ":
        if c.isalnum():
            run += c
        elif run:
            words.append(run)
            run = ""
    mask = (1 << 64) - 1
    m = [int(x) for x in toxicity._MULTIPLIERS]
    bags = []
    for w in words:
        signs, bag = [1, *map(ord, w), 2], []
        for size in range(toxicity.LEAST_GRAM, toxicity.MOST_GRAM + 1):
            for i in range(len(signs) - size + 1):
                h = sum(s * m[k] for k, s in enumerate(signs[i : i + size])) & mask
                h = ((h ^ h >> 29) * m[-1]) & mask
                bag.append((h >> 40) % toxicity.BUCKETS)
        bags.append(bag)
    size = min(toxicity.PASSAGE, len(bags))
    best = None
    for i in range(len(bags) - size + 1) if bags else []:
        rows = [g for bag in bags[i : i + size] for g in bag]
        logits = model.embedding[rows].mean(axis=0) @ model.weights + model.bias
        best = logits if best is None or logits[1] - logits[0] > best[1] - best[0] else best
    logits = model.bias if best is None else best
    return 1 / (1 + math.exp(min(700.0, logits[0] - logits[1])))


def test_toxicity_scores_by_definition(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    seen = labels.where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
    model = toxicity.train(docs, seen)
    texts = dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    got = queries.op12_toxicity(spark, SF).collect()
    assert {r.doc_id for r in got} == set(texts) and len(got) == len(texts)
    for r in got:
        assert r.held_out == held(r.doc_id, 5, 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1
    for r in sorted(got)[::7]:
        assert abs(r.score - slow_score(texts[r.doc_id], model)) < 1e-6


def test_toxicity_catches_unseen_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.op12_toxicity(spark, sf).where("held_out").collect()}
    truth = [(d, y) for d, y in duckdb.sql(f"select doc_id, toxic from '{sf}/labels.parquet'").fetchall() if d in got]
    bad, good = [got[d] for d, y in truth if y == 1], [got[d] for d, y in truth if y == 0]
    assert sum(r.predicted for r in bad) >= 0.9 * len(bad)
    assert sum(r.predicted for r in good) <= 0.01 * len(good)


def test_toxicity_learns_stems_and_misspellings():
    rng = np.random.default_rng(5)
    clean = ["".join(rng.choice(list("aeiourstlnm"), rng.integers(2, 8))) for _ in range(400)]
    texts, labels = [], []
    for i in range(400):
        words = list(rng.choice(clean, rng.integers(5, 200)))
        if i % 4 == 0:
            words[len(words) // 2] = "zgrobwik" + "".join(rng.choice(list("aeiou"), 2))
        texts.append(" ".join(words))
        labels.append(int(i % 4 == 0))
    model = toxicity.fit(texts, labels)
    said = [toxicity.document_score(t, model.scores(), model.offset()) for t in ("rast zgrobwikst lo", " ".join(clean * 20) + " zgrobwiik " + " ".join(clean), " ".join(clean * 20), "", "12 !!")]
    assert said[0] > 0.5 and said[1] > 0.5 and said[2] < 0.5 and said[3] < 0.5


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame(ODD, DOCS).repartition(2)
    labels = spark.createDataFrame([(3, 0, 1), (5, 1, 0), (5, 1, 0), (999, 1, 1), (8, 1, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = toxicity.classify(docs, labels).collect()
    assert sorted(repr(r.doc_id) for r in rows) == sorted(repr(r[0]) for r in ODD)
    assert len({r.score for r in rows if r.doc_id in (1, 2, 6)}) == 1
    assert {r.score for r in toxicity.classify(docs, labels.where("false")).collect()} == {0.5}
    assert toxicity.classify(docs.where("false"), labels).count() == 0
    long = ("lorem ipsum dolor " * 300_000)[: 2 * toxicity.CHUNK + 11]
    model = toxicity.fit(["bad word here", "good word there"], [1, 0])
    grams, words = toxicity.subwords(long)
    means = toxicity.passage_means(np.bincount(words, model.scores()[grams]), np.bincount(words))
    assert abs(toxicity.document_score(long, model.scores(), model.offset()) - 1 / (1 + math.exp(-(means.max() + model.offset())))) < 1e-9


def brute_whitening(vectors):
    """n, deviations, covariance as fractions, all in plain Python."""
    x = [[math.floor(1024 * Fraction(float(c))) + 100000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    z = [[n * r[i] - sums[i] for i in range(d)] for r in x]
    cov = [[Fraction(sum(r[i] * r[j] for r in z), n**3) for j in range(d)] for i in range(d)]
    return n, [sum(c * c for c in r) for r in z], z, cov


def check_whitening(rows, keys, vectors, components=8):
    n, deviations, z, cov = brute_whitening(vectors)
    v = np.array([[float(c) for c in r] for r in cov])
    values, axes = np.linalg.eigh(v)
    found = defaultdict(dict)
    for r in rows:
        found[r.vec_id][r.component] = r
    assert len(rows) == sum(map(len, found.values()))
    m = len(next(iter(found.values())))
    w = np.zeros((n, m))
    for k, key in enumerate(keys):
        assert sorted(found[key]) == list(range(1, m + 1)) and m <= components
        for c, r in found[key].items():
            assert r.n == n and int(r.deviation) == deviations[k]
            assert abs(r.explained - values[-c] / np.trace(v)) <= 1e-6 * r.explained + 1e-15 and 0 <= r.identity_error < 1e-4
            w[k, c - 1] = r.whitened
    for c in range(m):
        gap = min(abs(values[-1 - c] - o) for i, o in enumerate(values) if i != len(values) - 1 - c) if len(values) > 1 else 1
        if gap > 1e-6 * values[-1]:
            want = np.array([[zz / n for zz in r] for r in z], float) @ axes[:, -1 - c] / math.sqrt(values[-1 - c])
            want *= np.sign(want @ w[:, c])
            assert np.allclose(want, w[:, c], atol=1e-6)
    assert np.allclose(w.T @ w / n, np.eye(m), atol=1e-6)


def test_whitening_matches_fractions(spark):
    rows = duckdb.sql(f"select vec_id, embedding from '{SF}/embeddings.parquet'").fetchall()
    got = queries.op13_whitening(spark, SF)
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    check_whitening(got.collect(), [k for k, _ in rows], [v for _, v in rows])


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("own", T.IntegerType()), T.StructField("x", T.IntegerType()), T.StructField("n", T.IntegerType())])


def test_whitening_odd_rows(spark):
    good = [(i, [float(i % 7), float(i * i % 11) / 3, -0.25 * i]) for i in range(40)]
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 2.0]), (103, [1.0, float("inf"), 2.0]), (104, [1.0]), (105, []), (106, [1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame([(k, v, 1, None, 3) for k, v in good + bad], VECTORS).repartition(3)
    check_whitening(whitening.whiten(df).collect(), [k for k, _ in good], [np.float32(v) for _, v in good])
    again = spark.createDataFrame([(None, [1.0, 2.0], 1, 1, 1), (None, [2.0, 5.0], 1, 1, 1), (3, [0.0, 1.0], 1, 1, 1), (3, [0.0, 1.0], 1, 1, 1)], VECTORS)
    assert sorted(r.vec_id is None for r in whitening.whiten(again).collect()) == [False] * 4 + [True] * 4
    for none in (df.where("false"), df.where("vec_id = 5"), df.where("vec_id >= 100 and vec_id < 104")):
        assert whitening.whiten(none).collect() == []
    line = spark.createDataFrame([(i, [float(i), float(2 * i)], 1, 1, 1) for i in range(8)], VECTORS)
    assert {r.component for r in whitening.whiten(line).collect()} == {1}


def test_whitening_takes_large_numbers(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(v)) for v in rng.standard_normal(4) * [1e3, 1e9, 1e12, 1.0]]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    check_whitening(whitening.whiten(df, components=2).collect(), [k for k, _ in rows], [v for _, v in rows], 2)


def test_limbs_are_exact():
    rng = np.random.default_rng(9)
    z = rng.integers(-(2**60), 2**60, (300, 5))
    gram = whitening.Gram(5)
    gram.add(z)
    gram.add(z[:3].astype(object) * 10**9)
    gram.settle()
    want = [[sum(int(a) * int(b) for a, b in zip(z[:, i], z[:, j], strict=True)) + 10**18 * sum(int(a) * int(b) for a, b in zip(z[:3, i], z[:3, j], strict=True)) for j in range(5)] for i in range(5)]
    assert gram.whole.tolist() == want
    assert whitening.deviations(z[:9]) == [sum(int(c) ** 2 for c in r) for r in z[:9]]
    assert [sum(d << 32 * k for k, d in enumerate(ds)) for ds in whitening.digits([0, -1, 2**100, -(3**60)])] == [0, -1, 2**100, -(3**60)]
