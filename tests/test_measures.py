"""Name ratios, translation scores, the bootstrap and damaged JSON against brute force."""

import json
import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernstone.operators import evaluation as E
from quernstone.operators import hooks as H
from quernstone.operators import retrieval as Q
from quernstone.operators import translation as X
from quernstone.plans import QUERIES


def block_ratio(a, b):
    """Twice the characters in the longest common block and, to its left and right, in theirs, over all characters."""

    def common(a, b):
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        return n and n + common(a[:i], b[:j]) + common(a[i + n :], b[j + n :])

    return 2 * common(a, b) / (len(a) + len(b)) if a or b else 1.0


@pytest.mark.parametrize("ratio", [0.6, 0.8])
def test_linked_by_common_blocks(spark, ratio):
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcd é\U0001f600"), n))
    names = sorted({word(int(n)) for n in rng.integers(1, 14, 120)})
    terms = set(names[:5]) | {""}
    for _ in range(120):
        w = list(names[int(rng.integers(0, len(names)))])
        for _ in range(int(rng.integers(1, 4))):
            at, what = int(rng.integers(0, len(w) + 1)), int(rng.integers(0, 3))
            w[at : at + (what > 0)] = [str(rng.choice(list("abcd")))] * (what < 2)
        terms.add("".join(w))
    wanted = spark.createDataFrame([(t,) for t in terms] + [(None,)], "term string")
    nodes = spark.createDataFrame([(n,) for n in names] + [(None,), (names[0],)], "name string").repartition(3)
    got = {r.term: (r["name"], round(r.ratio, 9)) for r in Q.link_names(wanted, nodes, ratio).collect()}
    want = {}
    for t in terms:
        best = max((block_ratio(n, t), n) for n in names)
        if t in names:
            want[t] = (t, 1.0)
        elif best[0] >= ratio:
            want[t] = (best[1], round(best[0], 9))
    assert got == want and len(want) > 40


def test_names_of_the_whole_graph(spark):
    """Every supplier's misspelt name against all names of sf0.01, where most of them share most letters."""
    from quernstone.plans import views as V

    sf = "/root/testdata/sf0.01"
    got = {r.term: (r["name"], r.ratio) for r in QUERIES["j14_fuzzy_names"](spark, sf).collect()}
    edges = V.graph_edges(spark, sf)
    names = [r[0] for r in edges.select("src").union(edges.select("dst")).distinct().collect()]
    counts = {n: Counter(n) for n in names}
    for term in ["suplier 7", "suplier 99", "cust. 40r", "nation 3", "the nation of 4", "the nation of 17"]:
        if term in counts:
            assert got[term] == (term, 1.0)
            continue
        of = Counter(term)
        best = max(((block_ratio(n, term), n) for n in names if 2 * (counts[n] & of).total() >= 0.8 * (len(n) + len(term))), default=(0, None))
        assert got.get(term) == ((best[1], round(best[0], 6)) if best[0] >= 0.8 else None)


def slow_chrf(pairs):
    sums = [[0, 0, 0] for _ in range(6)]
    for a, b in pairs:
        a, b = ("".join((t or "").split()) for t in (a, b))
        for n in range(1, 7):
            x, y = [a[i : i + n] for i in range(len(a) - n + 1)], [b[i : i + n] for i in range(len(b) - n + 1)]
            left = list(y)
            hits = 0
            for g in x:
                if g in left:
                    left.remove(g)
                    hits += 1
            sums[n - 1] = [s + v for s, v in zip(sums[n - 1], (len(x) if y else 0, len(y), hits), strict=True)]
    used = [(m / p, m / g) for p, g, m in sums if p and g]
    if not used:
        return 0.0
    p, r = (sum(c) / len(used) for c in zip(*used, strict=True))
    return 100 * 5 * p * r / (4 * p + r) if p + r else 0.0


@pytest.mark.parametrize("pairs", [[("the cat sat", "the cat sat on it"), ("a b", None), ("", "xyz"), ("été ü", "ete ü")], [("same", "same")], [("abc", "xyz")], [(None, None)], []])
def test_chrf(spark, pairs):
    rows = spark.createDataFrame(pairs, "a string, b string")
    assert X.chrf(rows, "a", "b").first()[0] == pytest.approx(slow_chrf(pairs))


def slow_edits(said, gold):
    """The greedy definition with a recursive distance, plain lists and all blocks tried in turn."""

    def matrix(a):
        d = [[0] * (len(gold) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) + 1):
            for j in range(len(gold) + 1):
                if not i or not j:
                    d[i][j] = i + j
                else:
                    d[i][j] = min(d[i - 1][j - 1] + (a[i - 1] != gold[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)
        return d

    shifts = 0
    while True:
        d = matrix(said)
        path, i, j = [], len(said), len(gold)
        while i or j:
            if i and j and d[i][j] == d[i - 1][j - 1] + (said[i - 1] != gold[j - 1]):
                i, j = i - 1, j - 1
                path.append(("s", i, j))
            elif i and d[i][j] == d[i - 1][j] + 1:
                i -= 1
                path.append(("d", i, None))
            else:
                j -= 1
                path.append(("i", i - 1, j))
        bad_a = {i for k, i, j in path if k == "d" or k == "s" and said[i] != gold[j]}
        bad_b = {j for k, i, j in path if k == "i" or k == "s" and said[i] != gold[j]}
        where = {j: i for k, i, j in path if k != "d"}
        options = []
        for start in range(len(said)):
            for end in range(start + 1, len(said) + 1):
                for match in range(len(gold) - (end - start) + 1):
                    block = said[start:end]
                    if block != gold[match : match + len(block)] or not bad_a & set(range(start, end)) or not bad_b & set(range(match, match + len(block))) or start <= where[match] < end:
                        continue
                    for b in range(match - 1, match + len(block)):
                        to = where[b] + 1 if b >= 0 else 0
                        if not start <= to <= end:
                            moved = said[:to] + block + said[to:start] + said[end:] if to < start else said[:start] + said[end:to] + block + said[to:]
                            options.append((d[-1][-1] - matrix(moved)[-1][-1], len(block), -start, -to, moved))
        best = max(options, key=lambda o: o[:4], default=None)
        if not d[-1][-1] or best is None or best[0] <= 0:
            return shifts + d[-1][-1]
        said, shifts = best[4], shifts + 1


def test_edits_with_shifts():
    words = lambda s: s.split()
    assert X.edits(words("c d a b"), words("a b c d")) == 1
    assert X.edits(words("a b c"), words("a b c")) == 0 and X.edits([], words("a b")) == 2 and X.edits(words("a b"), []) == 2
    assert X.edits(words("saudi arabia denied this week information published in the american new york times"), words("this week the saudis denied information published in the new york times")) == 4
    rng = np.random.default_rng(8)
    for _ in range(250):
        a, b = (list(rng.choice(list("abcdef"), int(n))) for n in rng.integers(0, 9, 2))
        assert X.edits(a, b) == slow_edits(a, b)
    for _ in range(60):
        b = list(rng.choice(list("abcdefghijkl"), 9))
        i, j, k = sorted(rng.integers(0, 10, 3))
        a = b[:i] + b[j:k] + b[i:j] + b[k:]
        assert X.edits(a, b) == slow_edits(a, b)


def test_ter_adds_up(spark):
    rows = spark.createDataFrame([("C d a B", "a b c d"), ("x", None), (None, "y z")], "a string, b string").repartition(2)
    assert X.ter(rows, "a", "b").first() == (4, 6, 100 * 4 / 6)
    assert X.ter(rows.where("false"), "a", "b").first() == (0, 0, 0.0)


def test_bootstrap_in_one_pass(spark):
    """Any number of distinct values; within four errors of the closed form, and near the resamples of drawn rows."""
    rows = spark.range(20_000).select(F.when(F.col("id") % 50 == 0, None).otherwise(F.exp(F.rand(3) * 4)).alias("x")).repartition(3)
    closed = rows.agg(F.stddev_samp("x") / F.sqrt(F.count("x"))).first()[0]
    got = E.bootstrap_stderr(rows, "x", 1000)
    assert got.first()[0] == got.first()[0] == pytest.approx(closed, rel=4 / math.sqrt(2000) + 0.01)
    assert E.bootstrap_stderr(rows.where("false"), "x", 10).first()[0] is None
    few = spark.createDataFrame([(float(v),) for v in [1, 1, 2, 8, 9, 9, 9, 30] * 12], "x double")
    values, rng = np.array([1, 1, 2, 8, 9, 9, 9, 30] * 12, float), np.random.default_rng(4)
    drawn = np.std([rng.choice(values, len(values)).mean() for _ in range(4000)], ddof=1)
    assert E.bootstrap_stderr(few, "x", 4000).first()[0] == pytest.approx(drawn, rel=0.06)


VALUES = st.recursive(st.none() | st.booleans() | st.integers(-999, 999) | st.text("abcXYZ éß'.?!-", max_size=12), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text("abcxyz", min_size=1, max_size=5), x, max_size=4), max_leaves=12)
ROOTS = st.lists(VALUES, max_size=4) | st.dictionaries(st.text("abcxyz", min_size=1, max_size=5), VALUES, max_size=4)


@settings(max_examples=300, deadline=None)
@given(ROOTS)
def test_damaged_json_comes_back(value):
    said = json.dumps(value, ensure_ascii=False)
    assert H.repair_json(f"Sure! ```json\n{said}\n``` Hope [this] helps") == value
    spaced = json.dumps(value, ensure_ascii=False, indent=1)
    assert H._recovered(said) == value and H._recovered(spaced) == value
    assert H.repair_json(spaced.replace("\n]", ",\n]").replace("\n}", ",\n}").replace("[,", "[").replace("{,", "{")) == value
    assert H.repair_json(spaced.replace(",\n", "\n")) == value  # commas lost
    assert H.repair_json(repr(value)) == value  # single quotes, None, True, apostrophes


@settings(max_examples=200, deadline=None)
@given(ROOTS, st.integers(0, 200))
def test_cut_json_keeps_what_was_said(value, cut):
    """Cut anywhere, all whole items before the cut are there."""
    if isinstance(value, list):
        said = json.dumps(value, ensure_ascii=False)
        got = H.repair_json(said[: 1 + cut])
        whole = 0
        while whole < len(value) and len(json.dumps(value[: whole + 1], ensure_ascii=False)) - 1 <= min(1 + cut, len(said)) - 1:
            whole += 1
        assert got[:whole] == value[:whole]


def test_json_of_replies():
    assert H.repair_json("{'name': 'O'Neil's dog', 'age': 3,}") == {"name": "O'Neil's dog", "age": 3}
    assert H.repair_json('{name: John Smith, "tags": [red blue, \'green\'') == {"name": "John Smith", "tags": ["red blue", "green"]}
    assert H.repair_json('[{"a": "she said "yes" to it", "b": 1}]') == [{"a": 'she said "yes" to it', "b": 1}]
    assert H.repair_json('{"a": [1, 2} , "b": 3') == {"a": [1, 2]}
    assert H.repair_json("no value") is None and H.repair_json("") is None and H.repair_json("[" * 50) is not None


def test_class_f1_by_hand(spark):
    pairs = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "a"), ("d", "b"), (None, "a"), ("a", None)]
    row = E.class_f1(spark.createDataFrame(pairs, "p string, g string"), F.col("p"), F.col("g")).first()
    f = {}
    for c in "abcd":
        tp, said, gold = sum(p == g == c for p, g in pairs), sum(p == c for p, g in pairs if p and g), sum(g == c for p, g in pairs if p and g)
        f[c] = (2 * tp / (said + gold), gold)
    assert row.weighted_f1 == pytest.approx(sum(x * n for x, n in f.values()) / 5) and row.macro_f1 == pytest.approx(sum(x for x, _ in f.values()) / 4) and row.accuracy == pytest.approx(0.4)


def test_gain_by_the_context(spark):
    rows = [(1, 0, c, k, v) for c, k, v in [(0, "conditional", -5.0), (0, "unconditional", -9.0), (1, "conditional", -1.0), (1, "unconditional", -2.0), (2, "conditional", -1.0)]]
    rows += [(2, 1, c, k, v) for c, k, v in [(0, "conditional", -1.0), (0, "unconditional", -3.0), (1, "conditional", -2.0), (1, "unconditional", -4.0)]]
    got = {r.item: r.acc_mutual_info for r in E.mutual_information_choices(spark.createDataFrame(rows, "item long, gold int, choice int, kind string, loglik double"), "item", "gold").collect()}
    assert got == {1: 1, 2: 0}
