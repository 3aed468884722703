"""Scores and response filters as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation as E
from ..operators import translation as X
from . import views as V
from .registry import query, table

NORM = r"trim(regexp_replace(regexp_replace(replace(lower({}), '-', ' '), '[^\p{{L}}\p{{M}}\p{{N}}_\s\p{{Z}}]', '', 'g'), '[\s\p{{Z}}]+', ' ', 'g'))"
BARE = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({}), '[!-/:-@\[-`{{-~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '[\s\p{{Z}}]+', ' ', 'g'))"
BAG = """scored as (select qid, p, g, list_filter(string_split(p, ' '), lambda x: x <> '') as pt, list_filter(string_split(g, ' '), lambda x: x <> '') as gt from norm),
    tokens as (select qid, t, sum(p) as p, sum(g) as g from (select qid, unnest(pt) as t, 1 as p, 0 as g from scored union all select qid, unnest(gt), 0, 1 from scored) group by qid, t),
    sums as (select qid, sum(least(p, g)) as m, sum(p) as np, sum(g) as ng from tokens group by qid)"""


@query("a18_bag_f1", f"with {V.ANSWERS}, norm as (select qid, {NORM.format('question')} as p, {NORM.format('answer')} as g from answers), {BAG} select qid, (p = g)::int as em, round(case when coalesce(m, 0) = 0 then 0 else 2.0 * m / (np + ng) end, 6)::double as f1 from scored left join sums using (qid)")
def a18(spark, sf):
    scores = E.bag_scores(V.answers(spark, sf), ["qid"], T.normalise_answer(F.col("question")), T.normalise_answer(F.col("answer")))
    return scores.select("qid", "em", F.round("f1", 6).alias("f1"))


@query("a20_summary", f"with {V.ANSWERS}, norm as (select qid, {NORM.format('question')} as p, {NORM.format('answer')} as g from answers), {BAG} select count(*) as n, round(avg((p = g)::int), 6) as em, round(avg(case when coalesce(m, 0) = 0 then 0 else 2.0 * m / (np + ng) end), 6)::double as f1 from scored left join sums using (qid)")
def a20(spark, sf):
    scores = E.bag_scores(V.answers(spark, sf), ["qid"], T.normalise_answer(F.col("question")), T.normalise_answer(F.col("answer")))
    return scores.agg(F.count("*").alias("n"), F.round(F.avg("em"), 6).alias("em"), F.round(F.avg("f1"), 6).alias("f1"))


@query("a21_yes_no_f1", f"with {V.ANSWERS}, norm as (select qid, case when qid % 5 = 0 then 'yes' else {BARE.format('question')} end as p, case when qid % 3 = 0 then 'yes' else {BARE.format('answer')} end as g from answers where regexp_full_match(question || answer, '[\\x00-\\x7F]*')), {BAG} select qid, (p = g)::int as em, round(case when coalesce(m, 0) = 0 or (p <> g and (p in ('yes', 'no', 'noanswer') or g in ('yes', 'no', 'noanswer'))) then 0 else 2.0 * m / (np + ng) end, 6)::double as f1 from scored left join sums using (qid)")
def a21(spark, sf):
    rows = V.answers(spark, sf).where(F.concat("question", "answer").rlike(r"^[\x00-\x7F]*$"))
    p = F.when(F.col("qid") % 5 == 0, "yes").otherwise(T.normalise_answer_no_articles(F.col("question")))
    g = F.when(F.col("qid") % 3 == 0, "yes").otherwise(T.normalise_answer_no_articles(F.col("answer")))
    return E.yes_no_scores(rows, ["qid"], p, g).select("qid", "em", F.round("f1", 6).alias("f1"))


@query("a19_recall_at_k", """with ret as (select conv_id as qid, turn + 1 as rank, text from conversations), ref as (select distinct conv_id as qid, text || ' more' as ref from conversations where role = 'assistant'),
    best as (select r.qid, ref, min(case when contains(lower(trim(regexp_replace(ref, '[\\s\\p{Z}]+', ' ', 'g'))), lower(trim(regexp_replace(t.text, '[\\s\\p{Z}]+', ' ', 'g')))) then rank end) as best from ref r left join ret t on t.qid = r.qid group by 1, 2)
    select qid, round(avg((coalesce(best, 1e9) <= 2)::int), 6) as recall_at_2, round(avg((coalesce(best, 1e9) <= 5)::int), 6) as recall_at_5 from best group by qid""")  # fmt: skip
def a19(spark, sf):
    turns = table(spark, sf, "conversations")
    got = turns.select(F.col("conv_id").alias("qid"), (F.col("turn") + 1).alias("rank"), "text")
    refs = turns.where("role = 'assistant'").select(F.col("conv_id").alias("qid"), F.concat("text", F.lit(" more")).alias("ref")).distinct()
    out = E.recall_at(got, refs, (2, 5))
    return out.select("qid", F.round("recall_at_2", 6).alias("recall_at_2"), F.round("recall_at_5", 6).alias("recall_at_5"))


@query("a22_support_recall", """with got as (select o_custkey as qid, o_orderpriority as title, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as rank from orders), firsts as (select qid, title, min(rank) as rank from got group by 1, 2),
    gold as (select distinct o_custkey as qid, o_orderpriority as title from orders where o_totalprice > 100000)
    select g.qid, round(avg(coalesce((rank <= 2)::int, 0)), 6) as support_recall_2, min(coalesce((rank <= 2)::int, 0)) as all_support_2, round(avg(coalesce((rank <= 5)::int, 0)), 6) as support_recall_5, min(coalesce((rank <= 5)::int, 0)) as all_support_5
    from gold g left join firsts f on f.qid = g.qid and f.title = g.title group by g.qid""")  # fmt: skip
def a22(spark, sf):
    orders = table(spark, sf, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    got = orders.select(F.col("o_custkey").alias("qid"), F.col("o_orderpriority").alias("title"), F.row_number().over(w).alias("rank"))
    gold = orders.where("o_totalprice > 100000").select(F.col("o_custkey").alias("qid"), F.col("o_orderpriority").alias("title"))
    out = E.support_scores(got, gold, (2, 5))
    return out.select("qid", *[F.round(c, 6).alias(c) if "recall" in c else F.col(c) for c in out.columns[1:]])


@query("a23_running_mean", "select event_id, round(avg(value) over (partition by event_type order by event_id rows unbounded preceding) + 1e-9, 4) as mean from events")
def a23(spark, sf):
    w = Window.partitionBy("event_type").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "events").select("event_id", F.round(F.avg("value").over(w) + 1e-9, 4).alias("mean"))


@query("a24_balanced_accuracy", """with r as (select d.lang, 1 - toxic as p, quality as g from labels l join documents d on d.doc_id = l.doc_id),
    c as (select coalesce(lang, 'ALL') as lang, count(*) filter (p = 1 and g = 1) as tp, count(*) filter (p = 0 and g = 0) as tn, count(*) filter (p = 1 and g = 0) as fp, count(*) filter (p = 0 and g = 1) as fn from r group by rollup (lang)),
    m as (select *, tp / nullif(tp + fn, 0) as recall_1, tn / nullif(tn + fp, 0) as recall_0, tn / nullif(tn + fn, 0) as precision_0 from c)
    select lang, tp, tn, fp, fn, round(recall_1, 6) as recall_1, round(recall_0, 6) as recall_0, round(precision_0, 6) as precision_0, round((recall_1 + recall_0) / 2, 6) as balanced, round(2 * precision_0 * recall_0 / nullif(precision_0 + recall_0, 0), 6) as f1_0 from m""")  # fmt: skip
def a24(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").select("lang", (1 - F.col("toxic")).alias("p"), F.col("quality").alias("g"))
    out = E.confusion(rows, "lang", "p", "g")
    return out.select("lang", "tp", "tn", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("recall_1", "recall_0", "precision_0", "balanced", "f1_0")])


@query("a25_mode_vote", "with c as (select user_id, event_type, count(*) as n, min(event_id) as f from events group by 1, 2) select user_id, event_type from (select *, row_number() over (partition by user_id order by n desc, f) as r from c) where r = 1")
def a25(spark, sf):
    return E.majority(table(spark, sf, "events"), ["user_id"], "event_type", "event_id")


@query("a26_triple_prf", """with d as (select l_orderkey as k, count(*) as n, count(*) filter (l_discount > 0.05) as wrong, count(*) filter (l_returnflag = 'R') as missing from lineitem group by 1),
    p as (select *, case when n = 0 or n <= wrong then null else round((n - wrong) / n, 4) end as precision, case when n = 0 or n <= wrong then null else round((n - wrong) / (n - wrong + missing), 4) end as recall from d)
    select k, precision, recall, round(2 * precision * recall / (precision + recall), 4) as f1 from p""")  # fmt: skip
def a26(spark, sf):
    d = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("wrong"), F.count_if(F.col("l_returnflag") == "R").alias("missing"))
    right = F.col("n") - F.col("wrong")
    p = d.withColumns({"precision": F.when(right > 0, F.round(right / F.col("n"), 4)), "recall": F.when(right > 0, F.round(right / (right + F.col("missing")), 4))})
    return p.select("k", "precision", "recall", F.round(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")), 4).alias("f1"))


@query("a28_mcq_accuracy", "with r as (select conv_id, turn, upper(regexp_extract(text, '(?i)[a-d]')) as said, chr(65 + (turn % 4)::int) as key from conversations) select key, count(*) as n, round(avg((said = key)::int), 6) as accuracy from r group by key")
def a28(spark, sf):
    said = F.upper(F.regexp_extract("text", "(?i)[a-d]", 0))
    rows = table(spark, sf, "conversations").select(said.alias("said"), F.char(65 + F.col("turn") % 4).alias("key"))
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.round(F.avg((F.col("said") == F.col("key")).cast("int")), 6).alias("accuracy"))


@query("a29_adjacency", f"with {V.GEOGRAPHY} select dst as name, string_agg(src, ',' order by src) as before from edges group by dst")
def a29(spark, sf):
    return V.geography(spark, sf).groupBy(F.col("dst").alias("name")).agg(F.array_join(F.array_sort(F.collect_list("src")), ",").alias("before"))


@query("a30_truth_sets", "select string_split(p_type, ' ')[-1] as concept, count(distinct p_brand) as brands, string_agg(distinct p_brand, ',' order by p_brand) as names from part group by 1")
def a30(spark, sf):
    return table(spark, sf, "part").groupBy(F.substring_index("p_type", " ", -1).alias("concept")).agg(F.count_distinct("p_brand").alias("brands"), F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("names"))


@query("a32_perplexity_family", "select l_returnflag, round(exp(-avg(-l_tax)), 6) as perplexity, round(exp(-sum(-l_tax) / sum(l_quantity)), 6) as weighted_perplexity, round(-sum(-l_tax) / sum(l_quantity) / ln(2), 6) as bits_per_byte, round(sum(l_tax) / sum(l_quantity), 8) as weighted_mean from lineitem group by 1")
def a32(spark, sf):
    ll, w = -F.col("l_tax"), F.col("l_quantity")
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.exp(-F.avg(ll)), 6).alias("perplexity"), F.round(F.exp(-F.sum(ll) / F.sum(w)), 6).alias("weighted_perplexity"), F.round(-F.sum(ll) / F.sum(w) / F.log(F.lit(2.0)), 6).alias("bits_per_byte"), F.round(F.sum(F.col("l_tax")) / F.sum(w), 8).alias("weighted_mean"))


@query("a33_mcc_brier", """with r as (select quality as g, 1 - toxic as p from labels), c as (select count(*) filter (p = 1 and g = 1)::double as tp, count(*) filter (p = 0 and g = 0)::double as tn, count(*) filter (p = 1 and g = 0)::double as fp, count(*) filter (p = 0 and g = 1)::double as fn, avg((p * 0.8 + 0.1 - g) * (p * 0.8 + 0.1 - g)) as b from r)
    select round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) as mcc, round(2 * tp / (2 * tp + fp + fn), 6) as f1, round(b, 6)::double as brier from c""")  # fmt: skip
def a33(spark, sf):
    p, g = 1 - F.col("toxic"), F.col("quality")
    hit = lambda a, b: F.count_if((p == a) & (g == b))
    score = p * F.lit(0.8) + F.lit(0.1) - g
    c = table(spark, sf, "labels").agg(hit(1, 1).alias("tp"), hit(0, 0).alias("tn"), hit(1, 0).alias("fp"), hit(0, 1).alias("fn"), F.avg(score * score).alias("b"))
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    return c.select(F.round(E.matthews(tp, tn, fp, fn), 6).alias("mcc"), F.round(2 * tp / (2 * tp + fp + fn), 6).alias("f1"), F.round("b", 6).alias("brier"))


@query("a34_bleu", f"""with {V.ANSWERS}, t as (select qid, list_filter(string_split_regex(question, '[\\s\\p{{Z}}]+'), lambda x: x <> '') as p, list_filter(string_split_regex(answer, '[\\s\\p{{Z}}]+'), lambda x: x <> '') as g from answers),
    grams as (select qid, n, unnest(case when len(p) >= n then list_transform(range(1, len(p) - n + 2), lambda i: array_to_string(p[i:i + n - 1], ' ')) else [] end) as gram, 1 as p, 0 as q from t, range(1, 5) r(n)
        union all select qid, n, unnest(case when len(g) >= n then list_transform(range(1, len(g) - n + 2), lambda i: array_to_string(g[i:i + n - 1], ' ')) else [] end), 0, 1 from t, range(1, 5) r(n)),
    c as (select n, sum(least(p, q)) as matches, sum(p) as predicted_grams, sum(q) as gold_grams from (select qid, n, gram, sum(p) as p, sum(q) as q from grams group by 1, 2, 3) group by n)
    select n::int as n, matches::bigint as matches, predicted_grams::bigint as predicted_grams, gold_grams::bigint as gold_grams from c""")  # fmt: skip
def a34(spark, sf):
    out = None
    for n in range(1, 5):
        part = E.ngram_overlap(V.answers(spark, sf), "qid", n, "question", "answer").select(F.lit(n).alias("n"), "matches", "predicted_grams", "gold_grams")
        out = part if out is None else out.unionByName(part)
    return out


LOGLIK = "ll as (select item_id, (item_id % 3)::int as gold, i::int as choice, string_split(text, ' ')[i + 1] as continuation, -(('0x' || md5(item_id || ':' || i)[1:6])::bigint % 1000) / 100.0 as loglik from benchmark, range(4) r(i))"


def _loglik(spark, sf):
    """(item_id, gold, choice, continuation, loglik): a seeded stand-in for a model's log likelihoods of four words of an item."""
    items = table(spark, sf, "benchmark")
    rows = E.choice_requests(items, "item_id", F.col("text"), F.slice(F.split("text", " "), 1, 4))
    value = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("item_id").cast("string"), F.col("choice").cast("string")).cast("binary")), 1, 6), 16, 10).cast("long") % 1000
    return rows.select("item_id", (F.col("item_id") % 3).cast("int").alias("gold"), "choice", "continuation", (-value / 100.0).alias("loglik"))


@query("a33_weighted_f1", """with r as (select o_orderstatus as k, o_orderpriority as g, ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-LOW', '5-NONE'][(o_orderkey % 5)::int + 1] as p from orders),
    c as (select k, c, sum(g)::double as gold, sum(p) as said, sum(hit) as tp from (select k, g as c, 1 as g, 0 as p, (p = g)::int as hit from r union all select k, p, 0, 1, 0 from r) group by 1, 2)
    select k, round(sum(2 * tp / (said + gold) * gold) / sum(gold), 6) as weighted_f1, round(avg(2 * tp / (said + gold)), 6) as macro_f1, round(sum(tp) / sum(gold), 6) as accuracy from c group by k""")  # fmt: skip
def a33_weighted(spark, sf):
    said = F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-LOW", "5-NONE")))[(F.col("o_orderkey") % 5).cast("int")]
    found = E.class_f1(table(spark, sf, "orders").withColumnRenamed("o_orderstatus", "k"), said, F.col("o_orderpriority"), ["k"])
    return found.select("k", *[F.round(c, 6).alias(c) for c in ("weighted_f1", "macro_f1", "accuracy")])


@query("a35_mutual_information", """with ll as (select item_id, (item_id % 3)::int as gold, i::int as choice, -(('0x' || md5(item_id || ':' || i || ':conditional')[1:6])::bigint % 1000) / 100.0 + (('0x' || md5(item_id || ':' || i || ':unconditional')[1:6])::bigint % 1000) / 100.0 as gain from benchmark, range(4) r(i) where len(string_split(text, ' ')) > i),
    r as (select *, row_number() over (partition by item_id order by round(gain, 4) desc, choice) as a from ll) select item_id, max((a = 1 and choice = gold)::int) as acc_mutual_info from r group by item_id""")  # fmt: skip
def a35_mutual(spark, sf):
    items = table(spark, sf, "benchmark")
    rows = E.choice_requests(items, "item_id", F.col("text"), F.slice(F.split("text", " "), 1, 4), mutual=True)
    value = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("item_id").cast("string"), F.col("choice").cast("string"), "kind").cast("binary")), 1, 6), 16, 10).cast("long") % 1000
    scored = rows.select("item_id", (F.col("item_id") % 3).cast("int").alias("gold"), "choice", "kind", (-value).alias("loglik"))
    return E.mutual_information_choices(scored, "item_id", "gold")


@query("a34_chrf", f"""with {V.ANSWERS}, t as (select qid, regexp_replace(question, '[\\s\\p{{Z}}]+', '', 'g') as p, regexp_replace(answer, '[\\s\\p{{Z}}]+', '', 'g') as g from answers),
    grams as (select qid, n, unnest(list_transform(range(1, length(p) - n + 2), lambda i: substring(p, i, n))) as gram, 1 as p, 0 as q from t, range(1, 7) r(n) where length(p) >= n and length(g) >= n
        union all select qid, n, unnest(list_transform(range(1, length(g) - n + 2), lambda i: substring(g, i, n))), 0, 1 from t, range(1, 7) r(n) where length(g) >= n),
    c as (select n, sum(p) as p, sum(q) as g, sum(least(p, q)) as m from (select qid, n, gram, sum(p) as p, sum(q) as q from grams group by 1, 2, 3) group by n),
    a as (select avg(m / p) as p, avg(m / g) as r from c where p > 0 and g > 0)
    select round(coalesce(100 * 5 * p * r / (4 * p + r), 0), 6) as chrf from a""")  # fmt: skip
def a34_chrf(spark, sf):
    return X.chrf(V.answers(spark, sf), "question", "answer").select(F.round("chrf", 6).alias("chrf"))


@query("a34_ter")
def a34_ter(spark, sf):
    return X.ter(V.answers(spark, sf), "question", "answer")


@query("a35_choice_accuracy", f"with {LOGLIK}, r as (select *, row_number() over (partition by item_id order by loglik desc, choice) as a, row_number() over (partition by item_id order by loglik / length(continuation) desc, choice) as b from ll) select item_id, max((a = 1 and choice = gold)::int) as acc, max((b = 1 and choice = gold)::int) as acc_norm from r group by item_id")
def a35(spark, sf):
    return E.choice_scores(_loglik(spark, sf), "item_id", "gold")


@query("x10_choice_requests", "select item_id, kind, i::int as choice, case when kind = 'conditional' then text else '' end as context, string_split(text, ' ')[i + 1] as continuation from benchmark, range(4) r(i), (values ('conditional'), ('unconditional')) k(kind)")
def x10(spark, sf):
    return E.choice_requests(table(spark, sf, "benchmark"), "item_id", F.col("text"), F.slice(F.split("text", " "), 1, 4), mutual=True)


@query("a36_exact_match_options", f"with {V.ANSWERS} select round(avg((regexp_replace(lower(question), '[0-9!-/:-@\\[-`{{-~]', '', 'g') = regexp_replace(lower(answer), '[0-9!-/:-@\\[-`{{-~]', '', 'g'))::int), 6) as exact_match from answers")
def a36(spark, sf):
    bare = lambda c: F.regexp_replace(F.lower(c), r"[0-9!-/:-@\[-`{-~]", "")
    return V.answers(spark, sf).agg(F.round(F.avg((bare("question") == bare("answer")).cast("int")), 6).alias("exact_match"))


@query("a37_acc_all", "with q as (select l_orderkey, bool_and(l_quantity > 5) as ok from lineitem group by 1) select round(avg(ok::int), 6) as acc_all, round(stddev_samp(ok::int) / sqrt(count(*)), 8) as stderr from q")
def a37(spark, sf):
    q = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.bool_and(F.col("l_quantity") > 5).cast("int").alias("right"))
    return q.agg(F.round(F.avg("right"), 6).alias("acc_all"), F.round(F.stddev_samp("right") / F.sqrt(F.count("*")), 8).alias("stderr"))


@query("a38_stderr", "select g, n, pop, samp, stderr from (select l_returnflag as g, count(*) as n, round(stddev_pop(l_quantity), 6) as pop, round(stddev_samp(l_quantity), 6) as samp, round(stddev_samp(l_quantity) / sqrt(count(*)), 8) as stderr from lineitem group by 1)")
def a38(spark, sf):
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("g")).agg(F.count("*").alias("n"), F.round(F.stddev_pop(q), 6).alias("pop"), F.round(F.stddev_samp(q), 6).alias("samp"), F.round(F.stddev_samp(q) / F.sqrt(F.count("*")), 8).alias("stderr"))


@query("a39_bootstrap_stderr")
def a39(spark, sf):
    return E.bootstrap_stderr(table(spark, sf, "lineitem"), "l_quantity", 1000)


@query("a40_pooled_stderr", """with t as (select n_regionkey as g, n_nationkey as t, count(*) as n, stddev_samp(c_acctbal) / sqrt(count(*)) as e, avg(c_acctbal) as m from customer join nation on c_nationkey = n_nationkey group by 1, 2)
    select g, round(sqrt(sum((n - 1) * e * e * n) / (sum(n) - count(*)) / sum(n)), 4) as pooled, round(sum(m * n) / sum(n) + 1e-9, 4) as mean_by_size, round(avg(m) + 1e-9, 4) as mean from t group by g""")  # fmt: skip
def a40(spark, sf):
    both = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    t = both.groupBy(F.col("n_regionkey").alias("g"), "n_nationkey").agg(F.count("*").alias("n"), (F.stddev_samp("c_acctbal") / F.sqrt(F.count("*"))).alias("e"), F.avg("c_acctbal").alias("m"))
    by = E.weighted_mean(t, "g", "n", "m").withColumnRenamed("m", "a").join(E.weighted_mean(t, "g", "n", "m", False), "g")
    return E.pooled_stderr(t, "g", "n", "e").join(by, "g").select("g", F.round("pooled", 4).alias("pooled"), F.round(F.col("a") + 1e-9, 4).alias("mean_by_size"), F.round(F.col("m") + 1e-9, 4).alias("mean"))


@query("a41_group_rollup", "select coalesce(r_name, 'ALL') as region, coalesce(n_name, 'ALL') as nation, count(*) as n, round(avg(c_acctbal) + 1e-9, 4) as mean from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)")
def a41(spark, sf):
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    both = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    out = both.rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal") + 1e-9, 4).alias("mean"))
    return out.select(F.coalesce("r_name", F.lit("ALL")).alias("region"), F.coalesce("n_name", F.lit("ALL")).alias("nation"), "n", "mean")


@query("a44_z_value", "with m as (select l_linestatus as k, avg(l_quantity) as m, stddev_samp(l_quantity) / sqrt(count(*)) as e from lineitem group by 1) select round((a.m - b.m) / sqrt(a.e * a.e + b.e * b.e), 6) as z from m a, m b where a.k = 'F' and b.k = 'O'")
def a44(spark, sf):
    m = table(spark, sf, "lineitem").groupBy("l_linestatus").agg(F.avg("l_quantity").alias("m"), (F.stddev_samp("l_quantity") / F.sqrt(F.count("*"))).alias("e"))
    one = lambda k, c: F.max(F.when(F.col("l_linestatus") == k, F.col(c)))
    return m.agg(F.round((one("F", "m") - one("O", "m")) / F.sqrt(one("F", "e") ** 2 + one("O", "e") ** 2), 6).alias("z"))


@query("a45_grouping_sets", "select coalesce(c_mktsegment, 'ALL') as category, round(avg(c_acctbal) + 1e-9, 4) as mean from customer group by grouping sets ((), (c_mktsegment))")
def a45(spark, sf):
    out = table(spark, sf, "customer").rollup("c_mktsegment").agg(F.round(F.avg("c_acctbal") + 1e-9, 4).alias("mean"))
    return out.select(F.coalesce("c_mktsegment", F.lit("ALL")).alias("category"), "mean")


@query("a46_type_level_counts", "select role, turn, count(*) as n from conversations group by 1, 2")
def a46(spark, sf):
    return table(spark, sf, "conversations").groupBy("role", "turn").agg(F.count("*").alias("n"))


@query("a47_context_merge", "select sha256(source || chr(0) || text)[1:16] as id, string_agg(doc_id::varchar, ',' order by doc_id) as question_ids, bool_or(lang = 'en') as is_supporting from documents group by source, text")
def a47(spark, sf):
    docs = table(spark, sf, "documents")
    grouped = docs.groupBy("source", "text").agg(F.array_sort(F.collect_set("doc_id")).alias("ids"), F.bool_or(F.col("lang") == "en").alias("is_supporting"))
    return grouped.select(T.short_hash(F.col("source"), F.col("text")).alias("id"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("question_ids"), "is_supporting")


@query("a48_usage_totals", "select role, sum(length(text))::bigint as chars, sum(len(string_split(text, ' ')))::bigint as tokens from conversations group by role")
def a48(spark, sf):
    return table(spark, sf, "conversations").groupBy("role").agg(F.sum(F.length("text")).alias("chars"), F.sum(F.size(F.split("text", " "))).alias("tokens"))


@query("a49_triples_per_document", f"with {V.TRIPLES} select doc::bigint as doc, count(*) filter (head_type = 'entity') as entity_triples, count(*) filter (head_type = 'event') as event_triples from triples group by doc")
def a49(spark, sf):
    return V.triples(spark, sf).groupBy("doc").agg(F.count_if(F.col("head_type") == "entity").alias("entity_triples"), F.count_if(F.col("head_type") == "event").alias("event_triples"))


@query("a50_reply_counts", "select doc_id, case when contains(text, 'License') then 0 else len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) end::bigint as lines from documents")
def a50(spark, sf):
    lines = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))
    return table(spark, sf, "documents").select("doc_id", F.when(F.contains("text", F.lit("License")), 0).otherwise(lines).cast("long").alias("lines"))


@query("a51_checkpoint_rollup", "select event_type as method, count(*) as done, round(avg(value) + 1e-9, 4) as mean, count(*) >= 100 as complete from events group by 1")
def a51(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("method")).agg(F.count("*").alias("done"), F.round(F.avg("value") + 1e-9, 4).alias("mean"), (F.count("*") >= 100).alias("complete"))


@query("a52_best_reference", "select l_orderkey, round(max(l_extendedprice / l_quantity) + 1e-9, 4) as best from lineitem group by 1")
def a52(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.round(F.max(F.col("l_extendedprice") / F.col("l_quantity")) + 1e-9, 4).alias("best"))


@query("a53_metric_rows", "select l_returnflag as task, metric, value from (select l_returnflag, round(avg(l_quantity) + 1e-9, 4) as quantity, round(avg(l_discount), 6) as discount, round(avg(l_tax), 6) as tax from lineitem group by 1) unpivot (value for metric in (quantity, discount, tax))")
def a53(spark, sf):
    wide = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("task")).agg(F.round(F.avg("l_quantity") + 1e-9, 4).alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount"), F.round(F.avg("l_tax"), 6).alias("tax"))
    return wide.unpivot("task", ["quantity", "discount", "tax"], "metric", "value")


@query("a54_regression_diff", "with a as (select l_returnflag as task, avg(l_quantity) as v from lineitem where l_linestatus = 'F' group by 1), b as (select l_returnflag as task, avg(l_quantity) as v from lineitem where l_linestatus = 'O' group by 1) select coalesce(a.task, b.task) as task, round(b.v - a.v, 6) as diff from a full join b on a.task = b.task")
def a54(spark, sf):
    part = lambda s: table(spark, sf, "lineitem").where(F.col("l_linestatus") == s).groupBy(F.col("l_returnflag").alias("task")).agg(F.avg("l_quantity").alias(s))
    return part("F").join(part("O"), "task", "full").select("task", F.round(F.col("O") - F.col("F"), 6).alias("diff"))


@query("x2_regex_extract", "select doc_id, coalesce(trim(regexp_extract_all(text, '[0-9]+')[-1]), '[invalid]') as picked from documents")
def x2(spark, sf):
    return table(spark, sf, "documents").select("doc_id", E.regex_pick(F.col("text"), "[0-9]+", select=-1).alias("picked"))


@query("x3_first_letter_choice", "select doc_id, coalesce(trim(replace(regexp_extract_all(text, '[A-D][a-z]*:?')[1], ':', ''))[1], '[invalid]') as choice from documents")
def x3(spark, sf):
    found = F.try_element_at(F.regexp_extract_all("text", F.lit("[A-D][a-z]*:?"), F.lit(0)), F.lit(1))
    return table(spark, sf, "documents").select("doc_id", F.coalesce(F.substring(F.trim(F.replace(found, F.lit(":"))), 1, 1), F.lit("[invalid]")).alias("choice"))


@query("x4_choice_fallbacks", "with t as (select conv_id, turn, case turn % 3 when 0 then 'The answer is (B).' when 1 then 'it is: C' else text end as r from conversations) select conv_id, turn, coalesce(nullif(regexp_extract(r, '\\(([A-D])\\)', 1), ''), nullif(regexp_extract(r, ':\\s*([A-D])', 1), ''), '[invalid]') as choice from t")
def x4(spark, sf):
    r = F.when(F.col("turn") % 3 == 0, "The answer is (B).").when(F.col("turn") % 3 == 1, "it is: C").otherwise(F.col("text"))
    first = F.nullif(F.regexp_extract(r, r"\(([A-D])\)", 1), F.lit(""))
    second = F.nullif(F.regexp_extract(r, r":\s*([A-D])", 1), F.lit(""))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce(first, second, F.lit("[invalid]")).alias("choice"))


@query("x5_text_filters", "select conv_id, turn, lower(ltrim('  ' || text)) as text, upper(role) as role from conversations")
def x5(spark, sf):
    said = E.filter_chain(F.concat(F.lit("  "), "text"), E.FILTERS["lstrip"], E.FILTERS["lowercase"])
    return table(spark, sf, "conversations").select("conv_id", "turn", said.alias("text"), E.FILTERS["uppercase"](F.col("role")).alias("role"))


@query("x6_majority_vote", "with c as (select user_id, props, count(*) as n, min(event_id) as f from events group by 1, 2) select user_id, props from (select *, row_number() over (partition by user_id order by n desc, f) as r from c) where r = 1")
def x6(spark, sf):
    return E.majority(table(spark, sf, "events"), ["user_id"], "props", "event_id")


@query("x7_map_filter", "select event_id, case event_type when 'click' then 'C' when 'view' then 'V' when 'purchase' then 'P' else 'other' end as code from events")
def x7(spark, sf):
    codes = F.create_map(*[F.lit(x) for x in ("click", "C", "view", "V", "purchase", "P")])
    return table(spark, sf, "events").select("event_id", F.coalesce(codes[F.col("event_type")], F.lit("other")).alias("code"))


@query("x9_uncached_requests", "select distinct sha256(text) as request from conversations where turn > 0 and sha256(text) not in (select sha256(text) from conversations where turn = 0)")
def x9(spark, sf):
    hashed = table(spark, sf, "conversations").select("turn", F.sha2("text", 256).alias("request"))
    return hashed.where("turn > 0").join(hashed.where("turn = 0"), "request", "left_anti").select("request").distinct()


@query("x11_fewshot_context", "with shots as (select b.item_id, s.text, row_number() over (partition by b.item_id order by s.item_id) as n from benchmark b join benchmark s on s.item_id % 10 = b.item_id % 10 and s.item_id <> b.item_id), k as (select item_id, string_agg(text, chr(10) || chr(10) order by n) as shots from shots where n <= 3 group by item_id) select b.item_id, coalesce(shots || chr(10) || chr(10), '') || b.text as context from benchmark b left join k on k.item_id = b.item_id")
def x11(spark, sf):
    from ..operators.relational import top_per_group

    items = table(spark, sf, "benchmark").withColumn("bin", F.col("item_id") % 10)
    # the first four of a bin hold the three shots of any of its items
    pool = top_per_group(items.select("bin", F.col("item_id").alias("sid"), F.col("text").alias("shot")), ["bin"], [F.col("sid")], 4).groupBy("bin").agg(F.array_sort(F.collect_list(F.struct("sid", "shot"))).alias("pool"))
    both = items.join(pool, "bin")
    shots = F.transform(F.slice(F.filter("pool", lambda s: s["sid"] != F.col("item_id")), 1, 3), lambda s: s["shot"])
    return both.select("item_id", F.array_join(F.concat(shots, F.array("text")), "\n\n").alias("context"))


@query("x15_token_cost", "select sum(len(string_split(text, ' ')))::bigint as tokens, count(*) as requests from benchmark")
def x15(spark, sf):
    return table(spark, sf, "benchmark").agg(F.sum(F.size(F.split("text", " "))).alias("tokens"), F.count("*").alias("requests"))


@query("j20_group_responses", "select conv_id, string_agg(role, ',' order by turn) as roles, count(*) as n from conversations group by conv_id")
def j20(spark, sf):
    grouped = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("s"))
    return grouped.select("conv_id", F.array_join(F.transform("s", lambda x: x["role"]), ",").alias("roles"), F.size("s").cast("long").alias("n"))


@query("j21_task_groups", "select r_name as category, round(avg(s_acctbal) + 1e-9, 4) as mean from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1")
def j21(spark, sf):
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    both = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return both.groupBy(F.col("r_name").alias("category")).agg(F.round(F.avg("s_acctbal") + 1e-9, 4).alias("mean"))


@query("j16_containment", "select distinct conv_id, turn from conversations c where exists (select 1 from conversations r where r.conv_id = c.conv_id and r.turn <> c.turn and contains(lower(r.text), lower(split_part(c.text, ' ', 2))))")
def j16(spark, sf):
    turns = table(spark, sf, "conversations").withColumn("found", F.lower(F.split_part("text", F.lit(" "), F.lit(2))))
    other = turns.select(F.col("conv_id").alias("k"), F.col("turn").alias("t"), F.col("text").alias("reference"))
    inside = (F.col("conv_id") == F.col("k")) & (F.col("turn") != F.col("t")) & F.contains(F.lower("reference"), F.col("found"))
    return turns.join(other, inside, "left_semi").select("conv_id", "turn").distinct()


@query("j17_title_split", "select n_name, case when n_regionkey in (select r_regionkey from region where r_name in ('ASIA', 'EUROPE')) then 'gold' else 'distractor' end as kind from nation")
def j17(spark, sf):
    gold = table(spark, sf, "region").where("r_name in ('ASIA', 'EUROPE')").select(F.col("r_regionkey").alias("n_regionkey"))
    nation = table(spark, sf, "nation")
    return nation.join(gold, "n_regionkey", "left_semi").select("n_name", F.lit("gold").alias("kind")).unionByName(nation.join(gold, "n_regionkey", "left_anti").select("n_name", F.lit("distractor").alias("kind")))


@query("a31_best_matching")
def a31(spark, sf):
    words = table(spark, sf, "part").select("p_brand", F.explode(F.split("p_type", " ")).alias("gold")).distinct()
    names = table(spark, sf, "part").select("p_brand", F.explode(F.split("p_name", " ")).alias("predicted")).distinct()
    near = 1 - F.levenshtein("gold", "predicted") / F.greatest(F.length("gold"), F.length("predicted"))
    return E.matched_scores(words.join(names, "p_brand").withColumn("similarity", near), "p_brand")


@query("a27_column_means", "select round(avg(value) + 1e-9, 4) as value, count(value) as n from events")
def a27(spark, sf):
    return table(spark, sf, "events").agg(F.round(F.avg("value") + 1e-9, 4).alias("value"), F.count("value").alias("n"))
