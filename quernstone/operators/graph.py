"""Building and walking the property graph; a question is a row, and a loop's rounds are written tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scratch import cut, few
from .relational import number_rows


def valid_triples(triples: DataFrame, head: str = "head", relation: str = "relation", tail: str = "tail") -> DataFrame:
    """Cleaned triples with all three parts non-empty. Nulls (parts that weren't strings) go."""
    cleaned = triples.withColumns({c: T.clean_text(F.col(c)) for c in (head, relation, tail)})
    return cleaned.where(" and ".join(f"{c} <> ''" for c in (head, tail, relation)))


def participations(records: DataFrame, event: str = "event", entities: str = "entities") -> DataFrame:
    """Each participant of an event as a triple ``(event, is participated by, entity)``, with its position."""
    rows = records.where(F.col(event).isNotNull()).select("*", F.posexplode(entities).alias("at", "entity"))
    return rows.withColumn("relation", F.lit("is participated by")).drop(entities)


def first_seen_nodes(triples: DataFrame, order: Column) -> DataFrame:
    """(name, type, doc): every node once, with the type and passage of its first sight; a head comes before its tail.

    ``order`` must be a total order of the triples; where it and ``doc`` are numbers, every aggregation of the sightings is by
    hash, without a sort: first sights are found for each type and side apart, and only these few are compared.
    """
    heads = triples.select(F.col("head").alias("name"), order.alias("at"), F.lit(0).alias("side"), F.col("head_type").alias("type"), "doc")
    tails = triples.select(F.col("tail").alias("name"), order.alias("at"), F.lit(1).alias("side"), F.col("tail_type").alias("type"), "doc")
    seen = heads.unionByName(tails).groupBy("name", "type", "side").agg(F.min_by("doc", "at").alias("doc"), F.min("at").alias("at"))
    first = seen.groupBy("name").agg(F.min_by(F.struct("type", "doc"), F.struct("at", "side")).alias("first"))
    return first.select("name", "first.type", "first.doc")


def worklist(nodes: DataFrame, triples: DataFrame) -> DataFrame:
    """(name, type): what is to be conceptualised: nodes by their first type, and relations."""
    return nodes.select("name", F.initcap("type").alias("type")).unionByName(triples.select(F.col("relation").alias("name"), F.lit("Relation").alias("type")).distinct())


def collapse_edges(edges: DataFrame, order: Column, concepts: str | None = None) -> DataFrame:
    """One edge a (src, dst): the first relation, and all its rows' distinct concepts, sorted."""
    aggs = [F.min_by("relation", order).alias("relation"), F.count("*").alias("n")]
    if concepts:
        aggs.append(F.array_sort(F.array_distinct(F.flatten(F.collect_set(concepts)))).alias("concepts"))
    return edges.groupBy("src", "dst").agg(*aggs)


def concept_edges(nodes: DataFrame, concepts: DataFrame) -> DataFrame:
    """(src, dst, relation): a ``has_concept`` edge per node and concept, ids by hash. ``concepts``: (name, concept)."""
    both = concepts.join(nodes.select("name"), "name").select("name", "concept").distinct()
    return both.select(T.hash_id(F.col("name"), "_entity").alias("src"), T.hash_id(F.col("concept"), "_concept").alias("dst"), F.lit("has_concept").alias("relation"))


def assemble(nodes: DataFrame, texts: DataFrame, edges: DataFrame, mentions: DataFrame, concepts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (key, id, type, file_id) and edges (src, dst, relation, type) of the whole graph.

    ``nodes`` (name, type), ``texts`` (text_id, original_text), ``edges`` (src, dst, relation; names, in ``pos``
    order), ``mentions`` (name, text_id), ``concepts`` (name, concept). Node keys are hashes in their own
    namespace, so an edge is parallel only to others of its kind: of relations the first stays, of mentions and concepts one.
    They are told apart by names, and hashed when few are left to move.
    """
    entity = lambda c: T.hash_id(F.col(c), "_entity")
    files = mentions.groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("text_id")), ",").alias("file_id"))
    vertices = nodes.join(files, "name", "left").select(entity("name").alias("key"), F.col("name").alias("id"), "type", "file_id")
    vertices = vertices.unionByName(texts.select(F.col("text_id").alias("key"), F.col("original_text").alias("id"), F.lit("passage").alias("type"), F.col("text_id").alias("file_id")))
    named = concepts.select("concept").distinct()
    vertices = vertices.unionByName(named.select(T.hash_id(F.col("concept"), "_concept").alias("key"), F.col("concept").alias("id"), F.lit("concept").alias("type"), F.lit("concept_file").alias("file_id")))
    first = edges.groupBy("src", "dst").agg(F.min_by("relation", F.col("pos").cast("long")).alias("relation"))
    rows = first.select(entity("src").alias("src"), entity("dst").alias("dst"), "relation", F.lit("Relation").alias("type"))
    said = mentions.select("name", "text_id").distinct()
    rows = rows.unionByName(said.select(entity("name").alias("src"), F.col("text_id").alias("dst"), F.lit("mention in").alias("relation"), F.lit("Source").alias("type")))
    rows = rows.unionByName(concept_edges(nodes, concepts).withColumn("type", F.lit("Concept")))
    return vertices, rows


def induced(edges: DataFrame, nodes: DataFrame, key: str = "name") -> DataFrame:
    """The edges with both ends among ``nodes``."""
    ends = nodes.select(F.col(key).alias("_n"))
    return edges.join(ends, F.col("src") == F.col("_n"), "left_semi").join(ends, F.col("dst") == F.col("_n"), "left_semi")


def induced_counts(edges: DataFrame, nodes: DataFrame, key: str = "name") -> DataFrame:
    """(src, relation, dst, n): the edges with both ends among ``nodes``, once each, and how often. Edges are placed by source once and counted there; only counts move on."""
    ends = nodes.select(F.col(key).alias("_n"))
    out = edges.join(ends, F.col("src") == F.col("_n"), "left_semi").groupBy("src", "relation", "dst").agg(F.count("*").alias("n"))
    return out.join(ends, F.col("dst") == F.col("_n"), "left_semi")


def typed_counts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src_type, relation, dst_type, edges): how many distinct edges there are between types. ``nodes`` (name, type) has a name once.

    Edges are placed by source once; from there a target gets one count a relation and source type.
    """
    a, b = nodes.select(F.col("name").alias("src"), F.col("type").alias("src_type")), nodes.select(F.col("name").alias("dst"), F.col("type").alias("dst_type"))
    into = edges.join(a, "src").select("src", "src_type", "relation", "dst").distinct().groupBy("src_type", "relation", "dst").agg(F.count("*").alias("k"))
    return into.join(b, "dst").groupBy("src_type", "relation", "dst_type").agg(F.sum("k").alias("edges"))


VARIANTS = {"entity": ("entity",), "entity_event": ("entity", "event"), "full": ("entity", "event", "concept")}


def variant(vertices: DataFrame, edges: DataFrame, name: str, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """A named variant's vertices, passages always among them, and the edges inside."""
    kept = vertices.where(F.col("type").isin(*VARIANTS[name], "passage"))
    return kept, induced(edges, kept, key)


def degrees(edges: DataFrame) -> DataFrame:
    """(name, out_degree, in_degree) of every node that has an edge."""
    ends = edges.select(F.col("src").alias("name"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select(F.col("dst"), F.lit(0), F.lit(1)))
    return ends.groupBy("name").agg(F.sum("o").cast("long").alias("out_degree"), F.sum("i").cast("long").alias("in_degree"))


def first_neighbours(edges: DataFrame, most: int) -> DataFrame:
    """(name, near): of each node the first ``most`` names that its edges lead to, and the first ``most`` that lead to it, as one sorted array.

    A name on both sides is there twice, repeats of an edge count once. Both sides are ranked in one pass, and a task drops what can't be among
    the first before rows move. The sort begins with a node's hash: names begin alike, and comparing them takes longer than comparing numbers.
    """
    out, back = ([F.col(n).alias("name"), F.lit(side).alias("out"), F.col(m).alias("near")] for n, side, m in (("src", True, "dst"), ("dst", False, "src")))
    ends = edges.select(F.explode(F.array(F.struct(*out), F.struct(*back))).alias("end")).select(F.xxhash64("end.name").alias("hash"), "end.*")
    first = ends.withColumn("place", F.dense_rank().over(Window.partitionBy("hash", "name", "out").orderBy("near"))).where(F.col("place") <= most)
    kept = first.groupBy("hash", "name").agg(F.collect_set(F.struct("out", "near")).alias("ends"))  # at most twice ``most``
    return kept.select("name", F.array_sort(F.transform("ends", lambda x: x["near"])).alias("near"))


def undirected(edges: DataFrame) -> DataFrame:
    """(u, v) both ways, once each."""
    return edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionAll(edges.select(F.col("dst"), F.col("src"))).distinct()


def breadth_first(edges: DataFrame, seeds: DataFrame, hops: int, leaf: Column | None = None) -> DataFrame:
    """(qid, name, hop): nodes within ``hops`` undirected steps of each question's seeds (qid, name).

    A node for which ``leaf`` holds is reached but not passed through.
    """
    both = undirected(edges)
    seen = seeds.select("qid", "name").distinct().withColumn("hop", F.lit(0))
    front = seen
    for hop in range(1, hops + 1):
        start = front if leaf is None else front.where(~leaf)
        step = start.select("qid", F.col("name").alias("u")).join(both, "u").select("qid", F.col("v").alias("name")).distinct()
        front = step.join(seen.select("qid", "name"), ["qid", "name"], "left_anti").withColumn("hop", F.lit(hop))
        front = cut(front, "bfs")
        seen = seen.unionByName(front)
    return seen


def walk_sample(edges: DataFrame, starts: DataFrame, walkers: int, steps: int, restart: float, seed: int) -> DataFrame:
    """(qid, name): the nodes that random walks with restart meet, starts included.

    ``starts`` (qid, name, number): ``walkers`` walks from each. A walk's choices are digests of seed, question, walk and
    step, so the sample is the same wherever it is drawn. All walks of all questions take a step together. A step numbers the neighbours
    of the nodes where walks are, and of no other, together over all these nodes in parts, so a hub's need no task of their own.
    """
    ends = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionAll(edges.select(F.col("dst"), F.col("src")))
    walks = starts.select("qid", F.col("name").alias("start"), "name", F.explode(F.transform(F.sequence(F.lit(0), F.lit(walkers - 1)), lambda w: F.col("number") * walkers + w)).alias("walker"))
    walks = cut(walks, "walks")
    met = [walks.select("qid", "name")]
    for t in range(1, steps + 1):
        at = cut(walks.select(F.col("name").alias("u")).distinct(), "walk-nodes")
        numbered = cut(number_rows(ends.join(few(at), "u", "left_semi").distinct(), ["u", "v"], "place"), "walk-neighbours")
        first = numbered.groupBy("u").agg(F.min("place").alias("first"), F.count("*").alias("k"))
        digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("qid").cast("string"), F.col("walker").cast("string"), F.lit(str(t))).cast("binary"))
        drawn = walks.withColumn("h", F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")).withColumnRenamed("name", "u")
        chosen = drawn.join(first, "u").withColumn("place", F.col("first") + F.expr("h div 1000") % F.col("k"))
        moved = chosen.join(numbered.select("place", "v"), "place")
        walks = cut(moved.select("qid", "start", F.when(F.col("h") % 1000 < int(restart * 1000), F.col("start")).otherwise(F.col("v")).alias("name"), "walker"), "walks")
        met.append(walks.select("qid", "name"))
    return reduce(DataFrame.unionByName, met).distinct()


def neighbourhood_edges(edges: DataFrame, reached: DataFrame, hops: int, leaf: Column | None = None) -> DataFrame:
    """(qid, src, dst, relation): every edge at a node that the walk expanded."""
    expanded = reached.where(F.col("hop") < hops)
    if leaf is not None:
        expanded = expanded.where(~leaf)
    expanded = expanded.select("qid", F.col("name").alias("_n"))
    out = edges.join(expanded, F.col("src") == F.col("_n")).select("qid", "src", "dst", "relation")
    return out.unionByName(edges.join(expanded, F.col("dst") == F.col("_n")).select("qid", "src", "dst", "relation")).distinct()


def hashed_nodes(edges: DataFrame, name: str) -> tuple[DataFrame, Callable[[str], Column], int]:
    """(id, name) of all ends of ``edges``, what makes a column of names one of ids, and how many nodes there are. Ids are 64-bit hashes, told apart by counting; a null name has a null id."""
    names = edges.select(F.col("src").alias("name")).unionAll(edges.select("dst")).distinct()
    for tries in range(8):  # should two names ever meet, another seed tells them apart
        ident = lambda c, salt=tries: F.when(F.col(c).isNotNull(), F.xxhash64(F.lit(salt), F.col(c)))
        nodes = cut(names.select(ident("name").alias("id"), "name"), name)
        counted = nodes.agg(F.count("*").alias("all"), F.count("name").alias("named"), F.count_distinct("id").alias("ids")).first()
        if counted.ids == counted.named:
            return nodes, ident, counted["all"]
    raise RuntimeError("names have no distinct hashes")


def personalised_pagerank(edges: DataFrame, seeds: DataFrame, alpha: float, iterations: int, tolerance: float | None = None) -> DataFrame:
    """(qid, name, rank): PageRank with restarts in each question's seeds (qid, name, weight).

    Edges are unweighted and parallel ones count once; rank starts even over all nodes; nodes without out-edges
    give theirs to the seeds. The walk is linear, so the even start is walked once for all questions, and a
    question's own state holds only nodes that its seeds have reached; no question is ever joined with all nodes.
    Nodes are 64-bit hashes, told apart by counting, and a node's links one row; after the first round, links of
    nodes that nothing leads to and that are no seeds can't be walked again and are left out.
    The result has the nodes reached; any other has what is left of the even start there, the same for every
    question. A round is one written table: ranks are sums, so parts of a node's rank need not come together before
    they move on, and what goes nowhere is added up in the same aggregate.
    Stops after ``iterations`` rounds, or when the change is below ``tolerance`` times the number of nodes.
    """
    nodes, ident, count = hashed_nodes(edges, "ppr-nodes")
    total = max(count, 1)
    lists = edges.select(ident("src").alias("src"), ident("dst").alias("dst")).where("src is not null")
    lists = cut(lists.groupBy("src").agg(F.collect_set(F.struct("dst")).alias("to")), "ppr-links")
    links = lists.select("src", F.transform("to", lambda x: x["dst"]).alias("to"), F.size("to").alias("out"))
    known = seeds.join(nodes, "name").select("qid", F.col("id").alias("name"), "weight")
    mass = known.groupBy("qid").agg(F.sum("weight").alias("all"))
    restart = cut(known.join(mass, "qid").groupBy("qid", "name").agg((F.sum("weight") / F.first("all")).alias("p")), "ppr-restart")
    #: the even start's rows have no question
    state = nodes.select(F.lit(None).cast(restart.schema["qid"].dataType).alias("qid"), F.col("id").alias("name"), F.lit(1.0 / total).alias("rank"))
    summed = lambda df: df.groupBy("qid", "name").agg(F.sum("rank").alias("rank"))

    kept = None  # placed by source once, so that rounds shuffle only ranks
    for turn in range(iterations):
        if turn == 1:
            live = lists.select(F.explode("to.dst").alias("src")).unionAll(restart.select("name")).distinct()
            kept = cut(lists.join(live, "src", "left_semi"), "ppr-links").repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "src").persist()
            links = kept.select("src", F.transform("to", lambda x: x["dst"]).alias("to"), F.size("to").alias("out"))
        went = state.withColumnRenamed("name", "src").join(links, "src", "left").select("qid", "rank", "out", F.explode_outer("to").alias("dst"))
        flow = cut(went.groupBy("qid", F.col("dst").alias("name")).agg((alpha * F.sum(F.col("rank") / F.coalesce("out", F.lit(1)))).alias("rank")), "ppr-flow")
        lost = flow.where("name is null")  # what went nowhere
        own_lost = lost.where("qid is not null").select("qid", F.col("rank").alias("lost"))
        even_lost = lost.where("qid is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("even"))  # one row
        share = (F.coalesce("lost", F.lit(0.0)) + F.col("even") + 1 - alpha) * F.col("p")
        back = restart.join(own_lost, "qid", "left").crossJoin(even_lost).select("qid", "name", share.alias("rank"))
        was, state = state, flow.where("name is not null").unionByName(back)
        if tolerance is not None:
            both = summed(was).withColumnRenamed("rank", "was").join(summed(state).withColumnsRenamed({"qid": "q", "name": "n"}), F.col("qid").eqNullSafe(F.col("q")) & (F.col("name") == F.col("n")), "full")
            moved = both.groupBy(F.coalesce("qid", "q").alias("qid")).agg(F.sum(F.abs(F.coalesce("rank", F.lit(0.0)) - F.coalesce("was", F.lit(0.0)))).alias("d"))
            change = moved.agg(F.coalesce(F.max(F.when(F.col("qid").isNotNull(), F.col("d"))), F.lit(0.0)) + F.coalesce(F.max(F.when(F.col("qid").isNull(), F.col("d"))), F.lit(0.0))).first()[0]
            if change < total * tolerance:
                break
    if kept is not None:
        kept.unpersist()
    even = state.where("qid is null").select("name", F.col("rank").alias("even"))
    own = summed(state.where("qid is not null")).join(even, "name", "left").withColumnRenamed("name", "id")
    return own.join(nodes, "id").select("qid", "name", (F.col("rank") + F.coalesce("even", F.lit(0.0))).alias("rank"))


def paths(edges: DataFrame, starts: DataFrame, depth: int, width: int | None = None, score: Column | None = None, both_ways: bool = False) -> DataFrame:
    """(qid, nodes, relations): paths grown ``depth`` steps from each question's starts (qid, name), no node twice.

    A path that cannot grow is carried on. After each step the ``width`` best by ``score`` (a Column
    over nodes and relations) stay for a question, ties by the path itself; without ``width`` all stay.
    """
    steps = path_steps(edges, both_ways)
    at = path_starts(starts)
    for _ in range(depth):
        at = grow_paths(steps, at, width, score)
    return at


def path_steps(edges: DataFrame, both_ways: bool = False) -> DataFrame:
    """(last, next, relation): the steps that a path may take."""
    steps = edges.select(F.col("src").alias("last"), F.col("dst").alias("next"), "relation")
    if both_ways:
        steps = steps.unionByName(edges.select(F.col("dst").alias("last"), F.col("src").alias("next"), "relation"))
    return steps.distinct()


def path_starts(starts: DataFrame) -> DataFrame:
    """(qid, nodes, relations): a path without a step from each of (qid, name)."""
    return starts.select("qid", F.array("name").alias("nodes"), F.array().cast("array<string>").alias("relations")).distinct()


def grow_paths(steps: DataFrame, at: DataFrame, width: int | None = None, score: Column | None = None) -> DataFrame:
    """One step of ``paths``: all paths ``at`` grown by ``steps``, and the ``width`` best of each question. Written, so rounds don't nest."""
    from pyspark.sql import Window

    tip = at.withColumn("last", F.element_at("nodes", -1))
    grown = tip.join(steps, "last").where(~F.array_contains("nodes", F.col("next")))
    grown = grown.select("qid", F.concat("nodes", F.array("next")).alias("nodes"), F.concat("relations", F.array("relation")).alias("relations"), F.col("nodes").alias("was"), F.col("relations").alias("by"))
    grown = cut(grown, "paths")
    grew = grown.select("qid", F.col("was").alias("nodes"), F.col("by").alias("relations")).distinct()
    at = grown.select("qid", "nodes", "relations").unionByName(at.join(grew, ["qid", "nodes", "relations"], "left_anti"))
    if width is not None:
        order = Window.partitionBy("qid").orderBy(score.desc() if score is not None else F.size("nodes").desc(), F.array_join("nodes", "\x1f"), F.array_join("relations", "\x1f"))
        at = at.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= width).drop("_r")
    return cut(at, "paths")


def weak_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(name, component): component the smallest name. Nodes go to their smallest neighbour, and edges contract, until none is left."""
    live = cut(undirected(edges).where("u < v").select(F.col("u").alias("a"), F.col("v").alias("b")), "wcc-edges")
    nodes = edges.select(F.col("src").alias("name")).unionAll(edges.select("dst")).distinct()
    label = cut(nodes.withColumn("component", F.col("name")), "wcc-labels")
    for _ in range(max_rounds):
        if not live.limit(1).count():
            return label
        ends = live.unionAll(live.select(F.col("b"), F.col("a")))
        up = ends.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("p"))
        above = up.select(F.col("u").alias("p"), F.col("p").alias("q"))
        up = cut(up.join(above, "p").select("u", F.col("q").alias("p")), "wcc-up")
        to = up.select(F.col("u").alias("component"), "p")
        label = cut(label.join(to, "component", "left").select("name", F.coalesce("p", "component").alias("component")), "wcc-labels")
        moved = live.join(up.select(F.col("u").alias("a"), F.col("p").alias("pa")), "a").join(up.select(F.col("u").alias("b"), F.col("p").alias("pb")), "b").where("pa <> pb")
        live = cut(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "wcc-edges")
    raise RuntimeError("components did not settle")


def simple_pairs(edges: DataFrame) -> DataFrame:
    """(u, v): every undirected edge (src, dst) once, from the lesser to the greater name, no loops."""
    return edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).where("src <> dst").distinct()


def pair_degrees(pairs: DataFrame) -> DataFrame:
    """(u, d): how many neighbours each node of ``simple_pairs`` has."""
    return pairs.select(F.explode(F.array("u", "v")).alias("u")).groupBy("u").agg(F.count("*").alias("d"))


def upward_edges(both: DataFrame) -> DataFrame:
    """(u, v, d): undirected edges (u, v; no loops, both ways or as ``simple_pairs``) from the lesser to the greater end in (degree, name) order, with the degree of v.

    An edge moves once to each end, and its shuffle files go when the table is written.
    """
    pairs = both.where("u < v")
    degree = cut(pair_degrees(pairs), "degrees")
    ranked = pairs.join(degree.withColumnRenamed("d", "du"), "u").join(degree.select(F.col("u").alias("v"), F.col("d").alias("dv")), "v")
    low, high = F.struct(F.col("du").alias("d"), F.col("u").alias("n")), F.struct(F.col("dv").alias("d"), F.col("v").alias("n"))
    ends = ranked.select(F.least(low, high).alias("a"), F.greatest(low, high).alias("b"))
    return cut(ends.select(F.col("a.n").alias("u"), F.col("b.n").alias("v"), F.col("b.d").alias("d")), "upward-edges")


def triangle_corners(up: DataFrame) -> DataFrame:
    """(u, v, w) of every triangle of ``upward_edges``, once each, in their order.

    A triangle's middle corner has an edge upwards itself, so a wedge is only opened towards nodes that have one: two
    hubs that never meet cost nothing, however many nodes they share.
    """
    first = cut(up.join(up.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u", "v", "d"), "upward-first")
    wedges = first.join(up.select("u", F.col("v").alias("w"), F.col("d").alias("e")), "u").where("(d, v) < (e, w)").select("u", "v", "w")
    return wedges.join(up.select(F.col("u").alias("v"), F.col("v").alias("w")), ["v", "w"], "left_semi").select("u", "v", "w")


def triangles(edges: DataFrame) -> DataFrame:
    """(name, triangles, degree) over the undirected simple graph, whose ratio is the clustering coefficient.

    Every edge points from its lesser to its greater node in (degree, name) order, so a hub opens few wedges.
    """
    pairs = cut(simple_pairs(edges), "simple-pairs")
    corner = triangle_corners(upward_edges(pairs)).select(F.explode(F.array("u", "v", "w")).alias("u")).groupBy("u").agg(F.count("*").alias("t"))
    return pair_degrees(pairs).join(cut(corner, "corners"), "u", "left").select(F.col("u").alias("name"), F.coalesce("t", F.lit(0)).cast("long").alias("triangles"), F.col("d").cast("long").alias("degree"))


def shortest_hops(edges: DataFrame, seeds: DataFrame, cutoff: int) -> DataFrame:
    """(qid, name, hop) by directed shortest hops from each seed, up to ``cutoff``."""
    steps = edges.select("src", "dst").distinct()
    seen = seeds.select("qid", "name").distinct().withColumn("hop", F.lit(0))
    front = seen
    for hop in range(1, cutoff + 1):
        step = front.select("qid", F.col("name").alias("src")).join(steps, "src").select("qid", F.col("dst").alias("name")).distinct()
        front = cut(step.join(seen.select("qid", "name"), ["qid", "name"], "left_anti").withColumn("hop", F.lit(hop)), "hops")
        seen = seen.unionByName(front)
    return seen


#: Steps of one question that a task may hold as arrays; of those with more, steps travel as rows.
HELD_STEPS = 1_000_000


def hop_counts(edges: DataFrame, cutoff: int, held: int = HELD_STEPS) -> DataFrame:
    """(hop, pairs): how many nodes are ``hop`` directed steps from each node with an out-edge, over all of them, up to ``cutoff``.

    As ``shortest_hops`` counted, but the pairs of the last hop, which are by far the most, are never rows: nodes are numbers, neighbours
    travel as arrays, and an array a question is counted. Questions of over ``held`` steps are counted by distinct rows instead, which can spill.
    """
    numbered = cut(number_rows(cut(edges.select(F.col("src").alias("name")).unionAll(edges.select("dst")).distinct(), "hop-names"), ["name"], "id"), "hop-ids")
    ids = numbered.select("name", F.col("id").cast("int" if numbered.count() < 1 << 31 else "long").alias("id"))
    at = edges.join(ids.toDF("src", "s"), "src").select("s", "dst").join(ids.toDF("dst", "d"), "dst")
    steps = cut(at.select(F.col("s").alias("src"), F.col("d").alias("dst")).distinct(), "hop-steps")
    starts = steps.select(F.col("src").alias("qid"), F.col("src").alias("name")).distinct()
    seen = cut(shortest_hops(steps, starts, max(cutoff - 1, 0)), "hops-seen")
    counts = seen.groupBy("hop").agg(F.count("*").alias("pairs"))
    if not cutoff:
        return counts
    degree = steps.groupBy(F.col("src").alias("name")).agg(F.count("*").alias("k"))
    front = seen.where(F.col("hop") == cutoff - 1).select("qid", "name")
    work = cut(front.join(degree, "name").groupBy("qid").agg(F.sum("k").alias("n")).where(F.col("n") > held).select("qid"), "hop-many")
    many = work.count() > 0
    some = front.join(work, "qid", "left_anti") if many else front
    nexts = steps.join(degree.where(F.col("k") <= held).select(F.col("name").alias("src")), "src", "left_semi") if many else steps
    nexts = nexts.groupBy(F.col("src").alias("name")).agg(F.collect_list("dst").alias("next"))
    rows = some.join(nexts, "name", "left").select("qid", "name", F.coalesce("next", F.array().cast(nexts.schema["next"].dataType)).alias("next"))
    before = seen.where(F.col("hop") < cutoff - 1).join(some.select("qid"), "qid", "left_semi").select("qid", "name", F.array().cast(nexts.schema["next"].dataType))
    new = F.size(F.array_except(F.flatten(F.collect_list("next")), F.collect_list("name")))
    pairs = rows.unionAll(before).groupBy("qid").agg(new.cast("long").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    if many:
        wide = front.join(work, "qid", "left_semi").select("qid", F.col("name").alias("src")).join(steps, "src").select("qid", F.col("dst").alias("name")).distinct()
        wide = wide.join(seen.join(work, "qid", "left_semi").select("qid", "name"), ["qid", "name"], "left_anti")
        pairs = pairs.unionAll(wide.agg(F.count("*").alias("n"))).agg(F.sum("n").alias("n"))
    return counts.unionByName(pairs.where("n > 0").select(F.lit(cutoff).alias("hop"), F.col("n").alias("pairs")))


def two_step_paths(edges: DataFrame, both_ways: bool = False) -> DataFrame:
    """(paths): how many paths of two steps ``paths`` would grow from all nodes, no node twice, counted without making them.

    Through a node go as many walks as steps in times steps out; those that return to where they began go again. So a hub costs a row.
    """
    steps = cut(path_steps(edges, both_ways).where("last <> next").groupBy("last", "next").agg(F.count("*").alias("k")), "path-steps")
    out, into = steps.groupBy(F.col("last").alias("mid")).agg(F.sum("k").alias("o")), steps.groupBy(F.col("next").alias("mid")).agg(F.sum("k").alias("i"))
    back = steps.select(F.col("next").alias("last"), F.col("last").alias("next"), F.col("k").alias("b"))
    walks = into.join(out, "mid").select((F.col("i") * F.col("o")).alias("n"))
    returns = steps.join(back, ["last", "next"]).select((-F.col("k") * F.col("b")).alias("n"))
    return walks.unionAll(returns).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("paths"))
