"""Node and edge tables: entities that appear together, neighbourhoods, paths, hierarchies, communities."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenweave.session import written


def cooccurrence(contains: DataFrame, frame: str = "frame_id", entity: str = "entity_id", keep: int = 5) -> DataFrame:
    """``a, b, weight, frames``: entities in the same frame; the smallest ``keep`` frames are listed."""
    pairs = contains.select(F.col(frame), F.col(entity).alias("a")).join(contains.select(F.col(frame), F.col(entity).alias("b")), frame).where("a < b")
    ranked = pairs.withColumn("_n", F.row_number().over(Window.partitionBy("a", "b").orderBy(frame)))
    return ranked.groupBy("a", "b").agg(F.count("*").alias("weight"), F.array_sort(F.collect_list(F.when(F.col("_n") <= keep, F.col(frame)))).alias("frames"))


def entity_graph(entities: DataFrame, edges: DataFrame, least: int, node: str = "entity_id", occurrences: str = "occurrences") -> DataFrame:
    """Edges between entities that occur ``least`` times or more."""
    some = entities.where(F.col(occurrences) >= least).select(F.col(node))
    return edges.join(some.withColumnRenamed(node, "a"), "a", "left_semi").join(some.withColumnRenamed(node, "b"), "b", "left_semi")


def accumulate(mentions: DataFrame, keys: list[str], at: str, text: str, confidence: str, keep: int = 5) -> DataFrame:
    """One row an entity: count, first and last time, best confidence, longest text, up to ``keep`` distinct texts in order of time."""
    new = F.row_number().over(Window.partitionBy(*keys, text).orderBy(at)) == 1
    # the first of each text are numbered before any are gathered
    nth = F.sum(F.col("_new").cast("int")).over(Window.partitionBy(*keys).orderBy(F.col(at), F.col(text)).rowsBetween(Window.unboundedPreceding, 0))
    ranked = mentions.withColumn("_new", new).withColumn("_n", nth)
    texts = F.transform(F.array_sort(F.collect_list(F.when(F.col("_new") & (F.col("_n") <= keep), F.struct(at, text)))), lambda s: s[text])
    return ranked.groupBy(*keys).agg(F.count("*").alias("occurrences"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.max(confidence).alias("confidence"), F.max_by(text, F.struct(F.length(text), F.col(text))).alias("description"), texts.alias("descriptions"))


def common_entities(mentions: DataFrame, name: str, kind: str, video: str, frame: str, least: int = 2) -> DataFrame:
    """``name, type, videos, n_videos, appearances`` of what stands in ``least`` videos or more."""
    per = mentions.groupBy(name, kind, video).agg(F.countDistinct(frame).alias("n"))
    return per.groupBy(F.col(name).alias("name"), F.col(kind).alias("type")).agg(F.array_sort(F.collect_list(video)).alias("videos"), F.count("*").alias("n_videos"), F.sum("n").alias("appearances")).where(F.col("n_videos") >= least)


#: Entities of one name that meet those of another in one task, and pairs that a task hands on, about.
TILE, PAIRS = 4096, 4_000_000


def same_entities(entities: DataFrame, node: str, name: str, kind: str, video: str, least: int = 4, gram: int = 4, user: str | None = None) -> DataFrame:
    """``a, b, similarity`` of entities of one type in different videos: 1.0 for equal names, 0.7 if one long name contains the other.

    A name that contains another holds all of its ``gram``-letter pieces, so distinct
    names meet by the first piece of the shorter; entities meet tile by tile where
    their names do. With ``user``, only entities of the same user are the same, and
    those of none are left out.
    """
    of = [F.col(c).alias(f"k{i}") for i, c in enumerate([kind, user] if user else [kind])]
    k = [f"k{i}" for i in range(len(of))]
    rows = entities.select(F.col(node).alias("id"), F.col(name).alias("name"), F.col(video).alias("video"), *of)
    rows = rows.where(reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in rows.columns])).distinct()
    e = written(rows.withColumn("many", F.count("*").over(Window.partitionBy("id")) > 1))
    names = written(e.groupBy(*k, "name").agg(F.count("*").alias("n")))
    # tables of few bytes may hold very many rows: none of these joins is left to their size on disk
    long = names.where(F.length("name") >= least)
    heads = long.select(*k, F.substring("name", 1, gram).alias("g"), F.col("name").alias("x"), F.col("n").alias("nx"))
    pieces = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("name") - gram + 1, F.lit(1))), lambda i: F.substring(F.col("name"), i, F.lit(gram))))
    inside = long.select(*k, F.explode(pieces).alias("g"), F.col("name").alias("y"), F.col("n").alias("ny"))
    part = heads.join(inside.hint("merge"), [*k, "g"]).where("x <> y AND contains(y, x)").select(*k, "x", "y", "nx", "ny", F.lit(0.7).alias("similarity"))
    alike = names.where("n > 1").select(*k, F.col("name").alias("x"), F.col("name").alias("y"), F.col("n").alias("nx"), F.col("n").alias("ny"), F.lit(1.0).alias("similarity"))
    tiles = lambda n: F.ceil(F.col(n) / TILE).cast("int")
    met = written(alike.unionByName(part).withColumns({"tx": tiles("nx"), "ty": tiles("ny")}))
    total = met.agg(F.sum(F.col("nx") * F.col("ny"))).first()[0] or 0
    parts = max(int(e.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PAIRS))

    def side(at: str, other: str, mine: str, its: str) -> DataFrame:
        own = e.select(*k, F.col("name").alias(at), F.col("id").alias(f"id_{at}"), F.col("video").alias(f"video_{at}")).join(met.hint("merge"), [*k, at])
        every = F.explode(F.sequence(F.lit(0), F.col(f"t{other}") - 1)).alias(its)
        kept = ["similarity"] if at == "x" else []
        dealt = own.select(*k, "x", "y", F.pmod(F.xxhash64(f"id_{at}"), F.col(f"t{at}")).cast("int").alias(mine), every, f"id_{at}", f"video_{at}", *kept)
        return dealt.repartition(parts, *k, "x", "y", "i", "j")

    pairs = side("x", "y", "i", "j").join(side("y", "x", "j", "i").hint("merge"), [*k, "x", "y", "i", "j"])
    apart = "id_x < id_y" if user else "id_x <= id_y"
    pairs = pairs.where(f"video_x <> video_y AND (x <> y OR {apart})" + (" AND id_x <> id_y" if user else ""))
    found = pairs.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b"), "similarity")
    # ids of one row each make a pair once
    return found if e.where("many").isEmpty() else found.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def both_ways(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    return edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).union(edges.select(F.col(dst), F.col(src))).distinct()


#: Steps from a node of more neighbours than this are not written out for each start that comes by.
HUB = 1000


@dataclass
class _Two:
    """What is two steps from ``starts``, with the steps over hubs told apart.

    ``first`` and ``second`` (start, node): the nodes at one step, and those at two that
    no hub leads to. ``heads`` (start, h) names the set of hubs beside a start, ``over``
    (h, node) what these reach, the start among it; ``known`` (start, node) what of that
    is at one step.
    """

    first: DataFrame
    second: DataFrame
    heads: DataFrame
    over: DataFrame
    known: DataFrame

    @classmethod
    def of(cls, starts: DataFrame, edges: DataFrame) -> _Two:
        # few bytes on disk may be very many rows: none of these joins is left to a table's size
        steps = written(both_ways(edges).where("src IS NOT NULL AND dst IS NOT NULL"))
        onward = steps.withColumnRenamed("src", "node").hint("merge")
        own = starts.select("start").where("start IS NOT NULL").distinct()
        first = written(own.join(steps.withColumnsRenamed({"src": "start", "dst": "node"}).hint("merge"), "start"))
        hubs = written(steps.groupBy(F.col("src").alias("node")).count().where(F.col("count") > HUB).select("node"))
        beside = first.join(hubs.hint("merge"), "node", "left_semi").groupBy("start").agg(F.array_sort(F.collect_set("node")).alias("hubs"))
        sets = written(beside.select("hubs").distinct().withColumn("h", F.monotonically_increasing_id()))
        heads = written(beside.join(sets, "hubs").select("start", "h"))
        over = written(sets.select("h", F.explode("hubs").alias("node")).join(onward, "node").select("h", F.col("dst").alias("node")).distinct())
        known = written(first.where("node <> start").join(heads.hint("merge"), "start").join(over.hint("merge"), ["h", "node"], "left_semi").select("start", "node"))
        second = first.join(hubs.hint("merge"), "node", "left_anti").join(onward, "node").select("start", F.col("dst").alias("node")).where("node <> start").distinct()
        second = second.join(first.hint("merge"), ["start", "node"], "left_anti").join(heads.hint("merge"), "start", "left").join(over.hint("merge"), ["h", "node"], "left_anti")
        return cls(first.where("node <> start"), written(second.select("start", "node")), heads, over, known)

    def third(self) -> DataFrame:
        """``start, node`` at two steps by hubs, tile by tile: each pair comes once, and none is gathered again."""
        known = self.known.groupBy("start").agg(F.collect_list("node").alias("known"), F.count("*").alias("n"))
        heads = self.heads.join(known.hint("merge"), "start", "left")
        sizes = self.heads.groupBy("h").agg(F.count("*").alias("starts")).join(self.over.groupBy("h").agg(F.count("*").alias("nodes")), "h")
        tiles = lambda n: F.ceil(F.col(n) / TILE).cast("int")
        sizes = written(sizes.withColumns({"ti": tiles("starts"), "tj": tiles("nodes")}))
        total = sizes.agg(F.sum(F.col("starts") * F.col("nodes"))).first()[0] or 0
        parts = max(int(self.heads.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PAIRS))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        at = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        few = F.coalesce("n", F.lit(0)) <= FEW
        left = heads.join(sizes.hint("merge"), "h").select("h", at("start", "ti").alias("i"), every("tj").alias("j"), "start", F.when(few, F.coalesce("known", F.array())).alias("known"))
        right = self.over.join(sizes.hint("merge"), "h").select("h", every("ti").alias("i"), at("node", "tj").alias("j"), "node")
        met = left.repartition(parts, "h", "i", "j").join(right.repartition(parts, "h", "i", "j").hint("merge"), ["h", "i", "j"]).where("node <> start")
        one = met.where("known IS NOT NULL AND NOT array_contains(known, node)").select("start", "node")
        if known.where(~few).isEmpty():
            return one
        return one.unionByName(met.where("known IS NULL").select("start", "node").join(self.known.hint("merge"), ["start", "node"], "left_anti"))


#: So many nodes of a start are looked for in a list; more are joined.
FEW = 256


def neighbours(starts: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """``start, node, distance``: what is within ``hops`` undirected steps, by the least distance; the start itself is left out."""
    if hops < 1:
        return starts.select(F.col("start"), F.col("start").alias("node"), F.lit(0).alias("distance")).limit(0)
    if hops == 2:
        two = _Two.of(starts, edges)
        parts = [two.first.withColumn("distance", F.lit(1)), two.second.withColumn("distance", F.lit(2)), two.third().withColumn("distance", F.lit(2))]
        return reduce(lambda x, y: x.unionByName(y), parts)
    steps = written(both_ways(edges)) if hops > 1 else both_ways(edges)
    edge = starts.select("start", F.col("start").alias("node")).distinct()
    found = []
    for d in range(1, hops + 1):
        edge = edge.join(steps, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        edge = written(edge) if d < hops else edge
        found.append(edge.withColumn("distance", F.lit(d)))
    reached = reduce(lambda x, y: x.union(y), found).where("node <> start")
    return reached.groupBy("start", "node").agg(F.min("distance").alias("distance"))


def context(starts: DataFrame, edges: DataFrame, hops: int, most: int = 30, per_distance: int = 5) -> DataFrame:
    """The neighbours that are shown, with ``total_related`` of the start: ``most`` by distance, then ``per_distance`` of each.

    At two hops what hubs lead to is counted by the set of hubs, and of it only the nodes
    are looked at that may be shown.
    """
    if hops == 2:
        two = _Two.of(starts, edges)
        near = two.first.withColumn("distance", F.lit(1)).unionByName(two.second.withColumn("distance", F.lit(2)))
        # the start is among what its hubs reach
        beyond = two.heads.join(two.over.groupBy("h").agg((F.count("*") - 1).alias("n")), "h").select("start", "n")
        counts = near.groupBy("start").agg(F.count("*").alias("n")).unionByName(beyond).unionByName(two.known.groupBy("start").agg((-F.count("*")).alias("n")))
        totals = counts.groupBy("start").agg(F.sum("n").alias("total_related"))
        # of these as many are left out at most as there are nodes at one step, under ``most`` where any of two steps is shown, and the start
        lowest = two.over.withColumn("_n", F.row_number().over(Window.partitionBy("h").orderBy("node"))).where(F.col("_n") <= per_distance + most).select("h", "node")
        some = two.heads.join(lowest.hint("merge"), "h").where("node <> start").select("start", "node").join(two.known.hint("merge"), ["start", "node"], "left_anti")
        n = near.unionByName(some.withColumn("distance", F.lit(2)))
    else:
        n = neighbours(starts, edges, hops)
        totals = n.groupBy("start").agg(F.count("*").alias("total_related"))
    ranked = n.withColumn("_n", F.row_number().over(Window.partitionBy("start").orderBy("distance", "node"))).where(F.col("_n") <= most)
    ranked = ranked.withColumn("_d", F.row_number().over(Window.partitionBy("start", "distance").orderBy("node"))).where(F.col("_d") <= per_distance).drop("_n", "_d")
    return ranked.join(totals, "start").select("start", "node", "distance", "total_related")


def companions(contains: DataFrame, starts: DataFrame, k: int, frame: str = "frame_id", entity: str = "entity_id") -> DataFrame:
    """``start, node, distance``: of each start the first ``k`` entities of one frame with it, then of one frame with those, by distance and node.

    ``contains`` may repeat rows. A start with ``k`` at one step needs no second, and no
    frame or entity can give more than its ``k + 1`` lowest: of those one may be the start
    itself or the entity between, and the others that are left out stand before.
    """
    rows = contains.select(F.col(frame).alias("frame"), F.col(entity).alias("node")).where("frame IS NOT NULL AND node IS NOT NULL")
    lowest = lambda df, key: df.withColumn("_n", F.dense_rank().over(Window.partitionBy(key).orderBy("node"))).where(F.col("_n") <= k + 1).drop("_n").distinct()
    low = written(lowest(rows, "frame"))

    def beside(some: DataFrame, name: str) -> DataFrame:
        held = rows.join(some.select(F.col(name).alias("node")), "node").select(F.col("node").alias(name), "frame").distinct()
        return held.join(low.hint("merge"), "frame").where(F.col("node") != F.col(name)).select(name, "node")

    first = lowest(beside(starts.select("start").where("start IS NOT NULL").distinct(), "start"), "start")
    first = written(first.withColumn("n", F.count("*").over(Window.partitionBy("start"))))
    few = first.where(F.col("n") < k)
    between = written(few.select(F.col("start"), F.col("node").alias("between")))
    onward = lowest(beside(between.select("between").distinct(), "between"), "between")
    second = between.join(onward, "between").where("node <> start").select("start", "node").distinct().join(few.select("start", "node"), ["start", "node"], "left_anti")
    both = first.select("start", "node", F.lit(1).alias("distance")).unionByName(second.withColumn("distance", F.lit(2)))
    return both.withColumn("_n", F.row_number().over(Window.partitionBy("start").orderBy("distance", "node"))).where(F.col("_n") <= k).drop("_n")


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The distinct edges with both ends among ``node``."""
    n = nodes.select("node").distinct()
    return edges.join(n.withColumnRenamed("node", "src"), "src", "left_semi").join(n.withColumnRenamed("node", "dst"), "dst", "left_semi").distinct()


def one_hop(node: DataFrame, edges: DataFrame) -> DataFrame:
    """``start, node, rel_type, direction`` of both directions."""
    out = node.join(edges, F.col("start") == F.col("src")).select("start", F.col("dst").alias("node"), "rel_type", F.lit("outgoing").alias("direction"))
    return out.union(node.join(edges, F.col("start") == F.col("dst")).select("start", F.col("src"), "rel_type", F.lit("incoming")))


def path_up(nodes: DataFrame, parents: DataFrame, most: int = 6) -> DataFrame:
    """``node, path`` from the root down to the node, over ``parents`` (child, parent); each child has one parent."""
    path = nodes.select("node", F.col("node").alias("_top"), F.array(F.col("node")).alias("path"))
    for i in range(most):
        p = parents.select(F.col("child").alias("_c"), F.col("parent").alias("_p"))
        path = path.join(p, F.col("_top") == F.col("_c"), "left").select("node", F.coalesce("_p", "_top").alias("_top"), F.when(F.col("_p").isNull(), F.col("path")).otherwise(F.array_prepend("path", F.col("_p"))).alias("path"))
    return path.select("node", "path")


def shortest_up(starts: DataFrame, parents: DataFrame, nodes: DataFrame, top: str, most: int = 6, user: object = None, beam: int | None = None) -> DataFrame:
    """``node, path``: from each of ``starts`` (node) the shortest way up to a node of label ``top``, of equals the smallest.

    ``parents`` (child, parent) may give a node several. ``nodes`` has node, label and
    user: with ``user`` every node of a path has to be theirs. Each hop keeps one path a
    start and node, and with ``beam`` the smallest so many of a start. A start of label
    ``top`` is its own path; one from which ``most`` hops reach none has no row.
    """
    own = nodes if user is None else nodes.where(F.col("user") == F.lit(user))
    known = written(own.select("node", (F.col("label") == top).alias("ends")))
    edges = parents.select(F.col("child").alias("node"), "parent").distinct()
    at = starts.select("node").distinct().join(known, "node").select(F.col("node").alias("start"), "node", F.array("node").alias("path"), "ends")
    found = []
    for hop in range(most + 1):
        at = written(at)
        found.append(at.where("ends").groupBy("start").agg(F.min("path").alias("path")))
        if hop == most:
            break
        # who has arrived goes no further
        on = at.join(found[-1].select("start"), "start", "left_anti")
        if on.isEmpty():
            break
        up = on.join(edges, "node").select("start", F.col("parent").alias("node"), F.array_append("path", F.col("parent")).alias("path")).where("NOT array_contains(slice(path, 1, size(path) - 1), node)")
        at = up.join(known, "node").groupBy("start", "node", "ends").agg(F.min("path").alias("path"))
        if beam is not None:
            at = at.withColumn("_n", F.row_number().over(Window.partitionBy("start").orderBy(F.desc("ends"), "path"))).where(F.col("_n") <= beam).drop("_n")
    return reduce(lambda x, y: x.unionByName(y), found).select(F.col("start").alias("node"), "path")


def quota_sample(nodes: DataFrame, video: str, label: str, node: str, quotas: dict[str, float], most: int, least: int = 5) -> DataFrame:
    """Of each label in a video its first nodes by id: a share of ``most``, but ``least`` anyway."""
    rows = [(k, max(least, int((most - 1) * v))) for k, v in quotas.items()]
    q = nodes.sparkSession.createDataFrame(rows, f"`{label}` string, _quota int")
    ranked = nodes.join(F.broadcast(q), label).withColumn("_n", F.row_number().over(Window.partitionBy(video, label).orderBy(node)))
    return ranked.where("_n <= _quota").drop("_n", "_quota")


def connected(edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node that edges reach. Labels run along the edges and jump, written down each round."""
    e = written(both_ways(edges, "a", "b"))
    labels = written(e.select(F.col("src").alias("node")).distinct().withColumn("component", F.col("node")))
    while True:
        near = e.join(labels, F.col("dst") == F.col("node")).groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        low = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("component").alias("top"))
        new = written(low.join(up, "low", "left").select("node", "was", F.least("low", F.coalesce("top", "low")).alias("component")))
        if new.where("component <> was").isEmpty():
            return new.select("node", "component")
        labels = new.select("node", "component")


def communities(membership: DataFrame, entities: DataFrame, least: int = 3, most: int = 20) -> DataFrame:
    """``community, members, size, first_seen, last_seen``: the largest ``most`` of ``least`` members or more."""
    m = membership.join(entities, "node").groupBy(F.col("component").alias("community")).agg(F.array_sort(F.collect_list("node")).alias("members"), F.count("*").alias("size"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    return m.where(F.col("size") >= least).orderBy(F.desc("size"), "community").limit(most)
