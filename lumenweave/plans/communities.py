"""Queries over communities: the entities of a video and what they are seen with.

A part stands for an entity of the video that is its size, and an order for a frame.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenweave.operators import communities as C
from lumenweave.operators import graph as G
from lumenweave.operators import sinks as K
from lumenweave.operators import tables as B
from lumenweave.plans import views as V
from lumenweave.plans.discovery import HELD, THINGS, things
from lumenweave.plans.registry import query
from lumenweave.session import new_path, table, written

#: Weighted edges between entities of a video.
SEEN = f"""{HELD}, {THINGS}, seen AS (SELECT x.video_id AS graph, a.entity_id AS a, b.entity_id AS b, count(*)::DOUBLE AS w FROM held a JOIN held b ON a.frame_id = b.frame_id AND a.entity_id < b.entity_id
  JOIN things x ON x.entity_id = a.entity_id JOIN things y ON y.entity_id = b.entity_id AND y.video_id = x.video_id GROUP BY ALL)"""
#: Modularity of a membership ``m`` (graph, node, community) on ``seen``.
MODULARITY = """ends AS (SELECT graph, a AS node, w FROM seen UNION ALL SELECT graph, b, w FROM seen), k AS (SELECT graph, node, sum(w) AS k FROM ends GROUP BY ALL), twom AS (SELECT graph, sum(k) AS t FROM k GROUP BY graph),
inn AS (SELECT s.graph, x.community, 2 * sum(w) AS i FROM seen s JOIN m x ON x.graph = s.graph AND x.node = s.a JOIN m y ON y.graph = s.graph AND y.node = s.b AND y.community = x.community GROUP BY ALL),
tot AS (SELECT graph, community, sum(k) AS s FROM k JOIN m USING (graph, node) GROUP BY ALL)
SELECT graph, 0 AS level, round(sum(coalesce(i, 0) / t - (s / t) * (s / t)), 9) + 0.0 AS modularity FROM tot JOIN twom USING (graph) LEFT JOIN inn USING (graph, community) GROUP BY graph"""


def seen(spark, d: str, least: int = 1):
    """``graph, a, b, weight``: entities of one video in one frame; only those that occur ``least`` times or more."""
    held = V.contains(spark, d)
    of = things(spark, d).select("entity_id", F.col("video_id").alias("graph"))
    # a pair of one video meets by frame and video
    e = held.join(of, "entity_id").select(F.struct("graph", "frame_id").alias("frame_id"), "entity_id")
    pairs = G.cooccurrence(e.withColumn("graph", F.col("frame_id.graph")).select("frame_id", "entity_id")).drop("frames")
    edges = pairs.join(of.withColumnRenamed("entity_id", "a"), "a")
    if least > 1:
        counts = held.groupBy("entity_id").agg(F.count("*").alias("occurrences"))
        edges = G.entity_graph(counts, edges, least)
    return edges.select("graph", "a", "b", "weight")


@query(f"WITH {SEEN}, m AS (SELECT video_id AS graph, entity_id AS node, type AS community FROM things), {MODULARITY}")
def type_modularity(spark, d):
    """How well the types of entities part a video's graph."""
    m = things(spark, d).select(F.col("video_id").alias("graph"), F.lit(0).alias("level"), F.col("entity_id").alias("node"), F.col("type").alias("community"))
    return C.modularity(seen(spark, d), m).select("graph", "level", (F.round("modularity", 9) + 0.0).alias("modularity"))


@query()
def leiden_communities(spark, d):
    """Communities of every video at two resolutions."""
    return C.leiden(seen(spark, d), levels=2)


@query()
def louvain_hierarchy(spark, d):
    """The tree of communities of every video, written down as a whole and read back."""
    path = new_path(spark, "hierarchy")
    C.louvain(seen(spark, d)).write.parquet(path)
    return spark.read.parquet(path)


@query()
def video_communities(spark, d):
    """The whole run: the graph of entities that occur twice, communities, those of three entities, and the table replaced video by video."""
    path = new_path(spark, "communities")
    found = written(C.leiden(seen(spark, d, least=2), levels=2))
    best = C.detected(found)
    members = best.join(found, ["graph", "level", "community"]).join(things(spark, d).select(F.col("entity_id").alias("node"), "type"), "node")
    rows = members.groupBy("graph", "rank", "level", "community", "size").agg(F.array_join(F.array_sort(F.collect_set("type")), ", ").alias("themes"))
    rows.where("graph % 2 = 0").withColumn("themes", F.lit("of an earlier run")).write.parquet(path)
    K.rebuild(rows, path, "graph")
    return B.read(spark, path)


#: Regions hold nations, these customers and suppliers, customers orders, and orders and suppliers parts; the user is the number's parity.
TREE_SQL = """nodes AS (SELECT 'r' || r_regionkey AS node, 'Video' AS label, r_regionkey % 2 AS u FROM region UNION ALL SELECT 'n' || n_nationkey, 'Chapter', n_nationkey % 2 FROM nation UNION ALL SELECT 'c' || c_custkey, 'Scene', c_custkey % 2 FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'Scene', s_suppkey % 2 FROM supplier UNION ALL SELECT 'o' || o_orderkey, 'Frame', o_orderkey % 2 FROM orders UNION ALL SELECT 'p' || p_partkey, 'Entity', p_partkey % 2 FROM part),
up AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders UNION ALL SELECT DISTINCT 'p' || l_partkey, 'o' || l_orderkey FROM lineitem UNION ALL SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey FROM lineitem WHERE l_quantity > 45)"""


@query(f"""WITH RECURSIVE {TREE_SQL}, own AS (SELECT node, label FROM nodes WHERE u = 0),
r AS (SELECT node AS start, node, label, [node] AS path FROM own WHERE label IN ('Entity', 'Video') UNION ALL SELECT r.start, o.node, o.label, list_append(path, o.node) FROM r JOIN up ON child = r.node JOIN own o ON o.node = parent WHERE r.label <> 'Video' AND len(path) <= 6)
SELECT start AS node, path FROM r WHERE label = 'Video' QUALIFY row_number() OVER (PARTITION BY start ORDER BY len(path), path) = 1""")
def paths_up(spark, d):
    """The shortest way from every entity up to a video, through nodes of one user alone; a node may have several parents."""
    nodes, up = None, None

    def named(letter: str, key: str):
        return F.concat(F.lit(letter), F.col(key).cast("string"))

    for name, letter, key, label in (("region", "r", "r_regionkey", "Video"), ("nation", "n", "n_nationkey", "Chapter"), ("customer", "c", "c_custkey", "Scene"), ("supplier", "s", "s_suppkey", "Scene"), ("orders", "o", "o_orderkey", "Frame"), ("part", "p", "p_partkey", "Entity")):
        one = table(spark, d, name).select(named(letter, key).alias("node"), F.lit(label).alias("label"), (F.col(key) % 2).cast("long").alias("user"))
        nodes = one if nodes is None else nodes.unionByName(one)
    held = table(spark, d, "lineitem")
    ways = ((table(spark, d, "nation"), "n", "n_nationkey", "r", "n_regionkey"), (table(spark, d, "customer"), "c", "c_custkey", "n", "c_nationkey"), (table(spark, d, "supplier"), "s", "s_suppkey", "n", "s_nationkey"), (table(spark, d, "orders"), "o", "o_orderkey", "c", "o_custkey"), (held, "p", "l_partkey", "o", "l_orderkey"), (held.where("l_quantity > 45"), "p", "l_partkey", "s", "l_suppkey"))
    for rows, a, child, b, parent in ways:
        one = rows.select(named(a, child).alias("child"), named(b, parent).alias("parent"))
        up = one if up is None else up.unionByName(one)
    return G.shortest_up(nodes.where("label IN ('Entity', 'Video')"), up, nodes, "Video", user=0)
