"""Queries for what results look like.

A turn of a conversation stands for a scene of ten seconds: what the system says is its
title, what the assistant says its description. An event stands for a frame that was found.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenweave.operators import shaping as H
from lumenweave.plans import discovery
from lumenweave.plans import views as V
from lumenweave.plans.registry import ORACLE_SQL, query
from lumenweave.session import table

PREFIXES = ["To ", "The "]
CLOCK = "CASE WHEN {0} >= 3600 THEN printf('%d:%02d:%02d', {0}::BIGINT // 3600, {0}::BIGINT % 3600 // 60, {0}::BIGINT % 60) ELSE printf('%d:%02d', {0}::BIGINT // 60, {0}::BIGINT % 60) END"
SCENES_SQL = f"""raw AS (SELECT conv_id AS video_id, turn AS scene_id, turn * 10.0::DOUBLE AS a, turn * 10.0 + 8::DOUBLE AS b, CASE WHEN role = 'system' THEN text END AS t, CASE WHEN role = 'assistant' THEN text END AS d FROM conversations),
c0 AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(trim(d), '^(\\d+[.)]|[-*•])\\s+', ''), '\\*\\*', '', 'g'), '\\s+', ' ', 'g')) AS x FROM raw),
c1 AS (SELECT *, CASE WHEN starts_with(x, 'To ') THEN ltrim(x[4:]) ELSE x END AS y FROM c0), c2 AS (SELECT *, nullif(CASE WHEN starts_with(y, 'The ') THEN ltrim(y[5:]) ELSE y END, '') AS clean FROM c1),
scenes AS (SELECT video_id, scene_id, a, b, coalesce(nullif(t, ''), nullif(trim(left(split_part(clean, '.', 1), 100)), ''), 'Scene ' || (scene_id + 1)) AS title, clean AS summary FROM c2)"""


def _scenes(spark, d):
    c = table(spark, d, "conversations")
    said = lambda who: F.when(F.col("role") == who, F.col("text"))
    rows = c.select(F.col("conv_id").alias("video_id"), F.col("turn").alias("scene_id"), (F.col("turn") * 10).alias("start_time"), (F.col("turn") * 10 + 8).alias("end_time"), said("system").alias("title"), said("assistant").alias("description"))
    return H.scene_list(rows, "video_id", PREFIXES)


@query(f"WITH {SCENES_SQL} SELECT video_id, scene_id::BIGINT AS scene_id, a AS start_time, b AS end_time, title, summary FROM scenes")
def scene_lists(spark, d):
    return _scenes(spark, d)


@query(f"""WITH {SCENES_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY a, scene_id) - 1 AS n FROM scenes),
ch AS (SELECT video_id, n // 5 AS chapter_id, left(first(title ORDER BY n), 60) AS title, nullif(left(string_agg(summary, ' ' ORDER BY n), 300), '') AS summary, min(a) AS a, max(b) AS b, list(scene_id || '|' || title || '|' || {CLOCK.format('a')} || ' - ' || {CLOCK.format('b')} ORDER BY n) AS scenes FROM n GROUP BY ALL)
SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY chapter_id) AS number, trim(title) AS title, a AS start_time, {CLOCK.format('a')} AS start_formatted, b AS end_time, {CLOCK.format('b')} AS end_formatted, coalesce(trim(summary), trim(title)) AS summary, scenes FROM ch""")
def chapter_entries(spark, d):
    """Chapters of five scenes as numbered entries, with their scenes in short."""
    e = H.entries(H.chapters(_scenes(spark, d), "video_id"), "video_id", ["chapter_id"])
    return e.withColumn("scenes", F.transform("scenes", lambda x: F.concat_ws("|", x["scene_id"].cast("string"), x["title"], x["time_range"])))


@query("""SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY s DESC, frame_id) AS rank, frame_id AS id, coalesce(k, 0) AS frame_number, ts_ms / 1000.0::DOUBLE AS timestamp, kind AS content, s AS score
FROM (SELECT *, CASE WHEN kind = 'purchase' AND score <> 0 THEN score ELSE k / 100.0::DOUBLE END AS s FROM frames WHERE k > 50)""", "frames")
def video_hits(spark, d):
    """The frames found in each video: those of purchases have a combined score."""
    f = V.frames(spark, d)
    found = f.where("k > 50").select("video_id", F.col("frame_id").alias("node_id"), F.when(F.col("kind") == "purchase", F.col("score")).alias("combined_score"), (F.col("k") / 100).alias("vector_score"))
    return H.frame_hits(found, f.select("frame_id", F.col("k").alias("frame_number"), (F.col("ts_ms") / 1000).alias("timestamp"), F.col("kind").alias("description")), "video_id")


LEVEL = "CASE WHEN {0} < 10 THEN 'video' WHEN {0} < 100 THEN 'chapter' ELSE 'scene' END"


def _paths(spark, d):
    e = table(spark, d, "embeddings")
    level = F.when(F.col("vec_id") < 10, "video").when(F.col("vec_id") < 100, "chapter").otherwise("scene")
    nodes = e.select(F.col("vec_id").alias("node"), level.alias("level"), F.concat(F.lit("of "), "label").alias("title"), F.lit(None).cast("string").alias("summary"), F.lit(None).cast("double").alias("start_time"), F.lit(None).cast("double").alias("end_time"))
    n = V.vectors(spark, d).select(F.col("node_id").alias("node"))
    edges = n.where("node BETWEEN 10 AND 99").select((F.col("node") % 10).alias("src"), F.col("node").alias("dst")).union(n.where("node >= 100").select((F.col("node") % 90 + 10).alias("src"), F.col("node").alias("dst")))
    found = discovery.drill_down(spark, d).select("query", "path")
    # a search that stops a level above finds the same paths without their last node
    return H.levels_of(found.unionByName(found.select("query", F.slice("path", 1, 2).alias("path")).distinct()), nodes, edges)


PATHS_SQL = f"WITH found AS ({ORACLE_SQL['drill_down']}), p AS (SELECT query, path FROM found UNION ALL SELECT DISTINCT query, path[1:2] FROM found)"


@query(f"""{PATHS_SQL} SELECT query, path[-1] AS node, {LEVEL.format('path[-1]')} AS level, list_transform(path, lambda x: {LEVEL.format('x')} || ' ' || x) AS path,
'of ' || e.label AS title, len(path) AS steps, len(path) = 2 AND EXISTS (SELECT 1 FROM embeddings c WHERE c.vec_id >= 100 AND c.vec_id % 90 + 10 = path[-1]) AS has_more_levels FROM p JOIN embeddings e ON e.vec_id = path[-1]""")
def drill_down_paths(spark, d):
    """Each path of the drill-down with its levels, and each that stops a level above."""
    shaped, _ = _paths(spark, d)
    return shaped.select("query", "current.node", "current.level", F.transform("path", lambda x: F.concat_ws(" ", x["level"], x["node"].cast("string"))).alias("path"), "current.title", F.size("path").alias("steps"), "has_more_levels")


@query(f"""{PATHS_SQL}, s AS (SELECT query, path, unnest(path) AS x FROM p) SELECT query, list_sort(list(DISTINCT {LEVEL.format('x')})) AS levels_traversed, count(DISTINCT path) AS total_results FROM s GROUP BY query""")
def drill_down_levels(spark, d):
    """The levels that each query passed, and how many results it has."""
    return _paths(spark, d)[1]
