"""Queries over the structure of videos.

An event stands for a frame of the video that is its user's last digit, ten frames a
second; a purchase is a visual boundary. A vector stands for a frame of the video that
is its label, one in two seconds. A conversation is what is said in the video of its number.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenweave.operators import structure as T
from lumenweave.plans import views as V
from lumenweave.plans.registry import query
from lumenweave.session import table, written

NEAR, APART = 2000, 3000

VISUAL_SQL = "vis AS (SELECT user_id % 10 AS video_id, event_id * 100 AS t, event_id AS number, value / 1000.0 AS confidence, 'cut' AS method FROM events WHERE event_type = 'purchase')"
#: Merged boundaries of ``vis`` and ``sem`` (video_id, t, number): each visual one in turn takes the nearest that is left.
MERGED_SQL = f"""vo AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY t, number) AS i FROM vis), so AS (SELECT video_id, list(t ORDER BY t, number) AS ts FROM sem GROUP BY video_id),
r AS (SELECT video_id, 0::BIGINT AS i, []::BIGINT[] AS used, NULL::BIGINT AS hit FROM (SELECT DISTINCT video_id FROM vis)
  UNION ALL SELECT video_id, i, CASE WHEN h IS NULL THEN used ELSE list_append(used, h) END, h FROM (
    SELECT r.video_id, v.i, r.used, list_sort(list_transform(list_filter(range(1, len(coalesce(s.ts, [])) + 1), lambda j: NOT list_contains(r.used, j) AND abs(s.ts[j] - v.t) < {NEAR}), lambda j: {{'d': abs(s.ts[j] - v.t), 'j': j}}))[1].j AS h
    FROM r JOIN vo v ON v.video_id = r.video_id AND v.i = r.i + 1 LEFT JOIN so s ON s.video_id = r.video_id)),
m AS (SELECT v.video_id, CASE WHEN hit IS NULL THEN v.t ELSE (v.t + s.ts[hit]) / 2.0 END::DOUBLE AS t, v.number, CASE WHEN hit IS NULL THEN confidence ELSE (confidence + 0.7) / 2 END AS confidence, CASE WHEN hit IS NULL THEN method ELSE 'merged' END AS method
  FROM r JOIN vo v ON v.video_id = r.video_id AND v.i = r.i LEFT JOIN so s ON s.video_id = r.video_id),
taken AS (SELECT video_id, used FROM r QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY i DESC) = 1),
sn AS (SELECT video_id, t, number, row_number() OVER (PARTITION BY video_id ORDER BY t, number) AS j FROM sem), ml AS (SELECT video_id, list(t) AS ms FROM m GROUP BY video_id),
lo AS (SELECT sn.*, row_number() OVER (PARTITION BY sn.video_id ORDER BY j) AS i FROM sn LEFT JOIN taken k ON k.video_id = sn.video_id LEFT JOIN ml ON ml.video_id = sn.video_id WHERE NOT list_contains(coalesce(used, []), j) AND len(list_filter(coalesce(ms, []), lambda x: abs(x - sn.t) < {APART})) = 0),
a AS (SELECT video_id, 0::BIGINT AS i, NULL::BIGINT AS last, FALSE AS kept FROM (SELECT DISTINCT video_id FROM lo) UNION ALL SELECT a.video_id, l.i, CASE WHEN last IS NULL OR l.t - last >= {APART} THEN l.t ELSE last END, last IS NULL OR l.t - last >= {APART} FROM a JOIN lo l ON l.video_id = a.video_id AND l.i = a.i + 1),
bounds AS (SELECT * FROM m UNION ALL SELECT l.video_id, l.t::DOUBLE, l.number, 0.7, 'semantic' FROM a JOIN lo l ON l.video_id = a.video_id AND l.i = a.i WHERE kept)"""


def visual(spark, d):
    e = table(spark, d, "events").where("event_type = 'purchase'")
    return e.select((F.col("user_id") % 10).alias("video_id"), (F.col("event_id") * 100).alias("t"), F.col("event_id").alias("number"), (F.col("value") / 1000).alias("confidence"), F.lit("cut").alias("method"))


@query(f"WITH RECURSIVE {VISUAL_SQL}, sem AS (SELECT label::BIGINT AS video_id, vec_id * 2000 AS t, vec_id AS number FROM embeddings), {MERGED_SQL} SELECT video_id, t, number, round(confidence, 6) AS confidence, method FROM bounds")
def merged_boundaries(spark, d):
    """Visual boundaries and every vector's as semantic ones, matched one to one."""
    e = table(spark, d, "embeddings")
    semantic = e.select(F.col("label").cast("long").alias("video_id"), (F.col("vec_id") * 2000).alias("t"), F.col("vec_id").alias("number"), F.lit(T.SEMANTIC_CONFIDENCE).alias("confidence"), F.lit("semantic").alias("method"))
    return T.merge_boundaries(visual(spark, d), semantic, "video_id", NEAR, APART).withColumn("confidence", F.round("confidence", 6))


CLUSTERS_SQL = """u AS (SELECT label::BIGINT AS video_id, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i, list_transform(embedding, lambda x: x::DOUBLE / (sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))) + 1e-8)) AS v FROM embeddings),
c AS (SELECT video_id, vec_id, i, v AS total, 1 AS n, TRUE AS fresh FROM u WHERE i = 1
UNION ALL SELECT c.video_id, u.vec_id, u.i, CASE WHEN near THEN list_transform(list_zip(c.total, u.v), lambda p: p[1] + p[2]) ELSE u.v END, CASE WHEN near THEN c.n + 1 ELSE 1 END, NOT near
FROM (SELECT c.*, list_dot_product(list_transform(c.total, lambda x: x / c.n), u.v) >= 0.1 AS near, u.vec_id AS next_id FROM c JOIN u ON u.video_id = c.video_id AND u.i = c.i + 1) c JOIN u ON u.vec_id = c.next_id),
sem AS (SELECT video_id, vec_id * 2000 AS t, i - 1 AS number FROM c WHERE fresh)"""


@query(f"""WITH RECURSIVE {VISUAL_SQL}, {CLUSTERS_SQL}, {MERGED_SQL},
e AS (SELECT user_id % 10 AS video_id, event_id, event_type FROM events), dur AS (SELECT video_id, max(event_id) * 100 + 5000 AS duration FROM e GROUP BY video_id),
sp AS (SELECT b.*, coalesce(lead(t) OVER w, duration) AS stop, row_number() OVER w AS i FROM bounds b JOIN dur USING (video_id) WINDOW w AS (PARTITION BY video_id ORDER BY t, number, method)),
sc AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY t, number, method) - 1 AS scene_id, t AS start_ms, stop AS end_ms, floor(t * 0.01)::BIGINT AS f, floor(stop * 0.01)::BIGINT AS g, method FROM sp WHERE i = 1 OR stop - t >= {APART}),
held AS (SELECT sc.video_id, scene_id, event_id, event_type FROM sc JOIN e ON e.video_id = sc.video_id AND event_id >= f AND event_id < g),
said AS (SELECT video_id, scene_id, string_agg(event_type || ' ' || event_id, ' ' ORDER BY event_id) AS description FROM (SELECT * FROM held QUALIFY row_number() OVER (PARTITION BY video_id, scene_id ORDER BY event_id) <= 3) GROUP BY ALL),
obj AS (SELECT video_id, scene_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS objects FROM held GROUP BY ALL),
ty AS (SELECT video_id, scene_id, event_type AS scene_type FROM (SELECT video_id, scene_id, event_type, count(*) AS n, min(event_id) AS a FROM held GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY video_id, scene_id ORDER BY n DESC, a) = 1),
tr AS (SELECT sc.video_id, scene_id, string_agg(role, ' ' ORDER BY turn) AS transcript FROM sc JOIN conversations ON conv_id = sc.video_id AND turn * 10000 >= start_ms AND turn * 10000 + 8000 <= end_ms GROUP BY ALL)
SELECT sc.video_id, scene_id::INT AS scene_id, scene_id // 5 AS chapter_id, 'Chapter ' || (scene_id // 5 + 1) AS title, min(start_ms) OVER p AS chapter_start, max(end_ms) OVER p AS chapter_end, start_ms, end_ms, CASE WHEN g <= f THEN [] WHEN g - f <= 3 THEN range(f, g) ELSE list_transform(range(1, 4), lambda i: floor(f + (g - f) / 4.0 * i)::BIGINT) END AS keyframes,
method, description, coalesce(objects, '') AS objects, scene_type, transcript FROM sc LEFT JOIN said USING (video_id, scene_id) LEFT JOIN obj USING (video_id, scene_id) LEFT JOIN ty USING (video_id, scene_id) LEFT JOIN tr USING (video_id, scene_id) WINDOW p AS (PARTITION BY sc.video_id, scene_id // 5)""")
def video_analysis(spark, d):
    """Scenes and chapters from visual boundaries and clusters of like vectors."""
    e = table(spark, d, "events").select((F.col("user_id") % 10).alias("video_id"), "event_id", "event_type")
    frames = e.select("video_id", F.col("event_id").alias("frame_number"), F.concat_ws(" ", "event_type", "event_id").alias("description"), F.array("event_type").alias("objects"), F.col("event_type").alias("scene_type"))
    durations = e.groupBy("video_id").agg((F.max("event_id") * 100 + 5000).alias("duration"))
    embedded = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("video_id"), (F.col("vec_id") * 2000).alias("t"), F.col("embedding").alias("v"))
    segments = V.segments(spark, d).select("video_id", "start_ms", "end_ms", F.col("speaker").alias("text"))
    scenes, chapters = T.analyse(visual(spark, d), embedded, durations, frames, segments, "video_id", 10.0, NEAR, APART, 0.1)
    c = chapters.select("video_id", F.col("chapter_id").cast("long").alias("chapter_id"), "title", F.col("start_ms").alias("chapter_start"), F.col("end_ms").alias("chapter_end"), F.explode("scene_ids").alias("scene_id"))
    out = written(scenes).join(c, ["video_id", "scene_id"])
    return out.select("video_id", "scene_id", "chapter_id", "title", "chapter_start", "chapter_end", "start_ms", "end_ms", "keyframes", "method", "description", F.array_join("objects", ",").alias("objects"), "scene_type", "transcript")
