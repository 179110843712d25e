"""Queries over what to look at in a video."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenweave.operators import sampling as A
from lumenweave.plans import views as V
from lumenweave.plans.registry import query
from lumenweave.session import table


def _videos(spark, d):
    """A customer stands for a video; its length in seconds is made from its balance."""
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("video_id"), F.col("c_nationkey").alias("n"), F.floor(F.abs("c_acctbal") * 3).cast("double").alias("seconds"))


VIDEOS_SQL = "v AS (SELECT c_custkey AS video_id, c_nationkey AS n, floor(abs(c_acctbal) * 3)::DOUBLE AS seconds FROM customer)"


@query(f"""WITH RECURSIVE {VIDEOS_SQL}, r AS (SELECT video_id, seconds, 0 AS i, 0.0::DOUBLE AS start FROM v WHERE seconds > 0
UNION ALL SELECT video_id, seconds, i + 1, least(seconds, start + 600) - 30 FROM r WHERE least(seconds, start + 600) < seconds AND i + 1 < 40),
c AS (SELECT video_id, seconds, i, start, least(seconds, start + 600) AS stop FROM r), kept AS (SELECT * FROM c WHERE i = 0 OR stop - start >= 45)
SELECT video_id, i AS n, round(start, 3) AS start, round(stop, 3) AS "end", max(stop) OVER (PARTITION BY video_id) + 0.001 >= seconds AS covered FROM kept""")
def audio_chunks(spark, d):
    return A.audio_chunks(_videos(spark, d).drop("n"), "seconds", 600, 30, 45, 40).drop("seconds")


@query(f"""WITH {VIDEOS_SQL}, a AS (SELECT video_id, seconds, (['interval', 'fps', 'uniform', 'adaptive', 'scene_detect'])[n % 5 + 1] AS method FROM v),
t AS (SELECT video_id, CASE method WHEN 'interval' THEN list_transform(range(least(ceil(seconds / 45), 100)::BIGINT), lambda i: i * 45.0) WHEN 'fps' THEN list_transform(range(least(ceil(seconds * 0.25), 100)::BIGINT), lambda i: i * 4.0)
WHEN 'uniform' THEN list_transform(range(12), lambda i: least(i * (seconds / 11), greatest(seconds - 0.1, 0))) WHEN 'adaptive' THEN CASE WHEN seconds >= 300 AND seconds < 1800 THEN list_transform(range(least(ceil(seconds / 3), 100)::BIGINT), lambda i: i * 3.0) ELSE [] END ELSE [] END AS t FROM a WHERE seconds > 0)
SELECT v.video_id, len(coalesce(t, []))::INT AS n, round(coalesce(list_sum(t), 0), 4)::DOUBLE AS total, round(coalesce(list_max(t), 0), 4)::DOUBLE AS latest FROM v LEFT JOIN t USING (video_id)""")
def frame_times(spark, d):
    method = F.get(F.array(*map(F.lit, ["interval", "fps", "uniform", "adaptive", "scene_detect"])), F.col("n") % 5)
    t = _videos(spark, d).withColumn("t", A.frame_times(F.col("seconds"), method, 45.0, 0.25, 12, 100))
    return t.select("video_id", F.size("t").alias("n"), F.round(F.aggregate("t", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.round(F.coalesce(F.array_max("t"), F.lit(0.0)), 4).alias("latest"))


@query(f"""WITH {VIDEOS_SQL} SELECT video_id, CASE WHEN seconds >= 300 AND seconds < 1800 THEN 'interval' ELSE 'hybrid' END AS method, CASE WHEN seconds < 300 THEN 1 WHEN seconds < 1800 THEN 3 WHEN seconds < 3600 THEN 4 WHEN seconds < 7200 THEN 5 WHEN seconds < 14400 THEN 6 WHEN seconds < 28800 THEN 8 ELSE 10 END::DOUBLE AS interval,
CASE WHEN seconds < 300 THEN 0.35 WHEN seconds < 1800 THEN NULL WHEN seconds < 3600 THEN 0.35 WHEN seconds < 7200 THEN 0.3 WHEN seconds < 14400 THEN 0.25 WHEN seconds < 28800 THEN 0.2 ELSE 0.15 END::DOUBLE AS threshold,
CASE WHEN seconds < 300 THEN 300 WHEN seconds < 1800 THEN 400 WHEN seconds < 3600 THEN 600 WHEN seconds < 7200 THEN 800 WHEN seconds < 14400 THEN 1200 WHEN seconds < 28800 THEN 1500 ELSE 2000 END AS most FROM v""")
def adaptive_sampling(spark, d):
    return _videos(spark, d).withColumn("how", A.adaptive(F.col("seconds"))).select("video_id", "how.method", "how.interval", "how.threshold", "how.most")


@query("""WITH s AS (SELECT DISTINCT o_custkey AS video_id, (o_orderkey % 900)::DOUBLE AS t FROM orders), v AS (SELECT c_custkey AS video_id, 900.0::DOUBLE AS d FROM customer),
g AS (SELECT video_id, t, lead(t) OVER w - t AS gap, count(*) OVER (PARTITION BY video_id) AS c FROM s WINDOW w AS (PARTITION BY video_id ORDER BY t)),
f AS (SELECT video_id, t, gap, floor(gap / sum(gap) OVER (PARTITION BY video_id) * (24 - c))::INT AS n FROM (SELECT video_id, t, c, CASE WHEN gap > 40 THEN gap END AS gap FROM g)),
x AS (SELECT video_id, t FROM s UNION SELECT video_id, t + j * (gap / (n + 1)) FROM (SELECT video_id, t, gap, n, unnest(range(1, n + 1)) AS j FROM f WHERE n > 0)),
e AS (SELECT video_id, t FROM x UNION SELECT video_id, 0 FROM x UNION SELECT video_id, 899.9 FROM x WHERE video_id NOT IN (SELECT video_id FROM x WHERE t = 899.5)),
k AS (SELECT video_id, t FROM e QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY t) <= 24 UNION ALL SELECT video_id, unnest(range(24)) * (900.0 / 23) FROM v WHERE video_id NOT IN (SELECT video_id FROM x))
SELECT video_id, count(*) AS n, round(sum(t), 4)::DOUBLE AS total FROM k GROUP BY video_id""")
def hybrid_times(spark, d):
    scenes = table(spark, d, "orders").select(F.col("o_custkey").alias("video_id"), (F.col("o_orderkey") % 900).cast("double").alias("t"))
    videos = table(spark, d, "customer").select(F.col("c_custkey").alias("video_id"), F.lit(900.0).alias("d"))
    return A.hybrid_times(scenes, videos, "video_id", "t", "d", 40, 24).groupBy("video_id").agg(F.count("*").alias("n"), F.round(F.sum("t"), 4).alias("total"))


@query(f"""WITH {VIDEOS_SQL}, l AS (SELECT video_id, seconds, greatest(least(300, seconds / 5), 60) AS length FROM v WHERE seconds > 0)
SELECT video_id, i AS n, round(i * length, 4)::DOUBLE AS start FROM (SELECT video_id, length, unnest(range(ceil(seconds / length)::BIGINT)) AS i FROM l)""")
def uniform_scenes(spark, d):
    return A.uniform_scenes(_videos(spark, d).drop("n"), "seconds", 60, 300).select("video_id", "n", F.round("start", 4).alias("start"))


@query("""WITH c AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS ks FROM orders GROUP BY o_custkey)
SELECT o_custkey, CASE WHEN len(ks) <= 4 THEN ks ELSE list_transform(list_sort(list_distinct(list_transform(range(4), lambda i: round_even(i * ((len(ks) - 1) / 3.0), 0)::BIGINT))), lambda i: ks[i + 1]) END AS four, CASE WHEN len(ks) <= 1 THEN ks ELSE [ks[len(ks) // 2 + 1]] END AS one,
CASE WHEN len(ks) <= 3 THEN range(len(ks)) ELSE list_transform(range(1, 4), lambda i: floor(len(ks) / 4.0 * i)::BIGINT) END AS keys FROM c""")
def evenly_spaced(spark, d):
    c = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("ks"))
    return c.select("o_custkey", A.evenly(F.col("ks"), 4).alias("four"), A.evenly(F.col("ks"), 1).alias("one"), A.keyframes(F.lit(0), F.size("ks"), 3).alias("keys"))


@query(f"""WITH {VIDEOS_SQL} SELECT video_id, list_transform([0.1, 0.5, 0.85], lambda x: round(x * seconds, 4)::DOUBLE) AS points FROM v""")
def fallback_points(spark, d):
    return _videos(spark, d).select("video_id", F.transform(A.fallback_points(F.col("seconds")), lambda x: F.round(x, 4)).alias("points"))


@query("""WITH RECURSIVE u AS (SELECT label AS video_id, vec_id AS node_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i, list_transform(embedding, lambda x: x::DOUBLE / (sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))) + 1e-8)) AS v FROM embeddings),
r AS (SELECT video_id, node_id, i, v AS total, 1 AS n, 0 AS cluster FROM u WHERE i = 1
UNION ALL SELECT u.video_id, u.node_id, u.i, CASE WHEN near THEN list_transform(list_zip(r.total, u.v), lambda p: p[1] + p[2]) ELSE u.v END, CASE WHEN near THEN r.n + 1 ELSE 1 END, CASE WHEN near THEN r.cluster ELSE r.cluster + 1 END
FROM (SELECT r.*, list_dot_product(list_transform(r.total, lambda x: x / r.n), u.v) >= 0.1 AS near, u.v, u.node_id AS next_id FROM r JOIN u ON u.video_id = r.video_id AND u.i = r.i + 1) r JOIN u ON u.node_id = r.next_id)
SELECT video_id, node_id, cluster FROM r""")
def semantic_clusters(spark, d):
    return A.semantic_clusters(V.vectors(spark, d), "video_id", ["node_id"], "v", 0.1).select("video_id", "node_id", "cluster")
