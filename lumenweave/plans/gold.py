"""Queries over a video's results.

A customer stands for a video, its orders for frames, and a line item for what one
task of a model said of a frame.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenweave.operators import gold as D
from lumenweave.operators import tables as B
from lumenweave.plans import views as V
from lumenweave.plans.registry import query
from lumenweave.session import table

FRAMES = "frames AS (SELECT o_orderkey AS frame_id, o_custkey AS video_id, (o_orderkey * 7919 % 100000)::BIGINT AS ts_ms FROM orders)"
RAW = "raw AS (SELECT l_orderkey AS frame_id, l_linenumber * 100000000 + l_partkey * 1000 + l_quantity::BIGINT AS nth, l_returnflag AS task, CASE WHEN l_linenumber % 2 = 1 THEN p_name || '.' END AS caption, CASE WHEN l_tax > 0.05 THEN l_linestatus || l_linenumber END AS ocr_text, CASE WHEN l_linenumber < 4 THEN [p_type, upper(p_type), p_brand] END AS labels, l_quantity::BIGINT AS tokens FROM lineitem JOIN part ON p_partkey = l_partkey)"
CLEAN = r"nullif(trim(regexp_replace({}, '\s+', ' ', 'g')), '')"
CUT = "CASE WHEN length({0}) <= {1} THEN {0} ELSE rtrim(substr({0}, 1, {1} - 3)) || '...' END"
KNOWN = f"""{RAW}, lab AS (SELECT frame_id, nth, unnest(labels) AS o, generate_subscripts(labels, 1) AS i FROM raw), obj AS (SELECT frame_id, arg_min(o, nth * 10 + i) AS o, min(nth * 10 + i) AS i FROM lab GROUP BY frame_id, lower(o)),
ob AS (SELECT frame_id, list_slice(list(o ORDER BY i), 1, 50) AS objects FROM obj GROUP BY frame_id),
said_ AS (SELECT frame_id, {CLEAN.format("coalesce(string_agg(caption, ' ' ORDER BY nth), '')")} AS d, string_agg(ocr_text, ' ' ORDER BY nth) AS ocr_text, list_sort(list(DISTINCT task)) AS tasks, sum(tokens)::BIGINT AS tokens FROM raw GROUP BY frame_id),
known AS (SELECT frame_id, {CUT.format('d', 700)} AS description, ocr_text, coalesce(objects, []) AS objects, tasks, tokens FROM said_ LEFT JOIN ob USING (frame_id))"""


def frames(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("frame_id"), F.col("o_custkey").alias("video_id"), (F.col("o_orderkey") * 7919 % 100000).alias("ts_ms"))


def raw(spark, d):
    li, p = table(spark, d, "lineitem"), table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    n = F.col("l_linenumber")
    return li.join(p, F.col("p_partkey") == F.col("l_partkey")).select(
        F.col("l_orderkey").alias("frame_id"), (n * 100000000 + F.col("l_partkey") * 1000 + F.col("l_quantity").cast("long")).alias("nth"), F.col("l_returnflag").alias("task"), F.when(n % 2 == 1, F.concat("p_name", F.lit("."))).alias("caption"), F.when(F.col("l_tax") > 0.05, F.concat("l_linestatus", n)).alias("ocr_text"),
        F.when(n < 4, F.array("p_type", F.upper("p_type"), "p_brand")).alias("labels"), F.col("l_quantity").cast("long").alias("tokens"),
    )


def known(spark, d):
    return D.frame_understanding(raw(spark, d))


@query(f"WITH {KNOWN} SELECT * FROM known")
def frame_understanding(spark, d):
    return known(spark, d)


@query(f"WITH {FRAMES}, {KNOWN} SELECT frame_id, video_id, round(ts_ms / 1000.0, 3)::DOUBLE AS timestamp, description AS analysis, coalesce(tokens, 0) AS tokens FROM frames LEFT JOIN known USING (frame_id)")
def frames_data(spark, d):
    return D.frames_data(frames(spark, d), known(spark, d)).select("frame_id", "video_id", "timestamp", "analysis", "tokens")


TOPICS = "tp AS (SELECT video_id, arg_min(o, ts_ms * 1000000000 + frame_id * 10 + i) AS o, min(ts_ms * 1000000000 + frame_id * 10 + i) AS pos FROM (SELECT video_id, frame_id, ts_ms, unnest(list_slice(objects, 1, 5)) AS o, generate_subscripts(list_slice(objects, 1, 5), 1) AS i FROM frames JOIN known USING (frame_id)) GROUP BY video_id, lower(o)), topics AS (SELECT video_id, list_slice(list(o ORDER BY pos), 1, 15) AS topics FROM tp GROUP BY video_id)"


@query(f"WITH {FRAMES}, {KNOWN}, {TOPICS} SELECT * FROM topics")
def key_topics(spark, d):
    return D.key_topics(frames(spark, d), known(spark, d))


SEGMENTS = "segments AS (SELECT conv_id AS video_id, turn AS idx, turn * 10000 AS start_ms, turn * 10000 + 8000 AS end_ms, text FROM conversations)"
AUDIO = r"audio AS (SELECT coalesce(s.video_id, r.video_id) AS video_id, coalesce(n, 0) AS n_segments, len(list_filter(regexp_split_to_array(coalesce(whole, joined, ''), '\s+'), lambda w: w <> ''))::INT AS n_words, coalesce(whole, joined, '') AS text, language FROM (SELECT video_id, count(*) AS n, string_agg(text, ' ' ORDER BY idx) AS joined FROM segments GROUP BY video_id) s FULL JOIN (SELECT doc_id AS video_id, text AS whole, lang AS language FROM documents WHERE doc_id % 7 = 0) r ON r.video_id = s.video_id)"


def audio(spark, d):
    runs = table(spark, d, "documents").where("doc_id % 7 = 0").select(F.col("doc_id").alias("video_id"), "text", F.col("lang").alias("language"))
    return D.audio_data(V.segments(spark, d), runs)


@query(f"WITH {SEGMENTS}, {AUDIO} SELECT * FROM audio")
def audio_data(spark, d):
    return audio(spark, d)


SCENES = f"""cand AS (SELECT video_id, n, n * 20000 AS start_ms, n * 20000 + 20000 AS end_ms, coalesce(list(frame_id ORDER BY frame_id) FILTER (frame_id IS NOT NULL), []) AS frame_ids FROM (SELECT video_id, n FROM (SELECT DISTINCT video_id FROM frames), (SELECT unnest(range(5)) AS n))
  LEFT JOIN (SELECT video_id, ts_ms // 20000 AS n, frame_id FROM frames WHERE frame_id % 3 = 0) USING (video_id, n) GROUP BY video_id, n),
li AS (SELECT video_id, n, unnest(frame_ids) AS frame_id, generate_subscripts(frame_ids, 1) - 1 AS pos FROM cand), kn AS (SELECT li.*, description, objects FROM li LEFT JOIN known USING (frame_id)),
vis AS (SELECT video_id, n, arg_min(frame_id, pos) AS shown, {CLEAN.format("coalesce(string_agg(description, ' ' ORDER BY pos) FILTER (pos < 3), '')")} AS v, list(frame_id ORDER BY pos) AS evidence FROM kn GROUP BY ALL),
so AS (SELECT video_id, n, arg_min(o, pos * 100 + i) AS o, min(pos * 100 + i) AS i FROM (SELECT video_id, n, pos, unnest(objects) AS o, generate_subscripts(objects, 1) AS i FROM kn) GROUP BY video_id, n, lower(o)), sob AS (SELECT video_id, n, list_slice(list(o ORDER BY i), 1, 20) AS objects FROM so GROUP BY video_id, n),
heard AS (SELECT video_id, n, {CLEAN.format("string_agg(text, ' ' ORDER BY idx)")} AS h FROM cand JOIN segments s USING (video_id) WHERE s.start_ms < cand.end_ms AND s.end_ms > cand.start_ms GROUP BY video_id, n),
near AS (SELECT video_id, n, arg_min(frame_id, abs(ts_ms - (start_ms + end_ms) / 2.0) * 1e12 + ts_ms * 1e6 + frame_id) AS near FROM cand JOIN frames USING (video_id) WHERE len(frame_ids) = 0 GROUP BY video_id, n),
sc AS (SELECT c.video_id, c.n, start_ms / 1000.0::DOUBLE AS start, end_ms / 1000.0::DOUBLE AS "end", coalesce({CUT.format('v', 500)}, {CUT.format('h', 500)}) AS summary, coalesce(objects, []) AS objects, coalesce(shown, near) AS frame_id, coalesce(evidence, []) AS evidence
  FROM cand c LEFT JOIN vis USING (video_id, n) LEFT JOIN sob USING (video_id, n) LEFT JOIN heard USING (video_id, n) LEFT JOIN near USING (video_id, n))"""


def _scenes(spark, d):
    f = frames(spark, d)
    spans = f.select("video_id").distinct().withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(4))))
    held = f.where("frame_id % 3 = 0").groupBy("video_id", F.floor(F.col("ts_ms") / 20000).cast("int").alias("n")).agg(F.array_sort(F.collect_list("frame_id")).alias("frame_ids"))
    candidates = spans.join(held, ["video_id", "n"], "left").select("video_id", "n", (F.col("n") * 20000).alias("start_ms"), (F.col("n") * 20000 + 20000).alias("end_ms"), F.coalesce("frame_ids", F.array().cast("array<bigint>")).alias("frame_ids"))
    return D.scenes(candidates, f, known(spark, d), V.segments(spark, d))


@query(f"""WITH {FRAMES}, {KNOWN}, {SEGMENTS}, {SCENES} SELECT video_id, n, start, "end", coalesce(nullif(trim(split_part({CUT.format('summary', 100)}, '.', 1)), ''), 'Scene ' || (n + 1)) AS title, summary, objects, frame_id, evidence FROM sc""")
def gold_scenes(spark, d):
    return _scenes(spark, d)


@query(f"""WITH {FRAMES}, {KNOWN}, {SEGMENTS}, {SCENES}, {TOPICS}, {AUDIO}, f AS (SELECT video_id, count(*) AS frames_extracted, count(description) AS frames_analyzed, sum(coalesce(tokens, 0))::BIGINT AS tokens_total, max(ts_ms) / 1000.0::DOUBLE AS duration FROM frames LEFT JOIN known USING (frame_id) GROUP BY video_id),
s AS (SELECT video_id, count(*) AS total_scenes, {CLEAN.format("coalesce(string_agg(summary, ' ' ORDER BY n), '')")} AS s FROM sc GROUP BY video_id)
SELECT f.video_id, frames_extracted, frames_analyzed, tokens_total, duration, coalesce(total_scenes, 0) AS total_scenes, {CUT.format('s', 900)} AS summary, coalesce(n_segments > 0, FALSE) AS audio_processed, topics, CASE WHEN frames_analyzed > 0 THEN 'completed' ELSE 'completed_with_warnings' END AS status
FROM f LEFT JOIN s USING (video_id) LEFT JOIN audio USING (video_id) LEFT JOIN topics USING (video_id)""")
def gold_results(spark, d):
    f, k = frames(spark, d), known(spark, d)
    return D.results(f, k, _scenes(spark, d), audio(spark, d), D.key_topics(f, k))


INTENTS = f"""{FRAMES}, {KNOWN}, {SEGMENTS}, seen AS (SELECT DISTINCT video_id, frame_id, coalesce(nullif(trim(regexp_replace(trim(regexp_replace(lower(o), '\\s+', ' ', 'g')), '[^a-z0-9áéíóúüñ _.-]', '', 'g')), ''), 'unknown') AS name FROM (SELECT video_id, frame_id, unnest(objects) AS o FROM frames JOIN known USING (frame_id))),
v AS (SELECT DISTINCT video_id FROM frames), i AS (SELECT 'node' AS operation, 'Video' AS label, video_id::VARCHAR AS key, NULL AS from_key, NULL AS to_key FROM v
UNION ALL SELECT 'node', 'Scene', video_id || ':scene:' || lpad(n::VARCHAR, 6, '0'), NULL, NULL FROM v, (SELECT unnest(range(5)) AS n)
UNION ALL SELECT 'relationship', 'CONTAINS', video_id || '->CONTAINS->' || video_id || ':scene:' || lpad(n::VARCHAR, 6, '0'), video_id::VARCHAR, video_id || ':scene:' || lpad(n::VARCHAR, 6, '0') FROM v, (SELECT unnest(range(5)) AS n)
UNION ALL SELECT 'node', 'Frame', video_id || ':frame:' || frame_id, NULL, NULL FROM frames UNION ALL SELECT 'relationship', 'HAS_FRAME', video_id || '->HAS_FRAME->' || video_id || ':frame:' || frame_id, video_id::VARCHAR, video_id || ':frame:' || frame_id FROM frames
UNION ALL SELECT 'node', 'AudioSegment', video_id || ':segment:' || lpad(idx::VARCHAR, 6, '0'), NULL, NULL FROM segments UNION ALL SELECT 'relationship', 'HAS_TRANSCRIPT', video_id || '->HAS_TRANSCRIPT->' || video_id || ':segment:' || lpad(idx::VARCHAR, 6, '0'), video_id::VARCHAR, video_id || ':segment:' || lpad(idx::VARCHAR, 6, '0') FROM segments
UNION ALL SELECT DISTINCT 'node', 'Entity', video_id || ':entity:' || name, NULL, NULL FROM seen UNION ALL SELECT 'relationship', 'CONTAINS', video_id || ':frame:' || frame_id || '->CONTAINS->' || video_id || ':entity:' || name, video_id || ':frame:' || frame_id, video_id || ':entity:' || name FROM seen)"""


def _intents(spark, d):
    return D.graph_intents(_scenes(spark, d), frames(spark, d), V.segments(spark, d), known(spark, d))


@query(f"WITH {INTENTS} SELECT * FROM i")
def graph_intents(spark, d):
    return _intents(spark, d)


@query(f"WITH {INTENTS} SELECT operation, label, count(*) AS n, 'grouped' AS state FROM i GROUP BY operation, label UNION ALL SELECT 'relationship', 'no ends', 3, 'failed' UNION ALL SELECT 'node', 'no valid label', 2, 'failed'")
def intent_groups(spark, d):
    bad = spark.createDataFrame([("relationship", "CONTAINS", "a", None, "x")] * 3 + [("node", "1 bad", "b", None, None), ("node", None, "c", None, None)], "operation string, label string, key string, from_key string, to_key string")
    good, failed = D.intent_groups(_intents(spark, d).unionByName(bad))
    lost = failed.groupBy("reason").agg(F.count("*").alias("n")).select(F.when(F.col("reason") == "no ends", "relationship").otherwise("node").alias("operation"), F.col("reason").alias("label"), "n", F.lit("failed").alias("state"))
    return good.select("operation", "label", "n", F.lit("grouped").alias("state")).unionByName(lost)


@query("SELECT p_brand AS candidate, p_name AS summary, p_size AS at FROM part WHERE p_type <> 'PROMO' QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) = 1")
def latest_analysis(spark, d):
    done = table(spark, d, "part").where("p_type <> 'PROMO'")
    return B.latest(done, ["p_brand"], [F.desc("p_size"), F.col("p_partkey")]).select(F.col("p_brand").alias("candidate"), F.col("p_name").alias("summary"), F.col("p_size").alias("at"))
