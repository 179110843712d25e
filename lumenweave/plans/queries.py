"""Every query over the driver's tables, beside the SQL that says the same.

The views that stand for the engine's data model are in :mod:`lumenweave.plans.views`.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenweave.functions import scalar as S
from lumenweave.functions import text as X
from lumenweave.operators import evaluation as E
from lumenweave.operators import graph as G
from lumenweave.operators import search as R
from lumenweave.operators import tables as B
from lumenweave.operators import timeline as L
from lumenweave.operators.fulltext import FullTextIndex, tokens
from lumenweave.operators.vectors import VectorIndex
from lumenweave.plans import views as V
from lumenweave.plans.registry import query
from lumenweave.session import new_path, table, written

# text

COLLAPSE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
TRUNC = "CASE WHEN length({0}) = 0 THEN NULL WHEN length({0}) <= {1} THEN {0} ELSE rtrim(substr({0}, 1, {1} - 3)) || '...' END"
ROLE_TEXT = COLLAPSE.format("text")


@query(f"SELECT conv_id, turn, {TRUNC.format(ROLE_TEXT, 60)} AS short FROM conversations")
def text_truncate(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.truncate(F.col("text"), 60).alias("short"))


@query("SELECT conv_id, turn, CASE WHEN length(text) <= 50 THEN text ELSE substr(text, 1, 50) || ' […' || (length(text) - 50) || ' chars omitted]' END AS short FROM conversations")
def text_truncate_with_notice(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.truncate_with_notice(F.col("text"), 50).alias("short"))


@query(f"SELECT conv_id, turn, coalesce(nullif(trim(split_part({TRUNC.format(ROLE_TEXT, 100)}, '.', 1)), ''), 'Scene') AS title FROM conversations")
def text_first_sentence(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.first_sentence(F.col("text"), "Scene").alias("title"))


ENTITY_NAME = r"coalesce(nullif(trim(regexp_replace(trim(regexp_replace(lower({}), '\s+', ' ', 'g')), '[^a-z0-9áéíóúüñ _.-]', '', 'g')), ''), 'unknown')"


@query(f"SELECT p_partkey, {ENTITY_NAME.format('p_name')} AS name, replace(trim(lower(p_name)), ' ', '_') AS graph_name FROM part")
def entity_names(spark, d):
    return table(spark, d, "part").select("p_partkey", X.entity_name(F.col("p_name")).alias("name"), X.graph_name(F.col("p_name")).alias("graph_name"))


_types = ", ".join(f"('{a}', '{t}')" for t in X.ENTITY_TYPES for a in [t, *X.ENTITY_ALIASES.get(t, [])])
ALIASES = [a for xs in X.ENTITY_ALIASES.values() for a in xs]
_pick = ", ".join(f"'{a}'" for a in [*ALIASES, *X.ENTITY_TYPES, "unheard"])


@query(f"SELECT event_id, coalesce(t.type, 'concept') AS type FROM (SELECT event_id, upper(([{_pick}])[event_id % {len(ALIASES) + 9} + 1]) AS raw FROM events) LEFT JOIN (VALUES {_types}) t(alias, type) ON lower(trim(raw)) = alias")
def entity_types(spark, d):
    names = F.array(*map(F.lit, [*ALIASES, *X.ENTITY_TYPES, "unheard"]))
    return table(spark, d, "events").select("event_id", X.entity_type(F.upper(F.get(names, (F.col("event_id") % (len(ALIASES) + 9)).cast("int")))).alias("type"))


@query("""SELECT c_custkey, (['RELATES_TO', 'CONTAINS', 'INTERACTS_WITH', 'CAUSES', 'RELATES_TO', 'RELATES_TO', 'CONTAINS', 'SIMILAR_TO', 'INTERACTS_WITH', 'RELATES_TO'])[c_custkey % 10 + 1] AS rel FROM customer""")
def relation_types(spark, d):
    said = ["near", " part_of ", "Holds", "causes", "other", "part of", "has", "Similar_To", "WEARS", "part-of"]
    return table(spark, d, "customer").select("c_custkey", X.relation_type(F.get(F.array(*map(F.lit, said)), (F.col("c_custkey") % 10).cast("int"))).alias("rel"))


@query(r"""WITH t AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM conversations)
SELECT c.conv_id, c.turn, coalesce(terms, '') AS terms FROM conversations c LEFT JOIN (SELECT conv_id, turn, string_agg(w, ' ' ORDER BY w) AS terms FROM t WHERE regexp_matches(w, '^[a-z0-9]{3,}$')
AND w NOT IN ('the', 'and', 'for', 'with', 'this', 'that', 'what', 'when', 'where', 'which', 'who', 'how', 'about', 'video', 'scene', 'please') GROUP BY ALL) USING (conv_id, turn)""")
def query_terms(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(X.query_terms(F.col("text"))), " ").alias("terms"))


@query(r"""SELECT page_id, regexp_replace(nullif(substr(trim(url), 1, 1000), ''), '([+\-&|!(){}\[\]^"~*?:\\/])', '\\\1', 'g') AS q FROM pages""")
def escape_fulltext(spark, d):
    return table(spark, d, "pages").select("page_id", X.escape_fulltext(F.col("url")).alias("q"))


@query(r"SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), ''), 'unknown') AS segment FROM pages")
def safe_segments(spark, d):
    return table(spark, d, "pages").select("page_id", X.safe_segment(F.col("url")).alias("segment"))


@query("SELECT doc_id, 'lang: ' || lang || ' | source: ' || source AS label FROM documents")
def labelled_parts(spark, d):
    return table(spark, d, "documents").select("doc_id", X.labelled([("lang", F.col("lang")), ("empty", F.lit("")), ("source", F.col("source"))]).alias("label"))


@query("SELECT doc_id, (CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'und') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'que') THEN 1 ELSE 0 END)::INT AS n FROM documents")
def term_overlap(spark, d):
    return table(spark, d, "documents").select("doc_id", X.overlap(F.col("text"), F.array(*map(F.lit, ["the", "und", "que"]))).alias("n"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'copyright')")
def any_keyword(spark, d):
    return table(spark, d, "documents").where(X.any_keyword(F.col("text"), X.keywords(F.lit("  License of copyright ")))).select("doc_id")


@query("SELECT p_partkey, [p_brand, p_type] AS names FROM part")
def distinct_ci(spark, d):
    return table(spark, d, "part").select("p_partkey", X.unique_ci(F.array("p_brand", F.upper("p_brand"), F.lit(" "), "p_type", F.lower("p_type")), 5).alias("names"))


# time, numbers, ladders

CLOCK_SQL = "CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') ELSE (s // 60) || ':' || lpad((s % 60)::VARCHAR, 2, '0') END"


@query(f"SELECT frame_id, {CLOCK_SQL} AS at, s::DOUBLE AS back FROM (SELECT frame_id, ts_ms // 1000 AS s FROM frames)", "frames")
def clock_times(spark, d):
    f = V.frames(spark, d).withColumn("at", S.clock(F.floor(F.col("ts_ms") / 1000)))
    return f.select("frame_id", "at", S.seconds_of(F.col("at")).alias("back"))


@query("SELECT o_orderkey, CASE WHEN d >= 180 THEN 'Archive' WHEN d >= 90 THEN 'Cold' WHEN d >= 30 THEN 'Cool' ELSE 'Hot' END AS tier FROM (SELECT o_orderkey, datediff('day', o_orderdate::DATE, DATE '1998-08-02') AS d FROM orders)")
def storage_tiers(spark, d):
    days = F.datediff(F.lit("1998-08-02").cast("date"), F.to_date("o_orderdate"))
    return table(spark, d, "orders").select("o_orderkey", S.tier(days).alias("tier"))


@query("""WITH t AS (SELECT o_totalprice AS gb, CASE WHEN d >= 180 THEN 'Archive' WHEN d >= 90 THEN 'Cold' WHEN d >= 30 THEN 'Cool' ELSE 'Hot' END AS tier FROM (SELECT *, datediff('day', o_orderdate::DATE, DATE '1998-08-02') AS d FROM orders))
SELECT tier, count(*) AS n, round(sum(gb), 2) AS gb, round(sum(gb) * CASE tier WHEN 'Archive' THEN 0.00099 WHEN 'Cold' THEN 0.0036 WHEN 'Cool' THEN 0.0115 ELSE 0.0208 END::DOUBLE, 2) AS cost FROM t GROUP BY tier""")
def storage_costs(spark, d):
    days = F.datediff(F.lit("1998-08-02").cast("date"), F.to_date("o_orderdate"))
    g = table(spark, d, "orders").select(S.tier(days).alias("tier"), "o_totalprice").groupBy("tier").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))
    return g.select("tier", "n", F.round("s", 2).alias("gb"), F.round(F.col("s") * S.tier_price(F.col("tier")), 2).alias("cost"))


@query("SELECT frame_id, round(CASE WHEN score IS NULL THEN 0.5 ELSE exp(-0.5 * power((score - 50) / 25, 2)) END, 6) AS temporal FROM frames", "frames")
def gaussian_proximity(spark, d):
    return V.frames(spark, d).select("frame_id", F.round(S.gaussian(F.col("score"), 25, 75), 6).alias("temporal"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0 THEN round(coalesce(CASE WHEN l_linenumber <> 3 THEN l_discount END, 0) / l_tax, 3) END AS rate FROM lineitem")
def rate_metric(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.rate(F.when(F.col("l_linenumber") != 3, F.col("l_discount")), F.col("l_tax")).alias("rate"))


@query("SELECT p_partkey, round(CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size::DOUBLE / (p_partkey % 7) END, 8) AS fps FROM part")
def frame_rates(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(S.frame_rate(F.concat_ws("/", "p_size", F.col("p_partkey") % 7)), 8).alias("fps"))


# timelines


@query("SELECT video_id, frame_id AS src, lead(frame_id) OVER (PARTITION BY video_id ORDER BY ts_ms, frame_id) AS dst, 'NEXT_FRAME' AS rel_type FROM frames QUALIFY dst IS NOT NULL", "frames")
def next_frame_chain(spark, d):
    f = V.frames(spark, d)
    return L.chain(f, "video_id", ["ts_ms", "frame_id"], "frame_id", "NEXT_FRAME").join(f.select("video_id", F.col("frame_id").alias("src")), "src").select("video_id", "src", "dst", "rel_type")


@query("""SELECT * FROM (WITH r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY ts_ms, frame_id) AS n FROM frames) SELECT a.frame_id AS anchor, b.frame_id, abs(b.n - a.n) AS hop, CASE WHEN b.n > a.n THEN 'forward' ELSE 'backward' END AS direction
FROM r a JOIN r b ON a.video_id = b.video_id AND abs(b.n - a.n) BETWEEN 1 AND 5 WHERE a.frame_id % 20 = 0)""", "frames")
def walk_chain(spark, d):
    f = V.frames(spark, d)
    anchors = f.where("frame_id % 20 = 0")
    ahead = L.walk(f, "video_id", ["ts_ms", "frame_id"], anchors, "frame_id", 5).withColumn("direction", F.lit("forward"))
    back = L.walk(f.withColumns({"_t": -F.col("ts_ms"), "_f": -F.col("frame_id")}), "video_id", ["_t", "_f"], anchors, "frame_id", 5).withColumn("direction", F.lit("backward"))
    return ahead.select("anchor", "frame_id", "hop", "direction").unionByName(back.select("anchor", "frame_id", "hop", "direction")).withColumn("hop", F.col("hop").cast("long"))


@query("""SELECT video_id, session, count(*) AS n, min(ts_ms) AS lo, max(ts_ms) AS hi, round(avg(score), 6) AS score FROM (
  SELECT *, sum(f) OVER (PARTITION BY video_id ORDER BY ts_ms, frame_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM (
    SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY video_id ORDER BY ts_ms, frame_id) <= 3600000 THEN 0 ELSE 1 END AS f FROM frames)) GROUP BY video_id, session""", "frames")
def gap_sessions(spark, d):
    s = L.sessions(V.frames(spark, d), "video_id", "ts_ms", 3_600_000, ["frame_id"])
    return s.groupBy("video_id", "session").agg(F.count("*").alias("n"), F.min("ts_ms").alias("lo"), F.max("ts_ms").alias("hi"), F.round(F.avg("score"), 6).alias("score"))


WINDOWS_SQL = "w AS (SELECT video_id, n, n * 20000 AS start_ms, least(duration, n * 20000 + 25000) AS end_ms FROM (SELECT video_id, duration, unnest(range(0, greatest(ceil((duration - 25000) / 20000.0)::BIGINT, 0) + 1)) AS n FROM (SELECT video_id, max(end_ms) AS duration FROM segments GROUP BY video_id)))"


def _windows(spark, d):
    s = V.segments(spark, d)
    return s, L.sliding(s.groupBy("video_id").agg(F.max("end_ms").alias("duration")), "video_id", "duration", 25_000, 5_000)


@query(f"SELECT * FROM (WITH {WINDOWS_SQL} SELECT video_id, n, start_ms, end_ms FROM w)", "segments")
def sliding_windows(spark, d):
    return _windows(spark, d)[1]


@query(f"SELECT * FROM (WITH {WINDOWS_SQL} SELECT w.video_id, w.n, list(s.idx ORDER BY s.idx) AS members FROM w JOIN segments s ON s.video_id = w.video_id AND s.start_ms < w.end_ms AND s.end_ms > w.start_ms GROUP BY w.video_id, w.n)", "segments")
def window_overlap_join(spark, d):
    s, w = _windows(spark, d)
    return L.overlapping(w, s, ["video_id"]).groupBy("video_id", "n").agg(F.array_sort(F.collect_list("r_idx")).alias("members"))


@query(f"SELECT * FROM (WITH {WINDOWS_SQL} SELECT w.video_id, w.n, count(*) AS n_inside FROM w JOIN segments s ON s.video_id = w.video_id AND s.start_ms >= w.start_ms AND s.end_ms <= w.end_ms GROUP BY w.video_id, w.n)", "segments")
def window_containment_join(spark, d):
    s, w = _windows(spark, d)
    return L.containing(w, s, ["video_id"]).groupBy("video_id", "n").agg(F.count("*").alias("n_inside"))


@query("SELECT f.video_id, s, count(*) AS n FROM (SELECT video_id, ts_ms // 3600000 AS s FROM frames) f GROUP BY f.video_id, s", "frames")
def points_in_windows(spark, d):
    f = V.frames(spark, d)
    hours = L.sliding(f.groupBy("video_id").agg((F.max("ts_ms") + 3_600_000).alias("duration")), "video_id", "duration", 3_600_000, 0)
    return L.points_in(hours, f.select("video_id", "frame_id", "ts_ms"), ["video_id"], width=3_600_000).groupBy("video_id", F.col("n").alias("s")).agg(F.count("*").alias("n"))


@query("""SELECT t.video_id, t_ms, f.frame_id AS near_id, f.ts_ms AS near_at FROM (SELECT video_id, unnest([1000000, 50000000, 900000000]) AS t_ms FROM (SELECT DISTINCT video_id FROM frames)) t JOIN frames f USING (video_id)
QUALIFY row_number() OVER (PARTITION BY t.video_id, t_ms ORDER BY abs(f.ts_ms - t_ms), f.ts_ms, f.frame_id) = 1""", "frames")
def nearest_frame(spark, d):
    f = V.frames(spark, d)
    t = f.select("video_id").distinct().select("video_id", F.explode(F.array(*[F.lit(x).cast("long") for x in (1_000_000, 50_000_000, 900_000_000)])).alias("t_ms"))
    return L.nearest(t, f, "video_id", "ts_ms", "frame_id")


@query("""SELECT frame_id, round(CASE WHEN p IS NULL THEN 0 ELSE (p + s) / 2 END, 4) AS lo, round(CASE WHEN n IS NULL THEN greatest(m, s + 1) ELSE (s + n) / 2 END, 4) AS hi FROM (
SELECT frame_id, ts_ms / 1000.0::DOUBLE AS s, lag(ts_ms / 1000.0::DOUBLE) OVER w AS p, lead(ts_ms / 1000.0::DOUBLE) OVER w AS n, (max(ts_ms) OVER (PARTITION BY video_id)) / 1000.0::DOUBLE AS m FROM frames WINDOW w AS (PARTITION BY video_id ORDER BY ts_ms, frame_id))""", "frames")
def midpoint_scenes(spark, d):
    f = V.frames(spark, d).withColumn("s", F.col("ts_ms") / 1000).withColumn("m", F.max("s").over(Window.partitionBy("video_id")))
    return L.midpoints(f, "video_id", "s", ["frame_id"], F.col("m"), 4).select("frame_id", "lo", "hi")


@query("""SELECT * FROM (WITH RECURSIVE k AS (SELECT video_id, min(ts_ms) AS ts_ms FROM frames GROUP BY video_id UNION ALL
SELECT k.video_id, (SELECT min(f.ts_ms) FROM frames f WHERE f.video_id = k.video_id AND f.ts_ms >= k.ts_ms + 86400000) AS ts_ms FROM k WHERE k.ts_ms IS NOT NULL) SELECT video_id, ts_ms FROM k WHERE ts_ms IS NOT NULL)""", "frames")
def thinned_frames(spark, d):
    return L.thin(V.frames(spark, d), "video_id", "ts_ms", 86_400_000)


@query("""SELECT frame_id, round(least(1, least(1, s + coalesce(CASE WHEN g <= 3600000 THEN (1 - g / 3600000.0) * 0.15 * pb END, 0)) + coalesce(CASE WHEN h <= 3600000 THEN (1 - h / 3600000.0) * 0.15 * nb END, 0)), 6) AS boosted FROM (
SELECT frame_id, least(score / 100, 1) AS s, ts_ms - lag(ts_ms) OVER w AS g, lead(ts_ms) OVER w - ts_ms AS h, lag(score / 200) OVER w AS pb, lead(score / 200) OVER w AS nb FROM frames WINDOW w AS (PARTITION BY video_id ORDER BY ts_ms, frame_id))""", "frames")
def adjacency_boost(spark, d):
    f = V.frames(spark, d).withColumns({"s": F.least(F.col("score") / 100, F.lit(1.0)), "v": F.col("score") / 200})
    return L.adjacency_boost(f, "video_id", "ts_ms", "s", "v", ["frame_id"], 3_600_000).select("frame_id", F.round("boosted", 6).alias("boosted"))


@query("""SELECT chunk, video_id, count(*) AS n, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(text, ' ' ORDER BY idx) AS summary FROM (
SELECT *, (row_number() OVER (PARTITION BY video_id ORDER BY idx) - 1) // 5 AS chunk FROM segments) GROUP BY video_id, chunk""", "segments")
def chapters_of_five(spark, d):
    c = L.chunks(V.segments(spark, d), "video_id", ["idx"], 5)
    return c.groupBy("video_id", "chunk").agg(F.count("*").alias("n"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda s: s["text"]), " ").alias("summary"))


@query("""SELECT video_id, frame_id FROM (SELECT video_id, frame_id, row_number() OVER (PARTITION BY video_id ORDER BY ts_ms, frame_id) - 1 AS i, ceil(count(*) OVER (PARTITION BY video_id) / 10.0) AS step FROM frames) WHERE i % step = 0""", "frames")
def every_nth_frame(spark, d):
    return L.every_nth(V.frames(spark, d), "video_id", ["ts_ms", "frame_id"], 10).select("video_id", "frame_id")


@query("""SELECT s.video_id, s.idx, s.start_ms - p AS pause FROM (SELECT *, lag(end_ms) OVER (PARTITION BY video_id ORDER BY start_ms) AS p FROM segments) s WHERE s.start_ms - p >= 2000""", "segments")
def transcript_pauses(spark, d):
    return L.pauses(V.segments(spark, d), "video_id", 2000).select("video_id", "idx", "pause")


POINTS_SQL = """dur AS (SELECT video_id, max(ts_ms) + 1000 AS duration FROM frames GROUP BY video_id),
raw AS (SELECT video_id, 0::BIGINT AS point, 'start' AS reason FROM dur UNION ALL SELECT video_id, duration, 'end' FROM dur
  UNION ALL SELECT video_id, ts_ms, 'frame_anchor' FROM frames JOIN dur USING (video_id) WHERE ts_ms > 0 AND ts_ms < duration
  UNION ALL SELECT video_id, unnest(range(200000000, duration, 200000000)), 'max_scene_duration' FROM dur),
points AS (SELECT video_id, point, list_sort(list(DISTINCT reason)) AS reasons FROM raw GROUP BY ALL)"""


def _points(spark, d, points=L.boundary_points):
    f = V.frames(spark, d)
    durations = f.groupBy("video_id").agg((F.max("ts_ms") + 1000).alias("duration"))
    none = V.segments(spark, d).where("idx < 0").select("video_id", "start_ms", "end_ms")
    return points(durations, f, none, "video_id", 2500, 200_000_000)


@query(f"SELECT * FROM (WITH {POINTS_SQL} SELECT video_id, point, array_to_string(reasons, ',') AS reasons FROM points)", "frames")
def scene_boundary_points(spark, d):
    return _points(spark, d).select("video_id", "point", F.array_join("reasons", ",").alias("reasons"))


@query(f"""SELECT * FROM (WITH RECURSIVE {POINTS_SQL},
p AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY point) AS i, max(point) OVER (PARTITION BY video_id) AS stop FROM points),
s AS (SELECT video_id, i, point AS at, NULL::BIGINT AS a, NULL::BIGINT AS b FROM p WHERE i = 1
  UNION ALL SELECT p.video_id, p.i, CASE WHEN p.point - s.at < 20000000 AND p.point <> p.stop THEN s.at ELSE p.point END, CASE WHEN p.point - s.at < 20000000 AND p.point <> p.stop THEN NULL ELSE s.at END, CASE WHEN p.point - s.at < 20000000 AND p.point <> p.stop THEN NULL ELSE p.point END FROM s JOIN p ON p.video_id = s.video_id AND p.i = s.i + 1)
SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY a) - 1 AS n, a AS start_ms, b AS end_ms FROM s WHERE a IS NOT NULL)""", "frames")
def scene_candidates(spark, d):
    return L.scenes(_points(spark, d, L.candidate_points), "video_id", 20_000_000).select("video_id", F.col("n").cast("long").alias("n"), "start_ms", "end_ms")


@query("""SELECT c.video_id, c.idx FROM (SELECT *, idx // 2 AS chunk FROM segments) c JOIN (SELECT video_id, chunk, max(e) OVER (PARTITION BY video_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM (SELECT video_id, idx // 2 AS chunk, max(end_ms + 4000) AS e FROM segments GROUP BY ALL)) u USING (video_id, chunk) WHERE until IS NULL OR start_ms >= until""", "segments")
def late_segments_dropped(spark, d):
    s = V.segments(spark, d).withColumns({"chunk": F.floor(F.col("idx") / 2), "end_ms": F.col("end_ms") + 4000})
    return L.after_last(s, "video_id", "chunk").select("video_id", "idx")


@query("""SELECT * FROM (WITH f AS (SELECT video_id, ts_ms // 1000 + 0.0::DOUBLE AS t FROM frames), dur AS (SELECT video_id, max(t) + 5 AS duration FROM f GROUP BY video_id),
g AS (SELECT video_id, lead(t) OVER (PARTITION BY video_id ORDER BY t) - t AS gap FROM f UNION ALL SELECT video_id, min(t) FROM f GROUP BY video_id HAVING min(t) > 1 UNION ALL SELECT f.video_id, any_value(duration) - max(t) FROM f JOIN dur USING (video_id) GROUP BY f.video_id HAVING any_value(duration) - max(t) > 1),
a AS (SELECT video_id, max(gap) AS m, avg(gap) AS v, count(*) FILTER (gap > CASE WHEN duration < 300 THEN 10 WHEN duration < 1800 THEN 20 WHEN duration < 3600 THEN 30 ELSE 45 END) AS p, any_value(CASE WHEN duration < 300 THEN 10 WHEN duration < 1800 THEN 20 WHEN duration < 3600 THEN 30 ELSE 45 END) AS lim, any_value(duration) AS duration FROM g JOIN dur USING (video_id) WHERE gap IS NOT NULL GROUP BY video_id),
n AS (SELECT video_id, count(*) AS n FROM f GROUP BY video_id)
SELECT video_id, n, round(m, 2) AS max_gap, round(v, 2) AS avg_gap, p AS problems, round(n / (duration / 60), 2)::DOUBLE AS density, round(score, 1)::DOUBLE AS score,
coalesce(nullif(list_filter([CASE WHEN score < 50 THEN 'Consider using DEEP_ANALYSIS or ADAPTIVE preset for better coverage' END, CASE WHEN m > lim * 2 THEN format('Large gap detected ({:.1f}s) - use HYBRID extraction to fill gaps', m) END,
CASE WHEN n / (duration / 60) < 5 THEN 'Low frame density - increase max_frames or reduce interval' END, CASE WHEN p > 5 THEN format('{} gaps over {:.1f}s - content may be missed', p, lim::DOUBLE) END], lambda x: x IS NOT NULL), []), ['Good coverage achieved']) AS advice
FROM (SELECT *, greatest(least(10 * n / (duration / 60), 100) - least(10.0 * p, 50) - CASE WHEN m > lim THEN least(20 * (m / lim - 1), 30) ELSE 0 END, 0) AS score FROM a JOIN n USING (video_id)))""", "frames")
def coverage_metrics(spark, d):
    f = V.frames(spark, d).select("video_id", F.floor(F.col("ts_ms") / 1000).cast("double").alias("t"))
    return L.coverage(f, "video_id", "t", f.groupBy("video_id").agg((F.max("t") + 5).alias("duration")))


# graph


@query("SELECT a.entity_id AS a, b.entity_id AS b, count(*) AS weight, list_slice(list(a.frame_id ORDER BY a.frame_id), 1, 5) AS frames FROM contains_ a JOIN contains_ b ON a.frame_id = b.frame_id AND a.entity_id < b.entity_id GROUP BY ALL", "contains_")
def entity_cooccurrence(spark, d):
    return G.cooccurrence(V.contains(spark, d))


@query("SELECT p_brand, p_type, (SELECT list_slice(list(n ORDER BY s, n), 1, 5) FROM (SELECT q.p_name AS n, min(q.p_size) AS s FROM part q WHERE q.p_brand = p.p_brand AND q.p_type = p.p_type GROUP BY q.p_name)) AS descriptions, count(*) AS occurrences, min(p_size) AS first_seen, max(p_size) AS last_seen, max(p_retailprice) AS confidence, arg_max(p_name, struct_pack(l := length(p_name), n := p_name)) AS description FROM part p GROUP BY p_brand, p_type")
def entity_accumulate(spark, d):
    return G.accumulate(table(spark, d, "part"), ["p_brand", "p_type"], "p_size", "p_name", "p_retailprice")


@query("SELECT kind AS name, 'event' AS type, list_sort(list(video_id)) AS videos, count(*) AS n_videos, sum(n)::BIGINT AS appearances FROM (SELECT kind, video_id, count(DISTINCT frame_id) AS n FROM frames GROUP BY ALL) GROUP BY kind HAVING count(*) >= 2", "frames")
def common_entities(spark, d):
    return G.common_entities(V.frames(spark, d).withColumn("type", F.lit("event")), "kind", "type", "video_id", "frame_id")


@query("""SELECT a, b, max(s) AS similarity FROM (SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b, CASE WHEN x.name = y.name THEN 1.0 ELSE 0.7 END::DOUBLE AS s
FROM e x JOIN e y ON x.kind = y.kind AND x.video <> y.video AND (x.name = y.name OR (length(x.name) > 3 AND length(y.name) > 3 AND contains(y.name, x.name)))) GROUP BY a, b""".replace("FROM e x JOIN e y", "FROM (SELECT p_partkey AS id, lower(p_name) AS name, p_brand AS kind, p_size AS video FROM part) x JOIN (SELECT p_partkey AS id, lower(p_name) AS name, p_brand AS kind, p_size AS video FROM part) y"))
def cross_video_entities(spark, d):
    return G.same_entities(table(spark, d, "part").withColumn("name", F.lower("p_name")), "p_partkey", "name", "p_brand", "p_size")


@query("""WITH e AS (SELECT p_partkey AS id, lower(p_name) AS name, p_type AS kind, p_size AS video, nullif(p_brand, 'Brand#11') AS usr FROM part)
SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b, max(CASE WHEN x.name = y.name THEN 1.0 ELSE 0.7 END)::DOUBLE AS similarity FROM e x JOIN e y ON x.kind = y.kind AND x.usr = y.usr AND x.video <> y.video AND x.id <> y.id
WHERE x.name = y.name OR (length(x.name) > 3 AND length(y.name) > 3 AND contains(y.name, x.name)) GROUP BY ALL""")
def same_user_entities(spark, d):
    """The same within one user's videos; a brand stands for a user, and one of them for none."""
    p = table(spark, d, "part").withColumns({"name": F.lower("p_name"), "user": F.nullif("p_brand", F.lit("Brand#11"))})
    return G.same_entities(p, "p_partkey", "name", "p_type", "p_size", user="user")


EDGES_SQL = "edges AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 'CONTAINS' AS rel_type FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'CONTAINS' FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 'CONTAINS' FROM orders)"


def _tree(spark, d):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    parts = [("nation", "r", "n_regionkey", "n", "n_nationkey"), ("customer", "n", "c_nationkey", "c", "c_custkey"), ("orders", "c", "o_custkey", "o", "o_orderkey")]
    edges = [table(spark, d, t).select(name(p, a).alias("src"), name(q, b).alias("dst"), F.lit("CONTAINS").alias("rel_type")) for t, p, a, q, b in parts]
    return edges[0].union(edges[1]).union(edges[2])


BOTH_SQL = "both_ AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)"
HOPS_SQL = f"""{EDGES_SQL}, {BOTH_SQL}, h1 AS (SELECT DISTINCT src AS start, dst AS node FROM both_ WHERE src LIKE 'r%' OR substr(src, 2)::BIGINT % 20 = 0), h2 AS (SELECT DISTINCT start, dst AS node FROM h1 JOIN both_ ON node = src),
reached AS (SELECT start, node, min(distance) AS distance FROM (SELECT start, node, 1 AS distance FROM h1 UNION ALL SELECT start, node, 2 FROM h2 WHERE node <> start) GROUP BY start, node)"""


def _starts(edges):
    """Every node of the tree whose number is divisible by 20, and the regions, of which there are few."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("start")).distinct()
    return nodes.where("start LIKE 'r%' OR cast(substring(start, 2) AS long) % 20 = 0")


@query(f"WITH {HOPS_SQL} SELECT start, node, distance FROM reached")
def neighbourhood(spark, d):
    e = _tree(spark, d)
    return G.neighbours(_starts(e), e, 2)


@query(f"WITH {HOPS_SQL}, r AS (SELECT *, count(*) OVER (PARTITION BY start) AS total_related, row_number() OVER (PARTITION BY start ORDER BY distance, node) AS n FROM reached) SELECT start, node, distance, total_related FROM r WHERE n <= 30 QUALIFY row_number() OVER (PARTITION BY start, distance ORDER BY node) <= 5")
def expand_context(spark, d):
    e = _tree(spark, d)
    return G.context(_starts(e), e, 2)


@query(f"""WITH {EDGES_SQL}, s AS (SELECT DISTINCT n AS start FROM (SELECT src AS n FROM edges UNION SELECT dst FROM edges) WHERE n LIKE 'r%' OR substr(n, 2)::BIGINT % 20 = 0)
SELECT start, dst AS node, rel_type, 'outgoing' AS direction FROM s JOIN edges ON src = start UNION ALL SELECT start, src, rel_type, 'incoming' FROM s JOIN edges ON dst = start""")
def related_one_hop(spark, d):
    e = _tree(spark, d)
    return G.one_hop(_starts(e), e)


@query("SELECT 'o' || o_orderkey AS node, ['r' || n_regionkey, 'n' || n_nationkey, 'c' || c_custkey, 'o' || o_orderkey] AS path FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def hierarchy_paths(spark, d):
    e = _tree(spark, d)
    return G.path_up(e.where("dst LIKE 'o%'").select(F.col("dst").alias("node")), e.select(F.col("dst").alias("child"), F.col("src").alias("parent")))


@query("SELECT r_name, count(DISTINCT n_nationkey) AS nations, count(DISTINCT c_custkey) AS customers, count(DISTINCT o_orderkey) AS orders FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY r_name")
def hierarchy_stats(spark, d):
    r, n, c, o = (table(spark, d, t) for t in ("region", "nation", "customer", "orders"))
    per = o.groupBy("o_custkey").agg(F.count("*").alias("n_o"))  # each level summed before it is joined
    j = r.join(n, F.col("n_regionkey") == F.col("r_regionkey"), "left").join(c.join(per, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_nationkey").agg(F.count("*").alias("n_c"), F.sum("n_o").alias("n_o")), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return j.groupBy("r_name").agg(F.count("n_nationkey").alias("nations"), F.coalesce(F.sum("n_c"), F.lit(0)).alias("customers"), F.coalesce(F.sum("n_o"), F.lit(0)).alias("orders"))


@query("SELECT s_nationkey AS video_id, label, node FROM (SELECT s_nationkey, 'Entity' AS label, s_suppkey AS node FROM supplier UNION ALL SELECT c_nationkey, 'Frame', c_custkey FROM customer) t QUALIFY row_number() OVER (PARTITION BY s_nationkey, label ORDER BY node) <= CASE label WHEN 'Frame' THEN 29 ELSE 9 END")
def quota_subgraph(spark, d):
    nodes = table(spark, d, "supplier").select(F.col("s_nationkey").alias("video_id"), F.lit("Entity").alias("label"), F.col("s_suppkey").alias("node")).union(table(spark, d, "customer").select("c_nationkey", F.lit("Frame"), "c_custkey"))
    return G.quota_sample(nodes, "video_id", "label", "node", {"Frame": 0.30, "Entity": 0.10}, 100).select("video_id", "label", "node")


@query("""WITH RECURSIVE e AS (SELECT s_suppkey AS a, s_suppkey % 10 + 100000 AS b FROM supplier UNION SELECT s_suppkey % 10 + 100000, s_suppkey FROM supplier),
r AS (SELECT DISTINCT a AS node, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON r.node = e.a) SELECT node, min(c) AS component FROM r GROUP BY node""")
def connected_components(spark, d):
    s = table(spark, d, "supplier")
    return G.connected(s.select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") % 10 + 100000).alias("b")))


@query("WITH a AS (SELECT DISTINCT user_id, event_type FROM events) SELECT event_type, count(*) AS users, count(*) FILTER (user_id IN (SELECT user_id FROM a GROUP BY user_id HAVING count(*) = 1)) AS only_here FROM a GROUP BY event_type")
def shared_and_unique(spark, d):
    a = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("k"))
    return a.select(F.explode("k").alias("event_type"), F.size("k").alias("n")).groupBy("event_type").agg(F.count("*").alias("users"), F.sum((F.col("n") == 1).cast("long")).alias("only_here"))


# search

DOT = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: {0}[i]::DOUBLE * {1}[i]::DOUBLE))"
COS = f"({DOT.format('{0}', '{1}')} / (sqrt({DOT.format('{0}', '{0}')}) * sqrt({DOT.format('{1}', '{1}')})))"
COS_VQ = COS.format("v", "q")


@query(
    f"""SELECT * FROM (WITH p AS (SELECT a.node_id AS query, b.node_id AS node, round({COS.format('a.v', 'b.v')}, 9) AS score FROM vectors a, vectors b WHERE a.node_id % 20 = 0)
SELECT query, node, round(score, 6) AS score FROM p WHERE score >= 0.2 QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, node) <= 10)""",
    "vectors",
)
def vector_search(spark, d):
    """The ten nearest of every twentieth vector, by the index and exact."""
    n = V.vectors(spark, d)
    return VectorIndex.build(n).search(n.where("node_id % 20 = 0"), 10, 0.2).select("query", "node", F.round("score", 6).alias("score"))


@query()
def vector_search_probed(spark, d):
    """The same from the cells nearest to each query alone, as many as a sample of queries needs for 19 of 20 results."""
    n = V.vectors(spark, d)
    index, some = VectorIndex.build(n), n.where("node_id % 20 = 0")
    return index.search(some, 10, 0.2, probes=index.tuned(some, 10, 0.2), exact=False)


@query(
    f"""SELECT * FROM (WITH p AS (SELECT a.node_id AS query, b.node_id AS node, round({COS.format('a.v', 'b.v')}, 9) AS score FROM vectors a JOIN vectors b ON a.video_id <> b.video_id WHERE a.node_id % 20 = 0)
SELECT query, node, round(score, 6) AS score FROM p WHERE score >= 0.1 QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, node) <= 5)""",
    "vectors",
)
def similar_across_videos(spark, d):
    n = V.vectors(spark, d)
    return VectorIndex.build(n, group="video_id").search(n.where("node_id % 20 = 0"), 5, 0.1, group="video_id").select("query", "node", F.round("score", 6).alias("score"))


@query(f"SELECT * FROM (WITH s AS (SELECT a.node_id AS query, b.video_id AS parent, b.node_id AS node, {COS.format('b.v', 'a.v')} AS score FROM vectors a, vectors b WHERE a.node_id % 20 = 0) SELECT query, parent, node, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query, parent ORDER BY score DESC, node) <= 3)", "vectors")
def search_children(spark, d):
    """Of every twentieth vector, the three nearest in each video."""
    n = V.vectors(spark, d)
    found = R.nearest_each(n.where("node_id % 20 = 0"), n, 3, "video_id")
    return found.select("query", "parent", "node", F.round("score", 6).alias("score"))


@query("""SELECT * FROM (WITH e AS (SELECT video_id, node_id % 3 + 1 AS w, unnest(range(1, 65)) AS i, unnest(v)::DOUBLE AS x FROM vectors), m AS (SELECT video_id, i, sum(w * x) / sum(w) AS x FROM e GROUP BY ALL)
SELECT video_id, i - 1 AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY video_id)), 6) AS x FROM m)""", "vectors")
def pooled_embeddings(spark, d):
    n = V.vectors(spark, d).withColumn("w", F.col("node_id") % 3 + 1)
    return R.pool(n, "video_id", "v", "w").select("video_id", F.posexplode("pooled").alias("pos", "x")).select("video_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query("""SELECT * FROM (WITH e AS (SELECT video_id, unnest(range(1, 65)) AS i, unnest(v)::DOUBLE AS x FROM vectors), m AS (SELECT video_id, i, max(x) AS x FROM e GROUP BY ALL)
SELECT video_id, i - 1 AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY video_id)), 6) AS x FROM m)""", "vectors")
def largest_embeddings(spark, d):
    """Vectors pooled by their largest entries."""
    pooled = R.pool(V.vectors(spark, d), "video_id", "v", strategy="max")
    return pooled.select("video_id", F.posexplode("pooled").alias("pos", "x")).select("video_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query(f"SELECT node_id, list_transform(range(8), lambda i: round(v[(i * 8) + 1] / sqrt(s), 6)) AS small FROM (SELECT node_id, v, list_sum(list_transform(range(8), lambda i: v[(i * 8) + 1]::DOUBLE * v[(i * 8) + 1]::DOUBLE)) AS s FROM vectors)", "vectors")
def compressed_embeddings(spark, d):
    return V.vectors(spark, d).select("node_id", F.transform(S.spread(F.col("v").cast("array<double>"), 8), lambda x: F.round(x, 6)).alias("small"))


TERMS = ["license", "the", "der"]
BM25_SQL = """t AS (SELECT doc_id AS node, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents), len AS (SELECT doc_id AS node, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS l FROM documents),
tf AS (SELECT node, term, count(*) AS tf FROM t WHERE term IN ('license', 'the', 'der') GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), tot AS (SELECT count(*) AS n, avg(l) AS a FROM len),
bm AS (SELECT node, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))) AS score FROM tf JOIN df USING (term) JOIN len USING (node), tot GROUP BY node)"""


@query(f"WITH {BM25_SQL} SELECT node AS doc_id, round(score, 6) AS score FROM bm")
def bm25_search(spark, d):
    return R.bm25(table(spark, d, "documents"), TERMS, "doc_id", "text").select("doc_id", F.round("score", 6).alias("score"))


#: BM25 of every text for the terms of ``qt`` (query, term), texts being ``words`` (doc_id, w).
RANKED_SQL = """words AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents), len AS (SELECT doc_id AS node, len(w) AS l FROM words), tot AS (SELECT count(*) AS n, avg(l) AS a FROM len),
tf AS (SELECT doc_id AS node, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM words) WHERE term IN (SELECT term FROM qt) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT query, node, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))), 9) AS score FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN len USING (node), tot GROUP BY query, node)"""


def first_words(rows, query: str, text: str, n: int = 4):
    """``query, term``: the first words of a text as a question."""
    return rows.select(F.col(query).alias("query"), F.explode(F.slice(tokens(F.col(text)), 1, n)).alias("term")).distinct()


@query(
    f"""WITH qt AS (SELECT DISTINCT item_id AS query, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')[1:4]) AS term FROM benchmark), {RANKED_SQL}
SELECT query, node, round(score, 6) AS score FROM bm QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, node) <= 10"""
)
def fulltext_search(spark, d):
    """The ten best texts for every benchmark item's first words, by the index."""
    index = FullTextIndex.build(table(spark, d, "documents"), new_path(spark, "fulltext"), "doc_id", "text")
    return index.search(first_words(table(spark, d, "benchmark"), "item_id", "text"), 10).select("query", "node", F.round("score", 6).alias("score"))


@query(
    f"""SELECT * FROM (WITH qt AS (SELECT DISTINCT doc_id AS query, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')[1:4]) AS term FROM documents WHERE doc_id % 20 = 0), {RANKED_SQL},
ft AS (SELECT query, node, score / max(score) OVER (PARTITION BY query) AS fs FROM (SELECT * FROM bm QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, node) <= 100)),
p AS (SELECT a.node_id AS query, b.node_id AS node, round({COS.format('a.v', 'b.v')}, 9) AS vs FROM vectors a, vectors b WHERE a.node_id % 20 = 0), vl AS (SELECT * FROM p WHERE vs >= 0.1 QUALIFY row_number() OVER (PARTITION BY query ORDER BY vs DESC, node) <= 100),
c AS (SELECT vl.query, vl.node, vs, coalesce(fs, 0) AS fs FROM vl LEFT JOIN ft ON ft.query = vl.query AND ft.node = vl.node
  UNION ALL (SELECT ft.query, ft.node, 0, fs FROM ft ANTI JOIN vl ON ft.query = vl.query AND ft.node = vl.node QUALIFY row_number() OVER (PARTITION BY ft.query ORDER BY fs DESC, ft.node) <= 20)),
deg AS (SELECT l_partkey AS node, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1), times AS (SELECT event_id AS node, event_id % 600 AS ts FROM events),
s AS (SELECT query, node, 0.25 * vs + 0.40 * fs + 0.20 * least(1, (1 + coalesce(n, 0)) / 50.0) + 0.15 * CASE WHEN ts IS NULL THEN 0.5 ELSE exp(-0.5 * power((ts - 300) / 200.0, 2)) END AS score
  FROM c LEFT JOIN deg USING (node) LEFT JOIN times USING (node) WHERE ts IS NULL OR ts BETWEEN 100 AND 500)
SELECT query, node AS doc_id, round(score, 6) AS combined_score FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, node) <= 20)""",
    "vectors",
)
def hybrid_search(spark, d):
    """Of every twentieth number its vector and its text's first words as a query: vectors, full text, the orders that hold a part, and the events' time."""
    docs, n = table(spark, d, "documents"), V.vectors(spark, d)
    hits = VectorIndex.build(n).search(n.where("node_id % 20 = 0"), 100, 0.1).select("query", F.col("node").alias("node_id"), "score")
    index = FullTextIndex.build(docs, new_path(spark, "fulltext"), "doc_id", "text")
    said = index.search(first_words(docs.where("doc_id % 20 = 0"), "doc_id", "text"), 100).select("query", F.col("node").alias("node_id"), "score")
    related = V.contains(spark, d).groupBy(F.col("entity_id").alias("node_id")).agg(F.count("*").alias("related"))
    times = table(spark, d, "events").select(F.col("event_id").alias("node_id"), (F.col("event_id") % 600).alias("ts"))
    facts = R.fuse(written(hits), written(said)).join(related, "node_id", "left").join(times, "node_id", "left")
    return R.weigh(facts, 20, "text", lo=100, hi=500).select("query", F.col("node_id").alias("doc_id"), F.round("combined_score", 6).alias("combined_score"))


@query("""WITH r AS (SELECT d.doc_id, c.turn AS related, c.turn % 2 + 1 AS distance, c.text FROM documents d JOIN conversations c ON c.conv_id = d.doc_id), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY distance, related) AS i, CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'and') THEN 1 ELSE 0 END AS s FROM r),
b AS (SELECT doc_id, avg(s / 2.0 / (distance + 1)) AS m FROM n WHERE i <= 10 AND s > 0 GROUP BY doc_id) SELECT doc_id, round(0.5 * (1 + least(0.2, coalesce(m, 0))), 6) AS combined_score FROM documents LEFT JOIN b USING (doc_id)""")
def context_rerank(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("node_id"), F.lit(0.5).alias("combined_score"))
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("node_id"), F.col("turn").alias("related"), (F.col("turn") % 2 + 1).alias("distance"), "text")
    return R.rerank(docs, docs.select("node_id").join(c, "node_id"), ["the", "and"]).select(F.col("node_id").alias("doc_id"), F.round("combined_score", 6).alias("combined_score"))


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM conversations) WHERE run <= 400")
def rag_context(spark, d):
    rows = table(spark, d, "conversations").withColumn("size", F.length("text"))
    return R.within_budget(rows, "conv_id", [F.col("turn")], "size", 400).select("conv_id", "turn")


@query("SELECT video_id, frame_id FROM frames QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY score DESC, frame_id) <= 3", "frames")
def best_per_video(spark, d):
    return R.per_group(V.frames(spark, d), "video_id", [F.desc("score"), F.col("frame_id")], 3).select("video_id", "frame_id")


@query("""SELECT * FROM (WITH m AS (SELECT video_id, frame_id, score FROM frames WHERE kind = 'purchase' QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY score DESC, frame_id) <= 3)
SELECT video_id, list(frame_id ORDER BY score DESC, frame_id) AS matches, round(max(score), 3) AS relevance FROM m GROUP BY video_id ORDER BY max(score) DESC, video_id LIMIT 5)""", "frames")
def search_across_videos(spark, d):
    m = R.per_group(V.frames(spark, d).where("kind = 'purchase'"), "video_id", [F.desc("score"), F.col("frame_id")], 3)
    g = m.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "frame_id"))).alias("m"), F.max("score").alias("best"))
    return g.orderBy(F.desc("best"), "video_id").limit(5).select("video_id", F.transform("m", lambda x: x["frame_id"]).alias("matches"), F.round("best", 3).alias("relevance"))


@query("""SELECT * FROM (WITH RECURSIVE c AS (SELECT video_id, frame_id, ts_ms / 1000.0::DOUBLE - 3600 AS lo, ts_ms / 1000.0::DOUBLE + 3600 AS hi, row_number() OVER (PARTITION BY video_id ORDER BY -score, frame_id) AS i FROM frames WHERE score > 50),
k AS (SELECT video_id, 0::BIGINT AS i, []::STRUCT(lo DOUBLE, hi DOUBLE)[] AS t FROM (SELECT DISTINCT video_id FROM c) UNION ALL
SELECT k.video_id, c.i, CASE WHEN len(t) < 5 AND len(list_filter(t, lambda r: c.lo < r.hi AND c.hi > r.lo)) = 0 THEN list_append(t, {'lo': c.lo, 'hi': c.hi}) ELSE t END FROM k JOIN c ON c.video_id = k.video_id AND c.i = k.i + 1),
z AS (SELECT video_id, unnest(t) AS r FROM k QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY i DESC) = 1) SELECT video_id, round(r.lo, 3) AS lo, round(r.hi, 3) AS hi FROM z)""".replace("z AS (SELECT video_id, unnest(t) AS r FROM k QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY i DESC) = 1)", "y AS (SELECT video_id, t FROM k QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY i DESC) = 1), z AS (SELECT video_id, unnest(t) AS r FROM y)"), "frames")
def highlights(spark, d):
    f = V.frames(spark, d).where("score > 50").withColumns({"rank": -F.col("score"), "lo": F.col("ts_ms") / 1000 - 3600, "hi": F.col("ts_ms") / 1000 + 3600})
    return R.pick_apart(f, "video_id", ["rank", "frame_id"], "lo", "hi", 5).select("video_id", F.round("lo", 3).alias("lo"), F.round("hi", 3).alias("hi"))


@query("SELECT kind, count(*) AS n, count(DISTINCT video_id) AS videos FROM frames GROUP BY kind", "frames")
def facets(spark, d):
    return V.frames(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("video_id").alias("videos"))


@query("""SELECT video_id, speaker, t, s FROM (SELECT video_id, speaker, start_ms AS t, 'audio' AS s FROM segments UNION ALL SELECT video_id, kind, ts_ms, 'visual' FROM frames)
QUALIFY row_number() OVER (PARTITION BY video_id, t // 100000 ORDER BY s DESC, t, speaker) = 1""", "segments", "frames")
def deduped_timeline(spark, d):
    both = V.segments(spark, d).select("video_id", "speaker", F.col("start_ms").alias("t"), F.lit("audio").alias("s")).unionByName(V.frames(spark, d).select("video_id", F.col("kind").alias("speaker"), F.col("ts_ms").alias("t"), F.lit("visual").alias("s")))
    return B.latest(both.withColumn("_b", F.floor(F.col("t") / 100_000)), ["video_id", "_b"], [F.desc("s"), F.col("t"), F.col("speaker")]).drop("_b")


# keyed tables and operations


@query("""SELECT coalesce(t.k, u.k) AS k, CASE WHEN u.k IS NULL THEN t.v ELSE u.v END AS v, CASE WHEN t.k IS NOT NULL THEN t.created_at ELSE u.created_at END AS created_at
FROM (SELECT c_custkey AS k, c_acctbal AS v, 1 AS created_at FROM customer WHERE c_custkey % 3 > 0) t FULL JOIN (SELECT c_custkey AS k, round(c_acctbal * 2, 2) AS v, 2 AS created_at FROM customer WHERE c_custkey % 2 = 0) u ON t.k = u.k""")
def keyed_merge(spark, d):
    c = table(spark, d, "customer")
    t = c.where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.lit(1).alias("created_at"))
    u = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.round(F.col("c_acctbal") * 2, 2).alias("v"), F.lit(2).alias("created_at"))
    return B.merge(t, u, ["k"])


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_row(spark, d):
    return B.latest(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT p_partkey AS upsert_id, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 > 0 THEN 'applied' ELSE 'pending' END AS status FROM part")
def applied_stays_applied(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("upsert_id"), F.to_json(F.struct("p_brand", "p_name")).alias("properties_json"))
    old = p.where("upsert_id % 2 = 0").withColumns({"status": F.lit("applied"), "properties_json": F.when(F.col("upsert_id") % 3 > 0, F.col("properties_json")).otherwise("{}")})
    return B.keep_applied(p, old).select("upsert_id", "status")


@query("SELECT p_partkey, list_filter([CASE WHEN NOT p_size >= 10 THEN 'size' END, CASE WHEN NOT p_retailprice < 1500 THEN 'price' END, CASE WHEN NOT p_brand IN ('Brand#1', 'Brand#2') THEN 'brand' END], lambda x: x IS NOT NULL) AS failed_gates FROM part")
def quality_gates(spark, d):
    gates = {"size": F.col("p_size") >= 10, "price": F.col("p_retailprice") < 1500, "brand": F.col("p_brand").isin("Brand#1", "Brand#2")}
    return B.split_by_gates(table(spark, d, "part"), gates).select("p_partkey", "failed_gates")


@query("SELECT event_id AS outbox_id FROM events WHERE event_type <> 'view' ORDER BY ts, event_id LIMIT 100")
def outbox_poll(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("outbox_id"), F.col("ts").alias("emitted_at"), F.when(F.col("event_type") == "view", F.col("ts")).alias("consumed_at"))
    return B.unconsumed(e, 100).select("outbox_id")


@query("""SELECT media_id, CASE s WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS status, CASE WHEN s = 'purchase' THEN 1.0 ELSE round(p / 1000, 6) END::DOUBLE AS progress FROM (
SELECT user_id AS media_id, event_type AS s, value AS p FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)""")
def status_projection(spark, d):
    e = table(spark, d, "events")
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("progress")
    events = e.select(F.col("user_id").alias("media_id"), F.lit("d1").alias("dispatch_id"), status.alias("status"), F.round(F.col("value") / 1000, 6).alias("progress"), F.col("ts").alias("emitted_at"), F.col("event_id").alias("outbox_id"))
    control = e.select(F.col("user_id").alias("media_id")).distinct().select("media_id", F.lit("d1").alias("dispatch_id"), F.lit("queued").alias("status"), F.lit(0.0).alias("progress"), F.lit(False).alias("processed"))
    return B.project_status(control, events).select("media_id", "status", "progress")


@query("SELECT event_type, day, round(v, 6) AS v, round(baseline, 6) AS baseline, coalesce(v < baseline - 0.03, FALSE) AS regressed FROM (SELECT *, quantile_cont(v, 0.5) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS baseline FROM (SELECT event_type, ts::DATE AS day, avg(value) AS v FROM events GROUP BY ALL))")
def rolling_regressions(spark, d):
    days = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    return B.regressions(days, "event_type", "day", "v").select("event_type", "day", F.round("v", 6).alias("v"), F.round("baseline", 6).alias("baseline"), "regressed")


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def content_distinct(spark, d):
    return B.hash_distinct(table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit(""))), "text", ["doc_id"]).select("doc_id", "sha256")


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS n FROM documents) ORDER BY n, lang NULLS FIRST LIMIT 100")
def stratified_sample(spark, d):
    return B.stratified(table(spark, d, "documents"), "lang", "doc_id", 100).select("doc_id", "lang")


@query("SELECT o_orderstatus AS stage, o_orderpriority AS status, count(*) AS n, round(avg(o_totalprice), 4) AS avg_s, round(quantile_cont(o_totalprice, 0.95), 4) AS p95, sum(CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END)::BIGINT AS retries, max(o_totalprice) AS longest FROM orders GROUP BY ALL")
def ops_stage_durations(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("stage"), F.col("o_orderpriority").alias("status")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("avg_s"), F.round(F.percentile("o_totalprice", F.lit(0.95)), 4).alias("p95"), F.sum((F.col("o_totalprice") > 200000).cast("long")).alias("retries"), F.max("o_totalprice").alias("longest"))


@query("SELECT event_type AS status, count(*) AS n, min(ts) AS oldest, max(ts) AS newest FROM events WHERE json_extract_string(props, '$.k')::INT % 2 = 0 GROUP BY event_type")
def ops_outbox_backlog(spark, d):
    return table(spark, d, "events").where(F.get_json_object("props", "$.k").cast("int") % 2 == 0).groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"))


@query("""WITH l AS (SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
SELECT c_custkey, c_mktsegment, o_orderkey, o_orderstatus, n FROM customer LEFT JOIN l ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey WHERE o_orderstatus IN ('O', 'P') OR c_acctbal < 0""")
def ops_active_runs(spark, d):
    last = B.latest(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    j = table(spark, d, "customer").join(last, F.col("o_custkey") == F.col("c_custkey"), "left").join(n, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return j.where("o_orderstatus IN ('O', 'P') OR c_acctbal < 0").select("c_custkey", "c_mktsegment", "o_orderkey", "o_orderstatus", "n")


@query("""SELECT n_nationkey, coalesce(a.n, 0) AS suppliers, coalesce(b.n, 0) AS customers, coalesce(b.s, 0) AS balance FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) a ON s_nationkey = n_nationkey
LEFT JOIN (SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS s FROM customer GROUP BY 1) b ON c_nationkey = n_nationkey""")
def ops_coverage(spark, d):
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    j = table(spark, d, "nation").join(s, "n_nationkey", "left").join(c, "n_nationkey", "left")
    return j.select("n_nationkey", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("suppliers", "customers")], F.coalesce("balance", F.lit(0.0)).alias("balance"))


@query("SELECT event_type, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL")
def ops_stage_metrics(spark, d):
    return table(spark, d, "events").where(F.col("event_type").isin("click", "view")).groupBy("event_type", F.get_json_object("props", "$.k").try_cast("bigint").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT user_id, count(*) FILTER (event_type <> 'error') / count(*)::DOUBLE AS success_rate FROM events GROUP BY user_id")
def success_rate(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.try_divide(F.sum((F.col("event_type") != "error").cast("long")), F.count("*")).alias("success_rate"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN [m * 60 + 5, 3600 + m * 60 + 7, m * 60 + 30]::DOUBLE[] WHEN 1 THEN [m + 0.5, m]::DOUBLE[] WHEN 2 THEN [m * 60 + 9]::DOUBLE[] ELSE []::DOUBLE[] END AS seconds,
CASE WHEN event_id % 4 = 1 THEN [m, 17]::INT[] ELSE []::INT[] END AS frames FROM (SELECT event_id, event_id % 60 AS m FROM events)""")
def citations(spark, d):
    m, n = (F.col("event_id") % 60).cast("string"), F.col("event_id") % 4
    said = (
        F.when(n == 0, F.concat(F.lit("from "), m, F.lit(":30 on, see [ "), m, F.lit(":05] and (1:"), F.lpad(m, 2, "0"), F.lit(":07)")))
        .when(n == 1, F.concat(F.lit("Frame #"), m, F.lit(" and frame 17, T = "), m, F.lit(".5 s, At "), m, F.lit(" seconds")))
        .when(n == 2, F.concat(F.lit("odds of 123:45, version 1.12:30 and 1:234, but ("), m, F.lit(":09)")))
        .otherwise(F.lit("near the end of frames, at seconds 12, t=s"))
    )
    cited = E.citations(said)
    return table(spark, d, "events").select("event_id", F.filter(F.transform(cited, lambda c: c["seconds"]), lambda x: x.isNotNull()).alias("seconds"), F.filter(F.transform(cited, lambda c: c["frame"]), lambda x: x.isNotNull()).alias("frames"))


@query("SELECT event_id, substr('ABCDE', (event_id % 5)::INT + 1, 1) AS said, CASE WHEN event_id % 5 < 4 THEN substr('ABCD', (event_id % 5)::INT + 1, 1) END AS choice FROM events")
def multiple_choice(spark, d):
    said = F.substring(F.lit("ABCDE"), (F.col("event_id") % 5 + 1).cast("int"), F.lit(1))
    return table(spark, d, "events").select("event_id", said.alias("said"), E.choice(F.concat(F.lit("  The answer is "), said, F.lit("."))).alias("choice"))


@query(r"SELECT conv_id, turn, regexp_matches(lower(text), '\b(beginning|middle|end|opening|closing|earlier|later|after|before)\b') AS soft FROM (SELECT conv_id, turn, text || ([' the start', ' at the opening', ' during it', ' Closing scene', ' ending'])[turn % 5 + 1] AS text FROM conversations)")
def soft_references(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", E.soft_reference(F.concat("text", F.get(F.array(*map(F.lit, [" the start", " at the opening", " during it", " Closing scene", " ending"])), (F.col("turn") % 5).cast("int")))).alias("soft"))


@query("SELECT l_orderkey, l_partkey, rank FROM (SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank FROM lineitem) WHERE rank <= 2")
def top_children(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber", "l_partkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.row_number().over(w).alias("rank")).where("rank <= 2")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 25")
def paged(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(25).limit(25)


# more of the same kinds


@query("SELECT frame_id FROM (SELECT frame_id, CASE WHEN frame_id % 7 > 0 THEN ts_ms END AS t FROM frames) WHERE t IS NULL OR t BETWEEN 1000000 AND 90000000", "frames")
def time_range_or_unknown(spark, d):
    t = F.when(F.col("frame_id") % 7 > 0, F.col("ts_ms"))
    return V.frames(spark, d).where(t.isNull() | t.between(1_000_000, 90_000_000)).select("frame_id")


@query(f"WITH {EDGES_SQL}, n AS (SELECT 'r' || r_regionkey AS node FROM region UNION SELECT 'n' || n_nationkey FROM nation) SELECT DISTINCT src, dst, rel_type FROM edges WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n)")
def induced_subgraph(spark, d):
    e = _tree(spark, d)
    nodes = e.where("src LIKE 'r%'").select(F.explode(F.array("src", "dst")).alias("node"))
    return G.induced(nodes, e).select("src", "dst", "rel_type")


@query("SELECT doc_id, 'question ' || doc_id || ' (' || mode || ')' AS query, ground_truth, mode FROM (SELECT doc_id, upper(substr(text, 1, 1)) AS ground_truth FROM documents), (VALUES ('with'), ('without')) m(mode) WHERE ground_truth IN ('A', 'B', 'C', 'D')")
def benchmark_rows(spark, d):
    q = table(spark, d, "documents").select("doc_id", F.upper(F.substring("text", 1, 1)).alias("ground_truth")).where(F.col("ground_truth").isin("A", "B", "C", "D"))
    return q.withColumn("mode", F.explode(F.array(F.lit("with"), F.lit("without")))).select("doc_id", F.concat(F.lit("question "), "doc_id", F.lit(" ("), "mode", F.lit(")")).alias("query"), "ground_truth", "mode")


@query("""SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || doc_id), doc_id) AS n FROM documents) WHERE n <= (SELECT 100 // count(DISTINCT lang) FROM documents)""")
def equal_quotas(spark, d):
    return B.equal_quotas(table(spark, d, "documents"), "lang", "doc_id", 100, 7).select("doc_id", "lang")


@query("SELECT video_id, speaker, start_ms, phase FROM (SELECT s.*, CASE WHEN end_ms < 30000 THEN 'before' WHEN start_ms > 40000 THEN 'after' ELSE 'during' END AS phase FROM segments s) QUALIFY row_number() OVER (PARTITION BY video_id, phase ORDER BY abs(start_ms - 35000), start_ms) <= 3", "segments")
def scene_context(spark, d):
    phase = F.when(F.col("end_ms") < 30_000, "before").when(F.col("start_ms") > 40_000, "after").otherwise("during")
    s = V.segments(spark, d).withColumn("phase", phase)
    return B.latest(s, ["video_id", "phase", "start_ms"], [F.col("idx")]).withColumn("_n", F.row_number().over(Window.partitionBy("video_id", "phase").orderBy(F.abs(F.col("start_ms") - 35_000), "start_ms"))).where("_n <= 3").select("video_id", "speaker", "start_ms", "phase")


@query("SELECT video_id, string_agg('[' || (start_ms // 1000 // 60) || ':' || lpad((start_ms // 1000 % 60)::VARCHAR, 2, '0') || '] **' || speaker || '**: ' || text, chr(10) ORDER BY idx) AS transcript, count(*) AS n, count(DISTINCT speaker) AS speakers FROM segments GROUP BY video_id", "segments")
def transcripts(spark, d):
    s = V.segments(spark, d)
    line = F.concat(F.lit("["), S.clock(F.col("start_ms") / 1000), F.lit("] **"), "speaker", F.lit("**: "), "text")
    g = s.withColumn("line", line).groupBy("video_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "line"))), lambda x: x["line"]), "\n").alias("transcript"), F.count("*").alias("n"), F.countDistinct("speaker").alias("speakers"))
    return g


@query("SELECT video_id, min(idx) AS first, array_to_string(list_sort(list(DISTINCT speaker)), ',') AS speakers, max(end_ms) / 1000.0::DOUBLE AS duration, sum(length(text))::BIGINT AS chars, list(text ORDER BY length(text) DESC, idx)[1] AS longest FROM segments GROUP BY video_id", "segments")
def video_overview(spark, d):
    s = V.segments(spark, d)
    return s.groupBy("video_id").agg(F.min("idx").alias("first"), F.array_join(F.array_sort(F.collect_set("speaker")), ",").alias("speakers"), (F.max("end_ms") / 1000).alias("duration"), F.sum(F.length("text")).alias("chars"), F.max_by("text", F.struct(F.length("text"), -F.col("idx"))).alias("longest"))


@query("SELECT o_orderkey, coalesce(nullif(o_totalprice, 0), m, 0) AS duration FROM orders LEFT JOIN (SELECT l_orderkey, max(l_extendedprice) AS m FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def duration_fallback(spark, d):
    m = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_extendedprice").alias("m"))
    return table(spark, d, "orders").join(m, "o_orderkey", "left").select("o_orderkey", F.coalesce(F.nullif(F.col("o_totalprice"), F.lit(0.0)), "m", F.lit(0.0)).alias("duration"))


@query("""SELECT video_id, speaker, round(lex + rec, 6) AS score FROM (SELECT video_id, speaker, idx, 2.0 * (CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'und') THEN 1 ELSE 0 END) AS lex, greatest(0, 1 - (row_number() OVER (PARTITION BY video_id ORDER BY idx DESC) - 1) / 20.0) AS rec FROM segments)
QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY lex + rec DESC, idx DESC) = 1""", "segments")
def memory_ranking(spark, d):
    s = V.segments(spark, d)
    lex = 2.0 * X.overlap(F.col("text"), F.array(F.lit("the"), F.lit("und")))
    rec = F.greatest(F.lit(0.0), 1 - (F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("idx"))) - 1) / 20)
    ranked = s.withColumn("score", lex + rec)
    return B.latest(ranked, ["video_id"], [F.desc("score"), F.desc("idx")]).select("video_id", "speaker", F.round("score", 6).alias("score"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem GROUP BY ALL")
def label_rollup(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("SELECT source, lang, status, n, first_id, last_id FROM (SELECT source, lang, CASE WHEN n_chars % 3 = 0 THEN 'failed' ELSE 'pending' END AS status, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY ALL)")
def ops_unapplied_upserts(spark, d):
    status = F.when(F.col("n_chars") % 3 == 0, "failed").otherwise("pending")
    return table(spark, d, "documents").groupBy("source", "lang", status.alias("status")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query("SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.n_chars < 500")
def ops_quarantine(spark, d):
    return table(spark, d, "documents").where("n_chars < 500").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", "source", "quality", "toxic")


@query("SELECT user_id AS src, event_type AS dst, count(*) AS evidence_count, max(value) AS weight, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY ALL")
def semantic_edges(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("src"), F.col("event_type").alias("dst")).agg(F.count("*").alias("evidence_count"), F.max("value").alias("weight"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def unreferenced(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@query("SELECT video_id, i, greatest(0, least(round(duration * (i + 0.5) / 10, 3), duration - 0.1)) AS at FROM (SELECT video_id, max(ts_ms) // 1000 + 0.0::DOUBLE AS duration FROM frames GROUP BY video_id), range(10) r(i)", "frames")
def uniform_samples(spark, d):
    v = V.frames(spark, d).groupBy("video_id").agg(F.floor(F.max("ts_ms") / 1000).cast("double").alias("duration")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))))
    return v.select("video_id", "i", F.greatest(F.lit(0.0), F.least(F.round(F.col("duration") * (F.col("i") + 0.5) / 10, 3), F.col("duration") - 0.1)).alias("at"))
