"""Queries of an assistant over videos."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenweave.functions import payload as P
from lumenweave.functions import text as X
from lumenweave.operators import assistant as A
from lumenweave.operators import graph as G
from lumenweave.operators import search as R
from lumenweave.plans import views as V
from lumenweave.plans.discovery import HELD, SHOTS, media, shots
from lumenweave.plans.registry import query
from lumenweave.session import table


@query("""WITH RECURSIVE c AS (SELECT conv_id, turn, substr(role || ': ' || text, 1, 260) AS said, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS back FROM conversations),
r AS (SELECT conv_id, '[memory] ' || said AS snippet, ((contains(lower(said), 'the'))::INT + (contains(lower(said), 'und'))::INT) * 2.2 + greatest(0, 1 - back / 20.0) * 0.8 AS rank, greatest(0, 1 - back / 20.0) AS rec FROM c WHERE back < 20),
t AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY rank DESC, rec DESC) <= 24), u AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY conv_id, lower(snippet) ORDER BY rank DESC, rec DESC) = 1),
o AS (SELECT conv_id, snippet, length(snippet) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY rank DESC, rec DESC) AS i FROM u),
w AS (SELECT conv_id, 0::BIGINT AS i, 0::BIGINT AS total, 0 AS taken, NULL::VARCHAR AS snippet, FALSE AS has FROM (SELECT DISTINCT conv_id FROM o)
UNION ALL SELECT w.conv_id, o.i, CASE WHEN fits THEN total + w.n ELSE total END, CASE WHEN fits THEN taken + 1 ELSE taken END, o.snippet, fits FROM (SELECT w.*, o.snippet AS s2, o.n, total + o.n <= 500 AND taken < 3 AS fits FROM w JOIN o ON o.conv_id = w.conv_id AND o.i = w.i + 1) w JOIN o ON o.conv_id = w.conv_id AND o.i = w.i + 1)
SELECT conv_id, taken AS nth, snippet FROM w WHERE has""")
def memory_snippets(spark, d):
    terms = F.array(F.lit("the"), F.lit("und"))
    return A.memory(table(spark, d, "conversations"), "conv_id", "turn", "role", "text", terms, 500, 3)


@query(f"""WITH RECURSIVE {SHOTS}, {HELD}, f AS (SELECT frame_id, video_id, ts, description, 126.0::DOUBLE AS duration, length(description) AS len FROM shots), long AS (SELECT * FROM f WHERE len > 8 QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY len DESC, frame_id) <= 100),
best AS (SELECT video_id, 1 AS way, -len AS byx, frame_id, ts, duration FROM long QUALIFY row_number() OVER (PARTITION BY video_id, floor(ts / 20) ORDER BY len DESC, frame_id) = 1), cnt AS (SELECT frame_id, count(*) AS n FROM held GROUP BY frame_id HAVING count(*) > 2),
ent AS (SELECT video_id, 2 AS way, -n AS byx, frame_id, ts, duration FROM f JOIN cnt USING (frame_id) QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY n DESC, frame_id) <= 20),
sp AS (SELECT video_id, greatest(0, ts - 5) AS lo, greatest(least(duration, ts + 5), greatest(0, ts - 5) + 10) AS hi, row_number() OVER (PARTITION BY video_id ORDER BY way, byx, frame_id) AS i FROM (SELECT * FROM best UNION ALL SELECT * FROM ent)),
k AS (SELECT video_id, 0::BIGINT AS i, []::STRUCT(lo DOUBLE, hi DOUBLE)[] AS t FROM (SELECT DISTINCT video_id FROM sp) UNION ALL SELECT k.video_id, sp.i, CASE WHEN len(t) < 4 AND len(list_filter(t, lambda r: sp.lo < r.hi AND sp.hi > r.lo)) = 0 THEN list_append(t, {{'lo': sp.lo, 'hi': sp.hi}}) ELSE t END FROM k JOIN sp ON sp.video_id = k.video_id AND sp.i = k.i + 1),
y AS (SELECT video_id, t FROM k QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY i DESC) = 1), z AS (SELECT video_id, unnest(t) AS r FROM y) SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY r.lo) AS nth, r.lo AS lo, r.hi AS hi FROM z""")
def all_highlights(spark, d):
    f = shots(spark, d).withColumn("duration", F.lit(126.0))
    n = V.contains(spark, d).groupBy("frame_id").agg(F.count("*").alias("n"))
    return A.highlights(f, n, 20, 10, 4, rich=8)


@query(r"""WITH v AS (SELECT user_id AS video_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, event_type || ' number ' || event_id AS said FROM events WHERE event_id % 4 > 0),
s AS (SELECT *, greatest(1, n // least(5, n)) AS step FROM v) SELECT video_id, substr(string_agg(substr(said, 1, 150), ' ' ORDER BY i), 1, 600) AS summary FROM s WHERE i % step = 0 AND i // step < 5 GROUP BY video_id""")
def video_summaries(spark, d):
    e = table(spark, d, "events")
    said = F.when(F.col("event_id") % 4 == 0, "a completely black picture").otherwise(F.concat(F.lit("- **The image shows** "), "event_type", F.lit("\nnumber "), "event_id"))
    return A.summaries(e.select(F.col("user_id").alias("video_id"), "ts", "event_id", said.alias("description")), ["ts", "event_id"], ["The image shows"])


@query(f"WITH {SHOTS}, {HELD} SELECT p_brand AS community, frame_id FROM (SELECT DISTINCT p_brand, frame_id, ts FROM held JOIN part ON p_partkey = entity_id JOIN shots USING (frame_id)) QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY ts, frame_id) <= 5")
def supporting_frames(spark, d):
    m = table(spark, d, "part").select(F.col("p_brand").alias("community"), F.col("p_partkey").alias("entity_id"))
    return A.supporting_frames(m, V.contains(spark, d), shots(spark, d))


@query("""WITH b AS (SELECT 'event' AS kind, event_id AS id, props AS body FROM events UNION ALL SELECT 'message', event_id, '{"media_id": ' || user_id || ', "status": "' || event_type || '"}' FROM events UNION ALL SELECT 'document', doc_id, text FROM documents)
SELECT kind, id, CASE kind WHEN 'event' THEN 'missing media_id,status' WHEN 'document' THEN 'no object' END AS problem, CASE kind WHEN 'message' THEN (body->>'$.media_id')::BIGINT END AS media_id FROM b""")
def checked_messages(spark, d):
    """Messages, properties of events and documents, read as messages."""
    e = table(spark, d, "events")
    message = F.to_json(F.struct(F.col("user_id").alias("media_id"), F.col("event_type").alias("status")))
    rows = e.select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("props").alias("body")).unionByName(e.select(F.lit("message").alias("kind"), F.col("event_id").alias("id"), message.alias("body")))
    rows = rows.unionByName(table(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("body")))
    return A.checked_messages(rows, "body", "media_id long, status string", ["media_id", "status"]).select("kind", "id", "problem", F.col("message.media_id").alias("media_id"))


@query("""WITH e AS (SELECT user_id, event_type AS stage, ts, event_id, CASE WHEN event_id % 3 = 0 THEN 'completed' WHEN event_id % 7 = 0 THEN 'failed' ELSE 'running' END AS status FROM events)
SELECT user_id, stage, arg_max(status, struct_pack(t := ts, r := CASE status WHEN 'running' THEN 0 ELSE 1 END)) AS state, count(*) AS n FROM e GROUP BY user_id, stage""")
def stage_states(spark, d):
    n = F.col("event_id")
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("stage"), "ts", F.when(n % 3 == 0, "completed").when(n % 7 == 0, "failed").otherwise("running").alias("status"))
    return A.stage_states(e, "user_id", "stage", "ts", "status")


@query("""SELECT p_partkey, [regexp_replace(lower(p_name), '[^a-z0-9 _.-]', '', 'g'), 'unknown'] AS names, ['object', 'concept'] AS types FROM part""")
def entity_nodes(spark, d):
    """Nodes from what a model names: canonical names and known types."""
    body = F.concat(F.lit('{"entities": [{"name": " '), F.upper("p_name"), F.lit('! ", "type": "Vehicle"}, {"name": "?", "type": "odd"}]}'))
    e = F.from_json(body, "entities array<struct<name: string, type: string>>")["entities"]
    return table(spark, d, "part").select("p_partkey", F.transform(e, lambda x: X.entity_name(x["name"])).alias("names"), F.transform(e, lambda x: X.entity_type(x["type"])).alias("types"))


@query(f"""WITH {HELD}, s AS (SELECT DISTINCT frame_id, entity_id FROM held), pairs AS (SELECT DISTINCT a.entity_id AS a, b.entity_id AS b FROM s a JOIN s b USING (frame_id) WHERE a.entity_id <> b.entity_id),
st AS (SELECT p_partkey AS start FROM part WHERE p_partkey % 20 = 0), h1 AS (SELECT start, b AS node FROM st JOIN pairs ON a = start), n AS (SELECT start, node, 1 AS distance FROM h1 UNION ALL SELECT DISTINCT start, b, 2 FROM h1 JOIN pairs ON a = node WHERE b <> start),
m AS (SELECT start, node, min(distance) AS distance FROM n GROUP BY ALL) SELECT start, node, distance FROM m QUALIFY row_number() OVER (PARTITION BY start ORDER BY distance, node) <= 15""")
def related_content(spark, d):
    """Entities seen together with every twentieth, or with what is seen with it."""
    held = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("frame_id"), F.col("l_partkey").alias("entity_id"))
    starts = table(spark, d, "part").where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("start"))
    return G.companions(held, starts, 15)


@query(f"WITH {SHOTS} SELECT video_id, list(frame_id ORDER BY ts, frame_id) AS frames, list(least(ts + 5, 125.0)::DOUBLE ORDER BY ts, frame_id) AS ends FROM shots GROUP BY video_id")
def zipped_frames(spark, d):
    """Two lists of a video, matched by position."""
    sorted_ = F.array_sort(F.collect_list(F.struct("ts", "frame_id")))
    s = shots(spark, d).groupBy("video_id").agg(sorted_.alias("s"))
    both = F.arrays_zip(F.transform("s", lambda x: x["frame_id"]).alias("f"), F.transform("s", lambda x: F.least(x["ts"] + 5, F.lit(125.0))).alias("e"))
    z = s.select("video_id", both.alias("z"))
    return z.select("video_id", F.transform("z", lambda x: x["f"]).alias("frames"), F.transform("z", lambda x: x["e"]).alias("ends"))


@query("""WITH m AS (SELECT c_custkey AS video_id, c_name AS title, abs(c_acctbal)::DOUBLE AS duration FROM customer) SELECT 'newest' AS mode, video_id FROM (SELECT * FROM m ORDER BY video_id DESC LIMIT 6) UNION ALL SELECT 'oldest', video_id FROM (SELECT * FROM m ORDER BY video_id LIMIT 6)
UNION ALL SELECT 'name', video_id FROM (SELECT * FROM m ORDER BY lower(title), video_id LIMIT 6) UNION ALL SELECT 'size', video_id FROM (SELECT * FROM m ORDER BY duration DESC, video_id LIMIT 6)""")
def library_sorted(spark, d):
    m, out = media(spark, d), None
    for mode, order in {"newest": [F.desc("video_id")], "oldest": [F.col("video_id")], "name": [F.lower("title"), F.col("video_id")], "size": [F.desc("duration"), F.col("video_id")]}.items():
        part = m.orderBy(*order).limit(6).select(F.lit(mode).alias("mode"), "video_id")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""WITH {SHOTS}, m AS (SELECT c_custkey AS video_id, c_name AS title FROM customer) SELECT m.video_id, title, count(frame_id) AS n_frames, coalesce(max(ts), 0)::DOUBLE AS last, coalesce(list_slice(list(frame_id ORDER BY ts, frame_id) FILTER (frame_id IS NOT NULL), 1, 3), []) AS shown FROM m LEFT JOIN shots s ON s.video_id = m.video_id GROUP BY m.video_id, title""")
def video_structure(spark, d):
    """A video with its statistics and first frames, in one row."""
    first = R.per_group(shots(spark, d), "video_id", [F.col("ts"), F.col("frame_id")], 3).groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "frame_id"))), lambda s: s["frame_id"]).alias("shown"))
    stats = shots(spark, d).groupBy("video_id").agg(F.count("*").alias("n_frames"), F.max("ts").alias("last"))
    j = media(spark, d).select("video_id", "title").join(stats, "video_id", "left").join(first, "video_id", "left")
    return j.select("video_id", "title", F.coalesce("n_frames", F.lit(0)).alias("n_frames"), F.coalesce("last", F.lit(0.0)).alias("last"), F.coalesce("shown", F.array().cast("array<bigint>")).alias("shown"))


@query("""WITH e AS (SELECT 'n' || c_nationkey AS src, 'c' || c_custkey AS dst FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders), s AS (SELECT 'n' || n_nationkey AS start FROM nation WHERE n_nationkey % 20 = 0)
SELECT DISTINCT start, a.dst AS node, 1 AS hop FROM s JOIN e a ON a.src = start UNION SELECT DISTINCT start, b.dst, 2 FROM s JOIN e a ON a.src = start JOIN e b ON b.src = a.dst""")
def video_children(spark, d):
    """Children and their children."""
    name = lambda x, k: F.concat(F.lit(x), F.col(k).cast("string"))
    e = table(spark, d, "customer").select(name("n", "c_nationkey").alias("src"), name("c", "c_custkey").alias("dst")).union(table(spark, d, "orders").select(name("c", "o_custkey"), name("o", "o_orderkey")))
    s = table(spark, d, "nation").where("n_nationkey % 20 = 0").select(name("n", "n_nationkey").alias("start"))
    one = s.join(e, F.col("start") == F.col("src")).select("start", F.col("dst").alias("node"))
    two = one.join(e, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node"))
    return one.distinct().withColumn("hop", F.lit(1)).unionByName(two.distinct().withColumn("hop", F.lit(2)))


@query("""SELECT event_id, ('{"k":' || event_id % 3 || '}')[1:5] AS preview, 'click' = event_type AS known FROM events""")
def artifact_previews(spark, d):
    body = F.concat(F.lit('{"other": "'), "event_type", F.lit('", "summary": {"k": '), F.col("event_id") % 3, F.lit("}}"))
    v = P.value(body)
    return table(spark, d, "events").select("event_id", P.preview(v, ["title", "summary"], 5).alias("preview"), (P.string_field(v, ["other"]) == "click").alias("known"))


#: Each turn refers to one of seven artifacts of its conversation, and the first turn is the question; an artifact holds what was said last under its name.
REFS_SQL = """refs AS (SELECT conv_id, turn AS n, CASE WHEN turn % 5 = 4 THEN '' ELSE conv_id || '-' || turn % 7 END AS artifact_id, role AS tool, substr(text, 1, 300) AS summary FROM conversations),
stored AS (SELECT artifact_id, arg_max(tool, n) AS tool, arg_max(CASE WHEN conv_id % 11 = 0 THEN '' ELSE substr(summary, 1, 250) END, n) AS preview FROM refs GROUP BY artifact_id),
back AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) AS b FROM refs)"""
SNIPPET_SQL = """snip AS (SELECT conv_id, nth, '[artifact:' || artifact_id || '] ' || coalesce(nullif(c.tool, ''), nullif(s.tool, ''), 'tool') || chr(10) || 'summary: ' || substr(summary, 1, 180) || chr(10) || 'payload: ' || preview AS snippet FROM chosen c JOIN stored s USING (artifact_id) WHERE preview <> '')
SELECT conv_id, nth, snippet FROM snip QUALIFY sum(length(snippet)) OVER (PARTITION BY conv_id ORDER BY nth) <= 700"""


def _stored(spark, d):
    c = table(spark, d, "conversations")
    name = F.when(F.col("turn") % 5 == 4, "").otherwise(F.concat_ws("-", "conv_id", F.col("turn") % 7))
    refs = c.select("conv_id", F.col("turn").alias("n"), name.alias("artifact_id"), F.col("role").alias("tool"), F.substring("text", 1, 300).alias("summary"))
    held = F.when(F.col("conv_id") % 11 == 0, "").otherwise(F.substring("summary", 1, 250))
    return refs, refs.groupBy("artifact_id").agg(F.max_by("tool", "n").alias("tool"), F.max_by(held, "n").alias("preview"))


@query(f"""WITH {REFS_SQL},
q AS (SELECT conv_id, text AS question FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1),
w AS (SELECT conv_id, regexp_matches(lower(question), 'exact|specific|detail|timestamp|timecode|quote|verbatim|full|complete|all results|evidence') AS detail, list_distinct(list_filter(regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_matches(w, '^[a-z0-9]{{3,}}$')
  AND w NOT IN ('the', 'and', 'for', 'with', 'this', 'that', 'what', 'when', 'where', 'which', 'who', 'how', 'about', 'video', 'scene', 'please'))) AS terms FROM q),
sc AS (SELECT b.*, detail, len(list_filter(terms, lambda t: contains(lower(tool || ' ' || summary), t))) AS s FROM back b JOIN w USING (conv_id) WHERE b <= 20), mx AS (SELECT *, max(s) OVER (PARTITION BY conv_id) AS m FROM sc),
one AS (SELECT * FROM mx WHERE (m > 0 OR detail) AND artifact_id <> '' QUALIFY row_number() OVER (PARTITION BY conv_id, artifact_id ORDER BY s DESC, b) = 1),
chosen AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY s DESC, b) AS nth, artifact_id, tool, summary FROM one QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY s DESC, b) <= 2), {SNIPPET_SQL}""")
def recalled_artifacts(spark, d):
    """What the artifacts hold that a conversation's first turn is likely to be about."""
    refs, stored = _stored(spark, d)
    first = R.per_group(table(spark, d, "conversations"), "conv_id", [F.col("turn")], 1).select("conv_id", F.col("text").alias("question"))
    return A.rehydrated(A.artifacts_for(refs, first, "conv_id"), stored, "conv_id", 700)


@query(f"""WITH {REFS_SQL},
latest AS (SELECT * FROM back WHERE b <= 50 AND artifact_id <> '' QUALIFY row_number() OVER (PARTITION BY conv_id, artifact_id ORDER BY b) = 1),
wanted AS (SELECT conv_id, p AS place, conv_id || '-' || (conv_id + p * 3) % 7 AS artifact_id FROM (SELECT DISTINCT conv_id FROM conversations), (SELECT unnest(range(4)) AS p)),
chosen AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS nth, artifact_id, tool, summary FROM wanted JOIN latest USING (conv_id, artifact_id) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY place) <= 2), {SNIPPET_SQL}""")
def named_artifacts(spark, d):
    """What the artifacts hold that a list names, the first of it first."""
    refs, stored = _stored(spark, d)
    wanted = table(spark, d, "conversations").select("conv_id").distinct().select("conv_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("place"))
    wanted = wanted.withColumn("artifact_id", F.concat_ws("-", "conv_id", (F.col("conv_id") + F.col("place") * 3) % 7))
    return A.rehydrated(A.artifacts_named(refs, wanted, "conv_id"), stored, "conv_id", 700)
