"""Queries over payloads, configurations and texts of messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenweave.functions import payload as P
from lumenweave.functions import scalar as S
from lumenweave.functions import text as X
from lumenweave.operators import sampling as M
from lumenweave.plans import views as V
from lumenweave.plans.registry import query
from lumenweave.session import table


def _nth(n, *texts: str | None):
    return F.get(F.array(*map(F.lit, texts)), (n % len(texts)).cast("int"))


PAYLOADS = [
    '{"caption": " A car ", "objects": ["car", {"name": "Bike", "label": " bike "}, ["tree", 42, {"text": "sign"}]], "text": "stop"}',
    '{"labels": ["Dog", "dog", 7, " "], "objects": ["unseen"], "summary": ""}',
    '{"entities": {"entity": "Ann", "age": 3}, "people": ["ann", "Bob"], "description": "two people", "setting": "park"}',
    '["red", {"value": "blue"}, "Red", null]',
    '" just text "',
    "no json {",
    None,
]
_payloads = ", ".join("NULL" if p is None else "'" + p.replace("'", "''") + "'" for p in PAYLOADS)
PAYLOAD_SQL = f"SELECT event_id, ([{_payloads}])[event_id % 7 + 1] AS raw FROM events"
#: The strings of one value in DuckDB: itself, an object's names, a list's strings (to the depth that is there).
NAMES_SQL = "list_filter([CASE WHEN json_type({0}, '$.name') = 'VARCHAR' THEN trim({0}->>'name') END, CASE WHEN json_type({0}, '$.label') = 'VARCHAR' THEN trim({0}->>'label') END, CASE WHEN json_type({0}, '$.text') = 'VARCHAR' THEN trim({0}->>'text') END, CASE WHEN json_type({0}, '$.value') = 'VARCHAR' THEN trim({0}->>'value') END, CASE WHEN json_type({0}, '$.entity') = 'VARCHAR' THEN trim({0}->>'entity') END], lambda s: s <> '')"


@query(f"""WITH p AS (SELECT event_id, CASE WHEN json_valid(raw) THEN raw::JSON END AS j FROM ({PAYLOAD_SQL}))
SELECT event_id, coalesce(CASE WHEN json_type(j) = 'OBJECT' THEN json_array_length(json_keys(j)) END, 0)::INT AS n_keys, coalesce(CASE WHEN json_type(j) = 'ARRAY' THEN json_array_length(j) END, 0)::INT AS n_items,
CASE WHEN json_type(j) = 'OBJECT' THEN coalesce(CASE WHEN json_type(j, '$.caption') = 'VARCHAR' THEN nullif(trim(j->>'caption'), '') END, CASE WHEN json_type(j, '$.summary') = 'VARCHAR' THEN nullif(trim(j->>'summary'), '') END, CASE WHEN json_type(j, '$.description') = 'VARCHAR' THEN nullif(trim(j->>'description'), '') END) END AS said FROM p""".replace("json_array_length(json_keys(j))", "len(json_keys(j))"))
def json_values(spark, d):
    e = table(spark, d, "events").select("event_id", _nth(F.col("event_id"), *PAYLOADS).alias("raw"))
    v = P.value(F.col("raw"))
    n_keys = F.coalesce(F.json_object_keys(P.object_text(F.col("raw"))), F.array().cast("array<string>"))
    return e.select("event_id", F.size(n_keys).alias("n_keys"), F.json_array_length(P.list_text(F.col("raw"))).alias("n_items"), P.string_field(v, ["caption", "summary", "description"]).alias("said"))


@query(f"""WITH RECURSIVE p AS (SELECT event_id, CASE WHEN json_valid(raw) THEN raw::JSON END AS j FROM ({PAYLOAD_SQL})),
k(key, rank) AS (VALUES ('detected_objects', 0), ('objects', 1), ('visible_objects', 2), ('people', 3), ('entities', 4), ('text', 5), ('actions', 6), ('setting', 7)),
node AS (SELECT event_id, [rank]::BIGINT[] AS pos, json_extract(j, '$.' || key) AS v FROM p, k WHERE json_type(j) = 'OBJECT'
  UNION ALL SELECT event_id, list_append(pos, i), json_extract(v, '$[' || i || ']') FROM (SELECT event_id, pos, v, unnest(range(json_array_length(v)::BIGINT)) AS i FROM node WHERE json_type(v) = 'ARRAY')),
leaf AS (SELECT event_id, pos, nullif(trim(v->>'$'), '') AS s FROM node WHERE json_type(v) = 'VARCHAR'
  UNION ALL SELECT event_id, list_append(pos, i), s FROM (SELECT event_id, pos, unnest({NAMES_SQL.format('v')}) AS s, generate_subscripts({NAMES_SQL.format('v')}, 1) AS i FROM node WHERE json_type(v) = 'OBJECT')),
one AS (SELECT event_id, arg_min(s, pos) AS s, min(pos) AS pos FROM leaf WHERE s IS NOT NULL GROUP BY event_id, lower(s))
SELECT e.event_id, coalesce(list(s ORDER BY pos) FILTER (s IS NOT NULL), []) AS objects FROM events e LEFT JOIN one USING (event_id) GROUP BY e.event_id""")
def payload_objects(spark, d):
    raw = _nth(F.col("event_id"), *PAYLOADS)
    return table(spark, d, "events").select("event_id", F.coalesce(P.objects(P.value(raw)), F.array().cast("array<string>")).alias("objects"))


@query("""SELECT event_id, ([['car', 'Bike', 'tree', 'sign'], ['Dog', '7'], ['Ann'], ['red', 'blue'], [], [], []])[event_id % 7 + 1] AS labels,
(['A car', 'Dog, dog, 7', 'two people', NULL, 'just text', NULL, NULL])[event_id % 7 + 1] AS caption FROM events""")
def payload_labels(spark, d):
    v = P.value(_nth(F.col("event_id"), *PAYLOADS))
    return table(spark, d, "events").select("event_id", P.labels(v).alias("labels"), P.caption(v).alias("caption"))


@query("""SELECT event_id, ('{"k":' || event_id % 5 || '}') AS answer, ('first part' || chr(10) || 'number ' || event_id) AS said, (['{}', '{"a":1}'])[event_id % 2 + 1] AS other FROM events""")
def model_answers(spark, d):
    n = F.col("event_id")
    fenced = F.concat(F.lit('```json\n{ "k": '), n % 5, F.lit(" }\n```"))
    message = F.concat(F.lit('{"content": [{"type": "text", "text": "first part"}, {"type": "image"}, {"type": "text", "text": "number '), n, F.lit('"}]}'))
    return table(spark, d, "events").select("event_id", P.model_json(fenced).alias("answer"), P.message_text(P.value(message)).alias("said"), P.object_text(_nth(n, "[1]", '{"a": 1}')).alias("other"))


@query("""SELECT o_orderkey, '{"amount":' || l || ',"key":' || o_orderkey || ',"note":null,"status":"' || o_orderstatus || '"}' AS body, sha256('{"amount":' || l || ',"key":' || o_orderkey || ',"note":null,"status":"' || o_orderstatus || '"}') AS hash,
substr(sha256('{"amount":' || l || ',"key":' || o_orderkey || ',"note":null,"status":"' || o_orderstatus || '"}'), 1, 32) AS cache_key FROM (SELECT *, (o_totalprice * 100)::BIGINT AS l FROM orders)""")
def canonical_json(spark, d):
    cols = {"status": F.col("o_orderstatus"), "key": F.col("o_orderkey"), "note": F.lit(None).cast("string"), "amount": F.round(F.col("o_totalprice") * 100).cast("long")}
    return table(spark, d, "orders").select("o_orderkey", P.canonical(cols).alias("body"), P.stable_hash(cols).alias("hash"), F.substring(P.stable_hash(cols), 1, 32).alias("cache_key"))


@query("""SELECT c_custkey, c_nationkey % 2 = 0 AS asked, (['av1', 'h264', 'vp9'])[1 : 1 + c_custkey % 3] AS codecs, least(greatest(c_custkey % 100, 1), 60)::DOUBLE AS seconds, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE (c_custkey % 4 = 1)::VARCHAR END AS meta FROM customer""")
def config_values(spark, d):
    n, k = F.col("c_custkey"), F.col("c_nationkey")
    asked = F.when(k % 4 == 0, "YES ").when(k % 4 == 1, "off").when(k % 4 == 2, "1").otherwise(None)
    codecs = _nth(n, " AV1,", "av1,H264 ,av1", "vp9, h264,,av1")
    return table(spark, d, "customer").select(
        "c_custkey", P.bool_of(asked, False).alias("asked"), P.string_set(codecs).alias("codecs"),
        P.bounded(F.least(F.greatest(n % 100, F.lit(1)), F.lit(60)).cast("double"), 1.0, 0.001, 60, "seconds").alias("seconds"),
        P.metadata_text(F.when(n % 4 > 0, n % 4 == 1)).alias("meta"),
    )


@query("""SELECT s_suppkey, ([['api.API-Key', 'api.nested.password_hash'], ['items[1].sas_token', 'myToken'], [], ['a.b.client_secret']])[s_suppkey % 4 + 1] AS secrets FROM supplier""")
def raw_secrets(spark, d):
    configs = ('{"api": {"API-Key": 1, "api_key_env": "X", "nested": {"password_hash": 2}}}', '{"myToken": "t", "items": [1, {"sas_token": "s"}], "tokens": 3}', '{"model": {"name": "m", "token_count": 4}}', '{"a": {"b": {"client_secret": null}}}')
    return table(spark, d, "supplier").select("s_suppkey", P.secret_paths(_nth(F.col("s_suppkey"), *configs)).alias("secrets"))


@query("""SELECT s_suppkey, '{"model":"m' || s_suppkey || '","rate":0.5}' AS kept, map_from_entries([('a', '1'), ('b', 'new'), ('c', s_suppkey::VARCHAR)]) AS both FROM supplier""".replace("map_from_entries([('a', '1'), ('b', 'new'), ('c', s_suppkey::VARCHAR)]) AS both", "'{\"a\":\"1\",\"b\":\"new\",\"c\":\"' || s_suppkey || '\"}' AS both"))
def projected_configs(spark, d):
    n = F.col("s_suppkey").cast("string")
    config = F.concat(F.lit('{"model": "m'), n, F.lit('", "password": "x", "inner": {"a": 1}, "rate": 0.5}'))
    both = P.merged(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("old")), F.create_map(F.lit("b"), F.lit("new"), F.lit("c"), n))
    kept = P.filtered(config, ["model", "inner", "rate"])
    # numbers stay numbers in the text
    text = F.concat(F.lit('{"model":"'), kept["model"], F.lit('","rate":'), kept["rate"], F.lit("}"))
    return table(spark, d, "supplier").select("s_suppkey", F.when(F.size(kept) == 2, text).alias("kept"), F.to_json(both).alias("both"))


@query("""SELECT p_partkey, p_size, '{"brand":"' || p_brand || '","size":' || p_size || '}' AS thing, ['{"t":"' || p_type || '"}'] AS things, [p_name] AS names FROM part""")
def flat_node_properties(spark, d):
    p = table(spark, d, "part")
    return P.flat_properties(p.select("p_partkey", "p_size", F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")).alias("thing"), F.array(F.struct(F.col("p_type").alias("t"))).alias("things"), F.array("p_name").alias("names")))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 0.3 WHEN 'view' THEN 0.62 WHEN 'purchase' THEN 1.0 ELSE 0.0 END::DOUBLE AS progress, coalesce(CASE WHEN event_id % 3 > 0 THEN value END, CASE WHEN event_id % 2 = 0 THEN 7.0 END, 0)::DOUBLE AS at,
CASE event_type WHEN 'click' THEN 'chapter' WHEN 'view' THEN 'video' WHEN 'purchase' THEN 'frame' ELSE 'unknown' END AS level, CASE event_type WHEN 'click' THEN 'name' WHEN 'view' THEN 'text' ELSE 'description' END AS field FROM events""")
def stage_ladders(spark, d):
    by = lambda **x: F.create_map(*[F.lit(v) for kv in x.items() for v in kv])[F.col("event_type")]
    levels = F.when(F.col("event_type") == "click", F.array(F.lit("Scene"), F.lit("Chapter"))).when(F.col("event_type") == "view", F.array(F.lit("Video"))).when(F.col("event_type") == "purchase", F.array(F.lit("Frame"))).otherwise(F.array(F.lit("Entity")))
    return table(spark, d, "events").select(
        "event_id", P.progress(by(click="extract_audio_assets", view="detect_scenes_and_windows", purchase="publish_outbox")).alias("progress"),
        P.timestamp_of(F.when(F.col("event_id") % 3 > 0, F.col("value")), F.when(F.col("event_id") % 2 == 0, 7.0)).alias("at"), P.level_of(levels).alias("level"), P.text_field(by(click="Entity", view="AudioSegment", purchase="Frame")).alias("field"),
    )


@query("""SELECT conv_id, turn, detail, CASE WHEN detail THEN 2200 WHEN n >= 8 THEN 1600 ELSE 1200 END AS budget FROM (SELECT conv_id, turn, regexp_matches(lower(text), 'exact|specific|detail|timestamp|timecode|quote|verbatim|full|complete|all results|evidence') AS detail,
len(list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda w: regexp_matches(w, '^[a-z0-9]{3,}$') AND w NOT IN ('the', 'and', 'for', 'with', 'this', 'that', 'what', 'when', 'where', 'which', 'who', 'how', 'about', 'video', 'scene', 'please')))) AS n FROM conversations)""")
def memory_budgets(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", X.is_detail_query(F.col("text")).alias("detail"), X.memory_budget(F.col("text")).alias("budget"))


@query("""SELECT p_partkey, p_partkey % 4 > 1 AS valid, length(p_name) > 12 AS rich FROM part""")
def content_checks(spark, d):
    said = F.when(F.col("p_partkey") % 4 == 0, F.concat("p_name", F.lit(" on a Black Screen"))).when(F.col("p_partkey") % 4 == 1, "").otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", X.is_valid_content(said).alias("valid"), (F.length("p_name") > 12).alias("rich"))


@query(r"""WITH w AS (SELECT doc_id, i, regexp_replace(w, '^[.,!?:;()\[\]]+|[.,!?:;()\[\]]+$', '', 'g') AS t FROM (SELECT doc_id, unnest(regexp_split_to_array(trim(text), '\s+')) AS w, generate_subscripts(regexp_split_to_array(trim(text), '\s+'), 1) AS i FROM documents)
WHERE regexp_matches(w, '^\p{Lu}') AND length(w) > 3 AND lower(w) NOT IN ('the', 'this', 'that', 'there', 'here', 'where', 'what', 'which', 'when', 'image', 'video', 'frame')),
f AS (SELECT doc_id, arg_min(t, i) AS t, min(i) AS i FROM w WHERE t <> '' GROUP BY doc_id, lower(t))
SELECT d.doc_id, coalesce(list_slice(list(t ORDER BY i) FILTER (t IS NOT NULL), 1, 10), []) AS topics FROM documents d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id""")
def capitalised_topics(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(X.capitalised_topics(F.col("text")), F.array().cast("array<string>")).alias("topics"))


@query(
    r"""WITH t AS (SELECT 'document' AS kind, doc_id AS id, 0 AS turn, text AS t FROM documents UNION ALL SELECT 'message', conv_id, turn, text || ' [artifact:' || role || '-' || turn || ']' FROM conversations)
SELECT kind, id, turn, list_sort(list_distinct(list_concat(regexp_extract_all(t, '"([^"]+)"', 1), regexp_extract_all(regexp_replace(regexp_replace(t, '[^\x00-\x7F\p{L}\p{M}\p{N}]', '.', 'g'), '[^\x00-\x7F]', '_', 'g'), '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b')))) AS topics, nullif(regexp_extract(t, '\[artifact:([^\]]+)\]', 1), '') AS artifact FROM t"""
)
def message_topics(spark, d):
    """What every document and message names or quotes, and the artifact that it points to.

    The SQL's word boundaries know only ASCII: other letters become underscores there first.
    """
    docs = table(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).alias("turn"), F.col("text").alias("t"))
    said = F.concat("text", F.lit(" [artifact:"), "role", F.lit("-"), "turn", F.lit("]"))
    rows = docs.unionByName(table(spark, d, "conversations").select(F.lit("message").alias("kind"), F.col("conv_id").alias("id"), F.col("turn").cast("int").alias("turn"), said.alias("t")))
    return rows.select("kind", "id", "turn", X.quoted_and_named(F.col("t")).alias("topics"), X.artifact_id(F.col("t")).alias("artifact"))


@query("""SELECT p_partkey, concat_ws(' ', p_name, CASE WHEN NOT contains(lower(p_name), lower(p_brand)) THEN p_brand END, CASE WHEN NOT contains(lower(p_name), 'red') THEN 'red' END, 'unseen', CASE WHEN NOT contains(lower(p_name), lower(p_type)) THEN p_type END) AS query FROM part""")
def expanded_queries(spark, d):
    return table(spark, d, "part").select("p_partkey", X.expand_query(F.col("p_name"), F.array(F.col("p_brand"), F.lit("red"), F.lit("unseen"), F.lit("fourth")), F.array(F.col("p_type"), F.col("p_name"), F.lit("third"))).alias("query"))


@query(
    r"""WITH a AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(trim(text), '^(\d+[.)]|[-*•])\s+', ''), '\*\*', '', 'g'), '\s+', ' ', 'g')) AS c FROM documents),
b AS (SELECT doc_id, CASE WHEN starts_with(c, 'The ') THEN ltrim(substr(c, 5)) ELSE c END AS c FROM a) SELECT doc_id, CASE WHEN starts_with(c, 'De') THEN ltrim(substr(c, 3)) ELSE c END AS clean FROM b"""
)
def cleaned_texts(spark, d):
    """Every document without list marker, bold marks, line breaks and two openings."""
    return table(spark, d, "documents").select("doc_id", X.clean_generated(F.col("text"), ["The ", "De"]).alias("clean"))


@query("""SELECT frame_id, round(least(0.95, 0.45 + CASE WHEN k % 2 = 0 THEN 0.2 ELSE 0 END + CASE WHEN score > 50 THEN 0.15 ELSE 0 END + CASE WHEN kind = 'view' THEN 0.1 ELSE 0 END), 3)::DOUBLE AS confidence, least(1.0, greatest(0.1, k / 10.0))::DOUBLE AS weight,
CASE WHEN score > 70 THEN 'cut' WHEN score > 40 THEN 'dissolve' ELSE 'fade' END AS transition, greatest(0, least(score / 2, greatest(score - 30, 0)))::DOUBLE AS seek, CASE WHEN k > 0 THEN score / k END AS rtf FROM frames""", "frames")
def frame_ladders(spark, d):
    f = V.frames(spark, d)
    return f.select("frame_id", S.scene_confidence(F.col("k") % 2 == 0, F.col("score") > 50, F.col("kind") == "view").alias("confidence"), S.strength_weight(F.col("k")).alias("weight"), S.transition(F.col("score") / 100).alias("transition"), S.decode_seek(F.col("score"), 30).alias("seek"), F.try_divide("score", "k").alias("rtf"))


@query("""SELECT * FROM (WITH RECURSIVE h AS (SELECT video_id, frame_id, frame_id * 40503 AS h, row_number() OVER (PARTITION BY video_id ORDER BY ts_ms, frame_id) AS i FROM frames),
r AS (SELECT video_id, i, frame_id, h AS last, TRUE AS stays FROM h WHERE i = 1
UNION ALL SELECT h.video_id, h.i, h.frame_id, CASE WHEN bit_count(xor(h.h, r.last)) > 12 THEN h.h ELSE r.last END, bit_count(xor(h.h, r.last)) > 12 FROM r JOIN h ON h.video_id = r.video_id AND h.i = r.i + 1)
SELECT frame_id FROM r WHERE stays)""", "frames")
def perceptual_duplicates(spark, d):
    """The frames that differ from the last one left."""
    f = V.frames(spark, d).select("video_id", "ts_ms", "frame_id", (F.col("frame_id") * 40503).alias("hash"))
    return M.distinct_frames(f, "video_id", ["ts_ms", "frame_id"], "hash").select("frame_id")


@query("""SELECT o_orderkey, date_diff('minute', TIMESTAMP '1992-01-01', o_orderdate::TIMESTAMP)::DOUBLE AS minutes, o_orderdate::TIMESTAMP >= TIMESTAMP '1998-08-02' - INTERVAL 4800 HOURS AS recent FROM orders""")
def elapsed_minutes(spark, d):
    at, now = F.col("o_orderdate").cast("timestamp"), F.lit("1998-08-02").cast("timestamp")
    return table(spark, d, "orders").select("o_orderkey", ((F.unix_timestamp(at) - F.unix_timestamp(F.lit("1992-01-01").cast("timestamp"))) / 60).alias("minutes"), (at >= now - F.expr("INTERVAL 4800 HOURS")).alias("recent"))


@query("""SELECT conv_id, turn, CASE WHEN role = 'user' THEN nullif(trim(text), '') END AS caption, CASE WHEN role = 'system' THEN nullif(trim(text), '') END AS ocr_text,
CASE WHEN role = 'assistant' THEN '{"text":' || to_json(text) || ',"turn":' || turn || '}' ELSE '{}' END AS objects_json, '{}' AS regions_json, CASE WHEN role = 'assistant' THEN '{"text":' || to_json(text) || ',"turn":' || turn || '}' ELSE '{}' END AS grounding_json FROM conversations""")
def picture_tasks(spark, d):
    """A turn as what a model of pictures said: by its role a caption, a text in the picture or objects."""
    task = F.when(F.col("role") == "user", "caption").when(F.col("role") == "system", "ocr").when(F.col("role") == "assistant", "object_detection")
    c = table(spark, d, "conversations").withColumn("v", P.value(F.to_json(F.struct("turn", "text"))))
    return c.select("conv_id", "turn", *[x.alias(n) for n, x in P.task_fields(task, F.col("v")).items()])
