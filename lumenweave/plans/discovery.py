"""Queries that find things in videos.

A customer stands for a video of the user that is its nation, an order for a frame,
a part for an entity, and a conversation for what is said in the video of its number.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenweave.operators import discovery as D
from lumenweave.operators import evaluation as E
from lumenweave.operators import nodes as N
from lumenweave.operators import scope as C
from lumenweave.operators import search as R
from lumenweave.operators import tables as B
from lumenweave.plans import views as V
from lumenweave.plans.registry import query
from lumenweave.session import new_path, table

MEDIA = "media AS (SELECT c_custkey AS video_id, c_nationkey AS user_id, c_name AS title, c_acctbal > 0 AS processed, abs(c_acctbal)::DOUBLE AS duration FROM customer)"
SHOTS = "shots AS (SELECT o_orderkey AS frame_id, o_custkey AS video_id, (o_orderkey % 1000)::DOUBLE / 8 AS ts, o_orderpriority || ' ' || o_orderstatus AS description FROM orders)"
HELD = "held AS (SELECT DISTINCT l_orderkey AS frame_id, l_partkey AS entity_id FROM lineitem)"
THINGS = "things AS (SELECT p_partkey AS entity_id, p_name AS name, p_brand AS type, p_size AS video_id FROM part)"
SAID = "said AS (SELECT conv_id AS video_id, turn AS idx, turn * 10000 AS start_ms, turn * 10000 + 8000 AS end_ms, role, text FROM conversations)"


def media(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("video_id"), F.col("c_nationkey").alias("user_id"), F.col("c_name").alias("title"), (F.col("c_acctbal") > 0).alias("processed"), F.abs("c_acctbal").alias("duration"))


def shots(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("frame_id"), F.col("o_custkey").alias("video_id"), ((F.col("o_orderkey") % 1000).cast("double") / 8).alias("ts"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("description"))


def things(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("type"), F.col("p_size").alias("video_id"))


# scope


@query(f"WITH {MEDIA} SELECT 'user' AS way, video_id FROM media WHERE user_id = 7 UNION ALL SELECT 'list', video_id FROM media WHERE user_id = 7 AND video_id IN (7, 32, 57, 5) UNION ALL SELECT 'one', video_id FROM media WHERE video_id = 12")
def tenant_scope(spark, d):
    m = media(spark, d)
    ways = {"user": C.scope(m, 7), "list": C.scope(m, 7, [7, 32, 57, 5], 12), "one": C.scope(m, video=12), "nothing": C.scope(m, 7, []), "range": C.scope(m, 7).where(F.lit(C.time_range(1, None) is not None))}
    out = None
    for way, rows in ways.items():
        part = rows.select(F.lit(way).alias("way"), "video_id")
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT o_orderkey AS src, l_partkey AS dst FROM (SELECT DISTINCT o_orderkey, l_partkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE c_nationkey % 5 = 2 AND p_size % 5 = 2)""")
def tenant_paths(spark, d):
    """Edges that may be walked by user 2: both a frame and its entity have to be theirs."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    nodes = o.select(F.concat(F.lit("o"), "o_orderkey").alias("node"), (F.col("c_nationkey") % 5).alias("user_id")).unionByName(table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("node"), (F.col("p_size") % 5).alias("user_id")))
    edges = V.contains(spark, d).select(F.concat(F.lit("o"), "frame_id").alias("src"), F.concat(F.lit("p"), "entity_id").alias("dst"))
    return C.scoped_edges(edges, nodes, 2).select(F.substring("src", 2, 20).cast("long").alias("src"), F.substring("dst", 2, 20).cast("long").alias("dst"))


@query(f"WITH {SHOTS} SELECT frame_id, ts >= 20 AS from_, ts <= 90 AS until FROM shots WHERE ts >= 20 OR ts <= 90")
def open_time_bounds(spark, d):
    s = shots(spark, d)
    a, b = C.time_bounds(s, "ts", lo=20).select("frame_id", F.lit(True).alias("from_")), C.time_bounds(s, "ts", hi=90).select("frame_id", F.lit(True).alias("until"))
    return a.join(b, "frame_id", "full").select("frame_id", F.coalesce("from_", F.lit(False)).alias("from_"), F.coalesce("until", F.lit(False)).alias("until"))


@query(f"WITH {THINGS} SELECT type, count(*) AS n, count(*) FILTER (type IN ('Brand#11', 'Brand#12')) AS some FROM things GROUP BY type")
def kinds_or_any(spark, d):
    t = things(spark, d)
    some = C.kinds(t, ["Brand#11", "Brand#12"]).groupBy("type").agg(F.count("*").alias("some"))
    return C.kinds(t, ["any", "Brand#11"]).groupBy("type").agg(F.count("*").alias("n")).join(some, "type", "left").select("type", "n", F.coalesce("some", F.lit(0)).alias("some"))


# full text


def _bm25_sql(rows: str, node: str, text: str, terms: list[str]) -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""tok AS (SELECT {node} AS node, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS term FROM {rows}), leng AS (SELECT {node} AS node, len(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS l FROM {rows}),
tf AS (SELECT node, term, count(*) AS tf FROM tok WHERE term IN ({listed}) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), tot AS (SELECT count(*) AS n, avg(l) AS a FROM leng),
bm AS (SELECT node, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))) AS score FROM tf JOIN df USING (term) JOIN leng USING (node), tot GROUP BY node)"""


@query(f"WITH {THINGS}, few AS (SELECT * FROM things WHERE type IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21')), {_bm25_sql('few', 'entity_id', 'name', ['cold', 'widget', 'rod'])} SELECT node AS entity_id, round(score, 6) AS score FROM bm ORDER BY score DESC, node LIMIT 20")
def search_entities(spark, d):
    some = C.kinds(things(spark, d), ["Brand#11", "Brand#12", "Brand#13", "Brand#21"])
    return D.text_search(some, ["cold", "widget", "rod"], "entity_id", "name", 20).select("entity_id", F.round("score", 6).alias("score"))


@query(f"WITH {SHOTS}, few AS (SELECT * FROM shots WHERE ts BETWEEN 10 AND 100), {_bm25_sql('few', 'frame_id', 'description', ['urgent', 'f'])} SELECT node AS frame_id, round(score, 6) AS score FROM bm ORDER BY score DESC, node LIMIT 20")
def search_frames(spark, d):
    some = C.time_bounds(shots(spark, d), "ts", 10, 100)
    return D.text_search(some, ["urgent", "f"], "frame_id", "description", 20).select("frame_id", F.round("score", 6).alias("score"))


@query(f"WITH {SAID} SELECT video_id, idx FROM said WHERE contains(lower(text), 'and') ORDER BY start_ms, video_id, idx LIMIT 20")
def search_transcripts(spark, d):
    return D.transcript_search(V.segments(spark, d), "AND", 20, ["start_ms", "video_id", "idx"]).select("video_id", "idx")


@query(f"""WITH {SHOTS}, {SAID} (SELECT 'visual' AS source, frame_id::VARCHAR AS node, ts AS at FROM shots WHERE contains(lower(description), 'urgent') OR contains(lower(description), 'and') ORDER BY ts, frame_id LIMIT 15)
UNION ALL (SELECT 'audio', (video_id * 1000 + idx)::VARCHAR, start_ms / 1000.0::DOUBLE FROM said WHERE contains(lower(text), 'urgent') OR contains(lower(text), 'and') ORDER BY start_ms, video_id * 1000 + idx LIMIT 15)""")
def search_multimodal(spark, d):
    audio = V.segments(spark, d).select((F.col("video_id") * 1000 + F.col("idx")).alias("node"), F.col("text"), (F.col("start_ms") / 1000).alias("at"))
    visual = shots(spark, d).select(F.col("frame_id").alias("node"), F.col("description").alias("text"), F.col("ts").alias("at"))
    return D.multimodal_search({"audio": audio, "visual": visual}, ["urgent", "and"], "node", "text", "at", 15)


@query(f"""WITH {THINGS}, c AS (SELECT type AS community, count(*) AS members, string_agg(name, ' ' ORDER BY entity_id) AS themes FROM things GROUP BY type), {_bm25_sql('c', 'community', 'themes', ['cold', 'bolt', 'rod'])}
SELECT 'topic' AS way, node AS community, round(score, 6) AS score FROM (SELECT * FROM bm ORDER BY score DESC, node LIMIT 4) UNION ALL SELECT 'all', community, 1.0 FROM (SELECT * FROM c ORDER BY members DESC, community LIMIT 4)""")
def community_context(spark, d):
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entity_id", "name"))), lambda s: s["name"]), " ")
    c = things(spark, d).groupBy(F.col("type").alias("community")).agg(F.count("*").alias("members"), words.alias("themes"))
    by = D.text_search(c, ["cold", "bolt", "rod"], "community", "themes", 4).select(F.lit("topic").alias("way"), "community", F.round("score", 6).alias("score"))
    return by.unionByName(c.orderBy(F.desc("members"), "community").limit(4).select(F.lit("all").alias("way"), "community", F.lit(1.0).alias("score")))


# entities and moments


@query(f"WITH {SHOTS}, {HELD} SELECT entity_id, video_id, count(*) AS n, min(ts) AS first, max(ts) AS last, list_slice(list(ts ORDER BY ts), 1, 10) AS times FROM held JOIN shots USING (frame_id) WHERE entity_id % 20 = 0 GROUP BY ALL")
def entity_timeline(spark, d):
    return D.entity_timeline(V.contains(spark, d), shots(spark, d), things(spark, d).where("entity_id % 20 = 0"))


@query(f"WITH {SHOTS}, {HELD}, {THINGS}, {SAID} SELECT 'visual' AS section, s.video_id, ts AS at, name AS what FROM held JOIN things USING (entity_id) JOIN shots s USING (frame_id) WHERE contains(lower(name), 'bolt') UNION ALL SELECT 'audio', video_id, start_ms / 1000.0::DOUBLE, text FROM said WHERE contains(lower(text), 'bolt')")
def entity_appearances(spark, d):
    return D.appearances(V.contains(spark, d), shots(spark, d), things(spark, d).drop("video_id"), V.segments(spark, d), "BOLT")


@query(f"""WITH {SHOTS}, {HELD}, r AS (SELECT video_id, round_even(ts, 1) AS m, entity_id, ts FROM held JOIN shots USING (frame_id)) SELECT video_id, entity_id, ts FROM r QUALIFY row_number() OVER (PARTITION BY video_id, m ORDER BY ts, entity_id) = 1""")
def moments_once(spark, d):
    rows = V.contains(spark, d).join(shots(spark, d), "frame_id")
    return D.one_a_moment(rows, "video_id", "ts", [F.col("ts"), F.col("entity_id")]).select("video_id", "entity_id", "ts")


@query(f"WITH {THINGS} SELECT entity_id, type FROM things t WHERE EXISTS (SELECT 1 FROM things w WHERE w.entity_id % 20 = 0 AND lower(trim(w.name)) = lower(trim(t.name)) AND (w.entity_id % 40 = 0 OR w.type = t.type))")
def entity_by_name(spark, d):
    """Every twentieth entity is asked for by its name, every second of them with its kind."""
    t = things(spark, d)
    wanted = t.where("entity_id % 20 = 0").select(F.concat(F.lit("  "), F.upper("name"), F.lit(" ")).alias("name"), F.when(F.col("entity_id") % 40 != 0, F.col("type")).alias("type"))
    return D.by_name(t, wanted).select("entity_id", "type")


@query(f"WITH {SHOTS}, {HELD}, {THINGS} SELECT type, name, count(*) AS n, list_slice(list(frame_id ORDER BY ts, frame_id), 1, 8) AS frames FROM held JOIN things USING (entity_id) JOIN (SELECT frame_id, ts FROM shots) USING (frame_id) GROUP BY type, name")
def entity_evidence(spark, d):
    rows = V.contains(spark, d).join(things(spark, d).drop("video_id"), "entity_id").join(shots(spark, d), "frame_id")
    return D.evidence(rows, ["type", "name"], "frame_id", "ts")


@query(f"""WITH {SHOTS}, v AS (SELECT DISTINCT video_id FROM shots), s AS (SELECT video_id, n * 25.0::DOUBLE AS lo, n * 25.0::DOUBLE + 20 AS hi FROM v, (SELECT unnest(range(5)) AS n))
SELECT s.video_id, lo, hi, arg_max(description, struct_pack(l := length(description), t := -ts, d := description)) AS description FROM s LEFT JOIN shots f ON f.video_id = s.video_id AND f.ts BETWEEN lo AND hi GROUP BY s.video_id, lo, hi""")
def scene_descriptions(spark, d):
    s = shots(spark, d)
    spans = s.select("video_id").distinct().withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(4)))).select("video_id", (F.col("n") * 25).cast("double").alias("lo"), (F.col("n") * 25 + 20).cast("double").alias("hi"))
    return D.longest_in(spans, s, "video_id", "lo", "hi", "ts", "description")


@query("""SELECT 'l' || l_orderkey || '-' || l_linenumber AS node, o_custkey AS video FROM lineitem JOIN orders ON o_orderkey = l_orderkey UNION SELECT 'c' || c_custkey, c_custkey FROM customer UNION SELECT 'p' || p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size END FROM part""")
def node_owners(spark, d):
    li, c, p = table(spark, d, "lineitem"), table(spark, d, "customer"), table(spark, d, "part")
    name = lambda x, k: F.concat(F.lit(x), F.col(k).cast("string"))
    line = F.concat(F.lit("l"), "l_orderkey", F.lit("-"), "l_linenumber")
    none = F.lit(None).cast("long")
    nodes = li.select(line.alias("node"), none.alias("video")).union(c.select(name("c", "c_custkey"), F.col("c_custkey"))).union(p.select(name("p", "p_partkey"), none))
    parents = li.select(line.alias("child"), name("o", "l_orderkey").alias("parent")).union(table(spark, d, "orders").select(name("o", "o_orderkey"), name("c", "o_custkey")))
    about = p.where("p_partkey % 2 = 0").select(name("p", "p_partkey").alias("node"), F.col("p_size").cast("long").alias("video"))
    return D.owners(nodes, parents, about, hops=2)


@query(f"WITH {MEDIA}, {SHOTS} SELECT frame_id, coalesce(title, 'Untitled') AS title FROM shots LEFT JOIN (SELECT * FROM media WHERE processed) USING (video_id)")
def owner_titles(spark, d):
    m = media(spark, d).where("processed").select("video_id", "title")
    return shots(spark, d).join(m, "video_id", "left").select("frame_id", F.coalesce("title", F.lit("Untitled")).alias("title"))


@query(f"""WITH {SHOTS}, r AS (SELECT video_id, frame_id, CASE WHEN frame_id % 7 > 0 THEN floor(ts / 30) END AS scene, coalesce(CASE WHEN frame_id % 3 = 0 THEN ts / 200 END, ts / 100) AS s FROM shots WHERE video_id % 3 = 0)
SELECT video_id * 100 + scene::BIGINT AS scene, max(s) AS best_score, count(*) AS n, list_slice(list(frame_id ORDER BY s DESC, frame_id), 1, 100) AS ids FROM r WHERE scene IS NOT NULL GROUP BY 1""".replace(" WHERE video_id % 3 = 0", ""))
def grouped_by_scene(spark, d):
    s = shots(spark, d)
    rows = s.withColumn("scene", F.when(F.col("frame_id") % 7 > 0, F.col("video_id") * 100 + F.floor(F.col("ts") / 30)))
    return D.grouped_by_scene(rows, "scene", "frame_id", F.coalesce(F.when(F.col("frame_id") % 3 == 0, F.col("ts") / 200), F.col("ts") / 100))


@query(f"WITH {THINGS}, t AS (SELECT * FROM (VALUES ('rod', ['xx']), ('Large Widget Set', ['cold']), ('nothing', ['77', '#'])) v(topic, kw), (SELECT DISTINCT video_id FROM things) g) SELECT DISTINCT entity_id, topic FROM things JOIN t USING (video_id) WHERE contains(lower(name), lower(topic)) OR contains(lower(topic), lower(name)) OR len(list_filter(kw, lambda k: contains(lower(name), k))) > 0")
def topic_links(spark, d):
    t = things(spark, d)
    topics = F.array(*[F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, kw)).alias("keywords")) for n, kw in (("rod", ["xx"]), ("Large Widget Set", ["COLD"]), ("nothing", ["77", "#"]))])
    per = t.select("video_id").distinct().select("video_id", F.explode(topics).alias("t")).select("video_id", "t.name", "t.keywords")
    return D.topic_links(t, per)


@query(f"""WITH {HELD}, n AS (SELECT frame_id, entity_id, lower(p_name) AS name FROM held JOIN part ON p_partkey = entity_id),
s AS (SELECT a.l_orderkey AS frame_id, lower(p.p_name) AS source, lower(q.p_name) AS target, CASE WHEN a.l_quantity > 25 THEN 'CAUSES' ELSE 'RELATES_TO' END AS type, a.l_discount AS weight FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 JOIN part p ON p.p_partkey = a.l_partkey JOIN part q ON q.p_partkey = b.l_partkey)
SELECT x.entity_id AS src, y.entity_id AS dst, type, count(*) AS evidence, max(weight) AS weight FROM s JOIN n x ON x.frame_id = s.frame_id AND x.name = source JOIN n y ON y.frame_id = s.frame_id AND y.name = target WHERE x.entity_id <> y.entity_id GROUP BY ALL""")
def semantic_relations(spark, d):
    li, p = table(spark, d, "lineitem"), table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_name")
    a = li.join(p, F.col("l_partkey") == F.col("k")).select(F.col("l_orderkey").alias("frame_id"), F.col("l_linenumber").alias("n"), F.upper("p_name").alias("source"), F.when(F.col("l_quantity") > 25, "CAUSES").otherwise("RELATES_TO").alias("type"), F.col("l_discount").alias("weight"))
    b = li.join(p, F.col("l_partkey") == F.col("k")).select(F.col("l_orderkey").alias("frame_id"), (F.col("l_linenumber") - 1).alias("n"), F.col("p_name").alias("target"))
    return D.relations(a.join(b, ["frame_id", "n"]), V.contains(spark, d), things(spark, d))


@query(f"""WITH {SAID}, f AS (SELECT user_id AS video_id, event_id AS frame_id, (event_id * 37 % 80000)::BIGINT AS ts_ms FROM events), t AS (SELECT DISTINCT video_id, t_ms FROM said, (SELECT unnest([5000, 31000, 60000]) AS t_ms) WHERE video_id % 20 = 0),
n AS (SELECT t.video_id, t_ms, frame_id FROM t JOIN f USING (video_id) WHERE abs(ts_ms - t_ms) <= 5000 QUALIFY row_number() OVER (PARTITION BY t.video_id, t_ms ORDER BY abs(ts_ms - t_ms), ts_ms, frame_id) = 1),
s AS (SELECT DISTINCT t.video_id, t_ms, start_ms, text FROM t JOIN said USING (video_id) WHERE start_ms <= t_ms + 5000 AND end_ms >= t_ms - 5000), k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY video_id, t_ms ORDER BY start_ms, text) <= 5)
SELECT t.video_id, t.t_ms, any_value(n.frame_id) AS near_id, list(text ORDER BY start_ms, text) FILTER (text IS NOT NULL) AS said FROM t LEFT JOIN n ON n.video_id = t.video_id AND n.t_ms = t.t_ms LEFT JOIN k ON k.video_id = t.video_id AND k.t_ms = t.t_ms GROUP BY t.video_id, t.t_ms""")
def compare_moments(spark, d):
    """Every twentieth video at three moments."""
    s = V.segments(spark, d)
    t = s.where("video_id % 20 = 0").select("video_id").distinct().select("video_id", F.explode(F.array(*[F.lit(x).cast("long") for x in (5000, 31000, 60000)])).alias("t_ms"))
    f = table(spark, d, "events").select(F.col("user_id").alias("video_id"), F.col("event_id").alias("frame_id"), (F.col("event_id") * 37 % 80000).alias("ts_ms"))
    return D.context_at(t, f, s, 5000)


# vectors


DOT = "list_sum(list_transform(range(1, 65), lambda i: {0}[i]::DOUBLE * {1}[i]::DOUBLE))"
COS = f"({DOT.format('{0}', '{1}')} / (sqrt({DOT.format('{0}', '{0}')}) * sqrt({DOT.format('{1}', '{1}')})))"


@query(f"""WITH q AS (SELECT vec_id AS query, embedding AS q FROM embeddings WHERE vec_id % 20 = 0), a AS (SELECT query, vec_id AS top, {COS.format('embedding', 'q')} AS s FROM q, embeddings WHERE vec_id < 10 QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, top) <= 3),
b AS (SELECT a.query, top, vec_id AS mid, {COS.format('embedding', 'q.q')} AS sb FROM a JOIN q ON q.query = a.query JOIN embeddings ON vec_id % 10 = top AND vec_id BETWEEN 10 AND 99 QUALIFY row_number() OVER (PARTITION BY a.query, top ORDER BY sb DESC, mid) <= 3),
c AS (SELECT b.query, top, mid, vec_id AS leaf, {COS.format('embedding', 'q.q')} AS sc FROM b JOIN q ON q.query = b.query JOIN embeddings ON vec_id % 90 + 10 = mid AND vec_id >= 100 QUALIFY row_number() OVER (PARTITION BY b.query, top, mid ORDER BY sc DESC, leaf) <= 3)
SELECT query, [top, mid, leaf] AS path, round(sc, 6) AS score FROM c""")
def drill_down(spark, d):
    """Videos, chapters and scenes are the vectors up to 9, up to 99 and beyond."""
    n = V.vectors(spark, d).select(F.col("node_id").alias("node"), "v")
    levels = [n.where("node < 10"), n.where("node BETWEEN 10 AND 99"), n.where("node >= 100")]
    edges = levels[1].select((F.col("node") % 10).alias("src"), F.col("node").alias("dst")).union(levels[2].select((F.col("node") % 90 + 10).alias("src"), F.col("node").alias("dst")))
    queries = n.where("node % 20 = 0").select(F.col("node").alias("query"), F.col("v").alias("q"))
    return R.drill_down(queries, levels, edges, 3).select("query", "path", F.round("score", 6).alias("score"))


@query("SELECT video_id, node_id FROM vectors QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY node_id) <= 4", "vectors")
def fallback_search(spark, d):
    """Where there is no score, the first few of each label."""
    return R.per_group(V.vectors(spark, d), "video_id", [F.col("node_id")], 4).select("video_id", "node_id")


@query("SELECT doc_id FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE vec_id IS NULL AND text IS NOT NULL")
def missing_embeddings(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").join(table(spark, d, "embeddings"), F.col("doc_id") == F.col("vec_id"), "left_anti").select("doc_id")


# a library


@query(f"WITH {MEDIA} SELECT user_id, count(*) AS n, count(*) FILTER (processed) AS done, round(sum(duration), 2) AS seconds, max(title) FILTER (processed) AS latest FROM media GROUP BY user_id")
def library_rollup(spark, d):
    return media(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("processed").alias("done"), F.round(F.sum("duration"), 2).alias("seconds"), F.max(F.when(F.col("processed"), F.col("title"))).alias("latest"))


@query(f"WITH {THINGS}, f AS (SELECT video_id, type, min(entity_id) AS i FROM things GROUP BY ALL) SELECT video_id, list_slice(list(type ORDER BY i), 1, 30) AS topics FROM f GROUP BY video_id")
def library_topics(spark, d):
    f = things(spark, d).groupBy("video_id", "type").agg(F.min("entity_id").alias("i"))
    ranked = R.per_group(f, "video_id", [F.col("i")], 30)
    return ranked.groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "type"))), lambda s: s["type"]).alias("topics"))


@query(f"""WITH {HELD}, n AS (SELECT 'Frame' AS label, o_orderkey AS node FROM orders UNION ALL SELECT 'Entity', p_partkey FROM part UNION ALL SELECT 'Video', c_custkey FROM customer),
e AS (SELECT 'CONTAINS' AS rel_type FROM held UNION ALL SELECT 'HAS_FRAME' FROM orders), s AS (SELECT 'label' AS what, label AS name, count(*) AS n FROM n GROUP BY label UNION ALL SELECT 'relation', rel_type, count(*) FROM e GROUP BY rel_type)
SELECT * FROM s UNION ALL SELECT what, 'all', sum(n)::BIGINT FROM s GROUP BY what""")
def graph_stats(spark, d):
    label = lambda t, k, name: table(spark, d, t).select(F.lit(name).alias("label"), F.col(k).alias("node"))
    nodes = label("orders", "o_orderkey", "Frame").union(label("part", "p_partkey", "Entity")).union(label("customer", "c_custkey", "Video"))
    edges = V.contains(spark, d).select(F.lit("CONTAINS").alias("rel_type")).union(table(spark, d, "orders").select(F.lit("HAS_FRAME")))
    return D.graph_stats(nodes, edges)


@query("SELECT p_brand, p_type FROM (SELECT p_brand, p_type, list_sort(list(DISTINCT p_size % 4)) AS m FROM part GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY m ORDER BY p_brand, p_type) = 1")
def distinct_communities(spark, d):
    c = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.collect_set(F.col("p_size") % 4).alias("members"))
    return D.distinct_sets(c, "members", ["p_brand", "p_type"]).select("p_brand", "p_type")


@query("""SELECT name FROM (SELECT p_name || ' ' AS name, lower(trim(p_name)) AS low FROM part WHERE p_size > 10) WHERE low NOT IN (SELECT lower(trim(p_name)) FROM part WHERE p_size <= 10) QUALIFY row_number() OVER (PARTITION BY low ORDER BY name) = 1""")
def new_entities(spark, d):
    p = table(spark, d, "part")
    return D.unseen(p.where("p_size > 10").select(F.concat("p_name", F.lit(" ")).alias("name")), p.where("p_size <= 10").select(F.upper("p_name").alias("name")), "name").select("name")


@query("SELECT c_nationkey AS owner, 'customer' AS part FROM customer UNION SELECT s_nationkey, 'supplier' FROM supplier UNION SELECT n_nationkey, 'customer' FROM nation")
def owner_union(spark, d):
    part = lambda t, k, name: table(spark, d, t).select(F.col(k).alias("owner"), F.lit(name).alias("part"))
    return part("customer", "c_nationkey", "customer").union(part("supplier", "s_nationkey", "supplier")).union(part("nation", "n_nationkey", "customer")).distinct()


@query("SELECT p_partkey, list_sort(list_distinct(list_concat([p_brand, p_type], [p_type, p_name]))) AS elements FROM part")
def merged_elements(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_sort(F.array_union(F.array("p_brand", "p_type"), F.array("p_type", "p_name"))).alias("elements"))


@query("SELECT o_orderpriority, sum(l_quantity)::BIGINT AS tokens, bool_or(l_discount > 0.09) AS any_discount FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def token_sums(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("o_orderpriority").agg(F.sum("l_quantity").cast("long").alias("tokens"), F.bool_or(F.col("l_discount") > 0.09).alias("any_discount"))


# evaluation


@query("SELECT c_mktsegment AS bucket, count(*) AS n, avg((c_custkey % 3 = 0)::INT)::DOUBLE AS accuracy FROM customer WHERE c_custkey % 5 > 0 GROUP BY 1")
def bucket_accuracy(spark, d):
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("bucket"), F.when(F.col("c_custkey") % 5 > 0, (F.col("c_custkey") % 3 == 0).cast("double")).alias("score"))
    return E.bucket_accuracy(c, "bucket", "score")


@query("""SELECT event_id, ((CASE WHEN m * 60 + 5 BETWEEN 600 AND 1800 THEN 1 ELSE 0 END) + (CASE WHEN event_id % 2 = 0 AND m * 100 / 25.0 BETWEEN 600 AND 1800 THEN 1 ELSE 0 END)) / 2.0::DOUBLE AS inside FROM (SELECT event_id, event_id % 60 AS m FROM events)""")
def fraction_in_window(spark, d):
    m = F.col("event_id") % 60
    cited = E.citations(F.concat(F.lit("at ["), m, F.lit(":05], frame "), m * 100))
    return table(spark, d, "events").select("event_id", E.fraction_in_window(cited, F.lit(600), F.lit(1800), F.when(F.col("event_id") % 2 == 0, 25.0)).alias("inside"))


# nodes


CREATED_SQL = f"""{SHOTS}, {HELD}, v AS (SELECT c_custkey::VARCHAR AS video_id, c_nationkey::VARCHAR AS user_id FROM customer WHERE c_acctbal > 0),
made AS (SELECT 'f' || frame_id AS id, s.video_id::VARCHAR AS video_id, coalesce(CASE WHEN description LIKE '1-%' THEN 'own' END, v.user_id) AS user_id, ts AS timestamp, frame_id AS frame_number, description, TIMESTAMP '2024-01-01' AS created_at FROM shots s JOIN v ON v.video_id = s.video_id::VARCHAR)"""


def _created(spark, d):
    """Frames of the videos that are there, in two overlapping batches, and which frames show which entities."""
    nodes, edges = new_path(spark, "nodes"), new_path(spark, "edges")
    videos = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("video_id"), F.col("c_nationkey").alias("user_id"))
    s = shots(spark, d)
    rows = s.select(F.concat(F.lit("f"), "frame_id").alias("id"), "video_id", F.when(F.startswith("description", F.lit("1-")), "own").alias("user_id"), F.col("ts").alias("timestamp"), F.col("frame_id").alias("frame_number"), "description", F.lit(0).alias("unknown"))
    at = F.lit("2024-01-01").cast("timestamp")
    for batch in (rows.where("ts < 80"), rows):
        N.create_nodes(batch, videos, "Frame", nodes, edges, at)
    shows = V.contains(spark, d).select(F.concat(F.lit("f"), "frame_id").alias("src"), F.concat(F.lit("e"), "entity_id").alias("dst"))
    ids = B.read(spark, nodes).select("id").union(things(spark, d).select(F.concat(F.lit("e"), "entity_id")))
    N.create_relationships(shows, ids, edges, "SHOWS")
    return nodes, edges


@query(f"WITH {CREATED_SQL} SELECT id, video_id, user_id, timestamp, frame_number, description FROM made")
def created_nodes(spark, d):
    return B.read(spark, _created(spark, d)[0]).select("id", "video_id", "user_id", "timestamp", "frame_number", "description")


@query(f"WITH {CREATED_SQL} SELECT video_id AS src, id AS dst, 'CONTAINS' AS rel_type FROM made UNION ALL SELECT 'f' || frame_id, 'e' || entity_id, 'SHOWS' FROM held WHERE 'f' || frame_id IN (SELECT id FROM made) AND entity_id IN (SELECT p_partkey FROM part)")
def created_relationships(spark, d):
    return B.read(spark, _created(spark, d)[1])
