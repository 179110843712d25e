"""Finding things in videos: entities and where they appear, moments, scenes, and what a library holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenweave.operators.search import bm25, per_group


def text_search(rows: DataFrame, query: list[str], node: str, text: str, k: int) -> DataFrame:
    """``rows`` with ``score``: the best ``k`` by full text; the statistics are those of the rows given."""
    return rows.join(bm25(rows, query, node, text), node).orderBy(F.desc("score"), node).limit(k)


def transcript_search(segments: DataFrame, said: str, k: int, order: list[str]) -> DataFrame:
    """The first ``k`` segments in order whose text contains what was said, whatever the case."""
    return segments.where(F.contains(F.lower("text"), F.lit(said.lower()))).orderBy(*order).limit(k)


def multimodal_search(parts: dict[str, DataFrame], words: list[str], node: str, text: str, at: str, k: int) -> DataFrame:
    """``source, node, at``: what contains any of the words, of each source its first ``k`` in order of time."""
    out = None
    for name, rows in sorted(parts.items()):
        hit = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(text), w))
        some = rows.where(hit).orderBy(at, node).limit(k).select(F.lit(name).alias("source"), F.col(node).cast("string").alias("node"), F.col(at).alias("at"))
        out = some if out is None else out.unionByName(some)
    return out


def entity_timeline(contains: DataFrame, frames: DataFrame, entities: DataFrame, frame: str = "frame_id", entity: str = "entity_id", at: str = "ts") -> DataFrame:
    """``entity, video, n, first, last, times``: where an entity is to be seen in each video, with its first ten times."""
    seen = contains.join(entities.select(entity), entity, "left_semi").join(frames.select(frame, "video_id", at), frame)
    ranked = seen.withColumn("_n", F.row_number().over(Window.partitionBy(entity, "video_id").orderBy(at, frame)))
    return ranked.groupBy(entity, "video_id").agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"), F.array_sort(F.collect_list(F.when(F.col("_n") <= 10, F.col(at)))).alias("times"))


def appearances(contains: DataFrame, frames: DataFrame, entities: DataFrame, segments: DataFrame, name: str) -> DataFrame:
    """``section, video_id, at, what``: frames whose entities contain the name, and segments whose text does."""
    low = F.lit(name.lower())
    found = entities.where(F.contains(F.lower("name"), low)).select("entity_id", F.col("name").alias("what"))
    visual = contains.join(found, "entity_id").join(frames, "frame_id").select(F.lit("visual").alias("section"), "video_id", F.col("ts").cast("double").alias("at"), "what")
    audio = segments.where(F.contains(F.lower("text"), low)).select(F.lit("audio").alias("section"), "video_id", (F.col("start_ms") / 1000).alias("at"), F.col("text").alias("what"))
    return visual.unionByName(audio)


def one_a_moment(rows: DataFrame, key: str, at: str, order: list[Column], digits: int = 1) -> DataFrame:
    """The first row of each moment, times rounded half to even."""
    moment = F.bround(at, digits)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key, moment).orderBy(*order))).where("_n = 1").drop("_n")


def by_name(entities: DataFrame, wanted: DataFrame) -> DataFrame:
    """Entities of the very names in ``wanted`` (name, type), whatever the case, of one kind where it says one; each once."""
    asked = wanted.select(F.lower(F.trim("name")).alias("_name"), F.col("type").alias("_type")).distinct()
    same = (F.lower(F.trim("name")) == F.col("_name")) & (F.col("_type").isNull() | (F.col("type") == F.col("_type")))
    return entities.join(asked, same, "left_semi")


def evidence(mentions: DataFrame, keys: list[str], frame: str, at: str, k: int = 8) -> DataFrame:
    """Of each key the first ``k`` frames, as a list, and how many there are."""
    ranked = mentions.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(at, frame)))
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.when(F.col("_n") <= k, F.struct(at, frame)))), lambda s: s[frame]).alias("frames"))


def longest_in(spans: DataFrame, frames: DataFrame, key: str, lo: str, hi: str, at: str, text: str) -> DataFrame:
    """Of each span the longest text of the frames within it; the first of those that are equally long. Null without a frame.

    Spans of a video must not overlap: a frame is then in the last span that began before it.
    """
    marks = spans.select(key, F.col(lo).alias("_at"), F.lit(0).alias("_k"), F.struct(lo, hi).alias("_span"), F.lit(None).cast("string").alias("_text"))
    points = frames.select(key, F.col(at).alias("_at"), F.lit(1).alias("_k"), F.lit(None).cast(f"struct<{lo}: double, {hi}: double>").alias("_span"), F.col(text).alias("_text"))
    marks = marks.withColumn("_span", F.col("_span").cast(f"struct<{lo}: double, {hi}: double>"))
    held = marks.unionByName(points).withColumn("_in", F.last("_span", ignorenulls=True).over(Window.partitionBy(key).orderBy("_at", "_k").rowsBetween(Window.unboundedPreceding, 0)))
    inside = held.where((F.col("_k") == 1) & (F.col("_at") <= F.col(f"_in.{hi}")) & F.col("_text").isNotNull())
    best = inside.groupBy(key, F.col(f"_in.{lo}").alias(lo)).agg(F.max_by("_text", F.struct(F.length("_text"), -F.col("_at"), "_text")).alias("description"))
    return spans.join(best, [key, lo], "left")


def owners(nodes: DataFrame, parents: DataFrame, about: DataFrame, hops: int = 5) -> DataFrame:
    """``node, video``: its own video, or the one up the tree within ``hops``, or the one that is about it.

    ``nodes`` has node and video (may be null), ``parents`` child and parent, ``about`` node and video.
    """
    known = nodes.where("video IS NOT NULL").select(F.col("node").alias("_k"), F.col("video").alias("_v"))
    at = nodes.select("node", "video", F.col("node").alias("_at"))
    for _ in range(hops):
        up = parents.select(F.col("child").alias("_c"), F.col("parent").alias("_p"))
        at = at.join(up, F.col("_at") == F.col("_c"), "left").select("node", "video", F.coalesce("_p", "_at").alias("_at"))
        at = at.join(known, F.col("_at") == F.col("_k"), "left").select("node", F.coalesce("video", "_v").alias("video"), "_at")
    told = about.select(F.col("node").alias("_n"), F.col("video").alias("_a"))
    return at.join(told, F.col("node") == F.col("_n"), "left").select("node", F.coalesce("video", "_a").alias("video")).distinct()


def grouped_by_scene(results: DataFrame, scene: str, node: str, score: Column) -> DataFrame:
    """``scene, best_score, n, ids``: results without a scene are left out; ids in order of their scores, the first hundred."""
    some = results.where(F.col(scene).isNotNull()).withColumn("_s", score)
    ranked = some.withColumn("_n", F.row_number().over(Window.partitionBy(scene).orderBy(F.desc("_s"), node)))
    ids = F.transform(F.array_sort(F.collect_list(F.when(F.col("_n") <= 100, F.struct("_n", node)))), lambda s: s[node])
    return ranked.groupBy(scene).agg(F.max("_s").alias("best_score"), F.count("*").alias("n"), ids.alias("ids"))


def topic_links(entities: DataFrame, topics: DataFrame) -> DataFrame:
    """``entity_id, topic``: of one video, where one name contains the other or a keyword stands in the entity's name.

    ``topics`` are few for each video (a summary's); they are what an entity is compared with.
    """
    t = topics.select("video_id", F.col("name").alias("topic"), F.lower("name").alias("_t"), F.transform("keywords", F.lower).alias("_kw"))
    met = entities.join(t, "video_id")
    hit = F.contains(F.lower("name"), F.col("_t")) | F.contains(F.col("_t"), F.lower("name")) | F.exists("_kw", lambda k: F.contains(F.lower("name"), k))
    return met.where(hit).select("entity_id", "topic").distinct()


def relations(said: DataFrame, contains: DataFrame, entities: DataFrame) -> DataFrame:
    """``src, dst, type, evidence, weight``: relations named in a frame, between the entities of these names in it.

    ``said`` has frame_id, source, target, type and weight.
    """
    named = contains.join(entities.select("entity_id", F.lower("name").alias("_name")), "entity_id")
    side = lambda end, name: named.select("frame_id", F.col("_name").alias(end), F.col("entity_id").alias(name))
    low = said.withColumns({"source": F.lower("source"), "target": F.lower("target")})
    met = low.join(side("source", "src"), ["frame_id", "source"]).join(side("target", "dst"), ["frame_id", "target"]).where("src <> dst")
    return met.groupBy("src", "dst", "type").agg(F.count("*").alias("evidence"), F.max("weight").alias("weight"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``what, name, n``: nodes by label, edges by type, and the totals."""
    by = nodes.groupBy(F.col("label").alias("name")).agg(F.count("*").alias("n")).select(F.lit("label").alias("what"), "name", "n")
    rel = edges.groupBy(F.col("rel_type").alias("name")).agg(F.count("*").alias("n")).select(F.lit("relation").alias("what"), "name", "n")
    both = by.unionByName(rel)
    return both.unionByName(both.groupBy("what").agg(F.sum("n").alias("n")).select("what", F.lit("all").alias("name"), "n"))


def context_at(times: DataFrame, frames: DataFrame, segments: DataFrame, width: int, k: int = 5) -> DataFrame:
    """``video_id, t_ms, near_id, said``: of each moment the nearest frame within ``width`` and what is said around it, ``k`` texts at most.

    Moments and rows meet by slices of time of that width.
    """
    slices = lambda c: F.explode(F.array(F.floor(c / width) - 1, F.floor(c / width), F.floor(c / width) + 1))
    t = times.withColumn("_b", slices(F.col("t_ms")))
    f = frames.select("video_id", F.floor(F.col("ts_ms") / width).alias("_b"), "ts_ms", "frame_id")
    gap = F.abs(F.col("ts_ms") - F.col("t_ms"))
    near = t.join(f, ["video_id", "_b"]).where(gap <= width).groupBy("video_id", "t_ms").agg(F.min_by("frame_id", F.struct(gap, "ts_ms", "frame_id")).alias("near_id"))
    s = segments.select("video_id", "start_ms", "end_ms", "text").withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_ms") / width), F.floor(F.col("end_ms") / width))))
    met = times.withColumn("_b", slices(F.col("t_ms"))).join(s, ["video_id", "_b"]).where((F.col("start_ms") <= F.col("t_ms") + width) & (F.col("end_ms") >= F.col("t_ms") - width)).select("video_id", "t_ms", "start_ms", "text").distinct()
    first = per_group(met.withColumn("_key", F.struct("video_id", "t_ms")), "_key", [F.col("start_ms"), F.col("text")], k).drop("_key")
    said = first.groupBy("video_id", "t_ms").agg(F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "text"))), lambda x: x["text"]).alias("said"))
    return times.join(near, ["video_id", "t_ms"], "left").join(said, ["video_id", "t_ms"], "left")


def distinct_sets(rows: DataFrame, members: str, order: list[str]) -> DataFrame:
    """The first row of each set of members, in whatever order they stand."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(F.array_sort(members)).orderBy(*order))).where("_n = 1").drop("_n")


def unseen(new: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """New rows whose name is not known yet, whatever its case and spaces around it; each name once."""
    low = F.lower(F.trim(name))
    fresh = new.withColumn("_low", low).join(known.select(low.alias("_low")).distinct(), "_low", "left_anti")
    return fresh.withColumn("_n", F.row_number().over(Window.partitionBy("_low").orderBy(name))).where("_n = 1").drop("_n", "_low")
