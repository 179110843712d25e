"""From what models said of frames to a video's result: understanding, scenes, topics, statistics and graph intents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenweave.functions.text import entity_name, first_sentence, truncate, unique_ci
from lumenweave.operators.timeline import nearest, overlapping


def _texts(order: str, text: str):
    """The texts of a group that are there, in order, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.length(text) > 0, F.struct(order, text)))), lambda s: s[text]), " ")


def frame_understanding(rows: DataFrame, most: int = 50) -> DataFrame:
    """``frame_id, description, ocr_text, objects, tasks, tokens`` from rows (frame_id, nth, task, caption, ocr_text, labels, tokens), one for each task.

    Captions and texts are joined in order, a description is cut at 700 characters; objects are distinct whatever the case.
    """
    grouped = rows.groupBy("frame_id").agg(
        _texts("nth", "caption").alias("said"), _texts("nth", "ocr_text").alias("ocr"), F.array_sort(F.collect_list(F.struct("nth", "labels"))).alias("labels"),
        F.array_sort(F.collect_set("task")).alias("tasks"), F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"),
    )
    objects = unique_ci(F.flatten(F.transform("labels", lambda s: F.coalesce(s["labels"], F.array().cast("array<string>")))), most)
    return grouped.select("frame_id", truncate(F.col("said"), 700).alias("description"), F.nullif("ocr", F.lit("")).alias("ocr_text"), objects.alias("objects"), "tasks", "tokens")


def frames_data(frames: DataFrame, understanding: DataFrame) -> DataFrame:
    """Every frame with what is understood of it, or nothing and no tokens."""
    joined = frames.join(understanding.select("frame_id", F.col("description").alias("analysis"), "tokens"), "frame_id", "left")
    return joined.withColumns({"timestamp": F.round(F.col("ts_ms") / 1000, 3), "tokens": F.coalesce("tokens", F.lit(0))})


def key_topics(frames: DataFrame, understanding: DataFrame, each: int = 5, most: int = 15) -> DataFrame:
    """``video_id, topics``: of the first ``each`` objects of each frame, in order of the frames, the first ``most`` that differ."""
    seen = frames.select("video_id", "frame_id", "ts_ms").join(understanding, "frame_id").select("video_id", "ts_ms", "frame_id", F.posexplode(F.slice("objects", 1, each)).alias("pos", "topic"))
    at = F.struct("ts_ms", "frame_id", "pos")
    first = seen.groupBy("video_id", F.lower("topic").alias("low")).agg(F.min(at).alias("at"), F.min_by("topic", at).alias("topic"))
    ranked = first.withColumn("n", F.row_number().over(Window.partitionBy("video_id").orderBy("at"))).where(F.col("n") <= most)
    return ranked.groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "topic"))), lambda s: s["topic"]).alias("topics"))


def audio_data(segments: DataFrame, runs: DataFrame) -> DataFrame:
    """``video_id, n_segments, n_words, text, language``: a run's transcript if there is one, or else the segments in order."""
    said = segments.groupBy("video_id").agg(F.count("*").alias("n_segments"), _texts("idx", "text").alias("joined"))
    both = said.join(runs.select("video_id", F.col("text").alias("whole"), "language"), "video_id", "full")
    text = F.coalesce("whole", "joined", F.lit(""))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return both.select("video_id", F.coalesce("n_segments", F.lit(0)).alias("n_segments"), F.size(words).alias("n_words"), text.alias("text"), "language")


def scenes(candidates: DataFrame, frames: DataFrame, understanding: DataFrame, segments: DataFrame) -> DataFrame:
    """``video_id, n, start, end, title, summary, objects, frame_id, evidence`` from candidates (video_id, n, start_ms, end_ms, frame_ids).

    A scene shows the first of its frames that exists, or else the one nearest to its
    middle. Its summary is the first three descriptions, cut at 500 characters, or
    what is said meanwhile.
    """
    key = ["video_id", "n"]
    listed = candidates.select(*key, F.posexplode("frame_ids").alias("pos", "frame_id")).join(frames.select("video_id", "frame_id"), ["video_id", "frame_id"])
    known = listed.join(understanding.select("frame_id", "description", "objects"), "frame_id", "left")
    known = known.withColumn("i", F.row_number().over(Window.partitionBy(*key).orderBy("pos")))
    objects = unique_ci(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "objects"))), lambda s: F.coalesce(s["objects"], F.array().cast("array<string>")))), 20)
    seen = known.groupBy(*key).agg(
        F.min_by("frame_id", "pos").alias("shown"), truncate(F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("i") <= 3) & (F.length("description") > 0), F.struct("pos", "description")))), lambda s: s["description"]), " "), 500).alias("visual"),
        objects.alias("objects"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "frame_id"))), lambda s: s["frame_id"]).alias("evidence"),
    )
    spans = candidates.select(*key, "start_ms", "end_ms")
    said = overlapping(spans, segments.select("video_id", "start_ms", "end_ms", "idx", "text"), ["video_id"]).groupBy(*key).agg(truncate(_texts("r_idx", "r_text"), 500).alias("said"))
    bare = candidates.join(seen.where("shown IS NOT NULL").select(*key), key, "left_anti").select(*key, ((F.col("start_ms") + F.col("end_ms")) / 2).alias("t_ms"))
    near = nearest(bare, frames, "video_id", "ts_ms", "frame_id").select(*key, F.col("near_id").alias("near"))
    every = spans.join(seen, key, "left").join(said, key, "left").join(near, key, "left")
    summary = F.coalesce("visual", "said")
    title = first_sentence(summary, "")
    none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind))
    return every.select(
        *key, F.round(F.col("start_ms") / 1000, 3).alias("start"), F.round(F.col("end_ms") / 1000, 3).alias("end"), F.coalesce(F.nullif(title, F.lit("")), F.concat(F.lit("Scene "), F.col("n") + 1)).alias("title"),
        summary.alias("summary"), none("objects", "array<string>").alias("objects"), F.coalesce("shown", "near").alias("frame_id"), none("evidence", "array<bigint>").alias("evidence"),
    )


def results(frames: DataFrame, understanding: DataFrame, scenes_: DataFrame, audio: DataFrame, topics: DataFrame) -> DataFrame:
    """One row a video: counts, sums, a summary of the first five scenes cut at 900 characters, and a status."""
    f = frames_data(frames, understanding).groupBy("video_id").agg(F.count("*").alias("frames_extracted"), F.count_if(F.col("analysis").isNotNull()).alias("frames_analyzed"), F.sum("tokens").alias("tokens_total"), (F.max("ts_ms") / 1000).alias("duration"))
    five = F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("n") < 5) & (F.length("summary") > 0), F.struct("n", "summary")))), lambda s: s["summary"]), " ")
    s = scenes_.groupBy("video_id").agg(F.count("*").alias("total_scenes"), truncate(five, 900).alias("summary"))
    out = f.join(s, "video_id", "left").join(audio.select("video_id", (F.col("n_segments") > 0).alias("audio_processed")), "video_id", "left").join(topics, "video_id", "left")
    status = F.when(F.col("frames_analyzed") > 0, "completed").otherwise("completed_with_warnings")
    return out.withColumns({"total_scenes": F.coalesce("total_scenes", F.lit(0)), "audio_processed": F.coalesce("audio_processed", F.lit(False)), "status": status})


def graph_intents(scenes_: DataFrame, frames: DataFrame, segments: DataFrame, understanding: DataFrame) -> DataFrame:
    """``operation, label, key, from_key, to_key``: the nodes and edges that a video's tables ask for.

    An entity is one node of its video, whatever frames it is seen in, and has an edge from each of them.
    """
    v = F.col("video_id").cast("string")
    node = lambda df, label, key: df.select(F.lit("node").alias("operation"), F.lit(label).alias("label"), key.alias("key"), F.lit(None).cast("string").alias("from_key"), F.lit(None).cast("string").alias("to_key"))
    edge = lambda df, kind, a, b: df.select(F.lit("relationship").alias("operation"), F.lit(kind).alias("label"), F.concat(a, F.lit(f"->{kind}->"), b).alias("key"), a.alias("from_key"), b.alias("to_key"))
    six = lambda c: F.lpad(F.col(c).cast("string"), 6, "0")
    scene, frame, segment = F.concat(v, F.lit(":scene:"), six("n")), F.concat(v, F.lit(":frame:"), F.col("frame_id").cast("string")), F.concat(v, F.lit(":segment:"), six("idx"))
    seen = frames.select("video_id", "frame_id").join(understanding, "frame_id").select("video_id", "frame_id", F.explode("objects").alias("name")).withColumn("name", entity_name(F.col("name"))).distinct()
    entity = F.concat(v, F.lit(":entity:"), F.col("name"))
    parts = [
        node(frames.select("video_id").distinct(), "Video", v), node(scenes_, "Scene", scene), edge(scenes_, "CONTAINS", v, scene), node(frames, "Frame", frame), edge(frames, "HAS_FRAME", v, frame),
        node(segments, "AudioSegment", segment), edge(segments, "HAS_TRANSCRIPT", v, segment), node(seen.select("video_id", "name").distinct(), "Entity", entity), edge(seen, "CONTAINS", frame, entity),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def intent_groups(intents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """How many intents go together (operation and label), and those that name no valid label, with the reason."""
    ok = F.coalesce(F.rlike("label", F.lit("^[A-Za-z][A-Za-z0-9_]*$")), F.lit(False)) & ((F.col("operation") == "node") | (F.col("from_key").isNotNull() & F.col("to_key").isNotNull()))
    good = intents.where(ok).groupBy("operation", "label").agg(F.count("*").alias("n"))
    return good, intents.where(~ok).select("key", F.when(F.col("from_key").isNull() & (F.col("operation") != "node"), "no ends").otherwise("no valid label").alias("reason"))
