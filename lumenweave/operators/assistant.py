"""What an assistant over videos reads: memory within a budget, highlights, summaries, and checked messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenweave.functions.text import clean_generated, is_detail_query, is_valid_content, overlap, query_terms
from lumenweave.operators.search import fitting, per_group, pick_apart, within_budget


def memory(turns: DataFrame, key: str, order: str, role: str, text: str, terms: Column, budget: int, most: int = 6, candidates: int = 24, recent: int = 20) -> DataFrame:
    """``key, nth, snippet``: what of the ``recent`` last turns is put before a model.

    A turn ranks by 2.2 for each term in it and 0.8 for the latest, less for older ones.
    Of the best ``candidates``, distinct whatever the case, those are taken in order that
    still fit into the budget, ``most`` at most.
    """
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order))) - 1
    said = F.substring(F.concat(F.col(role), F.lit(": "), F.col(text)), 1, 260)
    some = turns.withColumn("_back", back).where(F.col("_back") < recent).select(key, order, "_back", said.alias("_said"))
    recency = F.greatest(F.lit(0.0), 1 - F.col("_back") / 20)
    ranked = some.withColumns({"_rank": -(overlap(F.col("_said"), terms) * 2.2 + recency * 0.8), "_recent": -recency, "_snippet": F.concat(F.lit("[memory] "), "_said")})
    top = per_group(ranked, key, [F.col("_rank"), F.col("_recent")], candidates)
    once = top.withColumn("_first", F.row_number().over(Window.partitionBy(key, F.lower("_snippet")).orderBy("_rank", "_recent"))).where("_first = 1").withColumn("_chars", F.length("_snippet"))
    taken = fitting(once, key, ["_rank", "_recent", "_snippet"], "_chars", budget, most)
    return taken.select(key, F.row_number().over(Window.partitionBy(key).orderBy("_rank", "_recent")).alias("nth"), F.col("_snippet").alias("snippet"))


def highlights(frames: DataFrame, entities: DataFrame, segment: float, clip: float, most: int, rich: int = 80, many: int = 2) -> DataFrame:
    """``video_id, nth, lo, hi``: clips that don't overlap, in order of time.

    First the frame with the longest description over ``rich`` characters of each
    segment, the longest first; then frames with over ``many`` entities, the most first.
    ``frames`` has video_id, frame_id, ts, description and duration; ``entities`` frame_id and n.
    """
    long = per_group(frames.where(F.length("description") > rich).withColumn("_len", -F.length("description")), "video_id", [F.col("_len"), F.col("frame_id")], 100)
    best = per_group(long.withColumn("_seg", F.struct("video_id", F.floor(F.col("ts") / segment).alias("s"))), "_seg", [F.col("_len"), F.col("frame_id")], 1)
    first = best.select("video_id", F.lit(1).alias("_way"), F.col("_len").alias("_by"), "frame_id", "ts", "duration")
    full = frames.join(entities.where(F.col("n") > many), "frame_id").withColumn("_many", -F.col("n"))
    second = per_group(full, "video_id", [F.col("_many"), F.col("frame_id")], 20).select("video_id", F.lit(2).alias("_way"), F.col("_many").cast("int").alias("_by"), "frame_id", "ts", "duration")
    lo = F.greatest(F.lit(0.0), F.col("ts") - clip / 2)
    hi = F.least(F.col("duration"), F.col("ts") + clip / 2)
    spans = first.unionByName(second).withColumns({"lo": lo, "hi": F.greatest(hi, lo + clip)})
    taken = pick_apart(spans, "video_id", ["_way", "_by", "frame_id"], "lo", "hi", most)
    return taken.withColumn("nth", F.row_number().over(Window.partitionBy("video_id").orderBy("lo"))).select("video_id", "nth", "lo", "hi")


def summaries(frames: DataFrame, order: list[str], prefixes: list[str], n: int = 5, each: int = 150, whole: int = 600) -> DataFrame:
    """``video_id, summary``: of each video ``n`` descriptions that say something, evenly spaced, cleaned and cut."""
    valid = frames.where(is_valid_content(F.col("description")))
    by = Window.partitionBy("video_id")
    count = F.count("*").over(by)
    step = F.greatest(F.lit(1), F.floor(count / F.least(F.lit(n), count)))
    at = valid.withColumns({"_i": F.row_number().over(by.orderBy(*order)) - 1, "_step": step}).where((F.col("_i") % F.col("_step") == 0) & (F.floor(F.col("_i") / F.col("_step")) < n))
    said = F.substring(clean_generated(F.col("description"), prefixes), 1, each)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.length("_said") > 0, F.struct("_i", "_said")))), lambda s: s["_said"]), " ")
    return at.withColumn("_said", said).groupBy("video_id").agg(F.substring(text, 1, whole).alias("summary"))


def supporting_frames(membership: DataFrame, contains: DataFrame, frames: DataFrame, n: int = 5) -> DataFrame:
    """``community, frame_id``: the first ``n`` frames with a description that hold an entity of the community."""
    held = membership.join(contains, "entity_id").select("community", "frame_id").distinct().join(frames.where(F.col("description").isNotNull()), "frame_id")
    return per_group(held, "community", [F.col("ts"), F.col("frame_id")], n).select("community", "frame_id")


def checked_messages(rows: DataFrame, body: str, schema: str, required: list[str]) -> DataFrame:
    """``rows`` with ``message`` (struct) and ``problem``: no JSON object, a missing field, or null if it is right."""
    read = rows.withColumn("message", F.from_json(body, schema, {"mode": "PERMISSIVE"}))
    missing = F.array_compact(F.array(*[F.when(F.col(f"message.{c}").isNull(), c) for c in required]))
    broken = F.get_json_object(body, "$").isNull() | ~F.startswith(F.ltrim(body), F.lit("{"))
    problem = F.when(F.coalesce(broken, F.lit(True)), "no object").when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ",")))
    return read.withColumn("problem", problem)


def stage_states(events: DataFrame, key: str, stage: str, at: str, status: str) -> DataFrame:
    """``key, stage, state, n``: the last state of each stage, which once it failed or completed runs again only if it says so."""
    last = F.max_by(status, F.struct(F.col(at), F.when(F.col(status) == "running", 0).otherwise(1)))
    return events.groupBy(key, stage).agg(last.alias("state"), F.count("*").alias("n"))


def artifacts_for(refs: DataFrame, questions: DataFrame, key: str, last: int = 20, most: int = 2) -> DataFrame:
    """``key, nth, artifact_id, tool, summary``: the references that a question is likely to be about.

    Of the ``last`` references (key, n, artifact_id, tool, summary) each scores by how
    many of the question's terms its tool and summary hold; the best ``most`` different
    artifacts are taken, of equals the latest. Without any term in common there are none,
    unless the question asks for detail.
    """
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n")))
    recent = refs.withColumn("_back", back).where(F.col("_back") <= last).join(questions.select(key, query_terms(F.col("question")).alias("_terms"), is_detail_query(F.col("question")).alias("_detail")), key)
    said = F.lower(F.concat(F.coalesce("tool", F.lit("")), F.lit(" "), F.coalesce("summary", F.lit(""))))
    scored = recent.withColumn("_score", F.size(F.filter("_terms", lambda t: F.contains(said, t))))
    asked = scored.withColumn("_most", F.max("_score").over(Window.partitionBy(key))).where((F.col("_most") > 0) | F.col("_detail"))
    order = [F.desc("_score"), F.col("_back")]
    once = per_group(asked.where("artifact_id <> ''").withColumn("_id", F.struct(key, "artifact_id")), "_id", order, 1)
    return once.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("nth") <= most).select(key, "nth", "artifact_id", "tool", "summary")


def artifacts_named(refs: DataFrame, wanted: DataFrame, key: str, last: int = 50, most: int = 2) -> DataFrame:
    """The same for artifacts that are asked for by name: ``wanted`` (key, place, artifact_id), in that order, each by its latest reference of the ``last``."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n")))
    recent = refs.withColumn("_back", back).where((F.col("_back") <= last) & (F.col("artifact_id") != ""))
    latest = per_group(recent.withColumn("_id", F.struct(key, "artifact_id")), "_id", [F.col("_back")], 1)
    found = wanted.select(key, "artifact_id", "place").join(latest, [key, "artifact_id"])
    return found.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy("place"))).where(F.col("nth") <= most).select(key, "nth", "artifact_id", "tool", "summary")


def rehydrated(chosen: DataFrame, artifacts: DataFrame, key: str, budget: int = 3500) -> DataFrame:
    """``key, nth, snippet``: what the chosen artifacts (artifact_id, tool, preview) hold, in order, up to the first that exceeds the budget.

    An artifact that isn't there, or is empty, is passed over.
    """
    a = artifacts.select("artifact_id", F.col("tool").alias("_tool"), "preview").where("preview <> ''")
    tool = F.coalesce(F.nullif("tool", F.lit("")), F.nullif("_tool", F.lit("")), F.lit("tool"))
    snippet = F.concat(F.lit("[artifact:"), "artifact_id", F.lit("] "), tool, F.lit("\nsummary: "), F.substring(F.coalesce("summary", F.lit("")), 1, 180), F.lit("\npayload: "), "preview")
    rows = chosen.join(a, "artifact_id").select(key, "nth", snippet.alias("snippet")).withColumn("_n", F.length("snippet"))
    return within_budget(rows, key, [F.col("nth")], "_n", budget).drop("_n")
