"""Merged boundaries, scenes and chapters against the rules said one by one."""

import random

import pytest
from pyspark.sql import functions as F

from lumenweave.operators import structure as T
from lumenweave.operators import timeline as L

BOUNDS = "v string, t long, number long, confidence double, method string"


def greedy(visual, semantic, near, apart):
    """Each visual boundary in turn takes the nearest semantic one that is left."""
    free, out = sorted(semantic), []
    for t, number, c in sorted(visual):
        best = min(free, key=lambda s: abs(s[0] - t), default=None)
        if best is not None and abs(best[0] - t) < near:
            free.remove(best)
            out.append(((t + best[0]) / 2, number, round((c + best[2]) / 2, 9), "merged"))
        else:
            out.append((float(t), number, round(c, 9), "cut"))
    for t, number, c in free:
        if all(abs(t - m[0]) >= apart for m in out):
            out.append((float(t), number, c, "semantic"))
    return sorted(out)


def rows(videos, method):
    return [(v, t, n, c, method) for v, own in videos.items() for t, n, c in own]


@pytest.mark.parametrize("seed", range(3))
def test_merged_boundaries(spark, seed):
    rng = random.Random(seed)
    # times of every density, and ties
    visual = {f"v{i}": [(rng.randrange(0, 60_000, 250), n, rng.random()) for n in range(rng.randrange(60))] for i in range(12)}
    semantic = {f"v{i}": sorted({rng.randrange(0, 60_000, 250): (n, 0.7) for n in range(rng.randrange(60))}.items()) for i in range(2, 14)}
    semantic = {v: [(t, n, c) for t, (n, c) in own] for v, own in semantic.items()}
    df = [spark.createDataFrame(rows(x, m) or [("none", None, 0, 0.0, m)], BOUNDS).repartition(5) for x, m in ((visual, "cut"), (semantic, "semantic"))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = T.merge_boundaries(*df, "v", 2000, 1500).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for v in {*visual, *semantic}:
        assert sorted((r.t, r.number, round(r.confidence, 9), r.method) for r in got if r.v == v) == greedy(visual.get(v, []), semantic.get(v, []), 2000, 1500)


def test_no_boundaries(spark):
    none = spark.createDataFrame([], BOUNDS)
    some = spark.createDataFrame([("v", 1000, 1, 0.5, "cut")], BOUNDS)
    assert T.merge_boundaries(none, none, "v").collect() == []
    assert [tuple(r) for r in T.merge_boundaries(some, none, "v").collect()] == [("v", 1000.0, 1, 0.5, "cut")]
    assert [r.t for r in T.merge_boundaries(none, some, "v").collect()] == [1000.0]


def test_scenes_of_boundaries(spark):
    b = spark.createDataFrame([("v", 0.0, 0, 0.5, "cut"), ("v", 1000.0, 1, 0.6, "cut"), ("v", 1500.0, 2, 0.7, "cut"), ("v", 9000.0, 3, 0.8, "semantic")], "v string, t double, number long, confidence double, method string")
    d = spark.createDataFrame([("v", 10_000), ("w", 5)], "v string, duration long")
    s = T.scenes_between(b, d, "v", 10.0, least=2000).orderBy("scene_id")
    # the first stays though short; the second and the last are too short
    assert [(r.scene_id, r.start_ms, r.end_ms, r.start_frame, r.end_frame, r.keyframes) for r in s.collect()] == [(0, 0.0, 1000.0, 0, 10, [2, 5, 7]), (1, 1500.0, 9000.0, 15, 90, [33, 52, 71])]
    frames = spark.createDataFrame([("v", n, f"seen {n}", [f"o{n % 12:02}"], "indoor" if n < 40 else "outdoor" if n % 2 else None) for n in range(15, 70)] + [("v", 5, "", [], None)], "v string, frame_number long, description string, objects array<string>, scene_type string")
    said = spark.createDataFrame([("v", 2000, 3000, "within"), ("v", 1400, 3000, "begins before"), ("v", 1500, 9000, "all of it")], "v string, start_ms long, end_ms long, text string")
    got = T.described(s, frames, said, "v", width=7).orderBy("scene_id").collect()
    assert (got[0].description, got[0].objects, got[0].scene_type, got[0].transcript) == (None, [], None, None)
    assert (got[1].description, got[1].objects, got[1].scene_type, got[1].transcript) == ("seen 15 seen 16 seen 17", [f"o{i:02}" for i in range(10)], "indoor", "all of it within")


def test_chapters_are_runs_of_scenes(spark):
    s = spark.createDataFrame([("v", i, i * 10.0, i * 10.0 + 9) for i in range(12)], "v string, scene_id int, start_ms double, end_ms double")
    got = T.chapters_of(s, "v").orderBy("chapter_id").collect()
    assert [(r.chapter_id, r.title, r.start_ms, r.end_ms, r.scene_ids) for r in got] == [(0, "Chapter 1", 0.0, 49.0, [0, 1, 2, 3, 4]), (1, "Chapter 2", 50.0, 99.0, [5, 6, 7, 8, 9]), (2, "Chapter 3", 100.0, 119.0, [10, 11])]


def test_without_vectors_visual_boundaries_stand(spark):
    visual = spark.createDataFrame([("v", 0, 0, 0.5, "cut"), ("v", 5000, 1, 0.5, "cut")], BOUNDS)
    frames = spark.createDataFrame([], "v string, frame_number long, description string, objects array<string>, scene_type string")
    said = spark.createDataFrame([], "v string, start_ms long, end_ms long, text string")
    d = visual.select("v", F.lit(9000).alias("duration")).distinct()
    scenes, chapters = T.analyse(visual, None, d, frames, said, "v", 10.0)
    assert [(r.start_ms, r.end_ms) for r in scenes.orderBy("scene_id").collect()] == [(0.0, 5000.0), (5000.0, 9000.0)] and chapters.count() == 1


def test_scenes_are_one_fold_whatever_the_points_come_as(spark):
    """Against edges found first and reasons gathered between them, from grouped points and from a row a reason, on any number of partitions."""
    rng = random.Random(9)
    rows = [(v, rng.randrange(400), r) for v in ("a", "b", None, "c") for r in ("x", "y", "z") for _ in range(60)] + [("one", 5, "x"), ("two", 5, "x"), ("two", 6, "y"), ("none", None, "x")]
    want = []
    for v in {r[0] for r in rows}:
        points = sorted({p for k, p, _ in rows if k == v and p is not None})
        why = lambda lo, hi, v=v: sorted({r for k, p, r in rows if k == v and p is not None and lo <= p <= hi})
        edges = points[:1]
        for p in points[1:]:
            if p - edges[-1] >= 25 or p == points[-1]:
                edges.append(p)
        want += [(v, n, lo, hi, why(lo, hi)) for n, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))]
    single = spark.createDataFrame(rows, "v string, point long, reason string")
    grouped = single.groupBy("v", "point").agg(F.collect_set("reason").alias("reasons"))
    for points in (single, grouped, single.repartition(7), single.coalesce(1)):
        got = [(r.v, r.n, r.start_ms, r.end_ms, r.reasons) for r in L.scenes(points, "v", 25).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert L.scenes(single.where("false"), "v", 25).count() == 0


def test_a_fold_has_each_key_in_one_task_after_a_union(spark):
    """Both sides of the union are dealt by the key before, and each is put together anew by its own sizes."""
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "3k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in held}
    rows = spark.range(20_000).select((F.col("id") % 97).alias("v"), (F.col("id") * 7919 % 100_003).alias("point"))
    ends = rows.groupBy("v").agg(F.max("point").alias("stop"))
    points = rows.join(ends, "v").where("point < stop").select("v", "point", F.lit("x").alias("reason")).union(ends.select("v", "stop", F.lit("end")))
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = L.scenes(points, "v", 5000).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    want = []
    for v in range(97):
        at = sorted({i * 7919 % 100_003 for i in range(v, 20_000, 97)})
        edges = at[:1]
        for p in at[1:]:
            if p - edges[-1] >= 5000 or p == at[-1]:
                edges.append(p)
        want += [(v, n, lo, hi) for n, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))]
    assert sorted((r.v, r.n, r.start_ms, r.end_ms) for r in got) == want
