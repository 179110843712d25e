import random

import pytest
from pyspark.sql import functions as F

from lumenweave.functions import payload as P
from lumenweave.operators import sampling as M
from lumenweave.operators import shaping as H
from lumenweave.sources import ordered_rows

SCENES = "video string, scene_id int, start_time double, end_time double, title string, description string"


def test_scene_list_takes_titles_then_sentences_then_numbers(spark):
    rows = [("a", 0, 0.0, 5.0, "Given", "This scene shows a dog. It runs."), ("a", 1, 5.0, 9.0, None, "This scene shows **a dog**. It runs."), ("a", 2, None, None, "", ""), ("a", None, 1.0, 2.0, None, "This scene shows "), (None, 4, 0.0, 1.0, None, "x" * 300)]
    got = {(r.video, r.start_time, r.scene_id): r for r in H.scene_list(spark.createDataFrame(rows, SCENES), "video", ["This scene shows"]).collect()}
    assert got["a", 0.0, 0].title == "Given" and got["a", 0.0, 0].summary == "a dog. It runs."
    assert got["a", 5.0, 1].title == "a dog" and got["a", 5.0, 1].summary == "a dog. It runs."
    assert got["a", 0.0, 2].title == "Scene 3" and got["a", 0.0, 2].summary is None and got["a", 0.0, 2].end_time == 0
    assert got["a", 1.0, 0].title == "Scene 1" and got["a", 1.0, 0].summary is None
    assert got[None, 0.0, 4].title == "x" * 100 and len(got[None, 0.0, 4].summary) == 300


def test_chapters_and_entries(spark):
    rows = [("a", i, 700.0 * i, 700.0 * i + 600, None if i % 2 else f"Title {i} " + "y" * 80, f"Said {i}." if i % 3 else None) for i in range(12)] + [("b", 0, 5.0, 1.0, None, None)]
    listed = H.scene_list(spark.createDataFrame(rows, SCENES), "video", [])
    got = {(r.video, r.chapter_id): r for r in H.chapters(listed, "video").collect()}
    assert len(got) == 4 and [got["a", i].scene_count for i in range(3)] == [5, 5, 2]
    one = got["a", 1]
    assert len(one.title) <= 60 and one.start_time == 3500 and one.end_time == 6900 and one.duration == 3400 and one.summary == "Said 5. Said 7. Said 8."
    assert [tuple(x) for x in one.scenes][0] == (5, "Said 5", "58:20 - 1:08:20")
    assert got["b", 0].duration == 0 and got["b", 0].summary is None and got["b", 0].title == "Scene 1"
    numbered = H.entries(H.chapters(listed, "video"), "video", ["chapter_id"]).collect()
    assert sorted((r.video, r.number) for r in numbered) == [("a", 1), ("a", 2), ("a", 3), ("b", 1)]
    bare = H.entries(spark.createDataFrame([("a", 1, None, None, " ", None)], "video string, n int, start_time double, end_time double, title string, summary string"), "video", ["n"]).first()
    assert tuple(bare) == ("a", 1, "Scene 1", 0.0, "0:00", 0.0, "0:00", "Scene 1")
    assert H.chapters(listed.where("false"), "video").count() == 0


def test_frame_hits_without_a_frame(spark):
    found = spark.createDataFrame([("q", 1, 0.0, 0.5), ("q", 2, 0.9, 0.1), ("q", 3, None, None)], "query string, node_id long, combined_score double, vector_score double")
    frames = spark.createDataFrame([(1, 7, 1.5, "a cat"), (2, None, None, None)], "frame_id long, frame_number int, timestamp double, description string")
    got = [tuple(r) for r in H.frame_hits(found, frames).orderBy("rank").collect()]
    assert got == [("q", 1, 2, 0, 0.0, "", 0.9), ("q", 2, 1, 7, 1.5, "a cat", 0.5), ("q", 3, 3, 0, 0.0, "", 0.0)]


def test_levels_of_paths(spark):
    paths = spark.createDataFrame([(0, [1, 2, 3]), (0, [1, 2]), (1, [9])], "query int, path array<int>")
    nodes = spark.createDataFrame([(1, "video", "V"), (2, "chapter", "C"), (3, "scene", None)], "node int, level string, title string")
    nodes = nodes.select("*", F.lit("s").alias("summary"), F.lit(1.0).alias("start_time"), F.lit(2.0).alias("end_time"))
    edges = spark.createDataFrame([(1, 2), (2, 3), (2, 4)], "src int, dst int")
    shaped, totals = H.levels_of(paths, nodes, edges)
    got = {(r.query, r.current.node): r for r in shaped.collect()}
    assert [tuple(x) for x in got[0, 3].path] == [("video", 1, "V"), ("chapter", 2, "C"), ("scene", 3, None)]
    assert not got[0, 3].has_more_levels and got[0, 2].has_more_levels and got[0, 2].current.title == "C"
    assert got[1, 9].current.level is None and not got[1, 9].has_more_levels
    assert {r.query: (r.levels_traversed, r.total_results) for r in totals.collect()} == {0: (["chapter", "scene", "video"], 2), 1: ([], 1)}


def test_task_fields(spark):
    rows = [("caption", '{"caption":" a cat "}'), ("ocr", '"stop"'), ("object_detection", '{"b":1,"a":[2]}'), ("dense_region_caption", '{"labels":["x"]}'), ("object_detection", "[]"), ("object_detection", None), ("other", '{"a":1}'), (None, '{"a":1}')]
    df = spark.createDataFrame(rows, "task string, raw string")
    got = [tuple(r) for r in df.select(*P.task_fields(F.col("task"), P.value(F.col("raw"))).values()).collect()]
    none = (None, None, "{}", "{}", "{}")
    assert got == [("a cat", *none[1:]), (None, "stop", *none[2:]), (None, None, '{"a":[2],"b":1}', "{}", '{"a":[2],"b":1}'), (None, None, "{}", '{"labels":["x"]}', '{"labels":["x"]}'), none, none, none, none]


def test_distinct_frames_compare_with_the_last_one_left(spark):
    rng = random.Random(1)
    rows = []
    for video in ("a", "b", None):
        h = rng.getrandbits(64) - (1 << 63)
        for i in range(300):  # a slow drift
            h ^= 1 << rng.randrange(63)
            rows.append((video, i, None if i % 50 == 7 else h))
    want, now, last = [], (), None
    for video, i, h in rows:
        now, last = (video, last if now == video else None)
        if h is None or last is None or bin((h ^ last) & (1 << 64) - 1).count("1") > 12:
            want.append((video, i))
            last = last if h is None else h
    got = M.distinct_frames(spark.createDataFrame(rows, "video string, at int, hash long"), "video", ["at"], "hash")
    assert sorted(map(str, ((r.video, r.at) for r in got.collect()))) == sorted(map(str, want)) and 18 < len(want) < 120


def test_ordered_rows_raise_when_nothing_is_there(spark):
    df = spark.createDataFrame([("m", 2), ("m", 1), (None, 3)], "media string, n int")
    assert [r.n for r in ordered_rows(df, {"media": "m"}, ["n"], "the cutting").collect()] == [1, 2]
    assert ordered_rows(df, {"media": None}, ["n"]).first().n == 3 and ordered_rows(df, {"media": "x"}, ["n"]).count() == 0
    with pytest.raises(LookupError):
        ordered_rows(df, {"media": "x"}, ["n"], "the cutting")
