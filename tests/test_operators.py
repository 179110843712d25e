import os
import random

import pytest
from pyspark.sql import functions as F

from lumenweave import sources, streaming
from lumenweave.functions import scalar as S
from lumenweave.functions import text as X
from lumenweave.operators import evaluation as E
from lumenweave.operators import graph as G
from lumenweave.operators import search as R
from lumenweave.operators import tables as B
from lumenweave.operators import timeline as L


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_boundary_points(spark):
    d = spark.createDataFrame([(1, 35000)], "v long, duration long")
    f = spark.createDataFrame([(1, 5000), (1, 25000)], "v long, ts_ms long")
    s = spark.createDataFrame([(1, 0, 1000), (1, 8000, 9000)], "v long, start_ms long, end_ms long")
    got = {r.point: r.reasons for r in L.boundary_points(d, f, s, "v", 2500, 15000).collect()}
    assert got[0] == ["start"] and got[5000] == ["frame_anchor"] and got[8000] == ["transcript_gap"]
    assert got[15000] == got[30000] == ["max_scene_duration"] and got[35000] == ["end"]
    scenes = [(r.start_ms, r.end_ms) for r in L.scenes(L.boundary_points(d, f, s, "v", 2500, 15000), "v", 8000).orderBy("n").collect()]
    assert scenes == [(0, 8000), (8000, 25000), (25000, 35000)] or scenes[0][0] == 0 and scenes[-1][1] == 35000


def test_sliding_windows_and_members(spark):
    w = L.sliding(spark.createDataFrame([(1, 18000)], "v long, duration long"), "v", "duration", 10000, 2000)
    assert [(r.start_ms, r.end_ms) for r in w.orderBy("n").collect()] == [(0, 10000), (8000, 18000)]
    f = spark.createDataFrame([(1, 1000, "a"), (1, 9000, "b"), (1, 12000, "c")], "v long, ts_ms long, id string")
    got = L.points_in(w, f, ["v"]).groupBy("n").agg(F.array_sort(F.collect_list("r_id")).alias("m"))
    assert {r.n: r.m for r in got.collect()} == {0: ["a", "b"], 1: ["b", "c"]}
    s = spark.createDataFrame([(1, 0, 2000, 0), (1, 11000, 13000, 1)], "v long, start_ms long, end_ms long, i int")
    assert {(r.n, r.r_i) for r in L.overlapping(w, s, ["v"]).collect()} == {(0, 0), (1, 1)}


def test_midpoints(spark):
    f = spark.createDataFrame([(1, 0.0, 0), (1, 10.0, 1), (1, 20.0, 2)], "v long, t double, i int")
    got = L.midpoints(f, "v", "t", ["i"], F.lit(30.0)).orderBy("i").collect()
    assert [(r.lo, r.hi) for r in got] == [(0, 5), (5, 15), (15, 30)]


def test_adjacency_boost(spark):
    f = spark.createDataFrame([(1, 1000, 0.5, 0.9, 0), (1, 3000, 0.5, 0.8, 1), (2, 1000, 0.99, 1.0, 2), (2, 1500, 0.99, 1.0, 3), (3, 1000, 0.5, 0.9, 4), (3, 100000, 0.5, 0.9, 5)], "v long, t long, s double, o double, i int")
    got = [r.boosted for r in L.adjacency_boost(f, "v", "t", "s", "o", ["i"]).orderBy("i").collect()]
    assert got == pytest.approx([0.604, 0.617, 1, 1, 0.5, 0.5])


def test_text(spark):
    assert one(spark, X.unique_ci(F.array(*map(F.lit, ["Car", "car ", "Bike", "Plane"])), 2)) == ["Car", "Bike"]
    assert one(spark, X.truncate(F.lit("a  b\nc" + "d" * 20), 10)) == "a b cdd..."
    assert one(spark, X.truncate(F.lit("  "), 10)) is None
    assert one(spark, X.first_sentence(F.lit(" . x"), "none")) == "none"
    assert one(spark, X.entity_name(F.lit(" Big  Red! Car "))) == "big red car"
    assert one(spark, X.entity_type(F.lit("Vehicle"))) == "object" and one(spark, X.entity_type(F.lit("?"))) == "concept"
    assert one(spark, X.relation_type(F.lit("part of"))) == "RELATES_TO" and one(spark, X.relation_type(F.lit(" part_of "))) == "CONTAINS"
    assert one(spark, X.clean_generated(F.lit("1. **Title:** Summary: it\nis"), ["Title:", "Summary:", "IT"])) == "it is"
    assert one(spark, X.escape_fulltext(F.lit(" a:b (c) "))) == r"a\:b \(c\)"
    assert one(spark, X.strip_fences(F.lit("```json\n{}\n```"))) == "{}"
    assert one(spark, X.safe_segment(F.lit("..a b/c_"))) == "a_b_c"
    assert one(spark, X.query_terms(F.lit("What about the red CAR, red café a_b video?"))) == ["red", "car"]
    assert one(spark, X.keywords(F.lit("a big, red! car"))) == ["big", "red", "car"]


def test_numbers(spark):
    assert one(spark, S.clock(F.lit(3725.9))) == "1:02:05" and one(spark, S.clock(F.lit(65))) == "1:05"
    assert one(spark, S.seconds_of(F.lit("1:02:05"))) == 3725 and one(spark, S.seconds_of(F.lit("x"))) is None
    assert one(spark, S.frame_rate(F.lit("30000/1001"))) == pytest.approx(29.97002997)
    assert one(spark, S.frame_rate(F.lit("25"))) == 25 and one(spark, S.frame_rate(F.lit("0/0"))) is None and one(spark, S.frame_rate(F.lit("no"))) is None
    assert one(spark, S.gaussian(F.lit(5.0), 5, 5)) == 1
    assert all(sum(w) == pytest.approx(1) for w in S.PROFILES.values())
    v = F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, S.cosine(v, v)) == 0


def test_citations(spark):
    got = one(spark, E.citations(F.lit("see [1:05], (0:10) and 2:00, 123:45, 1.2:30, frame #7, t=1.5s, at 3 secs")))
    assert [(c.kind, c.seconds, c.frame) for c in got] == [("timestamp", 65, None), ("timestamp", 10, None), ("timestamp", 120, None), ("frame", None, 7), ("timestamp", 1.5, None), ("timestamp", 3, None)]
    assert one(spark, E.citations(F.lit(None).cast("string"))) == []
    cited = E.citations(F.lit("[1:05] frame 100"))
    assert one(spark, E.fraction_in_window(cited, F.lit(60), F.lit(70), F.lit(None).cast("double"))) == 0.5
    assert one(spark, E.fraction_in_window(cited, F.lit(0), F.lit(70), F.lit(25.0))) == 1.0
    assert one(spark, E.choice(F.lit("Answer: B."))) == "B" and one(spark, E.choice(F.lit("no"))) is None
    assert one(spark, E.grounding(F.lit(0), F.lit(1), F.lit(False))) == 0.5


def test_entity_graph(spark):
    e = spark.createDataFrame([("e1", 3), ("e2", 2), ("e3", 4), ("e4", 1)], "entity_id string, occurrences int")
    edges = spark.createDataFrame([("e1", "e2", 5), ("e2", "e3", 3), ("e3", "e4", 9)], "a string, b string, weight int")
    assert {(r.a, r.b): r.weight for r in G.entity_graph(e, edges, 2).collect()} == {("e1", "e2"): 5, ("e2", "e3"): 3}


def test_accumulate_keeps_first_texts(spark):
    m = spark.createDataFrame([("a", 1, "x", 0.1), ("a", 2, "long", 0.9), ("a", 3, "x", 0.5)], "n string, t int, d string, c double")
    r = G.accumulate(m, ["n"], "t", "d", "c").first()
    assert (r.occurrences, r.first_seen, r.last_seen, r.confidence, r.description, r.descriptions) == (3, 1, 3, 0.9, "long", ["x", "long"])


def test_components_and_communities(spark):
    got = G.connected(spark.createDataFrame([(i, i + 1) for i in range(1, 20)] + [(30, 31), (31, 30)], "a int, b int"))
    assert {(r.node, r.component) for r in got.collect()} == {(i, 1) for i in range(1, 21)} | {(30, 30), (31, 30)}
    seen = got.select("node", F.lit(0).alias("first_seen"), F.lit(1).alias("last_seen"))
    assert [(r.community, r["size"]) for r in G.communities(got, seen).collect()] == [(1, 20)]


def test_no_hops_means_no_expansion(spark):
    e = spark.createDataFrame([(1, 2)], "src int, dst int")
    assert G.neighbours(spark.createDataFrame([(1,)], "start int"), e, 0).count() == 0
    assert {(r.node, r.distance) for r in G.neighbours(spark.createDataFrame([(1,)], "start int"), e, 3).collect()} == {(2, 1)}


def test_fuse_appends_text_only_hits(spark):
    v = spark.createDataFrame([("a", 1, 0.9), ("b", 2, 0.7)], "query string, node_id int, score double")
    t = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 4.0), ("a", 3, 1.0)], "query string, node_id int, score double")
    got = {(r.query, r.node_id): (r.vector_score, r.fulltext_score) for r in R.fuse(v, t, extra=1).collect()}
    assert got == {("a", 1): (0.9, 0.5), ("a", 2): (0.0, 1.0), ("b", 2): (0.7, 0.0)}


def test_merge_and_replace(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, created_at int").write.parquet(path)
    u = spark.createDataFrame([(2, "c", 2), (3, "d", 2)], "k int, v string, created_at int")
    B.replace(B.merge(spark.read.parquet(path), u, ["k"]), path)
    assert sorted(map(tuple, B.read(spark, path).collect())) == [(1, "a", 1), (2, "c", 1), (3, "d", 2)]


def test_status_of_another_dispatch_is_rejected(spark):
    c = spark.createDataFrame([(1, "d1", "queued", 0.0, False), (2, "d1", "queued", 0.0, False)], "media_id int, dispatch_id string, status string, progress double, processed boolean")
    e = spark.createDataFrame([(1, "d1", "completed", 0.9, 2, "x"), (2, "d2", "completed", 0.9, 2, "y")], "media_id int, dispatch_id string, status string, progress double, emitted_at int, outbox_id string")
    assert {r.media_id: (r.status, r.progress, r.processed) for r in B.project_status(c, e).collect()} == {1: ("completed", 1.0, True), 2: ("queued", 0.0, False)}


def test_sources(spark, tmp_path):
    (tmp_path / "q.json").write_text('{"questions": [{"id": 1}, {"id": 2}]}')
    (tmp_path / "q.csv").write_text("ID,x\n7,a\n")
    (tmp_path / "q.jsonl").write_text('{"id": 3}\n')
    assert {r.id for r in sources.records(spark, str(tmp_path / "q.json")).collect()} == {1, 2}
    assert sources.first_of(sources.records(spark, str(tmp_path / "q.csv")), {"k": ["key", "id"], "none": ["z"]}).collect()[0] == (7, None)
    assert sources.records(spark, str(tmp_path / "q.jsonl")).count() == 1
    (tmp_path / "empty").write_text("")
    assert {os.path.basename(r.path): r.kind for r in sources.sniff(spark, str(tmp_path)).collect()} == {"q.json": "json", "q.csv": "text", "q.jsonl": "json"}
    with pytest.raises(Exception, match="."):
        sources.probe(spark, str(tmp_path / "missing"))


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:05"), (1, "2024-01-01 00:01:00"), (1, "2024-01-01 00:01:00")]
    spark.createDataFrame(rows, "k int, t string").select("k", F.to_timestamp("t").alias("at")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, at timestamp").parquet(str(tmp_path / "in"))
    seen = []
    streaming.consume(streaming.once(stream, ["k", "at"], "at", "1 hour"), lambda df, i: seen.extend(df.collect()), str(tmp_path / "c1")).awaitTermination()
    assert len(seen) == 3
    batch = spark.read.parquet(str(tmp_path / "in"))
    assert sorted(r.n for r in streaming.session_counts(batch, "at", "k", "10 seconds", "1 hour").collect()) == [2, 2]
    assert sum(r.n for r in streaming.sliding_counts(batch, "at", "k", "60 seconds", "60 seconds", "1 hour").collect()) == 4


def test_pick_apart_gathers_no_group(spark):
    spans = [("v", i, float(i * 7 % 50), float(i * 7 % 50 + 6)) for i in range(50)] + [("w", 1, 0.0, 1.0)]
    got = R.pick_apart(spark.createDataFrame(spans, "k string, o int, lo double, hi double"), "k", ["o"], "lo", "hi", 5)
    taken = []
    for _, _, lo, hi in spans[:50]:
        if len(taken) < 5 and all(hi <= a or lo >= b for a, b in taken):
            taken.append((lo, hi))
    assert sorted(map(tuple, got.collect())) == sorted([("v", *t) for t in taken] + [("w", 0.0, 1.0)])
    assert "collect_list" not in got._jdf.queryExecution().toString()


def test_two_steps_over_hubs(spark, monkeypatch):
    """Against sets, with every size of what counts as a hub, a tile and a list; hubs that lead to each other, loops and a start that is alone."""
    rng = random.Random(4)
    pairs = {(rng.randrange(40), int(rng.randrange(40) ** 2 / 60)) for _ in range(110)} | {(5, 5), (0, 1), (1, 2), (0, 2), (50, None), (51, 52)}
    e = spark.createDataFrame(sorted(pairs, key=str), "src int, dst int").cache()
    starts = spark.createDataFrame([(n,) for n in (*range(0, 40, 2), 1, 51, 52, 60, 0)], "start int")
    to = {}
    for a, b in pairs:
        if b is not None:
            to.setdefault(a, set()).add(b)
            to.setdefault(b, set()).add(a)
    want, shown = [], []
    for s in {r.start for r in starts.collect()}:
        one = to.get(s, set()) - {s}
        two = {n for m in to.get(s, ()) for n in to[m]} - one - {s}
        want += [(s, n, 1) for n in one] + [(s, n, 2) for n in two]
        first = [(1, n) for n in sorted(one)] + [(2, n) for n in sorted(two)]
        shown += [(s, n, d, len(first)) for i, (d, n) in enumerate(first[:6]) if sum(x == d for x, _ in first[:i]) < 3]
    for hub, tile, few in ((6, 3, 0), (0, 2, 256)):
        monkeypatch.setattr(G, "HUB", hub)
        monkeypatch.setattr(G, "TILE", tile)
        monkeypatch.setattr(G, "FEW", few)
        assert sorted(map(tuple, G.neighbours(starts, e, 2).collect())) == sorted(want)
        assert sorted(map(tuple, G.context(starts, e, 2, 6, 3).collect())) == sorted(shown)


def test_companions_are_the_first_of_all(spark):
    """Against sets: crowded frames and entities, starts with few at one step, and none."""
    rng = random.Random(5)
    rows = [(f, rng.randrange(60)) for f in range(12) for _ in range(rng.choice([1, 2, 3, 30]))] + [(100, 70), (100, 71), (101, 71), *[(101, n) for n in range(40)], (102, 80), (102, 80)]
    rows += [(f, 90 + f % 2) for f in range(200, 240)] + [(f, f) for f in range(200, 240)]
    df = spark.createDataFrame(rows, "frame_id int, entity_id int")
    for k in (1, 4, 9):
        want = []
        for s in range(0, 100, 5):
            near = lambda xs: {n for f, n in rows if any((f, x) in rows for x in xs)}
            one = near({s}) - {s}
            two = near(one) - one - {s}
            want += ([(s, n, 1) for n in sorted(one)] + [(s, n, 2) for n in sorted(two)])[:k]
        starts = spark.createDataFrame([(s,) for s in range(0, 100, 5)], "start int")
        assert sorted(map(tuple, G.companions(df, starts, k).collect())) == sorted(want)
