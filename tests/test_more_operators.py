"""Edges of the payload, sampling, discovery, gold and table operators: nulls, empty tables, ties."""

import pytest
from pyspark.sql import functions as F

from lumenweave.functions import payload as P
from lumenweave.functions import scalar as S
from lumenweave.functions import text as X
from lumenweave.operators import assistant as T
from lumenweave.operators import discovery as D
from lumenweave.operators import gold as G
from lumenweave.operators import graph as N
from lumenweave.operators import sampling as A
from lumenweave.operators import scope as C
from lumenweave.operators import search as R
from lumenweave.operators import sinks as K
from lumenweave.operators import tables as B
from lumenweave.session import new_path
from tests.compare import DATA


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def text(s):
    return F.lit(s).cast("string")


def test_payloads(spark):
    flat = '["person", {"name": "screen"}, {"entity": "Databricks"}, [{"text": "nested"}, "caption"], 42]'
    assert one(spark, P.strings(P.value(text(flat)))) == ["person", "screen", "Databricks", "nested", "caption"]
    for bad in (None, "", "no json", "[1, 2"):
        v = P.value(text(bad))
        assert one(spark, P.strings(v)) == [] and one(spark, P.labels(v)) == [] and one(spark, P.caption(v)) is None
        assert one(spark, P.object_text(text(bad))) == "{}" and one(spark, P.list_text(text(bad))) == "[]"
    assert one(spark, P.string_field(P.value(text('{"a": 1, "b": " ", "c": " x "}')), ["a", "b", "c"])) == "x"
    assert one(spark, P.secret_paths(text(None))) == []
    assert one(spark, P.bool_of(text(None), True)) is True and one(spark, P.bool_of(text(" No "), True)) is False
    for wrong in (P.bool_of(text("maybe"), True), P.bounded(F.lit(500.0), 120, 1, 240)):
        with pytest.raises(Exception):
            one(spark, wrong)
    assert one(spark, P.string_set(text(None))) == [] and one(spark, P.metadata_text(F.lit(True))) == "true"
    assert one(spark, P.preview(P.value(text('{"a": {"b": 1}, "c": 2}')), ["x", "a"])) == '{"b":1}'


def test_texts_and_numbers(spark):
    assert one(spark, X.is_valid_content(text(None))) is False and one(spark, X.is_valid_content(text("a dog"))) is True
    assert one(spark, X.capitalised_topics(text("The Cat saw Mouse, (Other) mouse. Video!"))) == ["Mouse", "Video"]
    assert one(spark, X.artifact_id(text("none"))) is None
    assert one(spark, S.decode_seek(F.lit(0.5), 1.0)) == 0 and one(spark, S.decode_seek(F.lit(10.0), 1.0)) == 5
    assert one(spark, S.rate(F.lit(None).cast("double"), F.lit(4.0))) == 0 and one(spark, S.rate(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, S.spread(F.array(F.lit(1.0), F.lit(2.0)), 4)) == [1, 2]
    assert S.normalised({"a": 1, "b": 3}) == {"a": 0.25, "b": 0.75} and S.normalised({}) == {}


def test_sampling(spark):
    videos = spark.createDataFrame([(1, 0.0), (2, 100.0), (3, 630.0), (4, 1300.0), (5, None)], "video_id int, d double")
    got = {}
    for r in A.audio_chunks(videos, "d", 600, 30, 45, 2).collect():
        got.setdefault(r.video_id, []).append((r.n, r.start, r.end, r.covered))
    assert got == {2: [(0, 0, 100, True)], 3: [(0, 0, 600, True), (1, 570, 630, True)], 4: [(0, 0, 600, False), (1, 570, 1170, False)]}
    assert one(spark, A.frame_times(F.lit(10.0), F.lit("uniform"), 1, 1, 3, 9)) == [0, 5, 9.9]
    assert one(spark, A.frame_times(F.lit(0.0), F.lit("uniform"), 1, 1, 3, 9)) == []
    assert one(spark, A.evenly(F.array(*map(F.lit, range(7))), 3)) == [0, 3, 6] and one(spark, A.evenly(F.array(F.lit(1)), 3)) == [1]
    empty = A.semantic_clusters(spark.createDataFrame([], "video_id int, n int, v array<double>"), "video_id", ["n"], "v")
    assert empty.collect() == []
    rows = [(1, i, v) for i, v in enumerate([[1.0, 0.0], [0.9, 0.1], [0.0, 1.0], [0.0, 0.0]])]
    assert [r.cluster for r in A.semantic_clusters(spark.createDataFrame(rows, "video_id int, n int, v array<double>"), "video_id", ["n"], "v").orderBy("n").collect()] == [0, 0, 1, 2]


def test_scope(spark):
    rows = spark.createDataFrame([(1, 7), (2, 7), (3, 8), (4, None)], "video_id int, user_id int")
    ids = lambda df: sorted(r.video_id for r in df.collect())
    assert ids(C.scope(rows)) == [1, 2, 3, 4] and ids(C.scope(rows, 7)) == [1, 2] and ids(C.scope(rows, 7, [])) == [] and ids(C.scope(rows, 7, [2, 3], 1)) == [2]
    assert C.time_range(None, 3) is None and C.time_range(1, 3) == (1, 3)


def test_vector_search_against_all_pairs(spark):
    n = spark.read.parquet(f"{DATA}/embeddings.parquet").select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("v"))
    q = n.where("node_id % 20 = 0")
    exact = {(r.query, r.node) for r in R.nearest(q, n, 5, -1.0, rows=64).collect()}
    assert exact == {(r.query, r.node) for r in R.nearest(q, n, 5, -1.0).collect()} and len(exact) == 5 * q.count()
    assert R.nearest(q, n.limit(0), 5, 0.0).collect() == []


def test_search_edges(spark):
    docs = spark.createDataFrame([(1, "a cat"), (2, None), (3, "Cat cat dog")], "id int, text string")
    assert {r.id for r in R.bm25(docs, ["cat"], "id", "text").collect()} == {1, 3} and R.bm25(docs.limit(0), ["cat"], "id", "text").collect() == []
    rows = spark.createDataFrame([("a", i, s) for i, s in enumerate([5, 9, 4, 1])], "k string, o int, size int")
    assert sorted(r.o for r in R.fitting(rows, "k", ["o"], "size", 10, 6).collect()) == [0, 2, 3]
    assert D.unseen(docs.select(F.lit(" Cat").alias("name")), docs.select(F.lit("cat ").alias("name")), "name").collect() == []


def test_gold_of_nothing(spark):
    rows = spark.createDataFrame([(1, 1, "t", None, None, None, None), (1, 2, "t", "", "", ["A", "a"], 3)], "frame_id int, nth int, task string, caption string, ocr_text string, labels array<string>, tokens int")
    r = G.frame_understanding(rows).first()
    assert (r.description, r.ocr_text, r.objects, r.tokens) == (None, None, ["A"], 3)
    assert G.frame_understanding(rows.limit(0)).collect() == []


def test_tables_in_folders(spark):
    path = new_path(spark, "t")
    base = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (None, "c", 0)], "k int, v string, created_at int")
    base.write.parquet(path)
    K.upsert(spark.createDataFrame([(1, "x"), (1, "y"), (None, "z"), (3, "n")], "k int, v string"), path, ["k"])
    assert sorted((str(r.k), r.v) for r in B.read(spark, path).collect()) == [("1", "y"), ("2", "b"), ("3", "n"), ("None", "z")]
    assert K.delete(spark, path, F.col("k") > 1) == 2 and K.delete(spark, path, F.col("k") > 1) == 0
    K.change(spark, path, F.col("v") == "z", {"v": F.lit(None)})
    assert sorted(str(r.v) for r in B.read(spark, path).collect()) == ["None", "y"]
    one_, two = (K.manifest(base.orderBy(F.col("v").asc() if up else F.col("v").desc()), "k", ["k", "v"]).first() for up in (True, False))
    assert one_ == two and one_.n == 3
    assert B.equal_quotas(base, "v", "k", 2).count() == 2 and B.equal_quotas(base, "v", "k", 9).count() == 3


def test_artifacts_of_a_question(spark):
    refs = spark.createDataFrame([("k", i, a, "search", s) for i, (a, s) in enumerate([("old", "red cars"), ("a", "blue car"), ("a", "red car and red bus"), ("", "red car"), (None, "red car"), ("b", "a bus"), ("c", "Red things")])], "k string, n int, artifact_id string, tool string, summary string")
    ask = lambda q: spark.createDataFrame([("k", q)], "k string, question string")
    pick = lambda q, **o: [(r.nth, r.artifact_id, r.summary) for r in T.artifacts_for(refs, ask(q), "k", **o).orderBy("nth").collect()]
    assert pick("the red bus") == [(1, "a", "red car and red bus"), (2, "c", "Red things")]
    assert pick("the red bus", last=2) == [(1, "c", "Red things"), (2, "b", "a bus")]
    assert pick("nothing like it") == [] and pick(None) == []
    # detail is wanted: the latest, whatever they say
    assert pick("every detail please") == [(1, "c", "Red things"), (2, "b", "a bus")]
    wanted = spark.createDataFrame([("k", 0, "gone"), ("k", 1, "a"), ("k", 2, "old"), ("k", 3, "c")], "k string, place int, artifact_id string")
    named = T.artifacts_named(refs, wanted, "k")
    assert [(r.nth, r.artifact_id) for r in named.orderBy("nth").collect()] == [(1, "a"), (2, "old")]
    stored = spark.createDataFrame([("a", "x", "1" * 50), ("old", None, "2" * 50), ("c", "x", "")], "artifact_id string, tool string, preview string")
    all_ = T.artifacts_named(refs, wanted, "k", most=9)
    assert [r.snippet for r in T.rehydrated(all_, stored, "k").orderBy("nth").collect()] == ["[artifact:a] search\nsummary: red car and red bus\npayload: " + "1" * 50, "[artifact:old] search\nsummary: red cars\npayload: " + "2" * 50]
    assert T.rehydrated(all_, stored, "k", 150).count() == 1 and T.rehydrated(all_, stored, "k", 20).count() == 0


def test_shortest_paths_up(spark):
    nodes = spark.createDataFrame([(n, label, u) for n, label, u in [("v", "Video", 1), ("w", "Video", 2), ("c", "Chapter", 1), ("s", "Scene", 1), ("t", "Scene", 2), ("f", "Frame", 1), ("x", "Frame", 1), ("y", "Frame", 1)]], "node string, label string, user int")
    up = spark.createDataFrame([("f", "s"), ("f", "t"), ("s", "c"), ("c", "v"), ("t", "w"), ("t", "v"), ("x", "y"), ("y", "x")], "child string, parent string")
    paths = lambda **o: {r.node: r.path for r in N.shortest_up(nodes.where("label IN ('Frame', 'Video')"), up, nodes, "Video", **o).collect()}
    assert paths() == {"f": ["f", "t", "v"], "v": ["v"], "w": ["w"]}
    # a scene of another user is on the shorter way
    assert paths(user=1) == {"f": ["f", "s", "c", "v"], "v": ["v"]}
    assert paths(user=1, most=2) == {"v": ["v"]}
    assert paths(beam=1) == {"f": ["f", "s", "c", "v"], "v": ["v"], "w": ["w"]}


def test_pooling(spark):
    m = spark.createDataFrame([("a", [3.0, 0.0], 1.0), ("a", [0.0, 8.0], 0.5), ("a", None, 9.0), ("b", [0.0, 0.0], 1.0)], "k string, v array<float>, w double")
    by = lambda df: {r.k: [round(x, 6) for x in r.pooled] for r in df.where("k = 'a'").collect()}
    assert by(R.pool(m, "k", "v")) == {"a": [round(3 / 73**0.5, 6), round(8 / 73**0.5, 6)]}
    assert by(R.pool(m, "k", "v", "w")) == {"a": [0.6, 0.8]} and by(R.pool(m, "k", "v", strategy="max")) == by(R.pool(m, "k", "v"))
    with pytest.raises(ValueError):
        R.pool(m, "k", "v", strategy="median")


def test_topics_of_a_long_text_take_one_pass(spark):
    """The words are split once, not once for each of them: a text of 60,000 words takes seconds."""
    words = [f"Word{i % 997}" if i % 3 else f"wORD{i % 997}!" for i in range(60_000)]
    want = [f"Word{i}" for i in range(1, 15) if i % 3][:10]
    got = spark.createDataFrame([(1, "Zero, ZERO the That " + " ".join(words)), (2, None), (3, "")], "id int, text string")
    plan = got.select("id", X.capitalised_topics(F.col("text")).alias("t"))
    assert {r.id: r.t for r in plan.collect()} == {1: ["Zero", *want][:10], 2: None, 3: []}
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
