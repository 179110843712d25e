import pytest
from pyspark.sql import functions as F

from lumenweave.operators import graph
from lumenweave.operators import nodes as N
from lumenweave.operators import tables as B
from lumenweave.operators.graph import same_entities


def test_batches_create_what_is_not_there_yet(spark, tmp_path):
    nodes, edges = str(tmp_path / "nodes"), str(tmp_path / "edges")
    videos = spark.createDataFrame([("v", "u"), ("w", None), ("v", "u"), (None, "x")], "video_id string, user_id string")
    rows = spark.createDataFrame([("a", "v", None, 1, ["x", "y"]), ("b", "v", "own", 2, []), ("a", "v", None, 1, ["x", "y"]), ("c", "gone", None, 3, None), (None, "v", None, 4, None), ("d", "w", None, None, None), ("e", None, None, 5, None)], "id string, video_id string, user_id string, community_id int, themes array<string>")
    at = F.lit("2024-01-01").cast("timestamp")
    N.create_nodes(rows.where("id = 'a'"), videos, "Community", nodes, edges, at)
    N.create_nodes(rows, videos, "Community", nodes, edges, at)
    N.create_nodes(rows, videos, "Community", nodes, edges, at)
    got = {r.id: r for r in B.read(spark, nodes).collect()}
    assert B.read(spark, nodes).count() == 3 and set(got) == {"a", "b", "d"}
    assert got["a"].user_id == "u" and got["b"].user_id == "own" and got["d"].user_id is None
    assert got["a"].themes_text == "x, y" and got["b"].themes_text == got["d"].themes_text == "" and got["a"].title is None
    want = {("v", "a", "CONTAINS"), ("v", "b", "CONTAINS"), ("w", "d", "CONTAINS")}
    assert sorted(map(tuple, B.read(spark, edges).collect())) == sorted(want)
    rels = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "zz"), (None, "b")], "src string, dst string")
    for _ in range(2):
        N.create_relationships(rels, B.read(spark, nodes), edges, "NEXT")
    assert sorted(map(tuple, B.read(spark, edges).collect())) == sorted(want | {("a", "b", "NEXT")})


def test_an_edge_lost_between_the_writes_comes_with_the_repeat(spark, tmp_path):
    nodes, edges = str(tmp_path / "nodes"), str(tmp_path / "edges")
    videos = spark.createDataFrame([("v", "u")], "video_id string, user_id string")
    rows = spark.createDataFrame([("s1", "v", 1.5)], "id string, video_id string, start_time double")
    N.create_nodes(rows, videos, "Scene", nodes)
    N.create_nodes(rows, videos, "Scene", nodes, edges)
    assert B.read(spark, nodes).count() == B.read(spark, edges).count() == 1
    assert B.read(spark, nodes).columns == [f.split()[0] for f in N.schema_of("Scene").split(", ")]


def test_rows_that_depend_on_a_version_tell_of_another_writer(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(2)
    B.add(rows, path)
    since = B.version(spark, path)
    B.add(rows, path)
    with pytest.raises(B.Conflict):
        B.add(rows, path, since)
    assert B.read(spark, path).count() == 4


def test_entities_of_no_user_are_the_same_as_none(spark):
    rows = [(1, "red car", "thing", "v", "u"), (2, "red car", "thing", "w", "u"), (3, "the red car", "thing", "x", "u"), (4, "red car", "thing", "y", "other"), (5, "red car", "thing", "v", None), (6, "red car", "thing", "w", None), (7, "red car", "place", "w", "u"), (8, None, "thing", "w", "u")]
    df = spark.createDataFrame(rows, "id int, name string, kind string, video string, user string")
    assert sorted(map(tuple, same_entities(df, "id", "name", "kind", "video", user="user").collect())) == [(1, 2, 1.0), (1, 3, 0.7), (2, 3, 0.7)]


def test_the_same_is_found_by_names_and_tiles(spark, monkeypatch):
    """Against all pairs; pairs of ids that are one row each are not gathered again, and no side is broadcast."""
    monkeypatch.setattr(graph, "TILE", 3)
    names = ["red car", "the red car", "red", "car", "Red car", "the red cart", "blue cart", None]
    rows = [(n, names[n * 7 % 8], f"kind {n % 2}" if n % 11 else None, n % 5 if n % 13 else None, f"user {n % 3}" if n % 7 else None) for n in range(120)]
    odd = rows + [(3, "red car", "kind 0", 4, "user 0"), (3, "red car", "kind 0", 1, "user 0"), (4, "red car", "kind 0", 2, "user 0")]
    for given, user in ((rows, False), (rows, True), (odd, False), (odd, True)):
        want = {}
        for x in given:
            for y in given:
                if None in (x[1], x[2], x[3], y[1], y[2], y[3]) or x[2] != y[2] or x[3] == y[3] or user and (x[4] is None or x[4] != y[4] or x[0] == y[0]):
                    continue
                if x[1] == y[1] or min(len(x[1]), len(y[1])) > 3 and x[1] in y[1]:
                    pair = min(x[0], y[0]), max(x[0], y[0])
                    want[pair] = max(want.get(pair, 0), 1.0 if x[1] == y[1] else 0.7)
        df = spark.createDataFrame(given, "id int, name string, kind string, video int, user string")
        found = same_entities(df, "id", "name", "kind", "video", user="user" if user else None)
        assert sorted(map(tuple, found.collect())) == sorted((a, b, s) for (a, b), s in want.items())
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "BroadcastHashJoin" not in plan and ("HashAggregate" in plan) == (given is odd)
