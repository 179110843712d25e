"""Versions of a table: each step may fail, and two may write."""

import os

import pytest
from pyspark.sql import functions as F

from lumenweave.operators import sinks as K
from lumenweave.operators import tables as B
from lumenweave.plans import catalog, queries, registry
from lumenweave.session import new_path
from tests.compare import same


def rows(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "k long").coalesce(1)


def held(spark, path):
    return sorted(r.k for r in B.read(spark, path).collect())


def test_a_version_follows_a_plain_folder(spark):
    path = new_path(spark, "versions")
    rows(spark, 1, 2).write.parquet(path)
    assert B.version(spark, path) == 0 and held(spark, path) == [1, 2]
    B.replace(B.read(spark, path).where("k > 1"), path)
    assert B.version(spark, path) == 1 and held(spark, path) == [2]
    B.add(rows(spark, 7), path)
    B.add(rows(spark, 8), path)
    assert B.version(spark, path) == 3 and held(spark, path) == [2, 7, 8]
    other = new_path(spark, "plain")
    rows(spark, 1).write.parquet(other)
    B.add(rows(spark, 2), other)
    assert held(spark, other) == [1, 2]


def test_a_failed_write_changes_nothing(spark, monkeypatch):
    path = new_path(spark, "versions")
    B.replace(rows(spark, 1), path)
    with pytest.raises(Exception, match="no good"):  # while rows are written
        B.replace(B.read(spark, path).select(F.raise_error(F.lit("no good")).cast("long").alias("k")), path)
    assert held(spark, path) == [1] and B.version(spark, path) == 1

    def fails(*_):
        raise OSError("between the rows and the switch")

    with monkeypatch.context() as m:
        m.setattr(B, "_commit", fails)
        with pytest.raises(OSError):
            B.replace(rows(spark, 2), path)
    assert held(spark, path) == [1]
    B.replace(rows(spark, 3), path)
    assert held(spark, path) == [3] and B.version(spark, path) == 2


def test_of_two_writers_one_is_told(spark):
    path = new_path(spark, "versions")
    B.replace(rows(spark, 1, 2, 3), path)
    seen = B.version(spark, path)
    mine = B.read(spark, path).where("k <> 1")
    K.delete(spark, path, F.col("k") == 2)  # another writer is first
    with pytest.raises(B.Conflict):
        B.replace(mine, path, seen)
    assert held(spark, path) == [1, 3]


def test_added_rows_meet_no_conflict(spark, monkeypatch):
    path = new_path(spark, "versions")
    B.add(rows(spark, 1), path)
    real, once = B._commit, []

    def late(spark, path, number, folders, keep=2):
        if not once:  # another adds in between
            once.append(True)
            other = "v-other"
            rows(spark, 50).write.parquet(f"{path}/{other}")
            real(spark, path, number, [*(f.removeprefix(f"{path}/") for f in B._folders(spark, path, number - 1)), other])
        return real(spark, path, number, folders, keep)

    monkeypatch.setattr(B, "_commit", late)
    B.add(rows(spark, 2), path)
    assert held(spark, path) == [1, 2, 50]


def test_a_reader_goes_on_while_the_next_version_is_written(spark):
    path = new_path(spark, "versions")
    B.replace(rows(spark, 1), path)
    before = B.read(spark, path)
    B.replace(rows(spark, 2), path)
    assert [r.k for r in before.collect()] == [1]
    B.replace(rows(spark, 3), path)  # two versions stay
    folders = [f for f in os.listdir(path.removeprefix("file:")) if f.startswith("v-")]
    assert len(folders) == 2 and held(spark, path) == [3]


def test_a_new_row_meets_no_part_of_its_number(spark, tmp_path):
    rows = [(1_000_000, "ring", "Brand#7", "LARGE", 5), (1, "bolt", "Brand#1", "PROMO", 20), (2, "rod", "Brand#1", "PROMO", 30), (3, "rod", None, "SMALL", 30)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    same(catalog.changed_rows(spark, str(tmp_path)), registry.ORACLE_SQL["changed_rows"], str(tmp_path))


def test_children_of_equal_place_come_by_their_part(spark, tmp_path):
    """The SQL leaves rows of one price and line open; here they have an order, whatever the files'."""
    rows = [(1, p, 5.0, 1) for p in (9, 3, 7)] + [(1, 1, 4.0, 1), (2, 8, 5.0, 2), (2, 6, 5.0, 1), (2, 4, 5.0, 1)]
    for n, given in enumerate((rows, rows[::-1])):
        spark.createDataFrame(given, "l_orderkey long, l_partkey long, l_extendedprice double, l_linenumber int").coalesce(1).write.parquet(f"{tmp_path}/{n}/lineitem.parquet")
        got = queries.top_children(spark, f"{tmp_path}/{n}").collect()
        assert sorted(map(tuple, got)) == [(1, 3, 1), (1, 7, 2), (2, 4, 1), (2, 6, 2)]
