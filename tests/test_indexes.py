"""The vector index and the full-text index against what looks at everything."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenweave.operators import fulltext
from lumenweave.operators import search as R
from lumenweave.operators.fulltext import FullTextIndex
from lumenweave.operators.vectors import VectorIndex
from lumenweave.plans import queries as Q
from lumenweave.plans import views as V
from lumenweave.session import new_path
from tests.compare import DATA


def found(df):
    return sorted((r.query, r.node, round(r.score, 6)) for r in df.collect())


def alike(got, want):
    assert [g[:2] for g in got] == [w[:2] for w in want] and all(abs(g[2] - w[2]) < 2e-6 for g, w in zip(got, want, strict=True))


@pytest.mark.parametrize("d", ["/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_of_the_registered_searches(spark, d):
    n = V.vectors(spark, d).cache()
    q = n.where("node_id % 20 = 0")
    want = found(R.nearest(q, n, 10, 0.2))
    alike(found(Q.vector_search(spark, d)), want)
    probed = {(r.query, r.node) for r in Q.vector_search_probed(spark, d).collect()}
    assert len(probed & {w[:2] for w in want}) >= 0.9 * len(want)


def clustered(seed, n=3000, groups=20, size=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, size))
    return [(i, int(i % 7), (centres[i % groups] + 0.15 * rng.normal(size=size)).astype("float32").tolist()) for i in range(n)]


def test_clustered_vectors_need_few_cells(spark):
    n = spark.createDataFrame(clustered(1), "node_id long, video_id int, v array<float>").cache()
    q = n.where("node_id % 50 = 0")
    index = VectorIndex.build(n, group="video_id", rows=40)
    probes = index.tuned(q, 10)
    assert probes <= len(index.centroids) // 4
    want = found(R.nearest(q, n, 10, -1.0))
    got = found(index.search(q, 10, probes=probes, exact=False))
    assert len({w[:2] for w in want} & {g[:2] for g in got}) >= 0.9 * len(want)
    # the exact way looks into more cells, but not into all, and misses nothing
    alike(found(index.search(q, 10, probes=1)), want)
    first = index.search(q, 10, probes=probes, exact=False)
    floors = q.join(first.groupBy("query").agg(F.min("score").alias("floor")), F.col("node_id") == F.col("query")).select(F.col("node_id").alias("id"), F.lit(None).cast("string").alias("g"), "v", "floor")
    looked = index._routed(floors, probes, True).count() + index._routed(floors, probes, False).count()
    assert looked < 0.6 * q.count() * int(index.slices.sum())
    alike(found(index.search(q, 10, 0.3, group="video_id", probes=2)), found(R.nearest(q, n, 10, 0.3, group="video_id")))


def test_index_of_equal_few_and_no_vectors(spark):
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(50)] + [(100, None), (101, [0.0, 0.0])], "node_id long, v array<float>")
    got = found(VectorIndex.build(same, rows=7).search(same.where("node_id = 49"), 3, 0.5, probes=1))
    assert got == [(49, 0, 1.0), (49, 1, 1.0), (49, 2, 1.0)]
    none = same.where("node_id < 0")
    index = VectorIndex.build(none)
    assert index.search(same, 3).collect() == [] and index.tuned(same, 3) == 1
    assert VectorIndex.build(same).search(none, 3).collect() == []


# full text


def brute(docs, queries, k):
    words = {i: re.findall("[a-z0-9]+", (t or "").lower()) for i, t in docs}
    avg, n = sum(map(len, words.values())) / max(len(words), 1) or 1.0, len(words)
    df, tf = Counter(), {i: Counter(w) for i, w in words.items()}
    for c in tf.values():
        df.update(c.keys())
    out = []
    for query, terms in queries.items():
        scores = Counter()
        for i, c in tf.items():
            for t in set(terms):
                if c[t]:
                    scores[i] += math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * len(words[i]) / avg))
        best = sorted(((-round(s, 9), i) for i, s in scores.items()))[:k]
        out += [(query, i, round(-s, 6)) for s, i in best]
    return sorted(out)


def asked(spark, queries):
    return spark.createDataFrame([(q, t) for q, terms in queries.items() for t in terms], "query string, term string")


def test_fulltext_index_is_the_scan(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(200)]
    docs = [(i, " ".join(rng.choices(vocabulary, [1 / (r + 1) for r in range(200)], k=int(rng.lognormvariate(3, 1))))) for i in range(1500)]
    docs += [(2000, None), (2001, ""), (2002, "... --"), (2003, docs[0][1]), (2004, docs[0][1])]
    path = new_path(spark, "index")
    FullTextIndex.build(spark.createDataFrame(docs, "node_id long, text string"), path, rows=64)
    index = FullTextIndex.open(spark, path)  # as a later session would
    queries = {f"q{i}": rng.choices(vocabulary, k=rng.randrange(1, 5)) for i in range(25)} | {"common": ["w0"], "twice": ["w3", "w3"], "unheard": ["nothing"], "part": ["w5", "nothing"]}
    assert found(index.search(asked(spark, queries), 5)) == brute(docs, queries, 5)
    other = {"again": ["w7", "w90"]}
    assert found(index.search(asked(spark, other), 2000)) == brute(docs, other, 2000)


def test_fulltext_search_skips_blocks(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(["common"] * rng.randrange(1, 4) + rng.choices("abcdefgh", k=rng.randrange(1, 300)))) for i in range(3000)]
    index = FullTextIndex.build(spark.createDataFrame(docs, "node_id long, text string"), new_path(spark, "index"), rows=32)
    weighted = index.weighted(asked(spark, {"q": ["common"], "r": ["common", "a"]}))
    early, _, late = index.phases(weighted, 10)
    read = early.unionByName(late.select(*early.columns)).agg(F.sum("n")).first()[0]
    there = index.bounds(weighted).agg(F.sum("n")).first()[0]
    assert read < 0.5 * there
    assert found(index.search(asked(spark, {"q": ["common"], "r": ["common", "a"]}), 10)) == brute(docs, {"q": ["common"], "r": ["common", "a"]}, 10)


def test_fulltext_index_of_nothing(spark):
    index = FullTextIndex.build(spark.createDataFrame([], "node_id long, text string"), new_path(spark, "index"))
    assert index.search(asked(spark, {"q": ["a"]}), 5).collect() == []
    assert index.search(asked(spark, {"q": ["a"]}).where("false"), 5).collect() == []


def test_one_query_reads_little_of_the_index(spark):
    index = FullTextIndex.build(spark.read.parquet(f"{DATA}/documents.parquet"), new_path(spark, "index"), "doc_id")
    plan = index.bounds(index.weighted(asked(spark, {"q": ["the"]})))._jdf.queryExecution().executedPlan().toString()
    assert "posts" not in plan.split("ReadSchema")[-1]


def test_children_meet_in_blocks(spark):
    """Against all pairs, with ties, a vector of no length, none at all, and blocks of a few rows."""
    rng = np.random.default_rng(3)
    some = rng.normal(size=(20, 5)).round(1)
    kids = [(p, n, None if n == 5 else [0.0] * 5 if n == 6 else some[n % 20].tolist()) for p in range(3) for n in range(p, 60, p + 1)]
    asks = [(q, p, some[q % 20].tolist()) for q in range(25) for p in (q % 3, 7)]
    want = []
    for q, p, v in asks:
        scored = []
        for kp, n, w in kids:
            if kp == p:
                a, b = np.float32(v).astype(float), np.float32(w or [0.0] * 5).astype(float)
                length = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
                scored.append((-sum(x * y for x, y in zip(a, b, strict=True)) / length if length else 0.0, n))
        want += [(q, p, n, round(-s, 9)) for s, n in sorted(scored)[:4]]
    a, c = spark.createDataFrame(asks, "query long, parent long, q array<float>"), spark.createDataFrame(kids, "parent long, node long, v array<float>")
    for rows in (7, 20_000):
        found = R.best_children(a, c, 4, rows)
        assert sorted((r.query, r.parent, r.node, round(r.score, 9)) for r in found.collect()) == sorted(want)
        # no join has vectors of both sides
        assert not [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x and " q" in x and " v" in x]


def test_many_queries_are_scored_by_blocks(spark, monkeypatch):
    """Against the scan, for blocks and parts of a few, texts of one word, and ties over blocks; no posting is written out a query."""
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(vocabulary, [1 / (r + 1) for r in range(60)], k=rng.choice([1, 2, 5, 40])))) for i in range(400)] + [(500, None), (501, "W0 w0")]
    queries = {f"q{i}": rng.choices(vocabulary, k=rng.randrange(1, 5)) for i in range(40)} | {"unheard": ["nothing"], "part": ["w5", "nothing"]}
    index = FullTextIndex.build(spark.createDataFrame(docs, "node_id long, text string"), new_path(spark, "index"), rows=16)
    monkeypatch.setattr(fulltext, "BLOCK", 90)
    monkeypatch.setattr(fulltext, "QUERIES", 15)
    got = index.search(asked(spark, queries), 6)
    assert found(got) == brute(docs, queries, 6)
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().toString() and "explode(posts" not in got._jdf.queryExecution().toString()
