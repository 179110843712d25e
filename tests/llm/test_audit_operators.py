"""Fingerprints, divergence and whitening against brute force, SQL and numpy."""

import hashlib
import random
import re
import struct
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lumenweave.llm import divergence as V
from lumenweave.llm import fingerprints as P
from lumenweave.llm import queries as Q
from lumenweave.llm import whitening as W
from tests.compare import DATA
from tests.llm.test_operators import CLASH, TEXTS, awkward, empty, rows_of, sql_same  # noqa: F401

MORE = ["range", "place", "own", "next", "edited", "sha", "fingerprint", "_p", "_g", "_z", "_s", "_f", "_k", "lang2", "term", "docs", "sources", "counts", "part", "item", "value", "rank", "x", "c", "i", "high", "low", "to", "component"]


@pytest.fixture(scope="module")
def clashing(awkward):  # noqa: F811
    return awkward.withColumns({c: F.lit(f"other {c}") for c in MORE})


# fingerprints

ALONE = "⺀-꓏가-힯豈-﫿\U00020000-\U0003ffff"
PIECE = re.compile(rf"[{ALONE}]|[^ \t\n\x0b\f\r{ALONE}]{{1,16}}")


def _chain(longs):
    h = 42
    for v in longs:
        h = xxhash.xxh64_intdigest(struct.pack("<q", v), seed=h)
    return _signed(h)


def brute_fingerprint(text, k=3, length=2, bits=6):
    p = [_signed(xxhash.xxh64_intdigest(m.encode(), seed=42)) for m in PIECE.findall(text)]
    grams = [_chain(p[i : i + k]) for i in range(max(len(p) - k + 1, min(len(p), 1)))]
    seen, rows = Counter(), []
    for i, g in enumerate(grams):
        rows.append((_number(g, seen[g]), i, g))
        seen[g] += 1
    buckets = defaultdict(list)
    for h, i, g in sorted(rows):
        buckets[h >> (64 - bits)].append((i, g))
    out = []
    for b in range(-(1 << bits - 1), 1 << bits - 1):
        own = [g for _, g in sorted(buckets[b][:length])] if b in buckets else None
        out.append("-" * 8 if own is None else f"{_chain(own) & (2**64 - 1):016x}"[-8:])
    return "".join(out)


def _signed(h):
    return h - (1 << 64) if h >= 1 << 63 else h


def _number(g, n):
    """xxhash64 of a long and an int."""
    return _signed(xxhash.xxh64_intdigest(struct.pack("<i", n), seed=xxhash.xxh64_intdigest(struct.pack("<q", g), seed=42)))


def brute_likeness(a, b):
    x, y = ([f[i : i + 8] for i in range(0, len(f), 8)] for f in (a, b))
    some = [(p, q) for p, q in zip(x, y, strict=True) if p != "-" * 8 or q != "-" * 8]
    return 1.0 if a == b else sum(p == q for p, q in some) / max(len(some), 1)


def brute_fingerprints(rows):
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, _signed(xxhash.xxh64_intdigest(r[1].encode(), seed=42))))
    out = []
    for at, (i, t) in enumerate(order):
        after = order[(at + 1) % len(order)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + after[:half]
        f, g, n = brute_fingerprint(t), brute_fingerprint(e), brute_fingerprint(after)
        out.append((str(i), len(t), hashlib.sha256(e.encode()).hexdigest(), f, g, round(brute_likeness(f, g), 12), round(brute_likeness(f, n), 12)))
    return sorted(out)


def told(df):
    return sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 12), round(r.near_next, 12)) for r in df.collect())


def test_fingerprints_of_awkward_rows(clashing):
    assert told(P.fingerprints(clashing)) == brute_fingerprints(rows_of(clashing))


def test_fingerprints_query(spark):
    docs = rows_of(spark.read.parquet(f"{DATA}/documents.parquet"))
    assert told(Q.op11_fingerprints(spark, DATA)) == brute_fingerprints(docs)


@pytest.mark.parametrize("rows", [[], [(5, "only one document, its own next")], [(1, None), (2, "")], [(7, "same row")] * 40, [(None, "a b c d e f")] * 3])
def test_fingerprints_of_few_rows(spark, rows):
    assert told(P.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_fingerprints(rows)


def test_fingerprints_of_ids_in_many_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(10**12), " ".join(rng.choices("abcdefgh", k=rng.randrange(30)))) for _ in range(700)] + [(5, f"text {i}") for i in range(400)]
    assert told(P.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(9))) == brute_fingerprints(rows)


def test_fingerprints_feel_order_and_edits(spark):
    rng = random.Random(1)
    words = [f"word{rng.randrange(10**6)}" for _ in range(600)]
    swapped = words[300:] + words[:300]
    edits = {0: words, 1: [*words[:100], "new", *words[101:]], 2: words[:300] + [f"other{i}" for i in range(300)], 3: swapped, 4: rng.sample(words, 600)}
    df = P.with_fingerprint(spark.createDataFrame([(i, " ".join(w)) for i, w in edits.items()], "i int, t string"), "t", "f")
    f = {r.i: r.f for r in df.collect()}
    near = {i: brute_likeness(f[0], f[i]) for i in edits}
    assert near[0] == 1 and near[1] > 0.9 and 0.05 < near[2] < 0.5 and near[4] == 0
    # the same k-mers in another order: a set of them would be almost as before
    assert near[3] < 0.8


# divergence


def test_divergence_of_awkward_rows(clashing):
    for least in (1, 2, 30):
        got = V.divergence(clashing, least=least, top=3, block=2, most=7)
        sql_same(got, clashing, Q.OP12_SQL.replace(">= 30", f">= {least}").replace("<= 50", "<= 3"))


def test_divergence_of_no_rows(empty):  # noqa: F811
    assert V.divergence(empty).collect() == []


def test_divergence_however_cut(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = sorted(map(tuple, V.divergence(docs, least=5).collect()))
    assert want == sorted(map(tuple, V.divergence(docs.repartition(17), least=5, block=7, most=1000).collect()))
    assert {r[2] for r in want} == {"pair", "term"}


def test_tries_merge_and_walk_in_order():
    rng = random.Random(2)
    terms = ["".join(rng.choices("abé日", k=rng.randrange(1, 6))).encode() for _ in range(2000)]
    halves, want = [V.Trie(), V.Trie()], defaultdict(Counter)
    for i, t in enumerate(terms):
        halves[i % 2].add(t, [1, f"s{i % 3}", i])
        want[t][f"s{i % 3}"] += i
    assert halves[0].branches and halves[1].branches  # they have burst
    got = list(halves[0].merge(halves[1]).walk())
    assert [t for t, _ in got] == sorted(want)
    for t, leaf in got:
        counts = Counter()
        for s, n in zip(leaf[1::2], leaf[2::2], strict=True):
            counts[s] += n
        assert leaf[0] == terms.count(t) and counts == want[t]


def test_shares_are_exact():
    rng = random.Random(4)
    for most in (100, 10**6, 2 * 10**14, 10**17):
        totals = [rng.randrange(1, most) for _ in range(300)]
        counts = [rng.randrange(t + 1) for t in totals]
        assert V.shares(np.array(counts), np.array(totals)).tolist() == [1 + 10**9 * c // t for c, t in zip(counts, totals, strict=True)]


# whitening


def vectors(spark, rows, more=()):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return df.withColumns({c: F.lit(f"other {c}") for c in more})


def brute_whitening(rows, top=16):
    """Exact sums, numpy's eigenvectors, as {(id, component): (n, deviation, abs(whitened), explained)}."""
    good = [(i, [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in good}))
    n, s = len(fit), fit.sum(axis=0)
    c = np.array([[float(Fraction(int(n * a - b), n)) for a, b in zip(x, s, strict=True)] for x in fit])
    cov = c.T @ c / n
    w, u = np.linalg.eigh(cov)
    w, u = w[::-1][:top], u[:, ::-1][:, :top]
    out = {}
    for i, x in good:
        y = np.array([float(Fraction(int(n * a - b), n)) for a, b in zip(x, s, strict=True)])
        for k in range(len(w)):
            if w[k] > 1e-12 * w[0]:
                out[i, k + 1] = (n, sum(int(n * a - b) ** 2 for a, b in zip(x, s, strict=True)), abs(y @ u[:, k]) / np.sqrt(w[k]), w[k] / np.trace(cov))
    return out


def same_whitening(df, want):
    got = df.collect()
    assert {(r.vec_id, r.component) for r in got} == set(want)
    for r in got:
        n, deviation, whitened, explained = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation) and abs(abs(r.whitened) - whitened) < 1e-8 and abs(r.explained / explained - 1) < 1e-9 and r.identity_error < 1e-10


def test_whitening_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    got = Q.op13_whitening(spark, DATA).cache()
    same_whitening(got, brute_whitening(rows))
    # one sign for all rows: the coordinates have no covariance across components
    table = np.array([[r.whitened for r in sorted(got.where(F.col("component") == k).collect(), key=lambda r: r.vec_id)] for k in range(1, 17)])
    assert np.abs(np.corrcoef(table) - np.eye(16)).max() < 0.2


def test_whitening_of_awkward_rows(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 10.0 ** (j - 2)) for j in range(6)]) for i in range(90)]
    rows += [(100 + i, rows[0][1]) for i in range(50)] + [(200, None), (201, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (202, [float("nan")] * 6), (203, [float("inf")] + [0.0] * 5)]
    want = brute_whitening(rows, top=4)
    # of another length, empty or too large
    more = [(300, [1.0, 2.0]), (301, []), (302, [3e38] * 6)]
    same_whitening(W.whiten(vectors(spark, rows + more, [*MORE, "label", "id", "size", "n"]), top=4), want)
    same_whitening(W.whiten(vectors(spark, rows + more).repartition(70), top=4), want)


def test_whitening_without_variance(spark):
    assert W.whiten(vectors(spark, [])).collect() == []
    assert W.whiten(vectors(spark, [(1, None)])).collect() == []
    assert W.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    # one direction only: one component
    got = W.whiten(vectors(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(5)] + [(None, [0.0, 0.0, 0.0])])).collect()
    assert {r.component for r in got} == {1} and len(got) == 6 and all(r.n == 5 for r in got)


def test_deviation_beyond_a_long():
    w = W.Whitening(3, [0, 3], np.zeros(0), np.zeros((2, 0)), 0.0)
    assert w.deviation(np.array([[1, 2], [1 << 40, 0]])) == [9 + 9, None]
    w.n = 1 << 33
    assert w.deviation(np.array([[0, 0], [1, 1]]))[0] == 9


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40])
def test_eigen(n):
    rng = np.random.default_rng(n)
    a = rng.normal(size=(n, n))
    q = np.linalg.qr(a)[0]
    for m in (a @ a.T, np.eye(n) * 3 + (a + a.T) * 1e-9, np.zeros((n, n)), np.diag(np.arange(n) // 3 * 1.0), q @ np.diag(10.0 ** -np.arange(n).clip(0, 14)) @ q.T):
        m = (m + m.T) / 2
        values, u = W.eigen(m)
        size = max(np.abs(m).max(), 1e-300)
        assert np.abs(values - np.linalg.eigvalsh(m)[::-1]).max() <= 1e-13 * size and np.abs(u.T @ u - np.eye(n)).max() < 1e-13 and np.abs(m @ u - u * values).max() <= 1e-13 * size


def test_outer_products_lose_nothing():
    rng = np.random.default_rng(0)
    high = rng.normal(size=(500, 3)) * [1, 1e-9, 1e9]
    low = high * 1e-17 * rng.normal(size=high.shape)
    got = W.outer(high, low)
    for i, j in ((0, 0), (0, 1), (1, 2)):
        exact = sum(((Fraction(a) + Fraction(b)) * (Fraction(c) + Fraction(d)) for a, b, c, d in zip(high[:, i], low[:, i], high[:, j], low[:, j], strict=True)), Fraction(0))
        bound = Fraction(np.abs(high[:, i]).max() * np.abs(high[:, j]).max()) * 500 / 2**75
        assert abs(Fraction(got[0][i, j]) + Fraction(got[1][i, j]) - exact) < bound


def test_leaves_of_many_tries_merge_whatever_their_batches(spark):
    # one term in 3,000 tries stands in several batches; a term below the least number of documents goes
    rng = random.Random(4)
    leaves = [(lang, b"common", 1 + i % 3, (s := rng.sample("abcdef", 1 + i % 4)), [rng.randint(1, 9) for _ in s]) for lang in ("", "en") for i in range(3000)]
    leaves += [("en", f"t{i % 50}".encode(), 1, ["a", "é"][: 1 + i % 2], [2, 3][: 1 + i % 2]) for i in range(400)] + [("fr", b"rare", 7, ["a"], [9])]
    rng.shuffle(leaves)
    docs, sums = Counter(), defaultdict(Counter)
    for lang, term, n, sources, counts in leaves:
        docs[lang, term] += n
        for source, count in zip(sources, counts, strict=True):
            sums[lang, term][source] += count
    got = V.merged(spark.createDataFrame(leaves, V.LEAF).repartition(7), 8).collect()
    assert {(r.lang, bytes(r.term)): (r.docs, dict(zip(r.sources, r.counts, strict=True))) for r in got} == {k: (n, dict(sums[k])) for k, n in docs.items() if n >= 8}
    assert len(got) == 52 and all(len(set(r.sources)) == len(r.sources) for r in got)
