"""Each stage of the pipeline against brute force over what the one before has kept."""

import random
from collections import Counter

import corpus_pipeline as P
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenweave.llm import language_id as LI
from lumenweave.llm import queries as Q
from lumenweave.llm.mixing import schedule
from lumenweave.session import new_path
from tests.compare import DATA
from tests.llm.test_operators import rows_of, shingle_components


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for i, (_, stage) in enumerate(P.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(i))
        stage(spark, docs, DATA).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_columns_and_order(stages):
    assert len(P.STAGES) == 5
    for before, after in stages[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language_stage_keeps_texts_with_letters(stages):
    before, after = stages[0]
    kept = {r.doc_id for r in after.collect()}
    assert all(r.doc_id in kept for r in before.collect() if sum(c.isalpha() for c in r.text or "") > 100)
    assert all(any(c.isalpha() for c in r.text) for r in after.collect())


def test_language_stage_rejects_what_no_learned_language_has(spark):
    rng = random.Random(7)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    junk = ["".join(rng.choice("qxzjkvwy") for _ in range(9)) for _ in range(3000)]
    foreign = ["".join(rng.choice("абвгдежзиклмнопрст") for _ in range(7)) for _ in range(3000)]
    planted = [(10**6 + i, " ".join(rng.choice(words) for _ in range(80)), None, "planted", 0) for i, words in enumerate([junk, foreign] * 5)]
    planted += [(10**6 + 100 + i, " ".join(rng.choice(junk) for _ in range(12)), None, "planted", 0) for i in range(5)]  # short ones too
    both = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    kept = {r.doc_id for r in P.language_id(spark, both, DATA).collect()}
    assert not kept & {r[0] for r in planted}
    assert {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")} <= kept


AWKWARD = [(1, "one two three four five six seven", "en", "s", 1), (1, "one two three four five six seven", "en", "s", 1), (1, "another text under the same id here", "en", "s", 1), (2, "one two three four five six seven", "en", None, 1), (None, "no id but a text of some words", None, "s", 1), (None, "no id but a text of some words", None, "s", 2), (None, "no id but a text of some words, too", "en", "t", 1), (3, None, "en", "s", 0), (4, "", None, None, 0), (5, "   ", "en", "s", 3), (6, "é" * 90 + " word " * 30000, "fr", "long", 7), (None, None, None, None, None)]


def test_stages_with_nulls_repeats_and_long_texts(spark):
    docs = spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string, source string, n_chars long")
    for extra in ([], ["row", "i", "h", "told", "certain", "fits", "group", "text_hash", "_row"]):
        more = docs.withColumns({c: F.lit(f"other {c}") for c in extra})
        for _, stage in P.STAGES[:-1]:
            got = stage(spark, more, DATA)
            assert got.columns == more.columns
            assert not set(map(str, (tuple(r)[:4:3] for r in got.collect()))) - set(map(str, (tuple(r)[:4:3] for r in more.collect())))
            assert stage(spark, more.limit(0), DATA).collect() == []
    one = P.minhash_near_dedup(spark, docs, DATA).collect()
    texts = [(r.doc_id, r.text) for r in one]
    assert sorted(str(t) for t in texts if t[1] and t[1].strip() and t[0] != 6) == sorted(str(t) for t in [(1, "one two three four five six seven"), (1, "another text under the same id here"), (None, "no id but a text of some words"), (None, "no id but a text of some words, too")])
    assert sum(1 for t in texts if not (t[1] or "").strip()) == 4
    path = new_path(spark, "test")
    docs.write.parquet(path)
    out = P.token_output(spark, spark.read.parquet(path), DATA)
    assert out.count() == len(AWKWARD) and sum(r.n_tokens for r in out.collect()) == max(r.mix_start + r.n_tokens for r in out.collect())


def test_near_dedup_stage_keeps_one_of_each_group(stages):
    before, after = stages[1]
    assert {r.doc_id for r in after.collect()} == {d for d, _, c in shingle_components(rows_of(before), 5, 80) if d == c}


def test_decontamination_stage(stages, spark):
    from tests.llm.test_operators import sql_same

    before, after = stages[2]
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    found = Q.decontaminate(before, bench)
    sql_same(found.drop("text_hash"), before, Q.OP10_SQL, bench)
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in found.where("NOT contaminated").collect()}


def test_mixing_stage_keeps_all(stages):
    before, after = stages[3]
    assert sorted(map(tuple, before.collect())) == sorted(map(tuple, after.collect()))


def test_token_stage(stages):
    before, after = stages[4]
    got = sorted(tuple(r) for r in after.collect())
    assert [r[0] for r in got] == sorted(r.doc_id for r in before.select("doc_id").collect())
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:], strict=False))


def test_token_output_follows_the_mix(stages, spark):
    unmixed, _ = stages[3]
    _, after = stages[4]
    order = lambda df: [r.doc_id for r in sorted(df.collect(), key=lambda r: r.mix_start)]
    slots = [(r.slot, r.start, r.doc_id) for r in schedule(unmixed).collect()]
    assert order(after) == [i for _, _, i in sorted(slots)]
    assert order(P.token_output(spark, unmixed, DATA)) != order(after)
    rows = sorted(after.collect(), key=lambda r: r.mix_start)
    assert rows[0].mix_start == 0 and all(a.mix_start + a.n_tokens == b.mix_start for a, b in zip(rows, rows[1:], strict=False))


def test_language_stage_learns_from_every_text(spark, monkeypatch):
    # more than a sample of 600: a word of one text alone is learned, and the floor is the median of all
    rows = [(i, " ".join(f"{a}{'xyz'[i % 3] * (i % 7)}" for a in ("water", "stone", f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}")) if i != 700 else "zyzzyvas", "en", "web") for i in range(1500)]
    rows += [(2000 + i, "vieille pierre " + "eau " * (1 + i % 5), "fr", "web") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = LI.fit(docs, texts_per_language=None)
    known = {b: i for i, b in enumerate(LI.rank_pieces(model.pieces))}
    for nth, lang in enumerate(model.languages):
        counts = Counter(w for _, text, label, _ in rows if label == lang for w in LI.words_in(text))
        lattice, p = LI.Lattice(sorted(counts), known, LI.STRETCH), np.full(len(known), 1 / len(known))
        for _ in range(4):
            p = lattice.expected(p, np.array([counts[w] for w in sorted(counts)], float)) + 0.02
            p /= p.sum()
        assert np.allclose(model.p[:, nth], p, rtol=1e-9)

    seen = {}
    monkeypatch.setattr(P, "floors", lambda *a: seen.setdefault("floors", LI.floors(*a)))
    P.language_id(spark, docs, DATA)
    fits = {r.i: (r.told, r.fits) for r in LI.predict(docs.withColumnRenamed("doc_id", "i"), model, "i", names=("told", "certain", "fits")).collect()}
    for lang in ("en", "fr"):
        own = sorted(fits[i][1] for i, _, label, _ in rows if label == lang and fits[i][0] == lang)
        assert seen["floors"][lang] == pytest.approx(own[(len(own) - 1) // 2] - 1, abs=4e-6)


def test_token_output_moves_only_texts_whose_id_is_repeated(spark):
    """Rows of one id by text, null ids too; without such rows no text is read again."""
    rows = [(1, "b"), (1, "a"), (1, "a"), (2, "z"), (None, "d"), (None, None), (3, None)]
    path = new_path(spark, "test")
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(path)
    got = P._placed(spark.read.parquet(path)).collect()
    assert sorted((r._row, r._id, r._nth) for r in got if r._row not in (1, 2)) == [(0, 1, 3), (3, 2, 1), (4, None, 2), (5, None, 1), (6, 3, 1)]
    assert sorted((r._id, r._nth) for r in got if r._row in (1, 2)) == [(1, 1), (1, 2)]
    path = new_path(spark, "test")
    spark.createDataFrame(rows[2:5], "doc_id long, text string").write.parquet(path)
    plan = P._placed(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert "doc_id" in plan and "text#" not in plan and "Exchange" not in plan


def test_near_dedup_lets_go_of_what_an_earlier_stage_held():
    from lumenweave.llm import memory, near_dedup

    for work in (near_dedup._sign(5), near_dedup._sets(5)):
        memory.held(("words of an earlier stage",), lambda: [0])
        assert list(work(iter([]))) == [] and not memory._held
