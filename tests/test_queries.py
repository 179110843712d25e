import pytest

from lumenweave.plans import queries, registry as q
from tests.compare import DATA, same


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_same_as_sql(spark, name):
    same(q.QUERIES[name](spark, DATA), q.ORACLE_SQL[name])


def test_stratified_sample_takes_turns(spark):
    rows = queries.stratified_sample(spark, DATA).collect()
    counts = {lang: sum(r.lang == lang for r in rows) for lang in {r.lang for r in rows}}
    there = {r.lang: r["count"] for r in spark.read.parquet(f"{DATA}/documents.parquet").groupBy("lang").count().collect()}
    assert len(rows) == 100 and all(n == there[lang] or max(counts.values()) - n <= 1 for lang, n in counts.items())
