"""The queries of this package's operators over the driver's tables, and their SQL where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenweave.llm.common import LOWER, UPPER, WORD
from lumenweave.llm.decontaminate import decontaminate
from lumenweave.llm.divergence import divergence
from lumenweave.llm.exact_dedup import exact_dedup
from lumenweave.llm.fingerprints import fingerprints
from lumenweave.llm.language_id import identify
from lumenweave.llm.license_scan import NOTICES, PHRASES, license_scan
from lumenweave.llm.line_dedup import line_dedup
from lumenweave.llm.lm_score import lm_score
from lumenweave.llm.mixing import schedule
from lumenweave.llm.near_dedup import near_dedup
from lumenweave.llm.suffix_dedup import suffix_dedup
from lumenweave.llm.token_shards import read_token_shards, write_token_shards
from lumenweave.llm.whitening import whiten
from lumenweave.session import new_path, table

#: The lower-cased text in DuckDB, whose lower() would change more than A-Z.
SQL_NORM = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
SQL_WORDS = f"regexp_extract_all({SQL_NORM}, '{WORD}')"


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


OP1_SQL = f"""
WITH n AS (SELECT doc_id, {SQL_NORM} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM n
"""


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


_pairs = ", ".join(f"('{text}', '{label}', {exact}, {i}, '{a}', '{b}', {len(w) - 1})" for texts, exact in ((PHRASES, True), (NOTICES, False)) for text, label in texts.items() for w in [text.split()] for i, (a, b) in enumerate(zip(w, w[1:], strict=False)))
OP2_SQL = f"""
WITH templates(template, label, exact, tpos, a, b, pairs) AS (VALUES {_pairs}),
d AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n, unnest(range(len(w))) AS pos, unnest(w) AS a, unnest(list_append(w[2:], NULL)) AS b FROM d),
v AS (SELECT DISTINCT doc_id, template, label, exact, pairs, tpos, pos, pos - tpos AS diagonal FROM p JOIN templates USING (a, b)),
line AS (SELECT doc_id, template, label, exact, pairs, diagonal, count(*) AS n, min(pos) AS lo, max(pos) AS hi FROM v GROUP BY ALL),
notice AS (
  SELECT k.doc_id, k.template, k.label, k.diagonal, count(DISTINCT v.tpos) / any_value(k.pairs)::DOUBLE AS coverage
  FROM line k JOIN v ON v.doc_id = k.doc_id AND v.template = k.template AND v.diagonal BETWEEN k.diagonal AND k.diagonal + 8
  WHERE NOT k.exact GROUP BY k.doc_id, k.template, k.label, k.diagonal),
span AS (
  SELECT doc_id, label, TRUE AS exact, diagonal AS start, 1.0::DOUBLE AS coverage FROM line WHERE exact AND n = pairs
  UNION ALL SELECT doc_id, label, FALSE, NULL, coverage FROM notice WHERE coverage >= 0.8),
found AS (
  SELECT doc_id, count(*) FILTER (exact) AS n_base, min(start) FILTER (exact) AS first_word, max(start) FILTER (exact) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score
  FROM span GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN found USING (doc_id)
"""

def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(table(spark, sf_dir, "documents"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


OP10_SQL = f"""
WITH d AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {SQL_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, list_slice(w, i, least(i + 9, len(w))) AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
m AS (SELECT DISTINCT len(win) AS m FROM win),
g AS (SELECT doc_id, i, m, list_slice(w, i, i + m - 1) AS win FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, m WHERE len(w) >= m)),
hit AS (SELECT doc_id, i, m, item_id FROM g JOIN win USING (win)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""

def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).drop("kept")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), words=2, percent=80).drop("text_hash", "group")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("kept")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_shards(spark, write_token_shards(table(spark, sf_dir, "documents"), new_path(spark, "tokens")))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({SQL_NORM}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(*) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT lang, source, term, sum(n) AS n FROM t GROUP BY ALL),
c AS (SELECT g.lang, g.source, k.term, coalesce(s.n, 0)::HUGEINT AS n FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN s ON s.lang = g.lang AND s.source = g.source AND s.term = k.term),
p AS (SELECT *, 1 + (1000000000 * (n + 5)) // sum(n + 5) OVER (PARTITION BY lang, source) AS p FROM c),
l AS (SELECT lang, term, sum(n) + 5 AS m FROM c GROUP BY ALL),
q AS (SELECT lang, term, 1 + (1000000000 * m) // sum(m) OVER (PARTITION BY lang) AS q FROM l),
v AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.f, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term GROUP BY ALL) x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT p.lang, source, 'term', p.term, p - q FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER o)::INTEGER AS rank FROM v WINDOW o AS (PARTITION BY lang, source, part ORDER BY value DESC, item) QUALIFY part = 'pair' OR row_number() OVER o <= 50
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_line_dedup": op3_line_dedup,
    "op4_near_dedup": op4_near_dedup,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_language_id": op6_language_id,
    "op7_token_shards": op7_token_shards,
    "op8_mixing": op8_mixing,
    "op9_lm_score": op9_lm_score,
    "op10_decontaminate": op10_decontaminate,
    "op11_fingerprints": op11_fingerprints,
    "op12_divergence": op12_divergence,
    "op13_whitening": op13_whitening,
}
ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": OP1_SQL,
    "op2_license_scan": OP2_SQL,
    "op10_decontaminate": OP10_SQL,
    "op12_divergence": OP12_SQL,
}
