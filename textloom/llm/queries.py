"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import digest, language, passages, periods, quality, secrets, simhash, suffixes, tokens, vector_codes, vector_search
from textloom.llm.common import documents


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir, "doc_id", "text"))


def op2_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.compare_edited(documents(spark, sf_dir, "doc_id", "text"))


def op3_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(documents(spark, sf_dir, "doc_id", "text"))


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.near_passages(documents(spark, sf_dir, "doc_id", "text"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir, "doc_id", "lang", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(documents(spark, sf_dir, "doc_id", "text"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encoding_digests(documents(spark, sf_dir, "doc_id", "text"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.pack_documents(documents(spark, sf_dir, "doc_id", "text"), with_ids=False)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict_languages(documents(spark, sf_dir, "doc_id", "text", "lang"))


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(documents(spark, sf_dir, "doc_id", "text"))


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.quantise(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.periodic_runs(documents(spark, sf_dir, "doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_simhash, op2_digests, op3_separator_scan, op4_passages, op5_quality, op6_secrets, op7_bpe, op8_packing, op9_language, op10_suffixes, op11_nearest, op12_codes, op13_periods)}

_BLANK = r"\x20\x09-\x0D"
_MEASURES = {
    "word_length": "CASE WHEN n_words > 0 THEN word_chars / n_words::DOUBLE ELSE 0 END",
    "word_shortness": "CASE WHEN word_chars > 0 THEN n_words / word_chars::DOUBLE ELSE 0 END",
    "symbol_share": "CASE WHEN word_chars > 0 THEN n_symbols / word_chars::DOUBLE ELSE 0 END",
    "dup_line_share": "CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines::DOUBLE ELSE 0 END",
    "repeat_share": "CASE WHEN n_words > 0 THEN n_repeat_words / n_words::DOUBLE ELSE 0 END",
}
_RISK = quality.RISK / len(_MEASURES)
_EACH = " UNION ALL ".join(f"SELECT doc_id, stratum, good, '{m}' AS measure, {sql} AS value, {quality.MEASURES[m] / quality.BINS!r} AS step FROM c WHERE NOT base_failed" for m, sql in _MEASURES.items())



def _codes_sql(size: int = 16, parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Operator 12 over vectors of ``size * parts`` components: plain Lloyd rounds, all distances in each."""
    places = range(1, size + 1)
    far = f"list_sum(list_transform(range(1, {size + 1}), lambda i: (x.v[i] - b.v[i]) * (x.v[i] - b.v[i])))"
    nearest = lambda r: f"a{r} AS MATERIALIZED (SELECT vec_id, p, any_value(x.v) AS v, min({far}::BIGINT * {entries} + c) AS k FROM x JOIN b{r} b USING (p) GROUP BY vec_id, p)"
    means = "[" + ", ".join(f"floor(sum(v[{i}])::DOUBLE / count(*))::BIGINT" for i in places) + "]"
    steps = [f"{nearest(r)}, m{r} AS (SELECT p, k % {entries} AS c, {means} AS v FROM a{r} GROUP BY 1, 2), b{r + 1} AS MATERIALIZED (SELECT p, c, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN m{r} m USING (p, c))" for r in range(rounds)]
    return f"""WITH e AS (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
x AS MATERIALIZED (SELECT vec_id, p, list_transform(range({size} * p + 1, {size} * p + {size + 1}), lambda i: floor(1024 * embedding[i]::DOUBLE)::BIGINT) AS v FROM e CROSS JOIN (SELECT unnest(range(0, {parts})) AS p)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS c, v FROM x WHERE vec_id IN (SELECT vec_id FROM e ORDER BY vec_id LIMIT {entries})),
{", ".join(steps)}, {nearest(rounds)},
own AS (SELECT vec_id, string_agg(printf('%02x', k % {entries}), '' ORDER BY p) AS code, sum(k // {entries})::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
digest AS (SELECT sha256(string_agg(n::VARCHAR, ',' ORDER BY p, c, i)) AS codebooks_sha256 FROM (SELECT p, c, unnest(v) AS n, unnest(range(0, {size})) AS i FROM b{rounds}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM own JOIN e USING (vec_id) CROSS JOIN digest"""


ORACLE_SQL: dict[str, str] = {
    "op12_codes": _codes_sql(),
    "op5_quality": f"""WITH d AS (SELECT doc_id, coalesce(lang, chr(1)) AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^{_BLANK}]+') AS ws FROM d),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2])) AS g FROM w),
dup AS (SELECT doc_id, g FROM win GROUP BY doc_id, g HAVING count(*) > 1),
cov AS (SELECT DISTINCT doc_id, i + k AS p FROM win JOIN dup USING (doc_id, g) CROSS JOIN (VALUES (0), (1), (2)) AS o(k)),
rep AS (SELECT doc_id, count(*) AS n FROM cov GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^{_BLANK}]')) AS ls FROM d),
b AS (SELECT d.doc_id, stratum, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[{_BLANK}]', '', 'g'))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM d JOIN w ON d.doc_id = w.doc_id JOIN lines ON d.doc_id = lines.doc_id LEFT JOIN rep ON d.doc_id = rep.doc_id),
c AS (SELECT b.*, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {int(100 * quality.MOST_REPEATED)} * n_words AS base_failed, b.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good FROM b),
v AS ({_EACH}),
g AS (SELECT stratum, measure, least({quality.BINS}, ceil(value / step)) AS bin FROM v WHERE good),
seq AS (SELECT stratum, measure, count(*) AS total FROM g GROUP BY 1, 2),
cand AS (SELECT s.stratum, s.measure, total, t.t, (SELECT count(*) FROM g WHERE g.stratum = s.stratum AND g.measure = s.measure AND g.bin > t.t) AS above FROM seq s CROSS JOIN (SELECT unnest(range(0, {quality.BINS})) AS t) t),
tail AS (SELECT *, CASE WHEN above > total * {_RISK!r} THEN 1.0 ELSE list_sum(list_transform(range(0, above + 1), lambda j: exp(lgamma(total + 1.0) - lgamma(j + 1.0) - lgamma(total - j + 1.0) + j * ln({_RISK!r}) + (total - j) * ln(1 - {_RISK!r})))) END AS p FROM cand),
cut AS (SELECT stratum, measure, coalesce(max(CASE WHEN p > {quality.FAULT!r} / (SELECT count(*) FROM seq) THEN t END) + 1, 0) AS t FROM tail GROUP BY 1, 2),
bad AS (SELECT DISTINCT doc_id FROM v JOIN cut ON v.stratum = cut.stratum AND v.measure = cut.measure WHERE cut.t < {quality.BINS} AND value > cut.t * step)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM c""",
    "op10_suffixes": """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), n AS (SELECT doc_id, h, length(h) // 2 AS n FROM d),
s AS (SELECT doc_id, unnest(range(0, greatest(n - 199, 0))) AS i, unnest(list_transform(range(0, greatest(n - 199, 0)), lambda i: md5(substring(h, 2 * i + 1, 400)))) AS k FROM n),
dup AS (SELECT k FROM s GROUP BY k HAVING count(*) > 1), m AS (SELECT doc_id, i FROM s WHERE k IN (SELECT k FROM dup)),
f AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM m),
g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM f),
r AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY doc_id, grp),
sums AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(a || ':' || b, ',' ORDER BY a) AS removed FROM r GROUP BY doc_id),
gaps AS (SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS x, a AS y FROM r UNION ALL SELECT n.doc_id, coalesce(last, 0), n FROM n LEFT JOIN sums ON n.doc_id = sums.doc_id),
kept AS (SELECT gaps.doc_id, string_agg(substring(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS h FROM gaps JOIN n ON gaps.doc_id = n.doc_id GROUP BY gaps.doc_id)
SELECT n.doc_id, n.n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(kept.h)) AS kept_sha256, coalesce(removed, '') AS removed
FROM n JOIN kept ON n.doc_id = kept.doc_id LEFT JOIN sums ON n.doc_id = sums.doc_id""",
}
