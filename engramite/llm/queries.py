"""Queries over the driver's tables that apply the operators of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from engramite.llm import byte_bpe, decontaminate, divergence, filter_audit, fingerprints, html_text, jaccard_join, language_id, quality, secret_scan, suffix_dedup, token_counts, token_files
from engramite.llm._batches import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(documents(spark, sf_dir))


@query
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(suffix_dedup.find_repeats(documents(spark, sf_dir), length=50))


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


@query
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(secret_scan.scan(documents(spark, sf_dir).select("doc_id", "text")))


def _secret_sql() -> str:
    rules, kinds = secret_scan.BASE + secret_scan.ADDED, []
    for rank, rule in enumerate(rules):
        pattern = rule.pattern.replace("'", "''")
        kinds.append(
            f"SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, {max(1, rule.least)} AS least, regexp_extract_all(t, '{pattern}') AS hits, "
            f"regexp_extract_all(t, '{pattern}', {rule.group}) AS kept, regexp_split_to_array(t, '{pattern}') AS gaps FROM docs"
        )
    counts = ", ".join(f"CAST(count(*) FILTER (kind = '{r.kind}') AS BIGINT) AS n_{r.kind}" for r in secret_scan.BASE)
    names = ", ".join(f"'{r.kind}'" for r in secret_scan.BASE)
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(kinds)}),
each AS (SELECT doc_id, rank, kind, least, hits, kept, gaps, unnest(range(1, len(hits) + 1)) AS i FROM found),
spans AS (
  SELECT doc_id, rank, kind, len(hits[i]) AS n,
    list_sum(list_transform(gaps[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: len(x))), 0) AS s
  FROM each WHERE len(kept[i]) >= least
), told AS (SELECT doc_id, rank, kind, CAST(s AS BIGINT) AS s, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT) AS line FROM spans)
SELECT d.doc_id, {counts},
  sha256(coalesce(string_agg(line, ',' ORDER BY s, rank) FILTER (kind IN ({names})), '')) AS base_sha256,
  coalesce(string_agg(line, ',' ORDER BY s, rank), '') AS spans
FROM docs d LEFT JOIN told USING (doc_id) GROUP BY d.doc_id
"""


ORACLES["op5_secret_scan"] = _secret_sql()


@query
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.roundtrip(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = language_id.held_out()
    model = language_id.fit(docs, ~held)
    return language_id.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(documents(spark, sf_dir), width=4, num=85, den=100)


ORACLES["op8_jaccard_join"] = r"""
WITH RECURSIVE toks AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s FROM toks
), grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (SELECT x, y FROM pairs WHERE 100 * c >= 85 * (na + nb - c)),
edges AS (SELECT x AS u, y AS v FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS u, doc_id AS v FROM sets UNION SELECT r.u, e.v FROM reach r JOIN edges e ON r.v = e.u)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.c AS component_id FROM sets s JOIN (SELECT u, min(v) AS c FROM reach GROUP BY u) r ON s.doc_id = r.u
"""


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = documents(spark, sf_dir), language_id.held_out()
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held)
    return quality.score(docs, model, threshold=0.7).select("doc_id", held.alias("held_out"), "score", "predicted")


@query
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(documents(spark, sf_dir), path, public_tokenizers.PATTERN), path))


@query
def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: For pages that have an article with a heading and paragraphs, as the given ones do.
ORACLES["op11_html_text"] = r"""
WITH bodies AS (SELECT page_id, url, regexp_split_to_array(coalesce(regexp_extract(html, '<article>(.*)</article>', 1, 's'), ''), '</?(?:p|h1)>') AS parts FROM pages),
plain AS (SELECT page_id, url, list_transform(parts, lambda x: regexp_replace(replace(x, '<br>', ' '), '</?b>', '', 'g')) AS parts FROM bodies),
named AS (SELECT page_id, url, list_transform(parts, lambda x: replace(replace(replace(replace(replace(x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#39;', chr(39)), '&#x27;', chr(39))) AS parts FROM plain),
lines AS (SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(x, '&amp;?', '&', 'g'), '[ \t\n\f\r]+', ' ', 'g'))) AS parts FROM named),
texts AS (SELECT page_id, url, coalesce(array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)), '') AS text FROM lines)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM texts
"""


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = filter_audit.masks(documents(spark, sf_dir))
    return filter_audit.report(filter_audit.counters(judged, spark.read.parquet(f"{sf_dir}/labels.parquet")))


ORACLES["op12_filter_audit"] = r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), toxic AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
failed AS (
  SELECT part, CAST(doc_id IN (SELECT doc_id FROM good) AS INT) AS good, CAST(doc_id IN (SELECT doc_id FROM toxic) AS INT) AS toxic,
    [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * len(t),
     regexp_matches(t, '[#$%&*|]'), doc_id > min(doc_id) OVER (PARTITION BY t)] AS f
  FROM docs
), cells AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, f),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders),
judged AS (
  SELECT part, filter_order, step, n, good, toxic, f[ascii(filter_order[step]) - 64] AS fails,
    len(list_filter(range(1, step), lambda i: f[ascii(filter_order[i]) - 64])) > 0 AS gone, len(list_filter(f, lambda x: x)) AS fs
  FROM cells, steps
), sums AS (
  SELECT part, filter_order, step, filter_order[step] AS letter,
    coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND fails), 0) AS removed,
    coalesce(sum(n) FILTER (gone AND fails), 0) AS redundant, coalesce(sum(n) FILTER (fails AND fs = 1), 0) AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND fails), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND fails), 0) AS toxic_lost
  FROM judged GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM sums
"""


@query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(divergence.count_terms(documents(spark, sf_dir)), least_docs=10, top=10)


ORACLES["op13_source_divergence"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), words AS (SELECT d, lang, source, unnest(w) AS term FROM docs),
groups AS (SELECT DISTINCT lang, source FROM docs),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM words GROUP BY 1, 2 HAVING count(DISTINCT d) >= 10),
counts AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM words GROUP BY 1, 2, 3),
sizes AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(n) AS total FROM kept GROUP BY 1),
grid AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
sums AS (SELECT lang, source, sum(n) AS total FROM grid GROUP BY 1, 2),
shares AS (
  SELECT g.lang, g.source, g.term, g.n, 1 + (1000000000 * (g.n + 2)) // (s.total + 2 * z.v) AS p FROM grid g JOIN sums s USING (lang, source) JOIN sizes z USING (lang)
), common AS (SELECT k.lang, k.term, 1 + (1000000000 * (k.n + 2)) // (z.total + 2 * z.v) AS q FROM kept k JOIN sizes z USING (lang)),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM shares a JOIN shares b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), terms AS (
  SELECT s.lang, s.source, 'term' AS part, s.term AS item, CAST(((s.p - c.q) * (s.p - c.q)) // (s.p + c.q) AS BIGINT) AS value
  FROM shares s JOIN common c USING (lang, term) WHERE s.n > 0 AND s.p > c.q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""
