"""The operators on whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from facetloom.llm import (
    digests,
    divergence,
    languages,
    lines,
    mixing,
    negatives,
    ngram_join,
    packing,
    paragraphs,
    postings,
    pseudonyms,
    substrings,
    url_rules,
)

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer_path() -> str:
    """The vocabulary of the packing query; other jobs give a path of their own."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.similar_documents(_table(spark, sf, "documents"))


def op2_url_rules(spark: SparkSession, sf: str) -> DataFrame:
    return url_rules.judge_urls(_table(spark, sf, "pages"), url_rules.rules_frame(spark))


def op3_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf, "documents"), tokenizer_path())


def op4_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf, "documents")).drop("spans")


def op5_pseudonyms(spark: SparkSession, sf: str) -> DataFrame:
    return pseudonyms.pseudonymize_documents(_table(spark, sf, "documents"))


def op6_nearest_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return postings.search(_table(spark, sf, "embeddings"))


def op7_temperature_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_documents(_table(spark, sf, "documents"))


def op8_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return digests.fingerprint_documents(_table(spark, sf, "documents"))


def op9_paragraph_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return paragraphs.removed_paragraphs(_table(spark, sf, "documents"))


def op10_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return languages.language_id(_table(spark, sf, "documents"))


def op11_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return lines.drop_repeated_lines(_table(spark, sf, "documents")).drop("keep")


def op12_source_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return divergence.source_divergence(_table(spark, sf, "documents"))


def op13_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    return negatives.hard_negatives(_table(spark, sf, "embeddings"))


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


QUERIES: dict[str, Query] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_url_rules": op2_url_rules,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_pseudonyms": op5_pseudonyms,
    "op6_nearest_vectors": op6_nearest_vectors,
    "op7_temperature_mix": op7_temperature_mix,
    "op8_fingerprints": op8_fingerprints,
    "op9_paragraph_dedup": op9_paragraph_dedup,
    "op10_language_id": op10_language_id,
    "op11_line_dedup": op11_line_dedup,
    "op12_source_divergence": op12_source_divergence,
    "op13_hard_negatives": op13_hard_negatives,
    "pipeline": pipeline,
}

_OP1 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, string_split_regex(bare, '\s+') AS w
  FROM (SELECT doc_id, regexp_replace(lower(text), '^\s+|\s+$', '', 'g') AS bare FROM documents)
  WHERE bare <> ''
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 5 * c >= 4 * (x.n + y.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT r.a AS doc_id, min(r.b) AS class_id, any_value(coalesce(k.n, 0))::BIGINT AS n_links
FROM reach r LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) k ON k.a = r.a
GROUP BY r.a
"""

_OP2 = r"""
WITH urls AS (
  SELECT page_id,
    CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest
  FROM pages
), parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM urls
), rules(v, h, p) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
    ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fits AS (
  SELECT page_id, host, path, h || p AS rule, v,
    row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h || p) DESC NULLS LAST, length(h) DESC, v) AS k
  FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM fits WHERE k = 1
"""

_OP4 = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT doc_id, i, substr(h, 2 * i - 1, 100) AS s
  FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 - 48)) AS i FROM d)
), firsts AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s
), hits AS (SELECT doc_id, i FROM w JOIN firsts USING (s) WHERE m < doc_id
), marked AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new
  FROM hits
), grouped AS (
  SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked
), spans AS (
  SELECT doc_id, g, min(i) AS a, max(i) + 50 AS b FROM grouped GROUP BY doc_id, g
), ends AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 1) AS from_ FROM spans
), kept AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last,
    string_agg(substr(h, 2 * from_ - 1, 2 * (a - from_)), '' ORDER BY a) AS head
  FROM ends JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(head, '') || CASE WHEN last IS NULL THEN h ELSE substr(h, 2 * last - 1) END)) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_OP7 = r"""
WITH rows AS (
  SELECT doc_id, source, text,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '-') || ':' || coalesce(md5(text), '-')), 1, 8))::BIGINT AS u
  FROM documents
), counted AS (
  SELECT doc_id, source, coalesce('+' || source, '-') AS k, u,
    CASE WHEN bare <> '' THEN length(bare) - length(replace(bare, ' ', '')) + 1 ELSE 0 END::BIGINT AS n
  FROM (SELECT *, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS bare FROM rows)
), sources AS (SELECT k, sum(n)::BIGINT AS t FROM counted WHERE n > 0 GROUP BY k
), expo AS (
  SELECT CASE WHEN ln(max(t)) = ln(min(t)) THEN 0
    ELSE greatest(0, 1 - ln(1.5::DOUBLE) / (ln(max(t)) - ln(min(t)))) END AS e FROM sources
), weights AS (SELECT k, t, pow(t, e) / sum(pow(t, e)) OVER () AS w FROM sources, expo
), plan AS (SELECT k, t, round(max(t / w) OVER () * w / t, 9) AS times FROM weights
), placed AS (
  SELECT c.*, coalesce(times, 1) AS r, floor(coalesce(times, 1)) AS whole, t,
    coalesce(sum(n) OVER (PARTITION BY c.k ORDER BY u, doc_id, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM counted c LEFT JOIN plan USING (k)
), epochs AS (
  SELECT *, CASE WHEN n = 0 THEN 1 ELSE whole + CASE WHEN before < (r - whole) * t THEN 1 ELSE 0 END END AS m
  FROM placed
)
SELECT doc_id, source, n AS n_tokens, epoch::INTEGER AS epoch,
  least(floor((epoch + u / 4294967296) / r * 1024), 1023)::INTEGER AS block
FROM (SELECT *, unnest(range(0, m::BIGINT)) AS epoch FROM epochs)
"""

_OP11 = r"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT doc_id, i, ls[i] AS line,
    translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM split)
), firsts AS (
  SELECT k, min(doc_id) AS m FROM lines WHERE length(k) >= 10 GROUP BY k
)
SELECT doc_id, count(*)::BIGINT AS n_lines,
  count(*) FILTER (WHERE m < doc_id)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE m IS NULL OR m = doc_id), '')) AS kept_sha256
FROM lines LEFT JOIN firsts USING (k) GROUP BY doc_id
"""

_OP12 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), words AS (
  SELECT id, lang, source, translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM docs
), kept AS (
  SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 10
), langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang
), grps AS (SELECT DISTINCT lang, source FROM docs
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term
), totals AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM counts GROUP BY lang, source
), given AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(t.total, 0) + 2 * l.v) AS p,
    1 + 1000000000::HUGEINT * (k.n + 2) // (l.total + 2 * l.v) AS q
  FROM grps g JOIN kept k USING (lang) JOIN langs l USING (lang)
  LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM given a JOIN given b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY 1, 2, 3
), rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM grps a JOIN grps b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM given WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank
  FROM rows
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""

_OP13 = """
WITH valid AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::HUGEINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), anchors AS (SELECT * FROM valid WHERE vec_id % 100 = 0
), scored AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same,
    list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS s
  FROM anchors a JOIN valid b ON a.vec_id <> b.vec_id
), positives AS (
  SELECT a, b AS p, s AS ps FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5
)
SELECT a AS anchor_id, p AS positive_id,
  row_number() OVER (PARTITION BY a, p ORDER BY s DESC, b)::INTEGER AS rank,
  b AS negative_id, ps AS positive_score, s AS negative_score
FROM positives JOIN scored USING (a)
WHERE NOT same AND 30 * ps <= 100 * s AND 100 * s <= 90 * ps
QUALIFY row_number() OVER (PARTITION BY a, p ORDER BY s DESC, b) <= 10
"""

ORACLES: dict[str, str] = {
    "op1_ngram_join": _OP1,
    "op2_url_rules": _OP2,
    "op4_substring_dedup": _OP4,
    "op7_temperature_mix": _OP7,
    "op11_line_dedup": _OP11,
    "op12_source_divergence": _OP12,
    "op13_hard_negatives": _OP13,
}
