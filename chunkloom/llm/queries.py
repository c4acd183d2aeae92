"""The ten operators as queries over the tables of a folder, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm import html, jaccard, media, mix, pack, pii, tokens, topk, toxic, urls
from chunkloom.storage import table


def tokenizer_file(name: str) -> str:
    """The place of a public vocabulary file; the files are installed on every machine, not kept here."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All links are made and verified; their number a document is in jaccard_links, as this query has its SQL's columns."""
    return jaccard_links(spark, sf_dir).drop("n_links")


def jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join of op6_jaccard with n_links: classes of equal sets other than the document's own that link with it."""
    return jaccard.join(table(spark, sf_dir, "documents")).drop("text_hash")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_mix, op2_token_counts, op3_pack, op4_topk, op5_pii, op6_jaccard, op7_url_filter, op8_html_text, op9_media, op10_toxicity, jaccard_links)}

ORACLES: dict[str, str] = {
    "op6_jaccard": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS g FROM w),
s AS (SELECT doc_id, unnest(g) AS x FROM g), n AS (SELECT doc_id, len(g)::BIGINT AS n FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS seen FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.seen = e.a)
SELECT n.doc_id, any_value(n) AS n_shingles, min(seen) AS component_id FROM n JOIN r ON n.doc_id = r.doc_id GROUP BY 1
""",
    "jaccard_links": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS g FROM w),
s AS (SELECT doc_id, unnest(g) AS x FROM g), n AS (SELECT doc_id, len(g)::BIGINT AS n, min(doc_id) OVER (PARTITION BY list_sort(g)) AS class FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b, x.class AS ca, y.class AS cb FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b, ca, cb FROM l UNION ALL SELECT b, a, cb, ca FROM l),
k AS (SELECT a, count(DISTINCT cb) FILTER (ca <> cb) AS n_links FROM e GROUP BY a),
r AS (SELECT doc_id, doc_id AS seen FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.seen = e.a)
SELECT n.doc_id, any_value(n) AS n_shingles, min(seen) AS component_id, coalesce(any_value(n_links), 0)::BIGINT AS n_links FROM n JOIN r ON n.doc_id = r.doc_id LEFT JOIN k ON n.doc_id = k.a GROUP BY 1
""",
    # for the one layout that the provided pages have
    "op8_html_text": r"""
WITH a AS (SELECT page_id, url, coalesce(regexp_extract(html, '(?s)<article>(.*?)(</article>|$)', 1), '') AS x FROM pages),
b AS (SELECT page_id, url, array_to_string(list_filter(list_transform(regexp_split_to_array(x, '</?(?:p|h1)>'),
  lambda t: trim(regexp_replace(replace(replace(replace(regexp_replace(replace(t, '<br>', ' '), '<[^>]*>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&amp;', '&'), '\s+', ' ', 'g'))), lambda t: t <> ''), chr(10)) AS text FROM a)
SELECT page_id, url, text, len(text)::BIGINT AS n_chars FROM b
""",
    "op4_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
""",
    "op7_url_filter": r"""
WITH a AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), b AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM a
), c AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM b
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(host, '(^|[.-])(adult|bet|bets|betting|casino|casinos|gambling|jackpot|lottery|pills|poker|porn|pharma|slots|viagra|warez|xxx)([.-]|$)') THEN 'block'
  ELSE 'allow' END AS verdict
FROM c
""",
    "op1_mix": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         coalesce('s' || source, 't') AS key, md5(coalesce(doc_id::VARCHAR, '') || ' ' || md5(coalesce(text, ''))) AS h FROM documents
), p AS (SELECT key, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY key) AS k FROM d GROUP BY key),
w AS (SELECT *, (k - 1) % 3 AS class_no, CASE (k - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0 ELSE 2.0 END AS weight, 2.0::DOUBLE * source_size AS cap FROM p),
r AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM w
), o AS (SELECT (SELECT min_by(rate, cap / weight) FROM r WHERE rate * weight <= cap) AS level),
t AS (
  SELECT r.*, CASE WHEN max((rate * weight <= cap)::INT) OVER (ORDER BY cap / weight, key ROWS UNBOUNDED PRECEDING) = 1 THEN least(level * weight, cap) ELSE cap END AS target FROM r, o
), s AS (
  SELECT d.*, source_size, target, floor(target + 0.5)::BIGINT AS budget, class_no,
         coalesce(sum(size) OVER (PARTITION BY d.key ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.key = t.key
), u AS (
  SELECT *, (greatest(least(budget - start, size), 0) + greatest(least(budget - start - source_size, size), 0))::BIGINT AS taken, least(greatest(start::DOUBLE / target, 0), 1) AS f FROM s
)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN round(CASE class_no
    WHEN 0 THEN (sqrt(greatest(0.25 + 2 * f, 0)) - 0.5) / 1.0
    WHEN 1 THEN f / 1.0
    ELSE CASE WHEN f <= 0.625 THEN (sqrt(greatest(2.25 - 2 * f, 0)) - 1.5) / -1.0 ELSE 0.5 + (sqrt(greatest(1 - 2 * (f - 0.625), 0)) - 1) / -1.0 END END, 9) END AS position
FROM u
""",
}
