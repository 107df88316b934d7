"""The ten registered queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.decontamination import find_leaks
from lexmill.llm.embedding_neardup import embedding_classes
from lexmill.llm.hard_negatives import mine_hard_negatives
from lexmill.llm.jaccard_join import jaccard_classes
from lexmill.llm.language_id import fuse_languages, markup_language, page_text, train_languages
from lexmill.llm.lexical_search import search_documents
from lexmill.llm.license_scan import scan_licenses
from lexmill.llm.mixing import mix_sources
from lexmill.llm.packing import pack_pieces, token_pieces
from lexmill.llm.quality_cnn import score_quality, train_quality
from lexmill.llm.toxicity import score_toxicity, train_toxicity
from lexmill.llm.url_filter import judge_urls, url_host
from lexmill.llm.warc_archive import read_archive, write_archive
from lexmill.session import new_folder

# (action, host, path)
URL_RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    known = _table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = train_toxicity(docs, known, binary=True)
    return score_toxicity(docs.select("doc_id", "text"), model).drop("text")


def op2_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return scan_licenses(_table(spark, sf, "documents"))


def op3_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    classes = jaccard_classes(_table(spark, sf, "documents"), size=3, similarity=(9, 10))
    return classes.drop("text_key")


def op4_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "action string, host string, path string")
    judged = judge_urls(_table(spark, sf, "pages"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op5_weighted_mix(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mix_sources(_table(spark, sf, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_embedding_neardup(spark: SparkSession, sf: str) -> DataFrame:
    return embedding_classes(_table(spark, sf, "embeddings"))


def op7_template_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return find_leaks(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


def op8_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """Pages, with byte-pair models of the documents' languages."""
    model = train_languages(_table(spark, sf, "documents").select("text", "lang"))
    host = url_host(F.col("url"))
    return fuse_languages(
        _table(spark, sf, "pages").select("page_id", "url", "html"),
        model,
        text=page_text(F.col("html")),
        declared=markup_language(F.col("html")),
        host=host,
        suffix=F.substring_index(host, ".", -1),
    ).select("page_id", "language", "posterior", "rejected")


def held_out(doc_id) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def quality_labels(labels: DataFrame) -> DataFrame:
    """Labels that may be learned from."""
    known = labels.select("doc_id", F.col("quality").alias("label"))
    return known.filter(~held_out(F.col("doc_id")))


def op9_quality_cnn(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    net = train_quality(docs, quality_labels(_table(spark, sf, "labels")))
    return score_quality(docs.select("doc_id", "text"), net).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
    )


def op10_warc_archive(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    write_archive(_table(spark, sf, "pages"), folder)
    return read_archive(spark, folder).select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op11_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = _table(spark, sf, "embeddings").withColumn("label", moved)
    return mine_hard_negatives(vectors, F.col("vec_id") % 100 == 0)


def op12_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    pieces = token_pieces(
        _table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json")
    )
    digests = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack_pieces(digests)


def op13_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    return search_documents(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_license_scan": op2_license_scan,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_url_filter": op4_url_filter,
    "op5_weighted_mix": op5_weighted_mix,
    "op6_embedding_neardup": op6_embedding_neardup,
    "op7_template_decontamination": op7_template_decontamination,
    "op8_language_id": op8_language_id,
    "op9_quality_cnn": op9_quality_cnn,
    "op10_warc_archive": op10_warc_archive,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_lexical_search": op13_lexical_search,
}

_RULE_ROWS = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in URL_RULES)

ORACLES = {
    "op3_jaccard_join": r"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sh AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN w ELSE w[i:i + 2] END AS s
  FROM words, unnest(range(1, CASE WHEN len(w) = 0 THEN 1 ELSE greatest(len(w) - 1, 2) END)) u(i)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT x.a, x.b
  FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c
        FROM sh p JOIN sh q ON p.s = q.s AND p.doc_id <> q.doc_id GROUP BY ALL) x
  JOIN n na ON na.doc_id = x.a JOIN n nb ON nb.doc_id = x.b
  WHERE 100 * x.c >= 90 * (na.n + nb.n - x.c)),
reach(doc_id, other) AS (
  SELECT a, b FROM links
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
least AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
""",
    "op4_url_filter": rf"""
WITH rules(action, rhost, rpath) AS (VALUES {_RULE_ROWS}),
parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
best AS (
  SELECT host, path, arg_max(rhost || rpath, (length(rhost), length(rpath))) AS rule,
    arg_max(action, (length(rhost), length(rpath))) AS verdict
  FROM (SELECT DISTINCT host, path FROM parts) p JOIN rules
    ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN best USING (host, path)
""",
    "op5_weighted_mix": r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    row_number() OVER (ORDER BY source NULLS LAST) AS number
  FROM sized GROUP BY source),
capped AS (
  SELECT *, 3 * source_size AS cap, 1 + (number - 1) % 3 AS weight FROM sources),
ranked AS (
  SELECT *,
    sum(cap) OVER w - cap AS caps, sum(weight) OVER w - weight AS shares,
    sum(source_size) OVER () AS words, sum(weight) OVER () AS weights
  FROM capped
  WINDOW w AS (ORDER BY CAST(cap AS DOUBLE) / weight, number)),
level AS (
  SELECT coalesce(arg_min(CAST(words - caps AS DOUBLE) / CAST(weights - shares AS DOUBLE),
    (CAST(cap AS DOUBLE) / weight, number)), 0.0) AS share
  FROM ranked WHERE cap * (weights - shares) >= weight * (words - caps)),
targets AS (
  SELECT source, source_size, number,
    least(CAST(cap AS DOUBLE), CAST(weight AS DOUBLE) * share) AS target
  FROM capped, level),
queued AS (
  SELECT doc_id, size, k, source_size, number, target,
    sum(size) OVER (PARTITION BY number ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto,
    row_number() OVER (ORDER BY number, k, doc_id, size) AS r
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
entries AS (
  SELECT r, size, CAST(turn * source_size + upto AS DOUBLE) / target AS t, number, turn
  FROM queued, (VALUES (0), (1), (2)) v(turn) WHERE size > 0),
spent AS (
  SELECT r, size,
    sum(size) OVER (ORDER BY t, number, r, turn ROWS UNBOUNDED PRECEDING) AS total
  FROM entries),
taken AS (
  SELECT r, sum(size) AS taken FROM spent
  WHERE total <= (SELECT sum(size) FROM sized) GROUP BY r)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM queued LEFT JOIN taken USING (r)
""",
    # five hexadecimal digits of the digest are four base-32 digits
    "op10_warc_archive": """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
    sha1(coalesce(html, '')) AS hex
  FROM pages),
g AS (
  SELECT *, max(page_id) OVER (PARTITION BY hex) AS top FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (
      (CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT)
        >> (15 - 5 * (i % 4))) & 31) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM g
""",
    "op11_hard_negatives": """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    CAST(list_sum(list_transform(list_zip(a.q, c.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id
    ORDER BY score DESC, vec_id) AS INT) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
  AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
""",
    "op13_lexical_search": r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS MATERIALIZED (
  SELECT item_id, t, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text,
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark)
  GROUP BY ALL),
n AS MATERIALIZED (SELECT doc_id, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
m AS (SELECT doc_id, 100 - 25 + ((25 * n * docs) // terms) AS m FROM n, total),
tf AS MATERIALIZED (
  SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d)
  WHERE t IN (SELECT t FROM q) GROUP BY ALL),
weight AS (
  SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE)
    / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight
  FROM tf, total GROUP BY t),
scores AS (
  SELECT item_id, doc_id,
    CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM q JOIN tf USING (t) JOIN weight USING (t) JOIN m USING (doc_id)
  GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id
    ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM scores WHERE score > 0
QUALIFY rank <= 20
""",
}
