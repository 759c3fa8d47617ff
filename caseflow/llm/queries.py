"""Registered queries of the subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm import (
    ann,
    decontaminate,
    hard_negatives,
    language,
    lexical,
    mixing,
    ngram_join,
    quality,
    secrets,
    sharding,
    substring,
    toxicity,
    url_cascade,
)
from caseflow.llm.shipping import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register a query with Python in its tasks."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def native(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register a query of DataFrame functions only."""
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@native
def op1_differencing_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(table(spark, sf_dir, "documents"), shards=16)
    return found.select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op2_segmentation_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language.held_out("doc_id", 4, 2))
    model = language.train(docs.filter("NOT held_out"))
    return language.identify(docs, model, columns=("doc_id", "held_out"))


@native
def op3_randomness_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(secrets.joined("base"), 256).alias("base_sha256"),
        secrets.joined("spans").alias("spans"),
    )


@query
def op4_random_indexing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", language.held_out("doc_id", 3, 1))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.train(docs.filter("NOT held_out").join(labels, "doc_id"), quality.word_vectors(docs))
    found = quality.score(docs, model)
    return found.select("doc_id", "held_out", F.col("_score").alias("score"), F.when(F.col("_score") >= 0.5, 1).otherwise(0).alias("predicted"))


@query
def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.ngram_components(table(spark, sf_dir, "documents"), size=3, percent=90)
    return found.withColumnRenamed("id", "doc_id")


@query
def op6_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.digests(decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), width=13))
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.col("_n_hit").alias("n_hit"),
        F.size("_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        F.col("_contaminated").alias("contaminated"),
    )


SQL["op6_fm_index_decontamination"] = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
phrases AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS p
  FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM phrases),
starts AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS p
  FROM d, lengths, unnest(range(1, len(w) - n + 2)) AS t(i)),
hits AS (SELECT doc_id, i, s.n, item_id FROM starts s JOIN phrases p ON s.p = p.p AND s.n = p.n),
covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM hits, unnest(range(i, i + n)) AS t(k) GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
    string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
  FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)
"""


@query
def op7_adaptive_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), k=10, every=100)


@query
def op8_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language.held_out("doc_id", 3, 1))
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.train(docs.filter("NOT held_out").join(labels, "doc_id"))
    found = toxicity.score(docs, model, columns=("doc_id", "held_out"))
    return found.withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0))


@query
def op9_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.poisson_mix(table(spark, sf_dir, "documents"), seed="mix")
    return mixed.drop("_order").withColumnRenamed("_copy", "copy_no")


SQL["op9_poisson_mix"] = """
WITH sizes AS (
  SELECT source, sum(coalesce(strlen(text), 0) + 1) AS b FROM documents GROUP BY source),
rates AS (
  SELECT source, (1.0::DOUBLE / (SELECT count(*) FROM sizes)) * (SELECT sum(b) FROM sizes)::DOUBLE / b::DOUBLE AS rate FROM sizes),
terms AS (
  SELECT source, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS term
  FROM rates, unnest(range(0, CAST(rate + 12 * sqrt(rate) + 40 AS BIGINT))) AS t(k)),
steps AS (
  SELECT source, k, sum(term) OVER (PARTITION BY source ORDER BY k) AS step FROM terms),
drawn AS (
  SELECT *, (('0x' || md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null'))[1:12])::UBIGINT + 0.5::DOUBLE)
    / 281474976710656.0::DOUBLE AS u FROM documents),
counted AS (
  SELECT d.*, (SELECT count(*) FROM steps s WHERE s.source IS NOT DISTINCT FROM d.source AND s.step < d.u) AS n FROM drawn d)
SELECT doc_id, text, lang, source, n_chars, CAST(c AS INTEGER) AS copy_no
FROM counted, unnest(range(1, n + 1)) AS t(c)
"""


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.dedup_substrings(table(spark, sf_dir, "documents"), width=13)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


URL_RULES = "VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')"


@native
def op11_bloom_cascade_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM {URL_RULES} AS rules(host, path, verdict)")
    found = url_cascade.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return found.select(
        "page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict")
    )


SQL["op11_bloom_cascade_urls"] = r"""
WITH rests AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM rests),
rules(rule_host, rule_path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT p.page_id, p.host, p.path, rule_host || rule_path AS rule, verdict
  FROM parts p LEFT JOIN rules r
    ON (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM fits QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) = 1
"""


@query
def op12_pair_bound_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


SQL["op12_pair_bound_search"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
lengths AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
totals AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM lengths),
posts AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) AS t
  WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
  FROM posts, totals GROUP BY term, n_docs),
impacts AS (
  SELECT p.doc_id, p.term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))) AS impact
  FROM posts p JOIN weights USING (term) JOIN lengths USING (doc_id), totals),
scores AS (
  SELECT item_id, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM impacts JOIN q USING (term) GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
"""


@query
def op13_angular_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", turned), every=100)


SQL["op13_angular_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
    CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s
  WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
  other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
WHERE 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
