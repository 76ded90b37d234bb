"""The queries opN_<name>, their SQL, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.llm import collocations, decontamination, exact_dedup, hard_negatives, language, mixing, ngram_join, quality, sharding, substring_dedup, token_counts, token_files, url_rules
from chalkline.llm.common import documents

DEDUP_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM t
"""


SUBSTRING_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h
      FROM d, LATERAL (SELECT unnest(generate_series(1, len(w) - 49)) AS i) WHERE len(w) >= 50),
f AS (SELECT h, min(doc_id) AS first_id FROM p GROUP BY h),
hit AS (SELECT p.doc_id, p.i FROM p JOIN f USING (h) WHERE f.first_id < p.doc_id),
gone AS (SELECT doc_id, list_distinct(list(k)) AS ks FROM (SELECT doc_id, unnest(generate_series(i, i + 49)) AS k FROM hit) GROUP BY doc_id),
kept AS (SELECT d.doc_id, len(w) AS n_words, coalesce(len(ks), 0) AS n_removed,
                CASE WHEN ks IS NULL THEN array_to_string(w, ' ')
                     ELSE array_to_string(list_transform(list_filter(generate_series(1, len(w)), lambda k: NOT list_contains(ks, k)), lambda k: w[k]), ' ') END AS t
         FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM kept
"""


#: The URL rules that the query applies: host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

URL_SQL = r"""
WITH u AS (SELECT row_number() OVER () AS i, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT i, page_id, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM u),
q AS (SELECT i, page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM p),
r AS (SELECT * FROM (VALUES RULES) AS t(rh, rp, rv)),
m AS (SELECT i, rh || rp AS rule, rv FROM q JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
      QUALIFY row_number() OVER (PARTITION BY i ORDER BY length(rh || rp) DESC) = 1)
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM q LEFT JOIN m USING (i)
""".replace("RULES", ", ".join(map(str, URL_RULES)))


PHRASE_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
c AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(body, '[.,;:!?\x0A-\x0D]')) AS p FROM t)),
g AS (SELECT lang, k, list_slice(w, i, i + k - 1) AS v, count(*) AS f
      FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM c, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k) GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM g WHERE k = 1 GROUP BY lang),
f AS (SELECT lang, k, v, array_to_string(v, ' ') AS phrase, CAST(f AS HUGEINT) AS f FROM g WHERE f >= 30),
x AS (SELECT lang, k, v, phrase, f AS a, unnest(generate_series(1, k - 1)) AS cut FROM f WHERE k > 1),
s AS (SELECT x.lang, x.k, x.v, x.phrase, x.a, l.f AS l, r.f AS r, 2000000 * x.a // (l.f + r.f) AS score
      FROM x JOIN f l ON l.lang = x.lang AND l.v = list_slice(x.v, 1, cut) JOIN f r ON r.lang = x.lang AND r.v = list_slice(x.v, cut + 1, x.k)
      QUALIFY row_number() OVER (PARTITION BY x.lang, x.phrase ORDER BY score, cut) = 1),
o AS (SELECT lang, v AS whole, k, a AS b, unnest(generate_series(2, k - 1)) AS size FROM s WHERE k > 2),
q AS (SELECT lang, list_slice(whole, i, i + size - 1) AS v, max(b) AS b
      FROM (SELECT *, unnest(generate_series(1, k - size + 1)) AS i FROM o) GROUP BY ALL)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
       CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM s JOIN n ON n.lang = s.lang LEFT JOIN q ON q.lang = s.lang AND q.v = s.v WHERE q.b IS NULL OR 100 * q.b < 80 * a
QUALIFY rank <= 2000
"""

NEGATIVES_SQL = r"""
WITH e AS (SELECT row_number() OVER () AS i, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
           FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.i, a.vec_id AS anchor_id, b.i AS j, b.vec_id AS other, a.label = b.label AS alike,
             CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.i <> b.i),
p AS (SELECT i, anchor_id, j AS pj, other AS positive_id, score AS positive_score FROM s WHERE alike
      QUALIFY row_number() OVER (PARTITION BY i ORDER BY score DESC, other, j) <= 5),
n AS (SELECT p.*, other AS negative_id, score AS negative_score,
             row_number() OVER (PARTITION BY i, pj ORDER BY score DESC, other, j) AS rank
      FROM p JOIN s USING (i, anchor_id)
      WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(documents(spark, sf_dir)).drop("bucket")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(documents(spark, sf_dir)).drop("row_no", "text64")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(documents(spark, sf_dir)).drop("kept_text", "intervals")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), shards=24)


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), weights=(3, 1, 2), share=1.5, epochs=2).drop("text64")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.score(docs, quality.train(docs, labels), threshold=0.7)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text64")


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir), least=30, first=2000, share=80)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", label), F.col("id") % 100 == 0, positives=5, negatives=10, low=30, high=90)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_exact_dedup, op3_ngram_join, op4_substring_dedup, op5_sharding, op6_token_ids, op7_language_id, op8_mixing, op9_quality, op10_decontamination, op11_url_filters, op12_collocations, op13_hard_negatives, pipeline)}


def oracle_sql() -> dict[str, str]:
    own = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return own | {"op2_exact_dedup": DEDUP_SQL, "op4_substring_dedup": SUBSTRING_SQL, "op8_mixing": mixing.MIX_SQL, "op11_url_filters": URL_SQL, "op12_collocations": PHRASE_SQL, "op13_hard_negatives": NEGATIVES_SQL}
