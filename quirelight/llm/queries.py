"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, fingerprints, html_extraction, importance_resampling, jaccard_join, lm_scoring, mixing, packing, periodic_runs, sharding, token_counts, toxicity, url_filters


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    lexicon = toxicity.learn(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, lexicon, keep=[docs["doc_id"]])
    doc_id = F.col("row.doc_id")
    return scored.select(doc_id.alias("doc_id"), toxicity.held_out(doc_id).alias("held_out"), "score", F.when(F.col("score") >= toxicity.LIMIT, 1).otherwise(0).alias("predicted"), "n_hits")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(_table(spark, sf_dir, "pages"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return lm_scoring.score(docs, lm_scoring.fit(docs, token_counts.read_vocabulary(lm_scoring.VOCABULARY)))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(_table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edits(_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), token_counts.read_vocabulary(token_counts.VOCABULARY))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(_table(spark, sf_dir, "documents"), edit=periodic_runs.repeated_tail)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r.start, F.lit(","), r.length, F.lit(","), r.period, F.lit("\n")))
    top = found.withColumns({"best": longest, "length": F.col("best.length"), "period": -F.col("best.period")})
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), "length", "period",
        F.floor(F.expr("1000 * length div period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance_resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(_table(spark, sf_dir, "pages"), html_extraction.fit())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_toxicity, op2_url_filters, op3_mixing, op4_lm_scoring, op5_sharding, op6_embedding_dedup, op7_fingerprints, op8_packing, op9_jaccard_join, op10_token_counts, op11_periodic_runs, op12_importance_resampling, op13_html_extraction)
}

# water-filling and the hash draw, from the same definitions
ORACLE_SQL: dict[str, str] = {
    "op3_mixing": r"""
WITH rows_ AS (
  SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows_ GROUP BY source
), weighed AS (
  SELECT *, 1.0 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS weight, source_size * CAST(3 AS DOUBLE) AS most FROM src
), filled AS (
  SELECT *, row_number() OVER f AS nth,
    ((SELECT sum(source_size) FROM src) - coalesce(sum(most) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / ((SELECT sum(weight) FROM weighed) - coalesce(sum(weight) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighed WINDOW f AS (ORDER BY most / weight, encode(source) NULLS LAST)
), final AS (
  SELECT CAST(arg_min(level, nth) AS DOUBLE) AS level FROM filled WHERE level <= most / weight
), targets AS (
  SELECT source, source_size, least(CAST(weight AS DOUBLE) * (SELECT level FROM final), most) AS target FROM filled
), rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0) ELSE 0 END AS rate FROM targets
), drawn AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, t.rate,
    CAST(CAST('0x' || substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM rows_ r JOIN rated t ON r.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM drawn
""",
    # crc32 from its definition, by a table of 256 remainders
    "op12_importance_resampling": r"""
WITH rem AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(CAST(3988292384 AS BIGINT), a >> 1) ELSE a >> 1 END) ORDER BY i) AS tab FROM range(256) AS t(i)
), texts AS (
  SELECT 0 AS kind, row_number() OVER () AS row_, doc_id, text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark
), split AS (
  SELECT kind, row_, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), features AS (
  SELECT kind, row_, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM split
), counted AS (
  SELECT kind, row_, f, count(*) AS n FROM features GROUP BY ALL
), distinct_ AS (
  SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM counted)
), hashed AS (
  SELECT f, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
    lambda a, x: xor(tab[(xor(a, x) & 255) + 1], a >> 8)), 4294967295) % 10000 AS bucket FROM distinct_, rem
), placed AS (
  SELECT kind, row_, bucket, n FROM counted JOIN hashed USING (f)
), sums AS (
  SELECT bucket, coalesce(sum(n) FILTER (kind = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (kind = 1), 0)::DOUBLE AS t FROM placed GROUP BY bucket
), gained AS (
  SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM sums) + 10000) / ((s + 1) * ((SELECT sum(t) FROM sums) + 10000)))) AS gain FROM sums
), weighed AS (
  SELECT row_, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM placed JOIN gained USING (bucket) WHERE kind = 0 GROUP BY row_
), scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score
  FROM split LEFT JOIN weighed USING (row_) WHERE kind = 0
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS total FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * total // 100 THEN place END AS rank FROM ordered
""",
}
