"""Registered queries of this subpackage and their reference SQL (DuckDB), where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import bloom_lm, chat, divergence, filter_audit, fingerprints, html_text, lattice, minhash, mixing, packing, tokens, toxicity, warc
from corpusmill.llm.common import remainder, word_count

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their bins; lengths are token ids with the end id."""
    counts = tokens.token_counts(table(spark, sf_dir, "documents"))
    return packing.pack(counts, F.col("n_tokens")).select(
        "row.doc_id", "piece", "piece_start", "piece_length", "bin_id", "bin_size", "bin_offset"
    )


@query()
def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.stored_digest(table(spark, sf_dir, "documents"))


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS total FROM d GROUP BY source
), w AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(turn % 3 + 1)::INT] AS weight, (3 * total)::DOUBLE AS cap
  FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM s)
), l AS (
  SELECT *, (sum(total) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY cap / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, total,
         least(cap, weight * (SELECT arg_min(level, (cap / weight, turn)) FROM l WHERE level * weight <= cap)) AS target
  FROM l
), r AS (
  SELECT d.*, total AS source_size, target, CASE WHEN total > 0 THEN floor(target / total)::BIGINT ELSE 0 END AS copies
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, target - copies * source_size AS budget,
         sum(size) OVER (PARTITION BY source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(size) OVER (PARTITION BY source, h) AS here
  FROM r
)
SELECT doc_id, size, source_size, round(target, 4) AS target,
       (size * (copies + CASE WHEN upto <= budget OR 2 * upto - here < 2 * budget THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""


@query(MIX_SQL)
def op7_hash_threshold_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents"), word_count(F.col("text")))
    return rows.select("row.doc_id", "size", "source_size", F.round("target", 4).alias("target"), (F.col("size") * F.col("copies")).alias("taken"))


@query()
def op5_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4)


@query()
def op3_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; labels are learnt from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(remainder(F.col("doc_id"), 5) != 0)
    fitted, model = toxicity.trained(docs.select("doc_id", "text"), labels)
    rows = toxicity.scored(docs, fitted, model, carry=["doc_id"])
    return rows.select(
        "row.doc_id", (remainder(F.col("row.doc_id"), 5) == 0).alias("held_out"), "score", toxicity.predicted(F.col("score")).alias("predicted")
    )


@query()
def op4_improbable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return fingerprints.fingerprints(docs, fingerprints.rarity_ranks(docs))


@query()
def op9_text_to_tag_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


@query(
    """
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
           AND NOT list_contains(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)), FALSE) AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(vec_id, root) AS (WITH RECURSIVE c(vec_id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, c.root FROM c JOIN l ON l.a = c.vec_id)
      SELECT vec_id, min(root) FROM c GROUP BY 1)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, r.root AS component_id, e.vec_id = r.root AS kept
FROM embeddings e JOIN r USING (vec_id)
"""
)
def op6_e8_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(table(spark, sf_dir, "embeddings"))


@query()
def op8_log_frequency_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.scored(table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 7) == 2)


@query()
def op10_prefix_tree_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one (-1) whose texts are control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text")
    )
    return chat.formatted(rows.unionByName(extra))


@query(divergence.SQL)
def op11_run_length_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


@query(filter_audit.SQL)
def op12_filter_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(warc.SQL)
def op13_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_digest(table(spark, sf_dir, "pages"))
