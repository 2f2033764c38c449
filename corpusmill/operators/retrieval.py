"""Ranking: lexical, vector and overlap top-k for many queries at once, and rank fusion."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from corpusmill.functions import text as T
from corpusmill.operators import postings
from corpusmill.operators.scale import broadcast_if_small, first_k
from corpusmill.session import checkpoint_dir, checkpointed

SCORE_PLACES = 6
# Queries whose vectors one task may hold at once (64 floats each: about 2 MB).
QUERY_BLOCK = 4096
# Vectors compared with one query block in one grid cell.
VECTOR_BLOCK = 100_000


def _top(scored: DataFrame, key: str, k: int, score: str = "score") -> DataFrame:
    """First ``k`` per query by score, ties to the lower key."""
    return first_k(scored, ["query_id"], [F.col(score).desc(), F.col(key)], k, rank="rank")


def asked_terms(queries: DataFrame, query: str = "query") -> DataFrame:
    """(query, term, count of the term in the query)."""
    terms = queries.select("query_id", F.explode_outer(T.tokens(query)).alias("term")).where("term IS NOT NULL")
    return terms.groupBy("query_id", "term").agg(F.count("*").alias("q_count"))


def bm25_topk(
    queries: DataFrame, docs: DataFrame, k: int, key: str = "doc_id", text: str = "text", all_terms: bool = False,
    index: postings.Index | None = None, **options,
) -> DataFrame:
    """The first k by BM25, from ``index`` or from one that is written for these queries. The hits are stored, so that what
    branches from them does not rank again."""
    index = index or postings.bm25_index(docs, f"{checkpoint_dir(docs.sparkSession)}/postings/{uuid.uuid4().hex}", key, text, **options)
    weights = checkpointed(postings.bm25_weights(index, asked_terms(queries)))
    return checkpointed(_top(postings.search(index, weights, k, all_terms), key, k))


def fulltext_all(queries: DataFrame, docs: DataFrame, k: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only documents that hold every term of the query."""
    return bm25_topk(queries, docs, k, key, text, all_terms=True)


# A term that no text has, for chunks with figures.
FIGURE = "\0figure"
# What marks a chunk as one with figures.
NUMERIC_HINT = r"\$|\b(?:million|billion|percent|%)\b|\d"


def overlap_topk(queries: DataFrame, chunks: DataFrame, k: int, key: str = "chunk_id", text: str = "content") -> DataFrame:
    """Ten points per shared distinct token plus one for a number; ties to the earlier chunk.

    Chunks that share nothing can still fill the list, so the first k with and without a number stand in for them.
    """
    kept = lambda c: F.array_except(F.array_distinct(T.tokens(c, "lexical")), F.array(*[F.lit(w) for w in T.OVERLAP_STOPWORDS]))
    hint = F.lower(F.col(text)).rlike(NUMERIC_HINT).cast("int")
    asked = queries.select("query_id", F.explode_outer(kept("query")).alias("term")).where("term is not null")
    terms = F.concat(F.coalesce(kept(text), F.array().cast("array<string>")), F.when(hint == 1, F.array(F.lit(FIGURE))).otherwise(F.array().cast("array<string>")))
    index = postings.write_index(chunks, f"{checkpoint_dir(chunks.sparkSession)}/postings/{uuid.uuid4().hex}", terms, key, binary=True)
    weights = asked.withColumn("weight", F.lit(10.0)).unionByName(queries.select("query_id", F.lit(FIGURE).alias("term"), F.lit(1.0).alias("weight")))
    hits = postings.search(index, checkpointed(weights), k).select("query_id", key, F.col("score").cast("bigint").alias("score"))
    spare = first_k(chunks.select(key, hint.cast("bigint").alias("score")), ["score"], [F.col(key)], k)
    spare = spare.agg(F.collect_list(F.struct(F.col(key), "score"))).scalar()
    fill = queries.select("query_id", F.explode(spare).alias("s")).select("query_id", f"s.{key}", "s.score")
    best = hits.unionByName(fill).groupBy("query_id", key).agg(F.max("score").alias("score"))
    return _top(best, key, k)


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    norm[norm == 0] = 1.0
    return m / norm


def _best_of(q_ids: np.ndarray, q: np.ndarray, keys: np.ndarray, v: np.ndarray, k: int, floor: float | None, name: str) -> pd.DataFrame:
    """The k best keys per query in one block of vectors, ties to the lower key."""
    scores = np.round(q @ v.T, SCORE_PLACES)
    qs, ks, ss = [], [], []
    for i, row in enumerate(scores):
        if len(row) > k:
            edge = np.partition(row, len(row) - k)[len(row) - k]
            above = np.flatnonzero(row > edge)
            level = np.flatnonzero(row == edge)
            pick = np.concatenate([above, level[np.argsort(keys[level], kind="stable")[: k - len(above)]]])
        else:
            pick = np.arange(len(row))
        if floor is not None:
            pick = pick[row[pick] >= floor]
        qs.append(np.full(len(pick), q_ids[i]))
        ks.append(keys[pick])
        ss.append(row[pick])
    cat = lambda parts: np.concatenate(parts) if parts else np.array([])
    return pd.DataFrame({"query_id": cat(qs), name: cat(ks), "score": cat(ss)})


def vector_scores(queries: DataFrame, vectors: DataFrame, k: int, key: str = "doc_id", min_score: float | None = None) -> DataFrame:
    """Cosine candidates: the k best per query of every block of vectors, so output stays small.

    Up to ``QUERY_BLOCK`` queries go to every task and the vectors are not shuffled. More queries are cut into
    blocks, and query blocks meet vector blocks in a grid joined on (query block, vector block).
    """
    queries, vectors = queries.select("query_id", "vector"), vectors.select(key, "vector")
    schema = S.StructType([queries.schema["query_id"], vectors.schema[key], S.StructField("score", S.DoubleType())])
    first = queries.limit(QUERY_BLOCK + 1).toPandas()
    if len(first) <= QUERY_BLOCK:
        q_ids = first["query_id"].to_numpy()
        q = _unit(np.stack(first["vector"].to_numpy()).astype("float64")) if len(first) else np.zeros((0, 1))
        shared = queries.sparkSession.sparkContext.broadcast((q_ids, q))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, m = shared.value
            for pdf in batches:
                if len(pdf) and len(ids):
                    v = _unit(np.stack(pdf["vector"].to_numpy()).astype("float64"))
                    yield _best_of(ids, m, pdf[key].to_numpy(), v, k, min_score, key)

        return vectors.mapInPandas(scan, schema)
    return _vector_grid(queries, vectors, k, key, min_score, schema)


def _vector_grid(queries, vectors, k, key, min_score, schema) -> DataFrame:
    n_q = -(-queries.count() // QUERY_BLOCK)
    n_v = max(1, -(-vectors.count() // VECTOR_BLOCK))
    left = queries.withColumn("qb", F.pmod(F.hash("query_id"), F.lit(n_q))).withColumn(
        "vb", F.explode(F.sequence(F.lit(0), F.lit(n_v - 1)))
    )
    right = vectors.withColumn("vb", F.pmod(F.hash(key), F.lit(n_v))).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)))
    )

    def cell(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], key: [], "score": []})
        q = _unit(np.stack(a["vector"].to_numpy()).astype("float64"))
        v = _unit(np.stack(b["vector"].to_numpy()).astype("float64"))
        return _best_of(a["query_id"].to_numpy(), q, b[key].to_numpy(), v, k, min_score, key)

    return left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInPandas(cell, schema)


def vector_topk(
    queries: DataFrame, vectors: DataFrame, k: int, key: str = "doc_id", min_score: float | None = None,
    only: DataFrame | None = None,
) -> DataFrame:
    """Exact cosine top-k; ``only`` restricts the keys before ranking."""
    if only is not None:
        vectors = vectors.join(only.select(key).distinct(), key, "left_semi")
    return _top(vector_scores(queries, vectors, k, key, min_score), key, k)


def vector_ann(
    queries: DataFrame, vectors: DataFrame, k: int, key: str = "doc_id", tables: int = 24, bits: int = 5, seed: int = 7
) -> DataFrame:
    """Approximate top-k: random-hyperplane buckets give candidates, exact cosine ranks them."""
    dim = len(vectors.select("vector").head()[0])
    planes = np.random.default_rng(seed).standard_normal((dim, tables * bits))
    powers = 2 ** np.arange(bits)

    @F.pandas_udf(S.ArrayType(S.LongType()))
    def buckets(batch: pd.Series) -> pd.Series:
        if not len(batch):
            return pd.Series([], dtype=object)
        signs = (np.stack(batch.to_numpy()) @ planes > 0).reshape(len(batch), tables, bits)
        return pd.Series(list((signs * powers).sum(axis=2).astype("int64")))

    left = queries.select("query_id", F.col("vector").alias("qv"), F.posexplode(buckets("vector")).alias("table", "bucket"))
    right = vectors.select(key, F.posexplode(buckets("vector")).alias("table", "bucket"))
    pairs = left.drop("qv").join(right, ["table", "bucket"]).select("query_id", key).distinct()
    scored = (
        pairs.join(vectors.select(key, "vector"), key)
        .join(queries.select("query_id", F.col("vector").alias("qv")), "query_id")
        .select("query_id", key, F.round(cosine("qv", "vector"), SCORE_PLACES).alias("score"))
    )
    return _top(scored, key, k)


def cosine(a: str, b: str) -> Column:
    """Cosine of two array columns in double precision."""

    def dot(x: Column, y: Column) -> Column:
        pairs = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p)

    x, y = F.col(a), F.col(b)
    return dot(x, y) / F.nullif(F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)), F.lit(0.0))


def ranked(scored: DataFrame, key: str, n: int, ties: str = "position") -> DataFrame:
    """Ranks within a query, by position or with shared ranks for equal scores; the first ``n`` rows are kept."""
    rows = _top(scored, key, n)
    if ties == "rank":
        # Rows of equal score share the lowest position among the kept rows: rank() over the same order.
        w = F.expr("rank() OVER (PARTITION BY query_id ORDER BY score DESC)")
        rows = rows.withColumn("rank", w.cast("bigint"))
    return rows


def rrf_score(rank: Column | str, k: int = 60, weight: Column | float = 1.0) -> Column:
    """Fused score as an aggregate over ranked lists."""
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    return F.sum(w / (F.lit(k) + T.col(rank)))


def rrf_many(lists: dict[str, DataFrame], key: str, n: int, k: int = 60, weights: dict[str, float] | None = None) -> DataFrame:
    """Fuse ranked lists (query_id, key, rank): score, rank in each list (0: absent) and the lists that hold the item.

    One union and one aggregation, whatever the number of lists.
    """
    weights = weights or {}
    rows = None
    for name, one in lists.items():
        part = one.select("query_id", key, "rank", F.lit(name).alias("list"), F.lit(float(weights.get(name, 1.0))).alias("weight"))
        rows = part if rows is None else rows.unionByName(part)
    fused = rows.groupBy("query_id", key).agg(
        F.round(rrf_score("rank", k, F.col("weight")), 9).alias("score"),
        *[F.coalesce(F.min(F.when(F.col("list") == name, F.col("rank"))), F.lit(0)).alias(f"{name}_rank") for name in lists],
        F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"),
    )
    return _top(fused, key, n)


def rrf(left: DataFrame, right: DataFrame, key: str, n: int, k: int = 60) -> DataFrame:
    return rrf_many({"left": left, "right": right}, key, n, k).drop("lists")


VARIANTS = {"hybrid_rrf", "hybrid_rrf_plus", "hybrid_weighted"}


def hybrid_topk(
    queries: DataFrame, docs: DataFrame, vectors: DataFrame, k: int, variant: str = "hybrid_rrf", mode: str = "hybrid",
    key: str = "doc_id", text: str = "text", rrf_k: int = 60, vector_weight: float = 0.60, keyword_weight: float = 0.40,
) -> DataFrame:
    """Vector and lexical lists of five times ``k`` each, fused by rank. Modes ``bm25`` and ``vector`` use one list."""
    variant = variant if variant in VARIANTS else "hybrid_rrf"
    lists: dict[str, DataFrame] = {}
    if mode in ("hybrid", "vector"):
        lists["vector"] = vector_topk(queries, vectors, 5 * k, key)
    if mode in ("hybrid", "bm25"):
        asked = queries
        if variant in ("hybrid_rrf_plus", "hybrid_weighted"):
            asked = queries.withColumn("query", T.normalize_query("query"))
        lists["bm25"] = bm25_topk(asked, docs, 5 * k, key, text)
    weights = {"vector": vector_weight, "bm25": keyword_weight} if variant == "hybrid_weighted" else None
    return rrf_many(lists, key, k, rrf_k, weights)


def compare_rankers(lists: dict[str, DataFrame], targets: DataFrame, key: str, top: int = 5) -> DataFrame:
    """Rank (0: not ranked) and score of each target item under each scorer, beside that scorer's first ``top`` items."""
    out = None
    for name, one in lists.items():
        heads = one.where(F.col("rank") <= top).groupBy("query_id").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", key))), lambda s: s[key].cast("string")), ",").alias("top_items")
        )
        found = targets.join(one.select("query_id", key, "rank", "score"), ["query_id", key], "left").join(heads, "query_id", "left")
        found = found.withColumn("rank", F.coalesce("rank", F.lit(0))).withColumn("ranker", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out


def rerank(hits: DataFrame, scorer: Column | None, payload_key: str = "doc_id", n: int | None = None) -> DataFrame:
    """New order by ``scorer`` (built-in expression or Arrow function) of all hits, or of the first ``n`` of each query;
    without a scorer the order stays."""
    if scorer is None:
        return hits
    scored = hits.withColumnRenamed("rank", "old_rank").withColumn("score", F.round(scorer, SCORE_PLACES))
    order = [F.col("score").desc(), F.col("old_rank"), F.col(payload_key)]
    if n is None:
        return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("bigint"))
    return first_k(scored, ["query_id"], order, n, rank="rank")


def ann_recall(exact: DataFrame, approx: DataFrame, key: str = "doc_id") -> DataFrame:
    """Share of the exact hits that the approximate list also has, per query."""
    found = approx.select("query_id", key, F.lit(1).alias("found"))
    return exact.join(found, ["query_id", key], "left").groupBy("query_id").agg(
        F.round(F.avg(F.coalesce("found", F.lit(0))), SCORE_PLACES).alias("recall")
    )
