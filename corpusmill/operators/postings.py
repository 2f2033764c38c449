"""A persistent index of postings, and top-k ranking that reads no more of it than may still matter.

The index is cut into *shards* of documents, by a hash of the key, so that no term has more postings in one place than a
shard has documents, however common it is. In a shard documents are numbered in the order of their keys; a row of the
index is a term of a shard with the numbers of its documents and how often each has it; one more row of a shard has the
keys and lengths of its documents. What a term counts in a document hangs on the mean length of all, so it is worked out
where the term is asked for, with an upper bound of each block of ``BLOCK`` postings. Building splits the texts once.

Ranking takes the terms of a query from the dearest to the cheapest. A shard keeps partial scores; as soon as the terms
that are left could not bring a new document among the first k, only documents that are still in reach are looked up in
them, and those whose block bound shows that they fall short are dropped. So a shard gives at most k rows of a query.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from corpusmill.functions import text as T
from corpusmill.operators.scale import broadcast_if_small

#: Documents of a shard (at most about so many), postings under one bound, queries that one task ranks at once.
SHARD_DOCS, BLOCK, QUERY_BLOCK = 10_000, 128, 4096
SCORE_PLACES = 6
#: Scores closer than this may be equal once they are rounded.
SLACK = 10.0**-SCORE_PLACES


@dataclass(frozen=True)
class Index:
    """A written index: its folder, the name of the key column, the number of its documents and of its shards."""

    path: str
    key: str
    n_docs: int
    shards: int

    def postings(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/postings")

    def mean_length(self, spark: SparkSession) -> float:
        total, counted = self.postings(spark).where("term is null").agg(F.sum("total"), F.sum("counted")).first()
        return total / counted if total and counted else 1.0

    def document_frequencies(self, spark: SparkSession) -> DataFrame:
        return self.postings(spark).where("term is not null").groupBy("term").agg(F.sum("n").alias("df"))


def bounds(impacts: np.ndarray, starts: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The greatest impact in each block of each list, and how many blocks the lists have. ``starts``: where lists begin."""
    sizes = np.diff(np.append(starts, len(impacts)))
    n = -(-sizes // block)
    first = np.repeat(starts, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * block
    return np.maximum.reduceat(impacts, first) if len(impacts) else impacts, n


def impact(tf: np.ndarray, lengths: np.ndarray, mean: float, shape: list[float] | None) -> np.ndarray:
    """What a term counts in documents: by BM25 with ``shape`` (k1, b), 1 without."""
    if shape is None:
        return np.ones(len(tf))
    k1, b = shape
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths / mean))


def write_index(
    docs: DataFrame, path: str, terms: Column, key: str = "doc_id", k1: float = 1.5, b: float = 0.75, binary: bool = False,
    shard_docs: int = SHARD_DOCS,
) -> Index:
    """Index ``docs`` by ``terms`` (an array of strings). The impact is that of BM25, or 1 for each term if ``binary``.

    Documents are counted first, without their terms. One exchange, by shard. A document without terms counts as a document; one whose terms are null does not lower the mean
    length.
    """
    spark = docs.sparkSession
    n_docs = docs.count()
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_docs // shard_docs))
    rows = docs.select(F.pmod(F.xxhash64(key), F.lit(shards)).cast("int").alias("shard"), F.col(key).alias("key"), terms.alias("terms"))
    whole = S.ArrayType(S.IntegerType())
    schema = S.StructType().add("shard", "integer").add("term", "string").add("n", "integer").add("docs", whole).add("tf", whole)
    schema = schema.add("keys", S.ArrayType(rows.schema["key"].dataType)).add("lengths", whole)
    schema = schema.add("total", "long").add("counted", "long").add("shape", S.ArrayType(S.DoubleType()))

    def built(name: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("key").combine_chunks()
        tokens = group.column("terms").combine_chunks()
        tokens = tokens.chunk(0) if isinstance(tokens, pa.ChunkedArray) else tokens
        sizes = pc.list_value_length(tokens)
        lengths = pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = tokens.flatten().dictionary_encode()
        row = np.repeat(np.arange(len(lengths)), lengths)
        pairs, tf = np.unique(flat.indices.to_numpy().astype(np.int64) * max(1, len(lengths)) + row, return_counts=True)
        term, doc = pairs // max(1, len(lengths)), pairs % max(1, len(lengths))
        starts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, dtype=np.int64)
        ends = np.append(starts, len(doc)).astype(np.int32)
        cut = lambda values, at: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values.astype(np.int32)))
        n = len(starts)
        found = pa.table({
            "shard": pa.array([name[0].as_py()] * n, pa.int32()), "term": flat.dictionary.take(pa.array(term[starts])), "n": pa.array(np.diff(ends).astype(np.int32)),
            "docs": cut(doc, ends), "tf": cut(tf, ends), "keys": pa.nulls(n, pa.list_(group.column("key").type)), "lengths": pa.nulls(n, pa.list_(pa.int32())),
            "total": pa.nulls(n, pa.int64()), "counted": pa.nulls(n, pa.int64()), "shape": pa.nulls(n, pa.list_(pa.float64())),
        })
        keys = group.column("key").combine_chunks()
        keys = keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        names = pa.table({
            "shard": pa.array([name[0].as_py()], pa.int32()), "term": pa.nulls(1, pa.string()), "n": pa.array([len(keys)], pa.int32()),
            "docs": pa.nulls(1, found.column("docs").type), "tf": pa.nulls(1, found.column("tf").type), "keys": one(keys), "lengths": one(pa.array(lengths, pa.int32())),
            "total": pa.array([int(lengths.sum())], pa.int64()), "counted": pa.array([len(sizes) - sizes.null_count], pa.int64()),
            "shape": pa.array([None if binary else [k1, b]], pa.list_(pa.float64())),
        })
        return pa.concat_tables([found, names])

    index = rows.groupBy("shard").applyInArrow(built, schema)
    index.sortWithinPartitions("term").write.parquet(f"{path}/postings")
    return Index(path, key, n_docs, shards)


def first_of(lists: list[tuple[float, np.ndarray, np.ndarray, np.ndarray]], n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The documents that may be among the first ``k``, and their exact scores. ``lists``: weight, documents (ascending),
    impacts and block bounds of each term."""
    lists = sorted(lists, key=lambda x: -x[0] * x[3].max())
    most = np.array([w * tops.max() for w, _, _, tops in lists])
    rest = np.append(np.cumsum(most[::-1])[::-1], 0.0)  # what the terms from here on can add
    score, floor, at = np.zeros(n_docs), -np.inf, 0
    for at, (w, docs, impacts, _) in enumerate(lists):
        if rest[at] < floor - SLACK:
            break
        score[docs] += w * impacts
        if n_docs > k:
            kth = np.partition(score, n_docs - k)[n_docs - k]
            floor = kth if kth > 0 else -np.inf
    else:
        at = len(lists)
    alive = np.flatnonzero((score > 0) & (score + rest[at] >= floor - SLACK))
    for i in range(at, len(lists)):
        w, docs, impacts, tops = lists[i]
        where = np.minimum(np.searchsorted(docs, alive), len(docs) - 1)
        reach = score[alive] + w * tops[where // BLOCK] + rest[i + 1] >= floor - SLACK
        alive, where = alive[reach], where[reach]
        hit = docs[where] == alive
        score[alive[hit]] += w * impacts[where[hit]]
        alive = alive[score[alive] + rest[i + 1] >= floor - SLACK]
    return alive, score[alive]


def all_of(lists: list[tuple[float, np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The documents that every list has, and their scores: the shortest list first."""
    lists = sorted(lists, key=lambda x: len(x[1]))
    alive, score = lists[0][1], lists[0][0] * lists[0][2]
    for w, docs, impacts, _ in lists[1:]:
        where = np.minimum(np.searchsorted(docs, alive), len(docs) - 1)
        hit = docs[where] == alive
        alive, score = alive[hit], score[hit] + w * impacts[where[hit]]
    return alive, score


def best(docs: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` by rounded score, ties to the lower document."""
    score = np.round(score, SCORE_PLACES)
    order = np.lexsort((docs, -score))[:k]
    return docs[order], score[order]


def search(index: Index, weights: DataFrame, k: int, all_terms: bool = False) -> DataFrame:
    """The k best of every shard for every query: ``query_id``, the key, ``score``.

    ``weights``: query_id, term, weight. Queries are cut into blocks, and each (shard, block of queries) is a group of its
    own; a shard's postings go to a block only for terms that it asks for.
    """
    spark = weights.sparkSession
    n = weights.select("query_id").distinct().count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    weights = weights.select("query_id", "term", "weight").withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    postings = index.postings(spark)
    wanted = postings.join(broadcast_if_small(weights.select("term", F.col("qb").alias("block")).distinct()), "term").withColumnRenamed("block", "qb")
    names = postings.where("term is null").withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    columns = ["shard", "qb", "term", "docs", "tf", "keys", "lengths", "shape"]
    mean = index.mean_length(spark)
    left = wanted.select(columns).unionByName(names.select(columns))
    right = weights.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(index.shards - 1))))
    key_type = postings.schema["keys"].dataType.elementType
    schema = S.StructType([S.StructField("query_id", weights.schema["query_id"].dataType), S.StructField(index.key, key_type), S.StructField("score", S.DoubleType())])

    def ranked(_: tuple, shard: pa.Table, asked: pa.Table) -> pa.Table:
        shard = shard.combine_chunks()
        name = shard.column("term").to_pylist()
        at = next((i for i, t in enumerate(name) if t is None), None)
        keys = None if at is None else shard.column("keys")[at].values
        query_type = asked.schema.field("query_id").type
        if keys is None or not asked.num_rows:
            return pa.table({"query_id": pa.array([], query_type), index.key: pa.array([], shard.schema.field("keys").type.value_type), "score": pa.array([], pa.float64())})
        lengths, shape = shard.column("lengths")[at].values.to_numpy(zero_copy_only=False).astype(np.int64), shard.column("shape")[at].as_py()
        lists = {}
        for i, t in enumerate(name):
            if t is not None:
                docs, tf = (shard.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("docs", "tf"))
                impacts = impact(tf.astype(np.int64), lengths[docs], mean, shape)
                lists[t] = docs, impacts, bounds(impacts, np.array([0]))[0]
        asked = asked.sort_by("query_id")
        ids, terms, weight = (asked.column(c).to_pylist() for c in ("query_id", "term", "weight"))
        out_ids, out_docs, out_scores = [], [], []
        at = 0
        while at < len(ids):
            end = at + 1
            while end < len(ids) and ids[end] == ids[at]:
                end += 1
            found = [(w, *lists[t]) for t, w in zip(terms[at:end], weight[at:end]) if t in lists]
            if found and not (all_terms and len(found) < end - at):
                docs, score = best(*(all_of(found) if all_terms else first_of(found, len(keys), k)), k)
                out_ids += [ids[at]] * len(docs)
                out_docs.append(docs)
                out_scores.append(score)
            at = end
        docs, score = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (out_docs, out_scores))
        return pa.table({"query_id": pa.array(out_ids, query_type), index.key: keys.take(pa.array(docs, pa.int64())), "score": pa.array(score, pa.float64())})

    return left.groupBy("shard", "qb").cogroup(right.groupBy("shard", "qb")).applyInArrow(ranked, schema)


def bm25_index(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", **options) -> Index:
    return write_index(docs, path, T.tokens(text), key, **options)


def bm25_weights(index: Index, asked: DataFrame) -> DataFrame:
    """``asked`` (query_id, term, q_count) with BM25's weight of each term; terms that no document has stay, with the
    weight of a term of no document."""
    spread = index.document_frequencies(asked.sparkSession)
    df = F.coalesce("df", F.lit(0))
    weight = F.col("q_count") * F.log(1 + (index.n_docs - df + 0.5) / (df + 0.5))
    return asked.join(spread.join(broadcast_if_small(asked.select("term").distinct()), "term", "left_semi"), "term", "left").select("query_id", "term", weight.alias("weight"))
