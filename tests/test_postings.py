"""The postings index against brute force: every ranking is the exact one, whatever is skipped."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import postings, retrieval

WORDS = [f"w{i}" for i in range(60)]


def texts(n, seed=1):
    draw = random.Random(seed)
    odds = [1 / (i + 1) for i in range(len(WORDS))]
    out = [" ".join(draw.choices(WORDS, odds, k=draw.randrange(0, 40))) for _ in range(n)]
    return out + [None, "", out[0], out[0], "w59 " * 3000]


def brute(docs, queries, k, all_terms=False):
    split = {i: (t or "").split() for i, t in docs}
    mean = sum(map(len, split.values())) / sum(t is not None for _, t in docs)
    df = Counter(w for ws in split.values() for w in set(ws))
    out = []
    for q, asked in queries:
        scores = []
        for i, ws in split.items():
            tf, terms = Counter(ws), Counter(asked.split())
            hits = [w for w in terms if tf[w]]
            if hits and (not all_terms or len(hits) == len(terms)):
                part = lambda w: terms[w] * math.log(1 + (len(split) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(ws) / mean))
                scores.append((-round(sum(map(part, hits)), 6), i))
        out += [(q, i, -s, r) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


QUERIES = [(1, "w0"), (2, "w59 w0 w1"), (3, "w3 w3 w40"), (4, "absent"), (5, ""), (6, " ".join(WORDS)), (7, "w58 absent"), (8, "w2 w5")]


@pytest.mark.parametrize("all_terms", [False, True])
@pytest.mark.parametrize("k, shard_docs, block", [(5, 10_000, 4096), (3, 20, 3), (400, 50, 4096)])
def test_ranking_is_exact(spark, monkeypatch, tmp_path, k, shard_docs, block, all_terms):
    monkeypatch.setattr(postings, "QUERY_BLOCK", block)
    docs = list(enumerate(texts(300)))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    index = postings.bm25_index(table, str(tmp_path / "index"), shard_docs=shard_docs)
    queries = spark.createDataFrame(QUERIES, "query_id long, query string")
    got = retrieval.bm25_topk(queries, table, k, index=index, all_terms=all_terms)
    assert sorted((r["query_id"], r["doc_id"], r["score"], r["rank"]) for r in got.collect()) == brute(docs, QUERIES, k, all_terms)
    # A shard gives no more than k rows of a query.
    weights = postings.bm25_weights(index, retrieval.asked_terms(queries))
    assert postings.search(index, weights, k).groupBy("query_id").count().agg(F.max("count")).first()[0] <= k * index.shards


def test_keys_may_be_texts_and_tables_empty(spark, tmp_path):
    table = spark.createDataFrame([("b", "x y"), ("a", "x y"), ("é", "x"), ("c", None)], "chunk_id string, content string")
    queries = spark.createDataFrame([(1, "x")], "query_id long, query string")
    got = retrieval.bm25_topk(queries, table, 2, "chunk_id", "content").collect()
    assert [r["chunk_id"] for r in sorted(got, key=lambda r: r["rank"])] == ["é", "a"]
    assert retrieval.bm25_topk(queries, table.limit(0), 2, "chunk_id", "content").collect() == []
    assert retrieval.bm25_topk(queries.limit(0), table, 2, "chunk_id", "content").collect() == []


def test_what_is_skipped_cannot_matter():
    draw = np.random.default_rng(4)
    n = 3000
    for k in (1, 10):
        lists, whole = [], np.zeros(n)
        for size in (2900, 1500, 700, 40, 3):
            docs = np.sort(draw.choice(n, size, replace=False))
            impacts, w = draw.exponential(size=size), 1000 / size
            tops, _ = postings.bounds(impacts, np.array([0]))
            assert len(tops) == -(-size // postings.BLOCK) and tops[0] == impacts[: postings.BLOCK].max()
            lists.append((w, docs, impacts, tops))
            whole[docs] += w * impacts
        docs, score = postings.best(*postings.first_of(lists, n, k), k)
        assert docs.tolist() == np.lexsort((np.arange(n), -np.round(whole, 6)))[:k].tolist()
        assert len(postings.first_of(lists, n, k)[0]) < n / 10 and np.allclose(score, np.round(whole[docs], 6))


def test_an_index_can_be_asked_again(spark, tmp_path):
    table = spark.createDataFrame(list(enumerate(texts(80, 7))), "doc_id long, text string")
    index = postings.bm25_index(table, str(tmp_path / "index"))
    again = postings.Index(index.path, index.key, index.n_docs, index.shards)
    queries = spark.createDataFrame(QUERIES, "query_id long, query string")
    rows = [sorted(map(tuple, retrieval.bm25_topk(queries, table, 5, index=i).collect())) for i in (index, again)]
    assert rows[0] == rows[1] and rows[0]


def test_texts_are_split_once(spark, tmp_path):
    split = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def terms(text):
        split.add(1)
        return None if text is None else text.split()

    table = spark.createDataFrame(list(enumerate(texts(80, 7))), "doc_id long, text string")
    index = postings.write_index(table, str(tmp_path / "index"), terms("text"))
    assert split.value == index.n_docs == table.count()
    lengths = [len(t.split()) for t in texts(80, 7) if t is not None]
    assert index.mean_length(spark) == sum(lengths) / len(lengths)
