"""The pipeline's stages against brute force, on the smallest tables; the queries' names."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusmill.llm import toxicity
from corpusmill.llm.common import stored
from corpusmill.llm.queries import ORACLES, QUERIES
from test_near_duplicates import brute
from test_packing_tokens_mixing import brute_mix

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def test_stages_keep_the_columns_of_documents(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "mixing", "packing"]
    assert all(s.columns == COLUMNS for s in stages[:-1])


def test_toxicity_stage_drops_what_it_rejects(spark, stages):
    fitted, model = toxicity.trained(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r["row"].doc_id: r["score"] for r in toxicity.scored(stages[0], fitted, model).collect()}
    assert {r.doc_id for r in stages[1].collect()} == {i for i, s in scores.items() if s < 0.5}


def test_near_duplicate_stage(stages):
    docs = [(r.doc_id, r.text) for r in stages[1].collect()]
    _, root = brute(docs, 5)
    assert {r.doc_id for r in stages[2].collect()} == {i for i, r in root.items() if i == r}


def test_mixing_stage(stages):
    rows = [(r.doc_id, r.text, r.source) for r in stages[2].collect()]
    size, _, _, taken = brute_mix(rows)
    want = Counter({r[0]: taken[i] // size[i] for i, r in enumerate(rows) if size[i] and taken[i]})
    got = Counter(r.doc_id for r in stages[3].collect() if r.text.split())
    assert got == want


def test_packing_stage_packs_all(stages):
    packed, docs = stages[4], stages[3]
    assert packed.where("piece = 0").count() == docs.count()
    used = packed.groupBy("bin_id").agg(F.sum("piece_length").alias("n"), F.max("bin_size").alias("size")).where("n > size")
    assert used.count() == 0


def test_one_query_for_each_operator():
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 11)] == [1] * 10


@pytest.mark.parametrize("name", list(ORACLES))
def test_queries_with_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    own = QUERIES[name](spark, SF)
    want = con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(own.columns)
    assert sorted(map(tuple, own.select(*names).collect())) == sorted(want.fetchall())
