"""Faults found in review: rounding, joins on few keys, chains of folders, memory of embedders."""

import pandas as pd
from pyspark.sql import functions as F

from corpusmill.operators import qa


def test_arithmetic_rounds_the_exact_value(spark):
    text = "Amounts in millions\n| Item | 2024 | 2025 |\n|---|---|---|\n| Net income | $150 | 1600.00 |\n| Net sales | 3 | 32 |\n"
    rows = qa.qa_arithmetic(spark.createDataFrame([(1, text)], "doc_id long, content string"), "the filing").where(F.col("kind") == "percent_change")
    # -90.625 lies between two answers: the even one is taken, as C's printf does.
    assert [r.answer for r in rows.orderBy("row").collect()] == ["%.2f%%" % -90.625, "%.2f%%" % -90.625] == ["-90.62%", "-90.62%"]


def test_upsert_broadcasts_what_is_known_of_partitions(spark, tmp_path, monkeypatch):
    from corpusmill.sources import corpus

    small, broadcast = [], F.broadcast
    monkeypatch.setattr(corpus.F, "broadcast", lambda df: small.append(df.columns) or broadcast(df))
    for at in (1, 2):
        rows = [(f"c{i}", 1, "s", f"text {at}", at) for i in range(at, 4)]
        corpus.write_chunks(spark.createDataFrame(rows, "chunk_id string, space_id int, strategy string, content string, indexed_at int"), str(tmp_path / "chunks"))
    assert sorted(r.content for r in spark.read.parquet(str(tmp_path / "chunks")).collect()) == ["text 1", "text 2", "text 2"]
    assert [c[:2] for c in small] == [["space_id", "strategy"]] * 3  # two names alone would bring a partition into one task


def test_breadcrumb_climbs_one_chain(spark, monkeypatch):
    from corpusmill.operators import folders

    tree = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 2, "c"), (4, 99, "d"), (5, 6, "e"), (6, 5, "f")], "folder_id long, parent_id long, name string")
    want = {i: sorted(map(tuple, folders.ancestors(tree).where(F.col("folder_id") == i).collect())) for i in (1, 3, 4, 5, 7)}
    monkeypatch.setattr(folders, "CLIMB", 1)
    assert sorted(map(tuple, folders.chain_of(tree, 3).collect())) == want[3]  # longer than the climb
    monkeypatch.setattr(folders, "CLIMB", 32)
    monkeypatch.setattr(folders, "ancestors", None)  # nobody else's ancestors are needed
    for i, rows in want.items():
        assert sorted(map(tuple, folders.chain_of(tree, i).collect())) == rows, i
    assert sorted(map(tuple, folders.breadcrumb(tree, 3).collect())) == [(1, "a", 0), (2, "b", 1), (3, "c", 2)]


def test_spans_look_for_numbers_only_where_the_text_is_missing(spark):
    from corpusmill.operators import evaluation

    rows = spark.createDataFrame([("It was $5m.", "$5"), ("It was $5m.", "5 million USD"), ("None", "x")], "evidence string, answer string")
    got = evaluation.align_spans(rows)
    assert [r.method for r in got.collect()] == ["exact", "numeric_entity", None]
    assert " AS _e#" not in got._jdf.queryExecution().analyzed().toString()  # a column of its own is computed for every row


def test_python_gets_few_texts_at_once(spark):
    from corpusmill import registry, session
    from corpusmill.operators import chunking
    from corpusmill.plans import source_queries

    @F.pandas_udf("array<double>")
    def seen(texts: pd.Series) -> pd.Series:
        return pd.Series([[float(len(texts))]] * len(texts))

    rows = spark.range(3000).coalesce(1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("some words of text"), "id").alias("text"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    sizes = session.made_in_small_batches(registry.embed(rows, {"m": seen}).select(F.col("vector")[0].alias("n")))
    assert sizes.agg(F.max("n")).first()[0] == session.TEXT_ROWS
    for made in (chunking.chunk_recursive(rows, 3), source_queries.hashed_embeddings(rows)):
        assert "ArrowEvalPython" not in made._jdf.queryExecution().toString()  # made already, in small batches
        assert made.select("doc_id").distinct().count() == 3000
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_summaries_score_each_pair_once_and_deal_pairs_out(spark, monkeypatch):
    from corpusmill.operators import evaluation

    rows = [(f"run{i % 3}", "g" if i % 2 else None, f"${i % 4} million", [f"{i % 4} million", None, "about 2"][i % 5 % 3], "late" if i % 7 == 0 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "run_id string, grp string, gold string, predicted string, error string")
    given, evaluate = [], evaluation.evaluate_answers
    monkeypatch.setattr(evaluation, "evaluate_answers", lambda d, *a: given.append(d) or evaluate(d, *a))
    monkeypatch.setattr(evaluation, "SCORED_ROWS", 25)
    counts = evaluation.scored_counts(df, ["run_id", "grp"])
    assert given[0].count() == len({r[2:4] for r in rows}) == 12 and counts.rdd.getNumPartitions() == 24
    plain, key = evaluate(df), lambda r: tuple(str(x) for x in r)
    for one in (evaluation.summarize_run, evaluation.summarize_groups):
        assert sorted(one(counts, times="times").collect(), key=key) == sorted(one(plain).collect(), key=key)
    failures = {r.run_id: r.f for r in evaluation.summarize_run(counts, F.sum("failures").alias("f"), times="times").collect()}
    assert failures == {f"run{k}": sum(r[4] is not None for r in rows if r[0] == f"run{k}") for k in range(3)}


def test_cells_are_found_within_the_row_of_their_text(spark):
    from corpusmill.operators import chunking, evaluation

    head, rule = "| Item | 2024 | 2025 |\n", "|---|---|---|\n"
    texts = ["", "no table", head + rule + "| net income | $5 | (7) |\n| income | 5 | income and net income | 9 |\n", head + rule + "| a | 1,000 | 2 |\n| | 5.0 | |\n"]
    tables = spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string")
    wanted = [(i, t) for i in (0, 2, 3, 3, 9) for t in ("income", "5", "-7", "9", "ITEM", "1000", "", "zzz", None)]
    targets = spark.createDataFrame(wanted, "doc_id long, target string")
    own, plain = evaluation.find_table_cells(tables, targets), evaluation.find_cells(chunking.markdown_cells(tables), targets)
    names, key = plain.columns, lambda r: tuple(str(x) for x in r)
    assert sorted(own.select(*names).collect(), key=key) == sorted(plain.collect(), key=key) and dict(own.dtypes) == dict(plain.dtypes)
    plan = own._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.index("Generate explode(_targets") < plan.index("Join ") and "RepartitionByExpression" in plan


def test_ingest_neither_shuffles_texts_nor_stores_them_again(spark, tmp_path, monkeypatch):
    from corpusmill.streaming import streams

    def shuffled() -> int:
        none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
        stages = spark._jsc.sc().statusStore().stageList(None, False, False, none, None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    def stored(part: str) -> int:
        return sum(f.stat().st_size for f in tmp_path.glob(f"table/*/part={part}/**/*.parquet"))

    path, corpus = str(tmp_path / "table"), streams.Corpus(spark, str(tmp_path / "table"), 2)
    for few in (1_000_000, 0):  # ids broadcast, and joined by shuffle
        monkeypatch.setattr(streams, "FEW_IDS", few, raising=False)
        at = 0 if few else 2
        text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(400)), lambda i: F.sha2(F.concat_ws(",", "id", i, F.lit(few)), 256)))
        docs = spark.range(40).select(
            (F.col("id") + 100 * at).alias("arrival"), F.lit(1).cast("long").alias("space_id"), F.lit("FILE").alias("doc_type"),
            F.format_string(f"u{at}-%d", "id").alias("unique_id"), F.lit("A").alias("title"), text.alias("content"),
        )
        streams.ingest_batch(docs, at, path, ["chunk_text"], buckets=2)
        moved = shuffled()
        streams.ingest_batch(docs.withColumns({"title": F.lit("B"), "arrival": F.col("arrival") + 100}), at + 1, path, ["chunk_text"], buckets=2)
        assert stored(f"b{at + 1:010d}") < stored(f"b{at:010d}") / 10  # a new title leaves the text alone
        if few:
            assert shuffled() - moved < 40 * 26_000 / 10
    got = corpus.documents()
    assert {(r.title, r.action, r.n) for r in got.withColumn("n", F.length("content")).collect()} == {("B", "retitled", 400 * 65 - 1)}
    assert got.count() == 80 == got.where(F.length("identity") == 64).select("identity", "content").distinct().count()
    corpus.compact()
    assert sorted(map(tuple, corpus.documents().select(*got.columns).collect())) == sorted(map(tuple, got.collect()))


def test_cells_are_asked_again_of_linked_vectors_only(spark, tmp_path):
    import numpy as np

    from corpusmill.llm import lattice

    def counting():
        keys = lattice.hasher(scale=0.2)  # large cells: nearly all vectors meet

        def counted(unit, label):
            with open(tmp_path / "hashed", "a") as f:
                f.write(f"{len(unit)}\n")
            return keys(unit, label)

        return counted

    x = np.random.default_rng(5).normal(size=(60, 16))
    x[41], x[57] = x[3] + 0.01, x[3] + 0.02
    rows = [(n, v.tolist(), 1) for n, v in enumerate(x)]
    got = lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), make_hasher=counting, block=16)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got.collect()} == {n: (2, 3) if n in (3, 41, 57) else (0, n) for n in range(60)}
    # Once each for its cells, then the linked three once in each of the tasks at most (8 partitions).
    assert sum(map(int, (tmp_path / "hashed").read_text().split())) <= 60 + 3 * 8
