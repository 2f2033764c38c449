"""Laws and brute-force checks on small planted inputs."""

import random
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from corpusmill.functions import answers as A
from corpusmill.functions import text as T
from corpusmill.operators import chunking, evaluation, folders, ingest, qa, retrieval, scale, usage

rng = random.Random(5)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_block_windows_match_plain_ones(spark):
    """A hot key: two thirds of the rows, cut into blocks."""
    data = [(None if i % 50 == 0 else (1 if i % 3 else i % 7), i, rng.randint(0, 9)) for i in range(600)]
    df = spark.createDataFrame(data, "k int, i int, v int")
    got = scale.running_total(df, ["k"], [F.col("i")], F.floor(F.col("i") / 16), F.col("v"), "total")
    got = scale.positions(got, ["k"], [F.col("i")], F.floor(F.col("i") / 16), "pos")
    got = scale.previous_value(got, ["k"], [F.col("i")], F.floor(F.col("i") / 16), "v", "prev")
    pdf = pd.DataFrame(data, columns=["k", "i", "v"]).astype({"k": "Int64"})
    groups = pdf.groupby("k", dropna=False)
    want = {
        i: (t, p + 1, None if pd.isna(x) else int(x))
        for i, t, p, x in zip(pdf.i, groups.v.cumsum(), groups.cumcount(), groups.v.shift())
    }
    assert {r.i: (r.total, r.pos, r.prev) for r in got.collect()} == want


def test_char_windows_follow_the_loop(spark):
    texts = ["", " ", "abc", "x" * 10, "αβγ😀δ" * 40, "  lead and trail  " * 9, "a" * 101]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for size, overlap in [(10, 0), (10, 3), (10, 9), (7, 50), (100, 1), (3, 2)]:
        want = []
        for d, text in enumerate(texts):
            step, start, kept = size - min(overlap, size - 1), 0, []
            while start < len(text):
                kept.append(text[start:start + size].strip(" \t\n\r"))
                if start + size >= len(text):
                    break
                start += step
            want += [(d, i, c) for i, c in enumerate(c for c in kept if c)]
        assert rows(chunking.chunk_chars(df, size, overlap), "doc_id", "idx", "content") == sorted(want), (size, overlap)


def test_recursive_pieces_join_back_and_fit():
    for _ in range(200):
        text = "".join(rng.choice(["word", " ", "a", ". ", "\n", "\n\n", "longer ", "x. Y", "\t"]) for _ in range(rng.randint(0, 80)))
        for cap in (1, 3, 10):
            pieces = chunking.recursive_pieces(text, cap)
            assert "".join(pieces) == text
            assert all(len(p.split()) <= cap for p in pieces)


def test_hybrid_keeps_tables_whole(spark):
    text = "Intro line\n\nLast words\n| a | b |\n|---|---|\n| 1 | 2 |\nAfter one\nmore\n  | c |\n"
    df = spark.createDataFrame([(1, text), (2, "| only |\n"), (3, "no table"), (4, "")], "doc_id int, text string")
    out = {(r.doc_id, r.idx): (r.is_table, r.content) for r in chunking.chunk_hybrid(df, 50).collect()}
    assert out[1, 0] == (False, "Intro line\n\nLast words\n")
    assert out[1, 1] == (True, "Last words\n| a | b |\n|---|---|\n| 1 | 2 |\nAfter one")
    assert out[1, 2] == (False, "After one\nmore\n")
    assert out[1, 3] == (True, "more\n| c |")
    assert out[2, 0] == (True, "| only |") and out[3, 0] == (False, "no table") and (4, 0) not in out


def greedy(gold, pred, same):
    free, hits = list(pred), 0
    for g in gold:
        for p in free:
            if same(g, p):
                free.remove(p)
                hits += 1
                break
    return hits


def test_numbers_are_matched_one_to_one(spark):
    parts = ["$1", "1", "1.0005", "(2)", "-2", "3%", "3 percent", "8.1B", "8,100 million", "$8,100M", "none", "5k", "5,000"]
    pairs = [(i, " and ".join(rng.choices(parts, k=rng.randint(0, 4))), " and ".join(rng.choices(parts, k=rng.randint(0, 4)))) for i in range(150)]
    df = spark.createDataFrame(pairs, "i int, g string, p string")
    e = df.select("i", A.numeric_entities(F.col("g")).alias("g"), A.numeric_entities(F.col("p")).alias("p"))
    entities = {r.i: ([x.asDict() for x in r.g], [x.asDict() for x in r.p]) for r in e.collect()}
    got = {r.i: (r.m, r.e.f1, r.e.primary) for r in e.select("i", A.number_match(F.col("g"), F.col("p")).alias("m"), A.entity_prf(F.col("g"), F.col("p")).alias("e")).collect()}
    for i, g, p in pairs:
        ge, pe = entities[i]
        near = lambda a, b: abs(a["base"] - b["base"]) <= max(1e-9, abs(a["base"]) * 1e-3)
        same = lambda a, b: a["kind"] == b["kind"] and abs(a["normalized"] - b["normalized"]) <= max(1e-9, abs(a["normalized"]) * 0.01)
        match = True if not ge else bool(pe) and (greedy(ge, pe, near) == len(ge) or greedy(ge, pe, same) == len(ge))
        tp = greedy(ge, pe, same)
        f1 = 1.0 if not ge and not pe else 0.0 if not tp else 2 * tp / (len(ge) + len(pe))
        primary = not pe if not ge else any(same(ge[0], x) for x in pe)
        assert got[i][0] == match and abs(got[i][1] - f1) < 1e-9 and got[i][2] == primary, (g, p, got[i])


def test_numbers_of_a_text(spark):
    text = "Net (1,234.5) million, up 8% to $3B;" + " x" * 12 + " \u22127 bps." + " x" * 20 + " 12 shares"
    got = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(A.numeric_entities("t").alias("e")).collect()
    found = [(e.raw, text.replace("\u2212", "-")[e.start : e.stop], e.base, e.kind, e.normalized) for e in got[0].e]
    assert found == [
        ("(1,234.5)", "(1,234.5)", -1234.5, "percent", -1234.5), ("8", "8", 8.0, "percent", 8.0), ("$3", "$3", 3.0, "percent", 3.0),
        ("-7", "-7", -7.0, "bps", -7.0), ("12", "12", 12.0, "count", 12.0),
    ]
    assert got[1].e == [] and got[2].e == []


def test_bag_and_set_f1_differ(spark):
    df = spark.createDataFrame([("a a b", "a b b"), ("", ""), ("a", ""), ("x", "y")], "p string, g string")
    got = df.select(A.f1_bag("p", "g").alias("b"), A.f1_set("p", "g")["f1"].alias("s")).collect()
    assert [round(r.b, 4) for r in got] == [0.6667, 1.0, 0.0, 0.0]
    assert [round(r.s, 4) for r in got] == [1.0, 0.0, 0.0, 0.0]


def test_vector_grid_equals_broadcast(spark, monkeypatch):
    vecs = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(120)] + [(500, [1.0] * 8), (501, [1.0] * 8)]
    v = spark.createDataFrame(vecs, "doc_id long, vector array<float>")
    q = spark.createDataFrame(vecs[:30], "query_id long, vector array<float>")
    plain = rows(retrieval.vector_topk(q, v, 5), "query_id", "doc_id", "score", "rank")
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 25)
    assert rows(retrieval.vector_topk(q, v, 5), "query_id", "doc_id", "score", "rank") == plain
    assert len(plain) == 150


def test_ann_finds_most_neighbours(spark):
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(10)]
    vecs = [(i, [c + rng.gauss(0, 0.3) for c in centres[i % 10]]) for i in range(400)]
    v = spark.createDataFrame(vecs, "doc_id long, vector array<float>")
    q = spark.createDataFrame(vecs[:20], "query_id long, vector array<float>")
    exact, approx = retrieval.vector_topk(q, v, 10), retrieval.vector_ann(q, v, 10)
    assert retrieval.ann_recall(exact, approx).agg(F.avg("recall")).first()[0] > 0.8


def test_same_content_in_one_batch_goes_to_the_first(spark):
    batch = [(1, "a", "T", "x"), (2, "b", "T", "x"), (3, "a", "T", "z"), (4, "c", "T2", "old"), (5, "d", "T", "old"), (6, "e", "T", "e-old"), (7, "f", "T", "f")]
    corpus = [(10, "c", "T", "old", None), (11, "e", "T", "e-old", '{"state": "failed"}'), (12, "f", "T", "f-old", None)]
    b = spark.createDataFrame(batch, "arrival long, identity string, title string, content_hash string")
    c = spark.createDataFrame(corpus, "doc_id long, identity string, title string, content_hash string, status string")
    got = {r.arrival: (r.action, r.title_changed) for r in ingest.classify_changes(b, c).collect()}
    assert got == {
        1: ("new", False), 2: ("duplicate", False), 4: ("unchanged", True), 5: ("duplicate", False), 6: ("requeued", False), 7: ("changed", False),
    }
    assert {r.arrival: r.action for r in ingest.classify_changes(b, c, variant=True).collect()}[2] == "new"


def test_versions_debounce_expire_and_cap(spark):
    start = datetime(2024, 1, 1)
    minutes = [0, 10, 39, 69, 99, 500] + [1000 + 31 * i for i in range(25)]
    edits = [(1, n, start + timedelta(minutes=m), f"c{n}") for n, m in enumerate(minutes)]
    df = spark.createDataFrame(edits, "doc_id long, edit_id long, ts timestamp_ntz, content string")
    got = ingest.version_history(df, "2024-01-05 00:00:00").orderBy("version").collect()
    # 0, 10 and 39 are one version; exactly 30 minutes later starts the next.
    assert [r.version for r in got] == list(range(10, 30)) and got[-1].content == "c30"
    assert ingest.version_history(df, "2024-12-01 00:00:00").count() == 0
    first = ingest.version_history(df.where("edit_id < 5"), "2024-01-05 00:00:00").orderBy("version").collect()
    assert [(r.version, r.content, r.n_edits) for r in first] == [(1, "c2", 3), (2, "c3", 1), (3, "c4", 1)]


def test_deep_folder_chain(spark):
    tree = [(i, i - 1 if i > 1 else None, f"f{i}") for i in range(1, 9)] + [(100, None, "other:x")]
    df = spark.createDataFrame(tree, "folder_id long, parent_id long, name string")
    paths = dict(rows(folders.folder_paths(df), "folder_id", "path"))
    assert paths[8] == "/".join(f"f{i}" for i in range(1, 9)) and paths[100] == "other_x"
    depth = {r.folder_id: (r.depth, r.subtree_depth) for r in folders.depths(df).collect()}
    assert depth[8] == (8, 0) and depth[1] == (1, 7)
    moves = spark.createDataFrame([(2, 8), (8, 2), (3, 3), (1, 100)], "folder_id long, new_parent long")
    assert rows(folders.is_cycle(df, moves), "folder_id", "new_parent", "cycle") == [(1, 100, False), (2, 8, True), (3, 3, True), (8, 2, False)]


def test_containment_without_inner_words(spark):
    ev = [(1, "x" * 40), (2, "b" * 20 + " " + "c" * 20), (3, "the quick brown fox jumps over it all"), (4, "not anywhere to be found in the texts")]
    paras = [(7, "pre" + "x" * 50 + " post"), (8, "aa" + "b" * 20 + " " + "c" * 20 + "dd"), (9, "say THE quick  brown fox jumps over it allways"), (10, "unrelated")]
    got = evaluation.locate_evidence(
        spark.createDataFrame(ev, "qid long, evidence string"), spark.createDataFrame(paras, "para_id long, text string")
    )
    assert rows(got, "qid", "para_id") == [(1, 7), (2, 8), (3, 9), (4, -1)]


def test_ledger_refuses_and_releases(spark):
    events = [(1, 1, "reserve", 60, 0), (1, 2, "reserve", 50, 0), (1, 3, "settle", 60, 10), (1, 4, "reserve", 80, 0), (1, 5, "settle", 80, 90), (1, 6, "reserve", 1, 0)]
    df = spark.createDataFrame(events, "user_id long, seq long, kind string, reserve_micros long, actual_micros long")
    limits = spark.createDataFrame([(1, 100)], "user_id long, limit_micros long")
    got = [(r.allowed, r.status, r.used, r.reserved) for r in usage.credit_ledger(df, limits).orderBy("seq").collect()]
    assert got == [
        (True, "OK", 0, 60), (False, "BLOCKED", 0, 60), (True, "OK", 10, 0), (True, "WARNING", 10, 80), (True, "BLOCKED", 100, 0), (False, "BLOCKED", 100, 0),
    ]


def test_text_functions(spark):
    one = spark.createDataFrame([("see [citation:12] and【citation:doc-3】 x\n\n\n\n y", "https://www.a.b/c?d")], "t string, u string")
    r = one.select(T.strip_citations("t").alias("t"), T.url_host("u").alias("h")).first()
    assert (r.t, r.h) == ("see and x\n\ny", "a.b")
    assert T.glob_regex("*.md") == "(?s)^.*\\.md$" and T.glob_regex("a[!b]?") == "(?s)^a[^b].$"
    terms = spark.createDataFrame([("What was the net-income of file.docx in Q1, net-income_?",)], "q string")
    assert terms.select(T.query_terms("q")).first()[0] == ["net-income", "q1"]


def test_each_table_has_its_own_header(spark):
    text = "Text\n| Item | 2024 | 2025 |\n|---|---|---|\n| Net income | $10 | $20 |\nMore text\n| Item | Jan | Feb |\n|---|---|---|\n| Revenue | 5 | 6 |\n| Costs | 3 | 4 |"
    docs = spark.createDataFrame([(1, text)], "doc_id int, content string")
    asked = {(r.row, r.question.split("'")[1], r.question.split("'")[3]) for r in qa.qa_cells(docs, "it").collect()}
    assert asked == {(1, "Net income", "2024"), (1, "Net income", "2025"), (3, "Revenue", "Jan"), (3, "Revenue", "Feb"), (4, "Costs", "Jan"), (4, "Costs", "Feb")}
    ratios = [r.question for r in qa.qa_arithmetic(docs, "it").collect() if r.kind == "ratio"]
    assert len(ratios) == 1 and "'Revenue' to 'Costs'" in ratios[0]


def test_folders_of_any_depth_and_cycles(spark):
    rows = [(i, i - 1 if i > 1 else None, f"n{i}") for i in range(1, 41)] + [(100, 101, "a"), (101, 102, "b"), (102, 100, "c"), (200, 200, "self")]
    df = spark.createDataFrame(rows, "folder_id long, parent_id long, name string")
    got = {(r.folder_id, r.ancestor_id): r.distance for r in folders.ancestors(df).collect()}
    assert got == {(i, j): i - j for i in range(1, 41) for j in range(1, i + 1)} | {(a, b): (b - a) % 3 for a in (100, 101, 102) for b in (100, 101, 102)} | {(200, 200): 0}
    docs = spark.createDataFrame([(1, 40)], "doc_id long, folder_id long")
    assert {r.folder_id for r in folders.empty_folders(df, docs).collect()} == {100, 101, 102, 200}


def test_rerank_keeps_every_hit(spark):
    hits = spark.range(1500).select(F.lit(1).alias("query_id"), F.col("id").alias("doc_id"), (F.col("id") + 1).alias("rank"), F.lit(0.0).alias("score"))
    out = retrieval.rerank(hits, F.col("doc_id") * 1.0)
    assert out.count() == 1500 and out.where("rank = 1").head().doc_id == 1499


def test_checkpoint_folder_must_be_named_on_a_cluster(monkeypatch):
    import pytest

    from corpusmill.session import checkpoint_dir

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        checkpoint_dir(Session())
