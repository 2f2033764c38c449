"""Evaluation and experiment analytics (E)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import answers as A
from corpusmill.operators import chunking, evaluation, qa
from corpusmill.plans.catalog import add_view, built_view, query
from corpusmill.plans.chunk_queries import CELLS_SQL

CLEAN = r"trim(regexp_replace(regexp_replace(trim(predicted, ' ' || chr(10)), '(?i)(?:tool\s+[a-z0-9_\-]+\s+completed)+', ' ', 'g'), '\s+', ' ', 'g'))"
NORM = r"trim(regexp_replace(regexp_replace(lower(trim({c})), '[ \t\n\r]+', ' ', 'g'), '[^a-z0-9.%$\- ]+', '', 'g'))"
WORDS = r"list_filter(string_split({c}, ' '), lambda x: x <> '')"


@query("E1", f"""
WITH w AS (SELECT qid, list_distinct({WORDS.format(c='lower(predicted)')}) AS p, list_distinct({WORDS.format(c='lower(gold)')}) AS g FROM {{v_qa}}),
n AS (SELECT qid, len(list_intersect(p, g)) AS c, len(p) AS np, len(g) AS ng FROM w)
SELECT qid, CASE WHEN c = 0 THEN 0.0::DOUBLE ELSE round(2 * (c / np) * (c / ng) / (c / np + c / ng), 6) END AS f1, round(c / np, 6) AS precision, round(c / ng, 6) AS recall FROM n
""")
def set_f1(v_qa: DataFrame) -> DataFrame:
    m = v_qa.select("qid", A.f1_set("predicted", "gold").alias("m"))
    return m.select("qid", *[F.round(f"m.{c}", 6).alias(c) for c in ("f1", "precision", "recall")])


@query("E2", f"""
WITH t AS (SELECT qid, 'p' AS s, unnest({WORDS.format(c=NORM.format(c="predicted || ' ' || predicted || ' total'"))}) AS w FROM {{v_qa}}
  UNION ALL SELECT qid, 'g', unnest({WORDS.format(c=NORM.format(c="gold || ' ' || gold"))}) FROM {{v_qa}}),
k AS (SELECT qid, w, count(*) FILTER (s = 'p') AS p, count(*) FILTER (s = 'g') AS g FROM t GROUP BY 1, 2),
n AS (SELECT qid, CAST(sum(least(p, g)) AS DOUBLE) AS c, CAST(sum(p) AS DOUBLE) AS np, CAST(sum(g) AS DOUBLE) AS ng FROM k GROUP BY 1)
SELECT qid, CASE WHEN c = 0 THEN 0.0::DOUBLE ELSE round(2 * (c / np) * (c / ng) / (c / np + c / ng), 6) END AS f1 FROM n
""")
def bag_f1(v_qa: DataFrame) -> DataFrame:
    p, g = F.concat_ws(" ", "predicted", "predicted", F.lit("total")), F.concat_ws(" ", "gold", "gold")
    return v_qa.select("qid", F.round(A.f1_bag(p, g), 6).alias("f1"))


@query("E3", f"""
SELECT qid, trim(predicted) = trim(gold) AS strict, {NORM.format(c='predicted')} = {NORM.format(c='gold')} AS normalized,
  {NORM.format(c='gold')} <> '' AND contains({NORM.format(c='predicted')}, {NORM.format(c='gold')}) AS contains FROM {{v_qa}}
""")
def match_flags(v_qa: DataFrame) -> DataFrame:
    return v_qa.select("qid", A.match_flags("predicted", "gold").alias("m")).select("qid", "m.*")


@query("E4", """
WITH g AS (SELECT query_id, list(DISTINCT chunk_id) AS got, list(DISTINCT chunk_id) FILTER (rank <= 10) AS half FROM {v_hits} GROUP BY 1),
w AS (SELECT query_id, got, CASE WHEN query_id % 5 = 0 THEN [] ELSE list_concat(half, [-1, -2]) END AS want FROM g)
SELECT query_id, CASE WHEN len(want) = 0 THEN 1.0::DOUBLE ELSE round(len(list_intersect(got, want)) / len(want), 6) END AS recall FROM w
""")
def chunk_recall(v_hits: DataFrame) -> DataFrame:
    g = v_hits.groupBy("query_id").agg(
        F.collect_list("chunk_id").alias("got"), F.collect_list(F.when(F.col("rank") <= 10, F.col("chunk_id"))).alias("half")
    )
    extra = F.array(F.lit(-1).cast("bigint"), F.lit(-2).cast("bigint"))
    want = F.when(F.col("query_id") % 5 == 0, F.array().cast("array<bigint>")).otherwise(F.concat("half", extra))
    return g.select("query_id", F.round(A.chunk_recall("got", want), 6).alias("recall"))


NUM_SQL = r"\(?[-+]?[$€£¥]?\d{1,3}(?:,\d{3})*(?:\.\d+)?\)?|[-+]?[$€£¥]?\d+(?:\.\d+)?"


def entities_sql(src: str) -> str:
    """Entities of (qid, side, txt) rows: qid, side, n, raw, start, stop, base, kind, scale, normalized."""
    return rf"""
SELECT qid, side, n, raw, start, stop, base, kind, scale, base * scale AS normalized FROM (SELECT *, CASE WHEN kind IN ('percent', 'bps') THEN 1.0::DOUBLE
    WHEN contains(win, 'billion') OR regexp_matches(win, '[0-9]b\b') THEN 1e9::DOUBLE WHEN contains(win, 'million') OR regexp_matches(win, '[0-9]m\b') THEN 1e6::DOUBLE
    WHEN contains(win, 'thousand') OR regexp_matches(win, '[0-9]k\b') THEN 1e3::DOUBLE ELSE 1.0::DOUBLE END AS scale
  FROM (SELECT *, CASE WHEN contains(win, '%') OR contains(win, 'percent') THEN 'percent' WHEN contains(win, 'bps') OR contains(win, 'basis points') THEN 'bps'
      WHEN contains(win, '$') OR contains(win, 'usd') OR contains(win, 'dollar') THEN 'currency' ELSE 'count' END AS kind
    FROM (SELECT qid, side, n, raw, start, start + length(raw) AS stop, lower(substr(txt, greatest(start - 20, 0) + 1, start + length(raw) + 20 - greatest(start - 20, 0))) AS win,
        CAST(regexp_replace(trim(raw, '()'), '[$€£¥,]', '', 'g') AS DOUBLE) * CASE WHEN raw LIKE '(%)' THEN -1 ELSE 1 END AS base
      FROM (SELECT qid, side, n, txt, split_part(seg, chr(2), 1) AS raw, CAST(coalesce(sum(length(replace(seg, chr(2), ''))) OVER (PARTITION BY qid, side ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
        FROM (SELECT qid, side, txt, unnest(segs) AS seg, generate_subscripts(segs, 1) AS n FROM (SELECT qid, side, txt, string_split(regexp_replace(txt, '({NUM_SQL})', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS segs FROM ({src}))))
      WHERE n > 1)))"""


SIDES = f"SELECT qid, 'g' AS side, gold AS txt FROM {{v_qa}} UNION ALL SELECT qid, 'p', {CLEAN} FROM {{v_qa}}"


@query("E5", f"SELECT qid, raw, start, stop, base, kind, scale FROM ({entities_sql(SIDES)}) WHERE side = 'p'")
def numeric_entities(v_qa: DataFrame) -> DataFrame:
    e = v_qa.select("qid", F.explode(A.numeric_entities(A.clean_answer("predicted"))).alias("e")).select("qid", "e.*")
    return e.drop("normalized")


@query("E5", f"""
SELECT qid AS doc_id, raw, start, stop, base, kind, scale FROM ({entities_sql("SELECT doc_id AS qid, 'd' AS side, text AS txt FROM {documents}")})
""")
def document_numbers(documents: DataFrame) -> DataFrame:
    e = documents.select("doc_id", F.explode(A.numeric_entities(F.col("text"))).alias("e"))
    return e.select("doc_id", "e.*").drop("normalized")


def greedy_sql(name: str, col: str, same: str) -> str:
    """Recursive one-to-one matching: each gold item takes the first free predicted one."""
    return f"""
{name}_l AS (SELECT q.qid, coalesce(list({col} ORDER BY n) FILTER (side = 'g'), []) AS g, coalesce(list({col} ORDER BY n) FILTER (side = 'p'), []) AS p FROM {{v_qa}} q LEFT JOIN ent USING (qid) GROUP BY 1),
{name}_r(qid, g, i, free, hits) AS (SELECT qid, g, 0, p, 0 FROM {name}_l UNION ALL
  SELECT qid, g, i + 1, CASE WHEN hit > 0 THEN list_concat(free[1:hit - 1], free[hit + 1:]) ELSE free END, hits + CASE WHEN hit > 0 THEN 1 ELSE 0 END
  FROM (SELECT *, coalesce(list_position(list_transform(free, lambda p: {same}), TRUE), 0) AS hit FROM {name}_r WHERE i < len(g))),
{name} AS (SELECT qid, g, hits FROM {name}_r WHERE i = len(g))"""


UNITS_SQL = "list_filter(['billion', 'million', 'thousand', 'percent', '%', 'basis points', 'bps', 'shares', 'years', 'months', 'days', '$'], lambda u: contains(lower({c}), u))"


def units_sql(c: str) -> str:
    short = [f"CASE WHEN regexp_matches(lower({c}), '[0-9]{w[0]}\\b') THEN ['{w}'] ELSE [] END" for w in ("billion", "million", "thousand")]
    return f"list_distinct(list_concat({UNITS_SQL.format(c=c)}, {', '.join(short)}))"


UNIT_MATCH = f"""CASE WHEN len(list_intersect(gu, ['billion', 'million', 'thousand'])) > 0 AND len(list_intersect(pu, ['billion', 'million', 'thousand'])) > 0
  THEN len(list_filter(gu, lambda u: u NOT IN ('billion', 'million', 'thousand') AND NOT list_contains(pu, u))) = 0 ELSE len(list_filter(gu, lambda u: NOT list_contains(pu, u))) = 0 END"""
UNIT_ROWS = f"""(SELECT qid, gu, CASE WHEN list_contains(gu, '$') AND (contains(pl, 'usd') OR contains(pl, 'dollar') OR contains(pl, 'billion') OR contains(pl, 'million') OR contains(pl, 'thousand')) THEN list_concat(pu, ['$']) ELSE pu END AS pu
  FROM (SELECT qid, {units_sql('gold')} AS gu, {units_sql('answer')} AS pu, lower(answer) AS pl FROM (SELECT qid, gold, {CLEAN} AS answer FROM {{v_qa}})))"""


@query("E7", f"SELECT qid, {UNIT_MATCH} AS unit_match, array_to_string(list_sort(gu), ',') AS gold_units FROM {UNIT_ROWS}")
def unit_matches(v_qa: DataFrame) -> DataFrame:
    return v_qa.select(
        "qid", A.unit_match(A.clean_answer("predicted"), "gold").alias("unit_match"), F.array_join(F.array_sort(A.units_of("gold")), ",").alias("gold_units")
    )


EXPECTED = "CASE WHEN regexp_matches(lower({c}), 'percent|rate|bps|basis points|%') THEN 'rate' WHEN contains(lower({c}), 'ratio') THEN 'ratio' WHEN regexp_matches(lower({c}), 'increase|decrease|difference|change') THEN 'delta' WHEN regexp_matches(lower({c}), 'date|as of|when') THEN 'date' ELSE 'amount' END"
MONTH_RE = "|".join(A.MONTHS)
PREDICTED = rf"CASE WHEN regexp_matches(lower({{c}}), '\$|usd|billion|million|thousand') THEN 'amount' WHEN regexp_matches(lower({{c}}), 'percent|%|bps|basis points') THEN 'rate' WHEN regexp_matches(lower({{c}}), '\b\d+(?:\.\d+)?\s*[:/]\s*\d+(?:\.\d+)?\b') THEN 'ratio' WHEN regexp_matches(lower({{c}}), '\b\d{{{{4}}}}\b') AND regexp_matches(lower({{c}}), '{MONTH_RE}') THEN 'date' WHEN regexp_matches(lower({{c}}), 'increase|decrease|difference|change') THEN 'delta' ELSE 'amount' END"
PREDICTED = PREDICTED.replace("{{4}}", "{4}")


def predicted_sql(c: str) -> str:
    return PREDICTED.replace("{c}", c)


@query("E9", f"SELECT qid, {EXPECTED.format(c='question')} AS expected, {predicted_sql('predicted')} AS predicted_kind FROM {{v_qa}}")
def answer_types(v_qa: DataFrame) -> DataFrame:
    return v_qa.select("qid", A.expected_type("question").alias("expected"), A.predicted_type("predicted").alias("predicted_kind"))


NOISY = " OR ".join(f"contains(lower(answer), '{p}')" for p in A.NOISE)
SCORED = f"""
WITH RECURSIVE ent AS ({entities_sql(SIDES)}),
{greedy_sql("raw", "base", "abs(g[i + 1] - p) <= greatest(1e-9, abs(g[i + 1]) * 1e-3)")},
{greedy_sql("sc", "{'k': kind, 'v': normalized}", "g[i + 1].k = p.k AND abs(g[i + 1].v - p.v) <= greatest(1e-9, abs(g[i + 1].v) * 0.01)")},
prim AS (SELECT qid, bool_or(g1.kind = p.kind AND abs(g1.normalized - p.normalized) <= greatest(1e-9, abs(g1.normalized) * 0.01)) AS ok
   FROM (SELECT * FROM ent WHERE side = 'g' QUALIFY row_number() OVER (PARTITION BY qid ORDER BY n) = 1) g1 JOIN (SELECT * FROM ent WHERE side = 'p') p USING (qid) GROUP BY 1),
pc AS (SELECT qid, count(*) AS np FROM ent WHERE side = 'p' GROUP BY 1),
u AS (SELECT qid, {UNIT_MATCH} AS unit_match FROM {UNIT_ROWS}),
tok AS (SELECT qid, 'p' AS s, unnest({WORDS.format(c=NORM.format(c=CLEAN))}) AS w FROM {{v_qa}} UNION ALL SELECT qid, 'g', unnest({WORDS.format(c=NORM.format(c='gold'))}) FROM {{v_qa}}),
bag AS (SELECT qid, CASE WHEN c = 0 THEN 0.0::DOUBLE ELSE round(2 * (c / np) * (c / ng) / (c / np + c / ng), 6) END AS token_f1 FROM (
   SELECT qid, CAST(sum(least(p, g)) AS DOUBLE) AS c, CAST(sum(p) AS DOUBLE) AS np, CAST(sum(g) AS DOUBLE) AS ng FROM (SELECT qid, w, count(*) FILTER (s = 'p') AS p, count(*) FILTER (s = 'g') AS g FROM tok GROUP BY 1, 2) GROUP BY 1)),
a AS (SELECT q.*, {CLEAN} AS answer FROM {{v_qa}} q),
b AS (SELECT a.*, answer <> '' AND NOT ({NOISY}) AS answer_clean, {EXPECTED.format(c='gold')} AS want, {predicted_sql('answer')} AS have,
  len(raw.g) AS ng, coalesce(np, 0) AS np, raw.hits AS rh, sc.hits AS sh, u.unit_match, token_f1, coalesce(prim.ok, FALSE) AS po,
  {NORM.format(c='gold')} AS gn, {NORM.format(c='answer')} AS pn
  FROM a JOIN raw USING (qid) JOIN sc USING (qid) LEFT JOIN prim USING (qid) LEFT JOIN pc USING (qid) JOIN u USING (qid) JOIN bag USING (qid)),
c AS (SELECT *, want = have OR (want = 'delta' AND have IN ('amount', 'delta')) AS intent_ok, ng = 0 OR (np > 0 AND (rh = ng OR sh = ng)) AS number_match,
  CASE WHEN ng = 0 AND np = 0 THEN 1.0::DOUBLE WHEN ng = 0 OR np = 0 THEN 0.0::DOUBLE ELSE sh / np END AS pr, CASE WHEN ng = 0 AND np = 0 THEN 1.0::DOUBLE WHEN ng = 0 OR np = 0 THEN 0.0::DOUBLE ELSE sh / ng END AS re,
  CASE WHEN ng = 0 AND np = 0 THEN TRUE WHEN ng = 0 OR np = 0 THEN FALSE ELSE po END AS primary_value_match FROM b),
d AS (SELECT *, round(CASE WHEN pr + re = 0 THEN 0.0::DOUBLE ELSE 2 * pr * re / (pr + re) END, 6) AS numeric_f1 FROM c)
SELECT qid, run_id, grp, gold, predicted, question, latency_ms, cost_micros, error, answer, answer_clean, intent_ok, number_match, unit_match, token_f1, trim(gold) = answer AS strict_exact,
  gn = pn AS normalized_exact, gn <> '' AND contains(pn, gn) AS contains_gold, round(pr, 6) AS numeric_precision, round(re, 6) AS numeric_recall, numeric_f1, primary_value_match,
  answer_clean AND intent_ok AND unit_match AND number_match AND (gn = pn OR (gn <> '' AND contains(pn, gn))) AS strict_correct,
  answer_clean AND intent_ok AND unit_match AND (primary_value_match OR numeric_f1 >= 0.5) AS overall_correct FROM d
"""


@built_view(SCORED)
def v_scored(v_qa: DataFrame) -> DataFrame:
    return evaluation.evaluate_answers(v_qa)


@query("E6 E8", "SELECT qid, number_match, numeric_precision, numeric_recall, numeric_f1, primary_value_match FROM {v_scored}")
def number_matches(v_scored: DataFrame) -> DataFrame:
    return v_scored.select("qid", "number_match", "numeric_precision", "numeric_recall", "numeric_f1", "primary_value_match")


@query("E6", f"""
WITH ent AS ({entities_sql(SIDES)})
SELECT q.qid, coalesce(bool_or(abs(g.base - p.base) <= greatest(1e-9, abs(g.base) * 0.01)), FALSE) AS any_match
FROM {{v_qa}} q LEFT JOIN (SELECT * FROM ent WHERE side = 'g') g ON g.qid = q.qid LEFT JOIN (SELECT * FROM ent WHERE side = 'p') p ON p.qid = q.qid GROUP BY 1
""")
def any_number_matches(v_qa: DataFrame) -> DataFrame:
    pred = A.numeric_entities(A.clean_answer("predicted"))
    rows = v_qa.select("qid", A.numeric_entities(F.col("gold")).alias("g"), pred.alias("p"))
    return rows.select("qid", A.any_number_match(F.col("g"), F.col("p")).alias("any_match"))


VERDICT = ["qid", "answer", "answer_clean", "intent_ok", "strict_exact", "normalized_exact", "contains_gold", "number_match", "unit_match", "token_f1", "strict_correct", "overall_correct"]


@query("E10", f"SELECT {', '.join(VERDICT)} FROM {{v_scored}}")
def answer_verdicts(v_scored: DataFrame) -> DataFrame:
    return v_scored.select(*VERDICT)


SUMMARY_SQL = ", ".join(
    ["count(*) AS n"] + [f"count(*) FILTER ({f}) AS {f}_count, round(count(*) FILTER ({f}) / count(*), 6) AS {f}_rate" for f in evaluation.SUMMARY_FLAGS] + ["round(avg(token_f1), 6) AS mean_token_f1"]
)


@query("E11", f"SELECT run_id, {SUMMARY_SQL} FROM {{v_scored}} GROUP BY 1")
def run_summary(v_qa: DataFrame) -> DataFrame:
    return evaluation.summarize_run(evaluation.scored_counts(v_qa, ["run_id"]), times="times")


@query("E12", f"""
SELECT CASE WHEN grouping(run_id) = 1 THEN '(all)' ELSE run_id END AS run_id, CASE WHEN grouping(grp) = 1 THEN '(all)' ELSE grp END AS grp, {SUMMARY_SQL} FROM {{v_scored}} GROUP BY ROLLUP (run_id, grp)
""")
def group_summary(v_qa: DataFrame) -> DataFrame:
    return evaluation.summarize_groups(evaluation.scored_counts(v_qa, ["run_id", "grp"]), times="times")


@query("E13", """
WITH o AS (SELECT run_id, latency_ms, cost_micros, row_number() OVER (PARTITION BY run_id ORDER BY latency_ms) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n FROM {v_qa} WHERE error IS NULL),
g AS (SELECT run_id, any_value(n) AS n_ok, round(avg(latency_ms), 6) AS avg_latency, min(latency_ms) FILTER (i = floor(n * 0.5::DOUBLE)) AS p50_latency, min(latency_ms) FILTER (i = floor(n * 0.95::DOUBLE)) AS p95_latency,
  min(latency_ms) FILTER (i = floor(n * 0.99::DOUBLE)) AS p99_latency, CAST(sum(cost_micros) AS DOUBLE) AS total FROM o GROUP BY 1),
e AS (SELECT run_id, count(*) AS n_all FROM {v_qa} GROUP BY 1)
SELECT run_id, n_ok, avg_latency, p50_latency, p95_latency, p99_latency, round(total, 6) AS total_cost, round(total / n_ok, 6) AS cost_per_query, round(total / n_ok * 1000, 4) AS cost_per_1k,
  round((n_all - n_ok) / n_all * 100, 6) AS error_rate_pct FROM g JOIN e USING (run_id)
""")
def latency_and_cost(v_qa: DataFrame) -> DataFrame:
    return evaluation.latency_cost(v_qa.withColumn("cost", F.col("cost_micros").cast("double")), cost="cost")


@query("E14", """
WITH s AS (SELECT run_id, unnest(['retrieval', 'rerank', 'answer']) AS component, unnest([latency_ms * 0.25, CASE WHEN qid % 3 = 0 THEN latency_ms * 0.5 END, latency_ms]) AS ms FROM {v_qa} WHERE error IS NULL),
n AS (SELECT run_id, count(*) AS n FROM {v_qa} WHERE error IS NULL GROUP BY 1)
SELECT run_id, component, round(sum(ms) / any_value(n), 6) AS avg_ms FROM s JOIN n USING (run_id) WHERE ms IS NOT NULL GROUP BY 1, 2
""")
def component_latency(v_qa: DataFrame) -> DataFrame:
    ms = F.col("latency_ms")
    base = F.create_map(F.lit("retrieval"), ms * 0.25, F.lit("answer"), ms)
    parts = F.when(F.col("qid") % 3 == 0, F.map_concat(base, F.create_map(F.lit("rerank"), ms * 0.5))).otherwise(base)
    return evaluation.component_breakdown(v_qa.withColumn("component_ms", parts))


@query("E15", """
WITH r AS (SELECT run_id, count(*) FILTER (overall_correct) / count(*) AS o, count(*) FILTER (number_match) / count(*) AS m, avg(token_f1) AS f, count(*) FILTER (error IS NOT NULL) AS failures FROM {v_scored} GROUP BY 1),
s AS (SELECT run_id, failures, round(CASE WHEN run_id = 'run5' THEN -1.0::DOUBLE ELSE 0.60::DOUBLE * round(o, 6) + 0.30::DOUBLE * round(m, 6) + 0.10::DOUBLE * round(f, 6) - 0.01::DOUBLE * failures END, 6) AS score FROM r)
SELECT run_id, failures, score, rank() OVER (ORDER BY score DESC) AS rank, rank() OVER (ORDER BY score DESC) = 1 AND score > -1 AS recommended FROM s
""")
def leaderboard(v_qa: DataFrame) -> DataFrame:
    runs = evaluation.summarize_run(evaluation.scored_counts(v_qa, ["run_id"]), F.sum("failures").alias("failures"), times="times")
    board = evaluation.leaderboard(runs.withColumn("failed", F.col("run_id") == "run5"))
    return board.select("run_id", "failures", "score", "rank", "recommended")


GRID_VALUES = {k: ", ".join(f"'{v}'" for v in vs) for k, vs in evaluation.FULL_GRID.items()}


@query("E16", f"""
SELECT item_id, r || '_' || d || '_' || k || '_' || t || '_' || c || '_' || m AS config FROM {{benchmark}}, {', '.join(f"(SELECT unnest([{v}]) AS {k[0] if k != 'dates' else 'd'}) AS g{i}" for i, (k, v) in enumerate(GRID_VALUES.items()))}
""")
def grid_of_questions(benchmark: DataFrame) -> DataFrame:
    return evaluation.config_grid(evaluation.FULL_GRID, benchmark.select("item_id")).select("item_id", "config")


add_view("v_pipeline_docs", """
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Filing__docling__hybrid__m' || CAST(doc_id % 3 AS STRING) || '__256__' || CAST(doc_id AS STRING)
         WHEN 1 THEN 'Other__mineru__recursive__m' || CAST(doc_id % 3 AS STRING) || '__512__x' WHEN 2 THEN 'Filing docling sandwich (m' || CAST(doc_id % 3 AS STRING) || ') 1024' ELSE title END AS title,
       CASE WHEN doc_id % 4 = 0 THEN 'DOCLING' ELSE '' END AS etl, CASE WHEN doc_id % 7 = 0 THEN 'Docling' ELSE '' END AS s_etl,
       CASE WHEN doc_id % 7 = 0 THEN 'text' ELSE NULL END AS s_strategy, CASE WHEN doc_id % 14 = 0 THEN '256' ELSE '' END AS s_size, 'm' || CAST(doc_id % 3 AS STRING) AS s_model FROM {v_docs}
""")
add_view("v_candidates", """
SELECT l_suppkey % 48 AS cand_id, min(CASE l_suppkey % 2 WHEN 0 THEN 'docling' ELSE 'mineru' END) AS etl, min(CASE floor(l_suppkey / 2) % 4 WHEN 0 THEN 'hybrid' WHEN 1 THEN 'recursive' WHEN 2 THEN 'sandwich' ELSE 'text' END) AS strategy,
       min('m' || CAST(CAST(floor(l_suppkey / 8) AS BIGINT) % 2 AS STRING)) AS model, min(CASE CAST(floor(l_suppkey / 16) AS BIGINT) % 3 WHEN 0 THEN '256' WHEN 1 THEN '512' ELSE '1024' END) AS size FROM {lineitem} GROUP BY 1
""")


@query("E17", r"""
WITH p AS (SELECT c.cand_id, d.doc_id, lower(d.title) AS t, regexp_replace(lower(d.title), '[^\p{L}\p{N}]', '', 'g') AS ct, c.*, d.s_strategy,
    d.s_strategy IS NOT NULL AND (d.s_etl = '' OR upper(c.etl) = upper(d.s_etl)) AND (d.s_strategy = c.strategy) AND (d.s_size = '' OR d.s_size = c.size) AND d.s_model = c.model AS signed, lower(d.etl) AS ce
  FROM {v_candidates} c CROSS JOIN {v_pipeline_docs} d),
k AS (SELECT cand_id, doc_id, CASE WHEN signed OR contains(t, 'filing__' || etl || '__' || strategy || '__' || model || '__' || size) THEN 3 WHEN contains(t, etl || '__' || strategy || '__' || model || '__' || size) THEN 2
    WHEN (contains(ct, etl) OR ce = etl) AND contains(ct, strategy) AND contains(ct, model) AND contains(ct, size) THEN 1 ELSE 0 END AS tier, CASE WHEN contains(ct, 'filing') THEN 2 ELSE 0 END AS s FROM p)
SELECT cand_id, tier, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY tier DESC, CASE WHEN tier = 1 THEN s ELSE 0 END DESC, doc_id DESC) AS rn FROM k WHERE tier > 0) WHERE rn = 1
""")
def matched_candidates(v_candidates: DataFrame, v_pipeline_docs: DataFrame) -> DataFrame:
    signature = F.struct(F.col("s_etl").alias("etl"), F.col("s_strategy").alias("strategy"), F.col("s_size").alias("size"), F.array("s_model").alias("models"))
    docs = v_pipeline_docs.withColumn("signatures", F.when(F.col("s_strategy").isNotNull(), F.array(signature)))
    return evaluation.match_candidates(v_candidates, docs, "Filing").withColumn("tier", F.col("tier").cast("int"))


# Five runs over every question: b repeats a, d is partial.
add_view("v_runs", """
SELECT 'a' AS run_id, qid, qid % 3 = 0 AS number_match FROM {v_qa} UNION ALL SELECT 'b', qid, qid % 3 = 0 FROM {v_qa} UNION ALL SELECT 'c', qid, qid % 4 = 1 FROM {v_qa}
UNION ALL SELECT 'd', qid, CASE WHEN qid % 100 = 0 THEN NULL ELSE TRUE END FROM {v_qa} UNION ALL SELECT 'e', qid, latency_ms > 1000 FROM {v_qa}
""")


@query("E18", """
SELECT qid, bool_or(number_match) FILTER (run_id = 'a') :: VARCHAR AS a, bool_or(number_match) FILTER (run_id = 'c') :: VARCHAR AS c, bool_or(number_match) FILTER (run_id = 'e') :: VARCHAR AS e FROM {v_runs} GROUP BY 1
""")
def run_matrix(v_runs: DataFrame) -> DataFrame:
    return evaluation.run_matrix(v_runs, ["a", "c", "e"])


@query("E18", """
WITH v AS (SELECT run_id, count(number_match) AS covered, string_agg(CAST(number_match AS VARCHAR), ',' ORDER BY qid) AS v FROM {v_runs} GROUP BY 1),
k AS (SELECT *, covered = (SELECT count(DISTINCT qid) FROM {v_runs}) AS complete FROM v)
SELECT run_id, covered, complete, CASE WHEN complete THEN min(run_id) OVER (PARTITION BY complete, v) END AS same_as, complete AND min(run_id) OVER (PARTITION BY complete, v) = run_id AS included FROM k
""")
def run_coverage(v_runs: DataFrame) -> DataFrame:
    return evaluation.distinct_runs(v_runs)


@query("E19", f"""
WITH n AS (SELECT qid, gold AS predicted FROM {{v_qa}} WHERE error IS NOT NULL), o AS (SELECT qid, predicted FROM {{v_qa}})
SELECT b.qid, row_number() OVER (ORDER BY b.qid) AS position, coalesce(n.predicted, o.predicted) AS predicted FROM o b JOIN o USING (qid) LEFT JOIN n ON n.qid = b.qid
""")
def merged_retries(v_qa: DataFrame) -> DataFrame:
    new = v_qa.where("error IS NOT NULL").select("qid", F.col("gold").alias("predicted"))
    bench = v_qa.select("qid", (F.col("qid") + 1).alias("position"))
    return evaluation.merge_retries(v_qa.select("qid", "predicted"), new, bench)


INTERMEDIATE = " OR ".join("contains(lower({c}), '" + p.replace("'", "''") + "')" for p in A.INTERMEDIATE)


@query("E19", rf"""
WITH a AS (SELECT qid, predicted, gold, {CLEAN} AS p FROM {{v_qa}}),
s AS (SELECT *, [CASE WHEN {" OR ".join(f"contains(lower(p), '{x}')" for x in A.NOISE)} THEN 0 ELSE 1 END, CASE WHEN {INTERMEDIATE.replace("{c}", "p")} THEN 0 ELSE 1 END, CASE WHEN regexp_matches(p, '\d') THEN 1 ELSE 0 END, greatest(0, 1000 - length(p))] AS sp,
  [1, 1, 1, greatest(0, 1000 - length(gold))] AS sg FROM a)
SELECT qid, CASE WHEN sg > sp THEN gold ELSE predicted END AS best FROM s
""")
def better_answers(v_qa: DataFrame) -> DataFrame:
    return v_qa.select("qid", evaluation.better_answer(v_qa, "predicted", "gold").alias("best"))


add_view("v_evidence", """
SELECT o_orderkey AS qid, 'Total  price was $' || amt || ' for order ' || CAST(o_orderkey AS STRING) || ' in 1,250 parts.' AS evidence,
       CASE o_orderkey % 5 WHEN 0 THEN '$' || amt WHEN 1 THEN 'USD ' || amt WHEN 2 THEN 'total PRICE was' WHEN 3 THEN '1250 parts' ELSE 'unknown' END AS answer,
       CASE o_orderkey % 6 WHEN 0 THEN -1 WHEN 1 THEN 0 ELSE 17 END AS start, CASE o_orderkey % 7 WHEN 0 THEN 900 WHEN 1 THEN 30 ELSE 17 + length(amt) + 1 END AS stop,
       CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_orderkey % 40 END AS page_number
FROM (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS STRING) AS amt FROM {orders}) o
""")


def support_sql(a: str, e: str) -> str:
    n = r"trim(lower(regexp_replace({c}, '[ \t\r\n\f\v]+', ' ', 'g')))"
    nums = r"list_transform(regexp_extract_all({c}, '[-+]?\d[\d,]*(?:\.\d+)?'), lambda x: replace(x, ',', ''))"
    na, ne, la, le = n.format(c=a), n.format(c=e), nums.format(c=a), nums.format(c=e)
    return f"CASE WHEN {na} <> '' AND contains({ne}, {na}) THEN 'exact' WHEN len({la}) > 0 AND len(list_filter({la}, lambda y: NOT list_contains({le}, y))) = 0 THEN 'numeric' ELSE 'none' END"


CHECKED = f"""SELECT *, {support_sql('answer', 'evidence')} AS support_text, {support_sql('answer', 'span')} AS support_span FROM (
  SELECT *, CASE WHEN ok THEN substr(evidence, CAST(start + 1 AS BIGINT), CAST(stop - start AS BIGINT)) ELSE '' END AS span FROM (SELECT *, start >= 0 AND stop >= start AND stop <= length(evidence) AS ok FROM {{v_evidence}}))"""


@query("E20", f"SELECT qid, support_text, support_span FROM ({CHECKED})")
def evidence_support(v_evidence: DataFrame) -> DataFrame:
    return evaluation.evidence_support(v_evidence).select("qid", "support_text", "support_span")


@query("E22", f"""
SELECT issue, count(*) AS n FROM (SELECT unnest([CASE WHEN NOT ok THEN 'invalid_offsets' END, CASE WHEN support_text = 'none' THEN 'answer_not_supported_by_evidence_text' END,
  CASE WHEN support_span = 'none' THEN 'answer_not_supported_by_offset_span' END, CASE WHEN page_number IS NULL THEN 'missing_page_number' END]) AS issue FROM ({CHECKED})) WHERE issue IS NOT NULL GROUP BY 1
""")
def evidence_issue_counts(v_evidence: DataFrame) -> DataFrame:
    return evaluation.issue_counts(evaluation.evidence_issues(v_evidence))


@query("E22", f"""
SELECT qid, ok AS offsets_valid, concat_ws(',', CASE WHEN NOT ok THEN 'invalid_offsets' END, CASE WHEN support_text = 'none' THEN 'answer_not_supported_by_evidence_text' END,
  CASE WHEN support_span = 'none' THEN 'answer_not_supported_by_offset_span' END, CASE WHEN page_number IS NULL THEN 'missing_page_number' END) AS issues FROM ({CHECKED})
""")
def evidence_issue_lists(v_evidence: DataFrame) -> DataFrame:
    rows = evaluation.evidence_issues(v_evidence)
    return rows.select("qid", "offsets_valid", F.array_join("issues", ",").alias("issues"))


# Passages, whole texts, and whole texts with other case and wider spaces.
add_view("v_passages", """
SELECT item_id AS qid, text AS evidence FROM {benchmark} UNION ALL SELECT 1000000 + doc_id, text FROM {documents}
UNION ALL SELECT 2000000 + doc_id, ' ' || replace(replace(text, 'the', 'THE'), ' ', '  ') FROM {documents}
""")


@query("E21", r"""
WITH e AS (SELECT qid, evidence, trim(lower(regexp_replace(evidence, '[ \t\r\n\f\v]+', ' ', 'g'))) AS n FROM {v_passages}),
p AS (SELECT doc_id AS para_id, text, trim(lower(regexp_replace(text, '[ \t\r\n\f\v]+', ' ', 'g'))) AS n FROM {documents}),
x AS (SELECT qid, para_id, 0 AS tier FROM e JOIN p ON e.evidence = p.text UNION ALL SELECT qid, para_id, 1 FROM e JOIN p ON e.n = p.n WHERE e.n <> ''),
h AS (SELECT * FROM x UNION ALL SELECT qid, para_id, 2 FROM (SELECT * FROM e WHERE n <> '' AND qid NOT IN (SELECT qid FROM x)) e JOIN p ON (length(e.n) > 30 AND contains(p.n, e.n)) OR (length(p.n) > 30 AND contains(e.n, p.n))),
b AS (SELECT DISTINCT qid, para_id, tier FROM (SELECT *, min(tier) OVER (PARTITION BY qid) AS t FROM h) WHERE tier = t)
SELECT e.qid, coalesce(b.para_id, -1) AS para_id, CASE b.tier WHEN 0 THEN 'paragraph_exact' WHEN 1 THEN 'paragraph_normalized_exact' WHEN 2 THEN 'paragraph_normalized_contains' ELSE 'none' END AS mode FROM e LEFT JOIN b USING (qid)
""")
def located_evidence(v_passages: DataFrame, documents: DataFrame) -> DataFrame:
    return evaluation.locate_evidence(v_passages, documents.select(F.col("doc_id").alias("para_id"), "text"))


LINES_SQL = "SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, ls FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {documents} WHERE text IS NOT NULL)"


@built_view(f"SELECT doc_id * 1000000 + i AS para_id, doc_id, ls[i] AS text, CASE WHEN i % 3 = 0 THEN 'table' ELSE 'paragraph' END AS kind, (i - 1) // 5 + 1 AS page_number, i AS line_number FROM ({LINES_SQL})")
def v_source_paragraphs(documents: DataFrame) -> DataFrame:
    """Lines of documents as paragraphs, five to a page, every third a table."""
    rows = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    i = (F.col("i") + 1).cast("bigint")
    return rows.select(
        (F.col("doc_id") * 1000000 + i).alias("para_id"), "doc_id", "text", F.when(i % 3 == 0, "table").otherwise("paragraph").alias("kind"),
        (F.floor((i - 1) / 5) + 1).alias("page_number"), i.alias("line_number"),
    )


# Of each document: its first line, the seam of its first two lines, its second line in other case and spaces with a wrong page, a
# short text out of its third line, and one that no document holds.
add_view("v_evidence_texts", """
WITH l AS (SELECT doc_id, max(CASE line_number WHEN 1 THEN text END) AS a, max(CASE line_number WHEN 2 THEN text END) AS b, max(CASE line_number WHEN 3 THEN text END) AS c FROM {v_source_paragraphs} GROUP BY doc_id)
SELECT doc_id * 5 AS qid, a AS evidence, CAST(1 AS BIGINT) AS page_number, CAST(1 AS BIGINT) AS line_number FROM l
UNION ALL SELECT doc_id * 5 + 1, right(a, 25) || '  ' || left(b, 25), CAST(1 AS BIGINT), CAST(NULL AS BIGINT) FROM l
UNION ALL SELECT doc_id * 5 + 2, ' ' || replace(replace(b, 'e', 'E'), ' ', '  '), CAST(9 AS BIGINT), CAST(2 AS BIGINT) FROM l
UNION ALL SELECT doc_id * 5 + 3, substr(c, 5, 18), CAST(NULL AS BIGINT), CAST(3 AS BIGINT) FROM l
UNION ALL SELECT doc_id * 5 + 4, 'q#' || CAST(doc_id AS STRING) || ' is nowhere in the given texts', CAST(1 AS BIGINT), CAST(1 AS BIGINT) FROM l
""")


@query("E21", r"""
WITH e AS (SELECT *, trim(lower(regexp_replace(evidence, '[ \t\r\n\f\v]+', ' ', 'g'))) AS n FROM {v_evidence_texts}),
p AS (SELECT *, trim(lower(regexp_replace(text, '[ \t\r\n\f\v]+', ' ', 'g'))) AS n FROM {v_source_paragraphs}),
x AS (SELECT qid, para_id, 0 AS tier FROM e JOIN p ON e.evidence = p.text UNION ALL SELECT qid, para_id, 1 FROM e JOIN p ON e.n = p.n WHERE e.n <> ''),
y AS (SELECT * FROM x UNION ALL SELECT qid, para_id, 2 FROM (SELECT * FROM e WHERE n <> '' AND qid NOT IN (SELECT qid FROM x)) e JOIN p ON (length(e.n) > 30 AND contains(p.n, e.n)) OR (length(p.n) > 30 AND contains(e.n, p.n))),
d AS (SELECT doc_id, string_agg(n, ' ' ORDER BY para_id) AS t FROM p WHERE n <> '' GROUP BY doc_id),
z AS (SELECT * FROM y UNION ALL SELECT DISTINCT qid, -1, 3 FROM (SELECT * FROM e WHERE n <> '' AND qid NOT IN (SELECT qid FROM y)) e JOIN d ON contains(d.t, e.n)),
b AS (SELECT DISTINCT qid, para_id, tier FROM (SELECT *, min(tier) OVER (PARTITION BY qid) AS best FROM z) WHERE tier = best),
g AS (SELECT b.qid, min(tier) AS tier, count(p.para_id) AS n, string_agg(DISTINCT p.kind, ',' ORDER BY p.kind) AS kinds,
  bool_or(CASE WHEN p.para_id IS NOT NULL AND e.page_number IS NOT NULL AND e.line_number IS NOT NULL THEN p.page_number = e.page_number AND p.line_number = e.line_number END) AS agree
  FROM b JOIN e ON e.qid = b.qid LEFT JOIN p ON p.para_id = b.para_id GROUP BY b.qid)
SELECT e.qid, CASE g.tier WHEN 0 THEN 'paragraph_exact' WHEN 1 THEN 'paragraph_normalized_exact' WHEN 2 THEN 'paragraph_normalized_contains' WHEN 3 THEN 'document_normalized_contains' ELSE 'none' END AS mode,
  coalesce(g.n, 0) AS n_paragraphs, coalesce(g.kinds, '') AS kinds, g.agree AS page_line_match,
  concat_ws(',', CASE WHEN g.qid IS NULL THEN 'evidence_text_not_found' END, CASE WHEN NOT g.agree THEN 'page_or_line_number_mismatch' END) AS issues
FROM e LEFT JOIN g USING (qid)
""")
def evidence_checks(v_evidence_texts: DataFrame, v_source_paragraphs: DataFrame) -> DataFrame:
    rows = evaluation.check_evidence(v_evidence_texts, v_source_paragraphs, "doc_id")
    return rows.select("qid", "mode", "n_paragraphs", F.array_join("kinds", ",").alias("kinds"), "page_line_match", F.array_join("issues", ",").alias("issues"))


add_view("v_span_tasks", """
SELECT o_orderkey AS qid, 'The first line. Total price was $' || amt || ' million for order ' || CAST(o_orderkey AS STRING) || '! It holds .75 of all. Last words? Yes.' AS evidence,
       CASE o_orderkey % 6 WHEN 0 THEN '$' || amt WHEN 1 THEN 'total price' WHEN 2 THEN '0.75' WHEN 3 THEN '$' || amt || '0 million' WHEN 4 THEN 'nowhere' ELSE ' Yes ' END AS answer, amt
FROM (SELECT o_orderkey, CAST(o_orderkey % 900 + 100 AS STRING) || '.5' AS amt FROM {orders}) o
""")


@query("E23", """
SELECT qid, CASE qid % 6 WHEN 0 THEN 'exact' WHEN 1 THEN 'case_insensitive' WHEN 2 THEN 'stripped_leading_zero' WHEN 3 THEN 'numeric_entity' WHEN 4 THEN '' ELSE 'exact' END AS method,
  coalesce(CASE qid % 6 WHEN 0 THEN '$' || amt WHEN 1 THEN 'Total price' WHEN 2 THEN '.75' WHEN 3 THEN '$' || amt || ' million' WHEN 5 THEN 'Yes' END, '') AS span,
  coalesce(CASE WHEN qid % 6 IN (0, 1, 3) THEN 'The first line. Total price was $' || amt || ' million for order ' || qid || '! It holds .75 of all.'
       WHEN qid % 6 = 2 THEN 'Total price was $' || amt || ' million for order ' || qid || '! It holds .75 of all. Last words?' WHEN qid % 6 = 5 THEN 'Last words? Yes.' END, '') AS context FROM {v_span_tasks}
""")
def aligned_spans(v_span_tasks: DataFrame) -> DataFrame:
    rows = evaluation.align_spans(v_span_tasks)
    none = F.lit("")
    span = F.substring(F.col("evidence"), F.col("start") + 1, F.col("stop") - F.col("start"))
    return rows.select("qid", F.coalesce("method", none).alias("method"), F.coalesce(span, none).alias("span"), F.coalesce("context", none).alias("context"))


add_view("v_cell_targets", """
SELECT p_partkey AS doc_id, CASE p_partkey % 5 WHEN 0 THEN '$' || CAST(p_size * 10 AS STRING) WHEN 1 THEN CAST(CAST(p_retailprice AS DECIMAL(18, 2)) AS STRING) || '0' WHEN 2 THEN 'INCOME' WHEN 3 THEN CAST(-p_size AS STRING) ELSE 'zzz' END AS target FROM {part}
""")


@query("E24", rf"""
WITH cells AS ({CELLS_SQL}),
x AS (SELECT *, lower(trim(cell)) AS c, lower(trim(target)) AS t FROM cells JOIN {{v_cell_targets}} USING (doc_id)),
n AS (SELECT *, try_cast(nullif(regexp_replace(trim(c, '()'), '[^0-9.\-]', '', 'g'), '') AS DOUBLE) * CASE WHEN c LIKE '(%)' THEN -1 ELSE 1 END AS cn, try_cast(nullif(regexp_replace(trim(t, '()'), '[^0-9.\-]', '', 'g'), '') AS DOUBLE) AS tn FROM x),
m AS (SELECT *, CASE WHEN c = t THEN 'exact_cell' WHEN abs(tn - cn) <= 0.001 THEN 'numeric_cell' WHEN t <> '' AND c <> '' AND contains(c, t) THEN 'contains_cell' END AS method FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY row, CASE WHEN method = 'contains_cell' THEN 1 ELSE 0 END, CASE WHEN method = 'contains_cell' THEN -col ELSE col END) AS rn FROM m WHERE method IS NOT NULL)
SELECT r.doc_id, r.target, r.row, r.col, r.cell, r.method, l.cell AS row_label, h.cell AS column_hint FROM r LEFT JOIN cells l ON l.doc_id = r.doc_id AND l.row = r.row AND l.col = 0 LEFT JOIN cells h ON h.doc_id = r.doc_id AND h.row = 0 AND h.col = r.col WHERE rn = 1
""")
def found_cells(v_tables: DataFrame, v_cell_targets: DataFrame) -> DataFrame:
    return evaluation.find_table_cells(v_tables, v_cell_targets)


@query("E25", """
SELECT DISTINCT option, value FROM (SELECT 'model' AS option, trim(json_extract_string(metadata, '$.model')) AS value FROM {v_docs}
  UNION ALL SELECT 'size', trim(unnest(CAST(json_extract(metadata, '$.sizes') AS VARCHAR[]))) FROM {v_docs}) WHERE value <> ''
""")
def available_options(v_docs: DataFrame) -> DataFrame:
    return evaluation.available_options(v_docs)


FACTS = "p_partkey AS doc_id, p_size, p_brand, p_name, CAST(CAST(p_retailprice AS DECIMAL(18, 2)) AS VARCHAR) AS price, p_partkey % 3 AS k"


@query("E26", f"""
WITH s AS (SELECT {FACTS}, 'Cash was $' || p_size || '.5 million in total;' AS a, 'tax expense grew by 4.5% to 12 million.' AS b FROM {{part}}),
q AS (SELECT a AS sentence, min(doc_id) AS doc_id, '$' || any_value(p_size) || '.5 million USD' AS answer, '$' || any_value(p_size) || '.5' AS tok FROM s WHERE length(a) >= 35 GROUP BY 1
      UNION ALL SELECT b, min(doc_id), '4.5%', '4.5%' FROM s GROUP BY 1)
SELECT doc_id, 'According to the filing, what is the reported amount or rate in this sentence: "' || sentence || '"?' AS question, answer, sentence AS evidence,
  strpos(sentence, tok) - 1 AS answer_start, strpos(sentence, tok) - 1 + length(tok) AS answer_stop FROM q
""")
def sentence_questions(v_tables: DataFrame) -> DataFrame:
    # Tables are cut away first: paragraphs alone are asked about.
    prose = chunking.chunk_paragraphs(v_tables, "content").where(~F.contains("content", F.lit("|"))).select("doc_id", "content")
    return qa.qa_sentences(prose, "the filing").drop("start")


@query("E27", f"""
WITH p AS (SELECT {FACTS} FROM {{part}}),
c AS (SELECT doc_id, 1 AS row, 1 AS col, 'Net income' AS label, '2024' AS head, '$' || p_size * 10 AS tok, '| $' AS x, 'Net income | $' || p_size * 10 || ' | ' || price AS t FROM p
  UNION ALL SELECT doc_id, 1, 2, 'Net income', '2025', price, '', 'Net income | $' || p_size * 10 || ' | ' || price FROM p
  UNION ALL SELECT doc_id, 2, 1, p_brand, '2024', '(' || p_size || ')', '', p_brand || ' | (' || p_size || ') | ' || k FROM p
  UNION ALL SELECT doc_id, 2, 2, p_brand, '2025', CAST(k AS VARCHAR), '', p_brand || ' | (' || p_size || ') | ' || k FROM p)
SELECT doc_id, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, 'According to the filing, what is the reported value for ''' || label || ''' under ''' || head || '''?' AS question, tok || ' USD' AS answer, t AS evidence, strpos(t, tok) - 1 AS answer_start FROM c
""")
def cell_questions(v_tables: DataFrame) -> DataFrame:
    return qa.qa_cells(v_tables, "the filing")


@query("E28", f"""
WITH p AS (SELECT {FACTS}, CAST(p_size * 10 AS DOUBLE) AS a1, CAST(p_retailprice AS DOUBLE) AS a2, CAST(-p_size AS DOUBLE) AS b1, CAST(p_partkey % 3 AS DOUBLE) AS b2 FROM {{part}}),
r AS (SELECT doc_id, 1 AS row, 'Net income' AS l, a1 AS v1, a2 AS v2 FROM p UNION ALL SELECT doc_id, 2, p_brand, b1, b2 FROM p)
SELECT doc_id, CAST(row AS BIGINT) AS row, 'difference' AS kind, 'According to the filing, what is the absolute difference for ''' || l || ''' between ''2024'' and ''2025''?' AS question, format('{{:,.2f}}', v1 - v2) || ' USD' AS answer FROM r
UNION ALL SELECT doc_id, row, 'percent_change', 'According to the filing, what is the percent change for ''' || l || ''' from ''2025'' to ''2024''?', CASE WHEN v2 = 0 THEN 'n/a' ELSE printf('%.2f%%', (v1 - v2) / abs(v2) * 100) END FROM r
UNION ALL SELECT doc_id, 1, 'ratio', 'According to the filing, what is the ratio of ''Net income'' to ''' || p_brand || ''' for ''' || CASE WHEN b1 <> 0 THEN '2024' ELSE '2025' END || '''?', printf('%.4fx', CASE WHEN b1 <> 0 THEN a1 / b1 ELSE a2 / b2 END) FROM p WHERE b1 <> 0 OR b2 <> 0
""")
def arithmetic_questions(v_tables: DataFrame) -> DataFrame:
    return qa.qa_arithmetic(v_tables, "the filing")


add_view("v_questions", """
SELECT qid, 'Group' || CAST(qid % 3 + 1 AS STRING) AS grp, 'What is ' || CASE WHEN qid % 2 = 0 THEN 'THE' ELSE 'the' END || ' price of ' || CAST(CAST(floor(qid / 4) AS BIGINT) AS STRING) || '?' AS question,
       CASE qid % 8 WHEN 0 THEN '12,' WHEN 1 THEN '(4' WHEN 2 THEN '7' ELSE gold END AS answer FROM {v_qa}
""")


@query("E29", """
WITH d AS (SELECT *, row_number() OVER (PARTITION BY grp, lower(question), answer ORDER BY qid) AS rn FROM {v_questions}),
n AS (SELECT qid, grp, question, answer, row_number() OVER (PARTITION BY grp ORDER BY qid) AS number FROM d WHERE rn = 1)
SELECT qid, grp, question, answer, number, replace(grp, 'Group', 'G') || '-' || printf('%03d', number) AS qa_id FROM n WHERE number <= CASE grp WHEN 'Group1' THEN 300 WHEN 'Group2' THEN 400 ELSE 300 END
""")
def selected_questions(v_questions: DataFrame) -> DataFrame:
    return qa.qa_select(v_questions, {"Group1": 300, "Group2": 400, "Group3": 300}, ["qid"])


@query("E30", r"""
SELECT count(*) AS total, count(*) FILTER (grp = 'Group1' AND regexp_full_match(answer, '\d{1,2},?')) AS date_like, count(*) FILTER (grp = 'Group1' AND regexp_full_match(answer, '[1-9]')) AS single_digit,
  count(*) FILTER (grp = 'Group2' AND answer LIKE '(%' AND answer NOT LIKE '%)') AS unclosed FROM {v_questions}
""")
def question_lint(v_questions: DataFrame) -> DataFrame:
    return qa.qa_lint(v_questions)
