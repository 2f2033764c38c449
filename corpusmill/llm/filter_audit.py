"""Filter interaction audit: what five text filters remove in each of their 120 orders, from one contingency tensor a part.

Every document fails or passes each of the filters A to E, so a part (a language) is described by the counts of its 32
cells. The corpus is read once to count them; from there on only cells matter. A part's cells are reshaped to
2x2x2x2x2, one axis per filter (0 passes, 1 fails), and each figure of each step of each order is a contraction of that
tensor: along every axis a vector selects pass, fail or all, and one ``einsum`` takes all steps of all orders at once.

The filters: A under 100 words; B fewer than 80 distinct words in 100; C more than 10 capitals in 100 characters; D one
of the signs ``#$%&*|``; E the text of a smaller id, anywhere in the table. Equal texts meet on their SHA-256, after the
rows of a text have been counted by part and labels, so a text that holds a third of all rows is a few rows there.

Defined cases: a null text is empty, a null part the empty string; a null id is smaller than none and larger than none,
so it passes E, and it has no labels; rows with the smallest id of a text all pass E; several labels of one id count if
any of them does, labels without id count for none; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import WORD

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)
FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{f} long" for f in FIGURES)


def text_failures(text: Column) -> list[Column]:
    """Whether a text fails A, B, C and D."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [n < 100, 100 * distinct < 80 * n, 100 * capitals > 10 * F.length(text), text.rlike("[#$%&*|]")]


def cells(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """``part``, ``cell`` (A's failure is its highest bit, E's the lowest) and its documents: ``n``, ``good``, ``toxic``."""
    text = F.coalesce("text", F.lit(""))
    failed = sum((f.cast("int") * (16 >> i) for i, f in enumerate(text_failures(text))), F.lit(0))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col(part), F.lit("")).alias("part"), failed.alias("failed"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
    )
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    rows = rows.join(known, "doc_id", "left").fillna(False, ["good", "toxic"])
    kinds = ["digest", "failed", "part", "good", "toxic"]
    # Rows that share id and all else first, so that those with a text's smallest id are counted and not assumed to be one.
    rows = rows.groupBy("doc_id", *kinds).agg(F.count("*").alias("m"))
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "m")))
    rows = rows.groupBy(*kinds).agg(F.sum("m").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("m")).otherwise(0)).alias("nameless"), least.alias("least"))
    first = F.col("least.doc_id") == F.min("least.doc_id").over(Window.partitionBy("digest"))
    rows = rows.withColumn("first", F.col("nameless") + F.when(first, F.col("least.m")).otherwise(0))
    split = F.explode(F.array(F.struct(F.lit(0).alias("again"), F.col("first").alias("n")), F.struct(F.lit(1).alias("again"), (F.col("n") - F.col("first")).alias("n"))))
    rows = rows.select("part", "failed", "good", "toxic", split.alias("s"))
    of = lambda flag: F.sum(F.when(F.col(flag), F.col("s.n")).otherwise(0)).alias(flag)
    return rows.groupBy("part", (F.col("failed") + F.col("s.again")).alias("cell")).agg(F.sum("s.n").alias("n"), of("good"), of("toxic"))


def selectors() -> dict[str, np.ndarray]:
    """Per figure the vectors (order and step, filter, pass or fail) that select its cells."""
    out: dict[str, list] = {"kept": [], "removed": [], "fails": [], "unique_fails": []}
    for order in ORDERS:
        for step, own in enumerate(order):
            earlier = order[:step]
            rules = {
                "kept": lambda f: PASS if f in earlier or f == own else ALL,
                "removed": lambda f: FAIL if f == own else PASS if f in earlier else ALL,
                "fails": lambda f: FAIL if f == own else ALL,
                "unique_fails": lambda f: FAIL if f == own else PASS,
            }
            for name, rule in rules.items():
                out[name].append([rule(f) for f in FILTERS])
    return {k: np.array(v, dtype=np.int64) for k, v in out.items()}


def contracted(tensor: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Sums of the cells that each row of ``chosen`` selects, for each part."""
    return np.einsum("pabcde,ma,mb,mc,md,me->pm", tensor, *(chosen[:, i] for i in range(5)))


def figures(n: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> dict[str, np.ndarray]:
    """All figures (part, order and step) from cells (part, 32)."""
    tensors = [x.reshape(-1, 2, 2, 2, 2, 2) for x in (n, good, toxic)]
    select = selectors()
    out = {k: contracted(tensors[0], v) for k, v in select.items()}
    out["redundant"] = out.pop("fails") - out["removed"]
    out["good_lost"], out["toxic_lost"] = (contracted(t, select["removed"]) for t in tensors[1:])
    own = np.array([FILTERS.index(f) for order in ORDERS for f in order])
    totals = np.stack([out["removed"][:, own == f].sum(axis=1) for f in range(len(FILTERS))], axis=1)
    out["shapley"] = totals[:, own]
    return out


def interactions(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step, with ``FIGURES``."""
    cell = F.struct("cell", "n", "good", "toxic")  # 32 at most in a part
    parts = cells(docs, labels, part).groupBy("part").agg(F.collect_list(cell).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = pa.array([o for o in ORDERS for _ in o])
        steps = pa.array([s + 1 for o in ORDERS for s in range(len(o))], pa.int32())
        for batch in batches:
            for at in range(batch.num_rows):
                counts = np.zeros((3, 1, 32), dtype=np.int64)
                for c in batch.column("cells")[at].as_py():
                    counts[:, 0, c["cell"]] = c["n"], c["good"], c["toxic"]
                found = figures(*counts)
                name = pa.array([batch.column("part")[at].as_py()] * len(steps), pa.string())
                yield pa.RecordBatch.from_arrays([name, orders, steps, *(pa.array(found[f][0]) for f in FIGURES)], ["part", "filter_order", "step", *FIGURES])

    return parts.mapInArrow(run, SCHEMA)


#: The same by joins of the orders with the flags' counts.
SQL = rf"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents
), l AS (
  SELECT doc_id, max(coalesce(quality = 1, FALSE)) AS good, max(coalesce(toxic = 1, FALSE)) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, len(ws) < 100 AS "A", 100 * len(list_distinct(ws)) < 80 * len(ws) AS "B",
         100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t) AS "C", regexp_matches(t, '[#$%&*|]') AS "D",
         coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), FALSE) AS "E", coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id
), c AS (
  SELECT part, CASE WHEN "A" THEN 'A' ELSE '' END || CASE WHEN "B" THEN 'B' ELSE '' END || CASE WHEN "C" THEN 'C' ELSE '' END
         || CASE WHEN "D" THEN 'D' ELSE '' END || CASE WHEN "E" THEN 'E' ELSE '' END AS failed,
         count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY 1, 2
), x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS earlier
         FROM o, (SELECT unnest(range(1, 6))::INT AS step)
), r AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (len(translate(failed, earlier || own, '')) = len(failed)), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (contains(failed, own) AND len(translate(failed, earlier, '')) = len(failed)), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (contains(failed, own) AND len(translate(failed, earlier, '')) < len(failed)), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (failed = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (contains(failed, own) AND len(translate(failed, earlier, '')) = len(failed)), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (contains(failed, own) AND len(translate(failed, earlier, '')) = len(failed)), 0)::BIGINT AS toxic_lost
  FROM c, s GROUP BY ALL
)
SELECT * EXCLUDE (own), sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM r
"""
