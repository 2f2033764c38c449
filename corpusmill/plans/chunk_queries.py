"""Chunking and segmentation (C)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import chunking
from corpusmill.plans.catalog import add_view, query

TRIM = "' ' || chr(9) || chr(10) || chr(13)"


def chars_sql(size: int, overlap: int, docs: str = "{documents}", text: str = "text") -> str:
    step = size - overlap
    return f"""
SELECT doc_id, unnest(l) AS content, generate_subscripts(l, 1) - 1 AS idx FROM (
  SELECT doc_id, list_filter(list_transform(range(0, CASE WHEN length({text}) <= {size} THEN 1 ELSE 1 + CAST(ceil((length({text}) - {size}) / {step}.0) AS BIGINT) END),
    lambda i: trim(substr({text}, CAST(i * {step} + 1 AS BIGINT), {size}), {TRIM})), lambda s: s <> '') AS l FROM {docs} WHERE length({text}) > 0)"""


def sandwich_sql(size: int, overlap: int) -> str:
    step = size - overlap
    return f"""
SELECT doc_id, i AS idx, substr(text, CAST(i * {step} + 1 AS BIGINT), {size}) AS content,
  trim(substr(text, CAST(greatest(i * {step} - 100, 0) + 1 AS BIGINT), CAST(least(i * {step}, 100) AS BIGINT)), {TRIM}) AS prefix,
  trim(substr(text, CAST(i * {step} + {size} + 1 AS BIGINT), 100), {TRIM}) AS suffix, i * {step} AS char_start, i * {step} + {size} AS char_end
FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / {step}.0) AS BIGINT))) AS i FROM {{documents}})"""


@query("C1", chars_sql(500, 50))
def char_chunks(documents: DataFrame) -> DataFrame:
    return chunking.chunk_chars(documents, 500, 50)


@query("C1", chars_sql(300, 200))
def deeply_overlapping_chunks(documents: DataFrame) -> DataFrame:
    return chunking.chunk_chars(documents, 300, 200)


add_view("v_paragraphs", """
SELECT doc_id, replace(replace(text, '. ', '.' || chr(10) || ' ' || chr(10)), ', ', ',' || chr(10)) AS text FROM {documents}
""")


@query("C2", f"""
SELECT doc_id, unnest(l) AS content, generate_subscripts(l, 1) - 1 AS idx FROM (SELECT doc_id,
  list_filter(list_transform(regexp_split_to_array(text, '\\n[ \\t\\r\\n]*\\n'), lambda p: trim(p, {TRIM})), lambda p: p <> '') AS l FROM {{v_paragraphs}})
""")
def paragraphs(v_paragraphs: DataFrame) -> DataFrame:
    return chunking.chunk_paragraphs(v_paragraphs)


@query("C3")
def recursive_chunks(documents: DataFrame) -> DataFrame:
    return chunking.chunk_recursive(documents, 64)


@query("C3", "SELECT doc_id, text, TRUE AS within_cap FROM {v_paragraphs}")
def recursive_chunks_rejoined(v_paragraphs: DataFrame) -> DataFrame:
    """The law of the ladder: pieces join back to the text and none is above the cap. Rows count one by one, as an id may come
    twice; a text without characters, or none at all, has no pieces to join."""
    has = F.length("text") > 0
    rows = v_paragraphs.where(has).select(F.struct("doc_id", F.monotonically_increasing_id().alias("row")).alias("of"), "text")
    pieces = chunking.chunk_recursive(rows, 64, key="of")
    joined = pieces.groupBy("of").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "content"))), lambda s: s["content"]), "").alias("text"),
        F.bool_and(F.size(T.words("content")) <= 64).alias("within_cap"),
    )
    empty = v_paragraphs.where(~F.coalesce(has, F.lit(False))).select("doc_id", "text", F.lit(True).alias("within_cap"))
    return joined.select("of.doc_id", "text", "within_cap").unionByName(empty)


@query("C4")
def hybrid_chunks(v_tables: DataFrame) -> DataFrame:
    return chunking.chunk_hybrid(v_tables, 24, "content")


@query("C4", """
SELECT doc_id, trim(regexp_extract(content, '(?s)(Amounts in millions\\n.*\\|)\\n\\n', 1)) || chr(10) || regexp_extract(content, '\\n(Cash was [^\\n]*)', 1) AS content FROM {v_tables}
""")
def hybrid_table_chunks(v_tables: DataFrame) -> DataFrame:
    return chunking.chunk_hybrid(v_tables, 24, "content").where("is_table").select("doc_id", "content")


@query("C4", """
WITH l AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS n FROM (SELECT doc_id, string_split(content, chr(10)) AS s FROM {v_docs} UNION ALL SELECT doc_id + 1000000, string_split(content, chr(10)) FROM {v_tables})),
k AS (SELECT *, regexp_matches(line, '^[ \\t]*\\|') AS t FROM l WHERE line <> '' OR n > 0),
g AS (SELECT *, CASE WHEN t IS DISTINCT FROM lag(t) OVER (PARTITION BY doc_id ORDER BY n) THEN 1 ELSE 0 END AS s FROM k),
r AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY n) AS run FROM g)
SELECT doc_id, count(DISTINCT run) FILTER (t) AS table_runs, count(*) FILTER (t) AS table_lines FROM r GROUP BY 1
""")
def table_runs(v_docs: DataFrame, v_tables: DataFrame) -> DataFrame:
    both = v_docs.select("doc_id", "content").unionByName(v_tables.select((F.col("doc_id") + 1000000).alias("doc_id"), "content"))
    runs = F.filter("runs", lambda r: r["is_table"])
    return chunking.line_runs(both, "content").select(
        "doc_id", F.size(runs).cast("bigint").alias("table_runs"),
        F.aggregate(runs, F.lit(0), lambda n, r: n + F.size(r["lines"])).cast("bigint").alias("table_lines"),
    )


@query("C5", sandwich_sql(600, 100))
def sandwich_chunks(documents: DataFrame) -> DataFrame:
    return chunking.chunk_sandwich(documents, 600, 100).drop("token_count")


@query("C5", sandwich_sql(150, 90))
def small_sandwich_chunks(documents: DataFrame) -> DataFrame:
    return chunking.chunk_sandwich(documents, 150, 90).drop("token_count")


@query("C6", """
SELECT doc_id, i AS idx, substr(text, CAST(i * 4000 + 1 AS BIGINT), 4000) AS content FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 4000.0) AS BIGINT))) AS i FROM {documents})
""")
def blocks(documents: DataFrame) -> DataFrame:
    return chunking.chunk_blocks(documents, 4000)


MULTI = f"""
SELECT doc_id, 'chunk_text' AS strategy, idx, content FROM ({chars_sql(800, 100)})
UNION ALL SELECT doc_id, 'sandwich_chunk', idx, concat_ws(chr(10), nullif(prefix, ''), content, nullif(suffix, '')) FROM ({sandwich_sql(800, 100)})"""


@query("C7", MULTI)
def multi_strategy_chunks(documents: DataFrame) -> DataFrame:
    return chunking.chunk_multi(documents, [None, "sandwitch_chunk", "no such strategy", " Sandwich_Chunk "])


@query("C7")
def all_strategies(v_docs: DataFrame) -> DataFrame:
    return chunking.chunk_multi(v_docs, ["chunk_text", "sandwich_chunk", "chunk_hybrid", "chunk_recursive"], text="content")


@query("C8", f"""
SELECT doc_id, strategy, 'main:' || doc_id || ':' || strategy || ':' || idx AS chunk_id, len(list_filter(regexp_split_to_array(content, '[ \\t\\n\\r]+'), lambda x: x <> '')) AS token_count FROM ({MULTI})
""")
def chunk_records(documents: DataFrame) -> DataFrame:
    rows = chunking.chunk_records(chunking.chunk_multi(documents, ["chunk_text", "sandwich_chunk"]), "main")
    return rows.select("doc_id", "strategy", "chunk_id", "token_count")


@query("C9", "SELECT doc_id, CASE WHEN length(text) > 1000 THEN substr(text, 1, 1000) || chr(10) || '... [TRUNCATED]' ELSE text END AS text FROM {documents}")
def truncated_texts(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", T.truncate_tokens("text", 250).alias("text"))


@query("C10", f"""
WITH p AS (SELECT doc_id, unnest(l) AS piece, generate_subscripts(l, 1) AS n FROM (SELECT doc_id, string_split(regexp_replace(text, '([.;:][ \\t\\r\\n]+)', '\\1' || chr(1), 'g'), chr(1)) AS l FROM {{documents}})),
o AS (SELECT doc_id, piece, CAST(coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos0 FROM p),
s AS (SELECT doc_id, trim(piece, {TRIM}) AS sentence, pos0 + length(piece) - length(ltrim(piece, {TRIM})) AS start FROM o)
SELECT doc_id, sentence, start, start + length(sentence) AS stop FROM s WHERE sentence <> ''
""")
def sentence_spans(documents: DataFrame) -> DataFrame:
    return chunking.sentence_spans(documents)


CELLS_SQL = r"""
WITH l AS (SELECT doc_id, trim(unnest(s), ' ' || chr(9) || chr(13)) AS line, generate_subscripts(s, 1) AS n FROM (SELECT doc_id, string_split(content, chr(10)) AS s FROM {v_tables})),
r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS row, string_split(regexp_replace(regexp_replace(line, '^\|', ''), '\|$', ''), '|') AS c
      FROM l WHERE line LIKE '|%' AND NOT regexp_matches(line, '^\|[\s]*[-:]+[\s\-:]*\|'))
SELECT doc_id, row, generate_subscripts(c, 1) - 1 AS col, trim(unnest(c)) AS cell FROM r"""


@query("C11", CELLS_SQL)
def table_cells(v_tables: DataFrame) -> DataFrame:
    return chunking.markdown_cells(v_tables)


@query("C12", " UNION ALL ".join(f"""
SELECT CAST({s} AS BIGINT) AS size, count(*) AS n_chunks, round(avg(length(content)), 6) AS avg_chars, max(length(content)) AS max_chars, quantile_cont(length(content), 0.5) AS median_chars
FROM ({chars_sql(s, 0)})""" for s in (256, 512, 1024)))
def chunk_size_sweep(documents: DataFrame) -> DataFrame:
    return chunking.chunk_sweep(documents, [256, 512, 1024])
