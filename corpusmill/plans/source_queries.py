"""Scans, document makers, sinks (S) and the extension hooks (U)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill import registry
from corpusmill.plans.catalog import path_query, query
from corpusmill.plans.chunk_queries import chars_sql
from corpusmill.plans.retrieval_queries import BM25_DOCS, rrf_sql, VECTOR_DOCS
from corpusmill.session import checkpoint_dir, made_in_small_batches
from corpusmill.sources import corpus


@path_query("S1", "SELECT doc_id, lang, source, n_chars FROM {documents}")
def corpus_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.read_corpus(spark, f"{sf_dir}/documents.parquet", ["doc_id", "lang", "source", "n_chars"])


@query("S2", """
SELECT 'folder=' || CAST(page_id % 7 AS VARCHAR) AS folder, CAST(sum(octet_length(encode(html)) + 1) AS BIGINT) AS n_bytes
FROM {pages} WHERE page_id % 7 <> 6 GROUP BY 1
""")
def file_scan(pages: DataFrame) -> DataFrame:
    """The pages' markup as text files in folders, one of which is left out of the scan."""
    root = f"{checkpoint_dir(pages.sparkSession)}/files/{uuid.uuid4().hex}"
    pages.select((F.col("page_id") % 7).alias("folder"), "html").write.partitionBy("folder").text(root)
    files = corpus.scan_files(pages.sparkSession, root, [".txt"], ["folder=6"])
    return files.groupBy(F.element_at(F.split("relative_path", "/"), 1).alias("folder")).agg(F.sum("size").alias("n_bytes"))


@query("S3", corpus.PAGES_SQL)
def extracted_pages(pages: DataFrame) -> DataFrame:
    return corpus.extract_pages(pages)


@query("S4", r"""
WITH c AS (SELECT conv_id AS file_id, turn, (turn + conv_id) % 3 AS k, 'r\|' || role AS a, CAST(length(text) AS VARCHAR) AS b, CAST(conv_id AS VARCHAR) AS c FROM {conversations}),
w AS (SELECT file_id, min(turn) AS f, arg_min(k, turn) AS w FROM c GROUP BY 1),
l AS (SELECT c.file_id, turn, '| ' || a || ' |' || CASE WHEN w > 0 THEN ' ' || CASE WHEN k > 0 THEN b ELSE '' END || ' |' ELSE '' END || CASE WHEN w > 1 THEN ' ' || CASE WHEN k > 1 THEN c ELSE '' END || ' |' ELSE '' END
    || CASE WHEN turn = f THEN chr(10) || '| --- |' || repeat(' --- |', CAST(w AS INT)) ELSE '' END AS line FROM c JOIN w USING (file_id))
SELECT file_id, CAST(0 AS BIGINT) AS part, string_agg(line, chr(10) ORDER BY turn) || chr(10) AS markdown FROM l GROUP BY 1
""")
def delimited_to_markdown(conversations: DataFrame) -> DataFrame:
    # Rows of one, two or three cells; the header row sets the width.
    cells = F.array(F.concat(F.lit(" r|"), "role"), F.length("text").cast("string"), F.concat(F.col("conv_id").cast("string"), F.lit(" ")))
    width = ((F.col("turn") + F.col("conv_id")) % 3 + 1).cast("int")
    rows = conversations.select(F.col("conv_id").alias("file_id"), F.col("turn").alias("line_no"), F.slice(cells, F.lit(1), width).alias("cells"))
    return corpus.rows_to_markdown(rows)


@query("S5", """
SELECT doc_id, 'k: ' || json_extract_string(metadata, '$.k') || chr(10) || 'model: ' || json_extract_string(metadata, '$.model') || chr(10) || 'sizes: ' || CAST(json_extract(metadata, '$.sizes') AS VARCHAR) AS everything,
  'model: ' || json_extract_string(metadata, '$.model') || chr(10) || 'k: ' || json_extract_string(metadata, '$.k') AS chosen FROM {v_docs}
""")
def record_texts(v_docs: DataFrame) -> DataFrame:
    return v_docs.select(
        "doc_id", corpus.records_to_text(v_docs, "metadata").alias("everything"),
        corpus.records_to_text(v_docs, "metadata", ["model", "absent", "k"]).alias("chosen"),
    )


@query("S6", "SELECT 'c' || o_custkey AS run_id, CAST(o_orderkey AS VARCHAR) AS qid, o_orderpriority AS grp, o_totalprice > 100000 AS number_match FROM {orders}")
def parsed_runs(orders: DataFrame) -> DataFrame:
    result = F.struct(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("group"),
        F.struct((F.col("o_totalprice") > 100000).alias("number_match")).alias("metrics"),
    )
    path = F.concat(F.lit("file:/runs/c"), F.col("o_custkey").cast("string"), F.lit(".json"))
    files = orders.groupBy(path.alias("path")).agg(F.to_json(F.struct(F.collect_list(result).alias("results"))).alias("value"))
    other = orders.select(F.lit("file:/runs/notes.json").alias("path"), F.lit('{"note": 1}').alias("value")).limit(1)
    return corpus.parse_runs(files.unionByName(other)).select("run_id", "qid", "grp", "number_match")


@query("S7", f"""
SELECT doc_id, idx, content, CAST(2 AS INT) AS indexed_at FROM ({chars_sql(800, 100)}) UNION ALL
SELECT doc_id, idx, content, 1 FROM ({chars_sql(500, 50)}) o WHERE NOT EXISTS (SELECT 1 FROM ({chars_sql(800, 100)}) n WHERE n.doc_id = o.doc_id AND n.idx = o.idx)
""")
def upserted_chunks(documents: DataFrame) -> DataFrame:
    from corpusmill.operators.chunking import chunk_chars

    marked = lambda df, at: df.withColumn("indexed_at", F.lit(at)).withColumn("chunk_id", F.concat_ws(":", "doc_id", "idx"))
    stamped = lambda df, at: marked(df, at).withColumns({"space_id": F.lit(1), "strategy": F.lit("chunk_text")})
    path = f"{checkpoint_dir(documents.sparkSession)}/chunks/{uuid.uuid4().hex}"
    corpus.write_chunks(stamped(chunk_chars(documents, 500, 50), 1), path)
    corpus.write_chunks(stamped(chunk_chars(documents, 800, 100), 2), path)
    return documents.sparkSession.read.parquet(path).select("doc_id", "idx", "content", "indexed_at")


@query("S8", "SELECT chunk_id FROM {v_chunks} WHERE doc_id NOT IN (SELECT doc_id FROM {labels} WHERE toxic = 1)")
def remaining_chunks(v_chunks: DataFrame, labels: DataFrame) -> DataFrame:
    return corpus.delete_documents(v_chunks, labels.where("toxic = 1")).select("chunk_id")


@query("S9", "SELECT space_id, count(*) AS n_chunks, CAST(sum(strlen(c.content)) AS BIGINT) AS n_bytes FROM {v_chunks} c JOIN {v_docs} USING (doc_id) GROUP BY 1")
def index_statistics(v_chunks: DataFrame, v_docs: DataFrame) -> DataFrame:
    return corpus.chunk_stats(v_chunks.join(v_docs.select("doc_id", "space_id"), "doc_id"))


@query("S10", """
SELECT coalesce(a.space_id, b.space_id) AS space_id, coalesce(x, 0) AS left_count, coalesce(y, 0) AS right_count, coalesce(x, 0) = coalesce(y, 0) AS agrees
FROM (SELECT space_id, count(*) AS x FROM {v_docs} GROUP BY 1) a FULL OUTER JOIN (SELECT doc_id % 4 + 1 AS space_id, count(*) AS y FROM {labels} GROUP BY 1) b ON a.space_id = b.space_id
""")
def reconciled_counts(v_docs: DataFrame, labels: DataFrame) -> DataFrame:
    return corpus.reconcile_counts(v_docs, labels.select((F.col("doc_id") % 4 + 1).alias("space_id")), "space_id")


@query("U1", f"SELECT doc_id, content, idx FROM ({chars_sql(700, 0)})")
def registered_chunker(documents: DataFrame) -> DataFrame:
    return registry.get("chunker", "chars")(documents, 700)


@query("U1", f"{rrf_sql({'vector': VECTOR_DOCS, 'bm25': BM25_DOCS}, 'doc_id', 10)}")
def registered_retriever(v_queries: DataFrame, documents: DataFrame, v_doc_vectors: DataFrame) -> DataFrame:
    return registry.get("retriever", "hybrid")(v_queries, documents, v_doc_vectors, 10)


@query("U2", r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM {documents}),
b AS (SELECT doc_id, CAST('0x' || substr(md5(w), 1, 8) AS UBIGINT) % 8 AS b, count(*) AS n FROM t GROUP BY 1, 2),
s AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM b GROUP BY 1)
SELECT doc_id, CAST(b AS BIGINT) AS dim, round(n / norm, 6) AS value FROM b JOIN s USING (doc_id)
""")
def hashed_embeddings(documents: DataFrame) -> DataFrame:
    rows = registry.embed(documents, {"hashing": registry.hashing_embedder(8)})
    flat = rows.select("doc_id", F.posexplode("vector").alias("dim", "value"))
    found = flat.where("value <> 0").select("doc_id", F.col("dim").cast("bigint").alias("dim"), F.round(F.col("value"), 6).alias("value"))
    return made_in_small_batches(found)


@query("U3", "SELECT doc_id, upper(lang) AS lang FROM {documents} WHERE n_chars > 500 AND lang = 'en'")
def hooked_documents(documents: DataFrame) -> DataFrame:
    chain = [lambda df: df.select("doc_id", "lang", "n_chars"), lambda df: df.withColumn("code", F.upper("lang"))]
    kept = registry.filtered(registry.transformed(documents, *chain), {"lang": "en"}, F.col("n_chars") > 500)
    return kept.select("doc_id", F.col("code").alias("lang"))
