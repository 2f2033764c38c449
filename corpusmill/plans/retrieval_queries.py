"""Retrieval and ranking (R)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import context, retrieval
from corpusmill.plans.catalog import add_view, built_view, query
from corpusmill.plans.text_queries import PW


def bm25_sql(queries: str, docs: str, key: str, text: str, k: int, q: str = "query", all_terms: bool = False) -> str:
    need = "HAVING count(*) = (SELECT count(DISTINCT term) FROM qt WHERE qt.query_id = s.query_id)" if all_terms else ""
    return f"""
SELECT query_id, {key}, score, rank FROM (
  WITH qt AS (SELECT query_id, term, count(*) AS qc FROM (SELECT query_id, unnest(regexp_extract_all(lower({q}), '[a-z0-9]+')) AS term FROM {queries}) GROUP BY 1, 2),
  dt AS (SELECT {key}, regexp_extract_all(lower({text}), '[a-z0-9]+') AS l FROM {docs}),
  st AS (SELECT count(*) AS n, avg(len(l)) AS avgdl FROM dt),
  tf AS (SELECT {key}, dl, term, count(*) AS tf FROM (SELECT {key}, len(l) AS dl, unnest(l) AS term FROM dt) GROUP BY 1, 2, 3),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
  s AS (SELECT qt.query_id, tf.{key}, qt.qc * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf.tf * 2.5::DOUBLE / (tf.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS part
        FROM tf JOIN qt USING (term) JOIN df USING (term) CROSS JOIN st),
  g AS (SELECT query_id, {key}, round(sum(part), 6) AS score FROM s GROUP BY 1, 2 {need})
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {key}) AS rank FROM g) WHERE rank <= {k}"""


def vector_sql(queries: str, vectors: str, key: str, k: int, where: str = "TRUE") -> str:
    return f"""
SELECT query_id, {key}, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {key}) AS rank FROM (
  SELECT query_id, {key}, round(list_cosine_similarity(CAST(q.vector AS DOUBLE[]), CAST(v.vector AS DOUBLE[])), 6) AS score
  FROM {queries} q CROSS JOIN {vectors} v) WHERE {where}) WHERE rank <= {k}"""


def rrf_sql(lists: dict[str, str], key: str, n: int, k: int = 60, weights: dict[str, float] | None = None) -> str:
    weights = weights or {}
    parts = " UNION ALL ".join(
        f"SELECT query_id, {key}, rank, '{name}' AS list, {weights.get(name, 1.0)}::DOUBLE AS w FROM ({sql})" for name, sql in lists.items()
    )
    ranks = ", ".join(f"coalesce(min(CASE WHEN list = '{name}' THEN rank END), 0) AS {name}_rank" for name in lists)
    return f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {key}) AS rank FROM (
  SELECT query_id, {key}, round(sum(w / ({k} + rank)), 9) AS score, {ranks}, string_agg(DISTINCT list, ',' ORDER BY list) AS lists
  FROM ({parts}) GROUP BY 1, 2)) WHERE rank <= {n}"""


BM25_DOCS = bm25_sql("{v_queries}", "{documents}", "doc_id", "text", 50)
VECTOR_DOCS = vector_sql("{v_queries}", "{v_doc_vectors}", "doc_id", 50)


@query("R3", bm25_sql("{v_queries}", "{documents}", "doc_id", "text", 10))
def bm25_topk(v_queries: DataFrame, documents: DataFrame) -> DataFrame:
    return retrieval.bm25_topk(v_queries, documents, 10)


@query("R1", vector_sql("{v_queries}", "{v_doc_vectors}", "doc_id", 10))
def vector_topk(v_queries: DataFrame, v_doc_vectors: DataFrame) -> DataFrame:
    return retrieval.vector_topk(v_queries, v_doc_vectors, 10)


@query("R1", vector_sql(
    "{v_queries}",
    "(SELECT * FROM {v_doc_vectors} WHERE doc_id IN (SELECT doc_id FROM {v_docs} WHERE doc_type = 'FILE' AND NOT contains(coalesce(status, ''), 'deleting')))",
    "doc_id", 10, "score >= 0.1"))
def vector_topk_scoped(v_queries: DataFrame, v_doc_vectors: DataFrame, v_docs: DataFrame) -> DataFrame:
    return retrieval.vector_topk(v_queries, v_doc_vectors, 10, min_score=0.1, only=context.scope(v_docs, types=["FILE"]))


@query("R2")
def vector_ann(v_queries: DataFrame, v_doc_vectors: DataFrame) -> DataFrame:
    return retrieval.vector_ann(v_queries, v_doc_vectors, 10)


@query("R2")
def vector_ann_recall(v_queries: DataFrame, v_doc_vectors: DataFrame) -> DataFrame:
    exact = retrieval.vector_topk(v_queries, v_doc_vectors, 10)
    return retrieval.ann_recall(exact, retrieval.vector_ann(v_queries, v_doc_vectors, 10))


@query("R4", bm25_sql("{v_queries}", "{documents}", "doc_id", "text", 10, all_terms=True))
def fulltext_all(v_queries: DataFrame, documents: DataFrame) -> DataFrame:
    return retrieval.fulltext_all(v_queries, documents, 10)


OW = ", ".join(f"'{w}'" for w in T.OVERLAP_STOPWORDS)
OVERLAP = rf"""
SELECT query_id, chunk_id, score, rank FROM (
  WITH qt AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9$%.]+')) AS term FROM {{v_queries}}) WHERE term NOT IN ({OW})),
  ct AS (SELECT DISTINCT chunk_id, term FROM (SELECT chunk_id, unnest(regexp_extract_all(lower(content), '[a-z0-9$%.]+')) AS term FROM {{v_chunks}})),
  h AS (SELECT chunk_id, CAST(regexp_matches(lower(content), '\$|\b(?:million|billion|percent|%)\b|\d') AS BIGINT) AS hint FROM {{v_chunks}}),
  n AS (SELECT query_id, chunk_id, count(*) AS n FROM qt JOIN ct USING (term) GROUP BY 1, 2),
  s AS (SELECT q.query_id, h.chunk_id, coalesce(n.n, 0) * 10 + h.hint AS score FROM {{v_queries}} q CROSS JOIN h LEFT JOIN n ON n.query_id = q.query_id AND n.chunk_id = h.chunk_id)
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 10"""


@query("R5", OVERLAP)
def overlap_topk(v_queries: DataFrame, v_chunks: DataFrame) -> DataFrame:
    return retrieval.overlap_topk(v_queries, v_chunks, 10)


@query("R6 U4", f"""
WITH b AS ({BM25_DOCS}), v AS ({VECTOR_DOCS}),
l AS (SELECT query_id, doc_id, rank() OVER (PARTITION BY query_id ORDER BY score DESC) AS r FROM b),
r AS (SELECT query_id, doc_id, rank() OVER (PARTITION BY query_id ORDER BY score DESC) AS r FROM v),
f AS (SELECT coalesce(l.query_id, r.query_id) AS query_id, coalesce(l.doc_id, r.doc_id) AS doc_id, coalesce(l.r, 0) AS left_rank, coalesce(r.r, 0) AS right_rank,
             round(coalesce(1.0::DOUBLE / (60 + l.r), 0) + coalesce(1.0::DOUBLE / (60 + r.r), 0), 9) AS score
      FROM l FULL OUTER JOIN r ON l.query_id = r.query_id AND l.doc_id = r.doc_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 10
""")
def rrf_shared_ranks(v_queries: DataFrame, documents: DataFrame, v_doc_vectors: DataFrame) -> DataFrame:
    left = retrieval.ranked(retrieval.bm25_topk(v_queries, documents, 50).drop("rank"), "doc_id", 50, ties="rank")
    right = retrieval.ranked(retrieval.vector_scores(v_queries, v_doc_vectors, 50), "doc_id", 50, ties="rank")
    return retrieval.rrf(left, right, "doc_id", 10)


@query("R7", rrf_sql({"vector": VECTOR_DOCS, "bm25": BM25_DOCS}, "doc_id", 10))
def hybrid_rrf(v_queries: DataFrame, documents: DataFrame, v_doc_vectors: DataFrame) -> DataFrame:
    return retrieval.hybrid_topk(v_queries, documents, v_doc_vectors, 10)


LEXICAL_QUERIES = rf"""(SELECT query_id, coalesce(lq, query) AS query FROM {{v_queries}} LEFT JOIN (
  SELECT query_id, string_agg(term, ' ' ORDER BY rn) AS lq FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rn FROM (
    SELECT query_id, lower(raw) AS term, min(pos) AS pos FROM (SELECT query_id, unnest(l) AS raw, generate_subscripts(l, 1) AS pos FROM (
      SELECT query_id, regexp_extract_all(query, '[A-Za-z0-9][A-Za-z0-9_\-.]*') AS l FROM {{v_queries}}))
    WHERE NOT regexp_matches(raw, '\.[a-zA-Z]{{2,5}}$') GROUP BY 1, 2) WHERE length(term) >= 3 AND term NOT IN ({PW})) WHERE rn <= 20 GROUP BY 1) USING (query_id))"""
BM25_LEXICAL = bm25_sql(LEXICAL_QUERIES, "{documents}", "doc_id", "text", 50)


@query("R7", rrf_sql({"vector": VECTOR_DOCS, "bm25": BM25_LEXICAL}, "doc_id", 10))
def hybrid_rrf_plus(v_queries: DataFrame, documents: DataFrame, v_doc_vectors: DataFrame) -> DataFrame:
    return retrieval.hybrid_topk(v_queries, documents, v_doc_vectors, 10, "hybrid_rrf_plus")


@query("R7", rrf_sql({"vector": VECTOR_DOCS, "bm25": BM25_LEXICAL}, "doc_id", 10, weights={"vector": 0.6, "bm25": 0.4}))
def hybrid_weighted(v_queries: DataFrame, documents: DataFrame, v_doc_vectors: DataFrame) -> DataFrame:
    return retrieval.hybrid_topk(v_queries, documents, v_doc_vectors, 10, "hybrid_weighted")


@query("R8", rrf_sql({"bm25": BM25_DOCS}, "doc_id", 10))
def lexical_only(v_queries: DataFrame, documents: DataFrame, v_doc_vectors: DataFrame) -> DataFrame:
    return retrieval.hybrid_topk(v_queries, documents, v_doc_vectors, 10, mode="bm25")


@query("R8", rrf_sql({"vector": VECTOR_DOCS}, "doc_id", 10))
def vector_only(v_queries: DataFrame, documents: DataFrame, v_doc_vectors: DataFrame) -> DataFrame:
    return retrieval.hybrid_topk(v_queries, documents, v_doc_vectors, 10, mode="vector")


# A second model: the same vectors with the halves swapped on the document side.
@built_view("SELECT vec_id AS doc_id, list_concat(embedding[33:64], embedding[1:32]) AS vector FROM {embeddings}")
def v_other_vectors(embeddings: DataFrame) -> DataFrame:
    halves = F.concat(F.slice("embedding", 33, 32), F.slice("embedding", 1, 32))
    return embeddings.select(F.col("vec_id").alias("doc_id"), halves.alias("vector"))


@query("R9", rrf_sql({
    "bm25": bm25_sql("{v_queries}", "{documents}", "doc_id", "text", 20),
    "model_a": vector_sql("{v_queries}", "{v_doc_vectors}", "doc_id", 20),
    "model_b": vector_sql("{v_queries}", "{v_other_vectors}", "doc_id", 20),
}, "doc_id", 10))
def multi_model_fusion(v_queries: DataFrame, documents: DataFrame, v_doc_vectors: DataFrame, v_other_vectors: DataFrame) -> DataFrame:
    lists = {
        "bm25": retrieval.bm25_topk(v_queries, documents, 20),
        "model_a": retrieval.vector_topk(v_queries, v_doc_vectors, 20),
        "model_b": retrieval.vector_topk(v_queries, v_other_vectors, 20),
    }
    return retrieval.rrf_many(lists, "doc_id", 10)


@built_view(f"""
SELECT h.query_id, h.chunk_id, c.doc_id, h.score, h.rank, c.content
FROM ({bm25_sql("{v_queries}", "{v_chunks}", "chunk_id", "content", 20)}) h JOIN {{v_chunks}} c USING (chunk_id)
""")
def v_hits(v_queries: DataFrame, v_chunks: DataFrame) -> DataFrame:
    top = retrieval.bm25_topk(v_queries, v_chunks, 20, "chunk_id", "content")
    return top.join(v_chunks.select("chunk_id", "doc_id", "content"), "chunk_id")


GROUPED = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first_rank) AS doc_rank FROM (
  SELECT query_id, doc_id, max(score) AS score, min(rank) AS first_rank, count(*) AS n_chunks, string_agg(content, chr(10) || chr(10) ORDER BY rank) AS content
  FROM {v_hits} GROUP BY 1, 2)) WHERE doc_rank <= 5"""


@query("R10", GROUPED)
def grouped_hits(v_hits: DataFrame) -> DataFrame:
    return context.group_hits(v_hits, 5).drop("chunks")


@query("R11", """
SELECT q.query_id, c.doc_id, c.chunk_id, coalesce(h.rank, 0) AS matched_rank FROM (SELECT DISTINCT query_id, doc_id FROM {v_hits}) q
JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id) AS rn FROM {v_chunks}) c ON c.doc_id = q.doc_id
LEFT JOIN {v_hits} h ON h.query_id = q.query_id AND h.chunk_id = c.chunk_id WHERE rn <= 20 OR h.rank IS NOT NULL
""")
def capped_chunks(v_chunks: DataFrame, v_hits: DataFrame) -> DataFrame:
    return context.cap_chunks(v_chunks, v_hits, 20)


NEIGHBORS = """
WITH p AS (SELECT doc_id, chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id) AS pos FROM {v_chunks})
SELECT DISTINCT h.query_id, b.doc_id, b.chunk_id FROM {v_hits} h JOIN p a ON a.chunk_id = h.chunk_id
JOIN p b ON b.doc_id = a.doc_id AND b.pos BETWEEN a.pos - 2 AND a.pos + 2
"""


@query("R12", NEIGHBORS)
def neighbor_chunks(v_chunks: DataFrame, v_hits: DataFrame) -> DataFrame:
    return context.expand_neighbors(v_chunks, v_hits, 2)


@query("R13", f"""
WITH c AS (SELECT query_id, doc_id, doc_rank AS rank, content FROM ({GROUPED})),
d AS (SELECT t.query_id, t.doc_id, t.rank, d.text AS content FROM ({bm25_sql("{v_queries}", "{documents}", "doc_id", "text", 10)}) t JOIN {{documents}} d USING (doc_id)),
f AS ({rrf_sql({"chunk": "SELECT * FROM c", "doc": "SELECT * FROM d"}, "doc_id", 10)})
SELECT f.query_id, f.doc_id, f.score, f.chunk_rank, f.doc_rank, f.rank, coalesce(c.content, d.content) AS content
FROM f LEFT JOIN c ON c.query_id = f.query_id AND c.doc_id = f.doc_id LEFT JOIN d ON d.query_id = f.query_id AND d.doc_id = f.doc_id
""")
def fused_levels(v_queries: DataFrame, documents: DataFrame, v_hits: DataFrame) -> DataFrame:
    chunk_docs = context.group_hits(v_hits, 5).select("query_id", "doc_id", F.col("doc_rank").alias("rank"), "content")
    doc_docs = retrieval.bm25_topk(v_queries, documents, 10).join(documents.select("doc_id", F.col("text").alias("content")), "doc_id")
    return context.fuse_levels(chunk_docs, doc_docs, 10)


@query("R14", """
SELECT doc_id, title FROM {v_docs} WHERE NOT contains(coalesce(status, ''), 'deleting') AND space_id = 2 AND doc_type IN ('FILE', 'CRAWLED_URL')
AND updated_at >= TS'2024-01-05 00:00:00' AND updated_at <= TS'2024-02-05 00:00:00'
""")
def scoped_documents(v_docs: DataFrame) -> DataFrame:
    return context.scope(v_docs, 2, ["FILE", "CRAWLED_URL"], "2024-01-05 00:00:00", "2024-02-05 00:00:00").select("doc_id", "title")


@query("R15", """
WITH n AS (SELECT doc_id, title FROM {v_docs} ORDER BY updated_at DESC, doc_id LIMIT 10),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id) AS chunk_no FROM {v_chunks} WHERE doc_id IN (SELECT doc_id FROM n))
SELECT n.doc_id, n.title, c.chunk_id, c.content, c.chunk_no, 0.0::DOUBLE AS score FROM n JOIN c USING (doc_id) WHERE chunk_no <= 5
""")
def recent_documents(v_docs: DataFrame, v_chunks: DataFrame) -> DataFrame:
    return context.browse_recent(v_docs, v_chunks, 10).select("doc_id", "title", "chunk_id", "content", "chunk_no", "score")


@query("R16", """
SELECT query_id, d.doc_id, pos, title FROM (SELECT query_id, doc_id, min(pos) AS pos FROM (
  SELECT query_id, unnest([query_id + 7, query_id, query_id + 7, -1]) AS doc_id, unnest([0, 1, 2, 3]) AS pos FROM {v_queries}) GROUP BY 1, 2) a
JOIN {v_docs} d USING (doc_id)
""")
def mentioned_documents(v_queries: DataFrame, v_docs: DataFrame) -> DataFrame:
    q = F.col("query_id")
    asked = v_queries.select("query_id", F.array(q + 7, q, q + 7, F.lit(-1).cast("bigint")).alias("ids"))
    return context.fetch_ordered(v_docs.select("doc_id", "title"), asked)


@query("R17", """
WITH a AS (SELECT query_id, doc_id, score, content, 0 AS s FROM {v_hits} UNION ALL SELECT query_id, doc_id, score / 2, content, 1 FROM {v_hits}
           UNION ALL SELECT query_id, NULL, score / 4, content, 2 FROM {v_hits}),
k AS (SELECT *, coalesce('id:' || doc_id, 'text:' || trim(content, ' ' || chr(9) || chr(10) || chr(13))) AS k FROM a),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, k ORDER BY s, score DESC, content) AS rn FROM k)
SELECT query_id, coalesce(doc_id, -1) AS doc_id, round(score, 8) AS score, content, CAST(s AS INT) AS source_no FROM r WHERE rn = 1
""")
def merged_results(v_hits: DataFrame) -> DataFrame:
    base = v_hits.select("query_id", "doc_id", "score", "content")
    web = base.select("query_id", F.lit(None).cast("bigint").alias("doc_id"), (F.col("score") / 4).alias("score"), "content")
    return context.merge_results([base, base.withColumn("score", F.col("score") / 2), web]).withColumn("score", F.round("score", 8)).withColumn("doc_id", F.coalesce("doc_id", F.lit(-1)))


@query("R18", """
WITH s AS (SELECT h.query_id, h.chunk_id, h.rank AS old_rank, round(len(list_intersect(
    list_distinct(regexp_extract_all(lower(q.query), '[a-z0-9]+')), list_distinct(regexp_extract_all(lower(h.content), '[a-z0-9]+'))))
    / len(list_distinct(regexp_extract_all(lower(h.content), '[a-z0-9]+'))), 6) AS score FROM {v_hits} h JOIN {v_queries} q USING (query_id))
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old_rank) AS rank FROM s
""")
def reranked_hits(v_queries: DataFrame, v_hits: DataFrame) -> DataFrame:
    pairs = v_hits.join(v_queries.select("query_id", "query"), "query_id")
    q, c = F.array_distinct(T.tokens("query")), F.array_distinct(T.tokens("content"))
    out = retrieval.rerank(pairs, F.size(F.array_intersect(q, c)) / F.size(c), "chunk_id")
    return out.select("query_id", "chunk_id", "old_rank", "score", "rank")


PACK_ROWS = f"""
SELECT h.query_id, h.doc_id, g.doc_rank - 1 AS doc_rank, d.doc_type, d.title, 'https://docs.example/' || h.doc_id AS url, h.chunk_id,
       row_number() OVER (PARTITION BY h.query_id, h.doc_id ORDER BY h.rank) AS chunk_no, trim(h.content, ' ' || chr(9) || chr(10) || chr(13)) AS body
FROM {{v_hits}} h JOIN ({GROUPED.replace("doc_rank <= 5", "doc_rank <= 20")}) g ON g.query_id = h.query_id AND g.doc_id = h.doc_id JOIN {{v_docs}} d ON d.doc_id = h.doc_id"""


def pack_rows(v_hits: DataFrame, v_docs: DataFrame) -> DataFrame:
    grouped = context.group_hits(v_hits, 20)
    chunks = grouped.select(
        "query_id", "doc_id", (F.col("doc_rank") - 1).alias("doc_rank"), F.posexplode("chunks").alias("pos", "c")
    )
    return chunks.join(v_docs.select("doc_id", "doc_type", "title"), "doc_id").select(
        "query_id", "doc_id", "doc_rank", "doc_type", "title", F.concat(F.lit("https://docs.example/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("c.chunk_id").alias("chunk_id"), (F.col("pos") + 1).alias("chunk_no"), F.col("c.content").alias("content"),
    )


@query("R19", f"""
WITH r AS ({PACK_ROWS}),
c AS (SELECT *, '  <chunk id=''' || chunk_id || '''><![CDATA[' || CASE WHEN length(body) > 400 THEN substr(body, 1, 400) || chr(10) || '...(truncated)' ELSE body END || ']]></chunk>' AS x FROM r
      WHERE body <> '' AND chunk_no <= greatest(floor((floor(6000 * (0.40::DOUBLE / (1 + doc_rank * 0.35::DOUBLE))) - 500) / 400), 3)),
d AS (SELECT query_id, doc_rank, '<document>' || chr(10) || '<document_metadata>' || chr(10) || '  <document_id>' || doc_id || '</document_id>' || chr(10) || '  <document_type>' || doc_type
        || '</document_type>' || chr(10) || '  <title><![CDATA[' || title || ']]></title>' || chr(10) || '  <url><![CDATA[' || url || ']]></url>' || chr(10)
        || '  <metadata_json><![CDATA[' || chr(123) || chr(125) || ']]></metadata_json>' || chr(10) || '</document_metadata>' || chr(10) || chr(10) || '<document_content>' || chr(10)
        || string_agg(x, chr(10) ORDER BY chunk_no) || chr(10) || '</document_content>' || chr(10) || '</document>' || chr(10) AS xml
      FROM c GROUP BY query_id, doc_id, doc_rank, doc_type, title, url),
u AS (SELECT *, sum(length(xml)) OVER (PARTITION BY query_id ORDER BY doc_rank) AS used, row_number() OVER (PARTITION BY query_id ORDER BY doc_rank) - 1 AS idx FROM d),
g AS (SELECT query_id, count(*) AS n_docs, count(*) FILTER (used <= 6000) AS n_fit, string_agg(xml, chr(10) ORDER BY idx) FILTER (used <= 6000 OR idx = 0) AS t,
        count(*) FILTER (used <= 6000 OR idx = 0) AS n_kept FROM u GROUP BY 1),
s AS (SELECT query_id, n_docs, n_kept, trim(CASE WHEN n_fit < n_docs THEN t || chr(10) || '<!-- Output truncated: ' || (n_docs - n_fit)
        || ' more document(s) omitted (budget 6000 chars). Refine your query or reduce top_k to retrieve different results. -->' ELSE t END, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM g)
SELECT query_id, n_docs, n_kept, CASE WHEN length(t) > 6000 THEN substr(t, 1, 6000 - 60) || chr(10) || '<!-- ...output forcibly truncated to fit context window -->' ELSE t END AS context FROM s
""")
def packed_context(v_hits: DataFrame, v_docs: DataFrame) -> DataFrame:
    return context.pack_context(pack_rows(v_hits, v_docs), 6000, 400)


@query("R20", f"""
WITH k AS (SELECT n.query_id, n.doc_id, n.chunk_id, d.title, h.chunk_id IS NOT NULL AS matched, trim(c.content, ' ' || chr(9) || chr(10) || chr(13)) AS body
  FROM ({NEIGHBORS}) n JOIN {{v_chunks}} c ON c.chunk_id = n.chunk_id JOIN {{v_docs}} d ON d.doc_id = n.doc_id LEFT JOIN {{v_hits}} h ON h.query_id = n.query_id AND h.chunk_id = n.chunk_id),
x AS (SELECT *, '  <chunk id=''' || chunk_id || '''><![CDATA[' || body || ']]></chunk>' AS x FROM k WHERE body <> ''),
l AS (SELECT *, length(x) - length(replace(x, chr(10), '')) + 1 AS n, count(*) OVER (PARTITION BY query_id, doc_id) AS cnt FROM x),
e AS (SELECT *, sum(n) OVER (PARTITION BY query_id, doc_id ORDER BY chunk_id) + cnt + 12 AS e FROM l)
SELECT query_id, doc_id, '<document>' || chr(10) || '<document_metadata>' || chr(10) || '  <document_id>' || doc_id || '</document_id>' || chr(10) || '  <document_type>FILE</document_type>' || chr(10)
  || '  <title><![CDATA[' || title || ']]></title>' || chr(10) || '  <metadata_json><![CDATA[' || chr(123) || chr(125) || ']]></metadata_json>' || chr(10) || '</document_metadata>' || chr(10) || chr(10) || '<chunk_index>' || chr(10)
  || string_agg('  <entry chunk_id="' || chunk_id || '" lines="' || CAST(e - n + 1 AS BIGINT) || '-' || CAST(e AS BIGINT) || '"' || CASE WHEN matched THEN ' matched="true"' ELSE '' END || '/>', chr(10) ORDER BY chunk_id)
  || chr(10) || '</chunk_index>' || chr(10) || chr(10) || '<document_content>' || chr(10) || string_agg(x, chr(10) ORDER BY chunk_id) || chr(10) || '</document_content>' || chr(10) || '</document>' AS context
FROM e GROUP BY query_id, doc_id, title
""")
def rendered_context(v_chunks: DataFrame, v_hits: DataFrame, v_docs: DataFrame) -> DataFrame:
    near = context.expand_neighbors(v_chunks, v_hits, 2).join(v_chunks.select("chunk_id", "content"), "chunk_id")
    marks = v_hits.select("query_id", "chunk_id", F.lit(True).alias("hit"))
    rows = near.join(v_docs.select("doc_id", "title"), "doc_id").join(marks, ["query_id", "chunk_id"], "left")
    return context.render_context(rows.withColumn("matched", F.coalesce("hit", F.lit(False))))


@query("R21", f"""
SELECT h.query_id, h.doc_id, h.chunk_id, d.title, 'https://docs.example/' || h.doc_id AS url, CASE WHEN length(h.content) > 200 THEN substr(h.content, 1, 200) || '...' ELSE h.content END AS preview
FROM {{v_hits}} h JOIN ({GROUPED}) g ON g.query_id = h.query_id AND g.doc_id = h.doc_id JOIN {{v_docs}} d ON d.doc_id = h.doc_id
""")
def citation_sources(v_hits: DataFrame, v_docs: DataFrame) -> DataFrame:
    docs = v_docs.withColumn("url", F.concat(F.lit("https://docs.example/"), F.col("doc_id").cast("string")))
    return context.citation_sources(context.group_hits(v_hits, 5), docs)


@query("R22", """
WITH p AS (SELECT doc_id, chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id) AS pos, count(*) OVER (PARTITION BY doc_id) AS total FROM {v_chunks})
SELECT h.cited_id, a.doc_id, a.total, a.pos AS cited_pos, greatest(a.pos - 4, 0) AS start_index, b.pos, b.chunk_id
FROM (SELECT DISTINCT chunk_id AS cited_id FROM {v_hits}) h JOIN p a ON a.chunk_id = h.cited_id JOIN p b ON b.doc_id = a.doc_id AND b.pos BETWEEN a.pos - 3 AND a.pos + 3
""")
def cited_windows(v_chunks: DataFrame, v_hits: DataFrame) -> DataFrame:
    cited = v_hits.select("chunk_id", F.col("chunk_id").alias("cited_id")).distinct()
    return context.cited_window(v_chunks, cited, 3)


@query("R23", "SELECT doc_id, idx, chunk_id, content FROM {v_chunks} WHERE doc_id = 20 ORDER BY chunk_id LIMIT 3 OFFSET 3")
def chunk_page(v_chunks: DataFrame) -> DataFrame:
    return context.page_chunks(v_chunks, 20, 1, 3)


add_view("v_targets", "SELECT query_id, query_id AS doc_id FROM {v_queries} UNION ALL SELECT query_id, query_id + 1 FROM {v_queries}")


@query("R24", f"""
WITH l AS (SELECT 'bm25' AS ranker, * FROM ({BM25_DOCS}) UNION ALL SELECT 'vector', * FROM ({VECTOR_DOCS})),
h AS (SELECT ranker, query_id, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank) AS top_items FROM l WHERE rank <= 5 GROUP BY 1, 2)
SELECT r.ranker, t.query_id, t.doc_id, coalesce(l.rank, 0) AS rank, l.score, h.top_items FROM {{v_targets}} t CROSS JOIN (VALUES ('bm25'), ('vector')) r(ranker)
LEFT JOIN l ON l.ranker = r.ranker AND l.query_id = t.query_id AND l.doc_id = t.doc_id LEFT JOIN h ON h.ranker = r.ranker AND h.query_id = t.query_id
""")
def ranker_comparison(v_queries: DataFrame, documents: DataFrame, v_doc_vectors: DataFrame, v_targets: DataFrame) -> DataFrame:
    lists = {"bm25": retrieval.bm25_topk(v_queries, documents, 50), "vector": retrieval.vector_topk(v_queries, v_doc_vectors, 50)}
    return retrieval.compare_rankers(lists, v_targets, "doc_id", 5)


add_view("v_memories", """
SELECT event_id AS memory_id, user_id AS query_id, event_type AS kind, value / 100 AS similarity, ts AS created_at,
       ts + INTERVAL '2' HOUR * (event_id % 30) AS last_accessed_at, event_id % 13 AS access_count,
       CASE event_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS importance,
       CASE WHEN event_id % 5 = 0 THEN ts + INTERVAL '10' DAY ELSE NULL END AS expires_at FROM {events}
""")


@query("R25", """
WITH s AS (SELECT query_id, memory_id, round(similarity * (1.0::DOUBLE / (1.0::DOUBLE + (epoch_us(TS'2024-02-05 00:00:00') - epoch_us(last_accessed_at)) / 3.6e9::DOUBLE / 24))
    * CASE importance WHEN 'critical' THEN 2.0::DOUBLE WHEN 'high' THEN 1.5 WHEN 'medium' THEN 1.0 ELSE 0.5 END * least(1.0::DOUBLE + access_count * 0.1::DOUBLE, 2.0), 6) AS score
  FROM {v_memories} WHERE (expires_at IS NULL OR expires_at > TS'2024-02-05 00:00:00') AND created_at >= TS'2024-01-16 00:00:00' AND importance IN ('critical', 'high', 'medium'))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM s) WHERE rank <= 10
""")
def memory_search(v_memories: DataFrame) -> DataFrame:
    return context.search_memories(v_memories, "2024-02-05 00:00:00", 10, 20, "medium").select("query_id", "memory_id", "score", "rank")


@query("R26", """
SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM {conversations}) WHERE rn <= 4
""")
def recent_turns(conversations: DataFrame) -> DataFrame:
    return context.recent_turns(conversations, 4)


@query("R27", r"""
WITH r AS (SELECT conv_id, turn, role, trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')) AS t FROM {conversations} WHERE role IN ('user', 'assistant')),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM r WHERE t <> '')
SELECT conv_id, string_agg(role || ': ' || CASE WHEN length(t) > 400 THEN rtrim(substr(t, 1, 400)) || '...' ELSE t END, chr(10) ORDER BY turn) AS dialogue FROM n WHERE rn <= 6 GROUP BY 1
""")
def rendered_dialogue(conversations: DataFrame) -> DataFrame:
    return context.render_dialogue(conversations, 6)


@query("R27", r"""
WITH r AS (SELECT conv_id, turn, role || ': ' || trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')) AS line FROM {conversations} WHERE role IN ('user', 'assistant') AND trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')) <> ''),
n AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS used FROM r)
SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS dialogue FROM n WHERE used <= 900 GROUP BY 1
""")
def dialogue_within_budget(conversations: DataFrame) -> DataFrame:
    return context.render_dialogue(conversations, budget=900)


@query("R28", """
SELECT query_id, kind, max_by(memory_id, created_at) AS memory_id, max(created_at) AS created_at FROM {v_memories}
WHERE expires_at IS NULL OR expires_at > TS'2024-01-20 00:00:00' GROUP BY 1, 2
""")
def latest_preferences(v_memories: DataFrame) -> DataFrame:
    return context.latest_by_key(context.purge(v_memories, "2024-01-20 00:00:00"), ["query_id", "kind"], "created_at", "memory_id")


@query("R28", "SELECT memory_id, kind FROM {v_memories} WHERE lower(kind) IN ('click', 'view')")
def named_entities(v_memories: DataFrame) -> DataFrame:
    return context.entities_named(v_memories, ["Click", "VIEW"], "kind").select("memory_id", "kind")


@query("R29", f"""
SELECT query_id, h.doc_id, d.title, h.score, h.rank, d.source FROM ({vector_sql("{v_queries}", "{v_doc_vectors}", "doc_id", 5)}) h JOIN {{v_docs}} d USING (doc_id)
""")
def vector_hits_with_documents(v_queries: DataFrame, v_doc_vectors: DataFrame, v_docs: DataFrame) -> DataFrame:
    return retrieval.vector_topk(v_queries, v_doc_vectors, 5).join(v_docs.select("doc_id", "title", "source"), "doc_id")
