"""Fixture views derived from the whole base tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import chunking
from corpusmill.plans.catalog import add_view, built_view

add_view("v_docs", """
SELECT doc_id, doc_id % 3 + 1 AS space_id,
       CASE doc_id % 4 WHEN 0 THEN 'FILE' WHEN 1 THEN 'CRAWLED_URL' WHEN 2 THEN 'GOOGLE_DRIVE_FILE'
            ELSE 'COMPOSIO_GOOGLE_DRIVE_CONNECTOR' END AS doc_type,
       replace(split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) || ' ' || split_part(text, ' ', 3), chr(10), ' ') AS title,
       text AS content, lang, source,
       TS'2024-01-01 00:00:00' + doc_id * INTERVAL '1' HOUR AS updated_at,
       TS'2023-12-01 00:00:00' + doc_id * INTERVAL '1' MINUTE AS created_at,
       CASE doc_id % 20 WHEN 0 THEN '{"state": "failed", "reason": "parser timeout"}' WHEN 1 THEN '{"state": "pending"}'
            WHEN 2 THEN '{"state": "processing"}' WHEN 3 THEN '{"state": "deleting"}' WHEN 4 THEN NULL
            ELSE '{"state": "ready"}' END AS status,
       doc_id % 7 AS connector_id,
       CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 100 + doc_id % 25 END AS folder_id,
       '{"k": ' || CAST(doc_id % 10 AS STRING) || ', "model": "m' || CAST(doc_id % 3 AS STRING) || '", "sizes": ["'
           || CAST(128 * (doc_id % 4 + 1) AS STRING) || '", " 64 "]}' AS metadata
FROM {documents}
""")

# The corpus as stored earlier: every document, with older texts, titles, states and identities for some of them.
add_view("v_corpus", """
SELECT doc_id, space_id, doc_type,
       CASE WHEN doc_id % 9 = 0 THEN 'gone-' ELSE 'u-' END || CAST(doc_id AS STRING) AS unique_id,
       CASE WHEN doc_id % 11 = 0 THEN title || ' (old)' ELSE title END AS title,
       CASE WHEN doc_id % 7 = 0 THEN content || ' earlier' ELSE content END AS content,
       status
FROM {v_docs}
""")

# The batch that arrives: every document, and every document with a short hash once more under a second identity.
add_view("v_batch", """
SELECT doc_id AS arrival, space_id, doc_type, 'u-' || CAST(doc_id AS STRING) AS unique_id, title, content FROM {v_docs}
UNION ALL
SELECT doc_id + 1000000000 AS arrival, space_id, doc_type, 'u-' || CAST(doc_id - doc_id % 2 AS STRING) AS unique_id, title,
       content || ' (copy)' AS content FROM {v_docs}
""")

add_view("v_folders", """
SELECT CAST(1 + r_regionkey AS BIGINT) AS folder_id, CAST(NULL AS BIGINT) AS parent_id, r_name AS name FROM {region}
UNION ALL
SELECT CAST(100 + n_nationkey AS BIGINT), CAST(1 + n_regionkey AS BIGINT), n_name FROM {nation}
UNION ALL
SELECT CAST(1000 + c_custkey AS BIGINT), CAST(100 + c_nationkey AS BIGINT), c_name FROM {customer}
UNION ALL
SELECT CAST(-1 - n_nationkey AS BIGINT), CAST(CASE WHEN n_nationkey > 0 THEN -n_nationkey END AS BIGINT), 'deep ' || n_name FROM {nation}
""")

# Documents filed in the folder tree: under customers' folders, nations' folders, or at the root.
add_view("v_filed", """
SELECT doc_id, space_id, title, doc_type, updated_at,
       CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 100 + doc_id % 20 WHEN 2 THEN -20 - doc_id % 3 ELSE 1000 + doc_id % 97 END AS folder_id
FROM {v_docs}
""")

add_view("v_users", """
SELECT '00000000-0000-4000-8000-' || lpad(CAST(c_custkey AS STRING), 12, '0') AS user_id, c_name AS name FROM {customer}
""")

add_view("v_comments", """
SELECT conv_id * 1000 + turn AS comment_id, conv_id AS thread_id, conv_id * 10 + CAST(floor(turn / 4) AS BIGINT) AS message_id,
       CASE WHEN turn % 4 = 0 THEN NULL ELSE conv_id * 1000 + turn - turn % 4 END AS parent_id,
       '00000000-0000-4000-8000-' || lpad(CAST((conv_id + turn) % 60 AS STRING), 12, '0') AS author_id,
       text || ' @[00000000-0000-4000-8000-' || lpad(CAST((conv_id * 7 + turn) % 200 AS STRING), 12, '0') || '] and @['
           || '00000000-0000-4000-8000-' || lpad(CAST((conv_id * 7 + turn % 2) % 200 AS STRING), 12, '0') || ']' AS content,
       TS'2024-02-01 00:00:00' + conv_id * INTERVAL '1' HOUR + turn * INTERVAL '1' MINUTE AS created_at
FROM {conversations}
""")

add_view("v_threads", """
SELECT conv_id AS thread_id, conv_id % 3 + 1 AS space_id, conv_id % 4 = 0 AS archived,
       CASE conv_id % 6 WHEN 0 THEN NULL ELSE 'user' || CAST(conv_id % 6 AS STRING) END AS created_by,
       CASE WHEN conv_id % 3 = 0 THEN 'PRIVATE' ELSE 'SEARCH_SPACE' END AS visibility,
       min_by(split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2), turn) AS title,
       max(TS'2024-02-01 00:00:00' + conv_id * INTERVAL '1' HOUR + turn * INTERVAL '1' MINUTE) AS updated_at,
       count(*) AS n_turns
FROM {conversations} GROUP BY conv_id
""")

add_view("v_logs", """
SELECT event_id AS log_id, user_id % 3 + 1 AS space_id, ts AS created_at,
       CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'IN_PROGRESS' ELSE 'SUCCESS' END AS status,
       CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_id % 5 = 0 THEN 'WARNING' ELSE 'INFO' END AS level,
       CASE WHEN event_id % 6 = 0 THEN NULL ELSE 'task_' || event_type END AS source,
       'message ' || CAST(event_id AS STRING) AS message,
       CASE WHEN event_id % 10 = 0 THEN NULL ELSE '{"task_name": "' || event_type || '", "document_id": ' || CAST(user_id AS STRING) || '}' END AS metadata
FROM {events}
""")

add_view("v_notif", """
SELECT event_id AS notif_id, user_id, ts AS created_at, event_id % 3 = 0 AS read, user_id % 3 + 1 AS space_id,
       CASE event_type WHEN 'view' THEN 'new_mention' WHEN 'click' THEN 'comment_reply' WHEN 'error' THEN 'connector_indexing'
            WHEN 'signup' THEN 'document_processing' ELSE 'connector_deletion' END AS type,
       CASE WHEN event_type IN ('error', 'purchase') THEN '{"connector_type": "C' || CAST(user_id % 4 AS STRING) || '", "connector_id": '
                 || CAST(user_id % 7 AS STRING) || ', "status": "' || CASE WHEN event_id % 2 = 0 THEN 'in_progress' ELSE 'completed' END || '"}'
            WHEN event_type = 'signup' THEN '{"document_type": "T' || CAST(event_id % 3 AS STRING) || '"}' ELSE NULL END AS metadata
FROM {events}
""")

add_view("v_calls", """
SELECT event_id AS call_id, ts, user_id, user_id AS thread_id, event_type AS model, CAST(floor(event_id / 5) AS BIGINT) AS turn_id,
       CAST(floor(value * 10) AS BIGINT) AS prompt_tokens, event_id % 100 AS completion_tokens,
       CAST(floor(value * 1000) AS BIGINT) AS cost_micros,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(floor(event_id / 2) AS BIGINT) END AS message_id,
       event_type || ':' || CAST(user_id % 2 AS STRING) AS signature
FROM {events}
""")

add_view("v_msgs", """
SELECT conv_id * 1000 + turn AS msg_id, conv_id % 7 AS channel_id, conv_id * 1000 + turn AS msg_ts,
       CAST(TS'2024-03-01 00:00:00' + conv_id * INTERVAL '1' MINUTE + turn * INTERVAL '1' SECOND AS STRING) AS sent_at,
       role AS author, text, CASE WHEN turn % 5 = 4 THEN 'channel_join' ELSE 'plain' END AS subtype
FROM {conversations}
""")

add_view("v_qa", """
SELECT o_orderkey AS qid, 'run' || CAST(o_custkey % 6 AS STRING) AS run_id, o_orderpriority AS grp,
       CASE o_orderkey % 4 WHEN 0 THEN '$' || amt || ' million' WHEN 1 THEN pct || '%' WHEN 2 THEN '($' || amt || ')'
            ELSE cnt || ' shares' END AS gold,
       CASE o_orderkey % 5
            WHEN 0 THEN CASE o_orderkey % 4 WHEN 0 THEN '$' || amt || ' million' WHEN 1 THEN pct || '%' WHEN 2 THEN '($' || amt || ')' ELSE cnt || ' shares' END
            WHEN 1 THEN '$' || CAST(CAST(o_totalprice AS DECIMAL(18, 2)) * CAST(0.001 AS DECIMAL(4, 3)) AS STRING) || ' billion in total'
            WHEN 2 THEN '$' || CAST(CAST(o_totalprice AS DECIMAL(18, 2)) * CAST(1.005 AS DECIMAL(4, 3)) AS STRING) || ' million'
            WHEN 3 THEN 'I need to read more'
            ELSE 'Tool read_file completed the value is ' || amt || ' million dollars and 7 days' END AS predicted,
       CASE o_orderkey % 4 WHEN 1 THEN 'What percentage of orders were urgent?' WHEN 3 THEN 'When was the change?' ELSE 'What was the amount?' END AS question,
       o_totalprice / 100 AS latency_ms, CAST(floor(o_totalprice) AS BIGINT) AS cost_micros,
       CASE WHEN o_orderkey % 17 = 0 THEN 'timeout' ELSE NULL END AS error
FROM (SELECT *, CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS STRING) AS amt, CAST(o_custkey % 100 AS STRING) || '.5' AS pct,
             CAST(o_custkey AS STRING) AS cnt FROM {orders}) o
""")

# One small Markdown table with prose before and after it, per part.
add_view("v_tables", """
SELECT p_partkey AS doc_id,
       'Net revenue for ' || p_name || ':' || chr(10) || chr(10) || 'Amounts in millions' || chr(10)
       || '| Item | 2024 | 2025 |' || chr(10) || '|---|:--|---|' || chr(10)
       || '| Net income | $' || CAST(p_size * 10 AS STRING) || ' | ' || CAST(CAST(p_retailprice AS DECIMAL(18, 2)) AS STRING) || ' |' || chr(10)
       || '| ' || p_brand || ' | (' || CAST(p_size AS STRING) || ') | ' || CAST(p_partkey % 3 AS STRING) || ' |' || chr(10)
       || chr(10) || 'Cash was $' || CAST(p_size AS STRING) || '.5 million in total; tax expense grew by 4.5% to 12 million. Other text follows here.' || chr(10) AS content
FROM {part}
""")


@built_view("""
SELECT doc_id, idx, doc_id * 1000000 + idx AS chunk_id, content FROM (
  SELECT doc_id, unnest(l) AS content, generate_subscripts(l, 1) - 1 AS idx FROM (
    SELECT doc_id, list_filter(list_transform(range(0, CASE WHEN length(text) <= 800 THEN 1 ELSE 1 + CAST(ceil((length(text) - 800) / 700.0) AS BIGINT) END),
      lambda i: trim(substr(text, CAST(i * 700 + 1 AS BIGINT), 800), chr(32) || chr(9) || chr(10) || chr(13))), lambda s: s <> '') AS l
    FROM {documents} WHERE length(text) > 0))
""")
def v_chunks(documents: DataFrame) -> DataFrame:
    chunks = chunking.chunk_chars(documents, 800, 100)
    return chunks.select(
        "doc_id", "idx", (F.col("doc_id") * 1000000 + F.col("idx")).alias("chunk_id"), "content"
    )


# Passages to look up, each with the vector of the same number.
add_view("v_queries", """
SELECT item_id AS query_id, text AS query, embedding AS vector FROM {benchmark} JOIN {embeddings} ON item_id = vec_id
""")

add_view("v_doc_vectors", """
SELECT vec_id AS doc_id, embedding AS vector, label FROM {embeddings}
""")
