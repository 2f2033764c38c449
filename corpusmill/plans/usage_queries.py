"""Usage, operations and relational reports (O)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import models
from corpusmill.operators import folders, search, usage
from corpusmill.plans.catalog import add_view, built_view, query

add_view("v_members", """
SELECT c_nationkey % 3 + 1 AS space_id, 'user' || CAST(c_custkey % 40 AS STRING) AS user_id FROM {customer} WHERE c_acctbal > 5000
UNION SELECT 2, 'user7' FROM {region}
""")


@query("O1", """
SELECT doc_type, count(*) AS n FROM {v_docs} WHERE space_id IN (SELECT space_id FROM {v_members} WHERE user_id = 'user7') GROUP BY 1
""")
def type_counts(v_docs: DataFrame, v_members: DataFrame) -> DataFrame:
    return usage.type_counts(v_docs, v_members.where("user_id = 'user7'"))


@query("O2", """
SELECT doc_id, title, doc_type, updated_at, t AS total, t > 30 AS has_more FROM (SELECT *, count(*) OVER () AS t FROM {v_docs} WHERE space_id = 1 AND folder_id IS NULL AND doc_type IN ('FILE', 'CRAWLED_URL'))
ORDER BY title DESC, doc_id LIMIT 15 OFFSET 15
""")
def document_list(v_docs: DataFrame) -> DataFrame:
    return usage.list_docs(v_docs, 1, ["FILE", "CRAWLED_URL"], "root", "title", True, 1, 15)


@query("O3", "SELECT doc_id, coalesce(json_extract_string(status, '$.state'), 'ready') AS state FROM {v_docs} WHERE doc_id IN (SELECT doc_id FROM {labels})")
def document_status(v_docs: DataFrame, labels: DataFrame) -> DataFrame:
    return usage.doc_status(v_docs, labels)


NOW, SINCE = "2024-01-20 12:00:00", "TS'2024-01-20 12:00:00' - INTERVAL '72' HOUR"


@query("O4", f"""
WITH l AS (SELECT * FROM {{v_logs}} WHERE created_at >= {SINCE})
SELECT 'status' AS kind, status AS value, count(*) AS n FROM l GROUP BY 2 UNION ALL SELECT 'level', level, count(*) FROM l GROUP BY 2
UNION ALL SELECT 'source', source, count(*) FROM l WHERE source IS NOT NULL GROUP BY 2
""")
def log_counts(v_logs: DataFrame) -> DataFrame:
    return usage.log_counts(v_logs, NOW, 72)


TASK = "coalesce(json_extract_string(metadata, '$.task_name'), 'Unknown') AS task_name"


@query("O4", f"SELECT log_id, {TASK}, message, created_at, source FROM {{v_logs}} WHERE created_at >= {SINCE} AND status = 'IN_PROGRESS'")
def active_tasks(v_logs: DataFrame) -> DataFrame:
    return usage.active_tasks(v_logs, NOW, 72)


@query("O4", f"SELECT log_id, {TASK}, message, created_at, source FROM {{v_logs}} WHERE created_at >= {SINCE} AND status = 'FAILED' ORDER BY created_at DESC, log_id LIMIT 10")
def recent_failures(v_logs: DataFrame) -> DataFrame:
    return usage.recent_failures(v_logs, NOW, 72)


@query("O5", """
SELECT log_id, message FROM {v_logs} WHERE level = 'WARNING' AND status = 'SUCCESS' AND contains(lower(source), 'task_c') AND created_at BETWEEN TS'2024-01-05 00:00:00' AND TS'2024-01-25 00:00:00'
AND space_id IN (SELECT space_id FROM {v_members} WHERE user_id = 'user7')
""")
def filtered_logs(v_logs: DataFrame, v_members: DataFrame) -> DataFrame:
    mine = v_members.where("user_id = 'user7'")
    return usage.filter_logs(v_logs, mine, "WARNING", "SUCCESS", "TASK_C", "2024-01-05 00:00:00", "2024-01-25 00:00:00").select("log_id", "message")


@query("O6", """
WITH n AS (SELECT user_id, type IN ('new_mention', 'comment_reply') AS c, created_at > TS'2024-01-30 00:00:00' - INTERVAL '14' DAY AS r FROM {v_notif} WHERE NOT read)
SELECT user_id, count(*) FILTER (c) AS comments_total, count(*) FILTER (c AND r) AS comments_recent, count(*) FILTER (NOT c) AS status_total, count(*) FILTER (NOT c AND r) AS status_recent FROM n GROUP BY 1
""")
def unread_counts(v_notif: DataFrame) -> DataFrame:
    return usage.unread_counts(v_notif, "2024-01-30 00:00:00")


@query("O7", """
SELECT category || ':' || t AS key, t AS source_type, category, count(*) AS n FROM (
  SELECT 'connector' AS category, json_extract_string(metadata, '$.connector_type') AS t FROM {v_notif} WHERE type IN ('connector_indexing', 'connector_deletion')
  UNION ALL SELECT 'document', json_extract_string(metadata, '$.document_type') FROM {v_notif} WHERE type = 'document_processing') WHERE t IS NOT NULL GROUP BY 1, 2, 3
""")
def source_types(v_notif: DataFrame) -> DataFrame:
    return usage.source_types(v_notif)


@query("O8", "SELECT connector_id, count(*) FILTER (NOT contains(coalesce(status, ''), 'deleting')) AS n_active, max(updated_at) AS last_update FROM {v_docs} GROUP BY 1")
def sync_stats(v_docs: DataFrame) -> DataFrame:
    return usage.sync_stats(v_docs)


@query("O9", """
SELECT coalesce(turn_id, -1) AS turn_id, CASE WHEN grouping(model) = 1 THEN '(all)' ELSE model END AS model, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
  CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(cost_micros) AS BIGINT) AS cost_micros, count(*) AS n_calls FROM {v_calls} GROUP BY ROLLUP (turn_id, model)
""")
def usage_by_model(v_calls: DataFrame) -> DataFrame:
    return usage.usage_by_model(v_calls)


@query("O10", """
WITH old AS (SELECT message_id FROM {v_calls} WHERE model = 'view' AND message_id IS NOT NULL), f AS (SELECT * FROM {v_calls} WHERE model <> 'view' AND (message_id IS NULL OR message_id NOT IN (SELECT message_id FROM old)))
SELECT call_id, model FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY call_id) AS rn FROM f) WHERE rn = 1 OR message_id IS NULL
""")
def inserted_usage(v_calls: DataFrame) -> DataFrame:
    return usage.insert_usage(v_calls.where("model <> 'view'"), v_calls.where("model = 'view'")).select("call_id", "model")


add_view("v_ledger_events", """
SELECT user_id, event_id AS seq, CASE WHEN event_id % 2 = 0 THEN 'reserve' ELSE 'settle' END AS kind, CAST(floor(value * 1000) AS BIGINT) AS reserve_micros, CAST(floor(value * 700) AS BIGINT) AS actual_micros FROM {events}
""")
add_view("v_limits", "SELECT user_id, 200000 + user_id * 5000 AS limit_micros FROM {events} GROUP BY user_id")


@query("O11", """
WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS i FROM {v_ledger_events} JOIN {v_limits} USING (user_id)),
r(user_id, i, seq, allowed, status, used, reserved, lim) AS (SELECT user_id, 0::BIGINT, -1::BIGINT, TRUE, '', 0::BIGINT, 0::BIGINT, limit_micros FROM {v_limits}
  UNION ALL SELECT user_id, i, seq, allowed, CASE WHEN NOT allowed OR held >= lim THEN 'BLOCKED' WHEN held >= floor(lim * 0.8) THEN 'WARNING' ELSE 'OK' END, used, reserved, lim
  FROM (SELECT *, CASE WHEN kind = 'reserve' THEN used + reserved ELSE used END AS held FROM (SELECT e.user_id, e.i, e.seq, e.kind, r.lim, e.kind = 'settle' OR r.used + r.reserved + e.reserve_micros <= r.lim AS allowed,
      CASE WHEN e.kind = 'settle' THEN r.used + e.actual_micros ELSE r.used END AS used,
      CASE WHEN e.kind = 'settle' THEN greatest(0, r.reserved - e.reserve_micros) WHEN r.used + r.reserved + e.reserve_micros <= r.lim THEN r.reserved + e.reserve_micros ELSE r.reserved END AS reserved
    FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)))
SELECT user_id, seq, allowed, status, used, reserved, greatest(0, lim - used - reserved) AS remaining FROM r WHERE i > 0
""")
def credit_ledger(v_ledger_events: DataFrame, v_limits: DataFrame) -> DataFrame:
    return usage.credit_ledger(v_ledger_events, v_limits)


add_view("v_models", """
SELECT p_partkey AS seq, CASE p_partkey % 6 WHEN 0 THEN 'openai/' WHEN 1 THEN 'qwen/' WHEN 2 THEN 'Liquid/' WHEN 3 THEN 'minimax/' WHEN 4 THEN 'nobody/' ELSE '' END || replace(p_name, ' ', '-')
         || CASE WHEN p_partkey % 11 = 0 THEN '-preview' ELSE '' END AS model, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE 1700000000 - p_partkey * 50000 END AS created,
       p_size * 0.0000004 AS prompt, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size * 0.0000002 END AS completion, p_size * 25000 AS context, p_brand, p_size, p_partkey % 4 AS k FROM {part}
""")
PARAMS = "CASE k WHEN 0 THEN {a}'tools', 'reasoning'{b} WHEN 1 THEN {a}'response_format'{b} WHEN 2 THEN {a}'tools', 'structured_outputs', 'include_reasoning'{b} ELSE NULL END"


@query("O12", f"""
WITH m AS (SELECT *, {PARAMS.format(a='[', b=']')} AS params, (CAST(prompt AS DOUBLE) + coalesce(CAST(completion AS DOUBLE), 0)) * 1000000 AS price, greatest(0, (1700000000 - created) // 86400) AS age FROM {{v_models}})
SELECT seq, CAST(greatest(0, least(100, CASE WHEN NOT contains(model, '/') THEN 0 WHEN model LIKE 'openai%' THEN 50 WHEN model LIKE 'qwen%' THEN 38 WHEN model LIKE 'Liquid%' THEN 18 WHEN model LIKE 'minimax%' THEN 28 ELSE 15 END
  + CASE WHEN created IS NULL OR created <= 0 THEN 0 WHEN age <= 60 THEN 20 WHEN age <= 180 THEN 16 WHEN age <= 365 THEN 12 WHEN age <= 540 THEN 9 WHEN age <= 730 THEN 6 WHEN age <= 1095 THEN 3 ELSE 0 END
  + CASE WHEN price >= 20 THEN 15 WHEN price >= 5 THEN 12 WHEN price >= 1 THEN 9 WHEN price >= 0.3 THEN 6 WHEN price >= 0.05 THEN 4 WHEN price > 0 THEN 2 ELSE 0 END
  + CASE WHEN context >= 1000000 THEN 10 WHEN context >= 400000 THEN 8 WHEN context >= 200000 THEN 6 WHEN context >= 128000 THEN 4 WHEN context >= 100000 THEN 2 ELSE 0 END
  + CASE k WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 5 ELSE 0 END + CASE WHEN model LIKE '%-preview' THEN -10 ELSE 0 END)) AS INT) AS score FROM m
""")
def model_scores(v_models: DataFrame) -> DataFrame:
    rows = v_models.withColumn("params", F.expr(PARAMS.format(a="array(", b=")"))).withColumn("prompt", F.col("prompt").cast("double")).withColumn("completion", F.col("completion").cast("double"))
    return rows.select("seq", models.quality_score("model", "created", "prompt", "completion", "context", "params", 1_700_000_000).alias("score"))


add_view("v_endpoints", """
SELECT l_suppkey % 97 AS model, CASE WHEN l_suppkey % 97 < 10 THEN 1 WHEN l_linenumber = 1 THEN NULL ELSE l_linenumber % 3 END AS status, CASE WHEN l_suppkey % 97 % 3 = 0 THEN NULL ELSE l_tax + 0.9 END AS up_30m,
       CASE WHEN l_linenumber % 2 = 0 THEN -1.0 ELSE 80 + l_quantity / 4 END AS up_5m, CASE WHEN l_suppkey % 97 % 6 = 0 THEN NULL ELSE l_discount + 0.8 END AS up_1d FROM {lineitem}
""")


@query("O13", """
WITH p AS (SELECT model, status, CASE WHEN up_5m < 0 THEN NULL WHEN up_5m <= 1 THEN up_5m * 100 ELSE up_5m END AS m5, CASE WHEN up_30m < 0 THEN NULL WHEN up_30m <= 1 THEN up_30m * 100.0::DOUBLE ELSE up_30m END AS m30,
    CASE WHEN up_1d < 0 THEN NULL WHEN up_1d <= 1 THEN up_1d * 100.0::DOUBLE ELSE up_1d END AS d1 FROM {v_endpoints}),
g AS (SELECT model, coalesce(bool_or(status = 0), FALSE) AS ok, max(m5) AS m5, max(m30) AS m30, max(d1) AS d1 FROM p GROUP BY 1),
b AS (SELECT *, coalesce(m30, d1, m5) AS best, coalesce(m5, m30, d1) AS fresh FROM g), h AS (SELECT *, NOT ok OR best IS NULL OR best < 90 AS gated FROM b)
SELECT model, gated, CASE WHEN NOT gated THEN round(greatest(0, least(100, 0.5::DOUBLE * best + 30 + 0.2::DOUBLE * fresh)), 6) END AS health FROM h
""")
def endpoint_health(v_endpoints: DataFrame) -> DataFrame:
    return models.endpoint_health(v_endpoints)


add_view("v_configs", "SELECT p_partkey AS config_id, CASE WHEN p_partkey % 50 = 1 THEN 'A' ELSE 'B' END AS tier, p_size AS score FROM {part}")


@query("O14", """
WITH a AS (SELECT * FROM {v_configs} WHERE tier = 'A' ORDER BY score DESC, config_id LIMIT 5), t AS (SELECT *, row_number() OVER (ORDER BY score DESC, config_id) - 1 AS idx, count(*) OVER () AS n FROM a),
h AS (SELECT thread_id, CAST('0x' || substr(sha256('auto_fastest:' || thread_id), 1, 16) AS UBIGINT) AS h FROM {v_threads})
SELECT h.thread_id, t.config_id FROM h JOIN t ON t.idx = h.h % t.n
""")
def spread_picks(v_configs: DataFrame, v_threads: DataFrame) -> DataFrame:
    return usage.spread_pick(v_configs, v_threads)


@query("O15", """
SELECT space_id, count(DISTINCT user_id) AS n_members FROM {v_members} WHERE space_id IN (SELECT space_id FROM {v_members} WHERE user_id = 'user7') GROUP BY 1
""")
def my_spaces(v_members: DataFrame) -> DataFrame:
    return usage.my_spaces(v_members, "user7")


USER = "00000000-0000-4000-8000-000000000014"


@query("O16", rf"""
WITH m AS (SELECT DISTINCT comment_id FROM (SELECT comment_id, unnest(regexp_extract_all(content, '@\[([0-9a-f\-]{{36}})\]', 1)) AS u FROM {{v_comments}}) WHERE u = '{USER}')
SELECT c.comment_id, c.thread_id, t.space_id, t.title, u.name AS author, CASE WHEN length(c.content) > 100 THEN substr(c.content, 1, 100) || '...' ELSE c.content END AS preview
FROM m JOIN {{v_comments}} c USING (comment_id) JOIN {{v_threads}} t USING (thread_id) LEFT JOIN {{v_users}} u ON u.user_id = c.author_id ORDER BY c.created_at DESC, c.comment_id DESC LIMIT 50
""")
def mention_feed(v_comments: DataFrame, v_threads: DataFrame, v_users: DataFrame) -> DataFrame:
    return usage.mention_feed(search.mentions(v_comments), v_comments, v_threads, v_users, USER)


@query("O17", """
SELECT DISTINCT thread_id, author_id AS user_id FROM {v_comments} c WHERE NOT EXISTS (SELECT 1 FROM {v_comments} x WHERE x.thread_id = c.thread_id AND x.parent_id IS NULL AND x.author_id = c.author_id)
""")
def participants(v_comments: DataFrame) -> DataFrame:
    starters = v_comments.where("parent_id IS NULL").select("thread_id", F.col("author_id").alias("user_id"))
    return usage.participants(v_comments, starters)


@query("O18", """
SELECT thread_id, title FROM {v_threads} WHERE contains(lower(title), 'th') AND (created_by = 'user3' OR visibility = 'SEARCH_SPACE' OR created_by IS NULL)
""")
def thread_search(v_threads: DataFrame) -> DataFrame:
    return usage.search_threads(v_threads, "user3", "TH", owner=True).select("thread_id", "title")


@query("O19", "SELECT thread_id, title FROM {v_threads} WHERE thread_id IN (SELECT thread_id FROM {v_comments} WHERE parent_id IS NOT NULL)")
def commented_threads(v_threads: DataFrame, v_comments: DataFrame) -> DataFrame:
    return usage.threads_with_comments(v_threads, v_comments.where("parent_id IS NOT NULL")).select("thread_id", "title")


@query("O20", """
SELECT conv_id AS thread_id, sha256('[' || string_agg(to_json(struct_pack(content := text, id := turn, role := role)), ',' ORDER BY turn) || ']') AS content_hash FROM {conversations} GROUP BY 1
""")
def snapshot_hashes(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("id"), "role", F.col("text").alias("content"))
    return usage.snapshot_hash(rows)


ANCESTORS = """
WITH RECURSIVE a(folder_id, ancestor_id, d) AS (SELECT folder_id, folder_id, 0 FROM {v_folders} UNION ALL
  SELECT a.folder_id, f.parent_id, a.d + 1 FROM a JOIN {v_folders} f ON f.folder_id = a.ancestor_id WHERE f.parent_id IS NOT NULL)"""


@query("O21", ANCESTORS + """
SELECT x.folder_id, x.depth, y.subtree_depth, y.subtree_size FROM (SELECT folder_id, CAST(max(d) + 1 AS BIGINT) AS depth FROM a GROUP BY 1) x
JOIN (SELECT ancestor_id, CAST(max(d) AS BIGINT) AS subtree_depth, count(*) AS subtree_size FROM a GROUP BY 1) y ON y.ancestor_id = x.folder_id
""")
def folder_depths(v_folders: DataFrame) -> DataFrame:
    return folders.depths(v_folders)


@query("O21", ANCESTORS + " SELECT folder_id, CAST(d AS BIGINT) AS distance FROM a WHERE ancestor_id = 3")
def folder_subtree(v_folders: DataFrame) -> DataFrame:
    return folders.subtree(v_folders, 3)


add_view("v_moves", "SELECT folder_id, CASE WHEN folder_id % 2 = 0 THEN 100 + folder_id % 25 ELSE 1000 + folder_id % 50 END AS new_parent FROM {v_folders}")


@query("O21", ANCESTORS + " SELECT m.folder_id, m.new_parent, EXISTS (SELECT 1 FROM a WHERE a.folder_id = m.new_parent AND a.ancestor_id = m.folder_id) AS cycle FROM {v_moves} m")
def folder_cycles(v_folders: DataFrame, v_moves: DataFrame) -> DataFrame:
    return folders.is_cycle(v_folders, v_moves)


@query("O22", ANCESTORS + " SELECT folder_id, name FROM {v_folders} WHERE folder_id NOT IN (SELECT ancestor_id FROM a WHERE folder_id IN (SELECT folder_id FROM {v_filed}))")
def empty_folders(v_folders: DataFrame, v_filed: DataFrame) -> DataFrame:
    return folders.empty_folders(v_folders, v_filed).select("folder_id", "name")


BEATS = "SELECT notif_id FROM {v_notif} WHERE read"
STALE = f"""SELECT notif_id, CAST(json_extract_string(metadata, '$.connector_id') AS BIGINT) AS connector_id, 'failed' AS status FROM {{v_notif}}
WHERE type = 'connector_indexing' AND json_extract_string(metadata, '$.status') = 'in_progress' AND notif_id NOT IN ({BEATS})"""


@query("O23", STALE)
def stale_jobs(v_notif: DataFrame) -> DataFrame:
    return usage.stale_jobs(v_notif, v_notif.where("read"))


@query("O23", f"""
SELECT doc_id, CASE WHEN connector_id IN (SELECT connector_id FROM ({STALE})) AND json_extract_string(status, '$.state') IN ('pending', 'processing') THEN 'failed' ELSE coalesce(json_extract_string(status, '$.state'), 'ready') END AS state FROM {{v_docs}}
""")
def stuck_documents(v_notif: DataFrame, v_docs: DataFrame) -> DataFrame:
    stale = usage.stale_jobs(v_notif, v_notif.where("read"))
    return usage.fail_stuck_documents(v_docs, stale).select("doc_id", usage.I.doc_state("status").alias("state"))


@query("O24", """
SELECT source_id FROM {v_sources} WHERE enabled AND next_run_at <= TS'2024-02-10 00:00:00' AND source_id NOT IN (SELECT user_id FROM {events} WHERE event_type = 'error')
AND source_id NOT IN (SELECT s_suppkey FROM {supplier})
""")
def due_sources(v_sources: DataFrame, events: DataFrame, supplier: DataFrame) -> DataFrame:
    jobs = events.where("event_type = 'error'").select(F.col("user_id").alias("source_id"))
    return usage.due_sources(v_sources, jobs, supplier.select(F.col("s_suppkey").alias("source_id")), "2024-02-10 00:00:00").select("source_id")


@built_view("SELECT conv_id * 10 AS snapshot_id, conv_id AS thread_id, list(conv_id * 1000 + turn) AS message_ids FROM {conversations} GROUP BY conv_id")
def v_snapshots(conversations: DataFrame) -> DataFrame:
    rows = conversations.groupBy("conv_id").agg(F.collect_list(F.col("conv_id") * 1000 + F.col("turn")).alias("message_ids"))
    return rows.select((F.col("conv_id") * 10).alias("snapshot_id"), F.col("conv_id").alias("thread_id"), "message_ids")


@query("O25", "SELECT snapshot_id, thread_id FROM {v_snapshots} WHERE list_has_any(message_ids, [1001, 5002, 7000, 99999999])")
def affected_snapshots(v_snapshots: DataFrame) -> DataFrame:
    return usage.affected_snapshots(v_snapshots, [1001, 5002, 7000, 99999999]).select("snapshot_id", "thread_id")


@query("O26", "SELECT DISTINCT CAST(space_id AS BIGINT) AS space_id, 'source' AS kind, source_type AS type FROM {v_sources} UNION SELECT space_id, 'document', doc_type FROM {v_docs}")
def discovered_types(v_sources: DataFrame, v_docs: DataFrame) -> DataFrame:
    return usage.discover_types(v_sources.withColumn("space_id", F.col("space_id").cast("bigint")), v_docs)


add_view("v_deployments", """
SELECT p_partkey AS seq, CASE p_partkey % 3 WHEN 0 THEN 'AZURE_OPENAI' WHEN 1 THEN 'OpenAI' ELSE '' END AS provider, replace(p_name, ' ', '-') AS model_name,
       CASE WHEN p_partkey % 4 = 0 THEN replace(p_name, ' ', '-') ELSE lower(p_brand) END AS base_model, p_retailprice AS price FROM {part}
""")


@query("O27", """
WITH m AS (SELECT *, lower(provider) AS p FROM {v_deployments}),
a AS (SELECT seq, price, 0 AS n, base_model AS alias FROM m UNION ALL SELECT seq, price, 1, p || '/' || base_model FROM m WHERE p <> '' UNION ALL SELECT seq, price, 2, model_name FROM m WHERE model_name <> base_model
  UNION ALL SELECT seq, price, 3, p || '/' || model_name FROM m WHERE p <> '' AND model_name <> base_model UNION ALL SELECT seq, price, 4, 'azure/' || base_model FROM m WHERE p = 'azure_openai'
  UNION ALL SELECT seq, price, 5, 'azure/' || model_name FROM m WHERE p = 'azure_openai' AND model_name <> base_model)
SELECT alias, seq, price FROM (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY seq, n) AS rn FROM a) WHERE rn = 1
""")
def price_aliases(v_deployments: DataFrame) -> DataFrame:
    return usage.price_aliases(v_deployments)


@query("O28", """
WITH v AS (SELECT * FROM {v_threads} WHERE created_by = 'user3' OR visibility = 'SEARCH_SPACE')
SELECT thread_id, archived FROM (SELECT *, row_number() OVER (PARTITION BY archived ORDER BY updated_at DESC, thread_id) AS rn FROM v) WHERE archived OR rn <= 12
""")
def thread_list(v_threads: DataFrame) -> DataFrame:
    return usage.list_threads(v_threads, "user3", 12).select("thread_id", "archived")


@query("O29", """
WITH n AS (SELECT c.*, u.name AS author FROM {v_comments} c LEFT JOIN {v_users} u ON u.user_id = c.author_id),
r AS (SELECT parent_id, count(*) AS n_replies, string_agg(comment_id || ':' || coalesce(author, ''), ',' ORDER BY comment_id) AS replies FROM n WHERE parent_id IS NOT NULL GROUP BY 1)
SELECT t.message_id, t.comment_id, t.author, CAST(0 AS BIGINT) AS part, coalesce(n_replies, 0) AS n_replies, coalesce(replies, '') AS replies FROM n t LEFT JOIN r ON r.parent_id = t.comment_id WHERE t.parent_id IS NULL
""")
def comment_trees(v_comments: DataFrame, v_users: DataFrame) -> DataFrame:
    rows = usage.comment_trees(v_comments, v_users)
    line = F.transform("replies", lambda r: F.concat(r["id"].cast("string"), F.lit(":"), F.coalesce(r["author"], F.lit(""))))
    return rows.select("message_id", "comment_id", "author", "part", "n_replies", F.coalesce(F.array_join(line, ","), F.lit("")).alias("replies"))


@query("O30", "SELECT snapshot_id, thread_id, title, len(message_ids) AS n_messages FROM {v_snapshots} JOIN {v_threads} USING (thread_id)")
def snapshot_list(v_snapshots: DataFrame, v_threads: DataFrame) -> DataFrame:
    return usage.list_snapshots(v_snapshots, v_threads)


@query("O31", ANCESTORS + """
SELECT f.folder_id AS top_id, f.name, (SELECT count(*) FROM {v_filed} d JOIN a ON a.folder_id = d.folder_id WHERE a.ancestor_id = f.folder_id) AS n_docs FROM {v_folders} f WHERE f.parent_id IS NULL
""")
def folder_summary(v_folders: DataFrame, v_filed: DataFrame) -> DataFrame:
    return folders.folder_summary(v_folders, v_filed)


@query("O31", ANCESTORS + " SELECT ancestor_id AS folder_id FROM a WHERE folder_id IN (SELECT folder_id FROM {v_filed}) UNION SELECT parent_id FROM {v_folders} WHERE parent_id IS NOT NULL")
def non_empty_folders(v_folders: DataFrame, v_filed: DataFrame) -> DataFrame:
    return folders.non_empty_folders(v_folders, v_filed)


@query("O32", ANCESTORS + " SELECT a.ancestor_id AS folder_id, f.name, CAST(max(a.d) OVER () - a.d AS BIGINT) AS level FROM a JOIN {v_folders} f ON f.folder_id = a.ancestor_id WHERE a.folder_id = 1005")
def breadcrumb(v_folders: DataFrame) -> DataFrame:
    return folders.breadcrumb(v_folders, 1005)


add_view("v_reports", "SELECT event_id AS report_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE user_id END AS group_id, ts AS created_at FROM {events}")


@query("O33", """
SELECT report_id, row_number() OVER (PARTITION BY coalesce('g' || group_id, 'r' || report_id) ORDER BY created_at, report_id) AS version, count(*) OVER (PARTITION BY coalesce('g' || group_id, 'r' || report_id)) AS n_versions FROM {v_reports}
""")
def report_siblings(v_reports: DataFrame) -> DataFrame:
    return usage.siblings(v_reports, F.date_trunc("day", F.col("created_at"))).select("report_id", "version", "n_versions")


add_view("v_actions", "SELECT event_id AS action_id, user_id AS thread_id, ts, event_type AS tool, CASE WHEN event_id % 9 = 0 AND event_id > 0 THEN event_id - 5 ELSE NULL END AS reverse_of FROM {events}")


@query("O34", """
SELECT a.action_id, a.tool, a.ts, (SELECT count(*) FROM {v_actions} WHERE thread_id = 8) AS total, coalesce((SELECT min(r.action_id) FROM {v_actions} r WHERE r.reverse_of = a.action_id), -1) AS reverted_by
FROM {v_actions} a WHERE a.thread_id = 8 ORDER BY a.ts DESC, a.action_id DESC LIMIT 20 OFFSET 20
""")
def action_log(v_actions: DataFrame) -> DataFrame:
    return usage.action_log(v_actions, 8, 1, 20).select("action_id", "tool", "ts", "total", "reverted_by")
