"""What happens to hits after ranking: grouping, neighbours, caps, merging, packing, citing, memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators.retrieval import rrf_many
from corpusmill.session import checkpointed
from corpusmill.operators.scale import first_k, positions

# Context budget rules.
BUDGET_FRACTION, CHARS_PER_TOKEN = 0.25, 4
MIN_BUDGET, MAX_BUDGET = 20_000, 200_000
MAX_CHUNK_CHARS, TOP_DOC_FRACTION, RANK_DECAY, XML_OVERHEAD, MIN_CHUNKS = 8_000, 0.40, 0.35, 500, 3

# Memory importance weights.
IMPORTANCE = {"critical": 2.0, "high": 1.5, "medium": 1.0, "low": 0.5}


def group_hits(hits: DataFrame, k: int) -> DataFrame:
    """Chunk hits to documents: best score, order of the first hit, joined content; the first ``k`` documents."""
    docs = hits.groupBy("query_id", "doc_id").agg(
        F.max("score").alias("score"),
        F.min("rank").alias("first_rank"),
        F.count("*").alias("n_chunks"),
        F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "content"))).alias("chunks"),
    )
    docs = first_k(docs, ["query_id"], [F.col("first_rank")], k, rank="doc_rank")
    return docs.withColumn("content", F.array_join(F.transform("chunks", lambda c: c["content"]), "\n\n"))


def cap_chunks(chunks: DataFrame, hits: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` chunks of every hit document plus every matched chunk, with its rank (0: not matched)."""
    wanted = hits.select("doc_id").distinct()
    # Leading chunks are found once per document, however many queries hit it.
    lead = first_k(chunks.select("doc_id", "chunk_id").join(wanted, "doc_id", "left_semi"), ["doc_id"], [F.col("chunk_id")], n)
    kept = hits.select("query_id", "doc_id").distinct().join(lead, "doc_id").select("query_id", "doc_id", "chunk_id")
    matched = hits.select("query_id", "doc_id", "chunk_id", F.col("rank").alias("matched_rank"))
    return (
        kept.withColumn("matched_rank", F.lit(None).cast("bigint")).unionByName(matched)
        .groupBy("query_id", "doc_id", "chunk_id").agg(F.coalesce(F.min("matched_rank"), F.lit(0)).alias("matched_rank"))
    )


def chunk_positions(chunks: DataFrame, only: DataFrame | None = None, block_rows: int = 4096) -> DataFrame:
    """Position of each chunk in its document, by id; ``block_rows`` bounds the rows one task ranks."""
    rows = chunks.select("doc_id", "chunk_id")
    if only is not None:
        rows = rows.join(only.select("doc_id").distinct(), "doc_id", "left_semi")
    return positions(rows, ["doc_id"], [F.col("chunk_id")], F.floor(F.col("chunk_id") / block_rows))


def expand_neighbors(chunks: DataFrame, hits: DataFrame, w: int = 1) -> DataFrame:
    """Chunks within ``w`` positions (1 to 3) of each hit; an equality join on the wanted positions."""
    w = max(1, min(int(w), 3))
    pos = checkpointed(chunk_positions(chunks, hits))  # asked for twice
    at = hits.select("query_id", "doc_id", "chunk_id").join(pos, ["doc_id", "chunk_id"])
    near = at.select("query_id", "doc_id", F.explode(F.sequence(F.col("pos") - w, F.col("pos") + w)).alias("pos")).distinct()
    return near.join(pos, ["doc_id", "pos"]).select("query_id", "doc_id", "chunk_id")


def fuse_levels(chunk_docs: DataFrame, doc_docs: DataFrame, k: int, rrf_k: int = 60) -> DataFrame:
    """Fuse a chunk-side and a document-side ranking of documents; the chunk side's content is preferred."""
    fused = rrf_many({"chunk": chunk_docs, "doc": doc_docs}, "doc_id", k, rrf_k).drop("lists")
    side = lambda df, name: df.select("query_id", "doc_id", F.col("content").alias(name))
    return (
        fused.join(side(chunk_docs, "_c"), ["query_id", "doc_id"], "left").join(side(doc_docs, "_d"), ["query_id", "doc_id"], "left")
        .withColumn("content", F.coalesce("_c", "_d")).drop("_c", "_d")
    )


def scope(
    docs: DataFrame, space: int | None = None, types: list[str] | None = None, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Documents of a space and type list in a date range that are not being deleted."""
    out = docs.where(F.coalesce(F.get_json_object("status", "$.state"), F.lit("ready")) != "deleting")
    if space is not None:
        out = out.where(F.col("space_id") == space)
    if types:
        out = out.where(F.col("doc_type").isin(types))
    if start:
        out = out.where(F.col("updated_at") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        out = out.where(F.col("updated_at") <= F.lit(end).cast("timestamp_ntz"))
    return out


def browse_recent(docs: DataFrame, chunks: DataFrame, k: int, m: int = 5) -> DataFrame:
    """Newest ``k`` documents with their first ``m`` chunks, score 0."""
    newest = docs.select("doc_id", "title", "updated_at").orderBy(F.col("updated_at").desc(), "doc_id").limit(k)
    lead = first_k(chunks.join(newest.select("doc_id"), "doc_id", "left_semi"), ["doc_id"], [F.col("chunk_id")], m, rank="chunk_no")
    return newest.join(lead, "doc_id").withColumn("score", F.lit(0.0))


def fetch_ordered(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """Documents of an id list, with the place each was asked at; unknown ids drop out."""
    wanted = asked.select("query_id", F.posexplode("ids").alias("pos", "doc_id"))
    wanted = wanted.groupBy("query_id", "doc_id").agg(F.min("pos").cast("bigint").alias("pos"))
    return wanted.join(docs, "doc_id")


def merge_results(sources: list[DataFrame]) -> DataFrame:
    """Results of several sources (query_id, doc_id or null, content, score): the first of each document kept.

    Results without an id are told apart by their content. Keys are hashed, so a min-by aggregation does it.
    """
    rows = None
    for i, one in enumerate(sources):
        part = one.withColumn("source_no", F.lit(i))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    key = F.when(F.col("doc_id").isNotNull(), F.concat(F.lit("id:"), F.col("doc_id").cast("string"))).otherwise(
        F.concat(F.lit("text:"), F.sha2(T.trimmed("content"), 256))
    )
    rows = rows.withColumn("_key", key)
    rows = first_k(rows, ["query_id", "_key"], [F.col("source_no"), F.col("score").desc(), F.col("content")], 1)
    return rows.drop("_key")


def context_budget(max_input_tokens: int | None) -> int:
    if not max_input_tokens or max_input_tokens <= 0:
        return MIN_BUDGET
    return max(MIN_BUDGET, min(int(max_input_tokens * CHARS_PER_TOKEN * BUDGET_FRACTION), MAX_BUDGET))


def chunks_allowed(doc_rank: Column, budget: int, max_chunk_chars: int = MAX_CHUNK_CHARS) -> Column:
    """Chunks a document of (zero-based) rank may bring."""
    share = F.floor(budget * (TOP_DOC_FRACTION / (1 + doc_rank * RANK_DECAY)))
    return F.greatest(F.floor((share - XML_OVERHEAD) / max_chunk_chars), F.lit(MIN_CHUNKS))


def _cdata(c: Column) -> Column:
    return F.concat(F.lit("<![CDATA["), c, F.lit("]]>"))


def pack_context(hits: DataFrame, budget: int, max_chunk_chars: int = MAX_CHUNK_CHARS) -> DataFrame:
    """One context text per query: documents in rank order until the first that no longer fits.

    ``hits``: query_id, doc_id, doc_rank (from 0), doc_type, title, url, chunk_id, chunk_no (from 1), content. A
    query's hits are a bounded top-k list, so the per-query window is small.
    """
    rows = hits.where((F.col("chunk_no") <= chunks_allowed(F.col("doc_rank"), budget, max_chunk_chars)) & (T.trimmed("content") != ""))
    body = T.trimmed("content")
    cut = F.when(F.length(body) > max_chunk_chars, F.concat(F.left(body, F.lit(max_chunk_chars)), F.lit("\n...(truncated)"))).otherwise(body)
    chunk = F.concat(F.lit("  <chunk id='"), F.col("chunk_id").cast("string"), F.lit("'>"), _cdata(cut), F.lit("</chunk>"))
    docs = rows.groupBy("query_id", "doc_id", "doc_rank", "doc_type", "title", "url").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", chunk.alias("x")))), lambda s: s["x"]), "\n").alias("chunks")
    )
    xml = F.concat(
        F.lit("<document>\n<document_metadata>\n  <document_id>"), F.col("doc_id").cast("string"),
        F.lit("</document_id>\n  <document_type>"), F.col("doc_type"),
        F.lit("</document_type>\n  <title>"), _cdata(F.col("title")),
        F.lit("</title>\n  <url>"), _cdata(F.col("url")),
        F.lit("</url>\n  <metadata_json><![CDATA[{}]]></metadata_json>\n</document_metadata>\n\n<document_content>\n"),
        F.col("chunks"), F.lit("\n</document_content>\n</document>\n"),
    )
    docs = docs.select("query_id", "doc_rank", xml.alias("xml"))
    w = Window.partitionBy("query_id").orderBy("doc_rank")
    docs = docs.withColumn("used", F.sum(F.length("xml")).over(w)).withColumn("idx", F.row_number().over(w) - 1)
    docs = docs.withColumn("fits", F.col("used") <= budget)
    out = docs.groupBy("query_id").agg(
        F.count("*").alias("n_docs"),
        F.count_if("fits").alias("n_fit"),
        F.array_sort(F.collect_list(F.when(F.col("fits") | (F.col("idx") == 0), F.struct("idx", "xml")))).alias("kept"),
    )
    note = F.concat(
        F.lit("<!-- Output truncated: "), (F.col("n_docs") - F.col("n_fit")).cast("string"),
        F.lit(f" more document(s) omitted (budget {budget} chars). Refine your query or reduce top_k to retrieve different results. -->"),
    )
    parts = F.transform("kept", lambda s: s["xml"])
    text = F.array_join(F.when(F.col("n_fit") < F.col("n_docs"), F.concat(parts, F.array(note))).otherwise(parts), "\n")
    text = T.trimmed(text)
    end = "\n<!-- ...output forcibly truncated to fit context window -->"
    text = F.when(F.length(text) > budget, F.concat(F.left(text, F.lit(budget - len(end))), F.lit(end))).otherwise(text)
    return out.select("query_id", "n_docs", F.size("kept").cast("bigint").alias("n_kept"), text.alias("context"))


def render_context(hits: DataFrame) -> DataFrame:
    """One document text per (query, document) with an index of its chunks: line range and matched mark.

    ``hits``: query_id, doc_id, title, chunk_id, matched, content; chunks of a document are capped before (R11).
    """
    body = T.trimmed("content")
    rows = hits.where(body != "").withColumn(
        "xml", F.concat(F.lit("  <chunk id='"), F.col("chunk_id").cast("string"), F.lit("'>"), _cdata(body), F.lit("</chunk>"))
    )
    lines = (F.length("xml") - F.length(F.replace("xml", F.lit("\n"), F.lit(""))) + 1).cast("bigint")
    w = Window.partitionBy("query_id", "doc_id")
    rows = rows.withColumn("_n", lines).withColumn("_count", F.count("*").over(w))
    rows = rows.withColumn("_end", F.sum("_n").over(w.orderBy("chunk_id")) + F.col("_count") + 12)
    entry = F.concat(
        F.lit('  <entry chunk_id="'), F.col("chunk_id").cast("string"), F.lit('" lines="'),
        (F.col("_end") - F.col("_n") + 1).cast("string"), F.lit("-"), F.col("_end").cast("string"), F.lit('"'),
        F.when(F.col("matched"), F.lit(' matched="true"')).otherwise(""), F.lit("/>"),
    )
    docs = rows.groupBy("query_id", "doc_id", "title").agg(
        F.array_sort(F.collect_list(F.struct("chunk_id", entry.alias("entry"), "xml"))).alias("c")
    )
    text = F.concat(
        F.lit("<document>\n<document_metadata>\n  <document_id>"), F.col("doc_id").cast("string"),
        F.lit("</document_id>\n  <document_type>FILE</document_type>\n  <title>"), _cdata(F.col("title")),
        F.lit("</title>\n  <metadata_json><![CDATA[{}]]></metadata_json>\n</document_metadata>\n\n<chunk_index>\n"),
        F.array_join(F.transform("c", lambda s: s["entry"]), "\n"),
        F.lit("\n</chunk_index>\n\n<document_content>\n"),
        F.array_join(F.transform("c", lambda s: s["xml"]), "\n"),
        F.lit("\n</document_content>\n</document>"),
    )
    return docs.select("query_id", "doc_id", text.alias("context"))


def citation_sources(grouped: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per cited chunk: title, 200-character preview, link."""
    chunks = grouped.select("query_id", "doc_id", F.explode("chunks").alias("c"))
    return chunks.join(docs.select("doc_id", "title", "url"), "doc_id").select(
        "query_id", "doc_id", F.col("c.chunk_id").alias("chunk_id"), "title", "url", T.preview(F.col("c.content"), 200).alias("preview")
    )


def cited_window(chunks: DataFrame, cited: DataFrame, n: int) -> DataFrame:
    """Chunks within ``n`` positions of each cited chunk, with its place, the document's total and the start."""
    docs = chunks.select("doc_id", "chunk_id").join(cited, "chunk_id").select("cited_id", "doc_id", "chunk_id")
    pos = chunk_positions(chunks, docs)
    totals = pos.groupBy("doc_id").agg(F.count("*").alias("total"))
    at = docs.join(pos, ["doc_id", "chunk_id"]).join(totals, "doc_id")
    at = at.select(
        "cited_id", "doc_id", "total", F.col("pos").alias("cited_pos"),
        F.greatest(F.col("pos") - n - 1, F.lit(0)).alias("start_index"),
        F.explode(F.sequence(F.greatest(F.col("pos") - n, F.lit(1)), F.col("pos") + n)).alias("pos"),
    )
    return at.join(pos, ["doc_id", "pos"])


def page_chunks(chunks: DataFrame, doc_id: int, page: int, size: int) -> DataFrame:
    rows = chunks.where(F.col("doc_id") == doc_id)
    return rows.orderBy("chunk_id").offset(page * size).limit(size)


def search_memories(
    memories: DataFrame, now: str, k: int, window_days: int | None = None, min_importance: str | None = None
) -> DataFrame:
    """Top memories per query by similarity, recency, importance and use; expired ones are left out."""
    at = F.lit(now).cast("timestamp_ntz")
    rows = memories.where(F.col("expires_at").isNull() | (F.col("expires_at") > at))
    if window_days is not None:
        rows = rows.where(F.col("created_at") >= at - F.expr(f"INTERVAL '{window_days}' DAY"))
    if min_importance:
        floor = IMPORTANCE[min_importance]
        rows = rows.where(F.col("importance").isin([name for name, w in IMPORTANCE.items() if w >= floor]))
    age_hours = (F.unix_micros(at.cast("timestamp")) - F.unix_micros(F.col("last_accessed_at").cast("timestamp"))) / 3.6e9
    weight = T.lookup(F.col("importance"), IMPORTANCE, F.lit(0.0))
    boost = F.least(1.0 + F.col("access_count") * 0.1, F.lit(2.0))
    scored = rows.withColumn("score", F.round(F.col("similarity") * (1.0 / (1.0 + age_hours / 24)) * weight * boost, 6))
    return first_k(scored, ["query_id"], [F.col("score").desc(), F.col("memory_id")], k, rank="rank")


def recent_turns(conv: DataFrame, n: int) -> DataFrame:
    """Last ``n`` turns of every conversation, numbered oldest first."""
    last = first_k(conv, ["conv_id"], [F.col("turn").desc()], n)
    return last.withColumn("pos", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("bigint"))


def render_dialogue(conv: DataFrame, n: int = 6, clip: int = 400, budget: int | None = None) -> DataFrame:
    """Recent user and assistant turns as lines, oldest first; with a budget, the newest that fit.

    ``n`` (or, with a budget, one line per budget character) bounds what a conversation brings to one task.
    """
    line_text = T.normalize_space("text")
    rows = conv.where(F.col("role").isin("user", "assistant")).select("conv_id", "turn", "role", line_text.alias("t")).where("t <> ''")
    if budget is None:
        rows = first_k(rows, ["conv_id"], [F.col("turn").desc()], n)
        shown = F.when(F.length("t") > clip, F.concat(F.rtrim(F.left("t", F.lit(clip))), F.lit("..."))).otherwise(F.col("t"))
        rows = rows.withColumn("line", F.concat("role", F.lit(": "), shown))
    else:
        # The shortest line ("user: x") has seven characters, so more lines can never fit.
        rows = first_k(rows, ["conv_id"], [F.col("turn").desc()], max(1, budget // 7 + 1))
        rows = rows.withColumn("line", F.concat("role", F.lit(": "), F.col("t")))
        w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
        used = F.sum(F.length("line") + 1).over(w) - 1
        rows = rows.withColumn("_used", used).where(F.col("_used") <= budget)
    return rows.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda s: s["line"]), "\n").alias("dialogue")
    )


def latest_by_key(df: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(value, ts).alias(value), F.max(ts).alias(ts))


def purge(df: DataFrame, now: str, expires: str = "expires_at") -> DataFrame:
    """Rows not yet expired; no expiry means they stay."""
    return df.where(F.col(expires).isNull() | (F.col(expires) > F.lit(now).cast("timestamp_ntz")))


def entities_named(memories: DataFrame, names: list[str], col: str = "name") -> DataFrame:
    return memories.where(F.lower(col).isin([n.lower() for n in names]))
