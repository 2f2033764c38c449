"""Title search, substring search, mentions, globbing and query routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators.scale import first_k

# Word classes of the routing rules.
ROUTING_TERMS = {
    "financial": ["revenue", "income", "profit", "earnings", "fiscal", "quarter"],
    "code": ["function", "class", "code", "python", "javascript", "import"],
    "latest": ["today", "recent", "latest", "now", "current"],
}


def page_of(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset(page * size).limit(size)


def like_pattern(text: str) -> str:
    return "%" + text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"


def search_titles(docs: DataFrame, q: str, page: int = 0, size: int = 50) -> DataFrame:
    """Trigram similarity above 0.3 or a substring match, best first; under two characters, newest first."""
    q = q.strip()
    if len(q) < 2:
        rows = docs.select("doc_id", "title", F.lit(0.0).alias("similarity"), "updated_at")
        return page_of(rows, [F.col("updated_at").desc_nulls_last(), F.col("doc_id")], page, size).drop("updated_at")
    sim = T.trigram_similarity(T.trigrams("title"), T.trigrams(F.lit(q)))
    rows = docs.select("doc_id", "title", sim.alias("_sim"))
    rows = rows.where((F.col("_sim") > 0.3) | F.col("title").ilike(like_pattern(q)))
    rows = page_of(rows, [F.col("_sim").desc(), F.col("title"), F.col("doc_id")], page, size)
    return rows.select("doc_id", "title", F.round("_sim", 6).alias("similarity"))


def search_docs(docs: DataFrame, title: str, types: list[str] | None, page: int, size: int) -> DataFrame:
    """Case-insensitive substring search over titles; each row of the page carries the total."""
    hits = docs.where(F.col("title").ilike(like_pattern(title)))
    if types:
        hits = hits.where(F.col("doc_type").isin(types))
    total = hits.agg(F.count("*")).scalar()
    rows = hits.select("doc_id", "title", "doc_type", "updated_at").withColumn("total", total)
    return page_of(rows, [F.col("updated_at").desc(), F.col("doc_id")], page, size).drop("updated_at")


def mentions(comments: DataFrame, content: str = "content", key: str = "comment_id") -> DataFrame:
    return comments.select(key, F.explode(T.mention_ids(content)).alias("user_id"))


def render_mentions(comments: DataFrame, users: DataFrame, key: str = "comment_id") -> DataFrame:
    """Known mentioned users shown by name as ``@{name}``; unknown ids stay."""
    found = mentions(comments, key=key).join(users, "user_id")
    names = found.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("user_id", "name"))).alias("_names"))
    rows = comments.join(names, key, "left")
    # The text splits at each mention; ids and the text between them are then put back together.
    pattern = r"@\[[0-9a-fA-F-]{36}\]"
    ids = F.regexp_extract_all("content", F.lit(r"@\[([0-9a-fA-F-]{36})\]"), F.lit(1))
    shown = F.transform(
        ids,
        lambda u: F.coalesce(
            F.concat(F.lit("@{"), F.try_element_at("_names", F.lower(u)), F.lit("}")), F.concat(F.lit("@["), u, F.lit("]"))
        ),
    )
    between = F.split("content", pattern, -1)
    joined = F.array_join(
        F.zip_with(between, shown, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""
    )
    return rows.withColumn("content", joined).drop("_names")


def grep_chunks(
    chunks: DataFrame, pattern: str, per_doc: int = 5, total: int = 50, paths: DataFrame | None = None, glob: str | None = None
) -> DataFrame:
    """Chunks holding the pattern, a few per document, with a one-line snippet."""
    hits = chunks.where(F.col("content").ilike(like_pattern(pattern)))
    if paths is not None:
        hits = hits.join(glob_docs(paths, glob) if glob else paths, "doc_id", "left_semi")
    hits = first_k(hits.select("doc_id", "chunk_id", "content"), ["doc_id"], [F.col("chunk_id")], per_doc)
    return (
        hits.orderBy("doc_id", "chunk_id").limit(total)
        .select("doc_id", "chunk_id", F.left(T.normalize_space("content"), F.lit(240)).alias("snippet"))
    )


def glob_docs(paths: DataFrame, pattern: str) -> DataFrame:
    return paths.where(F.col("path").rlike(T.glob_regex(pattern)))


def _any_term(c: Column, terms: list[str]) -> Column:
    return c.rlike("|".join(f"\\Q{t}\\E" for t in terms))


def route_queries(
    queries: DataFrame, docs: DataFrame, rules: list[tuple[str, object, str]] | None = None, default: str = "default"
) -> DataFrame:
    """Profile of each query: the last rule that matches wins.

    A rule is ("terms", word list, profile), ("docs_below", n, profile) or ("docs_above", n, profile).
    """
    rules = rules or [
        ("terms", ROUTING_TERMS["financial"], "production"),
        ("terms", ROUTING_TERMS["code"], "code_specialist"),
        ("docs_above", 1000, "fast_cheap"),
    ]
    n_docs = docs.agg(F.count("*")).scalar()
    rows = queries.withColumn("_n", n_docs)
    text = F.lower("query")
    profile = F.lit(default)
    for kind, value, name in rules:
        hit = _any_term(text, value) if kind == "terms" else (F.col("_n") < value if kind == "docs_below" else F.col("_n") > value)
        profile = F.when(hit, name).otherwise(profile)
    return rows.withColumn("profile", profile).withColumn("needs_latest", _any_term(text, ROUTING_TERMS["latest"])).drop("_n")
