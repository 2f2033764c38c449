"""Scans, document makers and chunk-table sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from corpusmill.functions import identity as I
from corpusmill.functions import text as T
from corpusmill.operators.scale import first_k

CORPUS_COLUMNS = ["doc_id", "space_id", "doc_type", "title", "content", "updated_at", "created_at", "status", "folder_id", "connector_id", "metadata"]


def read_corpus(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Document rows without their vectors unless asked for."""
    df = spark.read.parquet(path)
    return df.select(*(columns or [c for c in df.columns if c not in ("embedding", "vector")]))


def spread_scan(df: DataFrame) -> DataFrame:
    """Deal the rows of a small scan out to all cores before heavy work on each row.

    Only a plain scan with fewer splits than cores is touched, so the data moved is at most one split per core; a
    large table keeps its splits and gets no exchange.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def scan_files(spark: SparkSession, root: str, exts: list[str] | None = None, excludes: list[str] | None = None) -> DataFrame:
    """Files below ``root``: path, relative path, name, time, size. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    plain = F.regexp_replace("path", "^file:/*", "/")
    base = root.removeprefix("file:").rstrip("/") + "/"
    rel = F.when(plain.startswith(base), F.substring(plain, F.lit(len(base) + 1), F.length(plain))).otherwise(plain)
    rows = files.select(
        plain.alias("path"), rel.alias("relative_path"), F.element_at(F.split("path", "/"), -1).alias("name"),
        F.col("modificationTime").alias("modified_at"), F.col("length").alias("size"),
    )
    if exts is not None:
        rows = rows.where(I.suffix("name").isin([e.lower() for e in exts]))
    if excludes:
        rows = rows.where(~F.arrays_overlap(F.split("relative_path", "/"), F.array(*[F.lit(e) for e in excludes])))
    return rows


DROPPED_TAGS = "script|style|nav|footer|header|aside|noscript|head"
# Entities of the pages' markup.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&copy;": "©", "&middot;": "·", "&amp;": "&"}


def page_text(html: Column | str) -> Column:
    """Body text of a page: the article (else the body) without navigation, scripts and markup."""
    page = T.col(html)
    article = F.regexp_extract(page, r"(?is)<article[^>]*>(.*)</article>", 1)
    text = F.coalesce(F.nullif(article, F.lit("")), page)
    for tag in DROPPED_TAGS.split("|"):
        text = F.regexp_replace(text, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?i)</?(p|br|div|li|ul|ol|h[1-6]|tr|table)\b[^>]*>", "\n")
    text = decode(F.regexp_replace(text, r"<[^>]+>", ""))
    text = F.regexp_replace(text, r"[ \t\r]+", " ")
    return T.trimmed(F.regexp_replace(text, r" *\n[ \n]*", "\n"))


def decode(c: Column) -> Column:
    for entity, char in ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, content); pages without text are left out, pages without title take their url."""
    title = T.trimmed(decode(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)))
    rows = pages.select("page_id", "url", F.coalesce(F.nullif(title, F.lit("")), "url").alias("title"), page_text("html").alias("content"))
    return rows.where("content <> ''")


def page_content_hash(pages: DataFrame, space: int) -> DataFrame:
    """Change hash of a page over its text alone."""
    return extract_pages(pages).withColumn("content_hash", I.content_hash(F.lit(space), "content"))


def _sql_drop(expr: str) -> str:
    for tag in DROPPED_TAGS.split("|"):
        expr = rf"regexp_replace({expr}, '(?is)<{tag}\b[^>]*>.*?</{tag}>', ' ', 'g')"
    return expr


def _sql_decode(expr: str) -> str:
    for entity, char in ENTITIES.items():
        expr = f"replace({expr}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return expr


# Reference SQL of extract_pages.
_BODY = _sql_drop(r"coalesce(nullif(regexp_extract(html, '(?is)<article[^>]*>(.*)</article>', 1), ''), html)")
_BODY = rf"regexp_replace(regexp_replace(regexp_replace({_BODY}, '(?s)<!--.*?-->', ' ', 'g'), '(?i)</?(p|br|div|li|ul|ol|h[1-6]|tr|table)\b[^>]*>', chr(10), 'g'), '<[^>]+>', '', 'g')"
_BODY = rf"trim(regexp_replace(regexp_replace({_sql_decode(_BODY)}, '[ \t\r]+', ' ', 'g'), ' *\n[ \n]*', chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))"
_TITLE = _sql_decode("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")
PAGES_SQL = rf"""SELECT * FROM (SELECT page_id, url, coalesce(nullif(trim({_TITLE}, ' ' || chr(9) || chr(10) || chr(13)), ''), url) AS title, {_BODY} AS content FROM {{pages}}) WHERE content <> ''"""


def rows_to_markdown(df: DataFrame, file: str = "file_id", order: str = "line_no", cells: str = "cells", part_rows: int = 10_000) -> DataFrame:
    """One Markdown table per file: first row is the header, short rows are padded, long ones cut, pipes escaped.

    A file of more than ``part_rows`` lines continues in further parts, so no task gathers an unbounded file.
    """
    safe = F.transform(F.col(cells), lambda x: F.replace(T.trimmed(x), F.lit("|"), F.lit("\\|")))
    rows = df.select(file, F.col(order).alias("_no"), safe.alias("_cells"))
    width = rows.groupBy(file).agg(F.min("_no").alias("_first"), F.size(F.min_by("_cells", "_no")).alias("_width"))
    rows = rows.join(width, file)
    padded = F.slice(F.concat("_cells", F.array_repeat(F.lit(""), F.col("_width"))), F.lit(1), F.col("_width"))
    line = lambda a: F.concat(F.lit("| "), F.array_join(a, " | "), F.lit(" |"))
    rule = line(F.array_repeat(F.lit("---"), F.col("_width")))
    text = F.when(F.col("_no") == F.col("_first"), F.concat(line(padded), F.lit("\n"), rule)).otherwise(line(padded))
    rows = rows.withColumn("part", F.floor((F.col("_no") - F.col("_first")) / part_rows)).withColumn("_text", text)
    return rows.groupBy(file, "part").agg(
        F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_no", "_text"))), lambda s: s["_text"]), "\n"), F.lit("\n")).alias("markdown")
    )


def records_to_text(df: DataFrame, json: str, fields: list[str] | None = None) -> Column:
    """``field: value`` lines of a JSON record; nested values stay JSON, nulls and booleans are left out."""
    record = F.from_json(F.col(json), "map<string,string>")
    entries = F.map_entries(record)
    if fields is not None:
        entries = F.transform(
            F.filter(F.array(*[F.lit(f) for f in fields]), lambda f: F.map_contains_key(record, f)),
            lambda f: F.struct(f.alias("key"), F.try_element_at(record, f).alias("value")),
        )
    kept = F.filter(entries, lambda e: e["value"].isNotNull() & ~e["value"].isin("true", "false"))
    return F.array_join(F.transform(kept, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


RUN_SCHEMA = (
    "summary STRUCT<number_match_rate: DOUBLE, overall_correct_rate: DOUBLE>, "
    "results ARRAY<STRUCT<id: STRING, `group`: STRING, gold: STRING, predicted: STRING, metrics: STRUCT<number_match: BOOLEAN, overall_correct: BOOLEAN, token_f1: DOUBLE>>>"
)


def parse_runs(files: DataFrame) -> DataFrame:
    """Result rows of benchmark payloads (path, value); payloads without results drop out; a run is named by its path."""
    label = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.json$", "")
    rows = files.select(label.alias("run_id"), F.explode(F.from_json("value", RUN_SCHEMA)["results"]).alias("r"))
    return rows.where("r.id IS NOT NULL").select(
        "run_id", F.col("r.id").alias("qid"), F.col("r.group").alias("grp"), "r.gold", "r.predicted", "r.metrics.*"
    )


def read_runs(spark: SparkSession, glob: str) -> DataFrame:
    """Benchmark result files, one JSON document each."""
    files = spark.read.text(glob, wholetext=True)
    return parse_runs(files.select(F.col("_metadata.file_path").alias("path"), "value"))


def last_per_chunk(chunks: DataFrame, order: str) -> DataFrame:
    return first_k(chunks, ["chunk_id"], [F.col(order).desc()], 1)


def table_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None where there is none yet or no file in it; any other error stays an error."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def write_chunks(chunks: DataFrame, path: str, order: str = "indexed_at", file_rows: int = 250_000) -> None:
    """Upsert by chunk id into a table with one partition per space and strategy.

    Only the partitions that the new chunks touch are read and rewritten. The merged rows are checkpointed first,
    since their old files are replaced by the write. A partition gets files of about ``file_rows`` rows. What is known of
    partitions, a row for each, is broadcast: a join on their few names would gather a partition's chunks in one task.
    """
    from corpusmill.session import checkpointed

    spark = chunks.sparkSession
    new = last_per_chunk(chunks, order)
    old = table_if_there(spark, path)
    if old is not None:
        touched = new.select("space_id", "strategy").distinct()
        old = old.join(F.broadcast(touched), ["space_id", "strategy"], "left_semi")
        new = last_per_chunk(old.select(*new.columns).unionByName(new), order)
    new = checkpointed(new)
    sizes = new.groupBy("space_id", "strategy").agg(F.ceil(F.count("*") / file_rows).cast("int").alias("_files"))
    (
        new.join(F.broadcast(sizes), ["space_id", "strategy"]).withColumn("_file", F.pmod(F.hash("chunk_id"), F.col("_files")))
        .repartition("space_id", "strategy", "_file").drop("_files", "_file")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("space_id", "strategy").parquet(path)
    )


def delete_documents(chunks: DataFrame, doc_ids: DataFrame) -> DataFrame:
    return chunks.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti")


def delete_space(chunks: DataFrame, space: int) -> DataFrame:
    return chunks.where(F.col("space_id") != space)


def chunk_stats(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("space_id").agg(F.count("*").alias("n_chunks"), F.sum(F.octet_length("content")).alias("n_bytes"))


def reconcile_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Row counts per key of two stores side by side, and whether they agree."""
    a = left.groupBy(key).agg(F.count("*").alias("left_count"))
    b = right.groupBy(key).agg(F.count("*").alias("right_count"))
    rows = a.join(b, key, "full_outer")
    rows = rows.select(key, F.coalesce("left_count", F.lit(0)).alias("left_count"), F.coalesce("right_count", F.lit(0)).alias("right_count"))
    return rows.withColumn("agrees", F.col("left_count") == F.col("right_count"))
