"""Chunking and segmentation: one document row in, many chunk rows out.

A document is split once into pieces of ``size - overlap`` characters (one linear regular-expression pass);
windows, overlaps and contexts are then built from neighbouring pieces, so long texts cost linear time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from corpusmill.functions.text import WS, let, words
from corpusmill.operators.scale import running_total
from corpusmill.session import made_in_small_batches


def _pieces(text: Column, step: int) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{step}}})"), F.lit(1))


def _from_pieces(pieces: Column, i: Column, step: int, start: int, n: int) -> Column:
    """``n`` characters beginning ``start`` characters after the start of piece ``i`` (zero-based)."""
    first, last = start // step, (start + n - 1) // step
    joined = F.array_join(F.slice(pieces, i + 1 + first, last - first + 1), "")
    return F.substring(joined, start % step + 1, n)


def windows(text: Column, size: int, overlap: int) -> Column:
    """Array of struct(number, raw): fixed windows that stop at the end of the text."""
    step = size - max(0, min(overlap, size - 1))
    n = F.when(F.length(text) <= size, 1).otherwise(1 + F.ceil((F.length(text) - size) / step)).cast("int")
    cut = let(
        _pieces(text, step),
        lambda pieces: F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.struct(i.alias("number"), _from_pieces(pieces, i, step, 0, size).alias("raw")),
        ),
    )
    return F.when(F.length(text) > 0, cut)


def chunk_chars(df: DataFrame, size: int, overlap: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fixed windows, trimmed; empty ones dropped; ``idx`` counts the kept ones."""
    kept = F.filter(
        F.transform(windows(F.col(text), size, overlap), lambda w: F.btrim(w["raw"], F.lit(WS))), lambda s: s != ""
    )
    return df.select(key, F.posexplode(kept).alias("idx", "content")).withColumn("idx", F.col("idx").cast("bigint"))


def chunk_blocks(df: DataFrame, size: int = 4000, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Plain blocks without overlap, text unchanged."""
    return df.select(key, F.posexplode(_pieces(F.col(text), size)).alias("idx", "content")).withColumn(
        "idx", F.col("idx").cast("bigint")
    )


def chunk_paragraphs(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Paragraphs between blank lines."""
    parts = F.filter(F.transform(F.split(F.col(text), r"\n[ \t\r\n]*\n"), lambda p: F.btrim(p, F.lit(WS))), lambda p: p != "")
    return df.select(key, F.posexplode(parts).alias("idx", "content")).withColumn("idx", F.col("idx").cast("bigint"))


def chunk_sandwich(
    df: DataFrame, size: int, overlap: int = 0, context: int = 100, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """Windows with the text before and after each one, and character offsets.

    Windows follow each other until the text is used up, so the last ones may lie inside the one before.
    """
    step = size - max(0, min(overlap, size - 1))
    body = F.col(text)
    back = -(-context // step)

    def window(pieces: Column, i: Column) -> Column:
        before = F.array_join(
            F.slice(pieces, F.greatest(i - back, F.lit(0)) + 1, F.least(i, F.lit(back))), ""
        )
        return F.struct(
            (i * step).cast("bigint").alias("char_start"),
            _from_pieces(pieces, i, step, 0, size).alias("content"),
            F.btrim(F.right(before, F.lit(context)), F.lit(WS)).alias("prefix"),
            F.btrim(_from_pieces(pieces, i, step, size, context), F.lit(WS)).alias("suffix"),
        )

    cut = let(
        _pieces(body, step),
        lambda p: F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda i: window(p, i)),
    )
    rows = df.where(F.length(body) > 0).select(key, F.posexplode(cut).alias("idx", "w"))
    return rows.select(
        key,
        F.col("idx").cast("bigint").alias("idx"),
        F.col("w.content").alias("content"),
        F.col("w.prefix").alias("prefix"),
        F.col("w.suffix").alias("suffix"),
        F.col("w.char_start").alias("char_start"),
        (F.col("w.char_start") + size).alias("char_end"),
        F.size(words(F.col("w.content"))).cast("bigint").alias("token_count"),
    )


# Separators from the coarsest to the finest; a piece keeps the separator that ends it.
_LADDER = [re.compile(p) for p in (r"\n[ \t]*\n\s*", r"\n+", r"(?<=[.!?])[ \t]+", r"[ \t\r]+")]


#: White space to ``str.split`` that does not end a word elsewhere (``text.words``).
_WITHIN_WORDS = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_WORD = re.compile(r"[^ \t\n\r]+")


def _n_words(text: str) -> int:
    return len(text.split())


def _n_words_by_pattern(text: str) -> int:
    return len(_WORD.findall(text))


def _split_keep(text: str, sep: re.Pattern) -> list[str]:
    cuts = [0, *[m.end() for m in sep.finditer(text)], len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:]) if b > a]


def recursive_pieces(text: str, cap: int, level: int = 0, n_words: Callable[[str], int] | None = None) -> list[str]:
    """Pieces of at most ``cap`` words that join back to ``text``; neighbours are merged while they fit."""
    n_words = n_words or (_n_words_by_pattern if _WITHIN_WORDS.search(text) else _n_words)
    if n_words(text) <= cap or level == len(_LADDER):
        return [text] if text else []
    out: list[str] = []
    room = 0
    for part in _split_keep(text, _LADDER[level]):
        n = n_words(part)
        if n > cap:
            out.extend(recursive_pieces(part, cap, level + 1, n_words))
            room = 0
        elif out and n <= room:
            out[-1] += part
            room -= n
        else:
            out.append(part)
            room = cap - n
    return out


def recursive_array(max_tokens: int):
    """Arrow function: text to array of pieces."""

    @F.pandas_udf(S.ArrayType(S.StringType()))
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: recursive_pieces(t, max_tokens) if t else [])

    return split


def recursive_arrays(max_tokens: int):
    """The same for an array of texts (null stays empty)."""

    @F.pandas_udf(S.ArrayType(S.ArrayType(S.StringType())))
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield rows.map(lambda texts: [recursive_pieces(t, max_tokens) if t else [] for t in texts])

    return split


@F.pandas_udf(S.ArrayType(S.LongType()))
def prefix_sums(lengths: pd.Series) -> pd.Series:
    """Sum of all earlier numbers, per array position."""
    return lengths.map(lambda a: np.concatenate([[0], np.cumsum(a)[:-1]]).astype("int64") if len(a) else a)


def chunk_recursive(df: DataFrame, max_tokens: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Paragraph, line, sentence, word ladder under a cap of words."""
    pieces = df.select(key, F.posexplode(recursive_array(max_tokens)(F.col(text))).alias("idx", "content"))
    return made_in_small_batches(pieces.withColumn("idx", F.col("idx").cast("bigint")))


def line_runs(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Runs of table lines (``|``) and prose lines per document, in order: key, run, is_table, lines.

    Works inside each row on the array of its lines, so no shuffle is needed: the places where the kind of
    line changes cut the array.
    """
    kinds = lambda lines: F.transform(lines, lambda s: s.rlike(r"^[ \t]*\|"))

    def cut(lines: Column, kind: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(1), F.size(lines)),
            lambda i: (i == 1) | (F.element_at(kind, i) != F.element_at(kind, F.greatest(i - 1, F.lit(1)))),
        )
        return let(
            starts,
            lambda at: F.transform(
                at,
                lambda s, j: F.struct(
                    F.element_at(kind, s).alias("is_table"),
                    F.slice(lines, s, F.coalesce(F.get(at, j + 1), F.size(lines) + 1) - s).alias("lines"),
                ),
            ),
        )

    lines = F.regexp_extract_all(F.col(text), F.lit("([^\n]*\n|[^\n]+$)"), F.lit(1))
    runs = let(lines, lambda ls: let(kinds(ls), lambda ks: cut(ls, ks)))
    return df.where(F.length(text) > 0).select(key, runs.alias("runs"))


def chunk_hybrid(df: DataFrame, max_tokens: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Tables stay whole, with the last prose line before and the first one after; prose goes down the ladder."""

    def prose_lines(run: Column) -> Column:
        lines = F.coalesce(run["lines"], F.array().cast("array<string>"))
        return F.transform(
            F.filter(lines, lambda s: F.btrim(s, F.lit(WS)) != ""), lambda s: F.regexp_replace(s, "[ \t\r\n]+$", "")
        )

    def body(runs: Column, run: Column, j: Column) -> Column:
        whole = F.array_join(run["lines"], "")
        table = F.concat_ws(
            "\n",
            F.try_element_at(prose_lines(F.get(runs, j - 1)), F.lit(-1)),
            F.btrim(whole, F.lit(WS)),
            F.get(prose_lines(F.get(runs, j + 1)), F.lit(0)),
        )
        return F.struct(run["is_table"].alias("is_table"), F.when(run["is_table"], table).otherwise(whole).alias("body"))

    bodies = let(F.col("runs"), lambda rs: F.transform(rs, lambda r, j: body(rs, r, j)))
    rows = line_runs(df, text, key).select(key, bodies.alias("bodies"))
    prose = F.transform("bodies", lambda p: F.when(~p["is_table"], p["body"]))
    rows = rows.withColumn("_split", recursive_arrays(max_tokens)(prose))
    parts = F.flatten(
        F.zip_with(
            "bodies", "_split",
            lambda p, parts: F.transform(
                F.when(p["is_table"], F.array(p["body"])).otherwise(parts),
                lambda c: F.struct(p["is_table"].alias("is_table"), c.alias("content")),
            ),
        )
    )
    kept = F.filter(parts, lambda c: F.btrim(c["content"], F.lit(WS)) != "")
    return rows.select(key, F.posexplode(kept).alias("idx", "c")).select(
        key, F.col("idx").cast("bigint").alias("idx"), "c.is_table", "c.content"
    )


ALIASES = {
    "sandwitch_chunk": "sandwich_chunk",
    "sandwich_chunk": "sandwich_chunk",
    "hybrid_sandwich": "sandwich_chunk",
    "chunk_hybrid": "chunk_hybrid",
    "chunk_recursive": "chunk_recursive",
    "chunk_text": "chunk_text",
}


def strategy_names(strategies: list[str | None]) -> list[str]:
    """Aliases resolved, unknown names become the default, repeats dropped, order kept."""
    return list(dict.fromkeys(ALIASES.get((s or "chunk_text").strip().lower(), "chunk_text") for s in strategies))


def chunk_multi(
    df: DataFrame, strategies: list[str | None], size: int = 800, overlap: int = 100, max_tokens: int = 256,
    text: str = "text", key: str = "doc_id",
) -> DataFrame:
    """The same documents cut by several named strategies: key, strategy, idx, content."""
    out = None
    for name in strategy_names(strategies):
        if name == "sandwich_chunk":
            one = chunk_sandwich(df, size, overlap, text=text, key=key).select(
                key, "idx", F.concat_ws("\n", F.nullif("prefix", F.lit("")), "content", F.nullif("suffix", F.lit(""))).alias("content")
            )
        elif name == "chunk_hybrid":
            one = chunk_hybrid(df, max_tokens, text, key)
        elif name == "chunk_recursive":
            one = chunk_recursive(df, max_tokens, text, key)
        else:
            one = chunk_chars(df, size, overlap, text, key)
        one = one.select(key, F.lit(name).alias("strategy"), "idx", "content")
        out = one if out is None else out.unionByName(one)
    return out


def chunk_records(chunks: DataFrame, name: str, key: str = "doc_id", strategy: str = "strategy") -> DataFrame:
    """Chunk id ``name:key:strategy:idx`` and token count added."""
    return chunks.withColumn(
        "chunk_id", F.concat_ws(":", F.lit(name), F.col(key).cast("string"), F.col(strategy), F.col("idx").cast("string"))
    ).withColumn("token_count", F.size(words("content")).cast("bigint"))


_MARK = "\u0001"


def sentence_array(text: Column) -> Column:
    """Sentences of one text; each keeps the blanks that follow it, so their lengths add up to the text's."""
    return F.split(F.regexp_replace(text, "([.;:][ \t\r\n]+)", f"$1{_MARK}"), _MARK)


def sentence_spans(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Sentences with character offsets into the text; all inside each row, without a shuffle."""
    rows = df.select(key, sentence_array(F.col(text)).alias("_s"))
    rows = rows.withColumn("_at", prefix_sums(F.transform("_s", lambda s: F.length(s))))
    rows = rows.select(key, F.explode(F.arrays_zip("_s", "_at")).alias("p")).select(
        key, F.col("p._s").alias("piece"), F.col("p._at").alias("at")
    )
    lead = F.length("piece") - F.length(F.regexp_replace("piece", "^[ \t\r\n]+", ""))
    rows = rows.withColumn("sentence", F.btrim("piece", F.lit(WS))).where(F.col("sentence") != "")
    return rows.select(
        key,
        "sentence",
        (F.col("at") + lead).cast("bigint").alias("start"),
        (F.col("at") + lead + F.length("sentence")).cast("bigint").alias("stop"),
    )


def markdown_rows(text: Column) -> Column:
    """Table rows of a Markdown text as arrays of trimmed cells; separator rows are skipped."""
    lines = F.transform(F.split(text, "\n"), lambda s: F.btrim(s, F.lit(WS)))
    lines = F.filter(lines, lambda s: s.startswith("|") & ~s.rlike(r"^\|[\s]*[-:]+[\s\-:]*\|"))
    inner = F.transform(lines, lambda s: F.regexp_replace(F.regexp_replace(s, r"^\|", ""), r"\|$", ""))
    return F.filter(
        F.transform(inner, lambda s: F.transform(F.split(s, r"\|"), lambda x: F.btrim(x, F.lit(WS)))),
        lambda cells: F.size(cells) > 0,
    )


def markdown_cells(df: DataFrame, text: str = "content", key: str = "doc_id") -> DataFrame:
    """One row per table cell: key, row, col, cell."""
    rows = df.select(key, F.posexplode(markdown_rows(F.col(text))).alias("row", "cells"))
    return rows.select(key, F.col("row").cast("bigint").alias("row"), F.posexplode("cells").alias("col", "cell")).withColumn(
        "col", F.col("col").cast("bigint")
    )


def chunk_sweep(df: DataFrame, sizes: list[int], overlap: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Chunk count and length statistics per chunk size, in one scan."""
    per_size = F.explode(F.array(*[
        F.struct(F.lit(s).cast("bigint").alias("size"), F.transform(windows(F.col(text), s, overlap), lambda w: F.btrim(w["raw"], F.lit(WS))).alias("chunks"))
        for s in sizes
    ]))
    rows = df.select(key, per_size.alias("s")).select(key, "s.size", F.explode("s.chunks").alias("content")).where("content <> ''")
    n = F.length("content")
    return rows.groupBy("size").agg(
        F.count("*").alias("n_chunks"),
        F.round(F.avg(n), 6).alias("avg_chars"),
        F.max(n).cast("bigint").alias("max_chars"),
        F.percentile(n, F.lit(0.5)).alias("median_chars"),
    )


def stitch_offsets(chunks: DataFrame, key: str = "doc_id", idx: str = "idx", block_rows: int = 4096) -> DataFrame:
    """Start and end of each chunk in the concatenated text of its document."""
    out = running_total(
        chunks, [key], [F.col(idx)], F.floor(F.col(idx) / block_rows), F.length("content").cast("bigint"), "stop_at"
    )
    return out.withColumn("start_at", F.col("stop_at") - F.length("content"))
