"""Named chunkers, embedders, retrievers, rerankers and extractors, and the hooks around them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from corpusmill.operators import chunking, retrieval
from corpusmill.sources import corpus

KINDS = ("extractor", "chunker", "embedder", "retriever", "reranker")
_ENTRIES: dict[tuple[str, str], Callable] = {}


def register(kind: str, name: str, fn: Callable) -> None:
    """``fn`` maps DataFrames (or Columns) to one; a later entry of the same name replaces the earlier."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}, expected one of {KINDS}")
    _ENTRIES[kind, name] = fn


def get(kind: str, name: str) -> Callable:
    try:
        return _ENTRIES[kind, name]
    except KeyError:
        raise KeyError(f"no {kind} named {name!r}; there are {names(kind)}") from None


def names(kind: str) -> list[str]:
    return sorted(n for k, n in _ENTRIES if k == kind)


for _name, _fn in {
    "chars": chunking.chunk_chars, "blocks": chunking.chunk_blocks, "paragraphs": chunking.chunk_paragraphs,
    "recursive": chunking.chunk_recursive, "hybrid": chunking.chunk_hybrid, "sandwich": chunking.chunk_sandwich,
}.items():
    register("chunker", _name, _fn)
for _name, _fn in {
    "bm25": retrieval.bm25_topk, "vector": retrieval.vector_topk, "vector_ann": retrieval.vector_ann,
    "overlap": retrieval.overlap_topk, "hybrid": retrieval.hybrid_topk,
}.items():
    register("retriever", _name, _fn)
register("reranker", "score", retrieval.rerank)
register("extractor", "pages", corpus.extract_pages)
register("extractor", "delimited", corpus.rows_to_markdown)


def hashing_embedder(dim: int) -> Column:
    """Arrow function: unit vector of hashed word counts. A stand-in where no model is at hand."""

    @F.pandas_udf(S.ArrayType(S.DoubleType()))
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        slots: dict[str, int] = {}

        def one(text: str) -> np.ndarray:
            v = np.zeros(dim)
            for word in re.findall("[a-z0-9]+", (text or "").lower()):
                if word not in slots:
                    slots[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dim
                v[slots[word]] += 1
            norm = np.sqrt((v * v).sum())
            return v / norm if norm else v

        for texts in batches:
            yield texts.map(one)
            if len(slots) > 1_000_000:
                slots.clear()

    return vectors


def embed(df: DataFrame, models: dict[str, Callable], text: str = "text", limits: dict[str, int] | None = None) -> DataFrame:
    """One row per (row, model) with its vector and whether its text was cut. ``models`` map a text column to a vector
    column and run on Arrow batches; ``limits`` gives the characters that a model can read, where it has a limit."""
    out = None
    for name, fn in models.items():
        limit = (limits or {}).get(name)
        body = F.col(text) if limit is None else F.left(F.col(text), F.lit(limit))
        cut = F.lit(False) if limit is None else F.coalesce(F.length(text) > limit, F.lit(False))
        one = df.withColumn("model", F.lit(name)).withColumn("vector", fn(body)).withColumn("truncated", cut)
        out = one if out is None else out.unionByName(one)
    return out


def transformed(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Post-extract transformations in order."""
    for step in steps:
        df = df.transform(step)
    return df


def filtered(df: DataFrame, criteria: dict[str, object] | None = None, *conditions: Column) -> DataFrame:
    """Rows whose columns equal the criteria (a list means any of) and meet the conditions."""
    for name, value in (criteria or {}).items():
        df = df.where(F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    for condition in conditions:
        df = df.where(condition)
    return df
