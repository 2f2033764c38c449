"""Shared helpers: tables in the shared folder, Arrow batches, words, row-keeping."""

from __future__ import annotations

import ctypes
import gc
import sys
import uuid
from collections.abc import Callable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.session import checkpoint_dir, small_batches  # noqa: F401

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the folder that the driver and all executors share."""
    return f"{checkpoint_dir(spark)}/llm/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str, rows: int = 1 << 20) -> DataFrame:
    """``mapInArrow`` with one function per task: ``make()`` runs once in a task, so its caches live as long as the task.
    The function sees at most ``rows`` rows at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                if (out := each(batch.slice(at, rows))) is not None and out.num_rows:
                    yield out
        each = batch = out = None  # the caches too
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Hand memory that a task has freed back to the system: its worker stays, idle or for other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # glibc alone has it
        trim(0)


def worker_memory() -> dict:
    """What a Python worker keeps for its next tasks. The library reaches workers by value, so its own globals last for one
    task; the list of modules lasts as long as the worker."""
    return vars(sys.modules.setdefault("corpusmill_memory", ModuleType("corpusmill_memory")))


def utf8_column(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def in_slices(texts: list, size: int = 2_000_000):
    """Slices of ``texts`` (or bytes) of about ``size`` in all; a longer one makes a slice of its own."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield texts[start : i + 1]
            start, total = i + 1, 0
    if start < len(texts):
        yield texts[start:]


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list column from one numpy array per row."""
    ends = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=ends[1:])
    flat = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, type=kind))


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit bijection that spreads every bit over all others (xor-shift and multiply)."""
    x = np.asarray(x, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
