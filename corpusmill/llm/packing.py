"""Best-fit packing into bins of several permitted sequence lengths.

Documents longer than the largest length are cut into pieces of it; nothing is dropped. A block of pieces is packed at
a time, longest first: a piece goes into the open bin with the least room that still holds it. If none does, a new bin
is opened with the size that costs least for each token it is likely to hold: the room beside the piece is filled in
thought with the longest remaining pieces that fit, and the bin that this would make is priced after downsizing. At the
end each bin shrinks to the smallest permitted length that holds its contents.

Blocks are cut from the rows of a task as they come, so nothing is shuffled, no key can be hot, and a task holds one
block of lengths. Bin ids name the task's partition, the block and the bin; a task that runs again packs alike.

Defined cases: a null or negative length counts as 0; a row of length 0 gets one piece of length 0 in no bin (null
``bin_id``, ``bin_size`` 0); equal rows are packed one by one; an empty table gives an empty table. Columns of the input
are kept in the struct ``row`` whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIZES = (512, 1024, 2048, 4096, 8192)
BLOCK = 32_768


def bin_cost(size: int, overhead: float = 16.0, attention: float = 32_768.0) -> float:
    """Cost of a sequence: its tokens, what attention adds with the square of the length, and a fixed part."""
    return overhead + size + size * size / attention


def best_fit(lengths: Sequence[int], sizes: Sequence[int] = SIZES, steps: int = 16) -> tuple[list[int], list[int], list[int]]:
    """The bin and the offset of each piece, and the size of each bin. Lengths are from 1 to the largest size."""
    sizes = sorted(sizes)
    shrunk = {}  # contents to the smallest size that holds them, asked for again and again
    left: dict[int, int] = defaultdict(int)
    there = 0  # bit n: pieces of length n remain
    for n in lengths:
        left[n] += 1
        there |= 1 << n
    bins, at, content, roomy = [0] * len(lengths), [0] * len(lengths), [], defaultdict(list)
    room_bits = 0  # bit n: open bins with n tokens of room

    def holds(n: int) -> int:
        if n not in shrunk:
            shrunk[n] = next(s for s in sizes if s >= n)
        return shrunk[n]

    def filled(n: int, size: int) -> int:
        """What a bin of ``size`` that starts with ``n`` is likely to hold."""
        gap = size - n
        for _ in range(steps):
            fit = (there & ((2 << gap) - 1)).bit_length() - 1
            if fit < 1:
                break
            gap -= fit * min(left[fit], gap // fit)
            if gap >= fit:  # all pieces of this length are used: look below it
                fit = (there & ((1 << fit) - 1)).bit_length() - 1
                if fit < 1:
                    break
                gap -= fit * min(left[fit], gap // fit)
        return size - gap

    for i in np.argsort(-np.asarray(lengths, dtype=np.int64), kind="stable"):
        n = lengths[i]
        left[n] -= 1
        if not left[n]:
            there &= ~(1 << n)
        fits = room_bits >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = roomy[room].pop()
            if not roomy[room]:
                room_bits &= ~(1 << room)
        else:
            likely = [(bin_cost(holds(f := filled(n, s))) / f, s) for s in sizes if s >= n]
            room = min(likely)[1]
            b = len(content)
            content.append(0)
        bins[i], at[i] = b, content[b]
        content[b] += n
        if room > n:
            roomy[room - n].append(b)
            room_bits |= 1 << (room - n)
    return bins, at, [holds(c) for c in content]


def pack(rows: DataFrame, length: Column, sizes: Sequence[int] = SIZES, block: int = BLOCK) -> DataFrame:
    """One row per piece: ``row``, ``piece`` (from 0), ``piece_start``, ``piece_length``, ``bin_id``, ``bin_size``, ``bin_offset``."""
    top = max(sizes)
    n = F.greatest(F.coalesce(length.cast("bigint"), F.lit(0)), F.lit(0).cast("bigint"))
    last = F.greatest(F.floor((F.col("n") - 1) / top), F.lit(0))
    pieces = rows.select(F.struct("*").alias("row"), n.alias("n")).select("row", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
    pieces = pieces.select(
        "row", "piece", (F.col("piece") * top).alias("piece_start"),
        F.least(F.col("n") - F.col("piece") * top, F.lit(top).cast("bigint")).alias("piece_length"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held, count = [], 0

        def packed(table: pa.Table) -> Iterator[pa.RecordBatch]:
            lengths = table.column("piece_length").to_numpy()
            real = np.flatnonzero(lengths)
            bins, at, size = best_fit(lengths[real].tolist(), sizes)
            ids, widths, offsets = [None] * len(lengths), np.zeros(len(lengths), np.int32), np.zeros(len(lengths), np.int64)
            for i, b, o in zip(real, bins, at):
                ids[i], widths[i], offsets[i] = f"{part}-{number}-{b}", size[b], o
            table = table.append_column("bin_id", pa.array(ids, pa.string())).append_column("bin_size", pa.array(widths)).append_column("bin_offset", pa.array(offsets))
            yield from table.to_batches(max_chunksize=10_000)

        for batch in batches:
            while batch.num_rows:
                some = batch.slice(0, block - count)
                held.append(some)
                count += some.num_rows
                batch = batch.slice(some.num_rows)
                if count == block:
                    yield from packed(pa.Table.from_batches(held))
                    held, count, number = [], 0, number + 1
        if count:
            yield from packed(pa.Table.from_batches(held))

    extra = T.StructType().add("bin_id", "string").add("bin_size", "integer").add("bin_offset", "long")
    return pieces.mapInArrow(run, T.StructType([*pieces.schema.fields, *extra.fields]))
