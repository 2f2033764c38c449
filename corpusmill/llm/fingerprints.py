"""Document fingerprints from improbable byte windows.

Every window of 64 bytes has an entropy. Over the whole corpus the entropies make a histogram, and a window's rank is
how rare its entropy is there (windows of very low or very high entropy are left out: they are padding or noise). Among
each 64 neighbouring windows the rarest, leftmost on a tie, gets a point; windows with enough points are the document's
features. Each feature sets five bits of a Bloom filter of 2048 bits; after 160 features the next filter of the chain
begins. Two fingerprints are compared by the bits that filters share, less what chance would share, as a part of the
most they could share: each filter of the shorter chain takes its best partner in the longer one.

A fingerprint is text: the number of features in each filter and the filters in base 64. Equal texts have equal
fingerprints under one set of ranks.

Defined cases: a null text is empty; a text in which no window has enough points (all alike, or few) takes the 16 windows
with the least hashes; a text shorter than a window has one feature, its whole bytes, and is like nothing but a text
with the same bytes; the fingerprint of the empty text is empty, and it is like
the empty text alone. Rows with one id follow one another in text order, null ids come first. An empty table gives an
empty table; only the id and the text are read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import arrow_map, mixed, utf8_column

WINDOW, POINTS = 64, 16
BITS, PER_FILTER, HASHES = 2048, 160, 5
#: Features of a text in which no window has enough points.
LEAST = 16
#: Entropies are counted in thousandths of the most that a window can have (6 bits).
CELLS, LOW, HIGH = 1001, 100, 990
SLICE = 1 << 18


def _window_entropies(data: np.ndarray) -> np.ndarray:
    """The entropy cell of each window of ``data`` (bytes), by whole-number sums, so that it hangs on the window alone."""
    n = len(data)
    if n < WINDOW:
        return np.empty(0, dtype=np.int32)
    c = np.arange(WINDOW + 2)
    g = np.rint(c * np.log2(np.maximum(c, 1)) * (1 << 20)).astype(np.int64)
    back, ahead = np.ones(n, dtype=np.uint8), np.ones(n, dtype=np.uint8)
    for k in range(1, WINDOW):
        same = data[k:] == data[:-k]
        back[k:] += same
        ahead[:-k] += same
    first = np.bincount(data[:WINDOW], minlength=256)
    # Going one byte on: the first byte leaves its window, then the next byte enters.
    leaves, enters = ahead[: n - WINDOW], back[WINDOW:]
    step = g[enters] - g[enters - 1] - g[leaves] + g[leaves - 1]
    sums = g[first].sum() + np.concatenate([[0], np.cumsum(step)])
    bits = 6.0 - sums / (WINDOW * float(1 << 20))
    return np.clip(np.rint(bits * (1000 / 6)), 0, 1000).astype(np.int32)


def entropy_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``cell`` and ``n``: how many windows of all whole texts have each entropy."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            total = np.zeros(CELLS, dtype=np.int64)
            for part, ends in joined(utf8_column(batch.column(0))):
                cells = _window_entropies(part)
                total += np.bincount(cells[inside(ends, len(cells))], minlength=CELLS)
            cells = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total[cells])], ["cell", "n"])

        return each

    return arrow_map(docs.select(F.col(text).alias("text")), make, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def joined(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts laid end to end in arrays of a bounded size (a longer text makes one of its own), and where each ends."""
    at = 0
    while at < len(texts):
        size, to = 0, at
        while to < len(texts) and (to == at or size + len(texts[to]) <= SLICE):
            size += len(texts[to])
            to += 1
        yield np.frombuffer(b"".join(texts[at:to]), dtype=np.uint8), np.cumsum([len(t) for t in texts[at:to]])
        at = to


def inside(ends: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` windows lie in one text."""
    ok = np.ones(n + WINDOW, dtype=bool)
    for e in ends[:-1]:
        ok[max(0, e - WINDOW + 1) : e] = False
    return ok[:n]


def rarity_ranks(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The rank of each entropy cell, 0 for the rarest; cells out of bounds get the last rank, which is no feature."""
    counts = np.zeros(CELLS, dtype=np.int64)
    for row in entropy_counts(docs, text).collect():  # one row per cell
        counts[row.cell] = row.n
    ranks = np.empty(CELLS, dtype=np.int16)
    ranks[np.lexsort((np.arange(CELLS), counts))] = np.arange(CELLS)
    ranks[:LOW] = ranks[HIGH:] = CELLS
    return ranks


def features(data: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The starts of the windows of one text's bytes that are its features."""
    return _points(ranks[_window_entropies(data)])


def _points(rank: np.ndarray) -> np.ndarray:
    n = len(rank)
    if not n:
        return np.empty(0, dtype=np.int64)
    key = (rank.astype(np.int64) << 40) | np.arange(n)
    width = 1
    while width < min(WINDOW, n):  # the least of `width` neighbours, then of twice as many
        step = min(width, min(WINDOW, n) - width)
        key = np.minimum(key[:-step], key[step:])
        width += step
    best = key & ((1 << 40) - 1)
    points = np.bincount(best, minlength=n)
    return np.flatnonzero((points >= POINTS) & (rank < CELLS))


def _hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    rows = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[starts]
    words = np.ascontiguousarray(rows).view("<u8")
    h = np.full(len(starts), WINDOW, dtype=np.uint64)
    for k in range(words.shape[1]):
        h = mixed(h + words[:, k])
    return h


def filters(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chain of filters (rows of bits) of the features in order, and how many features each holds."""
    n = len(hashes)
    rows = np.arange(n) // PER_FILTER
    bits = np.zeros((int(rows[-1]) + 1 if n else 0, BITS), dtype=np.uint8)
    for k in range(HASHES):
        bits[rows, (hashes >> np.uint64(11 * k)) & np.uint64(BITS - 1)] = 1
    return bits, np.bincount(rows) if n else np.empty(0, dtype=np.int64)


def digest(data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Filters, their counts, and whether the one feature is the whole text."""
    if not data:
        return (*filters(np.empty(0, dtype=np.uint64)), True)
    if not len(starts) and len(data) >= WINDOW:  # windows all alike, or few: those with the least hashes
        every = np.frombuffer(data, dtype=np.uint8)
        ends = len(data) - WINDOW + 1
        least = [np.unique(_hashes(every, np.arange(a, min(a + SLICE, ends))))[:LEAST] for a in range(0, ends, SLICE)]
        return (*filters(np.unique(np.concatenate(least))[:LEAST]), False)
    if not len(starts):
        whole = np.frombuffer(hashlib.blake2b(data, digest_size=8).digest(), dtype="<u8")
        return (*filters(whole.astype(np.uint64)), True)
    return (*filters(_hashes(np.frombuffer(data, dtype=np.uint8), starts)), False)


def as_text(bits: np.ndarray, counts: np.ndarray, whole: bool) -> str:
    if not len(counts):
        return ""
    packed = base64.b64encode(np.packbits(bits, axis=1).tobytes()).decode()
    return f"{'whole' if whole else 'parts'}:{','.join(map(str, counts))}:{packed}"


def from_text(text: str) -> tuple[np.ndarray, np.ndarray, bool]:
    """Reads back ``as_text``."""
    if not text:
        return np.zeros((0, BITS), dtype=np.uint8), np.empty(0, dtype=np.int64), True
    kind, counts, packed = text.split(":")
    counts = np.array(counts.split(","), dtype=np.int64)
    return np.unpackbits(np.frombuffer(base64.b64decode(packed), dtype=np.uint8).reshape(len(counts), -1), axis=1), counts, kind == "whole"


def likeness(one: tuple[np.ndarray, np.ndarray, bool], other: tuple[np.ndarray, np.ndarray, bool]) -> float:
    """From 0 (no more shared bits than by chance) to 1 (all that could be shared)."""
    (a, na, whole_a), (b, nb, whole_b) = one, other
    if whole_a or whole_b or not len(na) or not len(nb):
        return float(whole_a == whole_b and a.shape == b.shape and bool((a == b).all()))
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if (len(nb), nb.sum()) < (len(na), na.sum()):
        a, na, b, nb = b, nb, a, na
    shared = a.astype(np.float32) @ b.astype(np.float32).T
    in_a, in_b = a.sum(axis=1, dtype=np.int64)[:, None], b.sum(axis=1, dtype=np.int64)[None, :]
    chance = in_a * in_b / BITS
    most = np.minimum(in_a, in_b)
    part = np.clip((shared - chance) / np.maximum(most - chance, 1e-9), 0, 1)
    # A partner with far fewer features could not hold what this filter holds.
    fair = np.minimum(1.0, nb[None, :] / na[:, None])
    return float(np.clip((part * fair).max(axis=1) @ na / na.sum(), 0, 1))


def successors(docs: DataFrame, key: str = "doc_id", text: str = "text", rows_per_part: int = 4000) -> DataFrame:
    """Texts dealt into id ranges: ``part``, ``extra``, ``doc_id``, ``text``, each part sorted in itself. The first row of
    a part is there once more at the end of the part before it (``extra``), so that each row's next row is in its part;
    the first of all follows the last. One exchange; an id range holds about ``rows_per_part`` rows, but ranges are at
    most 10,000."""
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = rows.count()
    parts = max(1, min(10_000, n // rows_per_part))
    shares = [i / parts for i in range(1, parts)]
    cuts = rows.agg(F.percentile_approx("doc_id", F.lit(shares) if len(shares) != 1 else F.array(F.lit(shares[0])), 10_000)).head()[0] if shares else []
    rows = rows.withColumn("part", _part_of(F.col("doc_id"), sorted(set(cuts or []))))
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id"))["doc_id"]
    heads = {r.part: r.head for r in rows.groupBy("part").agg(first.alias("head")).collect()}  # one row per part
    order = sorted(heads)
    every = range(max(order, default=0) + 1)
    before = {p: order[i - 1] for i, p in enumerate(order)}
    copies = F.array(F.struct(F.col("part"), F.lit(False).alias("extra")))
    here = (F.col("part") + 1).cast("int")
    head = F.element_at(F.array(*[F.lit(heads.get(p)).cast("bigint") for p in every]), here)
    earlier = F.element_at(F.array(*[F.lit(before.get(p)).cast("int") for p in every]), here)
    rows = rows.withColumn("before", F.when(F.col("doc_id").eqNullSafe(head), earlier))
    both = F.when(F.col("before").isNotNull(), F.concat(copies, F.array(F.struct(F.col("before").alias("part"), F.lit(True).alias("extra"))))).otherwise(copies)
    rows = rows.select("doc_id", "text", F.explode(both).alias("to")).select("to.part", "to.extra", "doc_id", "text")
    width = max(len(order), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(width, "part").sortWithinPartitions("part", "extra", F.col("doc_id").asc_nulls_first(), "text")


def _part_of(doc_id: Column, cuts: list[int], width: int = 100) -> Column:
    """How many of the sorted ``cuts`` lie at or below the id, in two steps of at most ``width`` comparisons or so."""
    if not cuts:
        return F.lit(0)
    groups = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    not_above = lambda numbers: F.size(F.filter(numbers, lambda c: c <= doc_id))
    group = not_above(F.array(*[F.lit(g[0]) for g in groups]))
    inner = F.element_at(F.array(*[F.array(*[F.lit(c) for c in g]) for g in groups]), F.greatest(group, F.lit(1)))
    return F.when(doc_id.isNull() | (group == 0), 0).otherwise((group - 1) * width + not_above(inner))


def fingerprints(docs: DataFrame, ranks: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited`` and ``near_next``. The edited text has its last quarter replaced by the beginning of the next text."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # the last row of a part so far, which has not met its next row

        def row(own: tuple, following: tuple) -> tuple:
            doc_id, text, data, rank, mine = own
            n = len(text)
            keep = n - n // 4
            head = text[:keep].encode()
            edited = head + following[1][: n // 4].encode()
            # Windows inside the part that stays have the ranks they had.
            stay = max(0, len(head) - WINDOW + 1)
            tail = np.frombuffer(edited[stay:], dtype=np.uint8)
            new_rank = np.concatenate([rank[:stay], ranks[_window_entropies(tail)]])
            changed = digest(edited, _points(new_rank)) if edited != data else mine
            return (
                doc_id, n, hashlib.sha256(edited).hexdigest(), as_text(*mine), as_text(*changed),
                likeness(mine, changed), likeness(mine, following[4]),
            )

        for batch in batches:
            cells = [c.to_pylist() for c in (batch.column("part"), batch.column("extra"), batch.column("doc_id"), batch.column("text"))]
            data = utf8_column(batch.column("text"))
            rank_of: list[np.ndarray] = []
            for stretch, ends in joined(data):
                rank = ranks[_window_entropies(stretch)]
                starts = np.concatenate([[0], ends[:-1]])
                rank_of += [rank[a : max(a, e - WINDOW + 1)] for a, e in zip(starts, ends)]
            out = []
            for part, extra, doc_id, text, raw, rank in zip(*cells, data, rank_of):
                now = (doc_id, text, raw, rank, digest(raw, _points(rank)))
                if waiting is not None and waiting[0] == part:
                    out.append(row(waiting[1], now))
                # Where the first id of the next part is repeated, only its first row follows.
                waiting = None if extra else (part, now)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2))], names)

    return successors(docs, key, text).mapInArrow(run, schema)
