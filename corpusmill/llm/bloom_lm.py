"""Language-model scores from a log-frequency Bloom filter.

Words and pairs of neighbouring words are counted over all training texts. A count is quantised to a level, and an
n-gram of level q is put into the filter q times, once with each number from 1 to q; reading a count means to ask for
level after level until one is missing. The filter is made of one part for each bucket of hashes, eight bits for an
entry, and holds every word and pair, so it grows with the texts. Up to ``max_bytes`` it goes to every worker; a larger
one stays a table, and the distinct keys of each slice of texts (about 2 MB) go to the parts of their buckets. A part
reads what many slices ask at once, each key one time. Levels alone come back, in the order of the keys; the slice kept
the places that its tokens have in it. Both ways ask the same bits, so the scores do not depend on the bound.

A word's probability is that of the pair with absolute discounting, interpolated with add-one word probabilities. The
weight of the latter follows from the number of different successors, taken as a power of the context's count; the power
is solved for from the totals.

Base scores need exact counts. The most frequent words (at most ``frequent``) go to every worker; a training text's
word that is not among them when all words seen twice are, was seen once; the other words are looked up by a join.

Defined cases: a null text is empty and has the end token alone; without training texts N and V are 0; repeated rows are
learnt from and scored one by one; an empty table gives an empty table; only the id and the text are read.
"""

from __future__ import annotations

import math
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import arrow_map, in_slices, mixed, stored, utf8_column

START, END = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b"\0start", b"\0end"))
BASE, PROBES, BITS_PER_ENTRY, DISCOUNT = 1.25, 4, 8, 0.75
#: Tokens that are gathered before they are summed up.
CHUNK = 3_000_000
LEVELS = np.unique(np.ceil(BASE ** np.arange(0, 190, dtype=float))).astype(np.int64)
#: The middle of the counts of each level; level 0 is an absent n-gram.
MEANS = np.concatenate([[0.0], (LEVELS[:-1] + LEVELS[1:] - 1) / 2, LEVELS[-1:]])


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEVELS, counts, side="right")


def word_hasher(keep: int = 500_000):
    """A function from UTF-8 texts to arrays of word hashes, lower-cased in A-Z, each with the end token."""
    known: dict[bytes, int] = {}

    def hashed(texts: list[bytes]) -> list[np.ndarray]:
        split = [t.lower().split() for t in texts]
        new = set(chain.from_iterable(split)).difference(known)
        if len(known) + len(new) > keep:
            known.clear()
            new = set(chain.from_iterable(split))
        for w in new:
            known[w] = xxhash.xxh3_64_intdigest(w)
        return [np.append(np.fromiter(map(known.__getitem__, ws), dtype=np.uint64, count=len(ws)), END) for ws in split]

    return hashed


def pair_keys(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before each word (a start mark for a text's first), and the hash of both."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[np.cumsum(sizes) - sizes] = START
    with np.errstate(over="ignore"):
        return before, mixed(before * np.uint64(0x9E3779B97F4A7C15) + words)


def counted(docs: DataFrame, buckets: int, text: str = "text") -> DataFrame:
    """``pair`` (0 words, 1 pairs), ``bucket``, ``keys`` and ``counts`` (packed): sums over stretches of the texts."""
    shift = np.uint64(64 - int(math.log2(buckets)))

    def run(batches):
        hashed, held, size = word_hasher(), [], 0

        def summed():
            words = np.concatenate(held)
            _, pairs = pair_keys(words, np.array([len(h) for h in held]))
            for kind, every in enumerate((words, pairs)):
                keys, n = np.unique(every, return_counts=True)
                cuts = np.searchsorted(keys >> shift, np.arange(buckets + 1)) if buckets > 1 else np.array([0, len(keys)])
                full = [b for b in range(buckets) if cuts[b + 1] > cuts[b]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kind] * len(full), pa.int32()), pa.array(full, pa.int32()),
                     pa.array([keys[cuts[b] : cuts[b + 1]].tobytes() for b in full], pa.binary()),
                     pa.array([n[cuts[b] : cuts[b + 1]].astype(np.uint32).tobytes() for b in full], pa.binary())],
                    ["pair", "bucket", "keys", "counts"],
                )

        for batch in batches:
            texts = utf8_column(batch.column(0))
            for slice_ in in_slices(texts):
                some = hashed(slice_)
                held += some
                size += sum(map(len, some))
                if size >= CHUNK:
                    yield from summed()
                    held, size = [], 0
        if held:
            yield from summed()

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "pair int, bucket int, keys binary, counts binary")


def _merged(keys: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    every = np.frombuffer(b"".join(keys), dtype=np.uint64)
    n = np.frombuffer(b"".join(counts), dtype=np.uint32)
    if not len(every):
        return every, np.zeros(0, dtype=np.int64)
    order = np.argsort(every, kind="stable")
    every, n = every[order], n[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], np.diff(every) != 0]))
    return every[first], np.add.reduceat(n, first)


def _bits(keys: np.ndarray, level: int | np.ndarray, probe: int, width: int | np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        salt = np.asarray(level, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(probe * 0x632BE59B + 1)
        return mixed(keys ^ mixed(salt)) % np.asarray(width, dtype=np.uint64)


def filter_parts(sums: DataFrame) -> DataFrame:
    """One row per bucket: ``tokens``, ``n_words``, ``n_pairs``, sizes of the words by the power of two of their count
    (``spread``, ``spread_tokens``), the filter's part (``bits``, ``width``), and the words with their counts."""
    schema = "bucket int, tokens long, n_words long, n_pairs long, spread array<long>, spread_tokens array<long>, width long, bits binary, words binary, counts binary"
    names = [c.split()[0] for c in schema.split(", ")]

    def part(table: pa.Table) -> pa.Table:
        kind = table.column("pair").to_pylist()
        keys, counts = table.column("keys").to_pylist(), table.column("counts").to_pylist()
        (words, n1), (pairs, n2) = (_merged([k for k, x in zip(keys, kind) if x == y], [c for c, x in zip(counts, kind) if x == y]) for y in (0, 1))
        entries = [(words, level_of(n1)), (pairs, level_of(n2))]
        width = max(64, BITS_PER_ENTRY * sum(int(q.sum()) for _, q in entries))
        bits = np.zeros(width, dtype=bool)
        for x, q in entries:
            for level in range(1, int(q.max(initial=0)) + 1):
                x, q = x[q >= level], q[q >= level]
                for probe in range(PROBES):
                    bits[_bits(x, level, probe, width)] = True
        power = np.floor(np.log2(np.maximum(n1, 1))).astype(np.int64)
        spread = np.bincount(power, minlength=48), np.bincount(power, weights=n1, minlength=48).astype(np.int64)
        row = [table.column("bucket")[0].as_py(), int(n1.sum()), len(words), len(pairs), *(s.tolist() for s in spread), width, np.packbits(bits).tobytes(), words.tobytes(), n1.astype(np.int64).tobytes()]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

    return sums.groupBy("bucket").applyInArrow(part, schema)


class Model(NamedTuple):
    """What goes to every worker: the filter's bits (None where they stay a table), where each bucket's part begins and
    how wide it is, the totals, the power for successors, and the most frequent words with their exact counts
    (``floor``: all words with that count)."""

    bits: np.ndarray | None
    begins: np.ndarray
    widths: np.ndarray
    tokens: int
    n_words: int
    n_texts: int
    power: float
    words: np.ndarray
    counts: np.ndarray
    floor: int


def successor_power(spread: np.ndarray, spread_tokens: np.ndarray, n_pairs: int) -> float:
    """The power of a context's count whose sum over all contexts is the number of different pairs."""
    mean = spread_tokens / np.maximum(spread, 1)
    low, high = 0.0, 1.0
    for _ in range(50):
        at = (low + high) / 2
        low, high = (at, high) if (spread * np.maximum(mean, 1) ** at).sum() < n_pairs else (low, at)
    return (low + high) / 2


def fitted(docs: DataFrame, text: str = "text", max_bytes: int = 256 << 20, frequent: int = 4_000_000) -> tuple[Model, DataFrame]:
    """The model of all ``docs``, and the exact counts of all their words (``word``, ``c``) as a table."""
    return fitted_parts(docs, text, max_bytes, frequent)[:2]


def fitted_parts(docs: DataFrame, text: str, max_bytes: int, frequent: int) -> tuple[Model, DataFrame, DataFrame]:
    """``fitted``, and the filter's parts (``bucket``, ``width``, ``bits``) as a table."""
    spark = docs.sparkSession
    buckets = 1 << max(4, math.ceil(math.log2(4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    n_texts = docs.count()
    parts = stored(filter_parts(counted(docs, buckets, text)), "lm-parts")
    rows = parts.select("bucket", "tokens", "n_words", "n_pairs", "spread", "spread_tokens", "width", F.length("bits").alias("size")).collect()
    begins, widths = np.zeros(buckets, dtype=np.int64), np.ones(buckets, dtype=np.int64)
    for r, end in zip(rows, np.cumsum([r["size"] for r in rows]).tolist()):
        begins[r.bucket], widths[r.bucket] = (end - r["size"]) * 8, r.width
    bits = None
    if (size := sum(r["size"] for r in rows)) <= max_bytes:
        bits = np.zeros(size + 1, dtype=np.uint8)  # filled part by part
        for r in parts.select("bucket", "bits").toLocalIterator():
            at = int(begins[r.bucket]) // 8
            bits[at : at + len(r.bits)] = np.frombuffer(r.bits, dtype=np.uint8)
    spread, spread_tokens = (np.sum([r[n] for r in rows], axis=0) if rows else np.zeros(48, dtype=np.int64) for n in ("spread", "spread_tokens"))
    # The smallest power of two such that not too many words have that count.
    more = np.cumsum(spread[::-1])[::-1]
    floor = 1 << int(np.argmax(more <= frequent))

    def make_frequent():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = np.frombuffer(c, dtype=np.int64)
                out.append((np.frombuffer(w, dtype=np.uint64)[n >= floor].tobytes(), n[n >= floor].astype(np.uint64).tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*out)], ["words", "counts"])

        return each

    n = int(more[int(math.log2(floor))]) if rows else 0
    words, counts, at = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64), 0  # `frequent` entries of 16 bytes
    for r in arrow_map(parts.select("words", "counts"), make_frequent, "words binary, counts binary").toLocalIterator():
        some = np.frombuffer(r.words, dtype=np.uint64)
        words[at : at + len(some)], counts[at : at + len(some)] = some, np.frombuffer(r.counts, dtype=np.uint64)
        at += len(some)
    order = np.argsort(words)
    model = Model(
        bits, begins, widths, sum(r.tokens for r in rows), sum(r.n_words for r in rows), n_texts,
        successor_power(spread, spread_tokens, sum(r.n_pairs for r in rows)), words[order], counts[order], floor,
    )

    def make_rows():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            w = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.int64)
            n = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(w[n < floor]), pa.array(n[n < floor])], ["word", "c"])

        return each

    return model, arrow_map(parts.select("words", "counts"), make_rows, "word long, c long"), parts.select("bucket", "width", "bits")


def buckets_of(model: Model, keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - int(math.log2(len(model.begins))))).astype(np.int64)


def counts_in_filter(model: Model, keys: np.ndarray) -> np.ndarray:
    """The count that each key has by the filter."""
    bucket = buckets_of(model, keys)
    return MEANS[levels_in(model.bits, keys, model.begins[bucket], model.widths[bucket])]


def levels_in(bits: np.ndarray, keys: np.ndarray, begin: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Level after level of each key, while all its bits are set in its part (``begin``, ``width``)."""
    level = np.zeros(len(keys), dtype=np.int64)
    alive = np.arange(len(keys))
    while len(alive) and level[alive[0]] < len(LEVELS):
        nxt = level[alive] + 1
        for probe in range(PROBES):
            at = begin[alive] + _bits(keys[alive], nxt, probe, width[alive]).astype(np.int64)
            hit = (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            alive, nxt = alive[hit], nxt[hit]
        level[alive] += 1
    return level


def log_probabilities(model: Model, words: np.ndarray, sizes: np.ndarray, one: np.ndarray, where_one: np.ndarray) -> np.ndarray:
    """log10 of each word's probability after the word before it; ``one[where_one]`` are the words."""
    two, where_two = np.unique(pair_keys(words, sizes)[1], return_inverse=True)
    return logs_of_counts(model, counts_in_filter(model, one)[where_one], counts_in_filter(model, two)[where_two], sizes)


def logs_of_counts(model: Model, cw: np.ndarray, c2: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 of each word's probability by the filter's counts of the words and of the pairs that they end."""
    cv = np.empty_like(cw)
    cv[1:] = cw[:-1]
    cv[np.cumsum(sizes) - sizes] = model.n_texts
    p1 = (cw + 1) / (model.tokens + model.n_words + 1)
    c2 = np.where(cw > 0, np.minimum(c2, np.minimum(cv, cw)), 0)
    back = np.minimum(1.0, DISCOUNT * np.maximum(cv, 1) ** (model.power - 1))
    p2 = np.maximum(c2 - DISCOUNT, 0) / np.maximum(cv, 1) + back * p1
    return np.log10(np.where(cv > 0, np.minimum(p2, 1.0), p1))


def asked_keys(model: Model, words: np.ndarray, sizes: np.ndarray) -> tuple[list[dict], np.ndarray]:
    """The distinct words and pairs of a slice of texts, dealt by bucket: ``bucket``, ``keys`` (ascending, packed); and the
    place that each word, then each pair, has among them."""
    keys, places = np.unique(np.concatenate([words, pair_keys(words, sizes)[1]]), return_inverse=True)
    full, starts = np.unique(buckets_of(model, keys), return_index=True)
    return [{"bucket": b, "keys": some.tobytes()} for b, some in zip(full.tolist(), np.split(keys, starts[1:]))], places


def packed(places: np.ndarray) -> bytes:
    """Compressed 32-bit numbers, their lowest bytes first, then the next, as the high ones hardly differ."""
    return pa.compress(places.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    some = pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(some, dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel()


#: Keys that are looked up at once, and tokens of the training texts for each task that looks up.
ASKED, TASK_TOKENS = 1_000_000, 2_000_000


def levels_of_asks(asks: list[np.ndarray], bits: np.ndarray, width: int) -> list[np.ndarray]:
    """The levels of the keys of each ask in one part; what several ask is looked up once."""
    keys, places = np.unique(np.concatenate(asks), return_inverse=True)
    level = levels_in(bits, keys, np.zeros(len(keys), np.int64), np.full(len(keys), width)).astype(np.uint8)
    return np.split(level[places], np.cumsum([len(a) for a in asks])[:-1])


def looked_up(asks: DataFrame, parts: DataFrame, tasks: int) -> DataFrame:
    """``chunk``, ``bucket`` and ``levels`` (packed) of ``asks`` (chunk, bucket, keys). A task reads its buckets one after
    another: first the part, then what is asked of it, so it holds one part whatever the number of slices."""
    no = lambda kind: F.lit(None).cast(kind)
    rows = parts.select("bucket", no("long").alias("chunk"), "width", "bits", no("binary").alias("keys"))
    rows = rows.unionByName(asks.select("bucket", "chunk", no("long").alias("width"), no("binary").alias("bits"), "keys"))

    def make():
        have, width, bits = -1, 0, None

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal have, width, bits
            out: list[tuple] = []
            held: list[tuple] = []
            size = 0

            def answer():
                nonlocal held, size
                if held:
                    asked = [k for _, k in held]
                    # A bucket without a part holds no n-gram.
                    levels = levels_of_asks(asked, bits, width) if have == now else [np.zeros(len(k), np.uint8) for k in asked]
                    out.extend((chunk, now, x.tobytes()) for (chunk, _), x in zip(held, levels))
                held, size = [], 0

            now = -1
            for bucket, chunk, w, part, keys in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now or size >= ASKED:
                    answer()
                    now = bucket
                if part is not None:
                    have, width, bits = bucket, w, np.frombuffer(part, dtype=np.uint8)
                    continue
                held.append((chunk, np.frombuffer(keys, dtype=np.uint64)))
                size += len(held[-1][1])
            answer()
            kinds = (pa.int64(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else [()] * 3, kinds)], ["chunk", "bucket", "levels"])

        return each

    # Nulls come first: the part before the asks.
    rows = rows.repartition(tasks, "bucket").sortWithinPartitions("bucket", "chunk").select("bucket", "chunk", "width", "bits", "keys")
    return arrow_map(rows, make, "chunk long, bucket int, levels binary", 2000)


def scores_by_table(first: DataFrame, parts: DataFrame, sent, tasks: int) -> DataFrame:
    """``_row`` and ``by_table`` (the score) of the rows of ``first`` (row, slice, asks), by the filter as a table."""
    levels = looked_up(first.select(F.col("row").alias("chunk"), F.explode("asks").alias("a")).select("chunk", "a.*"), parts, tasks)
    no = lambda kind: F.lit(None).cast(kind)
    both = first.where("slice is not null").select(F.col("row").alias("chunk"), no("int").alias("bucket"), "slice.*", no("binary").alias("levels"))
    both = both.unionByName(levels.select("chunk", "bucket", *[no("binary").alias(c) for c in ("rows", "sizes", "places")], "levels"))
    # Nulls come first: the slice, then its levels, bucket after bucket, so in the order of all its keys.
    both = both.repartition("chunk").sortWithinPartitions("chunk", "bucket").select("rows", "sizes", "places", "levels")

    def run(batches):
        m = Model(*sent.value)
        held, levels = None, []

        def scores() -> pa.RecordBatch:
            rows, sizes = (np.frombuffer(x, dtype=np.int64) for x in held[:2])
            n = int(sizes.sum())
            counts = MEANS[np.frombuffer(b"".join(levels), dtype=np.uint8)][unpacked(held[2], 2 * n)]
            logs = logs_of_counts(m, counts[:n], counts[n:], sizes)
            score = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=logs, minlength=len(sizes))
            return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(score)], ["_row", "by_table"])

        for batch in batches:
            for *slice_, level in zip(*(c.to_pylist() for c in batch.columns)):
                if level is not None:
                    levels.append(level)
                    continue
                if held:
                    yield scores()
                held, levels = slice_, []
        if held:
            yield scores()

    return both.mapInArrow(run, "_row long, by_table double")


def scored(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", max_bytes: int = 256 << 20, frequent: int = 4_000_000) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and
    ``score``; learnt from the rows that are not held out."""
    rows = docs.select(F.col(key).alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text"))
    model, rest, parts = fitted_parts(rows.where(~F.col("held_out")), "text", max_bytes, frequent)
    by_table = model.bits is None
    sent = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def make():
        hashed, m = word_hasher(), Model(*sent.value)
        total = math.log10(m.tokens + m.n_words + 1)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            held, rows_ = batch.column("held_out").to_numpy(zero_copy_only=False), batch.column("row").to_pylist()
            texts = utf8_column(batch.column("text"))
            out: list[tuple] = []
            at = 0
            for slice_ in in_slices(texts):
                some = hashed(slice_)
                own, at = held[at : at + len(some)], at + len(some)
                sizes = np.array([len(s) for s in some])
                words, owner = np.concatenate(some), np.repeat(np.arange(len(some)), sizes)
                one, where_one = np.unique(words, return_inverse=True)
                logs = np.zeros(len(words)) if by_table else log_probabilities(m, words, sizes, one, where_one)
                place = np.minimum(np.searchsorted(m.words, one), max(0, len(m.words) - 1))
                c = np.where(m.words[place] == one, m.counts[place].astype(np.int64), -1) if len(m.words) else np.full(len(one), -1)
                c = c[where_one]
                # If every word seen twice is here, the others in a training text were seen once.
                once = (c < 0) & ~own[owner] & (m.floor == 2)
                none = (c < 0) & (m.floor == 1)
                c = np.where(once, 1, np.where(none, 0, c))
                ask = c < 0
                base = np.bincount(owner, weights=np.where(ask, 0, np.log10(np.maximum(c, 0) + 1) - total), minlength=len(some))
                known = np.bincount(owner, weights=c > 0, minlength=len(some)).astype(np.int64)
                score = np.bincount(owner, weights=logs, minlength=len(some))
                asked = np.split(words[ask].view(np.int64), np.cumsum(np.bincount(owner[ask], minlength=len(some)))[:-1])
                more = []
                if by_table:
                    asks, places = asked_keys(m, words, sizes)
                    own_rows = np.array(rows_[at - len(some) : at], dtype=np.int64)
                    whole = {"rows": own_rows.tobytes(), "sizes": sizes.astype(np.int64).tobytes(), "places": packed(places)}
                    more = [[x] + [None] * (len(some) - 1) for x in (whole, asks)]
                out += zip(sizes.tolist(), known.tolist(), base.tolist(), score.tolist(), asked, *more)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()))
            if by_table:
                kinds += (pa.struct([(x, pa.binary()) for x in ("rows", "sizes", "places")]), pa.list_(pa.struct([("bucket", pa.int32()), ("keys", pa.binary())])))
            return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *(pa.array(x, k) for x, k in zip(zip(*out), kinds))], names)

        return each

    schema = rows.select(F.lit(0).cast("bigint").alias("row"), "doc_id", "held_out").schema
    names = ["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "ask"]
    more = ""
    if by_table:
        names += ["slice", "asks"]
        more = ", slice struct<rows: binary, sizes: binary, places: binary>, asks array<struct<bucket: int, keys: binary>>"
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    first = stored(arrow_map(numbered, make, f"{fields}, n_tokens long, known long, base double, score double, ask array<long>{more}"), "lm-scores")
    total = math.log10(model.tokens + model.n_words + 1)
    asked = first.select("row", F.explode("ask").alias("word")).join(rest, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    asked = asked.groupBy(F.col("row").alias("_row")).agg(F.sum(F.log10(F.col("c") + 1) - total).alias("more_base"), F.sum((F.col("c") > 0).cast("bigint")).alias("more_known"))
    out = first.drop("ask").join(asked, F.col("row") == F.col("_row"), "left").drop("_row")
    if by_table:
        tasks = min(len(model.begins), max(docs.sparkSession.sparkContext.defaultParallelism, model.tokens // TASK_TOKENS))
        out = out.join(scores_by_table(first.select("row", "slice", "asks"), parts, sent, tasks), F.col("row") == F.col("_row"))
        out = out.withColumn("score", F.col("by_table"))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), "score",
    )
