"""Near-duplicates by circulant MinHash: two permutations make every coordinate of the signature.

A document is the set of its word shingles, each hashed to 64 bits. One permutation scatters the hashed shingles over a
ring of places, a second one gives each place its value, and coordinate k is the least value when the second is turned
by k places. The values that a place has under all turns lie side by side, so a signature is a minimum over slices.

Copies (equal sets) are one *class*. Bands of six coordinates deal the classes into buckets. Small buckets compare all
their classes; a large one compares each class with its centre, which for a group of near copies is already enough to
join most. Then only pairs of different components are still open: large buckets that hold such pairs are dealt into
blocks of bounded size, and each pair of blocks is compared in a task that gives only the links of a forest, never the
pairs. Candidates pass a bound on set sizes and on the estimated similarity (six standard deviations wide), then are
confirmed on their full sets. A link that a signature's bands would miss has a chance of (1 - 0.8 ** 6) ** 48, less
than one in a million, at a similarity of exactly 0.8.

Defined cases: a null text, and one without words, has the empty set and links with nothing; a text of fewer words than
a shingle is one shingle; rows are told apart by a stored number, so ids may repeat or be null (a component has the
smallest id that is not null, and keeps one row of it); an empty table gives an empty table; only the id and the text
are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import arrow_map, give_back, in_slices, mixed, small_batches, stored, utf8_column
from corpusmill.llm.components import components
from corpusmill.operators.scale import broadcast_if_small

BANDS, ROWS, RING = 48, 6, 1 << 20
#: Buckets of so many classes compare all their pairs at once; classes of a block.
SMALL, BLOCK = 8, 1024
#: A threshold of 80 in 100, in whole numbers.
AT_LEAST = (80, 100)
#: Rows that a task sketches or confirms at once, classes that it remembers as sketched, hashes of sets that it keeps.
SLICE, SEEN, KEPT = 500, 50_000, 2_000_000


def shingle_hasher(words: int, keep: int = 100_000):
    """A function from UTF-8 texts to sorted arrays of distinct 64-bit shingle hashes."""
    turns = mixed(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
    known: dict[bytes, int] = {}

    def hashed(texts: list[bytes]) -> list[np.ndarray]:
        return [s for some in in_slices(texts) for s in of_slice(some)]

    def of_slice(texts: list[bytes]) -> list[np.ndarray]:
        split = [t.lower().split() for t in texts]
        new = set(chain.from_iterable(split)).difference(known)
        if len(known) + len(new) > keep:
            for w in list(known)[: len(known) // 2 + 1]:  # the older half
                del known[w]
            new = set(chain.from_iterable(split)).difference(known)
        for w in new:
            known[w] = xxhash.xxh3_64_intdigest(w)
        out = []
        for ws in split:
            h = np.fromiter(map(known.__getitem__, ws), dtype=np.uint64, count=len(ws))
            n = min(words, len(h))
            if not n:
                out.append(h)
                continue
            with np.errstate(over="ignore"):
                sums = np.full(len(h) - n + 1, n, dtype=np.uint64)
                for k in range(n):
                    sums += h[k : len(h) - n + 1 + k] * turns[k]
            out.append(np.unique(mixed(sums)))
        return out

    return hashed


def signer(bands: int = BANDS, rows: int = ROWS, ring: int = RING, seed: int = 7):
    """A function from a hashed set to its signature."""
    draw = np.random.default_rng(seed)
    scatter = draw.permutation(ring).astype(np.uint32)
    values = draw.permutation(ring).astype(np.uint32)
    k = bands * rows
    turned = np.lib.stride_tricks.sliding_window_view(np.concatenate([values, values[:k]]), k)

    def sign(hashes: np.ndarray) -> np.ndarray:
        places = scatter[hashes & np.uint64(ring - 1)]
        least = np.full(k, np.iinfo(np.uint32).max, dtype=np.uint32)
        for at in range(0, len(places), 1024):
            np.minimum(least, turned[places[at : at + 1024]].min(axis=0), out=least)
        return least

    return sign


def numbered(docs: DataFrame, key: str, text: str, whole: bool) -> DataFrame:
    """``number``, ``doc_id`` and ``text`` of each row, and with ``whole`` the row itself (``doc``), stored once: a row's
    number is the same wherever it is read again."""
    number = F.monotonically_increasing_id().alias("number")
    if not whole:
        return stored(docs.select(number, F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")), "minhash-docs")
    rows = stored(docs.select(number, F.struct("*").alias("doc")), "minhash-docs")
    return rows.select("number", F.col("doc")[key].cast("bigint").alias("doc_id"), F.col("doc")[text].alias("text"), "doc")


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """Per row: ``number``, ``doc_id``, ``n_shingles``, ``cls`` (digest of the set, null if empty); with the first row of a class in
    a task also ``bands`` (one key each) and ``sig`` (the low byte of each coordinate)."""

    def make():
        hashed, sign, seen = shingle_hasher(words), signer(), set()
        number = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            if len(seen) > SEEN:
                seen.clear()
            sets = hashed(utf8_column(batch.column(2)))
            names = [hashlib.blake2b(s, digest_size=16).digest() if len(s) else None for s in sets]
            bands, sigs = [None] * len(sets), [None] * len(sets)
            for i, (name, s) in enumerate(zip(names, sets)):
                if name is None or name in seen:
                    continue
                seen.add(name)
                sig = sign(s)
                with np.errstate(over="ignore"):
                    keys = number.copy()
                    for column in sig.reshape(BANDS, ROWS).T:
                        keys = mixed(keys + column)
                bands[i], sigs[i] = keys.view(np.int64), (sig & np.uint32(255)).astype(np.uint8).tobytes()
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                ["number", "doc_id", "n_shingles", "cls", "bands", "sig"],
            )

        return each

    return arrow_map(docs.select("number", "doc_id", "text"), make, "number long, doc_id long, n_shingles long, cls binary, bands array<long>, sig binary", SLICE)


def least_alike(at_least: tuple[int, int]) -> float:
    """The share of equal coordinates that a pair at the threshold falls below by six standard deviations only."""
    low = at_least[0] / at_least[1]
    return low - 6 * (low * (1 - low) / (BANDS * ROWS)) ** 0.5


def likely(pairs: DataFrame, classes: DataFrame, at_least: tuple[int, int]) -> DataFrame:
    """Those of ``pairs`` (a, b) whose set sizes and signatures allow the threshold."""
    side = classes.select("node", "n", "sig")
    floor = least_alike(at_least)

    for name in ("a", "b"):
        pairs = pairs.join(side.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("sig").alias(f"sig_{name}")), name)
    pairs = pairs.where(at_least[1] * F.least("n_a", "n_b") >= at_least[0] * F.greatest("n_a", "n_b"))

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            a, b = (np.frombuffer(b"".join(batch.column(f"sig_{x}").to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for x in "ab")
            alike = ((a == b).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
            return batch.select(["a", "b"]).filter(pa.array(alike >= floor))

        return each

    return arrow_map(pairs.select("a", "b", "sig_a", "sig_b"), make, "a long, b long")


def class_texts(nodes: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """``node``, ``cls`` and a text of each of ``nodes``: that of one row of the class."""
    wanted = stored(nodes.distinct().join(classes.select("node", "cls", "number"), "node"), "minhash-ends")
    return stored(docs.select("number", "text").join(broadcast_if_small(wanted, 1_000_000), "number").select("node", "cls", "text"), "minhash-texts")


def named_sets(words: int, keep: int = KEPT):
    """A function from a class and its text to the class's set. Sets of ``keep`` hashes in all are remembered."""
    hashed = shingle_hasher(words)
    kept: dict[bytes, np.ndarray] = {}
    held = 0

    def shingles(name: bytes, text: bytes) -> np.ndarray:
        nonlocal held
        found = kept.get(name)
        if found is None:
            found = hashed([text])[0]
            if held + len(found) > keep:
                kept.clear()
                held = 0
            kept[name] = found
            held += len(found)
        return found

    return shingles


def reaches(s: np.ndarray, t: np.ndarray, at_least: tuple[int, int]) -> bool:
    both = len(np.intersect1d(s, t, assume_unique=True))
    return both > 0 and at_least[1] * both >= at_least[0] * (len(s) + len(t) - both)


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, at_least: tuple[int, int]) -> DataFrame:
    """Those of ``pairs`` whose full sets reach the threshold."""
    texts = class_texts(pairs.select(F.explode(F.array("a", "b")).alias("node")), classes, docs)
    for name in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("node").alias(name), F.col("cls").alias(f"cls_{name}"), F.col("text").alias(f"text_{name}")), name)

    def make():
        shingles = named_sets(words)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            names = [batch.column(f"cls_{x}").to_pylist() for x in "ab"]
            texts = [utf8_column(batch.column(f"text_{x}")) for x in "ab"]
            found = [reaches(shingles(a, x), shingles(b, y), at_least) for a, b, x, y in zip(*names, *texts)]
            return batch.select(["a", "b"]).filter(pa.array(found, pa.bool_()))

        return each

    return arrow_map(pairs.select("a", "b", "cls_a", "cls_b", "text_a", "text_b"), make, "a long, b long", SLICE).distinct()


def first_pairs(buckets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs to compare at first in ``buckets`` (key, node): in small ones all, in large ones each with the centre, the
    class that meets most others in all its buckets (the text that near copies were made from, if it is there); the
    large buckets."""
    sums = buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = stored(buckets.join(sums, "key"), "minhash-buckets")
    weights = stored(rows.groupBy("node").agg(F.sum("n").alias("weight")), "minhash-weights")
    few = F.col("n") <= SMALL
    small = rows.where(few).select("key", F.col("node").alias("a")).join(rows.where(few).select("key", F.col("node").alias("b")), "key").where("a < b").select("a", "b")
    large = rows.where(~few).select("key", "node")
    centre = large.join(weights, "node").groupBy("key").agg(F.max(F.struct("weight", "node"))["node"].alias("first"))
    star = large.join(centre, "key").where("node <> first").select(F.least("first", "node").alias("a"), F.greatest("first", "node").alias("b"))
    return small.unionByName(star).distinct(), large


def rooted(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))


def open_links(large: DataFrame, labels: DataFrame | None, classes: DataFrame, docs: DataFrame, words: int, at_least: tuple[int, int]) -> DataFrame | None:
    """Links (a, b) between different components in the buckets ``large`` (key, node), those of a forest in each block."""
    rows = rooted(large, labels) if labels is not None else large.withColumn("root", F.col("node"))
    mixed_ones = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1")
    rows = stored(rows.join(mixed_ones.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")), "key"), "minhash-open")
    if rows.isEmpty():
        return None
    sides = stored(class_texts(rows.select("node"), classes, docs).join(classes.select("node", "n", "bands", "sig"), "node"), "minhash-sides")
    rows = rows.withColumn("b", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # Block b meets every block: as the smaller number it is side 0, as the larger side 1, with itself side 0.
    pair = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda o: F.struct(F.least("b", o).alias("i"), F.greatest("b", o).alias("j"), F.when(F.col("b") <= o, 0).otherwise(1).alias("side")),
    )
    rows = rows.select("key", "node", "root", F.explode(pair).alias("p")).select("key", "node", "root", "p.*")
    rows = rows.join(sides, "node")
    rows = rows.select("key", "i", "j", "side", "node", "root", "n", "bands", "sig", "cls", "text").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    floor = least_alike(at_least)
    need, of = at_least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = named_sets(words)

        def solved(group: pa.Table) -> pa.RecordBatch | None:
            group = group.combine_chunks()
            side, node, root, n = (group.column(c).to_numpy() for c in ("side", "node", "root", "n"))
            this, same = group.column("key")[0].as_py(), group.column("i")[0] == group.column("j")[0]
            left = np.flatnonzero(side == 0)
            right = left if same else np.flatnonzero(side == 1)
            sigs = np.frombuffer(b"".join(group.column("sig").to_pylist()), dtype=np.uint8).reshape(len(node), -1)
            bands = np.array(group.column("bands").to_pylist(), dtype=np.int64)
            names, raw = group.column("cls").to_pylist(), utf8_column(group.column("text").chunk(0))
            ends: list[tuple[int, int]] = []
            up = {r: r for r in root.tolist()}

            def top(r: int) -> int:
                while up[r] != r:
                    r = up[r]
                return r

            for x in left.tolist():
                y = right[(root[right] != root[x]) & (of * np.minimum(n[right], n[x]) >= need * np.maximum(n[right], n[x]))]
                if same:
                    y = y[y > x]
                y = y[((sigs[y] == sigs[x]).mean(axis=1) - 1 / 256) / (1 - 1 / 256) >= floor] if len(y) else y
                # A pair that shares several buckets is compared in the one with the smallest key alone.
                y = y[np.where(bands[y] == bands[x], bands[x], np.iinfo(np.int64).max).min(axis=1) == this] if len(y) else y
                for z in y.tolist():
                    if top(int(root[x])) != top(int(root[z])) and reaches(shingles(names[x], raw[x]), shingles(names[z], raw[z]), at_least):
                        up[top(int(root[x]))] = top(int(root[z]))
                        ends.append((int(node[x]), int(node[z])))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*ends)], ["a", "b"]) if ends else None

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            key_, i, j = (held.column(c).to_numpy() for c in ("key", "i", "j"))
            cuts = np.flatnonzero((np.diff(key_) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
            for a, b in zip([0, *cuts[:-1]], cuts):  # the last group may go on in the next batch
                if (out := solved(held.slice(a, b - a))) is not None:
                    yield out
            held = held.slice(cuts[-1]) if len(cuts) else held
        if held is not None and (out := solved(held)) is not None:
            yield out
        held = batch = table = out = shingles = None
        give_back()

    return rows.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, at_least: tuple[int, int] = AT_LEAST) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id`` (the smallest id that links reach,
    itself included) and ``kept`` (one row with that id)."""
    return grouped(numbered(docs, key, text, False), words, at_least).drop("number")


def grouped(docs: DataFrame, words: int, at_least: tuple[int, int]) -> DataFrame:
    """``near_duplicates`` of ``numbered`` rows, with their ``number``."""
    with small_batches(docs.sparkSession, SLICE):
        every = stored(sketches(docs, words), "minhash-rows")
        classes = every.where("cls is not null").groupBy("cls").agg(
            F.min("number").alias("number"), F.first("n_shingles").alias("n"),
            F.first("bands", ignorenulls=True).alias("bands"), F.first("sig", ignorenulls=True).alias("sig"),
        )
        classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "minhash-classes")
        pairs, large = first_pairs(classes.select("node", F.explode("bands").alias("key")))
        pairs = stored(likely(pairs, classes, at_least), "minhash-pairs")
        links = labels = None
        if not pairs.isEmpty():
            links = stored(confirmed(pairs, classes, docs, words, at_least), "minhash-links")
            labels = components(links)
        more = open_links(large, labels, classes, docs, words, at_least)
        if more is not None:
            more = stored(more, "minhash-more")
            if not more.isEmpty():
                labels = components(more if links is None else links.unionByName(more))
    rows = every.select("number", "doc_id", "n_shingles", "cls").join(classes.select("cls", "node"), "cls", "left")
    rows = rows.withColumn("root", F.col("node")) if labels is None else rooted(rows, labels)
    firsts = rows.where("root is not null").groupBy(F.col("root").alias("_r")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "number")).alias("first"))
    out = rows.join(firsts, F.col("root") == F.col("_r"), "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    kept = F.col("cls").isNull() | (F.col("number") == F.col("first.number"))
    return out.select("number", "doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def without_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, at_least: tuple[int, int] = AT_LEAST) -> DataFrame:
    """``docs`` with one row of each component, one with its smallest id; rows are taken one by one, whatever their ids."""
    rows = numbered(docs, key, text, True)
    gone = stored(grouped(rows, words, at_least).where(~F.col("kept")).select("number"), "minhash-gone")
    return rows.select("number", "doc").join(broadcast_if_small(gone, 1_000_000), "number", "left_anti").select("doc.*")
