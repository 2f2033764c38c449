"""Near-duplicate vectors by E8 lattice hashing.

In each of several tables a random projection takes a unit vector to eight dimensions, where it is decoded to the
nearest point of the E8 lattice: its home cell. The lattice's cells are nearly balls, so near vectors mostly share one.
A vector also probes the neighbouring cells that it is closest to. Vectors meet in a cell where at least one of them is
at home, and their cosine is taken in double precision.

Equal vectors of one label are one class. A cell's classes are dealt into blocks of bounded size and compared block by
block with matrix products; a block gives a number of links for each class and a forest that joins the linked ones, not
the pairs. A pair that meets in several cells counts in the one with the smallest key alone; only classes with a link are
asked for their other cells.

Defined cases: vectors that are null, zero, or hold null or non-finite components, and those without a label, link with
nothing; vectors of different lengths link with nothing; each repeated row counts as a vector; an empty table gives an
empty table. Only the id, the vector and the label are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import arrow_map, mixed, stored
from corpusmill.llm.components import components

TABLES, PROBES, SCALE = 14, 4, 1.0
BLOCK = 512
#: Classes whose cells a task remembers (some 15 MB).
KNOWN = 20_000


def decode_d8(y: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates of an even sum."""
    near = np.rint(y)
    off = y - near
    worst = np.abs(off).argmax(axis=1)
    rows = np.flatnonzero(near.sum(axis=1) % 2)
    at = worst[rows]
    near[rows, at] += np.where(off[rows, at] >= 0, 1.0, -1.0)
    return near


def decode_e8(y: np.ndarray) -> np.ndarray:
    """Nearest points of E8, which is that set and the same set moved by one half in every coordinate."""
    whole, half = decode_d8(y), decode_d8(y - 0.5) + 0.5
    nearer = ((y - half) ** 2).sum(axis=1) < ((y - whole) ** 2).sum(axis=1)
    return np.where(nearer[:, None], half, whole)


def shortest_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: the steps to neighbouring cells."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (-1.0, 1.0):
                for b in (-1.0, 1.0):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for signs in range(256):
        if bin(signs).count("1") % 2 == 0:
            out.append(np.array([-0.5 if signs >> k & 1 else 0.5 for k in range(8)]))
    return np.array(out)


def hasher(tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, seed: int = 11):
    """A function from unit vectors (one length) and a number for each one's label to keys: homes, one per table, and
    probes, ``probes`` per table."""
    steps = shortest_vectors()
    drawn: dict[int, np.ndarray] = {}

    def keys(unit: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, dim = unit.shape
        if dim not in drawn:
            drawn[dim] = np.random.default_rng([seed, dim]).normal(size=(tables, dim, 8)) * scale
        home, probe = np.empty((n, tables), dtype=np.int64), np.empty((n, tables, probes), dtype=np.int64)

        def key(points: np.ndarray, table: int, label: np.ndarray) -> np.ndarray:
            h = mixed(label + np.uint64(table * 1_000_003 + dim))
            for column in np.rint(points * 2).astype(np.int64).view(np.uint64).T:
                h = mixed(h + column)
            return h.view(np.int64)

        for t in range(tables):
            y = unit @ drawn[dim][t]
            point = decode_e8(y)
            home[:, t] = key(point, t, label)
            if probes:
                close = np.argpartition(-((y - point) @ steps.T), probes - 1, axis=1)[:, :probes]  # in any order
                for p in range(probes):
                    probe[:, t, p] = key(point + steps[close[:, p]], t, label)
        return home, probe.reshape(n, -1)

    return keys


def classified(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """``vec_id``, ``cls`` (digest of label and vector, null for vectors that link with nothing), ``tag`` (a number for
    label) and ``unit``, the vector at length 1."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            names, tags, units = [], [], []
            for v, lab in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                x = np.array(v, dtype=np.float64) if v and lab is not None and None not in v else np.zeros(1)
                top = np.abs(x).max()
                if not np.isfinite(top) or top == 0:
                    names.append(None), tags.append(None), units.append(None)
                    continue
                x = x / top
                x = x / np.sqrt(x @ x)
                tag = hashlib.blake2b(str(lab).encode(), digest_size=8).digest()
                names.append(hashlib.blake2b(tag + (np.array(v, dtype=np.float64) + 0.0).tobytes(), digest_size=16).digest())
                tags.append(int.from_bytes(tag, "little", signed=True))
                units.append(x)
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.binary()), pa.array(tags, pa.int64()), pa.array(units, pa.list_(pa.float64()))],
                ["vec_id", "cls", "tag", "unit"],
            )

        return each

    plain = rows.select(F.col(key).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("string").alias("l"))
    return arrow_map(plain, make, "vec_id long, cls binary, tag long, unit array<double>")


def _stacked(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of one length together: their numbers and their matrix."""
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy()
    sizes = np.diff(ends)
    if len(sizes) and (sizes == sizes[0]).all():
        return [(np.arange(len(sizes)), flat[ends[0] : ends[-1]].reshape(len(sizes), -1))]
    return [(rows := np.flatnonzero(sizes == d), np.stack([flat[ends[r] : ends[r + 1]] for r in rows])) for d in np.unique(sizes)]


def cells(classes: DataFrame, make_hasher) -> DataFrame:
    """``key``, ``cls``, ``home``: the cells that each class is at home in or probes."""

    def make():
        keys = make_hasher()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            names = batch.column(0)
            tags = batch.column(1).to_numpy().view(np.uint64)
            out_key, out_row, out_home = [], [], []
            for rows, unit in _stacked(batch.column(2)):
                home, probe = keys(unit, tags[rows])
                out_key += [home.ravel(), probe.ravel()]
                out_row += [np.repeat(rows, home.shape[1]), np.repeat(rows, probe.shape[1])]
                out_home += [np.ones(home.size, bool), np.zeros(probe.size, bool)]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(out_key)), names.take(pa.array(np.concatenate(out_row))), pa.array(np.concatenate(out_home))], ["key", "cls", "home"]
            )

        return each

    return arrow_map(classes.select("cls", "tag", "unit"), make, "key long, cls binary, home boolean")


def met_before(hp: np.ndarray, pp: np.ndarray, hq: np.ndarray, pq: np.ndarray, key: int) -> np.ndarray:
    """Which rows of two sets (homes and probes) also meet in a cell with a smaller key: at home both, or one at home and one
    probing. Cells that one row alone has tell nothing; the others are columns of two tables of zeros and ones."""
    t = hp.shape[1]
    cells = np.concatenate((np.hstack((hp, pp)), np.hstack((hq, pq))))
    row, column = np.nonzero(cells < key)
    _, at, n = np.unique(cells[row, column], return_inverse=True, return_counts=True)
    keep = n > 1
    number = np.cumsum(keep) - 1
    row, column, at = (x[keep[at]] for x in (row, column, at))
    every = np.zeros((len(cells), int(keep.sum())), dtype=np.float32)
    every[row, number[at]] = 1
    home = np.zeros_like(every)
    home[row[column < t], number[at[column < t]]] = 1
    p, q = slice(0, len(hp)), slice(len(hp), None)
    return (home[p] @ every[q].T + every[p] @ home[q].T) > 0


def linked_blocks(blocks: DataFrame, make_hasher, at_least: float) -> DataFrame:
    """Of ``blocks`` (key, i, j, side, home, cls, tag, m, unit; each (key, i, j) together in a partition): per class
    ``links`` (partners, copies counted) and ``joined``, the first class of those it is linked with in the block."""
    names = ["key", "i", "j", "side", "home", "cls", "tag", "m", "unit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held, known = make_hasher(), None, {}

        def meeting(rows: np.ndarray, cls: list, tags: np.ndarray, units: dict, dims: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Homes and probes of ``rows``. A class comes back in other cells: what was found for it stays while there is room."""
            if len(known) > KNOWN:
                known.clear()
            new = [r for name, r in {cls[r]: r for r in rows}.items() if name not in known]
            for d in {dims[r] for r in new}:
                some = [r for r in new if dims[r] == d]
                for r, *found in zip(some, *keys(units[d][place[some]], tags[some])):
                    known[cls[r]] = tuple(found)
            return tuple(np.stack(x) for x in zip(*(known[cls[r]] for r in rows)))

        def solved(table: pa.Table) -> pa.RecordBatch | None:
            table = table.combine_chunks()
            key, i, j, side, m = (table.column(c).to_numpy() for c in ("key", "i", "j", "side", "m"))
            home = table.column("home").to_numpy()
            cls = table.column("cls").to_pylist()
            tags = table.column("tag").to_numpy().view(np.uint64)
            units, dims, place = {}, np.zeros(len(cls), dtype=np.int64), np.zeros(len(cls), dtype=np.int64)
            for rows, unit in _stacked(table.column("unit").chunk(0)):
                units[d := unit.shape[1]] = unit
                dims[rows], place[rows] = d, np.arange(len(rows))
            border = np.flatnonzero((np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
            starts, ends = np.array([0, *border]), np.array([*border, len(cls)])
            # Most cells hold two classes: their cosines are taken at once, and those that are far apart are done with.
            two = starts[(ends - starts == 2) & (i[starts] == j[starts])]
            far = np.zeros(len(cls), dtype=bool)
            for d, unit in units.items():
                at = two[(dims[two] == d) & (dims[two + 1] == d)]
                far[at] = np.einsum("nd,nd->n", unit[place[at]], unit[place[at + 1]]) < at_least - 1e-9
            linked = []  # start, end, and the linked rows
            for a, b in zip(starts, ends):
                if far[a] or (dims[a:b] != dims[a]).any():
                    continue
                x = units[dims[a]][place[a:b]]
                own = i[a] == j[a]
                left = np.flatnonzero(side[a:b] == 0)
                right = left if own else np.flatnonzero(side[a:b] == 1)
                if not len(left) or not len(right):
                    continue
                link = (x[left] @ x[right].T >= at_least) & (home[a:b][left][:, None] | home[a:b][right][None, :])
                if own:
                    np.fill_diagonal(link, False)
                if link.any():
                    left, right, link = left[link.any(axis=1)], right[link.any(axis=0)], link[link.any(axis=1)][:, link.any(axis=0)]
                    linked.append((a, b, left, right, link))
            if not linked:
                return None
            # Where two classes meet is asked for linked ones only.
            some = np.unique(np.concatenate([a + x for a, _, left, right, _ in linked for x in (left, right)]))
            homes, probes = meeting(some, cls, tags, units, dims, place)
            rank = np.zeros(len(cls), dtype=np.int64)
            rank[some] = np.arange(len(some))
            out_cls, out_links, out_joined = [], [], []
            for a, b, left, right, link in linked:
                p, q = rank[a + left], rank[a + right]
                counted = link & ~met_before(homes[p], probes[p], homes[q], probes[q], key[a])
                counts, first = np.zeros(b - a, dtype=np.int64), np.arange(b - a)
                counts[left] += counted @ m[a + right]
                if i[a] != j[a]:
                    counts[right] += counted.T @ m[a + left]
                while True:  # each class takes the first row that it is joined with
                    before = first.copy()
                    first[left] = np.minimum(first[left], np.where(link, first[right], b).min(axis=1))
                    first[right] = np.minimum(first[right], np.where(link, first[left][:, None], b).min(axis=0))
                    first = first[first]
                    if (first == before).all():
                        break
                for k in np.union1d(left, right):
                    out_cls.append(cls[a + k]), out_links.append(counts[k]), out_joined.append(cls[a + first[k]])
            return pa.RecordBatch.from_arrays([pa.array(out_cls, pa.binary()), pa.array(out_links, pa.int64()), pa.array(out_joined, pa.binary())], ["cls", "links", "joined"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            last = [table.column(c)[len(table) - 1].as_py() for c in ("key", "i", "j")]
            same = np.logical_and.reduce([table.column(c).to_numpy() == v for c, v in zip(("key", "i", "j"), last)])
            start = int(np.flatnonzero(same)[0])  # rows are sorted: the last group may go on in the next batch
            held = table.slice(start)
            if start and (out := solved(table.slice(0, start))) is not None:
                yield out
        if held is not None and (out := solved(held)) is not None:
            yield out

    return blocks.select(*names).mapInArrow(run, "cls binary, links long, joined binary")


def near_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", at_least: float = 0.93, block: int = BLOCK, make_hasher=hasher) -> DataFrame:
    """One row per row of ``rows``: ``vec_id``, ``n_links``, ``component_id`` and ``kept``."""
    every = stored(classified(rows, key, vector, label), "lattice-rows")
    classes = stored(
        every.where("cls is not null").groupBy("cls").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("m"), F.first("tag").alias("tag"), F.first("unit").alias("unit")),
        "lattice-classes",
    )
    places = stored(cells(classes, make_hasher).groupBy("key", "cls").agg(F.max("home").alias("home")), "lattice-cells")
    # Cells with one class alone, and those that are only probed, hold no pair.
    live = places.groupBy("key").agg(F.count("*").alias("n"), F.max("home").alias("any_home")).where("n > 1 and any_home")
    parts = F.ceil(F.col("n") / block).cast("int")
    rows_in = places.join(live.select("key", parts.alias("parts")), "key").withColumn("b", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    # Block b meets every block: as the smaller number it is side 0, as the larger side 1, with itself side 0.
    pair = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda o: F.struct(F.least("b", o).alias("i"), F.greatest("b", o).alias("j"), F.when(F.col("b") <= o, 0).otherwise(1).alias("side")),
    )
    rows_in = rows_in.select("key", "cls", "home", F.explode(pair).alias("p")).select("key", "cls", "home", "p.*")
    blocks = rows_in.join(classes.select("cls", "tag", "m", "unit"), "cls").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "cls")
    found = stored(linked_blocks(blocks, make_hasher, at_least), "lattice-links")
    labels = components(found.select(F.col("cls").alias("a"), F.col("joined").alias("b")))
    per_class = classes.select("cls", "m").join(found.groupBy("cls").agg(F.sum("links").alias("links")), "cls", "left")
    if labels is None:
        per_class = per_class.withColumn("root", F.col("cls"))
    else:
        per_class = per_class.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    per_class = stored(per_class, "lattice-result")
    firsts = classes.join(per_class.select("cls", "root"), "cls").groupBy("root").agg(F.min("first_id").alias("component"))
    out = every.select("vec_id", "cls").join(per_class.join(firsts, "root").drop("root"), "cls", "left")
    return out.select(
        "vec_id", F.coalesce(F.col("m") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
