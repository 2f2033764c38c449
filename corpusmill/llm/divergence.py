"""Source divergence audit: how far apart the term distributions of the sources of a language lie, and which terms do it.

Terms of a language that few documents hold are left out; the others have a count in every source, mostly a small one or
none. So the vocabulary is reordered until equal counts lie together: terms with the same counts in all sources become
one entry with a length, entries are sorted by the counts of the largest source first, and each source's column of
counts is run-length encoded. Two columns are compared run by run: where their boundaries cut each other, both counts
are constant, and the divergence f of that pair of counts is multiplied by the number of terms in between. The work
follows the number of runs and not the size of the vocabulary.

On Spark: tasks count their texts' terms before anything moves; one exchange by language and term sums them; equal
count vectors are merged by an aggregation; then blocks of vectors, bounded by cells (vectors times sources), meet the
figures of their language's groups in a cogroup, and each gives one partial sum for each pair of sources. No language or
source goes to one task, and nothing goes through the driver. All arithmetic is in whole numbers.

Defined cases: null texts, languages and sources are the empty string; a group without kept terms still has a row for
each other source; a language of one source has no pairs; a language without kept terms has divergence 0; an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import in_slices, stored, utf8_column
from corpusmill.operators.scale import broadcast_if_small

#: Cells of a block: its vectors times the sources of its language.
CELLS = 500_000
#: Counters a task holds before it gives them out.
HELD = 300_000
MIN_DOCS, TOP = 3, 200
#: Probabilities are in parts of 10 ** 9, taken in three steps of 1000 so that large counts stay within 64 bits.
STEPS, STEP = 3, 1000


def term_bytes() -> bytes:
    """Bytes as a term has them: A-Z lower-cased, other ASCII letters and all bytes of other characters as they are, and a
    space for the rest."""
    return bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``term`` with its occurrences ``n`` and documents ``docs``, as each task has counted them."""
    columns = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = term_bytes()
        held: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}

        def given() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                for at in range(0, len(terms := list(n)), 50_000):
                    some = terms[at : at + 50_000]
                    names = [pa.array([x] * len(some), pa.binary()).cast(pa.string()) for x in (lang, source)]
                    yield pa.RecordBatch.from_arrays(
                        [*names, pa.array(some, pa.binary()).cast(pa.string()), *(pa.array([c[t] for t in some], pa.int64()) for c in (n, docs))],
                        ["lang", "source", "term", "n", "docs"],
                    )
            held.clear()

        size = 0
        for batch in batches:
            langs, sources = utf8_column(batch.column("lang")), utf8_column(batch.column("source"))
            at = 0
            for some in in_slices(utf8_column(batch.column("text"))):
                for text, key in zip(some, zip(langs[at:], sources[at:])):
                    n, docs = held.get(key) or held.setdefault(key, (Counter(), Counter()))
                    before = len(n)
                    words = text.translate(table).split()
                    n.update(words)
                    docs.update(set(words))
                    size += len(n) - before
                at += len(some)
                if size >= HELD:
                    yield from given()
                    size = 0
        yield from given()

    return docs.select(*columns).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def groups_of(docs: DataFrame) -> DataFrame:
    """Each occurring ``lang`` and ``source``, with its number ``g`` in the language: one row for each group."""
    names = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    return names.withColumn("g", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)


def vocabulary(docs: DataFrame, groups: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Kept terms: ``lang``, ``term``, ``total`` and ``counts``, an array of (g, n) for the sources that have it."""
    rows = term_counts(docs).repartition("lang", "term")  # one exchange serves both sums
    rows = rows.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    rows = rows.join(broadcast_if_small(groups), ["lang", "source"])
    return (
        rows.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("g", "n"))).alias("counts"))
        .where(F.col("docs") >= min_docs).select("lang", "term", "total", "counts")
    )


def with_sums(groups: DataFrame, terms: DataFrame) -> DataFrame:
    """Adds to each group ``size`` (occurrences of kept terms), and of its language ``lang_size``, ``terms`` and ``sources``."""
    sums = terms.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.g").alias("g")).agg(F.sum("c.n").alias("size"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_size"))
    out = groups.join(sums, ["lang", "g"], "left").join(langs, "lang", "left").fillna(0, ["size", "terms", "lang_size"])
    return out.withColumn("sources", F.count("*").over(Window.partitionBy("lang")))


def parts_of(count: Column, whole: Column) -> Column:
    """1 + floor(10**9 * count / whole), by long division."""
    out, rest = F.lit(0).cast("bigint"), count
    for _ in range(STEPS):
        rest = rest * STEP
        out, rest = out * STEP + whole_part(rest, whole), rest % whole
    return out + 1


def whole_part(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def parts_array(count: np.ndarray, whole: int) -> np.ndarray:
    """``parts_of`` of an array."""
    out, rest = np.zeros(len(count), dtype=np.int64), count
    for _ in range(STEPS):
        rest = rest * STEP
        out, rest = out * STEP + rest // whole, rest % whole
    return out + 1


def runs(column: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.concatenate([[0], np.flatnonzero(column[1:] != column[:-1]) + 1])


def pair_sums(counts: np.ndarray, lengths: np.ndarray, wholes: list[int]) -> np.ndarray:
    """Sums of f for all ordered pairs of groups. ``counts``: a row for each group, a column for each entry of the
    vocabulary; ``lengths``: the terms of each entry; ``wholes``: occurrences plus vocabulary of each group."""
    size = np.argsort(-counts.sum(axis=1), kind="stable")
    order = np.lexsort(counts[size[::-1]])  # the last key counts most
    counts, ends = counts[:, order], np.concatenate([[0], np.cumsum(lengths[order])])
    starts = [runs(c) for c in counts]
    shares = [parts_array(c[s] + 1, w) for c, s, w in zip(counts, starts, wholes)]
    out = np.zeros((len(counts), len(counts)), dtype=np.int64)
    for a in range(len(counts)):
        for b in range(a):
            cuts = np.union1d(starts[a], starts[b])
            p, q = (shares[x][np.searchsorted(starts[x], cuts, side="right") - 1] for x in (a, b))
            n = np.diff(ends[np.append(cuts, counts.shape[1])])
            squares = (p - q) * (p - q)
            out[a, b], out[b, a] = (squares // q * n).sum(), (squares // p * n).sum()
    return out


def pair_divergences(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``item`` (another source) and ``value`` for every ordered pair of sources."""
    vectors = terms.groupBy("lang", "counts").agg(F.count("*").alias("length"))
    langs = groups.groupBy("lang").agg(F.greatest(F.ceil(F.first("terms") * F.first("sources") / CELLS), F.lit(1)).cast("int").alias("blocks"))
    vectors = vectors.join(broadcast_if_small(langs), "lang").withColumn("block", F.pmod(F.xxhash64("counts"), F.col("blocks")).cast("int"))
    sides = groups.where("sources > 1").join(langs, "lang").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def solved(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        lang, n = key[0].as_py(), right.num_rows
        if not n:
            return pa.table({"lang": pa.array([], pa.string()), "g": pa.array([], pa.int32()), "h": pa.array([], pa.int32()), "value": pa.array([], pa.int64())})
        out = np.zeros((n, n), dtype=np.int64)
        if left.num_rows:
            right = right.sort_by("g")
            wholes = [s + t for s, t in zip(right.column("size").to_pylist(), right.column("terms").to_pylist())]
            counts = np.zeros((n, left.num_rows), dtype=np.int64)
            lists = left.column("counts").combine_chunks()
            at = np.repeat(np.arange(left.num_rows), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            counts[flat.field("g").to_numpy(), at] = flat.field("n").to_numpy()
            out = pair_sums(counts, left.column("length").to_numpy(), wholes)
        g, h = np.nonzero(~np.eye(n, dtype=bool))
        return pa.table({"lang": pa.array([lang] * len(g), pa.string()), "g": pa.array(g, pa.int32()), "h": pa.array(h, pa.int32()), "value": pa.array(out[g, h], pa.int64())})

    pairs = vectors.select("lang", "block", "counts", "length").groupBy("lang", "block").cogroup(
        sides.select("lang", "block", "g", "size", "terms").groupBy("lang", "block")
    ).applyInArrow(solved, "lang string, g int, h int, value long")
    pairs = pairs.groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    for number, name in (("g", "source"), ("h", "item")):
        pairs = pairs.join(groups.select("lang", F.col("g").alias(number), F.col("source").alias(name)), ["lang", number])
    return pairs.select("lang", "source", "item", "value")


def term_divergences(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``item`` (a term that the source has more of than its language) and ``value``."""
    rows = terms.select("lang", F.col("term").alias("item"), "total", F.explode("counts").alias("c")).select("lang", "item", "total", F.col("c.g").alias("g"), F.col("c.n").alias("n"))
    rows = rows.join(groups, ["lang", "g"])
    rows = rows.withColumn("p", parts_of(F.col("n") + 1, F.col("size") + F.col("terms"))).withColumn("q", parts_of(F.col("total") + 1, F.col("lang_size") + F.col("terms")))
    gap = F.col("p") - F.col("q")
    return rows.where("p > q").select("lang", "source", "item", whole_part(gap * gap, F.col("q")).alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """``lang``, ``source``, ``part`` (pair or term), ``item``, ``value`` and ``rank``: all pairs, the ``top`` terms."""
    groups = stored(groups_of(docs), "divergence-groups")
    terms = stored(vocabulary(docs, groups, min_docs), "divergence-terms")
    groups = stored(with_sums(groups, terms), "divergence-sums")
    both = pair_divergences(terms, groups).withColumn("part", F.lit("pair")), term_divergences(terms, groups).withColumn("part", F.lit("term"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = [x.withColumn("rank", F.row_number().over(order)) for x in both]
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return ranked[0].select(columns).unionByName(ranked[1].where(F.col("rank") <= top).select(columns))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents
), t AS (SELECT i, lang, source, unnest(ws) AS term FROM d
), k AS (SELECT lang, term, count(*)::HUGEINT AS total FROM t GROUP BY ALL HAVING count(DISTINCT i) >= 3
), n AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL
), l AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS size FROM k GROUP BY lang
), g AS (
  SELECT d.lang, d.source, coalesce(s.size, 0)::HUGEINT AS size
  FROM (SELECT DISTINCT lang, source FROM d) d LEFT JOIN (SELECT lang, source, sum(n) AS size FROM n GROUP BY ALL) s ON s.lang = d.lang AND s.source = d.source
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n, 1 + 1000000000 * (coalesce(n.n, 0) + 1) // (g.size + l.v) AS p,
         1 + 1000000000 * (k.total + 1) // (l.size + l.v) AS q
  FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  ) x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), every AS (
  SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q
), r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM every)
SELECT * FROM r WHERE part = 'pair' OR rank <= 200
"""
