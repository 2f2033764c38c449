"""Toxicity with noisy-channel deobfuscation.

A character trigram model is counted over the whole corpus. Words that look disguised (leetspeak, marks between letters,
letters spaced apart, letters repeated) become a lattice: each sign may stand for some letters, be dropped, or end a
word; a repeated letter may stand for one or two. Viterbi decoding finds the restored readings that the model and the
channel find likeliest; the classifier then sees the restored words beside the written ones.

The classifier is a lexicon with weights. Words and beginnings of words are counted over toxic and other documents of a
bounded sample of labelled rows, near copies once (those whose least shingle hash is the same); those clearly likelier
in toxic documents make the lexicon. A logistic function of the strongest weight, the sum of the strongest, the number
of hits and the length gives the score; it is fitted on documents that the weights it sees were not counted on.

Defined cases: a null or empty text has no words and gets the score of a document without hits; labels that are null
are left out, several labels of one id count as their largest; tokens and spaced runs of any length are decoded, long ones
in overlapping windows; a token of digits alone is a number and is not decoded; without labels, or with one class alone, every score is
the share of toxic labels (0 without labels); repeated rows score alike; writing other than Latin is scored as written;
an empty table gives an empty table. Columns of the input are kept in the struct ``row`` whatever their names.
"""

from __future__ import annotations

import heapq
import math
import re
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import arrow_map, stored, utf8_column
from corpusmill.llm.minhash import shingle_hasher

#: Letters of the character model: a-z and the lower-case letters of Latin-1. Everything else is a word's end (0).
LETTERS = "abcdefghijklmnopqrstuvwxyzß" + "".join(map(chr, range(0xE0, 0x100))).replace("÷", "")
BASE = len(LETTERS) + 1
CODE = {c: i + 1 for i, c in enumerate(LETTERS)}
#: What a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "+": "t", "|": "il", "(": "c", "<": "c", "€": "e", "£": "l", "*": "aeiou", "#": "aeiou",
}
#: Costs in nats: a sign read as one of its letters, a sign or gap dropped, a sign or gap as a word's end, a repeated letter cut.
READ, DROP, END, CUT = 1.5, 1.2, 1.5, 0.7
#: Readings kept: this many, and this close to the best in nats.
READINGS, MARGIN, BEAM = 3, 2.5, 24
#: A long run is decoded in windows of so many characters and the overlap with the next.
WINDOW, OVERLAP = 200, 40
#: Rows that a task reads at once.
SLICE = 500
#: A letter comes twice for nothing if the model's log probability for it after itself is below this.
RARE = -6.5

_SIGNS = re.escape("".join(LEET)) + r".\-_'·,:;/\\~^"
_LEET, _MARKS = re.escape("".join(LEET)), re.escape("".join(c for c in LEET if not c.isdigit()))
#: Marks between letters, a sign beside a letter, or two signs of which one is no digit.
_DISGUISED = re.compile(
    rf"[^\W\d_][{_SIGNS}]+[^\W\d_]|[{_LEET}][{_SIGNS}]*[^\W\d_]|[^\W\d_][{_SIGNS}]*[{_LEET}]|[{_MARKS}][{_LEET}]|[{_LEET}][{_MARKS}]"
)
_TWICE = re.compile(r"([^\W\d_])\1+")
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]+\S){2,}(?!\S)")
_EDGE = re.compile(r"^[^\w@$!+|(<€£]+|([^\w\s])\1{2,}$|[.,;:?\")\]]+$")
_RUN = re.compile(r"([^\W\d_])\1*|.", re.S)


def character_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``gram`` (three letter codes as one number) and ``n``, over all whole texts."""

    def make():
        codes = bytearray(256)
        for c, i in CODE.items():
            codes[c.encode("latin-1")[0]] = i
        codes = bytes(codes)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            total, held, size = np.zeros(BASE**3, dtype=np.int64), [], 0
            texts = [t for t in batch.column(0).to_pylist() if t]
            for last, t in zip(range(len(texts) - 1, -1, -1), texts):
                c = np.frombuffer(b"\0\0" + t.lower().encode("latin-1", "replace").translate(codes) + b"\0", dtype=np.uint8).astype(np.int32)
                held.append((c[:-2] * BASE + c[1:-1]) * BASE + c[2:])
                size += len(c)
                if size > 2_000_000 or not last:
                    total += np.bincount(np.concatenate(held), minlength=BASE**3)
                    held, size = [], 0
            grams = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array(grams.astype(np.int32)), pa.array(total[grams])], ["gram", "n"])

        return each

    rows = arrow_map(docs.select(F.col(text).alias("text")), make, "gram int, n long")
    return rows.groupBy("gram").agg(F.sum("n").alias("n"))


def character_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Log probabilities [before last, last, next]. The table has one cell per three letters, whatever the corpus."""
    counts = np.zeros(BASE**3)
    for row in character_counts(docs, text).collect():
        counts[row.gram] = row.n
    three = counts.reshape(BASE, BASE, BASE)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + BASE)
    p2 = (two + 20 * p1) / (two.sum(axis=1, keepdims=True) + 20)
    p3 = (three + 20 * p2) / (three.sum(axis=2, keepdims=True) + 20)
    return np.log(p3).astype(np.float32)


def decoder(model: np.ndarray):
    """A function from a disguised token (lower case) to its likely readings, best first; a reading may be several words."""
    logp = model.tolist()

    def options(token: str) -> list[list[tuple[str, float]]]:
        steps: list[list[tuple[str, float]]] = []
        for m in _RUN.finditer(token):
            run = m.group()
            c = run[0]
            if c in CODE:
                steps.append([(c, 0.0)] if len(run) == 1 else [(c, CUT), (run, 0.0)] if len(run) == 2 else [(c, CUT), (c + c, CUT), (run, 0.0)])
            elif c.isspace():
                steps.append([(" ", 0.0), ("", DROP / 2)])
            else:
                steps.append([(x, READ) for x in LEET.get(c, "")] + [("", DROP), (" ", END)])
        return steps

    def decode(token: str) -> list[str]:
        states: dict[tuple[int, int], list[tuple[float, str]]] = {(0, 0): [(0.0, "")]}
        for step in options(token):
            new: dict[tuple[int, int], list[tuple[float, str]]] = defaultdict(list)
            for (x, y), paths in states.items():
                for letters, cost in step:
                    a, b, gain = x, y, -cost
                    for ch in letters:
                        n = CODE.get(ch, 0)
                        if n or b:  # a word's end follows a word only
                            gain += logp[a][b][n]
                            a, b = (b, n) if n else (0, 0)
                    new[a, b] += [(s + gain, t + letters) for s, t in paths]
            best = heapq.nlargest(BEAM, ((s, t, k) for k, ps in new.items() for s, t in ps))
            states = defaultdict(list)
            for s, t, k in best:
                if len(states[k]) < READINGS:
                    states[k].append((s, t))
        ends = sorted(((s + (logp[x][y][0] if y else 0.0), t) for (x, y), ps in states.items() for s, t in ps), reverse=True)
        out: list[str] = []
        for s, t in ends:
            t = " ".join(t.split())
            if t and t not in out and s > ends[0][0] - MARGIN:
                out.append(t)
        return out[:READINGS]

    return decode


def word_reader(model: np.ndarray):
    """Functions from a token to its restored words, and from a text to the disguised runs of single letters in it."""
    decode = decoder(model)
    rare = (np.diagonal(model, axis1=1, axis2=2) < RARE).tolist()

    def odd(core: str) -> bool:
        """Whether a letter comes three times, or twice where the model hardly knows it twice."""
        for m in _TWICE.finditer(core):
            if len(m[0]) > 2 or rare[CODE.get(core[m.start() - 1], 0) if m.start() else 0][CODE.get(m[1], 0)]:
                return True
        return False

    def windows(run: str) -> list[str]:
        """Overlapping parts of a run of any length."""
        return [run] if len(run) <= WINDOW + OVERLAP else [run[at : at + WINDOW + OVERLAP] for at in range(0, len(run) - OVERLAP, WINDOW)]

    def words_of(token: str) -> set[str]:
        core = token if token.isalpha() else _EDGE.sub("", token)
        letters = core.isalpha()
        words = {core} if letters else set(re.findall(r"[^\W\d_]+", core))
        for part in windows(core):
            if odd(part) or (not letters and _DISGUISED.search(part)):
                for reading in decode(part):
                    words.update(reading.split())
        return words

    def spaced(text: str) -> set[str]:
        words: set[str] = set()
        for m in _SPACED.finditer(text):
            run = m.group()
            for part in windows(run):
                for reading in decode(part):
                    words.update(w for w in reading.split() if len(w) > 2)
        return words

    return words_of, spaced


def features(word: str) -> list[str]:
    """The word and its beginnings of 4 to 8 letters."""
    return [word, *(word[:n] + "-" for n in range(4, min(9, len(word))))]


def feature_reader(model: np.ndarray, keep: int = 50_000):
    """A function from a text to the set of its features."""
    words_of, spaced = word_reader(model)
    known: dict[str, list[str]] = {}

    def read(text: str) -> set[str]:
        low = text.lower()
        tokens = set(low.split())
        found: set[str] = set()
        if len(known) > keep:
            known.clear()
        for t in tokens:
            if t not in known:
                known[t] = [f for w in words_of(t) for f in features(w)]
            found.update(known[t])
        for w in spaced(low):
            found.update(features(w))
        return found

    return read


def fit(docs: DataFrame, labels: DataFrame, model: np.ndarray, sample_rows: int = 40_000, least: int = 3, key: str = "doc_id", text: str = "text", label: str = "toxic") -> dict:
    """The lexicon and the logistic function, from at most about ``sample_rows`` labelled rows (by hash of the id)."""
    marks = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("_id")).agg((F.max(label) > 0).cast("int").alias("toxic"))
    n = marks.count()
    share = min(1.0, sample_rows / max(1, n))
    marks = marks.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # At most about sample_rows rows of two numbers: small enough for every executor.
    rows = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(marks), "_id")

    def make_group():
        hashed = shingle_hasher(3)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            firsts = [int(s[0]) >> 1 if len(s) else 0 for s in hashed(utf8_column(batch.column(1)))]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(firsts, pa.int64())], ["toxic", "text", "first"])

        return each

    sample = arrow_map(rows.select("toxic", "text"), make_group, "toxic int, text string, first long", SLICE)
    sample = stored(sample.groupBy("toxic", "first").agg(F.min("text").alias("text")), "toxic-sample")
    # Fold 1 fits the logistic function; it sees weights that were counted on fold 0.
    sample = sample.select("toxic", "text", (F.col("first") % 3 == 1).cast("int").alias("fold"))
    size = defaultdict(int) | {(r.toxic, r.fold): r["count"] for r in sample.groupBy("toxic", "fold").count().collect()}
    pos, neg = size[1, 0] + size[1, 1], size[0, 0] + size[0, 1]
    if not all((size[y, f] for y in (0, 1) for f in (0, 1))):
        return {"weights": {}, "line": (_logit(pos / max(1, pos + neg)), 0.0, 0.0, 0.0, 0.0)}

    def make():
        read = feature_reader(model)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            place: dict[str, int] = {}
            counts = array("q")
            for y, t, fold in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for f in read(t):
                    at = place.get(f)
                    if at is None:
                        at = place[f] = len(counts)
                        counts.extend((0, 0, 0, 0))
                    counts[at + 2 * fold + y] += 1
            table = np.array(counts, dtype=np.int64).reshape(-1, 4)
            return pa.RecordBatch.from_arrays([pa.array(list(place), pa.string()), *(pa.array(c.copy()) for c in table.T)], ["feature", "o0", "t0", "o1", "t1"])

        return each

    sums = arrow_map(sample, make, "feature string, o0 long, t0 long, o1 long, t1 long", 3 * SLICE).groupBy("feature").agg(*(F.sum(c).alias(c) for c in ("o0", "t0", "o1", "t1")))

    def weights(toxic: Column, other: Column, pos: int, neg: int) -> dict[str, float]:
        """Log odds less two standard errors, where they are clearly above 0."""
        t, o = toxic + 0.5, other + 0.5
        odds = F.log(t / (pos + 1.0)) - F.log(o / (neg + 1.0)) - 2 * F.sqrt(1 / t + 1 / o)
        able = sums.where(toxic >= least).withColumn("weight", odds).where("weight > 0.7")
        return {r.feature: r.weight for r in able.select("feature", "weight").collect()}  # of ``sample_rows`` texts

    sums = stored(sums.where("t0 + t1 >= 2"), "toxic-features")
    half = weights(F.col("t0"), F.col("o0"), size[1, 0], size[0, 0])

    def make_stats():
        stats = scorer({"weights": half, "line": (0.0,) * 5}, model)[1]

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = pa.array([stats(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([batch.column(0), found], ["toxic", "x"])

        return each

    cells = arrow_map(sample.where("fold = 1").select("toxic", "text"), make_stats, "toxic int, x array<double>", SLICE).collect()
    line = logistic(np.array([r.x for r in cells]), np.array([float(r.toxic) for r in cells]))
    return {"weights": weights(F.col("t0") + F.col("t1"), F.col("o0") + F.col("o1"), pos, neg), "line": line}


def _logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[float, ...]:
    """Weights of a logistic function by Newton's method; the ridge keeps them finite where the classes part."""
    b = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty, x.T @ (y - p) - penalty @ b)
        b += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, b))


def scorer(fitted: dict, model: np.ndarray, keep: int = 200_000):
    """Functions from a text to its score, and to what the score is made of: 1, the strongest weight, the sum of the ten
    strongest, the number of hits (up to 20), and the logarithm of the number of different words."""
    words_of, spaced = word_reader(model)
    weights, line = fitted["weights"], fitted["line"]
    clean: set[str] = set()
    bad: dict[str, float] = {}

    def best(words: set[str]) -> float:
        return max((weights[f] for w in words for f in features(w) if f in weights), default=0.0)

    def stats(text: str) -> list[float]:
        low = text.lower()
        tokens = set(low.split())
        new = tokens - clean
        for t in new:
            if t not in bad:
                if h := best(words_of(t)):
                    bad[t] = h
                else:
                    clean.add(t)
        found = [bad[t] for t in new if t in bad] + [h for w in spaced(low) if (h := best({w}))]
        if len(clean) > keep:
            clean.clear()
        if len(bad) > keep // 4:
            bad.clear()
        found = heapq.nlargest(20, found)
        return [1.0, found[0] if found else 0.0, sum(found[:10]), float(len(found)), math.log1p(len(tokens))]

    def score(text: str) -> float:
        z = sum(b * x for b, x in zip(line, stats(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    return score, stats


def scored(docs: DataFrame, fitted: dict, model: np.ndarray, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` as the struct ``row`` (of the columns ``carry``, or of all), with ``score``."""
    rows = docs.select(F.struct(*(carry or ["*"])).alias("row"), *([F.col(text).alias("text")] if carry else []))

    def make():
        score = scorer(fitted, model)[0]

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            row = batch.column(0)
            texts = batch.column(1) if carry else row.field(text)
            scores = [score(t or "") for t in texts.to_pylist()]
            return pa.RecordBatch.from_arrays([row, pa.array(scores, pa.float64())], ["row", "score"])

        return each

    return arrow_map(rows, make, rows.select("row", F.lit(0.0).alias("score")).schema, SLICE)


def trained(docs: DataFrame, labels: DataFrame, **options) -> tuple[dict, np.ndarray]:
    model = character_model(docs)
    return fit(docs, labels, model, **options), model


def predicted(score: Column) -> Column:
    return (score >= 0.5).cast("int")
