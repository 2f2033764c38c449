"""Packing, the token store and mixing: laws, exact round trips, edge cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.llm import mixing, packing, tokens
from corpusmill.llm.common import shared_path, word_count

DOCS = "doc_id long, text string, source string, row string, n long"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_bins_hold_what_they_say(lengths):
    bins, at, sizes = packing.best_fit(lengths, (8, 16, 32, 64))
    held = defaultdict(list)
    for b, a, n in zip(bins, at, lengths):
        held[b].append((a, a + n))
    for b, spans in held.items():
        spans.sort()
        assert all(x[1] == y[0] for x, y in zip(spans, spans[1:])) and spans[0][0] == 0
        assert spans[-1][1] <= sizes[b] and not any(spans[-1][1] <= s < sizes[b] for s in (8, 16, 32, 64))


def test_best_fit_takes_the_tightest_bin_and_shrinks():
    bins, _, sizes = packing.best_fit([60, 50, 14, 4], (64,))
    assert bins[3] == bins[0] and bins[2] == bins[1] and sizes == [64, 64]
    assert packing.best_fit([30, 5], (8, 32, 64))[2] == [32, 8] or packing.best_fit([30, 5], (8, 32, 64))[2] == [64]


def test_pack_keeps_every_token(frame):
    rows = [(1, "a", "x", "r", 20000), (1, "a", "x", "r", 20000), (2, None, None, None, 0), (3, "b", "y", "r", None), (4, "c", "y", "r", 7), (None, "d", "z", "r", 8192)]
    out = packing.pack(frame(rows, DOCS), F.col("n"), block=4).select("row.*", "piece", "piece_start", "piece_length", "bin_id", "bin_size", "bin_offset").collect()
    total = defaultdict(int)
    used = defaultdict(int)
    for r in out:
        total[r.doc_id] += r.piece_length
        used[r.bin_id] += r.piece_length
    assert total == {1: 40000, 2: 0, 3: 0, 4: 7, None: 8192}
    assert all(r.bin_id is None and r.bin_size == 0 for r in out if not r.piece_length)
    assert all(used[r.bin_id] <= r.bin_size for r in out if r.bin_id)
    assert packing.pack(frame([], DOCS), F.col("n")).count() == 0


def test_token_store_round_trip(spark, frame):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokens.tokenizer_path())
    model.encode_special_tokens = True
    texts = ["", None, "a  b \n c", "x" * 5000, "Straße <|endoftext|> it's 12²  ", "long text, " * 20000, "same", "same"]
    rows = [(i if i != 7 else 6, t, "s", "ids", i) for i, t in enumerate(texts)]
    random.Random(3).shuffle(rows)
    docs = frame(rows, DOCS).repartition(3)
    path = shared_path(spark, "test")
    tokens.write_tokens(docs, path, parts=3)
    got = {r.doc_id: r for r in tokens.read_tokens(spark, path).where("doc_id < 6").collect()}
    start = 0
    for i, t in enumerate(texts[:6]):
        want = model.encode(t or "", add_special_tokens=False).ids + [2]
        assert (got[i].start, got[i].n_tokens, got[i].ids) == (start, len(want), want)
        start += len(want)
    some = tokens.read_tokens(spark, path, doc_ids=[2])
    assert [r.doc_id for r in some.collect()] == [2] and "ids" not in tokens.read_tokens(spark, path, metadata_only=True).columns
    crc = {r.doc_id: r.ids_crc32 for r in tokens.with_crc(tokens.read_tokens(spark, path)).collect()}
    assert crc[3] == zlib.crc32(np.array(got[3].ids, "<u4").tobytes())
    assert tokens.stored_digest(frame([], DOCS)).count() == 0


def test_store_is_dictionary_encoded_with_page_indexes(spark, frame):
    import glob

    import pyarrow.parquet as pq

    path = shared_path(spark, "test")
    tokens.write_tokens(frame([(i, "some words here " * 50, "s", "r", 0) for i in range(200)], DOCS), path, parts=1)
    file = max(glob.glob(f"{path.removeprefix('file:')}/ids/*.parquet"))
    chunks = {c.path_in_schema: c for c in (pq.ParquetFile(file).metadata.row_group(0).column(i) for i in range(5))}
    ids = next(c for n, c in chunks.items() if n.startswith("ids"))
    assert any("DICTIONARY" in e for e in ids.encodings) and "DELTA_BINARY_PACKED" in chunks["doc_id"].encodings
    assert chunks["doc_id"].has_offset_index and chunks["doc_id"].has_column_index


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_encoder_is_the_librarys(text):
    from tokenizers import Tokenizer

    if not hasattr(test_encoder_is_the_librarys, "both"):
        model = Tokenizer.from_file(tokens.tokenizer_path())
        model.encode_special_tokens = True
        test_encoder_is_the_librarys.both = tokens.piece_encoder(keep=50), model
    own, model = test_encoder_is_the_librarys.both
    assert own([text, "a " + text])[1].tolist() == model.encode("a " + text, add_special_tokens=False).ids


def brute_mix(rows):
    """By sorting: sizes, targets by repeated resharing, and the rows below each source's budget."""
    size = {i: len((t or "").split()) for i, (_, t, *_) in enumerate(rows)}
    total = defaultdict(int)
    for i, r in enumerate(rows):
        total[r[2]] += size[i]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    whole, target, open_ = sum(total.values()), dict.fromkeys(order, 0.0), set(order)
    while open_:
        spare = whole - sum(target[s] for s in order if s not in open_)
        share = {s: spare * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * total[s]}
        target.update({s: 3.0 * total[s] for s in full} if full else share)
        open_ = open_ - full if full else set()
    taken = {}
    h = {i: int(hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest()[:15], 16) for i, r in enumerate(rows)}
    for s in order:
        mine = [i for i, r in enumerate(rows) if r[2] == s]
        copies = int(target[s] // total[s]) if total[s] else 0
        budget, below = target[s] - copies * total[s], 0
        for v in sorted({h[i] for i in mine}):
            here = [i for i in mine if h[i] == v]
            n = sum(size[i] for i in here)
            for i in here:
                taken[i] = size[i] * (copies + (below + n <= budget or 2 * below + n < 2 * budget))
            below += n
    return size, total, target, taken


def test_mix_against_sorting(frame):
    draw = random.Random(5)
    rows = [(i, " ".join("w" * draw.randint(0, 90)), draw.choice(["a", "b", None, "c", "tiny"]) if i % 9 else "hot", "copies", i) for i in range(400)]
    rows += [(7, "repeated row", "a", "r", 1)] * 3 + [(None, None, "empty", None, None)] * 2
    size, total, target, taken = brute_mix(rows)
    out = mixing.mix(frame(rows, DOCS), word_count(F.col("text"))).select("row.*", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")).collect()
    got = sorted((str(r.doc_id), str(r.text), r["size"], r.source_size, round(r.target, 4), r.taken) for r in out)
    assert got == sorted((str(r[0]), str(r[1]), size[i], total[r[2]], round(target[r[2]], 4), taken[i]) for i, r in enumerate(rows))
    assert mixing.mix(frame([], DOCS), word_count(F.col("text"))).count() == 0
    mixed = mixing.mixed_rows(frame(rows, DOCS), word_count(F.col("text")))
    assert mixed.columns == ["doc_id", "text", "source", "row", "n"]
    words = sum(len(r.text.split()) for r in mixed.collect() if r.text)
    assert words == sum(taken.values())


def test_added_tokens_are_the_librarys(frame):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokens.tokenizer_path())
    end = "<|endoftext|>"
    texts = [end, f"a {end} b", f"{end}{end} x", f"word{end}word  {end}\n", f"  {end}  two", "<|endoftext", f"x<{end}>", "plain text", f"it's 12² {end}."]
    want = [model.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in tokens.piece_encoder(added=True)(texts)] == want
    docs = frame([(i, t, "s", "ids", i) for i, t in enumerate(texts)], DOCS)
    crc = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in tokens.stored_digest(docs).collect()}
    assert crc == {i: (len(w) + 1, zlib.crc32(np.array(w + [2], "<u4").tobytes())) for i, w in enumerate(want)}
    assert {r.doc_id: r.n_tokens for r in tokens.token_counts(docs).collect()} == {i: len(w) + 1 for i, w in enumerate(want)}


def test_rows_without_size_are_not_repeated_beyond_the_limit(frame):
    """A source at its cap, with empty rows, beside a source that has nothing else."""
    rows = [(i, "a b" if i % 2 else "", "small", "copies", i) for i in range(20)] + [(100 + i, "w " * 900, "x-large", "copies", i) for i in range(9)]
    rows += [(200 + i, "" if i else None, "void", "copies", i) for i in range(5)]
    table = frame(rows, DOCS)
    got = {r["row"]["doc_id"]: r for r in mixing.mix(table, word_count(F.col("text"))).collect()}
    assert max(r["copies"] for r in got.values()) == 3
    assert all(got[i]["copies"] == 0 and got[i]["target"] == 0 for i in range(200, 205))
    taken = Counter(r["doc_id"] for r in mixing.mixed_rows(table, word_count(F.col("text"))).collect())
    assert all(taken[i] == r["copies"] for i, r in got.items())


def test_other_pre_tokenizers_are_refused(tmp_path):
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    cases = [(pre_tokenizers.Whitespace(), None), (pre_tokenizers.ByteLevel(add_prefix_space=True), None), (pre_tokenizers.ByteLevel(add_prefix_space=False), normalizers.NFC()), (None, None)]
    for cut, before in cases:
        other = Tokenizer(models.BPE(vocab={"a": 0}, merges=[]))
        if cut:
            other.pre_tokenizer = cut
        if before:
            other.normalizer = before
        other.save(str(tmp_path / "t.json"))
        with pytest.raises(ValueError):
            tokens.piece_encoder(str(tmp_path / "t.json"))


def test_pieces_last_from_task_to_task():
    """op2_token_store: a worker's next task encodes only what no task before it had; what is forgotten comes out alike."""
    texts = ["The first wörd, and the next.", "", " alone", "a  b\n c", "x" * 150 + " the first"]
    plain = [x.tolist() for x in tokens.piece_encoder()(texts)]
    first = tokens.piece_encoder(lasting=True)
    assert [x.tolist() for x in first(texts)] == plain
    _, pieces = tokens._pieces(tokens.tokenizer_path(), 100, True)
    pieces.tokenize = None  # nothing may be encoded again but the long piece
    assert [x.tolist() for x in tokens.piece_encoder(lasting=True)(texts[:-1])] == plain[:-1]
    tokens.worker_memory().clear()
    small = tokens.piece_encoder(keep=2, keep_pieces=6, lasting=True)
    assert [[x.tolist() for x in small([t])] for t in texts * 3] == [[x] for x in plain * 3]
    tokens.worker_memory().clear()


def test_memory_of_a_worker_outlives_its_task(spark):
    def run(batches):
        from corpusmill.llm.common import worker_memory as memory

        for batch in batches:
            memory()["n"] = memory().get("n", 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([memory()["n"]])], ["n"])

    assert max(r.n for r in spark.range(0, 64, 1, 64).mapInArrow(run, "n long").collect()) > 1
