"""What the findings of the fourth round named, in the operators for training data."""

import numpy as np
from pyspark.sql import functions as F

from corpusmill.llm import bloom_lm
from corpusmill.llm.common import remainder


def test_a_part_of_the_filter_reads_what_many_slices_ask_at_once(monkeypatch):
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 1 << 63, 500, dtype=np.uint64))
    width = 40_000
    bits = np.zeros(width, dtype=bool)
    for level in range(1, 6):
        for probe in range(bloom_lm.PROBES):
            bits[bloom_lm._bits(keys[: 100 * (6 - level)], level, probe, width)] = True
    bits = np.packbits(bits)
    asks = [np.sort(rng.choice(keys, n, replace=False)) for n in rng.integers(0, 40, 300)]
    alone = [bloom_lm.levels_in(bits, k, np.zeros(len(k), np.int64), np.full(len(k), width)) for k in asks]
    calls, levels_in = [], bloom_lm.levels_in
    monkeypatch.setattr(bloom_lm, "levels_in", lambda *a: calls.append(len(a[1])) or levels_in(*a))
    together = bloom_lm.levels_of_asks(asks, bits, width)
    assert all(np.array_equal(a, b) for a, b in zip(alone, together)) and len(together) == 300
    assert calls == [len(np.unique(np.concatenate(asks)))]  # each key once, in one pass over the levels


def test_places_lead_back_to_words_and_pairs():
    words = np.array([5, 9, 5, 5, 9], dtype=np.uint64) << np.uint64(60)
    sizes = np.array([3, 2])
    model = bloom_lm.Model(None, np.zeros(16, np.int64), np.ones(16, np.int64), 1, 1, 1, 0.5, words[:0], words[:0], 1)
    asks, places = bloom_lm.asked_keys(model, words, sizes)
    keys = np.concatenate([np.frombuffer(a["keys"], dtype=np.uint64) for a in asks])
    assert np.array_equal(keys, np.unique(keys)) and [a["bucket"] for a in asks] == sorted({int(k) >> 60 for k in keys})
    back = keys[bloom_lm.unpacked(bloom_lm.packed(places), 10)]
    assert np.array_equal(back, np.concatenate([words, bloom_lm.pair_keys(words, sizes)[1]]))


def test_scores_by_table_are_those_by_broadcast(spark):
    docs = [(i, None if i == 7 else " ".join(f"w{(i * j) % (j + 3)}" for j in range(i % 90))) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    one, two = (sorted(bloom_lm.scored(df, remainder(F.col("doc_id"), 7) == 2, max_bytes=b).collect()) for b in (0, 256 << 20))
    assert one == two and len(one) == 400
