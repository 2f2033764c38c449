"""MinHash and lattice near-duplicates and components, each against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest

from corpusmill.llm import lattice, minhash
from corpusmill.llm.components import components

DOCS = "doc_id long, text string, sig string, node long"


def smallest(ids, links):
    up = {i: i for i in ids}

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(docs, k):
    sets = {i: shingles(t, k) for i, t, *_ in docs}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return sets, smallest(sets, links)


def corpus(seed, copies):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(1, 6)))
    base = [" ".join(word() for _ in range(draw.randint(3, 200))) for _ in range(25)]
    out = list(base)
    for _ in range(copies):
        w = (base[0] if draw.random() < 0.6 else draw.choice(base)).split()
        for _ in range(draw.randint(0, max(1, len(w) // 25))):
            w[draw.randrange(len(w))] = word()
        out.append((" " if draw.random() < 0.5 else "\n").join(w).swapcase() if draw.random() < 0.3 else " ".join(w))
    return [(i, t, "s", 1) for i, t in enumerate(out)]


@pytest.mark.parametrize("block", [256, 5])
def test_minhash_against_all_pairs(frame, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    docs = corpus(1, 160)
    n = len(docs)
    docs += [(n, None, None, None), (n + 1, "", "s", 1), (n + 2, " \n ", "s", 1), (n + 3, "two words", "s", 1), (n + 4, "TWO\twords", "s", 1), (n + 5, "x " * 40000, "s", 1), (n + 6, " one word", "s", 1)]
    sets, want = brute(docs, 4)
    got = minhash.near_duplicates(frame(docs, DOCS), words=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_minhash_repeats_and_empty(frame):
    rows = [(5, "a b c d e f", "s", 1)] * 3 + [(4, "a b c d e f", "s", 1), (9, None, None, None)]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(frame(rows, DOCS)).collect())
    assert got == [(4, 4, True), (5, 4, False), (5, 4, False), (5, 4, False), (9, 9, True)]
    assert minhash.near_duplicates(frame([], DOCS)).count() == 0
    left = minhash.without_near_duplicates(frame(rows, DOCS))
    assert left.columns == ["doc_id", "text", "sig", "node"] and sorted(r.doc_id for r in left.collect()) == [4, 9]


def test_signature_is_a_turned_permutation():
    """Coordinate k is the least value of the second permutation, turned by k, over the scattered set."""
    ring, draw = 64, np.random.default_rng(7)
    scatter, values = draw.permutation(ring), draw.permutation(ring)
    hashes = np.array([3, 77, 130, 999], dtype=np.uint64)
    sig = minhash.signer(2, 4, ring)(hashes)
    assert sig.tolist() == [min(values[(scatter[int(h) % ring] + k) % ring] for h in hashes) for k in range(8)]


def test_components(frame):
    draw = random.Random(2)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, 500 + i) for i in range(1, 90)] + [(3, 3)]
    got = {r.node: r.root for r in components(frame(links, "a long, b long")).collect()}
    ids = {x for a, b in links if a != b for x in (a, b)}
    assert got == {i: r for i, r in smallest(ids, [x for x in links if x[0] != x[1]]).items()}
    assert components(frame([], "a long, b long")) is None


def test_e8_decoding_is_nearest():
    draw = np.random.default_rng(1)
    y = draw.normal(size=(300, 8)) * 2
    point = lattice.decode_e8(y)
    doubled = np.rint(point * 2)
    assert ((doubled % 2).sum(axis=1) % 8 == 0).all() and (np.rint(point.sum(axis=1)) % 2 == 0).all()
    steps = lattice.shortest_vectors()
    assert len(steps) == 240 and np.allclose((steps**2).sum(axis=1), 2)
    own = ((y - point) ** 2).sum(axis=1)
    assert (own[:, None] <= ((y[:, None] - point[:, None] - steps[None]) ** 2).sum(axis=2) + 1e-9).all()


@pytest.mark.parametrize("block", [512, 4])
def test_lattice_against_all_pairs(frame, block):
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(12, 16))
    rows = []
    for i in range(220):
        c = centres[0] if i % 3 == 0 else centres[draw.integers(12)]
        v = c + draw.normal(size=16) * draw.choice([0.02, 0.15, 0.3])
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(draw.integers(2)), "x"))
    rows += [(300 + k, rows[k][1], rows[k][2], "copy") for k in range(8)]
    rows += [(400, None, 1, "x"), (401, [0.0] * 16, 1, "x"), (402, [float("nan")] * 16, 1, "x"), (403, [1.0, None], 1, "x"), (404, rows[0][1], None, "x"), (405, [], 1, "x"), (406, [1.0, 2.0], 1, "x"), (407, [2.0, 4.0], 1, "x")]
    good = {i: (np.array(v), lab) for i, v, lab, _ in rows if v and lab is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    cos = lambda a, b: len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b))
    links = [(a, b) for a, b in combinations(good, 2) if good[a][1] == good[b][1] and cos(good[a][0], good[b][0]) >= 0.93]
    ids = [r[0] for r in rows]
    want = smallest(ids, links)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in lattice.near_vectors(frame(rows, "vec_id long, embedding array<float>, label int, unit string"), block=block).collect()}
    n = {i: sum(i in x for x in links) for i in ids}
    missed = sum(abs(n[i] - got[i][0]) for i in ids) / 2
    assert all(got[i][0] <= n[i] for i in ids) and missed <= 0.01 * len(links)
    assert got.keys() == set(ids) and {i: got[i][1] for i in ids} == want
    assert lattice.near_vectors(frame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_minhash_with_repeated_and_null_ids(frame):
    long = " ".join(f"w{i}" for i in range(100))
    near = lambda w: f"{w} {long}"
    rows = [(7, "a text of its own that is nowhere else", "own", 1), (7, near("x"), "x", 1), (8, near("y"), "y", 1)]
    rows += [(None, "null ids link as well " + near("p").replace("w", "v"), "p", 1), (None, "null ids link as well " + near("q").replace("w", "v"), "q", 1)]
    rows += [(3, "copies with the smallest id", "c", 1)] * 3 + [(None, "copies with the smallest id", "n", 1)]
    table = frame(rows, DOCS).coalesce(1)
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in minhash.near_duplicates(table).collect())
    assert got == sorted([("7", "7", True)] * 2 + [("8", "7", False)] + [("None", "None", True), ("None", "None", False)] + [("3", "3", True)] + [("3", "3", False)] * 2 + [("None", "3", False)])
    left = [r.sig for r in minhash.without_near_duplicates(table).collect()]
    assert len(left) == 4 and {"own", "x", "c"} < set(left) and len({"p", "q"} & set(left)) == 1
