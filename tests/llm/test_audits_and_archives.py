"""Filter interactions, source divergence and WARC bundles against brute force, and their defined cases."""

import base64
import hashlib
import io
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
import zstandard

from corpusmill.llm import divergence, filter_audit, warc

DOCS = "doc_id long, text string, lang string, source string, part string, digest string, n long"
LABELS = "doc_id long, quality int, toxic int"


def docs_of(frame, rows):
    """Rows (doc_id, text, lang, source), with columns whose names the operators use too."""
    return frame([(*r, "x", "y", 1) for r in rows], DOCS)


# Filter interactions


def failures(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    return [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search(r"[#$%&*|]", text))]


def brute_interactions(docs, labels):
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    rows = defaultdict(list)
    for doc_id, text, lang, _ in docs:
        text = text or ""
        again = doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, _, _ in docs)
        rows[lang or ""].append((dict(zip("ABCDE", [*failures(text), again])), doc_id in good, doc_id in toxic))
    out = {}
    for part, members in rows.items():
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = members
            for step, f in enumerate(order):
                gone = [m for m in left if m[0][f]]
                kept = [m for m in left if not m[0][f]]
                fails = [m for m in members if m[0][f]]
                shapley[f] += len(gone)
                out[part, order, step + 1] = [
                    len(kept), len(gone), len(fails) - len(gone), sum(sum(m[0].values()) == 1 for m in fails), sum(m[1] for m in gone), sum(m[2] for m in gone)
                ]
                left = kept
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order):
                out[part, order, step + 1].append(shapley[f])
    return out


def test_interactions_by_brute_force(spark, frame):
    draw = random.Random(3)
    plain = " ".join(f"word{i}" for i in range(120))
    texts = [plain, plain + " x", plain + " $", plain.upper(), "a b", "", None, "same " * 150, "é " * 3 + "| A", " \x0b\t", "x" * 500_000 + " %"]
    docs = [(i if i % 11 else None, draw.choice(texts), draw.choice(["en", "de", None, ""]), "s") for i in range(150)] + [(3, plain, "en", "s")] * 3
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1])) for i in range(0, 150, 2)] + [(None, 1, 1), (4, 1, 0), (4, 0, 1)]
    got = filter_audit.interactions(docs_of(frame, docs), frame(labels, LABELS)).collect()
    assert {(r["part"], r["filter_order"], r["step"]): [r[f] for f in filter_audit.FIGURES] for r in got} == brute_interactions(docs, labels)
    assert len(got) == 3 * 600


def test_interactions_of_nothing(spark, frame):
    assert filter_audit.interactions(docs_of(frame, []), frame([], LABELS)).collect() == []


def test_contractions_select_cells():
    cells = np.random.default_rng(1).integers(0, 1000, (2, 32))
    found = filter_audit.figures(cells, cells, cells)
    at = [(o, s) for o in filter_audit.ORDERS for s in range(5)].index(("CABDE", 1))  # A after C
    bits = np.array([[c >> (4 - f) & 1 for f in range(5)] for c in range(32)])
    gone = (bits[:, 0] == 1) & (bits[:, 2] == 0)
    assert (found["removed"][:, at] == cells[:, gone].sum(axis=1)).all()
    assert (found["good_lost"] == found["removed"]).all()


# Source divergence


def brute_divergence(docs, min_docs=3, top=200):
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in docs:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        groups.add((lang, source))
        counts[lang, source].update(words)
        seen[lang].update(set(words))
    out = []
    for lang, source in groups:
        kept = [t for t, n in seen[lang].items() if n >= min_docs]
        here = [s for x, s in groups if x == lang]
        n = {s: sum(counts[lang, s][t] for t in kept) for s in here}
        p = {s: {t: 1 + 10**9 * (counts[lang, s][t] + 1) // (n[s] + len(kept)) for t in kept} for s in here}
        q = {t: 1 + 10**9 * (sum(counts[lang, s][t] for s in here) + 1) // (sum(n.values()) + len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // q
        pairs = [(sum(f(p[source][t], p[s][t]) for t in kept), s) for s in here if s != source]
        terms = [(f(p[source][t], q[t]), t) for t in kept if counts[lang, source][t] and p[source][t] > q[t]]
        for part, items, most in (("pair", pairs, None), ("term", terms, top)):
            for rank, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                out.append((lang, source, part, item, value, rank))
    return sorted(out)


@pytest.mark.parametrize("top, cells, held", [(200, 500_000, 300_000), (3, 40, 5)])
def test_divergence_by_brute_force(spark, frame, monkeypatch, top, cells, held):
    monkeypatch.setattr(divergence, "CELLS", cells)
    monkeypatch.setattr(divergence, "HELD", held)
    draw = random.Random(5)
    words = [f"{a}{b}" for a in "abcdefg" for b in ("x", "YZ", "É", "ß中")]
    docs = [
        (i, " ".join(draw.choices(words[: 5 + i % 24], k=draw.randrange(30))), draw.choice(["en", "de", None]), draw.choice(["a", "b", "ä", None, ""]))
        for i in range(160)
    ]
    docs += [(7, None, "en", "empty"), (7, "", "lone", "only"), (8, "once alone here", "few", "a"), (9, "", "few", "b"), (None, "ax9ax-ax" * 9000, "en", "a")]
    got = sorted(tuple(r) for r in divergence.audit(docs_of(frame, docs), top=top).collect())
    assert got == brute_divergence(docs, top=top)


def test_divergence_of_nothing(spark, frame):
    assert divergence.audit(docs_of(frame, [])).collect() == []


def test_large_counts_stay_exact(spark):
    count, whole = 4 * 10**12, 9 * 10**12 + 7
    exact = 1 + 10**9 * count // whole
    from pyspark.sql import functions as F

    assert spark.range(1).select(divergence.parts_of(F.lit(count), F.lit(whole))).first()[0] == exact
    assert divergence.parts_array(np.array([count]), whole)[0] == exact


def test_runs_give_the_sum_over_terms():
    draw = np.random.default_rng(2)
    counts, lengths = draw.integers(0, 3, (4, 60)), draw.integers(1, 9, 60)
    wholes = [int((c * lengths).sum() + lengths.sum()) for c in counts]
    shares = [divergence.parts_array(c + 1, w) for c, w in zip(counts, wholes)]
    got = divergence.pair_sums(counts, lengths, wholes)
    for a in range(4):
        for b in range(4):
            if a != b:
                assert got[a, b] == ((shares[a] - shares[b]) ** 2 // shares[b] * lengths).sum()


# WARC bundles


PAGES = "page_id long, url string, html string, payload string, first string"
ROWS = [
    (1, "http://a/1", "<p>one</p>"), (2, "http://a/2", None), (3, None, ""), (4, "http://a/ 4\r\nX: y", "<p>one</p>"), (5, "http://a/5", "é" * 300_000),
    (6, "http://a/6", "<p>one</p>"), (None, "http://a/7", "<p>one</p>"), (8, "http://a/8", "x\r\n\r\nWARC/1.1\r\n"), (9, "", "twice"), (9, "", "twice"), (None, None, "nameless"),
]


def pages_of(frame, rows):
    return frame([(*r, "p", "f") for r in rows], PAGES)


def brute_records(rows, min_bytes=0):
    out = []
    for page_id, _, html in rows:
        body = (html or "").encode()
        same = [i for i, _, h in rows if (h or "").encode() == body]
        last = max((i for i in same if i is not None), default=None)
        again = len(body) >= min_bytes and page_id != last
        out.append((page_id, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", last if again else None))
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


def named(rows):
    return [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows]


@pytest.mark.parametrize("min_bytes, frame_bytes, bundle_bytes", [(0, 1 << 20, 1 << 28), (6, 64, 300), (11, 1000, 1)])
def test_archive_reads_back(spark, frame, tmp_path, min_bytes, frame_bytes, bundle_bytes):
    path = str(tmp_path / "archive")
    warc.write_archive(pages_of(frame, ROWS), path, min_bytes, frame_bytes, bundle_bytes)
    assert sorted(named(warc.read_archive(spark, path).collect()), key=key) == sorted(brute_records(ROWS, min_bytes), key=key)
    back = warc.restored(spark, path).collect()
    assert sorted(((r["page_id"], r["html"]) for r in back), key=key) == sorted(((i, h or "") for i, _, h in ROWS), key=key)


def test_bundles_are_plain_zstandard(spark, frame, tmp_path):
    path = tmp_path / "archive"
    warc.write_archive(pages_of(frame, ROWS), str(path), frame_bytes=200)
    index = {(r["bundle"], r["frame"], r["offset"]): r for r in warc.read_index(spark, str(path)).collect()}
    for bundle in (path / "bundles").iterdir():
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(bundle.read_bytes()), read_across_frames=True).read()
        kinds = Counter(f["WARC-Type"] for f, _ in warc.parsed(whole))
        assert kinds["warcinfo"] == 1 and sum(kinds.values()) - 1 == sum(b == bundle.name for b, _, _ in index)
        fs, at = warc.file_system(str(bundle))
        file = fs.open_input_file(at)
        for number, frame_ in enumerate(warc.seek_table(file)):
            data = warc.read_frame(file, frame_)
            for (_, f, offset), row in index.items():
                if row["bundle"] == bundle.name and f == number:
                    assert (row["frame_at"], row["frame_size"]) == frame_[:2]
                    (fields, _), = warc.parsed(data, offset, offset + row["length"])
                    assert fields["WARC-Record-ID"] == row["record_id"]


def test_chosen_records_only(spark, frame, tmp_path):
    path = str(tmp_path / "archive")
    warc.write_archive(pages_of(frame, ROWS), path, frame_bytes=200)
    ids = [r["record_id"] for r in warc.read_index(spark, path).where("page_id in (1, 5, 6)").collect()]
    rows = warc.read_records(path, frame([(i,) for i in ids] + [("<urn:uuid:none>",)], "record_id string")).collect()
    assert sorted(r["page_id"] for r in rows) == [1, 5, 6]
    by_page = {r["page_id"]: r for r in rows}
    assert bytes(by_page[5]["payload"]) == ("é" * 300_000).encode()
    assert by_page[1]["refers_to_id"] == by_page[6]["record_id"] and by_page[1]["payload"] is None


def test_files_that_no_index_names_are_not_read(spark, frame, tmp_path):
    path = tmp_path / "archive"
    warc.write_archive(pages_of(frame, ROWS), str(path))
    (path / "bundles" / "part-000000-0000-lost.warc.zst").write_bytes(b"half of a bundle")
    assert warc.read_archive(spark, str(path)).count() == len(ROWS)


def test_a_damaged_frame_is_found(spark, frame, tmp_path):
    writer = warc.BundleWriter(str(tmp_path), "b.warc.zst", 10, 3)
    for page in range(3):
        writer.place(warc.page_record(page, "u", b"payload", None, "1970-01-01T00:00:00Z")[2])
    writer.close()
    fs, at = warc.file_system(str(tmp_path / "b.warc.zst"))
    table = warc.seek_table(fs.open_input_file(at))
    assert len(table) == 3
    wrong = (*table[0][:3], table[0][3] ^ 1)
    with pytest.raises(ValueError):
        warc.read_frame(fs.open_input_file(at), wrong)


def test_archive_of_nothing(spark, frame, tmp_path):
    warc.write_archive(pages_of(frame, []), str(tmp_path / "archive"))
    assert warc.read_archive(spark, str(tmp_path / "archive")).collect() == []
