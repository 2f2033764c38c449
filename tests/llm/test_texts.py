"""Toxicity, fingerprints, scores, page text and chat: brute force, held-out accuracy, round trips, edge cases."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import bloom_lm, chat, fingerprints, html_text, toxicity
from corpusmill.llm.common import remainder, shared_path

DOCS = "doc_id long, text string, row string, score double"
WORDS = "the of and to in is it that for was with his they be at one have this from or had by hot word but what some we can out other were all there when up use your how said".split()


def toxic_corpus(n=900):
    draw = random.Random(8)
    bad = ["moronic", "scumbag", "worthless"]
    hide = {"moronic": "m0r0nic", "scumbag": "5cumb@g", "worthless": "w o r t h l e s s"}
    docs, labels = [], []
    for i in range(n):
        words = [draw.choice(WORDS) for _ in range(draw.randint(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            w = draw.choice(bad)
            words.insert(draw.randrange(len(words)), hide[w] if i % 15 == 0 and i > 400 else w)
        docs.append((i, " ".join(words), "r", 0.5))
        labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity_on_held_out_rows(frame):
    docs, labels = toxic_corpus()
    docs += [(5000, None, None, None), (5001, "", "r", 1.0), (5002, "привет мир", "r", 1.0), (5003, "а " * 30000, "r", 1.0)]
    learn = [x for x in labels if zlib.crc32(str(x[0]).encode()) % 5] + [(0, None), (1, 0), (1, 0)]
    table = frame(docs, DOCS)
    fitted, model = toxicity.trained(table, frame(learn, "doc_id long, toxic int"))
    out = {r["row"].doc_id: r["score"] for r in toxicity.scored(table, fitted, model).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((out[i] >= 0.5) == bool(y) for i, y in held)
    assert right >= 0.97 * len(held) and all(0 <= s <= 1 for s in out.values())
    assert max(out[i] for i in range(5000, 5004)) < 0.5
    assert toxicity.scored(table, fitted, model).select("row.*").columns == ["doc_id", "text", "row", "score"]


def test_toxicity_without_labels_or_rows(frame):
    docs = frame([(1, "a b", "r", 0.1)], DOCS)
    none = frame([], "doc_id long, toxic int")
    fitted, model = toxicity.trained(docs, none)
    assert [r["score"] < 0.01 for r in toxicity.scored(docs, fitted, model).collect()] == [True]
    empty = frame([], DOCS)
    assert toxicity.scored(empty, *toxicity.trained(empty, none)).count() == 0


def test_viterbi_finds_the_best_path(frame):
    """The decoder's best reading is the best of all readings."""
    model = toxicity.character_model(frame([(i, "stupid idiot this is a small corpus of words moron", "r", 0.0) for i in range(5)], DOCS))
    decode = toxicity.decoder(model)
    for token in ("1d10t", "m0r0n", "5tup1d", "i.d.i"):
        options = []
        for c in token:
            options.append([(c, 0.0)] if c in toxicity.CODE else [(x, toxicity.READ) for x in toxicity.LEET.get(c, "")] + [("", toxicity.DROP), (" ", toxicity.END)])
        best = []
        for path in product(*options):
            a = b = 0
            score = -sum(cost for _, cost in path)
            for ch in "".join(p for p, _ in path):
                n = toxicity.CODE.get(ch, 0)
                if n or b:
                    score += float(model[a][b][n])
                    a, b = (b, n) if n else (0, 0)
            best.append((score + (float(model[a][b][0]) if b else 0.0), " ".join("".join(p for p, _ in path).split())))
        assert decode(token)[0] == max(best)[1]


def test_disguises_of_any_length_are_decoded(frame):
    words = "asshole shit fuck stop stupid idiot little letter book account address moron this is a small corpus of words"
    words_of, _ = toxicity.word_reader(toxicity.character_model(frame([(i, words, "r", 0.0) for i in range(3000)], DOCS)))
    for token, word in {"@$$hole": "asshole", "455hole": "asshole", "5hit": "shit", "570p": "stop", "fuuck": "fuck", "f.u.c.k": "fuck", "stuuupid": "stupid"}.items():
        assert word in words_of(token), token
    assert "stupid" in words_of(".".join("stupid" * 400)) and "stupid" in words_of("x" * 5000 + ".5tup1d." + "y" * 5000)
    assert words_of("2024") == set() and words_of("little") == {"little"} and words_of("") == set()


def test_fingerprints(frame):
    draw = random.Random(3)
    text = lambda n: " ".join("".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(2, 9))) for _ in range(n))
    docs = [(i * 2, text(draw.choice([0, 1, 30, 400])), "r", 1.0) for i in range(60)] + [(3, None, None, None), (5, "é" * 500, "r", 1.0), (7, text(30000), "r", 1.0)]
    docs += [(1001, docs[10][1], "r", 1.0), (1000, "zz " * 4000, "r", 1.0)]
    table = frame(docs, DOCS)
    ranks = fingerprints.rarity_ranks(table)
    got = {r.doc_id: r for r in fingerprints.fingerprints(table.repartition(5), ranks).collect()}
    order = sorted((i, t or "") for i, t, *_ in docs)
    assert got.keys() == {i for i, _ in order}
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        keep = len(t) - len(t) // 4
        edited = t[:keep] + after[: len(t) // 4]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        data = edited.encode()
        alone = fingerprints.digest(data, fingerprints.features(np.frombuffer(data, np.uint8), ranks)) if edited != t else None
        if alone:
            assert r.edited_fingerprint == fingerprints.as_text(*alone)
        assert math.isclose(r.near_edited, fingerprints.likeness(fingerprints.from_text(r.fingerprint), fingerprints.from_text(r.edited_fingerprint)))
        assert 0 <= r.near_next <= 1
    assert got[docs[10][0]].fingerprint == got[1001].fingerprint and got[3].fingerprint == ""
    # The uniform text has no features of its own beside those of the text that it is mixed with.
    long = [r for r in got.values() if r.n_chars > 1500 and r.doc_id != 1000]
    assert got[1000].fingerprint.startswith("parts:3:")
    assert min(r.near_edited for r in long) > 0.5 > max(r.near_next for r in long)
    assert fingerprints.fingerprints(frame([], DOCS), ranks).count() == 0


def test_fingerprints_over_many_ranges(frame):
    docs = [(i // 2, f"text number {i} " * 9, "r", 1.0) for i in range(300)] + [(None, "no id " * 20, "r", 1.0)]
    table = frame(docs, DOCS)
    rows = fingerprints.successors(table, rows_per_part=7).collect()
    assert len([r for r in rows if not r.extra]) == len(docs)
    ranks = np.arange(fingerprints.CELLS, dtype=np.int16)
    assert fingerprints.fingerprints(table, ranks).count() == len(docs)


def test_window_entropy_against_counting():
    data = np.random.default_rng(2).integers(97, 110, 300).astype(np.uint8)
    for i, cell in enumerate(fingerprints._window_entropies(data)):
        n = np.array(list(Counter(data[i : i + 64].tolist()).values())) / 64
        assert abs(cell - -(n * np.log2(n)).sum() * 1000 / 6) <= 0.51


@pytest.mark.parametrize("frequent", [4_000_000, 3, 0])
def test_language_model(frame, frequent):
    draw = random.Random(6)
    docs = [(i, " ".join(draw.choice(WORDS) for _ in range(draw.randint(0, 40))), "r", 0.0) for i in range(200)]
    docs += [(500, None, None, None), (501, "new\tunseen WORDS\x0bof the", "r", 0.0), (502, docs[3][1], "r", 0.0), (502, docs[3][1], "r", 0.0)]
    out = bloom_lm.scored(frame(docs, DOCS), remainder(F.col("doc_id"), 7) == 2, frequent=frequent).collect()
    count = Counter()
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    words = lambda t: (t or "").encode().lower().split() + [None]
    for i, t, *_ in docs:
        if not held(i):
            count.update(words(t))
    n, v = sum(count.values()), len(count)
    want = sorted((i, held(i), len(words(t)), sum(count[w] > 0 for w in words(t)), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words(t)), 6)) for i, t, *_ in docs)
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    assert all(-math.inf < r.score <= 0 for r in out)
    assert bloom_lm.scored(frame([], DOCS), remainder(F.col("doc_id"), 7) == 2).count() == 0


def test_filter_counts_come_near_the_counts(frame):
    docs = frame([(i, "a " * 100 + "b c", "r", 0.0) for i in range(30)] + [(99, "once", "r", 0.0)], DOCS)
    model, _ = bloom_lm.fitted(docs)
    h = bloom_lm.word_hasher()([b"a b c once absent"])[0]
    got = bloom_lm.counts_in_filter(model, h)
    assert 3000 / 1.25 <= got[0] <= 3000 * 1.25 and 24 <= got[1] <= 38 and got[3] >= 1 and (got[1:3] == got[1]).all()


PAGES = {
    "": "",
    "text only": "text only",
    "<p>unfinished <b>bold &lt;x&gt; <a hre": "unfinished bold <x>",
    "<script>var a='<p>x</p>'</script>": "",
    "<!-- c <p>no</p> --> <p>yes &nbsp; there</p>": "yes there",
    "<nav><a href=/>Home</a></nav><article><h1>Title</h1><p>One  two<br>three</p><p>Sh.</p></article><footer>&copy; x</footer>": "Title\nOne two three\nSh.",
    "<body><header><h1>Site</h1></header><main><article><header><h1>Real</h1><p>By me</p></header><p>Body text body text body text.</p>"
    "<form><input><label>Name</label></form><div class='notice'>Cookies</div><p>End.</p></article><section class=comments><article class=comment>"
    "<p>I think so, and I say it at great length, more than the article did, really.</p></article></section></main><footer>f</footer>": "Real\nBody text body text body text.\nEnd.",
}


def test_main_text(frame):
    assert {h: html_text.main_text(h) for h in PAGES} == PAGES
    rows = [(i, "u", h, "t") for i, h in enumerate(PAGES)] + [(90, None, None, None), (91, "u", "<p>" + "long words here " * 50000 + "</p>", "t"), (91, "u", "<p>x</p>", "t")]
    out = html_text.extracted(frame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(out) == len(rows) and all(len(r.text) == r.n_chars for r in out) and sum(not r.text for r in out) == 3
    assert html_text.extracted(frame([], "page_id long, url string, html string")).count() == 0


LONG = ["This paragraph number %d says what the page is about, at some length and without any tags inside of it." % i for i in range(6)]
MENU = "<ul>" + "".join(f"<li><a href=/{i}>Item {i}</a></li>" for i in range(8)) + "</ul>"
PLAIN = "".join(f"<p>{t}</p>" for t in LONG)


def test_content_is_found_by_its_ratio_alone(monkeypatch):
    """No tag or class says what is what."""
    page = f"<div class=x1>{MENU}</div><div class=x2><h1>On pages</h1>{PLAIN[:330]}</p><p>So.</p>{PLAIN[336:]}</div><div class=x3><span>a</span> <span>b</span> <span>c</span></div>"
    text = html_text.main_text(page)
    assert text.startswith("On pages\n" + LONG[0]) and "\nSo.\n" in text and text.endswith(LONG[5]) and "Item" not in text
    draw = np.random.default_rng(1)
    monkeypatch.setattr(html_text, "smoothed", lambda ratio: np.exp(draw.uniform(0, 6, len(ratio))))
    assert html_text.main_text(page) != text


@pytest.mark.parametrize("page, want", {
    f"<form id=aspnet><nav>{MENU}</nav><div><h1>Title</h1>{PLAIN}</div><footer>Imprint</footer></form>": ["Title", *LONG],
    f"<nav>{MENU}</nav><main><article><h2>One</h2>{PLAIN}</article><article><h2>Two</h2><p>{LONG[0]} Again.</p></article></main>": ["One", *LONG, "Two", LONG[0] + " Again."],
    f"<nav>{MENU}</nav><main><p>A lead that stands beside the article.</p><article><h2>One</h2>{PLAIN}</article></main>": ["A lead that stands beside the article.", "One", *LONG],
    f"<nav>{MENU}</nav><article class='search-engines widget'><h2>One</h2>{PLAIN}</article><footer>x</footer>": ["One", *LONG],
    f"<article><h1>One</h1>{PLAIN}<form><p>Leave your address here and get our letter every week.</p><button>Go</button></form></article>": ["One", *LONG],
    f"<article><h1>One</h1>{PLAIN}</article><section id=comments><div class=comment><p>{LONG[0] * 5}</p></div></section>": ["One", *LONG],
}.items())
def test_content_is_whole(page, want):
    assert html_text.main_text(page) == "\n".join(want)


def test_smoothing_and_threshold():
    assert np.allclose(html_text.smoothed(np.ones(7)), 1) and html_text.smoothed(np.eye(9)[4]).argmax() == 4
    assert 2 < html_text.threshold(np.array([0, 1, 2, 10, 11, 12.0])) < 10 and html_text.threshold(np.array([3.0])) == 3


CHATS = "conv_id long, turn long, role string, text string, node string, path string"


def chats():
    control = "<|im_end|><|im_start|>assistant ok"
    rows = [(c, t, ("user", "assistant")[t % 2], f"shared {t}" if t < 3 or c % 3 else f"own {c} {t}") for c in range(40) for t in range(2 + c % 4)]
    rows += [(100, t, "user", f"long {t}") for t in range(120)] + [(101, 0, "user", control), (101, 1, "assistant", control + "<\\|<\\\\|x|>"), (102, None, None, None), (102, 0, "as\\n\nsis<|tant", "")]
    rows += [(103, 1, "user", "tie b"), (103, 1, "user", "tie a"), (103, 1, "user", "tie a"), (104, 0, "assistant", "é" * 70000)]
    return [(*r, "n", "p") for r in rows]


def test_chat_round_trip(frame):
    rows = chats()
    got = {r.conv_id: r for r in chat.formatted(frame(rows, CHATS).repartition(4)).collect()}
    whole = defaultdict(list)
    for c, t, role, text, *_ in rows:
        whole[c].append((t is not None, t or 0, role or "", text or ""))
    assert got.keys() == whole.keys()
    for c, turns in whole.items():
        turns.sort()
        heard = "".join(x for *_, r, x in turns if r == "assistant")
        want = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in turns).encode()).hexdigest(), len(heard), hashlib.sha256(heard.encode()).hexdigest())
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == want
    assert chat.formatted(frame([], CHATS)).count() == 0


def test_tree_is_depth_first_with_ancestors_in_reach(spark, frame):
    path = shared_path(spark, "test")
    chat.write_tree(frame(chats(), CHATS), path, parts=5)
    tokens = {bytes(r.node): r for r in spark.read.parquet(f"{path}/tokens").collect()}
    layout = {bytes(r.node): r for r in spark.read.parquet(f"{path}/layout").collect()}
    assert tokens.keys() == layout.keys()
    stream = sorted(layout, key=lambda n: layout[n].start)
    assert [bytes(tokens[n].path) for n in stream] == sorted(bytes(t.path) for t in tokens.values())
    for n, at in zip(stream, np.cumsum([0] + [layout[n].n_tokens for n in stream])):
        assert layout[n].start == at
        p = bytes(tokens[n].path)
        ancestors = [chat.node_of(p[:k]) for k in range(chat.STEP, len(p), chat.STEP)]
        reach = {i for a, b in layout[n].attends for i in range(a, b)}
        assert reach == {i for m in ancestors for i in range(layout[m].start, layout[m].start + layout[m].n_tokens)}
        assert layout[n].first_position == len(reach)


def test_filter_keeps_every_pair_and_scores_do_not_hang_on_its_bound(frame):
    draw = random.Random(9)
    docs = frame([(i, " ".join(f"w{draw.randrange(400)}" for _ in range(draw.randint(0, 300))), "r", 0.0) for i in range(300)] + [(999, None, None, None)], DOCS).repartition(3)
    scores = lambda **o: sorted((r.doc_id, round(r.score, 6)) for r in bloom_lm.scored(docs, remainder(F.col("doc_id"), 7) == 2, **o).collect())
    assert scores(max_bytes=1000) == scores() and len(scores(max_bytes=0)) == 301
