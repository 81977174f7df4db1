"""Resampling, spelling variants, page extraction and token ids against brute force on small hostile tables."""

import html
import itertools
import math
import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pytest

from textloom.llm import extraction, packing, resampling, spelling

DOCS = "doc_id long, text string, row long, word string, n long, rank int"


def docs(spark, rows):
    """Documents (id, text) with clashing extra columns."""
    return spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in rows], DOCS)


def low(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def brute_draw(rows, target, n, percent=10):
    def grams(t):
        w = words_of(t)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    s, t = np.zeros(10_000), np.zeros(10_000)
    for _, x in rows:
        for b in grams(x):
            s[b] += 1
    for x in target:
        for b in grams(x):
            t[b] += 1
    out = []
    for i, x in rows:
        g = grams(x)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (s.sum() + 10_000) / ((s[b] + 1) * (t.sum() + 10_000)))) for b in g)
        h = int(sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(x))])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], -1 if r[0] is None else r[0], -r[1]))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.fixture(scope="module")
def drawn_texts():
    rng = random.Random(4)
    vocabulary = ["alpha", "Beta", "gamma7", "δelta", "été", "x", "Ÿ", "word"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))) for _ in range(60)]
    long = " ".join(rng.choice(vocabulary) + rng.choice(["", ".", "\n"]) for _ in range(3000))
    return [*enumerate(texts), (7, texts[7]), (61, None), (62, ""), (None, texts[3]), (63, long), (64, "ü" * 5000), (65, "\x00 \x7f !")]


@pytest.mark.parametrize("n, size", [(1, 1 << 20), (1, 50), (3, 50), (2, 7)])
def test_draw_equals_brute_force(spark, drawn_texts, n, size):
    """Chunks of any size give the same counts and weights, whatever runs cross their borders."""
    target = ["alpha beta alpha", None, "été word " * 30]
    weights = resampling.weighted(docs(spark, drawn_texts), spark.createDataFrame([(t,) for t in target], "text string"), n, size=size)
    got = resampling.draw(weights, percent=25).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=repr) == brute_draw(drawn_texts, target, n, 25)


def test_draw_from_empty_tables(spark, drawn_texts):
    none = docs(spark, []).select("text")
    assert resampling.draw(resampling.weighted(docs(spark, []), none)).collect() == []
    got = resampling.draw(resampling.weighted(docs(spark, drawn_texts), none)).collect()
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got), key=repr) == brute_draw(drawn_texts, [], 1)
    some = resampling.resample(docs(spark, [(i, "alpha " * 30) for i in range(30)]), none)
    assert some.columns == DOCS.replace(",", "").split()[::2] and some.count() == 3


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_variants(rows):
    n = {}
    for i, t in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            w = low(run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] = n.get(w, 0) + 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    near = {w: [x for x in n if abs(len(x) - len(w)) <= 1 and distance(w, x) == 1] for w in n}
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 2 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


def test_variants_equal_brute_force(spark):
    """Few letters, so that words share beginnings, ends and doubled letters; chains of forms; letters of two bytes."""
    rng = random.Random(9)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randrange(5, 9))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "aaaab", "×÷×÷×", "Élève", "ÿÿÿÿÿÿ"]
    rows = []
    for i in range(40):
        text = [rng.choice(stems) for _ in range(60)] + ["aaaaa"] * (i % 3) + ["Aaaaab"]
        rows.append((i if i else None, rng.choice([" ", "-", "1"]).join(text)))
    rows += [(50, None), (51, ""), (3, rows[3][1]), (52, "longword" * 2000), (53, "longword" * 2000), (54, "longword" * 2000 + "x"), (55, "longword" * 2000), *((60 + i, "longword" * 2000 + "x") for i in range(9))]
    got = sorted(map(tuple, spelling.variants(spelling.vocabulary(docs(spark, rows))).select("word", "form", "root", "n", "n_near", "form_n").collect()))
    want = brute_variants([(i, t) for i, t in rows if t is None or len(t) < 5000])
    assert [r for r in got if len(r[0]) < 5000] == want and len(want) > 40
    long = {r[0]: r for r in got if len(r[0]) >= 5000}
    assert len(long) == 2 and long["longword" * 2000][1] == "longword" * 2000 + "x"


def test_variants_of_all_words_over_three_letters(spark):
    """Every pair one edit apart is found among all words of five and some of six letters."""
    words = ["".join(w) for w in itertools.product("abc", repeat=5)] + ["".join(w) for w in itertools.product("ab", repeat=6)]
    vocab = spark.createDataFrame([(w, 3 + zlib.crc32(w.encode()) % 50) for w in words], "word string, n long")
    got = {(r.word, r.other) for r in spelling.near(vocab).collect()}
    assert got == {(a, b) for a in words for b in words if abs(len(a) - len(b)) <= 1 and distance(a, b) == 1}


def test_runs_of_long_texts(monkeypatch):
    monkeypatch.setattr(spelling, "SLICE", 7)
    text = "Élève aaaaa bbbbbbbbbbbbbbbbbbbb,ccccc dddddĀeeeee fffff" * 3
    got = {}
    for part in spelling.runs(text.encode(), 5):
        for w, k in part.items():
            got[w.decode()] = got.get(w.decode(), 0) + k
    want = {}
    for w in re.findall(r"[a-zÀ-ÿ]{5,}", low(text)):
        want[w] = want.get(w, 0) + 1
    assert got == want


def test_variants_of_empty_tables(spark):
    assert spelling.variants(spelling.vocabulary(docs(spark, []))).collect() == []
    assert spelling.variants(spelling.vocabulary(docs(spark, [(1, "too few words here")]))).collect() == []


PAGES = {
    "article": ('<title>T</title><nav><ul><li><a href="/x">Home.</a></li></ul></nav><div class="ad">Buy this now.</div><article><h1>Head &amp; line</h1><p><b>Bold one<br><p>Two\n\n  words &lt;b&gt;.</p><p>End</article><footer>&copy; 2024 all of it.</footer>', "Head & line\nBold one\nTwo words <b>.\nEnd"),
    "main": ('<head><style>p{}</style><body><header><a href=a>Site name</a></header><div class="cookie-notice"><p>We use cookies to make this site better for you.</p></div><main><h1>Title</h1><p>Short.</p><p>Long text with some words in it and <a href=b>one link</a>.</p><form><label>Name</label><input><select><option>A</select></form><section id="comments"><h3>Comments</h3><p>A reader says something here.</p></section></main><aside><p>More of the same from elsewhere on this site.</p></aside>', "Title\nShort.\nLong text with some words in it and one link."),
    "neither": ('<div><a href=1>One</a> <a href=2>Two</a></div><h1>A title</h1><p>This is the first paragraph with quite a few words in it so that it is kept.</p><p>Brief.</p><p>This is the second paragraph, and it also has enough words to look like text.</p><ul><li><a href=x>Next</a></li></ul>', "A title\nThis is the first paragraph with quite a few words in it so that it is kept.\nBrief.\nThis is the second paragraph, and it also has enough words to look like text."),
    "script": ("<article><script>var t='</p><p>no</p>';</script><p>a<!-- <p>no</p> -->b</p><noscript>no</noscript><p>&#233;t&eacute; &nbsp; x</p></article>", "ab\nété x"),
    "empty": ("", ""), "null": (None, ""), "tags": ("<p><div></div><br>", ""), "open comment": ("<!-- all of it", ""),
}


def test_pages(spark):
    rows = [(i, None, h, "text", 5) for i, (h, _) in enumerate(PAGES.values())]
    rows += [(0, "u", PAGES["article"][0], None, None)]
    got = extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = list(PAGES.values())[r.page_id][1]
        assert (r.text, r.n_chars) == (want, len(want))
    assert extraction.extract(spark.createDataFrame([], "page_id long, html string")).collect() == []


@pytest.mark.parametrize("page", ['<a "' * 50_000, "<div>" * 20_000 + "x" + "</p>" * 20_000, "</b>" * 50_000, "<b>" * 20_000 + "</i>" * 20_000, "<p>x" * 20_000, "<!--" * 50_000, "<script>" * 50_000, "<li>" * 20_000, "x" * 3_000_000])
def test_hostile_pages_take_linear_time(page):
    import time

    start = time.time()
    extraction.main_text(page, extraction.trained())
    assert time.time() - start < 5


def test_pages_equal_a_plain_reading_of_articles(spark):
    """On the given pages the tree finds just the article: read plainly here, by cutting at its tags."""

    def plain(page):
        article = page[page.index("<article>") + 9 : page.index("</article>")]
        found = (" ".join(html.unescape(re.sub("<[^>]*>", " ", part.replace("<b>", ""))).split()) for part in re.split("</?(?:p|h1)>", article))
        return "\n".join(x for x in found if x)

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html").collect()
    got = {r.page_id: r.text for r in extraction.op13_html_blocks(spark, "/root/testdata/sf0.01").collect()}
    assert got == {r.page_id: plain(r.html) for r in pages}


def test_ids_of_random_texts_with_marks():
    """Words that compose with one case only, and any other text, get the tokenizer's own ids."""
    tok, rng = packing.Tokens(packing.default_tokenizer()), random.Random(11)
    marks = [chr(i) for i in range(0x300, 0x370)]

    def word():
        k = rng.random()
        if k < 0.4:
            return "".join(rng.choice("ABCDYJHTWXyjhtwabc") + (rng.choice(marks) if rng.random() < 0.4 else "") for _ in range(rng.randrange(1, 5)))
        if k < 0.7:
            return "".join(chr(rng.randrange(33, 0x2FFF)) for _ in range(rng.randrange(1, 5)))
        return "".join(chr(rng.choice([rng.randrange(33, 127), rng.randrange(0xE000, 0x1FFFF)])) for _ in range(rng.randrange(1, 6)))

    texts = ["".join(word() + rng.choice([" ", "  ", "\n", "\t", " ̈"]) for _ in range(rng.randrange(1, 12))) for _ in range(10_000)]
    texts += ["Y̊.", "XY̊X!", "J̌", "H̱", "T̈", "W̊", "Aͅ B"]
    for lo in range(0, len(texts), 500):
        some = texts[lo : lo + 500]
        for t, ids in zip(some, tok.ids([t.encode() for t in some])):
            assert np.frombuffer(ids, "<u4").tolist() == tok.tok.encode(t, add_special_tokens=False).ids, t
