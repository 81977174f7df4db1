"""The ten operators against brute force, exact round trips or held-out accuracy on small hostile tables."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from textloom.llm import chat, context_mixing, decontamination, fingerprint, ngram_join, packing, pii, quality, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, root long, label int"


def docs(spark, texts, ids=None):
    """Documents with clashing extra columns."""
    return spark.createDataFrame([(i, t, "en", None, None, 5, 1) for i, t in zip(ids or range(len(texts)), texts)], DOCS)


def sentence(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa la mu".split()) + str(rng.randrange(40)) for _ in range(n))


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    base = [sentence(rng, 80) for _ in range(6)]
    near = [" ".join("new" if rng.random() < 0.02 else w for w in b.split()) for b in base for _ in range(4)]
    return [*base, *near, base[0], base[0], None, "", "  ", "one two", "One two", "x " * 3000, base[1] + " " + base[2]]


def test_join_equals_brute_force(spark, texts):
    s = [shingles(t) for t in texts]
    comp = list(range(len(s)))
    for i, j in itertools.combinations(range(len(s)), 2):
        if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]):
            a, b = sorted((comp[i], comp[j]))
            comp = [a if c == b else c for c in comp]
    for cell in (50_000, 3):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.class_components(docs(spark, texts), cell=cell).collect()}
        assert got == {i: (len(x), comp[i]) for i, x in enumerate(s)}


def brute_components(s):
    comp = list(range(len(s)))
    for i, j in itertools.combinations(range(len(s)), 2):
        if s[i] and s[j] and comp[i] != comp[j] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]):
            a, b = sorted((comp[i], comp[j]))
            comp = [a if c == b else c for c in comp]
    return comp


@pytest.mark.parametrize("block", [500_000, 900])
def test_join_of_a_large_family_equals_brute_force(spark, monkeypatch, block):
    """Near copies of one text, many not similar to it but to each other, and chains of edits, over one or many cells."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "MEETINGS", block // 3)
    monkeypatch.setattr(ngram_join, "FAMILY", 7)
    rng = random.Random(5)
    base, chain, far = sentence(rng, 60).split(), [], []
    for _ in range(40):
        chain.append(" ".join(base))
        k = rng.randrange(0, 56)
        base[k : k + 2] = sentence(rng, 2).split()
    for _ in range(25):
        words = chain[0].split()
        for _ in range(4):
            words[rng.randrange(60)] = rng.choice(["new", "other", "third"])
        far += [" ".join(words), " ".join([*words, "tail"]), " ".join(words[: rng.randrange(45, 60)])]
    all_texts = [*chain, *far, *(sentence(rng, 30) + " " + chain[0] for _ in range(10))]
    rng.shuffle(all_texts)
    s = [shingles(t) for t in all_texts]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.class_components(docs(spark, all_texts)).collect()}
    assert got == {i: (len(x), c) for i, (x, c) in enumerate(zip(s, brute_components(s)))}


def test_join_of_a_repeated_id(spark):
    """Rows of one id with different texts are judged each by its own text."""
    rng = random.Random(3)
    a, b = sentence(rng, 40), sentence(rng, 40)
    rows = ngram_join.class_components(docs(spark, [a, b, b + " end", a, None, None], [7, 7, 9, 3, 7, 7])).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(3, 3), (7, 3), (7, 7), (7, 7), (7, 7), (9, 7)]
    assert len({r.text_key for r in rows if r.doc_id == 7}) == 3


def test_join_of_nothing(spark):
    assert ngram_join.class_components(docs(spark, [])).count() == 0


def test_fingerprints(spark, texts):
    got = {r.doc_id: r for r in fingerprint.edited_fingerprints(docs(spark, texts), rows=3).collect()}
    order = sorted(range(len(texts)), reverse=True)
    for k, i in enumerate(order):
        t, nxt = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        edit = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert got[i].edited_sha256 == hashlib.sha256(edit.encode()).hexdigest() and got[i].n_chars == len(t)
        a, b = shingles(t), shingles(edit)
        assert abs(got[i].near_edited - (len(a & b) / len(a | b) if a | b else 1.0)) < 0.15
    assert got[0].fingerprint == got[len(texts) - 9].fingerprint
    assert fingerprint.edited_fingerprints(docs(spark, [])).count() == 0
    assert fingerprint.edited_fingerprints(docs(spark, ["a b"])).first().near_next == 1.0


def test_pii(spark):
    texts = ["a.b@c.d.e x 10.0.0.256 1.2.3.4", "card 4111 1111 1111 1111 +1 (555) 010-2030", None, "", "é@x.y +1+1+1 " + "1" * 30_000, "a@b.c_d@e.f"]
    got = {r.doc_id: [tuple(x) for x in r.base] for r in pii.found(docs(spark, texts)).collect()}
    assert got[0] == [(0, 0, 9), (23, 1, 30)] and got[1] == [(5, 2, 24), (25, 3, 42)] and got[2] == got[3] == got[4] == []
    assert got[5] == [(0, 0, 5), (5, 0, 11)]
    red = {r.doc_id: r.text for r in pii.redacted(docs(spark, texts)).collect()}
    assert red[0] == "[EMAIL] x 10.0.0.256 [IP]" and red[2] is None
    assert pii.found(docs(spark, [])).count() == 0


def test_pii_base_equals_plain_python(spark):
    rng = random.Random(4)
    parts = ["a.b@c.de", "x@y", "@", "10.1.2.3", "300.1.2.3", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-2030", "+12", "+1+2", "12 34", " ", ",", "word", "\u00e9", "0", "-", "."]
    many = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(12))) for _ in range(300)]

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    def plain(t):
        out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = re.sub("[^0-9]", "", m[0])
            out += [(m.start(), 2, m.end())] * (12 <= len(d) <= 19 and luhn(d))
        for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
            out += [(m.start(), 3, m.end())] * (9 <= len(re.sub("[^0-9]", "", m[0])) <= 15)
        return sorted(out)

    got = {r.doc_id: [tuple(x) for x in r.base] for r in pii.found(docs(spark, many)).collect()}
    assert got == {i: plain(t) for i, t in enumerate(many)}


def test_pii_learned_spans_and_clashing_columns(spark):
    rng = random.Random(6)
    say = lambda: sentence(rng, 6)
    many = [f"{say()} {rng.choice(['ann', 'bob.lee'])}{i}@mail{i}.org {say()}" for i in range(60)] + [f"{say()} +1 555 {i + 100} {2000 + i} {say()}" for i in range(60)] + [f"{say()} order 20{i % 90 + 10}-1{i % 3}-{i % 18 + 10} {say()}" for i in range(60)]
    loose = ["jane.roe (at) mail (dot) org", "bob [at] corp [dot] net", "john dot smith at example dot com", "tel 555-010-2030", "phone: (555) 010-2030", "joe @ mail.org"]
    clean = ["met at noon. Then left", "in 2010-11-12 and 1999", "at home. dot", "item 12-34 5"]
    n = len(many)
    got = {r.doc_id: r for r in pii.found(docs(spark, [*many, *(f"{say()} {x} {say()}" for x in [*loose, *clean])])).collect()}
    assert [len(got[n + i].spans) for i in range(len(loose))] == [1] * len(loose)
    assert [len(got[n + len(loose) + i].spans) for i in range(len(clean))] == [0] * len(clean)
    assert all(set(r.base) <= set(r.spans) for r in got.values())
    odd = spark.createDataFrame([(1, "x a@b.co", 5, "keep", "own", 7)], "doc_id long, text string, base long, spans string, own string, _t long")
    assert [tuple(r) for r in pii.redacted(odd).collect()] == [(1, "x [EMAIL]", 5, "keep", "own", 7)]


def test_urls(spark):
    urls = ["http://A.com/en/1", "http://www.example.com/en/7?x", "x://net/de/9", None, "nothing", "http://example.org/es/#a", "http://bad.io/1"]
    pages = spark.createDataFrame([*enumerate(urls), *((i, "http://bad.io/2") for i in range(10, 40))], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0, 0) for i in range(10, 40)] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(pages, labels).collect()}
    assert got[0] == ("a.com", "/en/1", "com/en/", "block") and got[1][2:] == ("example.com/en/7", "allow") and got[2][2:] == ("net/de/", "allow")
    assert got[3][:3] == got[4][:3] == ("", "", None) and got[5][2:] == ("org/es/", "block") and got[6][2:] == (None, "block")


def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "\\b\\\\<a>[x]\\", None, "", "z" * 9000, "</turn><window>"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(["system", "user", "assistant", "a b<>", None, "assistant"], hard))]
    turns = spark.createDataFrame([*rows, (2, None, "user", "x"), (2, None, "user", "x")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(turns)).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r or "", t or "") for _, _, r, t in rows]
    assert [t.loss for t in got[1].turns] == [r == "assistant" for _, _, r, _ in rows] and len(got[2].turns) == 2


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    rows = packing.pack(docs(spark, [*texts, "é, ñ. a<|endoftext|>b it's 12.5"]), part=7).collect()
    for i, t in enumerate([*texts, "é, ñ. a<|endoftext|>b it's 12.5"]):
        ids, at = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4"), 0
        for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for _, run in itertools.groupby(sorted((r.sequence_id, r.offset, r.length) for r in rows), key=lambda x: x[0]):
        at = 0
        for _, offset, n in run:
            assert offset == at
            at += n
        assert at <= 2048


def test_packing_of_letters_in_several_pieces():
    tok = packing.Tokens(packing.default_tokenizer())
    for odd in ("\u0130stanbul", "\u095c", "\ufb2a,"):
        words = ["hello", odd, "river", "stone.", "\u00e9t\u00e9"]
        got = tok.ids([" ".join(words).encode(), *(w.encode() for w in words)])
        for t, ids in zip([" ".join(words), *words], got):
            assert np.frombuffer(ids, "<u4").tolist() == tok.tok.encode(t, add_special_tokens=False).ids, t
        tok.known, tok.old = {}, {}


def test_cutting_stock_holds_demand():
    sizes, demand = np.array([3, 5, 7]), np.array([11, 8, 5])
    plan = packing.cutting_stock(sizes, demand, 16)
    assert (sum(p * k for p, k in plan) == demand).all() and all((p * sizes).sum() <= 16 for p, _ in plan)


def test_decontamination(spark):
    rng = random.Random(3)
    item = sentence(rng, 30)
    edited = item[:40] + "#" + item[41:90] + item[91:]
    texts = [sentence(rng, 50) + " " + item.upper() + " tail", "pre " + edited, sentence(rng, 200), None, "", "abc tiny"]
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "tiny")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(docs(spark, texts), bench).collect()}
    assert set(got) == {(0, 7), (1, 7), (5, 10)} and got[0, 7].edits == 0 and got[1, 7].edits == 2
    assert (got[1, 7].start, got[1, 7].end) == (4, 4 + len(edited))
    assert {r.doc_id for r in decontamination.clean(docs(spark, texts), bench).collect()} == {2, 3, 4}


def test_decontamination_of_repetitive_text(spark):
    bench = spark.createDataFrame([(1, "-" * 400), (2, "ab" * 300)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontamination.contaminated(docs(spark, ["-" * 6000, "x" * 50 + "ab" * 300 + "y", "-" * 300]), bench).collect()}
    assert got == {(0, 1): 0, (1, 2): 0}


def labelled(spark, n=300):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        bad, low = i % 5 == 0, i % 7 == 0
        t = sentence(rng, 60) + (" scum loser." if bad else "")
        rows.append(re.sub(" ", " | ", t) if low else t)
        if i < 200:
            labels.append((i, int(not low), int(bad)))
    return docs(spark, [*rows, None, ""]), spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity_and_quality_on_held_out(spark):
    d, labels = labelled(spark)
    got = {r.doc_id: r for r in toxicity.score(d, *toxicity.fit(d, labels)).collect()}
    right = sum(got[i].rejected == (i % 5 == 0) for i in range(200, 300))
    assert right >= 95 and not got[300].rejected, right
    assert toxicity.accepted(d, labels).columns == d.columns
    kept = {r.doc_id: r.keep for r in quality.score(d, quality.fit(d, labels)).collect()}
    assert sum(kept[i] == (i % 7 != 0) for i in range(200, 300)) >= 95
    assert quality.score(d, quality.fit(d, labels.limit(0))).count() == 302


def test_context_mixing(spark):
    rng = random.Random(9)
    texts = [sentence(rng, 60) for _ in range(60)] + [None, ""]
    got = {r.doc_id: r for r in context_mixing.scored(docs(spark, texts)).collect()}
    train = [i for i in range(62) if zlib.crc32(str(i).encode()) % 7 != 2]
    assert got[0].train_tokens == sum(len((texts[i] or "").split()) + 1 for i in train)
    held = [i for i in range(60) if i not in train]
    assert all(got[i].held_out == (i not in train) for i in range(62))
    assert sum(got[i].score for i in held) > 1.05 * sum(got[i].base_score for i in held)
    assert context_mixing.scored(docs(spark, [])).count() == 0


def test_context_mixing_equals_brute_force_counts(spark, texts):
    """Counts and base score against plain counting; no score depends on how rows are dealt; held-out text scores better than the base."""
    import math
    from collections import Counter

    rng = random.Random(9)
    many = [*texts, *(sentence(rng, 60) for _ in range(60))]
    table = docs(spark, many)
    got = {r.doc_id: r for r in context_mixing.scored(table).collect()}
    words = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), None] for t in many]
    count = Counter(w for i, ws in enumerate(words) if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(count.values()), len(count)
    for i, ws in enumerate(words):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 7 == 2, len(ws), sum(w in count for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws))
    again = {r.doc_id: r.score for r in context_mixing.scored(table.repartition(7)).collect()}
    assert again == pytest.approx({i: r.score for i, r in got.items()}, abs=1e-4)
    held = [r for i, r in got.items() if r.held_out and len(many[i] or "") > 200]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_context_mixing_uses_the_order_of_words(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(60):
        at = rng.randrange(40)
        texts.append(" ".join(f"word{(at * 7**k) % 41}" for k in range(60)))
    other = texts[3].split()
    rng.shuffle(other)
    ids = [*range(60), next(i for i in range(1000, 2000) if context_mixing.held_out(i))]
    got = {r.doc_id: r for r in context_mixing.scored(docs(spark, [*texts, " ".join(other)], ids)).collect()}
    held = [i for i in range(60) if context_mixing.held_out(i)]
    assert sum(got[i].score for i in held) > 0.5 * sum(got[i].base_score for i in held)
    assert got[ids[-1]].score < 2 * got[3].score


def test_pipeline(spark, tmp_path):
    """Planted toxic texts, copies, benchmark passages and personal data against what must be left, piece by piece."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng = random.Random(11)
    d, labels = labelled(spark)
    rows = [r.text for r in d.collect()[:300]]
    item = sentence(rng, 40)
    clean = [sentence(rng, 60) for _ in range(5)]
    extra = [*clean, clean[0], clean[1] + " more", "see " + item + " end", sentence(rng, 50) + " scum loser", "mail me at a.b@c.org now " + sentence(rng, 20), None]
    for name, df in (("documents", docs(spark, [*rows, *extra])), ("labels", labels), ("benchmark", spark.createDataFrame([(1, item)], "item_id long, text string"))):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = {i for i in range(300) if i % 5} | {300, 301, 302, 303, 304, 309, 310}
    assert {r.doc_id for r in got} == want
    tok = Tokenizer.from_file(packing.default_tokenizer())
    text = re.sub("a.b@c.org", "[EMAIL]", extra[9])
    ids = np.array(tok.encode(text, add_special_tokens=False).ids + [1], "<u4")
    assert [(r.doc_tokens, r.ids_crc32) for r in got if r.doc_id == 309] == [(len(ids), zlib.crc32(ids.tobytes()))]
    empty = tmp_path / "empty"
    docs(spark, []).write.parquet(str(empty / "documents.parquet"))
    labels.limit(0).write.parquet(str(empty / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(empty / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
