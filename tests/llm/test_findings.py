"""Findings of the review of round 3."""

import random

import pytest

pytest.importorskip("xxhash")

from textloom.llm import ngram_join, spelling  # noqa: E402


def test_join_writes_no_prefixes_and_gathers_postings_once(spark, monkeypatch):
    """Prefixes are as large as the postings, so they must not lie on disk beside them; groups are read twice, made once."""
    rng = random.Random(2)
    base = [[rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(60)] for _ in range(4)]
    near = [[w if rng.random() > 0.03 else "new" for w in b] for b in base for _ in range(3)]
    rows = [(i, " ".join(t)) for i, t in enumerate([*base, *near])]
    written, plain = {}, ngram_join.save
    monkeypatch.setattr(ngram_join, "save", lambda df, label: written.setdefault(label, df) and plain(df, label))
    ngram_join.class_components(spark.createDataFrame(rows, "doc_id long, text string")).count()
    assert "groups" in written and not any("pre" in df.columns for df in written.values())


def test_memberships_without_partner_do_not_count(spark):
    """Classes 1 and 2 share enough tokens only if those count that they share with 3 and 4, which are too small for them."""
    met = [[1, 2]] * 20 + [[1, 3]] * 20 + [[2, 4]] * 20
    groups = ngram_join.save(spark.createDataFrame([(g, nodes, 1) for g, nodes in enumerate(met)], "gid long, nodes array<long>, times long"), "groups")
    sizes = spark.createDataFrame([(1, 280), (2, 280), (3, 40), (4, 40)], "node long, n int")
    assert ngram_join._open(groups.selectExpr("gid", "times", "explode(nodes) as node"), sizes, 75).count() == 40
    assert ngram_join._all_open(groups, sizes, 75).count() == 0


@pytest.mark.parametrize("name", ["issues_ranked", "issues_acknowledged"])
def test_issues_are_scored_once(spark, tmp_path, monkeypatch, name):
    """What reads the issues twice must not score the texts twice."""
    from textloom import catalog

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [(i, f"t{i} a@b.io def x():", "en", "s", 5) for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic long, quality long").write.parquet(f"{tmp_path}/labels.parquet")
    plain = catalog._issues
    monkeypatch.setattr(catalog, "_issues", lambda s, d: (i := plain(s, d)).mapInArrow(count, i.schema))
    expected = plain(spark, str(tmp_path)).count()
    assert catalog.QUERIES[name](spark, str(tmp_path)).collect() and seen.value == expected > 0


def test_words_are_not_broadcast(spark):
    """Spark estimates the keys by the words' file, of which each word makes up to 24 rows; below its limit it broadcast them."""
    words = [a + b + c for a in ("stone", "store", "stove") for b in "aeiou" for c in ("", "r", "rs")]
    vocab = spelling.save(spark.createDataFrame([(w, 3 + i) for i, w in enumerate(words)], "word string, n long"), "vocabulary")
    for df in (spelling.near(vocab), spelling.variants(vocab)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan and df.count() > 0


def test_latin_words_go_to_the_model(spark):
    """Words of Latin letters need no normaliser and no splitting; their ids are the tokenizer's, also where it is not asked."""
    import types

    import numpy as np

    from textloom.llm import packing

    tok = packing.Tokens(packing.default_tokenizer())
    letters = [c for c in map(chr, range(0x250)) if packing.LATIN.fullmatch(c.lower()) and packing.LATIN.fullmatch(c)]
    assert tok.direct and len(letters) > 350
    rng = random.Random(8)
    words = [*letters, *("".join(rng.choices(letters + list("etaoin" * 40), k=rng.randrange(1, 15))) for _ in range(3000))]
    texts = [" ".join(w + rng.choice(["", "", ",", "."]) for w in words[i : i + 50]) for i in range(0, len(words), 50)] + ["The the THE The, the. THE,", ""]
    whole, tok.tok = tok.tok, types.SimpleNamespace(model=tok.tok.model)
    assert [np.frombuffer(x, "<u4").tolist() for x in tok.ids([t.encode() for t in texts])] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_travel_packed(spark, monkeypatch):
    """A row for each word of each block took most of the disk and a third of the time; in parts, counts and scores are the same everywhere."""
    from textloom.llm import context_mixing

    rng = random.Random(6)
    words = ["".join(rng.choices("abcdé", k=rng.randrange(1, 6))) for _ in range(150)]
    rows = [(i, " ".join(rng.choices(words, k=40))) for i in range(40)] + [(40, ""), (41, None)]
    table, written, plain = spark.createDataFrame(rows, "doc_id long, text string"), {}, context_mixing.save
    columns = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score"]
    whole = sorted(context_mixing.scored(table).select(columns).collect())
    monkeypatch.setattr(context_mixing, "save", lambda df, label: written.setdefault(label, out := plain(df, label)) and out)
    monkeypatch.setattr(context_mixing, "discard", lambda *saved: None)
    monkeypatch.setattr(context_mixing, "PART_WORDS", 40)
    one = {r.doc_id: r for r in context_mixing.scored(table.repartition(1)).collect()}
    assert 1 < written["dealt"].count() < 12 and written["known"].count() == written["dealt"].count()
    again = {r.doc_id: r.score for r in context_mixing.scored(table.repartition(5)).collect()}
    assert sorted(tuple(one[i][c] for c in columns) for i in one) == [pytest.approx(tuple(r)) for r in whole]
    assert again == pytest.approx({i: r.score for i, r in one.items()})


def test_distinct_numbers():
    import numpy as np

    from textloom.llm import context_mixing

    rng = np.random.default_rng(6)
    for n, bits in ((0, 40), (1, 40), (1000, 8), (1000, 54), (1000, 55), (1000, 64)):
        h = rng.integers(0, 1 << bits, n, np.uint64, endpoint=False) if bits < 64 else rng.integers(0, (1 << 64) - 1, n, np.uint64, endpoint=True)
        for got, expected in zip(context_mixing._distinct(h, bits), np.unique(h, return_inverse=True)):
            assert got.tolist() == expected.tolist()
