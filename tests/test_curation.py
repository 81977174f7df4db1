import pytest
from pyspark.sql import functions as F

from textloom.functions import normalize as N
from textloom.functions import text as T
from textloom.operators import compose, contamination, dedup, items, quality, records, review, rewrite, store, versions
from textloom.plans import verdicts
from textloom.sources import readers, sinks

ITEM = "id long, dataset_id string, text string, content_hash string, char_count long, tokens long, language string, decision string"


def rows(spark, texts, dataset="a", decision="keep"):
    docs = spark.createDataFrame([(i, t, "en", dataset) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    return items.from_documents(docs).withColumn("decision", F.lit(decision))


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text"))).first()[0]


def test_text_scores(spark):
    assert one(spark, "a b c d e a b c d e", T.repetition) == pytest.approx(1 - 5 / 6)
    assert one(spark, "", T.spam) == 0 and one(spark, "!!!!", T.spam) == 1
    assert one(spark, "def f():\nhello", T.code_ratio) == 0.5
    assert one(spark, "the cat is in", T.language) == "en"
    assert one(spark, "a\r\nb\n", lambda c: F.size(T.lines(c))) == 2 and one(spark, "", lambda c: F.size(T.lines(c))) == 0
    assert one(spark, "mail x@y.org now", lambda c: T.redact(c)[0]) == "mail [REDACTED] now"


def test_normalize(spark):
    got = one(spark, "<b>Hi</b>&nbsp;x\r\n\r\n\r\n\r\nclick here now\nsame\nsame\nsame", N.normalize)
    assert got["text"] == "Hi x\n\nsame" and got["html"] and got["whitespace"] and got["boilerplate"]
    assert one(spark, got["text"], N.normalize)["text"] == got["text"]


def test_normalize_hostile(spark):
    hard = {
        "edit\n[Edit]\n Cookie x\nhttp://a b\nhttp://a http://b \n|---|:--|\n- - -\n***\n1. 2) \n1. 2. 3. 4.\n-- x\n": "http://a b\n1. 2. 3. 4.\n-- x",
        "\ufeffa\x1c\x1d b  \n\n\n\nc d\x85  \n  ": "a b\n\nc d",
        "\u00c5ngstr\ufb01 \x07&amp;&lt;p&gt;y": "\u00c5ngstrfi & y",
        "- " * 5000: "",
        "http://x " * 3000: "",
        "   ": "",
    }
    got = spark.createDataFrame([(t,) for t in hard], "text string").select("text", N.normalize(F.col("text")).alias("n")).collect()
    assert {r.text: r.n.text for r in got} == hard
    assert one(spark, None, N.normalize)["text"] == ""
    p = one(spark, "\U0001f600 mail x@y.org 555-123-4567 password: z", N.privacy)
    assert (p.pii, p.types, p.evidence) == (True, ["email", "phone", "secret"], "email@7, phone@15, secret@28")


def test_signature_equals_plain_python(spark):
    import hashlib

    def plain(t):
        t = (t or "").replace("\n", " ").replace("\t", " ")
        hs = [int.from_bytes(hashlib.sha256(t[k : k + 5].encode()).digest()[4:8], "big") for k in range(len(t) - 4)]
        return [min((((7919 * i + 31) * h + 6271 * i + 17) % 2**32 for h in hs)) for i in range(128)] if hs else []

    texts = ["hello\tworld again", "na\u00efve caf\u00e9 \U0001f600 x", "abcd", None, "", "ab" * 700, "hello world\nagain"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r.s for r in df.select(dedup.signature(F.col("text")).alias("s")).collect()] == [plain(t) for t in texts]


def test_text_spans_and_repetition(spark):
    spans = one(spark, "\u00e9 one two one three", lambda c: T.evidence_spans(c, F.array(*map(F.lit, ("one two", "two one", "three", "abc", "nowhere")))))
    assert [(s.st, s.en) for s in spans] == [(2, 9), (14, 19)]
    r = one(spark, "a b c d e a b c d e", T.repetition_stats)
    assert (r.repetition_score, r.unique_grams, r.total_grams) == (0.167, 5, 6)
    assert one(spark, "a b", T.repetition_stats).total_grams == 0


def test_rewrite_jobs(spark):
    df = rows(spark, ["plain text here", "<i>x</i>  y", "mail a@b.org now", None])
    done = {r.id: r for r in rewrite.normalized(df).collect()}
    assert done[1].text == "x y" and done[1].changed and done[1].char_count == 3 and not done[0].changed
    c = rewrite.counters(rewrite.normalized(df)).first()
    assert (c["items"], c.changed_items, c.html, c.boilerplate) == (4, 1, 1, 0)
    red = {r.id: (r.text, r.substitutions) for r in rewrite.redacted(df).collect()}
    assert red[2] == ("mail [REDACTED] now", 1) and red[0][1] == 0 and len(red) == 4


def test_review_errors_and_captions(spark):
    labels = spark.createDataFrame([("a", 1, "x", "approved", None)], "id string, doc_id long, category string, status string, superseded_at timestamp")
    with pytest.raises(Exception, match="empty"):
        review.rename_labels(labels, spark.createDataFrame([("a", "  ")], "id string, category string")).collect()
    with pytest.raises(Exception, match="approved"):
        review.review_labels(labels, spark.createDataFrame([("a", "odd", None, None)], "id string, status string, reviewer string, comment string"))[0].collect()
    caps = spark.createDataFrame([("c", 1, "old", "approved", None)], "id string, text_id long, text string, status string, superseded_at timestamp")
    got = {r.id: r for r in review.set_captions(caps, spark.createDataFrame([("d", 1, "new")], "id string, text_id long, text string"), F.current_timestamp()).collect()}
    assert got["c"].superseded_at and got["d"].status == "pending"


def test_store(spark):
    log = spark.createDataFrame([("a", "x", 1, False), ("a", "y", 2, False), ("b", "z", 1, False), ("b", "z", 3, True)], "id string, name string, updated_at long, deleted boolean")
    assert [(r.id, r.name) for r in store.current(log).collect()] == [("a", "y")]
    sets = spark.createDataFrame([("a", "n", "permissive")], "id string, name string, license_policy string")
    assert store.patched(sets, spark.createDataFrame([("a", None, "strict")], sets.schema)).first().license_policy == "strict"
    with pytest.raises(Exception, match="license_policy"):
        store.patched(sets, spark.createDataFrame([("a", None, "odd")], sets.schema)).collect()
    some = spark.createDataFrame([("p", "c")], "prompt string, completion string")
    first = store.append(some.select(F.lit("old").alias("id"), "prompt", "completion", F.lit("pending").alias("status")).limit(0), some, "sft")
    assert store.append(first, some, "sft").count() == 1


def test_verdicts(spark):
    assert one(spark, 'so: {"a": 1}\n.', lambda c: verdicts.parsed_answer(c, "a int")).a == 1 and one(spark, "none", lambda c: verdicts.parsed_answer(c, "a int")) is None
    assert one(spark, " cat ", lambda c: verdicts.captioned(c, "a {caption}", "x", "z", "-")) == "x-a cat-z"
    with pytest.raises(ValueError, match="caption"):
        verdicts.captioned(F.lit("x"), "no place")
    answers = spark.createDataFrame([(1, "some text", [(0, 4, "w", 0.9), (5, 99, "w", 0.9)])], "text_id long, text string, spans array<struct<start:int,end:int,category:string,confidence:double>>")
    fresh = verdicts.span_labels(answers, "m")
    assert [r.value for r in fresh.collect()] == ["some"]
    old = fresh.withColumn("superseded_at", F.lit(None).cast("timestamp")).withColumn("id", F.lit("old"))
    both = {r.id: r.superseded_at for r in verdicts.annotated(old, fresh, "m", F.current_timestamp()).collect()}
    assert both.pop("old") and list(both.values()) == [None]
    labels, audit = verdicts.automated(fresh, 0.5)
    assert labels.first().status == "approved" and audit.count() == 1 and verdicts.automated(fresh, 0.5, preview=True)[1].count() == 0
    issues = spark.createDataFrame([(1, "possible_pii", "open", "d"), (1, "spam", "open", None)], "text_id long, issue_type string, status string, detector string")
    new = spark.createDataFrame([(2, True, ["email"], "email@1"), (3, False, [], "")], "text_id long, pii boolean, types array<string>, evidence string")
    assert {(r.text_id, r.issue_type) for r in verdicts.pii_issues(issues, new, "d").collect()} == {(1, "spam"), (2, "possible_pii")}
    probs = [(i, 0, [0.9, 0.1]) for i in range(5)] + [(i, 1, [0.1, 0.9]) for i in range(5, 10)] + [(10, 0, [0.05, 0.95])]
    assert [(r.id, r.likely) for r in verdicts.suspect_labels(spark.createDataFrame(probs, "id long, label int, probabilities array<double>")).collect()] == [(10, 1)]
    verdicts.manifest('{"command": ["./run.py"], "capabilities": ["x"]}', {"run.py"})
    for bad in ("[", '{"command": ["../x"]}', '{"command": ["./../x"]}', '{"command": ["./run.py"], "permissions": ["all"]}'):
        with pytest.raises(ValueError):
            verdicts.manifest(bad, {"run.py"})


def test_quality_and_filters(spark):
    df = rows(spark, ["short", "x" * 50, None])
    got = {(r.text_id, r.issue_type) for r in quality.issues(df).collect()}
    assert got == {(0, "too_short"), (2, "too_short")}
    assert items.filtered(df, quality.issues(df), issue="too_short").count() == 2
    assert items.page(df, 1, 1).count() == 1


def test_exact_and_near_duplicates(spark):
    base = " ".join(f"word{i}" for i in range(60))
    df = rows(spark, [base, base, base + " end", "something else entirely different", None])
    exact = {r.text_id: r.is_canonical for r in dedup.exact_members(df).collect()}
    assert exact == {0: True, 1: False}
    near = {r.text_id: r.group_id for r in dedup.near_members(df).collect()}
    assert near == {0: 0, 1: 0, 2: 0}
    sig = df.select(dedup.signature(F.col("text")).alias("s")).collect()
    assert len(sig[0].s) == 128 and sig[4].s == []


def test_near_pairs_compare_all_of_a_bucket(spark, monkeypatch):
    """1 and 2 are near each other but not near 0, the smallest id of the only bucket that they share."""
    import numpy as np

    sig = np.arange(4 * 128).reshape(4, 128)
    sig[1:3, :8] = sig[0, :8]
    sig[2, 9:] = sig[1, 9:]
    sig[2, 8::8] += 1000
    monkeypatch.setattr(dedup, "signature", lambda text: F.array(*(F.element_at(F.array(*(F.lit(int(sig[i, k])).cast("long") for i in range(4))), text.cast("int")) for k in range(128))))
    df = rows(spark, ["1", "2", "3", "4"])
    for cell in (1000, 1):
        monkeypatch.setattr(dedup, "CELL", cell, raising=False)
        assert [tuple(r) for r in dedup.near_pairs(df).collect()] == [(1, 2, 0.882813)]
        assert {r.text_id: r.group_id for r in dedup.near_members(df).collect()} == {1: 1, 2: 1}


def test_contamination(spark):
    bench = spark.createDataFrame([(1, "One two three four five six seven")], "item_id long, text string")
    df = rows(spark, ["one two three four five six seven", "nothing of that sort is in here at all"])
    assert [r.text_id for r in contamination.issues(df, bench, n=5, threshold=0.2).collect()] == [0]
    with pytest.raises(ValueError, match="benchmark"):
        contamination.issues(df, bench.limit(0))


def test_compose(spark):
    df = rows(spark, [f"text {i}" for i in range(10)]).union(rows(spark, [f"other {i}" for i in range(10)], "b").withColumn("id", F.col("id") + 100))
    assert sorted(r.dataset_id for r in compose.mix(df, {"a": 3, "b": 1}, size=8).collect()) == ["a"] * 6 + ["b"] * 2
    first = {r.id for r in compose.sample_random(df, 5, 42).collect()}
    assert first == {r.id for r in compose.sample_random(df, 5, 42).collect()} and len(first) == 5
    assert compose.split(df, [8, 1, 1]).count() == 20
    assert compose.merge(df.union(df), ["b", "a"]).select("content_hash").distinct().count() == 20


def test_sample_diverse_sees_all(spark):
    import numpy as np

    sig = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.pmod(F.xxhash64(F.col("id"), k), 2 + F.col("id") % 40))
    ids = spark.range(20_500)
    last = ids.orderBy(F.desc(F.xxhash64("id")), F.desc("id")).first().id
    table = ids.select("id", F.when(F.col("id") == last, 9).otherwise(F.col("id") % 9).alias("tokens"), sig.alias("sig"), F.xxhash64("id").alias("h"))
    all_ = table.orderBy("h", "id").collect()
    sigs, far, want = np.array([r.sig for r in all_]), np.full(len(all_), np.inf), []
    at = next(i for i, r in enumerate(all_) if r.id == last)
    for _ in range(12):
        want.append(all_[at].id)
        far = np.minimum(far, 1 - (sigs == sigs[at]).mean(axis=1))
        far[[i for i, r in enumerate(all_) if r.id in want]] = -1
        at = int(np.argmax(far))
    got = compose.sample_diverse(table.select("id", "tokens", "sig"), 12)
    assert [r.id for r in got.orderBy("place").collect()] == want


def test_versions(spark):
    df = rows(spark, ["one", "two"])
    snap = versions.snapshot(df)
    assert versions.checksum(snap).first().item_count == 2
    changed = snap.where("id = 0").withColumn("content_hash", F.lit("x")).unionByName(snap.where("id = 0").withColumn("id", F.lit(9).cast("long")))
    assert {(r.id, r.change) for r in versions.diff(snap, changed).collect()} == {(0, "modified"), (1, "removed"), (9, "added")}
    assert {r.id: r.decision for r in items.restore(df, df.where("id = 1")).collect()} == {0: "quarantine", 1: "keep"}


def test_records(spark):
    lines = [
        '{"messages": [{"role": "human", "content": "hi"}, {"role": "bot", "content": "yes"}]}',
        '{"instruction": "do", "input": "x", "output": "y"}',
        '{"prompt": "p", "chosen": "a", "rejected": "b"}',
        '{"prompt": "p", "completion": "c"}',
        '{"trajectory": [1], "success": true}',
        '{"prompt": "p", "completion": "c"}',
        '{"completion": "c", "prompt": "p"}',
        "not json",
        "",
        "\t",
    ]
    got = records.structured(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert {k: v.count() for k, v in got.items()} == {"conversations": 2, "preferences": 1, "sft": 1, "traces": 1}
    assert ["user", "assistant"] in [[m.role for m in r.messages] for r in got["conversations"].collect()]
    pair = items.prefer(got["preferences"], F.lit("b")).first()
    assert (pair.chosen, pair.rejected, pair.status) == ("b", "a", "approved")


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("hello\n\nworld\n")
    (tmp_path / "in/b.jsonl").write_text('{"content": " x "}\nbroken\n')
    (tmp_path / "in/odd.txt").write_bytes(b"a\0b")
    whole = readers.whole_files(spark, str(tmp_path / "in"))
    assert {r.relative_path: r.ingest_status for r in whole.collect()} == {"a.txt": "done", "b.jsonl": "done", "odd.txt": "error"}
    registered = spark.createDataFrame(readers.items(whole, "d").toPandas())
    (tmp_path / "in/odd.txt").write_text("late")
    again = {r.relative_path: (r.text, r.ingest_status) for r in readers.retried(spark, str(tmp_path / "in"), registered).collect()}
    assert again["odd.txt"] == ("late", "done") and again["a.txt"][1] == "done"
    (tmp_path / "in/odd.txt").unlink()
    lines = readers.numbered(readers.line_rows(spark, str(tmp_path / "in/a.txt")), F.col("value"))
    assert {(r.row, r.relative_path, r.text) for r in lines.collect()} == {(0, "a_0", "hello"), (1, "a_1", "world")}
    (tmp_path / "in/c.jsonl").write_text('\n{"messages": []}\n')
    assert {r.source_uri[-7:]: r.form for r in readers.sniffed(spark, str(tmp_path / "in")).collect()} == {"n/a.txt": "text", "b.jsonl": "text", "c.jsonl": "training"}
    (tmp_path / "d.csv").write_text("a;b\n1,5;2\n3,5;4\n")
    assert readers.delimited(spark, str(tmp_path / "d.csv")).columns == ["a", "b"]
    info = sinks.dataset_folder({"text": versions.manifest(rows(spark, ["one"])), "sft": spark.range(3)}, str(tmp_path / "folder"), "n")
    assert info["configs"]["sft"]["num_examples"] == 3 and (tmp_path / "folder/README.md").exists()
    got = readers.items(readers.text_lines(spark, str(tmp_path / "in/a.txt")), "d")
    assert {r.text for r in got.collect()} == {"hello", "world"}
    assert [r[0] for r in readers.json_lines(spark, str(tmp_path / "in/b.jsonl")).select(readers.text_field(F.col("value"))).collect()] == ["x"]
    sinks.write(versions.manifest(rows(spark, ["one"])), str(tmp_path / "out"), "jsonl")
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_stream(spark, tmp_path):
    from textloom.streaming.ingest import stream_lines

    (tmp_path / "in").mkdir()
    for name in ("1.txt", "2.txt"):
        (tmp_path / "in" / name).write_text("same\n" + name + "\n")
        q = stream_lines(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination(60)
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1.txt", "2.txt", "same"]
