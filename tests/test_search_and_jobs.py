"""Vector search, embedding job, stored versions, export ledger, plugins, label issues and review of pairs."""

import random
import sys
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import compose, dedup, quality, stored_versions, vector_index, vectors, versions
from textloom.plans import embeddings, plugin, verdicts
from textloom.plans.jobs import Providers, hash_embedding
from textloom.sources import readers
from textloom.sources.ledger import Ledger


def vector_rows(spark, n=1500, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    around = rng.normal(size=(12, dim)) * 2
    points = around[rng.integers(0, 12, n)] + rng.normal(size=(n, dim))
    points[100:200] = points[100]
    return spark.createDataFrame([(i, p.astype(np.float32).tolist(), "a" if i % 3 else "b") for i, p in enumerate(points)], "id long, vector array<float>, kind string").repartition(5), points.astype(np.float32).astype(float)


def brute_nearest(points, q, k, ids=None):
    ids = range(len(points)) if ids is None else ids
    unit = points / (np.linalg.norm(points, axis=1, keepdims=True) + 1e-9)
    scores = np.round(unit @ unit[q], 6)
    return sorted(ids, key=lambda i: (-scores[i], i))[:k]


@pytest.mark.parametrize("block", [8192, 64])
def test_exact_search_equals_brute_force(spark, monkeypatch, block):
    """Over one block of rows or a grid of many; a hundred equal vectors tie and go by id."""
    monkeypatch.setattr(vector_index, "ROWS", block)
    rows, points = vector_rows(spark, 700)
    asked = vector_index.of_items(rows, rows.where("id % 20 = 0"))
    got = {}
    for r in vector_index.exact(rows, asked, 7).collect():
        got.setdefault(r.query_id, []).append((-r.score, r.id))
    assert {q: [i for _, i in sorted(x)] for q, x in got.items()} == {q: brute_nearest(points, q, 7) for q in range(0, 700, 20)}
    left = vector_index.joined(rows, rows.where("kind = 'b'"))
    some = [r.id for r in vector_index.exact(left, asked.where("query_id = 40"), 5).orderBy(F.desc("score"), "id").collect()]
    assert some == brute_nearest(points, 40, 5, range(0, 700, 3))
    assert some == [r.id for r in vectors.top_k(left, points[40].tolist(), 5).collect()]


def test_exact_search_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, None), (5, [-1.0, 0.0])], "id long, vector array<float>")
    asked = rows.select(F.col("id").alias("query_id"), "vector")
    got = {(r.query_id, r.id): r.score for r in vector_index.exact(rows, asked, 10).collect()}
    assert got == {(1, 1): 1.0, (1, 2): 0.0, (1, 5): -1.0, (2, 1): 0.0, (2, 2): 0.0, (2, 5): 0.0, (3, 3): 1.0, (5, 1): -1.0, (5, 2): 0.0, (5, 5): 1.0}
    assert vector_index.exact(rows, asked, 0).collect() == [] and vector_index.exact(rows.limit(0), asked, 3).collect() == []


def test_index_recall(spark, tmp_path):
    """Every twentieth vector as a query, against brute force: recall of at least 0.9, and no cell left out of the index."""
    rows, points = vector_rows(spark, 3000, 24)
    vector_index.build(rows, str(tmp_path / "index"), cells=24, sample=1000)
    assert spark.read.parquet(str(tmp_path / "index/vectors")).count() == 3000
    asked = vector_index.of_items(rows, rows.where("id % 20 = 0"))
    found = {(r.query_id, r.id) for r in vector_index.search(spark, str(tmp_path / "index"), asked, 10, probes=8).collect()}
    true = {(r.query_id, r.id) for r in vector_index.exact(rows, asked, 10).collect()}
    assert len(found & true) / len(true) >= 0.9
    only = vector_index.search(spark, str(tmp_path / "index"), asked, 10, probes=24, where="kind = 'b'")
    assert {(r.query_id, r.id) for r in only.collect()} == {(r.query_id, r.id) for r in vector_index.exact(rows.where("kind = 'b'"), asked, 10).collect()}


def test_index_of_the_given_embeddings(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    vector_index.build(rows, str(tmp_path / "index"), cells=32)
    asked = vector_index.of_items(rows, rows.where("id % 20 = 0"))
    found = {(r.query_id, r.id) for r in vector_index.search(spark, str(tmp_path / "index"), asked, 5, probes=16).collect()}
    true = {(r.query_id, r.id) for r in vector_index.exact(rows, asked, 5).collect()}
    assert len(found & true) / len(true) >= 0.9


def test_embedding_job_asks_once_for_a_text(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()

    def make():
        call = hash_embedding(8)()

        def run(texts):
            import uuid

            (seen / uuid.uuid4().hex).write_text("\n".join(texts))
            return [[] if t == "refused" else v for t, v in zip(texts, call(texts))]

        return run

    def asked():
        return sorted(t for f in seen.iterdir() for t in f.read_text().splitlines())

    providers = Providers()
    providers.register("embedding", "local", make)
    texts = ["one", "two", "one", "", "refused"]
    items = spark.createDataFrame([(i, t, "done") for i, t in enumerate(texts)] + [(9, "late", "error")], "id long, text string, ingest_status string").withColumn("content_hash", F.sha2("text", 256))
    path = str(tmp_path / "vectors")
    assert embeddings.run(items, providers, path, "m") == {"processed": 2, "skipped": 0, "failed": 1}
    assert asked() == ["one", "refused", "two"]
    assert {r.id for r in embeddings.vectors(items, path, "m").collect()} == {0, 1, 2}
    more = items.where("id <> 4").withColumn("ingest_status", F.lit("done"))
    assert embeddings.run(more, providers, path, "m") == {"processed": 1, "skipped": 2, "failed": 0}
    assert asked() == ["late", "one", "refused", "two"]
    assert embeddings.run(more, providers, path, "m") == {"processed": 0, "skipped": 3, "failed": 0} and len(asked()) == 4
    assert embeddings.run(more, providers, path, "other") == {"processed": 3, "skipped": 0, "failed": 0}
    assert embeddings.vectors(more, path, "m").count() == 4 and embeddings.run(items.limit(0), providers, path, "m") == {"processed": 0, "skipped": 0, "failed": 0}


def test_stored_versions_read_what_differs(spark, tmp_path):
    old = spark.range(5000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("content_hash"), F.lit("keep").alias("decision"))
    new = old.where("id <> 17").withColumn("content_hash", F.when(F.col("id") == 40, "x").otherwise(F.col("content_hash"))).unionByName(spark.range(9000, 9001).select("id", F.lit("y").alias("content_hash"), F.lit("keep").alias("decision")))
    for name, snap in (("old", old), ("new", new), ("same", old.orderBy(F.rand(1)))):
        stored_versions.write(snap, str(tmp_path / name))
    got = stored_versions.changed(spark, str(tmp_path / "old"), str(tmp_path / "new"))
    assert {(r.id, r.change) for r in got.collect()} == {(r.id, r.change) for r in versions.diff(old, new).collect()} == {(17, "removed"), (40, "modified"), (9000, "added")}
    places = stored_versions.differing(spark, str(tmp_path / "old"), str(tmp_path / "new"))
    assert 1 <= places.count() <= 3
    read = {f for f in got.inputFiles() if "/old/rows/" in f}
    assert 0 < len(read) <= len(spark.read.parquet(str(tmp_path / "old/rows")).inputFiles())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "folder" in plan
    assert stored_versions.changed(spark, str(tmp_path / "old"), str(tmp_path / "same")).collect() == []
    assert sorted(r.id for r in stored_versions.read(spark, str(tmp_path / "new")).collect()) == sorted(r.id for r in new.collect())


def test_a_failed_export_leaves_the_last(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "exports"))
    rows = spark.range(10).select("id", F.array(F.lit("x")).alias("tags"))
    assert ledger.latest("d", "csv") is None and ledger.entries() == []
    made = [ledger.export(rows.where(F.col("id") <= i), "d", "jsonl", f"v{i}") for i in range(7)]
    assert [e["version"] for e in ledger.entries("d", "jsonl")] == ["v6", "v5", "v4", "v3", "v2"] and made[6]["rows"] == 7
    assert sorted(p.name for p in (tmp_path / "exports/d").iterdir()) == sorted(f"jsonl-{e['export_id']}" for e in made[2:])
    with pytest.raises(Exception, match="broken"):
        ledger.export(rows.select(F.raise_error(F.lit("broken")).alias("x")), "d", "jsonl", "bad")
    assert ledger.latest("d", "jsonl") == made[6] and spark.read.json(made[6]["path"]).count() == 7
    assert not [p for p in (tmp_path / "exports/staging").iterdir() if not p.name.startswith(".")]
    other = ledger.export(rows, "d", "csv")
    assert other["rows"] == 10 and ledger.export(rows.limit(0), "e", "parquet")["rows"] == 0
    assert {(r.dataset_id, r.fmt) for r in ledger.frame().collect()} == {("d", "jsonl"), ("d", "csv"), ("e", "parquet")}


PLUGIN = """
import json, os, sys, time
for line in sys.stdin:
    text = json.loads(line)["payload"]["text"]
    if text == "die": os._exit(1)
    if text == "hang": time.sleep(60)
    if text == "half": sys.stdout.write('{"out'); sys.stdout.flush(); time.sleep(60)
    if text == "bad": print("no json", flush=True); continue
    if text == "no": print(json.dumps({"type": "error", "error": "refused"}), flush=True); continue
    print("", flush=True)
    print(json.dumps({"type": "result", "output": {"n": len(text), "pid": os.getpid()}}), flush=True)
"""


@pytest.fixture
def command(tmp_path):
    (tmp_path / "plugin.py").write_text(PLUGIN)
    return [sys.executable, str(tmp_path / "plugin.py")]


def test_plugin_survives_faults(command):
    p = plugin.Plugin(command, timeout=2, idle=0)
    first = p.call("x", {"text": "abc"})
    assert first["n"] == 3 and p.call("x", {"text": "z" * 300_000}) == {"n": 300_000, "pid": first["pid"]} and p.starts == 1
    for text, fault in (("hang", "timed out"), ("die", "ended"), ("half", "timed out"), ("bad", "Expecting")):
        before = p.starts
        start = time.monotonic()
        with pytest.raises(plugin.PluginError, match=fault):
            p.call("x", {"text": text})
        assert time.monotonic() - start < 5 and p.process is None
        assert p.call("x", {"text": "after"})["n"] == 5 and p.starts == before + 1
    with pytest.raises(plugin.PluginError, match="refused"):
        p.call("x", {"text": "no"})
    assert p.process.poll() is None
    p.stop()


def test_plugin_stops_when_idle(command):
    p = plugin.Plugin(command, timeout=5, idle=0.3)
    p.call("x", {"text": "a"})
    process = p.process
    for _ in range(100):
        if process.poll() is not None:
            break
        time.sleep(0.05)
    assert process.poll() is not None and p.call("x", {"text": "b"})["n"] == 1 and p.starts == 2
    p.stop()


def test_plugin_over_rows(spark, command):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "bb", None, "die", "no", "ccc"] * 3)], "id long, text string").coalesce(1)
    got = {r.id: (r.n, r.n_error) for r in plugin.apply(rows, command, "x", "text", "n", "n", "long", timeout=5).collect()}
    assert [got[i][0] for i in range(6)] == [1, 2, 0, None, None, 3]
    assert "ended" in got[3][1] and "refused" in got[4][1] and got[0][1] is None and len(got) == 18
    quiet = plugin.apply(rows.where("text not in ('die', 'no')"), command, "x", "text", "pid", "pid", "long", timeout=5).select("pid").distinct()
    assert quiet.count() == 1


def test_planted_label_errors(spark):
    """A tenth of the labels are wrong; nine in ten of them are found, and of what is found nine in ten are wrong."""
    rng = random.Random(6)
    words = [[f"{c}{k}" for k in range(30)] for c in "abc"]
    rows, wrong = [], set()
    for i in range(600):
        c = rng.randrange(3)
        text = " ".join([*(rng.choice(words[c]) for _ in range(12)), *(rng.choice(sum(words, [])) for _ in range(5))])
        label = c
        if i % 10 == 0:
            label, _ = (c + 1) % 3, wrong.add(i)
        rows.append((i, text, label))
    df = spark.createDataFrame([*rows, (999, "a1 a2", None)], "id long, text string, label int")
    probabilities = verdicts.out_of_fold(df, 3)
    assert probabilities.count() == 600 and probabilities.where("size(probabilities) <> 3 or abs(aggregate(probabilities, 0D, (s, x) -> s + x) - 1) > 1e-6").isEmpty()
    found = {r.text_id for r in verdicts.label_issues(df, 3).collect()}
    assert len(found & wrong) / len(wrong) >= 0.9 and len(found & wrong) / len(found) >= 0.9
    assert verdicts.label_issues(df.limit(0), 3).collect() == []


def test_thresholds_of_datasets(spark):
    items = spark.createDataFrame([(1, "a", "x" * 20), (2, "b", "x" * 20), (3, "c", "x" * 20), (4, None, "x")], "id long, dataset_id string, text string")
    own = spark.createDataFrame([("a", {"min_length": 21.0}), ("b", {"min_length": 0.0, "max_length": None}), ("c", {})], "dataset_id string, thresholds map<string,double>")
    got = {(r.text_id, r.issue_type, r.threshold) for r in quality.issues(items, datasets=own).collect()}
    assert got == {(1, "too_short", 21.0), (4, "too_short", 10.0)}


def test_derive_filtered_copies_labels(spark):
    items = spark.createDataFrame([(1, "a", "keep", 50, "done"), (2, "a", "review", 5, "done"), (3, "a", "keep", 50, "error")], "id long, dataset_id string, decision string, char_count long, ingest_status string")
    labels = spark.createDataFrame([(1, "x", "approved"), (1, "y", "pending"), (2, "x", "approved")], "doc_id long, category string, status string")
    rows, copied = compose.derive_filtered(items, labels, "new", min_length=10)
    row = rows.collect()
    assert [(r.dataset_id, r.char_count) for r in row] == [("new", 50)]
    assert sorted((r.doc_id, r.category, r.status) for r in copied.collect()) == [(row[0].id, "x", "approved"), (row[0].id, "y", "pending")]


def test_pick_of_a_pair(spark):
    items = spark.createDataFrame([(i, "pending") for i in range(6)], "id long, decision string")
    members = spark.createDataFrame([("g", 0, True), ("g", 1, False), ("g", 2, False), ("h", 3, True), ("h", 4, False)], "group_id string, text_id long, is_canonical boolean")
    choices = spark.createDataFrame([("g", 1, 0), ("h", 3, 4)], "group_id string, keep long, other long")
    rows, now = dedup.pick(items, members, choices)
    assert {r.id: r.decision for r in rows.collect()} == {0: "quarantine", 1: "keep", 2: "pending", 3: "keep", 4: "quarantine", 5: "pending"}
    assert {r.text_id for r in now.where("is_canonical").collect()} == {1, 3} and now.count() == 5


def test_each_file_has_its_delimiter(spark, tmp_path):
    for name, text in (("a.csv", "x,y\n1,2\n"), ("b.csv", "x;y\n3;4,5\n6;7\n"), ("c.tsv", "x\tz\n8\t9\n"), ("d.csv", "x,y\n10,11\n"), ("e.csv", "")):
        (tmp_path / name).write_text(text)
    got = readers.delimited(spark, str(tmp_path))
    assert sorted(((r.x, r.y, r.z) for r in got.collect()), key=lambda t: t[0]) == sorted([("1", "2", None), ("3", "4,5", None), ("6", "7", None), ("8", None, "9"), ("10", "11", None)], key=lambda t: t[0])
    assert readers.delimited(spark, str(tmp_path / "a.csv")).columns == ["x", "y"]
