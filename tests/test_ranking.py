"""Exact numbers and first rows of an order, components of pairs, postings and row numbers over many tasks."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import compose, items
from textloom.operators.components import components
from textloom.operators.ranking import boundary, first, numbered
from textloom.sources import readers


def plain_order(rows, order):
    def key(r):
        out = []
        for c, down in order:
            v = r[c]
            if isinstance(v, str):
                v = [b + 1 for b in v.encode()] + [0]
                v = [-x for x in v] if down else v
            elif v is not None:
                v = -v if down else v
            out.append((v is None, v if v is not None else 0))
        return out

    return sorted(rows, key=key)


@pytest.mark.parametrize("order", [[("k", True), ("flag", True), ("t", True), ("id", False)], [("name", False), ("x", True), ("id", True)], [("x", False), ("name", True), ("id", False)], [("id", True)]])
def test_first_equals_a_sort(spark, order):
    rng = random.Random(3)
    names = ["", "a", "a\0", "a\0b", "ab", "abc", "abcd", "é", "z" * 50, "z" * 49, None]
    rows = [{"id": i * 3, "k": rng.choice([0, 1, 2, 2, None]), "flag": rng.random() < 0.3, "t": rng.randrange(10**9) if i % 3 else 5, "x": rng.choice([0.5, -2.25, 1e9, None, 0.1 * i]), "name": rng.choice(names)} for i in range(300)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "id long, k long, flag boolean, t long, x double, name string").repartition(5)
    want = [r["id"] for r in plain_order(rows, order)]
    for k in (0, 1, 2, 37, 150, 299, 300, 500):
        assert sorted(r.id for r in first(df, k, order).collect()) == sorted(want[:k])


def test_first_among_ties_and_none(spark):
    df = spark.range(50).withColumn("k", F.lit(1))
    assert first(df, 7, [("k", True)]).count() == 7 and first(df.limit(0), 7, [("k", True)]).count() == 0
    assert boundary(df, 50, [("id", False)]) is None and boundary(df, 3, [("id", False)]) == ([2], 1)
    wide = spark.createDataFrame([(-(2**62),), (2**62,), (0,), (None,)], "k long")
    assert [r.k for r in first(wide, 1, [("k", True)]).collect()] == [2**62] and first(wide, 3, [("k", False)]).where("k is null").count() == 0


def test_numbered_equals_a_sort(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(20), rng.choice(["a", "b", None])) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, k long, name string").repartition(7)
    got = numbered(df, F.desc("k"), F.asc_nulls_last("name"), "id").collect()
    want = sorted(rows, key=lambda r: (-r[1], r[2] is None, r[2] or "", r[0]))
    assert [(r.id, r.k, r.name) for r in sorted(got, key=lambda r: r["rank"])] == want and sorted(r["rank"] for r in got) == list(range(1, 2001))
    assert numbered(df.limit(0), "id").collect() == []


def test_components_of_a_chain_and_a_star(spark):
    """A chain of 100 000 in any order and a star of a million whose centre is its greatest node."""
    chain = spark.range(100_000).select(F.col("id").alias("id_a"), (F.col("id") + 1).alias("id_b")).orderBy(F.xxhash64("id_a"))
    assert components(chain).agg(F.count("*"), F.min("group_id"), F.max("group_id"), F.count_distinct("text_id")).first()[:] == (100_001, 0, 0, 100_001)
    star = spark.range(1_000_000).select(F.lit(5_000_000).cast("long").alias("id_a"), F.col("id").alias("id_b"))
    assert components(star).agg(F.count("*"), F.min("group_id"), F.max("group_id")).first()[:] == (1_000_001, 0, 0)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_components_equal_brute_force(spark, kind, monkeypatch):
    rng = random.Random(kind)
    make = str if kind == "string" else int
    pairs = [(make(rng.randrange(300)), make(rng.randrange(300))) for _ in range(170)]
    group = {x: x for p in pairs for x in p}
    for _ in group:
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
    alone = {x for x in group if all(x not in p or p[0] == p[1] for p in pairs)}
    df = spark.createDataFrame([*pairs, (None, None), (pairs[0][0], None)], f"id_a {kind}, id_b {kind}").repartition(40)
    assert {r.text_id: r.group_id for r in components(df).collect()} == {x: g for x, g in group.items() if x not in alone}
    assert components(df.limit(0)).collect() == []


def test_no_checkpoint_is_left_but_one(spark, tmp_path):
    from textloom import lineage

    before = set(lineage._SAVED)
    chain = spark.range(3000).select(F.col("id").alias("id_a"), (F.col("id") + 1).alias("id_b")).orderBy(F.xxhash64("id_a"))
    components(chain).count()
    assert len(set(lineage._SAVED) - before) == 1


def test_postings(spark):
    here = spark.range(100).select("id")
    labels = [(i % 120, "big", "approved", None, "class") for i in range(150)] + [(i, "small", "approved", None, "span") for i in range(3)]
    labels += [(5, "other", "pending", None, "class"), (6, "other", "approved", 1, "class"), (7, None, "approved", None, "class"), (999, "other", "approved", None, "class")]
    df = spark.createDataFrame(labels, "doc_id long, category string, status string, superseded_at long, label_type string")
    got = {(r.category, r.chunk): r.ids for r in items.postings(here, df, size=30).collect()}
    assert got == {("big", k): list(range(30 * k, min(100, 30 * k + 30))) for k in range(4)} | {("small", 0): [0, 1, 2]}
    assert {r.category: r.ids for r in items.by_label(here, df, "span").collect()} == {"small": [0, 1, 2]}
    assert items.postings(here.limit(0), df).collect() == []


def test_important_sample_of_ties(spark):
    rows = spark.range(40).select("id", F.lit("keep").alias("decision"), (F.col("id") % 3).alias("tokens"))
    issues = spark.createDataFrame([(3, "open"), (3, "open"), (4, "open"), (5, "dismissed")], "text_id long, status string")
    got = {r.id: r.open_issues for r in compose.sample_important(rows, issues, 4).collect()}
    assert got == {3: 2, 4: 1, 2: 0, 5: 0}


def test_failed_ingests_first(spark):
    df = spark.createDataFrame([(1, "keep", "done"), (2, "pending", "done"), (3, "pending", "error")], "id long, decision string, ingest_status string")
    assert [r.id for r in items.page(df, 0, 10).collect()] == [3, 2, 1] and [r.id for r in items.page(df.drop("ingest_status"), 0, 10).collect()] == [2, 3, 1]


@pytest.mark.parametrize("few", [100_000, 0])
def test_numbers_of_a_file_over_many_tasks(spark, tmp_path, monkeypatch, few):
    """Equal to plain numbering, whether blocks are sent to the rows or meet them in a shuffle."""
    monkeypatch.setattr(readers, "FEW_BLOCKS", few)
    text = [f"line {i} " + "x" * (i % 200) if i % 5 else "  " for i in range(4000)]
    (tmp_path / "big.part.txt").write_text("\n".join(text))
    (tmp_path / "small.txt").write_text("\n\none\ntwo")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = readers.line_rows(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 10
        got = {(r.relative_path.rpartition("_")[0], r.row): r.text for r in readers.numbered(rows, F.col("value")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = {("big.part", n): t for n, t in enumerate(t for t in text if t.strip())} | {("small", 0): "one", ("small", 1): "two"}
    assert got == want
