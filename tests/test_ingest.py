"""Streams that take each text once, and archives read by ranges."""

import random
import zipfile

import pytest
from pyspark.sql import functions as F

from textloom.sources import archives
from textloom.streaming import ingest


def texts(spark, path):
    return sorted(r.text for r in spark.read.schema("text string").parquet(str(path)).collect())


def test_restarts_late_repeats_and_known_texts(spark, tmp_path):
    """Each run reads new files only, a file a batch; what an earlier run, an earlier batch or the known table had is left out."""
    (tmp_path / "in").mkdir()
    known = spark.createDataFrame([("known",)], "text string").select(F.sha2("text", 256).alias("content_hash"))
    for i in range(3):
        (tmp_path / f"in/a{i}.txt").write_text(f"known\n\t \n \ta{i}\t\nrepeat\nrepeat\n")
        (tmp_path / f"in/b{i}.txt").write_text(f"late {i}\nrepeat\n\x85a0\n")
        run = ingest.stream_lines(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), known, files=1)
        assert run.awaitTermination(60) and run.exception() is None
        read = [p["numInputRows"] for p in run.recentProgress if p["numInputRows"]]
        assert len(read) == 2 and sum(read) <= 8
        assert texts(spark, tmp_path / "out") == sorted(["repeat", *(f"a{k}" for k in range(i + 1)), *(f"late {k}" for k in range(i + 1))])
    again = ingest.stream_lines(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert again.awaitTermination(60) and not any(p["numInputRows"] for p in again.recentProgress)


def test_a_batch_that_failed_is_taken_once(spark, tmp_path):
    """The first run dies after part of its input; the second takes all of it, each text once."""
    (tmp_path / "in").mkdir()
    for i in range(4):
        (tmp_path / f"in/{i}.txt").write_text(f"one {i}\nshared\n")
    broken = tmp_path / "broken"
    broken.write_text("")

    def lines(glob):
        def fail(batches):
            import os

            for b in batches:
                if os.path.exists(broken) and "one 2" in b.column("text").to_pylist():
                    raise RuntimeError("lost")
                yield b

        return ingest.line_stream(spark, str(tmp_path / "in"), 1, glob).mapInArrow(fail, "source_uri string, text string")

    run = ingest.ingest(spark, lines, str(tmp_path / "out"), str(tmp_path / "cp"))
    with pytest.raises(Exception, match="lost"):
        run.awaitTermination(60)
    broken.unlink()
    assert ingest.ingest(spark, lines, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert texts(spark, tmp_path / "out") == ["one 0", "one 1", "one 2", "one 3", "shared"]


def test_whole_files(spark, tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    for name, content in (("a.txt", b"\xef\xbb\xbfone"), ("deep/b.md", b"one"), ("c.txt", b"\xe9t\xe9"), ("d.txt", b"a\0b"), ("e.bin", b"x"), ("f.txt", b"")):
        (tmp_path / "in" / name).write_bytes(content)
    assert ingest.stream_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert texts(spark, tmp_path / "out") == ["one", "été"]


def test_session_keeps_its_state_store(spark):
    assert ingest._STORE and all(spark.conf.get(k, "") != v for k, v in ingest._STORE.items())


@pytest.fixture
def zips(tmp_path):
    rng, want = random.Random(2), {}
    for k in range(3):
        with zipfile.ZipFile(tmp_path / f"{k}.zip", "w", zipfile.ZIP_DEFLATED if k else zipfile.ZIP_STORED) as z:
            z.writestr("folder/", "")
            for i in range(400):
                text = " ".join(rng.choice(["é", "word", "x" * 50]) for _ in range(rng.randrange(300)))
                z.writestr(f"folder/{i}.txt", text.encode("latin-1" if i % 7 == 0 else "utf-8"))
                want[(f"{k}.zip", f"folder/{i}.txt")] = text
            z.comment = b"a comment"
    return tmp_path, want


@pytest.mark.parametrize("few", [100_000, 0])
def test_members_over_many_tasks(spark, zips, monkeypatch, few):
    monkeypatch.setattr(archives, "FEW_MEMBERS", few)
    got = archives.archives(spark, str(zips[0]))
    assert {(r.source_uri.rpartition("/")[2], r.member): r.text for r in got.collect()} == zips[1]
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_directory_larger_than_the_tail(spark, zips):
    files = spark.read.format("binaryFile").load(str(zips[0]))
    rows = sorted(map(tuple, archives.members(files).collect()))
    assert len(rows) == 1200 and sorted(map(tuple, archives.members(files, tail=200).collect())) == rows
    assert sorted(map(tuple, archives.members(files, tail=20).collect())) == rows


@pytest.mark.parametrize("name", ["../x", "/abs", "a/../../b", "..\\x", "C:\\x"])
def test_unsafe_members_are_refused(spark, tmp_path, name):
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("fine.txt", "x")
        z.writestr(name, "y")
    with pytest.raises(Exception, match="unsafe member"):
        archives.archives(spark, str(tmp_path)).collect()


def test_large_broken_and_empty_archives(spark, tmp_path, monkeypatch):
    with zipfile.ZipFile(tmp_path / "none.zip", "w"):
        pass
    assert archives.archives(spark, str(tmp_path)).collect() == []
    with zipfile.ZipFile(tmp_path / "large.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", "x" * 1000)
    tail = (tmp_path / "large.zip").read_bytes()
    monkeypatch.setattr(archives, "ZIP_BYTES", 999)
    with pytest.raises(ValueError, match="more than 999 bytes"):
        archives.directory("u", len(tail), tail)
    with pytest.raises(ValueError, match="u: "):
        archives.directory("u", 21, b"no archive at all....")
    monkeypatch.undo()
    uri, member, at, length, *rest = archives.directory("u", len(tail), tail)[0]
    assert archives.unpack(tail[at : at + length], *rest, member) == b"x" * 1000
    for wrong in (b"", tail[at + 1 : at + length]):
        with pytest.raises(ValueError, match="a: "):
            archives.unpack(wrong, *rest, member)
    with pytest.raises(ValueError, match="checksum"):
        archives.unpack(tail[at : at + length], *rest[:-1], 1, member)
