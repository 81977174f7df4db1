"""Bounded labelled samples, their vocabulary and features."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import collect_bounded, save, texts

#: Bytes that end a word here: ASCII controls, white space and punctuation; A-Z are lowered. Others stay.
_FOLD = bytes(32 if i < 48 or 58 <= i < 65 or 91 <= i < 97 or 123 <= i < 128 else i + 32 if 65 <= i < 91 else i for i in range(256))


def folded(text: bytes) -> set[bytes]:
    """Distinct words without ASCII punctuation."""
    return set(text.translate(_FOLD).split())


def raw(text: bytes) -> set[bytes]:
    """Distinct words with punctuation, lowered."""
    return set(text.lower().split())


def chosen(labels: DataFrame, most: int, *order) -> DataFrame:
    """At most ``most`` labelled ids, chosen by a hash of the id, so alike at every size; broadcast size is bounded."""
    return labels.orderBy(*order, F.xxhash64("doc_id"), "doc_id").limit(most)


def word_rows(docs: DataFrame, labelled: DataFrame, words, extra: list[str] = ()) -> DataFrame:
    """The sample's rows with the distinct words of the whole text (column words: array of binary), saved."""
    keep = [c for c in labelled.columns if c != "doc_id"]
    picked = docs.select("doc_id", "text", *extra).join(F.broadcast(labelled), "doc_id")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in picked.select("doc_id", *extra, *keep).schema) + ", words array<binary>"

    def run(batches):
        for batch in batches:
            ws = pa.array([list(words(t)) for t in texts(batch.column("text"))], pa.list_(pa.binary()))
            names = ["doc_id", *extra, *keep]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), ws], [*names, "words"])

    return save(picked.mapInArrow(run, schema), "sample")


def vocabulary(rows: DataFrame, least: int, most: int) -> list[bytes]:
    """The ``most`` words of the sample in the most rows, in ``least`` at least."""
    counts = rows.select(F.explode("words").alias("word")).groupBy("word").count().where(F.col("count") >= least)
    return collect_bounded(counts.orderBy(F.desc("count"), "word").limit(most), most, "vocabulary")["word"].to_pylist()


def features(rows: DataFrame, vocab: list[bytes], most: int) -> tuple[dict, list[np.ndarray]]:
    """The sample's other columns and, for each row, the indices of its vocabulary words; both bounded."""
    index = rows.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(vocab)})
    names = [c for c in rows.columns if c != "words"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*names).schema) + ", at binary"

    def run(batches):
        get = index.value.get
        for batch in batches:
            at = [np.array(sorted(i for i in map(get, ws) if i is not None), np.int32).tobytes() for ws in batch.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(at, pa.binary())], [*names, "at"])

    got = collect_bounded(rows.mapInArrow(run, schema), 64 * most, "sample").sort_by([("doc_id", "ascending")]).to_pydict()
    return got, [np.frombuffer(a, np.int32) for a in got.pop("at")]
