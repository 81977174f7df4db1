"""Document fingerprints: one-permutation MinHash with optimal densification and packed b-bit values.

Each shingle is hashed once: the top bits name a bin, the bin keeps its smallest hash. An empty bin copies
the first non-empty bin of its own fixed random probing order (optimal densification). Of each bin the low
four bits are kept, two bins to a byte. The likeness of two fingerprints is the share of equal values,
corrected for chance agreement: ``(m - C) / (1 - C)`` with ``C = 2 ** -4``, cut off at 0.

Fingerprints are lowercase hex. A text without words has the empty fingerprint: it is 1.0 like another empty
one and 0.0 like any other. Nulls count as empty texts; equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE, Words, collect_bounded, mix, shingle_sets, table, texts

BINS = 512
BITS = 4
PROBES = 12
MOST_RANGES = 1 << 20


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _probing(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """probe[a, i]: the bin that empty bin i tries at attempt a; rank[i, j]: when it tries bin j after those."""
    if bins in _TABLES:
        return _TABLES[bins]
    i = np.arange(bins, dtype=np.uint64)
    probe = mix(np.arange(PROBES, dtype=np.uint64)[:, None] * np.uint64(bins) + i + np.uint64(1)) % np.uint64(bins)
    order = np.argsort(mix((i[:, None] << np.uint64(32)) + i + np.uint64(7)), axis=1)
    rank = np.empty((bins, bins), np.uint16)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(bins, dtype=np.uint16), (bins, bins)), axis=1)
    _TABLES[bins] = probe.astype(np.int64), rank
    return _TABLES[bins]


def signature(hashes: np.ndarray, bins: int = BINS, bits: int = BITS) -> np.ndarray:
    """The b-bit values of sorted distinct 64-bit hashes; no hashes: no values."""
    if not len(hashes):
        return np.empty(0, np.uint8)
    at = (hashes >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    full = np.zeros(bins, bool)
    full[at[first]] = True
    out = np.zeros(bins, np.uint8)
    out[at[first]] = (hashes[first] & np.uint64((1 << bits) - 1)).astype(np.uint8)
    empty = np.flatnonzero(~full)
    if len(empty):
        probe, rank = _probing(bins)
        source = np.full(bins, -1)
        for a in range(PROBES):
            to = probe[a, empty]
            ok = full[to]
            source[empty[ok]] = to[ok]
            empty = empty[~ok]
            if not len(empty):
                break
        if len(empty):
            there = np.flatnonzero(full)
            source[empty] = there[np.argmin(rank[np.ix_(empty, there)], axis=1)]
        filled = source >= 0
        out[filled] = out[source[filled]]
    return out


def pack(values: np.ndarray) -> str:
    return (values[0::2] << 4 | values[1::2]).tobytes().hex()


def unpack(fingerprint: str) -> np.ndarray:
    b = np.frombuffer(bytes.fromhex(fingerprint), np.uint8)
    return np.stack([b >> 4, b & 15], axis=1).reshape(-1)


def likeness(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    chance = 2.0**-bits
    return max(0.0, (float(np.mean(a == b)) - chance) / (1 - chance))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", w: int = SHINGLE) -> DataFrame:
    """(doc_id, n_chars, fingerprint) for every row, nulls, repeats and blank texts included; one scan, no shuffle."""

    def run(batches):
        words = Words()
        for batch in batches:
            ts = texts(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t.decode()) for t in ts], pa.int64()), pa.array([pack(signature(s)) for s in shingle_sets(ts, words, w)], pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def _in_ranges(docs: DataFrame, rows: int) -> DataFrame:
    """Rows dealt by ranges of descending key, each range followed by the first row of the next (``tail``).

    Ranges are cut at approximate quantiles and then evenly, ``rows`` to a range or more, at most MOST_RANGES of
    them, so the broadcast list of their first keys has a fixed bound. After the last range comes the first.
    """
    spark = docs.sparkSession
    docs = docs.withColumn("key", F.coalesce("doc_id", F.lit(-(2**63))))
    n = docs.count()
    ranges = min(MOST_RANGES, max(1, n // rows))
    some = min(256, ranges)
    bounds = sorted(set(docs.agg(F.percentile_approx("key", [i / some for i in range(1, some)], 2000)).first()[0] or [])) if some > 1 and n else []
    ends = docs.agg(F.min("key"), F.max("key")).first()
    lows = [ends[0] or 0, *bounds]
    highs = [*bounds, (ends[1] or 0) + 1]
    per = max(1, -(-ranges // len(lows)))
    q = F.size(F.filter(F.lit(bounds) if bounds else F.array().cast("array<bigint>"), lambda b: b <= F.col("key")))
    lo, width = (F.element_at(F.lit(v), q + 1) for v in (lows, [max(1.0, (h - low) / per) for low, h in zip(lows, highs)]))
    docs = docs.withColumn("b", (q * per + F.least(F.lit(per - 1), F.floor((F.col("key").cast("double") - lo) / width))).cast("long"))
    heads = collect_bounded(docs.groupBy("b").agg(F.max("key").alias("key")), 2 * MOST_RANGES, "ranges").sort_by("b").to_pydict()
    k = len(heads["b"])
    if not k:
        return docs.select("doc_id", "key", "text", "b", F.lit(0).alias("tail"))
    after = spark.createDataFrame([(heads["key"][i], heads["b"][(i + 1) % k]) for i in range(k)], "head long, to long")
    docs = docs.join(F.broadcast(after), F.col("key") == F.col("head"), "left")
    own, tail = F.struct(F.col("b"), F.lit(0).alias("tail")), F.struct(F.col("to").alias("b"), F.lit(1).alias("tail"))
    docs = docs.withColumn("z", F.explode(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, tail))))
    docs = docs.select("doc_id", "key", "text", "z.b", "z.tail")
    return docs.repartition("b").sortWithinPartitions("b", "tail", F.col("key").desc(), F.col("text").desc_nulls_last())


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", w: int = SHINGLE, rows: int = 2000) -> DataFrame:
    """Fingerprints of every text and of its edit by the next document, descending id (repeated ids: by text).

    The edit replaces the last ``n // 2`` code points by as many first ones of the next text, or all it has.
    The last row's next is the first; a single row follows itself. Null ids sort after all others; null texts
    are empty. An empty table gives no rows. Texts are shuffled once, by ranges of the id.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        words = Words()
        before = None
        cols = ([], [], [], [], [], [], [])

        def flush(rows):
            """rows: id, text, edited text, then the fingerprints' values of the text and of the next one."""
            for (doc, n, edit, mine, other), s in zip(rows, shingle_sets([r[2] for r in rows], words, w)):
                changed = signature(s)
                for c, v in zip(cols, (doc, n, hashlib.sha256(edit).hexdigest(), pack(mine), pack(changed), likeness(mine, changed), likeness(mine, other))):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            for c in cols:
                c.clear()
            return out

        for batch in batches:
            rows, ts = [], texts(batch.column(1))
            for doc, text, s, b, tail in zip(batch.column(0).to_pylist(), ts, shingle_sets(ts, words, w), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if tail and before is None:
                    continue
                print_, text = signature(s), text.decode()
                if before is not None:
                    assert before[3] == b, "a range lacks its tail"
                    was = before[1]
                    n = len(was)
                    rows.append((before[0], n, (was[: n - n // 2] + text[: n // 2]).encode(), before[2], print_))
                before = None if tail else (doc, text, print_, b)
            yield flush(rows)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _in_ranges(docs, rows).select("doc_id", "text", "b", "tail").mapInArrow(run, schema)


def op1_minhash_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
