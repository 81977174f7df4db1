"""Exact and MinHash near duplicates of item rows (id, text, content_hash, tokens)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import save
from .components import components

HASHES = 128
BANDS = 16
ROWS = 8
SHINGLE = 5
CELL = 1_000
WIDTH = 512
KNOWN = 3_000_000


def exact_groups(items: DataFrame) -> DataFrame:
    """content_hash, members, of hashes that two items or more share."""
    return items.groupBy("content_hash").agg(F.count("*").alias("members")).where("members > 1")


def exact_members(items: DataFrame) -> DataFrame:
    """group_id, text_id, similarity, is_canonical; canonical is the one of most tokens, then the smallest id.

    The canonical one is an aggregate, so a hot hash is not gathered in one task.
    """
    best = items.groupBy("content_hash").agg(F.count("*").alias("k"), F.min_by("id", F.struct(-F.col("tokens"), "id")).alias("best")).where("k > 1")
    rows = items.join(best, "content_hash")
    return rows.select(F.col("content_hash").alias("group_id"), F.col("id").alias("text_id"), F.lit(1.0).alias("similarity"), (F.col("id") == F.col("best")).alias("is_canonical"))


class _Grams:
    """Hashes of the distinct 5-character shingles of texts, remembered as sorted arrays of at most KNOWN entries."""

    def __init__(self):
        self.keys, self.hashes = np.empty(0, np.uint64), np.empty(0, np.uint32)

    def of(self, texts: list[str]) -> list[np.ndarray]:
        found = []
        for t in texts:
            at = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
            n = max(0, len(at) - SHINGLE + 1)
            key = np.zeros(n, np.uint64)
            if at.max(initial=0) < 1 << 12:
                for k in range(SHINGLE):
                    key = key << np.uint64(12) | at[k : k + n]
            else:
                for k in range(SHINGLE):
                    key = (key ^ at[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(29)
                key |= np.uint64(1 << 63)
            found.append(np.unique(key, return_index=True))
        keys = np.concatenate([k for k, _ in found]) if found else self.keys
        new, first = np.unique(keys, return_index=True)
        at = np.minimum(np.searchsorted(self.keys, new), max(len(self.keys) - 1, 0))
        fresh = self.keys[at] != new if len(self.keys) else np.ones(len(new), bool)
        new, first = new[fresh], first[fresh]
        starts = np.cumsum([0, *(len(k) for k, _ in found)])
        row = np.searchsorted(starts, first, "right") - 1
        places = np.concatenate([i for _, i in found])[first] if len(first) else first
        grams = [texts[r][i : i + SHINGLE] for r, i in zip(row.tolist(), places.tolist())]
        hashes = np.array([int.from_bytes(hashlib.sha256(g.encode("utf-8", "surrogatepass")).digest()[4:8], "big") for g in grams], np.uint32)
        every, values = np.concatenate([self.keys, new]), np.concatenate([self.hashes, hashes])
        by = np.argsort(every, kind="stable")
        every, values = every[by], values[by]
        self.keys, self.hashes = (every, values) if len(every) <= KNOWN else (self.keys[:0], self.hashes[:0])
        return [values[np.searchsorted(every, k)] for k, _ in found]


def signature(text: Column) -> Column:
    """128 minima of the family ``((7919 i + 31) h + 6271 i + 17) mod 2^32`` over 5-character shingles; [] below 5.

    h is the low half of the first 64 bits of a shingle's sha256; tabs and line feeds count as blanks.
    """

    @F.pandas_udf("array<long>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        i = np.arange(HASHES, dtype=np.uint32)[:, None]
        a, b = i * np.uint32(7919) + np.uint32(31), i * np.uint32(6271) + np.uint32(17)
        grams, work = _Grams(), np.empty((HASHES, WIDTH), np.uint32)
        for s in parts:
            texts, out = [(t or "").replace("\n", " ").replace("\t", " ") for t in s], []
            for lo in range(0, len(texts), 100):
                for h in grams.of(texts[lo : lo + 100]):
                    low = np.full(HASHES, 2**32 - 1, np.uint32)
                    for k in range(0, len(h), WIDTH):
                        part = h[None, k : k + WIDTH]
                        v = work[:, : part.shape[1]]
                        np.multiply(a, part, out=v)
                        v += b
                        np.minimum(low, v.min(axis=1), out=low)
                    out.append(low.astype(np.int64).tolist() if len(h) else [])
            yield pd.Series(out)

    return run(text)


def near_pairs(items: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(id_a, id_b, jaccard): all pairs of distinct texts that share a band of eight values and reach the threshold.

    Equal texts are one class, named by its smallest id, and not paired.
    """
    return _linked(items, threshold, False)


def near_links(items: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Of near_pairs() as many as connect the same texts: a spanning forest of each bucket, linear in its texts."""
    return _linked(items, threshold, True).distinct()


def _linked(items: DataFrame, threshold: float, forest: bool) -> DataFrame:
    """Compares all classes of each band's bucket. Small buckets share cells; one of more than CELL classes is dealt over
    a triangular grid of cells. Without ``forest`` a pair is taken in the first band that it shares."""
    reps = items.groupBy("content_hash").agg(F.min("id").alias("id"))
    rows = save(items.join(reps, ["content_hash", "id"], "left_semi").select("id", signature(F.col("text")).alias("sig")), "signatures").where(F.size("sig") > 0)
    bands = rows.select("id", F.posexplode(F.expr(f"transform(sequence(0, {BANDS - 1}), b -> xxhash64(b, slice(sig, b * {ROWS} + 1, {ROWS})))")).alias("b", "band"))
    many = bands.groupBy("band").agg(F.count("*").alias("k")).where("k > 1")
    shared = save(bands.join(many, "band"), "bands")
    cells = max(1, shared.count() // (2 * CELL))
    side = F.ceil(F.col("k") / CELL)
    dealt = shared.withColumn("mine", F.pmod(F.xxhash64("id"), side)).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), side - 1)))
    bucket = F.xxhash64("band", F.least("mine", "j"), F.greatest("mine", "j"))
    cell = F.when(F.col("k") <= CELL, F.pmod(F.xxhash64("band"), F.lit(cells))).otherwise(bucket)
    dealt = dealt.select(cell.alias("cell"), bucket.alias("bucket"), "b", "mine", (F.col("mine") != F.col("j")).alias("apart"), "id")
    kind = items.schema["id"].dataType.simpleString()
    sigs = rows.select("id", F.expr("transform(sig, x -> int(x - 2147483648L))").alias("sig"))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("bucket", "ascending"), ("id", "ascending")])
        ids, at = t["id"].to_pylist(), t["bucket"].to_numpy()
        sig = t["sig"].combine_chunks().flatten().to_numpy().reshape(-1, HASHES)
        band, mine, apart = t["b"].to_numpy(), t["mine"].to_numpy(), t["apart"].to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.r_[True, at[1:] != at[:-1], True]).tolist()
        out = []

        def share(same):
            return np.floor(same.mean(axis=1) * 1e6 + 0.5) / 1e6

        def near(i, j):
            """Those of j (numbers of rows) that reach the threshold with i, and their equal values."""
            if apart[i]:
                j = j[mine[j] != mine[i]]
            same = sig[j] == sig[i]
            ok = share(same) >= threshold
            return j[ok], same[ok]

        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if not forest:
                for i in range(lo, hi - 1):
                    j, same = near(i, np.arange(i + 1, hi))
                    first = same.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band[i]
                    out += [(i, x, s) for x, s in zip(j[first].tolist(), share(same[first]).tolist())]
                continue
            left = np.arange(lo, hi)
            while len(left) > 1:
                queue, left = [int(left[0])], left[1:]
                while queue and len(left):
                    i = queue.pop()
                    j, same = near(i, left)
                    left = left[~np.isin(left, j)]
                    queue += j.tolist()
                    out += [(min(i, x), max(i, x), s) for x, s in zip(j.tolist(), share(same).tolist())]
        ids_type = t.schema.field("id").type
        return pa.table({"id_a": pa.array([ids[i] for i, _, _ in out], ids_type), "id_b": pa.array([ids[j] for _, j, _ in out], ids_type), "jaccard": pa.array([s for _, _, s in out], pa.float64())})

    return dealt.join(sigs, "id").groupBy("cell").applyInArrow(run, f"id_a {kind}, id_b {kind}, jaccard double")


def groups_of(pairs: DataFrame) -> DataFrame:
    """(text_id, group_id): connected components of pairs (id_a, id_b), named by their smallest id."""
    return components(pairs)


def near_members(items: DataFrame, threshold: float = 0.7) -> DataFrame:
    """group_id, text_id, is_canonical of near-duplicate groups over all items, equal texts included."""
    classes = items.groupBy("content_hash").agg(F.min("id").alias("rep"), F.count("*").alias("k"))
    linked = groups_of(near_links(items, threshold))
    rows = items.join(classes, "content_hash").join(linked, F.col("rep") == linked.text_id, "left")
    rows = rows.where("k > 1 or group_id is not null").select("id", "tokens", F.coalesce("group_id", "rep").alias("group_id"))
    best = rows.groupBy("group_id").agg(F.min_by("id", F.struct(-F.col("tokens"), "id")).alias("best"))
    return rows.join(best, "group_id").select("group_id", F.col("id").alias("text_id"), (F.col("id") == F.col("best")).alias("is_canonical"))


def swap_canonical(members: DataFrame, group_id, text_id) -> DataFrame:
    return members.withColumn("is_canonical", F.when(F.col("group_id") == group_id, F.col("text_id") == text_id).otherwise(F.col("is_canonical")))


def quarantine_others(items: DataFrame, members: DataFrame) -> DataFrame:
    """Every member that is not canonical is quarantined."""
    hit = members.where("not is_canonical").select(F.col("text_id").alias("id")).distinct().withColumn("_hit", F.lit(True))
    return items.join(hit, "id", "left").withColumn("decision", F.when(F.col("_hit"), "quarantine").otherwise(F.col("decision"))).drop("_hit")


def review_pairs(members: DataFrame) -> DataFrame:
    """(group_id, canonical, other): the canonical member against each other one."""
    first = members.groupBy("group_id").agg(F.min_by("text_id", F.struct(~F.col("is_canonical"), "text_id")).alias("canonical"))
    return members.join(first, "group_id").where("text_id <> canonical").select("group_id", "canonical", F.col("text_id").alias("other"))


def pick(items: DataFrame, members: DataFrame, choices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items and members after a reviewer's choices (group_id, keep, other) of pairs: the kept text has decision keep, the other
    quarantine, and the kept one is canonical where the other was. Of choices that contradict each other keep wins."""
    kept, gone = choices.select(F.col("keep").alias("id"), F.lit("keep").alias("_to")), choices.select(F.col("other").alias("id"), F.lit("quarantine").alias("_to"))
    decided = kept.unionByName(gone).groupBy("id").agg(F.min("_to").alias("_to"))
    rows = items.join(decided, "id", "left").withColumn("decision", F.coalesce("_to", "decision")).drop("_to")
    was = members.where("is_canonical").select("group_id", F.col("text_id").alias("other"))
    now = choices.join(was, ["group_id", "other"]).groupBy("group_id").agg(F.min("keep").alias("_new"))
    swapped = members.join(now, "group_id", "left").withColumn("is_canonical", F.when(F.col("_new").isNotNull(), F.col("text_id") == F.col("_new")).otherwise(F.col("is_canonical")))
    return rows, swapped.drop("_new")


def members_of(members: DataFrame, items: DataFrame) -> DataFrame:
    w = Window.partitionBy("group_id").orderBy(F.desc("is_canonical"), "text_id")
    return members.join(items.select(F.col("id").alias("text_id"), "tokens", "decision"), "text_id").withColumn("place", F.row_number().over(w))
