"""Benchmark decontamination by the q-gram lemma.

An item of m characters occurs in a text with at most k edits only if some band of 2 (k + 1) neighbouring
diagonals holds at least ``m - q + 1 - k q`` shared character q-grams. Bands overlap by half, so any alignment
lies in one whole. Bands over that bound are regions; each is verified by banded alignment. Characters are
code points, A-Z lowered, every ASCII white space a space. k is EDIT_SHARE of m, or less where the bound would be
below 1; items shorter than q are looked for exactly.

The benchmark is the query side: it is read in blocks of at most BLOCK_CHARS characters, each broadcast and
run against all texts. Texts are scanned once a block and never shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, table, texts

Q = 12
EDIT_SHARE = 0.05
BLOCK_CHARS = 8_000_000
_BASE = 0x9E3779B97F4A7C15
MEETINGS = 2_000_000
_BITS = 22


def _codes(text: str) -> np.ndarray:
    a = np.frombuffer(text.encode("utf-32-le"), np.uint32).copy()
    a[(a >= 65) & (a <= 90)] += 32
    a[(a >= 9) & (a <= 13)] = 32
    return a


def _grams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """64-bit hashes of all q-grams (q = 12: doubled up from 1, 2, 4, 8 and 4)."""
    power = lambda n: np.uint64(pow(_BASE, n, 1 << 64))
    h1 = codes.astype(np.uint64) + np.uint64(1)
    h2 = h1[:-1] * power(1) + h1[1:]
    h4 = h2[:-2] * power(2) + h2[2:]
    h8 = h4[:-4] * power(4) + h4[4:]
    return h8[:-4] * power(4) + h4[8:]


def edit_budget(m: int, q: int = Q, share: float = EDIT_SHARE) -> int:
    return max(0, min(int(share * m), (m - q) // q))


def banded_distance(item: np.ndarray, text: np.ndarray, low: int, high: int, k: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best occurrence of item in text with at most k edits, over diagonals low..high."""
    lo, hi = low - k, high + k
    width, far = hi - lo + 1, len(item) + 1
    d = np.arange(lo, hi + 1)
    cost = np.where((d >= 0) & (d <= len(text)), 0, far)
    start = d.copy()
    steps = np.arange(width)
    for i, c in enumerate(item):
        j = d + i
        inside = (j >= 0) & (j < len(text))
        same = np.zeros(width, bool)
        same[inside] = text[j[inside]] == c
        new = np.where(inside, cost + ~same, far)
        old = start
        up = np.r_[cost[1:], far] + 1
        better = (up < new) & (j + 1 >= 0) & (j + 1 <= len(text) + 1)
        new = np.where(better, up, new)
        start = np.where(better, np.r_[old[1:], 0], old)
        run = new - steps
        best = np.minimum.accumulate(run)
        take = np.maximum.accumulate(np.where(run == best, steps, 0))
        cost, start = np.minimum(best + steps, far), start[take]
    j = d + len(item)
    cost = np.where((j >= 0) & (j <= len(text)), cost, far)
    i = int(np.argmin(cost))
    return (int(cost[i]), int(start[i]), int(j[i])) if cost[i] <= k else None


class Items:
    """A block of benchmark items with its q-gram index."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.rows = [(i, _codes(t)) for i, t in rows]
        at = [(n, c) for n, (_, c) in enumerate(self.rows) if len(c) >= Q]
        self.short = [(n, c) for n, (_, c) in enumerate(self.rows) if 0 < len(c) < Q]
        g = [_grams(c) for _, c in at]
        grams = np.concatenate(g) if g else np.empty(0, np.uint64)
        item = np.repeat(np.array([n for n, _ in at], np.int64), [len(x) for x in g])
        place = np.concatenate([np.arange(len(x)) for x in g]) if g else np.empty(0, np.int64)
        by = np.argsort(grams, kind="stable")
        self.gram, first = np.unique(grams[by], return_index=True)
        self.first, self.item, self.place = np.r_[first, len(by)], item[by], place[by]
        self.map = np.zeros(1 << _BITS, bool)
        self.map[self.gram >> np.uint64(64 - _BITS)] = True
        m = np.array([len(c) for _, c in self.rows], np.int64)
        self.k = np.array([edit_budget(x) if x >= Q else 0 for x in m], np.int64)
        self.least = m - Q + 1 - self.k * Q

    def _regions(self, hit: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Regions, item << 40 | band + 2^39, and how many grams each shares; band b holds the diagonals b * width to
        (b + 2) * width - 1. MEETINGS at a time, as a gram that repeats in both meets itself that often squared."""
        many = self.first[k + 1] - self.first[k]
        upto, parts = np.cumsum(many), []
        cuts = [0, *(np.searchsorted(upto, np.arange(MEETINGS, upto[-1], MEETINGS)) + 1).tolist(), len(hit)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if lo >= hi:
                continue
            m = many[lo:hi]
            flat = np.repeat(self.first[k[lo:hi]] - np.r_[0, np.cumsum(m)[:-1]], m) + np.arange(m.sum())
            item, diagonal = self.item[flat], np.repeat(hit[lo:hi], m) - self.place[flat]
            band = np.floor_divide(diagonal, self.k[item] + 1)
            key = item << np.int64(40) | band + np.int64(1 << 39)
            parts.append(np.unique(np.r_[key, key - 1], return_counts=True))
        regions, at = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
        return regions, np.bincount(at, np.concatenate([c for _, c in parts])).astype(np.int64)

    def find(self, text: np.ndarray, grams: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item number, edits, start, end) of the best occurrence of each item that is in the text."""
        found: dict[int, tuple[int, int, int]] = {}
        for n, c in self.short:
            where = np.flatnonzero(text[: max(0, len(text) - len(c) + 1)] == c[0])
            at = next((x for x in where.tolist() if np.array_equal(text[x : x + len(c)], c)), None)
            if at is not None:
                found[n] = (0, at, at + len(c))
        hit = np.flatnonzero(self.map[grams >> np.uint64(64 - _BITS)])
        if len(hit):
            k = np.searchsorted(self.gram, grams[hit])
            k[k == len(self.gram)] = 0
            ok = self.gram[k] == grams[hit]
            hit, k = hit[ok], k[ok]
        if len(hit):
            regions, counts = self._regions(hit, k)
            item = regions >> np.int64(40)
            region = counts >= self.least[item]
            for n, b in zip(item[region].tolist(), ((regions[region] & np.int64((1 << 40) - 1)) - (1 << 39)).tolist()):
                if n in found and found[n][0] == 0:
                    continue
                w, k = int(self.k[n]) + 1, int(self.k[n])
                code = self.rows[n][1]
                here = banded_distance(code, text, b * w, (b + 2) * w - 1, k) if k else _exact(code, text, b, b + 1)
                if here and (n not in found or here < found[n]):
                    found[n] = here
        return [(n, *v) for n, v in found.items()]


def _exact(item: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int] | None:
    return next(((0, s, s + len(item)) for s in range(max(0, low), high + 1) if np.array_equal(text[s : s + len(item)], item)), None)


def blocks(benchmark: DataFrame, chars: int = BLOCK_CHARS):
    """The benchmark's (item_id, text) rows in blocks of at most ``chars`` characters, one item at least."""
    rows, size = [], 0
    for r in benchmark.where("text is not null and text <> ''").select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        if rows and size + len(r[1]) > chars:
            yield rows
            rows, size = [], 0
        rows.append((r[0], r[1]))
        size += len(r[1])
    if rows:
        yield rows


def _scan(block, ids: list, column) -> list[tuple]:
    out = []
    ts = texts(column)
    for lo, hi in slices(ts):
        strs = [t.decode() for t in ts[lo:hi]]
        codes = _codes("".join(strs))
        grams = _grams(codes) if len(codes) >= Q else np.empty(0, np.uint64)
        at = 0
        for i, t in zip(range(lo, hi), strs):
            end = at + len(t)
            for n, edits, s, e in block.find(codes[at:end], grams[at : max(at, end - Q + 1)]):
                out.append((ids[i], block.rows[n][0], edits, s, e, len(block.rows[n][1])))
            at = end
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, edits, start, end (code points of the whole text), item_chars: the best occurrence of each item.

    Null and empty texts and items match nothing; repeated rows each give theirs; an empty benchmark gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, edits int, start long, end long, item_chars long"
    out = None
    for rows in blocks(benchmark):
        shared = spark.sparkContext.broadcast(rows)

        def run(batches, shared=shared):
            block = Items(shared.value)
            for batch in batches:
                got = list(zip(*_scan(block, batch.column(0).to_pylist(), batch.column(1)))) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(got, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "item_id", "edits", "start", "end", "item_chars"])

        part = docs.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no item; judged row by row."""
    for rows in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(rows)

        def run(batches, shared=shared):
            block = Items(shared.value)
            for batch in batches:
                bad = {r[0] for r in _scan(block, list(range(batch.num_rows)), batch.column("text"))}
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op9_qgram_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
