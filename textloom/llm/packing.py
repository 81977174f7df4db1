"""Packing token sequences by cutting-stock column generation.

Documents are tokenised whole, an end id is added, and runs of 2 048 ids are cut off as full sequences. The
remainders are a cutting-stock problem: their lengths, in classes of sixteen tokens, give a histogram; a
linear program over patterns (how many pieces of each class share a sequence) is solved by column
generation, where a knapsack dynamic program prices the columns. Patterns are rounded down, the few pieces left
over are packed best fit first, and documents, ranked within their class, take the places in order.

The program sees 128 classes however much data there is. Ranks are counted in salted parts of a class, so
no class meets in one task. Only the histogram and the pattern table reach the driver.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import collect_bounded, save, table, texts

LENGTH = 2048
WIDTH = 16
END_ID = 1
SEPARATOR = "<|endoftext|>"
PART = 500_000
CACHE_WORDS = 600_000
#: Letters that composition leaves alone and whose lower case is one letter everywhere; U+0130 is not.
LATIN = re.compile("[a-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F]+")


class Tokens:
    """Ids of whole texts. White space always ends a token here and case is lost, so words are encoded once, lowered,
    and remembered.

    Of the remembered words the last CACHE_WORDS or so stay, in two generations, which bounds memory.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        size = self.tok.get_vocab_size()
        self.ends = np.array([(self.tok.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.raw = [i.to_bytes(4, "little") for i in range(size)]
        letters = "".join(filter(LATIN.fullmatch, map(chr, range(0x250)))).lower()
        split = self.tok.pre_tokenizer.pre_tokenize_str(",".join(["a", *letters]) + ".") if self.tok.pre_tokenizer else []
        self.spelt = {ord(c): x for c, (x, _) in zip(letters, split[2::2])}
        #: As the tokenizer splits them, words of these letters and one mark can go to its model directly.
        self.direct = [x for x, _ in split[1::2]] == [","] * len(letters) + ["."]
        self.marks = {"": b""} | {c: self._model(c) for c in ",." if self.direct}
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _model(self, piece: str) -> bytes:
        raw = self.raw
        return b"".join([raw[t.id] for t in self.tok.model.tokenize(piece)])

    def _learn(self, words: list[bytes]) -> None:
        """Encode the words: those of LATIN letters with or without one comma or full stop by the tokenizer's model, in
        about half the time; others many to a text. Letters with or without one comma or full stop are one or two pieces for
        the tokenizer, each of which ends in a token marked so; any other word has a special token around it.

        Normalisation may split letters (U+0130, U+095C) into more pieces, never into fewer. Where a run has more ends
        than expected, its words go the way of the others."""
        plain, other = [], []
        for w in words:
            s = w.decode()
            core = s[:-1] if s[-1] in ",." else s
            if self.direct and LATIN.fullmatch(core):
                self.known[w] = self._model(core if core.isascii() else core.lower().translate(self.spelt)) + self.marks[s[len(core) :]]
            elif core.isalpha():
                plain.append((w, s, 1 + (core is not s)))
            else:
                other.append((w, s))
        for i in range(0, len(plain), 500):
            run = plain[i : i + 500]
            ids = np.array(self.tok.encode(" ".join([s for _, s, _ in run]), add_special_tokens=False).ids, "<u4")
            marked, upto = np.flatnonzero(self.ends[ids]), np.cumsum([k for _, _, k in run])
            if len(marked) != upto[-1]:
                other += [(w, s) for w, s, _ in run]
                continue
            ends = marked[upto - 1].tolist()
            self._keep([w for w, _, _ in run], ids, [-1, *ends], [e + 1 for e in ends])
        for i in range(0, len(other), 500):
            run = other[i : i + 500]
            ids = np.array(self.tok.encode(SEPARATOR.join([s for _, s in run]) + SEPARATOR, add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(ids == self.tok.token_to_id(SEPARATOR)).tolist()
            self._keep([w for w, _ in run], ids, [-1, *ends], ends)

    def _keep(self, words: list[bytes], ids: np.ndarray, before: list[int], ends: list[int]) -> None:
        raw = ids.tobytes()
        for w, a, b in zip(words, before, ends):
            self.known[w] = raw[4 * a + 4 : 4 * b]

    @staticmethod
    def _words(text: bytes) -> list[bytes]:
        """Words with A-Z lowered, but for those with a mark of U+0300 to U+036F (first byte CC or CD): the tokenizer composes
        letter and mark before it lowers, and some marks compose with one case only."""
        if b"\xcc" not in text and b"\xcd" not in text:
            return text.lower().split()
        return [w if b"\xcc" in w or b"\xcd" in w else w.lower() for w in text.split()]

    def ids(self, batch: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text. Texts with special-token openers are encoded as they are."""
        if len(self.known) > CACHE_WORDS // 2:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        words = [() if b"<|" in t else self._words(t) for t in batch]
        here = dict.fromkeys(chain.from_iterable(words))
        missing = []
        for x in here:
            if (v := known.get(x)) is None:
                if (v := old.get(x)) is None:
                    missing.append(x)
                    continue
                known[x] = v
            here[x] = v
        self._learn(missing)
        for x in missing:
            here[x] = known[x]
        out = []
        for t, w in zip(batch, words):
            if b"<|" in t:
                out.append(np.array(self.tok.encode(t.decode(), add_special_tokens=False).ids, "<u4").tobytes())
            else:
                out.append(b"".join(map(here.__getitem__, w)))
        return out


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece, and the ids themselves if asked for.

    Null and empty texts have the end id alone. Repeated ids stay separate rows. One scan, no shuffle.
    """
    path = tokenizer or default_tokenizer()

    def run(batches):
        import os
        import sys
        import types
        import zlib

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        kept = sys.modules.setdefault("textloom_worker_cache", types.ModuleType("textloom_worker_cache")).__dict__
        tok = kept.setdefault(("tokens", path), None) or Tokens(path)
        kept[("tokens", path)] = tok
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows = [[] for _ in range(6)]
            docs_, ts = batch.column(0).to_pylist(), texts(batch.column(1))
            for at in range(0, len(ts), 100):
                for doc, got in zip(docs_[at : at + 100], tok.ids(ts[at : at + 100])):
                    got += end
                    n = len(got) // 4
                    for s in range(0, n, length):
                        piece = got[4 * s : 4 * (s + length)]
                        for c, v in zip(rows, (doc, s, len(piece) // 4, zlib.crc32(piece), n, piece if with_ids else None)):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in rows[:5]), *([pa.array(rows[5], pa.binary())] if with_ids else [])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids binary" if with_ids else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def knapsack(values: np.ndarray, weights: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best value and item counts of an unbounded integer knapsack (weights ascending)."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        k = np.searchsorted(weights, c, "right")
        best[c] = best[c - 1]
        if k:
            v = best[c - weights[:k]] + values[:k]
            i = int(np.argmax(v))
            if v[i] > best[c] + 1e-12:
                best[c], took[c] = v[i], i
    counts, c = np.zeros(len(weights), np.int64), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            counts[took[c]] += 1
            c -= weights[took[c]]
    return float(best[capacity]), counts


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-3) -> list[tuple[np.ndarray, int]]:
    """Patterns (pieces of each size) and how often each is used; together they hold the demand exactly.

    Revised simplex on the linear relaxation with knapsack pricing, to a relative gap; then rounding down and
    best fit for the rest. No sizes: no patterns.
    """
    sizes, demand = np.asarray(sizes, np.int64), np.asarray(demand, np.int64)
    m = len(sizes)
    if not m:
        return []
    basis = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / (capacity // sizes))
    x = inverse @ demand
    for _ in range(8 * m + 100):
        price = inverse.sum(axis=0)
        value, column = knapsack(price, sizes, capacity)
        if value <= 1 + 1e-9 or x.sum() * (1 - 1 / value) <= gap * x.sum():
            break
        d = inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(d > 1e-9, x / d, np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
        row = inverse[out] / d[out]
        inverse -= np.outer(d, row)
        inverse[out] = row
        x = np.maximum(inverse @ demand, 0)
    used: Counter = Counter()
    left = demand.copy()
    for i in np.argsort(-x):
        column = basis[:, i].astype(np.int64)
        has = column > 0
        times = int(min(np.floor(x[i] + 1e-6), (left[has] // column[has]).min()))
        if times > 0:
            used[tuple(column)] += times
            left -= times * column
    room: dict[int, list[np.ndarray]] = {}
    for i in range(m - 1, -1, -1):
        for _ in range(int(left[i])):
            r = next((r for r in range(int(sizes[i]), capacity + 1) if room.get(r)), None)
            p = room[r].pop() if r else np.zeros(m, np.int64)
            p[i] += 1
            room.setdefault((r or capacity) - int(sizes[i]), []).append(p)
    for ps in room.values():
        used.update(tuple(p) for p in ps)
    return [(np.array(p), c) for p, c in sorted(used.items(), reverse=True)]


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, width: int = WIDTH, part: int = PART, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece with its sequence_id and offset; see pieces(). An empty table gives no rows."""
    spark = docs.sparkSession
    cut = save(pieces(docs, tokenizer, length, id_col, text_col), "pieces")
    cut = cut.withColumn("class", F.ceil(F.col("length") / width))
    top = -(-length // width)
    counts = collect_bounded(cut.groupBy("class").count(), top, "classes").to_pydict()
    have = sorted(zip(counts["class"], counts["count"]))
    patterns = cutting_stock(np.array([c for c, _ in have]), np.array([n for _, n in have]), top)
    places, at, sequence = [], Counter(), 0
    for p, times in patterns:
        before = 0
        for i in np.flatnonzero(p):
            c, k = have[i][0], int(p[i])
            places.append((c, at[c], at[c] + k * times, sequence, k, before))
            at[c] += k * times
            before += k
        sequence += times
    places = spark.createDataFrame(places, "class long, lo long, hi long, first long, mult long, before long")
    parts = max(1, -(-sum(n for _, n in have) // part))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "start"), F.lit(parts)))
    ranked = cut.withColumn("rank", F.row_number().over(Window.partitionBy("class", "part").orderBy("doc_id", "start", "ids_crc32")))
    sizes = cut.groupBy("class", "part").count()
    sizes = sizes.withColumn("ahead", F.sum("count").over(Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = ranked.join(sizes.select("class", "part", F.coalesce("ahead", F.lit(0)).alias("ahead")), ["class", "part"])
    ranked = ranked.withColumn("slot", F.col("ahead") + F.col("rank") - 1)
    placed = ranked.join(F.broadcast(places), (ranked["class"] == places["class"]) & (ranked.slot >= places.lo) & (ranked.slot < places.hi))
    placed = placed.withColumn("sequence_id", F.expr("first + (slot - lo) div mult")).withColumn("place", F.expr("before + (slot - lo) % mult"))
    run = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(run), F.lit(0).cast("long")).alias("offset"))


def op8_cutting_stock_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
