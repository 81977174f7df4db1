"""Quality: co-training of a text-content and a page-metadata classifier.

The content view sees which words a text has and its layout (lines, punctuation, capitals, digits, separators), the
metadata view what stands beside it: language, source and the stated size. Both are logistic regressions on hashed
features, so no value is left out however many there are. In each round all documents without a label in the sample are scored
on the executors; where a view is sure, its verdict is a pseudo-label for the other view. These enter the next fit
as sums over all of them: gradient and curvature of their loss at the view's present weights, whose sizes are fixed and
which do not depend on how documents are dealt. A held-out part of the labels calibrates each view and the sum of the two.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear, sample
from .common import collect_bounded, table, texts
from .linear import sigmoid
from .sample import raw

MOST_LABELLED = 6_000
BITS = (16, 12)
SLOTS = 1 << 12
ROUNDS = 2
SURE = 0.95
KEEP = 0.5


def layout(text: bytes) -> list[str]:
    """Binned layout of a text: logarithm of its length, mean line length, shares of punctuation, capitals, digits, bars."""
    n = max(len(text), 1)
    lines = text.count(b"\n") + 1
    runs = len(text.split())
    share = lambda k: round(20 * k / n) if k / n < 0.2 else 4 + round(5 * k / n)
    upper = len(text) - len(text.translate(None, bytes(range(65, 91))))
    digit = len(text) - len(text.translate(None, b"0123456789"))
    odd = len(text) - len(text.translate(None, b"!#$%&*+<=>@^_`{|}~"))
    bars = text.count(b" | ")
    return [f"len={int(math.log2(n))}", f"line={int(math.log2(max(1, n // lines)))}", f"word={min(20, n // max(runs, 1))}", f"upper={share(upper)}", f"digit={share(digit)}", f"odd={share(odd)}", f"bars={min(9, 100 * bars // max(runs, 1) // 3)}"]


def content(text: bytes) -> np.ndarray:
    """The content view's features: slots of distinct words and of the layout."""
    mask = (1 << BITS[0]) - 1
    return np.unique(np.array([zlib.crc32(w) & mask for w in {*raw(text), *(b"\0" + x.encode() for x in layout(text))}], np.int32))


def metadata(lang, source, size) -> np.ndarray:
    """The metadata view's features; null columns are a value of their own."""
    mask = (1 << BITS[1]) - 1
    size = "none" if size is None else int(2 * math.log2(max(1, size)))
    return np.unique(np.array([zlib.crc32(x.encode()) & mask for x in (f"lang={lang}", f"source={source}", f"size={size}", f"lang,size={lang},{size}")], np.int32))


def quality_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, good), one row per labelled id: repeated labels count by the worst. Null quality is no label."""
    return labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("good"))


def _meta(docs: DataFrame) -> list:
    own = lambda c, kind: (F.col(c) if c in docs.columns else F.lit(None)).cast(kind).alias(c)
    return [own("lang", "string"), own("source", "string"), own("n_chars", "long")]


def _labelled(docs: DataFrame, chosen: DataFrame, most: int) -> dict:
    """doc_id, good and both views' features of the sample's rows."""
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_meta(docs), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def run(batches):
        for batch in batches:
            lang, source, size = (batch.column(c).to_pylist() for c in ("lang", "source", "n_chars"))
            a = [content(t).tobytes() for t in texts(batch.column("text"))]
            b = [metadata(*x).tobytes() for x in zip(lang, source, size)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("good"), pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["doc_id", "good", "a", "b"])

    got = collect_bounded(picked.mapInArrow(run, "doc_id long, good int, a binary, b binary"), 64 * most, "sample")
    return got.sort_by([("doc_id", "ascending"), ("a", "ascending"), ("b", "ascending")]).to_pydict()


def _pseudo(docs: DataFrame, models, scales, known: set) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each view the other's pseudo-labels over all documents not in ``known``: their number by class, and by class and
    slot (the last is the intercept) the gradient and curvature of their loss at the view's weights."""
    shared = docs.sparkSession.sparkContext.broadcast((models, scales, known))
    sizes = [(1 << bits) + 1 for bits in BITS]

    def run(batches):
        models, scales, known = shared.value
        total = [np.zeros((2, 2, m)) for m in sizes]  # gradient and curvature, class, slot
        count = np.zeros((2, 2))
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "lang", "source", "n_chars")]
            for doc, lang, source, size, t in zip(*columns, texts(batch.column("text"))):
                if doc in known:
                    continue
                at = content(t), metadata(lang, source, size)
                z = [w[x].sum() + c for x, (w, c) in zip(at, models)]
                p = [sigmoid(k * v + o) for v, (k, o) in zip(z, scales)]
                for v in (0, 1):
                    sure = p[1 - v]
                    if sure > SURE or sure < 1 - SURE:
                        y, mine = int(sure > 0.5), sigmoid(z[v])
                        slots = np.append(at[v], sizes[v] - 1)
                        total[v][0, y, slots] += mine - y
                        total[v][1, y, slots] += mine * (1 - mine)
                        count[v, y] += 1
        for v in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array([v]), pa.array([-1]), pa.array([count[v].tobytes()], pa.binary())], ["view", "k", "sums"])
            for k in range(0, sizes[v], SLOTS):
                part = total[v][:, :, k : k + SLOTS]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([v]), pa.array([k]), pa.array([np.ascontiguousarray(part).tobytes()], pa.binary())], ["view", "k", "sums"])

    def add(t: pa.Table) -> pa.Table:
        sums = np.sum([np.frombuffer(x) for x in t["sums"].to_pylist()], axis=0)
        return pa.table({"view": t["view"].slice(0, 1), "k": t["k"].slice(0, 1), "sums": pa.array([sums.tobytes()], pa.binary())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_meta(docs), F.col("text").cast("string").alias("text")).mapInArrow(run, "view long, k long, sums binary")
    got = collect_bounded(rows.groupBy("view", "k").applyInArrow(add, "view long, k long, sums binary"), 64, "pseudo-labels")
    total, count = [np.zeros((2, 2, m)) for m in sizes], np.zeros((2, 2))
    for v, k, x in zip(got["view"].to_pylist(), got["k"].to_pylist(), got["sums"].to_pylist()):
        x = np.frombuffer(x)
        if k < 0:
            count[v] = x
        else:
            total[v][:, :, k : k + SLOTS] = x.reshape(2, 2, -1)
    return [(count[v], total[v][0], total[v][1]) for v in (0, 1)]


def _fitted(at, y: np.ndarray, m: int, pseudo=None, before=None, l2: float = 2.0, steps: int = 150) -> tuple[np.ndarray, float]:
    """Logistic regression on labelled rows and, around the weights ``before``, the quadratic loss of pseudo-labels. Of
    these each class weighs half as much as its labels, however many there are."""
    n = len(y)
    w = np.zeros(m + 1)
    w[m] = np.log((y.sum() + 1) / (n - y.sum() + 1))
    g, h = np.zeros(m + 1), np.zeros(m + 1)
    if pseudo is not None:
        count, slope, curve = pseudo
        for c in (0, 1):
            if count[c]:
                share = 0.5 * float((y == c).sum()) / count[c]
                g, h = g + share * slope[c], h + share * curve[c]
        start = np.append(*before)
    else:
        start = w
    rows, cols = np.r_[at[0], np.arange(n)], np.r_[at[1], np.full(n, m)]
    per_row = np.sqrt(np.bincount(rows, minlength=n).max(initial=1))
    reach = np.maximum(np.bincount(cols, minlength=m + 1), 1) * 0.25 * per_row + h + l2  # diagonal steps
    v, t = w.copy(), 1.0
    ridge = np.append(np.full(m, l2), 0)
    for _ in range(steps):
        err = sigmoid(np.bincount(rows, v[cols], n)) - y
        slope = np.bincount(cols, err[rows], m + 1) + g + h * (v - start) + ridge * v
        new = v - slope / reach
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t = new + (t - 1) / nt * (new - w), new, nt
    return w[:m], float(w[m])


def fit(docs: DataFrame, labels: DataFrame, labelled: int = MOST_LABELLED, rounds: int = ROUNDS) -> dict:
    """The calibrated model from at most ``labelled`` labelled rows, chosen by a hash of the id, and all other documents.

    Without labels of both kinds the model gives every document the labels' mean, or 0.5 without any.
    """
    got = _labelled(docs, sample.chosen(quality_labels(labels), labelled), labelled)
    y = np.array(got["good"], float)
    held = np.array([zlib.crc32(str(i).encode()) % 4 == 0 for i in got["doc_id"]], bool)
    sizes = [1 << bits for bits in BITS]
    if not len(y) or any(y[part].size == 0 or y[part].min() == y[part].max() for part in (held, ~held)):
        rate = float(y.mean()) if len(y) else 0.5
        return {"views": [(np.zeros(m), 0.0) for m in sizes], "scales": [(0.0, 0.0)] * 2, "both": (0.0, float(np.log((rate + 1e-3) / (1 - rate + 1e-3))))}
    known, at = set(got["doc_id"]), [linear.csr([np.frombuffer(x, np.int32) for x in got[c]]) for c in "ab"]

    def of(v, keep):
        to = np.cumsum(keep) - 1
        ok = keep[at[v][0]]
        return to[at[v][0][ok]], at[v][1][ok]

    def scales(models):
        z = [linear.times(of(v, held), w, int(held.sum())) + c for v, (w, c) in enumerate(models)]
        return z, [linear.platt(x, y[held]) for x in z]

    models = [_fitted(of(v, ~held), y[~held], sizes[v]) for v in (0, 1)]
    for _ in range(rounds):
        pseudo = _pseudo(docs, models, scales(models)[1], known)
        models = [_fitted(of(v, ~held), y[~held], sizes[v], pseudo[v], models[v]) for v in (0, 1)]
    z, scale = scales(models)
    total = sum(a * v + b for v, (a, b) in zip(z, scale))
    return {"views": models, "scales": scale, "both": linear.platt(total, y[held])}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, p_content, p_metadata, quality, keep for every row, repeats included; one scan, no shuffle.

    Null and empty texts have no words. The broadcast model has a weight for each slot, whatever the data.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        (wa, ca), (wb, cb) = m["views"]
        for batch in batches:
            lang, source, size = (batch.column(c).to_pylist() for c in ("lang", "source", "n_chars"))
            a = np.array([wa[content(t)].sum() for t in texts(batch.column("text"))], float) + ca
            b = np.array([wb[metadata(*x)].sum() for x in zip(lang, source, size)], float) + cb
            za, zb = (s * z + c for z, (s, c) in zip((a, b), m["scales"]))
            p = np.round(sigmoid(m["both"][0] * (za + zb) + m["both"][1]), 6)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.round(sigmoid(za), 6)), pa.array(np.round(sigmoid(zb), 6)), pa.array(p), pa.array(p >= KEEP)], ["doc_id", "p_content", "p_metadata", "quality", "keep"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_meta(docs), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, p_content double, p_metadata double, quality double, keep boolean")


def op10_cotraining_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
