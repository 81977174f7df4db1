"""Toxicity: cumulative-link ordinal regression on sparse text features.

Severity grades 0, 1, 2 come from the labels: 0 clean, 1 toxic, 2 toxic and of low quality. One weight vector
serves all ordered thresholds: ``P(grade >= k) = sigmoid(w.x - theta_k)``. Features are the presence of words
(ASCII punctuation removed, A-Z lowered), of their first STEM bytes, as many languages inflect, and of such that
several words share. The L1 penalty is the one of PENALTIES under which labelled rows kept out of the fit are
likeliest; a text is rejected from the expected severity on that parts those rows best. Weights are never negative, so lacking clean words, as an
empty text does, is no evidence. Expected severity is the sum of ``P(grade >= k)``.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear, sample
from .common import collect_bounded, table, texts
from .linear import sigmoid
from .sample import folded

MOST_LABELLED = 8_000
LEAST = 4
SCREENED = 4_000
STEM = 5
PENALTIES = (1e-4, 3e-4, 1e-3)
REJECT = 0.5
BETA = 0.5
FOLDS = 5


def stemmed(text: bytes) -> set[bytes]:
    """Distinct words without ASCII punctuation, A-Z lowered; the first STEM bytes of longer ones, marked by a zero byte; and
    those that several distinct words begin with, marked by a one."""
    words = folded(text)
    once, again = set(), set()
    for w in words:
        if len(w) > STEM:
            w = w[:STEM]
            (again if w in once else once).add(w)
    return words | {b"\0" + w for w in once} | {b"\1" + w for w in again}


def severity_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, grade), one row per labelled id: repeated labels count by the worst. Null toxic labels are no labels."""
    toxic, low = F.max(F.col("toxic").cast("int")), F.min(F.coalesce(F.col("quality").cast("int"), F.lit(1)))
    one = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(toxic.alias("t"), low.alias("q"))
    return one.select("doc_id", F.when(F.col("t") == 0, 0).when(F.col("q") == 0, 2).otherwise(1).alias("grade"))


def fit_ordinal(at, grade: np.ndarray, m: int, grades: int, l1: float = 3e-4, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights, none negative, and ascending thresholds by accelerated proximal gradient descent on the likelihood."""
    n = len(grade)
    share = np.array([(grade >= k).mean() if n else 0.0 for k in range(1, grades)])
    share = np.clip(share, 1e-4, 1 - 1e-4)
    theta = np.maximum.accumulate(-np.log(share / (1 - share)) + 1e-3 * np.arange(grades - 1))
    w = np.zeros(m)
    if not n or not m or grade.min() == grade.max():
        return w, theta
    step = 1 / (0.25 * (1 + np.bincount(at[0], minlength=n).mean()))
    v, th, t = w.copy(), theta.copy(), 1.0
    for _ in range(steps):
        z = linear.times(at, v, n)
        up = np.concatenate([np.ones((1, n)), linear.sigmoid(z - th[:, None]), np.zeros((1, n))])
        slope = up * (1 - up)
        p = np.maximum(up[grade, np.arange(n)] - up[grade + 1, np.arange(n)], 1e-9)
        a, b = slope[grade, np.arange(n)], slope[grade + 1, np.arange(n)]
        g = -(a - b) / p / n
        gt = np.array([(np.where(grade == k, a / p, 0) - np.where(grade == k - 1, b / p, 0)).sum() / n for k in range(1, grades)])
        nw = v - step * linear.times_t(at, g, m)
        nw = np.maximum(nw - step * l1, 0)
        nth = np.maximum.accumulate(th - gt + np.r_[0, np.full(grades - 2, 1e-9)])
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, th, w, theta, t = nw + (t - 1) / nt * (nw - w), nth, nw, nth, nt
    return w, theta


def _linear(ts: list[bytes], weights: dict[bytes, float]) -> np.ndarray:
    known = weights.keys()
    return np.array([sum(weights[w] for w in known & stemmed(t)) for t in ts], float)


def _severity(z: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(grade >= k) for each k, and the expected severity."""
    up = np.round(sigmoid(z[None, :] - theta[:, None]), 6)
    return up, np.round(up.sum(axis=0), 6)


def _rows_of(at, keep: np.ndarray):
    """The features of the rows kept, numbered anew."""
    to = np.cumsum(keep) - 1
    ok = keep[at[0]]
    return to[at[0][ok]], at[1][ok]


def _cut(severity: np.ndarray, grade: np.ndarray) -> float:
    """The severity that parts toxic rows from others best, by F-measure: half way between the last row above it and the next
    below, precision counting 1 / BETA times as much as recall; REJECT if there are no toxic rows."""
    by = np.argsort(-severity, kind="stable")
    s, good = severity[by], np.cumsum(grade[by] > 0)
    if not len(s) or not good[-1]:
        return REJECT
    f1 = np.where(np.r_[s[1:] != s[:-1], True], (1 + BETA**2) * good / (np.arange(1, len(s) + 1) + BETA**2 * good[-1]), -1)
    k = int(np.flatnonzero(f1 == f1.max())[-1])
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k])


def _telling(rows: DataFrame) -> list[bytes]:
    """The SCREENED words, in LEAST rows at least, whose rows' share of toxic ones lies farthest from that of all."""
    rate = rows.agg(F.avg((F.col("grade") > 0).cast("double"))).first()[0] or 0.0
    words = rows.select((F.col("grade") > 0).cast("long").alias("bad"), F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"), F.sum("bad").alias("bad"))
    far = F.round(F.abs(F.col("bad") - rate * F.col("df")) / F.sqrt("df"), 9)
    return collect_bounded(words.where(F.col("df") >= LEAST).orderBy(far.desc(), "word").limit(SCREENED), SCREENED, "words").sort_by([("word", "ascending")])["word"].to_pylist()


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> tuple[dict[bytes, float], np.ndarray, float]:
    """Word weights, thresholds and the severity from which texts are rejected, from at most ``most`` labelled rows, chosen by
    a hash of the id; a FOLDS-th of them chooses penalty and cut. No usable labels or too few to keep
    some out: no weights."""
    rows = sample.word_rows(docs.select("doc_id", "text"), sample.chosen(severity_labels(labels), most), stemmed)
    vocab = _telling(rows)
    got, feats = sample.features(rows, vocab, most)
    grade = np.array(got["grade"], np.int64)
    n, m = len(grade), len(vocab)
    at = linear.csr(feats)
    if not n or not m:
        return {}, fit_ordinal(at, grade, m, 3)[1], REJECT
    out = np.array([zlib.crc32(str(i).encode()) % FOLDS == 0 for i in got["doc_id"]])
    if out.all() or not out.any():
        return {}, fit_ordinal(at, grade, m, 3)[1], REJECT
    best, model = -np.inf, ({}, np.zeros(2), REJECT)
    for penalty in PENALTIES:
        w, theta = fit_ordinal(_rows_of(at, ~out), grade[~out], m, 3, penalty)
        up, severity = _severity(linear.times(_rows_of(at, out), w, int(out.sum())), theta)
        steps = np.concatenate([np.ones((1, out.sum())), up, np.zeros((1, out.sum()))])
        k = np.arange(int(out.sum()))
        likely = np.log(np.maximum(steps[grade[out], k] - steps[grade[out] + 1, k], 1e-6)).sum()
        if likely > best:
            best, model = likely, ({vocab[k]: float(x) for k, x in enumerate(w) if x}, theta, _cut(severity, grade[out]))
    return model


def score(docs: DataFrame, weights: dict[bytes, float], theta: np.ndarray, cut: float = REJECT) -> DataFrame:
    """doc_id, p_toxic, p_severe, expected_severity, rejected for every row, repeats included; one scan, no shuffle.

    Null, empty and wordless texts score as a text without features. Weights are at most SCREENED words.
    """
    model = docs.sparkSession.sparkContext.broadcast((weights, theta))

    def run(batches):
        weights, theta = model.value
        for batch in batches:
            up, severity = _severity(_linear(texts(batch.column(1)), weights), theta)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, up), pa.array(severity), pa.array(severity >= cut)], ["doc_id", "p_toxic", "p_severe", "expected_severity", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, p_toxic double, p_severe double, expected_severity double, rejected boolean")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose own text is not rejected; judged row by row, also for repeated or null ids."""
    weights, theta, cut = fit(docs, labels)
    model = docs.sparkSession.sparkContext.broadcast((weights, theta))

    def run(batches):
        weights, theta = model.value
        for batch in batches:
            yield batch.filter(pa.array(_severity(_linear(texts(batch.column("text")), weights), theta)[1] < cut))

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity_severity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, *fit(docs, table(spark, sf_dir, "labels")))
