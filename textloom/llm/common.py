"""Shared helpers: table access, shared-folder materialisation and vectorised text hashing."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
SIMILARITY = 0.75
_SAVED: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder; 250 rows a batch bound Arrow memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "250")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or in local mode a fresh temporary one."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="textloom-")
        sc.setCheckpointDir(where)
        where = sc.getCheckpointDir()
    return where


def save(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back. Removed by discard(), or when Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _SAVED[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def _delete(path: str) -> None:
    spark = _SAVED.pop(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(*saved: DataFrame) -> None:
    """Delete what save() wrote for these frames, which nothing may read any more, and settle()."""
    for df in saved:
        if getattr(df, "_saved_at", None) in _SAVED:
            _delete(df._saved_at)
    settle(saved[0].sparkSession)


def settle(spark: SparkSession) -> None:
    """Let Spark drop the shuffles of plans that are done: it does so when the driver's garbage is collected."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark._jvm.System.gc()


def clear_saved() -> None:
    """Delete all that save() has written so far; frames that read it must no longer be needed."""
    for path, spark in list(_SAVED.items()):
        if spark.sparkContext._jsc is None:  # the session has ended: the folder is then the cluster's to clean
            _SAVED.pop(path)
        else:
            _delete(path)


def _at_exit() -> None:
    """The session may end while this runs; what is left is then the cluster's to clean."""
    with contextlib.suppress(Exception):
        clear_saved()


atexit.register(_at_exit)


def collect_bounded(df: DataFrame, most: int, what: str) -> pa.Table:
    """Bring a table whose size is bounded by construction to the driver; more rows than the bound is an error."""
    got = df.limit(most + 1).toArrow()
    if got.num_rows > most:
        raise ValueError(f"{what}: more than {most} rows")
    return got


def ascii_lower(col):
    """A-Z to a-z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (public splitmix64 constants)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_BASE = np.uint64(0x2545F4914F6CDD1D)
_INVERSE = np.uint64(pow(0x2545F4914F6CDD1D, -1, 1 << 64))
_STEP = np.uint64(0x9E3779B97F4A7C15)
SLICE = 1 << 20


class Words:
    """64-bit hashes of the words of many texts at once.

    Words are the runs between ASCII white space, A-Z lowered. A word's hash is a polynomial in its bytes,
    taken from prefix sums modulo 2^64 and mixed with its length; nothing is cached between texts.
    """

    def __init__(self):
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.blank = np.zeros(256, bool)
        self.blank[[32, *range(9, 14)]] = True
        self.power = self.inverse = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, SLICE + 4096)
            with np.errstate(over="ignore"):
                self.power = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _BASE)], dtype=np.uint64)
                self.inverse = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _INVERSE)], dtype=np.uint64)

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in order, and where each text's begin (one more than texts)."""
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        ends_of = np.cumsum([len(t) + 1 for t in texts])
        self._powers(len(data) + 1)
        blank = self.blank[data]
        word = np.r_[False, ~blank]
        starts = np.flatnonzero(~word[:-1] & word[1:])
        ends = np.flatnonzero(word[1:-1] & ~word[2:]) + 1
        sums = np.cumsum((self.lower[data].astype(np.uint64) + np.uint64(1)) * self.power[: len(data)], dtype=np.uint64)
        sums = np.r_[np.uint64(0), sums]
        h = (sums[ends] - sums[starts]) * self.inverse[starts]
        return mix(h + (ends - starts).astype(np.uint64) * _STEP), np.searchsorted(starts, np.r_[0, ends_of])


def slices(texts: list[bytes]):
    """Runs (from, to) of texts of about SLICE bytes, one text at least."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > SLICE:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def shingle_sets(texts: list[bytes], words: Words, w: int = SHINGLE):
    """For each text the sorted distinct 64-bit hashes of its w-word shingles.

    Fewer than w words: the whole sequence is the one shingle. No words: none.
    """
    for lo, hi in slices(texts):
        h, cut = words.of(texts[lo:hi])
        acc = np.full(max(0, len(h) - w + 1), np.uint64(w))
        for i in range(w if len(acc) else 0):
            acc = acc * _STEP + h[i : i + len(acc)]
        acc = mix(acc)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            if b - a >= w:
                s = np.sort(acc[a : b - w + 1])
                yield s[np.r_[True, s[1:] != s[:-1]]] if len(s) > 1 else s
            elif b > a:
                one = np.full(1, np.uint64(b - a))
                for i in range(a, b):
                    one = one * _STEP + h[i]
                yield mix(one)
            else:
                yield np.empty(0, np.uint64)
