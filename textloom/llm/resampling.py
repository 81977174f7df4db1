"""Importance resampling towards a target: overlap chunks, hashed word runs, Gumbel noise and an exact draw.

Each text is cut into chunks at word boundaries. A chunk owns the words that begin in it and carries the next n - 1 words,
so that every run of up to n words is counted by the one chunk that owns its first word. Chunks of long texts are dealt
out over the cluster, so a text's length bounds no task; counts and weights of chunks are summed by document. Bucket
totals are at most BUCKETS rows; nothing else reaches the driver.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import numbered
from .common import collect_bounded, save, table, texts

N = 1
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: Bytes of a chunk, and from how many bytes on a text's chunks are dealt out.
CHUNK = 1 << 20
KNOWN = 500_000
SUMS = ("n_words", "n_features", "weight")
#: A-Z lowered; every other ASCII character but digits and a-z ends a word.
_FOLD = bytes(i if 48 <= i < 58 or 97 <= i < 123 or i > 127 else i + 32 if 65 <= i < 91 else 32 for i in range(256))


def cut(text: bytes, n: int, size: int = CHUNK):
    """(owned words, chunk) of a text: chunks of about ``size`` bytes that end where a word ends, and carry the next n - 1
    words, which ``owned`` does not count. A text has one chunk at least; a word longer than ``size`` stays whole."""
    folded, at = text.translate(_FOLD), 0
    while at < len(folded) or not at:
        end = folded.find(b" ", at + size) if at + size < len(folded) else -1
        end = len(folded) if end < 0 else end
        own = len(folded[at:end].split())
        carry, upto, step = 0, end, 16
        while carry < n - 1 and upto < len(folded):  # the next words, looked for in doubling steps
            upto, step = folded.find(b" ", upto + step), 2 * step
            upto = len(folded) if upto < 0 else upto
            carry = len(folded[end:upto].split())
        yield own, b" ".join([*folded[at:end].split(), *folded[end:upto].split()[: n - 1]])
        at = max(end, 1)


class Buckets:
    """Bucket numbers of the word runs that begin at a chunk's own words; numbers of KNOWN single words are remembered."""

    def __init__(self, n: int, buckets: int):
        self.n, self.buckets, self.known = n, buckets, {}

    def of(self, own: int, chunk: bytes) -> np.ndarray:
        words = chunk.split()
        if len(self.known) > KNOWN:
            self.known = {}
        known = self.known
        for w in set(words[:own]).difference(known):
            known[w] = zlib.crc32(w) % self.buckets
        out = [np.fromiter(map(known.__getitem__, words[:own]), np.int64, own)]
        for k in range(2, self.n + 1):
            out.append(np.array([zlib.crc32(b" ".join(words[i : i + k])) % self.buckets for i in range(min(own, len(words) - k + 1))], np.int64))
        return np.concatenate(out)


def chunks(docs: DataFrame, columns: list[str], n: int, text_col: str = "text", size: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """``columns``, own, chunk of the texts of up to ``size`` bytes, one row each where they are read, and of the chunks of
    longer ones, with ``row`` to tell their documents apart, dealt out over the cluster. Null counts as empty."""
    rows = docs.select(*columns, F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    names = [*columns, "row"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema) + ", own long, chunk binary"

    def run(batches):
        for batch in batches:
            at, parts, size_now = [], [], 0
            for i, t in enumerate(texts(batch.column("_text"))):
                for part in cut(t, n, size):
                    at.append(i)
                    parts.append(part)
                    size_now += len(part[1])
                    if size_now > 16 * size:
                        yield give(batch, at, parts)
                        at, parts, size_now = [], [], 0
            yield give(batch, at, parts)

    def give(batch, at, parts):
        taken = batch.take(pa.array(at, pa.int64()))
        own, found = pa.array([k for k, _ in parts], pa.int64()), pa.array([c for _, c in parts], pa.binary())
        return pa.RecordBatch.from_arrays([*(taken.column(c) for c in names), own, found], [*names, "own", "chunk"])

    long = F.octet_length("_text") > size
    return rows.where(~long).mapInArrow(run, schema).drop("row"), rows.where(long).mapInArrow(run, schema).repartition("row", F.xxhash64("chunk"))


def totals(short: DataFrame, long: DataFrame, n: int, buckets: int) -> np.ndarray:
    """Features of all chunks by bucket; each task sends one row a bucket at most."""

    def run(batches):
        of, sums = Buckets(n, buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for own, chunk in zip(batch.column("own").to_pylist(), batch.column("chunk").to_pylist()):
                sums += np.bincount(of.of(own, chunk), minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["bucket", "n"])

    rows = short.unionByName(long.drop("row")).select("own", "chunk").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    got = collect_bounded(rows, buckets, "buckets")
    out = np.zeros(buckets, np.int64)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed bucket shares, target over source)."""
    b, s_all, t_all = float(len(source)), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + b) / ((s + 1.0) * (t_all + b)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weighted(docs: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS, size: int = CHUNK, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight of every row of ``docs``, saved; texts without words have zeros."""
    gain = gains(totals(*chunks(docs, [], n, text_col, size), n, buckets), totals(*chunks(target, [], n, target_text, size), n, buckets))
    gain = docs.sparkSession.sparkContext.broadcast(gain)

    def judged(parts: DataFrame) -> DataFrame:
        names = [c for c in parts.columns if c not in ("own", "chunk")]

        def run(batches):
            of = Buckets(n, buckets)
            for batch in batches:
                found = [of.of(own, chunk) for own, chunk in zip(batch.column("own").to_pylist(), batch.column("chunk").to_pylist())]
                counts, sums = pa.array([len(f) for f in found], pa.int64()), pa.array([int(gain.value[f].sum()) for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), batch.column("own"), counts, sums], [*names, *SUMS])

        return parts.mapInArrow(run, ", ".join(f"{c} long" for c in [*names, *SUMS]))

    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    short, long = chunks(ids, ["doc_id"], n, "text", size)
    whole = judged(long).groupBy("row", "doc_id").agg(*(F.sum(c).alias(c) for c in SUMS)).drop("row")
    return save(judged(short).unionByName(whole), "weights")


def draw(weights: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """weights with score (weight plus Gumbel noise of a hash of seed and id, a null id counting as empty) and rank.

    Of the N rows with at least ``least_words`` words the floor(percent N / 100) of highest score have ranks from 1, ties
    going to the smaller id (null first), then to more features; rows that tie in all of these are alike. Others have null.
    """
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = weights.withColumn("score", F.col("weight") + noise)
    able = numbered(scored.where(F.col("n_words") >= least_words), F.desc("score"), F.asc("doc_id"), F.desc("n_features"))
    most = able.count() * percent // 100
    able = able.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    return able.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, n: int = N, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` drawn towards ``target``, with all their columns; ids must be unique and not null."""
    drawn = draw(weighted(docs, target, n), percent, seed=seed).where("rank is not null").select(F.col("doc_id").alias("_id"))
    return docs.join(drawn, F.col("doc_id").cast("long") == F.col("_id"), "left_semi")


def op11_overlap_resampling(spark, sf_dir):
    """doc_id, n_features, weight, score, rank of every document, drawn towards the benchmark's words.

    Null and empty texts: no features, weight 0, never drawn. Repeated rows are each judged and may both be drawn. Ties go
    to the smaller id. An empty documents table gives no rows; an empty benchmark gives every bucket t = 0. Extra columns
    are not read.
    """
    weights = weighted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return draw(weights).select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 of a text, by a table of 256 remainders made in SQL; ``crc`` holds (w, crc) of the texts in ``texts`` (w).
CRC_SQL = """tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i::UBIGINT], range(8)::UBIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END)) AS t),
hexed AS (SELECT w, hex(encode(w)) AS x FROM texts),
crc AS MATERIALIZED (SELECT w, xor(4294967295::UBIGINT, list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::INT, 2))::UBIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::INT + 1]))) AS crc FROM hexed, tab)"""
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""WITH docw AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS ws FROM documents), benw AS (SELECT {_WORDS} AS ws FROM benchmark),
ds AS MATERIALIZED (SELECT row, unnest(ws) AS w FROM docw), bs AS MATERIALIZED (SELECT unnest(ws) AS w FROM benw), texts AS (SELECT w FROM ds UNION SELECT w FROM bs), {CRC_SQL},
bucket AS MATERIALIZED (SELECT w, (crc % {BUCKETS})::INT AS b FROM crc), s AS (SELECT b, count(*) AS s FROM ds JOIN bucket USING (w) GROUP BY 1), t AS (SELECT b, count(*) AS t FROM bs JOIN bucket USING (w) GROUP BY 1),
allb AS (SELECT x.b, coalesce(s, 0)::DOUBLE AS s, coalesce(t, 0)::DOUBLE AS t FROM (SELECT DISTINCT b FROM bucket) x LEFT JOIN s ON s.b = x.b LEFT JOIN t ON t.b = x.b),
gain AS MATERIALIZED (SELECT b, floor(1000 * ln((t + 1) * ((SELECT count(*) FROM ds) + {BUCKETS}.0::DOUBLE) / ((s + 1) * ((SELECT count(*) FROM bs) + {BUCKETS}.0::DOUBLE))))::BIGINT AS g FROM allb),
weights AS (SELECT row, sum(g)::BIGINT AS weight FROM ds JOIN bucket USING (w) JOIN gain USING (b) GROUP BY 1),
scored AS (SELECT d.doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight, ('0x' || sha256('{SEED}:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT AS h FROM docw d LEFT JOIN weights USING (row)),
noisy AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS FIRST, n_features DESC) AS r, count(*) OVER (PARTITION BY n_features >= {LEAST_WORDS}) AS n FROM noisy)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {LEAST_WORDS} AND r <= n * {PERCENT} // 100 THEN r END AS rank FROM ranked"""
