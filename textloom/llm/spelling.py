"""Spelling variants: words one edit apart, found by their rarest positional bigrams.

The corpus vocabulary is counted in the tasks that read the texts. Bigrams are ordered by how many words' positions hold
them, rarest first. One edit spoils at most two bigrams of a word and keeps the others in order, so two words one edit apart
share one of each one's three rarest, at positions at most one apart. The edit then lies wholly left or right of the shared
bigram: the other side of the word is equal, and of the edited side either its first or its second half. These equal parts
are the join's keys, so a frequent bigram or beginning gathers only words that agree in most letters too, and Spark's
Levenshtein distance verifies each pair. Nothing but the bigrams' counts, at most LETTERS squared, reaches the driver: joins
are hinted to merge, since Spark's estimate of the keys' size takes no account of the rows that explode() makes of each
word, so that it would broadcast many times the threshold.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import collect_bounded, discard, save, table, texts
from .resampling import CRC_SQL

LEAST_LENGTH = 5
LEAST_COUNT = 3
TIMES = 2
TYPO = 97
RARE = 3
#: a-z and the 64 code points from U+00C0 on.
LETTERS = 26 + 64
SLICE = 1 << 20
HELD = 1_000_000


def runs(text: bytes, least: int):
    """Counters of the maximal letter runs of at least ``least`` code points, A-Z lowered, slice by slice of the text; the
    pattern needs slices that end where a run ends."""
    word = re.compile(rb"(?:[a-z]|\xC3[\x80-\xBF]){%d,}" % least)
    gap = re.compile(rb"[^a-z\x80-\xC3]")
    low, at = text.lower(), 0
    while at < len(low):
        cut = gap.search(low, at + SLICE) if at + SLICE < len(low) else None
        end = cut.start() if cut else len(low)
        yield Counter(word.findall(low, at, end))
        at = end


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, typo: int = TYPO, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n of the words of ``least_length`` code points at least that occur ``least_count`` times. With ``typo``, a run
    whose crc32 of ``<id>:<run>`` it divides lacks the code point at crc32 % length (from 0); 0 leaves all runs as they are.
    Null texts have none; a null id counts as empty."""

    def run(batches):
        held: Counter = Counter()

        def give():
            words = pa.array([w.decode() for w in held], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for i, t in zip(batch.column("i").to_pylist(), texts(batch.column("t"))):
                head = zlib.crc32(f"{i}:".encode())
                for found in runs(t, least_length):
                    changed = [(w, h) for w in found if (h := zlib.crc32(w, head)) % typo == 0] if typo else []
                    for w, h in changed:
                        n, s = found.pop(w), w.decode()
                        at = h % len(s)
                        if len(s) > least_length:
                            held[(s[:at] + s[at + 1 :]).encode()] += n
                    held.update(found)
                if len(held) > HELD:
                    yield give()
                    held.clear()
        yield give()

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def rarest(vocab: DataFrame) -> DataFrame:
    """vocab with ``rare``: where (from 0) each word's RARE rarest bigrams begin, by the number of places over all words
    that hold the bigram, the bigram, then the place."""
    grams = vocab.select(F.explode(F.expr("transform(sequence(0, length(word) - 2), i -> substring(word, i + 1, 2))")).alias("gram"))
    counts = collect_bounded(grams.groupBy("gram").agg(F.count("*").alias("n")), LETTERS**2, "bigrams").to_pydict()
    order = sorted(zip(counts["n"], counts["gram"]))
    rank = vocab.sparkSession.sparkContext.broadcast({g: r for r, (_, g) in enumerate(order)})

    def run(batches):
        for batch in batches:
            rare = []
            for w in batch.column("word").to_pylist():
                rare.append([i for _, i in heapq.nsmallest(RARE, ((rank.value[w[i : i + 2]], i) for i in range(len(w) - 1)))])
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(rare, pa.list_(pa.int32()))], ["word", "n", "rare"])

    return vocab.select("word", "n").mapInArrow(run, "word string, n long, rare array<int>")


def keyed(rare: DataFrame) -> DataFrame:
    """word, n, longer, key: one row for each rare bigram, side that the edit may be on, half of that side that is then equal,
    and for the word as one of equal length or the longer of its pair (``longer``).

    ``a`` is the length of the edited side in the shorter word of the pair; its halves are cut there at a // 2.
    """
    word, p = F.col("word"), F.col("p")
    rows = rare.select("word", "n", F.explode("rare").alias("p"))
    right = F.struct(F.lit("right").alias("side"), F.substring(word, F.lit(1), p + 2).alias("kept"), F.substring(word, p + 3, F.length(word)).alias("rest"))
    left = F.struct(F.lit("left").alias("side"), F.substring(word, p + 1, F.length(word)).alias("kept"), F.substring(word, F.lit(1), p).alias("rest"))
    rows = rows.select("word", "n", F.explode(F.array(left, right)).alias("s")).select("word", "n", "s.*")
    rows = rows.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("longer")).withColumn("a", F.length("rest") - F.col("longer").cast("int")).where("a >= 0")
    half = F.floor(F.col("a") / 2).cast("int")
    first = F.concat(F.lit("<"), F.substring(F.col("rest"), F.lit(1), half))
    last = F.concat(F.lit(">"), F.substring(F.col("rest"), F.length("rest") - (F.col("a") - half) + 1, F.length("rest")))
    rows = rows.select("word", "n", "longer", "side", "kept", "a", F.explode(F.array(first, last)).alias("half"))
    return rows.select("word", "n", "longer", F.xxhash64("side", "kept", "a", "half").alias("key"))


def near(vocab: DataFrame) -> DataFrame:
    """word, n, other, other_n: every pair of words exactly one inserted, deleted or replaced code point apart, both ways."""
    rows = keyed(rarest(vocab))
    x, y = rows.where("not longer").select(F.col("word").alias("wx"), F.col("n").alias("nx"), "key"), rows.select(F.col("word").alias("wy"), F.col("n").alias("ny"), "longer", "key")
    met = x.join(y.hint("merge"), "key").where(F.col("longer") | (F.col("wx") < F.col("wy")))
    pairs = met.where(F.levenshtein("wx", "wy", 1) == 1).select("wx", "nx", "wy", "ny").distinct()
    both = F.array(*(F.struct(F.col(a).alias("word"), F.col(b).alias("n"), F.col(c).alias("other"), F.col(d).alias("other_n")) for a, b, c, d in (("wx", "nx", "wy", "ny"), ("wy", "ny", "wx", "nx"))))
    return pairs.select(F.inline(both))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of every word that has a form: the last one met by following forms, by pointer doubling.

    Along a chain n at least doubles with TIMES of 2, so a chain is no longer than n has bits and rounds are few.
    """
    now = save(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if now.join(further.hint("merge"), "root", "left_semi").isEmpty():
            return now
        last, now = now, save(now.join(further.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        discard(last)


def variants(vocab: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``vocab`` (word, n: distinct, not null); ``times`` above 1.

    The form is the near word of largest n (ties: the smallest in code-point order) if that is at least ``times`` n.
    """
    vocab = save(vocab, "vocabulary")
    best = F.min_by(F.struct("other", "other_n"), F.struct(-F.col("other_n"), "other"))
    some = near(vocab).groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    fits = F.col("best.other_n") >= times * F.col("n")
    some = save(some.select("word", "n_near", F.when(fits, F.col("best.other")).alias("form"), F.when(fits, F.col("best.other_n")).alias("form_n")), "forms")
    last = roots(some.where("form is not null"))
    out = vocab.join(some.hint("merge"), "word", "left").join(last.hint("merge"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op12_spelling_variants(spark, sf_dir):
    """word, form, root, n, n_near, form_n of every word of the documents.

    Null and empty texts have no words; a null id counts as empty text in the hash. Repeated rows count each time. Ties
    between near words of equal n go to the smallest word. Empty tables give no rows. Texts are read in slices that end
    between words, so long ones need bounded memory. Extra columns are not read.
    """
    return variants(vocabulary(table(spark, sf_dir, "documents")))


#: DuckDB's distance counts bytes, so letters from U+00C0 on stand for one ASCII character each there.
_WIDE = "".join(map(chr, range(0xC0, 0x100)))
_BYTES = "".join(chr(i) for i in range(33, 127) if i != 39 and not 97 <= i < 123)[:64]
SQL = f"""WITH RECURSIVE docr AS (SELECT DISTINCT coalesce(doc_id::VARCHAR, '') AS i, r, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS r FROM documents) GROUP BY ALL HAVING length(r) >= {LEAST_LENGTH}),
texts AS MATERIALIZED (SELECT DISTINCT i || ':' || r AS w FROM docr), {CRC_SQL},
spelt AS (SELECT CASE WHEN crc % {TYPO} = 0 THEN r[1:(crc % length(r))::INT] || r[(crc % length(r))::INT + 2:] ELSE r END AS word, n FROM docr JOIN crc ON crc.w = i || ':' || r),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= {LEAST_LENGTH} GROUP BY 1 HAVING sum(n) >= {LEAST_COUNT}),
narrow AS MATERIALIZED (SELECT *, translate(word, '{_WIDE}', '{_BYTES}') AS b FROM v),
near AS MATERIALIZED (SELECT x.word, x.n, y.word AS other, y.n AS other_n FROM narrow x JOIN narrow y ON abs(length(x.b) - length(y.b)) <= 1 AND x.word <> y.word AND levenshtein(x.b, y.b) = 1),
best AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS r, count(*) OVER (PARTITION BY word) AS n_near FROM near),
forms AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {TIMES} * v.n THEN other END AS form, CASE WHEN other_n >= {TIMES} * v.n THEN other_n END AS form_n FROM v LEFT JOIN best b ON b.word = v.word AND r = 1),
walk AS (SELECT word, word AS at, form AS next FROM forms UNION ALL SELECT w.word, f.word, f.form FROM walk w JOIN forms f ON f.word = w.next)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN walk w ON w.word = f.word AND w.next IS NULL"""
