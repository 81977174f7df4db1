"""Named queries over the driver's tables and the same queries as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lineage
from .config import Thresholds
from .functions import normalize as N
from .functions import text as T
from .operators import compose, contamination, dedup, quality, records, review, rewrite, store, stored_versions, vector_index, vectors, versions
from .operators import items as I
from .streaming import ingest

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
LOW_PII = Thresholds(pii=0.1, code=0.1)


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _items(spark: SparkSession, d: str) -> DataFrame:
    return I.from_documents(_table(spark, d, "documents"), _table(spark, d, "labels"))


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


# SQL pieces, the same semantics as functions.text.
_SPLIT = f"regexp_extract_all(text, '[^{T.SPACE}]+')"
_LINES = f"(CASE WHEN text = '' THEN CAST([] AS VARCHAR[]) ELSE regexp_split_to_array(regexp_replace(text, '(?:{T.LINE_END})\\z', ''), '{T.LINE_END}') END)"
_ASCII = f"list_distinct(list_filter(regexp_extract_all(lower(text), '{T.WORD}'), lambda w: regexp_matches(w, '^[a-z]+$')))"


def _lang(words):
    return f"len(list_intersect(aw, [{', '.join(repr(w) for w in words)}]))"


_GRAMS5 = "list_transform(range(1, greatest(1, len(ws) - 3)), lambda i: array_to_string(ws[i:i + 4], ' '))"
_PII = " + ".join(f"CAST(regexp_matches(text, '{p}') AS INT)" for p in T.PII_PATTERNS)
_START = "|".join(s.replace("(", r"\(") for s in T.CODE_STARTS)
_END = "|".join("\\" + s for s in T.CODE_ENDS)
_ITEMS = """items AS (SELECT d.doc_id AS id, d.source AS dataset_id, coalesce(d.text, '') AS text, sha256(coalesce(d.text, '')) AS content_hash,
  length(coalesce(d.text, '')) AS char_count, length(coalesce(d.text, '')) // 4 AS tokens, coalesce(d.lang, 'unknown') AS language,
  CASE WHEN l.toxic = 1 THEN 'quarantine' WHEN l.quality = 0 THEN 'review' WHEN l.quality = 1 THEN 'keep' ELSE 'pending' END AS decision
  FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id))"""
_SCORES = f"""base AS (SELECT *, {_SPLIT} AS ws, {_LINES} AS ls, {_ASCII} AS aw FROM items),
scores AS (SELECT id, dataset_id, CAST(length(text) AS DOUBLE) AS length,
  round(CASE WHEN len(ws) < 5 THEN 0.0 ELSE 1 - len(list_distinct({_GRAMS5})) / (len(ws) - 4) END, 6) AS repetition,
  round(CASE WHEN text = '' THEN 0.0 ELSE least(1.0, len(regexp_extract_all(text, '[!@#$%^&*()]')) / length(text) * 5 + len(regexp_extract_all(text, '\\p{{Lu}}')) / length(text) * 2) END, 6) AS spam_score,
  round(CASE WHEN len(ls) = 0 THEN 0.0 ELSE len(list_filter(ls, lambda x: regexp_matches(regexp_replace(x, '^[{T.SPACE}]+|[{T.SPACE}]+$', '', 'g'), '^(?:{_START})|(?:{_END})$'))) / len(ls) END, 6) AS code_ratio,
  round(len(list_intersect(aw, [{', '.join(repr(w) for w in T.OFFENSIVE)}])) / greatest(1, len(aw)), 6) AS toxicity,
  round(({_PII}) / 5, 6) AS pii_score FROM base)"""


def _issue_sql(th: Thresholds) -> str:
    rules = [("too_short", "length", th.min_length, "<"), ("too_long", "length", th.max_length, ">"), ("repetition", "repetition", th.repetition, ">"), ("spam_score", "spam_score", th.spam, ">"), ("code_ratio", "code_ratio", th.code, ">"), ("toxicity", "toxicity", th.toxicity, ">"), ("pii_score", "pii_score", th.pii, ">")]
    return "issues AS (" + " UNION ALL ".join(f"SELECT id AS text_id, dataset_id, '{n}' AS issue_type, {c} AS score, CAST({v} AS DOUBLE) AS threshold, 'open' AS status FROM scores WHERE {c} {op} {v}" for n, c, v, op in rules) + ")"


_ALL = f"WITH {_ITEMS}, {_SCORES}, {_issue_sql(LOW_PII)}"


def _issues(spark, d):
    return quality.issues(_items(spark, d), LOW_PII)


@query(f"""WITH {_ITEMS}, w AS (SELECT *, len({_SPLIT}) AS words FROM items) SELECT count(*) AS items, count(DISTINCT dataset_id) AS sources,
 {', '.join(f"coalesce(sum({c}), 0)::BIGINT AS total_{n}, coalesce(round(avg({c}), 1), 0) AS avg_{n}, coalesce(min({c}), 0) AS min_{n}, coalesce(max({c}), 0) AS max_{n}" for c, n in (('tokens', 'tokens'), ('char_count', 'chars'), ('words', 'words')))} FROM w""")
def corpus_stats(spark, d):
    return I.corpus_stats(I.from_documents(_table(spark, d, "documents")))


@query("SELECT coalesce(nullif(lang, ''), 'unknown') AS language, count(*) AS n FROM documents GROUP BY 1")
def language_counts(spark, d):
    return I.top_values(I.from_documents(_table(spark, d, "documents")), "language")


@query("SELECT coalesce(nullif(source, ''), 'unknown') AS dataset_id, count(*) AS n FROM documents GROUP BY 1")
def source_counts(spark, d):
    return I.top_values(I.from_documents(_table(spark, d, "documents")), "dataset_id")


@query(f"""WITH {_ITEMS}, base AS (SELECT *, len({_SPLIT}) AS wc, list_transform({_LINES}, lambda x: length(x)) AS ll, {_ASCII} AS aw FROM items)
SELECT id, char_count, wc AS word_count, len(ll) AS line_count, coalesce(list_max(ll), 0) AS max_line_length, coalesce(list_min(ll), 0) AS min_line_length,
 contains(text, '<') AND contains(text, '>') AS has_html, tokens,
 CASE WHEN {_lang(T.EN_WORDS)} >= {_lang(T.PT_WORDS)} AND {_lang(T.EN_WORDS)} >= {_lang(T.ES_WORDS)} THEN 'en' WHEN {_lang(T.PT_WORDS)} >= {_lang(T.ES_WORDS)} THEN 'pt' ELSE 'es' END AS language FROM base""")
def text_stats(spark, d):
    t = T.text_of("text")
    return _table(spark, d, "documents").select(F.col("doc_id").alias("id"), *(c.alias(k) for k, c in T.stats(t).items()))


@query(f"WITH {_ITEMS}, {_SCORES} SELECT * FROM scores")
def quality_scores(spark, d):
    return quality.scores(_items(spark, d))


@query(f"{_ALL} SELECT * FROM issues")
def quality_issues(spark, d):
    return _issues(spark, d)


_EXACT = f"""WITH {_ITEMS}, m AS (SELECT content_hash AS group_id, id AS text_id, row_number() OVER (PARTITION BY content_hash ORDER BY tokens DESC, id) = 1 AS is_canonical, count(*) OVER (PARTITION BY content_hash) AS k FROM items),
members AS (SELECT group_id, text_id, 1.0::DOUBLE AS similarity, is_canonical FROM m WHERE k > 1)"""
_OWN = {"src0": {"min_length": 2000.0, "spam_threshold": 0.0}, "src1": {"code_threshold": 0.0, "max_length": 5000.0}}


@query(f"""WITH {_ITEMS}, {_SCORES}, o AS (SELECT *, CASE dataset_id WHEN 'src0' THEN 2000 ELSE 10 END AS least, CASE dataset_id WHEN 'src1' THEN 5000 ELSE 100000 END AS most, CASE dataset_id WHEN 'src0' THEN 0 ELSE 0.7 END AS spam, CASE dataset_id WHEN 'src1' THEN 0 ELSE 0.5 END AS code FROM scores)
SELECT id AS text_id, 'too_short' AS issue_type, least::DOUBLE AS threshold FROM o WHERE length < least UNION ALL SELECT id, 'too_long', most FROM o WHERE length > most UNION ALL SELECT id, 'repetition', 0.3 FROM o WHERE repetition > 0.3
UNION ALL SELECT id, 'spam_score', spam FROM o WHERE spam_score > spam UNION ALL SELECT id, 'code_ratio', code FROM o WHERE code_ratio > code UNION ALL SELECT id, 'toxicity', 0.8 FROM o WHERE toxicity > 0.8 UNION ALL SELECT id, 'pii_score', 0.5 FROM o WHERE pii_score > 0.5""")
def issues_by_own_thresholds(spark, d):
    """Issues under thresholds that two of the datasets override."""
    entries = F.array(*(F.struct(F.lit(s).alias("dataset_id"), F.create_map(*(F.lit(x) for kv in own.items() for x in kv)).alias("thresholds")) for s, own in _OWN.items()))
    datasets = _items(spark, d).select("dataset_id").distinct().join(spark.range(1).select(F.inline(entries)), "dataset_id")
    return quality.issues(_items(spark, d), datasets=datasets).select("text_id", "issue_type", "threshold")


@query(f"""{_EXACT}, c AS (SELECT group_id, min(text_id) FILTER (is_canonical) AS canonical, max(text_id) FILTER (NOT is_canonical) AS k FROM members GROUP BY 1)
SELECT id, CASE WHEN id IN (SELECT k FROM c) THEN 'keep' WHEN id IN (SELECT canonical FROM c) THEN 'quarantine' ELSE decision END AS decision, coalesce(id IN (SELECT k FROM c), false) AS is_canonical FROM items""")
def duplicate_picks(spark, d):
    """Of each group its last member is kept instead of the canonical one."""
    items = _items(spark, d)
    members = dedup.exact_members(items)
    pairs = dedup.review_pairs(members).groupBy("group_id").agg(F.max("other").alias("keep"), F.first("canonical").alias("other"))
    rows, now = dedup.pick(items, members, pairs)
    best = now.where("is_canonical").select(F.col("text_id").alias("id"), F.lit(True).alias("is_canonical"))
    return rows.join(best, "id", "left").select("id", "decision", F.coalesce("is_canonical", F.lit(False)).alias("is_canonical"))


@query(f"{_ALL} SELECT issue_type, count(*) AS n FROM issues GROUP BY 1")
def issues_by_type(spark, d):
    return quality.by_type(_issues(spark, d))


@query(f"""WITH {_ITEMS} SELECT id AS text_id, 'too_short' AS issue_type, 1.0::DOUBLE AS score, 10.0::DOUBLE AS threshold FROM items WHERE char_count < 10
UNION ALL SELECT id, 'too_long', 1.0::DOUBLE, 4000.0::DOUBLE FROM items WHERE tokens > 4000""")
def ingest_issues(spark, d):
    return quality.ingest_issues(_items(spark, d))


@query(f"WITH {_ITEMS} SELECT id, dataset_id, char_count, decision FROM items WHERE decision = 'keep' AND char_count >= 1000 AND language = 'en'")
def items_filtered(spark, d):
    return I.filtered(_items(spark, d), status="keep", min_length=1000, language="en").select("id", "dataset_id", "char_count", "decision")


@query(f"""WITH {_ITEMS} SELECT id, decision FROM items ORDER BY CASE decision WHEN 'pending' THEN 0 WHEN 'review' THEN 1 WHEN 'quarantine' THEN 2 WHEN 'reject' THEN 3 ELSE 4 END, id LIMIT 50 OFFSET 100""")
def items_paged(spark, d):
    return I.page(_items(spark, d), 100, 50).select("id", "decision")


@query(f"{_ALL} SELECT id, decision FROM items WHERE id IN (SELECT text_id FROM issues WHERE issue_type = 'spam_score')")
def items_with_issue(spark, d):
    return I.filtered(_items(spark, d), _issues(spark, d), issue="spam_score").select("id", "decision")


@query(f"{_ALL} SELECT i.text_id, i.issue_type, i.score, t.decision, t.char_count FROM issues i LEFT JOIN items t ON t.id = i.text_id")
def issue_enriched(spark, d):
    return quality.enriched(_issues(spark, d), _items(spark, d)).select("text_id", "issue_type", "score", "decision", "char_count")


@query(f"""{_ALL}, o AS (SELECT text_id, count(*) AS k FROM issues GROUP BY 1), p AS (SELECT dataset_id, coalesce(sum(k), 0)::BIGINT AS open_issues, count_if(decision = 'pending') AS pending FROM items LEFT JOIN o ON o.text_id = id GROUP BY 1)
SELECT dataset_id, open_issues, pending::BIGINT AS pending, CASE WHEN open_issues > 3 THEN 'flagged' WHEN open_issues > 0 THEN 'review' WHEN pending > 0 THEN 'new' ELSE 'clean' END AS triage FROM p""")
def dataset_triage(spark, d):
    return I.triage(_items(spark, d), _issues(spark, d))


@query(f"WITH {_ITEMS} SELECT content_hash, count(*) AS members FROM items GROUP BY 1 HAVING count(*) > 1")
def exact_dup_groups(spark, d):
    return dedup.exact_groups(_items(spark, d))




@query(f"{_EXACT} SELECT * FROM members")
def exact_dup_members(spark, d):
    return dedup.exact_members(_items(spark, d))


@query(f"{_EXACT} SELECT id, CASE WHEN id IN (SELECT text_id FROM members WHERE NOT is_canonical) THEN 'quarantine' ELSE decision END AS decision FROM items")
def quarantine_duplicates(spark, d):
    items = _items(spark, d)
    return dedup.quarantine_others(items, dedup.exact_members(items)).select("id", "decision")


@query(f"{_EXACT}, c AS (SELECT group_id, text_id AS canonical FROM members WHERE is_canonical) SELECT m.group_id, canonical, m.text_id AS other FROM members m JOIN c USING (group_id) WHERE m.text_id <> canonical")
def duplicate_review_pairs(spark, d):
    return dedup.review_pairs(dedup.exact_members(_items(spark, d)))


# Signatures: shingles of characters, the low half of the first 64 bits of each one's sha256, and 128 minima.
_SIGNED = f"""{_ITEMS}, cs AS (SELECT id, string_split(replace(replace(text, chr(10), ' '), chr(9), ' '), '') AS c FROM items),
chars AS (SELECT id, generate_subscripts(c, 1) AS i, unnest(c) AS ch FROM cs),
grams AS (SELECT DISTINCT id, g FROM (SELECT id, ch || lead(ch, 1) OVER p || lead(ch, 2) OVER p || lead(ch, 3) OVER p || lead(ch, 4) OVER p AS g FROM chars WINDOW p AS (PARTITION BY id ORDER BY i)) WHERE g IS NOT NULL),
hashed AS (SELECT id, ('0x' || sha256(g)[9:16])::BIGINT AS h FROM grams),
minima AS MATERIALIZED (SELECT id, [{', '.join(f"min(({7919 * i + 31} * h + {6271 * i + 17}) % 4294967296)" for i in range(dedup.HASHES))}] AS sig FROM hashed GROUP BY 1),
signed AS (SELECT i.id, coalesce(m.sig, []) AS sig FROM items i LEFT JOIN minima m ON m.id = i.id)"""
_NEAR = f"""{_SIGNED}, classes AS (SELECT content_hash, min(id) AS id FROM items GROUP BY 1), reps AS MATERIALIZED (SELECT s.id, s.sig FROM signed s JOIN classes c ON c.id = s.id WHERE len(s.sig) > 0),
bands AS MATERIALIZED (SELECT id, sig, unnest(range(0, {dedup.BANDS})) AS b FROM reps), keyed AS MATERIALIZED (SELECT id, sig, b, array_to_string(sig[b * {dedup.ROWS} + 1:b * {dedup.ROWS} + {dedup.ROWS}], ',') AS band FROM bands),
meet AS (SELECT DISTINCT x.id AS id_a, y.id AS id_b, x.sig AS s, y.sig AS t FROM keyed x JOIN keyed y ON x.b = y.b AND x.band = y.band AND x.id < y.id),
pairs AS MATERIALIZED (SELECT * FROM (SELECT id_a, id_b, floor(len(list_filter(list_zip(s, t), lambda z: z[1] = z[2])) / {dedup.HASHES} * 1e6 + 0.5) / 1e6 AS jaccard FROM meet) WHERE jaccard >= 0.7)"""


@query(f"WITH {_SIGNED} SELECT id, array_to_string(sig, ',') AS signature FROM signed")
def minhash_signatures(spark, d):
    sig = dedup.signature(F.col("text"))
    return _items(spark, d).select("id", F.array_join(F.transform(sig, lambda x: x.cast("string")), ",").alias("signature"))


@query(f"WITH {_NEAR} SELECT id_a, id_b, jaccard FROM pairs")
def near_dup_pairs(spark, d):
    return dedup.near_pairs(_items(spark, d))


@query(f"""WITH RECURSIVE {_NEAR}, edges AS (SELECT id_a AS a, id_b AS b FROM pairs UNION SELECT id_b, id_a FROM pairs),
reach AS (SELECT a, a AS r FROM edges UNION SELECT e.a, r.r FROM edges e JOIN reach r ON r.a = e.b), linked AS (SELECT a AS rep, min(r) AS g FROM reach GROUP BY 1),
of_hash AS (SELECT content_hash, min(id) AS rep, count(*) AS k FROM items GROUP BY 1),
rows AS (SELECT coalesce(l.g, o.rep) AS group_id, i.id AS text_id, i.tokens FROM items i JOIN of_hash o USING (content_hash) LEFT JOIN linked l USING (rep) WHERE o.k > 1 OR l.g IS NOT NULL)
SELECT group_id, text_id, row_number() OVER (PARTITION BY group_id ORDER BY tokens DESC, text_id) = 1 AS is_canonical FROM rows""")
def near_dup_members(spark, d):
    return dedup.near_members(_items(spark, d))


def _contamination_sql(n):
    gram = " || ' ' || ".join(["w", *(f"lead(w, {k}) OVER p" for k in range(1, n))])

    def grams(table, key):
        t = f"regexp_extract_all(lower(coalesce(text, '')), '{T.WORD}')"
        return f"SELECT DISTINCT {key}, gram FROM (SELECT {key}, {gram} AS gram FROM (SELECT {key}, generate_subscripts({t}, 1) AS i, unnest({t}) AS w FROM {table}) WINDOW p AS (PARTITION BY {key} ORDER BY i)) WHERE gram IS NOT NULL"

    return f"""WITH bg AS (SELECT DISTINCT gram FROM ({grams('benchmark', 'item_id')})), dg AS ({grams('documents', 'doc_id')}), n AS (SELECT doc_id, count(*) AS total_ngrams FROM dg GROUP BY 1),
o AS (SELECT doc_id, count(*) AS overlap_ngrams FROM dg JOIN bg USING (gram) GROUP BY 1), s AS (SELECT doc_id AS text_id, total_ngrams, overlap_ngrams, round(overlap_ngrams / total_ngrams, 6) AS overlap FROM o JOIN n USING (doc_id))"""


@query(_contamination_sql(10) + " SELECT text_id, overlap_ngrams, total_ngrams, overlap FROM s")
def contamination_scores(spark, d):
    return contamination.overlap(_items(spark, d), _table(spark, d, "benchmark")).select("text_id", F.col("overlap_ngrams").cast("long").alias("overlap_ngrams"), F.col("total_ngrams").cast("long").alias("total_ngrams"), "overlap")


@query(_contamination_sql(5) + " SELECT text_id, 'contamination' AS issue_type, overlap AS score, 0.05::DOUBLE AS threshold, overlap_ngrams, total_ngrams FROM s WHERE overlap >= 0.05")
def contamination_issues(spark, d):
    return contamination.issues(_items(spark, d), _table(spark, d, "benchmark"), n=5)


@query(f"""WITH {_ITEMS}, r AS (SELECT *, list_position(['src1', 'src0', 'src2'], dataset_id) AS k FROM items WHERE dataset_id IN ('src1', 'src0', 'src2'))
SELECT id, dataset_id, content_hash FROM r QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY k, id) = 1""")
def merge_sources(spark, d):
    return compose.merge(_items(spark, d), ["src1", "src0", "src2"]).select("id", "dataset_id", "content_hash")


@query(f"""WITH {_ITEMS}, a AS (SELECT id, content_hash FROM items WHERE decision = 'keep'), b AS (SELECT id, sha256(lower(text)) AS content_hash FROM items WHERE char_count >= 1000)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.content_hash <> b.content_hash""")
def version_diff(spark, d):
    items = _items(spark, d)
    new = items.where("char_count >= 1000").select("id", F.sha2(F.lower("text"), 256).alias("content_hash"))
    return versions.diff(items.where("decision = 'keep'"), new)


@query(f"""WITH {_ITEMS}, r AS (SELECT dataset_id, sha256(concat_ws('|', id::VARCHAR, content_hash, decision)) AS h FROM items WHERE decision IN ('keep', 'restore')),
b AS (SELECT dataset_id, h[1:3] AS b, sha256(string_agg(h, '' ORDER BY h)) AS h, count(*) AS k FROM r GROUP BY 1, 2)
SELECT dataset_id, sum(k)::BIGINT AS item_count, sha256(string_agg(h, '' ORDER BY b)) AS checksum FROM b GROUP BY 1""")
def version_checksum(spark, d):
    return versions.checksum(versions.snapshot(_items(spark, d)))


@query(f"""WITH {_ITEMS} SELECT id AS item_id, dataset_id, content_hash AS sha256, char_count, tokens, language, decision, 'v1' AS dataset_version, 'local-operator' AS exported_by, '0.1.0' AS pipeline_version FROM items WHERE decision IN ('keep', 'restore')""")
def export_manifest(spark, d):
    return versions.manifest(_items(spark, d), "v1")


@query(f"""WITH {_ITEMS} SELECT id, CASE WHEN decision IN ('keep', 'restore', 'quarantine') THEN CASE WHEN char_count >= 1000 THEN 'keep' ELSE 'quarantine' END ELSE decision END AS decision FROM items""")
def restore_decisions(spark, d):
    items = _items(spark, d)
    return I.restore(items, items.where("char_count >= 1000")).select("id", "decision")


@query(f"""WITH {_ITEMS}, h AS (SELECT id, ('0x' || sha256(id::VARCHAR || '7')[1:13])::BIGINT / 4503599627370496.0 AS h FROM items WHERE decision IN ('keep', 'restore'))
SELECT id, CASE WHEN h <= 0.8 THEN 0 WHEN h <= 0.9 THEN 1 ELSE 2 END AS part FROM h""")
def split_assign(spark, d):
    return compose.split(_items(spark, d), [8, 1, 1], seed=7).select("id", "part")


@query(f"WITH {_ITEMS} SELECT id FROM items ORDER BY sha256(id::VARCHAR || '3'), id LIMIT 100")
def sample_random(spark, d):
    return compose.sample_random(_items(spark, d), 100, seed=3).select("id")


@query(f"""{_ALL}, k AS (SELECT text_id, count(*) AS k FROM issues GROUP BY 1) SELECT id, coalesce(k, 0) AS open_issues FROM items LEFT JOIN k ON id = text_id ORDER BY coalesce(k, 0) DESC, (decision = 'review') DESC, tokens DESC, id LIMIT 100""")
def sample_important(spark, d):
    return compose.sample_important(_items(spark, d), _issues(spark, d), 100).select("id", "open_issues")


@query()
def sample_diverse(spark, d):
    return compose.sample_diverse(_items(spark, d).select("id", "tokens", dedup.signature(F.col("text")).alias("sig")), 50)


@query(f"""WITH {_ITEMS}, p AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY sha256(id::VARCHAR || '5'), id) AS r FROM items WHERE dataset_id IN ('src1', 'src2')),
t AS (SELECT * FROM p WHERE r <= CASE dataset_id WHEN 'src1' THEN 30 ELSE 10 END)
SELECT id, dataset_id FROM t QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY dataset_id, id) = 1""")
def mix_sources(spark, d):
    return compose.mix(_items(spark, d), {"src1": 3.0, "src2": 1.0}, size=40, seed=5).select("id", "dataset_id")


def _redact_sql():
    t = "coalesce(text, '')"
    for p in T.REDACTIONS:
        t = f"regexp_replace({t}, '{p}', '{T.MASK}', 'gi')"
    return f"SELECT doc_id AS id, {t} AS redacted FROM documents"


@query(_redact_sql())
def redact_documents(spark, d):
    return _table(spark, d, "documents").select(F.col("doc_id").alias("id"), T.redact(T.text_of("text"))[0].alias("redacted"))


@query()
def privacy_flags(spark, d):
    return _table(spark, d, "documents").select(F.col("doc_id").alias("id"), N.privacy(F.col("text")).alias("p")).select("id", "p.pii", "p.types", "p.evidence")


@query()
def normalize_pages(spark, d):
    return _table(spark, d, "pages").select("page_id", N.normalize(F.col("html")).alias("n")).select("page_id", "n.*")


@query(r"SELECT page_id, regexp_replace(coalesce(html, ''), '<[^>\n]{1,1000}[^>\n]{0,1000}>', ' ', 'g') AS stripped FROM pages")
def strip_tags_pages(spark, d):
    return _table(spark, d, "pages").select("page_id", T.strip_tags(T.text_of("html")).alias("stripped"))


_LINE = f"regexp_replace(l, '\\A[{T.SPACE}]+|[{T.SPACE}]+\\z', '', 'g')"


@query(f"""WITH d AS (SELECT DISTINCT {_LINE} AS text FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents)), b AS (SELECT {_LINE} AS text FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM benchmark))
SELECT sha256(text) AS content_hash, text, length(text) AS char_count, length(text) // 4 AS tokens FROM d WHERE text <> '' AND text NOT IN (SELECT text FROM b WHERE text IS NOT NULL)""")
def ingested_lines(spark, d):
    """The table that a stream over the documents' files makes of their lines, less the lines of the benchmark."""

    def lines(rows):
        return rows.select(F.explode(F.split("text", "\n")).alias("l")).select(F.lit("documents").alias("source_uri"), N.trimmed(F.col("l")).alias("text")).where("text <> ''")

    def stream(glob):  # a stream reads a folder or a pattern, and the table may be one file
        reader = spark.readStream.schema(_table(spark, d, "documents").schema)
        return lines((reader.option("pathGlobFilter", glob) if glob else reader).parquet(f"{d}/documents.parque[t]"))

    at = lineage.folder(spark, "ingested")
    known = lines(_table(spark, d, "benchmark")).select(F.sha2("text", 256).alias("content_hash"))
    ingest.ingest(spark, stream, f"{at}/table", f"{at}/checkpoint", known).awaitTermination()
    schema = "content_hash string, text string, source_uri string, char_count long, tokens long"
    return spark.read.schema(schema).parquet(f"{at}/table").drop("source_uri")


_TALKS = """talks AS (SELECT conv_id, count(*) AS turn_count, sum(length(coalesce(text, '')) // 4)::BIGINT AS total_tokens, arg_max(role, turn) AS last_role, arg_min(coalesce(text, ''), turn) AS first_text FROM conversations GROUP BY 1)"""


@query(f"WITH {_TALKS} SELECT conv_id, turn_count, total_tokens, last_role, last_role NOT IN ('assistant', 'tool') AS missing_final FROM talks")
def conversation_summary(spark, d):
    return records.conversations(_table(spark, d, "conversations")).drop("messages", "has_tools")


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY 1")
def conversation_messages(spark, d):
    talk = records.conversations(_table(spark, d, "conversations"))
    return talk.select("conv_id", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("transcript"))


@query(f"""WITH {_ITEMS}, {_TALKS} SELECT 'text-' || id AS id, 'text' AS kind, dataset_id AS title, text[1:120] AS preview, decision AS status, tokens FROM items
UNION ALL SELECT 'conversation-' || conv_id, 'conversation', 'conversation ' || conv_id, first_text[1:120], CASE WHEN last_role NOT IN ('assistant', 'tool') THEN 'review' ELSE 'pending' END, total_tokens FROM talks""")
def explorer_union(spark, d):
    both = records.explorer(_items(spark, d), records.conversations(_table(spark, d, "conversations")))
    return both.select("id", "kind", "title", "preview", "status", "tokens")


def _training(spark, d):
    """Preference pairs, SFT records and traces made of the conversations, as the SQL below makes them."""
    talks = records.conversations(_table(spark, d, "conversations"))
    says = lambda role: F.transform(F.filter("messages", lambda m: m["role"] == role), lambda m: m["content"])
    rows = talks.select(F.col("conv_id").alias("id"), "messages", says("user").alias("u"), says("assistant").alias("a"), "last_role")
    pairs = rows.where("size(u) > 0 and size(a) > 1").select("id", F.get("u", F.lit(0)).alias("prompt"), F.get("a", F.lit(0)).alias("chosen"), F.try_element_at("a", F.lit(-1)).alias("rejected"), F.when(F.col("id") % 3 == 0, "approved").when(F.col("id") % 3 == 1, "rejected").otherwise("pending").alias("status"))
    sft = rows.where("size(u) > 0 and size(a) > 0").select("id", F.transform(F.array(F.get("u", F.lit(0)), F.get("a", F.lit(0))), lambda c: F.struct(c.alias("content"))).alias("messages"), F.lit("pending").alias("status"))
    steps = F.transform("messages", lambda m: m["content"])
    traces = rows.where("id % 2 = 0").select("id", F.to_json(F.struct(steps.alias("steps"), F.struct(F.col("last_role").alias("final_role")).alias("end"))).alias("trace"), (F.col("last_role") == "assistant").alias("success"), F.when(F.col("id") % 7 == 0, "timeout").alias("error"))
    return talks, pairs, sft, traces


_KINDS = """t AS (SELECT conv_id AS id, coalesce(role, 'user') AS role, coalesce(text, '') AS text, turn FROM conversations),
g AS (SELECT id, count(*) FILTER (role = 'user') AS us, count(*) FILTER (role = 'assistant') AS asst, arg_min(text, turn) FILTER (role = 'user') AS u, arg_min(text, turn) FILTER (role = 'assistant') AS a, arg_max(text, turn) FILTER (role = 'assistant') AS z,
 arg_max(role, turn) AS last_role, string_agg(text, ' ' ORDER BY turn) AS said FROM t GROUP BY 1),
pairs AS (SELECT 'preference-' || id AS id, 'preference' AS kind, u[1:240] AS preview, CASE id % 3 WHEN 0 THEN 'keep' WHEN 1 THEN 'reject' ELSE 'review' END AS status, length(u) // 4 + length(a) // 4 + length(z) // 4 AS tokens, NULL::BOOLEAN AS has_tools, NULL::BOOLEAN AS missing_final, u || ' ' || a || ' ' || z AS body FROM g WHERE us > 0 AND asst > 1),
sft AS (SELECT 'sft-' || id AS id, 'sft' AS kind, (u || ' ' || a)[1:240] AS preview, 'pending' AS status, length(u) // 4 + length(a) // 4 AS tokens, NULL::BOOLEAN AS has_tools, NULL::BOOLEAN AS missing_final, u || ' ' || a AS body FROM g WHERE us > 0 AND asst > 0),
tr AS (SELECT *, said || ' ' || last_role AS b FROM g WHERE id % 2 = 0),
traces AS (SELECT 'trace-' || id AS id, 'trace' AS kind, b[1:240] AS preview, CASE WHEN last_role = 'assistant' THEN 'keep' ELSE 'review' END AS status, NULL::BIGINT AS tokens, contains(lower(b), 'tool_call') OR contains(lower(b), 'function') AS has_tools,
 last_role <> 'assistant' OR id % 7 = 0 OR NOT contains(lower(b), 'final') AS missing_final, b AS body FROM tr),
kinds AS (SELECT * FROM pairs UNION ALL SELECT * FROM sft UNION ALL SELECT * FROM traces)"""


@query(f"WITH {_KINDS} SELECT id, kind, preview, status, CASE WHEN kind = 'trace' THEN 0 ELSE tokens END AS tokens, has_tools, missing_final FROM kinds")
def explorer_kinds(spark, d):
    _, pairs, sft, traces = _training(spark, d)
    rows = records.explorer(pairs=pairs, sft=sft, traces=traces, preview=240)
    return rows.select("id", "kind", "preview", "status", F.when(F.col("kind") == "trace", 0).otherwise(F.col("tokens")).alias("tokens"), "has_tools", "missing_final")


@query(f"WITH {_KINDS} SELECT id, status FROM kinds WHERE contains(lower(body), 'an') ORDER BY CASE status WHEN 'review' THEN 0 WHEN 'pending' THEN 2 WHEN 'keep' THEN 3 ELSE 4 END, kind || ' ' || split_part(id, '-', 2), id LIMIT 100 OFFSET 10")
def explorer_payload(spark, d):
    _, pairs, sft, traces = _training(spark, d)
    rows = records.explorer(pairs=pairs, sft=sft, traces=traces, preview=240)
    return records.search(rows, q=" AN ", order="pending_first", limit=100, offset=10).select("id", "status")


@query(f"WITH {_KINDS} SELECT id FROM kinds WHERE kind = 'trace' AND missing_final ORDER BY 'trace ' || split_part(id, '-', 2), id LIMIT 500")
def explorer_unfinished(spark, d):
    _, pairs, sft, traces = _training(spark, d)
    return records.search(records.explorer(pairs=pairs, sft=sft, traces=traces), missing_final=True, order="name").select("id")


@query(f"""WITH {_ITEMS}, b AS (SELECT id, {_SPLIT} AS ws FROM items), g AS (SELECT id, CASE WHEN len(ws) < 5 THEN [] ELSE {_GRAMS5} END AS g FROM b)
SELECT id, len(list_distinct(g)) AS unique_grams, len(g) AS total_grams, CASE WHEN len(g) = 0 THEN 0.0 ELSE round(1 - len(list_distinct(g)) / len(g), 3) END AS repetition_score FROM g""")
def repetition_stats(spark, d):
    return _items(spark, d).select("id", T.repetition_stats(F.col("text")).alias("r")).select("id", "r.*")


@query(f"{_ALL} SELECT text_id, score FROM issues WHERE issue_type = 'spam_score' AND status = 'open' AND dataset_id = 'src1' ORDER BY score DESC, text_id LIMIT 50")
def issues_worst(spark, d):
    return review.worst(review.listed(_issues(spark, d), "spam_score", "open", "src1"), 50).select("text_id", "score")


@query(f"{_ALL} SELECT issue_type, text_id, score, row_number() OVER (PARTITION BY issue_type ORDER BY score DESC, text_id) AS place, count(*) OVER (PARTITION BY issue_type) AS of_type FROM issues QUALIFY place <= 20")
def issues_ranked(spark, d):
    return review.ranked(_issues(spark, d), 20).select("issue_type", "text_id", "score", F.col("place").cast("long").alias("place"), "of_type")


@query(f"{_EXACT}, x AS (SELECT DISTINCT text_id FROM members WHERE NOT is_canonical) SELECT dataset_id, count(*) AS total, count_if(decision = 'pending')::BIGINT AS pending, round(100 * count_if(decision = 'keep') / count(*), 1) AS keep_pct, round(100 * count(x.text_id) / count(*), 1) AS savings_pct FROM items LEFT JOIN x ON x.text_id = id GROUP BY 1")
def dataset_shares(spark, d):
    items = _items(spark, d)
    return review.shares(items, dedup.exact_members(items))


@query(f"WITH {_ITEMS} SELECT count(*) AS n FROM items WHERE decision = 'review' AND char_count >= 200")
def filtered_count(spark, d):
    return I.filtered(_items(spark, d), status="review", min_length=200).agg(F.count("*").alias("n"))


@query(f"""{_ALL} SELECT i.text_id, i.issue_type, CASE WHEN i.text_id % 3 = 0 THEN 'dismissed' WHEN i.text_id % 3 = 1 THEN 'acknowledged' ELSE 'open' END AS status, CASE WHEN i.text_id % 3 < 2 THEN 'local' END AS reviewed_by FROM issues i""")
def issues_acknowledged(spark, d):
    rows = lineage.save(_issues(spark, d).withColumn("id", F.concat_ws("/", F.col("text_id").cast("string"), "issue_type")), "issues")
    state = F.when(F.col("text_id") % 3 == 0, "dismissed").otherwise("acknowledged")
    acks = rows.where("text_id % 3 < 2").select("id", state.alias("status"), F.lit("local").alias("reviewed_by"), F.lit(None).cast("timestamp").alias("reviewed_at"))
    return review.acknowledge(rows, acks).select("text_id", "issue_type", "status", "reviewed_by")


_LABELS = "l AS (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1)"


@query(f"""WITH {_LABELS}, old AS (SELECT 'a' || doc_id AS id, doc_id, CASE quality WHEN 1 THEN 'good' ELSE 'low' END AS category, CASE WHEN toxic = 1 THEN 'rejected' ELSE 'approved' END AS status, toxic = 1 OR doc_id % 2 = 0 AS gone FROM l),
new AS (SELECT 'b' || doc_id AS id, doc_id, 'second' AS category, CASE WHEN doc_id % 4 = 0 THEN 'approved' ELSE 'pending' END AS status, false AS gone FROM l WHERE toxic = 1 OR doc_id % 2 = 0)
SELECT * FROM old UNION ALL SELECT * FROM new""")
def label_lifecycle(spark, d):
    l = _table(spark, d, "labels").where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    start = l.select(F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("id"), "doc_id", F.lit("new").alias("category"), F.lit("human").alias("source_type"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("supersedes_id"), F.lit("approved").alias("status"), F.lit(None).cast("timestamp").alias("superseded_at"))
    names = l.select(F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("id"), F.when(F.col("quality") == 1, " good ").otherwise("low").alias("category"))
    state, _ = review.review_labels(review.rename_labels(start, names), l.where("toxic = 1").select(F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("id"), F.lit("rejected").alias("status"), F.lit(None).cast("string").alias("reviewer"), F.lit(None).cast("string").alias("comment")))
    fresh = l.where("toxic = 1 or doc_id % 2 = 0").select(F.concat(F.lit("b"), F.col("doc_id").cast("string")).alias("id"), "doc_id", F.lit("second").alias("category"), F.when(F.col("doc_id") % 4 == 0, "human").otherwise("model").alias("source_type"), F.lit(0.5).alias("confidence"), F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("supersedes_id"))
    done = review.add_labels(state, fresh, F.lit("2024-01-01").cast("timestamp"))
    return done.select("id", "doc_id", "category", "status", F.col("superseded_at").isNotNull().alias("gone"))


@query(f"""{_ALL}, parts AS (SELECT 'items' AS name, count(*) AS n FROM items WHERE dataset_id <> 'src1' UNION ALL SELECT 'issues', count(*) FROM issues WHERE dataset_id <> 'src1'
UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id IS NULL OR doc_id NOT IN (SELECT id FROM items WHERE dataset_id = 'src1')) SELECT * FROM parts""")
def dataset_deleted(spark, d):
    items = _items(spark, d)
    left = store.without_dataset({"items": items, "issues": _issues(spark, d), "labels": _table(spark, d, "labels")}, "src1")
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("""WITH c AS (SELECT conv_id, count(*) AS k FROM conversations GROUP BY 1), n AS (SELECT conv_id, k AS turn, 'user' AS role, 'more' AS text FROM c WHERE conv_id % 2 = 0 UNION ALL SELECT conv_id, k + 1, 'assistant', 'done' FROM c WHERE conv_id % 2 = 0)
SELECT conv_id, turn::BIGINT AS turn, role, text FROM conversations UNION ALL SELECT conv_id, turn, role, text FROM n""")
def turns_appended(spark, d):
    turns = _table(spark, d, "conversations")
    some = turns.where("conv_id % 2 = 0").select("conv_id").distinct()
    new = some.select("conv_id", F.explode(F.array(*(F.struct(F.lit(k).alias("seq"), F.lit(r).alias("role"), F.lit(t).alias("text")) for k, (r, t) in enumerate((("user", "more"), ("assistant", "done")))))).alias("m")).select("conv_id", "m.*")
    return store.append_turns(turns, new).withColumn("turn", F.col("turn").cast("long"))


@query(f"""WITH {_ITEMS}, s AS (SELECT id, decision FROM items WHERE decision IN ('keep', 'restore')), l AS (SELECT doc_id AS id, string_agg(CASE quality WHEN 1 THEN 'good' ELSE 'low' END, ',' ORDER BY CASE quality WHEN 1 THEN 'good' ELSE 'low' END) AS labels FROM labels GROUP BY 1)
SELECT i.id AS item_id, i.content_hash AS sha256, i.char_count, s.decision, coalesce(l.labels, '') AS labels, 'v1' AS dataset_version FROM items i JOIN s ON s.id = i.id LEFT JOIN l ON l.id = i.id WHERE i.char_count >= 100""")
def export_version(spark, d):
    items = _items(spark, d)
    labels = _table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("low").alias("category"))
    live = items.where("char_count >= 100").withColumn("decision", F.lit("pending"))
    rows = versions.export_snapshot(live, versions.snapshot(items, labels), "v1")
    return rows.select("item_id", "sha256", "char_count", "decision", F.array_join("labels", ",").alias("labels"), "dataset_version")


def _redactions_sql():
    t, parts = "coalesce(text, '')", []
    for p in T.REDACTIONS:
        parts.append(f"len(regexp_extract_all({t}, '(?i){p}'))")
        t = f"regexp_replace({t}, '{p}', '{T.MASK}', 'gi')"
    return f"WITH {_ITEMS} SELECT id, ({' + '.join(parts)})::BIGINT AS substitutions, sha256({t}) AS content_hash, length({t}) AS char_count FROM items WHERE decision IN ('keep', 'restore')"


@query(_redactions_sql())
def redact_job(spark, d):
    return rewrite.redacted(_items(spark, d)).select("id", "substitutions", "content_hash", "char_count")


def _spaced_sql(text):
    inner = T.SPACE.replace(r"\x09-\x0d", r"\x09\x0b-\x0d")
    for p, to in ((r"\r\n?", "chr(10)"), (r"\A\x{feff}+", "''"), (N.BLANKS, "' '"), (rf"[{inner}]+\n", "chr(10)"), (rf"[{inner}]+\z", "''"), (r"\n{3,}", "chr(10) || chr(10)"), (rf"\A[{T.SPACE}]+|[{T.SPACE}]+\z", "''")):
        text = f"regexp_replace({text}, '{p}', {to}, 'g')"
    return text


@query(f"SELECT page_id, {_spaced_sql("coalesce(html, '')")} AS spaced FROM pages")
def spaced_pages(spark, d):
    return _table(spark, d, "pages").select("page_id", N.collapse_whitespace(T.text_of("html")).alias("spaced"))


def _plain_pattern(p):
    """A line pattern for DuckDB, which has neither possessive repeats nor flags for Unicode."""
    for old, new in (("(?iu)", "(?i)"), ("(?U)", ""), ("*+", "*"), ("++", "+"), ("}+", "}"), ("\\d", "\\p{Nd}")):
        p = p.replace(old, new)
    return p


_BOILER = " OR ".join(f"regexp_matches(x, '{_plain_pattern(p)}')" for p in N.BOILERPLATE_LINES)


@query(f"""WITH l AS (SELECT doc_id AS id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: NOT ({_BOILER} OR (regexp_matches(x, '{_plain_pattern(N.BOILERPLATE_LINKS[0])}') AND len(list_filter(regexp_extract_all(x, '[^{T.SPACE}]+'), lambda t: NOT regexp_matches(t, '{N.BOILERPLATE_LINKS[1]}'))) = 0))) AS ls FROM documents),
k AS (SELECT id, list_filter(ls, lambda x, i: i = 1 OR NOT regexp_matches(x, '[^{T.SPACE}]') OR x <> ls[i - 1]) AS ls FROM l)
SELECT id, regexp_replace(array_to_string(ls, chr(10)), '\\A[{T.SPACE}]+|[{T.SPACE}]+\\z', '', 'g') AS text FROM k""")
def boilerplate_removed(spark, d):
    return _table(spark, d, "documents").select(F.col("doc_id").alias("id"), N.remove_boilerplate(T.text_of("text")).alias("text"))


@query()
def normalize_job(spark, d):
    return rewrite.counters(rewrite.normalized(_items(spark, d)))


@query(f"""WITH {_ITEMS} SELECT 'text-' || id AS id, tokens FROM items WHERE contains(lower(dataset_id || ' ' || text), 'the') ORDER BY tokens, lower(dataset_id), 'text-' || id LIMIT 500""")
def explorer_search(spark, d):
    both = records.explorer(_items(spark, d), records.conversations(_table(spark, d, "conversations")))
    return records.search(both, q="the", kind_="text", order="tokens").select("id", "tokens")


@query(f"""WITH {_ITEMS} SELECT dataset_id, {', '.join(f"count_if(decision = '{x}')::BIGINT AS {x}" for x in I.DECISIONS)}, count(*) AS total FROM items GROUP BY 1""")
def decision_counts(spark, d):
    return I.decision_counts(_items(spark, d))


@query("""WITH c AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'low' ELSE 'good' END AS category FROM labels)
SELECT category, count(DISTINCT doc_id) AS n, string_agg(DISTINCT doc_id::VARCHAR, ',' ORDER BY doc_id::VARCHAR) AS ids FROM c WHERE doc_id IN (SELECT doc_id FROM documents) GROUP BY 1""")
def items_by_label(spark, d):
    c = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").otherwise("good")
    got = I.by_label(_items(spark, d), _table(spark, d, "labels").select("doc_id", c.alias("category")))
    return got.select("category", "n", F.array_join(F.sort_array(F.transform("ids", lambda x: x.cast("string"))), ",").alias("ids"))


@query("""WITH c AS (SELECT DISTINCT CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'low' ELSE 'good' END AS category, doc_id FROM labels WHERE quality = 1 OR toxic = 1 OR doc_id % 2 = 0),
p AS (SELECT category, doc_id, row_number() OVER (PARTITION BY category ORDER BY doc_id) - 1 AS place FROM c WHERE doc_id IN (SELECT doc_id FROM documents))
SELECT category, place // 64 AS chunk, min(doc_id) AS first_id, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM p GROUP BY ALL""")
def label_postings(spark, d):
    c = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").otherwise("good")
    status = F.when((F.col("quality") == 1) | (F.col("toxic") == 1) | (F.col("doc_id") % 2 == 0), "approved").otherwise("pending")
    got = I.postings(_items(spark, d), _table(spark, d, "labels").select("doc_id", c.alias("category"), status.alias("status")), size=64)
    return got.select("category", "chunk", "first_id", "n", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query(f"""{_ALL}, k AS (SELECT text_id, count(*) AS k FROM issues GROUP BY 1) SELECT id, coalesce(k, 0) AS open_issues, tokens FROM items LEFT JOIN k ON id = text_id ORDER BY coalesce(k, 0) DESC, (decision = 'review') DESC, tokens DESC, id LIMIT (SELECT count(*) * 3 // 10 FROM items)""")
def top_share_important(spark, d):
    items = _items(spark, d)
    return compose.sample_important(items, _issues(spark, d), items.count() * 3 // 10).select("id", "open_issues", "tokens")


@query("""WITH q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1), s AS (SELECT vec_id AS id, list_transform(list_zip(embedding, (SELECT e FROM q)), lambda z: z[1]::DOUBLE * z[2]::DOUBLE) AS p, embedding, (SELECT e FROM q) AS e FROM embeddings)
SELECT id, round(list_sum(p) / ((sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) + 1e-9) * (sqrt(list_sum(list_transform(e, lambda x: x::DOUBLE * x::DOUBLE))) + 1e-9)), 6) AS score FROM s ORDER BY score DESC, id LIMIT 10""")
def vector_search(spark, d):
    v = _table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vectors.top_k(v, v.orderBy("id").first()["vector"], 10)


def _neighbours_sql(where="TRUE"):
    dot = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
    norm = "(sqrt(list_sum(list_transform({0}, lambda x: x::DOUBLE * x::DOUBLE))) + 1e-9)"
    return f"""WITH v AS MATERIALIZED (SELECT vec_id AS id, embedding AS e, {norm.format('embedding')} AS n FROM embeddings), q AS (SELECT * FROM v WHERE id % 20 = 0),
s AS (SELECT q.id AS query_id, v.id, round({dot.format('q.e', 'v.e')} / (q.n * v.n), 6) AS score FROM q JOIN v ON {where})
SELECT query_id, id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5"""


def _vectors(spark, d):
    return _table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


@query(_neighbours_sql())
def vector_neighbours(spark, d):
    """Exact neighbours of every twentieth vector among all."""
    v = _vectors(spark, d)
    return vector_index.exact(v, vector_index.of_items(v, v.where("id % 20 = 0")), 5)


@query(_neighbours_sql("v.id IN (SELECT doc_id FROM documents WHERE lang = 'en' AND length(coalesce(text, '')) >= 500)"))
def vector_neighbours_filtered(spark, d):
    """Exact neighbours among vectors whose item passes filters."""
    v = _vectors(spark, d)
    left = I.filtered(I.from_documents(_table(spark, d, "documents")), language="en", min_length=500)
    return vector_index.exact(vector_index.joined(v, left), vector_index.of_items(v, v.where("id % 20 = 0")), 5)


@query()
def vector_index_neighbours(spark, d):
    """The same neighbours from an inverted index; tests measure its recall."""
    v, at = _vectors(spark, d), lineage.folder(spark, "index")
    vector_index.build(v, at, cells=32)
    return vector_index.search(spark, at, vector_index.of_items(v, v.where("id % 20 = 0")), 5, probes=16)


@query(f"""WITH {_ITEMS}, a AS (SELECT id, content_hash FROM items WHERE decision = 'keep'), b AS (SELECT id, CASE WHEN id % 50 = 0 THEN sha256(lower(text)) ELSE content_hash END AS content_hash FROM items WHERE decision = 'keep' AND id % 70 <> 1 OR id % 90 = 7)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.content_hash <> b.content_hash""")
def stored_version_diff(spark, d):
    """The difference of two written versions, from the parts whose digests differ."""
    items, at = _items(spark, d), lineage.folder(spark, "versions")
    docs = _table(spark, d, "documents")  # edited before labels are joined, so that hashes travel and no text
    edited = I.from_documents(docs.withColumn("text", F.when(F.col("doc_id") % 50 == 0, F.lower("text")).otherwise(F.col("text"))), _table(spark, d, "labels"))
    stored_versions.write(items.where("decision = 'keep'").select("id", "content_hash"), f"{at}/old")
    stored_versions.write(edited.where("decision = 'keep' and id % 70 <> 1 or id % 90 = 7").select("id", "content_hash"), f"{at}/new")
    return stored_versions.changed(spark, f"{at}/old", f"{at}/new")


@query()
def kmeans_clusters(spark, d):
    return vectors.clusters(_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))


@query()
def outliers(spark, d):
    return vectors.outliers(kmeans_clusters(spark, d))
