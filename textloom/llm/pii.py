"""Personal data by candidate gradient boosting; DataFrame functions only.

Strict rules give the base spans, which always stay. High-recall generators propose further, overlapping spans
(spelled-out addresses, loosely written numbers). A candidate has format and context features of few values
each; counted over all documents they form a table of bounded size, on which boosted trees learn. Positives are base spans
in the looser forms that the generators exist for: addresses spelled out or spaced, numbers without their country
code, as they stand and after a cue; negatives are candidates that are no base span and have no cue, and numbers that look like
addresses or cards but fail their checks. For each kind the lowest score at which the share of positives above it
reaches PRECISION, counted on the half of the documents that the trees have not seen, is its threshold; candidates from
there on that touch no base span are added, longest first.

Positions come from splitting a text at its matches. Separators inside numbers and dots inside names are first
replaced by a private-use character of the same length, so that every pattern is a plain run of characters
and long runs need no deep recursion.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import collect_bounded, table

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.95
ROUNDS = 24
RATE = 0.3
MARK, OTHER = "\ue000", "\ue001"

_LOCAL = rf"[A-Za-z0-9._%+{MARK}-]"
_EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++{MARK}[A-Za-z0-9{MARK}-]+"
_IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
_CARD = rf"[0-9][0-9{MARK}]*[0-9]"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_DOT = r"(?: ?(?:\(dot\)|\[dot\]) ?| dot |\.)"
_WIDE_MAIL = rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]++(?:{_DOT}[A-Za-z0-9_%+-]++){{0,4}}+(?: ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++){{1,4}}+| at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++){{1,4}}+)"
_WIDE_NUMBER = r"(?<![A-Za-z0-9])[+(]?[0-9][0-9 ().+/-]{5,28}[0-9](?![A-Za-z0-9])"
_CUES = (("phone", "tel|phone|call|fax|mobile|cell"), ("card", "card|visa|credit|account"), ("ip", "host|server| ip|address"))
FEATURES = ("guess", "digits", "length", "space", "dash", "dot", "paren", "at", "cue", "edge")


def matches(text: Column, pattern: str) -> Column:
    """Array of (st, en, m): the leftmost non-overlapping matches with code point positions, end exclusive."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<st:int,en:int,m:string>>").alias("out"))

    def step(s, x):
        st = s["at"] + F.length(x["gap"])
        en = st + F.length(x["m"])
        return F.struct(en.alias("at"), F.concat(s["out"], F.array(F.struct(st.alias("st"), en.alias("en"), x["m"].alias("m")))).alias("out"))

    each = F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("gap"), m.alias("m")))
    return F.aggregate(each, start, step, lambda s: s["out"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        short = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(short(p)) <= 3) & (F.coalesce(F.right(p, F.lit(3)).try_cast("int"), F.lit(0)) <= 255))
    n = F.length(_digits(m))
    if kind == "card":
        return F.when(n.between(12, 19), luhn(_digits(m))).otherwise(False)
    return n.between(9, 15)


def _as_spans(found: Column, kind: str) -> Column:
    kept = F.filter(found, lambda x: _valid(kind, x["m"]))
    return F.transform(kept, lambda x: F.struct(x["st"].alias("st"), F.lit(KINDS.index(kind)).alias("k"), x["en"].alias("en")))


_SPANS = "array<struct<st:int,k:int,en:int>>"


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with base (array of st, k, en by position and kind) for the whole text; null texts are empty.

    Texts without an @ sign or a pair of digits are not searched further.
    """
    t = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), MARK, OTHER)
    docs = docs.withColumn("_t", t).withColumn("_num", F.col("_t").rlike("[0-9][^A-Za-z]?[^A-Za-z]?[0-9]"))
    names = F.regexp_replace("_t", r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", MARK)
    numbers = F.regexp_replace("_t", r"(?<=[0-9])[ -](?=[0-9])", MARK)
    none = F.array().cast(_SPANS)
    spans = {
        "email": F.when(F.col("_t").contains("@"), _as_spans(matches(names, _EMAIL), "email")).otherwise(none),
        "ip": F.when(F.col("_num"), _as_spans(matches(F.col("_t"), _IP), "ip")).otherwise(none),
        "card": F.when(F.col("_num"), _as_spans(matches(numbers, _CARD), "card")).otherwise(none),
        "phone": F.when(F.col("_t").contains("+"), _as_spans(matches(F.col("_t"), _PHONE), "phone")).otherwise(none),
    }
    return docs.withColumn("base", F.sort_array(F.concat(*spans.values())))


def with_candidates(docs: DataFrame) -> DataFrame:
    """Adds cands: array of spans (st, k, en) with the features, y, whether the span is a base span of its kind, and apart,
    whether it touches none; and loose: the features of base spans in looser forms."""
    none = "array<struct<st:int,en:int,m:string>>"
    mail = F.when(F.col("_t").rlike(r"@|\(at\)|\[at\]| dot "), matches(F.col("_t"), _WIDE_MAIL)).otherwise(F.array().cast(none))
    number = F.when(F.col("_num"), matches(F.col("_t"), _WIDE_NUMBER)).otherwise(F.array().cast(none))
    text, base = F.col("_t"), F.col("base")

    def features(st, m, is_mail, cue=None):
        d = F.length(_digits(m))
        has = lambda c: m.contains(c).cast("int")
        before = F.lower(F.substring(text, F.greatest(F.lit(1), st - 19), F.least(F.lit(20), st)))
        dots = F.length(m) - F.length(F.replace(m, F.lit("."), F.lit("")))
        k = F.lit(0) if is_mail else F.when(dots == 3, 1).when(d >= 12, 2).otherwise(3)
        if cue is None:
            cue = F.lit(0)
            for i, (_, words) in enumerate(_CUES, 1):
                cue = F.when(before.rlike(words), i).otherwise(cue)
        return [
            k.alias("guess"), F.least(F.lit(20), d).alias("digits"), F.least(F.lit(9), (F.length(m) / 4).cast("int")).alias("length"),
            has(" ").alias("space"), has("-").alias("dash"), F.least(F.lit(3), dots).alias("dot"), has("(").alias("paren"), has("@").alias("at"), cue.alias("cue"),
            before.rlike(r"[\s]$").cast("int").alias("edge"),
        ]

    def candidate(x, is_mail):
        own = features(x["st"], x["m"], is_mail)
        same = F.exists(base, lambda b: (b["st"] == x["st"]) & (b["en"] == x["en"]) & (b["k"] == own[0]))
        apart = ~F.exists(base, lambda b: (b["st"] < x["en"]) & (x["st"] < b["en"]))
        return F.struct(x["st"].alias("st"), own[0].alias("k"), x["en"].alias("en"), *own, same.cast("int").alias("y"), apart.alias("apart"))

    def forms(b):
        m = F.substring(text, b["st"] + 1, b["en"] - b["st"])
        loose = []
        for at, dot in ((" (at) ", " (dot) "), (" [at] ", " [dot] "), (" at ", " dot "), (" @ ", ".")):
            loose.append(F.struct(*features(b["st"], F.replace(F.replace(m, F.lit("."), F.lit(dot)), F.lit("@"), F.lit(at)), True)))
        short = F.regexp_replace(m, r"^\+[0-9]{1,2}[ .-]?", "")
        d = _digits(short)
        dashed = F.concat_ws("-", F.substring(d, 1, 3), F.substring(d, 4, 3), F.substring(d, 7, 20))
        framed = F.concat(F.lit("("), F.substring(d, 1, 3), F.lit(") "), F.substring(d, 4, 3), F.lit("-"), F.substring(d, 7, 20))
        phone = [F.struct(*features(b["st"], m, False, cue)) for m in (short, dashed, framed) for cue in (None, F.lit(1))]
        return F.when(b["k"] == 0, F.array(*loose)).when(b["k"] == 3, F.array(*phone))

    both = F.concat(F.transform(mail, lambda x: candidate(x, True)), F.transform(number, lambda x: candidate(x, False)))
    return docs.withColumn("cands", both).withColumn("loose", F.flatten(F.filter(F.transform("base", forms), lambda f: f.isNotNull())))


def boost(x: np.ndarray, y: np.ndarray, n: np.ndarray, rounds: int = ROUNDS, rate: float = RATE) -> tuple[float, list]:
    """Logistic gradient boosting of depth-2 trees on weighted rows (n rows, y of them positive).

    A tree is (feature, cut, (left tree or value), (right ...)); rows with value <= cut go left.
    """
    total, good = n.sum(), y.sum()
    start = float(np.log((good + 0.5) / (total - good + 0.5)))
    score, trees = np.full(len(n), start), []

    def grow(rows, g, h, depth):
        value = float(rate * g[rows].sum() / (h[rows].sum() + 1.0))
        best = (1e-6, None)
        for f in range(x.shape[1] if depth else 0):
            for cut in np.unique(x[rows, f])[:-1]:
                left = rows[x[rows, f] <= cut]
                right = rows[x[rows, f] > cut]
                gain = sum(g[r].sum() ** 2 / (h[r].sum() + 1.0) for r in (left, right)) - g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
                if gain > best[0]:
                    best = (gain, (f, int(cut), left, right))
        if best[1] is None:
            return value
        f, cut, left, right = best[1]
        return (f, cut, grow(left, g, h, depth - 1), grow(right, g, h, depth - 1))

    def walk(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    for _ in range(rounds if 0 < good < total else 0):
        p = 1 / (1 + np.exp(-score))
        tree = grow(np.arange(len(n)), y - n * p, n * p * (1 - p), 2)
        trees.append(tree)
        score = score + np.array([walk(tree, row) for row in x])
    return start, trees


def fit(cands: DataFrame) -> list[tuple[float, list, float | None]]:
    """Each kind's trees and threshold from all candidates of all documents, dealt into two halves by a hash of the text.

    The features' values are few, so the collected table of their combinations is bounded whatever the data.
    """
    half = F.pmod(F.xxhash64("_t"), F.lit(2)).alias("half")
    other = F.filter("cands", lambda c: c["apart"] & ((c["cue"] == 0) | c["k"].isin(1, 2)))
    bad = F.transform(other, lambda c: F.struct(*(c[f].alias(f) for f in FEATURES), F.lit(0).alias("y")))
    good = F.transform("loose", lambda c: F.struct(*(c[f].alias(f) for f in FEATURES), F.lit(1).alias("y")))
    each = cands.where((F.size("cands") > 0) | (F.size("loose") > 0)).select(half, F.explode(F.concat(good, bad)).alias("c")).select("half", "c.*")
    bound = 4 * 21 * 10 * 2 * 2 * 4 * 2 * 2 * 4 * 2
    rows = collect_bounded(each.groupBy("half", *FEATURES).agg(F.sum("y").alias("good"), F.count("*").alias("n")), 2 * bound, "feature combinations").sort_by([(f, "ascending") for f in ("half", *FEATURES)]).to_pydict()
    x = np.array([rows[f] for f in FEATURES], np.int64).T.reshape(-1, len(FEATURES))
    y, n, seen = np.array(rows["good"], float), np.array(rows["n"], float), np.array(rows["half"]) == 0

    def walk(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    models = []
    for k in range(len(KINDS)):
        mine = x[:, 0] == k if len(x) else np.zeros(0, bool)
        if not (mine & seen).any() or not (mine & ~seen).any():
            models.append((0.0, [], None))
            continue
        learn, check = mine & seen, mine & ~seen
        start, trees = boost(x[learn], y[learn], n[learn])
        score = np.array([start + sum(walk(t, row) for t in trees) for row in x[check]])
        by = np.argsort(-score, kind="stable")
        value, good, total = score[by], np.cumsum(y[check][by]), np.cumsum(n[check][by])
        ok = np.flatnonzero(np.r_[value[1:] != value[:-1], True] & (good >= PRECISION * total) & (good > 0))
        limit = None
        if len(ok):  # where all pass, nothing speaks against lower scores, down to even odds
            limit = (min(float(value[-1]), 0.0) if ok[-1] == len(value) - 1 else float(value[ok[-1]])) - 1e-9
        models.append((start, trees, limit))
    return models


def _score(c: Column, start: float, trees: list) -> Column:
    def of(tree):
        if not isinstance(tree, tuple):
            return F.lit(tree)
        f, cut, left, right = tree
        return F.when(c[FEATURES[f]] <= cut, of(left)).otherwise(of(right))

    out = F.lit(start)
    for t in trees:
        out = out + of(t)
    return out


def found(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with base and spans, arrays of (st, k, en) by position; k numbers KINDS. Null texts have none.

    Rows of any id, repeated ones too, are judged by their own text; columns of docs named base, cands, loose, spans, _t or
    _num do not come back. An empty table gives an empty result.
    """
    work = with_candidates(with_base(docs.drop("base", "cands", "spans", "loose", "_t", "_num"), text))
    models = fit(work)
    none = F.array().cast(_SPANS)

    def passes(c):
        ok = F.lit(False)
        for k, (start, trees, limit) in enumerate(models):
            if limit is not None:
                ok = F.when(c["k"] == k, _score(c, start, trees) >= limit).otherwise(ok)
        return ok

    more = F.filter("cands", passes)
    free = F.filter(more, lambda c: ~F.exists("base", lambda b: (b["st"] < c["en"]) & (c["st"] < b["en"])))
    free = F.sort_array(F.transform(free, lambda c: F.struct((c["st"] - c["en"]).alias("o"), c["st"].alias("st"), c["k"].alias("k"), c["en"].alias("en"))))
    added = F.aggregate(free, none, lambda s, c: F.when(F.exists(s, lambda b: (b["st"] < c["en"]) & (c["st"] < b["en"])), s).otherwise(F.concat(s, F.array(F.struct(c["st"].alias("st"), c["k"].alias("k"), c["en"].alias("en"))))))
    spans = F.when(F.size("cands") > 0, F.sort_array(F.concat(F.col("base"), added))).otherwise(F.col("base"))
    return work.withColumn("spans", spans).drop("_t", "_num", "cands", "loose")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs``, same columns whatever their names, every span of text replaced by its kind in brackets (overlapping spans by
    the first's)."""
    columns = docs.columns
    work = found(docs.select(F.struct(*columns).alias("own"), F.col("text").cast("string").alias("text")))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s, x):
        label = F.concat(F.lit("["), F.upper(F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1)), F.lit("]"))
        put = F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, x["st"] - s["at"]), label)
        fresh = x["st"] >= s["at"]
        return F.struct(F.greatest(s["at"], x["en"]).alias("at"), F.when(fresh, put).otherwise(s["out"]).alias("out"))

    done = F.aggregate("spans", start, step, lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    new = {"text": F.when(F.size("spans") > 0, done).otherwise(F.col("text"))}
    if "n_chars" in columns:
        new["n_chars"] = F.when(F.size("spans") > 0, F.length(done).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("own.n_chars"))
    return work.select(*(new.get(c, F.col("own")[c]).alias(c) for c in columns))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["st"].cast("string"), x["en"].cast("string"))), ",")


def op2_boosted_pii_spans(spark, sf_dir: str) -> DataFrame:
    work = found(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(k):
        return F.size(F.filter("base", lambda b: b["k"] == k)).cast("long")

    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return work.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
