"""Text normalisation as column expressions; only entity decoding and NFKC, which SQL lacks, run in Arrow functions."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import PRIVACY, SPACE, let, strip_tags, text_of

# What the normalisation steps look for. The line patterns are possessive, so that long lines take linear time.
BLANKS = r"[ \t\x0b\f\x{a0}\x{200b}\x{200c}\x{200d}\x{2060}\x{feff}]+"
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
BOILERPLATE_STARTS = (
    "cookie", "advertis", "advertisement", "subscribe", "sign ?up", "log ?in", "share this", "follow us", "click here", "all rights reserved",
    "copyright ©", "skip to (?:main )?content", "jump to comments",
)
BOILERPLATE_LINES = (
    rf"(?iu)\A[{SPACE}]*+\[?edit\]?[{SPACE}]*+\z",
    rf"(?iu)\A[{SPACE}]*+(?:{'|'.join(BOILERPLATE_STARTS)})",
    rf"\A[{SPACE}]*+\|[{SPACE}:|-]{{3,}}+\z",
    rf"\A[-*_](?:[{SPACE}]*+[-*_]){{2}}[-*_{SPACE}]*+\z",
    rf"(?U)\A[{SPACE}]*+(?:\d++[{SPACE}]*+[.)][{SPACE}]*+){{1,3}}\z",
)
BOILERPLATE_LINKS = (rf"\A[{SPACE}]*+https?://[^{SPACE}]", "^https?://.")
STEPS = ("html", "unicode", "whitespace", "boilerplate")

#: The characters of SPACE, and those that may end a line's text.
_SPACES = "".join(c for c in map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_IN_LINE = _SPACES.replace("\n", "")


def trimmed(text: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(text, F.lit(_SPACES))


def _decoded(text: Column) -> Column:
    """Character references resolved; texts without an ampersand do not leave the JVM's rows as values."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(html.unescape, na_action="ignore")

    return F.coalesce(run(F.when(text.contains("&"), text)), text)


def _compatible(text: Column) -> Column:
    """NFKC; ASCII texts are that already."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")

    return F.coalesce(run(F.when(text.rlike(r"[^\x00-\x7f]"), text)), text)


def collapse_whitespace(text: Column) -> Column:
    """Line ends as line feeds, runs of blanks as one, none at line ends, one empty line at most, none around the text."""
    text = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"\A\x{feff}+", "")
    one = BLANKS.removesuffix("+")
    text = F.regexp_replace(text, rf"{one}{{2,}}+|{one.replace('[ ', '[')}", " ")  # a single plain blank stays as it is
    text = F.array_join(F.transform(F.split(text, "\n", -1), lambda x: F.rtrim(x, F.lit(_IN_LINE))), "\n")
    return trimmed(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def is_boilerplate(line: Column) -> Column:
    """Whether a line is an edit link, a notice, links alone, a table's rule, a line of dashes or enumeration marks."""
    found = F.lit(False)
    for p in BOILERPLATE_LINES:
        found = found | line.rlike(p)
    first, each = BOILERPLATE_LINKS
    tokens = F.regexp_extract_all(line, F.lit(f"[^{SPACE}]+"), F.lit(0))
    return found | (line.rlike(first) & F.forall(tokens, lambda t: t.rlike(each)))


def remove_boilerplate(text: Column) -> Column:
    """Boilerplate lines go first; then a line goes if it repeats the one before it and is not blank."""

    def once(left):
        return F.filter(left, lambda x, i: (i == 0) | ~x.rlike(f"[^{SPACE}]") | (x != F.get(left, i - 1)))

    return trimmed(F.array_join(let(F.filter(F.split(text, "\n", -1), lambda x: ~is_boilerplate(x)), once), "\n"))


def normalize(text: Column) -> Column:
    """Struct of the normalised text and a flag per step that changed it; null counts as empty. Each step runs once a text."""
    text = text_of(text)
    plain = strip_tags(_decoded(text))
    begun = F.struct(text.alias("text"), plain.alias("plain"), F.regexp_replace(_compatible(plain), CONTROLS, "").alias("clean"))

    def finished(b, spaced):
        def of(out):
            changes = [(b["plain"] != b["text"]).alias("html"), (b["clean"] != b["plain"]).alias("unicode"), (spaced != b["clean"]).alias("whitespace"), (out != spaced).alias("boilerplate")]
            return F.struct(out.alias("text"), *changes)

        return let(remove_boilerplate(spaced), of)

    return let(begun, lambda b: let(collapse_whitespace(b["clean"]), lambda spaced: finished(b, spaced)))


def not_nfc(text: Column) -> Column:
    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: not unicodedata.is_normalized("NFC", t or ""))

    return run(text)


def starts(text: Column, pattern: str) -> Column:
    """Code point positions of the leftmost non-overlapping matches."""

    def at(found):
        lens = F.transform(found, lambda m: F.length(m))
        gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda g: F.length(g))
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

        def step(s, x):
            here = s["at"] + x["gap"]
            return F.struct((here + x["len"]).alias("at"), F.concat(s["out"], F.array(here)).alias("out"))

        return F.aggregate(F.zip_with(gaps, lens, lambda g, n: F.struct(g.alias("gap"), n.alias("len"))), none, step, lambda s: s["out"])

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), at)


def privacy(text: Column) -> Column:
    """Struct of pii, types (sorted kinds) and evidence (the first ten kind@start, kind by kind); null counts as empty."""
    text = text_of(text)

    def hits_of(kind):
        return F.transform(starts(text, f"(?U){PRIVACY[kind]}"), lambda at: F.struct(F.lit(kind).alias("kind"), at.alias("at")))

    hits = F.concat(*map(hits_of, PRIVACY))

    def of(found):
        shown = F.transform(F.slice(found, F.lit(1), F.lit(10)), lambda h: F.concat(h["kind"], F.lit("@"), h["at"].cast("string")))
        return F.struct((F.size(found) > 0).alias("pii"), F.array_sort(F.array_distinct(F.transform(found, lambda h: h["kind"]))).alias("types"), F.array_join(shown, ", ").alias("evidence"))

    return let(hits, of)
