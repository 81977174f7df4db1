"""Per-document column functions; all run in the JVM but the Arrow functions at the end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists, prefixes and patterns of the analyzers.
EN_WORDS = ("the", "and", "is", "of", "to", "in", "a", "it", "that", "with", "for")
PT_WORDS = ("o", "a", "e", "de", "que", "se", "para", "com", "não", "uma", "em")
ES_WORDS = ("el", "la", "de", "que", "y", "en", "un", "una", "los", "las")
OFFENSIVE = ("fuck", "shit", "ass", "bitch", "dick", "cunt", "bastard", "slut", "whore", "nigger", "retard", "fag", "spic", "chink")
CODE_STARTS = ("def ", "import ", "class ", "from ", "return ", "if ", "for ", "while ", "print(", "const ", "let ", "var ", "function ")
CODE_ENDS = (":", "(", "{")
PII_PATTERNS = (
    r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b",
    r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
    r"\b\d{3}-\d{2}-\d{4}\b",
    r"\b(?:\d[ -]*?){13,16}\b",
    r"\b(?:\d{4}[ -]?){3}\d{4}\b",
)
REDACTIONS = (
    r"[\w.-]+@[\w.-]+\.\w+",
    r"\(?\d{2}\)?\s?\d{4,5}[-\s]?\d{4}",
    r"\b(?:\d[ -]*?){13,16}\b",
    r"\b\d{3}[ -]?\d{2}[ -]?\d{4}\b",
)
PRIVACY = {
    "email": r"\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b",
    "phone": r"(?<!\d)(?:\+?\d[\d ()-]{7,}\d)(?!\d)",
    "card": r"(?<!\d)(?:\d[ -]?){13,19}(?!\d)",
    "secret": r"(?i)\b(?:api[_ -]?key|secret|token|password)\s*[:=]\s*\S+",
}
MASK = "[REDACTED]"
# White space and line ends as Python's str methods see them.
SPACE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# The first class is a part of the second that Java tells fast; most words are of it alone.
WORDS = rf"(?:[!-~\x{{a1}}-\x{{167f}}]++|[^{SPACE}]++)++"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
WORD = r"[\p{L}\p{N}_]+"


def text_of(col) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(col).cast("string") if isinstance(col, str) else col, F.lit(""))


def let(value: Column, body) -> Column:
    """body(value) with the value evaluated once; inside lambdas an expression would be evaluated for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def words(text: Column) -> Column:
    """Runs between white space."""
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


def lines(text: Column) -> Column:
    """Lines without their ends; a last end opens no line, and an empty text has none."""
    body = F.regexp_replace(text, rf"(?:{LINE_END})\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, LINE_END, -1))


def ascii_words(text: Column) -> Column:
    """Distinct lower-case tokens of a-z alone."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: w.rlike("^[a-z]+$")))


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of n tokens, joined by blanks; fewer than n tokens give none."""

    def of(t):
        starts = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(t) - (n - 1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(t, i, F.lit(n)), " "))

    return let(tokens, of)


def run_hashes(tokens: Column, n: int) -> Column:
    """64-bit hashes of all runs of n tokens; fewer tokens give none."""

    def of(h):
        starts = F.when(F.size(h) >= n, F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(h) - (n - 1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(*(F.get(h, i - 1 + k) for k in range(n))))

    return let(F.transform(tokens, lambda w: F.xxhash64(w)), of)


def tokens_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def language(text: Column) -> Column:
    """en, pt or es by stop words; en wins ties, then pt; no hit gives en."""

    def of(found):
        en, pt, es = (F.size(F.array_intersect(found, F.array(*map(F.lit, w)))) for w in (EN_WORDS, PT_WORDS, ES_WORDS))
        return F.when((en >= pt) & (en >= es), "en").when(pt >= es, "pt").otherwise("es")

    return let(ascii_words(text), of)


def stats(text: Column) -> dict[str, Column]:
    lens = F.transform(lines(text), lambda x: F.length(x))
    return {
        "char_count": F.length(text).cast("long"),
        "word_count": F.size(words(text)).cast("long"),
        "line_count": F.size(lens).cast("long"),
        "max_line_length": F.coalesce(F.array_max(lens), F.lit(0)).cast("long"),
        "min_line_length": F.coalesce(F.array_min(lens), F.lit(0)).cast("long"),
        "has_html": text.contains("<") & text.contains(">"),
        "tokens": tokens_estimate(text),
        "language": language(text),
    }


def repetition(text: Column) -> Column:
    """Share of repeated word 5-grams."""
    return let(run_hashes(words(text), 5), lambda g: F.when(F.size(g) == 0, 0.0).otherwise(1 - F.size(F.array_distinct(g)) / F.size(g)))


def repetition_stats(text: Column) -> Column:
    """Struct of repetition_score (three places), unique_grams and total_grams of word 5-grams; fewer words give zeros."""

    def of(g):
        total, unique = F.size(g), F.size(F.array_distinct(g))
        score = F.when(total == 0, 0.0).otherwise(F.round(1 - unique / total, 3))
        return F.struct(score.alias("repetition_score"), unique.cast("long").alias("unique_grams"), total.cast("long").alias("total_grams"))

    return let(run_hashes(words(text), 5), of)


def evidence_spans(text: Column, fragments: Column, most: int = 24) -> Column:
    """Array of (st, en): where fragments of 4 to 120 characters first occur, ``most`` at most, none that overlaps an
    earlier one; positions in code points, end exclusive."""
    usable = F.filter(fragments, lambda f: F.length(f).between(4, 120))
    at = F.filter(F.transform(usable, lambda f: F.struct((F.instr(text, f) - 1).alias("st"), (F.instr(text, f) - 1 + F.length(f)).alias("en"))), lambda x: x["st"] >= 0)
    none = F.array().cast("array<struct<st:int,en:int>>")

    def add(s, x):
        clash = F.exists(s, lambda b: (b["st"] < x["en"]) & (x["st"] < b["en"]))
        return F.when(clash | (F.size(s) >= most), s).otherwise(F.concat(s, F.array(x)))

    return F.aggregate(F.array_sort(at), none, add)


def spam(text: Column) -> Column:
    n = F.length(text)
    punct, upper = F.regexp_count(text, F.lit(r"[!@#$%^&*()]")), F.regexp_count(text, F.lit(r"\p{IsUppercase}"))
    return F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), punct / n * 5 + upper / n * 2))


def code_ratio(text: Column) -> Column:
    start = "|".join(s.replace("(", r"\(") for s in CODE_STARTS)
    end = "|".join("\\" + s for s in CODE_ENDS)
    # stripping is slow, so lines that cannot match are left out before it
    may = lambda x: x.rlike(f"^[{SPACE}]*+(?:{start})|(?:{end})[{SPACE}]*+$")
    hit = lambda x: may(x) & F.regexp_replace(x, f"^[{SPACE}]+|[{SPACE}]+$", "").rlike(f"^(?:{start})|(?:{end})$")
    return let(lines(text), lambda s: F.when(F.size(s) == 0, 0.0).otherwise(F.size(F.filter(s, hit)) / F.size(s)))


def toxicity(text: Column) -> Column:
    listed = F.array(*map(F.lit, OFFENSIVE))
    return let(ascii_words(text), lambda w: F.size(F.array_intersect(w, listed)) / F.greatest(F.lit(1), F.size(w)))


def pii(text: Column) -> Column:
    """Share of the patterns that occur; texts without a digit or @ are not searched."""
    hits = sum((text.rlike(p).cast("int") for p in PII_PATTERNS), F.lit(0))
    return F.when(text.rlike("[0-9@]"), hits / len(PII_PATTERNS)).otherwise(0.0)


def redact(text: Column) -> tuple[Column, Column]:
    """Text with the patterns masked one after the other, and how many substitutions that took."""
    count = F.lit(0)
    for p in REDACTIONS:
        count = count + F.regexp_count(text, F.lit(f"(?i){p}"))
        text = F.regexp_replace(text, f"(?i){p}", MASK)
    return text, count.cast("long")


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, r"<[^>\n]{1,2000}>", " ")


def has_whitespace_issue(text: Column) -> Column:
    return F.substring(text, 1, 100).rlike(r"[\t\r]")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hashes given as hex, 0b or 64-digit binary strings, 64 bits at most."""

    def bits(c):
        binary = F.regexp_replace(c, "^0b", "")
        return F.when(c.startswith("0b") | ((F.length(c) == 64) & c.rlike("^[01]+$")), F.conv(binary, 2, 16)).otherwise(F.regexp_replace(c, "^0x", ""))

    pad = lambda c: F.unhex(F.lpad(bits(c), 16, "0"))
    nibbles = lambda c: F.conv(F.hex(pad(c)), 16, -10).cast("long")
    return F.bit_count(nibbles(a).bitwiseXOR(nibbles(b)))


def jaccard_estimate(a: Column, b: Column) -> Column:
    """Share of equal positions of two signatures; 0 if empty or of unequal length."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return F.when((F.size(a) == 0) | (F.size(a) != F.size(b)), 0.0).otherwise(same / F.size(a))
