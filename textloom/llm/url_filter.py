"""URL filter: listed rules, else an empirical-Bayes reputation of the host.

Labelled page outcomes (quality 1 or 0) are shrunk through beta-binomial priors: all pages to suffix (last label),
suffix to registered domain (last two), domain to host. Each level's prior strength is fitted by moments to
the spread of its groups around their parents. A page is blocked if its host's posterior bound says that good pages
are fewer than a limit. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: (verdict, host, path): fixed values of the task.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
LIMIT = 0.5
Z = 1.64
LEVELS = ("suffix", "domain", "host")


def parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with host and path: after the first ``://`` up to / ? # (A-Z lowered), then up to ? or #; else both empty."""
    rest = F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": ascii_lower(host), "path": path})


def rule_of(rules=RULES):
    """The longest fitting rule as ``host/path`` and its verdict, from columns host and path; null if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _levels(df: DataFrame) -> DataFrame:
    return df.withColumns({"suffix": F.substring_index("host", ".", -1), "domain": F.substring_index("host", ".", -2)})


def reputation(outcomes: DataFrame) -> dict:
    """For each level a frame (group, a, b) of posterior beta counts, and under "all" those of all pages. ``outcomes``: host, good (0 or 1).

    A level's prior for a group is its parent's posterior mean times the level's strength ``s``, the moment
    estimate ``(mean(p (1 - p)) - v) / max(v - sampling variance, tiny)`` kept within 1 and 1000. Hot hosts are summed
    before any shuffle. No outcomes: no groups.
    """
    hosts = _levels(outcomes.groupBy("host").agg(F.sum("good").cast("double").alias("g"), F.count("good").cast("double").alias("n")))
    good, n = (x or 0.0 for x in hosts.agg(F.sum("g"), F.sum("n")).first())
    whole = (good + 1, n - good + 1)
    out: dict = {"all": whole}
    above, parent = None, None
    for level in LEVELS:
        keys = [level] if parent is None else [level, parent]
        own = hosts.groupBy(*keys).agg(F.sum("g").alias("g"), F.sum("n").alias("n"))
        if parent is None:
            own = own.withColumn("m", F.lit(whole[0] / sum(whole)))
        else:
            own = own.join(above.select(parent, (F.col("a") / (F.col("a") + F.col("b"))).alias("m")), parent)
        spread, free = F.col("n") * F.pow(F.col("g") / F.col("n") - F.col("m"), 2), F.col("m") * (1 - F.col("m"))
        total, S, V, W = (x or 0.0 for x in own.agg(F.sum("n"), F.sum(spread), F.sum(F.col("n") * free), F.sum(free)).first())
        s = min(1000.0, max(1.0, V / max(total, 1.0) / max((S - W) / max(total, 1.0), 1e-6) - 1))
        above = own.select(*keys, (F.col("m") * s + F.col("g")).alias("a"), ((1 - F.col("m")) * s + F.col("n") - F.col("g")).alias("b"))
        out[level] = above.select(level, "a", "b")
        parent = level
    return out


def judged(pages: DataFrame, labels: DataFrame, rules=RULES, limit: float = LIMIT, z: float = Z) -> DataFrame:
    """page_id, host, path, rule, verdict, reputation, upper for every page; repeated pages stay.

    Outcomes are ``labels`` rows (doc_id, quality) of the page with that id, the worst of repeated ones; null labels are
    none. Without a rule the verdict is block if ``upper``, the posterior mean of the nearest known level plus z
    standard deviations, is below ``limit``, else allow. Hosts, also hot ones, are joined by shuffle, never broadcast.
    """
    pages = parts(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url")))
    label = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(F.min(F.col("quality").cast("int")).alias("good"))
    rep = reputation(pages.where("host <> ''").join(label, "page_id").select("host", "good"))
    hosts = _levels(pages.groupBy("host").count())
    for level in LEVELS:
        hosts = hosts.join(rep[level].select(level, F.col("a").alias(f"a_{level}"), F.col("b").alias(f"b_{level}")), level, "left")
    a, b = (F.coalesce(*(F.col(f"{c}_{level}") for level in reversed(LEVELS)), F.lit(x)) for c, x in zip("ab", rep["all"]))
    hosts = hosts.select("host", a.alias("a"), b.alias("b"))
    mean = F.col("a") / (F.col("a") + F.col("b"))
    upper = mean + z * F.sqrt(mean * (1 - mean) / (F.col("a") + F.col("b") + 1))
    hosts = hosts.select("host", F.round(mean, 6).alias("reputation"), F.round(upper, 6).alias("upper"))
    rule, verdict = rule_of(rules)
    out = pages.withColumns({"rule": rule, "listed": verdict}).join(hosts, "host", "left")
    verdict = F.coalesce("listed", F.when(F.col("upper") < limit, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "reputation", "upper")


def op3_host_reputation(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def _level_sql(level: str, parent: str | None) -> str:
    """SQL of a level's posterior counts from the hosts' and its parent's."""
    mean, keys = (f"p_{parent}.a / (p_{parent}.a + p_{parent}.b)", f"{level}, {parent}") if parent else ("(SELECT a / (a + b) FROM everything)", level)
    joined = f" JOIN p_{parent} USING ({parent})" if parent else ""
    return f"""o_{level} AS (SELECT o.*, {mean} AS m FROM (SELECT {keys}, sum(g) AS g, sum(n) AS n FROM hosts GROUP BY {keys}) o{joined}),
s_{level} AS (SELECT least(1000, greatest(1, sum(n * m * (1 - m)) / greatest(sum(n), 1) / greatest((sum(n * pow(g / n - m, 2)) - sum(m * (1 - m))) / greatest(sum(n), 1), 1e-6) - 1)) AS s FROM o_{level}),
p_{level} AS (SELECT {keys}, m * s + g AS a, (1 - m) * s + n - g AS b FROM o_{level}, s_{level})"""


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SQL = rf"""WITH rests AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
urls AS (SELECT row_number() OVER () AS k, page_id, translate(regexp_extract(rest, '\A[^/?#]*'), '{_UPPER}', '{_UPPER.lower()}') AS host, regexp_extract(rest, '\A[^/?#]*([^?#]*)', 1) AS path FROM rests),
cut AS (SELECT *, regexp_extract(host, '[^.]*\z') AS suffix, regexp_extract(host, '[^.]*(\.[^.]*)?\z') AS domain FROM urls),
rules(verdict, h, p) AS (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)}),
listed AS (SELECT k, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict FROM urls JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY k),
outcomes AS (SELECT doc_id, min(quality)::DOUBLE AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
hosts AS (SELECT host, domain, suffix, sum(good) AS g, count(*)::DOUBLE AS n FROM cut JOIN outcomes ON doc_id = page_id WHERE host <> '' GROUP BY ALL),
everything AS (SELECT coalesce(sum(g), 0) + 1 AS a, coalesce(sum(n) - sum(g), 0) + 1 AS b FROM hosts),
{_level_sql("suffix", None)},
{_level_sql("domain", "suffix")},
{_level_sql("host", "domain")},
known AS (SELECT c.*, coalesce(h.a, d.a, s.a, e.a) AS a, coalesce(h.b, d.b, s.b, e.b) AS b FROM cut c CROSS JOIN everything e LEFT JOIN p_host h ON h.host = c.host LEFT JOIN p_domain d ON d.domain = c.domain LEFT JOIN p_suffix s ON s.suffix = c.suffix),
bound AS (SELECT k, page_id, host, path, round(a / (a + b), 6) AS reputation, round(a / (a + b) + {Z} * sqrt(a / (a + b) * (b / (a + b)) / (a + b + 1)), 6) AS upper FROM known)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN upper < {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, reputation, upper FROM bound LEFT JOIN listed USING (k)"""
