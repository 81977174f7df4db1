"""Chat formatting in budgeted windows.

Turns are put in order (turn, role, text) and their tokens estimated; prefix sums of these cut a conversation into
turn-aligned windows. Every window repeats the system turn and as much of the turns before it as the history budget
holds; a turn too large for the budget has a window of its own. Each turn is new in one window only, and only
there is an assistant's text under the loss mask; repeated ones are masked.

A turn is ``<turn ROLE INDEX FLAG>TEXT</turn>``, FLAG being L (new, in the loss), N (new) or R (repeated), in
``<window>...</window>``. Texts and roles are escaped: backslash, ``<``, ``[``, ``>`` and space (the last two in roles
only) become a backslash and a letter, so no control string of this or other templates is left inside, and
reading back restores every text exactly. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

BUDGET = 1024
HISTORY = 256
OVERHEAD = 4
ROLE_CODES = ((" ", "\\s"), (">", "\\g"))
CODES = (("<", "\\a"), ("[", "\\b"))


def escape(col, codes=CODES):
    col = F.replace(col, F.lit("\\"), F.lit("\\\\"))
    for raw, code in codes:
        col = F.replace(col, F.lit(raw), F.lit(code))
    return col


def unescape(col):
    """Pairs of backslashes are found from the left, so what is between them holds whole codes only."""

    def inner(part):
        for raw, code in CODES + ROLE_CODES:
            part = F.replace(part, F.lit(code), F.lit(raw))
        return part

    return F.array_join(F.transform(F.split(col, r"\\\\", -1), inner), "\\")


def formatted(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id and windows (array of strings) of every conversation (conv_id, turn, role, text).

    Null roles and texts are empty, null turns come first, repeated rows stay as turns; rows of a null conv_id are one
    conversation. Extra columns are ignored.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    convs = convs.withColumn("k", F.transform("t", lambda t: F.ceil(F.length(t["text"]) / 4) + F.lit(OVERHEAD)))
    convs = convs.withColumn("sums", F.expr("aggregate(k, array(0L), (s, x) -> concat(s, array(element_at(s, -1) + x)))"))
    convs = convs.withColumn("sys", F.expr("CASE WHEN element_at(t, 1).role = 'system' THEN 1 ELSE 0 END"))
    convs = convs.withColumn("room", F.expr(f"greatest({budget // 4}L, {budget - history} - IF(sys = 1, k[0], 0L))"))
    starts = """aggregate(sequence(1, size(t) - 1), array(0), (s, i) ->
        IF(sums[i + 1] - sums[element_at(s, -1)] > room, concat(s, array(i)), s))"""
    convs = convs.withColumn("starts", F.expr(f"IF(size(t) > 1, {starts}, array(0))"))
    convs = convs.withColumn("spans", F.expr(f"""transform(starts, (s, w) -> named_struct(
        'h', greatest(least(sys, s), size(filter(slice(sums, 1, s), x -> sums[s] - x > {history}))),
        's', s, 'e', IF(w + 1 < size(starts), starts[w + 1], size(t))))"""))
    convs = convs.withColumn("e", F.transform("t", lambda t: F.struct(escape(t["role"], CODES + ROLE_CODES).alias("role"), escape(t["text"]).alias("text"), (t["role"] == "assistant").alias("says"))))

    def turn(i, fresh):
        e = F.col("e")[i]
        flag = F.when(e["says"], "L").otherwise("N") if fresh else F.lit("R")
        return F.concat(F.lit("<turn "), e["role"], F.lit(" "), i.cast("string"), F.lit(" "), flag, F.lit(">"), e["text"], F.lit("</turn>"))

    def run(lo, hi, fresh):
        none = F.array().cast("array<string>")
        return F.when(lo < hi, F.transform(F.sequence(lo, F.greatest(lo, hi - 1)), lambda i: turn(i, fresh))).otherwise(none)

    def window(x):
        system = F.when((F.col("sys") == 1) & (x["s"] > 0), F.array(turn(F.lit(0), False))).otherwise(F.array().cast("array<string>"))
        parts = F.concat(system, run(x["h"], x["s"], False), run(x["s"], x["e"], True))
        return F.concat(F.lit("<window>"), F.array_join(parts, ""), F.lit("</window>"))

    return convs.select("conv_id", F.transform("spans", window).alias("windows"))


def read_back(windows: DataFrame) -> DataFrame:
    """The other columns and turns (array of index, role, text, loss) as the windows' text has them, each where it is new."""
    whole = F.array_join("windows", "")
    found = r"<turn ([^ <>]*) ([0-9]+) ([LNR])>([^<]*)</turn>"
    keep = [c for c in windows.columns if c != "windows"]
    got = windows.select(*keep, *(F.regexp_extract_all(whole, F.lit(found), F.lit(g)).alias(n) for g, n in enumerate(("role", "index", "flag", "text"), 1)))
    turns = F.filter(F.arrays_zip("role", "index", "flag", "text"), lambda t: t["flag"] != "R")
    return got.select(*keep, F.transform(turns, lambda t: F.struct(t["index"].cast("int").alias("index"), unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text"), (t["flag"] == "L").alias("loss"))).alias("turns"))


def op7_budgeted_chat_windows(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    windows = formatted(turns.unionByName(more))
    size = F.expr("aggregate(windows, 0L, (s, x) -> s + length(x))")
    whole = windows.select("conv_id", "windows", size.alias("formatted_chars"), F.size("windows").cast("long").alias("n_windows"))
    back = read_back(whole)
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars", "n_windows")


_LONG = "length({0}) + length(regexp_replace({0}, '[^{1}]', '', 'g'))"
#: The query in SQL: turns numbered by a window, windows begun by a recursion over the turns, characters counted without making them.
SQL = rf"""WITH RECURSIVE said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, role)),
numbered AS (SELECT *, row_number() OVER o - 1 AS i, ceil(length(text) / 4)::BIGINT + {OVERHEAD} AS k FROM said WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
turns AS (SELECT *, sum(k) OVER (PARTITION BY conv_id ORDER BY i) AS upto, {len("<turn   L></turn>")} + {_LONG.format("role", r"\\<\[ >")} + length(i::VARCHAR) + {_LONG.format("text", r"\\<\[")} AS chars FROM numbered),
convs AS (SELECT conv_id, count(*) AS n, max(CASE WHEN i = 0 AND role = 'system' THEN 1 ELSE 0 END) AS sys, max(CASE WHEN i = 0 AND role = 'system' THEN k ELSE 0 END) AS sys_k, max(CASE WHEN i = 0 AND role = 'system' THEN chars ELSE 0 END) AS sys_chars,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256, coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '') AS loss, sum(chars) AS fresh FROM turns GROUP BY conv_id),
walk AS (SELECT conv_id, 0::BIGINT AS i, 0::BIGINT AS s, 0::HUGEINT AS before FROM convs
  UNION ALL SELECT w.conv_id, t.i, CASE WHEN t.upto - w.before > greatest({BUDGET // 4}, {BUDGET - HISTORY} - c.sys_k) THEN t.i ELSE w.s END, CASE WHEN t.upto - w.before > greatest({BUDGET // 4}, {BUDGET - HISTORY} - c.sys_k) THEN t.upto - t.k ELSE w.before END
  FROM walk w JOIN turns t ON t.conv_id = w.conv_id AND t.i = w.i + 1 JOIN convs c ON c.conv_id = w.conv_id),
windows AS (SELECT DISTINCT conv_id, s, before FROM walk),
again AS (SELECT w.conv_id, w.s, coalesce(sum(t.chars) FILTER (t.i >= c.sys AND w.before - (t.upto - t.k) <= {HISTORY}), 0) + CASE WHEN w.s > 0 THEN any_value(c.sys_chars) ELSE 0 END + {len("<window></window>")} AS chars
  FROM windows w JOIN convs c ON c.conv_id = w.conv_id LEFT JOIN turns t ON t.conv_id = w.conv_id AND t.i < w.s GROUP BY w.conv_id, w.s),
more AS (SELECT conv_id, sum(chars) AS chars, count(*) AS n_windows FROM again GROUP BY conv_id)
SELECT c.conv_id, c.n AS n_turns, c.turns_sha256, length(c.loss)::BIGINT AS loss_chars, sha256(c.loss) AS loss_sha256, (c.fresh + m.chars)::BIGINT AS formatted_chars, m.n_windows FROM convs c JOIN more m ON m.conv_id = c.conv_id"""
