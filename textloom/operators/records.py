"""Conversations, preference pairs, instruction records and traces, and the explorer over all kinds."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Role names and keys of training records.
ROLE_KEYS = ("role", "speaker", "from", "author")
ROLES = {
    "user": ("user", "human", "question"),
    "assistant": ("assistant", "model", "bot", "answer"),
    "system": ("system", "sys"),
    "tool": ("tool", "function"),
}
TRACE_KEYS = ("trace_type", "trace", "steps", "tool_calls", "trajectory")


def role(name: Column) -> Column:
    out = F.lit("user")
    for to, names in ROLES.items():
        out = F.when(F.lower(name).isin(*names), to).otherwise(out)
    return out


def kind(record: Column) -> Column:
    """Kind of a JSON record by its keys: conversation, instruction, preference, completion, trace, or null for plain text."""
    has = lambda *ks: F.forall(F.array(*map(F.lit, ks)), lambda k: F.array_contains(F.coalesce(F.json_object_keys(record), F.array().cast("array<string>")), k))
    trace = F.lit(False)
    for k in TRACE_KEYS:
        trace = trace | has(k)
    return F.when(has("conversations") | has("messages"), "conversation").when(has("instruction"), "instruction").when(has("prompt") & has("chosen") & has("rejected"), "preference").when(has("prompt") & has("completion"), "completion").when(trace, "trace")


_TURN = "array<struct<role:string,from:string,speaker:string,author:string,content:string,value:string,text:string>>"


def messages(record: Column) -> Column:
    """Array of (role, content) of a conversation or instruction record, empty for other kinds."""
    raw = F.coalesce(F.get_json_object(record, "$.messages"), F.get_json_object(record, "$.conversations"))
    turns = F.transform(F.from_json(raw, _TURN), lambda t: F.struct(role(F.coalesce(t["role"], t["speaker"], t["from"], t["author"])).alias("role"), F.coalesce(t["content"], t["value"], t["text"], F.lit("")).alias("content")))
    get = lambda k: F.coalesce(F.get_json_object(record, f"$.{k}"), F.lit(""))
    ask = F.concat(get("instruction"), F.when(get("input") != "", F.concat(F.lit("\n"), get("input"))).otherwise(""))
    alpaca = F.array(F.struct(F.lit("user").alias("role"), ask.alias("content")), F.struct(F.lit("assistant").alias("role"), get("output").alias("content")))
    none = F.array().cast("array<struct<role:string,content:string>>")
    return F.coalesce(F.when(raw.isNotNull(), turns), F.when(get("instruction") != "", alpaca), none)


def flat_messages(value: Column) -> Column:
    """A prompt given as a list of messages becomes ``role: content`` lines; a plain string stays."""
    turns = F.from_json(value, "array<struct<role:string,content:string>>")
    joined = F.array_join(F.transform(turns, lambda t: F.concat(F.coalesce(t["role"], F.lit("user")), F.lit(": "), F.coalesce(t["content"], F.lit("")))), "\n")
    return F.when(value.rlike(r"^\s*\["), joined).otherwise(value)


def canonical(record: Column) -> Column:
    """JSON with sorted keys, so that records equal but for the order of keys have equal hashes; null if malformed."""

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        def one(x):
            try:
                return json.dumps(json.loads(x), sort_keys=True, ensure_ascii=False)
            except (TypeError, ValueError):
                return None

        return rows.map(one)

    return run(record)


def flat_text(record: Column) -> Column:
    """All values of a JSON value, nested ones too, joined by blanks; malformed JSON is its own text."""

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        def values(x):
            if isinstance(x, dict):
                return [v for y in x.values() for v in values(y)]
            if isinstance(x, list):
                return [v for y in x for v in values(y)]
            return [x if isinstance(x, str) else str(x or "")]

        def one(x):
            try:
                return " ".join(values(json.loads(x)))
            except (TypeError, ValueError):
                return x or ""

        return rows.map(one)

    return run(record)


def structured(records: DataFrame, column: str = "value") -> dict[str, DataFrame]:
    """Frames by kind from JSON lines; records equal but for the order of keys count once. Blank and malformed lines
    are in none."""
    r = F.col(column)
    rows = records.where(r.rlike(f"[^{T.SPACE}]")).select(r.alias("record"), kind(r).alias("kind")).where("kind is not null")
    rows = rows.withColumn("content_hash", F.sha2(canonical(F.col("record")), 256)).dropDuplicates(["content_hash"])
    get = lambda k: F.get_json_object("record", f"$.{k}")
    tokens = lambda *cs: sum((F.floor(F.length(F.coalesce(F.col(c), F.lit(""))) / 4) for c in cs), F.lit(0)).cast("long")
    talk = rows.where("kind in ('conversation', 'instruction')").select("content_hash", messages(F.col("record")).alias("messages"))
    return {
        "conversations": talk.withColumn("turn_count", F.size("messages")),
        "preferences": rows.where("kind = 'preference'").select("content_hash", *(flat_messages(get(k)).alias(k) for k in ("prompt", "chosen", "rejected")), F.coalesce(get("strategy"), F.lit("manual")).alias("strategy"), F.lit("pending").alias("status")).withColumn("tokens", tokens("prompt", "chosen", "rejected")),
        "sft": rows.where("kind = 'completion'").select("content_hash", get("prompt").alias("prompt"), get("completion").alias("completion"), get("system").alias("system_prompt")).withColumn("tokens", tokens("prompt", "completion")),
        "traces": rows.where("kind = 'trace'").select("content_hash", F.coalesce(get("trace_type"), F.lit("agent")).alias("trace_type"), get("trace_id").alias("trace_id"), F.col("record").alias("trace"), get("error").alias("error"), get("success").cast("boolean").alias("success")).withColumn("tokens", tokens("trace")),
    }


def unseen(new: DataFrame, old: DataFrame, key: str = "content_hash") -> DataFrame:
    """New rows whose key is not there yet; null keys always are new."""
    return new.join(old.select(key).distinct(), key, "left_anti")


def conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation with ordered messages, turn_count, total_tokens, last role and has_tools; rows (conv_id, turn,
    role, text), and tool_calls or agent_trace where there are any."""
    tools = F.lit(False)
    for c in ("tool_calls", "agent_trace"):
        if c in turns.columns:
            filled = F.size(c) > 0 if turns.schema[c].dataType.typeName() == "array" else F.col(c).isNotNull()
            tools = tools | F.coalesce(filled, F.lit(False))
    t = turns.select("conv_id", tools.alias("tools"), F.struct("turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("content")).alias("m"))
    out = t.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("messages"), F.bool_or("tools").alias("has_tools"))
    tokens = F.aggregate("messages", F.lit(0).cast("long"), lambda s, m: s + F.floor(F.length(m["content"]) / 4))
    last = F.element_at("messages", -1)["role"]
    return out.select("conv_id", "messages", F.size("messages").cast("long").alias("turn_count"), tokens.alias("total_tokens"), last.alias("last_role"), (~last.isin("assistant", "tool")).alias("missing_final"), "has_tools")


ENVELOPE = ("id", "kind", "title", "preview", "status", "tokens", "language", "created_at", "has_tools", "missing_final", "body")


def _envelope(rows: DataFrame, kind_: str, id_: str, title: Column, body: Column, status: Column, tokens: Column, preview: int, shown: Column | None = None, tools: Column | None = None, open_: Column | None = None) -> DataFrame:
    """One kind's rows in the shape all kinds share; language and created_at where the rows have them."""
    own = lambda c: F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string")
    shown = body if shown is None else shown
    no = F.lit(None).cast("boolean")
    return rows.select(F.concat(F.lit(f"{kind_}-"), F.col(id_).cast("string")).alias("id"), F.lit(kind_).alias("kind"), title.alias("title"), F.substring(shown, 1, preview).alias("preview"), F.coalesce(status, F.lit("pending")).alias("status"), tokens.cast("long").alias("tokens"), own("language").alias("language"), own("created_at").alias("created_at"), (no if tools is None else tools).alias("has_tools"), (no if open_ is None else open_).alias("missing_final"), body.alias("body"))


def explorer(items: DataFrame | None = None, talks: DataFrame | None = None, pairs: DataFrame | None = None, sft: DataFrame | None = None, traces: DataFrame | None = None, preview: int = 120) -> DataFrame:
    """One envelope for texts, conversations (conversations()), preference pairs (id, prompt, chosen, rejected, status), SFT records
    (id, messages, status) and traces (id, trace as JSON, success, error). body is the whole text of a record, for search.

    A trace calls tools if its text names them; it misses its end if it failed, has an error or nowhere says "final".
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    contents = lambda c: F.array_join(F.transform(c, lambda m: m["content"]), " ")
    length = lambda c: F.floor(F.length(empty(c)) / 4)
    parts = []
    if items is not None:
        parts.append(_envelope(items, "text", "id", F.col("dataset_id"), F.col("text"), F.col("decision"), F.col("tokens"), preview))
    if talks is not None:
        status = F.when(F.col("missing_final"), "review").otherwise("pending")
        first = F.element_at("messages", 1)["content"]
        parts.append(_envelope(talks, "conversation", "conv_id", F.concat(F.lit("conversation "), F.col("conv_id").cast("string")), contents("messages"), status, F.col("total_tokens"), preview, first, F.col("has_tools"), F.col("missing_final")))
    if pairs is not None:
        status = F.when(F.col("status") == "approved", "keep").when(F.col("status") == "rejected", "reject").when(F.col("status") == "pending", "review").otherwise(F.col("status"))
        body = F.concat_ws(" ", empty("prompt"), empty("chosen"), empty("rejected"))
        parts.append(_envelope(pairs, "preference", "id", F.concat(F.lit("preference "), F.col("id").cast("string")), body, status, length("prompt") + length("chosen") + length("rejected"), preview, empty("prompt")))
    if sft is not None:
        tokens = F.aggregate("messages", F.lit(0).cast("long"), lambda s, m: s + F.floor(F.length(m["content"]) / 4))
        parts.append(_envelope(sft, "sft", "id", F.concat(F.lit("sft "), F.col("id").cast("string")), contents("messages"), F.col("status"), tokens, preview))
    if traces is not None:
        rows = traces.withColumn("_body", flat_text(F.col("trace")))
        low, ok = F.lower("_body"), F.coalesce(F.col("success"), F.lit(False))
        failed = F.coalesce(~F.col("success"), F.lit(False)) | (empty("error") != "") | ~low.contains("final")
        parts.append(_envelope(rows, "trace", "id", F.concat(F.lit("trace "), F.col("id").cast("string")), F.col("_body"), F.when(ok, "keep").otherwise("review"), F.floor(F.length(empty("trace")) / 4), preview, None, low.contains("tool_call") | low.contains("function"), failed))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def search(records: DataFrame, q: str | None = None, kind_: str | None = None, status: str | None = None, order: str = "recent", limit: int = 500, offset: int = 0, has_tool_calls: bool = False, missing_final: bool = False, ids: DataFrame | None = None) -> DataFrame:
    """Explorer rows by kind, status, flags, ids and a case-insensitive substring of title, preview and body; one page, 500
    rows at most. Filters on flags leave conversations and traces alone."""
    if kind_:
        records = records.where(F.col("kind") == kind_)
    if has_tool_calls:
        records = records.where("has_tools")
    if missing_final:
        records = records.where("missing_final")
    if ids is not None:
        records = records.join(ids.select("id").distinct(), "id", "left_semi")
    if status:
        records = records.where(F.col("status") == status)
    if q and q.strip():
        records = records.where(F.lower(F.concat_ws(" ", "title", "preview", "body")).contains(q.strip().lower()))
    rank = F.lit(5)
    for i, s in enumerate(("review", "quarantine", "pending", "keep", "reject")):
        rank = F.when(F.col("status") == s, i).otherwise(rank)
    name = F.lower("title")
    orders = {"tokens": ["tokens", name, "id"], "name": [name, "id"], "pending_first": [rank, name, "id"], "recent": [F.desc("created_at"), "id"]}
    return records.orderBy(*orders[order]).offset(max(0, offset)).limit(max(1, min(limit, 500)))
