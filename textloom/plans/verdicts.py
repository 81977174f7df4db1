"""Rows that providers' answers become: PII issues, span labels, automated approvals, captions, suspect labels, manifests."""

from __future__ import annotations

import json
import posixpath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import save
from ..operators.ranking import numbered

# What a plugin may ask for.
PERMISSIONS = ("filesystem:input", "filesystem:output", "network:approved", "model:cache")


def parsed_answer(text: Column, schema: str) -> Column:
    """The first JSON object in a model's answer, as a struct; null where there is none or it is malformed."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", F.from_json(found, schema))


def captioned(caption: Column, template: str = "{caption}", prefix: str = "", suffix: str = "", separator: str = " ") -> Column:
    """A caption in its template, between prefix and suffix; a template without {caption} is an error."""
    if "{caption}" not in template:
        raise ValueError("the template must contain {caption}")
    filled = F.replace(F.lit(template), F.lit("{caption}"), F.trim(caption))
    return F.concat_ws(separator, *(x for x in (F.lit(prefix) if prefix else None, filled, F.lit(suffix) if suffix else None) if x is not None))


def pii_issues(old: DataFrame, verdicts: DataFrame, detector: str) -> DataFrame:
    """old issues with possible_pii ones of this detector replaced by those of its verdicts (text_id, pii, types, evidence)."""
    rest = old.where(~((F.col("issue_type") == "possible_pii") & F.coalesce(F.col("detector") == detector, F.lit(False))))
    new = verdicts.where("pii").select("text_id", F.lit("possible_pii").alias("issue_type"), F.lit(1.0).alias("score"), F.lit("open").alias("status"), F.lit(detector).alias("detector"), F.to_json(F.struct("types", "evidence")).alias("evidence"))
    return rest.unionByName(new, allowMissingColumns=True)


def span_labels(answers: DataFrame, model: str) -> DataFrame:
    """Pending labels from a model's spans (text_id, text, spans: array of (start, end, category, confidence)); spans outside
    their text are dropped, as they point at nothing."""
    s = F.col("s")
    rows = answers.select("text_id", "text", F.explode("spans").alias("s")).where((s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.length("text")))
    key = F.sha2(F.concat_ws("/", F.lit(model), F.col("text_id").cast("string"), s["start"].cast("string"), s["end"].cast("string"), s["category"]), 256)
    return rows.select(key.alias("id"), "text_id", s["category"].alias("category"), s["start"].alias("span_start"), s["end"].alias("span_end"), s["confidence"].alias("confidence"), F.lit(model).alias("source_type"), F.lit("pending").alias("status"), F.substring("text", s["start"] + 1, s["end"] - s["start"]).alias("value"))


def annotated(labels: DataFrame, fresh: DataFrame, model: str, at) -> DataFrame:
    """labels with a model's fresh ones; its earlier ones on the same items are superseded at the time ``at``."""
    again = fresh.select("text_id").distinct().withColumn("_again", F.lit(True))
    mine = F.coalesce("_again", F.lit(False)) & (F.col("source_type") == model) & F.col("superseded_at").isNull()
    old = labels.join(again, "text_id", "left").withColumn("superseded_at", F.when(mine, at).otherwise(F.col("superseded_at"))).drop("_again")
    return old.unionByName(fresh, allowMissingColumns=True)


def automated(labels: DataFrame, least: float, enabled: bool = True, preview: bool = False) -> tuple[DataFrame, DataFrame]:
    """labels with pending ones of enough confidence approved, and audit rows of those; off or as a preview nothing changes."""
    sure = (F.col("status") == "pending") & (F.col("confidence") >= least) & F.lit(enabled and not preview)
    audit = labels.where(sure).select(F.lit("label").alias("target_type"), F.col("id").alias("target_id"), F.lit("automation").alias("reviewer_id"), F.lit("approved").alias("decision"))
    return labels.withColumn("status", F.when(sure, "approved").otherwise(F.col("status"))), audit


def out_of_fold(rows: DataFrame, classes: int, folds: int = 5, features: int = 1 << 16, penalty: float = 0.01) -> DataFrame:
    """id, label, probabilities of rows (id, text, label: int from 0), each from a model that has not seen it: hashed words and
    multinomial logistic regression, fitted by Spark on the rows of the other folds. Folds go by a hash of the id.

    A class that the other folds lack has probability 0. Null texts have no words; rows without a label are left out.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.functions import vector_to_array

    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    some = rows.where("label is not null").select("id", F.col("label").cast("int").alias("label"), F.pmod(F.xxhash64("id"), F.lit(folds)).alias("fold"), words.alias("words"))
    hashed = save(HashingTF(numFeatures=features, binary=True, inputCol="words", outputCol="features").transform(some).drop("words"), "features")
    zeros = F.array_repeat(F.lit(0.0), classes)
    parts = []
    for fold in range(folds):
        rest, here = hashed.where(F.col("fold") != fold), hashed.where(F.col("fold") == fold)
        if here.isEmpty():
            continue
        if rest.isEmpty():
            raise ValueError("all labelled rows are in one fold")
        model = LogisticRegression(family="multinomial", regParam=penalty, maxIter=50, standardization=False).fit(rest)
        made = vector_to_array("probability")
        parts.append(model.transform(here).select("id", "label", F.slice(F.concat(made, zeros), 1, classes).alias("probabilities")))
    if not parts:
        return rows.limit(0).select("id", F.col("label").cast("int").alias("label"), zeros.alias("probabilities"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def noisy_labels(scores: DataFrame) -> DataFrame:
    """id, label, likely, margin of the labels that confident learning prunes by noise rate, of rows (id, label, probabilities).

    Rows are counted by their label and the likeliest class that passes its bar, the mean probability it has in rows that carry
    it; a label's counts are scaled to its rows, which says how many of them belong to each other class. So many of its rows
    are taken for that class by the greatest margin over the label, ties by id, if their likeliest class is not the label.
    Rows are numbered over ranges of label, class and margin, so that a label of any size is no group.
    """
    own = scores.withColumn("self", F.get("probabilities", F.col("label")))
    bars = own.groupBy("label").agg(F.avg("self").alias("bar")).agg(F.map_from_entries(F.collect_list(F.struct("label", "bar"))).alias("bars"))
    ranked = F.transform("probabilities", lambda p, k: F.named_struct(F.lit("p"), p, F.lit("k"), -k))
    passing = F.array_max(F.filter(ranked, lambda x: F.coalesce(x["p"] >= F.element_at("bars", -x["k"]), F.lit(False))))
    seen = own.crossJoin(F.broadcast(bars)).select("label", (-passing["k"]).alias("j")).groupBy("label", "j").agg(F.count("*").alias("c"))
    per = seen.groupBy("label").agg(F.sum("c").alias("n"), F.sum(F.when(F.col("j").isNotNull(), F.col("c"))).alias("counted"))
    take = seen.where("j <> label").join(per, "label").select("label", "j", F.floor(F.col("c") / F.col("counted") * F.col("n") + 0.5).alias("take"))
    others = scores.select("id", "label", (-F.array_max(ranked)["k"]).alias("best"), F.get("probabilities", F.col("label")).alias("self"), F.posexplode("probabilities").alias("j", "p")).where("j <> label")
    placed = numbered(others.withColumn("margin", F.col("p") - F.col("self")), "label", "j", F.desc("margin"), "id", name="at")
    begins = placed.groupBy("label", "j").agg(F.min("at").alias("begin"))
    found = placed.join(begins, ["label", "j"]).join(take, ["label", "j"]).where((F.col("at") - F.col("begin") < F.col("take")) & (F.col("best") != F.col("label")))
    first = found.groupBy("id", "label").agg(F.max_by("j", F.struct("margin", -F.col("j"))).alias("likely"), F.max("margin").alias("margin"))
    return first.select("id", "label", "likely", F.round("margin", 6).alias("margin"))


def label_issues(rows: DataFrame, classes: int, folds: int = 5) -> DataFrame:
    """Issues (text_id, issue_type possible_label_error, score: the margin, evidence) of rows' labels (id, text, label) that
    out-of-fold probabilities contradict, by noisy_labels()."""
    found = noisy_labels(save(out_of_fold(rows, classes, folds), "probabilities"))
    evidence = F.to_json(F.struct("label", "likely"))
    return found.select(F.col("id").alias("text_id"), F.lit("possible_label_error").alias("issue_type"), F.col("margin").alias("score"), F.lit(0.0).alias("threshold"), F.lit("open").alias("status"), evidence.alias("evidence"))


def suspect_labels(scores: DataFrame) -> DataFrame:
    """Confident learning on rows (id, label: int, probabilities: array): id, label, likely, margin of the labels that another
    class contradicts. A class's bar is the mean probability it has in rows that carry it; a label is suspect if a
    class other than it passes its bar, its own does not, and that class is the likeliest of those that do.
    """
    own = scores.withColumn("self", F.get("probabilities", F.col("label")))
    bars = own.groupBy("label").agg(F.avg("self").alias("bar")).agg(F.map_from_entries(F.collect_list(F.struct("label", "bar"))).alias("bars"))
    passing = F.filter(F.transform("probabilities", lambda p, k: F.struct(p.alias("p"), (-k).alias("k"))), lambda x: F.coalesce(x["p"] >= F.element_at("bars", -x["k"]), F.lit(False)))
    best = F.array_max(passing)
    out = own.crossJoin(F.broadcast(bars)).withColumn("best", best)
    found = out.where(F.col("best").isNotNull() & (-F.col("best.k") != F.col("label")) & (F.col("self") < F.element_at("bars", F.col("label"))))
    return found.select("id", "label", (-F.col("best.k")).alias("likely"), F.round(F.col("best.p") - F.col("self"), 6).alias("margin"))


def manifest(text: str, files: set[str]) -> dict:
    """A plugin's manifest, checked against its pack's files (relative paths): commands start with ./ and name files of the
    pack, capabilities are strings, permissions among the known ones. A fault is a ValueError."""
    try:
        got = json.loads(text)
    except ValueError as e:
        raise ValueError("the manifest is not JSON") from e

    def strings(key: str) -> list[str]:
        value = got.get(key, [])
        if not isinstance(value, list) or any(not isinstance(x, str) for x in value):
            raise ValueError(f"{key} must be a list of strings")
        return value

    command = strings("command")
    inside = [posixpath.normpath(x) for x in command if x.startswith("./")]
    if not command or len(inside) < len(command) or not files.issuperset(inside):
        raise ValueError("command must name files of the pack by paths that start with ./")
    strings("capabilities")
    if unknown := set(strings("permissions")) - set(PERMISSIONS):
        raise ValueError(f"permissions not allowed: {', '.join(sorted(unknown))}")
    return got
