"""Exact row numbers and exact first rows of an order, without one task that holds or sorts them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import discard, save

BINS = 1024
#: monotonically_increasing_id counts rows of a partition in its lower 33 bits.
LOW = 33


def numbered(df: DataFrame, *order: str | Column, name: str = "rank", start: int = 1) -> DataFrame:
    """df with each row's number, from ``start``, in the order given.

    Rows are dealt by ranges of the order and sorted there, written once with their place in the range, and the counts of
    the ranges, one row each, become offsets. Rows that tie on the whole order get numbers in any order among themselves;
    a tie lies in one range, so name enough columns. An empty table stays empty.
    """
    at = f"_{name}_at"
    rows = save(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(F.col(at), LOW)
    counts = sorted(rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    offsets, upto = [], start
    for p, n in counts:
        offsets.append((p, upto))
        upto += n
    offset = F.broadcast(df.sparkSession.createDataFrame(offsets, f"_{name}_part long, _{name}_from long"))
    out = rows.join(offset, part == F.col(f"_{name}_part"))
    return out.select(*df.columns, (F.col(f"_{name}_from") + F.col(at).bitwiseAND((1 << LOW) - 1)).alias(name))


def _text_key(c: Column, done: str) -> tuple[Column, Column]:
    """Of a text: whether its bytes begin with the hex digits ``done``, and its next two bytes as a number; 0 at its end."""
    digits = F.hex(F.encode(c, "utf-8"))

    def byte(at):
        return F.conv(F.substring(digits, len(done) + at, 2), 16, 10).cast("long")

    rest = F.length(digits) - len(done)
    return digits.startswith(done), F.when(rest <= 0, 0).otherwise(byte(1) * 257 + F.when(rest <= 2, 0).otherwise(byte(3) + 1) + 1).cast("long")


def boundary(df: DataFrame, k: int, order: list[tuple[str, bool]]) -> tuple[list, int] | None:
    """Key of the k-th row in ``order``, (column, descending) pairs, and how many rows with just that key are among the
    first k; None if there are no more than k rows.

    Column by column a histogram of about BINS bins (for text: of the next two bytes), with each bin's least and
    greatest value, tells the bin that holds the k-th row; only that bin's rows are counted in the next pass. Nulls come last;
    NaN is not expected.
    """
    tied, key, need = F.lit(True), [], k
    if df.count() <= k:
        return None
    for name, down in order:
        c, kind = F.col(name), df.schema[name].dataType.simpleString()
        empty = tied & c.isNull()
        here = df.where(tied & c.isNotNull())
        if kind == "string":
            done = ""
            while True:
                begins, digit = _text_key(c, done)
                bins = here.where(begins).groupBy(digit.alias("b")).agg(F.count("*").alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi")).collect()
                found, need = _bin(sorted(bins, key=lambda r: -r.b if down else r.b), need)
                if found is None or found.lo == found.hi:
                    value = None if found is None else found.lo
                    break
                one, two = divmod(found.b - 1, 257)
                done += f"{one:02X}{two - 1:02X}"
        else:
            whole = kind in ("tinyint", "smallint", "int", "bigint", "boolean")
            v = c.cast("long") if whole else c.cast("double")
            lo, hi = here.agg(F.min(v), F.max(v)).first()
            value = None
            while lo is not None:
                width = (hi - lo) // BINS + 1 if whole else (hi - lo) / BINS or 1.0
                b = F.call_function("div", v, F.lit(width)) if whole else F.floor((v - F.lit(lo)) / F.lit(width)).cast("long")
                bins = here.where(v.between(lo, hi)).groupBy(b.alias("b")).agg(F.count("*").alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).collect()
                found, need = _bin(sorted(bins, key=lambda r: -r.b if down else r.b), need)
                if found is None or found.lo == found.hi:
                    value = None if found is None else found.lo
                    break
                lo, hi = found.lo, found.hi
        key.append(value)
        tied = empty if value is None else tied & (c.cast("long" if kind == "boolean" else kind) == F.lit(value))
    return key, need


def _bin(bins: list, need: int):
    """The bin that holds row ``need`` and the row's number in it; None if all bins together have fewer rows."""
    for r in bins:
        if need <= r.n:
            return r, need
        need -= r.n
    return None, need


def first(df: DataFrame, k: int, order: list[tuple[str, bool]]) -> DataFrame:
    """The k rows that come first in ``order`` ((column, descending) pairs; nulls last), as they are, unsorted.

    The k-th row's key comes from boundary(), so that only a filter touches the rows. Of rows that tie on the whole key as
    many as needed are taken, any of them. k of zero or less gives none; k above the rows' number gives all.
    """
    if k <= 0:
        return df.limit(0)
    keys = save(df.select(*(c for c, _ in order)), "keys")
    found = boundary(keys, k, order)
    discard(keys)
    if found is None:
        return df
    key, need = found
    before, tied = F.lit(False), F.lit(True)
    for (name, down), value in zip(order, key):
        c = F.col(name)
        c = c.cast("long") if df.schema[name].dataType.simpleString() == "boolean" else c
        if value is None:
            before, tied = before | (tied & c.isNotNull()), tied & c.isNull()
        else:
            ahead = F.coalesce(c > F.lit(value) if down else c < F.lit(value), F.lit(False))
            before, tied = before | (tied & ahead), tied & F.coalesce(c == F.lit(value), F.lit(False))
    return df.where(before).unionByName(df.where(tied).limit(need))
