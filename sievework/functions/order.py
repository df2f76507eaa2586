"""Input order as a column. DataFrames have no order of their own, but which row is first matters to several operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RID = "_rid"


def with_rid(df: DataFrame, order: list[str] | str | None = None) -> DataFrame:
    """df with a column _rid that sorts as the input does: a struct of the order columns, or else the place in the scan.

    Without order columns call this right after the read, before any shuffle: the place is the number of the partition and the row in it."""
    if RID in df.columns:
        return df
    if order is None:
        return df.withColumn(RID, F.monotonically_increasing_id())
    names = [order] if isinstance(order, str) else order
    return df.withColumn(RID, F.col(names[0]) if len(names) == 1 else F.struct(*names))


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != RID]


def quoted(name: str) -> Column:
    """A column by its whole name, whatever signs are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def kind_of(df: DataFrame, name: str) -> str:
    return dict(df.dtypes)[name]


NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def is_number(kind: str) -> bool:
    return kind in NUMBERS or kind.startswith("decimal")


def is_whole(kind: str) -> bool:
    return kind in NUMBERS[:4]


def is_time(kind: str) -> bool:
    return kind in ("date", "timestamp", "timestamp_ntz")


def widened(df: DataFrame) -> DataFrame:
    """Small integers as long, floats and decimals as double, so that operators meet one integer and one real type."""
    out = {}
    for name, kind in df.dtypes:
        if kind in ("tinyint", "smallint", "int"):
            out[name] = quoted(name).cast("bigint")
        elif kind == "float" or kind.startswith("decimal"):
            out[name] = quoted(name).cast("double")
    return df.withColumns(out) if out else df


def against(c: Column, kind: str, op: str, bound: float) -> Column:
    """c compared with a number, as real numbers: eq, neq, gt, lt, gte or lte. For whole-number columns the bound becomes a whole number, so that the comparison reaches the scan as it is."""
    if is_whole(kind) and abs(bound) < 1 << 53:
        low, high = math.floor(bound), math.ceil(bound)
        if op in ("eq", "neq"):
            if low != high:
                return c.isNotNull() & F.lit(op == "neq")
            return c == F.lit(low) if op == "eq" else c != F.lit(low)
        return {"gt": lambda: c > F.lit(low), "lte": lambda: c <= F.lit(low), "gte": lambda: c >= F.lit(high), "lt": lambda: c < F.lit(high)}[op]()
    d, b = (c if kind == "double" else c.cast("double")), F.lit(bound)
    return {"eq": lambda: d == b, "neq": lambda: d != b, "gt": lambda: d > b, "lt": lambda: d < b, "gte": lambda: d >= b, "lte": lambda: d <= b}[op]()
