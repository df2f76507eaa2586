"""Outliers by the interquartile range, and filling of gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.names import privacy_signal
from ..functions.order import RID, data_columns, is_number, is_whole, kind_of, quoted
from ..functions.quantiles import linear, lower_median

FENCE, LEAST_VALUES = 1.5, 4


def finite(c: Column) -> Column:
    """The value as a double if it is finite, else null."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def fences(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float, float, int]]:
    """column -> (low, high, median, values); exact linear percentiles."""
    if not columns:
        return {}
    found = linear(df, {c: finite(quoted(c)) for c in columns}, [0.25, 0.5, 0.75])
    counts = df.agg(*[F.count(finite(quoted(c))).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    out = {}
    for i, c in enumerate(columns):
        if counts[f"n{i}"]:
            q1, median, q3 = found[c]
            out[c] = (q1 - FENCE * (q3 - q1), q3 + FENCE * (q3 - q1), median, counts[f"n{i}"])
        else:
            out[c] = (float("-inf"), float("inf"), float("nan"), 0)
    return out


def exact_lower_median(df: DataFrame, column: str) -> int | None:
    """The lower median of whole numbers, exact beyond 2**53 too."""
    return lower_median(df, quoted(column).cast("bigint"))


def treat_recipe(df: DataFrame, treatments: list[tuple[str, str]]) -> DataFrame:
    """treatments: (column, cap | drop | impute), at most 16. All baselines come from the data before any change. Capped whole numbers become doubles where a value changes;
    imputed ones take the exact lower median. Fewer than four values or a value that isn't finite is an error."""
    if len(treatments) > 16 or len({c for c, _ in treatments}) < len(treatments):
        raise ValueError("at most 16 treatments, one for each column")
    for c, _ in treatments:
        if not is_number(kind_of(df, c)):
            raise ValueError(f"column {c!r} isn't numeric")
    names = [c for c, _ in treatments]
    bad = df.agg(*[F.count_if(quoted(c).isNotNull() & finite(quoted(c)).isNull()).alias(f"b{i}") for i, c in enumerate(names)]).first()
    limits = fences(df, names)
    for i, c in enumerate(names):
        if bad[f"b{i}"]:
            raise ValueError(f"column {c!r} holds values that aren't finite")
        if limits[c][3] < LEAST_VALUES:
            raise ValueError(f"column {c!r} has fewer than {LEAST_VALUES} values")
    medians = {c: exact_lower_median(df, c) if is_whole(kind_of(df, c)) else limits[c][2] for c, how in treatments if how == "impute"}
    out, keep = {}, F.lit(True)
    for c, how in treatments:
        low, high, _, _ = limits[c]
        x = quoted(c)
        outside = (x < low) | (x > high)
        if how == "drop":
            keep = keep & ~F.coalesce(outside, F.lit(False))
        elif how == "cap":
            capped = F.least(F.greatest(x.cast("double"), F.lit(low)), F.lit(high))
            changed = not is_whole(kind_of(df, c)) or not df.filter(outside).limit(1).isEmpty()
            out[c] = F.when(x.isNotNull(), capped) if changed else x
        elif how == "impute":
            out[c] = F.when(outside, F.lit(medians[c]).cast(kind_of(df, c))).otherwise(x)
        else:
            raise ValueError(f"no treatment {how!r}")
    return df.filter(keep).withColumns(out)


def treat_all(df: DataFrame, how: str, columns: list[str] | None = None) -> DataFrame:
    """cap, drop or impute over every numeric column with at least four values. Capped whole numbers stay whole, their limits rounded inwards."""
    names = columns or [c for c in data_columns(df) if is_number(kind_of(df, c))]
    limits = {c: v for c, v in fences(df, names).items() if v[3] >= LEAST_VALUES}
    out, keep = {}, F.lit(True)
    for c, (low, high, median, _) in limits.items():
        x, kind = quoted(c), kind_of(df, c)
        outside = F.coalesce((x < low) | (x > high), F.lit(False))
        if how == "drop":
            keep = keep & ~outside
        elif how == "cap" and is_whole(kind):
            out[c] = F.when(x < low, F.ceil(F.lit(low)).cast(kind)).when(x > high, F.floor(F.lit(high)).cast(kind)).otherwise(x)
        elif how == "cap":
            out[c] = F.when(x < low, low).when(x > high, high).otherwise(x)
        else:
            value = exact_lower_median(df, c) if is_whole(kind) else median
            out[c] = F.when(outside, F.lit(value).cast(kind)).otherwise(x)
    return df.filter(keep).withColumns(out)


def text_mode(df: DataFrame, column: str) -> str | None:
    """The most frequent text that isn't blank, if it occurs twice; of equals the one that is there first."""
    rows = df.filter(~T.blank(quoted(column))).groupBy(quoted(column).alias("v")).agg(F.count("*").alias("n"), F.min(RID).alias("first"))
    best = rows.filter("n >= 2").orderBy(F.desc("n"), "first").first()
    return best and best["v"]


def impute_missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Nulls of text columns take the mode, of whole numbers the exact lower median, of reals the lower median of the finite. Columns whose name is
    private, or with 80 % nulls or more, are left alone unless they are listed. Needs _rid for ties."""
    names = columns or [c for c in data_columns(df) if privacy_signal(c) is None]
    if not names:
        return df
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(quoted(c)).alias(f"c{i}") for i, c in enumerate(names)]).first()
    fills = {}
    for i, c in enumerate(names):
        kind = kind_of(df, c)
        nulls = row["n"] - row[f"c{i}"]
        if not nulls or (columns is None and nulls * 100 >= 80 * row["n"]):
            continue
        if kind == "string":
            value = text_mode(df, c)
        elif is_whole(kind):
            value = exact_lower_median(df, c)
        elif is_number(kind):
            value = lower_median(df, finite(quoted(c)))
        else:
            continue
        if value is not None:
            fills[c] = F.coalesce(quoted(c), F.lit(value).cast(kind))
    return df.withColumns(fills) if fills else df


#: Fixed value: what stands for an unknown category.
UNKNOWN = "Desconocido"


def impute_categories(df: DataFrame, columns: list[str] | None = None, value: str = UNKNOWN) -> DataFrame:
    """Nulls of text columns become value, other than in private columns, in ones with 80 % nulls or more and in ones whose texts suggest another type."""
    from .profile import suggested_types

    names = columns or [c for c in data_columns(df) if kind_of(df, c) == "string" and privacy_signal(c) is None]
    if not names:
        return df
    typed = suggested_types(df, names) if columns is None else {}
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(quoted(c)).alias(f"c{i}") for i, c in enumerate(names)]).first()
    chosen = [c for i, c in enumerate(names) if typed.get(c) is None and (columns is not None or (row["n"] - row[f"c{i}"]) * 100 < 80 * row["n"])]
    return df.withColumns({c: F.coalesce(quoted(c), F.lit(value)) for c in chosen}) if chosen else df
