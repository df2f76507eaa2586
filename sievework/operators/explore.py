"""The cross-filtered panel: every chart applies all filters but those on its own column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.names import privacy_signal
from ..functions.order import is_number, is_time, kind_of, quoted
from ..functions.quantiles import linear
from .profile import column_profile, semantic_number

MAX_FILTERS, BARS, MORE_BARS, MAX_BAR_CHARTS, BINS = 32, 12, 60, 6, 20
MAX_CATEGORY_CHARS = 40


@dataclass(frozen=True)
class Filter:
    """Of one kind: values (None for gaps), low and high (closed: [low, high], else [low, high)), or period (YYYY, YYYY-MM or YYYY-MM-DD)."""

    column: str
    values: tuple[str | None, ...] | None = None
    low: float | None = None
    high: float | None = None
    closed: bool = True
    period: str | None = None

    def predicate(self, df: DataFrame) -> Column:
        c, kind = quoted(self.column), kind_of(df, self.column)
        kinds = [self.values is not None, self.low is not None or self.high is not None, self.period is not None]
        if sum(kinds) != 1:
            raise ValueError("a filter has exactly one kind")
        if self.values is not None:
            v = label(c, kind)
            some = v.isin([x for x in self.values if x is not None])
            return F.coalesce(some, F.lit(False)) | v.isNull() if None in self.values else F.coalesce(some, F.lit(False))
        if self.period is not None:
            return F.coalesce(F.startswith(F.date_format(c, "yyyy-MM-dd"), F.lit(self.period)), F.lit(False))
        n = measure(c, kind)
        ok = F.lit(True)
        if self.low is not None:
            ok = ok & (n >= self.low)
        if self.high is not None:
            ok = ok & ((n <= self.high) if self.closed else (n < self.high))
        return F.coalesce(ok, F.lit(False))


def label(c: Column, kind: str) -> Column:
    """A value as a bar shows it; blank text is a gap."""
    text = T.render_text(c, kind)
    return F.nullif(T.trim(text), F.lit("")) if kind == "string" else text


def measure(c: Column, kind: str) -> Column:
    n = semantic_number(c) if kind == "string" else c.cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) < float("inf")), n)


def filtered(df: DataFrame, filters: list[Filter], but: str | None = None) -> DataFrame:
    if len(filters) > MAX_FILTERS:
        raise ValueError(f"at most {MAX_FILTERS} filters")
    for f in filters:
        if f.column != but:
            df = df.filter(f.predicate(df))
    return df


def kpis(df: DataFrame, filters: list[Filter], median_of: str | None = None, mean_of: str | None = None) -> DataFrame:
    """One row: rows, median (of the first measure), mean (of the second); all filters apply."""
    at = lambda c: measure(quoted(c), kind_of(df, c))
    chosen = filtered(df, filters)
    middle = linear(chosen, {"m": at(median_of)}, [0.5])["m"][0] if median_of else None
    return chosen.agg(F.count(F.lit(1)).alias("rows"), F.lit(middle).cast("double").alias("median"), (F.avg(at(mean_of)) if mean_of else F.lit(None).cast("double")).alias("mean"))


def bars(df: DataFrame, filters: list[Filter], column: str, most: int = BARS) -> DataFrame:
    """value, n, is_other: the most frequent values (of equals null first, then the smaller), and one row for the others if there are any."""
    counts = filtered(df, filters, column).groupBy(label(quoted(column), kind_of(df, column)).alias("value")).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), F.asc_nulls_first("value")).limit(most)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    rest = top.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("shown")).crossJoin(F.broadcast(total)).filter("total > shown")
    return top.select("value", "n", F.lit(False).alias("is_other")).unionByName(rest.select(F.lit(None).cast("string").alias("value"), (F.col("total") - F.col("shown")).alias("n"), F.lit(True).alias("is_other")))


def histogram(df: DataFrame, filters: list[Filter], column: str) -> DataFrame:
    """bin, lower, upper, n. The edges come from all rows, so that they stay while filters change; whole numbers get whole widths."""
    v = measure(quoted(column), kind_of(df, column))
    row = df.select(v.alias("v")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count_if(F.col("v") != F.floor("v")).alias("parts")).first()
    lo, hi = row["lo"], row["hi"]
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, lower double, upper double, n long")
    if hi <= lo:
        width, k = 1.0, 1
    elif not row["parts"] and hi - lo < 1e15:
        width = max(1.0, float(-(-(hi - lo + 1) // BINS)))
        k = min(BINS, max(1, int(-(-(hi - lo + 1) // width))))
    else:
        width, k = (hi - lo) / BINS, BINS
    at = F.least(F.floor((F.col("v") - lo) / width), F.lit(k - 1)).cast("int")
    counts = filtered(df, filters, column).select(v.alias("v")).filter("v is not null").groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    edges = df.sparkSession.range(k).select(F.col("id").cast("int").alias("bin"), (lo + width * F.col("id")).alias("lower"), F.when(F.col("id") == k - 1, hi).otherwise(lo + width * (F.col("id") + 1)).alias("upper"))
    return edges.join(F.broadcast(counts), "bin", "left").select("bin", "lower", "upper", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def trend(df: DataFrame, filters: list[Filter], column: str) -> DataFrame:
    """period, n: by day up to 92 days, by month up to 1,830, else by year."""
    rows = filtered(df, filters, column).select(quoted(column).cast("date").alias("d")).filter("d is not null")
    span = rows.agg(F.datediff(F.max("d"), F.min("d")).alias("n")).first()["n"]
    unit = "yyyy-MM-dd" if span is None or span <= 92 else "yyyy-MM" if span <= 366 * 5 else "yyyy"
    return rows.groupBy(F.date_format("d", unit).alias("period")).agg(F.count("*").alias("n"))


@dataclass
class Plan:
    bars: list[str]
    measures: list[str]
    date: str | None


def plan_panel(df: DataFrame, profile: DataFrame | None = None) -> Plan:
    """Charts from the profile: up to six bar charts of columns with 2 to 60 values and short text, no private ones and none that (nearly) names rows; measures with over 60 values; the first date column."""
    rows = (profile if profile is not None else column_profile(df)).collect()
    out = Plan([], [], None)
    for r in rows:
        name, kind = r["column_name"], r["data_type"]
        if privacy_signal(name) or name.startswith("_"):
            continue
        if is_time(kind):
            out.date = out.date or name
            continue
        numeric = is_number(kind) or r["suggested_type"] in ("integer", "decimal")
        values = r["row_count"] - r["null_count"]
        if values and r["unique_count"] * 10 >= 9 * values and (not numeric or kind in ("bigint", "int")):
            continue
        if 2 <= r["unique_count"] <= MORE_BARS and (numeric or (r["avg_length"] or 0) <= MAX_CATEGORY_CHARS):
            if len(out.bars) < MAX_BAR_CHARTS:
                out.bars.append(name)
        elif numeric and r["unique_count"] >= 2:
            out.measures.append(name)
    return out


def mirrors(df: DataFrame, a: str, b: str) -> bool:
    """Whether two columns say the same: each value of one goes with one value of the other."""
    pairs = df.groupBy(quoted(a).alias("a"), quoted(b).alias("b")).agg(F.count("*").alias("n"))
    row = pairs.agg(F.count("*").alias("n"), F.count_distinct(F.struct("a")).alias("a"), F.count_distinct(F.struct("b")).alias("b")).first()
    return row["n"] == row["a"] == row["b"]


def panel(df: DataFrame, filters: list[Filter] = (), plan: Plan | None = None) -> dict[str, DataFrame]:
    """All charts, each a small lazy DataFrame. Cache df first if the source is far."""
    filters, plan = list(filters), plan or plan_panel(df)
    shown: list[str] = []
    for c in plan.bars:
        if not any(mirrors(df, c, s) for s in shown):
            shown.append(c)
    charts = {"kpi": kpis(df, filters, *(plan.measures + [None, None])[:2])}
    charts |= {f"bars:{c}": bars(df, filters, c) for c in shown}
    charts |= {f"histogram:{c}": histogram(df, filters, c) for c in plan.measures[:2]}
    if plan.date:
        charts["trend:" + plan.date] = trend(df, filters, plan.date)
    return charts
