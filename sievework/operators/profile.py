"""Profiles of datasets and columns. One wide aggregation gives everything that is a count or a moment; exact percentiles come with it; only rankings and series group by value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parse as P
from ..functions import text as T
from ..functions.names import privacy_signal
from ..functions.order import data_columns, is_number, is_time, is_whole, kind_of, quoted
from ..functions.quantiles import linear

#: Ways of writing dates, in the order in which they are tried; Spark's patterns.
DATE_FORMATS = [
    "yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd-MM-yyyy", "yyyy/MM/dd", "dd MMM yyyy", "dd MMMM yyyy", "yyyyMMdd", "dd-MMM-yyyy",
    "MMM dd, yyyy", "MMMM dd, yyyy", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm", "iso8601",
]
MIN_YEAR, MAX_YEAR = 1900, 2100
HISTOGRAM_BINS, MAX_CORRELATED, CORRELATION_ROWS = 12, 12, 100_000
MAX_CATEGORIES, TOP_GROUPS, LEAST_GROUP, LABEL_CHARS = 4, 8, 3, 120
MAX_SERIES, MAX_PERIODS = 4, 48
#: Fixed value: the name of what is left.
REST = "Resto"
#: A regular expression for each pattern, so that the reader is asked only about texts that it can read in one way.
_SHAPES = {"yyyy": "[0-9]{4}", "MMMM": "[A-Za-z]{3,9}", "MMM": "[A-Za-z]{3}", "MM": "[0-9]{1,2}", "dd": "[0-9]{1,2}", "HH": "[0-9]{2}", "mm": "[0-9]{2}", "ss": r"[0-9]{2}(?:\.[0-9]{1,9})?"}


def read_date(c: Column, pattern: str, plausible: bool = True) -> Column:
    """A timestamp without zone, or null; plausible: of years 1900 to 2100 only."""
    import re

    t = T.trim(c)
    if pattern == "iso8601":
        value = F.when(F.octet_length(t) <= T.SHORT_BYTES, P.strict_datetime(t, "iso8601"))
    else:
        shape = "^" + "".join(_SHAPES.get(p, re.escape(p)) for p in re.split(r"(yyyy|MMMM|MMM|MM|dd|HH|mm|ss)", pattern.replace("'", "")) if p) + "$"
        if pattern == "yyyyMMdd":
            shape = "^[0-9]{8}$"
        loose = pattern if pattern == "yyyyMMdd" else pattern.replace("dd", "d").replace("MMMM", "LLLL").replace("MMM", "LLL").replace("MM", "M").replace("LLLL", "MMMM").replace("LLL", "MMM")
        loose = loose.replace("ss", "ss[.SSSSSSSSS][.SSSSSS][.SSS]")
        value = F.when(F.rlike(t, F.lit(shape)), F.try_to_timestamp(F.initcap(t) if "MMM" in pattern else t, F.lit(loose)).cast("timestamp_ntz"))
    return F.when(F.year(value).between(MIN_YEAR, MAX_YEAR), value) if plausible else value


#: English month names and the numbers that ISO dates have for them.
MONTHS = {m: i for i, m in enumerate("January February March April May June July August September October November December".split(), 1)}


def _month(c: Column) -> Column:
    """The number of an English month, by its name or its first three letters, as text; null for anything else."""
    low = F.lower(c)
    table = F.create_map(*[F.lit(x) for name, i in MONTHS.items() for k in dict.fromkeys((name.lower(), name[:3].lower())) for x in (k, f"{i:02d}")])
    return F.try_element_at(table, low)


def any_date(t: Column) -> Column:
    """A trimmed text under the first of DATE_FORMATS that reads it. One expression for all: the text is put in ISO order by its shape, and cast once; day before month, where both could be, and month before day where only that is a date."""
    first = F.substring(t, 1, 1)
    ymd, dmy, dmy_time = r"^([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})$", r"^([0-9]{1,2})([-/])([0-9]{1,2})[-/]([0-9]{4})$", r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4}) ([0-9]{2}:[0-9]{2})$"
    named, names_first = r"^([0-9]{1,2})[ -]([A-Za-z]{3,9})[ -]([0-9]{4})$", r"^([A-Za-z]{3,9}) ([0-9]{1,2}), ([0-9]{4})$"
    part = lambda p, i: F.regexp_extract(t, p, i)
    swapped = F.when(F.rlike(t, F.lit(dmy)), F.concat_ws("-", part(dmy, 4), part(dmy, 3), part(dmy, 1)))
    iso = (
        F.when(F.rlike(t, F.lit(ymd)), F.replace(t, F.lit("/"), F.lit("-")))
        .when(F.rlike(t, F.lit("^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\\.[0-9]{1,9})?)?(Z|[+-][0-9]{2}:?[0-9]{2})?$")), F.regexp_replace(t, "(\\.[0-9]{6})[0-9]*", "$1"))
        .when(F.rlike(t, F.lit("^[0-9]{8}$")), F.concat_ws("-", F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 2)))
        .when(F.rlike(t, F.lit(dmy_time)), F.regexp_replace(t, dmy_time, "$3-$2-$1 $4"))
        .when(F.rlike(t, F.lit(named)), F.concat(part(named, 3), F.lit("-"), _month(part(named, 2)), F.lit("-"), part(named, 1)))
        .when(F.rlike(t, F.lit(names_first)), F.concat(part(names_first, 3), F.lit("-"), _month(part(names_first, 1)), F.lit("-"), part(names_first, 2)))
    )
    # the cast to timestamp applies a zone if there is one; the session's zone stands for none, and goes again
    read = F.coalesce(F.coalesce(iso, swapped).try_cast("timestamp_ntz"), F.when(F.contains(t, F.lit("/")), F.regexp_replace(t, dmy, "$4-$1-$3")).try_cast("timestamp_ntz"))
    return F.when((F.octet_length(t) <= T.SHORT_BYTES) & (first.between("0", "9") | F.rlike(t, F.lit("[0-9]{4}$"))) & F.year(read).between(MIN_YEAR, MAX_YEAR), read)


def _number(t: Column) -> Column:
    """A trimmed text as a number that means one: no code with leading zeros, no whole number beyond 2**53."""
    value = F.when((F.octet_length(t) <= T.SHORT_BYTES) & F.rlike(t, F.lit(P.DOUBLE)) & ~F.rlike(t, F.lit(r"^[+-]?0[0-9]")), t.try_cast("double"))
    return F.when((F.abs(value) < float("inf")) & ((F.abs(value) <= P.EXACT) | ~F.rlike(t, F.lit(P.LONG))), value)


def semantic_number(c: Column) -> Column:
    return _number(T.trim(c))


def readers(c: Column) -> dict[str, Column]:
    """What a text is under each type that may be suggested for it, null if it isn't."""
    t = T.trim(c)
    n = _number(t)
    return {"boolean": T.boolean_token(c), "integer": F.when(n == F.floor(n), n), "decimal": n, "date": any_date(t)}


def _view(df: DataFrame, columns: list[str]) -> DataFrame:
    """Of text column i its text x, trimmed t, normalized m (if short), as a number n and as a date d. Worked out once, in projections that the aggregation above reads."""
    short = lambda i: F.octet_length(f"t{i}") <= T.SHORT_BYTES
    out = df.select(*[quoted(c).alias(f"x{i}") for i, c in enumerate(columns)], *[T.trim(quoted(c)).alias(f"t{i}") for i, c in enumerate(columns)])
    out = out.withColumns({f"m{i}": F.when(short(i), T.normalize_text(F.col(f"t{i}"))) for i in range(len(columns))})
    typed = {i: ~F.coalesce(F.col(f"m{i}").isin(T.SENTINELS), F.lit(False)) & (F.col(f"t{i}") != "") for i in range(len(columns))}
    out = out.withColumns({f"v{i}": F.when(typed[i], F.col(f"t{i}")) for i in range(len(columns))})
    return out.withColumns({f"n{i}": _number(F.col(f"v{i}")) for i in range(len(columns))} | {f"d{i}": any_date(F.col(f"v{i}")) for i in range(len(columns))})


def _type_counts(i: int) -> list[Column]:
    n = F.col(f"n{i}")
    return [
        F.count(f"v{i}").alias(f"typed{i}"), F.count_if(F.col(f"v{i}").isNotNull() & F.col(f"m{i}").isin(T.TRUE_WORDS + T.FALSE_WORDS)).alias(f"boolean{i}"),
        F.count_if(n == F.floor(n)).alias(f"integer{i}"), F.count(n).alias(f"decimal{i}"), F.count(f"d{i}").alias(f"date{i}"),
    ]


def suggested_types(df: DataFrame, columns: list[str]) -> dict[str, str | None]:
    """The type that at least 90 % of a text column's values (three or more, markers and blanks left out) have; of equals the first of boolean, integer, decimal, date."""
    if not columns:
        return {}
    row = _view(df, columns).agg(*[x for i in range(len(columns)) for x in _type_counts(i)]).first()
    return {c: suggestion(row[f"typed{i}"], {k: row[f"{k}{i}"] for k in ("boolean", "integer", "decimal", "date")}) for i, c in enumerate(columns)}


def suggestion(n: int, counts: dict[str, int]) -> str | None:
    best = max(counts, key=lambda k: counts[k])
    return best if n >= 3 and counts[best] * 10 >= 9 * n else None


def date_order(df: DataFrame, column: str) -> str | None:
    """iso, dmy, mdy or ambiguous if all values fit (both, for ambiguous), else None; in one aggregation."""
    c = quoted(column)
    row = df.agg(F.count(c).alias("n"), *[F.count(r).alias(k) for k, r in (("iso", P.strict_datetime(c, "iso8601")), ("dmy", P.two_digit_year_date(c, "dmy")), ("mdy", P.two_digit_year_date(c, "mdy")))]).first()
    fits = [k for k in ("iso", "dmy", "mdy") if row["n"] and row[k] == row["n"]]
    return "ambiguous" if fits == ["dmy", "mdy"] else fits[0] if fits else None


def dataset_summary(df: DataFrame) -> DataFrame:
    """One row: rows, duplicates (rows beyond the distinct ones), near_duplicates (distinct rows that are the same once texts are normalized).

    Rows are grouped to distinct ones, those to distinct keys: both with partial aggregation; nothing is collected."""
    names = data_columns(df)
    rows = df.groupBy(*[quoted(c).alias(f"c{i}") for i, c in enumerate(names)]).agg(F.count("*").alias("n"))
    keys = [(T.normalize_text(F.col(f"c{i}")) if kind_of(df, c) == "string" else F.col(f"c{i}")).alias(f"k{i}") for i, c in enumerate(names)]
    near = rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.count("*").alias("d"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return near.agg(zero("n").alias("rows"), (zero("n") - zero("d")).alias("duplicates"), (zero("d") - F.count("*")).alias("near_duplicates"))


def _short(c: Column) -> Column:
    """A stand-in for a text in distinct counts: long ones by their SHA-256, so that they aren't shuffled."""
    return F.when(F.octet_length(c) <= T.SHORT_BYTES, F.concat(F.lit("="), c)).otherwise(F.sha2(c, 256))


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column: column_name, data_type, row_count, null_count, unique_count, min_text, max_text, empty_count, min_length, max_length, avg_length, sentinel_count,
    mojibake_count, untrimmed_count, comma_decimal_count, non_finite_count, mean, std, q1, median, q3, outlier_count, suggested_type, privacy_signal.

    A few aggregations over the data (of all columns, of quartiles, of the texts' signals, of outliers, which need the quartiles), whatever the number of columns."""
    names = columns or data_columns(df)
    numbers: dict[str, Column] = {}
    aggs, text_aggs, texts, found = [F.count(F.lit(1)).alias("n")], [], [], {}
    for i, c in enumerate(names):
        x, kind = quoted(c), kind_of(df, c)
        aggs += [F.count(x).alias(f"count{i}"), F.count_distinct(_short(x) if kind == "string" else x).alias(f"unique{i}")]
        if not kind.startswith(("array", "struct", "map")):
            aggs += [F.min(x).cast("string").alias(f"min{i}"), F.max(x).cast("string").alias(f"max{i}")]
        if kind == "string":
            texts.append(c)
            j = len(texts) - 1
            x, t, m = F.col(f"x{j}"), F.col(f"t{j}"), F.col(f"m{j}")
            text_aggs += [
                F.count_if(t == "").alias(f"empty{i}"), F.min(F.length(x)).alias(f"short{i}"), F.max(F.length(x)).alias(f"long{i}"), F.avg(F.length(x)).alias(f"len{i}"),
                F.count_if(m.isin(T.SENTINELS)).alias(f"sentinel{i}"), F.count_if(T.repair_mojibake(x) != x).alias(f"moji{i}"), F.count_if(t != x).alias(f"untrim{i}"),
                F.count_if(P.is_comma_decimal(t)).alias(f"comma{i}"), *_type_counts(j),
            ]
        elif is_number(kind):
            d = x.cast("double")
            f = F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)
            aggs += [F.count_if(d.isNotNull() & f.isNull()).alias(f"inf{i}"), F.avg(f).alias(f"mean{i}"), F.stddev_samp(f).alias(f"std{i}"), F.count(f).alias(f"fin{i}")]
            numbers[c] = f
    row = df.agg(*aggs).first().asDict()
    quartiles = linear(df, numbers, [0.25, 0.5, 0.75])
    row |= {f"q{i}": quartiles[c] for i, c in enumerate(names) if c in quartiles and quartiles[c][0] is not None}
    if texts:
        row |= _view(df, texts).agg(*text_aggs).first().asDict()
    fences = []
    for i, c in enumerate(names):
        if (q := row.get(f"q{i}")) and row[f"fin{i}"] >= 4:
            d = quoted(c).cast("double")
            d = F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)
            fences.append(F.count_if((d < q[0] - 1.5 * (q[2] - q[0])) | (d > q[2] + 1.5 * (q[2] - q[0]))).alias(f"out{i}"))
    row |= df.agg(*fences).first().asDict() if fences else {}
    for i, c in enumerate(names):
        g, q = lambda k: row.get(f"{k}{i}"), row.get(f"q{i}") or [None] * 3  # noqa: B023
        j = texts.index(c) if c in texts else None
        suggested = suggestion(row[f"typed{j}"], {k: row[f"{k}{j}"] for k in ("boolean", "integer", "decimal", "date")}) if j is not None else None
        found[c] = (
            c, kind_of(df, c), row["n"], row["n"] - g("count"), g("unique"), g("min"), g("max"), g("empty"), g("short"), g("long"), g("len"), g("sentinel"), g("moji"), g("untrim"), g("comma"),
            g("inf"), g("mean"), g("std"), *q, g("out"), suggested, privacy_signal(c),
        )
    schema = "column_name string, data_type string, row_count long, null_count long, unique_count long, min_text string, max_text string, empty_count long, min_length int, max_length int, avg_length double, sentinel_count long, mojibake_count long, untrimmed_count long, comma_decimal_count long, non_finite_count long, mean double, std double, q1 double, median double, q3 double, outlier_count long, suggested_type string, privacy_signal string"
    return df.sparkSession.createDataFrame(list(found.values()), schema)


def histogram(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """bin, lower, upper, n: equal widths from the smallest to the largest finite value; one bin if they are equal; empty bins are there too."""
    d = quoted(column).cast("double")
    v = df.select(F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d).alias("v")).filter("v is not null")
    row = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    lo, hi = row["lo"], row["hi"]
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, lower double, upper double, n long")
    k = bins if hi > lo else 1
    width = (hi - lo) / k
    at = F.least(F.floor((F.col("v") - lo) / (width or 1.0)), F.lit(k - 1)).cast("int")
    counts = v.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    edges = df.sparkSession.range(k).select(F.col("id").cast("int").alias("bin"), (lo + width * F.col("id")).alias("lower"), F.when(F.col("id") == k - 1, hi).otherwise(lo + width * (F.col("id") + 1)).alias("upper"))
    return edges.join(F.broadcast(counts), "bin", "left").select("bin", "lower", "upper", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """left_column, right_column, pairs, correlation (Pearson) for each pair of at most 12 numeric columns, over the rows where both are finite; null with under two pairs or no variance. All pairs in one
    aggregation over all rows."""
    names = (columns or [c for c in data_columns(df) if is_number(kind_of(df, c))])[:MAX_CORRELATED]
    values = df.select(*[F.when(~F.isnan(quoted(c).cast("double")) & (F.abs(quoted(c).cast("double")) < float("inf")), quoted(c).cast("double")).alias(f"v{i}") for i, c in enumerate(names)])
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    aggs = []
    for i, j in pairs:
        x, y = (F.when(F.col(f"v{i}").isNotNull() & F.col(f"v{j}").isNotNull(), F.col(f"v{k}")) for k in (i, j))
        aggs += [F.count(x).alias(f"n{i}_{j}"), F.covar_pop(x, y).alias(f"c{i}_{j}"), F.var_pop(x).alias(f"x{i}_{j}"), F.var_pop(y).alias(f"y{i}_{j}")]
    if not aggs:
        return df.sparkSession.createDataFrame([], "left_column string, right_column string, pairs long, correlation double")
    row = values.agg(*aggs)
    cells = [F.struct(F.lit(names[i]).alias("left_column"), F.lit(names[j]).alias("right_column"), F.col(f"n{i}_{j}").alias("pairs"), F.when((F.col(f"n{i}_{j}") > 1) & (F.col(f"x{i}_{j}") > 0) & (F.col(f"y{i}_{j}") > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(f"c{i}_{j}", F.sqrt(f"x{i}_{j}") * F.sqrt(f"y{i}_{j}"))))).alias("correlation")) for i, j in pairs]
    return row.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def category_groups(df: DataFrame, column: str) -> DataFrame:
    """label, n, percentage, is_other: the eight most frequent values (trimmed; blanks left out) of at least three rows, of equals the smaller label, and the rest of the rows."""
    label = F.substring(T.trim(quoted(column).cast("string")), 1, LABEL_CHARS)
    counts = df.select(label.alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    top = counts.filter((F.col("n") >= LEAST_GROUP) & (F.col("label") != "")).orderBy(F.desc("n"), "label").limit(TOP_GROUPS)
    shown = top.crossJoin(F.broadcast(total)).select("label", "n", (F.col("n") / F.col("total") * 100).alias("percentage"), F.lit(False).alias("is_other"))
    rest = top.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("shown")).crossJoin(F.broadcast(total)).filter("total > shown")
    return shown.unionByName(rest.select(F.lit(REST).alias("label"), (F.col("total") - F.col("shown")).alias("n"), ((F.col("total") - F.col("shown")) / F.col("total") * 100).alias("percentage"), F.lit(True).alias("is_other")))


def categorical_columns(profile: DataFrame) -> list[str]:
    """Up to four text columns of a column profile that suggest no type, aren't private and have two values or more."""
    rows = profile.filter("data_type = 'string' and suggested_type is null and privacy_signal is null and unique_count >= 2").collect()
    return [r["column_name"] for r in rows][:MAX_CATEGORIES]


def granularity_of(first, last) -> str:
    days = (last - first).days
    months = (last.year - first.year) * 12 + last.month - first.month + 1
    return "day" if days <= 90 else "month" if months <= 36 else "year"


FORMATS = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}


def temporal_series(df: DataFrame, column: str, value: str | None = None, how: str = "count") -> DataFrame:
    """period, granularity, n (and value: sum or mean of a numeric column, null where there are none). Days up to 90 days, months up to 36, else years; days and months without rows are there with 0; what is before the
    last 48 periods is one period, 'previous'."""
    day = quoted(column).cast("date")
    rows = df.select(day.alias("d"), (quoted(value).cast("double") if value else F.lit(None).cast("double")).alias("v")).filter("d is not null")
    span = rows.agg(F.min("d").alias("a"), F.max("d").alias("b")).first()
    if span["a"] is None:
        return df.sparkSession.createDataFrame([], "period string, granularity string, n long, value double")
    unit = granularity_of(span["a"], span["b"])
    start = F.trunc if unit != "day" else None
    key = F.col("d") if unit == "day" else start("d", unit)
    step = {"day": "interval 1 day", "month": "interval 1 month", "year": "interval 1 year"}[unit]
    counts = rows.groupBy(key.cast("date").alias("p")).agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.count("v").alias("k"))
    if unit != "year":
        ends = df.sparkSession.range(1).select(F.explode(F.sequence(F.trunc(F.lit(span["a"]), "month") if unit == "month" else F.lit(span["a"]), F.lit(span["b"]), F.expr(step))).alias("p"))
        counts = ends.join(F.broadcast(counts), "p", "left")
    last = F.lit(span["b"]) if unit == "day" else F.trunc(F.lit(span["b"]), unit)
    edge = F.date_sub(last, MAX_PERIODS - 1) if unit == "day" else F.add_months(last, -(MAX_PERIODS - 1) * (1 if unit == "month" else 12))
    label = F.when(F.col("p") < edge, "previous").otherwise(F.date_format("p", FORMATS[unit]))
    total = F.sum("s") if how == "sum" else F.try_divide(F.sum("s"), F.sum("k"))
    return counts.groupBy(label.alias("period")).agg(F.lit(unit).alias("granularity"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"), (total if value else F.lit(None).cast("double")).alias("value"))


def temporal_columns(df: DataFrame) -> list[str]:
    return [c for c in data_columns(df) if is_time(kind_of(df, c))][:MAX_SERIES]


def whole_columns(df: DataFrame) -> list[str]:
    return [c for c in data_columns(df) if is_whole(kind_of(df, c))]
