"""One-step cleaning. Each operator takes and returns a DataFrame; report() counts what one changed. Operators that need the input's order read _rid (functions.order.with_rid) and add it from the scan if it isn't there."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parse as P
from ..functions import text as T
from ..functions.names import PERSONAL, normalized_names, privacy_signal
from ..functions.order import RID, data_columns, kind_of, quoted, with_rid

AUDIT = "_cambios"
AUDIT_CHARS = 2048
HIGH_NULLS = 80


def values_of(df: DataFrame) -> list[str]:
    """Data columns without the audit column."""
    return [c for c in data_columns(df) if c != AUDIT]


def text_columns(df: DataFrame) -> list[str]:
    return [c for c in values_of(df) if kind_of(df, c) == "string"]


# Rows


def remove_duplicates(df: DataFrame, order: list[str] | str | None = None) -> DataFrame:
    """Keeps the first row of each. A grouping on all columns with the smallest _rid, which aggregates before the shuffle; a window would sort everything."""
    df = with_rid(df, order)
    names = values_of(df)
    extra = [F.min_by(quoted(c), RID).alias(c) for c in df.columns if c == AUDIT]
    return df.groupBy(*[quoted(c) for c in names]).agg(*extra, F.min(RID).alias(RID)).select(*[quoted(c) for c in df.columns])


def _row_digest(df: DataFrame, normal: bool) -> Column:
    """The SHA-256 of a row's values, each with its length, so that no two rows are written alike; normal: of normalized texts."""
    parts = []
    for c in values_of(df):
        kind, x = kind_of(df, c), quoted(c)
        if kind == "string":
            x = T.normalize_text(x) if normal else x
        elif kind in ("float", "double"):
            x = (x + F.lit(0.0)).cast("string")  # 0.0 and -0.0 are equal
        else:
            x = F.hex(x) if kind == "binary" else F.to_json(F.struct(x)) if kind.startswith(("array", "struct", "map")) else x.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")))
    return F.unhex(F.sha2(F.concat_ws(",", *parts), 256))


def remove_near_duplicates(df: DataFrame, order: list[str] | str | None = None) -> DataFrame:
    """Of rows that are the same once their texts are normalized, the first stays, and so do its exact copies.

    Only digests are grouped: to distinct rows, then to the first of each key. What is joined is the list of distinct rows that go, if there are any; no text is shuffled twice, and a large group is one row of each task."""
    df = with_rid(df, order)
    told = df.select(RID, _row_digest(df, True).alias("key"), _row_digest(df, False).alias("row"))
    rows = told.groupBy("key", "row").agg(F.min(RID).alias("at"))
    first = rows.groupBy("key").agg(F.min(F.struct("at", "row")).alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("key").alias("_first_key"), F.col("first.row").alias("_first_row"))
    gone = rows.join(first, F.col("key") == F.col("_first_key")).filter("row <> _first_row").select(F.col("row").alias("_gone"))
    return df.join(gone, _row_digest(df, False) == F.col("_gone"), "left_anti")


def remove_empty_rows(df: DataFrame) -> DataFrame:
    """Rows in which no cell holds anything but white space go."""
    kept = F.lit(False)
    for c in values_of(df):
        kept = kept | (~T.blank(quoted(c)) if kind_of(df, c) == "string" else quoted(c).isNotNull())
    return df.filter(kept)


# Columns


def enable_audit(df: DataFrame) -> DataFrame:
    return df if AUDIT in df.columns else df.withColumn(AUDIT, F.lit(None).cast("string"))


def audited(df: DataFrame, label: str, new: dict[str, Column]) -> DataFrame:
    """df with new values for columns, and in the audit column, if there is one, the label and the columns that changed in the row."""
    if AUDIT not in df.columns:
        return df.withColumns(new)
    changed = F.concat_ws(", ", *[F.when(~quoted(c).eqNullSafe(v), c) for c, v in new.items()])
    note = F.when(changed != "", F.concat(F.lit(label + ": "), changed))
    return df.withColumns(new | {AUDIT: F.substring(F.nullif(F.concat_ws("; ", quoted(AUDIT), note), F.lit("")), 1, AUDIT_CHARS)})


def _gaps(df: DataFrame, distinct: bool) -> tuple[int, dict[str, int], dict[str, bool]]:
    names = values_of(df)
    aggs = [F.count(F.lit(1)).alias("n"), *[F.count(quoted(c)).alias(f"c{i}") for i, c in enumerate(names)]]
    if distinct:  # one value only if the smallest is the largest: no distinct counts, so one pass with partial aggregation
        aggs += [F.min(quoted(c)).eqNullSafe(F.max(quoted(c))).alias(f"d{i}") for i, c in enumerate(names) if not kind_of(df, c).startswith("map")]
    row = df.agg(*aggs).first().asDict()
    return row["n"], {c: row["n"] - row[f"c{i}"] for i, c in enumerate(names)}, {c: row.get(f"d{i}", False) for i, c in enumerate(names)}


def remove_constant_columns(df: DataFrame) -> DataFrame:
    """Columns without nulls and with one value, if there are several rows; one data column always stays."""
    rows, nulls, single = _gaps(df, True)
    gone = [c for c in values_of(df) if rows > 1 and not nulls[c] and single[c]]
    return _without(df, gone)


def remove_empty_columns(df: DataFrame) -> DataFrame:
    rows, nulls, _ = _gaps(df, False)
    return _without(df, [c for c in values_of(df) if rows and nulls[c] == rows])


def remove_high_null_columns(df: DataFrame) -> DataFrame:
    """80 % nulls or more, but not all."""
    rows, nulls, _ = _gaps(df, False)
    return _without(df, [c for c in values_of(df) if rows and nulls[c] < rows and nulls[c] * 100 >= HIGH_NULLS * rows])


def _without(df: DataFrame, gone: list[str]) -> DataFrame:
    if gone and len(gone) == len(values_of(df)):
        gone = gone[1:]
    return df.drop(*[quoted(c) for c in gone])


def remove_identifier_columns(df: DataFrame) -> DataFrame:
    return _without(df, [c for c in values_of(df) if privacy_signal(c) == "identifier"])


def remove_personal_columns(df: DataFrame) -> DataFrame:
    return _without(df, [c for c in values_of(df) if privacy_signal(c) in PERSONAL])


def mask_personal_values(df: DataFrame) -> DataFrame:
    return audited(df, "mask", {c: T.mask(quoted(c)) for c in values_of(df) if privacy_signal(c) in PERSONAL})


def normalize_column_names(df: DataFrame) -> DataFrame:
    names = values_of(df)
    new = dict(zip(names, normalized_names(names), strict=True))
    return df.select(*[quoted(c).alias(new.get(c, c)) for c in df.columns])


# Values


def trim_text_values(df: DataFrame) -> DataFrame:
    return audited(df, "trim", {c: T.trim(quoted(c)) for c in text_columns(df)})


def normalize_text_values(df: DataFrame, accents: bool = False) -> DataFrame:
    """accents: whether to take them off."""
    return audited(df, "normalize", {c: T.normalize_text(quoted(c), accents) for c in text_columns(df)})


def normalize_sentinels(df: DataFrame) -> DataFrame:
    """Markers of missing values become null; a marker that is a word and stands in one cell of its column only is data."""
    names = text_columns(df)
    if not names:
        return df
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), T.word_sentinel(quoted(c)).alias("w")) for i, c in enumerate(names)]))
    # at most as many groups as columns times words
    lone = df.select(pairs.alias("p")).filter("p.w is not null").groupBy("p.i", "p.w").agg(F.count("*").alias("n")).filter("n = 1").collect()
    words: dict[int, list[str]] = {}
    for r in lone:
        words.setdefault(r["i"], []).append(r["w"])
    new = {}
    for i, c in enumerate(names):
        missing = T.sentinel(quoted(c))
        if i in words:
            missing = missing & ~T.normalize_text(quoted(c)).isin(words[i])
        new[c] = F.when(~missing, quoted(c))
    return audited(df, "sentinels", new)


def _shares(df: DataFrame, tests: dict[str, list[Column]]) -> dict[str, tuple[int, list[int]]]:
    """column -> (values, how many meet each test); in one pass."""
    aggs = []
    for i, (c, ts) in enumerate(tests.items()):
        aggs.append(F.count(quoted(c)).alias(f"n{i}"))
        aggs += [F.count_if(t).alias(f"t{i}_{j}") for j, t in enumerate(ts)]
    row = df.agg(*aggs).first() if aggs else {}
    return {c: (row[f"n{i}"], [row[f"t{i}_{j}"] for j in range(len(ts))]) for i, (c, ts) in enumerate(tests.items())}


def normalize_booleans(df: DataFrame) -> DataFrame:
    """true and false in text columns with at least three values that aren't blank, of which 90 % are such words."""
    names = text_columns(df)
    found = _shares(df, {c: [T.boolean_token(quoted(c)).isNotNull(), ~T.blank(quoted(c))] for c in names})
    chosen = [c for c, (_, (k, n)) in found.items() if n >= 3 and k * 10 >= 9 * n]
    return audited(df, "booleans", {c: F.coalesce(T.boolean_token(quoted(c)), quoted(c)) for c in chosen})


def fix_encoding(df: DataFrame) -> DataFrame:
    return audited(df, "encoding", {c: T.repair_mojibake(quoted(c)) for c in text_columns(df)})


def nullify_invalid(df: DataFrame) -> DataFrame:
    """In text columns whose values suggest a type, values of no such type become null."""
    from .profile import readers, suggested_types

    types = suggested_types(df, text_columns(df))
    return audited(df, "invalid", {c: F.when(readers(quoted(c))[t].isNotNull(), quoted(c)) for c, t in types.items() if t})


def cast_numbers(df: DataFrame) -> DataFrame:
    """Text columns of which over 90 % of the values are whole numbers and none has a sign of decimals (a point, an e), become long; else those of which over 90 % are numbers, double. Not identifiers, nor
    codes with leading zeros; whole numbers beyond 2**53 in a column of doubles are an error. What isn't a number becomes null."""
    names = [c for c in text_columns(df) if privacy_signal(c) != "identifier"]
    tests = {}
    for c in names:
        x = quoted(c)
        d = P.strict_double(x)
        tests[c] = [P.strict_long(x).isNotNull(), d.isNotNull(), P.leading_zero_code(x), F.rlike(x, F.lit("[.eE]")), (d == F.floor(d)) & (F.abs(d) > P.EXACT)]
    new = {}
    for c, (n, (longs, doubles, codes, signs, inexact)) in _shares(df, tests).items():
        if not n or codes:
            continue
        if not signs and longs * 10 > 9 * n:
            new[c] = P.strict_long(quoted(c))
        elif doubles * 10 > 9 * n:
            if inexact:
                raise ValueError(f"column {c!r} holds numbers that would lose digits")
            new[c] = P.strict_double(quoted(c))
    return df.withColumns(new)


def cast_dates(df: DataFrame) -> DataFrame:
    """Text columns become timestamps by the first way of writing dates that reads over 80 % of their first 50 values, all in the years 1900 to 2100, if over all rows it leaves at most one row in a hundred without its value and reads no other years."""
    from .profile import DATE_FORMATS, read_date

    df = with_rid(df)
    chosen = {}
    for c in text_columns(df):
        # the first values: a bounded sample, as the rule says
        first = df.filter(quoted(c).isNotNull()).orderBy(RID).limit(50).select(quoted(c).alias("v"))
        counts = [x for i, f in enumerate(DATE_FORMATS) for x in (F.count(read_date(F.col("v"), f)).alias(f"f{i}"), F.count(read_date(F.col("v"), f, False)).alias(f"r{i}"))]
        row = first.agg(F.count("v").alias("n"), *counts).first()
        fits = [f for i, f in enumerate(DATE_FORMATS) if row[f"f{i}"] * 10 > 8 * row["n"] and row[f"f{i}"] == row[f"r{i}"]]
        if fits:
            chosen[c] = fits[0]
    if not chosen:
        return df
    rows = df.count()
    found = _shares(df, {c: [read_date(quoted(c), f).isNotNull(), read_date(quoted(c), f, False).isNotNull()] for c, f in chosen.items()})
    return df.withColumns({c: read_date(quoted(c), f) for c, f in chosen.items() if (found[c][0] - found[c][1][0]) * 100 <= rows and found[c][1][0] == found[c][1][1]})


@dataclass
class Report:
    rows_removed: int
    changed_cells: int
    by_column: dict[str, int]


PREVIEW = "step string, column_name string, cells long"


def preview_safe_corrections(df: DataFrame, order: list[str] | str | None = None) -> DataFrame:
    """What safe_corrections would change, without the changed table: step, column_name (null: whole rows), cells. Steps: trim, sentinels, rename, duplicates (rows), cast to a type, gaps. One pass for
    the cells, one for the duplicates and two for the types of what stays."""
    df = with_rid(df, order)
    found: list[tuple[str, str | None, int]] = []
    trimmed = trim_text_values(df)
    marked = normalize_sentinels(trimmed)
    names, texts = values_of(df), text_columns(df)
    # the operators' own expressions, on columns put side by side
    both = df.select(*[quoted(c).alias(f"a{i}") for i, c in enumerate(texts)], *[T.trim(quoted(c)).alias(f"b{i}") for i, c in enumerate(texts)])
    row = both.agg(*[F.count_if(~F.col(f"a{i}").eqNullSafe(F.col(f"b{i}"))).alias(f"t{i}") for i in range(len(texts))]).first() if texts else {}
    found += [("trim", c, row[f"t{i}"]) for i, c in enumerate(texts)]
    before = trimmed.agg(*[F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(texts)]).first() if texts else {}
    after = marked.agg(*[F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(texts)]).first() if texts else {}
    found += [("sentinels", c, before[f"n{i}"] - after[f"n{i}"]) for i, c in enumerate(texts)]
    new_names = dict(zip(names, normalized_names(names), strict=True))
    found += [("rename", c, 1) for c in names if new_names[c] != c]
    distinct = remove_duplicates(normalize_column_names(marked))
    rows = distinct.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    found.append(("duplicates", None, df.count() - rows))
    types = _full_casts(distinct)
    found += [(f"cast to {kind_of(distinct.select(x.alias('x')), 'x')}", c, rows) for c, x in types.items()]
    gaps = distinct.withColumns(types)
    from .outliers import impute_missing

    filled = impute_missing(gaps)
    counts = lambda d: d.agg(*[F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(values_of(gaps))]).first()
    had, has = counts(gaps), counts(filled)
    found += [("gaps", c, has[f"n{i}"] - had[f"n{i}"]) for i, c in enumerate(values_of(gaps))]
    return df.sparkSession.createDataFrame([x for x in found if x[2]], PREVIEW)


def report(before: DataFrame, after: DataFrame, order: str = RID) -> Report:
    """What changed, for frames with the same order column: a join on it, and one aggregation."""
    shared = [c for c in values_of(after) if c in before.columns and kind_of(before, c) == kind_of(after, c) and c != order]
    joined = after.select(quoted(order), *[quoted(c).alias(f"n{i}") for i, c in enumerate(shared)]).join(before.select(quoted(order), *[quoted(c).alias(f"o{i}") for i, c in enumerate(shared)]), order)
    row = joined.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(~F.col(f"n{i}").eqNullSafe(F.col(f"o{i}"))).alias(f"c{i}") for i in range(len(shared))]).first()
    by = {c: row[f"c{i}"] for i, c in enumerate(shared)}
    return Report(before.count() - row["rows"], sum(by.values()), by)


def _full_casts(df: DataFrame) -> dict[str, Column]:
    """The text columns of which every value converts, with the converted column. Leading zeros keep codes from becoming numbers; a day or month may have one."""
    from .profile import DATE_FORMATS, read_date

    names = [c for c in text_columns(df) if privacy_signal(c) != "identifier"]
    tests = {c: [P.strict_long(quoted(c)).isNotNull(), P.exact_number(quoted(c)).isNotNull(), P.leading_zero_code(quoted(c)), *[read_date(quoted(c), f).isNotNull() for f in DATE_FORMATS]] for c in names}
    new = {}
    for c, (n, (longs, doubles, codes, *dates)) in _shares(df, tests).items():
        if not n:
            continue
        if longs == n and not codes:
            new[c] = P.strict_long(quoted(c))
        elif doubles == n and not codes:
            new[c] = P.strict_double(quoted(c))
        elif n in dates:
            new[c] = read_date(quoted(c), DATE_FORMATS[dates.index(n)])
    return new


def safe_corrections(df: DataFrame, order: list[str] | str | None = None) -> DataFrame:
    """Trim, sentinels, column names, exact duplicates, full numeric and date casts (only where every value converts), gaps."""
    from .outliers import impute_missing

    df = with_rid(df, order)
    df = remove_duplicates(normalize_column_names(normalize_sentinels(trim_text_values(df))))
    return impute_missing(df.withColumns(_full_casts(df)))
