"""Strict readers of text: a value is read or it is null, and callers decide what a null that wasn't one means.

The grammars are narrower than Spark's casts, which take '1d', 'nan', 'Infinity' for numbers and 'yes', '1', 't' for booleans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim

#: The grammars of whole numbers, numbers and numbers with a decimal comma.
LONG = r"^[+-]?[0-9]+$"
DOUBLE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
COMMA_NUMBER = r"^[+-]?([0-9]+|[0-9]{1,3}(\.[0-9]{3})+|[0-9]{1,3}( [0-9]{3})+),[0-9]+$"
#: The largest integer up to which doubles hold every integer.
EXACT = 1 << 53


def strict_long(c: Column) -> Column:
    t = trim(c)
    return F.when(F.rlike(t, F.lit(LONG)), t.try_cast("bigint"))


def strict_double(c: Column) -> Column:
    """Finite numbers only."""
    t = trim(c)
    value = F.when(F.rlike(t, F.lit(DOUBLE)), t.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def strict_boolean(c: Column) -> Column:
    """true or false in any case of A-Z."""
    t = F.lower(trim(c))
    return F.when(t == "true", True).when(t == "false", False)


def exact_number(c: Column) -> Column:
    """For arithmetic: a double, null too for integers that a double can't hold."""
    t = trim(c)
    whole = F.rlike(t, F.lit(LONG))
    return F.when(~whole | (F.abs(t.try_cast("decimal(38,0)")) <= EXACT), strict_double(c))


def is_comma_decimal(t: Column) -> Column:
    """Of a trimmed text: 1.234,5 or 1 234,5 or 1234,5."""
    return F.rlike(t, F.lit(COMMA_NUMBER))


def comma_decimal(c: Column) -> Column:
    """Such a text as 1234.5; other text stays."""
    t = trim(c)
    return F.when(is_comma_decimal(t), F.replace(F.regexp_replace(t, "[. ]", ""), F.lit(","), F.lit("."))).otherwise(c)


def leading_zero_code(c: Column) -> Column:
    return F.rlike(trim(c), F.lit(r"^[+-]?0[0-9]"))


def _date(year: Column, month: Column, day: Column) -> Column:
    y, m, d = (x.try_cast("int") for x in (year, month, day))
    last = F.day(F.last_day(F.try_make_timestamp(y, m, F.lit(1), F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)")).cast("date")))
    return F.when((m >= 1) & (m <= 12) & (d >= 1) & (d <= last), F.try_to_timestamp(F.format_string("%04d-%02d-%02d", y, m, d), F.lit("yyyy-MM-dd")).cast("date"))


#: Orders of a date's parts, each with a regular expression whose groups are year, month, day as numbered.
ORDERS = {
    "ymd": (r"^([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})$", (1, 2, 3)),
    "dmy": (r"^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4})$", (3, 2, 1)),
    "mdy": (r"^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4})$", (3, 1, 2)),
    "iso8601": (r"^([0-9]{4})-([0-9]{2})-([0-9]{2})$", (1, 2, 3)),
}
TIME = r"(?:[T ]([0-9]{2}):([0-9]{2})(?::([0-9]{2})(?:\.([0-9]{1,9}))?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)"
#: A time of day that leaves the date as it is.
CLOCK = r"(?:[T ](?:[01][0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9](?:\.[0-9]{1,9})?)?Z?)?"


def strict_date(c: Column, order: str) -> Column:
    """A date with a four-digit year; iso8601 takes the date of a date-time too."""
    pattern, (y, m, d) = ORDERS[order]
    t = trim(c)
    plain = pattern[:-1] + CLOCK + "$" if order == "iso8601" else pattern
    read = F.when(F.rlike(t, F.lit(plain)), _date(*(F.regexp_extract(t, plain, g) for g in (y, m, d))))
    if order == "iso8601":
        # the date-time's expression is large and is there once, so that Spark can compile the whole; a zone may move its date out of the four-digit years
        moved = F.regexp_extract(strict_datetime(c, order).cast("date").cast("string"), r"^([0-9]{4}-[0-9]{2}-[0-9]{2})$", 1).try_cast("date")
        read = read.when(F.rlike(t, F.lit(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}" + TIME + "$")), moved)
    return read


def strict_datetime(c: Column, order: str) -> Column:
    """A timestamp without zone; a zone given in the text is applied, so that the result is UTC."""
    pattern, groups = ORDERS[order]
    t = trim(c)
    day = F.regexp_extract(t, r"^([^T ]*)", 1)
    time = "^[^T ]*" + TIME + "$"
    part = [F.regexp_extract(t, time, g) for g in range(1, 6)]
    date = F.when(F.rlike(day, F.lit(pattern)), _date(*(F.regexp_extract(day, pattern, g) for g in groups)))
    h, m, s = part[0], part[1], F.when(part[2] == "", "00").otherwise(part[2])
    clock = F.concat(h, F.lit(":"), m, F.lit(":"), s, F.lit("."), F.rpad(F.substring(part[3], 1, 6), 6, "0"))
    stamp = F.try_to_timestamp(F.concat(date.cast("string"), F.lit(" "), clock), F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")).cast("timestamp_ntz")
    zone = part[4]
    minutes = F.when(zone.isin("", "Z"), 0).otherwise(
        (F.substring(zone, 2, 2).try_cast("int") * 60 + F.regexp_extract(zone, "([0-9]{2})$", 1).try_cast("int")) * F.when(F.startswith(zone, F.lit("-")), -1).otherwise(1)
    )
    moved = stamp - F.make_dt_interval(F.lit(0), F.lit(0), minutes, F.lit(0).cast("decimal(18,6)"))
    return F.when(date.isNotNull() & (F.length(t) == F.length(day)), date.cast("timestamp_ntz")).when(date.isNotNull() & F.rlike(t, F.lit(time)), moved)


def two_digit_year_date(c: Column, order: str) -> Column:
    """dmy or mdy with a year of two (under 30: 20xx, else 19xx) or four digits, within 1900 to 2100; for the inference of a column's order."""
    pattern = r"^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4}|[0-9]{2})(?:[ T].*)?$"
    t = trim(c)
    year = F.regexp_extract(t, pattern, 3).try_cast("int")
    year = F.when(F.length(F.regexp_extract(t, pattern, 3)) == 2, year + F.when(year < 30, 2000).otherwise(1900)).otherwise(year)
    a, b = F.regexp_extract(t, pattern, 1), F.regexp_extract(t, pattern, 2)
    value = _date(year.cast("string"), *((b, a) if order == "dmy" else (a, b)))
    return F.when(F.rlike(t, F.lit(pattern)) & (year >= 1900) & (year <= 2100), value)


def strict_cast(c: Column, target: str) -> Column:
    """target: string, integer, decimal or boolean."""
    return {"string": lambda x: x, "integer": strict_long, "decimal": strict_double, "boolean": strict_boolean}[target](c)
