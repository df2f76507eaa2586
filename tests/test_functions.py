import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from sievework.functions import names, parse, text


def values(spark, make, rows, kind="string"):
    column = make(F.col("v"))
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", column.alias("x")).orderBy("i").select("x").collect()]


def test_trim_and_squeeze(spark):
    assert values(spark, lambda V: text.trim(V), ["  a b ", " ", None, "x"]) == ["a b", "", None, "x"]
    assert values(spark, lambda V: text.squeeze(V), [" a  \t b\n", ""]) == ["a b", ""]


def test_normalize(spark):
    rows = ["  ÁRBOL  Ñandú ", "Ελλάδα", "日本 É", "plain", None]
    assert values(spark, lambda V: text.normalize_text(V), rows) == ["arbol nandu", "ελλαδα", "日本 é", "plain", None]
    assert values(spark, lambda V: text.normalize_text(V, False), rows[:1]) == ["árbol ñandú"]
    for a, b in zip(text.ACCENTED, text.PLAIN, strict=True):
        assert unicodedata.normalize("NFD", a)[0] == b


def test_render_doubles(spark):
    rows = [1.0, 0.1, 1e20, 123456789.0, 1.5e-7, float("nan"), float("inf"), None, -0.0, 0.0001, 12345678.5, 5e-324]
    got = values(spark, lambda V: text.render_text(V, "double"), rows, "double")
    assert got[:6] == ["1.0", "0.1", "1e20", "123456789.0", "1.5e-7", "NaN"] and got[6:9] == ["inf", None, "-0.0"]
    for r, g in zip(rows[:5], got[:5], strict=True):
        assert float(g) == r
    assert [float(x) for x in got[9:]] == rows[9:]


def test_contacts_and_extractions(spark):
    assert values(spark, lambda V: text.email(V), [" A@B.Com "]) == ["a@b.com"]
    assert values(spark, lambda V: text.phone(V), [" +34 600-1", "tel 12 3", "x"]) == ["+346001", "123", ""]
    rows = ["ab12 c3 ", "", "  ", None, "ñandú-7"]
    assert values(spark, lambda V: text.first_token(V), rows) == ["ab12", None, None, None, "ñandú-7"]
    assert values(spark, lambda V: text.last_token(V), rows) == ["c3", None, None, None, "ñandú-7"]
    assert values(spark, lambda V: text.digits(V), rows) == ["12", None, None, None, "7"]
    assert values(spark, lambda V: text.letters(V), rows) == ["ab", None, None, None, "ñandú"]
    assert values(spark, lambda V: text.before(V, "-"), ["a-b-c", "-x", "none", None]) == ["a", "", None, None]
    assert values(spark, lambda V: text.after(V, "-"), ["a-b-c", "x-", "none", None]) == ["b-c", "", None, None]
    assert values(spark, lambda V: text.split_part(V, ".", 2, 1), ["a.b.c", "a", ".", None]) == ["b.c", None, "", None]
    assert values(spark, lambda V: text.merge_parts([V, F.lit(None).cast("string")], "-"), ["a", None]) == ["a", None]


def test_sentinels_and_booleans(spark):
    rows = ["N/A", " null ", "", "Vacío", "(VACÍO)", "x", None, "Desconocido"]
    assert values(spark, lambda V: text.sentinel(V), rows) == [True, True, True, False, True, False, None, True]
    assert values(spark, lambda V: text.word_sentinel(V), rows)[-1] == "desconocido"
    assert values(spark, lambda V: text.boolean_token(V), ["SÍ", "no", "yes ", "1", None]) == ["true", "false", "true", None, None]


def test_mojibake(spark):
    good = ["café", "“quoted” – ñ", "niño…"]
    bad = [g.encode().decode("cp1252", errors="replace") for g in good[:1]] + ["niÃ±o"]
    assert values(spark, lambda V: text.repair_mojibake(V), [*bad, "plain", "Ã© 日本", None]) == ["café", "niño", "plain", "Ã© 日本", None]


def test_privacy_values(spark):
    import hashlib

    assert values(spark, lambda V: text.mask(V), ["a", None]) == [text.REDACTED, None]
    assert values(spark, lambda V: text.salted_hash(V, b"\x00\xff"), ["é"]) == [hashlib.sha256(b"\x00\xff" + "é".encode()).hexdigest()]


def test_formulas(spark):
    rows = ["=1+1", "-1,5", "+34 600 000", "-", "@x", "\tx", "a=1", "-x", "-1.234,56", None, ""]
    assert values(spark, lambda V: text.formula_safe(V), rows) == ["'=1+1", "-1,5", "+34 600 000", "-", "'@x", "'\tx", "a=1", "'-x", "-1.234,56", None, ""]


def test_regex_dialect(spark):
    assert text.java_replacement("${2}_$1$$", r"(a)(b)") == r"${2}_$1\$".replace("${2}", "$2")
    assert text.java_replacement("$1x", "(a)") == ""
    assert text.java_replacement("[$name]", "(?P<name>a)") == "[${name}]"
    with pytest.raises(ValueError):
        text.java_regex("(?=a)")
    assert values(spark, lambda V: F.regexp_replace(V, text.java_regex(r"\w+"), "x"), ["ñandú 1"]) == ["x x"]


def test_strict_numbers(spark):
    rows = ["1d", "nan", "Infinity", "+5", "1e3", " 7 ", "1_000", "", None, "5.", ".5", "1e999", "9223372036854775808"]
    assert values(spark, lambda V: parse.strict_double(V), rows) == [None, None, None, 5.0, 1000.0, 7.0, None, None, None, 5.0, 0.5, None, 9223372036854775808.0]
    assert values(spark, lambda V: parse.strict_long(V), rows) == [None, None, None, 5, None, 7, None, None, None, None, None, None, None]
    assert values(spark, lambda V: parse.exact_number(V), ["9007199254740992", "9007199254740993", "1.5"]) == [9007199254740992.0, None, 1.5]
    assert values(spark, lambda V: parse.strict_boolean(V), ["true", "TRUE", "1", " False "]) == [True, True, None, False]
    assert values(spark, lambda V: parse.comma_decimal(V), ["1.234,56", "1 234,5", "1,5", "1,23,4", "x"]) == ["1234.56", "1234.5", "1.5", "1,23,4", "x"]
    assert values(spark, lambda V: parse.leading_zero_code(V), ["007", "0", "0.5", "-01"]) == [True, False, False, True]


def test_strict_dates(spark):
    as_text = lambda c: c.cast("string")
    assert values(spark, lambda V: as_text(parse.strict_date(V, "dmy")), ["3/4/2024", "31/02/2024", "13/13/2024", "3/4/24", "29-02-2024"]) == ["2024-04-03", None, None, None, "2024-02-29"]
    assert values(spark, lambda V: as_text(parse.strict_date(V, "mdy")), ["3/4/2024"]) == ["2024-03-04"]
    assert values(spark, lambda V: as_text(parse.strict_date(V, "iso8601")), ["2024-01-02", "2024-1-2", "2024-01-02T10:00:00Z"]) == ["2024-01-02", None, "2024-01-02"]
    rows = ["2024-01-02T10:00:00+02:00", "2024-01-02 10:00", "2024-01-02", "2024-01-02T25:00:00", "2024-01-02T10:00:00.123456Z"]
    assert values(spark, lambda V: as_text(parse.strict_datetime(V, "iso8601")), rows) == ["2024-01-02 08:00:00", "2024-01-02 10:00:00", "2024-01-02 00:00:00", None, "2024-01-02 10:00:00.123456"]
    assert values(spark, lambda V: as_text(parse.two_digit_year_date(V, "dmy")), ["1/2/29", "1/2/30", "1/2/1899"]) == ["2029-02-01", "1930-02-01", None]


def test_names():
    assert names.normalized_names(["Región-Nº 1", "región - nº 1 ", "1a", "%", "", "が -%- x"]) == ["region_nº_1", "region_nº_1_2", "col_1a", "unnamed", "unnamed_2", "が_x"]
    assert names.readable_headers(["a", "", "a", None]) == ["a", "column_2", "a_2", "column_4"]
    signals = {"clientEmail": "email", "hotel": None, "tel": "phone", "file_name": None, "full name": "name", "user_id": "identifier", "Dirección": "address", "idea": None, "product name": None, "Apellidos": "name"}
    assert {k: names.privacy_signal(k) for k in signals} == signals
    assert re.fullmatch(text.SAFE_SIGNED, "-1")


def test_iso_dates_compile(spark):
    """The date of a date-time is one copy of the date-time's expression: many were too large to compile, and ran a hundred times as long."""
    df = spark.createDataFrame([("2024-01-02T10:00:00Z",)], "v string")
    size = lambda c: len(df.select(c)._jdf.queryExecution().optimizedPlan().toString())
    spark.conf.set("spark.sql.maxPlanStringLength", "100000000")
    date, stamp = size(parse.strict_date(F.col("v"), "iso8601")), size(parse.strict_datetime(F.col("v"), "iso8601"))
    spark.conf.unset("spark.sql.maxPlanStringLength")
    assert date < 2 * stamp
    rows = ["9999-12-31T23:30:00-01:00", "0000-01-01T00:30:00+01:00", "0001-01-01T00:30:00+01:00", "2024-02-29T23:59:59.5-00:01", "2024-02-30T00:00", "2024-01-01 24:00", " 2024-01-01T00:30+0100 ", "2024-01-01"]
    assert values(spark, lambda V: parse.strict_date(V, "iso8601").cast("string"), rows) == [None, None, "0000-12-31", "2024-03-01", None, None, "2023-12-31", "2024-01-01"]
