"""JSON, Parquet, workbooks, databases, and conventions for typing imported text."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse as P
from ..functions import text as T
from ..functions.names import readable_headers
from ..functions.order import RID, quoted, widened
from .delimited import head

EXACT = 1 << 53


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return widened(spark.read.parquet(path))


def read_json(spark: SparkSession, path: str, keys: list[str] | None = None) -> DataFrame:
    """Records of a JSON array or of lines of JSON. Each column has the narrowest of boolean, long, double and text that holds all its values; long and double together are double, unless a whole number
    is beyond 2**53; nested values are JSON text. Columns stand in the order of their first appearance in the first records (keys: an order of your own)."""
    array = head(spark, path, 4096).decode("utf-8", errors="ignore").lstrip("\ufeff \t\r\n").startswith("[")
    raw = spark.read.option("multiLine", array).option("primitivesAsString", False).option("prefersDecimal", True).json(path)
    if "_corrupt_record" in raw.columns:
        raise ValueError("the file holds something else than records")
    text = spark.read.option("multiLine", array).schema(", ".join("`" + c.replace("`", "``") + "` string" for c in raw.columns)).json(path)
    names = keys or key_order(head(spark, path).decode("utf-8", errors="ignore"), raw.columns)
    kinds = dict(raw.dtypes)
    out, doubtful = {}, []
    for c in names:
        kind = kinds[c]
        if kind in ("boolean", "bigint"):
            out[c] = quoted(c).cast(kind)
        elif kind == "double" or kind.startswith("decimal"):
            doubtful.append(c)
        else:
            out[c] = quoted(c)
    if doubtful:
        whole = [F.max(F.when(F.rlike(quoted(c), F.lit(P.LONG)), F.abs(quoted(c).try_cast("decimal(38,0)")))).alias(f"w{i}") for i, c in enumerate(doubtful)]
        parts = [F.count_if(~F.rlike(quoted(c), F.lit(P.LONG))).alias(f"p{i}") for i, c in enumerate(doubtful)]
        row = text.agg(*whole, *parts).first()
        for i, c in enumerate(doubtful):
            exact = row[f"w{i}"] is None or row[f"w{i}"] <= EXACT
            out[c] = quoted(c).try_cast("double") if exact and row[f"p{i}"] else quoted(c).try_cast("bigint") if not row[f"p{i}"] and row[f"w{i}"] < 1 << 63 else quoted(c)
    return text.select(*[out[c].alias(c) for c in names])


def key_order(sample: str, columns: list[str]) -> list[str]:
    """Columns by first appearance in the sample's whole records, the others after them."""
    seen: list[str] = []
    decoder, at = json.JSONDecoder(), sample.find("{")
    while at >= 0:
        try:
            record, end = decoder.raw_decode(sample, at)
        except ValueError:
            break
        seen += [k for k in record if k not in seen]
        at = sample.find("{", end)
    return [c for c in seen if c in columns] + [c for c in columns if c not in seen]


def read_workbook(spark: SparkSession, path: str, sheet: str | int = 0, header: bool = True) -> DataFrame:
    """A sheet of a workbook. XLSX is read with the standard library, other formats need an engine that pandas finds. Read on the driver: a sheet has a million rows at most.

    Title rows above the first row that fills the sheet's width are skipped."""
    data = head(spark, path, 1 << 30)
    rows = xlsx_rows(data, sheet) if data[:4] == b"PK\x03\x04" and not path.lower().endswith((".ods", ".xlsb")) else _other_rows(data, sheet)
    if not rows:
        raise ValueError("the sheet is empty")
    width = max(sum(v is not None for v in r) for r in rows)
    start = next((i for i, r in enumerate(rows) if sum(v is not None for v in r) == width), 0) if header else 0
    across = max(map(len, rows))
    rows = [r + [None] * (across - len(r)) for r in rows]
    names = readable_headers([None if v is None else str(v) for v in rows[start]]) if header else readable_headers([None] * across)
    body = rows[start + header :]
    kinds = [merged_kind([r[i] for r in body]) for i in range(len(names))]
    make = {"bigint": int, "double": float, "boolean": bool, "timestamp_ntz": lambda v: v, "string": lambda v: str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)}
    return spark.createDataFrame([tuple(None if v is None else make[k](v) for v, k in zip(r, kinds, strict=True)) for r in body], ", ".join(f"`{n.replace('`', '``')}` {k}" for n, k in zip(names, kinds, strict=True)))


def _other_rows(data: bytes, sheet: str | int) -> list[list[Any]]:
    import io

    import pandas as pd

    try:
        cells = pd.read_excel(io.BytesIO(data), sheet_name=sheet, header=None, dtype=object)
    except ImportError as e:
        raise RuntimeError("reading this kind of workbook needs an optional package") from e
    return [[None if v is None or v != v else v for v in r] for r in cells.itertuples(index=False)]


def xlsx_rows(data: bytes, sheet: str | int = 0) -> list[list[Any]]:
    """The cells of a sheet, by name or place: text, numbers, booleans, and dates where a cell's format says so."""
    import datetime
    import io
    import re
    import zipfile
    from xml.etree import ElementTree as X

    z = zipfile.ZipFile(io.BytesIO(data))
    parts = {n.lower(): n for n in z.namelist()}
    read = lambda n: X.fromstring(z.read(parts[n.lower()]))
    tag = lambda e: e.tag.rpartition("}")[2]
    sheets = [e for e in read("xl/workbook.xml").iter() if tag(e) == "sheet"]
    chosen = sheets[sheet] if isinstance(sheet, int) else next((e for e in sheets if e.get("name") == sheet), None)
    if chosen is None:
        raise ValueError(f"no sheet {sheet!r}")
    rid = next(v for k, v in chosen.attrib.items() if k.endswith("}id"))
    target = next(e.get("Target") for e in read("xl/_rels/workbook.xml.rels") if e.get("Id") == rid)
    shared = ["".join(t.text or "" for t in s.iter() if tag(t) == "t") for s in read("xl/sharedStrings.xml") if tag(s) == "si"] if "xl/sharedstrings.xml" in parts else []
    dated: set[int] = set()
    if "xl/styles.xml" in parts:
        styles = read("xl/styles.xml")
        own = {int(e.get("numFmtId")): e.get("formatCode", "") for e in styles.iter() if tag(e) == "numFmt"}
        cells = next((e for e in styles if tag(e) == "cellXfs"), [])
        for i, e in enumerate(cells):
            n = int(e.get("numFmtId", 0))
            if 14 <= n <= 22 or 45 <= n <= 47 or re.search("[dmyhs]", re.sub(r'"[^"]*"|\\[[^\]]*\]', "", own.get(n, "")), re.I):
                dated.add(i)
    out: list[list[Any]] = []
    for row in (e for e in read("xl/" + target.removeprefix("/xl/")).iter() if tag(e) == "row"):
        at = int(row.get("r", len(out) + 1))
        out += [[] for _ in range(at - len(out))]
        for c in (e for e in row if tag(e) == "c"):
            letters = re.match("[A-Z]+", c.get("r", ""))
            place = len(out[at - 1]) if not letters else sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters[0]))) - 1
            kind, v = c.get("t", "n"), next((e.text for e in c if tag(e) == "v"), None)
            if kind == "inlineStr":
                value = "".join(t.text or "" for t in c.iter() if tag(t) == "t")
            elif v is None:
                value = None
            elif kind == "s":
                value = shared[int(v)]
            elif kind == "b":
                value = v == "1"
            elif kind in ("str", "e", "d"):
                value = v
            elif int(c.get("s", -1)) in dated:
                value = datetime.datetime(1899, 12, 30) + datetime.timedelta(seconds=round(float(v) * 86400))
            else:
                value = float(v)
            out[at - 1] += [None] * (place + 1 - len(out[at - 1]))
            out[at - 1][place] = value
    return [r for r in out if any(v is not None for v in r)]


def merged_kind(values: list[Any]) -> str:
    """Whole numbers, written as reals too, up to 2**53 are long."""
    import datetime

    kinds = set()
    for v in values:
        if v is None:
            continue
        if isinstance(v, bool):
            kinds.add("boolean")
        elif isinstance(v, (int, float)):
            kinds.add("bigint" if float(v).is_integer() and abs(v) <= EXACT else "double")
        elif isinstance(v, (datetime.datetime, datetime.date)):
            kinds.add("timestamp_ntz")
        else:
            kinds.add("string")
    if kinds == {"bigint", "double"}:
        return "double"
    return kinds.pop() if len(kinds) == 1 else "string"


def read_database(spark: SparkSession, url: str, table: str, limit: int | None = None, columns: list[str] | None = None, **options: str) -> DataFrame:
    """A table over JDBC, all as text. partitionColumn, lowerBound, upperBound and numPartitions read it in parallel."""
    df = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    df = df.select(*columns) if columns else df
    df = df.limit(limit) if limit else df
    return df.select(*[T.render_text(quoted(c), k).alias(c) for c, k in df.dtypes])


def page(df: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    """Up to 200 rows in the order of _rid, as text."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit is 1 to 200, offset 0 or more")
    rows = df.orderBy(RID).offset(offset).limit(limit) if RID in df.columns else df.offset(offset).limit(limit)
    return rows.select(*[T.render_text(quoted(c), k).alias(c) for c, k in rows.dtypes if c != RID])


#: Conventions: how dates or numbers are written in a column. Numbers: (thousands, decimal).
DATES = ("iso8601", "ymd", "dmy", "mdy")
NUMBERS = {"dot": ("", "."), "comma": ("", ","), "comma_dot": (",", "."), "dot_comma": (".", ",")}


def convention(c: Column, name: str) -> Column:
    """A text under a convention, or null."""
    t = T.trim(c)
    if name in DATES:
        return P.strict_date(t, name)
    if name == "integer":
        return F.when(~P.leading_zero_code(t), P.strict_long(t))
    thousands, decimal = NUMBERS[name]
    digits = rf"[0-9]{{1,3}}(?:\{thousands}[0-9]{{3}})+|[0-9]+" if thousands else "[0-9]+"
    shape = rf"^[+-]?(?:{digits})(?:\{decimal}[0-9]+)?$"
    plain = F.replace(t, F.lit(thousands), F.lit("")) if thousands else t
    plain = F.replace(plain, F.lit(decimal), F.lit(".")) if decimal != "." else plain
    return F.when(F.rlike(t, F.lit(shape)), P.strict_double(plain))


def apply_conventions(df: DataFrame, choices: dict[str, str]) -> tuple[DataFrame, list[dict]]:
    """Each column under its convention, if every value that isn't null or blank fits; a column with one that doesn't stays text, and is reported with the number of such values and one of them. One aggregation for all columns."""
    tests = {c: ~T.blank(quoted(c)) & convention(quoted(c), n).isNull() for c, n in choices.items()}
    aggs = [x for i, (c, bad) in enumerate(tests.items()) for x in (F.count_if(bad).alias(f"n{i}"), F.min(F.when(bad, quoted(c))).alias(f"v{i}"))]
    if not aggs:
        return df, []
    row = df.agg(*aggs).first()
    report, new = [], {}
    for i, (c, n) in enumerate(choices.items()):
        report.append({"column": c, "convention": n, "invalid": row[f"n{i}"], "example": row[f"v{i}"], "applied": not row[f"n{i}"]})
        if not row[f"n{i}"]:
            new[c] = convention(quoted(c), n)
    return df.withColumns(new), report


def schema_drift(df: DataFrame, saved: dict[str, str]) -> dict[str, list[str]]:
    """What an import profile expects and the data don't have, and the other way round."""
    now = dict(df.dtypes)
    return {"missing": [c for c in saved if c not in now], "additional": [c for c in now if c not in saved], "changed": [c for c in saved if c in now and now[c] != saved[c]]}
