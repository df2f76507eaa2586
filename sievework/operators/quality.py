"""Quality contracts: up to sixteen declarative rules of eighteen kinds. All rules that look at rows or sums fold into one aggregation; only order, foreign tables and schemas need anything else."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parse as P
from ..functions import text as T
from ..functions.order import RID, data_columns, is_number, is_time, kind_of, quoted, with_rid

MAX_RULES, MAX_ALLOWED = 16, 128
KINDS = [
    "not_null", "non_empty", "unique", "numeric_range", "allowed_values", "regex", "dtype", "unique_together", "column_compare",
    "referential_integrity", "monotonic", "aggregate_check", "aggregate_reconciliation", "distribution_drift", "date_range", "conditional", "schema_contract", "row_count",
]


class ContractError(ValueError):
    pass


@dataclass
class Contract:
    rules: list[dict[str, Any]]

    @classmethod
    def from_json(cls, text: str) -> Contract:
        data = json.loads(text)
        if data.get("version") != 1:
            raise ContractError(f"unknown version {data.get('version')!r}")
        return cls(data["rules"])

    def to_json(self) -> str:
        return json.dumps({"format": "quality-contract", "version": 1, "rules": self.rules}, ensure_ascii=False)


def _spelled(rule: dict) -> dict:
    """A rule in the names used here: saved contracts name pairs of columns by a list, references by referenceValues, and bounds of dates by minDate and maxDate."""
    rule = {k: v for k, v in rule.items() if v is not None}
    kind, columns = rule.get("kind"), rule.get("columns")
    if kind in ("column_compare", "aggregate_reconciliation") and columns:
        rule |= {"column": columns[0]} | ({"other": columns[1]} if len(columns) > 1 else {})
    if kind == "referential_integrity":
        rule.setdefault("reference", rule.get("referenceValues"))
        if columns and len(columns) == 1 and not isinstance(rule["reference"], DataFrame):
            rule = {k: v for k, v in rule.items() if k != "columns"} | {"column": columns[0]}
    if kind == "date_range":
        rule |= {new: rule[old] for old, new in (("minDate", "min"), ("maxDate", "max")) if old in rule}
    return rule


def _number(df: DataFrame, name: str) -> Column:
    """A finite number or null."""
    c, kind = quoted(name), kind_of(df, name)
    n = P.strict_double(c) if kind == "string" else c.cast("int").cast("double") if kind == "boolean" else c.cast("double") if is_number(kind) else F.lit(None).cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) < float("inf")), n)


def _time(c: Column, kind: str, order: str = "iso8601") -> Column:
    if kind == "string":
        return P.strict_datetime(c, order)
    return c.cast("timestamp_ntz") if is_time(kind) else F.lit(None).cast("timestamp_ntz")


def row_test(df: DataFrame, rule: dict) -> Column:
    """Whether a row is invalid under a row-local rule; never null."""
    kind, name = rule["kind"], rule.get("column")
    c = quoted(name) if name else None
    if kind == "not_null":
        return c.isNull()
    if kind == "non_empty":
        return T.blank(c) if kind_of(df, name) == "string" else c.isNull()
    if kind == "numeric_range":
        n, bad = _number(df, name), F.lit(False)
        if rule.get("min") is not None:
            bad = bad | (n < float(rule["min"]))
        if rule.get("max") is not None:
            bad = bad | (n > float(rule["max"]))
        return n.isNull() | F.coalesce(bad, F.lit(False))
    if kind == "allowed_values":
        values = rule["values"]
        if len(values) > MAX_ALLOWED or kind_of(df, name) != "string":
            raise ContractError("allowed values are at most 128, of a text column")
        return ~F.coalesce(c.isin(values), F.lit(False))
    if kind == "regex":
        return ~F.coalesce(F.rlike(T.render_text(c, kind_of(df, name)), F.lit(T.java_regex(rule["pattern"]))), F.lit(False))
    if kind == "date_range":
        t, bad = _time(c, kind_of(df, name), rule.get("order", "iso8601")), F.lit(False)
        if rule.get("min"):
            bad = bad | (t < P.strict_datetime(F.lit(rule["min"]), "iso8601"))
        if rule.get("max"):
            bad = bad | (t > P.strict_datetime(F.lit(rule["max"]), "iso8601"))
        return t.isNull() | F.coalesce(bad, F.lit(False))
    if kind == "column_compare":
        a, b = rule["column"], rule["other"]
        x, y = quoted(a), quoted(b)
        if is_number(kind_of(df, a)) and is_number(kind_of(df, b)):
            x, y = x.cast("double"), y.cast("double")
        elif is_time(kind_of(df, a)) and is_time(kind_of(df, b)):
            x, y = x.cast("timestamp_ntz"), y.cast("timestamp_ntz")
        else:
            x, y = T.render_text(x, kind_of(df, a)), T.render_text(y, kind_of(df, b))
        ok = {"eq": x == y, "ne": x != y, "lt": x < y, "lte": x <= y, "gt": x > y, "gte": x >= y}[rule["operator"]]
        return ~F.coalesce(ok, F.lit(False))
    if kind == "referential_integrity" and not isinstance(rule["reference"], DataFrame):
        values = rule["reference"]
        if rule.get("columns"):
            row = F.to_json(F.array(*[T.render_text(quoted(n), kind_of(df, n)) for n in rule["columns"]]))
            some = F.lit(False)
            for n in rule["columns"]:
                some = some | quoted(n).isNull()
            plain = lambda v: v if isinstance(v, str) else json.dumps(v)
            known = [json.dumps([plain(x) for x in (json.loads(v) if isinstance(v, str) else v)], separators=(",", ":"), ensure_ascii=False) for v in values]
            return some | ~F.coalesce(row.isin(known), F.lit(False))
        return ~F.coalesce(T.render_text(c, kind_of(df, name)).isin([str(v) for v in values]), F.lit(False))
    raise ContractError(f"{kind} isn't row-local")


def _plan(df: DataFrame, i: int, rule: dict) -> tuple[list[Column], Any]:
    """Aggregates for the rule, and a function of the one row that gives (checked, invalid)."""
    kind = rule["kind"]
    if kind == "dtype":
        return [], lambda r: (1, int(kind_of(df, rule["column"]) not in _types(rule["dtype"])))
    if kind == "schema_contract":
        have, want = data_columns(df), rule["columns"]
        missing = sum(w not in have for w in want)
        more = 0 if rule.get("allowAdditional", True) else sum(h not in want for h in have)
        order = int(bool(rule.get("ordered")) and [h for h in have if h in want] != [w for w in want if w in have]) + int("requiredOrder" in rule and have != rule["requiredOrder"])
        return [], lambda r: (1, missing + more + order)
    if kind == "row_count":
        return [], lambda r: (1, int(not (rule.get("min") or 0) <= r["rows"] <= (rule.get("max") if rule.get("max") is not None else float("inf"))))
    if kind == "unique":
        return [F.count_distinct(quoted(rule["column"])).alias(f"u{i}")], lambda r: (r["rows"], r["rows"] - r[f"u{i}"])
    if kind == "unique_together":
        key = F.struct(*[quoted(c).alias(f"x{j}") for j, c in enumerate(rule["columns"])])
        return [F.count_distinct(key).alias(f"u{i}")], lambda r: (r["rows"], r["rows"] - r[f"u{i}"])
    if kind in ("aggregate_check", "aggregate_reconciliation", "distribution_drift"):
        names = [rule["column"]] if not rule.get("other") else [rule["column"], rule["other"]]
        n = [_number(df, c) for c in names]
        unread = F.lit(False)
        for c, v in zip(names, n, strict=True):
            unread = unread | (quoted(c).isNotNull() & v.isNull())
        how = "mean" if kind == "distribution_drift" else rule.get("aggregate", "sum")
        made = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "mean": F.avg}[how]
        aggs = [F.count_if(unread).alias(f"b{i}"), *[made(v).alias(f"a{i}_{j}") for j, v in enumerate(n)]]

        aggs += [F.count(v).alias(f"k{i}_{j}") for j, v in enumerate(n)]

        def judged(r):
            seen = [r[f"a{i}_{j}"] if r[f"k{i}_{j}"] or how != "sum" else 0.0 for j in range(len(n))]
            if kind == "distribution_drift":
                if not r[f"k{i}_0"]:
                    return r["rows"], max(1, r[f"b{i}"])
                base = rule.get("baseline", rule.get("referenceValues"))
                base = sum(map(float, base)) / len(base) if isinstance(base, list) else float(base)
                limit = rule.get("toleranceAbs", rule.get("threshold")) or 0.0
                return r["rows"], r[f"b{i}"] + int(abs(seen[0] - base) > float(limit))
            if len(n) > 1:
                expected, around = seen[1], max(abs(seen[0]), abs(seen[1]))
            else:
                given = rule.get("expected")
                if given is None:  # references: their sum for sums, else the first
                    given = sum(map(float, rule["referenceValues"])) if how == "sum" else rule["referenceValues"][0]
                expected = float(given)
                around = abs(expected)
            slack = max(float(rule.get("toleranceAbs") or 0), float(rule.get("toleranceRel") or 0) * around, 1e-9 * max(1.0, around))
            return r["rows"], r[f"b{i}"] + int(seen[0] is None or abs(seen[0] - expected) > slack)

        return aggs, judged
    if kind == "conditional":
        when, then = rule["when"], rule["then"]
        if then["kind"] == "dtype":
            wrong = F.lit(kind_of(df, then["column"]) not in _types(then["dtype"]))
        elif then["kind"] in ("not_null", "non_empty", "numeric_range", "allowed_values", "regex"):
            wrong = row_test(df, then)
        else:
            raise ContractError(f"no conditional {then['kind']}")
        applies = _holds(df, when)
        return [F.count_if(applies).alias(f"c{i}"), F.count_if(applies & wrong).alias(f"b{i}")], lambda r: (r[f"c{i}"], r[f"b{i}"])
    return [F.count_if(row_test(df, rule)).alias(f"b{i}")], lambda r: (r["rows"], r[f"b{i}"])


def _holds(df: DataFrame, when: dict) -> Column:
    """Whether a condition applies: texts compare as texts, booleans and numbers by value; null and other types never do."""
    c, kind, value = quoted(when["column"]), kind_of(df, when["column"]), str(when["value"])
    compare = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b}[when["operator"]]
    if kind == "string":
        test = compare(c, F.lit(value))
    elif kind == "boolean" and value in ("true", "false"):
        test = compare(c, F.lit(value == "true"))
    elif is_number(kind):
        try:
            test = compare(c.cast("double"), F.lit(float(value)))
        except ValueError:
            test = F.lit(False)
    else:
        test = F.lit(False)
    return F.coalesce(test, F.lit(False))


#: Names of types in contracts.
TYPES = {
    "string": ("string", "text"), "bigint": ("integer", "int", "int64"), "double": ("float", "decimal", "float64"), "boolean": ("boolean", "bool"), "date": ("date",), "timestamp": ("datetime", "timestamp"),
}


def _types(dtype: str) -> tuple[str, ...]:
    found = next((k for k, names in TYPES.items() if dtype.strip().lower() in names), None)
    if found is None:
        raise ContractError(f"no type {dtype!r}")
    return {"bigint": ("tinyint", "smallint", "int", "bigint"), "double": ("float", "double"), "timestamp": ("timestamp", "timestamp_ntz")}.get(found, (found,))


def monotonic_breaks(df: DataFrame, column: str, increasing: bool = True, order: list[str] | str | None = None, parts: int | None = None) -> DataFrame:
    """One row, n: non-null values smaller (larger) than the one before them in input order; equal ones are in order, texts compare as texts, and a NaN is a break on both its sides.

    Input order over all rows in one window would be one task. The rows are dealt by ranges of _rid, each range compares within itself, and only
    the first and last value of each range are compared with the range before: as many rows as ranges."""
    df = with_rid(df, order)
    rows = df.filter(quoted(column).isNotNull()).select(RID, quoted(column).alias("v"))
    real = kind_of(df, column) in ("float", "double")
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, RID).withColumn("_part", F.spark_partition_id())
    w = Window.partitionBy("_part").orderBy(RID)
    wrong = lambda a, b: (b < a) if increasing else (b > a)
    broken = lambda a, b: (wrong(a, b) | ((F.isnan(a) | F.isnan(b)) & a.isNotNull())) if real else wrong(a, b)
    inside = dealt.select("_part", RID, "v", F.lag("v").over(w).alias("before"))
    each = inside.groupBy("_part").agg(
        F.count_if(F.coalesce(broken(F.col("before"), F.col("v")), F.lit(False))).alias("n"), F.min(RID).alias("at"), F.min_by("v", RID).alias("first"), F.max_by("v", RID).alias("last")
    )
    across = each.withColumn("before", F.lag("last").over(Window.orderBy("at")))
    return across.agg(F.coalesce(F.sum(F.col("n") + F.coalesce(broken(F.col("before"), F.col("first")), F.lit(False)).cast("long")), F.lit(0)).alias("n"))


def unreferenced(df: DataFrame, columns: list[str], reference: DataFrame, reference_columns: list[str]) -> DataFrame:
    """The rows with a null in columns or without a match in the reference table."""
    known = reference.select(*[quoted(c).alias(f"_r{i}") for i, c in enumerate(reference_columns)]).distinct()
    cond = F.lit(True)
    for i, c in enumerate(columns):
        cond = cond & (quoted(c) == F.col(f"_r{i}"))
    return df.join(known, cond, "left_anti")


def evaluate(df: DataFrame, contract: Contract | list[dict], order: list[str] | str | None = None) -> DataFrame:
    """One row per rule: rule (its place), kind, column_name, checked, invalid, percent, passed."""
    rules = [_spelled(r) for r in (contract.rules if isinstance(contract, Contract) else contract)]
    if len(rules) > MAX_RULES:
        raise ContractError(f"at most {MAX_RULES} rules")
    aggs, judges, found = [F.count(F.lit(1)).alias("rows")], {}, {}
    for i, rule in enumerate(rules):
        if rule["kind"] not in KINDS:
            raise ContractError(f"no rule {rule['kind']!r}")
        if rule["kind"] == "monotonic":
            found[i] = None, monotonic_breaks(df, rule["column"], rule.get("direction", "increasing") == "increasing", order).first()["n"]
        elif rule["kind"] == "referential_integrity" and isinstance(rule["reference"], DataFrame):
            names = rule.get("columns") or [rule["column"]]
            found[i] = None, unreferenced(df, names, rule["reference"], rule.get("referenceColumns") or names).count()
        else:
            more, judges[i] = _plan(df, i, rule)
            aggs += more
    row = df.agg(*aggs).first()
    out = []
    for i, rule in enumerate(rules):
        checked, invalid = judges[i](row) if i in judges else (row["rows"], found[i][1])
        percent = 100.0 * invalid / checked if checked else 0.0
        passed = invalid <= rule.get("maxInvalid", 0 if rule.get("maxInvalidPct") is None else float("inf")) and percent <= (rule.get("maxInvalidPct") if rule.get("maxInvalidPct") is not None else 100.0)
        out.append((i, rule["kind"], rule.get("column"), checked, invalid, percent, passed))
    return df.sparkSession.createDataFrame(out, "rule int, kind string, column_name string, checked long, invalid long, percent double, passed boolean")


def passes(df: DataFrame, contract: Contract | list[dict], order: list[str] | str | None = None) -> bool:
    return all(r["passed"] for r in evaluate(df, contract, order).collect())
