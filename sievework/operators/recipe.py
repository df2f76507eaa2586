"""Declarative transform recipes: a JSON document of steps, applied in one fixed order as a fold of DataFrame -> DataFrame.

Order: comma decimals, renames, casts, date parses, rows excluded by failed conversions, filters, find and replace, kept columns,
calculated column, split, merge, outliers, contacts, text extractions, group summary. Steps after the renames name columns by their original
names. All row-local steps are Column expressions, so that Catalyst fuses them into one projection over the scan; only checks
that must fail before any row is returned, percentiles and the group summary need a pass of their own."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parse as P
from ..functions import text as T
from ..functions.order import RID, against, data_columns, is_number, is_time, is_whole, kind_of, quoted, with_rid
from .outliers import treat_recipe

SUFFIXES = {"sum": "sum", "mean": "mean", "min": "min", "max": "max", "count": "count", "count_unique": "count_unique"}


class RecipeError(ValueError):
    pass


#: How saved recipes spell the parts of steps, and what they are called here.
SPELLINGS = {
    "dateParses": {"format": "order"},
    "filters": {"operator": "op"},
    "splitColumn": {"source": "column", "names": "targets"},
    "mergeColumns": {"sources": "columns", "name": "target"},
    "groupSummary": {"groupBy": "keys", "operation": "function"},
    "textExtractions": {"source": "column", "name": "target"},
}
KINDS = {"first_token": "first", "last_token": "last"}


def _spelled(step: str, value: Any) -> Any:
    """A step in the names used here, from either spelling."""
    if isinstance(value, list):
        return [_spelled(step, v) for v in value]
    if not isinstance(value, dict):
        return value
    if step == "findReplace" and "scope" in value:
        value = {k: v for k, v in value.items() if k != "scope"} | ({"column": None} if value["scope"] == "all_text_columns" else {})
    if step == "calculatedColumn" and "operation" in value:
        operand = value.get("operand")
        right = operand and {"column" if operand["kind"] == "column" else "literal": operand["value"]}
        return {"name": value["name"], "op": value["operation"], "left": {"column": value["source"]}, "right": right}
    if step == "casts" and "decimalSeparator" in value:
        value = {k: v for k, v in value.items() if k != "decimalSeparator"} | {"commaDecimal": value["decimalSeparator"] == "comma"}
    names = SPELLINGS.get(step, {})
    out = {names.get(k, k): _spelled(step, v) if k == "aggregations" else v for k, v in value.items()}
    if step == "textExtractions":
        out["kind"] = KINDS.get(out["kind"], out["kind"])
    return out


@dataclass
class Recipe:
    renames: list[dict] = field(default_factory=list)  # from, to
    casts: list[dict] = field(default_factory=list)  # column, target, policy, commaDecimal
    dateParses: list[dict] = field(default_factory=list)  # column, order, target (date | datetime), policy
    filters: list[dict] = field(default_factory=list)  # column, op, value
    calculatedColumn: dict | None = None  # name, op, left, right: {"column": ...} or {"literal": ...}
    findReplace: list[dict] = field(default_factory=list)  # column or None for all text columns, find, replace, regex
    keepColumns: list[str] = field(default_factory=list)
    splitColumn: dict | None = None  # column, delimiter, targets, dropSource
    mergeColumns: dict | None = None  # columns, target, separator, dropSources
    outlierTreatments: list[dict] = field(default_factory=list)  # column, action
    groupSummary: dict | None = None  # keys, aggregations: [{column, function}]
    contactNormalizations: list[dict] = field(default_factory=list)  # column, kind
    textExtractions: list[dict] = field(default_factory=list)  # column, target, kind, delimiter

    @classmethod
    def from_dict(cls, data: dict[str, Any]) -> Recipe:
        if unknown := set(data) - set(cls.__dataclass_fields__):
            raise RecipeError(f"unknown steps: {sorted(unknown)}")
        return cls(**{k: _spelled(k, v) for k, v in data.items() if v is not None})

    @classmethod
    def from_json(cls, text: str) -> Recipe:
        """A recipe document of version 1 or 2, or the steps alone."""
        data = json.loads(text)
        if "recipe" in data:
            if data.get("version") not in (1, 2):
                raise RecipeError(f"unknown version {data.get('version')!r}")
            data = data["recipe"]
        return cls.from_dict(data)

    def to_json(self, name: str = "", schema: dict[str, str] | None = None) -> str:
        return json.dumps({"version": 2 if schema else 1, "name": name, "recipe": {k: getattr(self, k) for k in self.__dataclass_fields__ if getattr(self, k)}} | ({"sourceSchema": schema} if schema else {}), ensure_ascii=False)

    def apply(self, df: DataFrame, order: list[str] | str | None = None) -> DataFrame:
        """The transformed rows, without the order column. The result has no order of its own; see apply_ordered."""
        return _Run(self, with_rid(df, order) if order else df).result().drop(RID)

    def apply_ordered(self, df: DataFrame, order: list[str] | str | None = None) -> DataFrame:
        """With _rid, which sorts the rows as the source's order has them. The place in the scan is taken after the filters, which then reach the scan; it sorts the rows that are left in the same way."""
        return _Run(self, with_rid(df, order) if order else df, late=True).result()

    def changes(self, df: DataFrame, order: list[str] | str | None = None) -> dict[str, int]:
        """Rows in and out, columns added and dropped, and changed cells of each column that keeps its name and type, in one pass over the row-local steps."""
        source = with_rid(df, order)
        run = _Run(self, source)
        renamed = {r["from"]: r["to"] for r in self.renames}
        local = Recipe(**{k: getattr(self, k) for k in self.__dataclass_fields__ if k not in ("groupSummary", "outlierTreatments", "filters", "keepColumns")})
        before = {n: f"_old{i}" for i, n in enumerate(data_columns(source))}
        marked = _Run(local, source.select(*[quoted(c) for c in source.columns], *[quoted(n).alias(o) for n, o in before.items()]), hidden=set(before.values())).result()
        aggs = []
        for n, o in before.items():
            new = renamed.get(n, n)
            if new in marked.columns and kind_of(marked, new) == kind_of(marked, o):
                aggs.append(F.count_if(~quoted(new).eqNullSafe(F.col(o))).alias(new))
        out = run.result()
        counted = marked.agg(*aggs).first().asDict() if aggs else {}
        return {"rows_in": source.count(), "rows_out": out.count(), "columns_in": len(before), "columns_out": len(data_columns(out)), "changed_cells": sum(counted.values()), **{f"changed:{k}": v for k, v in counted.items()}}


class _Run:
    """One application: df is the state so far, names maps original names to present ones."""

    def __init__(self, recipe: Recipe, df: DataFrame, hidden: set[str] = frozenset(), late: bool = False):
        self.recipe, self.df, self.hidden, self.late = recipe, df, hidden, late
        self.names = {c: c for c in data_columns(df)}

    def result(self) -> DataFrame:
        r = self.recipe
        if {c["column"] for c in r.casts} & {d["column"] for d in r.dateParses}:
            raise RecipeError("a column can't be both cast and parsed as a date")
        if r.splitColumn and r.splitColumn.get("dropSource") and r.mergeColumns and r.splitColumn["column"] in r.mergeColumns["columns"]:
            raise RecipeError("the merge needs the column that the split drops")
        for step in (self.rename, self.convert, self.filter, self.replace, self.keep, self.calculate, self.split, self.merge, self.outliers, self.contacts, self.extract, self.group):
            step()
        return self.df

    def name(self, original: str) -> str:
        name = self.names.get(original, original)
        if name not in self.df.columns:
            raise RecipeError(f"no column {original!r}")
        return name

    def kind(self, name: str) -> str:
        return kind_of(self.df, name)

    def text(self, name: str) -> Column:
        return T.render_text(quoted(name), self.kind(name))

    def rename(self) -> None:
        new = {r["from"]: r["to"] for r in self.recipe.renames}
        for old in new:
            self.name(old)
        out = [new.get(c, c) for c in self.df.columns]
        if len(set(out)) < len(out) or not all(out):
            raise RecipeError("renames give a name twice")
        if new:
            self.df = self.df.select([quoted(c).alias(n) for c, n in zip(self.df.columns, out, strict=True)])
        self.names |= new

    def convert(self) -> None:
        """Casts and date parses. Policies: review (an unreadable value is an error), nullify, excludeRow."""
        jobs = []
        for c in self.recipe.casts:
            name = self.name(c["column"])
            source = self.text(name)
            if c.get("commaDecimal"):
                source = P.comma_decimal(source)
            jobs.append((name, source, P.strict_cast(source, c["target"]), c.get("policy", "review")))
        for d in self.recipe.dateParses:
            name = self.name(d["column"])
            source = self.text(name)
            reader = P.strict_datetime if d.get("target") == "datetime" else P.strict_date
            jobs.append((name, source, reader(source, d.get("order", "iso8601")), d.get("policy", "review")))
        if not jobs:
            return
        # an empty text is no value of another type: an error like any other text that is none
        failed = [read.isNull() & source.isNotNull() for _, source, read, _ in jobs]
        strict = [i for i, j in enumerate(jobs) if j[3] == "review"]
        if strict:
            aggs = [x for i in strict for x in (F.count_if(failed[i]).alias(f"n{i}"), F.min(F.when(failed[i], jobs[i][1])).alias(f"v{i}"))]
            row = self.df.agg(*aggs).first()
            for i in strict:
                if row[f"n{i}"]:
                    raise RecipeError(f"column {jobs[i][0]!r}: {row[f'n{i}']} values can't be converted, such as {row[f'v{i}']!r}")
        keep = F.lit(True)
        for f, job in zip(failed, jobs, strict=True):
            if job[3] == "excludeRow":
                keep = keep & ~f
        self.df = self.df.filter(keep).withColumns({name: read for name, _, read, _ in jobs})

    def filter(self) -> None:
        if len(self.recipe.filters) > 3:
            raise RecipeError("at most three filters")
        tests, checks = [], []
        for f in self.recipe.filters:
            name = self.name(f["column"])
            test, check = predicate(quoted(name), self.kind(name), f["op"], f.get("value"))
            tests.append(test)
            if check is not None:
                checks.append((name, check))
        if checks:
            row = self.df.agg(*[F.count_if(c).alias(f"n{i}") for i, (_, c) in enumerate(checks)]).first()
            for i, (name, _) in enumerate(checks):
                if row[f"n{i}"]:
                    raise RecipeError(f"column {name!r} holds {row[f'n{i}']} values that aren't numbers")
        for t in tests:
            self.df = self.df.filter(t)
        if self.late:
            self.df = with_rid(self.df)

    def replace(self) -> None:
        steps = self.recipe.findReplace
        for s in [steps] if isinstance(steps, dict) else steps:
            names = [self.name(s["column"])] if s.get("column") else [c for c in data_columns(self.df) if self.kind(c) == "string" and c not in self.hidden]
            if not s["find"]:
                raise RecipeError("nothing to find")
            if s.get("regex"):
                pattern = T.java_regex(s["find"])
                change = lambda c: F.regexp_replace(c, pattern, T.java_replacement(s.get("replace", ""), s["find"]))  # noqa: E731, B023
            else:
                change = lambda c: F.replace(c, F.lit(s["find"]), F.lit(s.get("replace", "")))  # noqa: E731, B023
            self.df = self.df.withColumns({c: change(quoted(c)) for c in names})

    def keep(self) -> None:
        names = [self.name(c) for c in self.recipe.keepColumns]
        if len(set(names)) < len(names):
            raise RecipeError("a column is kept twice")
        if names:
            self.df = self.df.select(*[quoted(c) for c in names], *[quoted(c) for c in self.df.columns if c == RID or c in self.hidden])

    def _operand(self, o: dict) -> tuple[Column, str]:
        if "column" in o:
            name = self.name(o["column"])
            return quoted(name), self.kind(name)
        return F.lit(str(o["literal"])), "string"

    def calculate(self) -> None:
        s = self.recipe.calculatedColumn
        if not s:
            return
        if s["name"] in self.df.columns:
            raise RecipeError(f"there is a column {s['name']!r}")
        left, kind = self._operand(s["left"])
        op = s["op"]
        if op in ("year", "month", "day"):
            if not is_time(kind):
                raise RecipeError("parts of dates need a date column")
            value = {"year": F.year, "month": F.month, "day": F.dayofmonth}[op](left).cast("int")
        else:
            right, right_kind = self._operand(s["right"])
            if op == "concat":
                value = F.concat(T.render_text(left, kind), T.render_text(right, right_kind))
            else:
                a, b = number(left, kind), number(right, right_kind)
                if op == "divide":
                    b = F.when(b == 0, F.raise_error(F.lit("division by zero")).cast("double")).otherwise(b)
                value = {"add": lambda: a + b, "subtract": lambda: a - b, "multiply": lambda: a * b, "divide": lambda: a / b}[op]()
                value = F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.raise_error(F.lit("the result isn't finite")).cast("double")).otherwise(value)
        self.df = self.df.withColumn(s["name"], value)

    def split(self) -> None:
        s = self.recipe.splitColumn
        if not s:
            return
        name, targets = self.name(s["column"]), s["targets"]
        if not 2 <= len(targets) <= 16 or not s["delimiter"] or len(set(targets)) < len(targets) or set(targets) & set(self.df.columns):
            raise RecipeError("a split needs a delimiter and 2 to 16 new names")
        source = self.text(name)
        self.df = self.df.withColumns({t: T.split_part(source, s["delimiter"], len(targets), i) for i, t in enumerate(targets)})
        if s.get("dropSource"):
            self.df = self.df.drop(quoted(name))

    def merge(self) -> None:
        s = self.recipe.mergeColumns
        if not s:
            return
        names = [self.name(c) for c in s["columns"]]
        if not 2 <= len(names) <= 16 or s["target"] in set(self.df.columns) - (set(names) if s.get("dropSources") else set()):
            raise RecipeError("a merge needs 2 to 16 columns and a new name")
        value = T.merge_parts([self.text(c) for c in names], s.get("separator", ""))
        kept = [c for c in self.df.columns if not (s.get("dropSources") and c in names)]
        self.df = self.df.select(*[quoted(c) for c in kept], value.alias(s["target"]))

    def outliers(self) -> None:
        if self.recipe.outlierTreatments:
            self.df = treat_recipe(self.df, [(self.name(t["column"]), t["action"]) for t in self.recipe.outlierTreatments])

    def contacts(self) -> None:
        out = {}
        for t in self.recipe.contactNormalizations:
            name = self.name(t["column"])
            if self.kind(name) != "string" or name in out:
                raise RecipeError("contacts are text columns, each once")
            out[name] = {"email": T.email, "phone": T.phone, "address": T.address}[t["kind"]](quoted(name))
        if out:
            self.df = self.df.withColumns(out)

    def extract(self) -> None:
        out = {}
        for t in self.recipe.textExtractions:
            source = self.text(self.name(t["column"]))
            kinds = {"first": T.first_token, "last": T.last_token, "digits": T.digits, "letters": T.letters}
            if t["target"] in self.df.columns or t["target"] in out:
                raise RecipeError(f"there is a column {t['target']!r}")
            out[t["target"]] = kinds[t["kind"]](source) if t["kind"] in kinds else {"before": T.before, "after": T.after}[t["kind"]](source, t["delimiter"])
        if out:
            self.df = self.df.withColumns(out)

    def group(self) -> None:
        s = self.recipe.groupSummary
        if s:
            self.df = group_summary(self.df, [self.name(k) for k in s["keys"]], [(self.name(a["column"]), a["function"]) for a in s["aggregations"]])


def number(c: Column, kind: str) -> Column:
    """A double, or an error for text that isn't a number and for whole numbers that a double can't hold."""
    if kind == "string":
        read = P.exact_number(c)
        return F.when(c.isNotNull() & read.isNull(), F.raise_error(F.concat(F.lit("not a number: "), c)).cast("double")).otherwise(read)
    if is_whole(kind) or kind.startswith("decimal"):
        return F.when(F.abs(c.cast("decimal(38,0)")) > P.EXACT, F.raise_error(F.lit("a whole number beyond 2**53")).cast("double")).otherwise(c.cast("double"))
    if is_number(kind):
        return c.cast("double")
    raise RecipeError(f"no arithmetic with {kind}")


def predicate(c: Column, kind: str, op: str, value: Any) -> tuple[Column, Column | None]:
    """The test, which is never true for null but with is_null, and what must not occur in any row."""
    if op == "is_null":
        return c.isNull(), None
    if op == "not_null":
        return c.isNotNull(), None
    text = T.render_text(c, kind)
    if op in ("contains", "not_contains"):
        has = F.contains(F.lower(text), F.lower(F.lit(str(value))))
        return F.coalesce(has if op == "contains" else ~has, F.lit(False)), None
    compare = {"eq": lambda a, b: a == b, "neq": lambda a, b: a != b, "gt": lambda a, b: a > b, "lt": lambda a, b: a < b, "gte": lambda a, b: a >= b, "lte": lambda a, b: a <= b}[op]
    if is_time(kind):
        literal = P.strict_datetime(F.lit(str(value)), "iso8601")
        return compare(c.cast("timestamp_ntz"), literal), None
    if op in ("eq", "neq"):
        return compare(text, F.lit(str(value))), None
    bound = float(str(value).strip())
    if kind == "string":
        read = P.strict_double(c)
        return compare(read, F.lit(bound)), c.isNotNull() & read.isNull()
    return against(c, kind, op, bound), None


def group_summary(df: DataFrame, keys: list[str], aggregations: list[tuple[str, str]]) -> DataFrame:
    """Groups in the order of their first row; null is a group; keys that aren't finite are an error; names are <column>_<function>. One partial and one final aggregation."""
    if not 1 <= len(keys) <= 8 or not 1 <= len(aggregations) <= 32:
        raise RecipeError("1 to 8 keys and 1 to 32 aggregations")
    grouped = []
    for k in keys:
        c = quoted(k)
        if kind_of(df, k) in ("double", "float"):
            c = F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.raise_error(F.lit(f"a key of {k} isn't finite")).cast("double")).otherwise(c + 0.0)
        grouped.append(c.alias(k))
    aggs = []
    for name, how in aggregations:
        c, kind = quoted(name), kind_of(df, name)
        if how in ("sum", "mean") and not is_number(kind):
            raise RecipeError(f"no {how} of {kind}")
        if how in ("sum", "mean") and kind in ("double", "float"):
            c = F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.raise_error(F.lit(f"a value of {name} isn't finite")).cast("double")).otherwise(c)
        if how == "mean" and is_whole(kind):
            c = F.when(F.abs(c.cast("decimal(20,0)")) > P.EXACT, F.raise_error(F.lit("a whole number beyond 2**53")).cast("bigint")).otherwise(c)
        made = {
            "sum": lambda: F.coalesce(F.sum(c), F.lit(0).cast("bigint" if is_whole(kind) else "double")),  # noqa: B023
            "mean": lambda: F.avg(c), "min": lambda: F.min(c), "max": lambda: F.max(c), "count": lambda: F.count(F.lit(1)), "count_unique": lambda: F.count_distinct(c),  # noqa: B023
        }[how]()
        aggs.append(made.alias(f"{name}_{SUFFIXES[how]}"))
    return df.groupBy(*grouped).agg(*aggs, *([F.min(RID).alias(RID)] if RID in df.columns else []))
