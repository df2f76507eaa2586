"""The small SELECT dialect: SELECT items FROM dataset [JOIN compared ON a = b [AND ...]] [WHERE p [AND ...]] [GROUP BY c, ...] [LIMIT n] [OFFSET n].

Text is parsed into a Query and that into DataFrame calls; no user text ever reaches spark.sql."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parse as P
from ..functions import text as T
from ..functions.order import RID, against, data_columns, is_number, kind_of, quoted, with_rid
from ..operators.joins import key_join

DEFAULT_LIMIT, MAX_LIMIT, MAX_KEYS = 50, 200, 8
FUNCTIONS = {"count": "count", "sum": "sum", "avg": "avg", "average": "avg", "min": "min", "max": "max"}


class QueryError(ValueError):
    pass


@dataclass
class Item:
    function: str | None
    column: str | None  # None: all columns, or all rows for count
    alias: str | None = None

    def name(self) -> str:
        return self.alias or (self.column if not self.function else f"{self.function}_{self.column}" if self.column else "count")


@dataclass
class Query:
    items: list[Item]
    join: list[tuple[str, str]] = field(default_factory=list)
    how: str = "inner"
    predicates: list[tuple[str, str, str | None]] = field(default_factory=list)
    group_by: list[str] = field(default_factory=list)
    limit: int = DEFAULT_LIMIT
    offset: int = 0


TOKEN = re.compile(r"""\s*(?:("(?:[^"]|"")+")|('(?:[^']|'')*')|([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(<=|>=|<>|!=|[=<>(),.*])|([^\W\d][\w]*))""")


class _Parser:
    def __init__(self, text: str):
        self.tokens, at, text = [], 0, text.strip().removesuffix(";").rstrip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise QueryError(f"unexpected text at {text[at : at + 20]!r}")
            kind = ("quoted", "string", "number", "sign", "word")[m.lastindex - 1]
            self.tokens.append((kind, m[m.lastindex]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self) -> tuple[str, str]:
        token = self.peek()
        self.at += 1
        return token

    def word(self, *words: str) -> bool:
        """Takes the words if they come next."""
        for i, w in enumerate(words):
            if self.at + i >= len(self.tokens) or self.tokens[self.at + i][0] != "word" or self.tokens[self.at + i][1].lower() != w:
                return False
        self.at += len(words)
        return True

    def sign(self, s: str) -> bool:
        if self.peek() == ("sign", s):
            self.at += 1
            return True
        return False

    def need(self, ok: bool, what: str) -> None:
        if not ok:
            raise QueryError(f"expected {what}, found {self.peek()[1] or 'the end'!r}")

    def name(self) -> str:
        kind, value = self.take()
        if kind == "quoted":
            return value[1:-1].replace('""', '"')
        self.at -= 1
        self.need(kind == "word", "a name")
        self.at += 1
        return value

    def qualified(self) -> tuple[str | None, str]:
        first = self.name()
        return (first, self.name()) if self.sign(".") else (None, first)

    def item(self) -> Item:
        if self.sign("*"):
            return Item(None, None)
        kind, value = self.peek()
        if kind == "word" and value.lower() in FUNCTIONS and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1] == ("sign", "("):
            self.at += 2
            function = FUNCTIONS[value.lower()]
            column = None if self.sign("*") else self.qualified()[1]
            self.need(function == "count" or column is not None, "a column")
            self.need(self.sign(")"), ")")
            out = Item(function, column)
        else:
            out = Item(None, self.qualified()[1])
        if self.word("as"):
            out.alias = self.name()
        return out

    def count(self) -> int:
        kind, value = self.take()
        if kind != "number" or not value.isdecimal():
            raise QueryError("expected a whole number")
        return int(value)

    def query(self) -> Query:
        self.need(self.word("select"), "SELECT")
        items = [self.item()]
        while self.sign(","):
            items.append(self.item())
        self.need(self.word("from", "dataset"), "FROM dataset")
        q = Query(items)
        how = "left" if self.word("left", "outer", "join") or self.word("left", "join") else "full" if self.word("full", "outer", "join") or self.word("full", "join") else "inner" if self.word("inner", "join") or self.word("join") else None
        if how:
            q.how = how
            self.need(self.word("compared", "on"), "compared ON")
            while True:
                a = self.qualified()
                self.need(self.sign("="), "=")
                b = self.qualified()
                if (a[0] or "").lower() == "compared" or (b[0] or "").lower() == "dataset":
                    a, b = b, a
                q.join.append((a[1], b[1]))
                if not self.word("and"):
                    break
            self.need(len(q.join) <= MAX_KEYS, f"at most {MAX_KEYS} pairs of keys")
        if self.word("where"):
            while True:
                column = self.qualified()[1]
                if self.word("is", "not", "null"):
                    q.predicates.append((column, "not_null", None))
                elif self.word("is", "null"):
                    q.predicates.append((column, "is_null", None))
                else:
                    kind, op = self.take()
                    if kind != "sign" or op not in ("=", "!=", "<>", ">", ">=", "<", "<="):
                        raise QueryError("expected a comparison")
                    kind, value = self.take()
                    if kind not in ("string", "number", "word"):
                        raise QueryError("expected a value")
                    q.predicates.append((column, "<>" if op == "!=" else op, value[1:-1].replace("''", "'") if kind == "string" else value))
                if not self.word("and"):
                    break
        if self.word("group", "by"):
            q.group_by.append(self.qualified()[1])
            while self.sign(","):
                q.group_by.append(self.qualified()[1])
            self.need(len(q.group_by) <= MAX_KEYS, f"at most {MAX_KEYS} columns")
        if self.word("limit"):
            q.limit = self.count()
        if self.word("offset"):
            q.offset = self.count()
        self.need(self.peek()[0] == "end", "the end")
        if not 1 <= q.limit <= MAX_LIMIT:
            raise QueryError(f"LIMIT is 1 to {MAX_LIMIT}")
        aggregates = [i for i in items if i.function]
        if q.group_by and not aggregates:
            raise QueryError("GROUP BY needs an aggregate")
        if aggregates and any(not i.function and i.column not in q.group_by for i in items):
            raise QueryError("columns beside aggregates must be grouped")
        return q


def parse(text: str) -> Query:
    return _Parser(text).query()


def _compared(df: DataFrame, name: str, op: str, value: str | None) -> Column:
    """As numbers if both sides are, else as text. An unequal comparison is true for whatever isn't equal, but never for null."""
    c, kind = quoted(name), kind_of(df, name)
    if op in ("is_null", "not_null"):
        return c.isNull() if op == "is_null" else c.isNotNull()
    test = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}[op]
    try:
        number = float(value) if re.fullmatch(P.DOUBLE[1:-1], value.strip()) else None
    except ValueError:
        number = None
    as_text = test(T.render_text(c, kind), F.lit(value))
    if number is None:
        return F.coalesce(as_text, F.lit(False))
    if is_number(kind):  # the plain comparison reaches the scan
        return against(c, kind, {"=": "eq", "<>": "neq", ">": "gt", ">=": "gte", "<": "lt", "<=": "lte"}[op], number)
    n = P.strict_double(c)
    return F.coalesce(F.when(n.isNotNull(), test(n, F.lit(number))).otherwise(as_text), F.lit(False))


def _aggregate(df: DataFrame, item: Item) -> Column:
    if item.column is None:
        return F.count(F.lit(1))
    c, kind = quoted(item.column), kind_of(df, item.column)
    if item.function == "count":
        return F.count(c)
    if is_number(kind):
        return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[item.function](c)
    n = P.strict_double(c) if kind == "string" else F.lit(None).cast("double")
    if item.function in ("sum", "avg"):
        n = F.when(c.isNotNull() & n.isNull(), F.raise_error(F.lit(f"{item.column} holds values that aren't numbers")).cast("double")).otherwise(n)
        return {"sum": F.sum, "avg": F.avg}[item.function](n)
    if kind != "string":
        return {"min": F.min, "max": F.max}[item.function](c)
    best = F.min_by(c, n) if item.function == "min" else F.max_by(c, n)
    plain = F.min(c) if item.function == "min" else F.max(c)
    return F.when(F.count_if(c.isNotNull() & n.isNull()) == 0, best).otherwise(plain)


def unlimited(query: Query, dataset: DataFrame, compared: DataFrame | None = None, order: list[str] | str | None = None) -> DataFrame:
    """All rows of the query, with _rid in the order of the input (of first appearance for groups)."""
    df = dataset if order is None and not query.join else with_rid(dataset, order)
    if query.join:
        if compared is None:
            raise QueryError("there is no compared dataset")
        df = key_join(df, with_rid(compared, None), query.join, query.how)
    known = set(data_columns(df))
    used = [i.column for i in query.items if i.column] + [p[0] for p in query.predicates] + query.group_by
    if missing := [c for c in used if c not in known]:
        raise QueryError(f"no column {missing[0]!r}")
    for p in query.predicates:
        df = df.filter(_compared(df, *p))
    df = with_rid(df)  # after the filters, which then reach the scan
    if any(i.function for i in query.items):
        aggs = [_aggregate(df, i).alias(i.name()) for i in query.items if i.function]
        if not query.group_by:
            return df.agg(*aggs).withColumn(RID, F.lit(0)).select(*[quoted(i.name()) for i in query.items], RID)
        out = df.groupBy(*[quoted(c) for c in query.group_by]).agg(*aggs, F.min(RID).alias(RID))
        return out.select(*[quoted(i.name()) if i.function else quoted(i.column).alias(i.name()) for i in query.items], RID)
    columns = []
    for i in query.items:
        columns += [quoted(c) for c in data_columns(df)] if i.column is None else [quoted(i.column).alias(i.name())]
    return df.select(*columns, RID)


def run(text: str, dataset: DataFrame, compared: DataFrame | None = None, order: list[str] | str | None = None) -> DataFrame:
    """The page that the query asks for: a top-k by input order."""
    q = parse(text)
    return unlimited(q, dataset, compared, order).orderBy(RID).offset(q.offset).limit(q.limit).drop(RID)


def count(text: str, dataset: DataFrame, compared: DataFrame | None = None) -> int:
    """Rows without limit and offset."""
    return unlimited(parse(text), dataset, compared).count()
