"""Joins, comparison, consolidation and conflicts between a current and a compared dataset."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.order import RID, data_columns, is_number, kind_of, quoted, with_rid

MAX_KEYS = 16


def _renamed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[quoted(c).alias(f"{prefix}{i}") for i, c in enumerate(df.columns)])


def key_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], how: str = "inner", order: str | None = None, right_order: str | None = None) -> DataFrame:
    """inner, left or full join on equal keys (null keys never match) of the same type. Key columns appear once, filled from either side; right columns whose
    name the left has get _right. With order columns the result has _rid: left place, right place, rows of the right alone last."""
    if not 1 <= len(on) <= MAX_KEYS or how not in ("inner", "left", "full"):
        raise ValueError("1 to 16 keys; inner, left or full")
    for a, b in on:
        if kind_of(left, a) != kind_of(right, b):
            raise ValueError(f"keys {a!r} and {b!r} have different types")
    ordered = order is not None or RID in left.columns
    if ordered:
        left, right = with_rid(left, order), with_rid(right, right_order or order)
    ln, rn = left.columns, right.columns
    l, r = _renamed(left, "l"), _renamed(right, "r")  # noqa: E741
    pairs = [(f"l{ln.index(a)}", f"r{rn.index(b)}") for a, b in on]
    cond = F.lit(True)
    for a, b in pairs:
        cond = cond & (F.col(a) == F.col(b))
    joined = l.join(r, cond, how)
    keys = dict(pairs)
    out, taken = [], {c for c in ln if c != RID}
    for i, c in enumerate(ln):
        if c != RID:
            out.append((F.coalesce(f"l{i}", keys[f"l{i}"]) if f"l{i}" in keys else F.col(f"l{i}")).alias(c))
    for i, c in enumerate(rn):
        if c == RID or f"r{i}" in keys.values():
            continue
        name = c
        while name in taken:
            name += "_right"
        taken.add(name)
        out.append(F.col(f"r{i}").alias(name))
    if ordered:
        a, b = f"l{ln.index(RID)}", f"r{rn.index(RID)}"
        out.append(F.struct(F.col(a).isNull().alias("alone"), F.col(a).alias("left"), F.col(b).alias("right")).alias(RID))
    return joined.select(*out)


def join_bound(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], how: str = "inner") -> int:
    """How many rows the join can have: the sum over keys of the product of their counts, plus all rows of outer sides."""
    a = left.groupBy(*[quoted(x).alias(f"k{i}") for i, (x, _) in enumerate(on)]).agg(F.count("*").alias("a"))
    b = right.groupBy(*[quoted(y).alias(f"k{i}") for i, (_, y) in enumerate(on)]).agg(F.count("*").alias("b"))
    n = a.join(b, [f"k{i}" for i in range(len(on))]).agg(F.coalesce(F.sum(F.col("a").cast("decimal(38,0)") * F.col("b")), F.lit(0)).alias("n")).first()["n"]
    return int(n) + (left.count() if how in ("left", "full") else 0) + (right.count() if how == "full" else 0)


@dataclass(frozen=True)
class CompareOptions:
    significant_digits: bool = False  # numbers equal to 12 significant digits
    ignore_case: bool = False
    trim: bool = False

    def value(self, c: Column, kind: str) -> Column:
        from ..functions import text as T

        if kind == "string":
            c = T.trim(c) if self.trim else c
            return F.lower(c) if self.ignore_case else c
        if kind in ("double", "float"):
            c = c + F.lit(0.0)
            return F.format_string("%.11e", c) if self.significant_digits else c
        return c


def shared_columns(current: DataFrame, compared: DataFrame) -> list[str]:
    return [c for c in data_columns(current) if c in compared.columns]


def schema_diff(current: DataFrame, compared: DataFrame) -> dict:
    """Which columns both have, which only one; whether the shared ones have the same types, and the same order."""
    a, b = data_columns(current), data_columns(compared)
    both = [c for c in a if c in b]
    return {
        "shared": both, "current_only": [c for c in a if c not in b], "compared_only": [c for c in b if c not in a],
        "same_types": all(kind_of(current, c) == kind_of(compared, c) for c in both), "same_order": both == [c for c in b if c in a],
    }


def compare_rows(current: DataFrame, compared: DataFrame, options: CompareOptions = CompareOptions()) -> DataFrame:
    """Multisets of rows over the shared columns: one row with common, current_only, compared_only. Both sides are aggregated in one grouping, no join."""
    names = shared_columns(current, compared)

    def side(df: DataFrame, which: int) -> DataFrame:
        return df.select(*[options.value(quoted(c), kind_of(df, c)).alias(f"c{i}") for i, c in enumerate(names)], F.lit(which).alias("which"))

    counts = side(current, 0).unionByName(side(compared, 1)).groupBy(*[f"c{i}" for i in range(len(names))]).agg(F.count_if(F.col("which") == 0).alias("a"), F.count_if(F.col("which") == 1).alias("b"))
    both = F.least("a", "b")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return counts.agg(zero(both).alias("common"), zero(F.col("a") - both).alias("current_only"), zero(F.col("b") - both).alias("compared_only"))


def _keyed(current: DataFrame, compared: DataFrame, keys: list[str], options: CompareOptions) -> tuple[DataFrame, list[str]]:
    """One row per key (nulls are equal): na, nb, and the first payloads a, b of either side. One grouping of both sides."""
    names = [c for c in shared_columns(current, compared) if c not in keys]

    def side(df: DataFrame, which: int) -> DataFrame:
        payload = F.struct(*[F.struct(options.value(quoted(c), kind_of(df, c)).alias("v"), quoted(c).cast("string").alias("t")).alias(f"p{i}") for i, c in enumerate(names)])
        return df.select(*[options.value(quoted(c), kind_of(df, c)).alias(f"k{i}") for i, c in enumerate(keys)], F.lit(which).alias("which"), payload.alias("p"))

    both = side(current, 0).unionByName(side(compared, 1))
    first = lambda k: F.first(F.when(F.col("which") == k, F.col("p")), ignorenulls=True)
    grouped = both.groupBy(*[f"k{i}" for i in range(len(keys))]).agg(F.count_if(F.col("which") == 0).alias("na"), F.count_if(F.col("which") == 1).alias("nb"), first(0).alias("a"), first(1).alias("b"))
    return grouped, names


def _differs(names: list[str]) -> Column:
    out = F.lit(False)
    for i in range(len(names)):
        out = out | ~F.col(f"a.p{i}.v").eqNullSafe(F.col(f"b.p{i}.v"))
    return out


def compare_keys(current: DataFrame, compared: DataFrame, keys: list[str], options: CompareOptions = CompareOptions()) -> DataFrame:
    """One row: keys that both sides have (matched; repeated and conflicting ones too) or one of them; keys that either side repeats, whose rows aren't compared, and these rows; and the keys with one row on either
    side whose rows differ (conflicting)."""
    grouped, names = _keyed(current, compared, keys, options)
    repeated, both = (F.col("na") > 1) | (F.col("nb") > 1), (F.col("na") > 0) & (F.col("nb") > 0)
    return grouped.agg(
        F.count_if(both).alias("matched"), F.count_if(both & ~repeated & _differs(names)).alias("conflicting"),
        F.count_if(F.col("nb") == 0).alias("current_only"), F.count_if(F.col("na") == 0).alias("compared_only"),
        F.count_if(repeated).alias("duplicate_keys"), F.coalesce(F.sum(F.when(repeated, F.col("na") + F.col("nb"))), F.lit(0)).alias("duplicate_rows"),
    )


def conflicts(current: DataFrame, compared: DataFrame, keys: list[str], options: CompareOptions = CompareOptions()) -> DataFrame:
    """One row per key and differing column: the keys, column_name, current_value, compared_value as text. Page it by ordering on the keys."""
    grouped, names = _keyed(current, compared, keys, options)
    single = grouped.filter((F.col("na") == 1) & (F.col("nb") == 1))
    cells = F.array(*[
        F.when(~F.col(f"a.p{i}.v").eqNullSafe(F.col(f"b.p{i}.v")), F.struct(F.lit(c).alias("column_name"), F.col(f"a.p{i}.t").alias("current_value"), F.col(f"b.p{i}.t").alias("compared_value")))
        for i, c in enumerate(names)
    ])
    out = single.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], F.explode(F.filter(cells, lambda x: x.isNotNull())).alias("x"))
    return out.select(*[quoted(k) for k in keys], "x.*")


def conflict_page(current: DataFrame, compared: DataFrame, keys: list[str], offset: int = 0, limit: int = 50, options: CompareOptions = CompareOptions()) -> DataFrame:
    """conflicts() of one page of conflicting keys, in the order of the keys (nulls first): those from offset on, limit keys at most."""
    if offset < 0 or not 1 <= limit <= 200:
        raise ValueError("a page begins at 0 or later and has 1 to 200 keys")
    found = conflicts(current, compared, keys, options)
    order = [F.asc_nulls_first("`" + k.replace("`", "``") + "`") for k in keys]
    chosen = found.select(*[quoted(k) for k in keys]).distinct().orderBy(*order).offset(offset).limit(limit)
    chosen = chosen.select(*[quoted(k).alias(f"_p{i}") for i, k in enumerate(keys)])
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & quoted(k).eqNullSafe(F.col(f"_p{i}"))
    return found.join(F.broadcast(chosen), cond, "left_semi").orderBy(*order)


def _check_decisions(decisions: DataFrame, found: DataFrame, keys: list[str]) -> None:
    """Each decision belongs to a conflict, is there once and has a known choice; a conflict is decided as a whole, or in each of its columns; exclude is for the whole."""
    k = [f"k{i}" for i in range(len(keys))]
    own = decisions.select(*[quoted(c).alias(a) for a, c in zip(k, keys, strict=True)], F.col("column_name").alias("c"), "choice")
    by = own.groupBy(*k).agg(
        F.count("*").alias("n"), F.count("c").alias("named"), F.collect_set("c").alias("columns"), F.count_if(F.col("choice") == "exclude").alias("out"),
        F.count_if(~F.coalesce(F.col("choice").isin("current", "compared", "exclude"), F.lit(False))).alias("unknown"),
    )
    cells = found.select(*[quoted(c).alias("f" + a) for a, c in zip(k, keys, strict=True)], F.col("column_name").alias("cell")).groupBy(*["f" + a for a in k]).agg(F.collect_set("cell").alias("cells"))
    cond = F.lit(True)
    for a in k:
        cond = cond & F.col(a).eqNullSafe(F.col("f" + a))
    row = by.join(cells, cond, "left").agg(
        F.sum("unknown").alias("unknown choices"), F.count_if(F.col("cells").isNull()).alias("keys without a conflict"),
        F.count_if(F.size(F.array_except("columns", "cells")) > 0).alias("columns without a conflict"),
        F.count_if((F.col("named") > 0) & ((F.col("named") != F.col("n")) | (F.size(F.array_except("cells", "columns")) > 0))).alias("keys of which some columns lack a decision"),
        F.count_if((F.col("named") != F.size("columns")) | (F.col("n") - F.col("named") > 1)).alias("keys decided twice"),
        F.count_if((F.col("out") > 0) & (F.col("n") > 1)).alias("keys excluded and decided otherwise"),
    ).first()
    wrong = [f"{n} {what}" for what, n in row.asDict().items() if n]
    if wrong:
        raise ValueError("the decisions don't fit the conflicts: " + ", ".join(wrong))


def resolve_conflicts(current: DataFrame, compared: DataFrame, keys: list[str], decisions: DataFrame, options: CompareOptions = CompareOptions()) -> DataFrame:
    """current with the cells that decisions take from compared and without the rows that they exclude; conflicts without a decision stay as they are. decisions: the keys, column_name (null: the whole row), choice
    (current, compared or exclude). They are checked first; keys that either side repeats are no conflicts, so no row is multiplied."""
    _check_decisions(decisions, conflicts(current, compared, keys, options), keys)
    names = [c for c in shared_columns(current, compared) if c not in keys]
    chosen = decisions.filter("choice <> 'current'").groupBy(*[quoted(k) for k in keys]).agg(F.collect_set(F.coalesce("column_name", F.lit("*"))).alias("_take"), (F.max("choice") == "exclude").alias("_out"))
    chosen = chosen.select(*[quoted(k).alias(f"_d{i}") for i, k in enumerate(keys)], "_take", "_out")
    other = compared.select(*[quoted(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[quoted(c).alias(f"_c{i}") for i, c in enumerate(names)])

    def on(df_keys: list[Column], prefix: str) -> Column:
        cond = F.lit(True)
        for i, k in enumerate(df_keys):
            cond = cond & k.eqNullSafe(F.col(f"{prefix}{i}"))
        return cond

    values = other.join(chosen, on([F.col(f"_k{i}") for i in range(len(keys))], "_d")).drop(*[f"_d{i}" for i in range(len(keys))])
    joined = current.join(values, on([quoted(k) for k in keys], "_k"), "left").filter(~F.coalesce("_out", F.lit(False)))
    taken = lambda c: F.coalesce(F.array_contains("_take", "*") | F.array_contains("_take", c), F.lit(False))
    return joined.select(*[F.when(taken(c), F.col(f"_c{names.index(c)}")).otherwise(quoted(c)).alias(c) if c in names else quoted(c) for c in current.columns])


def consolidate(current: DataFrame, compared: DataFrame, keys: list[str], options: CompareOptions = CompareOptions()) -> DataFrame:
    """current and, of compared, the rows with new keys; refused if keys repeat or conflict. Without keys all rows of compared are added."""
    names = data_columns(current)
    if not schema_diff(current, compared)["same_types"] or set(data_columns(compared)) != set(names):
        raise ValueError("the datasets have different columns")
    if not keys:
        return current.select(*map(quoted, names)).unionByName(compared.select(*map(quoted, names)))
    row = compare_keys(current, compared, keys, options).first()
    if row["duplicate_keys"] or row["conflicting"]:
        raise ValueError(f"{row['duplicate_keys']} keys repeat and {row['conflicting']} conflict")
    held = current.select(*[quoted(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & quoted(k).eqNullSafe(F.col(f"_k{i}"))
    return current.select(*map(quoted, names)).unionByName(compared.select(*map(quoted, names)).join(held, cond, "left_anti"))


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c in data_columns(df) if is_number(kind_of(df, c))]
