"""Exact quantiles of columns of any size.

Spark's percentile keeps every distinct value with its count in one task, which is right for small data only. Beyond ONE_TASK rows the
wanted ranks are searched for instead: each pass counts the values of a range in equal buckets (one small aggregation), and goes on with
the bucket that holds the rank, between its smallest and largest value, until few values are left or all are equal. A pass reads one
column and returns at most BUCKETS rows for each rank; three or four passes are usual, and both ways give the same values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ONE_TASK, BUCKETS, FEW = 5_000_000, 1024, 100_000


def _share(v: Column, lo, hi, whole: bool) -> Column:
    """Where v is between lo and hi, 0 to 1; never falling as v rises."""
    if whole:
        return (v.cast("decimal(20,0)") - F.lit(lo).cast("decimal(20,0)")).cast("double") / float(hi - lo)
    return F.coalesce(F.try_divide(v / 2 - lo / 2, F.lit(hi / 2 - lo / 2)), F.lit(0.0))


def order_statistics(df: DataFrame, value: Column, ranks: list[int], buckets: int = BUCKETS, few: int = FEW) -> list:
    """The values at 0-based ranks in ascending order, nulls left out. value: long or double without NaN."""
    v = df.select(value.alias("v")).filter("v is not null")
    whole = v.schema["v"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    row = v.agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    # rank -> (smallest and largest value of its range, values below the range, values in it)
    at = {r: (row["lo"], row["hi"], 0, row["n"]) for r in ranks if 0 <= r < row["n"]}
    found: dict[int, object] = {}
    while at:
        for r, (lo, hi, below, n) in list(at.items()):
            if lo == hi:
                found[r] = lo
                del at[r]
            elif n <= few:
                held = [x["v"] for x in v.filter(F.col("v").between(lo, hi)).orderBy("v").collect()]
                for s, place in list(at.items()):
                    if place == (lo, hi, below, n):
                        found[s] = held[s - below]
                        del at[s]
                break
        else:
            ranges = sorted(set(at.values()))
            which = F.lit(None).cast("int")
            for i, (lo, hi, _, _) in enumerate(ranges):
                inside = F.col("v").between(lo, hi)
                which = F.when(inside, i * buckets + F.least(F.floor(_share(F.col("v"), lo, hi, whole) * buckets), F.lit(buckets - 1))).otherwise(which)
            counts = v.groupBy(which.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).filter("b is not null").collect()
            for r, place in list(at.items()):
                i, below = ranges.index(place), place[2]
                for c in sorted((c for c in counts if c["b"] // buckets == i), key=lambda c: c["b"]):
                    if r < below + c["n"]:
                        now = (c["lo"], c["hi"], below, c["n"])
                        break
                    below += c["n"]
                if now[:2] == place[:2] and now[3] == place[3]:  # nothing between them that arithmetic can tell apart: by the values themselves
                    below = place[2]
                    for x in v.filter(F.col("v").between(*place[:2])).groupBy("v").agg(F.count("*").alias("n")).orderBy("v").toLocalIterator():
                        if r < below + x["n"]:
                            now = (x["v"], x["v"], below, x["n"])
                            break
                        below += x["n"]
                at[r] = now
    return [found.get(r) for r in ranks]


def linear(df: DataFrame, values: dict[str, Column], shares: list[float], one_task: int = ONE_TASK) -> dict[str, list[float | None]]:
    """name -> linearly interpolated quantiles of each expression (doubles; nulls left out), exact."""
    if not values:
        return {}
    names = list(values)
    counts = df.agg(*[F.count(values[n]).alias(f"n{i}") for i, n in enumerate(names)]).first()
    small = [n for i, n in enumerate(names) if counts[f"n{i}"] <= one_task]
    out: dict[str, list[float | None]] = {}
    if small:
        row = df.agg(*[F.percentile(values[n], F.array(*map(F.lit, shares))).alias(f"q{i}") for i, n in enumerate(small)]).first()
        out = {n: row[f"q{i}"] or [None] * len(shares) for i, n in enumerate(small)}
    for i, n in enumerate(names):
        if n in out:
            continue
        places = [(counts[f"n{i}"] - 1) * s for s in shares]
        ranks = sorted({r for p in places for r in (int(p), min(int(p) + 1, counts[f"n{i}"] - 1))})
        held = dict(zip(ranks, order_statistics(df, values[n], ranks), strict=True))
        out[n] = [held[int(p)] + (p - int(p)) * (held[min(int(p) + 1, counts[f"n{i}"] - 1)] - held[int(p)]) for p in places]
    return out


def lower_median(df: DataFrame, value: Column):
    """The element at the lower middle, in its own type: whole numbers keep every digit. None without values."""
    n = df.agg(F.count(value).alias("n")).first()["n"]
    return order_statistics(df, value, [(n - 1) // 2])[0] if n else None
