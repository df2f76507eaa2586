"""Connected components of an undirected graph given as edges, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def _print(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["x"], r["s"]


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """edges: a and b, ids of one orderable type, in any direction; loops and repeats don't matter. Returns one row (node, root) for each node
    that is not the smallest of its component, root being the smallest. No edges: no rows.

    Each round joins every node's larger neighbours to the smallest one (large star), then its smaller ones (small star); minima are
    aggregated before they are shuffled, and each round is written to the shared folder. Rounds grow with the logarithm of the longest path; a round's tables go when the next one's are there.

    Defined cases: a null end is no edge; ids of any orderable type; a node that a third of all edges lead to is one minimum per task; repeated edges count once."""
    now = written(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _print(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.filter("a != b").distinct(), "large-star")
        # every edge of large points from a larger to a smaller node
        lower = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(lower, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(lower.select("a", F.col("m").alias("b")))
        last = now
        now = written(small.distinct(), "small-star")
        forget(last, large, least, lower)
        last, seen = seen, _print(now)
        if seen == last:
            break
    else:
        raise RuntimeError(f"no end after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
