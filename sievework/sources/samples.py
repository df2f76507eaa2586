"""Small synthetic tables for trying things out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def gaps(spark: SparkSession, rows: int = 200) -> DataFrame:
    """Customers with missing identifiers, names, dates and amounts, all as text."""
    i = F.col("id")
    return spark.range(rows).select(
        F.when(i % 17 != 3, (1000 + i).cast("string")).alias("customer_id"),
        F.concat(F.element_at(F.array(*map(F.lit, ("Ada", "Bo", "Cy", "Dee"))), (i % 4 + 1).cast("int")), F.lit(" "), i.cast("string")).alias("full name"),
        F.when(i % 11 == 5, "N/A").otherwise(F.when(i % 3 == 0, "small").otherwise("large")).alias("segment"),
        F.when(i % 13 != 7, F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), i.cast("int")), "dd/MM/yyyy")).alias("since"),
        F.when(i % 7 != 2, F.format_string("%d,%02d", i * 3, i % 100)).alias("amount"),
    )


def series(spark: SparkSession, days: int = 400) -> DataFrame:
    """A day's units and revenue by region."""
    i = F.col("id")
    return spark.range(days).select(F.date_add(F.lit("2024-01-01").cast("date"), i.cast("int")).alias("day"), F.when(i % 2 == 0, "north").otherwise("south").alias("region"), (i % 30 + 5).alias("units"), ((i % 30 + 5) * 12.5).alias("revenue"))
