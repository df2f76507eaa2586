"""Row-local recipe steps over a stream: whatever needs no pass of its own over the data."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.recipe import Recipe, RecipeError


def apply_to_stream(recipe: Recipe, stream: DataFrame) -> DataFrame:
    """The recipe on a streaming DataFrame. Outliers and group summaries need all rows and are refused, and so are conversions
    under review, since a stream can't be checked before it is returned: use nullify or excludeRow."""
    if recipe.outlierTreatments or recipe.groupSummary:
        raise RecipeError("outliers and group summaries need all rows")
    if any(c.get("policy", "review") == "review" for c in [*recipe.casts, *recipe.dateParses]):
        raise RecipeError("conversions of a stream need the policy nullify or excludeRow")
    if any(f["op"] in ("gt", "lt", "gte", "lte") and dict(stream.dtypes).get(f["column"]) == "string" for f in recipe.filters):
        raise RecipeError("cast the column of a numeric filter first")
    from ..functions.order import RID
    from pyspark.sql import functions as F

    return recipe.apply_ordered(stream.withColumn(RID, F.lit(0))).drop(RID)
