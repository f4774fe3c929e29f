"""Tables with one row per provider, and joins to them. The providers are those of the data, however they are called."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: More providers than this fail the job: their figures are broadcast.
MOST = 1000


def few_rows(table: DataFrame, most: int = MOST) -> DataFrame:
    """The table, proven to have at most `most` rows: one more fails the job instead of being dropped."""
    gathered = table.limit(most + 1).agg(F.collect_list(F.struct(*table.columns)).alias("rows"))
    checked = F.when(F.size("rows") <= most, F.col("rows")).otherwise(F.raise_error(F.lit(f"more than {most} rows of provider figures")))
    return gathered.select(F.inline(checked))


def per_provider(df: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
    """Attach one row of figures per provider."""
    return df.join(F.broadcast(few_rows(table)), "cloud_provider", how)
