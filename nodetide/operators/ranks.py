"""Exact order statistics, exact percentiles and exact draws of any number of rows, by counts in ranges of values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nodetide.operators.providers import few_rows

#: Ranges a pass counts, and values that are few enough to be sorted at once.
RANGES, FEW = 4096, 10_000


def order_statistics(rows: DataFrame, group: list[str], value: str, wanted: DataFrame) -> DataFrame:
    """The values of given ranks: `wanted` (columns of `group`, name, rank from 1) with the column `value`.

    A pass counts the values in equal ranges between the least and greatest one that can be meant, with the least and
    greatest value in each; the range that holds a rank is the next pass's whole. A pass moves a row a range (map-side
    sums), never values, and splits every range it looks into, so it ends: with one value, or with few that are sorted.
    `wanted` is small and has a row for each group of `rows` it asks about. Null values are left out; a rank beyond the
    group's values gives no row.
    """
    spark = rows.sparkSession
    names = [*group, "name"]
    clean = rows.select(*group, F.col(value).cast("double").alias("v")).where("v is not null")
    ends = few_rows(clean.groupBy(*group).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")))
    open_ = spark.createDataFrame(wanted.join(ends, group).where("rank between 1 and n").select(*names, F.col("rank").cast("long").alias("rank"), "lo", "hi").collect(),
                                  ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.select(*names).schema) + ", rank long, lo double, hi double")
    found = [open_.where("lo = hi").select(*names, F.col("lo").alias(value))]
    open_ = open_.where("lo < hi")
    for_all = Window.partitionBy(*group, "lo", "hi").orderBy("range")
    while ranges := open_.select(*group, "lo", "hi").distinct().collect():
        bounds = spark.createDataFrame(ranges, open_.select(*group, "lo", "hi").schema)
        inside = clean.join(F.broadcast(bounds), group).where("v between lo and hi")
        share = (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))
        counted = inside.groupBy(*group, "lo", "hi", F.least(F.floor(share * RANGES), F.lit(RANGES - 1)).alias("range")).agg(
            F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).withColumn("upto", F.sum("n").over(for_all))
        met = open_.join(counted, [*group, "lo", "hi"]).where("rank <= upto and rank > upto - n").select(
            *names, (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), "low", "high", "n")
        rows_now = met.collect()  # a row for each wanted rank
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in met.select(*names).schema) + ", rank long, lo double, hi double, n long"
        now = spark.createDataFrame(rows_now, schema)
        found.append(now.where("lo = hi").select(*names, F.col("lo").alias(value)))
        few = now.where(f"lo < hi and n <= {FEW}")
        if few.limit(1).count():
            sets = clean.join(F.broadcast(few.select(*group, "lo", "hi").distinct()), group).where("v between lo and hi").groupBy(*group, "lo", "hi").agg(
                F.sort_array(F.collect_list("v")).alias("vs"))
            picked = few.join(sets, [*group, "lo", "hi"]).select(*names, F.expr("vs[rank - 1]").alias(value))
            found.append(spark.createDataFrame(picked.collect(), picked.schema))
        open_ = now.where(f"lo < hi and n > {FEW}").drop("n")
    return reduce(DataFrame.unionByName, found)


def exact_quantiles(df: DataFrame, columns: dict[str, str], probs: dict[str, float]) -> DataFrame:
    """Percentiles per provider as `logs.provider_quantiles` gives for few rows, exact for any number of them.

    The percentile p of n values is the value of rank ceil(p * n), of rank 1 for p = 0.
    """
    each = F.explode(F.array(*[F.struct(F.lit(prefix).alias("what"), F.col(c).cast("double").alias("v")) for prefix, c in columns.items()]))
    long = df.select("cloud_provider", each.alias("one")).select("cloud_provider", "one.*").where("v is not null")
    sizes = few_rows(long.groupBy("cloud_provider", "what").agg(F.count("*").alias("n")))
    ranks = F.explode(F.array(*[F.struct(F.lit(s).alias("name"), F.greatest(F.ceil(F.col("n") * F.lit(p)), F.lit(1)).alias("rank")) for s, p in probs.items()]))
    wanted = sizes.select("cloud_provider", "what", ranks.alias("one")).select("cloud_provider", "what", "one.*")
    values = order_statistics(long, ["cloud_provider", "what"], "v", wanted)
    names = [f"{prefix}{suffix}" for prefix in columns for suffix in probs]
    return values.groupBy("cloud_provider").agg(*[F.max(F.when(F.concat("what", "name") == n, F.col("v"))).alias(n) for n in names])


def counted_quantiles(df: DataFrame, column: str, probs: dict[str, float]) -> DataFrame:
    """Exact percentiles per provider of a column with few distinct values, such as the windows of a trace, in one pass.

    Values are counted, a row a value moves on; the columns are called `column` and the probability's suffix.
    """
    counted = df.groupBy("cloud_provider", F.col(column).alias("v")).agg(F.count("*").alias("n")).where("v is not null")
    upto = F.sum("n").over(Window.partitionBy("cloud_provider").orderBy("v"))
    total = F.sum("n").over(Window.partitionBy("cloud_provider"))
    ranked = counted.withColumn("upto", upto).withColumn("total", total)
    reached = [F.min(F.when(F.col("upto") >= F.greatest(F.ceil(F.col("total") * F.lit(p)), F.lit(1)), F.col("v"))).alias(f"{column}{s}") for s, p in probs.items()]
    return ranked.groupBy("cloud_provider").agg(*reached)


# ---------------------------------------------------------------------------- draws
DRAW_BITS = 52


def draw_key(keys: list[str], seed: int) -> Column:
    """52 bits of a digest of seed and key columns: the same for a row wherever and however often it is computed."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]).cast("binary"))
    return F.conv(F.substring(digest, 1, DRAW_BITS // 4), 16, 10).cast("long")


def draw_share(rows: DataFrame, share: float, seed: int, keys: list[str]) -> DataFrame:
    """The rows whose draw lies in the lowest `share` of all possible ones. Rows with equal keys go together."""
    return rows if share >= 1 else rows.filter(draw_key(keys, seed) < int(share * (1 << DRAW_BITS)))


def draw_rows(rows: DataFrame, n: int, seed: int, keys: list[str]) -> DataFrame:
    """Exactly `n` rows, or all if there are no more: those with the lowest draws, found by counts in ranges of draws.

    Of rows that share the last draw (equal keys) as many as are needed are taken.
    """
    total = rows.count()
    if total <= n:
        return rows
    if n <= 0:
        return rows.limit(0)
    drawn = rows.withColumn("_draw", draw_key(keys, seed))
    one = drawn.select(F.lit(0).alias("all"), "_draw")
    wanted = rows.sparkSession.createDataFrame([(0, "last", n)], "all int, name string, rank long")
    last = int(order_statistics(one, ["all"], "_draw", wanted).first()["_draw"])
    below = drawn.filter(F.col("_draw") < last)
    return below.unionByName(drawn.filter(F.col("_draw") == last).limit(n - below.count())).drop("_draw")


# ------------------------------------------------------------------------- sketches
SKETCH_K = 400
#: Rank error of a sketch with k = 400, 99 % sure, as published for these sketches.
SKETCH_ERROR = 0.0075


def daily_sketches(df: DataFrame, columns: dict[str, str], day_seconds: int = 86_400) -> DataFrame:
    """One KLL sketch for each provider, day and column: the table that is kept. New days are appended, none is read again."""
    aggs = [F.call_function("kll_sketch_agg_double", F.col(c).cast("double"), F.lit(SKETCH_K)).alias(prefix) for prefix, c in columns.items()]
    day = F.floor(F.col("window_ts") / day_seconds).alias("day")
    return df.groupBy("cloud_provider", day).agg(F.count("*").alias("rows"), *aggs)


def merged_sketches(sketches: DataFrame, columns: list[str], days_at_once: int = 32) -> DataFrame:
    """One sketch for each provider and column over all days, merged in a tree: runs of days first, then runs of those."""
    first = sketches.agg(F.min("day")).first()[0] or 0
    level = sketches.select("cloud_provider", (F.col("day") - first).alias("day"), "rows", *columns)
    while True:
        level = level.withColumn("day", F.floor(F.col("day") / days_at_once))
        merged = [F.expr(f"reduce(slice(all_{c}, 2, size(all_{c})), all_{c}[0], (a, b) -> kll_sketch_merge_double(a, b))").alias(c) for c in columns]
        level = level.groupBy("cloud_provider", "day").agg(F.sum("rows").alias("rows"), *[F.collect_list(c).alias(f"all_{c}") for c in columns]).select(
            "cloud_provider", "day", "rows", *merged)
        lo, hi = level.agg(F.min("day"), F.max("day")).first()
        if lo == hi:
            return level.drop("day")


def sketched_quantiles(merged: DataFrame, columns: list[str], probs: dict[str, float]) -> DataFrame:
    """Percentiles per provider from merged sketches, within `SKETCH_ERROR` of the rank."""
    return merged.select("cloud_provider", *[
        F.call_function("kll_sketch_get_quantile_double", F.col(c), F.lit(p).cast("double")).alias(f"{c}{s}") for c in columns for s, p in probs.items()])
