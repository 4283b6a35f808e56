"""Operators over tables of addresses, candidates and results: each takes DataFrames and returns one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from atlasmill.functions import rules as R
from atlasmill.functions import text as T

#: Rows whose order numbers share a bucket; a bucket is one task's sort.
BUCKET_BITS = 16


def first_occurrence(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row in order of each key. Ranks are limited before the shuffle, so a key of many rows sends one a task."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by keys, or evenly without any, over several tasks for each core, which adaptive execution doesn't pack together again.

    For rows that are small and whose work is not: Spark sizes tasks by bytes and would put a million addresses into one.
    """
    spark = df.sparkSession
    return df.repartition(min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(64, 4 * spark.sparkContext.defaultParallelism)), *keys)


def before(df: DataFrame, value: Column, order: str, name: str) -> DataFrame:
    """df with the sum of value over all rows before each, by a whole-number order, bucket by bucket.

    The buckets' totals are summed in one small window, so no task takes all rows. Rows without an order number come first.
    """
    held = df.withColumn("_v", value.cast("long")).withColumn("_b", F.shiftright(F.col(order).cast("long"), BUCKET_BITS))
    totals = held.groupBy("_b").agg(F.sum("_v").alias("_t"))
    starts = totals.select("_b", F.coalesce(F.sum("_t").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    within = F.coalesce(F.sum("_v").over(Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.withColumnRenamed("_b", "_at")
    # a bucket's rows are of one task: numbers far apart, such as monotonically_increasing_id, make buckets of few rows
    return held.withColumn("_w", within).join(starts, F.col("_b").eqNullSafe(F.col("_at"))).withColumn(name, F.col("_s") + F.col("_w")).drop("_v", "_b", "_s", "_w", "_at")


def dense_ids(df: DataFrame, ok: Column, order: str, start: int, name: str = "region_id") -> DataFrame:
    """start plus the number of earlier rows for which ok holds: a failed row has the id that the next good one takes."""
    return before(df, F.when(ok, 1).otherwise(0), order, "_earlier").withColumn(name, F.col("_earlier") + start).drop("_earlier")


def streaks(df: DataFrame, empty: Column, order: str, threshold: int, carried: int = 0) -> DataFrame:
    """df with streak: empties in a row so far, 0 at others; it starts again after reaching the threshold.

    carried: the streak of the row before the first, for rows that go on from others.

    A run's length is the distance to the last row that isn't empty. That is looked for in the row's own bucket, and the
    buckets' last ones are carried on in one small window, so a run of any length stays in its buckets.
    """
    held = before(df.withColumn("_e", empty), F.lit(1), order, "_pos").withColumn("_b", F.shiftright(F.col(order).cast("long"), BUCKET_BITS))
    full = F.when(~F.col("_e"), F.col("_pos"))
    lasts = held.groupBy("_b").agg(F.max(full).alias("_l"))
    before_it = lasts.select(F.col("_b").alias("_at"), F.max("_l").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_c"))
    here = F.max(full).over(Window.partitionBy("_b").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0))
    run = F.col("_pos") - F.coalesce("_h", "_c", F.lit(-1 - carried))
    joined = held.withColumn("_h", here).join(before_it, F.col("_b").eqNullSafe(F.col("_at")))
    return joined.withColumn("streak", F.when(F.col("_e"), (run - 1) % threshold + 1).otherwise(0)).drop("_e", "_pos", "_b", "_h", "_at", "_c")


def best_admissible(df: DataFrame, keys: list[str], order: list[Column], admissible: Column) -> DataFrame:
    """Each key's first admissible row, with skipped: how many rows of the key stand before it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("_ok", admissible).withColumn("_rank", F.row_number().over(w))
    return first_occurrence(ranked.where("_ok"), keys, "_rank").withColumn("skipped", F.col("_rank") - 1).drop("_rank", "_ok")


def city_allowed(city: Column, wanted: str = R.CITY) -> Column:
    return F.coalesce(city, F.lit("")).isin("", wanted)


def within_bounds(has_center: Column, lon: Column, lat: Column, bounds: tuple[float, float, float, float]) -> Column:
    """Inside the box (lon, lat, lon, lat), borders included; without a centre always."""
    return ~has_center | (lon.between(bounds[0], bounds[2]) & lat.between(bounds[1], bounds[3]))


def place_type(std_tag: Column, show_tag: Column) -> Column:
    """The tag's last part; a tag that ends in ; is taken whole."""
    tag = F.coalesce(F.nullif(std_tag, F.lit("")), F.nullif(show_tag, F.lit("")), F.lit(R.UNKNOWN_TYPE))
    return F.when(tag.endswith(";"), tag).otherwise(F.substring_index(tag, ";", -1))


def region_name(multi: Column, name: Column, address: Column) -> Column:
    return F.when(multi, address).otherwise(F.coalesce(F.nullif(name, F.lit("")), address))


def status(has_center: Column, low: Column, notes: Column) -> Column:
    """Failed without a centre; low for a low score and for any note at all; else success."""
    return F.when(~has_center, R.STATUS_FAILED).when(low | (F.size(notes) > 0), R.STATUS_LOW).otherwise(R.STATUS_SUCCESS)


def summary(results: DataFrame) -> DataFrame:
    """One row: how many results, of each status, and without a polygon among those that have a centre."""
    ok = F.col("center_lon").isNotNull() & F.col("center_lat").isNotNull()
    count = lambda c: F.count_if(c).cast("long")
    return results.agg(
        F.count(F.lit(1)).alias("total"), count(F.col("status") == R.STATUS_SUCCESS).alias("success"), count(F.col("status") == R.STATUS_LOW).alias("low"),
        count(F.col("status") == R.STATUS_FAILED).alias("failed"), count(ok & (F.size("polygon") == 0)).alias("no_polygon"),
    )


def histogram(df: DataFrame, column: str, blank: str = "(空)") -> DataFrame:
    value = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(blank))
    return df.groupBy(value.alias(column)).agg(F.count(F.lit(1)).alias("n"))


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    """One row: n, how many different values key has; null is none."""
    return df.agg(F.countDistinct(key).alias("n"))


def keyword_filter(df: DataFrame, keyword: str, columns: list[str]) -> DataFrame:
    """Rows that hold the keyword in a column, upper and lower case alike."""
    found = F.lit(False)
    for c in columns:
        found = found | F.lower(T.or_empty(c)).contains(keyword.lower())
    return df.where(found)


def has_boundary(ring: Column) -> Column:
    """Whether a result has a ring of three or more points; a null ring is none."""
    return F.coalesce(F.size(ring) >= 3, F.lit(False))


def shown(df: DataFrame, status: str | None = None, boundary: bool | None = None) -> DataFrame:
    """The rows (status, polygon, ...) of a view: of one status, with or without a boundary; None: all."""
    if status is not None:
        df = df.where(F.col("status") == status)
    return df if boundary is None else df.where(has_boundary(F.col("polygon")) == F.lit(boundary))


def numbered_view(df: DataFrame, condition: Column | None, order: str) -> DataFrame:
    """The rows that a view shows, numbered from 1 as they follow each other."""
    shown = df if condition is None else df.where(condition)
    return before(shown, F.lit(1), order, "row_no").withColumn("row_no", F.col("row_no") + 1)
