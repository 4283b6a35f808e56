"""Label enrichment, key replacement, audits of aligned tables, and appends that can be repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from atlasmill.operators import before


def label_lists(labels: DataFrame, key: str = "address", label: str = "label", order: str = "seq", separator: str = "/") -> DataFrame:
    """(key, label): each key's distinct labels in the order in which they first come."""
    first = labels.groupBy(key, label).agg(F.min(order).alias("_at"))  # repeated pairs meet before they are gathered
    listed = F.array_sort(F.collect_list(F.struct("_at", label)))
    return first.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x[label]), separator).alias(label))


def with_labels(results: DataFrame, labels: DataFrame, key: str = "address", label: str = "label") -> DataFrame:
    """results with their label lists, '' where the key has none."""
    return results.join(label_lists(labels, key, label), key, "left").withColumn(label, F.coalesce(F.col(label), F.lit("")))


def unlabelled(results: DataFrame, labels: DataFrame, key: str = "address") -> DataFrame:
    return results.join(labels.select(key).distinct(), key, "left_anti")


def with_codes(results: DataFrame, labels: DataFrame, key: str = "address", preferred: Column | None = None, order: str = "seq") -> DataFrame:
    """results with the label row of their key; of several the preferred one, else the first; a key without one raises."""
    rank = Window.partitionBy(key).orderBy(*([F.when(preferred, 0).otherwise(1)] if preferred is not None else []), order)
    one = labels.withColumn("_n", F.row_number().over(rank)).where("_n = 1").drop("_n", order).withColumn("_found", F.lit(True))
    joined = results.join(one, key, "left")
    return joined.where(F.when(F.col("_found"), True).otherwise(F.raise_error(F.concat(F.lit("no label row: "), F.col(key))).cast("boolean"))).drop("_found")


def placed(df: DataFrame, order: str) -> DataFrame:
    """df with pos, its rows' places from 0 in that order."""
    return before(df, F.lit(1), order, "pos")


def misaligned(left: DataFrame, right: DataFrame, column: str, order: str) -> DataFrame:
    """(pos, left, right) wherever two tables, each in order, don't hold equal values at a place; a missing row is null."""
    a = placed(left, order).select("pos", F.col(column).alias("left"))
    b = placed(right, order).select("pos", F.col(column).alias("right"))
    return a.join(b, "pos", "full").where(~F.col("left").eqNullSafe(F.col("right")))


def matched_ids(results: DataFrame, regions: DataFrame, key: str, check: str) -> DataFrame:
    """results with their region by key; a row without one, and one that doesn't hold the same check, raises."""
    other = regions.withColumnRenamed(check, "_check").withColumn("_found", F.lit(True))
    same = F.when(F.col("_found") & F.col(check).eqNullSafe(F.col("_check")), True).otherwise(F.raise_error(F.concat(F.lit("differs: "), F.col(key).cast("string"))).cast("boolean"))
    return results.join(other, key, "left").where(same).drop("_check", "_found")


def aligned(left: DataFrame, right: DataFrame, column: str, order: str) -> DataFrame:
    """left, where both tables hold equal values at every place; the first of the places where they don't raises."""
    rows = placed(left, order)
    other = placed(right, order).select("pos", F.col(column).alias("_right"), F.lit(True).alias("_there"))
    same = F.when(F.col("_there") & F.col(column).eqNullSafe(F.col("_right")), True).otherwise(F.raise_error(F.concat(F.lit("tables differ at row "), F.col("pos").cast("string"))).cast("boolean"))
    return rows.join(other, "pos", "left").where(same).select(left.columns)


def updated_by_place(base: DataFrame, changes: DataFrame, columns: list[str], order: str = "seq") -> DataFrame:
    """base with the columns of the row of changes at the same place; as many rows of either, else ValueError."""
    same_count(base, changes)
    new = placed(changes, order).select("pos", *[F.col(c).alias(f"_new_{c}") for c in columns])
    rows = placed(base, order).join(new, "pos")
    return rows.withColumns({c: F.col(f"_new_{c}") for c in columns}).select(*base.columns, *[c for c in columns if c not in base.columns])


def appended(base: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """base with extra behind it; rows of base that an earlier append left under extra's keys go first, so it can be repeated."""
    return base.join(extra.select(key).distinct(), key, "left_anti").select(base.columns).unionByName(extra)


def same_count(*frames: DataFrame) -> int:
    """The row count that all frames share; ValueError if they differ."""
    counts = [f.count() for f in frames]
    if len(set(counts)) > 1:
        raise ValueError(f"row counts differ: {counts}")
    return counts[0]
