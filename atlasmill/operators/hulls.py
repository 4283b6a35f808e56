"""Convex hulls of point sets of any size: partial hulls where the points lie, merged a few at a time.

A hull of a union is the hull of its parts' hulls, so each task sends on the corners of what it holds for a key, and
nothing else is shuffled. Parts are merged in groups of FAN until a key has one; no task ever holds a key's points, only
the corners of FAN hulls. Before a hull is built, points inside the octagon of the extreme ones are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partial hulls merged at once.
FAN = 16


def _outside(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which points are not strictly inside the octagon of the extremes by x, y, x + y and x - y."""
    corners = []
    for v in (x, x - y, -y, -x - y, -x, y - x, y, x + y):  # in clockwise order of direction
        corners.append(int(np.argmax(v)))
    inside = np.ones(len(x), bool)
    for a, b in zip(corners, corners[1:] + corners[:1]):
        if x[a] != x[b] or y[a] != y[b]:
            inside &= (x[b] - x[a]) * (y - y[a]) - (y[b] - y[a]) * (x - x[a]) < 0
    return ~inside


def corners(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The corners of a hull, counter-clockwise from the least (x, y); of collinear points the two ends, of equal ones one."""
    if len(x) > 16:
        kept = _outside(x, y)
        x, y = x[kept], y[kept]
    points = np.unique(np.stack([x, y], 1) + 0.0, axis=0)
    if len(points) < 3:
        return points[:, 0], points[:, 1]

    def chain(some: list) -> list:
        out: list = []
        for p in some:
            while len(out) >= 2 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    listed = points.tolist()
    ring = np.array(chain(listed)[:-1] + chain(listed[::-1])[:-1])
    return ring[:, 0], ring[:, 1]


def convex_hulls(points: DataFrame, key: str, x: str = "x", y: str = "y") -> DataFrame:
    """(key, hull) of points (key, x, y): a ring as functions.geometry.convex_hull() makes it, null where that is null.

    Points with a null, infinite or missing coordinate are left out, and a key without any point has no row; a null key is
    one of its own. Repeated points change nothing. An empty table gives an empty result. A hull is one value, so the
    corners of one hull must fit a row.
    """
    kind = points.schema[key].dataType.simpleString()
    schema = f"key {kind}, part long, x double, y double"

    def reduced(part: pd.DataFrame, number: int) -> Iterator[pd.DataFrame]:
        for k, some in part.groupby("key", dropna=False, sort=False):
            hx, hy = corners(some["x"].to_numpy(), some["y"].to_numpy())
            yield pd.DataFrame({"key": [None if pd.isna(k) else k] * len(hx), "part": number, "x": hx, "y": hy}).astype({"key": part["key"].dtype})

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        for b in batches:
            yield from reduced(b, TaskContext.get().partitionId())

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        return pd.concat(list(reduced(part, int(part["part"].iloc[0]))))

    def numbered(part: pd.DataFrame) -> pd.DataFrame:
        merged = merge(part)
        return merged.assign(part=np.arange(len(merged)))

    ok = lambda c: F.col(c).isNotNull() & (F.abs(c) < float("inf"))  # noqa: E731  a NaN is above infinity
    clean = points.select(F.col(key).alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where(ok("x") & ok("y"))
    partial = clean.mapInPandas(local, "key " + schema.split(" ", 1)[1])
    parts = max(clean.rdd.getNumPartitions(), 1)
    while parts > 1:
        partial = partial.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("key", "part").applyInPandas(merge, schema)
        parts = -(-parts // FAN)
    ring = F.array_sort(F.collect_list(F.struct("i", "x", "y")))
    whole = partial.groupBy("key").applyInPandas(numbered, schema)
    listed = whole.withColumnRenamed("part", "i").groupBy("key").agg(ring.alias("ring"))
    hull = F.when(F.size("ring") >= 3, F.transform("ring", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))
    return listed.select(F.col("key").alias(key), hull.alias("hull"))
