"""Rings that cross themselves, as offsets of concave ones do: split at the crossings, of which loops that turn the right way stay."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atlasmill.functions import geometry as G
from atlasmill.functions.text import bind
from atlasmill.operators import spread


#: Metres within which a corner lies on an edge.
TOUCH = 1e-6
#: Metres that each corner of a ring stands off its neighbours' edges for it to be taken as convex without a closer look.
CLEAR = 1e-3


def signed_area(r: np.ndarray) -> float:
    n = np.roll(r, -1, axis=0)
    return float((r[:, 0] * n[:, 1] - n[:, 0] * r[:, 1]).sum() / 2)


def crossing(r: np.ndarray) -> tuple[int, int, np.ndarray] | None:
    """(i, j, place) of the first edge i that a later edge j properly crosses; edges start at corner i and j."""
    a, b = r, np.roll(r, -1, axis=0)
    side = lambda p, q, s: (q[..., 0] - p[..., 0]) * (s[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (s[..., 0] - p[..., 0])
    n = len(r)
    for i in range(n - 2):
        j = np.arange(i + 2, n - (i == 0))  # the edges beside it share a corner with it
        c, d = a[j], b[j]
        s, t = side(a[i], b[i], c), side(a[i], b[i], d)
        u, v = side(c, d, a[i]), side(c, d, b[i])
        met = np.flatnonzero((s * t < 0) & (u * v < 0))
        if len(met):
            along = u[met] / (u[met] - v[met])
            k = int(np.argmin(along))
            return i, int(j[met[k]]), a[i] + along[k] * (b[i] - a[i])
    return None


def touching(r: np.ndarray) -> tuple[int, int] | None:
    """(i, k): the first edge i on which another corner k lies, to within TOUCH, that isn't one of its ends."""
    n = len(r)
    for i in range(n):
        a, d = r[i], r[(i + 1) % n] - r[i]
        length = float(d @ d)
        along = np.clip(((r - a) @ d) / length, 0, 1) if length else np.zeros(n)
        near = np.hypot(*(r - a - along[:, None] * d).T) <= TOUCH
        near[[i, (i + 1) % n]] = False
        if near.any():
            return i, int(np.argmax(near))
    return None


def is_simple(r: np.ndarray) -> bool:
    """Whether a ring of metres neither crosses nor touches itself."""
    return crossing(r) is None and touching(r) is None


def loops(ring: np.ndarray) -> list[np.ndarray]:
    """The simple loops that a ring of metres falls into where it crosses or touches itself, those that turn
    counter-clockwise, the largest first. Each step leaves fewer crossings, or loops of fewer corners."""
    left, out = [ring], []
    while left:
        r = left.pop()
        if len(r) < 3:
            continue
        if (met := crossing(r)) is not None:
            i, j, place = met
            left += [np.concatenate([r[: i + 1], [place], r[j + 1 :]]), np.concatenate([[place], r[i + 1 : j + 1]])]
        elif (met := touching(r)) is not None:
            i, k = met
            left += [np.concatenate([r[: i + 1], r[k:]]), np.concatenate([r[k : k + 1], r[i + 1 : k]])] if k > i else [np.concatenate([r[: k + 1], r[i + 1 :]]), r[k : i + 1]]
        elif signed_area(r) > 0:
            out.append(r)
    return sorted(out, key=signed_area, reverse=True)


def _outer_loops(rings: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The largest counter-clockwise simple loop of each ring; a simple ring as it is, one without a loop empty."""
    for some in rings:
        out = []
        for ring in some:
            if ring is None or len(ring) < 3:
                out.append(None if ring is None else [dict(p) for p in ring])
                continue
            points = np.array([(p["x"], p["y"]) for p in ring], float)
            if not is_simple(points):
                found = loops(points)
                points = found[0] if found else np.zeros((0, 2))
            out.append([{"x": float(x), "y": float(y)} for x, y in points])
        yield pd.Series(out, dtype=object)


def is_convex(ring: Column) -> Column:
    """Whether a ring of metres turns left at every corner, by CLEAR at least, and once around in all. Such a ring is simple:
    of the other corners those beside an edge are the nearest to its line. False for what isn't plainly so."""

    def turns(edges: Column) -> Column:
        def left(e: Column, f: Column) -> Column:
            cross = e["x"] * f["y"] - e["y"] * f["x"]
            return ~F.isnan(cross) & (cross > CLEAR * F.greatest(F.hypot(e["x"], e["y"]), F.hypot(f["x"], f["y"])))

        east = lambda e: (e["x"] > 0) | ((e["x"] == 0) & (e["y"] > 0))
        flips = F.size(F.filter(F.zip_with(G.previous(edges), edges, lambda e, f: east(e) != east(f)), lambda c: c))
        return F.forall(F.zip_with(G.previous(edges), edges, left), lambda c: c) & (flips == 2)

    edges = G.over_edges(ring, lambda a, b: G.point(b["x"] - a["x"], b["y"] - a["y"]))
    return F.coalesce(F.when(F.size(ring) >= 3, bind(edges, turns)), F.lit(False))


def with_buffers(df: DataFrame, ring: Column, metres: float, name: str) -> DataFrame:
    """df with geometry.buffered() of a ring of degrees, of which, where it crosses or touches itself, the largest simple loop is taken.

    A null ring and one of under three vertices give an empty one. The work is that of a ring's corners squared for each
    crossing. A step of a DataFrame and no expression, since the loops are found in Python, from Arrow batches; only rings
    that aren't plainly convex are handed to it. Rows are dealt out evenly, since their bytes say little of their work.
    """
    loop = F.pandas_udf(_outer_loops, G.RING).asNondeterministic()  # or Spark would put it back into the expression around it
    rows = spread(df).withColumn("_moved", G.moved(ring, metres)).withColumn("_convex", is_convex(F.col("_moved.ring")))
    rows = rows.withColumn("_loop", loop(F.when(~F.col("_convex"), F.col("_moved.ring"))))
    of = F.when(F.col("_convex"), F.col("_moved.ring")).otherwise(F.col("_loop"))
    kept = bind(of, lambda r: F.when(r.isNotNull(), G.from_local(r, F.col("_moved.origin"))).otherwise(F.array().cast(G.RING)))
    return rows.withColumn(name, kept).drop("_moved", "_convex", "_loop")
