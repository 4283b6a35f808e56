"""Text of numbers, points and rings, and their parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from atlasmill.functions import geometry as G
from atlasmill.functions.text import bind


def decimal_text(v: Column) -> Column:
    """Up to 14 decimals, zeros at the end left out, never an exponent."""
    return F.regexp_replace(F.format_string("%.14f", v), r"\.?0+$", "")


def point_json(p: Column) -> Column:
    return F.concat(F.lit('{"lon":'), decimal_text(p["x"]), F.lit(',"lat":'), decimal_text(p["y"]), F.lit("}"))


def ring_json(ring: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(ring, point_json), ","), F.lit("]"))


def parsed_ring(text: Column) -> Column:
    """The points of a JSON array of {"lon", "lat"}, a missing number as 0; empty for null or blank text."""
    points = F.from_json(text, "array<struct<lon:double,lat:double>>")
    return F.coalesce(F.transform(points, lambda p: G.point(F.coalesce(p["lon"], F.lit(0.0)), F.coalesce(p["lat"], F.lit(0.0)))), F.array().cast(G.RING))


def parsed_point(text: Column) -> Column:
    p = F.from_json(text, "struct<lon:double,lat:double>")
    return G.point(F.coalesce(p["lon"], F.lit(0.0)), F.coalesce(p["lat"], F.lit(0.0)))


def range_text(grown: Column, center: Column, metres: float) -> Column:
    """Text of a grown ring, closed; of a circle around the centre where it is empty."""
    around = lambda c: G.circle(c["x"], c["y"], metres)
    return ring_json(G.closed(bind(grown, lambda g: F.when(F.size(g) > 0, g).otherwise(bind(parsed_point(center), around)))))


def expanded_range(center: Column, ring: Column, metres: float) -> Column:
    """Text of a ring moved outwards, or of a circle around the centre where it has under three vertices; closed."""
    return range_text(G.buffered(parsed_ring(ring), metres), center, metres)
