"""Rings, hulls, buffers and coordinates over arrays of struct<x double, y double>, all as expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from atlasmill.functions import rules as R
from atlasmill.functions.text import bind, control_trim

POINT = "struct<x:double,y:double>"
RING = f"array<{POINT}>"
#: Points of which a hull is built without leaving out inner ones.
PRUNED = 64


def point(x, y) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def previous(ring: Column) -> Column:
    """The ring turned so that each place holds the vertex before it."""
    return F.concat(F.slice(ring, F.size(ring), 1), F.slice(ring, 1, F.size(ring) - 1))


def following(ring: Column) -> Column:
    return F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))


def over_edges(ring: Column, f) -> Column:
    """f(previous vertex, vertex) of each edge; empty for an empty ring."""
    return F.when(F.size(ring) > 0, F.zip_with(previous(ring), ring, f))


def parsed_polygons(text: Column) -> Column:
    """Rings of at least three points of every POLYGON ((x y, ...)) without inner parentheses; points that aren't two numbers go."""
    bodies = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"POLYGON\s*\(\(([^)]*)\)\)"), F.lit(1))

    def ring(body: Column) -> Column:
        pairs = F.transform(F.split(body, ","), lambda p: F.split(control_trim(p), r"\s+"))
        points = F.transform(pairs, lambda p: point(F.get(p, 0).try_cast("double"), F.get(p, 1).try_cast("double")))
        return F.filter(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull())

    return F.filter(F.transform(bodies, ring), lambda r: F.size(r) >= 3)


def bbox(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def in_bbox(x: Column, y: Column, box: Column) -> Column:
    return x.between(box["x0"], box["x1"]) & y.between(box["y0"], box["y1"])


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule with half-open edges."""
    crossed = over_edges(ring, lambda j, i: ((i["y"] > y) != (j["y"] > y)) & (x < F.try_divide((j["x"] - i["x"]) * (y - i["y"]), j["y"] - i["y"]) + i["x"]))
    return F.coalesce(F.size(F.filter(crossed, lambda c: c)) % 2 == 1, F.lit(False))


def area(ring: Column) -> Column:
    return F.abs(_sum(over_edges(ring, lambda j, i: (j["x"] + i["x"]) * (j["y"] - i["y"])))) / 2


def signed_area(ring: Column) -> Column:
    return _sum(over_edges(ring, lambda j, i: j["x"] * i["y"] - i["x"] * j["y"])) / 2


def centroid(ring: Column) -> Column:
    """Centre of area; of a ring without area the centre of its box."""
    cross = lambda j, i: j["x"] * i["y"] - i["x"] * j["y"]
    sums = F.struct(
        _sum(over_edges(ring, cross)).alias("a"),
        _sum(over_edges(ring, lambda j, i: (j["x"] + i["x"]) * cross(j, i))).alias("x"),
        _sum(over_edges(ring, lambda j, i: (j["y"] + i["y"]) * cross(j, i))).alias("y"),
    )
    middle = lambda b: point((b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2)
    return bind(sums, lambda s: F.when(F.abs(s["a"]) < 1e-9, bind(bbox(ring), middle)).otherwise(point(F.try_divide(s["x"], 3 * s["a"]), F.try_divide(s["y"], 3 * s["a"]))))


def mean_point(points: Column) -> Column:
    n = F.size(points)
    return F.when(n > 0, point(F.try_divide(_sum(F.transform(points, lambda p: p["x"])), n), F.try_divide(_sum(F.transform(points, lambda p: p["y"])), n)))


def chosen_footprint(rings: Column, x: Column, y: Column) -> Column:
    """The first ring that holds the point, else the first of the largest, else null."""
    holding = F.get(F.filter(rings, lambda r: bind(bbox(r), lambda b: in_bbox(x, y, b)) & contains(r, x, y)), 0)
    sized = F.transform(rings, lambda r, i: F.struct(area(r).alias("a"), (-i).alias("i"), r.alias("r")))
    return F.coalesce(holding, F.array_max(sized)["r"])


def outside(points: Column) -> Column:
    """Points that are not strictly inside the octagon of the extreme ones: no other can be a vertex of the hull."""
    directions = [lambda p: p["x"], lambda p: p["x"] - p["y"], lambda p: -p["y"], lambda p: -p["x"] - p["y"], lambda p: -p["x"], lambda p: p["y"] - p["x"], lambda p: p["y"], lambda p: p["x"] + p["y"]]
    extreme = lambda f: F.array_max(F.transform(points, lambda p: F.struct(f(p).alias("v"), p.alias("p"))))["p"]

    def cut(corners: Column) -> Column:
        edges = bind(F.zip_with(corners, following(corners), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda e: F.filter(e, lambda s: s["a"] != s["b"]))
        right_of = lambda e, p: (e["b"]["x"] - e["a"]["x"]) * (p["y"] - e["a"]["y"]) - (e["b"]["y"] - e["a"]["y"]) * (p["x"] - e["a"]["x"]) < 0
        return bind(edges, lambda es: F.filter(points, lambda p: ~F.forall(es, lambda e: right_of(e, p)) | (F.size(es) == 0)))

    return bind(F.array(*map(extreme, directions)), cut)


def convex_hull(points: Column) -> Column:
    """Counter-clockwise, without collinear vertices and not closed; null of under three distinct or of collinear points.

    Of over PRUNED points those inside the octagon of the extreme ones are left out first. The work still grows with the
    points times the vertices: for rings with very many vertices see operators.hulls.
    """

    def turn(o: Column, a: Column, b: Column) -> Column:
        return (a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"])

    def popped(chain: Column, p: Column) -> Column:
        """chain less the vertices at its end that p makes needless."""
        def last(h: Column, _: Column) -> Column:
            n = F.size(h)
            return F.when((n >= 2) & (turn(F.get(h, n - 2), F.get(h, n - 1), p) <= 0), F.slice(h, 1, F.greatest(n - 1, F.lit(0)))).otherwise(h)

        return F.aggregate(F.sequence(F.lit(0), F.size(chain)), chain, last)

    def half(sorted_points: Column) -> Column:
        chain = F.aggregate(sorted_points, F.array().cast(RING), lambda h, p: F.concat(popped(h, p), F.array(p)))
        return bind(chain, lambda h: F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))))

    distinct = F.array_sort(F.array_distinct(bind(points, lambda r: F.when(F.size(r) > PRUNED, outside(r)).otherwise(r))))
    hull = bind(distinct, lambda d: F.when(F.size(d) >= 3, F.concat(half(d), half(F.reverse(d)))))
    return bind(hull, lambda h: F.when(F.size(h) >= 3, h))


def closed(ring: Column) -> Column:
    return bind(ring, lambda r: F.when((F.size(r) >= 3) & (F.get(r, 0) != F.element_at(r, -1)), F.concat(r, F.slice(r, 1, 1))).otherwise(r))


def to_lonlat(x: Column, y: Column, official: bool = True) -> Column:
    """Projected metres to degrees: by the band of |y| and its polynomial, or by the simple inverse of a sphere's."""
    if not official:
        lat = y / R.WORLD_HALF * 180
        return point(x / R.WORLD_HALF * 180, 180 / math.pi * (2 * F.atan(F.exp(lat * math.pi / 180)) - math.pi / 2))
    size = F.abs(y)
    constants = [F.expr(f"array({', '.join(f'{float(v)!r}D' for v in c)})") for c in R.BANDS]  # one call each: numbers one by one cost seconds
    band = F.coalesce(*[F.when(size >= limit, c) for limit, c in zip(R.BAND_LIMITS, constants)])

    def at(c: Column) -> Column:
        b = size / F.get(c, 9)
        lat = F.get(c, 2)
        power = F.lit(1.0)
        for i in range(3, 9):
            power = power * b
            lat = lat + F.get(c, i) * power
        lon = F.get(c, 0) + F.get(c, 1) * F.abs(x)
        return point(lon * F.when(x < 0, -1.0).otherwise(1.0), lat * F.when(y < 0, -1.0).otherwise(1.0))

    return bind(band, at)


def ring_to_lonlat(ring: Column, official: bool = True) -> Column:
    return closed(F.transform(ring, lambda p: to_lonlat(p["x"], p["y"], official)))


def cleaned(ring: Column) -> Column:
    """Without vertices equal to the one before and without the closing vertex."""
    some = F.filter(ring, lambda p: p.isNotNull())
    single = bind(some, lambda r: F.filter(r, lambda p, i: (i == 0) | (p != F.get(r, i - 1))))
    return bind(single, lambda r: F.when((F.size(r) > 1) & (F.get(r, 0) == F.try_element_at(r, F.lit(-1))), F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0)))).otherwise(r))


def _metres_lon(lat: Column) -> Column:
    return R.METRES_PER_DEGREE * F.cos(F.radians(lat))


def to_local(ring: Column, origin: Column) -> Column:
    return F.transform(ring, lambda p: point((p["x"] - origin["x"]) * _metres_lon(origin["y"]), (p["y"] - origin["y"]) * R.METRES_PER_DEGREE))


def from_local(ring: Column, origin: Column) -> Column:
    return F.transform(ring, lambda p: point(origin["x"] + p["x"] / _metres_lon(origin["y"]), origin["y"] + p["y"] / R.METRES_PER_DEGREE))


def outward(e: Column) -> Column:
    """Unit normal to the right of an edge; of a zero edge (0, 0)."""
    n = F.hypot(e["x"], e["y"])
    return F.when(n == 0, point(F.lit(0.0), F.lit(0.0))).otherwise(point(F.try_divide(e["y"], n), -F.try_divide(e["x"], n)))


def crossing(p: Column, d: Column, q: Column, e: Column) -> Column:
    """Where the lines through p along d and through q along e meet; null if they are parallel."""
    det = d["x"] * e["y"] - d["y"] * e["x"]
    t = F.try_divide((q["x"] - p["x"]) * e["y"] - (q["y"] - p["y"]) * e["x"], det)
    return F.when(F.abs(det) >= 1e-9, point(p["x"] + t * d["x"], p["y"] + t * d["y"]))


def offset(ring: Column, metres: float) -> Column:
    """Mitred offset of a ring in local metres; beyond three times the distance, and on collinear edges, the middle of the two moved vertices."""

    def corner(a: Column, b: Column, c: Column) -> Column:
        e, f = point(b["x"] - a["x"], b["y"] - a["y"]), point(c["x"] - b["x"], c["y"] - b["y"])
        moved = lambda p, n: point(p["x"] + n["x"] * metres, p["y"] + n["y"] * metres)

        def meet(s: Column) -> Column:
            p, q = s["p"], s["q"]
            middle = point((p["x"] + q["x"]) / 2, (p["y"] + q["y"]) / 2)
            return bind(crossing(p, s["e"], q, s["f"]), lambda m: F.when(m.isNull() | (F.hypot(m["x"] - b["x"], m["y"] - b["y"]) > 3.0 * metres), middle).otherwise(m))

        return bind(F.struct(moved(a, outward(e)).alias("p"), moved(b, outward(f)).alias("q"), e.alias("e"), f.alias("f")), meet)

    turned = bind(ring, lambda r: F.when(signed_area(r) < 0, F.reverse(r)).otherwise(r))
    corners = lambda r: F.transform(F.arrays_zip(previous(r).alias("a"), r.alias("b"), following(r).alias("c")), lambda z: corner(z["a"], z["b"], z["c"]))
    return bind(turned, corners)


def moved(ring: Column, metres: float) -> Column:
    """struct(origin, ring) of a ring of degrees moved outwards, in local metres; null if under three vertices are left of it."""
    made = lambda r: bind(mean_point(r), lambda o: F.struct(o.alias("origin"), offset(to_local(r, o), metres).alias("ring")))
    return bind(cleaned(ring), lambda r: F.when(F.size(r) >= 3, made(r)))


def buffered(ring: Column, metres: float) -> Column:
    """A ring of degrees moved outwards; empty if under three vertices are left of it.

    The offset of a concave ring can cross itself, and stays so; see untangle.with_buffers().
    """
    return bind(moved(ring, metres), lambda m: F.when(m.isNotNull(), from_local(m["ring"], m["origin"])).otherwise(F.array().cast(RING)))


def circle(x: Column, y: Column, metres: float, sides: int = R.CIRCLE_SIDES) -> Column:
    angle = lambda i: 2 * math.pi * i / sides
    return F.transform(F.sequence(F.lit(0), F.lit(sides - 1)), lambda i: point(x + metres * F.cos(angle(i)) / _metres_lon(y), y + metres * F.sin(angle(i)) / R.METRES_PER_DEGREE))
