import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from atlasmill.functions import formats as X
from atlasmill.functions import geometry as G

SQUARE = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]


def one(spark, ring, *exprs):
    return spark.createDataFrame([(ring,)], f"r {G.RING}").select(*[e.alias(f"c{i}") for i, e in enumerate(exprs)]).first()


def test_official_and_simple_coordinates(spark):
    p, q, s = one(spark, SQUARE, G.to_lonlat(F.lit(12958074.255013367), F.lit(3572218.8142307573)), G.to_lonlat(F.lit(12675065.0), F.lit(2569406.75)), G.to_lonlat(F.lit(12675065.0), F.lit(2569406.75), official=False))
    assert abs(p.x - 116.403095) < 1e-6 and abs(p.y - 30.7029839) < 1e-6
    assert 113.80 < q.x < 113.90 and 22.58 < q.y < 22.66 and abs(s.y - q.y) > 0.1


def test_hull_of_two_squares(spark):
    both = SQUARE + [(20.0, 0.0), (30.0, 0.0), (30.0, 10.0), (20.0, 10.0), (20.0, 0.0)]
    hull, center = one(spark, both, G.convex_hull(F.col("r")), G.centroid(G.convex_hull(F.col("r"))))
    assert {tuple(p) for p in hull} == {(0, 0), (30, 0), (30, 10), (0, 10)} and tuple(center) == (15, 5)


def test_hull_of_too_little(spark):
    assert one(spark, [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)], G.convex_hull(F.col("r"))).c0 is None
    assert one(spark, [(0.0, 0.0), (1.0, 1.0), (0.0, 0.0)], G.convex_hull(F.col("r"))).c0 is None


def test_degenerate_centroid_is_the_middle_of_the_box(spark):
    assert tuple(one(spark, [(0.0, 0.0), (4.0, 4.0), (2.0, 2.0)], G.centroid(F.col("r"))).c0) == (2, 2)


def test_footprint_falls_back_to_the_first_largest(spark):
    rings = [SQUARE, [(x + 20, y) for x, y in SQUARE], [(50.0, 50.0), (51.0, 50.0), (51.0, 51.0)]]
    df = spark.createDataFrame([(rings,)], f"r array<{G.RING}>")
    got = df.select(G.chosen_footprint(F.col("r"), F.lit(25.0), F.lit(5.0)).alias("a"), G.chosen_footprint(F.col("r"), F.lit(-5.0), F.lit(5.0)).alias("b"), G.chosen_footprint(F.slice("r", 1, 0), F.lit(0.0), F.lit(0.0)).alias("c")).first()
    assert tuple(got.a[0]) == (20, 0) and tuple(got.b[0]) == (0, 0) and got.c is None


def test_offset_of_a_square_with_a_collinear_vertex(spark):
    ring = [(0.0, 0.0), (5.0, 0.0), *SQUARE[1:]]
    assert {tuple(p) for p in one(spark, ring, G.offset(F.col("r"), 1.0)).c0} == {(-1, -1), (2.5, -1), (11, -1), (11, 11), (-1, 11)}


def test_clockwise_rings_grow_too(spark):
    grown, before = one(spark, SQUARE[::-1], G.area(G.offset(F.col("r"), 2.0)), G.area(F.col("r")))
    assert (grown, before) == (196, 100)


def test_expanded_range_of_nothing_is_a_closed_circle(spark):
    text = spark.range(1).select(X.expanded_range(F.lit('{"lon":114.0,"lat":22.5}'), F.lit(""), 30.0).alias("t"))
    ring = text.select(X.parsed_ring(F.col("t")).alias("r")).first().r
    assert len(ring) == 37 and ring[0] == ring[-1]
    assert all(abs(math.hypot((p.x - 114) * 111320 * math.cos(math.radians(22.5)), (p.y - 22.5) * 111320) - 30) < 1e-6 for p in ring)


def test_decimal_text(spark):
    values = {100.0: "100", 0.0: "0", 22.5: "22.5", 2.9e-9: "0.0000000029", 1e20: "100000000000000000000", 113.87715805983: "113.87715805983"}
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", X.decimal_text(F.col("v")).alias("t")).collect()
    assert {r.v: r.t for r in rows} == values


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-50, 50), st.integers(-50, 50)), min_size=3, max_size=14))
def test_hull_holds_all_points_and_its_centroid(spark, points):
    ring = [(float(x), float(y)) for x, y in points]
    hull = one(spark, ring, G.convex_hull(F.col("r"))).c0
    if hull is None:
        return
    n = len(hull)
    left = lambda p: all((hull[(i + 1) % n].x - hull[i].x) * (p[1] - hull[i].y) - (hull[(i + 1) % n].y - hull[i].y) * (p[0] - hull[i].x) >= -1e-9 for i in range(n))
    assert all(map(left, ring))
    assert left(tuple(one(spark, [tuple(p) for p in hull], G.centroid(F.col("r"))).c0))
