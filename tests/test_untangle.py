"""Offsets of concave rings that don't cross themselves, hulls of many points, and the merge on the command line."""

import hashlib
import json
import math

import numpy as np
from pyspark.sql import functions as F

from atlasmill.__main__ import main
from atlasmill.functions import geometry as G
from atlasmill.functions import untangle as U
from atlasmill.plans import sinks as K

from test_cli import texts
from test_flow import place

M = 1 / 111320.0
NOTCH = [(0, 0), (100, 0), (100, 100), (55, 100), (55, 20), (45, 20), (45, 100), (0, 100)]  # narrower than twice an offset of 20


def grown(spark, rings, metres, simple):
    df = spark.createDataFrame([(i, [(113.9 + x * M, 22.5 + y * M) for x, y in r]) for i, r in enumerate(rings)], f"i long, r {G.RING}")
    return {r.i: np.array([(p.x, p.y) for p in r.o]).reshape(-1, 2) for r in (U.with_buffers(df, F.col("r"), metres, "o") if simple else df.withColumn("o", G.buffered(F.col("r"), metres))).collect()}


def test_options_rings_are_simple(spark):
    slanted = [(0, 0), (100, 0), (100, 100), (56, 97), (54, 20), (46, 22), (45, 100), (0, 95)]
    square, clockwise, thin = [(0, 0), (50, 0), (50, 50), (0, 50)], NOTCH[::-1], [(0, 0), (1, 1)]
    star = [(math.cos(k * math.pi / 5) * (80 if k % 2 else 15), math.sin(k * math.pi / 5) * (80 if k % 2 else 15)) for k in range(10)]
    rings = [NOTCH, slanted, square, clockwise, thin, star]
    plain, simple = grown(spark, rings, 20.0, False), grown(spark, rings, 20.0, True)
    metres = lambda r: (r - (113.9, 22.5)) / M * (math.cos(math.radians(22.5)), 1)
    assert not U.is_simple(metres(plain[0])) and not U.is_simple(metres(plain[1]))  # the default is as it was
    for i in (0, 1, 2, 3, 5):
        assert U.crossing(simple[i]) is None and U.signed_area(simple[i]) > 0 and U.is_simple(metres(simple[i]))
    assert np.allclose(simple[2], plain[2]) and len(simple[4]) == len(plain[4]) == 0
    for i in (0, 3):  # the notch is closed: what is left is a square
        span = np.ptp(metres(simple[i]), axis=0)
        assert np.allclose(span[1], 140, atol=0.1) and math.isclose(U.signed_area(metres(simple[i])), span[0] * span[1], rel_tol=1e-3)


def test_null_rings_and_loops(spark):
    df = spark.createDataFrame([(None,), ([],)], f"r {G.RING}")
    assert [r.o for r in U.with_buffers(df, F.col("r"), 5.0, "o").collect()] == [[], []]
    rows = [(0, "c", "n", '{"lon":1,"lat":2}', json.dumps([{"lon": 113.9 + x * M, "lat": 22.5 + y * M} for x, y in NOTCH]), "a", "l"), (1, "d", "n", '{"lon":1,"lat":2}', "[]", "a", "l")]
    lines = K.buffered_lines(spark.createDataFrame(rows, "seq long, code string, name string, center string, ring string, address string, label string"), 20.0, simple=True)
    notched, around = (json.loads(r.value.split("\t")[6]) for r in lines.collect())
    assert U.crossing(np.array([(p["lon"], p["lat"]) for p in notched[:-1]])) is None and notched[0] == notched[-1] and len(around) == 37
    eight = np.array([(0, 0), (2, 2), (2, 0), (0, 2)], float)  # one loop each way
    assert len(U.loops(eight)) == 1 and math.isclose(U.signed_area(U.loops(eight)[0]), 1.0)


def test_inner_points_change_no_hull(spark, monkeypatch):
    rng = np.random.default_rng(0)
    sets = [rng.normal(size=(n, 2)).round(1).tolist() for n in (65, 200, 700)] + [[(float(i), 2.0 * i) for i in range(100)], [(1.0, 1.0)] * 90, [(float(x), float(y)) for x in range(12) for y in range(12)]]
    df = spark.createDataFrame([(i, [tuple(p) for p in s]) for i, s in enumerate(sets)], f"i long, p {G.RING}")
    got = {r.i: r.h for r in df.select("i", G.convex_hull(F.col("p")).alias("h")).collect()}
    monkeypatch.setattr(G, "PRUNED", 10**9)
    assert got == {r.i: r.h for r in df.select("i", G.convex_hull(F.col("p")).alias("h")).collect()} and got[3] is None


def test_merge_and_store_on_the_command_line(spark, tmp_path, capsys):
    at = lambda name: str(tmp_path / name)
    (tmp_path / "cache").mkdir()
    key = hashlib.md5("华润大厦".encode()).hexdigest()
    (tmp_path / "cache" / f"{key}.json").write_text(json.dumps({"content": [place("华润大厦艺术中心", tag="文化;场馆"), place("华润大厦")]}), encoding="utf-8")
    files = {
        "results": "7\tn\t{}\t[]\t甲\t\n8\tm\t{}\t[]\t乙\t\n", "labels": "label\td\ts\ta\tc\nA\t福田\t\t甲\tc1\nB\t罗湖\t\t甲\tc2\nC\t罗湖\t\t乙\tc3\n", "answers": "华润大厦\t华润大厦\tc9\t商业\n",
        "failed": "华润大厦\tm\n丙\tm\n", "review": "丁\tx\td\tm\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    main(["store", at("cache"), at("store"), "--compact"])
    call = ["merge", *map(at, ("results", "labels", "answers", "store", "failed", "review")), "--store", "--accept", "房地产", "--district", "罗湖"]
    main(call)
    assert "3 lines" in capsys.readouterr().out and (tmp_path / "results").read_text(encoding="utf-8") == files["results"]
    for _ in range(2):  # and again: nothing is added twice
        main([*call, "--write"])
        rows = [line.split("\t") for line in texts(tmp_path / "results")]
        assert [(r[0], r[4], r[5]) for r in rows] == [("c2", "甲", "B"), ("c3", "乙", "C"), ("c9", "华润大厦", "商业")]
        assert texts(tmp_path / "failed") == ["丙\tm"]
        assert [line.split("\t")[0] for line in texts(tmp_path / "review")] == ["丁", "华润大厦"]


def test_plainly_convex_rings_skip_python(spark):
    """Convex rings need no loops; a star that turns left twice around, a clockwise and a concave ring, and near-flat corners are looked at."""
    star = [(math.cos(4 * math.pi * i / 5), math.sin(4 * math.pi * i / 5)) for i in range(5)]
    shapes = [
        ([(0, 0), (4, 0), (4, 4), (0, 4)], True), ([(0, 0), (4, 0), (2, 3)], True), ([(math.cos(i), math.sin(i)) for i in range(6)], True), (star, False), ([(0, 0), (0, 4), (4, 4), (4, 0)], False),
        ([(0, 0), (4, 0), (1, 1), (0, 4)], False), ([(0, 0), (2, -1e-4), (4, 0), (2, 3)], False), ([(0, 0), (4, 0)], False), ([], False), (None, False), ([(0, 0), (float("nan"), 0), (2, 3)], False),
    ]
    rows = spark.createDataFrame([(i, None if r is None else [{"x": float(x), "y": float(y)} for x, y in r]) for i, (r, _) in enumerate(shapes)], f"i int, r {G.RING}")
    got = {r.i: r.c for r in rows.select("i", U.is_convex(F.col("r")).alias("c")).collect()}
    assert got == {i: c for i, (_, c) in enumerate(shapes)}
    assert all(U.is_simple(np.array(r, float)) and U.signed_area(np.array(r, float)) > 0 for r, c in shapes if c)


def test_few_rings_are_dealt_out(spark):
    """Rings that adaptive execution would put into one task by their bytes are repaired in several."""
    df = spark.range(64, numPartitions=1).select(F.array(*[G.point(F.lit(x), F.lit(y)) for x, y in ((113.9, 22.5), (113.91, 22.5), (113.91, 22.51))]).alias("r"))
    assert U.with_buffers(df, F.col("r"), 5.0, "o").select(F.spark_partition_id().alias("t")).distinct().count() > 1
