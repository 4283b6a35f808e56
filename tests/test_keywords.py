"""Keyword automata and merged hulls against plain versions."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from atlasmill.functions import geometry as G
from atlasmill.functions import keywords as W
from atlasmill.functions import rules as R
from atlasmill.functions import text as T
from atlasmill.operators import hulls


def test_districts_equal_the_fixed_rule(spark):
    rng = random.Random(0)
    names = [k for k, _ in R.AREA_DISTRICTS] + [d[:-1] for d in R.DISTRICTS] + ["路", "号", "x", ""]
    texts = ["".join(rng.choice(names) for _ in range(rng.randrange(5))) for _ in range(400)] + [None, ""]
    found = W.districts(spark)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.district_of(F.col("t")).alias("want"), found.first(F.col("t")).alias("got"), found.any(F.col("t")).alias("any")).collect()
    assert len(rows) == len(texts) and all(r.got == r.want and r.any == (r.want is not None) for r in rows)
    generic = W.Keywords(spark, [(w, i, w) for i, w in enumerate(R.GENERIC_WORDS)])
    tried = spark.createDataFrame([("宿舍楼",), ("花园",), ("x大楼y",)], "t string")
    assert [r.a == r.b for r in tried.select(T.is_generic(F.col("t")).alias("a"), generic.any(F.col("t")).alias("b")).collect()] == [True] * 3


@pytest.mark.parametrize("limit", [W.LIMIT, 3])
def test_first_row_wins_over_several_automata(spark, limit):
    rows = [("b", "B", 5), ("ab", "AB", 2), ("abc", "ABC", 9), ("b", "again", 7), (None, "none", 0), ("é", "E", 3), ("日本", "J", 1), ("b", "earlier", 4), ("zz", None, 6)]
    table = spark.createDataFrame(rows, "keyword string, value string, place long")
    found = W.of_table(table, "keyword", "value", "place", limit)
    texts = ["abc", "xbx", "é日本b", "", None, "q", "zzz"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(found.first(F.col("t")).alias("f"), found.every(F.col("t")).alias("e")).collect()
    assert [r.f for r in got] == ["AB", "earlier", "J", None, None, None, None]
    assert [r.e for r in got] == [["AB", "earlier", "ABC"], ["earlier"], ["J", "E", "earlier"], [], None, [], [None]]
    found.release()
    empty = W.of_table(table.limit(0), "keyword", "value", "place")
    assert spark.range(1).select(empty.first(F.lit("a")).alias("f"), empty.every(F.lit("a")).alias("e"), empty.any(F.lit("a")).alias("a")).collect()[0][:] == (None, [], False)
    blank = W.Keywords(spark, [("", 4, "all"), ("a", 6, "a")])
    assert [r.f for r in spark.createDataFrame([("a",), ("",), (None,)], "t string").select(blank.first(F.col("t")).alias("f")).collect()] == ["all", "all", None]


def test_many_keywords_take_one_pass(spark):
    table = spark.range(100_000).select(F.format_string("k%06d;", "id").alias("keyword"), F.col("id").alias("place"))
    found = W.of_table(table, "keyword", "keyword", "place")
    texts = spark.range(2000).select("id", F.concat(F.repeat(F.lit("some words "), 50), F.format_string("k%06d; k%06d;", F.col("id") + 5, F.col("id"))).alias("t"))
    began = time.time()
    assert texts.where(found.first(F.col("t")) == F.format_string("k%06d;", "id")).count() == 2000
    assert time.time() - began < 60


POINTS = "k string, x double, y double, part string, hull string, i string"


def merged(spark, sets, parts=5):
    rows = [(k, float(x), float(y), "?", "?", "?") for k, points in sets.items() for x, y in points]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, POINTS).repartition(parts)
    return {r.k: r.hull and [(p.x, p.y) for p in r.hull] for r in hulls.convex_hulls(df, "k").collect()}


def test_merged_hulls_equal_the_expression(spark, monkeypatch):
    monkeypatch.setattr(hulls, "FAN", 2)
    rng = random.Random(4)
    sets = {f"r{i}": [(rng.randrange(-i, i + 1), rng.randrange(-9, 10)) for _ in range(rng.randrange(1, 80))] for i in range(1, 25)}
    sets |= {"line": [(i, 2 * i) for i in range(50)], "one": [(1, 1)] * 9, "two": [(0, 0), (1, 1)] * 20, "square": [(x, y) for x in range(20) for y in range(20)], "zero": [(0.0, 0), (-0.0, 1), (1, 0), (0.0, 1)]}
    want = {r.k: r.h and [(p.x, p.y) for p in r.h] for r in spark.createDataFrame([(k, [(float(x), float(y)) for x, y in p]) for k, p in sets.items()], f"k string, p {G.RING}").select("k", G.convex_hull(F.col("p")).alias("h")).collect()}
    assert merged(spark, sets) == want and want["line"] is None and len(want["square"]) == 4


def test_a_ring_of_a_hundred_thousand_points(spark):
    angle = np.linspace(0, 2 * np.pi, 100_000, endpoint=False)
    inside = np.random.default_rng(0).uniform(-0.5, 0.5, (100_000, 2))
    x, y = np.concatenate([np.cos(angle), inside[:, 0]]), np.concatenate([np.sin(angle), inside[:, 1]])
    df = spark.createDataFrame(__import__("pandas").DataFrame({"k": 1, "x": x, "y": y})).repartition(8)
    began = time.time()
    (row,) = hulls.convex_hulls(df, "k").select(F.size("hull").alias("n"), F.abs(G.signed_area(F.col("hull"))).alias("a")).collect()
    assert row.n > 99_000 and abs(row.a - np.pi) < 1e-6 and time.time() - began < 60


def test_points_without_a_place_and_null_keys(spark):
    rows = [(None, 0.0, 0.0), (None, 1.0, 0.0), (None, 0.0, 1.0), ("n", None, 1.0), ("n", float("nan"), 1.0), ("i", float("inf"), 1.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    assert [(r.k, len(r.hull)) for r in hulls.convex_hulls(df, "k").collect()] == [(None, 3)]
    assert hulls.convex_hulls(df.limit(0), "k").count() == 0


def test_what_a_batch_finds_is_handed_on_in_parts(spark, monkeypatch):
    """Texts that find many keywords each: a task holds the finds of some, not of a whole batch of ten thousand."""
    found = W.Keywords(spark, [(f"k{i:03d};", i, f"v{i}") for i in range(1000)])
    monkeypatch.setattr(F, "arrow_udf", lambda kind: lambda f: f)
    lookup = W._lookup(found.shared[0], False)
    text = "".join(f"k{i:03d};" for i in range(1000))
    parts = list(lookup(iter([pa.array([text] * 1000 + [None, "", "k005;k003;"])])))
    assert len(parts) > 3 and max(len(p.flatten()) for p in parts) < W.HITS + 1000 and sum(map(len, parts)) == 1003
    assert parts[-1].to_pylist()[-3:] == [None, [], [{"place": 3, "value": "v3"}, {"place": 5, "value": "v5"}]]
