"""Embedded arrays in many tasks, the map page and its tiles."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from atlasmill.functions import geometry as G
from atlasmill.plans import maps
from atlasmill.plans import sinks as K
from atlasmill.sources.embedded import embedded_rows, object_texts
from atlasmill.sources.folders import scratch


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    for k in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{k}")


def page(rows, **how):
    return '<style>a{b:"}"}</style><script>var x = "[{";\nvar DATA = ' + json.dumps(rows, **how) + ';\nfunction f(){ return [{"a":"]"}]; } var DATA = [{"id":-1}];</script>'


def test_objects_are_cut_at_their_borders(spark, tmp_path, small_splits):
    rng = random.Random(3)
    odd = ['}', '{"', '"}', '\\', '\\"}', '},{', ']', '"]}', "é日本", "\n", "", "{{", "a\\\\"]
    rows = [{"id": i, "s": "".join(rng.choice(odd) for _ in range(rng.randrange(6))), "o": {"p": [{"q": rng.choice(odd)}], "e": {}}} for i in range(120)]
    for n, how in enumerate(({}, {"indent": 2}, {"ensure_ascii": False}, {"separators": (",", ":")})):
        path = tmp_path / f"p{n}.html"
        path.write_text(page(rows, **how), encoding="utf-8")
        texts = object_texts(spark, str(path), "var DATA =")
        assert spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 20
        assert [json.loads(r.value) for r in texts.orderBy("pos").collect()] == rows
        assert [r.pos for r in texts.orderBy("pos").collect()] == list(range(120))
    got = embedded_rows(spark, str(tmp_path / "p0.html"), "var DATA =", "id long, o struct<p: array<struct<q: string>>>").orderBy("pos").collect()
    assert [(r.id, r.o.p[0].q) for r in got] == [(r["id"], r["o"]["p"][0]["q"]) for r in rows]


def test_empty_missing_and_open_arrays(spark, tmp_path):
    for name, text in (("empty", "x DATA= [ ] {}"), ("none", "nothing"), ("open", 'DATA=[{"a":1},{"b":2}'), ("one", 'DATA=[ {"a":1} ]')):
        (tmp_path / name).write_text(text, encoding="utf-8")
    assert object_texts(spark, str(tmp_path / "empty"), "DATA=").count() == 0
    assert [r.value for r in object_texts(spark, str(tmp_path / "one"), "DATA=").collect()] == ['{"a":1}']
    for name, why in (("none", "no 'DATA='"), ("open", "does not end")):
        with pytest.raises(ValueError, match=why):
            object_texts(spark, str(tmp_path / name), "DATA=")


RESULTS = f"seq long, region_id long, region_name string, input_address string, center_lon double, center_lat double, polygon {G.RING}, place_type string, status string, selected_name string, score_detail string, sub_queries array<string>, message string"


def results(spark, n=60):
    rows = []
    for i in range(n):
        lon, lat = 113.8 + i * 0.011, 22.4 + (i * 7 % n) * 0.004
        ring = [(lon + dx, lat + dy) for dx, dy in ((0, 0), (0.02, 0), (0.02, 0.01), (0, 0.01), (0, 0))] if i % 3 else []
        rows.append((i, 100 + i, f"名{i}</script>", f"a{i}", None if i == 5 else lon, lat, ring, "t", "成功" if i % 2 else "低置信度", None, "d", [f"a{i}", "b"], None))
    return spark.createDataFrame(rows, RESULTS)


def test_page_holds_every_row_and_its_views(spark):
    text = K.map_page(results(spark), 'a"<b', "k'")
    assert text.count("</script>") == 1 and "<title>a&quot;&lt;b</title>" in text
    data = json.loads(re.search(r"const DATA=(.*?);const view", text, re.S).group(1))
    assert len(data) == 59 and data[1]["polygon"][2] == [113.8 + 0.011 + 0.02, 22.4 + 7 * 0.004 + 0.01] and data[0]["polygon"] == [] and data[0]["subs"] == "a0 | b"
    sets = [json.loads(m) for m in re.findall(r"data-set='(.*?)'", text.replace("&quot;", '"'))]
    assert sets == [["status", None], ["status", "成功"], ["status", "低置信度"], ["boundary", None], ["boundary", True], ["boundary", False]]


def test_tiles_hold_what_touches_them(spark):
    df = results(spark)
    path = scratch(spark, "tiles")
    maps.write_tiles(df, path, range(8, 15))
    found = spark.read.parquet(path)
    assert {r.level for r in found.select("level").distinct().collect()} == set(range(8, 15))
    assert all(r.n == 59 for r in found.groupBy("level").agg(F.countDistinct("seq").alias("n")).collect())
    # the tiles of a level below a tile have what the tile has
    for level in range(8, 14):
        for r in found.where(F.col("level") == level).groupBy("quadkey").agg(F.collect_set("seq").alias("s")).collect():
            below = maps.tile(spark, path, level + 1, r.quadkey).agg(F.collect_set("seq").alias("s")).first().s
            assert set(below) == set(r.s)
    key = found.where("level = 14 and seq = 7").first().quadkey
    plan = maps.tile(spark, path, 14, key)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "EqualTo(quadkey" in plan
    assert found.where("level = 14 and seq = 7").first().boundary and not found.where("level = 14 and seq = 6").first().boundary


def test_places_at_the_ends_of_the_world(spark):
    rows = [(1, -180.0, 90.0), (2, 180.0, -90.0), (3, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "k long, lon double, lat double")
    x, y = maps.tile_place(F.col("lon"), F.col("lat"), 3)
    got = {r.k: r.q for r in df.select("k", maps.quadkey(F.floor(x), F.floor(y), 3).alias("q")).collect()}
    assert got == {1: "000", 2: "333", 3: "300"}
