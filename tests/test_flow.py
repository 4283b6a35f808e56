import json

import pytest
from pyspark.sql import functions as F

from atlasmill import operators as O
from atlasmill import sources as Z
from atlasmill.functions import geometry as G
from atlasmill.operators import enrich as N
from atlasmill.plans import sinks as K
from atlasmill.plans.resolve import Settings, resolve

X, Y = 12675065.0, 2569406.0


def place(name, x=X, y=Y, ring=True, city="深圳市", tag="房地产;内部楼栋", center=True):
    detail = {}
    if center:
        detail["navi_xy"] = {"diPoint": {"x": str(x), "y": y}}
    if ring:
        corners = [(x - 5, y - 5), (x + 5, y - 5), (x + 5, y + 5), (x - 5, y + 5)]
        detail["guoke_geo_bud"] = {"bud_geom": "POLYGON ((" + ", ".join(f"{a} {b}" for a, b in corners) + "))"}
    return {"name": name, "std_tag": tag, "city_name": city, "ext": {"detail_info": detail}}


def run(spark, addresses, answers, **settings):
    inputs = spark.createDataFrame(list(enumerate(addresses)), "seq long, address string")
    rows = [(q, json.dumps({"result": {"error": 0}, "content": c}) if isinstance(c, list) else c) for q, c in answers.items()] or [("none", "{}")]
    responses = spark.createDataFrame(rows, "query string, raw string").select(F.md5("query").alias("query_md5"), "raw")
    return {r.input_address: r for r in resolve(inputs, responses, Settings(**settings)).collect()}


def test_statuses_ids_and_merging(spark):
    answers = {
        "领秀花园E栋": [place("领秀花园E栋", city="东莞市"), place("领秀花园E栋")],
        "红岭花园1栋": [place("红岭花园1栋")], "红岭花园2栋": [place("红岭花园2栋", x=X + 20)],
        "韵动家园A栋": [place("韵动家园A栋")], "香珠花园3栋": [place("香珠花园3栋", city="东莞市")], "坏花园1栋": "{broken", "低花园5栋": [place("甲", tag=None, ring=False)],
    }
    addresses = ["领秀花园E栋", "香珠花园3栋", "红岭花园1、2栋", " 领秀花园E栋 ", "韵动家园AB栋", "坏花园1栋", "低花园5栋", "无花园9栋"]
    got = run(spark, addresses, answers)
    assert len(got) == 7
    assert {a: r.status for a, r in got.items()} == {"领秀花园E栋": "成功", "香珠花园3栋": "失败", "红岭花园1、2栋": "成功", "韵动家园AB栋": "低置信度", "坏花园1栋": "失败", "低花园5栋": "低置信度", "无花园9栋": "失败"}
    assert {a: r.region_id for a, r in got.items()} == {"领秀花园E栋": 10124, "香珠花园3栋": 10125, "红岭花园1、2栋": 10125, "韵动家园AB栋": 10126, "坏花园1栋": 10127, "低花园5栋": 10127, "无花园9栋": 10128}
    assert got["领秀花园E栋"].score_detail.endswith("（已跳过1个市外/越界候选）") and got["领秀花园E栋"].message is None
    assert got["红岭花园1、2栋"].region_name == "红岭花园1、2栋" and len(got["红岭花园1、2栋"].polygon) == 5
    assert got["韵动家园AB栋"].message == "部分子地址失败（1/2）"
    assert got["低花园5栋"].message.startswith("「低花园5栋」最高分 ") and got["低花园5栋"].polygon == []
    # notes of parts that failed are dropped
    assert got["香珠花园3栋"].message == "所有查询均无有效结果" and got["香珠花园3栋"].place_type == "未知"


def test_candidates_without_center_stand_at_the_origin_unless_strict(spark):
    answers = {"领秀花园E栋": [place("领秀花园E栋", center=False, ring=False)]}
    assert abs(run(spark, ["领秀花园E栋"], answers)["领秀花园E栋"].center_lon) < 1e-6
    assert run(spark, ["领秀花园E栋"], answers, strict=True)["领秀花园E栋"].status == "失败"


def test_several_parts_without_rings_take_the_first_center_unless_strict(spark):
    answers = {f"红岭花园{i}栋": [place(f"红岭花园{i}栋", x=X + 100 * i, ring=False)] for i in (1, 2)}
    loose, strict = (run(spark, ["红岭花园1、2栋"], answers, strict=s)["红岭花园1、2栋"] for s in (False, True))
    one = spark.range(1).select(G.to_lonlat(F.lit(X + 100), F.lit(Y)).alias("a"), G.to_lonlat(F.lit(X + 150), F.lit(Y)).alias("b")).first()
    assert abs(loose.center_lon - one.a.x) < 1e-9 and abs(strict.center_lon - one.b.x) < 1e-9


def test_no_input_gives_no_result(spark):
    assert run(spark, [], {}) == {}


def test_sources(spark, tmp_path):
    (tmp_path / "list.txt").write_text("地址\r\n# c\n\n 甲 \n地址\n乙\n", encoding="utf-8")
    got = Z.addresses(spark, str(tmp_path / "list.txt"), header="地址").orderBy("seq").collect()
    assert [r.address for r in got] == ["甲", "乙"]
    assert Z.addresses(spark, str(tmp_path / "none.txt"), fallback=str(tmp_path / "list.txt")).count() == 4
    (tmp_path / "cache").mkdir()
    (tmp_path / "cache" / "abc.json").write_text('{"a":\n1}')
    assert [tuple(r) for r in Z.response_cache(spark, str(tmp_path / "cache")).collect()] == [("abc", '{"a":\n1}')]
    (tmp_path / "t.tsv").write_text("h\th\th\th\th\nA\td\ts\t甲\t1\n\nB\t\t\t甲\t\n")
    assert [r.label for r in Z.labels(spark, str(tmp_path / "t.tsv")).orderBy("seq").collect()] == ["A", "B"]
    with pytest.raises(Exception, match="too few columns"):
        Z.tab_rows(spark, str(tmp_path / "t.tsv"), list("abcdef")).collect()
    (tmp_path / "m.html").write_text('<script>const DATA=[{"id":1,"n":"x"},{"id":2}];</script>')
    assert [tuple(r) for r in Z.embedded_json(spark, str(tmp_path / "m.html"), r"DATA=(\[.*\]);", "struct<id:long,n:string>").orderBy("pos").collect()] == [(0, 1, "x"), (1, 2, None)]
    (tmp_path / "p.properties").write_text("a=5\nb=\nc=x\n#d=1\nd=true\n")
    assert Z.properties(str(tmp_path / "p.properties"), {"a": 1, "b": "q", "c": 7, "d": False}) == {"a": 5, "b": "q", "c": 7, "d": True}


def test_sinks(spark, tmp_path):
    answers = {"领秀花园E栋": [place("领秀</script>花园E栋")], "低花园5栋": [place("甲", tag=None)]}
    inputs = spark.createDataFrame([(0, "领秀花园E栋"), (1, "低花园5栋"), (2, "无花园9栋")], "seq long, address string")
    rows = [(q, json.dumps({"content": c})) for q, c in answers.items()]
    results = resolve(inputs, spark.createDataFrame(rows, "q string, raw string").select(F.md5("q").alias("query_md5"), "raw")).cache()
    K.write_lines(K.result_lines(results), str(tmp_path / "out"))
    text = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.count(b"\r\n") == 2 and all(len(line.split("\t")) == 5 for line in text.decode().split("\r\n")[:-1])
    K.write_lines(K.result_lines(results), str(tmp_path / "dry"), dry_run=True)
    assert not (tmp_path / "dry").exists()
    assert K.failed_lines(results).first().value == "无花园9栋\t所有查询均无有效结果"
    assert K.review_lines(results).first().value.startswith("低花园5栋\t甲\t")
    page = K.map_page(results, "a<b", "k")
    assert "a&lt;b" in page and page.count("</script>") == 1 and len(json.loads(page.split("DATA=")[1].split(";const")[0].replace("<\\/", "</"))) == 2
    with pytest.raises(ValueError, match="over 1 rows"):
        K.map_page(results, "t", "k", max_rows=1)
    assert K.substituted("abc", [("b", "x")]) == "axc"
    with pytest.raises(ValueError, match="2 times"):
        K.substituted("abb", [("b", "x")])
    six = spark.createDataFrame([(0, "1", "n", '{"lon":114.0,"lat":22.5}', "[]", "t", "l", "old")], "seq long, a string, b string, c string, d string, e string, f string, g string")
    line = K.buffered_lines(six, 10.0).first().value.split("\t")
    assert len(line) == 7 and line[6].startswith('[{"lon":')


def test_operators(spark):
    df = spark.createDataFrame([(i, i % 3 == 0) for i in range(200_000, 200_400)] + [(5, True)], "k long, e boolean")
    ids = {r.k: r.region_id for r in O.dense_ids(df, ~F.col("e"), "k", 7).collect()}
    want, n = {}, 7
    for k, e in sorted(df.collect()):
        want[k] = n
        n += not e
    assert ids == want
    runs = spark.createDataFrame(list(enumerate([1, 1, 1, 1, 0, 1, 0, 1, 1])), "k long, v int")
    assert [r.streak for r in O.streaks(runs, F.col("v") == 1, "k", 3).orderBy("k").collect()] == [1, 2, 3, 1, 0, 1, 0, 1, 2]
    tags = spark.createDataFrame([("a;b", None), ("a;", "x"), ("", "s"), (None, None)], "t string, s string")
    assert [r[0] for r in tags.select(O.place_type(F.col("t"), F.col("s"))).collect()] == ["b", "a;", "s", "未知"]


def test_enrichment(spark):
    labels = spark.createDataFrame([(0, "A", "甲", "1"), (1, "B", "甲", "2"), (2, "A", "甲", "3"), (3, "C", "乙", "4")], "seq long, label string, address string, code string")
    results = spark.createDataFrame([("甲",), ("丙",)], "address string")
    assert {tuple(r) for r in N.with_labels(results, labels).collect()} == {("甲", "A/B"), ("丙", "")}
    assert [r.address for r in N.unlabelled(results, labels).collect()] == ["丙"]
    assert N.with_codes(results.where("address = '甲'"), labels, preferred=F.col("label") == "B").first().code == "2"
    with pytest.raises(Exception, match="no label row"):
        N.with_codes(results, labels).collect()
    with pytest.raises(ValueError):
        N.same_count(labels, results)
    a = spark.createDataFrame([(1, "x"), (2, "y")], "seq long, v string")
    b = spark.createDataFrame([(7, "x"), (8, "z"), (9, "w")], "seq long, v string")
    assert sorted(map(tuple, N.misaligned(a, b, "v", "seq").collect())) == [(1, "y", "z"), (2, None, "w")]


def test_streaming_extension(spark, tmp_path):
    from atlasmill.streaming import address_stream, outcomes

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("红岭花园1、2栋\n# x\n", encoding="utf-8")
    responses = spark.createDataFrame([("红岭花园1栋", json.dumps({"content": [place("红岭花园1栋")]}))], "q string, raw string").select(F.md5("q").alias("query_md5"), "raw")
    stream = outcomes(address_stream(spark, str(tmp_path / "in")), responses)
    run = stream.select("sub", "answered").writeStream.format("memory").queryName("parts").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    run.awaitTermination(120)
    assert {tuple(r) for r in spark.table("parts").collect()} == {("红岭花园1栋", True), ("红岭花园2栋", False)}
