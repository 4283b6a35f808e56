import hashlib
import json

import pytest
from pyspark.sql import functions as F

from atlasmill.__main__ import main, settings
from atlasmill.plans import enrich as E
from atlasmill.plans.resolve import Settings

from test_flow import X, place


def texts(folder):
    return [line for p in sorted(folder.glob("part-*")) for line in p.read_bytes().decode().split("\r\n") if line]


def test_flows_over_files(spark, tmp_path, capsys):
    at = lambda name: str(tmp_path / name)
    (tmp_path / "cache").mkdir()
    for name in ("领秀花园E栋", "红岭花园1栋"):
        key = hashlib.md5(name.encode()).hexdigest()
        (tmp_path / "cache" / f"{key}.json").write_text(json.dumps({"content": [place(name)]}), encoding="utf-8")
    (tmp_path / "addresses.txt").write_text("地址\n领秀花园E栋\n红岭花园1、2栋\n", encoding="utf-8")
    (tmp_path / "c.properties").write_text("region.id.start=7\nmatch.score.threshold=\ncache.dir=" + at("cache") + "\n" + "".join(f"{k}.path={at(v)}\n" for k, v in (("input", "addresses.txt"), ("output", "output"), ("failed", "failed"), ("review", "review"), ("html", "map.html"))))
    main(["resolve", "--config", at("c.properties")])
    rows = [line.split("\t") for line in texts(tmp_path / "output")]
    assert [(r[0], r[1], r[4]) for r in rows] == [("7", "领秀花园E栋", "内部楼栋"), ("8", "红岭花园1、2栋", "内部楼栋")]
    assert texts(tmp_path / "failed") == [] and len(texts(tmp_path / "review")) == 1 and "领秀" in (tmp_path / "map.html").read_text(encoding="utf-8")
    (tmp_path / "labels.tsv").write_text("label\td\ts\ta\tc\n住宅\t福田\t\t领秀花园E栋\t11\n商业\t福田\t\t领秀花园E栋\t12\n", encoding="utf-8")
    main(["enrich", at("output"), at("addresses.txt"), at("labels.tsv"), at("six")])
    assert not (tmp_path / "six").exists() and "红岭花园1、2栋" in capsys.readouterr().out
    main(["enrich", at("output"), at("addresses.txt"), at("labels.tsv"), at("six"), "--write"])
    assert [line.split("\t")[4:] for line in texts(tmp_path / "six")] == [["领秀花园E栋", "住宅/商业"], ["红岭花园1、2栋", ""]]
    for _ in range(2):  # in place, and again
        main(["buffer", at("six"), "25", "--write"])
    assert [len(line.split("\t")) for line in texts(tmp_path / "six")] == [7, 7]
    assert "lon" in texts(tmp_path / "six")[0].split("\t")[6]


def test_settings_keep_defaults_for_bad_values():
    base = {"city": "x", "match.score.threshold": 5, "region.id.start": 1, "coord.algorithm": "OFFICIAL", "strict": False}
    assert settings(base | {"bounds": "1,2,x"}).bounds == Settings.bounds and settings(base | {"bounds": "1,2,3,4"}).bounds == (1, 2, 3, 4)
    assert settings(base | {"bounds": ""}).official and not settings(base | {"bounds": "", "coord.algorithm": "simple"}).official


def test_merge_of_further_results(spark):
    labels = spark.createDataFrame([(0, "A", "甲", "福田", "c1"), (1, "B", "甲", "罗湖", "c2"), (2, "C", "乙", "罗湖", "c3")], "seq long, label string, address string, district string, code string")
    rows = spark.createDataFrame([(0, "7", "n", "{}", "[]", "甲", ""), (1, "8", "m", "{}", "[]", "乙", "")], "seq long, code string, name string, center string, ring string, address string, label string")
    recoded = E.recoded(rows, labels, preferred=F.col("district") == "罗湖")
    assert [(r.code, r.label) for r in recoded.orderBy("seq").collect()] == [("c2", "B"), ("c3", "C")]
    raw = json.dumps({"content": [place("华润大厦艺术中心", tag="文化;场馆"), place("华润大厦", x=X + 9)]})
    answers = spark.createDataFrame([(0, "华润大厦", "华润大厦", raw, "c9", "商业")], "seq long, address string, query string, raw string, code string, label string")
    extra = E.additions(answers, Settings(accept=lambda c: c["std_tag"].startswith("房地产")))
    assert extra.first().name == "华润大厦" and extra.first().ring.count("lon") == 5
    twice = E.merged(E.merged(recoded, extra), extra)
    assert [r.code for r in twice.orderBy("seq").collect()] == ["c2", "c3", "c9"]
    failed = spark.createDataFrame([("华润大厦", "m"), ("丙", "m")], "address string, message string")
    assert [r.address for r in E.still_failed(failed, extra).collect()] == ["丙"]
    with pytest.raises(Exception, match="no result"):
        E.additions(answers.withColumn("raw", F.lit("{}"))).collect()
