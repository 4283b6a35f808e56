import pytest
from pyspark.sql import functions as F

from atlasmill.functions import text as T

EXPANDED = {
    "佳兆业中心A、B座": ["佳兆业中心A座", "佳兆业中心B座"],
    "统建楼办公楼1栋、2栋、3栋、4栋": [f"统建楼办公楼{i}栋" for i in (1, 2, 3, 4)],
    "飞扬时代大厦A、B座": ["飞扬时代大厦A座", "飞扬时代大厦B座"],
    "安华工业区9栋A单元、8栋、7栋": ["安华工业区9栋A单元", "安华工业区8栋", "安华工业区7栋"],
    "韵动家园AB栋": ["韵动家园A栋", "韵动家园B栋"],
    "龙珠军苑A,B栋": ["龙珠军苑A栋", "龙珠军苑B栋"],
    "中海华庭华景峰1/2座": ["中海华庭华景峰1座", "中海华庭华景峰2座"],
    "名仕春天A/C座": ["名仕春天A座", "名仕春天C座"],
    "前海天境花园1-4栋": [f"前海天境花园{i}栋" for i in (1, 2, 3, 4)],
    "红岭大厦1、2栋": ["红岭大厦1栋", "红岭大厦2栋"],
    "香珠花园A、B": ["香珠花园A", "香珠花园B"],
    "领秀花园E栋": ["领秀花园E栋"],
    "福田区华强北街道上步中路1001号科技大厦": ["福田区华强北街道上步中路1001号科技大厦"],
    "创业花园248,249.250栋（连体）": ["创业花园248栋", "创业花园249栋", "创业花园250栋"],
    "太平洋商贸大厦A座、B座（相连）": ["太平洋商贸大厦A座", "太平洋商贸大厦B座"],
    # beyond the span a range is its two ends
    "花园小区1-20栋": ["花园小区1栋", "花园小区20栋"],
    # two numbers are a range whatever stands between them
    "花园小区1/5座": [f"花园小区{i}座" for i in range(1, 6)],
    # these four are no numerals, so the list stays whole
    "丁栋、丙栋、乙栋、甲栋": ["丁栋、丙栋、乙栋、甲栋"],
    "香蜜新村5栋一、二、三单元": ["香蜜新村5栋一单元", "香蜜新村5栋二单元", "香蜜新村5栋三单元"],
    # an acronym before a suffix is taken for letters
    "国际中心IBC座": ["国际中心I座", "国际中心B座", "国际中心C座"],
    # an address that isn't split keeps its alias
    "领秀花园E栋（连体）": ["领秀花园E栋（连体）"],
    "红岭大厦1、2栋、": ["红岭大厦1栋", "红岭大厦2栋"],
    "园A、B座": ["园A、B座"],
    "（别名）": ["（别名）"],
}


def test_expansion(spark):
    rows = spark.createDataFrame([(a,) for a in EXPANDED], "a string").select("a", T.expanded(F.col("a")).alias("e")).collect()
    assert {r.a: r.e for r in rows} == EXPANDED


@pytest.mark.parametrize(("x", "want"), [("ABC12345", "ABC1"), ("花园9栋A单元", "花园"), ("花园", None), ("12", None)])
def test_stripped_prefix(spark, x, want):
    got = spark.range(1).select(T.stripped_prefix(F.lit(x)).alias("p")).first().p
    assert got == want


def test_tokens_and_runs(spark):
    row = spark.range(1).select(
        T.unit_tokens(F.lit("香蜜楼3栋B单元二单元")).alias("u"), T.effective_runs(F.lit("宿舍楼1福田区2停车场大门口")).alias("r"), T.is_subsequence(F.lit("ace"), F.lit("abcde")).alias("s"),
        T.is_subsequence(F.lit("aec"), F.lit("abcde")).alias("n"), T.has_bounded(F.lit("花园13栋"), F.array(F.lit("3栋"))).alias("b"), T.cjk_length(F.lit("a栋b座")).alias("c"), T.control_trim(F.lit("\t　x　 \r")).alias("t"),
    ).first()
    assert row.u == ["3栋", "B单元", "二单元"] and row.r == ["福田区", "停车场大门口"]
    assert row.s and not row.n and not row.b and row.c == 2 and row.t == "　x　"
