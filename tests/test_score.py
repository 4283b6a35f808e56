from pyspark.sql import functions as F

from atlasmill.functions import geometry as G
from atlasmill.functions import responses as P
from atlasmill.plans.resolve import Settings, ranked

RING = [[(0.0, 0.0), (1.0, 0.0), (0.5, 1.5)]]
HOME, AREA = "房地产;内部楼栋", "房地产;住宅区"
#: address -> candidates (idx, name, addr, std_tag, with polygon) and the idx that must win
CASES = {
    "香蜜楼B单元": ([(0, "香蜜楼B单元", "福田区", HOME, False), (1, "香蜜二村B单元", "福田区", HOME, False), (2, "香蜜楼", "福田区", AREA, False), (3, "香蜜楼A单元", "福田区", HOME, False)], 0),
    "远望科技项目部": ([(0, "远望科技股份项目经理部", None, "公司企业;公司", False), (1, "别处", None, "公司企业;公司", False)], 0),
    "清水河花园3栋": ([(0, "清水河花园3栋", None, HOME, True), (1, "清水河花园13栋", None, HOME, True)], 0),
    "梅林一村小区": ([(8, "梅林一村小区便利店", "梅林一村小区", "购物;便利店", True), (0, "梅林一村", None, AREA, False)], 0),
}


def totals(spark, address, candidates, **settings):
    rows = [(idx, name, addr, tag, None, None, (12675065.0, 2569406.75), RING if poly else []) for idx, name, addr, tag, poly in candidates]
    df = spark.createDataFrame([(address, rows)], f"a string, c array<{P.CANDIDATE}>")
    got = df.select(ranked(F.col("c"), F.col("a"), Settings(**settings)).alias("r")).first().r
    return [(r.candidate.idx, r.score.total, r.score.detail, r.admissible) for r in got]


def test_winners(spark):
    for address, (candidates, winner) in CASES.items():
        assert totals(spark, address, candidates)[0][0] == winner, address


def test_worked_example(spark):
    got = totals(spark, "香蜜楼B单元", [(i, n, None, t, p) for i, n, t, p in ((0, "香蜜楼B单元", HOME, True), (1, "香蜜二村B单元", HOME, False), (2, "香蜜楼", AREA, True), (3, "香蜜楼A单元", HOME, True))])
    assert [(i, t) for i, t, _, _ in got] == [(0, 75.0), (1, 50.0), (2, 45.0), (3, 35.0)]
    assert got[0][2] == "名称40/地址0/楼栋20/类型10/多边形5=75"


def test_ties_go_to_polygons_then_to_the_earlier(spark):
    got = totals(spark, "无关地址", [(0, "x", None, None, False), (1, "y", None, None, False), (2, "z", None, None, True)])
    assert [g[0] for g in got] == [2, 0, 1]


def test_bounds_guard(spark):
    assert all(g[3] for g in totals(spark, "a", [(0, "x", None, None, False)]))
    assert not any(g[3] for g in totals(spark, "a", [(0, "x", None, None, False)], bounds=(0, 0, 1, 1)))


def test_envelope(spark):
    docs = {
        "": (True, []), "{": (True, []), "   ": (False, []), '{"result":{"error":2},"content":[{"name":"x"}]}': (True, []),
        '{"content":[null,{"name":{"a":1},"addr":null,"poi_address":"p","geo":"1|2.5,3"}]}': (False, [(1, "", "p", (2.5, 3.0))]),
        '{"content":[{"name":"n","diPointX":1250,"diPointY":-300}]}': (False, [(0, "n", None, (12.5, -3.0))]),
        '{"content":[{"name":"n","diPointX":0,"diPointY":1}]}': (False, [(0, "n", None, None)]),
    }
    rows = spark.createDataFrame([(d,) for d in docs], "d string").select("d", P.envelope(F.col("d")).alias("o")).collect()
    for r in rows:
        found = [(c.idx, c.name, c.addr, tuple(c.center) if c.center else None) for c in r.o.candidates]
        assert (r.o.auth_error, found) == docs[r.d], r.d


def test_polygons(spark):
    text = "POLYGON ((0 0, 1 0, x y, 1 1));POLYGON((0 0, 1 1));POLYGON ((0 0, 4 0, 4 4, 0 4),(1 1, 2 1, 2 2));POLYGON (( 5 5 ,6 5,6 6))"
    got = spark.range(1).select(G.parsed_polygons(F.lit(text)).alias("p")).first().p
    assert [[tuple(q) for q in r] for r in got] == [[(0, 0), (1, 0), (1, 1)], [(5, 5), (6, 5), (6, 6)]]
