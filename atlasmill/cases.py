"""Further registered queries: documented cases of splitting and scoring, repeated responses, reports and updates.

Each row of a given table picks a case by its key; the SQL states what the case must give.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atlasmill import operators as O
from atlasmill import streaming
from atlasmill.functions import geometry as G
from atlasmill.functions import keywords as W
from atlasmill.functions import rules as R
from atlasmill.functions import text as T
from atlasmill.functions.untangle import with_buffers
from atlasmill.operators import enrich as N
from atlasmill.operators import hulls
from atlasmill.plans import enrich as E
from atlasmill.plans import maps
from atlasmill.plans import sinks as K
from atlasmill.plans.resolve import Settings, candidate_lines, chosen, empty_streaks, resolve, sub_queries
from atlasmill.queries import ORACLE_SQL, event_responses, part_addresses, part_responses, query, response_fields, table, text, vector_rings
from atlasmill.sources import address_rows, bad_rows, tab_rows_apart
from atlasmill.sources.embedded import embedded_rows
from atlasmill.sources.folders import scratch
from atlasmill.sources.store import ResponseStore

# Addresses and the parts that they must be split into.
SPLITS = [
    ("佳兆业中心A、B座", "佳兆业中心A座|佳兆业中心B座"), ("统建楼办公楼1栋、2栋、3栋、4栋", "统建楼办公楼1栋|统建楼办公楼2栋|统建楼办公楼3栋|统建楼办公楼4栋"), ("飞扬时代大厦A、B座", "飞扬时代大厦A座|飞扬时代大厦B座"),
    ("安华工业区9栋A单元、8栋、7栋", "安华工业区9栋A单元|安华工业区8栋|安华工业区7栋"), ("韵动家园AB栋", "韵动家园A栋|韵动家园B栋"), ("龙珠军苑A,B栋", "龙珠军苑A栋|龙珠军苑B栋"), ("中海华庭华景峰1/2座", "中海华庭华景峰1座|中海华庭华景峰2座"),
    ("名仕春天A/C座", "名仕春天A座|名仕春天C座"), ("前海天境花园1-4栋", "前海天境花园1栋|前海天境花园2栋|前海天境花园3栋|前海天境花园4栋"), ("红岭大厦1、2栋", "红岭大厦1栋|红岭大厦2栋"), ("香珠花园A、B", "香珠花园A|香珠花园B"), ("领秀花园E栋", "领秀花园E栋"),
    ("福田区华强北街道上步中路1001号科技大厦", "福田区华强北街道上步中路1001号科技大厦"), ("创业花园248,249.250栋（连体）", "创业花园248栋|创业花园249栋|创业花园250栋"), ("太平洋商贸大厦A座、B座（相连）", "太平洋商贸大厦A座|太平洋商贸大厦B座"),
]
_HOUSE, _AREA = "房地产;内部楼栋", "房地产;住宅区"
# Address, candidates (name, address, tag, with a polygon), the name that must come first.
RANKED = [
    ("香蜜楼B单元", [("香蜜楼", "福田区香蜜湖街道XX路", _AREA, True), ("香蜜楼B单元", "福田区香蜜湖街道XX路", _HOUSE, True), ("香蜜二村B单元", "福田区XX路", _AREA, False), ("香蜜楼A单元", "福田区香蜜湖街道XX路", _HOUSE, True)], "香蜜楼B单元"),
    ("保利花园4栋", [("保利城花园-4栋", "深圳市南山区保利城花园3-4号楼", _HOUSE, True), ("保利招商龙誉花园-4栋", "深圳市龙华区新区大道", _HOUSE, True), ("保利城花园-4a栋", "广东省深圳市南山区保利城花园4a栋", _HOUSE, True), ("保利明玥澜岸花园东区-4栋", "深圳市坪山区禾瑞路宝达科技园", _HOUSE, True)], "保利城花园-4栋"),
    ("好望角B2栋", [("富通好旺角一期-B2栋", "广东省深圳市宝安区创业一路富通·好旺角", _HOUSE, True), ("B2栋", "深圳市坪山区果园路与水库路交叉路口往西北约50米", _HOUSE, True), ("深圳好望角信息科技有限公司", "深圳龙岗区赛格导航科技园翠宝路28号1楼", _AREA, False)], "富通好旺角一期-B2栋"),
    ("裕安一路西延工程项目部", [("中交第二航务局工程有限公司裕安一路西延工程项目经理部", "深圳市宝安区金科路与裕安西路交叉路口往西南约290米", _AREA, False), ("天健坪山业通一路市政工程项目部", "深圳市坪山区秀明北路欣安楼东南侧约190米", _AREA, True)], "中交第二航务局工程有限公司裕安一路西延工程项目经理部"),
    ("信义学校宿舍楼", [("宿舍楼", "深圳市坪山区某路", _AREA, False), ("香港培侨书院龙华信义学校-陪读楼", "深圳市龙华区民治街道", _HOUSE, True)], "香港培侨书院龙华信义学校-陪读楼"),
    ("水榭花都听水居3栋", [("香蜜湖水榭花都-听水居3栋", "深圳市福田区香蜜湖路", _HOUSE, False), ("香蜜湖水榭花都-13栋", "深圳市福田区香蜜湖路", _HOUSE, True)], "香蜜湖水榭花都-听水居3栋"),
    ("铲岛路2号缤纷世界 小区A1-1", [("三津汤包(铲岛路店)", "广东省深圳市宝安区福中福社区铲岛路2号缤纷世界花园F栋F-133B", "美食;小吃快餐店", True), ("碧海富通城1期-A1栋", "广东省深圳市宝安区铲岛路2-41号", _HOUSE, True)], "碧海富通城1期-A1栋"),
]


def picked(key: str, values: list[str]) -> Column:
    """The value that a row's key chooses in turn."""
    return F.get(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values)).cast("int"))


def picked_sql(key: str, values: list[str]) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[{key} % {len(values)} + 1]"


@query(f"""SELECT p_partkey AS seq, 'x' || {picked_sql('p_partkey', [p.replace('|', '|x') for _, p in SPLITS])} AS parts FROM part""")
def t11_documented_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each documented address, made the row's own by a letter in front of it once it is split."""
    rows = O.spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(F.col("p_partkey").alias("seq"), T.expanded(picked("p_partkey", [a for a, _ in SPLITS])).alias("subs"))
    return rows.select("seq", F.array_join(F.transform("subs", lambda s: F.concat(F.lit("x"), s)), "|").alias("parts"))


def ranked_responses(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(seq, sub_pos, sub, query_md5) and (query_md5, raw) of the documented candidates."""
    def candidate(c: tuple) -> str:
        ring = ',"geo":"","ext":{"detail_info":{"navi_xy":{"diPoint":{"x":"0.5","y":"0.5"}},"guoke_geo_bud":{"bud_geom":"POLYGON ((0 0, 1 0, 1 1, 0 0))"}}}' if c[3] else ""
        return f'{{"name":"{c[0]}","addr":"{c[1]}","std_tag":"{c[2]}"{ring}}}'

    raws = ['{"content":[' + ",".join(map(candidate, cs)) + "]}" for _, cs, _ in RANKED]
    rows = O.spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(F.col("p_partkey").alias("seq"), F.lit(0).alias("sub_pos"), picked("p_partkey", [a for a, _, _ in RANKED]).alias("sub"), F.col("p_partkey").cast("string").alias("query_md5"), picked("p_partkey", raws).alias("raw"))
    return rows.drop("raw"), rows.select("query_md5", "raw")


@query(f"""SELECT p_partkey AS seq, {picked_sql('p_partkey', [n for _, _, n in RANKED])} AS name, CASE p_partkey % 7 WHEN 0 THEN 75.0 WHEN 3 THEN 43.0 END::DOUBLE AS total FROM part""")
def c08_documented_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate that comes first, and the total where one is documented."""
    lines = candidate_lines(*ranked_responses(spark, sf_dir)).where("rank = 0")
    return lines.select("seq", "name", F.when((F.col("seq") % 7).isin(0, 3), F.col("total").cast("double")).alias("total"))


@query(ORACLE_SQL["resolve_addresses"])
def s05_repeated_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole flow over a store in which every response is there twice, and before it one that reports an error."""
    raws = part_responses(spark, sf_dir)
    kept = raws.withColumn("stored_at", F.lit(2).cast("long"))
    failed = raws.select("query_md5", F.lit('{"result":{"error":9},"content":[{"name":"z"}]}').alias("raw"), F.lit(1).cast("long").alias("stored_at"))
    found = resolve(part_addresses(spark, sf_dir), failed.unionByName(kept).unionByName(kept))
    return found.select("seq", F.col("region_id").cast("long"), F.round("center_lon", 6).alias("lon"), F.round("center_lat", 6).alias("lat"), "status", "place_type", F.size("polygon").cast("long").alias("n_points"))


@query("""
SELECT p_partkey AS seq, CASE p_partkey % 6 WHEN 2 THEN '部分子地址失败（1/' || (CASE WHEN p_size % 15 + 1 <= 12 THEN p_size % 15 + 2 ELSE 2 END) || '）' ELSE '' END AS partial,
  p_partkey % 6 = 4 AS low, CASE p_partkey % 6 WHEN 2 THEN '第' || p_partkey || '号花园1栋' ELSE '甲' END AS selected_name FROM part WHERE p_partkey % 6 IN (2, 4)
""")
def k03_review_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review report's lines, and of the message whether parts failed and a score is low."""
    p = lambda i: F.get(F.split("value", "\t", -1), F.lit(i))
    lines = K.review_lines(resolve(part_addresses(spark, sf_dir), part_responses(spark, sf_dir)))
    return lines.select(F.regexp_extract(p(0), "第([0-9]+)号", 1).cast("long").alias("seq"), F.regexp_extract(p(3), "部分子地址失败（[^）]*）", 0).alias("partial"), p(3).contains("低于阈值").alias("low"), p(1).alias("selected_name"))


@query("""
SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN '成功' WHEN 1 THEN '成功' ELSE '低置信度' END AS status, CASE WHEN p_partkey % 6 = 4 THEN 0 ELSE 5 END::BIGINT AS n_points FROM part WHERE p_partkey % 6 IN (0, 1, 2, 4)
""")
def d10_map_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map's JSON objects, read back."""
    rows = K.map_rows(resolve(part_addresses(spark, sf_dir), part_responses(spark, sf_dir))).select(F.from_json("value", "input string, status string, polygon array<array<double>>").alias("r"))
    return rows.select(F.regexp_extract("r.input", "第([0-9]+)号", 1).cast("long").alias("id"), "r.status", F.size("r.polygon").cast("long").alias("n_points"))


@query("""
SELECT s_suppkey, 7 AS columns, 'c' || s_suppkey AS code, 'a' || s_suppkey AS address, s_suppkey % 3 = 0 AS around_zero FROM supplier
""")
def k06_buffered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six columns and the expanded range; a row without a centre has its circle around (0, 0)."""
    k = F.col("s_suppkey")
    none = k % 3 == 0
    center = F.when(none, "").otherwise(text('{"lon":', F.lit(113.9) + k / 100000.0, ',"lat":22.5}'))
    rows = table(spark, sf_dir, "supplier").select(k.alias("seq"), text("c", k).alias("code"), text("n", k).alias("name"), center.alias("center"), F.lit("").alias("ring"), text("a", k).alias("address"), F.lit("l").alias("label"))
    p = F.split("value", "\t", -1)
    found = K.buffered_lines(rows, 1000.0).select(p.alias("p"))
    ring = F.get("p", F.lit(6))
    return found.select(F.substring(F.get("p", F.lit(0)), 2, 20).cast("long").alias("s_suppkey"), F.size("p").alias("columns"), F.get("p", F.lit(0)).alias("code"), F.get("p", F.lit(4)).alias("address"), (F.abs(F.get(F.from_json(ring, "array<struct<lon:double,lat:double>>"), 0)["lon"]) < 1).alias("around_zero"))


@query("""SELECT count(DISTINCT o_custkey) AS n FROM orders""")
def a12_distinct_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.distinct_keys(table(spark, sf_dir, "orders"), "o_custkey")


@query("""
WITH c AS (SELECT c_name, row_number() OVER (ORDER BY c_custkey) AS pos FROM customer), r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS pos FROM customer)
SELECT c_custkey AS seq, c_name AS code, 'l' || c_custkey AS label FROM r JOIN c USING (pos)
""")
def j06_updated_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and labels by place; the rows that name them have other order numbers, in the same order."""
    customer = table(spark, sf_dir, "customer")
    rows = customer.select((F.col("c_custkey") * 3 + 1).alias("seq"), F.col("c_name").alias("code"), text("l", F.col("c_custkey")).alias("label"))
    return E.coded_regions(customer.select(F.col("c_custkey").alias("seq")), rows)


@query("""SELECT c_custkey, CASE WHEN length(c_name) > 10 THEN left(c_name, 10) || '…' ELSE c_name END AS short, 'a+b%2F' || c_custkey || '%E6%A5%BC' AS encoded FROM customer""")
def t26_short_and_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T24, T26."""
    return table(spark, sf_dir, "customer").select("c_custkey", T.abbreviated(F.col("c_name"), 10).alias("short"), T.url_encoded(text("a b/", F.col("c_custkey"), "楼")).alias("encoded"))


@query("""SELECT p_partkey AS seq, trim(p_name) AS address FROM part WHERE p_partkey % 4 IN (0, 1)""")
def p03_address_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control characters around, comments, and the header wherever it stands."""
    r = F.col("p_partkey") % 4
    line = F.when(r == 0, text("\t ", F.col("p_name"), "\x01")).when(r == 1, F.col("p_name")).when(r == 2, text(" #", F.col("p_name"))).otherwise(F.lit(" 地址 "))
    return address_rows(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), line.alias("address")), "地址")


@query("""SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 0 END AS inside FROM embeddings""")
def p14_boundary_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a point lies in a row's own square, borders as the ray cast has them."""
    k = F.col("vec_id").cast("double")
    square = F.array(G.point(k, k), G.point(k + 4, k), G.point(k + 4, k + 4), G.point(k, k + 4))
    x = F.when(F.col("vec_id") % 3 == 0, k + 1).when(F.col("vec_id") % 3 == 1, k - 1).otherwise(k + 5)
    return table(spark, sf_dir, "embeddings").select("vec_id", G.contains(square, x, k + 2).cast("int").alias("inside"))


@query("""
WITH k AS (SELECT p_partkey k, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 1 END AS empty FROM part), m AS (SELECT *, max(CASE WHEN empty = 0 THEN k END) OVER (ORDER BY k) AS last FROM k)
SELECT k AS seq, CASE WHEN empty = 0 THEN 0 ELSE (k - coalesce(last, (SELECT min(k) - 1 FROM k)) - 1) % 3 + 1 END::BIGINT AS streak FROM m
""")
def w05_streaks_of_the_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W05, over the flow's own outcomes: every fifth query has a candidate."""
    inputs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), text("第", F.col("p_partkey"), "号大门").alias("address"))
    subs = sub_queries(inputs)
    raws = subs.select("query_md5", F.when(F.col("seq") % 5 == 0, '{"content":[{"name":"x"}]}').otherwise('{"content":[]}').alias("raw"))
    return empty_streaks(chosen(subs, raws, Settings()), 3).select("seq", F.col("streak").cast("long"))


@query("""SELECT o_orderkey, o_custkey FROM orders""")
def a13_aligned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table against its own rows dealt anew; the first difference would raise."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return N.aligned(orders, orders.repartition(7, "o_custkey"), "o_custkey", "o_orderkey")


def stored(spark: SparkSession, *batches: DataFrame) -> ResponseStore:
    """A new store with the batches appended one after the other."""
    store = ResponseStore(spark, scratch(spark, "responses"))
    for batch in batches:
        store.append(batch)
    return store


@query(ORACLE_SQL["d01_response_fields"])
def d01_stored_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fields, read from shredded objects; each response is stored under its event's number."""
    store = stored(spark, event_responses(spark, sf_dir).select(F.col("event_id").cast("string").alias("query_md5"), "raw"))
    return response_fields(store.lookup().select(F.col("query_md5").cast("long").alias("event_id"), F.col("outcome").alias("o")))


@query(ORACLE_SQL["resolve_addresses"])
def j01_answers_before_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors stored before answers, after them, and alone where no answer would pass the guards; then compacted."""
    answers = part_responses(spark, sf_dir).withColumn("stored_at", F.lit(5).cast("long")).persist(StorageLevel.MEMORY_AND_DISK)  # derived once, stored three times
    alone = sub_queries(part_addresses(spark, sf_dir)).where("seq % 6 = 3").select("query_md5")
    located = answers.join(alone, "query_md5", "left_anti")
    error = lambda at, raw: answers.select("query_md5", F.lit(raw).alias("raw"), F.lit(at).cast("long").alias("stored_at"))
    store = stored(spark, error(1, "{broken"), located, error(9, '{"result":{"error":9},"content":[{"name":"z"}]}'))
    answers.unpersist()
    store.compact()
    store.prune()
    found = resolve(part_addresses(spark, sf_dir), store.lookup())
    return found.select("seq", F.col("region_id").cast("long"), F.round("center_lon", 6).alias("lon"), F.round("center_lat", 6).alias("lat"), "status", "place_type", F.size("polygon").cast("long").alias("n_points"))


@query("""
WITH w AS (SELECT item_id, unnest(string_split(text, ' ')) AS word, unnest(range(len(string_split(text, ' ')))) AS pos FROM benchmark),
k AS (SELECT word, min(item_id * 100000 + pos) AS place, arg_min('b' || item_id, item_id * 100000 + pos) AS value FROM w WHERE word <> '' GROUP BY word)
SELECT doc_id, (SELECT arg_min(value, place) FROM k WHERE contains(coalesce(d.text, ''), word)) AS value, (SELECT count(*) FROM k WHERE contains(coalesce(d.text, ''), word)) AS found FROM documents d
""")
def j08_keyword_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all benchmark texts as a table of keywords, found in every document by an automaton."""
    words = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", " ", -1)).alias("pos", "word")).where("word <> ''")
    listed = W.of_table(words.select("word", text("b", F.col("item_id")).alias("value"), (F.col("item_id") * 100000 + F.col("pos")).alias("place")), "word", "value", "place")
    body = T.or_empty("text")
    return table(spark, sf_dir, "documents").select("doc_id", listed.first(body).alias("value"), F.size(listed.every(body)).cast("long").alias("found"))


@query("""
SELECT p_partkey AS seq, CASE WHEN p_partkey % 6 IN (2, 4) THEN '低置信度' ELSE '成功' END AS status, p_partkey % 6 <> 4 AS boundary FROM part WHERE p_partkey % 6 IN (2, 4) OR p_partkey % 6 < 2
""")
def p14_boundary_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results by status and by whether they have a ring of three or more points; the views are disjoint and put together."""
    results = resolve(part_addresses(spark, sf_dir), part_responses(spark, sf_dir))
    views = [O.shown(results, status, has).select("seq", "status", F.lit(has).alias("boundary")) for status in (R.STATUS_SUCCESS, R.STATUS_LOW) for has in (True, False)]
    return reduce(DataFrame.unionByName, views)


@query(f"""
WITH p AS (SELECT vec_id % 10 AS k, embedding[2 * i - 1]::DOUBLE AS x, embedding[2 * i]::DOUBLE AS y FROM embeddings, range(1, 33) t(i) WHERE i <= len(embedding) // 2),
b AS (SELECT k, max(x) AS x1, min(x) AS x0, max(y) AS y1, min(y) AS y0, max(x + y) AS a1, min(x + y) AS a0, max(x - y) AS d1, min(x - y) AS d0 FROM p GROUP BY k)
SELECT k, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1, round(a0, 6) AS a0, round(a1, 6) AS a1, round(d0, 6) AS d0, round(d1, 6) AS d1, true AS holds_all FROM b
""")
def g10_merged_hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hulls of all vectors' points by the last digit of their number. SQL states the extremes that a hull
    must share with its points; holds_all says that no point is outside, by one join of points with their hull."""
    points = vector_rings(spark, sf_dir).select((F.col("vec_id") % 10).alias("k"), F.explode("ring").alias("p")).select("k", "p.x", "p.y")
    found = hulls.convex_hulls(points, "k")
    edges = lambda: G.over_edges(F.col("hull"), lambda a, b: (b["x"] - a["x"]) * (F.col("y") - a["y"]) - (b["y"] - a["y"]) * (F.col("x") - a["x"]) >= -1e-9)
    holds = points.join(found, "k").groupBy("k").agg(F.bool_and(F.forall(edges(), lambda e: e)).alias("holds_all"))
    of = lambda agg, f: F.round(agg(F.transform("hull", f)), 6)
    low, high = F.array_min, F.array_max
    measures = {"x0": of(low, lambda p: p["x"]), "y0": of(low, lambda p: p["y"]), "x1": of(high, lambda p: p["x"]), "y1": of(high, lambda p: p["y"])}
    measures |= {"a0": of(low, lambda p: p["x"] + p["y"]), "a1": of(high, lambda p: p["x"] + p["y"]), "d0": of(low, lambda p: p["x"] - p["y"]), "d1": of(high, lambda p: p["x"] - p["y"])}
    return found.join(holds, "k").select("k", *[c.alias(n) for n, c in measures.items()], "holds_all")


@query("""
WITH p AS (SELECT s_suppkey AS seq, 113.5 + (s_suppkey % 100) / 100.0 AS lon, 22.5 + (s_suppkey % 37) / 100.0 AS lat, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 0.004 END AS d FROM supplier),
l AS (SELECT *, unnest([0, 9, 14]) AS level FROM p),
b AS (SELECT *, (lon - d + 180) / 360 * pow(2, level) AS x0, (lon + d + 180) / 360 * pow(2, level) AS x1,
  (1 - ln(tan(radians(lat + d)) + 1 / cos(radians(lat + d))) / pi()) / 2 * pow(2, level) AS y0, (1 - ln(tan(radians(lat - d)) + 1 / cos(radians(lat - d))) / pi()) / 2 * pow(2, level) AS y1 FROM l),
t AS (SELECT *, unnest(range(floor(x0)::INT, floor(x1)::INT + 1)) AS x FROM b), u AS (SELECT *, unnest(range(floor(y0)::INT, floor(y1)::INT + 1)) AS y FROM t)
SELECT level, array_to_string([((x >> (level - 1 - i)) & 1) + 2 * ((y >> (level - 1 - i)) & 1) FOR i IN range(level)], '') AS quadkey, seq, d > 0 AS boundary,
  CASE WHEN d = 0 OR level = 0 THEN 0 ELSE 4 END::BIGINT AS corners FROM u
""")
def k04_map_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares and centres in the tiles of three levels; at the first a square is less than a step."""
    lon, lat = F.lit(113.5) + (F.col("s_suppkey") % 100) / 100.0, F.lit(22.5) + (F.col("s_suppkey") % 37) / 100.0
    ring = F.array(*[G.point(lon + dx, lat + dy) for dx, dy in ((-0.004, -0.004), (0.004, -0.004), (0.004, 0.004), (-0.004, 0.004))])
    results = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("seq"), F.col("s_suppkey").alias("region_id"), text("r", F.col("s_suppkey")).alias("region_name"), F.lit(R.STATUS_SUCCESS).alias("status"),
        lon.alias("center_lon"), lat.alias("center_lat"), F.when(F.col("s_suppkey") % 3 == 0, F.array().cast(G.RING)).otherwise(ring).alias("polygon"),
    )
    return maps.tiles(results, [0, 9, 14]).select("level", "quadkey", "seq", "boundary", F.size("polygon").cast("long").alias("corners"))


@query("""SELECT doc_id, text, source FROM documents""")
def s09_embedded_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as objects of one array in a page, written and cut again by many tasks."""
    folder = scratch(spark, "page")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct("doc_id", F.struct("source", F.array(F.struct("text")).alias("parts")).alias("inner"))).alias("value"))
    listed = rows.select(F.col("doc_id").alias("o"), F.concat(F.lit(" , "), F.expr("left(value, char_length(value) - 1)")).alias("value"))
    around = {-1: '<style>p{color:red}</style><script>var s="{[";var ROWS = [ {"doc_id":-1', 1 << 62: ']; function f(){ return {"a":[{}]}; '}
    page = listed.unionByName(spark.createDataFrame(list(around.items()), "o long, value string"))
    page.repartitionByRange(5, "o").sortWithinPartitions("o").select("value").write.option("lineSep", "}").text(folder)  # part files follow each other by name, and end with a brace
    found = embedded_rows(spark, folder, "ROWS =", "doc_id long, inner struct<source: string, parts: array<struct<text: string>>>")
    return found.where("doc_id >= 0").select("doc_id", F.get("inner.parts", 0)["text"].alias("text"), "inner.source")


@query("""
WITH k AS (SELECT p_partkey AS seq, p_partkey % 6 AS r, '第' || p_partkey || '号花园' AS b, CASE WHEN p_size % 15 + 1 <= 12 THEN p_size % 15 + 2 ELSE 2 END AS n FROM part WHERE p_partkey % 6 <> 5),
d AS (SELECT *, '] 名称40/地址0/楼栋20/类型10/多边形5=75' AS s FROM k)
SELECT seq, CASE r WHEN 0 THEN '[' || b || '1栋' || s || ' || [' || b || '2栋' || s WHEN 1 THEN '[' || b || 'A座' || s || ' || [' || b || 'B座' || s WHEN 2 THEN '[' || b || '1栋' || s
  WHEN 3 THEN '' ELSE '[甲] 名称0/地址0/楼栋10/类型0/多边形0=10' END AS score_detail,
  CASE r WHEN 2 THEN '部分子地址失败（1/' || n || '）' WHEN 3 THEN '所有查询均无有效结果' WHEN 4 THEN '「' || b || '大门」最高分 10 低于阈值 40' END AS message FROM d
""")
def a04_joined_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole detail and message of every result, joined over its parts in their order."""
    return resolve(part_addresses(spark, sf_dir), part_responses(spark, sf_dir)).select("seq", "score_detail", "message")


@query("""SELECT p_partkey AS seq, CASE WHEN p_partkey % 6 = 3 THEN 0 WHEN p_partkey % 6 = 4 THEN 1 ELSE 5 END::BIGINT AS corners, p_partkey % 6 <> 3 AS located FROM part WHERE p_partkey % 6 <> 5""")
def g21_simple_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G20-G23 with the option that repairs ranges: a result's square moved out keeps its corners, a centre has its circle."""
    results = resolve(part_addresses(spark, sf_dir), part_responses(spark, sf_dir)).select("seq", "polygon", "center_lon")
    grown = with_buffers(results, F.col("polygon"), 20.0, "grown").withColumn("n", F.size("grown"))
    kinds = F.when(F.col("center_lon").isNull(), 0).when(F.col("n") == 0, 1).otherwise(F.col("n") + 1)
    return grown.select("seq", kinds.cast("long").alias("corners"), F.col("center_lon").isNotNull().alias("located"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 3 THEN '2 columns, 3 expected' END AS reason, CASE WHEN o_orderkey % 7 = 3 THEN NULL ELSE o_orderstatus END AS status FROM orders
""")
def s06_rows_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as lines of tabs, of which some are short; those are set apart with their reason."""
    folder, apart = scratch(spark, "lines"), scratch(spark, "apart")
    short = F.col("o_orderkey") % 7 == 3
    lines = table(spark, sf_dir, "orders").select(F.concat_ws("\t", F.col("o_orderkey").cast("string"), F.lit("x"), F.when(~short, F.col("o_orderstatus"))).alias("value"))
    lines.write.text(folder)
    good = tab_rows_apart(spark, folder, ["key", "x", "status"], apart).select(F.col("key").cast("long").alias("o_orderkey"), F.lit(None).cast("string").alias("reason"), "status")
    bad = bad_rows(spark, apart).select(F.substring_index("value", "\t", 1).cast("long").alias("o_orderkey"), "reason", F.lit(None).cast("string").alias("status"))
    return good.unionByName(bad)


@query("""
SELECT p_partkey AS seq, (10123 + sum(CASE WHEN p_partkey % 6 = 3 THEN 0 ELSE 1 END) OVER (ORDER BY p_partkey) + CASE WHEN p_partkey % 6 = 3 THEN 1 ELSE 0 END)::BIGINT AS region_id,
  CASE p_partkey % 6 WHEN 0 THEN '成功' WHEN 1 THEN '成功' WHEN 3 THEN '失败' ELSE '低置信度' END AS status FROM part WHERE p_partkey % 6 <> 5
""")
def w02_streamed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W01, W02 over a stream: every address twice, in two runs with a restart between them; ids go on."""
    path = scratch(spark, "stream")
    inputs, raws = part_addresses(spark, sf_dir).select("seq", "address"), f"{path}/raws"
    part_responses(spark, sf_dir).write.parquet(raws)
    half = inputs.agg((F.max("seq") / 2).cast("long")).first()[0]
    flow = streaming.Flow(spark, f"{path}/flow", lambda: spark.read.parquet(raws))
    before = spark.conf.get(streaming.STATE_STORE[0])
    spark.conf.set(*streaming.STATE_STORE)
    try:
        for some in (inputs.where(F.col("seq") <= half), inputs.withColumn("seq", F.when(F.col("seq") > half, F.col("seq")).otherwise(F.col("seq") + (1 << 40)))):
            some.coalesce(1).write.mode("append").parquet(f"{path}/in")
            streaming.start(streaming.numbered_stream(spark, f"{path}/in"), flow, f"{path}/checkpoint").awaitTermination()
    finally:
        spark.conf.set(streaming.STATE_STORE[0], before)
    return flow.results().select("seq", F.col("region_id").cast("long"), "status")
