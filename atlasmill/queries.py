"""Registered queries of the address engine over the driver's tables, each with SQL that states its result independently.

The tables hold no addresses, so adapters derive them from keys; the SQL states in closed form what the operators must
make of them, or computes it another way, and doesn't repeat their steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atlasmill import operators as O
from atlasmill.functions import formats as X
from atlasmill.functions import geometry as G
from atlasmill.functions import responses as P
from atlasmill.functions import rules as R
from atlasmill.functions import score as S
from atlasmill.functions import text as T
from atlasmill.operators import enrich as N
from atlasmill.plans import sinks as K
from atlasmill.plans.resolve import resolve, sub_queries
from atlasmill.sources import address_rows

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def lonlat_sql(x: str, y: str) -> tuple[str, str]:
    """SQL of longitude and latitude of projected metres."""
    def pick(i: int) -> str:
        return "CASE " + " ".join(f"WHEN abs({y}) >= {limit!r} THEN {c[i]!r}::DOUBLE" for limit, c in zip(R.BAND_LIMITS, R.BANDS)) + " END"

    b = f"(abs({y}) / ({pick(9)}))"
    lat = f"({pick(2)})" + "".join(f" + ({pick(i)}) * pow({b}, {i - 2})" for i in range(3, 9))
    return f"(({pick(0)}) + ({pick(1)}) * abs({x})) * CASE WHEN {x} < 0 THEN -1 ELSE 1 END", f"({lat}) * CASE WHEN {y} < 0 THEN -1 ELSE 1 END"


# --- addresses and responses derived from parts -------------------------------------------------------------------


def part_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, address): two units, joined letters, a range around the span limit, an alias, a plain one; and lines to drop."""
    k, r = F.col("p_partkey"), F.col("p_partkey") % 6
    base = text("  第", k, "号花园")
    address = (
        F.when(r == 0, text(base, "1、2栋 ")).when(r == 1, text(base, "AB座")).when(r == 2, text(base, "1-", F.col("p_size") % 15 + 2, "栋"))
        .when(r == 3, text(base, "C座（连体）")).when(r == 4, text(base, "大门")).otherwise(text("# ", base))
    )
    return address_rows(O.spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select(k.alias("seq"), address.alias("address")))


def part_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_md5, raw) for the parts of those addresses: the first two kinds are found, of the third the first unit only,
    the fourth is outside the city, and the fifth resembles nothing."""
    subs = sub_queries(part_addresses(spark, sf_dir))
    r, pos = F.col("seq") % 6, F.col("sub_pos")
    x, y = F.lit(12675000) + F.col("seq") % 1000 + 20 * pos, F.lit(2569000) + F.col("seq") % 700
    square = text("POLYGON ((", x, " ", y, ", ", x + 10, " ", y, ", ", x + 10, " ", y + 10, ", ", x, " ", y + 10, ", ", x, " ", y, "))")
    center = text('"ext":{"detail_info":{"navi_xy":{"diPoint":{"x":"', x + 5, '","y":"', y + 5, '"}},"guoke_geo_bud":{"bud_geom":"', square, '"}}}')
    hit = text('{"name":"', F.col("sub"), '","std_tag":"房地产;内部楼栋","city_name":"', R.CITY, '",', center, "}")
    far = text('{"name":"', F.col("sub"), '","city_name":"东莞市","diPointX":', x * 100, ',"diPointY":', y * 100, "}")
    poor = text('{"name":"甲","diPointX":', x * 100, ',"diPointY":', y * 100, ',"tag_info":"{\\"classification\\":{\\"std_tag\\":\\"购物;超市\\"}}"}')
    content = F.when(r == 3, far).when(r == 4, text("7,", poor)).otherwise(text(far, ",", hit))
    raw = text('{"result":{"error":0},"content":[', content, "]}")
    return subs.where((r != 2) | (pos == 0)).select("query_md5", raw.alias("raw"))


_CENTER = lonlat_sql("x", "y")


@query(f"""
WITH k AS (SELECT p_partkey k, p_size % 15 + 2 AS n FROM part WHERE p_partkey % 6 <> 5),
c AS (SELECT k, CASE WHEN k % 6 IN (0, 1) THEN 12675000 + k % 1000 + 15 ELSE 12675000 + k % 1000 + CASE WHEN k % 6 = 4 THEN 0 ELSE 5 END END::DOUBLE x,
  (2569000 + k % 700 + CASE WHEN k % 6 = 4 THEN 0 ELSE 5 END)::DOUBLE y, CASE WHEN k % 6 = 3 THEN false ELSE true END ok FROM k)
SELECT k AS seq, (10123 + sum(ok::INT) OVER (ORDER BY k) + CASE WHEN ok THEN 0 ELSE 1 END)::BIGINT AS region_id,
  CASE WHEN ok THEN round({_CENTER[0]}, 6) END AS lon, CASE WHEN ok THEN round({_CENTER[1]}, 6) END AS lat,
  CASE k % 6 WHEN 0 THEN '成功' WHEN 1 THEN '成功' WHEN 2 THEN '低置信度' WHEN 3 THEN '失败' ELSE '低置信度' END AS status,
  CASE k % 6 WHEN 3 THEN '未知' WHEN 4 THEN '超市' ELSE '内部楼栋' END AS place_type,
  CASE WHEN k % 6 IN (0, 1) THEN 5 WHEN k % 6 = 2 THEN 5 ELSE 0 END::BIGINT AS n_points
FROM c
""")
def resolve_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole flow S05, W01-W05, J01, T11, D01-D08, C01-C08, G01-G13, A02-A04, P06-P10, P16, O01, O03."""
    found = resolve(part_addresses(spark, sf_dir), part_responses(spark, sf_dir))
    return found.select("seq", F.col("region_id").cast("long"), F.round("center_lon", 6).alias("lon"), F.round("center_lat", 6).alias("lat"), "status", "place_type", F.size("polygon").cast("long").alias("n_points"))


@query("""
SELECT count(*) AS total, count(*) FILTER (WHERE p_partkey % 6 IN (0, 1)) AS success, count(*) FILTER (WHERE p_partkey % 6 IN (2, 4)) AS low,
  count(*) FILTER (WHERE p_partkey % 6 = 3) AS failed, count(*) FILTER (WHERE p_partkey % 6 = 4) AS no_polygon FROM part WHERE p_partkey % 6 <> 5
""")
def a01_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.summary(resolve(part_addresses(spark, sf_dir), part_responses(spark, sf_dir)))


@query("""
WITH k AS (SELECT p_partkey k, p_size % 15 + 2 AS n, '第' || p_partkey || '号花园' AS b FROM part WHERE p_partkey % 6 <> 5)
SELECT k AS seq, b || u AS sub, (row_number() OVER (PARTITION BY k ORDER BY o) - 1)::INT AS sub_pos FROM (
  SELECT k, b, unnest(['1栋', '2栋']) u, unnest([1, 2]) o FROM k WHERE k % 6 = 0
  UNION ALL SELECT k, b, unnest(['A座', 'B座']), unnest([1, 2]) FROM k WHERE k % 6 = 1
  UNION ALL SELECT k, b, unnest(range(1, n + 1)) || '栋', unnest(range(1, n + 1)) FROM k WHERE k % 6 = 2 AND n - 1 <= 12
  UNION ALL SELECT k, b, unnest(['1', n::VARCHAR]) || '栋', unnest([1, 2]) FROM k WHERE k % 6 = 2 AND n - 1 > 12
  UNION ALL SELECT k, b, 'C座（连体）', 1 FROM k WHERE k % 6 = 3
  UNION ALL SELECT k, b, '大门', 1 FROM k WHERE k % 6 = 4)
""")
def t11_expand_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P01-P03, T01-T11, W01."""
    return sub_queries(part_addresses(spark, sf_dir)).select("seq", "sub", "sub_pos")


@query("""SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL""")
def w01_first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.first_occurrence(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


@query("""SELECT o_orderkey, 10124 + coalesce(sum((o_orderstatus <> 'F')::INT) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS region_id FROM orders""")
def w02_dense_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.dense_ids(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), F.col("o_orderstatus") != "F", "o_orderkey", 10124).select("o_orderkey", F.col("region_id").cast("long"))


@query("""
WITH e AS (SELECT event_id, event_type = 'click' AS empty, sum((event_type <> 'click')::INT) OVER (ORDER BY event_id) AS g FROM events)
SELECT event_id, CASE WHEN empty THEN (row_number() OVER (PARTITION BY g, empty ORDER BY event_id) - 1) % 3 + 1 ELSE 0 END::BIGINT AS streak FROM e
""")
def w05_empty_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.streaks(table(spark, sf_dir, "events").select("event_id", "event_type"), F.col("event_type") == "click", "event_id", 3).select("event_id", F.col("streak").cast("long"))


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, l_tax <= 0.05 AS ok, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_quantity > 25 DESC, l_linenumber, l_partkey, l_suppkey) AS n
  FROM lineitem)
SELECT l_orderkey, l_linenumber, (n - 1)::BIGINT AS skipped FROM r WHERE ok QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY n) = 1
""")
def w03_best_admissible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O01, O03, W03, W04."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_quantity", "l_tax", "l_partkey", "l_suppkey")
    best = O.best_admissible(rows, ["l_orderkey"], [F.desc("l_discount"), (F.col("l_quantity") > 25).desc(), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")], F.col("l_tax") <= 0.05)
    return best.select("l_orderkey", "l_linenumber", F.col("skipped").cast("long"))


@query("""
SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 75 WHEN 1 THEN 55 WHEN 2 THEN 45 WHEN 3 THEN 35 WHEN 4 THEN 0 WHEN 5 THEN 50 WHEN 6 THEN 43 ELSE 65 END::DOUBLE AS total,
  CASE p_partkey % 8 WHEN 0 THEN 40 WHEN 1 THEN 20 WHEN 2 THEN 30 WHEN 3 THEN 20 WHEN 4 THEN 0 WHEN 5 THEN 15 WHEN 6 THEN 28 ELSE 40 END::DOUBLE AS name_s
FROM part
""")
def c08_candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates' totals worked out by hand from the rules."""
    r = F.col("p_partkey") % 8
    pick = lambda *v: F.get(F.array(*[F.lit(x).cast("string") for x in v]), r.cast("int"))
    cases = table(spark, sf_dir, "part").select(
        "p_partkey", pick("香蜜楼B单元", "香蜜楼B单元", "香蜜楼B单元", "香蜜楼B单元", "香蜜楼B单元", "香蜜楼B单元", "远望科技项目部", "香蜜楼B单元").alias("address"),
        pick("香蜜楼B单元", "香蜜二村B单元", "香蜜楼", "香蜜楼A单元", "13号便利店", "香蜜楼B单元停车场", "远望科技股份项目经理部", "香蜜楼B单元").alias("name"),
        pick("房地产;内部楼栋", "房地产;内部楼栋", "房地产;住宅区", "房地产;内部楼栋", "购物;便利店", "房地产;住宅区", "公司", None).alias("std_tag"), (~r.isin(4, 6)).alias("polygons"),
    )
    none = F.lit(None).cast("string")
    parts = S.scores(F.col("name"), none, F.col("std_tag"), none, F.col("polygons"), F.col("address"))
    return cases.select("p_partkey", *[v.alias(k) for k, v in parts.items()]).select("p_partkey", S.total().alias("total"), "name_s")


@query("""
WITH a AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '福田区' WHEN 1 THEN '南山区' WHEN 2 THEN '' ELSE '宝安区' END AS own FROM orders)
SELECT o_orderkey, own AS district, CASE WHEN own = '' THEN 12.5 WHEN own = '南山区' THEN 22.5 ELSE 0.0 END::DOUBLE AS addr_s FROM a
""")
def c02_address_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the keywords are in a candidate's address in one district."""
    area = F.get(F.array(*map(F.lit, ("香蜜湖", "蛇口", "无名", "宝安"))), (F.col("o_orderkey") % 4).cast("int"))
    address, where = F.concat(area, F.lit("2翠竹家园路")), F.lit("南山区翠竹家园路")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(T.district_of(address), F.lit("")).alias("district"), S.address_score(where, address).alias("addr_s"))


_LINE = lonlat_sql("x", "y")


@query(f"""
WITH p AS (SELECT l_orderkey, l_linenumber, ((l_orderkey * 7919 + l_linenumber * 104729) % 30000000 - 15000000)::DOUBLE x, ((l_partkey * 15485863 + l_linenumber) % 34000000 - 17000000)::DOUBLE y FROM lineitem)
SELECT l_orderkey, l_linenumber, round({_LINE[0]}, 6) AS lon, round({_LINE[1]}, 6) AS lat,
  round(x / 20037508.34 * 180, 6) AS simple_lon, round(180 / pi() * (2 * atan(exp(y / 20037508.34 * pi())) - pi() / 2), 6) AS simple_lat FROM p
""")
def g01_projected_to_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G01-G03."""
    x = ((F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729) % 30000000 - 15000000).cast("double")
    y = ((F.col("l_partkey") * 15485863 + F.col("l_linenumber")) % 34000000 - 17000000).cast("double")
    points = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x"), y.alias("y"))
    points = points.withColumns({"p": G.to_lonlat(F.col("x"), F.col("y")), "q": G.to_lonlat(F.col("x"), F.col("y"), official=False)})
    return points.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(n) for c, n in (("p.x", "lon"), ("p.y", "lat"), ("q.x", "simple_lon"), ("q.y", "simple_lat"))])


def vector_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, ring): consecutive pairs of a vector's components as points."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    ring = F.transform(F.sequence(F.lit(0), F.shiftright(F.size("v"), 1) - 1), lambda i: G.point(F.get("v", 2 * i), F.get("v", 2 * i + 1)))
    return table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v")).where("size(v) >= 2").select("vec_id", ring.alias("ring"))


_POINTS = "p AS (SELECT vec_id, i, embedding[2 * i - 1]::DOUBLE x, embedding[2 * i]::DOUBLE y, len(embedding) // 2 n FROM embeddings, range(1, 33) t(i) WHERE i <= len(embedding) // 2)"
_EDGES = "e AS (SELECT a.vec_id, a.x ax, a.y ay, b.x bx, b.y qy FROM p a JOIN p b ON a.vec_id = b.vec_id AND b.i = a.i % a.n + 1)"


@query(f"""
WITH {_POINTS}, {_EDGES}, s AS (SELECT vec_id, sum(ax * qy - bx * ay) a2, sum((ax + bx) * (ax * qy - bx * ay)) cx, sum((ay + qy) * (ax * qy - bx * ay)) cy,
  sum(((ay > 0.01) <> (qy > 0.01) AND 0.02 < (ax - bx) * (0.01 - qy) / nullif(ay - qy, 0) + bx)::INT) crossings FROM e GROUP BY vec_id),
b AS (SELECT vec_id, min(x) x0, min(y) y0, max(x) x1, max(y) y1, avg(x) mx, avg(y) my FROM p GROUP BY vec_id)
SELECT vec_id, round(abs(a2) / 2, 6) AS area, round(a2 / 2, 6) AS signed, round(cx / (3 * a2), 4) AS cx, round(cy / (3 * a2), 4) AS cy, crossings % 2 = 1 AS inside,
  round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1, round(mx, 6) AS mx, round(my, 6) AS my FROM s JOIN b USING (vec_id) WHERE abs(a2) > 0.02
""")
def g07_ring_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G05-G08, G15, G17, A09, A11, W06."""
    ring = F.col("ring")
    rows = vector_rings(spark, sf_dir).withColumns({"a": G.area(ring), "s": G.signed_area(ring), "c": G.centroid(ring), "b": G.bbox(ring), "m": G.mean_point(ring), "inside": G.contains(ring, F.lit(0.02), F.lit(0.01))})
    columns = (("a", 6, "area"), ("s", 6, "signed"), ("c.x", 4, "cx"), ("c.y", 4, "cy"), ("b.x0", 6, "x0"), ("b.y0", 6, "y0"), ("b.x1", 6, "x1"), ("b.y1", 6, "y1"), ("m.x", 6, "mx"), ("m.y", 6, "my"))
    return rows.where("a > 0.01").select("vec_id", "inside", *[F.round(c, d).alias(n) for c, d, n in columns])


@query(f"""
WITH {_POINTS}, h AS (SELECT a.vec_id, a.x ax, a.y ay, b.x bx, b.y qy FROM p a JOIN p b ON a.vec_id = b.vec_id AND (a.x <> b.x OR a.y <> b.y)
  WHERE NOT EXISTS (SELECT 1 FROM p c WHERE c.vec_id = a.vec_id AND (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0))
SELECT vec_id, count(*) AS vertices, round(sum(ax * qy - bx * ay) / 2, 6) AS area FROM h GROUP BY vec_id
""")
def g10_convex_hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In SQL a hull's edges are the pairs that have every other point to their left."""
    hulls = vector_rings(spark, sf_dir).select("vec_id", G.convex_hull(F.col("ring")).alias("hull")).where("hull is not null")
    return hulls.select("vec_id", F.size("hull").cast("long").alias("vertices"), F.round(G.signed_area(F.col("hull")), 6).alias("area"))


@query("""
SELECT s_suppkey, (s_suppkey % 4)::BIGINT AS kind, CASE s_suppkey % 4 WHEN 0 THEN 100 WHEN 1 THEN 400 WHEN 2 THEN 400 ELSE 100 END::DOUBLE AS area, 2::BIGINT AS rings FROM supplier
""")
def g09_chosen_footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point in the first, in the second, in neither (the larger), and in both squares."""
    k = F.col("s_suppkey")
    small = text("POLYGON ((", k, " 0, ", k + 10, " 0, ", k + 10, " 10, x y, ", k, " 10));")
    large = text("POLYGON((", k + 5, " 5, ", k + 25, " 5, ", k + 25, " 25, ", k + 5, " 25, ", k + 5, " 5));POLYGON ((1 1, 2 2))")
    x = k + F.get(F.array(*map(F.lit, (2.0, 20.0, 90.0, 7.0))), (k % 4).cast("int"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (k % 4).alias("kind"), G.parsed_polygons(text(small, large)).alias("rings"), x.alias("x"), (x - k).alias("y"))
    return rows.select("s_suppkey", "kind", G.area(G.chosen_footprint(F.col("rings"), F.col("x"), F.when(F.col("kind") == 0, 2.0).otherwise(F.col("y")))).alias("area"), F.size("rings").cast("long").alias("rings"))


@query("""
WITH p AS (SELECT s_suppkey, 113.5 + (s_suppkey % 100) / 100.0 AS lon, 22.5 + (s_suppkey % 37) / 100.0 AS lat FROM supplier),
q AS (SELECT *, 111320 * cos(radians(lat)) AS m FROM p)
SELECT s_suppkey, 5::BIGINT AS n_ring, 37::BIGINT AS n_circle, round(0.0005 * m * 0.0005 * 111320 + 4 * 400 + 2 * 20 * (0.0005 * m + 0.0005 * 111320), 3) AS area, round(pi() * 0 + 18 * 400 * sin(2 * pi() / 36), 3) AS circle_area FROM q
""")
def g20_buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares moved out by 20 m and circles in their place, by way of their JSON text."""
    lon, lat = F.lit(113.5) + (F.col("s_suppkey") % 100) / 100.0, F.lit(22.5) + (F.col("s_suppkey") % 37) / 100.0
    ring = F.array(*[G.point(lon + dx, lat + dy) for dx, dy in ((-0.00025, -0.00025), (0.00025, -0.00025), (0.00025, -0.00025), (0.00025, 0.00025), (-0.00025, 0.00025), (-0.00025, -0.00025))])
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", G.point(lon, lat).alias("c"), ring.alias("ring"))
    rows = rows.withColumns({"out": X.parsed_ring(X.expanded_range(X.point_json(F.col("c")), X.ring_json(F.col("ring")), 20.0)), "around": X.parsed_ring(X.expanded_range(X.point_json(F.col("c")), F.lit("[]"), 20.0))})
    metres = lambda r: F.round(G.area(G.to_local(F.col(r), F.col("c"))), 3)
    return rows.select("s_suppkey", F.size("out").cast("long").alias("n_ring"), F.size("around").cast("long").alias("n_circle"), metres("out").alias("area"), metres("around").alias("circle_area"))


def event_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, raw): malformed, reporting an error, three kinds of candidates behind an element that is none, challenged, blank."""
    k = F.col("event_id")
    a = text('{"name":"e', k, '","addr":"","poi_address":"p","tag_info":"{\\"classification\\":{\\"std_tag\\":\\"in;ner\\",\\"show_tag\\":\\"shown\\"}}","ext":{"detail_info":{"navi_xy":{"diPoint":{"x":"', k + 0.5, '","y":1}}}}}')
    b = text('{"name":"e', k, '","addr":"a","poi_address":"p","std_tag":"s","tag_info":"{broken","diPointX":', k * 100 + 125, ',"diPointY":200}')
    c = text('{"name":"e', k, '","poi_address":"p","show_tag":["first","second"],"geo":"1|-1.5,2;3,4"}')
    r = k % 7
    wrap = lambda c: text('{"result":{"error":0},"content":[{"name":"other"},5,', c, "]}")
    raw = F.when(r == 0, text("{", F.col("props"))).when(r == 1, F.lit('{"result":{"error":3,"msg":"x"},"content":[{"name":"n"}]}')).when(r == 2, wrap(a)).when(r == 3, wrap(b)).when(r == 4, wrap(c)).when(r == 5, F.lit('{"result":{"anti_session":{"need_recaptcha":true}},"content":[{"name":"n"}]}')).otherwise(F.lit("  "))
    return table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))


def response_fields(rows: DataFrame) -> DataFrame:
    """What rows (event_id, o) say of a response, and of its second candidate."""
    rows = rows.withColumn("c", F.get("o.candidates", 1))
    return rows.select("event_id", "o.auth_error", "o.error_code", F.size("o.candidates").cast("long").alias("n"), "c.name", "c.addr", "c.std_tag", "c.show_tag", F.col("c.center.x").alias("x"), F.coalesce("c.idx", F.lit(-1)).alias("idx"))


@query("""
SELECT event_id, CASE WHEN event_id % 7 IN (0, 1, 5) THEN true ELSE false END AS auth_error, CASE event_id % 7 WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE 0 END::INT AS error_code,
  CASE WHEN event_id % 7 IN (0, 1, 5, 6) THEN 0 ELSE 2 END::BIGINT AS n, CASE WHEN event_id % 7 IN (0, 1, 5, 6) THEN NULL ELSE 'e' || event_id END AS name,
  CASE event_id % 7 WHEN 2 THEN '' WHEN 3 THEN 'a' WHEN 4 THEN 'p' END AS addr, CASE event_id % 7 WHEN 2 THEN 'in;ner' WHEN 3 THEN 's' WHEN 4 THEN NULL END AS std_tag,
  CASE event_id % 7 WHEN 2 THEN 'shown' WHEN 4 THEN 'first' END AS show_tag, CASE event_id % 7 WHEN 2 THEN event_id + 0.5 WHEN 3 THEN event_id + 1.25 WHEN 4 THEN -1.5 END::DOUBLE AS x,
  CASE WHEN event_id % 7 IN (2, 3, 4) THEN 2 ELSE -1 END::INT AS idx FROM events
""")
def d01_response_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D01-D08."""
    return response_fields(event_responses(spark, sf_dir).select("event_id", P.envelope(F.col("raw")).alias("o")))


@query("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '住宅区' WHEN 1 THEN '房地产;' WHEN 2 THEN '公寓' WHEN 3 THEN '未知' ELSE p_type END AS place_type,
  CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN p_brand ELSE p_name END AS region_name, p_partkey % 4 < 2 AS city_ok, p_partkey % 10 <= 5 OR p_partkey % 7 = 0 AS bounds_ok,
  CASE WHEN p_partkey % 7 = 0 THEN '失败' WHEN p_partkey % 2 = 0 OR p_partkey % 3 = 0 THEN '低置信度' ELSE '成功' END AS status FROM part
""")
def p09_result_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P06-P10, P16."""
    k = F.col("p_partkey")
    by = lambda n, *v: F.get(F.array(*[x if isinstance(x, Column) else F.lit(x).cast("string") for x in v]), (k % n).cast("int"))
    located = k % 7 != 0
    lon = F.lit(113.7) + (k % 10) / 5.0
    return table(spark, sf_dir, "part").select(
        "p_partkey", O.place_type(by(5, "房地产;住宅区", "房地产;", "", None, F.col("p_type")), by(5, "x", None, "公寓", "", "y")).alias("place_type"),
        O.region_name(k % 3 == 1, F.when(k % 3 == 0, F.col("p_name")).otherwise(F.when(k % 3 == 2, F.lit(""))), F.when(k % 3 == 2, F.col("p_name")).otherwise(F.col("p_brand"))).alias("region_name"),
        O.city_allowed(by(4, R.CITY, "", "东莞市", "广州市")).alias("city_ok"), O.within_bounds(located, lon, F.lit(22.5), (113.7, 22.4, 114.7, 22.9)).alias("bounds_ok"),
        O.status(located, k % 2 == 0, F.when(k % 3 == 0, F.array(F.lit("n"))).otherwise(F.array().cast("array<string>"))).alias("status"),
    )


@query("""
SELECT d.doc_id, coalesce(string_agg(DISTINCT 'q' || l.quality ORDER BY 'q' || l.quality), '') AS label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.doc_id
""")
def j02_label_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("address"), text("q", F.col("quality")).alias("label"), F.col("quality").alias("seq"))
    return N.with_labels(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("address")), labels).select(F.col("address").alias("doc_id"), "label")


@query("""SELECT c_custkey, string_agg(o_orderpriority, '/' ORDER BY f) AS label FROM (SELECT o_custkey c_custkey, o_orderpriority, min(o_orderkey) f FROM orders GROUP BY ALL) GROUP BY c_custkey""")
def a05_first_seen_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("label"), F.col("o_orderkey").alias("seq"))
    return N.label_lists(rows, key="c_custkey")


@query("""SELECT o_custkey, first(o_orderkey ORDER BY (o_orderstatus = 'O')::INT DESC, o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey""")
def j03_preferred_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    dim = orders.select("o_custkey", "o_orderkey", "o_orderstatus", F.col("o_orderkey").alias("seq"))
    return N.with_codes(orders.select("o_custkey").distinct(), dim, "o_custkey", F.col("o_orderstatus") == "O").select("o_custkey", "o_orderkey")


@query("""
WITH a AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 pos, role FROM conversations), b AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 pos, role FROM conversations WHERE turn > 0)
SELECT pos, a.role AS "left", b.role AS "right" FROM a FULL JOIN b USING (pos) WHERE a.role IS DISTINCT FROM b.role
""")
def j05_misaligned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J05, J06, A13."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), "turn", "role")
    return N.misaligned(rows, rows.where("turn > 0"), "role", "seq")


@query("""SELECT o_orderkey, o_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey""")
def j04_matched_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("key"), "o_custkey")
    return N.matched_ids(orders, customer, "key", "o_custkey").drop("key")


@query("""SELECT CASE WHEN source = 'src0' OR source IS NULL THEN '(空)' ELSE source END AS source, count(*) AS n FROM documents GROUP BY 1""")
def a06_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.histogram(table(spark, sf_dir, "documents").select(F.when(F.col("source") != "src0", F.col("source")).alias("source")), "source")


@query("""SELECT doc_id FROM documents WHERE contains(lower(text), 'the ') OR contains(lower(source), 'the ')""")
def p12_keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.keyword_filter(table(spark, sf_dir, "documents"), "ThE ", ["text", "source"]).select("doc_id")


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS row_no FROM orders WHERE o_orderstatus = 'O'""")
def w07_numbered_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P13, P14, W07, O05."""
    return O.numbered_view(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), F.col("o_orderstatus") == "O", "o_orderkey").select("o_orderkey", F.col("row_no").cast("long"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN 'new' ELSE o_orderstatus END AS o_orderstatus FROM orders UNION ALL SELECT -o_orderkey, 'new' FROM orders WHERE o_orderkey % 10 = 3""")
def u01_repeatable_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appended twice, there once."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    some = orders.where("o_orderkey % 10 = 3")
    extra = some.select("o_orderkey", F.lit("new").alias("o_orderstatus")).unionByName(some.select((-F.col("o_orderkey")).alias("o_orderkey"), F.lit("new").alias("o_orderstatus")))
    return N.appended(N.appended(orders, extra, "o_orderkey"), extra, "o_orderkey")


@query("""SELECT c_custkey, md5(c_name) AS key, round(c_acctbal, 2) AS value FROM customer""")
def t25_digests_and_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T25, F01."""
    return table(spark, sf_dir, "customer").select("c_custkey", T.query_digest(F.col("c_name")).alias("key"), F.round(X.decimal_text(F.col("c_acctbal")).cast("double"), 2).alias("value"))


@query("""
SELECT o_orderkey % 1000 AS bucket, string_agg(o_orderkey::VARCHAR, chr(9) || '' ORDER BY o_orderkey) AS line FROM (SELECT * FROM orders WHERE o_orderstatus = 'F') GROUP BY 1
""")
def a04_ordered_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts regrouped in order and joined as text."""
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select((F.col("o_orderkey") % 1000).alias("bucket"), F.col("o_orderkey").cast("string").alias("line"), F.col("o_orderkey").alias("seq"))
    return N.label_lists(rows, key="bucket", label="line", separator="\t")


@query("""
SELECT p_partkey AS seq, '第' || p_partkey || '号花园' || CASE p_partkey % 6 WHEN 3 THEN 'C座（连体）' ELSE '' END || chr(9) || '所有查询均无有效结果' AS value FROM part WHERE p_partkey % 6 = 3
""")
def k02_failed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The failure report's lines with the key that their address states."""
    lines = K.failed_lines(resolve(part_addresses(spark, sf_dir), part_responses(spark, sf_dir)))
    return lines.select(F.regexp_extract("value", "第([0-9]+)号", 1).cast("long").alias("seq"), "value")


@query("""
SELECT p_partkey AS seq, 5 AS columns, '第' || p_partkey || '号花园' || CASE p_partkey % 6 WHEN 0 THEN '1、2栋' ELSE 'AB座' END AS name FROM part WHERE p_partkey % 6 IN (0, 1)
""")
def k01_result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of results of two parts, the columns of their lines and the name."""
    results = resolve(part_addresses(spark, sf_dir), part_responses(spark, sf_dir)).where("size(sub_queries) = 2 and seq % 6 < 2")
    parts = F.split("value", "\t", -1)
    return K.result_lines(results).select(F.regexp_extract("value", "第([0-9]+)号", 1).cast("long").alias("seq"), F.size(parts).alias("columns"), parts[1].alias("name"))


_LOW, _HIGH = lonlat_sql("x0", "y0"), lonlat_sql("x1", "y1")


@query(f"""
WITH k AS (SELECT p_partkey k, p_partkey % 6 r, p_size % 15 + 2 AS n FROM part WHERE p_partkey % 6 <> 5),
b AS (SELECT *, (12675000 + k % 1000)::DOUBLE x0, (2569000 + k % 700)::DOUBLE y0, (12675000 + k % 1000 + CASE WHEN r < 2 THEN 30 ELSE 10 END)::DOUBLE x1, (2569000 + k % 700 + 10)::DOUBLE y1, 10123 + sum(CASE WHEN r = 3 THEN 0 ELSE 1 END) OVER (ORDER BY k) AS id FROM k),
c AS (SELECT *, CASE WHEN r = 4 THEN x0 ELSE (x0 + x1) / 2 END AS x, CASE WHEN r = 4 THEN y0 ELSE (y0 + y1) / 2 END AS y FROM b WHERE r <> 3),
d AS (SELECT *, {_LOW[0]} AS lon0, {_LOW[1]} AS lat0, {_HIGH[0]} AS lon1, {_HIGH[1]} AS lat1 FROM c)
SELECT id::BIGINT AS region_id, 5 AS columns, CASE r WHEN 0 THEN '第' || k || '号花园1、2栋' WHEN 1 THEN '第' || k || '号花园AB座' WHEN 2 THEN '第' || k || '号花园1-' || n || '栋' ELSE '甲' END AS name,
  round({_CENTER[0]}, 6) AS lon, round({_CENTER[1]}, 6) AS lat,
  CASE WHEN r = 4 THEN '' ELSE printf('%.6f %.6f,%.6f %.6f,%.6f %.6f,%.6f %.6f,%.6f %.6f', lon0, lat0, lon1, lat0, lon1, lat1, lon0, lat1, lon0, lat0) END AS ring,
  CASE WHEN r = 4 THEN '超市' ELSE '内部楼栋' END AS place_type FROM d
""")
def k01_all_result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with all its columns, the centre and the ring read from their JSON."""
    parts = F.split("value", "\t", -1)
    lines = K.result_lines(resolve(part_addresses(spark, sf_dir), part_responses(spark, sf_dir))).select(parts.alias("p"))
    center = F.from_json(F.get("p", F.lit(2)), "lon double, lat double")
    ring = F.transform(X.parsed_ring(F.get("p", F.lit(3))), lambda q: F.format_string("%.6f %.6f", q["x"], q["y"]))
    return lines.select(
        F.get("p", F.lit(0)).cast("long").alias("region_id"), F.size("p").alias("columns"), F.get("p", F.lit(1)).alias("name"),
        F.round(center["lon"], 6).alias("lon"), F.round(center["lat"], 6).alias("lat"), F.array_join(ring, ",").alias("ring"), F.get("p", F.lit(4)).alias("place_type"),
    )


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '香蜜楼花园|号街道' WHEN p_partkey % 3 = 1 THEN '号街道' ELSE '' END AS runs,
  CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 50 || '栋|B单元|二单元' WHEN p_partkey % 3 = 1 THEN '' ELSE 'C座' END AS units, p_partkey % 3 = 0 AS ordered, p_partkey % 3 = 0 AND p_partkey % 50 >= 10 AS bounded FROM part
""")
def t15_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T12-T19."""
    n = F.col("p_partkey") % 50
    a = F.when(F.col("p_partkey") % 3 == 0, text("香蜜楼花园", n, "栋B单元二单元12号街道")).when(F.col("p_partkey") % 3 == 1, F.lit("12号街道 宿舍楼")).otherwise(F.lit("C座大门1"))
    rows = table(spark, sf_dir, "part").select("p_partkey", a.alias("a"), n.alias("n"))
    own = F.array(text(F.when(F.col("n") >= 10, F.col("n").cast("string")).otherwise(F.lit("花")), "栋"))
    return rows.select("p_partkey", F.array_join(F.filter(T.effective_runs(F.col("a")), lambda r: ~r.contains("单元")), "|").alias("runs"), F.array_join(T.unit_tokens(F.col("a")), "|").alias("units"), T.is_subsequence(F.lit("香花二街"), F.col("a")).alias("ordered"), T.has_bounded(F.col("a"), own).alias("bounded"))
