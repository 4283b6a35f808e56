"""Order of lines over several files, repeated responses, long runs, and rows that flows must refuse."""

import pytest
from pyspark.sql import functions as F

from atlasmill import operators as O
from atlasmill import sources as Z
from atlasmill.operators import enrich as N
from atlasmill.plans import enrich as E
from atlasmill.plans import sinks as K
from atlasmill.plans.resolve import Settings, candidate_lines, chosen, empty_streaks, latest_responses, sub_queries


def folder(path, files):
    path.mkdir()
    for name, lines in files.items():
        (path / name).write_text("".join(f"{x}\n" for x in lines), encoding="utf-8")
    return str(path)


def test_lines_of_files_of_unequal_size_keep_their_order(spark, tmp_path):
    files = {"a.txt": ["first", "second"], "b.txt": [f"b{i} {'x' * 50}" for i in range(400)], "c.txt": [], "d.txt": ["last"]}
    path = folder(tmp_path / "in", files)
    want = [x for lines in files.values() for x in lines]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        got = Z.numbered_lines(spark, path).collect()
        assert [r.value for r in sorted(got)] == want and sorted(r.seq for r in got) == list(range(len(want)))
        K.rewrite_lines(Z.numbered_lines(spark, path).orderBy("seq"), path)
        assert [r.value for r in Z.numbered_lines(spark, path).orderBy("seq").collect()] == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_each_file_has_a_header_and_tabs_alone_are_blank(spark, tmp_path):
    path = folder(tmp_path / "in", {"a": ["k\tv", "1\tx", " \t ", "\t"], "b": ["k\tv", "2\ty\tz"]})
    assert [tuple(r)[1:] for r in Z.tab_rows(spark, path, ["k", "v"], header=True).orderBy("seq").collect()] == [("1", "x"), ("2", "y")]
    with pytest.raises(Exception, match="not the columns expected"):
        Z.tab_rows(spark, path, ["k", "v"], header=True, exact=True).collect()


def test_enriched_pairs_rows_over_many_files(spark, tmp_path):
    names = [f"addr {i}" for i in range(60)]
    results = folder(tmp_path / "r", {"p0": [f"{i}\tn{i}\tc\tr\tt" for i in range(3)], "p1": [f"{i}\tn{i}\tc\tr\tt" for i in range(3, 60)]})
    inputs = folder(tmp_path / "i", {"x": names[:50], "y": names[50:]})
    labels = spark.createDataFrame([(i, f"L{i % 7}", n) for i, n in enumerate(names)], "seq long, label string, address string")
    out = E.enriched(Z.tab_rows(spark, results, ["code", "name", "center", "ring", "place_type"], exact=True), Z.addresses(spark, inputs), labels).orderBy("seq").collect()
    assert [(r.code, r.address, r.label) for r in out] == [(str(i), f"addr {i}", f"L{i % 7}") for i in range(60)]


def test_numbers_that_are_none_keep_the_default(tmp_path):
    (tmp_path / "p").write_text("a=--5\nb=-5\nc=1 2\n", encoding="utf-8")
    assert Z.properties(str(tmp_path / "p"), {"a": 1, "b": 1, "c": 1}) == {"a": 1, "b": -5, "c": 1}


def test_latest_response_of_each_query(spark):
    bad, one, two = '{"result":{"error":7}}', '{"result":{"error":0},"content":[]}', '{"content":[{"name":"x"}]}'
    rows = [("a", one, 1), ("a", two, 3), ("a", bad, 2), ("b", one, 5), ("b", one, 5), ("c", None, 1)]
    df = spark.createDataFrame(rows, "query_md5 string, raw string, stored_at long")
    assert {tuple(r) for r in latest_responses(df).collect()} == {("a", two), ("b", one), ("c", None)}
    assert dict(map(tuple, latest_responses(df.drop("stored_at").where("query_md5 = 'a' and raw <> '%s'" % two)).collect())) == {"a": one}


def test_the_store_replaces_and_leaves_errors_out(spark, tmp_path):
    path, good = str(tmp_path / "store"), '{"result":{"error":0},"content":[{"name":"%s"}]}'
    for raw in (good % "old", good % "new", '{"result":{"error":3}}', ""):
        K.store_responses(spark.createDataFrame([("k", "q", raw)], "query_md5 string, query string, raw string"), path)
    assert [tuple(r) for r in K.stored_responses(spark, path).collect()] == [("k", good % "new")]


def test_streaks_go_on_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(O, "BUCKET_BITS", 2)
    empty = [i % 17 not in (3, 4) for i in range(60)]
    df = spark.createDataFrame([(3 * i, e) for i, e in enumerate(empty)], "k long, e boolean")
    want, run = {}, 0
    for i, e in enumerate(empty):
        run = run + 1 if e else 0
        want[3 * i] = (run - 1) % 5 + 1 if e else 0
    assert {r.k: r.streak for r in O.streaks(df, F.col("e"), "k", 5).collect()} == want


def test_rows_without_an_order_come_first(spark):
    df = spark.createDataFrame([(None, "n"), (5, "a"), (None, "m"), (1, "b")], "k long, v string")
    got = {r.v: r.row_no for r in O.numbered_view(df, None, "k").collect()}
    assert (got["b"], got["a"], {got["n"], got["m"]}) == (3, 4, {1, 2})


def test_regions_codes_and_places(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y")], "id long, c string")
    assert N.matched_ids(left, left, "id", "c").count() == 2
    with pytest.raises(Exception, match="differs: 2"):
        N.matched_ids(left, left.where("id = 1"), "id", "c").collect()
    assert N.aligned(left, left, "c", "id").count() == 2
    with pytest.raises(Exception, match="differ at row 1"):
        N.aligned(left, left.withColumn("c", F.lit("x")), "c", "id").collect()
    rows = spark.createDataFrame([(7, "c7", "l7", "?"), (3, "c3", "l3", "?")], "seq long, code string, label string, name string")
    regions = spark.createDataFrame([(10, "r0"), (20, "r1")], "seq long, name string")
    assert sorted(map(tuple, E.coded_regions(regions, rows).collect())) == [(10, "r0", "c3", "l3"), (20, "r1", "c7", "l7")]
    assert O.distinct_keys(spark.createDataFrame([(1,), (1,), (None,), (2,)], "k int"), "k").first().n == 2


def test_candidates_and_streaks_of_the_flow(spark):
    subs = sub_queries(spark.createDataFrame([(1, "香蜜楼B单元"), (2, "别处大门"), (3, "又一处大门")], "seq long, address string"))
    content = '{"content":[{"name":"香蜜楼"},{"name":"香蜜楼B单元"}]}'
    raws = subs.select("query_md5", F.when(F.col("seq") == 1, content).otherwise('{"content":[]}').alias("raw"))
    lines = candidate_lines(subs, raws).orderBy("seq", "rank").collect()
    assert [(r.seq, r.rank, r.idx, r.name) for r in lines] == [(1, 0, 1, "香蜜楼B单元"), (1, 1, 0, "香蜜楼")] and lines[0].total > lines[1].total
    got = {r.seq: r.streak for r in empty_streaks(chosen(subs, raws, Settings()), 5).collect()}
    assert got == {1: 0, 2: 1, 3: 2}
