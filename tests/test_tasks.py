"""Rows that are small and whose work is not are dealt out over tasks, and what is large is never sent to all of them."""

from pyspark.sql import functions as F

from atlasmill.plans.resolve import Settings, candidate_lines, chosen, numbered, sub_queries
from atlasmill.sources import embedded


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_few_bytes_of_addresses_take_many_tasks(spark):
    inputs = spark.range(2000, numPartitions=1).select(F.col("id").alias("seq"), F.format_string("第%d号花园1、2栋", "id").alias("address"))
    tasks = sub_queries(inputs).select(F.spark_partition_id().alias("t")).distinct().count()
    assert tasks == min(int(spark.conf.get("spark.sql.shuffle.partitions")), 64) > 1


def test_a_row_without_a_number_comes_first(spark):
    rows = spark.createDataFrame([(5, "甲"), (None, "甲"), (7, "乙"), (6, " 乙"), (1, " ")], "seq long, address string")
    assert {(r.seq, r.address) for r in sub_queries(rows).collect()} == {(None, "甲"), (6, "乙")}


def test_responses_are_not_broadcast(spark):
    """A compressed file of repeated texts looks small enough to be; what its texts hold is not."""
    inputs = spark.createDataFrame([(1, "甲"), (2, "乙")], "seq long, address string")
    responses = spark.createDataFrame([("甲", '{"content":[{"name":"甲"}]}')], "q string, raw string").select(F.md5("q").alias("query_md5"), "raw")
    outcomes = chosen(sub_queries(inputs), responses, Settings())
    assert "SortMergeJoin" in plan_of(outcomes) and "BroadcastHashJoin" not in plan_of(outcomes)
    assert numbered(outcomes, Settings()).count() == 2


def test_sums_over_embedded_pieces_keep_no_second_copy_of_the_text(spark, tmp_path, monkeypatch):
    kept, keep = [], embedded._kept
    monkeypatch.setattr(embedded, "_kept", lambda df: kept.append(df.columns) or keep(df))
    (tmp_path / "page").write_text('var A = [ {"a":"x}\\"{"} , {"b":{"c":"]"}} ]; f({})', encoding="utf-8")
    got = [r.value for r in embedded.object_texts(spark, f"file://{tmp_path}/page", "A =").orderBy("pos").collect()]
    assert got == ['{"a":"x}\\"{"}', '{"b":{"c":"]"}}']
    assert [c for columns in kept for c in columns if c in ("t", "bare", "value")] == ["t"]


def test_scoring_keeps_its_tasks(spark):
    """A few bytes of looked-up responses are parsed and scored in as many tasks as the session shuffles to."""
    inputs = spark.range(200, numPartitions=1).select(F.col("id").alias("seq"), F.format_string("第%d号花园", "id").alias("address"))
    subs = sub_queries(inputs)
    outcomes = chosen(subs, subs.select("query_md5", F.lit('{"content":[{"name":"甲"}]}').alias("raw")), Settings())
    tasks = outcomes.select(F.spark_partition_id().alias("t")).distinct().count()
    assert tasks == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1


def test_no_filter_holds_what_is_exploded(spark):
    """Spark infers a filter from explode(), whose input it then computes again, below the deal too; not from explode_outer()."""
    inputs = spark.createDataFrame([(1, "甲1、2栋"), (2, "乙")], "seq long, address string")
    subs = sub_queries(inputs)
    lines = candidate_lines(subs, subs.select("query_md5", F.when(F.col("sub_pos") == 0, '{"content":[{"name":"甲"},5]}').otherwise('{"content":[]}').alias("raw")))
    for df in (subs, lines):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert not [line for line in plan.split("\n") if "Filter " in line and "transform(" in line]
    assert [(r.seq, r.sub_pos, r["rank"], r.idx) for r in lines.orderBy("seq").collect()] == [(1, 0, 0, 0), (2, 0, 0, 0)]
