"""A stream in batches, with restarts and replays, against the batch flow over all rows."""

import pytest
from pyspark.sql import functions as F

from atlasmill import streaming as S
from atlasmill.functions import text as T
from atlasmill.plans.resolve import Settings, chosen, empty_streaks, resolve, sub_queries
from atlasmill.sources.folders import scratch

NAMES = [f"第{i}号花园{k}" for i in range(40) for k in ("1、2栋", "AB座", "大门")]


def rows(k):
    """Batch k: some addresses of its own, some of earlier batches and some twice."""
    own = [NAMES[(k * 17 + i * 5) % len(NAMES)] for i in range(30)]
    return [(k * 1000 + i, f" {a} ") for i, a in enumerate(own + own[:4] + ["", "# no"])]


@pytest.fixture(scope="module")
def responses(spark):
    subs = sub_queries(spark.createDataFrame(enumerate(NAMES), "seq long, address string"))
    x = F.lit(1267500000) + F.col("seq") * 100
    hit = F.concat(F.lit('{"content":[{"name":"'), "sub", F.lit('","diPointX":'), x.cast("string"), F.lit(',"diPointY":256900000}]}'))
    raws = subs.where("seq % 11 <> 3").select("query_md5", F.when(F.col("seq") % 15 < 7, '{"content":[]}').otherwise(hit).alias("raw"))
    return raws.persist()


def write(spark, folder, k):
    spark.createDataFrame(rows(k), "seq long, address string").coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, path, responses):
    spark.conf.set(*S.STATE_STORE)
    flow = S.Flow(spark, f"{path}/flow", lambda: responses, Settings(), threshold=2)
    query = S.start(S.numbered_stream(spark, folder, files_per_batch=1), flow, f"{path}/checkpoint")
    query.awaitTermination()
    assert query.exception() is None
    return flow


def same(got, want, columns):
    show = lambda df: sorted(map(repr, df.select(*columns).collect()))
    assert show(got) == show(want)


def test_restarts_and_replays_give_the_batch_result(spark, responses):
    path = scratch(spark, "stream")
    folder = f"{path}/in"
    write(spark, folder, 0)
    run(spark, folder, path, responses)
    write(spark, folder, 1)
    flow = run(spark, folder, path, responses)  # a restart, with one more batch
    assert flow.batches.complete() == [0, 1]
    inputs = spark.createDataFrame([r for k in range(2) for r in rows(k)], "seq long, address string").where("address not in ('', ' # no ')").withColumn("address", T.control_trim(F.col("address")))
    inputs = inputs.where("address <> '' and not startswith(address, '#')")
    want = resolve(inputs, responses)
    columns = ["seq", "region_id", "input_address", "center_lon", "status", "message"]
    streaks = empty_streaks(chosen(sub_queries(inputs), responses, Settings()), 2)
    same(flow.results(), want, columns)
    same(flow.outcomes(), streaks, ["seq", "sub_pos", "streak"])
    assert streaks.where("streak = 2").count() and want.count() < inputs.count()
    # the last batch once more, as after a failure between its results and its mark
    last = [r for r in flow.results().where("seq >= 1000").select("seq", F.col("input_address").alias("address")).collect()]
    flow.batches.delete(1)
    flow(spark.createDataFrame(last, "seq long, address string"), 1)
    same(flow.results(), want, columns)
    same(flow.outcomes(), streaks, ["seq", "sub_pos", "streak"])


def test_parts_of_an_address_without_bound(spark):
    """Streaks by address and part where an address has more parts than 4,096."""
    n = 5000
    outcomes = spark.createDataFrame([(s, i, n if s == 1 else 2, True, 0) for s, k in ((1, n), (2, 2)) for i in range(k)], "seq long, sub_pos int, n_sub int, answered boolean, n_candidates int")
    got = {(r.seq, r.sub_pos): r.streak for r in empty_streaks(outcomes, 7, carried=2).collect()}
    assert all(got[1, i] == (2 + i) % 7 + 1 for i in range(n)) and got[2, 0] == (2 + n) % 7 + 1
