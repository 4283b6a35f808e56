"""The keyed store of responses: answers before errors, plans without a shuffle of texts, compaction that repeats safely."""

import json
import re

import pytest
from pyspark.sql import functions as F

from atlasmill.functions import responses as P
from atlasmill.plans.resolve import latest_responses, outcomes_by_query
from atlasmill.sources.folders import Versions, scratch
from atlasmill.sources.store import ResponseStore

GOOD = '{"result":{"error":0},"content":[{"name":"%s","addr":"a","diPointX":100,"diPointY":200},7,{"name":"second"}]}'
ERROR = '{"result":{"error":9},"content":[{"name":"z"}]}'
SCHEMA = "query_md5 string, raw string, stored_at long"


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def names(store):
    return {r.query_md5: (r.outcome.auth_error, r.outcome.error_code, [(c.idx, c.name) for c in r.outcome.candidates]) for r in store.lookup().collect()}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_answers_before_errors(spark):
    store = ResponseStore(spark, scratch(spark, "t"), buckets=4)
    assert names(store) == {}
    store.append(batch(spark, ("a", ERROR, 1), ("b", GOOD % "b1", 1), ("c", ERROR, 1), ("d", "{broken", 1), ("e", None, 1), ("f", "", 1), ("g", " ", 1)))
    store.append(batch(spark, ("a", GOOD % "a2", 2), ("b", ERROR, 9), ("a", GOOD % "a1", 1), ("g", GOOD % "g0", 0)))
    want = {"a": (False, 0, [(0, "a2"), (2, "second")]), "b": (False, 0, [(0, "b1"), (2, "second")]), "c": (True, 9, []), "d": (True, 0, []), "g": (False, 0, [])}
    assert names(store) == want
    for _ in range(2):  # stored once more, and compacted again and again
        store.append(batch(spark, ("a", GOOD % "a2", 2), ("b", GOOD % "b1", 1)))
        assert names(store) == want
        store.compact()
        assert names(store) == want
    assert {r.query_md5: r.raw for r in store.texts().collect()} == {"a": GOOD % "a2", "b": GOOD % "b1", "c": ERROR, "d": "{broken", "g": " "}
    assert store.rows().count() == 5 + 4  # a row for each text and each place that count
    store.prune()
    assert names(ResponseStore(spark, store.versions.path, buckets=4)) == want and len(store.versions.complete()) == 1


def test_plain_responses_too(spark):
    rows = batch(spark, ("a", GOOD % "x", 1), ("a", ERROR, 2), ("b", "{broken", 3), ("b", GOOD % "y", 1), ("c", ERROR, 1), ("n", None, 1))
    assert {r.query_md5: r.raw for r in latest_responses(rows).collect()} == {"a": GOOD % "x", "b": GOOD % "y", "c": ERROR, "n": None}


def test_lookup_equals_the_envelope(spark):
    point = '"ext":{"detail_info":{"navi_xy":{"diPoint":{"x":"1.5","y":2}},"guoke_geo_bud":{"bud_geom":"POLYGON ((0 0, 1 0, 1 1))"}}}'
    odd = ['{"name":null}', '{"name":{"x":1}}', '{"name":5,"std_tag":["a"],"show_tag":["s"]}', '{"tag_info":"{\\"classification\\":{\\"std_tag\\":\\"t\\"}}","geo":"9|1.5,2;3"}', "[]", "null", '"text"', '{"name":"n",%s}' % point, "{}", '{"diPointX":"1","diPointY":2}', '{"name":"é"}']
    raws = ['{"content":[' + ",".join(odd[i:] + odd[:i]) + "]}" for i in range(len(odd))] + ["[1]", "5", '{"content":{"a":1}}', '{"content":[]}', '{"result":{"anti_session":{"need_recaptcha":true}},"content":[{}]}', "{", "  "]
    rows = batch(spark, *[(str(i), raw, 1) for i, raw in enumerate(raws)])
    store = ResponseStore(spark, scratch(spark, "t"), buckets=3)
    store.append(rows)
    want = {r.query_md5: r.o for r in rows.select("query_md5", P.envelope(F.col("raw")).alias("o")).collect()}
    assert {r.query_md5: r.outcome for r in store.lookup().collect()} == want


def test_a_lookup_reads_fields_and_shuffles_no_text(spark):
    store = ResponseStore(spark, scratch(spark, "t"), buckets=4)
    store.append(batch(spark, *[(f"{i:032d}", GOOD % i, 1) for i in range(200)]))
    store.append(batch(spark, *[(f"{i:032d}", ERROR, 2) for i in range(200)]))
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    looked = plan(store.lookup())
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "Exchange" not in looked and "raw" not in looked
    read = re.search(r"ReadSchema: struct<.*?doc:struct<([^>]*)", looked)
    assert read and "variant" in read.group(1) and "name" not in read.group(1)  # the paths asked for, by number, in place of the document
    subs = spark.range(50).select(F.format_string("%032d", "id").alias("query_md5")).hint("merge")
    joined = subs.join(outcomes_by_query(store.lookup()), "query_md5", "left")
    assert plan(joined).count("Exchange") == 1 and joined.where("outcome is not null").count() == 50


def test_most_objects_fields_are_columns_of_their_own(spark):
    import glob

    import pyarrow.parquet as pq

    store = ResponseStore(spark, scratch(spark, "t"), buckets=1)
    store.append(batch(spark, *[(str(i), GOOD % i, 1) for i in range(200)]))
    files = glob.glob(store.versions.folder(1).removeprefix("file:") + "/*.parquet")
    typed = pq.read_schema(files[0]).field("doc").type
    assert "typed_value" in [f.name for f in typed] and "name" in str(typed)


def test_a_version_counts_when_it_is_complete(spark, monkeypatch):
    store = ResponseStore(spark, scratch(spark, "t"), buckets=2)
    store.append(batch(spark, ("a", GOOD % "a", 1), ("a", GOOD % "b", 2)))
    with monkeypatch.context() as m:
        m.setattr(Versions, "commit", lambda self, n: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.compact()
    assert store.versions.current() == 1 and names(store)["a"][2][0] == (0, "b")
    store.compact()
    assert store.versions.current() == 3 and store.rows().where("idx = -1").count() == 1
    store.prune()
    assert store.versions.complete() == [3]
    assert json.loads(store.texts().collect()[0].raw)["content"][0]["name"] == "b"
