"""Result lines with labels and codes: enrichment, and the merge of further results into them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atlasmill.functions import formats as X
from atlasmill.functions import geometry as G
from atlasmill.functions import text as T
from atlasmill.operators import enrich as N
from atlasmill.plans.resolve import Settings, chosen, regrouped

COLUMNS = ["code", "name", "center", "ring", "address", "label"]


def enriched(results: DataFrame, inputs: DataFrame, labels: DataFrame) -> DataFrame:
    """(seq, code: the id, name, center, ring, address, label) of result rows (seq, code, name, center, ring, place_type).

    inputs (seq, address) name each row's address, by place; as many rows as results, else ValueError. An address that
    the label table doesn't have gets an empty label.
    """
    N.same_count(results, inputs)
    at = N.placed(inputs.select("seq", "address"), "seq").select("pos", "address")
    rows = N.placed(results, "seq").join(at, "pos").drop("pos")
    return N.with_labels(rows, labels).select("seq", *COLUMNS)


def coded_regions(regions: DataFrame, rows: DataFrame) -> DataFrame:
    """regions (seq, ...) with the code and label of the row of rows (seq, code, label, ...) at the same place."""
    return N.updated_by_place(regions, rows, ["code", "label"])


def recoded(rows: DataFrame, labels: DataFrame, preferred: Column | None = None) -> DataFrame:
    """rows with the code and label of their address; an address without one raises, of several the preferred one counts."""
    named = labels.select("seq", "address", F.col("code").alias("_code"), F.col("label").alias("_label"), "district")
    found = N.with_codes(rows.drop("code", "label"), named, "address", preferred)
    return found.select("seq", F.col("_code").alias("code"), "name", "center", "ring", "address", F.col("_label").alias("label"))


def answered(answers: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The results of answers (seq, address, query, raw, code, label), with their code and label: each a stored response to a
    query that stands for an address."""
    subs = answers.select("seq", "address", F.lit(0).alias("sub_pos"), F.lit(1).alias("n_sub"), F.col("query").alias("sub"), T.query_digest(F.col("query")).alias("query_md5"))
    responses = answers.select(T.query_digest(F.col("query")).alias("query_md5"), "raw").distinct()
    return regrouped(chosen(subs, responses, settings), settings).join(answers.select("seq", "code", "label"), "seq")


def additions(answers: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(seq, code, name, center, ring, address, label) of answers, of which one without a result raises."""
    found = answered(answers, settings)
    point = X.point_json(G.point(F.col("center_lon"), F.col("center_lat")))
    center = F.when(F.col("center_lon").isNotNull(), point).otherwise(F.raise_error(F.concat(F.lit("no result: "), "input_address")))
    return found.select("seq", "code", F.col("region_name").alias("name"), center.alias("center"), X.ring_json(F.col("polygon")).alias("ring"), F.col("input_address").alias("address"), "label")


def reviewed(review: DataFrame, failed: DataFrame, results: DataFrame) -> DataFrame:
    """The review list (seq, address, name, detail, message) with the results of addresses that the failure list had behind it, once."""
    last = review.agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]
    new = results.join(failed.select(F.col("address").alias("input_address")).distinct(), "input_address", "left_semi")
    rows = new.select((F.col("seq") + last + 1).alias("seq"), F.col("input_address").alias("address"), F.col("selected_name").alias("name"), F.col("score_detail").alias("detail"), "message")
    return N.appended(review, rows, "address")


def merged(rows: DataFrame, extra: DataFrame) -> DataFrame:
    """rows with extra behind them, once, however often it is done: rows that extra's codes name are replaced."""
    last = rows.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    return N.appended(rows, extra.withColumn("seq", F.col("seq") + last + 1), "code")


def still_failed(failed: DataFrame, extra: DataFrame) -> DataFrame:
    """The failure or review list (address, ...) without the addresses that extra has resolved."""
    return failed.join(extra.select("address").distinct(), "address", "left_anti")
