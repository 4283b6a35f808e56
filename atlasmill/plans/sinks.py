"""Reports of results: tables of tabs, failures, reviews, and a map page; and parquet for responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atlasmill.functions import formats as X
from atlasmill.functions import geometry as G
from atlasmill.functions import responses as P
from atlasmill.functions import rules as R
from atlasmill.functions import text as T
from atlasmill.functions.untangle import with_buffers
from atlasmill.plans import maps
from atlasmill.plans.resolve import latest_responses
from atlasmill.sources import file_lines, rewritten


def has_center() -> Column:
    return F.col("center_lon").isNotNull() & F.col("center_lat").isNotNull()


def lines(df: DataFrame, columns: list[Column], order: str = "seq") -> DataFrame:
    """value: the columns joined by tabs, nulls as nothing, in order. The order is a range sort over partitions."""
    return df.select(F.col(order).alias("_o"), F.concat_ws("\t", *[T.or_empty(c) for c in columns]).alias("value")).orderBy("_o").select("value")


def result_lines(results: DataFrame) -> DataFrame:
    center = X.point_json(G.point(F.col("center_lon"), F.col("center_lat")))
    return lines(results.where(has_center()), [F.col("region_id").cast("string"), F.col("region_name"), center, X.ring_json(F.col("polygon")), F.col("place_type")])


def failed_lines(results: DataFrame) -> DataFrame:
    return lines(results.where(F.col("status") == R.STATUS_FAILED), [F.col("input_address"), F.col("message")])


def review_lines(results: DataFrame) -> DataFrame:
    return lines(results.where(F.col("status") == R.STATUS_LOW), [F.col("input_address"), F.col("selected_name"), F.col("score_detail"), F.col("message")])


def write_lines(df: DataFrame, path: str, dry_run: bool = False) -> DataFrame:
    """Writes value with CRLF ends below path, which is replaced; with dry_run nothing is written."""
    if not dry_run:
        df.write.mode("overwrite").option("lineSep", "\r\n").text(path)
    return df


def rewrite_lines(df: DataFrame, path: str) -> None:
    """write_lines() to a path that df itself reads, so that a failure at any step loses nothing.

    The rows become a version beside the path and count from its mark on: readers of the path take them from there. Then
    the path is replaced and the version goes. A rewrite that ended in between is ended by restore(), or by the next one.
    """
    spark = df.sparkSession
    held = rewritten(spark, path)
    n = held.following()
    write_lines(df.select("value"), held.folder(n))
    held.commit(n)
    restore(spark, path)


def restore(spark: SparkSession, path: str) -> bool:
    """Ends a rewrite of a path that failed on its way: its complete rows take the path's place, partial ones go."""
    held = rewritten(spark, path)
    n = held.current()
    if n is not None:
        rows = file_lines(spark, held.folder(n), lineSep="\r\n")  # part files are named in the order of their rows
        write_lines(rows.orderBy("seq").select("value"), path)
    held.drop()
    return n is not None


def map_rows(results: DataFrame) -> DataFrame:
    """value: a JSON object for each result that has a centre, with what the map shows."""
    ring = F.transform("polygon", lambda p: F.array(p["x"], p["y"]))
    fields = [F.col("region_id").alias("id"), F.col("region_name").alias("name"), F.col("input_address").alias("input"), F.col("center_lon").alias("lon"), F.col("center_lat").alias("lat"), ring.alias("polygon"), F.col("place_type").alias("type"), F.col("status"), F.col("score_detail").alias("detail"), F.col("message"), F.col("selected_name").alias("selected"), F.array_join("sub_queries", " | ").alias("subs")]
    return results.where(has_center()).orderBy("seq").select(F.to_json(F.struct(*fields)).alias("value"))


def map_page(results: DataFrame, title: str, key: str, max_rows: int = 100_000) -> str:
    """A page that embeds its rows and draws them; a page of over max_rows is refused, as a browser couldn't show it: see maps.write_tiles()."""
    rows = [r["value"] for r in map_rows(results).limit(max_rows + 1).collect()]
    if len(rows) > max_rows:
        raise ValueError(f"a map of over {max_rows} rows")
    return maps.page(rows, title, key)


def substituted(page: str, edits: list[tuple[str, str]]) -> str:
    """page with each anchor replaced; an anchor that doesn't stand in it exactly once raises."""
    for anchor, text in edits:
        if page.count(anchor) != 1:
            raise ValueError(f"the anchor stands {page.count(anchor)} times: {anchor[:40]}")
        page = page.replace(anchor, text)
    return page


def store_responses(responses: DataFrame, path: str) -> None:
    """Appends (query_md5, query, raw) of answered queries as parquet, with stored_at; such as report an error are left out.

    A query that is stored again is replaced: stored_responses() and resolve() take its latest row.
    """
    answered = responses.where(F.col("raw").isNotNull() & (F.col("raw") != "") & ~P.envelope(F.col("raw"))["auth_error"])
    answered.withColumn("stored_at", F.unix_micros(F.current_timestamp())).write.mode("append").parquet(path)


def stored_responses(spark: SparkSession, path: str) -> DataFrame:
    """(query_md5, raw) of a store, one row for each query."""
    return latest_responses(spark.read.parquet(path))


def buffered_lines(rows: DataFrame, metres: float, simple: bool = False) -> DataFrame:
    """value of rows (seq, six columns) with the expanded range as the seventh, in place of any that was there.

    simple: of a range that crosses itself only its largest simple loop.
    """
    names = [c for c in rows.columns if c != "seq"]
    center, ring = F.col(names[2]), F.col(names[3])
    if not simple:
        return lines(rows, [*map(F.col, names[:6]), X.expanded_range(center, ring, metres)])
    grown = with_buffers(rows, X.parsed_ring(ring), metres, "_grown")
    return lines(grown, [*map(F.col, names[:6]), X.range_text(F.col("_grown"), center, metres)])
