"""Readers of address lists, responses, tables of tabs, embedded JSON and properties."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from atlasmill.functions import text as T
from atlasmill.sources.folders import Versions


def rewritten(spark: SparkSession, path: str) -> Versions:
    """Versions of a path that a rewrite has made and not yet put in its place."""
    return Versions(spark, f"{path.rstrip('/')}.versions")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(seq, value): lines numbered from 0 without gaps; a file's lines follow each other in order, and files by path."""
    return file_lines(spark, path).select("seq", "value")


def file_lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """(seq, line_no, value): numbered_lines() with a line's place in its own file.

    Spark reads splits of files in an order of its own, by size. Rows are counted by split, a window over the splits
    (a row for each, whatever they hold) sums the counts by path and offset, and each line adds its place in the split.
    Where a rewrite of the path is complete but not yet in its place, its lines are read.
    """
    held = rewritten(spark, path)
    if (n := held.current()) is not None:
        path = held.folder(n)
    split = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")]
    rows = spark.read.options(**options).text(path).select(*split, F.monotonically_increasing_id().alias("_at"), "value")
    counts = rows.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    earlier = lambda w: F.coalesce(F.sum("_n").over(w.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_file", "_start", "_first", earlier(Window.partitionBy()).alias("_before"), earlier(Window.partitionBy("_file")).alias("_in_file"))
    place = F.col("_at") - F.col("_first")
    return rows.join(starts, ["_file", "_start"]).select((F.col("_before") + place).alias("seq"), (F.col("_in_file") + place).alias("line_no"), "value")


def addresses(spark: SparkSession, path: str, header: str | None = None, fallback: str | None = None) -> DataFrame:
    """(seq, address): trimmed lines but blank ones, those that # begins, and the header wherever it stands.

    fallback: another path, read where the first is no file on this machine.
    """
    if fallback is not None and "://" not in path and not Path(path).is_file():
        path = fallback
    return address_rows(numbered_lines(spark, path).withColumnRenamed("value", "address"), header)


def address_rows(lines: DataFrame, header: str | None = None) -> DataFrame:
    kept = lines.withColumn("address", T.control_trim(F.col("address"))).where((F.col("address") != "") & ~F.col("address").startswith("#"))
    return kept.where(F.col("address") != header) if header else kept


def response_cache(spark: SparkSession, path: str) -> DataFrame:
    """(query_md5, raw) of a folder of files <md5 of the query>.json, or of one such file."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1).alias("query_md5"), F.col("value").alias("raw"))


def golden_response(spark: SparkSession, path: str, fallback: str | None = None) -> DataFrame:
    """(query_md5, raw) of one response's file, a known good one; of the fallback where the first is no file, else an error."""
    found = next((p for p in (path, fallback) if p is not None and ("://" in p or Path(p).is_file())), None)
    if found is None:
        raise FileNotFoundError(f"neither {path} nor {fallback}")
    return response_cache(spark, found)


def tab_rows(spark: SparkSession, path: str, names: list[str], header: bool = False, exact: bool = False) -> DataFrame:
    """Columns by position of files of tabs without quoting, blank lines left out; a row with fewer columns raises.

    seq is the line's place; further columns than named are left out, or raise too if exact. header: each file's first
    line goes. A line of tabs and spaces alone is blank.
    """
    rows = _parted(spark, path, names, header, exact)
    whole = F.when(F.col("bad"), F.raise_error(F.concat(F.lit("not the columns expected: " if exact else "too few columns: "), "value")).cast("array<string>")).otherwise(F.col("p"))
    return rows.select("seq", whole.alias("p")).select("seq", *[F.col("p")[i].alias(n) for i, n in enumerate(names)])


def _parted(spark: SparkSession, path: str, names: list[str], header: bool, exact: bool) -> DataFrame:
    """(seq, line_no, value, p, bad) of lines that aren't blank."""
    lines = file_lines(spark, path).where(T.control_trim(F.col("value")) != "")
    if header:
        lines = lines.where(F.col("line_no") != 0)
    rows = lines.withColumn("p", F.split("value", "\t", -1))
    return rows.withColumn("bad", (F.size("p") != len(names)) if exact else (F.size("p") < len(names)))


class TooManyBadRows(ValueError):
    """More rows were kept apart than the caller allows."""


def tab_rows_apart(spark: SparkSession, path: str, names: list[str], apart: str, header: bool = False, exact: bool = False, most: int | None = None) -> DataFrame:
    """tab_rows() that sets bad lines apart instead of ending the job: (seq, line_no, reason, value) at apart, as Parquet.

    One pass over the files writes good and bad lines side by side, by kind, to a new version below apart, and counts
    both as it goes. More than ``most`` bad lines raise TooManyBadRows once the pass is over, with all of them written; the
    version before them then still counts. None: any number.
    """
    rows = _parted(spark, path, names, header, exact)
    reason = F.format_string(f"%d columns, {len(names)} expected", F.size("p"))
    row = F.when(~F.col("bad"), F.struct(*[F.get("p", F.lit(i)).alias(n) for i, n in enumerate(names)]))
    seen = Observation()
    kept = rows.select("seq", "line_no", F.when(F.col("bad"), reason).alias("reason"), F.when(F.col("bad"), F.col("value")).alias("value"), row.alias("row"), F.when(F.col("bad"), "bad").otherwise("good").alias("kind"))
    versions = Versions(spark, apart)
    n = versions.following()
    kept.observe(seen, F.count_if(F.col("kind") == "bad").alias("bad")).write.partitionBy("kind").parquet(versions.folder(n))
    if most is not None and seen.get["bad"] > most:
        raise TooManyBadRows(f"{seen.get['bad']} bad lines, {most} allowed: {versions.folder(n)}")
    versions.commit(n)
    return _of_kind(spark, versions.folder(n), kept, "good").select("seq", "row.*")


def _of_kind(spark: SparkSession, folder: str, like: DataFrame, kind: str) -> DataFrame:
    return spark.read.schema(like.schema).parquet(folder).where(F.col("kind") == kind)


def bad_rows(spark: SparkSession, apart: str) -> DataFrame:
    """(seq, line_no, reason, value) of the lines that the last tab_rows_apart() set apart."""
    versions = Versions(spark, apart)
    schema = "seq long, line_no long, reason string, value string, kind string"
    return spark.read.schema(schema).parquet(versions.folder(versions.current())).where("kind = 'bad'").drop("kind")


def labels(spark: SparkSession, path: str) -> DataFrame:
    """(seq, label, district, station, address, code) of a label table with a header line."""
    return tab_rows(spark, path, ["label", "district", "station", "address", "code"], header=True)


def embedded_json(spark: SparkSession, path: str, pattern: str, schema: str) -> DataFrame:
    """Rows of the JSON array that the pattern's first group finds in a file, one by one with their place."""
    found = spark.read.text(path, wholetext=True).select(F.from_json(F.regexp_extract("value", pattern, 1), f"array<{schema}>").alias("rows"))
    return found.select(F.posexplode("rows").alias("pos", "row")).select("pos", "row.*")


def properties(path: str | None, defaults: dict[str, str | int | bool]) -> dict[str, str | int | bool]:
    """defaults with the values of a file of key=value lines; a blank value and a number that isn't one keep the default."""
    found = dict(defaults)
    if path is None or not Path(path).is_file():
        return found
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        key, sign, value = line.partition("=")
        key, value = key.strip(), value.strip()
        if not sign or key.startswith(("#", "!")) or not value or key not in defaults:
            continue
        if isinstance(defaults[key], bool):
            found[key] = value.lower() == "true"
        elif isinstance(defaults[key], int):
            try:
                found[key] = int(value)
            except ValueError:
                found[key] = defaults[key]
        else:
            found[key] = value
    return found
