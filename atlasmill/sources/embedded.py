"""JSON arrays embedded in large text files, cut at their objects' borders by many tasks.

Spark cuts the file at closing braces, wherever its splits lie. Of each piece two numbers are enough: its quotes, whose
sum over the pieces before tells whether it begins inside a string, and then the braces that it opens outside strings,
whose sum tells how deep it lies. Where the depth comes back to nothing an object ends. The sums are made bucket by bucket
over the numbers alone, so no task reads the whole file and texts are shuffled only to meet their object's number and its
other pieces; a row holds one object at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atlasmill.operators import before
from atlasmill.sources import file_lines
from atlasmill.sources.folders import scratch


def _count(text: Column, character: str) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(character), F.lit("")))


def _kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder: the sums read it several times."""
    path = scratch(df.sparkSession, "pieces")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def object_texts(spark: SparkSession, path: str, anchor: str) -> DataFrame:
    """(pos, value): the text of each object of the array that follows the first place of anchor in a file.

    A folder is read as one text, file after file; all of its files but the last must end with a closing brace. The
    array's elements must be objects; space is allowed everywhere. Raises where the anchor isn't found or the array
    doesn't end. An empty array gives no rows. The anchor must not hold a closing brace.
    """
    if "}" in anchor:
        raise ValueError("the anchor holds a closing brace")
    pieces = file_lines(spark, path, lineSep="}").select("seq", "value")
    start = pieces.where(F.col("value").contains(anchor)).agg(F.min("seq").alias("n")).first()["n"]
    if start is None:
        raise ValueError(f"no {anchor!r} in {path}")
    begins = F.regexp_replace(F.substr("value", F.instr("value", anchor) + len(anchor)), r"^\s*\[", "")
    rows = pieces.where(F.col("seq") >= start).select("seq", F.when(F.col("seq") == start, begins).otherwise(F.col("value")).alias("t"))
    rows = _kept(rows)
    bare = F.regexp_replace("t", r"(?s)\\.", "")  # without escaped characters
    opened = lambda body: _count(F.regexp_replace(body, r'(?s)"[^"]*(?:"|$)', ""), "{")
    inside = F.when(F.col("quotes") > 0, F.regexp_replace("bare", r'(?s)^[^"]*"', "")).otherwise("")
    # what a piece opens is found for both cases, so that sums and their shuffles take numbers and no texts
    marks = rows.withColumn("bare", bare).withColumn("quotes", _count(F.col("bare"), '"'))
    marks = marks.select("seq", "quotes", opened(F.col("bare")).alias("outer"), opened(inside).alias("inner"), F.ltrim(F.regexp_replace("t", r"^\s+", "")).startswith("]").alias("closes"))
    marks = before(marks, F.col("quotes"), "seq", "earlier")
    within, at_end = F.col("earlier") % 2 == 1, (F.col("earlier") + F.col("quotes")) % 2 == 1
    change = F.when(within, F.col("inner")).otherwise(F.col("outer")) - F.when(at_end, 0).otherwise(1)
    marks = marks.select("seq", "closes", within.alias("within"), at_end.alias("at_end"), change.alias("change"))
    marks = _kept(before(_kept(marks), F.col("change"), "seq", "depth"))
    closing = ~F.col("within") & (F.col("depth") == 0) & F.col("closes")
    end = marks.where(closing).agg(F.min("seq").alias("n")).first()["n"]
    if end is None:
        raise ValueError(f"the array behind {anchor!r} in {path} does not end")
    ends = ~F.col("at_end") & (F.col("depth") + F.col("change") == 0)
    places = before(marks.where(F.col("seq") < end), F.when(ends, 1).otherwise(0), "seq", "pos").select("seq", "pos")
    numbered = rows.join(places, "seq")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "t"))), lambda p: p["t"])
    joined = numbered.select("pos", "seq", "t").groupBy("pos").agg(F.concat(F.array_join(parts, "}"), F.lit("}")).alias("value"))
    return joined.select("pos", F.regexp_replace("value", r"^[^{]*", "").alias("value"))


def embedded_rows(spark: SparkSession, path: str, anchor: str, schema: str) -> DataFrame:
    """(pos, columns of schema) of the objects of an embedded array; what doesn't fit the schema is null."""
    return object_texts(spark, path, anchor).select("pos", F.from_json("value", schema).alias("row")).select("pos", "row.*")
