"""A keyed store of responses: bucketed by the query's digest, shredded by field, and compacted in versions.

A response is stored as a row of its own (idx -1, with its text) and a row for each place that it names, whose JSON object
is a VARIANT; Spark shreds the fields that most of a file's objects share into columns of their own, so that a lookup
reads the paths it asks for and no text. All rows of a query are in one bucket. Which of a query's responses counts, and
which places it names, is found bucket by bucket, so neither texts nor places are shuffled by a lookup; a join deals out
the other side to the same buckets.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from atlasmill.functions import responses as P
from atlasmill.functions import text as T
from atlasmill.sources.folders import Versions

SCHEMA = "query_md5 string, rid bigint, ok boolean, error_code int, stored_at bigint, idx int, doc variant, raw string"
#: A query's last answer counts; a response that reports an error counts only where there is no answer.
ORDER = ("ok", "stored_at", "rid")


class ResponseStore:
    """Responses below a path. buckets is fixed when the store is made; one writer at a time.

    Appending the same responses again, with the same stored_at, and compacting again change no result.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.buckets, self.versions = spark, buckets, Versions(spark, path)
        if self.versions.current() is None:
            n = self.versions.following()
            self._register(n)
            self.versions.commit(n)

    def _register(self, version: int) -> str:
        """The version's table in the session's catalog, made where it isn't there."""
        folder = self.versions.folder(version)
        name = f"responses_{hashlib.md5(folder.encode()).hexdigest()[:16]}"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({SCHEMA}) USING parquet CLUSTERED BY (query_md5) SORTED BY (query_md5) INTO {self.buckets} BUCKETS LOCATION '{folder}'")
        return name

    def rows(self) -> DataFrame:
        return self.spark.table(self._register(self.versions.current()))

    def _write(self, rows: DataFrame, version: int) -> None:
        name = self._register(version)
        writer = rows.select(*self.spark.table(name).columns).write.bucketBy(self.buckets, "query_md5").sortBy("query_md5")
        writer.format("parquet").mode("append").option("path", self.versions.folder(version)).saveAsTable(name)

    def append(self, responses: DataFrame) -> None:
        """Adds responses (query or query_md5, raw, and stored_at in microseconds unless now); null and empty texts are left out.

        Of a query's responses in one batch that is stored which counts; copies are combined before they are shuffled.
        """
        digest = F.col("query_md5") if "query_md5" in responses.columns else T.query_digest(F.col("query"))
        at = F.col("stored_at").cast("bigint") if "stored_at" in responses.columns else F.unix_micros(F.current_timestamp())
        given = responses.where("raw is not null and raw <> ''").select(digest.alias("query_md5"), at.alias("stored_at"), "raw")
        headed = given.select("query_md5", (~P.head(F.col("raw"))["auth_error"]).alias("ok"), "stored_at", F.xxhash64("raw").alias("rid"), "raw")
        best = headed.groupBy("query_md5").agg(F.max(F.struct(*ORDER, "raw")).alias("best")).select("query_md5", "best.*")
        head = best.withColumn("head", P.head(F.col("raw")))
        none = F.lit(None)
        own = F.array(F.struct(F.lit(-1).alias("idx"), none.cast("variant").alias("doc"), F.col("raw")))
        places = F.filter(F.transform("head.content", lambda v, i: F.struct(i.alias("idx"), v.alias("doc"), none.cast("string").alias("raw"))), lambda s: P.is_object(s["doc"]))
        # outer, though there is always a row: else Spark parses all texts once more to filter by their places
        each = head.select("query_md5", "rid", "ok", "stored_at", F.col("head.error_code").alias("error_code"), F.explode_outer(F.concat(own, F.when(F.col("ok"), places).otherwise(F.slice(places, 1, 0)))).alias("row"))
        flat = each.select("query_md5", "rid", "ok", "error_code", "stored_at", "row.*").repartition(self.buckets, "query_md5")  # a file a bucket
        self._write(flat, self.versions.current())

    def _counting(self, rows: DataFrame) -> DataFrame:
        """rows of the responses that count."""
        best = rows.withColumn("_best", F.max(F.struct(*ORDER)).over(Window.partitionBy("query_md5")))
        return best.where(F.struct(*ORDER) == F.col("_best")).drop("_best")

    def lookup(self) -> DataFrame:
        """(query_md5, outcome) of every query: what functions.responses.envelope() makes of the text that counts."""
        rows = self.rows().select("query_md5", *ORDER, "error_code", F.when(F.col("idx") >= 0, P.fields(F.col("doc"), F.col("idx"))).alias("place"))
        found = self._counting(rows).groupBy("query_md5").agg(F.bool_and("ok").alias("ok"), F.max("error_code").alias("code"), F.array_sort(F.collect_set("place")).alias("places"))
        return found.select("query_md5", F.struct((~F.col("ok")).alias("auth_error"), F.col("code").alias("error_code"), F.col("places").alias("candidates")).alias("outcome"))

    def texts(self) -> DataFrame:
        """(query_md5, raw): the text of each query that counts."""
        rows = self.rows().where("idx = -1").select("query_md5", *ORDER, "raw")
        return self._counting(rows).dropDuplicates(["query_md5"]).select("query_md5", "raw")

    def compact(self) -> None:
        """A new version of the responses that count, a file a bucket; the old one stays until prune(), for running readers."""
        n = self.versions.following()
        self._write(self._counting(self.rows()).dropDuplicates(["query_md5", "rid", "idx"]), n)
        self.versions.commit(n)

    def prune(self) -> None:
        """Deletes versions that don't count."""
        self.versions.prune()
