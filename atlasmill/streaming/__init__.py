"""An extension: addresses that arrive as a stream, each taken once, looked up, and numbered on from batch to batch."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atlasmill.functions import text as T
from atlasmill.plans.resolve import Settings, chosen, empty_streaks, numbered, release, sub_queries
from atlasmill.sources.folders import Versions

#: What keeps a key's state between batches.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def address_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(address) of the lines of files as they appear in a folder."""
    lines = spark.readStream.text(folder).select(T.control_trim(F.col("value")).alias("address"))
    return lines.where((F.col("address") != "") & ~F.col("address").startswith("#"))


def numbered_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """(seq, address) of Parquet files as they appear in a folder; numbers rise from file to file."""
    rows = spark.readStream.schema("seq long, address string").option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    rows = rows.select("seq", T.control_trim(F.col("address")).alias("address"))
    return rows.where((F.col("address") != "") & ~F.col("address").startswith("#"))


def outcomes(stream: DataFrame, responses: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The outcome of each part of each address of a stream (address), from a stored table of responses."""
    each = stream.select(F.lit(0).cast("long").alias("seq"), "address", T.expanded(F.col("address")).alias("subs"))
    parts = each.select("seq", "address", F.size("subs").alias("n_sub"), F.posexplode("subs").alias("sub_pos", "sub"))
    return chosen(parts.withColumn("query_md5", F.md5(F.encode("sub", "UTF-8"))), responses, settings).drop("seq")


def first_occurrences(stream: DataFrame) -> DataFrame:
    """(seq, address) of a stream (seq, address), each address once; the session needs STATE_STORE set, the query the update mode.

    What was seen is kept by address, so state and work are dealt out by it, and a row goes on in the batch it came in: that
    of least seq of the first batch that has an address. All rows of a batch have its time, also when it is run again; a key
    of two times was there before.
    """
    at = stream.select("seq", "address", F.current_timestamp().alias("at"))
    seen = at.groupBy("address").agg(F.min("seq").alias("seq"), F.min("at").alias("first"), F.max("at").alias("last"))
    return seen.where("first = last").select("seq", "address")


class Flow:
    """A sink that resolves each batch (seq, address), and goes on with ids and streaks where the batch before it ended.

    A batch is a version below path, of results and outcomes, whose mark holds where it ended. A batch that is run again,
    after a failure or a restart, starts from the mark of the one before it and replaces what it wrote, so no row is
    doubled and no number given twice. Numbers must rise from batch to batch; an address must come once (first_occurrences()).
    """

    def __init__(self, spark: SparkSession, path: str, responses: Callable[[], DataFrame], settings: Settings = Settings(), threshold: int = 3):
        self.spark, self.responses, self.settings, self.threshold = spark, responses, settings, threshold
        self.batches = Versions(spark, path)

    def _ended(self, batch_id: int) -> dict:
        """Where the last batch before this one ended."""
        earlier = [n for n in self.batches.complete() if n < batch_id]
        return json.loads(self.batches.note(max(earlier))) if earlier else {"next_id": self.settings.first_id, "streak": 0}

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        ended, folder, responses = self._ended(batch_id), self.batches.folder(batch_id), self.responses()
        batch.write.mode("overwrite").parquet(f"{folder}/inputs")  # read by the flow's own session, whose execution is adaptive
        found = chosen(sub_queries(self.spark.read.parquet(f"{folder}/inputs")), responses, self.settings).persist(StorageLevel.MEMORY_AND_DISK)
        results = numbered(found, replace(self.settings, first_id=ended["next_id"]))
        results.write.mode("overwrite").parquet(f"{folder}/results")
        release(results)
        streaks = empty_streaks(found, self.threshold, ended["streak"])
        streaks.select("seq", "sub_pos", "sub", "n_candidates", "streak").write.mode("overwrite").parquet(f"{folder}/outcomes")
        found.unpersist()
        kept = self.spark.read.parquet(f"{folder}/results").agg(F.count_if(F.col("center_lon").isNotNull() & F.col("center_lat").isNotNull()).alias("n")).first()["n"]
        last = self.spark.read.parquet(f"{folder}/outcomes").agg(F.max(F.struct("seq", "sub_pos", "streak")).alias("last")).first()["last"]
        self.batches.commit(batch_id, json.dumps({"next_id": ended["next_id"] + kept, "streak": last["streak"] if last else ended["streak"]}))

    def _read(self, kind: str) -> DataFrame:
        if self.batches.current() is None:
            raise ValueError("no batch is complete yet")
        return self.spark.read.parquet(*[f"{self.batches.folder(n)}/{kind}" for n in self.batches.complete()])

    def results(self) -> DataFrame:
        """resolve()'s columns for all complete batches."""
        return self._read("results")

    def outcomes(self) -> DataFrame:
        """(seq, sub_pos, sub, n_candidates, streak) of all answered parts of all complete batches."""
        return self._read("outcomes")


def start(stream: DataFrame, flow: Flow, checkpoint: str):
    """Runs a stream (seq, address) into a flow until it is stopped or, with what is there, at an end."""
    return first_occurrences(stream).writeStream.outputMode("update").foreachBatch(flow).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
