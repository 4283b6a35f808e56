"""Shards of near-equal bytes by Karmarkar-Karp differencing over groups that stay whole.

Equal texts are a group. The groups that weigh more than a small part of a shard are items of their own, of which
there can only be so many; all others are dealt by hash into a fixed number of chunks, which are items too. So
differencing has at most ``items`` items of each kind, whatever the table holds, and runs on the driver. Both kinds are
made by the same rule at every size. Combining two partial partitions in opposite orders leaves a spread of at most the
larger of theirs, so shards end apart by no more than the heaviest item weighs, and by a few bytes where items are many.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from atlasmill.llm.shared import stored

#: Chunks of small groups; a group is large beyond total / ITEMS, so there are fewer than this many of those.
ITEMS = 20_480
#: Rows of a shard that are numbered together, about.
RUN_ROWS = 50_000


def karmarkar_karp(weights: dict, parts: int) -> dict:
    """item -> part: repeatedly combines the two partial partitions of largest spread, their sums oppositely ordered."""
    heap = []
    for i, (item, w) in enumerate(sorted(weights.items(), key=lambda x: (-x[1], str(x[0])))):
        heap.append((-w, i, [(0, [])] * (parts - 1) + [(w, [item])]))
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        (_, _, x), (_, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        both = sorted(((a + b, [p, q] if p and q else p or q) for (a, p), (b, q) in zip(x, reversed(y))), key=lambda s: s[0])
        least = both[0][0]  # only differences matter
        both = [(s - least, p) for s, p in both]
        heapq.heappush(heap, (-both[-1][0], n, both))
        n += 1
    out = {}
    for part, (_, tree) in enumerate(heap[0][2] if heap else []):
        stack = [tree]
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack.extend(node)
            else:
                out[node] = part
    return out


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", row_bytes: int = 16, items: int = ITEMS) -> DataFrame:
    """(id_col, size, text_crc32, shard, slot): docs dealt over shards of near-equal bytes, equal texts together.

    A row's size is its text's UTF-8 bytes (null: none) plus row_bytes; crc32 is unsigned, of a null text that of an
    empty one. Slots number a shard's rows from 0 without gaps. A null text is a group of its own with empty texts, so
    rows without text stay together too. Null and repeated ids are rows like others; ties between equal rows are broken
    by their order in hash and size. A very long text is its bytes and a checksum. An empty table gives an empty result. A group larger than a shard's mean makes its
    shard that large: it stays whole.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = stored(docs.select(id_col, (F.octet_length(text) + row_bytes).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("_group")), "shard-rows")
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    runs = -(-n // (shards * RUN_ROWS)) or 1  # a shard's rows are about as many as another's, or its runs longer
    groups = rows.groupBy("_group").agg(F.sum("size").alias("size"))
    large = F.col("size") > total / items
    # fewer than `items` rows in each of the two
    by_group = {r[0]: r[1] for r in groups.where(large).collect()}
    chunk = F.pmod(F.xxhash64(F.lit(2), "_group"), F.lit(items))
    by_chunk = {("chunk", r[0]): r[1] for r in groups.where(~large).groupBy(chunk.alias("c")).agg(F.sum("size")).collect()}
    part = karmarkar_karp(by_group | by_chunk, shards)
    spark = docs.sparkSession
    of_group = spark.createDataFrame([(g, part[g]) for g in by_group], "_group long, _own int")
    of_chunk = spark.createDataFrame([(c[1], part[c]) for c in by_chunk], "_chunk long, _shared int")
    dealt = rows.withColumn("_chunk", chunk).join(F.broadcast(of_group), "_group", "left").join(F.broadcast(of_chunk), "_chunk", "left")
    dealt = dealt.select(id_col, "size", "text_crc32", F.coalesce("_own", "_shared").alias("shard"), F.pmod(F.xxhash64(F.lit(3), id_col, "text_crc32"), F.lit(runs)).cast("int").alias("_run"))
    return numbered(dealt, "shard", "_run", [id_col, "text_crc32", "size"], "slot").drop("_run")


def numbered(df: DataFrame, part: str, run: str, order: list[str], name: str) -> DataFrame:
    """df with numbers from 0 without gaps in each part, run by run: no task takes a whole part of many runs."""
    counts = df.groupBy(part, run).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(part).orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(part, run, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # parts x runs rows
    here = df.withColumn("_at", F.row_number().over(Window.partitionBy(part, run).orderBy(*order)))
    return here.join(starts, [part, run]).withColumn(name, F.col("_start") + F.col("_at") - 1).drop("_start", "_at")
