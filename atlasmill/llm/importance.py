"""Importance resampling of documents towards a target's distribution of hashed n-grams.

Words, features and their crc32 are computed for many texts at once, from the bytes of an Arrow batch: a word's crc32
byte by byte over all words, that of a run of words by moving the first part's crc32 over the second part's length (a
table of linear maps) and an exclusive or. Two passes over the texts count the buckets and add up the gains.

The draw finds the key of the last drawn document exactly: each partition names the median of its remaining keys, the
median of these medians, weighted by the partitions' remaining sizes, is a pivot that has at least a fourth of the keys
on either side, and the side without the cutoff is discarded. Only what is drawn is sorted.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from atlasmill.llm.shared import discard, stored

#: Buckets of features; bytes of text worked on at once (a longer text alone takes some 60 times its bytes).
BUCKETS, PIECE = 10_000, 1 << 21
#: Lengths with a table of their own in moving a crc32; longer words go through zlib and powers of two.
LONGEST = 64
#: Remaining keys that are sorted at once to end the search for the cutoff.
FEW = 4_096
#: A byte's lower-case letter, itself in digits and in characters beyond ASCII, or 0 where no word has it.
LETTERS = np.array([b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0 for b in range(256)], np.uint8)


def _byte_table() -> np.ndarray:
    """The crc32 of single bytes, without the inversions at the ends."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


def _maps() -> tuple[np.ndarray, np.ndarray]:
    """Tables [n][k][byte] that move a crc32's k-th byte over n zero bytes, and the same for 2^n."""
    few = np.zeros((LONGEST + 1, 4, 256), np.uint32)
    few[0] = [np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)]
    for n in range(LONGEST):
        few[n + 1] = BYTES[few[n] & 255] ^ (few[n] >> np.uint32(8))
    powers = np.zeros((31, 4, 256), np.uint32)
    powers[0] = few[1]
    for n in range(30):
        powers[n + 1] = _applied(powers[n], powers[n])
    return few, powers


def _applied(maps: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return maps[0][crc & 255] ^ maps[1][(crc >> np.uint32(8)) & 255] ^ maps[2][(crc >> np.uint32(16)) & 255] ^ maps[3][crc >> np.uint32(24)]


BYTES = _byte_table()
FEW_MAPS, POWER_MAPS = _maps()


def moved(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The part of a crc32 that n more bytes leave of each: the crc32 of x + y is moved(crc32(x), len(y)) ^ crc32(y)."""
    short = np.minimum(n, LONGEST)
    out = FEW_MAPS[short, 0, crc & 255] ^ FEW_MAPS[short, 1, (crc >> np.uint32(8)) & 255] ^ FEW_MAPS[short, 2, (crc >> np.uint32(16)) & 255] ^ FEW_MAPS[short, 3, crc >> np.uint32(24)]
    for i in np.flatnonzero(n > LONGEST):
        c = crc[i : i + 1]
        for k in range(31):
            if int(n[i]) >> k & 1:
                c = _applied(POWER_MAPS[k], c)
        out[i] = c[0]
    return out


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(crc, length, doc) of every word of texts, in order; doc is the text's place."""
    joined = LETTERS[np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)]
    of_word = np.concatenate([[False], joined != 0, [False]])
    edges = np.flatnonzero(of_word[1:] != of_word[:-1])
    start, end = edges[::2], edges[1::2]
    length = end - start
    # the longest first, so that words of at least j bytes are the first ones
    order = np.argsort(-np.minimum(length, LONGEST + 1).astype(np.int16), kind="stable")
    place, left = start[order], length[order]
    long = int((left > LONGEST).sum())
    crc = np.full(len(start), 0xFFFFFFFF, np.uint32)
    reach = len(left) - np.searchsorted(left[long:][::-1], np.arange(LONGEST), "right") if len(left) else np.zeros(LONGEST, int)
    for j in range(LONGEST):
        n = int(reach[j])
        if n <= long:
            break
        crc[long:n] = BYTES[(crc[long:n] ^ joined[place[long:n] + j]) & 255] ^ (crc[long:n] >> np.uint32(8))
    crc = ~crc
    for i in range(long):
        crc[i] = zlib.crc32(joined[place[i] : place[i] + left[i]].tobytes())
    back = np.empty_like(crc)
    back[order] = crc
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return back, length, np.searchsorted(bounds, start, "right")


def features(texts: list[bytes], buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(doc of each word, [(first word, bucket) of the runs of one, two and three words]) of texts."""
    one, length, doc = words(texts)
    n = len(one)
    spaced = one ^ moved(np.full(n, zlib.crc32(b" "), np.uint32), length)  # the crc32 of a space and the word
    run, out = one, [(np.arange(n), one % np.uint32(buckets))]
    for k in (1, 2):
        run = moved(run[: max(n - k, 0)], length[k:] + 1) ^ spaced[k:]
        whole = np.flatnonzero(doc[k:] == doc[: max(n - k, 0)])
        out.append((whole, run[whole] % np.uint32(buckets)))
    return doc, out


def _slices(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first, texts) of a binary column, some PIECE bytes at a time."""
    held, size, first = [], 0, 0
    for i, t in enumerate(column):
        t = t.as_py()
        if held and size + len(t) > PIECE:
            yield first, held
            held, size, first = [], 0, i
        held.append(t)
        size += len(t)
    if held:
        yield first, held


def bucket_counts(texts: DataFrame, text_col: str, buckets: int) -> np.ndarray:
    """How many features of all texts fall in each bucket; a task passes on a row for each bucket at most."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in it:
            for _, some in _slices(b.column(0)):
                for _, at in features(some, buckets)[1]:
                    total += np.bincount(at, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    counted = texts.select(_bytes(text_col)).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in counted.collect():  # one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def _bytes(text_col: str) -> Column:
    return F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("_text")


def gains(all_docs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + n) / ((s + 1)(T + n)))) of n buckets with s of S features in the documents, t of T in the target."""
    n, total, wanted = len(all_docs), int(all_docs.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (total + n) / ((float(s) + 1) * (wanted + n)))) for s, t in zip(all_docs, target)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(id_col, n_words, n_features, weight) of each of docs."""
    table = docs.sparkSession.sparkContext.broadcast(gain)  # a number a bucket

    def weigh(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = np.zeros((3, b.num_rows), np.int64)
            for first, some in _slices(b.column(1)):
                doc, runs = features(some, len(table.value))
                n = np.bincount(doc, minlength=len(some))
                gained = np.zeros(len(doc) + 1, np.int64)
                for at, bucket in runs:
                    gained[at + 1] += table.value[bucket]
                sums, end = np.cumsum(gained), np.cumsum(n)
                here = slice(first, first + len(some))
                out[0, here], out[1, here], out[2, here] = n, n + np.maximum(n - 1, 0) + np.maximum(n - 2, 0), sums[end] - sums[end - n]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, out)], [id_col, "n_words", "n_features", "weight"])

    picked = docs.select(F.col(f"`{id_col}`").cast("long").alias(id_col), _bytes(text_col))
    return picked.mapInArrow(weigh, f"`{id_col}` long, n_words long, n_features long, weight long")


def noise(id_col: str, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u a number in (0, 1) by the hash of seed and id: noise that makes the highest scores a weighted draw."""
    h = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256), F.lit(8)), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


#: A key's columns, best first: the greatest score, then the least id (nulls first), then the row's number.
KEY = ("minus", "id", "row")


def _before(key: tuple, equal: bool) -> Column:
    """Whether a row's key comes before another's, or is equal to it."""
    out = F.lit(equal)
    for c, v in reversed(list(zip(KEY, key))):
        out = (F.col(c) < v) | ((F.col(c) == v) & out)
    return out


def cutoff(keys: DataFrame, k: int) -> tuple | None:
    """The k-th key, from 1, of a stored table of distinct keys (minus, id, row), exactly; None for k = 0."""
    if k < 1:
        return None

    def medians(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in it]
        if sum(len(h[0]) for h in held):
            columns = [np.concatenate(c) for c in zip(*held)]
            order = np.lexsort(columns[::-1])
            at = order[(len(order) - 1) // 2]
            yield pa.RecordBatch.from_arrays([pa.array([len(order)]), *[pa.array([int(c[at])]) for c in columns]], ["n", *KEY])

    left, table, size, passed = keys, keys, None, 0
    while True:
        found = left.mapInArrow(medians, "n long, minus long, id long, row long").collect()  # one row a partition
        remaining = sum(r["n"] for r in found)
        size = size or remaining
        if remaining <= FEW:
            rows = sorted(tuple(r) for r in left.select(*KEY).collect())
            if table is not keys:
                discard(table)
            return rows[k - passed - 1]
        if remaining < size / 4:  # later rounds read what is left only
            old, table = table, stored(left, "keys")
            left, size = table, remaining
            if old is not keys:
                discard(old)
        half, pivot = 0, None
        for r in sorted(found, key=lambda r: tuple(r[c] for c in KEY)):
            half, pivot = half + r["n"], tuple(r[c] for c in KEY)
            if 2 * half >= remaining:
                break
        upto = left.where(_before(pivot, True)).count()
        if passed + upto == k:
            if table is not keys:
                discard(table)
            return pivot
        if passed + upto > k:
            left = left.where(_before(pivot, False))
        else:
            left, passed = left.where(~_before(pivot, True)), passed + upto


def ranked(winners: DataFrame) -> DataFrame:
    """(row, rank) of winners (minus, id, row): a range sort over partitions, whose sizes are summed."""
    ordered = stored(winners.orderBy(*KEY).select("row", F.monotonically_increasing_id().alias("at")), "drawn")
    part = F.shiftright("at", 33)
    sizes = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # a row a partition
    starts = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return ordered.withColumn("part", part).join(starts, "part").select("row", (F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = 5, min_words: int = 20, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """(id_col, n_features, weight, score, rank) of docs: percent of those with at least min_words words are drawn, rank 1 first.

    A document's weight adds up the gains of its features, the runs of one to three words; the score adds noise by the
    id, so that the highest scores are a draw by weight. A null text is empty: no features, weight 0, and not drawn. A
    null id hashes as an empty text and comes first among equal scores. Ids are whole numbers. Repeated rows count, weigh
    and are drawn each by itself; of equal keys any comes first. An empty target gives gains against no features. An empty
    table gives an empty result. Other columns are not read, so names may clash.
    """
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_col, buckets))
    scored = weighed(docs, gain, id_col, text_col).withColumn("score", F.col("weight") + noise(id_col, seed))
    rows = stored(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    keys = rows.where(F.col("n_words") >= min_words).select((-F.col("score")).alias("minus"), F.coalesce(F.col(f"`{id_col}`"), F.lit(-(1 << 63))).alias("id"), "row")
    last = cutoff(keys, percent * keys.count() // 100)
    drawn = ranked(keys.where(_before(last, True) if last else F.lit(False)))
    return rows.join(drawn, "row", "left").select(id_col, "n_features", "weight", "score", "rank")


def drawn(docs: DataFrame, resampled: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that resample() drew, with all columns; rows that share an id go together."""
    return docs.join(resampled.where("rank is not null").select(id_col).distinct(), id_col, "left_semi")
