"""Tables of keywords, found in a text in one pass: an automaton over all patterns, built once and shared with the tasks.

A keyword is found where it stands anywhere in a text, also within other words and other keywords. The first row of the
table whose keyword is found wins. A table of any length is dealt into automata of at most LIMIT keywords; each is sent to
the tasks by itself, and a text takes one pass for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atlasmill.functions import rules as R

#: Keywords of one automaton; one of 100,000 keywords of ten characters takes some 60 MB.
LIMIT = 200_000
FOUND = "array<struct<place:bigint,value:string>>"
#: Bytes of texts, and keywords found, after which a task hands on what it has; a batch of long texts finds millions.
TEXT_BYTES, HITS = 1 << 20, 1 << 18


def _automaton(rows: list[tuple[str, int, str]]):
    """An automaton of (keyword, place, value) in order of place, of which the first of equal keywords counts; and the
    places and values by row, of which the automaton keeps the row's number only."""
    built = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, (keyword, _, _) in enumerate(rows):
        if keyword not in built:
            built.add_word(keyword, i)
    built.make_automaton()
    return built, pa.array([p for _, p, _ in rows], pa.int64()), pa.array([v for _, _, v in rows], pa.string())


class Keywords:
    """A table of keywords in an order. Null keywords are none; an empty one is found in every text."""

    def __init__(self, spark: SparkSession, rows: list[tuple[str, int, str]], limit: int = LIMIT):
        rows = sorted((r for r in rows if r[0] is not None), key=lambda r: r[1])
        self.empty = next(((place, value) for keyword, place, value in rows if keyword == ""), None)
        rows = [r for r in rows if r[0] != ""]
        self.shared: list[Broadcast] = [spark.sparkContext.broadcast(_automaton(rows[i : i + limit])) for i in range(0, len(rows), limit)]

    def _parts(self, text: Column, first: bool) -> list[Column]:
        parts = [_lookup(b, first)(text) for b in self.shared]
        own = [] if self.empty is None else [F.array(F.struct(F.lit(self.empty[0]).cast("bigint").alias("place"), F.lit(self.empty[1]).alias("value")))]
        return parts + [F.when(text.isNotNull(), c) for c in own]

    def first(self, text: Column) -> Column:
        """The value of the first row whose keyword stands in text; null without one, and for a null text."""
        parts = self._parts(text, True)
        return F.array_min(F.concat(*parts))["value"] if parts else F.lit(None).cast("string")

    def every(self, text: Column) -> Column:
        """The values of all rows whose keywords stand in text, in the table's order; null for a null text."""
        parts = self._parts(text, False)
        found = F.array_sort(F.concat(*parts)) if parts else F.array().cast(FOUND)
        return F.when(text.isNotNull(), F.transform(found, lambda f: f["value"]))

    def any(self, text: Column) -> Column:
        return F.coalesce(F.size(F.concat(*self._parts(text, True))) > 0, F.lit(False)) if self.shared or self.empty else F.lit(False)

    def release(self) -> None:
        for b in self.shared:
            b.destroy()


def _lookup(shared: Broadcast, first: bool):
    @F.arrow_udf(FOUND)
    def lookup(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton, places, values = shared.value

        def made(found: list[np.ndarray | None]) -> pa.Array:
            """The rows found in each text, as an array without an object for each."""
            ends = np.cumsum([0 if f is None else len(f) for f in found])
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32), mask=np.array([f is None for f in found] + [False]))
            at = pa.array(np.concatenate([np.zeros(0, np.int64), *[f for f in found if f is not None]]))
            return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([places.take(at), values.take(at)], ["place", "value"]))

        for texts in batches:
            found, size, hits = [], 0, 0
            for text in texts:
                text = text.as_py()
                at = None if text is None else {i for _, i in automaton.iter(text)}
                found.append(None if at is None else np.array([min(at)] if at and first else sorted(at), np.int64))
                size, hits = size + len(text or ""), hits + len(at or ())
                if size >= TEXT_BYTES or hits >= HITS:
                    yield made(found)
                    found, size, hits = [], 0, 0
            if found or not len(texts):
                yield made(found)

    return lookup


def of_table(table: DataFrame, keyword: str, value: str, order: str, limit: int = LIMIT) -> Keywords:
    """The keywords of a table, whose order numbers are whole and tell its rows apart.

    The table is read by the driver, which builds the automata; of repeated keywords only the first is. A gazetteer of some
    millions of rows is the intended size: the driver holds it while it builds.
    """
    first = table.where(F.col(keyword).isNotNull()).groupBy(keyword).agg(F.min(F.struct(F.col(order).cast("bigint").alias("place"), F.col(value).cast("string").alias("value"))).alias("row"))
    rows = [(r[keyword], r["place"], r["value"]) for r in first.select(keyword, "row.*").toLocalIterator()]
    return Keywords(table.sparkSession, rows, limit)


def districts(spark: SparkSession) -> Keywords:
    """The fixed list behind functions.text.district_of(): areas first, then districts without their last character."""
    rows = [*R.AREA_DISTRICTS, *((d[:-1], d) for d in R.DISTRICTS)]
    return Keywords(spark, [(k, i, d) for i, (k, d) in enumerate(rows)])
