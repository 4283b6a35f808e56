"""How the sources of each language differ in their terms, over the whole group-term count matrix.

A language's matrix has a row for each source and a column for each kept term, and most of its cells are zero. Its
columns are dealt into blocks and its rows into bands; a task has a block of two bands. There the matrix is a K-squared
tree (K = 2): each level lists the quadrants that hold a count, and all other quadrants are zero throughout. The trees of
the two bands are walked together, all pairs of rows at once: where both rows' quadrants are zero, their difference is
the same in each column and is priced by the number of columns; else the walk goes down, to single cells at last. Blocks
in which two bands hold nothing don't come to a task at all and are priced the same way.

All numbers are whole: shares are in billionths, rounded down, from decimals of 38 digits.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from atlasmill.llm.shared import stored

#: Rows of a band and, on average, columns of a block; a task's work is BAND * BAND * COLUMNS cells at most.
BAND, COLUMNS = 32, 1024
#: Bytes of a text split at once, and terms counted in a task before its counts are passed on.
PIECE, HELD = 1 << 20, 200_000
#: Added to each count.
PRIOR = 5
#: A byte's lower-case letter, or a space where no term has it; bytes of characters beyond ASCII stay.
LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def pieces(text: bytes) -> Iterator[bytes]:
    """A text's letters and spaces in pieces of about PIECE bytes, cut at spaces."""
    text = text.translate(LETTERS)
    start = 0
    while start < len(text):
        end = start + PIECE
        if end < len(text):
            cut = text.rfind(b" ", start, end)
            end = cut if cut > start else text.find(b" ", end)
            end = len(text) if end < 0 else end
        yield text[start:end]
        start = end


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of docs (lang, source, text): occurrences of a term in a group, and documents with it.

    Counts are combined in each task and passed on when it holds many terms, so its memory doesn't grow with its texts.
    """

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def passed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in held.items():
                terms = list(n)
                for at in range(0, len(terms), 100_000):
                    some = terms[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array([t.decode("utf-8", "replace") for t in some], pa.string()), pa.array([n[t] for t in some], pa.int64()), pa.array([d[t] for t in some], pa.int64())],
                        ["lang", "source", "term", "n", "docs"],
                    )
            held.clear()

        for b in it:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                before, seen = len(n), set()
                for piece in pieces(text.as_py()):
                    words = piece.split(b" ")
                    n.update(words)
                    seen.update(words)
                d.update(seen)
                for c in (n, d):
                    c.pop(b"", None)
                size += len(n) - before
                if size > HELD:
                    yield from passed_on()
                    size = 0
        yield from passed_on()

    counted = docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(count, "lang string, source string, term string, n long, docs long")
    # dealt by term once, which both the sums and the window over a term's sources keep to
    return counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + PRIOR) / (total + PRIOR * terms)), exactly; 0 where there are no terms."""
    top = (n + PRIOR).cast("decimal(20,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")
    return F.when(terms > 0, F.call_function("div", top, (total + PRIOR * terms).cast("decimal(20,0)")) + 1).otherwise(0)


class Tree:
    """The quadrants of a matrix that hold a cell, level by level; those of level 0 are the cells.

    codes[l] lists the level's quadrants in ascending order of their interleaved row and column bits.
    """

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, levels: int):
        code = interleaved(row, column)
        order = np.argsort(code)
        self.values, self.codes = value[order], [code[order]]
        for _ in range(levels):
            self.codes.append(np.unique(self.codes[-1] >> np.uint64(2)))

    def find(self, level: int, row: np.ndarray, column: np.ndarray, under: np.ndarray) -> np.ndarray:
        """The places of quadrants in their level, -1 where one is all zero; under: whether the parent isn't."""
        wanted, codes = interleaved(row, column), self.codes[level]
        if not len(codes):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
        return np.where(under & (codes[at] == wanted), at, -1)


def interleaved(row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Bits of row and column in turn, the row's first; both are below 2 ** 31."""
    out = []
    for x in (row, column):
        x = x.astype(np.uint64)
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            x = (x | (x << np.uint64(shift))) & np.uint64(mask)
        out.append(x)
    return (out[0] << np.uint64(1)) | out[1]


def differences(a: Tree, b: Tree, zero_a: np.ndarray, zero_b: np.ndarray, width: int, levels: int, within: bool) -> np.ndarray:
    """The sums over width columns of the absolute differences of each row of a and each of b.

    zero_a and zero_b: the rows' values where they hold no cell. within: both are one band, of whose pairs only those
    with the first row below the second are wanted; others stay 0.
    """
    total = np.zeros((len(zero_a), len(zero_b)), np.int64)
    i = j = c = np.zeros(1, np.int64)
    at_a, at_b = (np.where(len(t.codes[levels]), 0, -1).reshape(1) for t in (a, b))
    for level in range(levels, -1, -1):
        if level == 0:
            va, vb = (np.where(at >= 0, t.values[at] if len(t.values) else 0, z[k]) for t, at, z, k in ((a, at_a, zero_a, i), (b, at_b, zero_b, j)))
            np.add.at(total, (i, j), np.abs(va - vb))
            break
        zero = (at_a < 0) & (at_b < 0)
        if zero.any():
            columns = np.minimum((c[zero] + 1) << level, width) - (c[zero] << level)
            side = np.zeros(((len(zero_a) - 1 >> level) + 1, (len(zero_b) - 1 >> level) + 1), np.int64)
            np.add.at(side, (i[zero], j[zero]), columns)
            spread = side.repeat(1 << level, 0).repeat(1 << level, 1)[: len(zero_a), : len(zero_b)]
            total += spread * np.abs(zero_a[:, None] - zero_b[None, :])
        i, j, c, at_a, at_b = (x[~zero] for x in (i, j, c, at_a, at_b))
        steps = np.array([(x, y, z) for x in (0, 1) for y in (0, 1) for z in (0, 1)]).T
        i, j, c = ((2 * x[:, None] + s).ravel() for x, s in zip((i, j, c), steps))
        under_a, under_b = at_a.repeat(8) >= 0, at_b.repeat(8) >= 0
        down = level - 1
        there = (i << down < len(zero_a)) & (j << down < len(zero_b)) & (c << down < width)
        if within:
            there &= i <= j if down else i < j
        i, j, c, under_a, under_b = (x[there] for x in (i, j, c, under_a, under_b))
        at_a, at_b = a.find(down, i, c, under_a), b.find(down, j, c, under_b)
    return np.triu(total, 1) if within else total


def block_differences(part: pd.DataFrame) -> pd.DataFrame:
    """(lang, i, j, value, columns) of a block of two bands: rows i of the first and j of the second, i < j.

    part has a row for each cell, and for each row of the bands one without a term, whose p is that of a zero.
    """
    lang, first, second = part["lang"].iloc[0], int(part["first"].iloc[0]), int(part["second"].iloc[0])
    listed, cells = part[part["term"].isna()], part[part["term"].notna()]
    names = pd.factorize(cells["term"])
    width = len(names[1])
    empty = pd.DataFrame({"lang": pd.Series([], dtype=str), **{k: pd.Series([], dtype=np.int64) for k in ("i", "j", "value", "columns")}})
    if not width:
        return empty
    levels = max(1, int(max(width, BAND) - 1).bit_length())
    sides = []
    for band in (first, second):
        rows = listed[listed["row"] // BAND == band].sort_values("row")
        mine = (cells["row"] // BAND == band).to_numpy()
        place = np.searchsorted(rows["row"].to_numpy(), cells["row"].to_numpy()[mine])
        sides.append((rows["row"].to_numpy(), rows["p"].to_numpy(np.int64), Tree(place, names[0][mine], cells["p"].to_numpy(np.int64)[mine], levels)))
    (rows_a, zero_a, a), (rows_b, zero_b, b) = sides
    found = differences(a, b, zero_a, zero_b, width, levels, first == second)
    i, j = np.meshgrid(rows_a, rows_b, indexing="ij")
    pick = i < j
    return pd.DataFrame({"lang": lang, "i": i[pick].astype(np.int64), "j": j[pick].astype(np.int64), "value": found[pick], "columns": np.int64(width)})


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = 30, top_terms: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from the others of its language, and in which terms.

    Terms are runs of letters and of characters beyond ASCII, with A-Z lower-cased; a language keeps those in at least
    min_docs of its documents. Part ``pair`` has the summed differences to each other source of the language, all
    ranks; part ``term`` the top_terms kept terms that a source has and that have a greater share in it than in its
    language. Ties go by the item's UTF-8.

    Null text, language and source count as empty. Repeated rows are documents of their own. A group without terms is a
    row of zeros; a language that keeps no term has pairs of value 0 and no terms. A source alone in its language has no
    pairs. An empty table gives an empty result. Other columns are not read, so names may clash. A long text is counted
    piece by piece; the set of its terms is held. The pairs of sources are the result itself, so their number is given.
    """
    picked = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    in_docs = F.sum("docs").over(Window.partitionBy("lang", "term"))
    cells = stored(term_counts(picked).withColumn("in_docs", in_docs).where(F.col("in_docs") >= min_docs).select("lang", "source", "term", "n"), "term-cells")
    terms = stored(cells.groupBy("lang", "term").agg(F.sum("n").alias("lang_n")), "terms")
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    rows = picked.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "terms", "lang_total"])
    zero = share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1  # over sources, not over documents
    groups = stored(rows.select("lang", "source", "total", "terms", "lang_total", number.cast("long").alias("row"), zero.alias("zero"), F.count(F.lit(1)).over(Window.partitionBy("lang")).alias("n_rows")), "term-groups")
    priced = cells.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
    return _pairs(groups, priced).unionByName(_terms(priced, terms, top_terms))


def _pairs(groups: DataFrame, priced: DataFrame) -> DataFrame:
    blocks, bands = F.ceil(F.col("terms") / COLUMNS).cast("long"), F.ceil(F.col("n_rows") / BAND).cast("long")
    band = F.floor(F.col("row") / BAND)
    with_bands = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), bands - 1), lambda x: F.struct(F.least(x, band).alias("first"), F.greatest(x, band).alias("second"))))
    at = ["lang", "row", "term", "p", "block", "bands.first", "bands.second"]
    cells = priced.select("*", F.pmod(F.xxhash64("term"), blocks).alias("block"), with_bands.alias("bands")).select(*at)
    listed = groups.where("terms > 0").withColumn("term", F.lit(None).cast("string")).withColumn("p", F.col("zero"))
    listed = listed.select("*", with_bands.alias("bands")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block")).select(*at)
    found = cells.unionByName(listed).groupBy("lang", "block", "first", "second").applyInPandas(block_differences, "lang string, i long, j long, value long, columns long")
    sums = found.groupBy("lang", "i", "j").agg(F.sum("value").alias("walked"), F.sum("columns").alias("columns"))
    one = groups.select("lang", F.col("row").alias("i"), F.col("source").alias("a"), F.col("zero").alias("zero_a"), "terms")
    two = groups.select("lang", F.col("row").alias("j"), F.col("source").alias("b"), F.col("zero").alias("zero_b"))
    both = one.join(two, "lang").where("i < j").join(sums, ["lang", "i", "j"], "left")
    value = F.coalesce("walked", F.lit(0)) + (F.col("terms") - F.coalesce("columns", F.lit(0))) * F.abs(F.col("zero_a") - F.col("zero_b"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = both.select("lang", value.alias("value"), ways.alias("x")).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    return pairs.withColumn("rank", F.row_number().over(_order()))


def _terms(priced: DataFrame, terms: DataFrame, top: int) -> DataFrame:
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    over = priced.join(terms, ["lang", "term"]).withColumn("value", F.col("p") - q).where("value > 0")
    # ranks are limited before the shuffle, so a source of many terms sends top rows a task
    return over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value").withColumn("rank", F.row_number().over(_order())).where(F.col("rank") <= top)


def _order() -> Window:
    return Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
