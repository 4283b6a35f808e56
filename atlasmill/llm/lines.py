"""Fuzzy line de-duplication by MinHash, in DataFrame functions alone.

A line counts without surrounding spaces. Lines are near where the sets of their runs of ``shingle`` characters (a shorter
line is one run) have a Jaccard similarity of ``jaccard``.

Signatures. The minima are taken over runs of WINDOW bytes, longer than a shingle: scattered edits that leave 0.8 of the
shingles leave 0.71 of these, and lines that aren't near share fewer, so ROWS minima of them make a band. Generated code
computes the minima of one hash under different exclusive-ors from exploded rows. Lines of at most SHORT bytes have few such
runs: they get SHORT_BANDS bands of SHORT_ROWS minima over runs of SHORT_WINDOW bytes as well. Lines that share a band, and
whose numbers of distinct shingles fall in the same or neighbouring classes, meet in a bucket. The classes lose no near pair.

Comparison. Texts are never shuffled but once by document, to fetch one copy of each line that met another; all else goes by
hashes. The numbers of distinct shingles are counted once a line. Pairs are verified by exact Jaccard similarity: first a bucket's most central line (the one that
meets most others, over all bands) with all others, as pairs of hashes; then, in rounds of 8, 128, 2,048 and so on lines of
a bucket against the rest, all pairs across components, until no bucket has lines of two components left to compare.
Union-find over the verified pairs gives the components of all near pairs that share a bucket.

Lines of those rounds get a bitmap of their shingles' hashes, of 3 or more bits for each shingle. Bits in which two bitmaps
differ come of shingles that only one of the lines has, so a pair with more of them than near lines can have is out, and no
near pair is lost. The same holds for bitmaps folded to FOLD words, which are looked at first. There, a pair is compared in
one bucket only, that of the least key that both lines have.

Lines are told apart by 64 bits of hash; two lines that clash there (a second hash shows it) both stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atlasmill.llm.graph import components
from atlasmill.llm.shared import discard, drop_shuffles, parallelism, stored

#: Runs of a line exploded at once, so that no row grows with a line, and runs hashed in one row.
PIECE, STEP = 4096, 16
#: Bytes of a run for signatures and minima in a band; the same and the number of bands for lines of at most SHORT bytes.
WINDOW, ROWS, SHORT, SHORT_WINDOW, SHORT_BANDS, SHORT_ROWS = 12, 2, 100, 8, 6, 2
#: Words of 64 bits in a folded bitmap; shingles for each word of a whole one, at most.
FOLD, LOAD = 8, 20
#: Rounds of comparisons in buckets; the k-th compares about 8 * 16^(k-1) lines of each with all others, so these reach any size.
MAX_ROUNDS = 12


def _constant(k: int) -> int:
    """The k-th multiple of the golden ratio's 64-bit fraction, as a signed long: constants far apart in leading bits."""
    x = (k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)
    return x - (1 << 64) if x >= 1 << 63 else x


def _occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(at: id, hash of the text and number of the line; line; h1) of every line that isn't blank."""
    whole = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.split(text_col, "\n", -1).alias("parts"))
    split = whole.select("id", "th", F.posexplode("parts").alias("no", "line"))  # the hash once a text, which no line's row carries
    return split.withColumn("line", F.trim("line")).where("line <> ''").select(F.struct("id", "th", "no").alias("at"), "line", F.xxhash64("line").alias("h1"))


def _texts(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """(h1, line), each once, of wanted (h1, first, where it stands). Documents are shuffled whole, once, and split where they arrive."""
    of = wanted.groupBy("first.id", "first.th").agg(F.collect_list(F.struct("first.no", "h1")).alias("wanted"))
    whole = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"), F.col(text_col).alias("_text"))
    met = whole.join(of.hint("shuffle_hash"), F.col("_id").eqNullSafe(F.col("id")) & (F.col("_th") == F.col("th")))
    each = met.select(F.split("_text", "\n", -1).alias("parts"), "wanted").select("parts", F.explode("wanted").alias("w"))
    found = each.select(F.col("w.h1").alias("h1"), F.trim(F.get("parts", F.col("w.no"))).alias("line"))
    return found.where(F.xxhash64("line") == F.col("h1")).dropDuplicates(["h1"])  # rows may repeat id and text


def _hashed(data: DataFrame, unit: int, width: int) -> DataFrame:
    """x0 .. x(STEP-1) beside the other columns of data (..., b, last): hashes of the runs of width units of b that start at units 0 to last.

    A row has STEP runs (beyond the end the last again), so that an aggregate is updated once for them all.
    """
    kept = [c for c in data.columns if c not in ("b", "last")]
    pieces = data.select("*", F.explode(F.sequence(F.lit(0), "last", F.lit(PIECE))).alias("c"))
    starts = pieces.select(*data.columns, F.explode(F.sequence("c", F.least(F.col("c") + (PIECE - STEP), "last"), F.lit(STEP))).alias("i"))
    return starts.select(*kept, *[F.xxhash64(F.substring("b", unit * F.least(F.col("i") + j, "last") + 1, F.lit(unit * width))).alias(f"x{j}") for j in range(STEP)])


def _keys(lines: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(h1, key) of lines (h1, line), repeats included: a row for each band, of ``rows`` minima over runs of width bytes."""
    runs = _hashed(lines.select("h1", F.col("line").cast("binary").alias("b"), F.greatest(F.octet_length("line") - width, F.lit(0)).alias("last")), 1, width)
    least = lambda k: F.least(*[F.col(f"x{j}").bitwiseXOR(F.lit(_constant(k))) for j in range(STEP)])
    signed = runs.groupBy("h1").agg(*[F.min(least(k)).alias(f"s{k}") for k in range(bands * rows)])
    keys = [F.xxhash64(F.lit(width), F.lit(at), *[f"s{k}" for k in range(at, at + rows)]) for at in range(0, bands * rows, rows)]
    return signed.select("h1", F.explode(F.array(*keys)).alias("key"))


def _positions(line: Column, shingle: int) -> Column:
    """Where a line's last shingle starts."""
    return F.greatest(F.char_length(line) - shingle, F.lit(0))


def _bitmaps(lines: DataFrame, shingle: int) -> DataFrame:
    """(h1, w0 .. w(FOLD-1), bits) of lines (h1, line).

    bits is a bitmap of the hashes of the shingles as an array of words, FOLD at least and half as many as LOAD asks for or
    more, always a power of two; w0 and so on the same bitmap folded. Words are rows until they are complete.
    """
    n = _positions(F.col("line"), shingle) + 1
    placed = lines.repartition(parallelism(lines.sparkSession), "h1")  # both groupings below keep to it
    words = F.greatest(F.lit(FOLD), F.pow(F.lit(2), F.ceil(F.log2(n / LOAD)))).cast("int")
    sized = placed.select("h1", words.alias("words"), F.encode("line", "UTF-32").alias("b"), (n - 1).alias("last"))
    each = _hashed(sized, 4, shingle).select("h1", "words", F.explode(F.array(*[f"x{j}" for j in range(STEP)])).alias("x"))
    bits = each.select("h1", "words", F.expr("cast(shiftright(x, 6) & (words - 1) as int)").alias("word"), F.expr("shiftleft(1L, cast(x & 63 as int))").alias("bits"))
    set_ = bits.groupBy("h1", "words", "word").agg(F.bit_or("bits").alias("bits"))
    folded = [F.coalesce(F.bit_or(F.when(F.col("word") % FOLD == k, F.col("bits"))), F.lit(0).cast("long")).alias(f"w{k}") for k in range(FOLD)]
    maps = set_.groupBy("h1", "words").agg(*folded, F.collect_list(F.struct("word", "bits")).alias("set"))
    blank = F.transform(F.array_except(F.sequence(F.lit(0), F.col("words") - 1), F.col("set.word")), lambda k: F.struct(k.alias("word"), F.lit(0).cast("long").alias("bits")))
    whole = F.array_sort(F.when(F.size("set") < F.col("words"), F.concat("set", blank)).otherwise(F.col("set")))
    return maps.select("h1", *[f"w{k}" for k in range(FOLD)], whole["bits"].alias("bits"))


def _alike(a: Column, b: Column, jaccard: float) -> Column:
    """Whether lines of a and b distinct shingles can be near."""
    return (a + 1e-6 >= b * jaccard) & (b + 1e-6 >= a * jaccard)


def _possible(a: str, b: str, jaccard: float) -> Column:
    """Whether bitmaps leave it open that two lines are near; looks at the cheapest signs first."""
    most = (F.col(f"{a}.d") + F.col(f"{b}.d")) * ((1 - jaccard) / (1 + jaccard)) + 1e-6
    sizes = _alike(F.col(f"{a}.d"), F.col(f"{b}.d"), jaccard)
    folded = sum((F.bit_count(F.col(f"{a}.w{k}").bitwiseXOR(F.col(f"{b}.w{k}"))) for k in range(1, FOLD)), F.bit_count(F.col(f"{a}.w0").bitwiseXOR(F.col(f"{b}.w0"))))
    x, y = F.col(f"{a}.bits"), F.col(f"{b}.bits")
    differ = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda s, v: s + v)
    half = lambda z: F.zip_with(F.slice(z, 1, (F.size(z) / 2).cast("int")), F.slice(z, (F.size(z) / 2 + 1).cast("int"), (F.size(z) / 2).cast("int")), lambda u, v: u.bitwiseOR(v))
    whole = F.when(F.size(x) == F.size(y), differ(x, y) <= most).when(F.size(x) == 2 * F.size(y), differ(half(x), y) <= most).when(2 * F.size(x) == F.size(y), differ(x, half(y)) <= most).otherwise(True)
    return sizes & (folded <= most) & whole


def _shingles(line: str, shingle: int) -> Column:
    """The hashes of a line's shingles, repeats included. The outer lambda's variable holds the encoded line, encoded once."""
    runs = lambda b: F.transform(F.sequence(F.lit(1), 4 * _positions(F.col(line), shingle) + 1, F.lit(4)), lambda i: F.xxhash64(F.substring(b, i, F.lit(4 * shingle))))
    return F.get(F.transform(F.array(F.encode(line, "UTF-32")), runs), 0)


def _counts(lines: DataFrame, shingle: int) -> DataFrame:
    """(h1, d) of lines (h1, line): the number of distinct shingles, by hash."""
    placed = lines.repartition(parallelism(lines.sparkSession), "h1")  # not fewer tasks, as their bytes would ask for
    return placed.select("h1", F.size(F.array_distinct(_shingles("line", shingle))).cast("long").alias("d"))


def _verified(pairs: DataFrame, lines: DataFrame, shingle: int, jaccard: float) -> DataFrame:
    """pairs (a, b) of lines (h1, line) with near, whether their Jaccard similarity is at least jaccard.

    Not filtered here: a filter would be pushed below the columns that it needs, and build them again.
    """
    tasks = parallelism(pairs.sparkSession)  # not fewer, as their bytes would ask for: the work is in the sets
    left = pairs.join(lines.select(F.col("h1").alias("a"), F.col("line").alias("x")), "a").repartition(tasks, "b")
    both = left.join(lines.select(F.col("h1").alias("b"), F.col("line").alias("y")), "b")
    runs = both.select("a", "b", _shingles("x", shingle).alias("x"), _shingles("y", shingle).alias("y"))
    counted = runs.select("a", "b", F.size(F.array_intersect("x", "y")).alias("both"), F.size(F.array_union("x", "y")).alias("all"))
    return counted.select("a", "b", (F.col("both") >= jaccard * F.col("all")).alias("near"))


def _apart(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """rows (key, h1, ...) with part, the component of h1, in buckets that have lines of several components."""
    named = rows.drop("part").join(parts.select(F.col("node").alias("h1"), F.col("component").alias("part")), "h1", "left").withColumn("part", F.coalesce("part", "h1"))
    split = named.groupBy("key").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least < most").select("key")
    return named.join(split, "key")


def _left_maps(rest: DataFrame, texts: DataFrame, counts: DataFrame, shingle: int) -> DataFrame:
    """(h1, d, keys, bitmap) of the lines that rest (key, h1, ...) leaves in buckets, with those of their keys."""
    left = rest.groupBy("h1").agg(F.collect_list("key").alias("keys"))
    lines = texts.select("h1", "line").join(left.select("h1"), "h1")
    return _bitmaps(lines, shingle).join(left.join(counts, "h1"), "h1")


def near_lines(lines: DataFrame, fetch: Callable[[DataFrame], DataFrame], shingle: int, jaccard: float, bands: int) -> DataFrame:
    """(node, component) of each line h1 that is near a lesser one; raises if MAX_ROUNDS leave pairs uncompared.

    lines (h1, line) may repeat lines; fetch gives (h1, line), each once, of those of a table's h1 that are not to be left out.
    """
    short = _keys(lines.where(F.octet_length("line") <= SHORT), SHORT_WINDOW, SHORT_BANDS, SHORT_ROWS)
    dealt = _keys(lines, WINDOW, bands, ROWS).unionByName(short).repartition(parallelism(lines.sparkSession), "key")
    # least keeps h1 in the shuffle, which the join then takes as well
    sizes = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("h1").alias("least")).where("size > 1 and least is not null")
    met = stored(dealt.join(sizes.hint("shuffle_hash"), "key").select("key", "h1", "size"), "line-buckets")
    drop_shuffles(lines.sparkSession)
    central = met.groupBy("h1").agg(F.sum("size").alias("met"))
    texts = stored(fetch(central.select("h1")), "line-candidates")
    drop_shuffles(lines.sparkSession)
    counts = stored(_counts(texts, shingle), "line-counts")
    # near lines' numbers differ by a factor of at most 1 / jaccard, so that they share one of two neighbouring classes
    step = F.floor(F.log("d") / F.log(F.lit(1.001 / jaccard)))
    classed = met.join(central, "h1").join(counts, "h1").select("h1", "met", "key", F.explode(F.array(step, step + 1)).alias("class"))
    classed = classed.select("h1", "met", F.xxhash64("key", "class").alias("key")).repartition(parallelism(lines.sparkSession), "key")
    pivots = classed.groupBy("key").agg(F.max(F.struct("met", "h1")).alias("pivot"), F.count(F.lit(1)).alias("size")).where("size > 1")
    # a bucket's lines but the most central one by a number of their own in [0, size): about as many as wanted are below it
    rank = (F.pmod(F.xxhash64("key", "h1"), F.lit(1 << 40)) / float(1 << 40)) * F.col("size")
    rest = classed.join(pivots.select("key", "size", F.col("pivot.h1").alias("pivot")), "key").where("h1 <> pivot")
    rest = stored(rest.select("key", "h1", rank.alias("rank"), F.col("h1").alias("part"), "pivot"), "line-rest")
    discard(met)  # with the shuffles of the steps before
    pairs = stored(rest.select(F.least("h1", "pivot").alias("a"), F.greatest("h1", "pivot").alias("b")).distinct(), "line-pairs")
    parts, held, maps = None, rest, None
    for k in range(MAX_ROUNDS):
        checked = stored(_verified(pairs, texts.select("h1", "line"), shingle, jaccard), "line-links")
        links = checked.where("near").select("a", "b")
        discard(pairs)
        if parts is None or not links.isEmpty():
            # what is known of components stands for the links it came of
            last, edges = parts, links if parts is None else links.unionByName(parts.select(F.col("node").alias("a"), F.col("component").alias("b")))
            parts = components(edges, "a", "b")
            if last is not None:
                discard(last)
        discard(checked)
        rest = stored(_apart(rest.drop("pivot"), parts), "line-rest")
        discard(held)
        held = rest
        if rest.isEmpty():
            discard(rest, texts, counts, *([maps] if maps is not None else []))
            return parts
        if maps is None:
            maps = stored(_left_maps(rest, texts, counts, shingle), "line-bitmaps")
        limit = 8 * 16**k
        wide = rest.join(maps, "h1")
        in_order = F.expr("a.key = b.key and a.part <> b.part and (a.rank < b.rank or a.rank = b.rank and a.h1 < b.h1)")
        once = F.expr("array_min(array_intersect(a.keys, b.keys)) = a.key")
        open_ = wide.where(F.col("rank") < limit).alias("a").join(wide.alias("b"), in_order & _possible("a", "b", jaccard) & once)
        pairs = stored(open_.select(F.col("a.h1").alias("a"), F.col("b.h1").alias("b")), "line-pairs")
        rest = rest.where(F.col("rank") >= limit)
    raise RuntimeError(f"lines of a bucket are left to compare after {MAX_ROUNDS} rounds")


def _copies(rows: DataFrame) -> DataFrame:
    """rows (_id, _th, ...) with _copy, true in all but one of those that agree in both."""
    numbered = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "line-copies")
    first = numbered.groupBy(F.col("_id").alias("_first_id"), F.col("_th").alias("_first_th")).agg(F.min("_row").alias("_first"))
    at = F.col("_id").eqNullSafe(F.col("_first_id")) & (F.col("_th") == F.col("_first_th"))
    return numbered.join(first, at).withColumn("_copy", F.col("_row") > F.col("_first")).drop("_row", "_first", "_first_id", "_first_th")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 8, jaccard: float = 0.8, bands: int = 10) -> DataFrame:
    """docs with text_col less every line that is near an earlier one, and columns n_lines and n_removed.

    Of each component of near or equal lines one stays: that of the least (id, hash of the text, position), nulls first; of
    rows that repeat both id and text one keeps it. Blank lines stay. A null text stays null, with 0 lines; an empty one
    has one. An empty table gives an empty result. Columns of docs that are named like those added are replaced, all
    others kept. A line's shingles are held at once while it is compared, a line of n characters takes some 20 n bytes.
    """
    at = _occurrences(docs, id_col, text_col)
    drop_shuffles(docs.sparkSession)
    hashed = stored(at.select("at", "h1", F.xxhash64(F.lit(1), "line").alias("h2")), "line-hashes")
    whole = hashed.groupBy("h1").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.min("h2").alias("lo"), F.max("h2").alias("hi"))
    places = stored(whole.where("lo = hi").drop("lo", "hi"), "line-places")
    parts = near_lines(at.select("h1", "line"), lambda met: _texts(docs, id_col, text_col, places.join(met, "h1").select("h1", "first")), shingle, jaccard, bands)
    members = parts.select(F.col("node").alias("h1"), F.col("component").alias("part"))
    members = members.unionByName(members.select(F.col("part").alias("h1"), "part").distinct())
    again = places.join(members, "h1", "left").where("n > 1 or part is not null").withColumn("part", F.coalesce("part", "h1"))
    kept = again.groupBy("part").agg(F.min("first").alias("kept"))
    repeated = stored(again.join(kept, "part").select("h1", "kept"), "line-repeated")
    discard(parts, places)
    place = hashed.select("at", "h1").join(repeated, "h1")
    stays = F.col("at") == F.col("kept")
    by_row = place.groupBy(F.col("at.id").alias("_gone_id"), F.col("at.th").alias("_gone_th")).agg(
        F.collect_set(F.when(~stays, F.col("at.no"))).alias("_gone"), F.count_if(stays).alias("_n"), F.size(F.collect_set(F.when(stays, F.col("at.no")))).alias("_n_once")
    )
    # rows that repeat id and text show in a kept line that comes more than once
    gone = stored(by_row.select("_gone_id", "_gone_th", "_gone", (F.col("_n") > F.col("_n_once")).alias("_twice")).where(F.col("_twice") | (F.size("_gone") > 0)), "line-gone")
    discard(hashed, repeated)
    named = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = docs.select(*[F.col(f"`{c}`") for c in named], F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"))
    rows = rows.join(gone.hint("shuffle_hash"), F.col("_id").eqNullSafe(F.col("_gone_id")) & (F.col("_th") == F.col("_gone_th")), "left").withColumn("_copy", F.lit(False))
    if not gone.where("_twice").isEmpty():
        twice = F.coalesce("_twice", F.lit(False))
        rows = rows.where(~twice).unionByName(_copies(rows.where(twice).drop("_copy")).select(rows.columns))
    rows = rows.withColumn("_parts", F.split(F.col(f"`{text_col}`"), "\n", -1))  # a column: split once a text, not once a line
    parts_of = F.col("_parts")
    numbers = F.sequence(F.lit(0), F.size(parts_of) - 1)
    less = F.array_except(numbers, F.col("_gone"))
    blank = F.filter(numbers, lambda i: F.trim(F.get(parts_of, i)) == "")
    left = F.when(F.col("_copy"), blank).otherwise(less)
    touched = F.col("_copy") | (F.size("_gone") > 0)
    text = F.when(touched, F.array_join(F.transform(left, lambda i: F.get(parts_of, i)), "\n")).otherwise(F.col(f"`{text_col}`"))
    n_lines = F.when(F.col(f"`{text_col}`").isNull(), 0).otherwise(F.size(parts_of))
    removed = F.when(touched, n_lines - F.size(left)).otherwise(0)
    return rows.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in named], n_lines.alias("n_lines"), removed.alias("n_removed"))
