"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within radius r have a common variant within r / 2 of both. Every fingerprint therefore emits all its
variants within half the radius; those that share a variant are within r of each other, always, so a star from the
least member of each variant's bucket loses no link and never needs all pairs. A bucket holds as many fingerprints as
a ball has points at most (2,081 for radius 2 in 64 bits), whatever the corpus holds.

Variants go to their bucket in two steps. The shuffle routes by the variant's leading bits: a fingerprint sends one row
for each way to flip up to two of those, and the flips in the other bits are made where the row arrives, since they
don't change the route. That shuffles 37 to 500 rows a fingerprint in place of 2,081 and yields the same buckets.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasmill.llm.graph import components
from atlasmill.llm.shared import parallelism, stored

#: UTF-8 bytes beyond which words are found one after another, to keep their list short.
LONG_TEXT = 4_000_000
#: Rows of a route that one task takes; leading bits are chosen for it, and routes over it are dealt out by further bits.
ROUTE_ROWS = 16_000
#: Variants sorted at once in a task.
SORTED_AT_ONCE = 4_000_000


def _hashes(data: bytes, k: int) -> Iterator[np.ndarray]:
    """XXH64 of each k-word shingle, in blocks."""
    one = lambda g: xxhash.xxh64_intdigest(g, 42)
    if len(data) <= LONG_TEXT:
        w = data.lower().split()
        if 0 < len(w) <= k:
            yield np.array([one(b" ".join(w))], np.uint64)
        elif w:
            yield np.fromiter(map(one, map(b" ".join, zip(*(w[i:] for i in range(k))))), np.uint64, len(w) - k + 1)
        return
    words, kept, short = (m[0] for m in re.finditer(rb"[^\x20\x09-\x0d]+", data.lower())), [], True
    while block := list(itertools.islice(words, 200_000)):
        w = kept + block
        if len(w) >= k:
            yield np.fromiter(map(one, map(b" ".join, zip(*(w[i:] for i in range(k))))), np.uint64, len(w) - k + 1)
            short = False
        kept = w[max(0, len(w) - k + 1) :]
    if short and kept:
        yield np.array([one(b" ".join(kept))], np.uint64)


def fingerprint(text: str | None, shingle_words: int = 4) -> int:
    """64-bit SimHash: a bit is 1 if over half of the shingles' hashes have it; without words 0."""
    counts, n = np.zeros(64, np.int64), 0
    for h in _hashes((text or "").encode(), shingle_words):
        for i in range(0, len(h), 1 << 16):
            part = h[i : i + (1 << 16)]
            counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
        n += len(h)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0]) if n else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4) -> DataFrame:
    """(id_col, fp, th): the fingerprint's 64 bits as a signed long, and the text's hash. A null text counts as empty."""

    def batches(it):
        for b in it:
            fp = np.fromiter((fingerprint(t.as_py(), shingle_words) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), b.column(2)], [id_col, "fp", "th"])

    text = F.col(text_col).cast("string")
    picked = docs.select(id_col, text.alias("_text"), F.xxhash64(text).alias("_hash"))
    return picked.mapInArrow(batches, f"`{id_col}` {picked.schema[id_col].dataType.simpleString()}, fp long, th long")


def _flips(bits: list[int], left: int) -> list[tuple[int, int]]:
    """(mask, flips still left) for every way to flip up to left of these bits."""
    return [(sum(1 << b for b in c), left - n) for n in range(left + 1) for c in itertools.combinations(bits, n)]


def _ball(n: int, r: int) -> int:
    return sum(math.comb(n, i) for i in range(r + 1))


def route_bits(n: int, half: int) -> int:
    """Leading bits at which a route has ROUTE_ROWS rows on average, of n fingerprints."""
    return next((p for p in range(8, 40) if n * _ball(p, half) <= ROUTE_ROWS << p), 40)


def _stars(v: np.ndarray, owner: np.ndarray, left: np.ndarray, rest: int, out: list[np.ndarray]) -> None:
    """Into out: (least owner, other owner) of each bucket of variants of v that flip up to left of the last rest bits."""
    if len(v) < 2:
        return
    sizes = np.array([_ball(rest, x) for x in range(int(left.max()) + 1)])[left]
    if sizes.sum() <= SORTED_AT_ONCE or rest <= 6:
        variants, owners = [], []
        for x in np.unique(left):
            masks = np.array([m for m, _ in _flips(list(range(rest)), int(x))], np.uint64)
            rows = left == x
            variants.append((v[rows][:, None] ^ masks[None]).ravel())
            owners.append(np.repeat(owner[rows], len(masks)))
        variants, owners = np.concatenate(variants), np.concatenate(owners)
        order = np.argsort(variants)
        variants, owners = variants[order], owners[order]
        same = np.flatnonzero(variants[1:] == variants[:-1])
        if len(same):
            near = np.union1d(same, same + 1)
            variants, owners = variants[near], owners[near]
            starts = np.flatnonzero(np.r_[True, variants[1:] != variants[:-1]])
            least = np.repeat(np.minimum.reduceat(owners, starts), np.diff(np.r_[starts, len(owners)]))
            pairs = np.stack([least, owners], axis=1)[least != owners]
            out.append(np.unique(pairs, axis=0))
        return
    here = min(6, rest)  # too many to sort at once: on by the next bits
    rest -= here
    parts = [(v[ok] ^ np.uint64(m << rest), owner[ok], (left[ok] - used).astype(left.dtype)) for m, used in ((m, bin(m).count("1")) for m, _ in _flips(list(range(here)), int(left.max()))) for ok in [left >= used]]
    v, owner, left = (np.concatenate(x) for x in zip(*parts))
    key = (v >> np.uint64(rest)) & np.uint64((1 << here) - 1)
    for k in np.unique(key):
        rows = key == k
        _stars(v[rows], owner[rows], left[rows], rest, out)


def links(prints: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b): edges that tie all fingerprints within radius bits together, from prints (fp, rep), each fp once.

    Reps must be whole numbers; an edge goes from the least rep of a variant's bucket to each other one, and each pair is
    verified. The radius must be even, else ValueError.
    """
    if radius % 2:
        raise ValueError("radius must be even: halves of an odd one don't meet in the middle")
    half, n = radius // 2, prints.count()
    p = route_bits(n, half)

    def routed(df: DataFrame, bits: int, done: int, cols: list[str]) -> DataFrame:
        """One row for each way to flip up to `left` of the next bits."""
        masks = F.array(*[F.struct(F.lit(m << (64 - done - bits) if m << (64 - done - bits) < 1 << 63 else (m << (64 - done - bits)) - (1 << 64)).alias("m"), F.lit(bin(m).count("1")).alias("used")) for m, _ in _flips(list(range(bits)), half)])
        return df.select("*", F.explode(masks).alias("x")).where("x.used <= left").select(*cols, F.col("v").bitwiseXOR(F.col("x.m")).alias("v"), (F.col("left") - F.col("x.used")).alias("left"))

    rows = routed(prints.select("fp", "rep", F.col("fp").alias("v"), F.lit(half).alias("left")), p, 0, ["fp", "rep"])
    rows = rows.withColumn("route", F.shiftrightunsigned("v", 64 - p))
    rows, dealt, done, more = rows.withColumn("done", F.lit(p)), [], p, 8
    # a route of too many rows is dealt out by further bits, as often as it takes or as there are bits
    while done + more <= 64:
        hot = stored(rows.groupBy("route").count().where(F.col("count") > 8 * ROUTE_ROWS).select("route"), "hot-routes")
        if hot.isEmpty():
            break
        dealt.append(rows.join(hot, "route", "left_anti"))
        further = routed(rows.join(hot, "route", "left_semi"), more, done, ["fp", "rep"])
        done += more
        rows = further.withColumns({"route": F.shiftrightunsigned("v", 64 - done), "done": F.lit(done)})
    for less in dealt:
        rows = rows.unionByName(less.select(rows.columns))

    def tie(table: pa.Table) -> pa.Table:
        v, rep, fp = (table.column(c).to_numpy() for c in ("v", "rep", "fp"))
        out: list[np.ndarray] = []
        order = np.argsort(rep)
        rep, fp = rep[order], fp[order].view(np.uint64)
        names, at = np.unique(rep, return_index=True)
        owner = np.searchsorted(names, rep)
        _stars(v[order].view(np.uint64), owner, table.column("left").to_numpy()[order].astype(np.int64), 64 - int(table.column("done")[0].as_py()), out)
        pairs = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
        apart = np.bitwise_count(fp[at][pairs[:, 0]] ^ fp[at][pairs[:, 1]])
        pairs = pairs[apart <= radius]
        return pa.table({"a": names[pairs[:, 0]], "b": names[pairs[:, 1]]})

    n_parts = max(parallelism(prints.sparkSession), 1)
    return rows.repartition(n_parts, "done", "route").groupBy("done", "route").applyInArrow(tie, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, radius: int = 4) -> DataFrame:
    """(id_col, fp, component_id): each document's fingerprint and the least id that links reach from it.

    Ids are whole numbers. A null text is empty; documents without words have fingerprint 0 and are linked like any
    other, equal texts always are. Rows that repeat an id each come out, with their own fingerprint. A row with a null
    id gets its fingerprint and a null component. An empty table gives an empty result. Other columns are not read.
    """
    fps = stored(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    return _linked(fps, id_col, radius).drop("th")


def _linked(fps: DataFrame, id_col: str, radius: int) -> DataFrame:
    """fps (id_col, fp, ...) with component_id. Prints are what is linked, so an id of several texts has a print of each."""
    prints = stored(fps.where(F.col(id_col).isNotNull()).groupBy("fp").agg(F.min(id_col).cast("long").alias("least")), "prints")
    parts = components(links(prints.select("fp", F.col("fp").alias("rep")), radius), "a", "b")
    named = prints.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("part"))
    least = named.groupBy("part").agg(F.min("least").alias("component_id"))
    named = named.join(least, "part").select("fp", "component_id")
    return fps.join(named, "fp", "left").withColumn("component_id", F.when(F.col(id_col).isNotNull(), F.col("component_id"))).select(*fps.columns, "component_id")


def hex_digits(fp):
    """A signed long's 64 bits as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, radius: int = 4) -> DataFrame:
    """Rows of docs without those that a document of a smaller id is near to; a row with a null id stays.

    Rows of one id stay or go by their own texts.
    """
    fps = stored(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    gone = _linked(fps, id_col, radius).where(F.col("component_id") < F.col(id_col)).select(F.col(id_col).alias("_gone_id"), F.col("th").alias("_gone_th")).distinct()
    return docs.join(gone, (docs[id_col] == F.col("_gone_id")) & (F.xxhash64(docs[text_col].cast("string")) == F.col("_gone_th")), "left_anti")
