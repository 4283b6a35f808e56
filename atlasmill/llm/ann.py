"""Nearest neighbours by inner product with an inverted multi-index.

The two halves of each vector are quantised apart; a pair of centroids is a cell. A query walks the pairs in order of
their summed distance (here: least inner product last) with a heap, until the cells that it has passed hold a given
share of all vectors; what lies in them is scored exactly. That share comes from a pilot on the fitting sample: the
least at which the pilot's queries find ``recall`` of their true neighbours. Vectors that are equal are scored once and
carry the least ``k + 1`` of their ids, which is all that a ranking with ties to the smaller id can show.

Cells are dealt out to groups of about equal vectors, a cell with more than a group's share over several, and queries
go in blocks to the groups that hold a cell of theirs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from atlasmill.llm.shared import stored

#: Vectors that fit the centroids and the pilot at most, pilot queries, centroids of each half, vectors in a group,
#: queries that meet a group at once.
SAMPLE, PILOT, CENTROIDS, GROUP_ROWS, BLOCK_ROWS = 8_000, 200, 48, 4_096, 20_000


def _kmeans(x: np.ndarray, k: int, steps: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(steps):
        at = np.argmin((c**2).sum(1)[None] - 2 * x @ c.T, axis=1)
        n = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


@dataclass
class Index:
    """first, second: centroids of the halves; share: of all vectors that a query's cells must hold."""

    first: np.ndarray
    second: np.ndarray
    share: float

    def cells(self, x: np.ndarray) -> np.ndarray:
        h = self.first.shape[1]
        near = [np.argmin((c**2).sum(1)[None] - 2 * part @ c.T, axis=1) for c, part in ((self.first, x[:, :h]), (self.second, x[:, h:]))]
        return near[0] * len(self.second) + near[1]

    def distances(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of a block of queries to the centroids of either half: least first means largest inner product."""
        h = self.first.shape[1]
        return -q[:, :h] @ self.first.T, -q[:, h:] @ self.second.T

    def walk(self, d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, want: float) -> list[int]:
        """Cells by summed distance, until those passed hold want vectors; counts: vectors by cell."""
        o1, o2 = np.argsort(d1, kind="stable").tolist(), np.argsort(d2, kind="stable").tolist()
        s1, s2, width = d1[o1].tolist(), d2[o2].tolist(), len(d2)
        heap, out, held = [(s1[0] + s2[0], 0, 0)], [], 0
        while heap and held < want:
            _, i, j = heapq.heappop(heap)
            cell = o1[i] * width + o2[j]
            if counts[cell]:
                out.append(cell)
                held += counts[cell]
            if j + 1 < width:
                heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(s1):
                heapq.heappush(heap, (s1[i + 1] + s2[0], i + 1, 0))
        return out


def fit(sample: np.ndarray, k: int, recall: float, centroids: int = CENTROIDS, steps: int = 12, seed: int = 0) -> Index:
    """An index from a sample of distinct vectors, and the share at which pilot queries reach that recall there."""
    rng = np.random.default_rng(seed)
    h = sample.shape[1] // 2
    index = Index(_kmeans(sample[:, :h], centroids, steps, rng), _kmeans(sample[:, h:], centroids, steps, rng), 1.0)
    cell = index.cells(sample)
    counts = np.bincount(cell, minlength=len(index.first) * len(index.second)).tolist()
    picked = rng.choice(len(sample), min(PILOT, len(sample)), replace=False)
    near = min(k, len(sample) - 1)
    if near < 1:
        return index
    need = []
    for q, d1, d2 in zip(picked, *index.distances(sample[picked])):
        dot = sample @ sample[q]
        dot[q] = -np.inf
        true = np.argpartition(-dot, near - 1)[:near]
        reached, passed = {}, 0
        for c in index.walk(d1, d2, counts, np.inf):
            passed += counts[c]
            reached[c] = passed
        need += [reached[c] / len(sample) for c in cell[true].tolist()]
    index.share = float(min(1.0, np.quantile(need, recall)))
    return index


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v: doubles) of the rows that take part: no null id, vector or component, all finite, not all zero.

    All vectors have the most frequent length (the shorter of equals); others take no part.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0")
    finite = v.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    lengths = finite.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return finite.where(F.size("v") == (lengths[0]["n"] if lengths else 0))


def search(vectors: DataFrame, is_query, k: int = 20, recall: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE, centroids: int = CENTROIDS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row for which is_query, a condition on id, holds, its k nearest others.

    Nearness is the inner product in double precision, ties go to the smaller id, and fewer than k others are all
    returned. Rows that usable() leaves out take no part. Ids are unique; an id's repeated rows of one vector count once,
    and its different vectors each as a candidate. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score double"
    rows = stored(usable(vectors, id_col, vec_col).distinct(), "vectors")
    copies = Window.partitionBy("v").orderBy("id")
    # the k + 1 least ids of equal vectors; the limit on the rank is applied before the shuffle as well
    distinct = rows.withColumn("n", F.row_number().over(copies)).where(F.col("n") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    picked = distinct.orderBy(F.xxhash64("v"), "v").limit(sample).select("v").toArrow()  # sample rows at most
    if not len(picked):
        return spark.createDataFrame([], result)
    index = fit(_matrix(picked.column("v").combine_chunks()), k, recall, centroids)
    cells = len(index.first) * len(index.second)

    def assign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield b.append_column("cell", pa.array(index.cells(_matrix(b.column(0))), pa.int32()))

    entries = stored(distinct.mapInArrow(assign, "v array<double>, ids array<long>, cell int"), "entries")
    counts = np.zeros(cells, np.int64)
    for r in entries.groupBy("cell").count().collect():  # a row for each cell at most
        counts[r["cell"]] = r["count"]
    # neighbouring cells share a group; a cell beyond a group's rows is salted over several
    first, salts, at = np.zeros(cells, np.int64), np.ones(cells, np.int64), 0
    room = group_rows
    for c in range(cells):
        if counts[c] > room and room < group_rows:
            at, room = at + 1, group_rows
        salts[c] = max(1, -(-int(counts[c]) // group_rows))
        first[c] = at
        if salts[c] > 1:
            at, room = at + int(salts[c]), group_rows
        else:
            room -= int(counts[c])
    tally, want = counts.tolist(), index.share * int(counts.sum())
    n_groups = at + 1

    def probe(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each group that holds a cell of the query, with the cells' bits."""
        for b in it:
            ids, groups, held = [], [], []
            q = _matrix(b.column(1)) if b.num_rows else np.zeros((0, 2))
            for i, (d1, d2) in enumerate(zip(*index.distances(q))) if len(q) else ():
                by_group: dict[int, list[int]] = {}
                for c in index.walk(d1, d2, tally, want):
                    for s in range(int(salts[c])):
                        by_group.setdefault(int(first[c]) + s, []).append(c)
                for g, cs in by_group.items():
                    ids.append(i)
                    groups.append(g)
                    held.append(cs)
            take = pa.array(ids, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(groups, pa.int32()), pa.array(held, pa.list_(pa.int32()))], ["id", "v", "grp", "cells"])

    asked = rows.where(is_query(F.col("id"))).select("id", "v")
    blocks = max(1, -(-asked.count() // BLOCK_ROWS))
    queries = asked.repartition(max(8, spark.sparkContext.defaultParallelism)).mapInArrow(probe, "id long, v array<double>, grp int, cells array<int>").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    starts = F.broadcast(spark.createDataFrame([(c, int(first[c]), int(salts[c])) for c in range(cells) if counts[c]], "cell int, start int, salts int"))
    dealt = entries.join(starts, "cell").select("v", "ids", "cell", (F.col("start") + F.pmod(F.xxhash64("v"), F.col("salts"))).cast("int").alias("grp"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))

    def rank(q: pa.Table, e: pa.Table) -> pa.Table:
        """The k nearest of each query among this group's entries in its cells."""
        out: list[tuple] = []
        if q.num_rows and e.num_rows:
            x, cell, ids = _matrix(e.column("v").combine_chunks()), e.column("cell").to_numpy(), e.column("ids").to_pylist()
            least = np.array([i[0] for i in ids])
            order = np.lexsort((least, cell))
            x, cell, least, ids = x[order], cell[order], least[order], [ids[i] for i in order]
            here, begin = np.unique(cell, return_index=True)
            size = np.diff(np.r_[begin, len(cell)])
            for at in range(0, q.num_rows, 256):
                block = q.slice(at, 256)
                dots = _matrix(block.column("v").combine_chunks()) @ x.T
                for own, cs, row in zip(block.column("id").to_pylist(), block.column("cells"), dots):
                    ok = np.repeat(np.isin(here, cs.values.to_numpy(), assume_unique=True), size)
                    some = np.flatnonzero(ok)
                    if len(some) > k + 1:  # ties at the border stay in
                        border = np.partition(row[some], len(some) - k - 1)[len(some) - k - 1]
                        some = some[row[some] >= border]
                    best = sorted((-float(row[j]), i) for j in some for i in ids[j] if i != own)[:k]
                    out += [(own, i, -s) for s, i in best]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "vec_id", "score"), zip(*out) if out else [[]] * 3, (pa.int64(), pa.int64(), pa.float64()))})

    near = queries.groupBy("grp", "block").cogroup(dealt.groupBy("grp", "block")).applyInArrow(rank, "query_id long, vec_id long, score double")
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.distinct().withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
