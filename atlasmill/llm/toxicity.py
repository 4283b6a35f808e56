"""Toxicity by a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

A document's features are the hashed character n-grams that it holds, each once. Counts by label give every feature a
log-count ratio; logistic regression is fitted over the features of strongest evidence, each scaled by its ratio: the
choice is a parameter of the model (README has figures of a fit over all features). The fit sees at most ``max_rows`` labelled rows of each label, those of least hash, so that it costs the same at any size;
every whole text is scored, where it lies, by one table of weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasmill.llm.shared import stored

BITS = 20
LENGTHS = (3, 4, 5)
#: Labelled rows of each label, and features, that a fit takes at most.
MAX_ROWS, MAX_FEATURES = 4_000, 4_096
#: Characters hashed at once.
PIECE = 1 << 20


def features(text: str | None) -> np.ndarray:
    """Hashes of the distinct character n-grams of a text, lower-cased and set in spaces, in ascending order."""
    points = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out = []
    for start in range(0, len(points), PIECE):
        c = points[start : start + PIECE + max(LENGTHS) - 1]
        for n in LENGTHS:
            if len(c) >= n:
                h = np.full(len(c) - n + 1, n, np.uint64)
                for i in range(n):
                    h = (h ^ c[i : len(c) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(29)
                out.append((h >> np.uint64(64 - BITS)).astype(np.uint32))
        if len(out) > 4 * len(LENGTHS):
            out = [np.unique(np.concatenate(out))]
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint32)


@dataclass
class Model:
    """weights: by feature, float32; bias: for a text without features."""

    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        return logistic(self.weights, self.bias, text)


def logistic(weights: np.ndarray, bias: float, text: str | None) -> float:
    z = bias + float(weights[features(text)].sum(dtype=np.float64))
    return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias of L2-regularised logistic regression, by accelerated gradient descent."""
    w, v, bias, vb = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32), 0.0, 0.0
    u = np.ones(x.shape[1], np.float32)
    for _ in range(12):  # the largest curvature, by power iteration
        u = x.T @ (weight * (x @ u))
        u /= max(float(np.linalg.norm(u)), 1e-12)
    step = 1 / (0.25 * float(np.linalg.norm(x.T @ (weight * (x @ u)))) + 0.25 * float(weight.sum()) + l2)
    for t in range(1, steps + 1):
        g = weight * (1 / (1 + np.exp(-np.clip(x @ v + vb, -60, 60))) - y)
        new, new_b = v - step * (x.T @ g + l2 * v), vb - step * float(g.sum())
        m = (t - 1) / (t + 2)
        v, vb, w, bias = (new + m * (new - w)).astype(np.float32), new_b + m * (new_b - bias), new.astype(np.float32), new_b
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES, smoothing: float = 1.0, l2: float = 1e-3) -> Model:
    """A model of labels (id_col, label_col 0 or 1) over the texts of docs.

    A label of null counts for nothing; an id with several labels has the largest. With one label only, or none, every
    score is that label's share (0.5 of none).
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("_y"))
    shares = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = shares.get(0, 0), shares.get(1, 0)
    flat = Model(np.zeros(1 << BITS, np.float32), float(np.clip(np.log((n1 + 1e-9) / (n0 + 1e-9)), -20, 20)))
    if not n0 or not n1:
        return flat
    pick = [known.where(F.col("_y") == y).orderBy(F.xxhash64(id_col), id_col).limit(max_rows) for y in (0, 1)]
    sample = F.broadcast(pick[0].unionByName(pick[1]))  # 2 * max_rows rows at most
    texts = stored(docs.select(id_col, F.col(text_col).cast("string").alias("_text")).join(sample, id_col).select("_text", "_y"), "labelled")

    def counts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BITS), np.int64)
        for b in it:
            for t, y in zip(b.column(0), b.column(1).to_pylist()):
                total[y][features(t.as_py())] += 1
        at = np.flatnonzero(total.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], ["f", "n0", "n1"])

    # at most 2 ** BITS rows
    found = texts.mapInArrow(counts, "f long, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    rows0, rows1 = (texts.where(F.col("_y") == y).count() for y in (0, 1))
    if not rows0 or not rows1:
        return flat
    p, q = (F.col("n1") + smoothing) / (rows1 + 2 * smoothing), (F.col("n0") + smoothing) / (rows0 + 2 * smoothing)
    # the signed root of a likelihood ratio ranks the evidence
    strength = F.abs(F.log(p / q)) * F.sqrt(F.col("n1") / rows1 + F.col("n0") / rows0)
    top = found.withColumn("r", F.log(p / q)).orderBy(strength.desc(), "f").limit(max_features).select("f", "r").collect()
    chosen = np.array(sorted(r["f"] for r in top), np.int64)
    ratio = np.array([r["r"] for r in sorted(top, key=lambda r: r["f"])], np.float32)
    if not len(chosen):
        return flat

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            held = [np.flatnonzero(np.isin(chosen, features(t.as_py()), assume_unique=True)).astype(np.int32) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(held, pa.list_(pa.int32()))], ["y", "held"])

    got = texts.mapInArrow(rows, "y int, held array<int>").toArrow()  # 2 * max_rows rows of max_features numbers at most
    y = got.column("y").to_numpy().astype(np.float32)
    x = np.zeros((len(y), len(chosen)), np.float32)
    for i, h in enumerate(got.column("held")):
        x[i, h.values.to_numpy()] = 1
    x *= ratio
    order = np.lexsort((x @ ratio, y))  # so that the sums don't depend on the order of rows
    x, y = x[order], y[order]
    # each row stands for its label's share of all labelled rows
    weight = np.where(y == 1, n1 / (n0 + n1) / rows1, n0 / (n0 + n1) / rows0).astype(np.float32)
    w, bias = regression(x, y, weight, l2)
    weights = np.zeros(1 << BITS, np.float32)
    weights[chosen] = w * ratio
    return Model(weights, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) of every whole text; a null text is empty. Repeated rows and null ids each get their row.

    An empty table gives an empty result. Other columns are not read, so names may clash.
    """
    wide, bias = docs.sparkSession.sparkContext.broadcast(model.weights), model.bias  # 2 ** BITS floats

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((logistic(wide.value, bias, t.as_py()) for t in b.column(1)), pa.float64())], [id_col, "score"])

    picked = docs.select(id_col, F.col(text_col).cast("string").alias("_text"))
    return picked.mapInArrow(batches, f"`{id_col}` {picked.schema[id_col].dataType.simpleString()}, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs without the rows whose text scores at least threshold, all columns kept, without a shuffle.

    A null text is empty. Ids play no part: repeated rows go or stay together. An empty table stays one.
    """
    wide, bias = docs.sparkSession.sparkContext.broadcast(model.weights), model.bias
    at = docs.columns.index(text_col)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield b.filter(pa.array([logistic(wide.value, bias, t.as_py()) < threshold for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(batches, docs.schema)


def held_out(id_col: str):
    """True for the fifth of ids whose crc32, as text, divides by 5."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0
