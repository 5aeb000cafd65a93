"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting of shallow trees on binned features learns one lookup table for each feature, then one for each of a few
pairs of features; a score is the logistic of the sum of the looked-up bins, which is a handful of array additions a
batch. Features are computed from the text alone, over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_split, table
from .textvec import shingles, slices, words

#: Labelled rows, by smallest hash of the id, that the model is fitted on at most.
TRAIN_ROWS = 30_000
BINS, PAIR_BINS, PAIRS = 32, 8, 10
ROUNDS, PAIR_ROUNDS, RATE, L2 = 150, 80, 0.15, 5.0
CUT = 0.3
FEATURES = [
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "stop", "symbol", "bang", "pipe", "other_bytes",
    "newlines", "distinct_words", "top_word", "distinct_grams", "distinct_lines", "longest_line", "short_words", "word_spread", "ends_symbol",
]
_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "stop": b".,;:?'\"()-", "symbol": b"#$%&*+/<=>@[\\]^_`{}~", "bang": b"!", "pipe": b"|", "newlines": b"\n"}


def _shares(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    out, lookup = {}, np.zeros(256, np.uint8)
    for i, chars in enumerate(_CLASSES.values(), 1):
        lookup[np.frombuffer(chars, np.uint8)] = i
    lookup[128:] = len(_CLASSES) + 1
    kinds = lookup[raw]
    for i, name in enumerate([*_CLASSES, "other_bytes"], 1):
        total = np.concatenate([[0], np.cumsum(kinds == i, dtype=np.int64)])
        out[name] = total[offsets[1:]] - total[offsets[:-1]]
    return out


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text; null counts as empty. All are finite."""
    rows = []
    for _, _, raw, offsets in slices(texts):
        n = len(offsets) - 1
        size = np.diff(offsets).astype(float)
        hashes, starts, ends, before = words(raw, offsets)
        grams = shingles(hashes, 3)
        counts = _shares(raw, offsets)
        length = (ends - starts).astype(float)
        last = raw[ends - 1] if len(ends) else raw[:0]
        odd = np.isin(last, np.frombuffer(b"#$%&*+<=>@^_~|!", np.uint8))
        x = np.zeros((n, len(FEATURES)))
        number = np.diff(before).astype(float)
        some = np.maximum(number, 1)
        letters = np.maximum(counts["upper"] + counts["lower"], 1)
        for j, v in enumerate((np.log1p(size), np.log1p(number))):
            x[:, j] = v
        sums = {k: np.concatenate([[0.0], np.cumsum(v)]) for k, v in (("len", length), ("sq", length**2), ("short", length <= 2), ("odd", odd))}
        per = {k: (v[before[1:]] - v[before[:-1]]) / some for k, v in sums.items()}
        x[:, 2], x[:, 3] = per["len"], counts["upper"] / letters
        for j, name in enumerate(("digit", "stop", "symbol", "bang", "pipe", "other_bytes"), 4):
            x[:, j] = counts[name] / np.maximum(size, 1)
        x[:, 10] = counts["newlines"] / some
        x[:, 16], x[:, 17], x[:, 18] = per["short"], np.sqrt(np.maximum(per["sq"] - per["len"] ** 2, 0)), per["odd"]
        breaks = np.flatnonzero(raw == 10)
        edges = np.searchsorted(breaks, offsets)
        for i in range(n):
            a, b = before[i], before[i + 1]
            if b > a:
                _, c = np.unique(hashes[a:b], return_counts=True)
                x[i, 11], x[i, 12] = len(c) / (b - a), c.max() / (b - a)
            x[i, 13] = len(np.unique(grams[a : b - 2])) / (b - a - 2) if b - a > 2 else 1.0
            cuts = np.concatenate([[offsets[i]], breaks[edges[i] : edges[i + 1]] + 1, [offsets[i + 1]]])
            x[i, 15] = np.diff(cuts).max() / max(size[i], 1)
            if b > a:
                at = np.searchsorted(starts[a:b], cuts[:-1])
                lines = np.add.reduceat(np.append(hashes[a:b], np.uint64(0)), at) if len(at) else hashes[:0]
                x[i, 14] = len(np.unique(lines)) / len(at)
        rows.append(x)
    return np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))


@dataclass
class Additive:
    edges: list[np.ndarray]
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1)

    def coarse(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.pair_edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        total = np.full(len(x), self.base)
        if len(x) and self.tables:
            b = self.bins(x)
            for j, t in enumerate(self.tables):
                total += t[b[:, j]]
            c = self.coarse(x)
            for i, j, t in self.pairs:
                total += t[c[:, i], c[:, j]]
        return 1 / (1 + np.exp(-total))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Newton steps by bin of a shallow tree over ordered bins, grown by the best split."""
    parts, out = [(0, len(g))], np.zeros(len(g))
    G, H = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain = lambda a, b: (G[b] - G[a]) ** 2 / (H[b] - H[a] + L2)
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(parts):
            for m in range(a + 1, b):
                if (v := gain(a, m) + gain(m, b) - gain(a, b)) > best[0]:
                    best = (v, k, m)
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    for a, b in parts:
        out[a:b] = -(G[b] - G[a]) / (H[b] - H[a] + L2)
    return out


def _quad(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and steps of the best four-leaf tree over a table: one split of the first axis, one of the second."""
    G, H = (np.pad(v.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for v in (g, h))
    n, m = g.shape
    best, where = 0.0, None
    box = lambda v, a, b, c, d: v[b, d] - v[a, d] - v[b, c] + v[a, c]
    for i in range(1, n):
        for j in range(1, m):
            cells = [(0, i, 0, j), (0, i, j, m), (i, n, 0, j), (i, n, j, m)]
            v = sum(box(G, *c) ** 2 / (box(H, *c) + L2) for c in cells)
            if v > best:
                best, where = v, cells
    out = np.zeros(g.shape)
    for a, b, c, d in where or []:
        out[a:b, c:d] = -box(G, a, b, c, d) / (box(H, a, b, c, d) + L2)
    return best, out


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """Fit to labels 0 and 1. Without rows of both labels the score is the smoothed share of label 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    model = Additive(edges, float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model
    model.pair_edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) for j in range(x.shape[1])]
    b, c = model.bins(x), model.coarse(x)
    model.tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return p - y, p * (1 - p)

    for _ in range(ROUNDS):
        for j, t in enumerate(model.tables):
            g, h = slopes()
            step = RATE * _tree(np.bincount(b[:, j], g, len(t)), np.bincount(b[:, j], h, len(t)))
            t += step
            total += step[b[:, j]]
    g, h = slopes()
    width = [len(e) + 1 for e in model.pair_edges]
    flat = lambda i, j: c[:, i] * width[j] + c[:, j]
    table2 = lambda v, i, j: np.bincount(flat(i, j), v, width[i] * width[j]).reshape(width[i], width[j])
    found = sorted(((-_quad(table2(g, i, j), table2(h, i, j))[0], i, j) for i in range(len(width)) for j in range(i + 1, len(width))))[:PAIRS]
    model.pairs = [(i, j, np.zeros((width[i], width[j]))) for v, i, j in found if v < 0]
    for _ in range(PAIR_ROUNDS):
        for i, j, t in model.pairs:
            g, h = slopes()
            step = RATE * _quad(table2(g, i, j), table2(h, i, j))[1]
            t += step
            total += step[c[:, i], c[:, j]]
    return model


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Additive:
    """Fit on ``rows`` labels at most, those with the smallest hash of the id. labels: doc_id, label (0 or 1); docs: doc_id,
    text. Labels that repeat an id each count, and each row of ``docs`` that repeats a labelled id is learned from with
    every label of it, as long as these are no more than ``rows`` either. Null ids and other labels are no labels; a null text counts as empty; without any label the model
    scores 0.5."""
    picked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    both = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")  # ``rows`` short rows

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    seen = both.mapInArrow(measure, "doc_id long, label int, x array<double>").orderBy(F.xxhash64("doc_id"), "doc_id", "label", "x").limit(rows).toPandas().sort_values(["doc_id", "label"])
    x = np.stack(seen["x"].to_numpy()) if len(seen) else np.zeros((0, len(FEATURES)))
    return fit(x, seen["label"].to_numpy(float))


def score(docs: DataFrame, model: Additive, text_col: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1); a column of that name, in any case, is replaced. Every row gets a score from its own text alone, read
    whole, so rows that repeat an id with other texts differ; null and empty texts get one too."""
    docs = docs.drop("score")  # in any case
    place = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    from pyspark.sql.types import DoubleType, StructField, StructType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.score(features(batch.column(place))))], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def op1_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).filter(hash_split(5) != 0)
    scored = score(docs.withColumn("held_out", hash_split(5) == 0), train(docs, labels))
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))
