"""Quality rules: counts with fixed limits, and a calibrated logistic regression on hashed word and character n-grams.

The rules are counts of a text's words, symbols, repeated lines and repeated three-word windows. What passes them is judged
by a linear model over 2 ** BITS hashed features: words, pairs of neighbouring words, and byte n-grams of two lengths, each
with log(1 + count), the vector of a text scaled to length one. Texts are read whole.

Fitting is a loop of Spark jobs: the features of the labelled sample are computed once by the tasks and stored in the shared
folder; each step of L-BFGS broadcasts the weights, every task returns the gradient of its rows, and the driver adds a few
vectors of fixed size. No text and no feature reaches the driver. A fifth of the sample is not fitted but calibrates: two
numbers map margins to probabilities (Platt's targets), so the threshold is one of probability.

Scoring is one map pass in Arrow batches: n-grams hashed by a few array operations, weights looked up, margins summed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, hash_split, numbered, table
from .textvec import U, mix, shingles, slices, words

#: Labelled documents, by smallest hash of the id, that the model is fitted and calibrated on at most.
TRAIN_ROWS = 6_000
#: The part of them that calibrates: crc32 of the id modulo this is 0.
CALIBRATE = 5
BITS = 16
BYTE_GRAMS = (3, 5)
#: Bytes of text whose n-grams are held at once: about 150 times as much memory.
PART = 250_000
L2, STEPS, ENOUGH, MEMORY, TASKS = 0.3, 40, 1e-3, 6, 8
#: The rules: fewer words, or a larger percentage of words within repeated windows, fail; then the least probability.
MIN_WORDS, MAX_REPEATED, KEEP_AT = 50, 50, 0.3
SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counts(texts: pa.Array) -> np.ndarray:
    """One row of COUNTS for each text; null counts as empty. Words and lines are compared as they are, lines by their bytes and
    windows by 64-bit hashes."""
    symbol = np.zeros(256, bool)
    symbol[np.frombuffer(SYMBOLS, np.uint8)] = True
    rows = []
    for _, _, raw, offsets in slices(texts):
        hashes, _, _, before = words(raw, offsets, lower_case=False)
        windows = shingles(hashes, 3)
        out = np.zeros((len(offsets) - 1, len(COUNTS)), np.int64)
        out[:, 0] = np.diff(before)
        white = (raw == 0x20) | ((raw >= 9) & (raw <= 13))
        for j, kind in ((1, ~white & ((raw & 0xC0) != 0x80)), (2, symbol[raw])):
            total = np.concatenate([[0], np.cumsum(kind, dtype=np.int64)])
            out[:, j] = total[offsets[1:]] - total[offsets[:-1]]
        whole = raw.tobytes()
        for i in range(len(out)):
            lines = [x for x in whole[offsets[i] : offsets[i + 1]].split(b"\n") if x.strip(WHITE)]
            out[i, 3] = len(lines) - len(set(lines))
            mine = windows[before[i] : max(before[i], before[i + 1] - 2)]
            _, which, often = np.unique(mine, return_inverse=True, return_counts=True)
            if len(often) < len(mine):
                covered = np.zeros(len(mine) + 2, bool)
                again = often[which] > 1
                for k in range(3):
                    covered[k : k + len(mine)] |= again
                out[i, 4] = covered.sum()
        rows.append(out)
    return np.concatenate(rows) if rows else np.zeros((0, len(COUNTS)), np.int64)


def ngrams(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For consecutive rows: (rows' first entries and the end, hashed features, their values). The values of a text have length
    one; a text without any n-gram has none."""
    for _, _, raw, offsets in slices(texts, PART):
        n = len(offsets) - 1
        hashes, _, _, before = words(raw, offsets)
        found = [(np.repeat(np.arange(n), np.diff(before)), mix(hashes ^ U(1)))]
        pairs = shingles(hashes, 2)
        row = found[0][0][: len(pairs)]
        inside = row == found[0][0][1:] if len(pairs) else np.zeros(0, bool)
        found.append((row[inside], mix(pairs[inside] ^ U(2))))
        of = np.repeat(np.arange(n), np.diff(offsets))
        for k in BYTE_GRAMS:
            size = len(raw) - k + 1
            if size > 0:
                body = np.zeros(size, U)
                for j in range(k):
                    body = (body << U(8)) | raw[j : j + size].astype(U)
                inside = of[:size] == of[k - 1 :]
                found.append((of[:size][inside], mix(body[inside] ^ (U(k) << U(56)))))
        keys = np.concatenate([(r.astype(np.int64) << BITS) | (h >> U(64 - BITS)).astype(np.int64) for r, h in found])
        keys, often = np.unique(keys, return_counts=True)
        row, value = keys >> BITS, np.log1p(often)
        value /= np.sqrt(np.bincount(row, value**2, n))[row]
        yield np.searchsorted(row, np.arange(n + 1)), (keys & ((1 << BITS) - 1)).astype(np.int32), value


def sums(starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches, 0 where one is empty."""
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[starts[1:]] - total[starts[:-1]]


@dataclass
class Linear:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, texts: pa.Array) -> np.ndarray:
        parts = [sums(starts, value * self.weights[index]) + self.bias for starts, index, value in ngrams(texts)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * margins + self.shift)))


def lbfgs(slope: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int = STEPS, enough: float = ENOUGH) -> np.ndarray:
    """A minimum of a smooth convex function, given its value and gradient, up to a step that gains less than ``enough`` of the value."""
    at, (value, g) = start, slope(start)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if not g.any():
            break
        way, used = g.copy(), []
        for s, y in reversed(past):
            a = s @ way / (s @ y)
            way -= a * y
            used.append(a)
        way *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1 / np.linalg.norm(g)
        for (s, y), a in zip(past, reversed(used)):
            way += (a - y @ way / (s @ y)) * s
        size, down = 1.0, g @ way
        for _ in range(12):
            there = at - size * way
            value2, g2 = slope(there)
            if value2 <= value - 1e-4 * size * down:
                break
            size /= 2
        else:
            break
        if (y := g2 - g) @ (there - at) > 1e-12:
            past = [*past, (there - at, y)][-MEMORY:]
        gain, at, value, g = value - value2, there, value2, g2
        if gain <= enough * abs(value):
            break
    return at


def platt(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of the logistic curve that fits labels to margins best; targets are smoothed by the label counts. Without
    rows of both labels the margins stay as they are."""
    up = int(y.sum())
    if up in (0, len(y)):
        return 1.0, 0.0
    t = np.where(y == 1, (up + 1) / (up + 2), 1 / (len(y) - up + 2))
    x = np.stack([margins, np.ones_like(margins)], 1)
    w = np.array([1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - t))
        w = w - step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, label, text) of at most ``rows`` documents. labels: doc_id, label; an id with both labels counts as 1, other
    labels and null ids are none. Of rows that repeat an id, the text of the least hash is taken."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    picked = ids.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    both = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).join(F.broadcast(picked), "doc_id")  # ``rows`` short rows
    return both.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Linear:
    """Fit and calibrate on the ``sample``. Without labels of both kinds every text gets the smoothed share of label 1."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality-rules")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for starts, index, value in ngrams(batch.column(2)):
                n = len(starts) - 1
                packs = [pa.array([v[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:])], pa.binary()) for v in (index, value)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(1).slice(at, n), *packs], names=["doc_id", "label", "index", "value"])
                at += n

    seen = sample(docs, labels, rows).mapInArrow(measure, "doc_id long, label int, index binary, value binary")
    seen = scratch.keep(seen.withColumn("held", hash_split(CALIBRATE) == 0).sort("doc_id"), "features")
    fitted = seen.filter("not held").select("label", "index", "value").coalesce(TASKS)
    n, up = fitted.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    share = (up + 1) / (n + 2)
    model = Linear(np.zeros(1 << BITS), float(np.log(share / (1 - share))))
    if 0 < up < n:

        def slope(w: np.ndarray) -> tuple[float, np.ndarray]:
            shared = spark.sparkContext.broadcast(w)

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                at, loss, g = shared.value, 0.0, np.zeros(len(w))
                for batch in batches:
                    y, starts, index, value = entries(batch)
                    m = sums(starts, value * at[index]) + at[-1]
                    loss += float(np.logaddexp(0, np.where(y == 1, -m, m)).sum())
                    miss = 1 / (1 + np.exp(-m)) - y
                    g[:-1] += np.bincount(index, value * np.repeat(miss, np.diff(starts)), len(w) - 1)
                    g[-1] += miss.sum()
                yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([g.tobytes()])], names=["loss", "g"])

            parts = fitted.mapInArrow(run, "loss double, g binary").collect()  # TASKS vectors at most, whatever the sample
            shared.destroy()
            loss, g = sum(p.loss for p in parts), np.sum([np.frombuffer(p.g) for p in parts], 0)
            flat = np.append(w[:-1], 0.0)
            return loss + L2 / 2 * flat @ flat, g + L2 * flat

        found = lbfgs(slope, np.append(model.weights, model.bias))
        model = Linear(found[:-1], float(found[-1]))
        shared = spark.sparkContext.broadcast(model)

        def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                y, starts, index, value = entries(batch)
                yield pa.RecordBatch.from_arrays([pa.array(y.astype(float)), pa.array(sums(starts, value * shared.value.weights[index]) + shared.value.bias)], names=["y", "m"])

        held = seen.filter("held").select("label", "index", "value").mapInArrow(margins, "y double, m double").toPandas()  # two numbers a row
        model.slope, model.shift = platt(held["m"].to_numpy(float), held["y"].to_numpy(float))
    scratch.drop("features")
    return model


def entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(labels, rows' first entries and the end, features, values) of a batch of stored rows."""
    index, value = (np.frombuffer(b"".join(batch.column(c).to_pylist()), kind) for c, kind in ((1, np.int32), (2, np.float64)))
    sizes = [len(x) // 4 for x in batch.column(1).to_pylist()]
    return batch.column(0).to_numpy(), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), index, value


def judge(docs: DataFrame, model: Linear, text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """``docs`` with COUNTS, base_failed, probability and kept; columns of these names, in any case, are replaced.

    Every row is judged by its own whole text, so rows that repeat an id may differ; a null text is an empty one, which has no
    words and fails. An empty table stays empty.
    """
    named = [*COUNTS, "probability", "base_failed", "kept"]
    docs = docs.drop(*(c for c in docs.columns if c.lower() in named and c != text_col))
    place = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    flat = numbered(docs)
    text = fresh(flat.columns, "text")
    flat = flat.withColumn(text, F.coalesce(F.col(flat.columns[place]).cast("string"), F.lit("")))
    from pyspark.sql.types import DoubleType, LongType, StructField, StructType

    schema = StructType([*flat.schema.fields[:-1], *(StructField(c, LongType()) for c in COUNTS), StructField("probability", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            found = counts(texts)
            p = shared.value.probability(shared.value.margins(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(found[:, j]) for j in range(len(COUNTS))), pa.array(p)], names=schema.names)

    out = flat.mapInArrow(run, schema).toDF(*docs.columns, *COUNTS, "probability")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED)
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= keep_at))


def op12_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")))
    return judge(docs, model).select("doc_id", *COUNTS, "base_failed", "kept", "probability")
