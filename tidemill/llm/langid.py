"""Language identification by interpolated Kneser-Ney character models, one per language.

Texts are lower-cased, every run of non-letters becomes one space, and a text starts after ``order - 1`` start marks.
All character n-grams of all training texts are counted; continuation counts of the lower orders follow from them. Each
order is a sorted array of 64-bit n-gram hashes beside the log probabilities under every language (and one of contexts
beside the interpolation weights), so a lookup that finds an n-gram needs no other order. The language with the lowest
cross-entropy per character wins. A text is rejected if it has no letter, or if that cross-entropy lies further above
what its language's training texts show than chance and a margin explain: above their median by the margin, and by so
many standard errors of a mean of its number of characters. Both come from all training texts of each language; a
language of fewer than ``LEAST_TEXTS`` texts, which its own model knows by heart, borrows from all of them together.

A model keeps every n-gram of its training texts, so it grows with their vocabulary. It is collected and broadcast; one
of more than ``MOST_CELLS`` n-grams times languages is refused with an error and never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_split, lean, numbered, release, table
from .textvec import U, mix

ORDER = 5
#: Distinct n-grams of the highest order times languages, above which training stops with an error.
MOST_CELLS = 40_000_000
#: Texts that a language needs for a rejection of its own.
LEAST_TEXTS = 30
#: Rejection: nats per character, and standard errors, above the mean of the language's texts.
MARGIN, ERRORS = 1.0, 8.0
UNDETERMINED = "und"
_P = U(0x100000001B3)
_PIECE = 400_000
_START = 1


class _Letters:
    table: np.ndarray | None = None

    @classmethod
    def get(cls) -> np.ndarray:
        if cls.table is None:
            cls.table = np.array([chr(i).isalpha() for i in range(0x110000)])
        return cls.table


def codes_of(text: str) -> np.ndarray:
    """Lower-cased letters as code points; every run of other characters is one space, none at the start."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _Letters.get()[raw]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return np.where(letter, raw, np.uint32(32))[keep]


def _streams(texts: list[str | None], order: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(code points, row of each, whether it is predicted or only context), about ``size`` at once."""
    parts: list[np.ndarray] = []
    rows: list[int] = []
    held = 0
    pad = np.full(order - 1, _START, np.uint32)

    def out():
        lengths = np.array([len(p) for p in parts])
        told = np.ones(lengths.sum(), bool)
        begin = np.cumsum(lengths) - lengths
        for j in range(order - 1):
            told[begin + j] = False
        return np.concatenate(parts), np.repeat(rows, lengths), told

    for i, text in enumerate(texts):
        codes = codes_of(text) if text else pad[:0]
        if not len(codes):
            continue
        codes = np.concatenate([pad, codes])
        for at in range(0, len(codes) - order + 1, _PIECE):
            piece = codes[at : at + _PIECE + order - 1]
            parts.append(piece)
            rows.append(i)
            held += len(piece)
            if held >= size:
                yield out()
                parts, rows, held = [], [], 0
    if parts:
        yield out()


def _rolling(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """At n, the unmixed hash of the n code points that end at each place (n from 0)."""
    wide = codes.astype(U) + U(1)
    out, power = [np.zeros(len(codes), U)], U(1)
    with np.errstate(over="ignore"):
        for n in range(1, order + 1):
            now = out[-1].copy()
            now[n - 1 :] += (wide[: len(wide) - n + 1] if n > 1 else wide) * power
            out.append(now)
            power = power * _P
    return out


def _hash(codes: np.ndarray) -> np.ndarray:
    """The same hashes, mixed, of whole strings of code points, one a row."""
    n = codes.shape[1]
    total, power = np.zeros(len(codes), U), U(1)
    with np.errstate(over="ignore"):
        for j in range(n):
            total += (codes[:, n - 1 - j].astype(U) + U(1)) * power
            power = power * _P
    return mix(total * U(8) + U(n))


class Hashes:
    """A sorted array of hashes with an index over the high bits; ``find`` gives places, or -1."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys))))) + 1)
        self.starts = np.searchsorted(keys, np.arange(1 << self.bits, dtype=U) << U(64 - self.bits)).astype(np.int32)

    def find(self, want: np.ndarray) -> np.ndarray:
        at = self.starts[(want >> U(64 - self.bits)).astype(np.int64)].astype(np.int64)
        out = np.full(len(want), -1, np.int64)
        todo = np.arange(len(want))
        n = len(self.keys)
        while len(todo):
            inside = at < n
            todo, at = todo[inside], at[inside]
            seen = self.keys[at]
            hit = seen == want[todo]
            out[todo[hit]] = at[hit]
            more = seen < want[todo]
            todo, at = todo[more], at[more] + 1
        return out


@dataclass
class Model:
    langs: list[str]
    order: int
    grams: list[tuple[Hashes, np.ndarray]]  # at n - 1: hashes, log probabilities by language
    contexts: list[tuple[Hashes, np.ndarray]]  # at n - 1: hashes of n - 1 code points, log interpolation weights
    floor: float
    norm: dict[str, tuple[float, float]] | None = None  # usual cross-entropy and deviation of single characters

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character under each language, and characters; rows without a letter have 0 characters."""
        total, _, chars = self.sums(texts)
        return -total / np.maximum(chars, 1)[:, None], chars

    def sums(self, texts: list[str | None], squares: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums of the characters' log probabilities under each language, of their squares if asked for, and characters."""
        total, square = np.zeros((2, len(texts), len(self.langs)))
        chars = np.zeros(len(texts), np.int64)
        for codes, rows, told in _streams(texts, self.order, max(100_000, 4_000_000 // max(4, len(self.langs)))):
            rolled = _rolling(codes, self.order)
            at = np.flatnonzero(told)
            logp = np.zeros((len(at), len(self.langs)), np.float32)
            todo = np.arange(len(at))
            for n in range(self.order, 0, -1):
                where, values = self.grams[n - 1]
                found = where.find(mix(rolled[n][at[todo]] * U(8) + U(n)))
                hit = found >= 0
                logp[todo[hit]] += values[found[hit]]
                todo = todo[~hit]
                if not len(todo):
                    break
                where, values = self.contexts[n - 1]
                found = where.find(mix(rolled[n - 1][at[todo] - 1] * U(8) + U(n - 1)))
                hit = found >= 0
                logp[todo[hit]] += values[found[hit]]
            logp[todo] += self.floor
            mine = rows[at]
            first = np.flatnonzero(np.diff(mine, prepend=-1))
            total[mine[first]] += np.add.reduceat(logp, first, axis=0, dtype=np.float64)
            if squares:
                square[mine[first]] += np.add.reduceat(logp * logp, first, axis=0, dtype=np.float64)
            np.add.at(chars, mine[first], np.diff(np.append(first, len(mine))))
        return total, square, chars

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        entropy, chars = self.entropies(texts)
        best = entropy.argmin(axis=1) if len(self.langs) else np.zeros(len(texts), int)
        low = entropy[np.arange(len(texts)), best]
        scaled = np.exp(-(entropy - low[:, None]) * np.sqrt(np.maximum(chars, 1))[:, None])
        score = np.where(chars > 0, 1 / scaled.sum(axis=1), 0.0)
        lang = np.where(chars > 0, np.array(self.langs, object)[best], UNDETERMINED)
        out = pd.DataFrame({"lang_pred": lang, "score": score, "entropy": np.where(chars > 0, low, np.nan), "letters": chars})
        limit = np.full(len(texts), np.inf)
        if self.norm:
            mean, dev = (np.array([self.norm[x][i] for x in self.langs])[best] for i in (0, 1))
            limit = mean + np.maximum(MARGIN, ERRORS * dev / np.sqrt(np.maximum(chars, 1)))
        out["rejected"] = (chars == 0) | (low > limit)
        return out


def _count(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}

    def packed():
        for lang, parts in held.items():
            keys, grams, counts = (np.concatenate([p[i] for p in parts]) for i in range(3))
            _, first, back = np.unique(keys, return_index=True, return_inverse=True)
            held[lang] = [(keys[first], grams[first], np.bincount(back, weights=counts).astype(np.int64))]

    def rows():
        packed()
        for lang, [(_, grams, counts)] in held.items():
            text = grams.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(counts), pa.string()), pa.array([text[i : i + order] for i in range(0, len(text), order)], pa.string()), pa.array(counts, pa.int64())],
                names=["lang", "gram", "n"],
            )
        held.clear()

    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for lang in sorted(set(langs)):
            texts = batch.column(1).take(pa.array(np.flatnonzero(langs == lang))).to_pylist()
            for codes, _, told in _streams(texts, order, 1_000_000):
                rolled = _rolling(codes, order)[order]
                at = np.flatnonzero(told)
                keys, first, counts = np.unique(rolled[at], return_index=True, return_counts=True)
                grams = codes[(at[first][:, None] + np.arange(1 - order, 1)[None, :])]
                held.setdefault(lang, []).append((keys, grams, counts))
            if sum(len(p[0]) for parts in held.values() for p in parts) > 2_000_000:
                packed()
                if sum(len(p[0]) for parts in held.values() for p in parts) > 1_000_000:
                    yield from rows()
    if held:
        yield from rows()


def _text(strings: pa.Array) -> str:
    """All strings of an array as one, from its buffer."""
    strings = strings.cast(pa.large_string())
    if not len(strings):
        return ""
    ends = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    return strings.buffers()[2].to_pybytes()[ends[0] : ends[-1]].decode()


def _estimate(langs: list[str], counts: pa.Table, order: int) -> Model:
    """Interpolated Kneser-Ney estimates for all languages at once. counts: lang, gram, n.

    Grams are taken from Arrow's buffers, not as objects: all have ``order`` code points.
    """
    parts = [np.frombuffer(_text(c).encode("utf-32-le"), "<u4") for c in counts["gram"].chunks]
    codes = np.concatenate(parts).reshape(-1, order)
    lang = np.concatenate([pa.compute.index_in(c, pa.array(langs, c.type)).to_numpy(zero_copy_only=False) for c in counts["lang"].chunks])
    _, first, back = np.unique(_hash(codes), return_index=True, return_inverse=True)
    codes, matrix = codes[first], np.zeros((len(first), len(langs)))
    np.add.at(matrix, (back, lang), counts["n"].to_numpy().astype(float))
    layers = []  # from the highest order: grams, counts by language
    for size in range(order, 0, -1):
        if size < order:  # continuation counts: distinct left neighbours
            _, first, back = np.unique(_hash(codes[:, 1:]), return_index=True, return_inverse=True)
            seen, codes, matrix = matrix > 0, codes[first, 1:], np.zeros((len(first), len(langs)))
            np.add.at(matrix, back, seen)
        layers.append((size, codes, matrix))
    alphabet = len(layers[-1][1]) + 1
    floor = -np.log(alphabet)
    below, below_keys = np.full((1, len(langs)), 1 / alphabet), _hash(codes[:1, :0])
    grams, contexts = [], []
    while layers:
        size, codes, matrix = layers.pop()
        once, twice = ((matrix == v).sum(axis=0) for v in (1, 2))
        discount = np.clip(once / np.maximum(once + 2 * twice, 1), 0.1, 0.9)
        ctx_keys, ctx = np.unique(_hash(codes[:, :-1]), return_inverse=True)
        total = np.zeros((len(ctx_keys), len(langs)))
        kinds = np.zeros_like(total)
        np.add.at(total, ctx, matrix)
        np.add.at(kinds, ctx, matrix > 0)
        weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        lower = below[np.searchsorted(below_keys, _hash(codes[:, 1:]))]
        prob = np.maximum(matrix - discount, 0) / np.maximum(total, 1)[ctx] + weight[ctx] * lower
        keys = _hash(codes)  # in order: np.unique has sorted them
        grams.append((Hashes(keys), np.log(prob).astype(np.float32)))
        contexts.append((Hashes(ctx_keys), np.log(weight).astype(np.float32)))
        below, below_keys = prob, keys
    return Model(langs, order, grams, contexts, floor)


def train(docs: DataFrame, order: int = ORDER, text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of all rows of ``docs`` that have a text and a language."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang is not null and text is not null")
    counts = rows.mapInArrow(lean(lambda it: _count(it, order)), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = counts.persist()
    try:
        sizes = {r["lang"]: r["count"] for r in counts.groupBy("lang").count().collect()}
        langs = sorted(sizes)
        if not langs:
            return Model([], order, [], [], 0.0)
        if sum(sizes.values()) * len(langs) > MOST_CELLS:
            raise ValueError(f"{sum(sizes.values())} n-grams of {len(langs)} languages: more than a model of one machine holds (MOST_CELLS)")
        kept = counts.select("lang", "gram", "n").toArrow()
    finally:
        counts.unpersist()
    return _estimate(langs, kept, order)


def calibrate(model: Model, docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Set what cross-entropy is usual in each language, from all training texts."""
    if not model.langs:
        return model
    some = docs.select(F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l")).filter("t is not null and l is not null")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        places = {x: i for i, x in enumerate(m.langs)}
        for pdf in batches:
            pdf = pdf[pdf["l"].isin(places)]
            total, square, chars = m.sums(list(pdf["t"]), squares=True)
            own = np.arange(len(pdf)), pdf["l"].map(places).to_numpy(np.int64)
            yield pd.DataFrame({"lang": pdf["l"].to_numpy(), "chars": chars, "total": -total[own], "square": square[own]})

    seen = some.mapInPandas(lean(measure), "lang string, chars long, total double, square double").filter("chars > 0")
    entropy = F.col("total") / F.col("chars")
    told = [F.percentile_approx(entropy, 0.5, 10_000).alias("mean"), *(F.sum(c).alias(c) for c in ("chars", "total", "square")), F.count("*").alias("n")]
    norm: dict[str, tuple[float, float]] = {}
    rows = seen.rollup("lang").agg(*told).collect()  # the row of all texts has no lang
    usual = {r["lang"]: (r["mean"], float(np.sqrt(max(0.0, r["square"] / r["chars"] - (r["total"] / r["chars"]) ** 2))), r["n"]) for r in rows if r["chars"]}
    pooled = usual.get(None, (-model.floor - MARGIN, 0.0, 0))  # without any text: no worse than chance
    for lang in model.langs:
        mean, deviation, n = usual.get(lang, pooled)
        norm[lang] = (mean, deviation) if n >= LEAST_TEXTS else (max(mean, pooled[0]), max(deviation, pooled[1]))
    model.norm = norm
    return model


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1), entropy (nats a character), letters and rejected.

    Columns of those names are replaced, all others kept. A null text, or one without a letter, is ``und`` with score 0
    and rejected; ties go to the first language in order; without any learned language every row is ``und``. Texts are
    read whole, however long; rows that repeat are judged alike, each for itself; an empty table stays empty.
    """
    added = ["lang_pred", "score", "entropy", "letters", "rejected"]
    docs = docs.drop(*added)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)
    kinds = {"lang_pred": "string", "score": "double", "entropy": "double", "letters": "long", "rejected": "boolean"}
    from pyspark.sql.types import StructType

    schema = StructType(list(docs.schema.fields))
    for c in added:
        schema = schema.add(c, kinds[c])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(place).to_pylist()
            if m.langs:
                said = m.predict(texts)
            else:
                said = pd.DataFrame({"lang_pred": [UNDETERMINED] * len(texts), "score": 0.0, "entropy": np.nan, "letters": 0, "rejected": True}, index=range(len(texts)))
            new = [pa.array(said["lang_pred"], pa.string()), pa.array(said["score"], pa.float64()), pa.array(said["entropy"], pa.float64(), from_pandas=True), pa.array(said["letters"], pa.int64()), pa.array(said["rejected"], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[x.name for x in schema])

    return numbered(docs).mapInArrow(lean(run), schema)


def trained_on(docs: DataFrame) -> Model:
    """The production model: learned and calibrated on rows whose crc32(doc_id) mod 3 is not 1."""
    learn = docs.filter(hash_split(3) != 1)
    model = calibrate(train(learn), learn)
    release(docs.sparkSession)
    return model


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = trained_on(docs)
    read = docs.select("doc_id", "text").withColumn("held_out", hash_split(3) == 1)
    return identify(read, model).select("doc_id", "held_out", "lang_pred", "score", "rejected", "entropy")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the language models reject go, among them those without text or letters; without any
    learned language all go. Rows are judged each by its own text, whatever their ids; all columns stay, whatever their names."""
    said = identify(numbered(docs), trained_on(docs.select("doc_id", "text", "lang")), f"c{docs.columns.index('text')}")
    return said.filter(~F.col("rejected")).drop("lang_pred", "score", "entropy", "letters", "rejected").toDF(*docs.columns)
