"""Substring deduplication of passages by paragraph MinHash.

A text has three kinds of paragraphs, all compared over shingles of five words:

* lines of at least ``least`` words (51: passages of over 50 words; 5 at least, below which a line has no shingle),
* pieces of at least PIECE words between content-defined cuts: a word is a cut if no shingle within RADIUS words has a
  smaller hash. They take no notice of lines, so runs of short lines and parts of long ones are paragraphs too. MinHash
  bands (seven of three rows: a pair at a similarity of 0.8 collides with probability 0.993, one at 0.05, such as two
  paragraphs with a common short line, with 0.001) put lines with lines and pieces with pieces in buckets; all pairs of a bucket are then compared exactly (see setlinks), and components of the links are the clusters;
* windows of WINDOW words at content-defined places, for passages that begin and end anywhere. Winnowing takes the
  smallest shingle hash of every STRIDE neighbouring places, so equal stretches of WINDOW + STRIDE - 1 = 51 words share a
  window wherever they stand (those of 44 to 50 words do so sometimes). Here the band is the whole window, in 128 bits, so a bucket is a cluster. From the outer
  windows of a run, the words before and after are compared with those of the cluster's first document, so that a passage
  goes from its first equal word to its last. (Where two later documents agree further with each other than with the
  first, by fewer words than make a window of their own, up to STRIDE - 1 words stay.) Windows that no other document can
  share are left out before any shuffle, as far as a sketch of fixed size can tell them; a sketch that is too small for
  the input lets all pass, with the same result.

Of a cluster the paragraph with the smallest doc_id (then the smallest place) stays and those in other documents go; the
removed stretches of a document are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh, lean, numbered, quoted, release, table
from .setlinks import link
from .sketch import Sketch, shared_places
from .textvec import U, mix, powers, shingles, slices, words

K, THRESHOLD_PCT = 5, 80
LEAST = 51
PIECE, RADIUS = 51, 50
WINDOW, STRIDE = 44, 8
BANDS, ROWS = 7, 3
_ODD = (mix(np.arange(1, BANDS * ROWS + 1, dtype=U) * U(0x9E3779B97F4A7C15)) >> U(32)).astype(np.uint32) | np.uint32(1)
#: Inverse, modulo 2**64, of the base of ``powers``.
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class _Sequences:
    """128-bit hashes of any stretches of a row of words, from running sums."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        up = powers(n)[:n]
        self.down = np.concatenate([[U(1)], np.cumprod(np.full(n, _INVERSE, U))])
        self.sums = [np.concatenate([[U(0)], np.cumsum(x * up, dtype=U)]) for x in (hashes, mix(hashes + U(0x5851F42D4C957F2D)))]

    def of(self, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        return [mix((s[b] - s[a]) * self.down[a]) for s in self.sums]


def _lowest(keys: np.ndarray, size: int) -> np.ndarray:
    """At i, the least of keys[i : i + size]; shorter than keys by size - 1."""
    n, low, width = len(keys) - size + 1, keys, 1
    while width * 2 <= size:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    return np.minimum(low[:n], low[size - width : size - width + n])


def _ranked(grams: np.ndarray, n: int) -> np.ndarray:
    """Shingle hashes whose low bits tell places apart: of equal ones the last is the least."""
    return (grams[:n] & ~U(0xFFFFF)) | (U(0xFFFFF) - (np.arange(n, dtype=U) & U(0xFFFFF)))


def windows(grams: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, first word) of the winnowed windows of all rows; grams[i] is the shingle at word i."""
    n = int(before[-1]) - WINDOW + 1
    if n < STRIDE:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = _lowest(_ranked(grams, n), STRIDE)
    start = np.arange(len(low))
    row = np.searchsorted(before, start, "right") - 1
    inside = start + STRIDE - 1 + WINDOW <= before[row + 1]
    chosen = start + ((U(0xFFFFF) - (low & U(0xFFFFF))).astype(np.int64) - start & 0xFFFFF)
    chosen = np.unique(chosen[inside])
    return np.searchsorted(before, chosen, "right") - 1, chosen


def paragraphs(raw: np.ndarray, offsets: np.ndarray, grams: np.ndarray, starts: np.ndarray, before: np.ndarray, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(first word, word after the last) of the lines, and of the pieces, of all rows."""
    cuts = np.searchsorted(starts, np.union1d(offsets, np.flatnonzero(raw == 10) + 1))
    long = np.diff(cuts) >= least
    found = [(cuts[:-1][long], cuts[1:][long])]
    n = len(grams) - 2 * RADIUS
    edges = before
    if n > 0:
        key = _ranked(grams, len(grams))
        place = np.flatnonzero(_lowest(key, 2 * RADIUS + 1) == key[RADIUS : RADIUS + n]) + RADIUS
        row = np.searchsorted(before, place, "right") - 1
        place = place[(place - RADIUS >= before[row]) & (place + RADIUS + K <= before[row + 1])]
        edges = np.union1d(before, place)
    edges = np.unique(edges)
    long = np.diff(edges) >= PIECE
    return [*found, (edges[:-1][long], edges[1:][long])]


def bands(grams: np.ndarray, first: np.ndarray, last: np.ndarray, kind: int) -> np.ndarray:
    """Band keys of stretches of shingles [first, last), BANDS columns; kinds never meet."""
    ends = np.stack([first, last], axis=1).ravel()
    padded = np.append((grams >> U(32)).astype(np.uint32), np.uint32(0xFFFFFFFF))
    lows = [np.minimum.reduceat(padded * odd, ends)[::2].astype(U) if len(ends) else np.zeros(0, U) for odd in _ODD]
    out = []
    for b in range(BANDS):
        key = np.full(len(first), b + BANDS * kind, U)
        for low in lows[b * ROWS : (b + 1) * ROWS]:
            key = mix(key * U(0xC2B2AE3D27D4EB4F) + low)
        out.append(key)
    return np.stack(out, axis=1)


def _window_keys(texts: pa.Array) -> Iterator[np.ndarray]:
    for _, _, raw, offsets in slices(texts):
        hashes, _, _, before = words(raw, offsets)
        _, first = windows(shingles(hashes, K), before)
        if len(first):
            yield _Sequences(hashes).of(first, first + WINDOW)[0]


UNITS = "doc_id long, rid long, word int, words int, start long, end long, s1 long, s2 long, bands array<long>"


def _units(batches: Iterator[pa.RecordBatch], least: int, shared: Sketch) -> Iterator[pa.RecordBatch]:
    """Lines and pieces with their bands, and windows (without) that another may share."""
    for batch in batches:
        for at, _, raw, offsets in slices(batch.column(2)):
            hashes, starts, ends, before = words(raw, offsets)
            if not len(hashes):
                continue
            grams, whole = shingles(hashes, K), _Sequences(hashes)
            _, first = windows(grams, before)
            keys = whole.of(first, first + WINDOW)
            hit = shared.held(keys[0])
            first, keys = first[hit], [k[hit] for k in keys]
            found = [(a, b, *whole.of(a, b), kind) for kind, (a, b) in enumerate(paragraphs(raw, offsets, grams, starts, before, least))]
            for x, y, s1, s2, kind in (*found, (first, first + WINDOW, *keys, None)):
                if not len(x):
                    continue
                r = np.searchsorted(before, x, "right") - 1
                told = pa.nulls(len(x), pa.list_(pa.int64()))
                if kind is not None:
                    s2, told = s2 ^ U(kind), pa.array(list(bands(grams, x, y - K + 1, kind).view(np.int64)), pa.list_(pa.int64()))
                where = pa.array(at + r)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(where), batch.column(1).take(where), pa.array(x - before[r], pa.int32()), pa.array(y - x, pa.int32()), pa.array(starts[x] - offsets[r]), pa.array(ends[y - 1] - offsets[r]), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), told],
                    names=["doc_id", "rid", "word", "words", "start", "end", "s1", "s2", "bands"],
                )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingle sets of the wanted stretches of each text."""
    for batch in batches:
        wanted = batch.column(1)
        flat, counts = wanted.flatten(), wanted.value_lengths().to_numpy()
        owner = np.repeat(np.arange(batch.num_rows), counts)
        word, size = (flat.field(c).to_numpy() for c in ("word", "words"))
        for at, to, raw, offsets in slices(batch.column(0)):
            hashes, _, _, before = words(raw, offsets)
            grams = shingles(hashes, K)
            mine = np.flatnonzero((owner >= at) & (owner < to))
            first = before[owner[mine] - at] + word[mine]
            for base in range(0, len(mine), 2_000):
                some = slice(base, base + 2_000)
                keys = [np.unique(grams[a : a + n - K + 1]).tobytes() for a, n in zip(first[some].tolist(), size[mine[some]].tolist())]
                part = flat.take(pa.array(mine[some]))
                yield pa.RecordBatch.from_arrays([*(part.field(c) for c in ("uid", "block", "weight")), pa.array([0] * len(keys), pa.int32()), pa.array(keys, pa.binary())], names=["uid", "block", "weight", "fragment", "keys"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each wanted side of a window, the hashes of the STRIDE - 1 words beyond it, nearest first, and the bytes they reach."""
    for batch in batches:
        wanted = batch.column(3)
        flat, counts = wanted.flatten(), wanted.value_lengths().to_numpy()
        owner = np.repeat(np.arange(batch.num_rows), counts)
        word, side = (flat.field(c).to_numpy() for c in ("word", "side"))
        for at, to, raw, offsets in slices(batch.column(2)):
            hashes, starts, ends, before = words(raw, offsets)
            mine = np.flatnonzero((owner >= at) & (owner < to))
            row = owner[mine] - at
            left = side[mine] == 0
            near = before[row] + word[mine]
            step = np.arange(STRIDE - 1)
            place = np.where(left[:, None], near[:, None] - 1 - step, near[:, None] + WINDOW + step)
            size = np.where(left, near - before[row], before[row + 1] - near - WINDOW).clip(0, STRIDE - 1)
            inside = step < size[:, None]
            some = place[inside]
            cuts = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
            reach = np.where(np.repeat(left, size), starts[some], ends[some]) - np.repeat(offsets[row], size)
            lists = [pa.ListArray.from_arrays(cuts, pa.array(v)) for v in (hashes[some].view(np.int64), reach.astype(np.int64))]
            own, part = pa.array(owner[mine]), flat.take(pa.array(mine))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), *(part.field(c) for c in ("word", "side", "s1", "s2")), *lists], names=["doc_id", "rid", "word", "side", "s1", "s2", "context", "reach"])


def repeated_paragraphs(docs: DataFrame, units: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, rid, word, words, start, end, component_id): lines and pieces of clusters that several documents share."""
    units = units.filter("bands is not null").withColumn("uid", F.xxhash64("doc_id", "rid", "word", "words", "s2"))
    sets = units.select("uid", F.col("words").cast("long").alias("n"), "s1", "s2")

    def held_of(reps: DataFrame) -> DataFrame:
        return units.select("uid", "bands").join(reps.select("uid"), "uid").select("uid", F.explode("bands").alias("bucket"))

    def cut_of(home: DataFrame) -> DataFrame:
        wanted = units.select("uid", "doc_id", "rid", "word", "words").join(home, "uid")
        wanted = wanted.groupBy("doc_id", "rid").agg(F.collect_set(F.struct("uid", "block", "weight", "word", "words")).alias("wanted"))  # of one text
        texts = docs.join(wanted.hint("shuffle_hash"), ["doc_id", "rid"]).select("text", "wanted")
        return texts.mapInArrow(lean(_cut), "uid long, block long, weight long, fragment int, keys binary")

    found = link(sets, held_of, cut_of, THRESHOLD_PCT, scratch, counted=False)
    told = scratch.keep(units.join(found.filter("links > 0"), [units["words"] == found["n"], units["s1"] == found["s1"], units["s2"] == found["s2"]]).select("component", "doc_id", "rid", "word", "words", "start", "end"), "told")
    first = told.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.max("doc_id").alias("last")).filter("component_id < last")
    first = scratch.keep(first.select("component", "component_id"), "firsts")  # a table, so that a large cluster's join can be split
    return told.join(first, "component").drop("component")


def repeated_windows(docs: DataFrame, units: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, rid, word, words, start, end, component_id): stretches around windows that several documents share."""
    units = units.filter("bands is null").select("s1", "s2", "doc_id", "rid", "word", "start", "end")
    first = units.groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "word", "rid")).alias("first"), F.max("doc_id").alias("last")).filter("first.doc_id < last")
    first = scratch.keep(first.select("s1", "s2", F.col("first.doc_id").alias("component_id"), F.col("first.word").alias("first_word"), F.col("first.rid").alias("first_rid")), "window-firsts")
    release(docs.sparkSession)
    found = units.join(first, ["s1", "s2"]).withColumn("removed", F.col("doc_id") > F.col("component_id"))
    row = Window.partitionBy("doc_id", "rid", "removed")
    own = row.orderBy("word")
    runs = found.withColumn("run", F.when(F.col("word") - F.lag("word").over(own) <= WINDOW, 0).otherwise(1)).withColumn("run", F.sum("run").over(own))
    run = Window.partitionBy("doc_id", "rid", "removed", "run")
    runs = runs.withColumn("from", F.min("word").over(run)).withColumn("to", F.max("word").over(run))
    # what the run covers as far as any comparison would reach needs none
    outer = F.struct("s1", "s2", "word", "start", "end", "component_id", "first_word", "first_rid", (F.col("word") - F.col("from") < STRIDE - 1).alias("left"), (F.col("to") - F.col("word") < STRIDE - 1).alias("right"))
    runs = runs.groupBy("doc_id", "rid", "removed", "run").agg(
        F.min("from").alias("word"), (F.max("to") - F.min("from") + WINDOW).alias("words"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("component_id").alias("component_id"),
        F.collect_list(F.when(F.col("removed") & (outer["left"] | outer["right"]), outer)).alias("outer"),  # two times STRIDE at most
    )
    runs = scratch.keep(runs, "runs")
    scratch.drop("units")
    scratch.drop("window-firsts")
    del units, first, found
    release(docs.sparkSession)
    sides = runs.filter("removed").select("doc_id", "rid", F.explode("outer").alias("o")).select("doc_id", "rid", "o.*")
    sides = sides.withColumn("side", F.explode(F.array_compact(F.array(F.when(F.col("left"), 0), F.when(F.col("right"), 1))))).drop("left", "right")
    sides = scratch.keep(sides, "sides")
    wanted = sides.select("doc_id", "rid", "word", "side", "s1", "s2").unionByName(
        sides.select(F.col("component_id").alias("doc_id"), F.col("first_rid").alias("rid"), F.col("first_word").alias("word"), "side", "s1", "s2").distinct()
    )
    wanted = wanted.groupBy("doc_id", "rid").agg(F.collect_set(F.struct("word", "side", "s1", "s2")).alias("wanted"))  # of one text
    contexts = docs.join(wanted.hint("shuffle_hash"), ["doc_id", "rid"]).select("doc_id", "rid", "text", "wanted")
    contexts = scratch.keep(contexts.mapInArrow(lean(_contexts), "doc_id long, rid long, word int, side int, s1 long, s2 long, context array<long>, reach array<long>"), "contexts")
    release(docs.sparkSession)
    theirs = sides.select("s1", "s2", "side", F.col("component_id").alias("doc_id"), F.col("first_word").alias("word"), F.col("first_rid").alias("rid")).distinct()
    theirs = theirs.join(contexts, ["s1", "s2", "side", "doc_id", "word", "rid"]).groupBy("s1", "s2", "side").agg(F.first("context").alias("their_context"), F.first("reach").alias("their_reach"))
    theirs = scratch.keep(theirs, "their-contexts")
    equal = "array_position(zip_with(context, their_context, (x, y) -> coalesce(x = y, false)), false)"
    both = sides.join(contexts, ["s1", "s2", "side", "doc_id", "word", "rid"]).join(theirs, ["s1", "s2", "side"])
    both = both.withColumn("n", F.expr(f"cast(if({equal} = 0, size(context), {equal} - 1) as int)")).filter("n > 0")
    both = scratch.keep(both.select(*sides.columns, "n", F.expr("reach[n - 1]").alias("reach"), F.expr("their_reach[n - 1]").alias("their_reach")), "extended")
    theirs = both.groupBy(F.col("component_id").alias("doc_id"), F.col("first_rid").alias("rid"), F.col("first_word").alias("word"), "side").agg(F.max(F.struct("n", "their_reach")).alias("m"))

    def stretch(df: DataFrame, component: str) -> DataFrame:
        """The n words beyond the window."""
        word = F.when(F.col("side") == 0, F.col("word") - F.col("n")).otherwise(F.col("word") + WINDOW)
        return df.select("doc_id", "rid", word.alias("word"), F.col("n").alias("words"), F.when(F.col("side") == 0, F.col("reach")).alias("start"), F.when(F.col("side") == 1, F.col("reach")).alias("end"), F.col(component).alias("component_id"))

    more = stretch(both, "component_id").unionByName(stretch(theirs.select("doc_id", "rid", "word", "side", "m.n", F.col("m.their_reach").alias("reach")), "doc_id"))
    return runs.select(more.columns).unionByName(more)


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["doc_id", "rid", "start", "end", "component_id", "removed"]
    for pdf in batches:
        out = []
        for doc, rid, spans in zip(pdf["doc_id"], pdf["rid"], pdf["spans"]):
            gone: list[list] = []  # removed, first word, word after the last, start, end, component
            for s in spans:
                now = gone[-1] if gone else None
                if now and now[0] == s["removed"] and s["word"] <= now[2]:
                    now[2] = max(now[2], s["word"] + s["words"])
                    now[3:5] = (f([x for x in (p, s[c]) if x is not None and x == x]) for f, p, c in ((_least, now[3], "start"), (_most, now[4], "end")))
                    now[5] = min(now[5], s["component_id"])
                else:
                    gone.append([s["removed"], s["word"], s["word"] + s["words"], s["start"], s["end"], s["component_id"]])
            cuts = np.array([g[1:3] for g in gone if g[0]], np.int64).reshape(-1, 2)
            for g in gone:  # what stays for one cluster but goes for another goes
                at = np.searchsorted(cuts[:, 1], g[1], "right")
                if g[0] or at == len(cuts) or cuts[at, 0] >= g[2]:
                    out.append((doc, rid, g[3], g[4], g[5], g[0]))
        yield pd.DataFrame(out, columns=names)


def _least(x: list[int]) -> int | None:
    return min(x, default=None)


def _most(x: list[int]) -> int | None:
    return max(x, default=None)


def _spans(docs: DataFrame, least: int) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "substring-dedup")
    docs = docs.filter("doc_id is not null and text is not null")
    shared = docs.sparkSession.sparkContext.broadcast(shared_places(docs.select("text"), _window_keys))
    release(docs.sparkSession)
    units = scratch.keep(docs.select("doc_id", "rid", "text").mapInArrow(lean(partial(_units_of, least=max(least, K), shared=shared)), UNITS), "units")
    found = scratch.keep(repeated_paragraphs(docs, units, scratch), "paragraphs")
    release(docs.sparkSession)
    found = found.unionByName(repeated_windows(docs, units, scratch)).withColumn("removed", F.col("doc_id") > F.col("component_id"))
    # of one text: no more rows than its words
    each = found.groupBy("doc_id", "rid").agg(F.array_sort(F.collect_set(F.struct("removed", "word", "words", "start", "end", "component_id"))).alias("spans"))
    return each.mapInPandas(lean(_merge), "doc_id long, rid long, start long, end long, component_id long, removed boolean")


def _units_of(batches: Iterator[pa.RecordBatch], least: int, shared) -> Iterator[pa.RecordBatch]:
    yield from _units(batches, least, shared.value)


def _identified(docs: DataFrame, id_col: str, text_col: str):
    """The id as a number, and a hash that tells apart texts of one id."""
    doc = F.col(id_col).cast("long")
    return doc, F.xxhash64(doc, F.col(text_col).cast("string"))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """Repeated passages: doc_id, start, end (bytes of the UTF-8 text), component_id, removed.

    component_id is the smallest doc_id of the passage's cluster; there it stays (removed is false), in all other
    documents it goes. Stretches that touch are one row, with the smallest of their component ids. ``least``: words of a
    line that counts. Null, empty and short texts, rows without a doc_id, and passages that one document alone repeats
    give no rows. Rows that repeat a doc_id count as that document, each text with its own places. Texts are read whole,
    however long. Other columns are not read, whatever their names; an empty table gives no rows.
    """
    doc, rid = _identified(docs, id_col, text_col)
    docs = docs.select(doc.alias("doc_id"), rid.alias("rid"), F.col(text_col).cast("string").alias("text"))
    return _spans(docs, least).drop("rid").select("doc_id", "start", "end", "component_id", "removed")


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with the removed passages cut out of the texts; all columns and rows stay, whatever their names.

    A cut leaves one space where words on both of its sides would else touch, or a newline if the passage held one; of
    whole lines nothing stays. Rows that repeat a doc_id are cut each by its own text; null ids and texts stay as they are.
    """
    scratch = Scratch(docs.sparkSession, "substring-dedup")
    doc, rid = _identified(docs, id_col, text_col)
    read = docs.select(doc.alias("doc_id"), rid.alias("rid"), F.col(text_col).cast("string").alias("text"))
    names = [fresh(docs.columns, x) for x in ("doc", "rid", "cuts")]
    gone = _spans(read, least).filter("removed").groupBy("doc_id", "rid").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    gone = scratch.keep(gone, "cuts").toDF(*names)
    # rows without passages to cut never meet Python
    both = docs.join(gone.hint("shuffle_hash"), (doc == F.col(names[0])) & (rid == F.col(names[1])), "left")
    stay = both.filter(F.col(names[2]).isNull()).select(*map(quoted, docs.columns))
    at, schema = docs.columns.index(text_col), docs.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [cut_text(t, [(c["start"], c["end"]) for c in cuts]) for t, cuts in zip(batch.column(at).to_pylist(), batch.column(len(schema)).to_pylist())]
            columns = batch.columns[: len(schema)]
            columns[at] = pa.array(texts, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[: len(schema)])

    gone = both.filter(F.col(names[2]).isNotNull()).select(*map(quoted, docs.columns), names[2])
    return stay.unionByName(numbered(gone).mapInArrow(cut, schema))


def cut_text(text: str | None, cuts: list[tuple[int, int]]) -> str | None:
    if text is None:
        return None
    raw, out, at = text.encode(), [], 0
    for a, b in cuts:
        if b <= at:
            continue
        a = max(a, at)
        out.append(raw[at:a])
        if raw[max(a - 1, 0) : a] in (b"", b"\n") and raw[b : b + 1] in (b"", b"\n"):
            at = b + 1 if raw[b : b + 1] else b
            continue
        seam = b"\n" if b"\n" in raw[a:b] else b" "
        if raw[max(a - 1, 0) : a].strip() and raw[b : b + 1].strip():
            out.append(seam)
        at = b
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "replace")


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return spans(table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated passages stay in one document; a text's n_chars follows. All rows stay, as ``clean`` has it."""
    done = clean(docs)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done
