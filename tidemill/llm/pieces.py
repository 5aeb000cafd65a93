"""SentencePiece encoding and decoding over a relational lattice.

Encoding works on distinct words. A word (a run of spaces, as U+2581, and what follows up to the next) is exploded into
its substrings of bounded length, an equi-join with the piece table keeps those that are pieces, and grouping by word
makes the lattice: (start, end, id, score). A Spark higher-order ``aggregate`` folds each lattice to where the word is cut:

* ``unigram`` models: Viterbi, the path of the greatest total score,
* ``bpe`` models: the lattice's merges in order of score, which is what such a model means. The fold walks the edges
  once by rank; where a merge makes an edge of better rank possible, the word is folded again by repeated best merges.

No piece reaches from a word into the next, so a text's ids are its words' ids in order; characters without a piece
become their UTF-8 bytes' pieces. Texts travel in packs: a pack holds its distinct parts once and a number for each
occurrence, lists its distinct words once, by buckets, receives their cuts and assembles its ids, so that neither texts
nor words are shuffled one by one. Words of more than ``LONG_WORD`` characters are merged (or searched) by the same
rules within the task.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pac
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, release, table

SPACE = "▁"
LONG_WORD = 60
#: Bytes of text in a pack.
PACK = 8_000_000
#: Words of packs in one part of the fold.
PART = 100_000
#: Buckets of words for each part of the fold, so that parts are of like size.
BUCKETS = 4
#: Ids that are decoded at once.
IDS = 2_000_000
#: What a character without a piece costs a path, beside any score of a real model.
UNKNOWN = -1e12
NONE = 2_147_483_647


@dataclass
class Pieces:
    """A piece table: all pieces of two characters and more and single ones, and ids of the bytes 0 to 255."""

    names: list[str]
    scores: list[float]
    normal: list[bool]
    bytes_at: int
    kind: str

    @classmethod
    def load(cls, path: str, kind: str = "bpe") -> Pieces:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        special = [m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i) for i in range(n)]
        at = m.piece_to_id("<0x00>")
        if not m.is_byte(at) or any(m.piece_to_id(f"<0x{b:02X}>") != at + b for b in range(256)):
            raise ValueError("the model has no byte pieces in order")
        names = [m.id_to_piece(i) for i in range(n)]
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p, s in zip(names, special) if not s):
            raise ValueError("pieces reach over words")
        return cls(names, [m.get_score(i) for i in range(n)], [not s for s in special], at, kind)

    def ranked(self) -> dict[str, tuple[int, int, float]]:
        """Piece: (rank by falling score, id, score)."""
        order = sorted((i for i in range(len(self.names)) if self.normal[i]), key=lambda i: (-self.scores[i], i))
        return {self.names[i]: (r, i, self.scores[i]) for r, i in enumerate(order)}

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(p, r, i, s) for p, (r, i, s) in self.ranked().items()]
        return spark.createDataFrame([*rows, ("", (1 << 24) - 1, 0, 0.0)], "piece string, rank int, id int, score double")

    @property
    def longest(self) -> int:
        return max(len(p) for p, ok in zip(self.names, self.normal) if ok)


def split_words(text: str) -> list[str]:
    """The words of a text, with newlines as words of their own; together they are the text after its dummy prefix."""
    out: list[str] = []
    if not text:
        return out
    for n, line in enumerate(text.split("\n")):
        if n:
            out.append("\n")
        parts = line.split(" ")
        if "" not in parts:
            out.append(SPACE + parts[0] if n == 0 else parts[0])
            out.extend([SPACE + p for p in parts[1:]])
            continue
        run = SPACE if n == 0 else ""
        for j, p in enumerate(parts):
            run += SPACE if j else ""
            if p:
                out.append(run + p)
                run = ""
        if run:
            out.append(run)
    return out


def long_ids(word: str, pieces: dict[str, tuple[int, int, float]], bytes_at: int, kind: str, longest: int) -> list[int]:
    """One word's ids by the same rules, without the lattice, in time that hardly grows faster than its length."""
    n = len(word)
    if kind == "bpe":
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n and after[after[i]] - i <= longest and (e := pieces.get(word[i : after[after[i]]])):
                heapq.heappush(heap, (e[0], i, after[after[i]]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or after[i] >= n or after[after[i]] != end:
                continue
            gone = after[i]
            alive[gone] = False
            after[i] = end
            if end < n:
                before[end] = i
            offer(before[i])
            offer(i)
        cuts = [i for i in range(n) if alive[i]] + [n]
    else:
        best, back = [0.0] + [-np.inf] * n, [0] * (n + 1)
        for j in range(1, n + 1):
            for i in range(max(0, j - longest), j):
                e = pieces.get(word[i:j])
                s = e[2] if e else UNKNOWN if j - i == 1 else -np.inf
                if best[i] + s > best[j]:
                    best[j], back[j] = best[i] + s, i
        cuts = [n]
        while cuts[-1]:
            cuts.append(back[cuts[-1]])
        cuts.reverse()
    out: list[int] = []
    for a, b in zip(cuts, cuts[1:]):
        e = pieces.get(word[a:b])
        out += [e[1]] if e else [bytes_at + x for x in word[a:b].encode()]
    return out


# An edge is one long: rank (24 bits), id (24), start (6), end (6), so that sorting edges sorts them by rank and start.
_EDGE = "shiftleft(cast(rank as bigint), 36) | shiftleft(cast(id as bigint), 12) | shiftleft(cast(i as bigint), 6) | cast(j as bigint)"
_I, _J = "cast(shiftright({e}, 6) & 63 as int)", "cast({e} & 63 as int)"
# Edges by rank. The state is one long: a bit for each place where the word is still cut, and DIRTY once a merge has made
# one of better rank possible, which the walk has passed already. An edge is a merge if both its ends are cuts and just
# one cut lies between them.
_DIRTY = 1 << 62
_INSIDE = f"(shiftleft(1L, {_J} - {_I} - 1) - 1)"
_MERGES = f"{_J} > 0 and (shiftright({{b}}, {_I}) & 1) = 1 and (shiftright({{b}}, {_J}) & 1) = 1 and bit_count(shiftright({{b}}, {_I} + 1) & {_INSIDE}) = 1"


def _walk() -> str:
    """The fold's expression: an aggregate over ``edges``."""
    merged = f"b & ~shiftleft({_INSIDE}, {_I} + 1)".format(e="e")
    passed = f"exists(edges, x -> x < e and {_MERGES.format(b='m', e='x')})"
    return f"aggregate(edges, shiftleft(1L, length(word) + 1) - 1, (b, e) -> if({_MERGES.format(b='b', e='e')}, transform(array({merged}), m -> if({passed}, m | {_DIRTY}L, m))[0], b))"


_AGAIN = f"""aggregate(sequence(1, length(word)), sequence(0, length(word)), (b, s) -> if(size(b) < 3, b,
  element_at(transform(array(array_min(transform(sequence(0, size(b) - 3), t -> struct(coalesce(shiftright(try_element_at(known, b[t] * 64 + b[t + 2]), 36), {NONE}) as r, t as t)))),
    m -> if(m.r = {NONE}, b, concat(slice(b, 1, m.t + 1), slice(b, m.t + 3, size(b))))), 1)))"""
# edges by end and start; the state holds for each place the best score of a path to it and that path's cuts
_VITERBI = """element_at(aggregate(scored, array_repeat(named_struct('s', cast(null as double), 'cuts', array(0)), length(word) + 1), (b, e) ->
  element_at(transform(array(coalesce(get(b, e.i).s, if(e.i = 0, 0D, null)) + e.score), v -> if(v is null or coalesce(get(b, e.j).s >= v, false), b,
    concat(slice(b, 1, e.j), array(named_struct('s', v, 'cuts', concat(get(b, e.i).cuts, array(e.j)))), slice(b, e.j + 2, size(b))))), 1)), -1).cuts"""


def word_cuts(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, cuts) for a table of distinct words of LONG_WORD characters at most: a bit for each place where a piece begins
    or ends. Columns beside the word stay with it.

    Lattice, join and fold keep the partitioning of ``words`` by any of its columns, so nothing is shuffled here.
    """
    spark, keys = words.sparkSession, words.columns
    known = F.broadcast(pieces.frame(spark))  # as many rows as the vocabulary
    places = "aggregate({cuts}, 0L, (m, c) -> m | shiftleft(1L, c))"
    if pieces.kind == "unigram":
        parts = words.select(*keys, F.explode(F.expr("sequence(0, length(word) - 1)")).alias("i"))
        parts = parts.select(*keys, "i", F.explode(F.expr(f"sequence(i + 1, least(i + {pieces.longest}, length(word)))")).alias("j")).withColumn("piece", F.expr("substring(word, i + 1, j - i)"))
        scored = parts.join(known, "piece", "left").filter("id is not null or j = i + 1").groupBy(*keys)
        scored = scored.agg(F.sort_array(F.collect_list(F.struct("j", "i", F.coalesce("score", F.lit(UNKNOWN)).alias("score")))).alias("scored"))
        return scored.withColumn("at", F.expr(_VITERBI)).select(*keys, F.expr(places.format(cuts="at")).alias("cuts"))
    # single characters are no merges; every word has an empty substring at its start, whose edge is the last and no merge
    parts = words.select(*keys, F.explode(F.expr("sequence(0, greatest(length(word) - 2, 0))")).alias("i"))
    ends = f"if(length(word) < 2, array(0), if(i = 0, concat(array(0), sequence(2, least({pieces.longest}, length(word)))), sequence(i + 2, least(i + {pieces.longest}, length(word)))))"
    parts = parts.select(*keys, "i", F.explode(F.expr(ends)).alias("j")).withColumn("piece", F.expr("substring(word, i + 1, j - i)"))
    lattice = parts.join(known, "piece").groupBy(*keys).agg(F.sort_array(F.collect_list(F.expr(_EDGE))).alias("edges"))
    again = f"transform(array(map_from_arrays(transform(edges, e -> {_I} * 64 + {_J}), edges)), known -> {places.format(cuts=_AGAIN)})[0]".replace("{e}", "e")
    return lattice.withColumn("once", F.expr(_walk())).select(*keys, F.when(F.col("once") < _DIRTY, F.col("once")).otherwise(F.expr(again)).alias("cuts"))


def cut_ids(word: str, cuts: int, pieces: dict[str, tuple[int, int, float]], bytes_at: int) -> list[int]:
    """The ids of a word that is cut at the bits of ``cuts``."""
    out, a, rest = [], 0, cuts >> 1
    while rest:
        step = (rest & -rest).bit_length()
        e = pieces.get(word[a : a + step])
        if e:
            out.append(e[1])
        else:
            out += [bytes_at + x for x in word[a : a + step].encode()]
        a, rest = a + step, rest >> step
    return out


def word_ids(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, ids) for a table of distinct words of LONG_WORD characters at most."""
    shared = words.sparkSession.sparkContext.broadcast((pieces.ranked(), pieces.bytes_at))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [cut_ids(w, c, *shared.value) for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    return word_cuts(words, pieces).mapInArrow(run, "word string, ids array<int>")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        sizes = np.cumsum(pac.fill_null(pac.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, base + PACK, "right")))
            units, plain, codes, rows = _units(batch.slice(at, to - at))
            columns = [pa.array([x], pa.int64()) for x in (number, len(units), plain)] + [pa.array([x], pa.binary()) for x in (_shut(units), _planes(codes), _close(rows))]
            yield pa.RecordBatch.from_arrays(columns, names=["pack", "n", "plain", "units", "codes", "rows"])
            number, at = number + 1, to


def _close(batch: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return out.getvalue().to_pybytes()


def _open(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers (int32), compressed a byte's place at a time."""
    return len(numbers).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)


def _numbers(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    planes = np.frombuffer(pa.decompress(blob[8:], 4 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view(np.int32).ravel()


def _shut(units: pa.Array) -> bytes:
    """Strings as lengths and one text."""
    lengths, text = _planes(pac.binary_length(units).to_numpy().astype(np.int32)), pac.binary_join(pa.ListArray.from_arrays(pa.array([0, len(units)], pa.int32()), units), "")[0].as_buffer()
    return len(lengths).to_bytes(8, "little") + len(text).to_bytes(8, "little") + lengths + pa.compress(text, "zstd", asbytes=True)


def _units_in(blob: bytes) -> pa.Array:
    n, size = int.from_bytes(blob[:8], "little"), int.from_bytes(blob[8:16], "little")
    lengths = _numbers(blob[16 : 16 + n])
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets.tobytes()), pa.decompress(blob[16 + n :], size, "zstd"))


def _part_words(part: str) -> list[str]:
    """The words of a part that follows a space, or begins a text."""
    first, *rest = part.split("\n")
    out = [SPACE + first]
    for r in rest:
        out += ["\n", r] if r else ["\n"]
    return out


def _units(docs: pa.RecordBatch) -> tuple[pa.Array, int, np.ndarray, pa.RecordBatch]:
    """What the texts are made of: their distinct parts between single spaces and, from the place that comes next, the words of
    texts with runs of spaces; all occurrences as numbers of these; (doc_id, count) of the texts in the order of the occurrences."""
    ids, texts = docs.column(0), pac.fill_null(docs.column(1), "")
    odd = pac.or_(pac.or_(pac.match_substring(texts, "  "), pac.match_substring(texts, "\n ")), pac.or_(pac.starts_with(texts, " "), pac.ends_with(texts, " ")))
    empty = pac.equal(texts, "")
    even = pac.invert(pac.or_(odd, empty))
    split = pac.split_pattern(texts.filter(even), " ")
    told = split.flatten().dictionary_encode()
    parts, codes = told.dictionary, told.indices.to_numpy().astype(np.int32)
    # the frequent first, then by text, so that numbers and parts are short when compressed
    often = np.bincount(codes, minlength=len(parts))
    order = pac.sort_indices(parts).to_numpy().astype(np.int64)
    order = order[np.argsort(-np.where(often < 4, 0, often)[order], kind="stable")]
    place = np.empty(len(parts), np.int32)
    place[order] = np.arange(len(parts), dtype=np.int32)
    words: dict[str, int] = {}
    spaced = [[words.setdefault(w, len(parts) + len(words)) for w in split_words(t)] for t in texts.filter(odd).to_pylist()]
    codes = np.concatenate([place[codes], *(np.array(x, np.int32) for x in spaced)])
    counts = np.concatenate([pac.list_value_length(split).to_numpy().astype(np.int64), np.array([len(x) for x in spaced], np.int64), np.zeros(pac.sum(empty).as_py() or 0, np.int64)])
    rows = pa.record_batch([pa.concat_arrays([ids.filter(even), ids.filter(odd), ids.filter(empty)]), pa.array(counts)], names=["doc_id", "count"])
    return pa.concat_arrays([parts.take(pa.array(order)), pa.array(list(words), pa.string())]), len(parts), codes, rows


def _words_of(units: pa.Array, plain: int) -> pa.Array:
    """The distinct words of units for the lattice."""
    parts = units[:plain]
    lined = pac.match_substring(parts, "\n")
    more = set(units[plain:].to_pylist())
    for p in parts.filter(lined).to_pylist():
        more.update(_part_words(p))
    words = pa.concat_arrays([pac.binary_join_element_wise(SPACE, parts.filter(pac.invert(lined)), ""), pa.array(sorted(more), pa.string())]).unique()
    return words.filter(pac.and_(pac.and_(pac.not_equal(words, "\n"), pac.not_equal(words, "")), pac.less_equal(pac.utf8_length(words), LONG_WORD)))


def _dealt(units: pa.Array, plain: int, buckets: int) -> tuple[pa.Array, np.ndarray]:
    """The words of units by bucket and text, and their buckets."""
    words = _words_of(units, plain)
    words = words.take(pac.sort_indices(words))
    bucket = (pd.util.hash_array(np.array(words.to_pylist(), dtype=object), categorize=False) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    return words.take(pa.array(order)), bucket[order]


def _words(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for pack, plain, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            words, bucket = _dealt(_units_in(blob.as_py()), plain, buckets)
            found, starts = np.unique(bucket, return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(bucket)), pa.int32()), words)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(np.full(len(found), pack)), pac.binary_join(lists, "\n")], names=["word_bucket", "pack", "words"])


def encode(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (array of int). A null or empty text has no ids.

    Ids are those of the model's own library without special tokens. Rows that repeat an id, and null ids, are encoded
    each for itself; other columns are not read; an empty table gives none. Texts are read whole, of any length.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pieces")
    # packs are numbered as they come, so they are written down before they are read twice
    packs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # by buckets, so that they are not dealt again when their words' cuts come to them
    packs = scratch.keep_bucketed(packs.mapInArrow(_pack, "pack long, n long, plain long, units binary, codes binary, rows binary"), "packs", "pack")
    # words are dealt once: their fold and the join that hands out what it finds stay in these parts, each of bounded size
    total = packs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    deal = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART))
    buckets = BUCKETS * deal
    listed = packs.select("pack", "plain", "units").mapInArrow(lambda it: _words(it, buckets), "word_bucket int, pack long, words string")
    # a word once a pack at most, the words of a pack and bucket in one row
    dealt = listed.repartition(deal, "word_bucket").select("word_bucket", "pack", F.posexplode(F.split("words", "\n", -1)).alias("place", "word"))
    # hashing falls back to sorting here, after work that is then for nothing; a bucket holds all rows of its words
    settings = ("spark.sql.execution.useObjectHashAggregateExec", "spark.sql.requireAllClusterKeysForCoPartition")
    before = {k: spark.conf.get(k) for k in settings}
    for k in settings:
        spark.conf.set(k, "false")
    try:
        # the condition always holds; with the same columns both sides of the join read one exchange
        distinct = dealt.groupBy("word_bucket", "word").agg(F.max("pack").alias("p"), F.max("place").alias("q")).filter("p >= 0 and q >= 0").select("word_bucket", "word")
        found = dealt.join(word_cuts(distinct, pieces).hint("merge"), ["word_bucket", "word"]).groupBy("word_bucket", "pack")
        found = found.agg(F.sort_array(F.collect_list(F.struct("place", "cuts"))).alias("found")).select("pack", "word_bucket", F.col("found.cuts").alias("cuts"))
        found = scratch.keep(found, "cuts")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    del listed, dealt, distinct
    release(spark)
    shared = spark.sparkContext.broadcast((pieces.ranked(), pieces.bytes_at, pieces.kind, pieces.longest))

    def assemble(found: pa.Table, packs: pa.Table) -> pa.Table:
        ranked, bytes_at, kind, longest = shared.value
        id_of = {p: e[1] for p, e in ranked.items()}
        cuts = found["cuts"].combine_chunks()
        cuts = cuts.take(pac.sort_indices(found["word_bucket"])).flatten().to_numpy().tolist() if len(cuts) else []
        doc_ids, ids = [], []
        for plain, units, codes, rows in zip(packs["plain"].to_pylist(), *(packs[c].to_pylist() for c in ("units", "codes", "rows"))):
            units, rows, codes = _units_in(units), _open(rows), _numbers(codes)
            words, _ = _dealt(units, plain, buckets)
            if len(words) != len(cuts):
                raise ValueError(f"{len(cuts)} of a pack's {len(words)} words have ids")
            # ids of words, then of units that are no single word of the lattice
            flat, ends, names = array("i"), array("i", [0]), words.to_pylist()
            for w, c in zip(names, cuts):
                if c & (c - 2) == 1 and w in id_of:  # one piece
                    flat.append(id_of[w])
                else:
                    flat.extend(cut_ids(w, c, ranked, bytes_at))
                ends.append(len(flat))
            named = units[:plain]
            named = pa.concat_arrays([pac.binary_join_element_wise(SPACE, named, ""), units[plain:]])
            at = pac.fill_null(pac.index_in(named, value_set=words), -1).to_numpy().copy()
            rest = np.flatnonzero(at < 0)
            known = dict(zip(names, range(len(names)))) if len(rest) else {}
            for i, u in zip(rest.tolist(), units.take(pa.array(rest)).to_pylist()):
                for w in _part_words(u) if i < plain else [u]:
                    k = known.get(w)
                    flat.extend([bytes_at + 10] if w == "\n" else flat[ends[k] : ends[k + 1]] if k is not None else long_ids(w, ranked, bytes_at, kind, longest) if w else [])
                at[i] = len(ends) - 1
                ends.append(len(flat))
            counts = rows["count"].to_numpy()
            taken = pa.LargeListArray.from_arrays(pa.array(np.frombuffer(ends, np.int32), pa.int64()), pa.array(np.frombuffer(flat, np.int32) if flat else [], pa.int32())).take(pa.array(at.astype(np.int32)[codes]))
            bounds = taken.offsets.to_numpy()[np.concatenate([[0], np.cumsum(counts)])]
            ids.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), taken.values))
            doc_ids += rows["doc_id"].chunks
        return pa.table({"doc_id": pa.chunked_array(doc_ids, pa.int64()), "ids": pa.chunked_array(ids, pa.list_(pa.int32()))})

    return found.groupBy("pack").cogroup(packs.select("pack", "plain", "units", "codes", "rows").groupBy("pack")).applyInArrow(assemble, "doc_id long, ids array<int>")


def decode(df: DataFrame, pieces: Pieces, ids_col: str = "ids") -> DataFrame:
    """``df`` with ``decoded``: the text of the ids, without the dummy prefix. Null ids give null; a column of that name, in any case, is replaced."""
    df = df.drop("decoded")  # in any case
    at = df.columns.index(ids_col)
    from pyspark.sql.types import StringType, StructField, StructType

    names, normal, first = pieces.names, pieces.normal, pieces.bytes_at
    raw = [bytes([i - first]) if first <= i < first + 256 else names[i].replace(SPACE, " ").encode() if normal[i] else b"" for i in range(len(names))]
    shared = df.sparkSession.sparkContext.broadcast(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(shared.value, pa.large_binary())
        for batch in batches:
            sizes = np.cumsum(pac.fill_null(pac.list_value_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            start = 0
            while start < batch.num_rows:
                base = sizes[start - 1] if start else 0
                to = max(start + 1, int(np.searchsorted(sizes, base + IDS, "right")))
                part = batch.slice(start, to - start)
                lists = part.column(at)
                text = table.take(lists.flatten())
                ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset :][np.concatenate([[0], sizes[start:to] - base])]
                letters = np.frombuffer(text.buffers()[2] or b"", np.uint8)
                led = np.flatnonzero(np.diff(ends) > 0)
                led = led[letters[ends[led]] == 32]  # the dummy prefix
                letters = np.delete(letters[: ends[-1]], ends[led])
                ends[1:] -= np.cumsum(np.bincount(led, minlength=to - start))
                whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), to - start, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(letters.tobytes())])
                try:
                    texts = whole.cast(pa.large_string()).cast(pa.string())
                except pa.ArrowInvalid:
                    texts = pa.array([b.decode("utf-8", "replace") for b in whole.to_pylist()], pa.string())
                texts = pac.if_else(lists.is_null(), pa.scalar(None, pa.string()), texts)
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*batch.schema.names, "decoded"])
                start = to

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("decoded", StringType())]))


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Ids of every document, and the checksum of the text that they decode to."""
    import public_tokenizers

    pieces = Pieces.load(public_tokenizers.path("piece_bpe_32k.model"), "bpe")
    done = decode(encode(table(spark, sf_dir, "documents"), pieces), pieces)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))
