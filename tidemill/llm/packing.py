"""Packing of token sequences by lexical retrieval.

Every document is tokenised once. Its full windows are sequences of their own; what is left over (the tail) is packed
with tails that resemble it. Tails are dealt in shards of bounded size by the term that tells most about them, so that
any group of alike tails, however large, is spread over neighbouring shards. A shard holds a BM25 inverted index of its
tails alone, with document frequencies counted over the tails of all documents (not over their full windows); each seed, longest first, takes its best-scoring unused
neighbours that fit whole, then the first part of the next one. Tails may be cut on a grid of ``GRID`` tokens, where
running checksums are kept, so token ids themselves never leave the task that made them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean, table
from .textvec import slices

WINDOW, GRID = 1024, 16
#: Tails in one inverted index.
SHARD = 4096
K1, B = 1.2, 0.75
#: The id that ends a document.
END = np.zeros(1, np.uint32)


class Tokens:
    """Ids of the byte-level BPE in a tokenizers file, by a faster library with the same ranks where both surely agree.

    Texts with characters from U+2000 up, and any that the fast one cannot take, go to the file's own library.
    """

    def __init__(self, name: str):
        import base64

        import public_tokenizers
        import tiktoken

        self.name = name
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        # arrays come from a call that looks for special tokens: none is allowed, so the one that it needs to be fast is text
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|none|>": 1 << 24})

    @cached_property
    def exact(self):
        import public_tokenizers
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(public_tokenizers.path(f"{self.name}.json"))
        found.encode_special_tokens = True
        return found

    def ids(self, text: str, plain: bool) -> np.ndarray:
        if plain and len(text) < 1_000_000:
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except BaseException as e:  # noqa: BLE001  its regex engine may give up, and panics are no Exception
                if isinstance(e, (KeyboardInterrupt, SystemExit)):
                    raise
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


def _digest(ids: np.ndarray, window: int) -> tuple[list[int], int, bytes, bytes, bytes]:
    """Checksums of the full windows; of the tail its length, running checksums on the grid, terms and counts."""
    full = len(ids) // window
    raw = ids.astype("<u4").tobytes()
    sums = [zlib.crc32(raw[4 * window * i : 4 * window * (i + 1)]) for i in range(full)]
    tail, rest = ids[full * window :], raw[4 * window * full :]
    running, c = [], 0
    for at in range(0, len(rest), 4 * GRID):
        c = zlib.crc32(rest[at : at + 4 * GRID], c)
        running.append(c)
    terms, counts = np.unique(tail, return_counts=True)
    return sums, len(tail), np.array(running, np.uint32).tobytes(), terms.astype(np.uint32).tobytes(), counts.astype(np.uint16).tobytes()


def piece_crc(running: np.ndarray, start: int, end: int) -> int:
    """The checksum of tokens [start, end) of a tail, from its running checksums; start lies on the grid."""
    at_end = int(running[-(-end // GRID) - 1])
    if not start:
        return at_end
    zeros = bytes(4 * (end - start))
    return at_end ^ zlib.crc32(zeros, int(running[start // GRID - 1])) ^ zlib.crc32(zeros)


def _tokenise(batches: Iterator[pa.RecordBatch], name: str, window: int, vocabulary: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    tokens, df, number = Tokens(name), np.zeros(vocabulary, np.int64), TaskContext.get().partitionId() << 32
    names = ["doc_id", "doc_tokens", "first_sequence", "full", "tail", "running", "terms", "counts", "df"]
    for batch in batches:
        out: list[list] = [[] for _ in range(7)]
        for at, to, raw, offsets in slices(batch.column(1), 1 << 24):
            before = np.searchsorted(np.flatnonzero(raw >= 0xE2), offsets)
            plain = before[1:] == before[:-1]
            for i in range(to - at):
                text = raw[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8")
                ids = np.concatenate([tokens.ids(text, bool(plain[i])), END])
                sums, tail, running, terms, counts = _digest(ids, window)
                df[np.frombuffer(terms, np.uint32)] += 1
                for held, value in zip(out, (len(ids), number, sums, tail, running, terms, counts)):
                    held.append(value)
                number += len(sums)
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip(out, kinds)), pa.nulls(len(out[0]), pa.list_(pa.int64()))], names=names)
    none = [pa.nulls(1, k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary(), pa.binary())]
    seen = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([*none, pa.array([np.stack([seen, df[seen]], axis=1).ravel()], pa.list_(pa.int64()))], names=names)  # id, number, id, number, ...


class Index:
    """BM25 over the tails of one shard."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray], lengths: np.ndarray, idf: np.ndarray, mean: float):
        self.n = len(terms)
        sizes = np.array([len(t) for t in terms])
        self.begin = np.concatenate([[0], np.cumsum(sizes)])
        self.terms = np.concatenate(terms).astype(np.int64) if self.n else np.zeros(0, np.int64)
        tf = np.concatenate(counts).astype(np.float64) if self.n else np.zeros(0)
        owner = np.repeat(np.arange(self.n), sizes)
        self.weights = idf[self.terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[owner] / mean))
        order = np.argsort(self.terms, kind="stable")
        self.docs, self.values = owner[order], self.weights[order]
        self.vocab, first = np.unique(self.terms[order], return_index=True)
        self.starts = np.append(first, len(order))
        # scores by terms of every 16th tail and more are one product of matrices: much faster than scattering
        common = np.flatnonzero(16 * np.diff(self.starts) >= self.n)
        self.rare = np.ones(len(self.vocab), bool)
        self.rare[common] = False
        dense = np.zeros((len(common), self.n), np.float32)
        for i, p in enumerate(common):
            dense[i, self.docs[self.starts[p] : self.starts[p + 1]]] = self.values[self.starts[p] : self.starts[p + 1]]
        self.base = (dense > 0).astype(np.float32).T @ dense

    def scores(self, doc: int) -> np.ndarray:
        """Scores of all tails of the shard against the query that ``doc`` makes."""
        own = slice(self.begin[doc], self.begin[doc + 1])
        places = np.searchsorted(self.vocab, self.terms[own])
        total = self.base[doc]
        spans = [slice(self.starts[p], self.starts[p + 1]) for p in places[self.rare[places]]]
        if not spans:
            return total
        return total + np.bincount(np.concatenate([self.docs[s] for s in spans]), np.concatenate([self.values[s] for s in spans]), self.n)


def fill(index: Index, lengths: np.ndarray, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Windows of (tail, start, end); every token of every tail lies in exactly one."""
    start, left = np.zeros(len(lengths), np.int64), lengths.astype(np.int64).copy()
    by_size = np.argsort(-lengths, kind="stable")
    pending = list(by_size[::-1])
    while pending:
        seed = int(pending.pop())
        if not left[seed]:
            continue
        made = [(seed, int(start[seed]), int(start[seed] + left[seed]))]
        gap = window - int(left[seed])
        left[seed] = 0
        if gap >= GRID:
            score = index.scores(seed)
            open_ = np.flatnonzero(left > 0)
            open_ = open_[np.argsort(-score[open_], kind="stable")]
            while gap > 0 and len(open_):
                fits = left[open_] <= gap
                if fits.any():
                    at = int(fits.argmax())
                    take = int(left[open_[at]])
                elif gap >= GRID:
                    at, take = 0, gap // GRID * GRID
                else:
                    break
                doc = int(open_[at])
                made.append((doc, int(start[doc]), int(start[doc] + take)))
                start[doc] += take
                left[doc] -= take
                gap -= take
                if left[doc] == 0:
                    open_ = np.delete(open_, at)
                else:
                    pending.append(doc)
                    break
        yield made


def _pack(batches: Iterator[pa.RecordBatch], window: int, idf: np.ndarray, mean: float) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number = (1 << 62) | (TaskContext.get().partitionId() << 32)

    def shard(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        nonlocal number
        t = pa.Table.from_batches(rows)
        lengths = t["tail"].to_numpy()
        arrays = {c: [np.frombuffer(x, k) for x in t[c].to_pylist()] for c, k in (("terms", np.uint32), ("counts", np.uint16), ("running", np.uint32))}
        out: list[list[int]] = [[] for _ in range(6)]
        for made in fill(Index(arrays["terms"], arrays["counts"], lengths, idf, mean), lengths, window):
            offset = 0
            for doc, a, b in made:
                for held, value in zip(out, (doc, a, b - a, piece_crc(arrays["running"][doc], a, b), number, offset)):
                    held.append(value)
                offset += b - a
            number += 1
        at = pa.array(out[0], pa.int64())
        base = t["doc_tokens"].to_numpy() - lengths
        columns = [t["doc_id"].combine_chunks().take(at), pa.array(base[out[0]] + np.array(out[1], np.int64)), *(pa.array(v, pa.int64()) for v in out[2:4]), t["doc_tokens"].combine_chunks().take(at), *(pa.array(v, pa.int64()) for v in out[4:])]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, SHARD - sum(b.num_rows for b in held))
            batch = batch.slice(part.num_rows)
            held.append(part)
            if sum(b.num_rows for b in held) == SHARD:
                yield shard(held)
                held = []
    if held:
        yield shard(held)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k", window: int = WINDOW, vocabulary: int = 50_257, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of packed sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its token ids and then id 0; a null text is empty, so every row has at least one token. Rows that
    repeat a doc_id, or have none, are packed each for itself. Other columns are not read. An empty table packs to none.
    Ids are the tokenizer file's, which texts of less than 1,000,000 characters, all below U+2000, get from another
    library with the same ranks and pattern (see Tokens; tests hold both equal).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    stored = scratch.keep(
        docs.mapInArrow(
            lambda it: _tokenise(it, tokenizer, window, vocabulary),
            "doc_id long, doc_tokens long, first_sequence long, full array<long>, tail long, running binary, terms binary, counts binary, df array<long>",
        ),
        "tokens",
    )
    df = np.zeros(vocabulary)  # one number for each id of the vocabulary
    each = stored.filter("df is not null").select("df", F.explode(F.expr("if(size(df) = 0, array(), sequence(0, size(df) - 2, 2))")).alias("i")).select(F.expr("df[i]").alias("id"), F.expr("df[i + 1]").alias("n"))
    for r in each.groupBy("id").agg(F.sum("n").alias("n")).collect():
        df[r["id"]] = r["n"]
    tails = stored.filter("tail > 0")
    n, total = tails.agg(F.count("*"), F.coalesce(F.sum("tail"), F.lit(0))).first()
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    mean = max(1.0, total / max(n, 1))
    shared = spark.sparkContext.broadcast((idf, df))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Beside each tail, the shared term of the greatest weight."""
        idf, df = shared.value
        for batch in batches:
            keys = []
            for t, c in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                t, c = np.frombuffer(t, np.uint32), np.frombuffer(c, np.uint16)
                w = np.where(df[t] > 1, idf[t], 0) * c
                keys.append(int(t[w.argmax()]) if len(t) else -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], names=[*batch.schema.names, "key"])

    kinds = "doc_id long, doc_tokens long, tail long, running binary, terms binary, counts binary"
    dealt = tails.select("doc_id", "doc_tokens", "tail", "running", "terms", "counts").mapInArrow(lean(keyed), kinds + ", key long")
    tasks = max(1, min(-(-n // SHARD), max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // (16 * SHARD)))))  # of 16 shards at most
    dealt = dealt.repartitionByRange(tasks, "key", "doc_id").sortWithinPartitions("key", "doc_id", "tail", "terms")
    packed = dealt.drop("key").mapInArrow(lean(lambda it: _pack(it, window, *((shared.value[0], mean)))), PIECES)
    full = stored.filter(F.size("full") > 0).select("doc_id", "doc_tokens", "first_sequence", F.posexplode("full").alias("i", "crc"))
    full = full.select(
        "doc_id", (F.col("i") * window).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), "doc_tokens",
        (F.col("first_sequence") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    return packed.unionByName(full)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the pieces of the packed sequences, of every row, as ``pack`` has it."""
    return pack(docs)
