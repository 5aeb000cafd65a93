"""Links between sets, counted in blocks.

Both near-duplicate operators end alike: sets stand in buckets that every pair at the threshold shares (or shares with a
stated probability), and all pairs of a bucket have to be compared without a row for each. Here equal sets are collapsed,
sets that hang together get blocks of bounded size, blocks that share a
bucket are paired, and each pair of blocks counts its overlaps as small matrices, one for each fragment of the members'
order, which are summed. A pair of sets is compared in at most one pair of blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, components, lean, release
from .textvec import U, mix

#: Sets in a block, on average at most.
BLOCK = 384
#: Rounds in which sets take over the largest bucket of those they share a bucket with.
STEPS = 2
#: Members from which a set counts as several in sizing blocks.
LONG = 4_096


def _encoded(ids: list[int], weight: list[int], keys: list[bytes]) -> bytes:
    """One fragment of a block: its sets in order of their ids, the distinct members, and at which of them each set's are.
    Places are kept as gaps, so that sets that are nearly alike take little."""
    first = {x: i for i, x in enumerate(ids)}  # a part that was computed twice counts once
    order = [first[x] for x in sorted(first)]
    held = [np.frombuffer(keys[i], U) for i in order]
    members, place = np.unique(np.concatenate(held), return_inverse=True)
    sizes = np.array([len(x) for x in held], np.int64)
    gaps = np.diff(place, prepend=0).astype(np.int32)
    head = np.array([len(order), len(members), *(v[i] for v in (ids, weight) for i in order)], np.int64)
    return zlib.compress(b"".join([head.tobytes(), sizes.tobytes(), members.tobytes(), gaps.tobytes()]), 1)


class _Block:
    def __init__(self, blob: bytes):
        raw = zlib.decompress(blob)
        count, distinct = np.frombuffer(raw, np.int64, 2)
        self.ids, self.weight, self.sizes = np.frombuffer(raw, np.int64, 3 * count, 16).reshape(3, count)
        at = 16 + 24 * int(count)
        self.members = np.frombuffer(raw, U, distinct, at)
        self.place = np.cumsum(np.frombuffer(raw, np.int32, -1, at + 8 * int(distinct)), dtype=np.int64)
        self.owner = np.repeat(np.arange(count), self.sizes)

    def dense(self, chosen: np.ndarray) -> Iterator[np.ndarray]:
        """Sets by members, for some of the members (places in rising order) a few thousand at a time."""
        rank = np.full(len(self.members), -1, np.int64)
        rank[chosen] = np.arange(len(chosen))
        at = rank[self.place]
        owner, at = self.owner[at >= 0], at[at >= 0]
        order = np.argsort(at, kind="stable")
        owner, at = owner[order], at[order]
        for base in range(0, len(chosen), 8192):
            lo, hi = np.searchsorted(at, [base, base + 8192])
            out = np.zeros((len(self.ids), min(8192, len(chosen) - base)), np.float32)
            out[owner[lo:hi], at[lo:hi] - base] = 1
            yield out


def _overlaps(a: _Block, b: _Block | None) -> np.ndarray:
    """How many members each set of one block shares with each of another (or of the same) in one fragment."""
    if b is None:
        shared = np.flatnonzero(np.bincount(a.place, minlength=len(a.members)) > 1)
        out = np.zeros((len(a.ids), len(a.ids)), np.int32)
        for x in a.dense(shared):
            out += np.rint(x @ x.T).astype(np.int32)
        return out
    _, left, right = np.intersect1d(a.members, b.members, assume_unique=True, return_indices=True)
    out = np.zeros((len(a.ids), len(b.ids)), np.int32)
    for x, y in zip(a.dense(left), b.dense(right)):
        out += np.rint(x @ y.T).astype(np.int32)
    return out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            sets = batch.column(1)[i].as_py()
            blobs = [_encoded(*([x[c] for x in part] for c in ("uid", "weight", "keys"))) for f in sorted({x["fragment"] for x in sets}) for part in [[x for x in sets if x["fragment"] == f]]]
            size = len({x["uid"] for x in sets})
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([size], pa.int32()), pa.array([blobs], pa.list_(pa.binary()))], names=["block", "size", "fragments"])


def _linked(batches: Iterator[pa.RecordBatch], threshold_pct: int) -> Iterator[pa.RecordBatch]:
    """Columns: the fragments of block a, and those of block b (none: a with itself). Overlaps are counted fragment by
    fragment and summed."""
    for batch in batches:
        for i in range(batch.num_rows):
            left, right = (batch.column(c)[i].as_py() for c in (0, 1))
            yield _compared(left, right, threshold_pct)


def _compared(left: list[bytes], right: list[bytes] | None, threshold_pct: int) -> pa.RecordBatch:
    inter, n_a, n_b = 0, 0, 0
    for f, blob in enumerate(left):
        a, b = _Block(blob), _Block(right[f]) if right else None
        inter, n_a, n_b = inter + _overlaps(a, b), n_a + a.sizes, n_b + (b or a).sizes
    same = b is None
    b = b or a
    link = (100 * inter >= threshold_pct * (n_a[:, None] + n_b[None, :] - inter)) & (inter > 0)
    if same:
        np.fill_diagonal(link, False)
        ids, links, full = a.ids, link @ a.weight, link | np.eye(len(a.ids), dtype=bool)
    else:
        ids, links = np.concatenate([a.ids, b.ids]), np.concatenate([link @ b.weight, link.T @ a.weight])
        full = np.block([[np.eye(len(a.ids), dtype=bool), link], [link.T, np.eye(len(b.ids), dtype=bool)]])
    root = ids.copy()
    while True:  # smallest id of the neighbourhood until nothing changes: a block is small
        low = np.where(full, root[None, :], np.iinfo(np.int64).max).min(axis=1)
        if (low == root).all():
            break
        root = low
    keep = links > 0
    return pa.RecordBatch.from_arrays([pa.array(x[keep], pa.int64()) for x in (ids, root, links)], names=["uid", "root", "links"])


def link(
    sets: DataFrame, held_of: Callable[[DataFrame], DataFrame], cut_of: Callable[[DataFrame], DataFrame], threshold_pct: int, scratch: Scratch, counted: bool = True, reps: DataFrame | None = None, joined: DataFrame | None = None
) -> DataFrame:
    """Classes of sets: (n, s1, s2, component, links), a row for each distinct set with members.

    ``sets``: uid, n (members), s1, s2 (a 128-bit signature of the members); or ``reps``, a stored table that has each distinct
    set once, with weight, the number of its copies. ``joined`` (a, b): sets that belong together without being alike.
    ``held_of`` takes the representatives (uid,
    n, weight) and returns their buckets (bucket, uid, tag, need), each once: partners share at least ``need`` buckets of
    one tag, so sets that share fewer with all others together have no partner there. With ``counted`` false one shared
    bucket is enough, there are no columns tag and need, and n need not be the exact number of members. ``cut_of`` takes
    (uid, block, n, weight) and returns uid, block, weight, fragment and keys (binary, sorted 64-bit members in that
    fragment). links counts sets with copies.
    """
    if reps is None:
        reps = scratch.keep(sets.filter("n > 0 and uid is not null").groupBy("n", "s1", "s2").agg(F.min("uid").alias("uid"), F.count("*").alias("weight")), "reps")
    held = scratch.hold(held_of(reps.select("uid", "n", "weight")))
    common = held.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1")
    near = held.join(common, "bucket")
    if counted:
        # Partners share need buckets at least. So a set with fewer shared ones has none; and, in order of size, what is
        # left of each one's without the largest need - 1 has a bucket in common: sets with a common passage no longer
        # meet in its large buckets.
        own = Window.partitionBy("uid", "tag")
        near = near.withColumn("has", F.count("*").over(own)).withColumn("at", F.row_number().over(own.orderBy("m", "bucket"))).filter("has >= need and at <= has - need + 1")
        near = near.select("bucket", "uid").distinct()
    near = scratch.keep(near.select("bucket", "uid"), "near")
    held.unpersist()
    del held, common
    release(sets.sparkSession)
    again = near.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1")
    near = scratch.keep(near.join(again, "bucket"), "shared")
    scratch.drop("near")
    del again
    release(sets.sparkSession)
    # sets of one dense group get one label: the largest bucket within a few steps, so that the group fills few blocks
    label = near.groupBy("uid").agg(F.max(F.struct("m", "bucket")).alias("label"))
    for _ in range(STEPS):
        over = near.join(label, "uid").groupBy("bucket").agg(F.max("label").alias("label"))
        label = near.join(over, "bucket").groupBy("uid").agg(F.max("label").alias("label"))
    label = scratch.hold(label)
    scale = F.greatest(F.lit(0), F.floor(F.log2(F.col("n") / LONG))).cast("int")
    named = label.join(reps.select("uid", "n", "weight"), "uid").select("uid", "n", "weight", F.col("label.bucket").alias("label"), scale.alias("scale"))
    total = named.groupBy("label", "scale").agg(F.count("*").alias("size"))
    chunk = F.pmod(F.xxhash64("uid"), F.ceil(F.col("size") * F.pow(F.lit(2), F.col("scale")) / BLOCK))
    home = named.join(total, ["label", "scale"]).select("uid", "n", "weight", F.xxhash64("label", "scale", chunk).alias("block"))
    home = scratch.keep(home, "home")
    spans = home.groupBy("block").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("size"))
    fits = (F.col("high_b") * 100 >= F.col("low_a") * threshold_pct) & (F.col("high_a") * 100 >= F.col("low_b") * threshold_pct) if counted else F.lit(True)
    placed = near.select("bucket", "uid").join(home.select("uid", "block"), "uid").select("bucket", "block").distinct().join(spans, "block")
    left, right = (placed.select("bucket", *(F.col(c).alias(f"{c}_{s}") for c in ("block", "low", "high"))) for s in "ab")
    pairs = left.join(right, "bucket").filter((F.col("block_a") < F.col("block_b")) & fits).select(F.col("block_a").alias("a"), F.col("block_b").alias("b")).distinct()
    pairs = scratch.keep(pairs, "pairs")
    label.unpersist()
    del label, placed, left, right
    release(sets.sparkSession)
    grouped = cut_of(home).groupBy("block").agg(F.collect_list(F.struct("uid", "weight", "fragment", "keys")).alias("sets"))  # bounded: a block
    packed = scratch.keep(grouped.mapInArrow(lean(_pack), "block long, size int, fragments array<binary>"), "packed")
    scratch.drop("shared")
    scratch.drop("home")
    release(sets.sparkSession)  # the texts' shuffle too
    alone = packed.filter("size > 1").select(F.col("fragments").alias("left"), F.lit(None).cast("array<binary>").alias("right"))
    left, right = (packed.select(F.col("block").alias(s), F.col("fragments").alias(side)) for s, side in (("a", "left"), ("b", "right")))
    apart = pairs.join(left, "a").join(right, "b").select("left", "right")
    linked = alone.unionByName(apart).mapInArrow(lean(lambda it: _linked(it, threshold_pct)), "uid long, root long, links long")
    linked = scratch.keep(linked, "linked")
    scratch.drop("packed")
    release(sets.sparkSession)
    links = linked.groupBy("uid").agg(F.sum("links").alias("links"))
    edges = linked.select(F.col("uid").alias("a"), F.col("root").alias("b"))
    comp = components(edges if joined is None else edges.unionByName(joined), scratch)
    found = reps.join(links, "uid", "left").join(comp.select(F.col("node").alias("uid"), "component"), "uid", "left")
    return found.select("n", "s1", "s2", F.coalesce("component", "uid").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))


def signature(s: np.ndarray) -> tuple[int, int]:
    """Two sums over the members' hashes, whatever their order."""
    if not len(s):
        return 0, 0
    return tuple(int(mix(s * U(0x2545F4914F6CDD1D) + U(c)).sum(dtype=U).view(np.int64)) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F))
