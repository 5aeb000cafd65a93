"""A sketch of fixed size that tells which 64-bit keys of a whole corpus may occur more than once.

A key falls on one of 2**SKETCH_BITS places by its high bits. A place is set if two keys or more fall there, so every key
that occurs twice is on a set place; with many times more keys than places nearly all are set and the sketch spares
nothing. Tasks send the places of their batches by slices, which are merged a fixed number at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, release
from .textvec import U

#: Fixed, so that the broadcast (32 MB) is.
SKETCH_BITS, SLICE_BITS = 28, 22
#: Sketches of a slice that are merged in one group.
FAN_IN = 32


def _packed(places: np.ndarray) -> bytes:
    return zlib.compress(np.diff(places, prepend=places.dtype.type(0)).astype(np.uint32).tobytes(), 1)


def _places(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(blob), np.uint32), dtype=np.uint32)


def _seen(batches: Iterator[pa.RecordBatch], keys_of: Callable[[pa.Array], Iterator[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """By slice, the places that a task's keys hit once and those they hit more often."""
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    held: list[np.ndarray] = []
    size = 0

    def rows() -> Iterator[pa.RecordBatch]:
        place, n = np.unique(np.concatenate(held) >> U(64 - SKETCH_BITS), return_counts=True)
        held.clear()
        cuts = np.searchsorted(place >> U(SLICE_BITS), np.arange(1 << (SKETCH_BITS - SLICE_BITS), dtype=U))
        for i, (at, many) in enumerate(zip(np.split(place, cuts[1:]), np.split(n > 1, cuts[1:]))):
            at = (at & U((1 << SLICE_BITS) - 1)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([task], pa.int64()), *(pa.array([_packed(x)], pa.binary()) for x in (at[~many], at[many]))], names=["slice", "part", "once", "more"])

    for batch in batches:
        for keys in keys_of(batch.column(0)):
            held.append(keys)
            size += len(keys)
            if size >= 4_000_000:
                yield from rows()
                size = 0
    if held:
        yield from rows()


def _hits(pdf: pd.DataFrame) -> np.ndarray:
    hits = np.zeros(1 << SLICE_BITS, np.uint8)
    for once, more in zip(pdf["once"], pdf["more"]):
        for blob, weight in ((once, 1), (more, 2)):
            at = _places(blob)
            hits[at] = np.minimum(hits[at] + weight, 2)
    return hits


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    hits = _hits(pdf)
    once, more = (_packed(np.flatnonzero(hits == w).astype(np.uint32)) for w in (1, 2))
    return pd.DataFrame({"slice": pdf["slice"].iloc[:1].to_numpy(), "part": pdf["part"].iloc[:1].to_numpy(), "once": [once], "more": [more]})


def _bits(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"slice": pdf["slice"].iloc[:1].to_numpy(), "bits": [zlib.compress(np.packbits(_hits(pdf) > 1, bitorder="little").tobytes(), 1)]})


class Sketch:
    """A bit for each place by slice, compressed: 512 KB a slice at most. They are unpacked where they are first asked for."""

    def __init__(self, slices: dict[int, bytes]):
        self.slices = slices
        self.bits: np.ndarray | None = None

    def held(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key may occur more than once."""
        if self.bits is None:
            bits = np.zeros((1 << (SKETCH_BITS - SLICE_BITS), 1 << (SLICE_BITS - 3)), np.uint8)
            for i, blob in self.slices.items():
                bits[i] = np.frombuffer(zlib.decompress(blob), np.uint8)
            self.bits = bits.reshape(-1)
        place = (keys >> U(64 - SKETCH_BITS)).astype(np.int64)
        return (self.bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def shared_places(values: DataFrame, keys_of: Callable[[pa.Array], Iterator[np.ndarray]]) -> Sketch:
    """The sketch of the keys that ``keys_of`` gives for batches of the one column of ``values``."""
    kinds = "slice int, part long, once binary, more binary"
    tasks = values.rdd.getNumPartitions()
    rows = values.mapInArrow(lean(lambda it: _seen(it, keys_of)), kinds)
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        rows = rows.withColumn("part", F.pmod("part", F.lit(tasks))).groupBy("slice", "part").applyInPandas(_merged, kinds)
    release(values.sparkSession)
    done = rows.groupBy("slice").applyInPandas(_bits, "slice int, bits binary").toArrow()  # 64 rows of a bounded size
    return Sketch(dict(zip(done["slice"].to_pylist(), done["bits"].to_pylist())))
