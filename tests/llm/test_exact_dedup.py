import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from tidemill.llm import exact_dedup
from tidemill.llm.common import Scratch


def test_fuse_filter_holds_all_and_few_others():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 10, 1000, 60_000):
        keys = rng.integers(0, 2**63, n, dtype=np.uint64)
        f = exact_dedup.BinaryFuse.build(keys)
        assert f.holds(keys).all()
        others = rng.integers(0, 2**63, 20_000, dtype=np.uint64)
        assert f.holds(others).mean() < 0.02


def test_screening_uses_the_snapshot(spark):
    docs = spark.createDataFrame([(i, f"text {i % 40}") for i in range(100)], "doc_id long, text string")
    prints = exact_dedup.fingerprints(docs)
    path = Scratch(spark, "t").path("snapshot")
    exact_dedup.Snapshot.build(prints.filter("doc_id < 30"), path)
    snap = exact_dedup.Snapshot.open(spark, path)
    got = {(r.keep_id, r.n) for r in snap.classes(prints.filter("doc_id >= 30")).collect()}
    assert got == {(i, 3 if i < 20 else 2) for i in range(40)}


def test_a_large_batch_on_a_small_snapshot_is_sliced(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BUCKET", 10)
    prints = exact_dedup.fingerprints(spark.createDataFrame([(i, f"text {i % 150}") for i in range(300)], "doc_id long, text string"))
    for first in (0, 5, 150):
        snap = exact_dedup.Snapshot.build(prints.filter(f"doc_id < {first}"), Scratch(spark, "t").path("snapshot"))
        got = {(r.keep_id, r.n) for r in snap.classes(prints.filter(f"doc_id >= {first}")).collect()}
        assert got == {(i, 2) for i in range(150)}


def test_collisions_of_texts_without_an_id(spark, monkeypatch):
    """Equal digests of different texts are told apart by bytes, with an id or without."""
    monkeypatch.setattr(exact_dedup, "WHITE", "[ab]+")  # the operator's own classes stay; two texts now normalise alike
    docs = spark.createDataFrame([(None, "xay"), (None, "xby"), (3, "x y"), (4, "z")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.group_size, r.kept) for r in exact_dedup.dedup(docs, exact_dedup.halves()).collect())
    assert got == [(0, 3, False), (0, 3, False), (3, 3, True), (4, 1, True)]


def test_edge_cases(spark):
    rows = [(5, None), (3, ""), (9, " a  b"), (2, " a\tb"), (7, "a b"), (7, "a b"), (None, "zz"), (8, "zz"), (None, "only"), (11, "x" * 3_000_000), (12, "x" * 3_000_000)]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, n int, keep_id string")
    got = sorted(map(str, exact_dedup.dedup(docs, exact_dedup.halves()).collect()))
    want = []
    key = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for i, t in rows:
        same = [j for j, u in rows if key(u) == key(t)]
        ids = [j for j in same if j is not None]
        keep = min(ids) if ids else None
        want.append((i, keep, len(same), i == keep, hashlib.sha256(key(t).encode()).hexdigest()))
    from pyspark.sql import Row

    make = Row("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == sorted(str(make(*w)) for w in want)
    assert exact_dedup.dedup(docs.limit(0), exact_dedup.halves()).collect() == []


def test_collisions_are_regrouped(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string")
    told = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, t string").select("doc_id", F.unhex(F.sha2("t", 256)).alias("digest"), F.lit(1).cast("long").alias("keep_id"), F.lit(3).cast("long").alias("group_size"))
    got = exact_dedup._regrouped(docs, told, told.select("digest").distinct(), "doc_id", "text").collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(1, 1, 2), (2, 1, 2), (3, 3, 1)}
