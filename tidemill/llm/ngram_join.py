"""N-gram Jaccard join by vertical partitioning.

A document is the set of its distinct word n-grams, in the global order of their 64-bit hashes. Cutting that order into
m fragments cuts every set alike. Two sets at the threshold differ in at most H members, a bound that follows from their
sizes, and each difference lies in one fragment; so with m > H fragments they are equal in at least m - H of them. The
plan is

1. collapse documents with equal sets,
2. cut each set into the fragments of its class of sizes (and of the next class, if a partner may be in it) and hash each
   fragment's members: sets at the threshold share such a hash, others hardly ever do. Empty fragments count only for
   sets that have m - H of them or more, since any other partner shares a fragment with members too,
   A set that shares fewer fragments with all others together than a partner would alone is dropped. Before they are
   shuffled, keys that the whole corpus holds once are left out as far as a sketch of fixed size can
   tell them; where there are many times more keys than it has bits it lets all pass, with the same result,
3. pair blocks of sets that share a fragment, cut the order into a few coarse fragments, count the overlaps of each pair
   of blocks in each as a small matrix, sum the matrices of a pair and compare with the threshold (see setlinks).

The classes are exact, up to equal 64-bit hashes: every pair of different sets is compared in at most one block pair,
links are neither capped nor listed, and no step depends on how often an n-gram occurs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean, only, release, table
from .setlinks import link, signature
from .sketch import Sketch, shared_places
from .textvec import U, mix, shingle_sets

#: Coarse fragments (a power of two) in which overlaps are counted.
COARSE_BITS = 2


@lru_cache
def size_classes(threshold_pct: int) -> np.ndarray:
    """First size of each class. Partners at the threshold are in the same class or in neighbouring ones."""
    step, out = (100 / threshold_pct) ** 3, [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * step)))
    return np.array(out)


def fragments(last: int, threshold_pct: int) -> tuple[int, int]:
    """For sets of ``last`` members at most: the fragments m, and how many of them partners have equal (m - H)."""
    most = (100 - threshold_pct) * 2 * last // (100 + threshold_pct)
    spare = max(6, most // 2)  # what partners share beyond one: it sets them off from sets with a common passage
    return most + 1 + spare, 1 + spare


def fragment_keys(s: np.ndarray, threshold_pct: int) -> list[tuple[int, np.ndarray]]:
    """For each scheme that a partner at the threshold may follow, how many of its keys such a partner shares at least,
    and the keys. s: sorted members."""
    first = size_classes(threshold_pct)
    n = len(s)
    own = int(np.searchsorted(first, n, "right")) - 1
    out = []
    for c in (own, own + 1) if 100 * n >= threshold_pct * int(first[own + 1]) else (own,):
        m, equal = fragments(int(first[c + 1]) - 1, threshold_pct)
        place = ((s >> U(32)) * U(m)) >> U(32)
        starts = np.flatnonzero(np.diff(place, prepend=~U(0)))
        filled = place[starts]
        keys = mix(np.add.reduceat(mix(s * U(0x2545F4914F6CDD1D)), starts) ^ mix(filled + U(c << 44)))
        void = m - len(filled)
        if void >= equal:
            keys = np.concatenate([keys, mix(np.setdiff1d(np.arange(m, dtype=U), filled) + U((c << 44) + (1 << 43)))])
        out.append((equal - void if void < equal else 1, keys))
    return out


def _profile(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[list] = [[], [], []]
        for s in shingle_sets(batch.column(1), k):
            for held, value in zip(rows, (len(s), *signature(s))):
                held.append(value)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, pa.int64()) for v in rows)], names=["doc_id", "n", "s1", "s2"])


def _keys_of(texts: pa.Array, k: int, threshold_pct: int) -> Iterator[np.ndarray]:
    for s in shingle_sets(texts, k):
        if len(s):
            for _, keys in fragment_keys(s, threshold_pct):
                yield keys


def _fragmented(batches: Iterator[pa.RecordBatch], k: int, threshold_pct: int, shared: Sketch) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[list] = [[] for _ in range(7)]
        for i, s in enumerate(shingle_sets(batch.column(1), k)):
            own = None
            for tag, (need, keys) in enumerate(fragment_keys(s, threshold_pct) if len(s) else []):
                keys = keys[shared.held(keys)]
                if len(keys) >= need:
                    own = own or (len(s), *signature(s))
                    for held, value in zip(rows, (i, *own, tag, need, keys.view(np.int64))):
                        held.append(value)
        columns = [batch.column(0).take(pa.array(rows[0], pa.int64())), *(pa.array(v, pa.int64()) for v in rows[1:4]), *(pa.array(v, pa.int32()) for v in rows[4:6]), pa.array(rows[6], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "s1", "s2", "tag", "need", "fragments"])


def _coarse(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Columns: a text, and the set that is looked for: n, s1, s2, uid, block, weight. Another text of the same document has another set."""
    cuts = np.arange(1, 1 << COARSE_BITS, dtype=U) << U(64 - COARSE_BITS)
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            rows: list[list] = [[], [], []]
            asked = zip(*(part.column(c).to_pylist() for c in (1, 2, 3)))
            for i, (s, want) in enumerate(zip(shingle_sets(part.column(0), k), asked)):
                if (len(s), *signature(s)) != want:
                    continue
                for f, piece in enumerate(np.split(s, np.searchsorted(s, cuts))):
                    for held, value in zip(rows, (i, f, piece.tobytes())):
                        held.append(value)
            where = pa.array(rows[0], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(c).take(where) for c in (4, 5, 6)] + [pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.binary())], names=["uid", "block", "weight", "fragment", "keys"])


def classes(docs: DataFrame, k: int = 5, threshold_pct: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, n_links (rows of other documents, or copies, that its text links
    with), component_id.

    ``docs`` needs an integer id and a text; other columns are not read, whatever their names. Null, empty and blank
    texts have an empty set, link with nothing and are their own component. Fewer than ``k`` words make one n-gram of
    the whole sequence. Rows may repeat a doc_id with any texts: each text links for itself, and the document is in one
    component with all that any of them links with. A null id is kept, with a null component unless its text has copies;
    links count such rows only where the texts are equal and one of them has an id. Two texts link when
    100 * |intersection| >= threshold_pct * |union|.
    """
    scratch = Scratch(docs.sparkSession, "ngram-join")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sets = scratch.keep(docs.mapInArrow(lean(lambda it: _profile(it, k)), "doc_id long, n long, s1 long, s2 long"), "sets")
    alike = ["n", "s1", "s2"]
    # each distinct set by a number of its own, which is written down once; ``first``: a document that has it
    distinct = sets.filter("n > 0 and doc_id is not null").groupBy(*alike).agg(F.min("doc_id").alias("first"), F.count("*").alias("weight"))
    distinct = scratch.keep(distinct.withColumn("uid", F.monotonically_increasing_id()), "distinct")

    def held_of(reps: DataFrame) -> DataFrame:
        some = docs.filter("doc_id is not null")
        shared = docs.sparkSession.sparkContext.broadcast(shared_places(some.select("text"), partial(_keys_of, k=k, threshold_pct=threshold_pct)))
        release(docs.sparkSession)
        cut = some.mapInArrow(lean(lambda it: _fragmented(it, k, threshold_pct, shared.value)), "doc_id long, n long, s1 long, s2 long, tag int, need int, fragments array<long>")
        # one document stands for all that have its set: copies are spread by their ids and end here
        one = distinct.select(F.col("first").alias("doc_id"), *alike, "uid")
        return cut.join(one, ["doc_id", *alike]).dropDuplicates(["doc_id", *alike, "tag"]).select(F.explode("fragments").alias("bucket"), "uid", "tag", "need")

    def cut_of(home: DataFrame) -> DataFrame:
        wanted = home.select("uid", "block", "weight").join(distinct.select("uid", F.col("first").alias("doc_id"), *alike), "uid")
        texts = docs.join(wanted.hint("shuffle_hash"), "doc_id").select("text", *alike, "uid", "block", "weight")
        return texts.mapInArrow(lean(lambda it: _coarse(it, k)), "uid long, block long, weight long, fragment int, keys binary")

    # documents with several sets hold these together
    several = sets.filter("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*alike)).alias("a"), F.max(F.struct(*alike)).alias("b")).filter("a <> b").select("doc_id")
    numbers = sets.filter("n > 0").join(several, "doc_id").join(distinct.select(*alike, "uid"), alike).select("doc_id", "uid").distinct()
    joined = numbers.join(numbers.groupBy("doc_id").agg(F.min("uid").alias("a")), "doc_id").select("a", F.col("uid").alias("b"))
    found = link(sets, held_of, cut_of, threshold_pct, scratch, reps=distinct.select("uid", *alike, "weight"), joined=joined)
    found = scratch.keep(found, "found")
    firsts = found.join(distinct.select(*alike, "first"), alike).groupBy("component").agg(F.min("first").alias("component_id"))
    found = found.join(firsts, "component").select(*alike, "links", "component_id")
    return sets.join(found, alike, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op9_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Classes of ``documents`` over 3-word shingles at a similarity of 0.9."""
    return classes(table(spark, sf_dir, "documents"), k=3, threshold_pct=90)


#: All pairs that share a shingle, counted; components by following links as far as they go.
OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS s FROM w),
n AS (SELECT doc_id, s, row_number() OVER (ORDER BY doc_id) AS r FROM g),
x AS (SELECT r, len(s) AS size, unnest(s) AS gram FROM n),
p AS (SELECT a.r AS a, b.r AS b FROM x a JOIN x b ON a.gram = b.gram AND a.r < b.r AND 100 * least(a.size, b.size) >= 90 * greatest(a.size, b.size)
  GROUP BY ALL HAVING 100 * count(*) >= 90 * (any_value(a.size) + any_value(b.size) - count(*))),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p UNION SELECT y.r, z.r FROM n y JOIN n z ON y.doc_id = z.doc_id AND len(y.s) > 0 AND len(z.s) > 0),
walk(a, b) AS (SELECT r, r FROM n UNION SELECT walk.a, e.b FROM walk JOIN e ON walk.b = e.a),
c AS (SELECT walk.a AS r, min(doc_id) AS component_id FROM walk JOIN n ON walk.b = n.r GROUP BY walk.a),
l AS (SELECT a AS r, count(*) AS links FROM (SELECT a, b FROM p UNION SELECT b, a FROM p) GROUP BY a)
SELECT n.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, CAST(coalesce(links, 0) AS BIGINT) AS n_links, component_id FROM n JOIN c ON n.r = c.r LEFT JOIN l ON n.r = l.r
"""


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class over 5-word shingles at 0.8 the smallest doc_id stays. Rows without an id stay; rows
    that repeat an id stay or go together; all columns stay, whatever their names."""
    return only(docs, classes(docs).filter("doc_id = component_id").select("doc_id").distinct())
