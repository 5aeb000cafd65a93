import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import ngram_join
from tidemill.llm.textvec import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def grams(text, k):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, pct):
    sets = [(i, grams(t, k)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    links = {i: 0 for i, _ in sets}
    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1 :]:
            if a and b and 100 * len(a & b) >= pct * len(a | b):
                links[i] += 1
                links[j] += 1
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: (len(s), links[i], find(i)) for i, s in sets}


@given(st.integers(1, 400), st.sampled_from([80, 90]), st.integers(0, 2**32))
@settings(max_examples=150, deadline=None)
def test_sets_at_the_threshold_share_a_fragment(n, pct, seed):
    rng = np.random.default_rng(seed)
    pool = np.unique(rng.integers(0, 2**64, 2 * n + 10, dtype=np.uint64))
    rng.shuffle(pool)
    a = set(pool[:n].tolist())
    b, rest = list(a), pool[n:].tolist()
    while True:  # as far as the threshold allows: members go, come or are exchanged
        b2 = list(b)
        move = rng.integers(3)
        if move != 1 and len(b2) > 1:
            b2.pop(int(rng.integers(len(b2))))
        if move != 0:
            b2.append(rest.pop())
        if 100 * len(a & set(b2)) < pct * len(a | set(b2)) or not rest:
            break
        b = b2
    x, y = (ngram_join.fragment_keys(np.array(sorted(v), np.uint64), pct) for v in (a, b))
    assert any(len(np.intersect1d(p, q)) >= max(i, j) for i, p in x for j, q in y)


def got(df):
    return {r.doc_id: (r.n_shingles, r.n_links, r.component_id) for r in df.collect()}


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(ngram_join.classes(docs, 3, 90)) == brute(rows, 3, 90)


def test_near_group_larger_than_a_block(spark):
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        w[i % 120] = f"x{i}"
        if i % 3 == 0:
            w[(i * 7) % 120] = f"y{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, f"lonely text number {i} of its own kind") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(ngram_join.classes(docs, 3, 90)) == brute(rows, 3, 90)


def test_ids_with_several_texts(spark):
    """Each text of a document links; the document is one node of the components."""
    t, u, v = ([f"{c}{i}" for i in range(41)] for c in "tuv")
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(1, " ".join(t)), (1, " ".join(u)), (2, near(t)), (3, near(u)), (9, " ".join(v)), (5, near(v)), (5, " ".join(u)), (7, "alone " * 9), (7, ""), (8, near(t)), (8, near(t)), (8, " ".join(v))]
    rows += [(20 + i, f"no one else says this number {i} at all") for i in range(5)]
    sets = [(i, grams(x, 3)) for i, x in rows]
    alike = [[a is not b and bool(a[1]) and bool(b[1]) and 100 * len(a[1] & b[1]) >= 90 * len(a[1] | b[1]) for b in sets] for a in sets]
    reach = {i: {i} for i, _ in sets}
    while True:
        more = {i: set().union(*(reach[j] | {sets[y][0]} for x, (k, a) in enumerate(sets) if k == i and a for y, (j, b) in enumerate(sets) if alike[x][y]), reach[i]) for i in reach}
        if more == reach:
            break
        reach = more
    want = sorted((i, len(s), sum(alike[x]), min(reach[i]) if s else i) for x, (i, s) in enumerate(sets))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, ngram_join.classes(docs, 3, 90).collect())) == want
    assert {r[3] for r in want if r[0] in (1, 2, 3, 5, 8, 9)} == {1}


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (6, "one two three"), (7, "a b c " * 50_000), (8, "a b c " * 50_000), (9, "ä ö ü"), (10, "Ä ö ü")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, n_shingles string, gram long")
    assert got(ngram_join.classes(docs, 3, 90)) == brute(rows, 3, 90)
    assert ngram_join.classes(docs.limit(0), 3, 90).collect() == []


@given(st.lists(st.text(alphabet="aAbé \t\n\x0b", max_size=30), max_size=12))
@settings(max_examples=60, deadline=None)
def test_shingle_counts(texts):
    assert [len(s) for s in shingle_sets(pa.array(texts, pa.string()), 3)] == [len(grams(t, 3)) for t in texts]
