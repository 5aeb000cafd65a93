import random
import re

import numpy as np

from tidemill.llm import substring_dedup as sd
from tidemill.llm.textvec import shingles, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_planted_passages_are_cut_and_clean_texts_are_not(spark):
    rng = random.Random(1)
    passages = [prose(rng, n) for n in (51, 55, 70, 120, 300)]
    rows, planted = [], set()
    for i in range(120):
        head, tail = prose(rng, rng.randint(0, 60)), prose(rng, rng.randint(0, 60))
        if i % 3 == 0:
            p = passages[(i // 3) % 5]
            planted.add(i)
            rows.append((i, f"{head}{rng.choice([' ', chr(10)])}{p}{rng.choice([' ', chr(10)])}{tail}"))
        else:
            rows.append((i, f"{head}\n{prose(rng, 80)}\n{tail} common words that many texts share but no passage"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sd.spans(docs).collect()
    assert {r.doc_id for r in got} == planted
    assert {r.doc_id for r in got if not r.removed} == {0, 3, 6, 9, 12}
    text = dict(rows)
    after = {r.doc_id: r.text for r in sd.clean(docs).collect()}
    assert len(after) == len(rows)
    for i, t in after.items():
        if i not in planted or i in (0, 3, 6, 9, 12):
            assert t == text[i]
        else:
            p = passages[(i // 3) % 5]
            assert p not in t and len(WORD.findall(t)) <= len(WORD.findall(text[i])) - 32


def brute_lines(rows, least):
    """Documents with a line that is near a line of another one, over all pairs of lines."""
    lines = [(i, m) for i, t in rows for m in t.split("\n") if len(WORD.findall(m)) >= least]
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for _, m in lines for w in [WORD.findall(m.lower())]]
    root = list(range(len(lines)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(lines)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    out = {}
    for a, (i, _) in enumerate(lines):
        out.setdefault(find(a), set()).add(i)
    return {i for ids in out.values() if len(ids) > 1 for i in ids}


def test_near_lines_against_all_pairs(spark):
    rng = random.Random(5)
    rows = []
    for g in range(25):
        base = prose(rng, 100).split()
        for c in range(rng.randint(1, 5)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(100)] = prose(rng, 1)
            rows.append((g * 10 + c, "title\n" + " ".join(w) + "\nend"))
    got = {r.doc_id for r in sd.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_lines(rows, 51)
    exact = {i for i, t in rows for j, u in rows if i != j and set(stretches(t)) & set(stretches(u))}
    assert got <= want | exact and len(got & want) >= 0.98 * len(want)


def stretches(text):
    w = WORD.findall(text)
    return [tuple(w[j : j + sd.WINDOW]) for j in range(len(w) - sd.WINDOW + 1)]


def test_short_paragraphs_against_all_pairs(spark):
    rng = random.Random(9)
    rows = []
    for g in range(60):
        base = prose(rng, rng.randint(5, 50)).split()
        for c in range(rng.randint(1, 4)):
            w = list(base)
            if len(w) > 30 and rng.random() < 0.5:
                w[rng.choice([0, -1])] = prose(rng, 1)
            rows.append((g * 10 + c, prose(rng, rng.randint(1, 30)) + "\n" + " ".join(w) + "\n" + prose(rng, 4)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in sd.spans(docs, least=5).collect()}
    want = brute_lines(rows, 5)
    assert got <= want and len(got) >= 0.95 * len(want)
    assert {r.doc_id for r in sd.spans(docs).collect()} <= {i for i, t in rows if stretches(t)}  # by default only long passages


def test_near_copies_over_short_lines(spark):
    """A passage of many short lines, edited here and there, is no line of any length and has no equal stretch of 51 words."""
    rng = random.Random(11)
    rows, near = [], set()
    for g in range(12):
        lines = [prose(rng, 12).split() for _ in range(60)]
        for c in range(2):
            own = [list(x) for x in lines]
            if c:
                for j in range(3, 60, 4):
                    own[j][rng.randrange(12)] = prose(rng, 1)
            rows.append((2 * g + c, "\n".join(" ".join(x) for x in own)))
    rows += [(100 + i, "\n".join(prose(rng, 12) for _ in range(60))) for i in range(12)]
    words_gone = {i: 0 for i, _ in rows}
    text = dict(rows)
    for r in sd.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        if r.removed:
            words_gone[r.doc_id] += len(text[r.doc_id].encode()[r.start : r.end].decode().split())
    assert all(n == 0 for i, n in words_gone.items() if i % 2 == 0 or i >= 100)
    assert sum(words_gone[2 * g + 1] for g in range(12)) >= 0.6 * 12 * 720


def test_every_long_equal_stretch_shares_a_window():
    rng = random.Random(3)
    for _ in range(40):
        p = prose(rng, 51)
        a, b = (f"{prose(rng, rng.randint(1, 40))} {p} {prose(rng, rng.randint(1, 40))}" for _ in "ab")
        raw = np.frombuffer((a + b).encode(), np.uint8)
        h, _, _, before = words(raw, np.array([0, len(a), len(a) + len(b)]))
        row, first = sd.windows(shingles(h, 5), before)
        key = sd._Sequences(h).of(first, first + sd.WINDOW)[0]
        assert set(key[row == 0]) & set(key[row == 1])
        assert (first + sd.WINDOW <= before[row + 1]).all()


def test_sequence_hashes():
    rng = random.Random(4)
    w = [rng.choice("ab") for _ in range(300)]
    h, _, _, _ = words(np.frombuffer(" ".join(w).encode(), np.uint8), np.array([0, 599]))
    seq, seen = sd._Sequences(h), {}
    for _ in range(3000):
        a = rng.randrange(299)
        b = rng.randint(a + 1, min(300, a + 12))
        key = tuple(int(x[0]) for x in seq.of(np.array([a]), np.array([b])))
        assert seen.setdefault(key, w[a:b]) == w[a:b]
    assert len(seen) == len({tuple(x) for x in seen.values()})


def test_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, "short"), (4, long), (4, long), (5, "é " + long), (None, long), (6, "en " * 100_000), (7, "en " * 200), (8, long + "\n" + long)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, start int, n_chars string")
    got = sd.spans(docs).collect()
    assert {r.doc_id for r in got if r.removed} == {5, 7, 8}
    assert {r.component_id for r in got} == {4, 6}
    after = [(r.doc_id, r.text) for r in sd.clean(docs).collect()]
    assert len(after) == len(rows) and (None, long) in after and (1, None) in after
    assert dict(x for x in after if x[0] == 8)[8].strip() == ""
    assert sd.spans(docs.limit(0)).collect() == [] and sd.clean(docs.limit(0)).collect() == []


def test_passages_go_from_their_first_word_to_their_last(spark):
    rng = random.Random(7)
    passages = [" ".join(f"p{k}w{j}" for j in range(n)) for k, n in enumerate((51, 55, 70, 100, 300))]
    rows, want = [], {}
    for i in range(60):
        head, tail = (" ".join(f"{side}{i}w{j}" for j in range(rng.randint(25, 60))) for side in "ht")
        p = passages[i % 5]
        rows.append((i, f"{head} {p} {tail}"))
        want[i] = (len(head) + 1, len(head) + 1 + len(p), i % 5, i >= 5)
    got = sd.spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == 60 and {r.doc_id: (r.start, r.end, r.component_id, r.removed) for r in got} == want


def test_a_longer_passage_of_two_documents_around_one_of_three(spark):
    core = " ".join(f"c{j}" for j in range(60))
    more = [" ".join(f"{side}{j}" for j in range(12)) for side in "lr"]
    own = [" ".join(f"{side}{i}w{j}" for j in range(40)) for i in range(3) for side in "ab"]
    texts = [f"{own[0]} {core} {own[1]}", *(f"{own[2 * i]} {more[0]} {core} {more[1]} {own[2 * i + 1]}" for i in (1, 2))]
    got = {(r.doc_id, r.removed): texts[r.doc_id][r.start : r.end] for r in sd.spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {(0, False): core, (1, True): core, (2, True): f"{more[0]} {core} {more[1]}"}


def test_repeated_ids_and_clashing_columns(spark):
    """Texts of one id are cut each by its own places; no column name gets in the way."""
    p, q = (" ".join(f"{x}{j}" for j in range(60)) for x in "pq")
    own = [prose(random.Random(i), 30) for i in range(6)]
    rows = [(1, f"{own[0]} {p} {own[1]}"), (1, f"{q} {own[2]}"), (2, f"{own[3]} {p} {own[4]}"), (2, f"{own[5]}\n{q}"), (2, f"{own[3]} {p} {own[4]}"), (3, None), (None, p)]
    docs = spark.createDataFrame([(*r, 7, "x", "y", "z") for r in rows], "doc_id long, text string, _id int, _cuts string, rid string, cuts string").withColumnRenamed("rid", "doc")
    out = sd.clean(docs)
    assert out.columns == docs.columns
    got = sorted((r.doc_id or 0, (r.text or "").split(), r._id, r.cuts) for r in out.collect())
    want = [(0, p), (1, rows[0][1]), (1, rows[1][1]), (2, own[5]), (2, f"{own[3]} {own[4]}"), (2, f"{own[3]} {own[4]}"), (3, "")]
    assert got == sorted((i, t.split(), 7, "z") for i, t in want)
    odd = docs.withColumnsRenamed({"doc": "doc_id_", "cuts": "a`b.c", "_id": "start"})
    assert sd.clean(odd).columns == odd.columns and sd.clean(odd).count() == len(rows)
