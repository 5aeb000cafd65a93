import random
import re
from collections import Counter
from itertools import permutations

import pytest

from tidemill.llm import filter_audit

DOCS = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int, toxic int"


def brute(docs, labels):
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    seen = []
    for d, t, p in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > least[t],
        }
        good = any(x == d and q == 1 for x, q, _ in labels if d is not None)
        toxic = any(x == d and y == 1 for x, _, y in labels if d is not None)
        seen.append((p or "", fails, good, toxic))
    rows = []
    for part in {s[0] for s in seen}:
        mine = [s for s in seen if s[0] == part]
        removed = Counter()
        found = []
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [s for s in left if s[1][f]]
                left = [s for s in left if not s[1][f]]
                removed[f] += len(gone)
                failing = [s for s in mine if s[1][f]]
                alone = [s for s in failing if sum(s[1].values()) == 1]
                found.append((part, "".join(order), step, len(left), len(gone), len(failing) - len(gone), len(alone), sum(s[2] for s in gone), sum(s[3] for s in gone)))
        rows += [(*r, removed[r[1][r[2] - 1]]) for r in found]
    return sorted(rows)


def run(spark, docs, labels):
    got = filter_audit.audit(filter_audit.cells(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)))
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_against_every_order(spark, seed):
    r = random.Random(seed)
    texts = []
    for _ in range(25):
        words = [r.choice("abcdefgh") * r.randint(1, 3) + str(r.randint(0, r.choice([20, 2000]))) for _ in range(r.choice([5, 99, 100, 150]))]
        text = r.choice([" ", "\t", "  \n"]).join(words)
        texts.append(text.upper() if r.random() < 0.3 else text + r.choice(["", " #", "é x"]))
    docs = [(r.randint(0, 60), r.choice(texts), r.choice(["en", "de", None])) for _ in range(80)]
    docs += [(7, None, "en"), (8, "", None), (None, texts[0], "en"), (None, texts[1], "en"), (3, texts[0], "de"), (3, texts[0], "de"), (900, "A " * 40_000, "fr")]
    labels = [(r.choice([*range(60), None]), r.choice([0, 1, None]), r.choice([0, 1])) for _ in range(50)]
    assert run(spark, docs, labels) == brute(docs, labels)


def test_empty_tables_and_other_columns(spark):
    assert run(spark, [], []) == []
    rows = run(spark, [(1, "x", "en")], [])
    assert len(rows) == 600 and {r[3] for r in rows if r[2] == 5} == {0}
    docs = spark.createDataFrame([(1, "x", "en", 5, 6)], "doc_id long, text string, lang string, mask int, N int")
    assert filter_audit.audit(filter_audit.cells(docs, spark.createDataFrame([], LABELS))).count() == 600
