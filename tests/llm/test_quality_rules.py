import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemill.llm import quality_rules
from tidemill.llm.common import hash_split, table

WHITE = " \t\n\x0b\x0c\r"
LABELS = "doc_id long, label int"
TEXTS = [
    None, "", " \n\t", "a b c a b c", "a a a a a", "A a A a", "x", "é ü#$ |<>& é ü#$ |<>&\n\n x \n x \nx", "one line\none line\n\n \n one line", "w " * 60_000,
    "\n".join(["the same line here"] * 30), " ".join(f"w{i}" for i in range(70)), "a\x85b c\xa0d e f" * 3, "a b c\nd a b\nc d e",
]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)]


def test_counts_against_plain_python(spark, sf_dir):
    texts = TEXTS + [r.text for r in table(spark, sf_dir, "documents").select("text").collect()]
    assert quality_rules.counts(pa.array(texts, pa.string())).tolist() == [plain(t) for t in texts]


def test_ngrams_against_plain_python():
    texts = ["Ab cd ab cd", None, "é", "abc"]
    (starts, index, value), *more = quality_rules.ngrams(pa.array(texts))
    assert not more and len(index) == len(value) == starts[-1]
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        words = (t or "").lower().split()
        grams = Counter(words) + Counter(zip(words, words[1:])) + Counter(raw[j : j + k] for k in (3, 5) for j in range(len(raw) - k + 1))
        mine = np.sort(value[starts[i] : starts[i + 1]])
        want = np.sort(np.log1p(list(grams.values())))
        assert np.allclose(mine, want / max(np.linalg.norm(want), 1e-9))


def test_gradient_steps_reach_the_minimum():
    r = np.random.default_rng(0)
    a = r.normal(size=(40, 6))
    b = r.normal(size=40)
    found = quality_rules.lbfgs(lambda w: (float(((a @ w - b) ** 2).sum()), 2 * a.T @ (a @ w - b)), np.zeros(6), 100, 1e-12)
    assert np.allclose(found, np.linalg.lstsq(a, b, rcond=None)[0], atol=1e-3)


@pytest.fixture(scope="module")
def fitted(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    labels = table(spark, "/root/testdata/sf0.01", "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality_rules.train(docs, labels.filter(hash_split(3) != 1))
    return docs, labels, model


def test_verdicts_on_rows_that_were_not_learned(fitted):
    docs, labels, model = fitted
    seen = quality_rules.judge(docs.join(labels.filter(hash_split(3) == 1), "doc_id"), model).select("label", "probability").toPandas()
    assert len(seen) > 100
    assert ((seen["probability"] >= quality_rules.KEEP_AT) == seen["label"]).mean() > 0.95
    # probabilities are calibrated: their mean is the share of label 1, and Brier's score is small
    assert abs(seen["probability"].mean() - seen["label"].mean()) < 0.06
    assert ((seen["probability"] - seen["label"]) ** 2).mean() < 0.06


def test_odd_rows_and_columns(spark, fitted):
    _, _, model = fitted
    rows = spark.createDataFrame([(k, t, 1, 2) for k, t in enumerate(TEXTS)] + [(None, "x y", 1, 2)], "doc_id long, text string, `a.b` int, Kept int")
    out = quality_rules.judge(rows, model)
    assert out.columns[:3] == ["doc_id", "text", "a.b"] and out.columns.count("kept") == 1 and "Kept" not in out.columns
    got = {r.text: r for r in out.collect()}
    for t in TEXTS:
        n, _, _, _, again = plain(t)
        assert got[t].base_failed == (n < 50 or 100 * again > 50 * n)
        assert not (got[t].base_failed and got[t].kept) and 0 <= got[t].probability <= 1
    assert quality_rules.judge(rows.limit(0), model).count() == 0


def test_without_labels_of_both_kinds(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "c"), (2, None)], "doc_id long, text string")
    for labels, share in (([], 0.5), ([(1, 1), (None, 1), (2, 7)], None)):
        model = quality_rules.train(docs, spark.createDataFrame(labels, LABELS))
        p = [r.probability for r in quality_rules.judge(docs, model).collect()]
        assert len(set(p)) == 1 and (share is None or p[0] == share)
    twice = quality_rules.sample(docs, spark.createDataFrame([(1, 0), (1, 1), (2, 0)], LABELS)).collect()
    assert sorted((r.doc_id, r.label) for r in twice) == [(1, 1), (2, 0)]
