import numpy as np
import pyarrow as pa

from tidemill.llm import quality


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    ones = label.sum()
    return (rank[label == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(label) - ones))


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.op1_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert got["score"].between(0, 1).all()
    assert auc(held["score"].to_numpy(), held["quality"].to_numpy()) > 0.9
    assert ((held["score"] >= 0.3).astype(int) == held["predicted"]).all()


def test_tables_are_added_up():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, len(quality.FEATURES)))
    y = ((x[:, 0] + x[:, 1] * x[:, 2]) > 0).astype(float)
    m = quality.fit(x, y)
    assert auc(m.score(x), y) > 0.9
    assert any({i, j} == {1, 2} for i, j, _ in m.pairs)
    for row in x[:20]:
        total = m.base + sum(t[np.searchsorted(e, v, "right")] for t, e, v in zip(m.tables, m.edges, row))
        total += sum(t[np.searchsorted(m.pair_edges[i], row[i], "right"), np.searchsorted(m.pair_edges[j], row[j], "right")] for i, j, t in m.pairs)
        assert abs(1 / (1 + np.exp(-total)) - m.score(row[None, :])[0]) < 1e-9


def test_edge_cases(spark):
    odd = [None, "", " \n", "word", "a" * 1_000_000, "word word\n" * 100_000, "é!"]
    x = quality.features(pa.array(odd, pa.string()))
    assert x.shape == (7, len(quality.FEATURES)) and np.isfinite(x).all()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(odd)] + [(None, "t", None)], "doc_id long, text string, score string")
    none = quality.train(docs, spark.createDataFrame([], "doc_id long, label int"))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    one = quality.train(docs, spark.createDataFrame([(1, 1), (3, 1), (None, 0), (4, None)], "doc_id long, label int"))
    assert all(0 < r.score < 1 for r in quality.score(docs, one).collect())
    assert quality.score(docs.limit(0), one).collect() == []


WHITE = " \t\n\x0b\x0c\r"


def plain_features(text):
    """Every feature by its description, one character at a time."""
    text = text or ""
    raw = text.encode()
    found, now = [], ""
    for c in text:
        if c in WHITE:
            found += [now] if now else []
            now = ""
        else:
            now += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    found += [now] if now else []
    sizes = [len(w.encode()) for w in found]
    n, size = max(len(found), 1), max(len(raw), 1)
    has = lambda chars: sum(c in chars for c in raw)
    upper, lower = has(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), has(b"abcdefghijklmnopqrstuvwxyz")
    grams = [tuple(found[i : i + 3]) for i in range(len(found) - 2)]
    mean = sum(sizes) / n
    lines = raw.split(b"\n")
    longest = max(len(x) + (i < len(lines) - 1) for i, x in enumerate(lines))
    spread = (max(0.0, sum(x * x for x in sizes) / n - mean**2)) ** 0.5
    return {
        "log_bytes": np.log1p(len(raw)), "log_words": np.log1p(len(found)), "word_bytes": mean, "upper": upper / max(upper + lower, 1), "digit": has(b"0123456789") / size,
        "stop": has(b".,;:?'\"()-") / size, "symbol": has(b"#$%&*+/<=>@[\\]^_`{}~") / size, "bang": has(b"!") / size, "pipe": has(b"|") / size, "other_bytes": sum(c > 127 for c in raw) / size,
        "newlines": has(b"\n") / n, "distinct_words": len(set(found)) / n if found else 0.0, "top_word": max((found.count(w) for w in set(found)), default=0) / n,
        "distinct_grams": len(set(grams)) / len(grams) if grams else 1.0, "longest_line": longest / size, "short_words": sum(x <= 2 for x in sizes) / n, "word_spread": spread,
        "ends_symbol": sum(w[-1] in "#$%&*+<=>@^_~|!" for w in found) / n,
    }


def test_features_against_plain_computation(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(60).collect()] + [None, "", " \n ", "One two, THREE! 4 5% é|é\n\nx#"]
    got = quality.features(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        for name, want in plain_features(t).items():
            assert abs(got[i, quality.FEATURES.index(name)] - want) < 1e-6, (name, t)


def test_repeated_ids(spark):
    """Rows that repeat a doc_id, in documents or labels, each count; every row of documents gets its own score."""
    docs = spark.createDataFrame([(1, "good text here"), (1, "!!! bad"), (2, "good text here"), (2, "good text here")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1)], "doc_id long, label int")
    model = quality.train(docs, labels)
    got = sorted((r.doc_id, round(r.score, 12)) for r in quality.score(docs, model).collect())
    assert len(got) == 4 and got[2] == got[3] and got[2][1] in {x[1] for x in got[:2]}


def test_score_replaces_a_column_of_any_case(spark):
    rows = spark.createDataFrame([("a", 7)], "text string, Score int")
    out = quality.score(rows, quality.Additive([]))
    assert out.select("score").first()[0] == 0.5 and out.columns == ["text", "score"]


def test_rows_that_repeat_a_labelled_id_are_bounded(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, label int")
    assert quality.train(docs, labels, rows=10).base == quality.train(docs, labels, rows=10).base
