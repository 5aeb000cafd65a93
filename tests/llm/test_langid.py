import numpy as np
import pyarrow as pa

from tidemill.llm import langid


def brute_prob(counts, order, context, char, alphabet):
    """Interpolated Kneser-Ney by definition, over {gram: count} of one language."""
    layers = {order: dict(counts)}
    for n in range(order - 1, 0, -1):
        layers[n] = {}
        for g in layers[n + 1]:
            layers[n][g[1:]] = layers[n].get(g[1:], 0) + 1

    def p(n, ctx, c):
        if n == 0:
            return 1 / alphabet
        layer = layers[n]
        once, twice = sum(v == 1 for v in layer.values()), sum(v == 2 for v in layer.values())
        d = min(0.9, max(0.1, once / max(once + 2 * twice, 1)))
        mine = {g: v for g, v in layer.items() if g[:-1] == ctx}
        if not mine:
            return p(n - 1, ctx[1:], c)
        total = sum(mine.values())
        return max(layer.get(ctx + c, 0) - d, 0) / total + d * len(mine) / total * p(n - 1, ctx[1:], c)

    return p(order, context, char)


def test_estimates_against_definition():
    counts = {"a": {"aab": 3, "aba": 2, "bab": 1, "baa": 2, "cab": 1}, "b": {"ccb": 2, "cba": 1, "bac": 4, "acc": 2}}
    frame = pa.Table.from_pylist([{"lang": x, "gram": g, "n": n} for x, c in counts.items() for g, n in c.items()])
    model = langid._estimate(["a", "b"], frame, 3)
    alphabet = 3 + 1
    text = "abacabaccbab"
    got, chars = model.entropies([text])
    assert chars[0] == len(text)
    padded = chr(1) * 2 + text
    for i, lang in enumerate("ab"):
        total = sum(np.log(brute_prob(counts[lang], 3, padded[j : j + 2], padded[j + 2], alphabet)) for j in range(len(text)))
        assert abs(got[0, i] + total / len(text)) < 1e-4


def plain_codes(text):
    """Lower-cased letters, every run of other characters one space, none at the start; character by character."""
    out = ""
    for c in text.lower():
        if c.isalpha():
            out += c
        elif out and out[-1] != " ":
            out += " "
    return out


class Brute:
    """The definition again, with the sums that it needs kept."""

    def __init__(self, counts, order, alphabet):
        self.layers, self.order, self.alphabet = {order: counts}, order, alphabet
        for n in range(order - 1, 0, -1):
            self.layers[n] = {}
            for g in self.layers[n + 1]:
                self.layers[n][g[1:]] = self.layers[n].get(g[1:], 0) + 1
        self.d, self.total, self.kinds = {}, {}, {}
        for n, layer in self.layers.items():
            once, twice = sum(v == 1 for v in layer.values()), sum(v == 2 for v in layer.values())
            self.d[n] = min(0.9, max(0.1, once / max(once + 2 * twice, 1)))
            for g, v in layer.items():
                self.total[n, g[:-1]] = self.total.get((n, g[:-1]), 0) + v
                self.kinds[n, g[:-1]] = self.kinds.get((n, g[:-1]), 0) + 1

    def p(self, n, ctx, c):
        if n == 0:
            return 1 / self.alphabet
        if (n, ctx) not in self.total:
            return self.p(n - 1, ctx[1:], c)
        own = max(self.layers[n].get(ctx + c, 0) - self.d[n], 0) / self.total[n, ctx]
        return own + self.d[n] * self.kinds[n, ctx] / self.total[n, ctx] * self.p(n - 1, ctx[1:], c)

    def entropy(self, text):
        padded = chr(1) * (self.order - 1) + text
        return -sum(np.log(self.p(self.order, padded[j : j + self.order - 1], padded[j + self.order - 1])) for j in range(len(text))) / len(text)


def test_training_against_brute_force(spark, sf_dir):
    """Counting, discounts, continuation counts and predictions of the production model, from plain dictionaries."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learn = docs.filter(langid.hash_split(3) != 1)
    model = langid.train(learn)
    counts = {}
    for r in learn.collect():
        if r.lang is not None and r.text is not None:
            padded = chr(1) * 4 + plain_codes(r.text)
            mine = counts.setdefault(r.lang, {})
            for j in range(len(padded) - 4):
                mine[padded[j : j + 5]] = mine.get(padded[j : j + 5], 0) + 1
    assert model.langs == sorted(counts) and len(model.grams[-1][0].keys) == len({g for c in counts.values() for g in c})
    letters = {g[-1] for c in counts.values() for g in c}
    brute = [Brute(counts[x], 5, len(letters) + 1) for x in model.langs]
    texts = [r.text[:600] for r in docs.orderBy("doc_id").limit(40).collect()]
    texts = [t for t in texts if plain_codes(t)]
    got, chars = model.entropies(texts)
    for i, t in enumerate(texts):
        codes = plain_codes(t)
        assert chars[i] == len(codes)
        want = [b.entropy(codes) for b in brute]
        assert np.allclose(got[i], want, atol=2e-3), (got[i], want)
        assert int(got[i].argmin()) == int(np.argmin(want))


def test_ties_and_repeated_rows(spark):
    """Texts that all languages find equally likely go to the first of them; rows that repeat are judged alike."""
    rows = [(i, "abc abd", x) for i in range(40) for x in ("b", "a")]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    docs = spark.createDataFrame([(1, "abc"), (1, "abc"), (2, "abc"), (None, "abc")], "doc_id long, text string")
    got = langid.identify(docs, model).collect()
    assert [r.lang_pred for r in got] == ["a"] * 4 and len({r.score for r in got}) == 1


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = langid.op10_language_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got["held_out"] & got["lang"].notna()]
    assert len(got) == docs.count() and len(held) > 20
    assert (held["lang_pred"] == held["lang"]).mean() > 0.9
    assert got["rejected"].mean() < 0.03
    assert got["score"].between(0, 1).all()


def test_edge_cases(spark):
    rows = [(i, "the cat sat on the mat and the dog ran", "en") for i in range(20)] + [(i + 20, "der hund und die katze sind nicht da", "de") for i in range(20)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    odd = [(1, None, "x", 1), (2, "", "x", 1), (3, "123 !!", "x", 1), (4, "the dog", "x", 1), (5, "und die " * 200_000, "x", 1), (6, "the dog", "x", 1), (None, "der hund", None, None)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, score string, n int")
    got = [(r.doc_id, r.lang_pred) for r in langid.identify(docs, model).collect()]
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "de"), (6, "en"), (None, "de")]
    none = langid.train(docs.limit(0).selectExpr("doc_id", "text", "score as lang"))
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).collect() == []


def test_a_model_keeps_every_gram(spark):
    # 60,000 distinct grams, most of them seen once
    rng = np.random.default_rng(4)
    letters = [chr(0x4E00 + i) for i in range(300)]
    texts = ["".join(letters[j] for j in rng.integers(0, 300, 600)) for _ in range(100)]
    model = langid.train(spark.createDataFrame([(t, "x") for t in texts], "text string, lang string"))
    want = {}
    for t in texts:
        padded = chr(1) * 4 + t
        for j in range(len(t)):
            want[padded[j : j + 5]] = want.get(padded[j : j + 5], 0) + 1
    assert len(want) > 59_000 and len(model.grams[-1][0].keys) == len(want)
    frame = pa.Table.from_pylist([{"lang": "x", "gram": g, "n": n} for g, n in want.items()])
    whole = langid._estimate(["x"], frame, 5)
    assert np.allclose(model.entropies(texts[:5])[0], whole.entropies(texts[:5])[0])
    assert abs(np.exp(model.contexts[-1][1]).mean() - 0.9) < 0.05  # contexts seen once: the whole discount, clipped at 0.9


def test_foreign_texts_are_rejected_in_rare_languages_too(spark):
    rng = np.random.default_rng(6)

    def texts(alphabet, n, size):
        vocabulary = ["".join(rng.choice(list(alphabet), rng.integers(2, 8))) for _ in range(80)]
        return [" ".join(rng.choice(vocabulary, size)) for _ in range(n)]

    common, rare, foreign = texts("abcdefgh", 12_000, 20), texts("klmnopqr", 1, 400), texts("stuvwxyz", 20, 12)
    docs = spark.createDataFrame([(i, t, "common") for i, t in enumerate(common)] + [(20_000, rare[0], "rare")], "doc_id long, text string, lang string")
    model = langid.calibrate(langid.train(docs), docs)
    assert set(model.norm) == {"common", "rare"} and np.isfinite(list(model.norm.values())).all()
    near = ["".join(rng.choice(list("klmnopqr   "), n)) for n in (50, 60, 200) for _ in range(10)]  # of the rare letters, but gibberish
    gibberish = ["".join(rng.choice(list("abcdefgh   "), n)) for n in (50, 60, 200) for _ in range(10)]
    for odd in (near, gibberish, foreign):
        said = model.predict(odd)
        assert said["rejected"].all(), said
    assert (model.predict(near)["lang_pred"] == "rare").all()
    own = model.predict([*common[:200], rare[0], rare[0][:60]])
    assert not own["rejected"].any() and list(own["lang_pred"][-2:]) == ["rare", "rare"]


def test_a_language_without_texts_to_calibrate_on_has_a_limit(spark):
    docs = spark.createDataFrame([(i, "the cat sat on the mat", "en") for i in range(40)] + [(40, "der hund und die katze", "de")], "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert np.isfinite(list(langid.calibrate(model, docs.filter("lang = 'en'")).norm.values())).all() and set(model.norm) == {"de", "en"}
    assert np.isfinite(list(langid.calibrate(model, docs.limit(0)).norm.values())).all() and set(model.norm) == {"de", "en"}
