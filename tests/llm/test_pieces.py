import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.llm import pieces as pc

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_equals_the_library_and_round_trips(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    got = pc.op4_sentencepiece(spark, sf_dir).collect()
    assert len(got) == len(text)
    for r in got:
        assert r.ids == library.encode(text[r.doc_id]) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_edge_cases(spark, library):
    odd = [None, "", " ", "  a", "a  b   ", "\n", "\n\n x\n", "a\tb", "日本語と　emoji 🎉 é", "x" * 3000, "ab " * 100_000, "▁a▁", "  \r\n", "https://a.b/c?d=e#f" * 9, "a" + " " * 90 + "b"]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(odd)] + [(None, "x y", 1, "x"), (3, "  a", 1, "x")], "doc_id long, text string, ids int, word string")
    model = pc.Pieces.load(PATH)
    got = sorted(((r.doc_id, r.ids) for r in pc.encode(docs, model).collect()), key=str)
    assert got == sorted(((r.doc_id, library.encode(r.text or "")) for r in docs.collect()), key=str)
    assert pc.encode(docs.limit(0), model).collect() == []
    ids = spark.createDataFrame([(1, [model.names.index("▁the")], "x"), (2, None, "x"), (3, [], "x")], "doc_id long, ids array<int>, decoded string")
    assert [(r.doc_id, r.decoded) for r in pc.decode(ids, model).collect()] == [(1, "the"), (2, None), (3, "")]


def small(kind):
    words = ["a", "b", "c", "ab", "bc", "abc", "ca", "cab", "▁", "▁a", "▁ab", "bb", "abab"]
    names = ["<unk>", *(f"<0x{b:02X}>" for b in range(256)), *words]
    return pc.Pieces(names, [0.0] * 257 + [-5.0, -4.5, -4.7, -6.1, -6.0, -7.3, -5.9, -8.2, -3.0, -6.5, -7.7, -6.6, -9.9], [False] * 257 + [True] * len(words), 1, kind)


def brute(word, model):
    known = model.ranked()
    if model.kind == "unigram":
        best = (-float("inf"), None)

        def paths(at, total, cuts):
            nonlocal best
            if at == len(word):
                best = max(best, (total, cuts), key=lambda x: x[0])
                return
            for to in range(at + 1, len(word) + 1):
                e = known.get(word[at:to])
                if e or to == at + 1:
                    paths(to, total + (e[2] if e else pc.UNKNOWN), [*cuts, word[at:to]])

        paths(0, 0.0, [])
        parts = best[1]
    else:
        parts = list(word)
        while True:
            found = [(known[parts[i] + parts[i + 1]][0], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in known]
            if not found:
                break
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
    out = []
    for p in parts:
        out += [known[p][1]] if p in known else [model.bytes_at + b for b in p.encode()]
    return out


@pytest.mark.parametrize("kind", ["unigram", "bpe"])
def test_folds_against_brute_force(spark, kind):
    import random

    rng = random.Random(4)
    words = sorted({"".join(rng.choice("▁abcé") for _ in range(rng.randint(1, 9))) for _ in range(250)})
    model = small(kind)
    rows = spark.createDataFrame([(w,) for w in words], "word string")
    got = {r.word: list(r.ids) for r in pc.word_ids(rows, model).collect()}
    known = model.ranked()
    for w in words:
        want = brute(w, model)
        assert pc.long_ids(w, known, model.bytes_at, kind, model.longest) == want, w
        assert got[w] == want, w


@given(st.text(alphabet="ab \n▁é", max_size=40))
@settings(max_examples=200, deadline=None)
def test_words_are_the_text(text):
    assert "".join(pc.split_words(text)) == (pc.SPACE + text.replace(" ", pc.SPACE) if text else "")


def test_packs_of_an_unstable_input(spark, sf_dir, library, monkeypatch):
    """Rows that come in another order whenever they are asked for, in many small packs a task."""
    monkeypatch.setattr(pc, "PACK", 3000)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    mixed = docs.repartition(2).withColumn("at", F.rand()).sortWithinPartitions("at").drop("at")
    text = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.ids for r in pc.encode(mixed, pc.Pieces.load(PATH)).collect()}
    assert got == {i: library.encode(t) for i, t in text.items()}


def test_decoded_replaces_a_column_of_any_case(spark):
    model = pc.Pieces.load(PATH)
    ids = spark.createDataFrame([([model.names.index("▁the")], "x")], "ids array<int>, Decoded string")
    assert pc.decode(ids, model).select("decoded").first()[0] == "the"


def test_words_are_shuffled_once_and_cut_by_bits(spark, library, monkeypatch):
    model, ranked = pc.Pieces.load(PATH), pc.Pieces.load(PATH).ranked()
    words = ["▁the", "▁", "é", "▁日本", "x" * 60, "▁unbelievable", "a🎉b"]
    got = {r.word: r.cuts for r in pc.word_cuts(spark.createDataFrame([(w,) for w in words], "word string"), model).collect()}
    for w in words:
        assert pc.cut_ids(w, got[w], ranked, model.bytes_at) == pc.long_ids(w, ranked, model.bytes_at, "bpe", model.longest)
    plans, keep = {}, pc.Scratch.keep

    def kept(self, df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return keep(self, df, name)

    monkeypatch.setattr(pc.Scratch, "keep", kept)
    docs = spark.createDataFrame([(1, "the cat"), (2, None), (3, "cat  the\n")], "doc_id long, text string")
    assert {r.doc_id: r.ids for r in pc.encode(docs, model).collect()} == {1: library.encode("the cat"), 2: [], 3: library.encode("cat  the\n")}
    # both sides deal the same columns, so that Spark takes one exchange for both
    dealt = [x for x in plans["cuts"].splitlines() if "hashpartitioning(word" in x]
    assert len(dealt) == 2 and "ObjectHashAggregate" not in plans["cuts"]
    assert spark.conf.get("spark.sql.execution.useObjectHashAggregateExec") == "true"


def test_packs_are_not_dealt_again(spark, library, monkeypatch):
    """Packs stay in their buckets, and the words of a pack and bucket travel in one row."""
    monkeypatch.setattr(pc, "PACK", 40)
    texts = {1: "the cat\nsat", 2: "the  mat ", 3: None, 4: "", 5: "x" * 90 + " the cat", 6: " \n a", 7: "cat é 🎉"}
    got = pc.encode(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), pc.Pieces.load(PATH))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(pack") == 1 and "Bucketed: true" in plan
    assert {r.doc_id: r.ids for r in got.collect()} == {i: library.encode(t or "") for i, t in texts.items()}
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("scratch_")]
