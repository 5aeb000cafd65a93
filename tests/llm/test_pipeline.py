import re
from collections import defaultdict

import corpus_pipeline
from tidemill.llm import langid

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    text = {r.doc_id: r.text for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir).cache()
        assert out.columns == docs.columns
        rows = {r.doc_id: r.text for r in out.collect()}
        kept[name] = rows
        docs = out
    said = {r.doc_id: r.rejected for r in langid.identify(spark.read.parquet(f"{sf_dir}/documents.parquet"), langid.trained_on(spark.read.parquet(f"{sf_dir}/documents.parquet"))).collect()}
    assert set(kept["language_id"]) == {i for i, r in said.items() if not r}
    first = {}
    for i in sorted(kept["language_id"]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text[i]), i)
    assert set(kept["exact_dedup"]) == set(first.values())
    sets = {i: grams(t) for i, t in kept["exact_dedup"].items()}
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    assert set(kept["ngram_jaccard_join"]) == {find(i) for i in ids}
    before, after = kept["ngram_jaccard_join"], kept["substring_dedup"]
    assert set(before) == set(after)
    seen = defaultdict(set)
    for i, t in after.items():
        w = WORD.findall(t.lower())
        for j in range(len(w) - 50):
            seen[tuple(w[j : j + 51])].add(i)
    assert all(len(v) == 1 for v in seen.values())


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.count() > 0


def test_stages_with_odd_rows(spark, sf_dir):
    """Nulls anywhere, empty and long texts, repeated rows and ids, and columns with clashing names: every stage has a
    defined result."""
    prose = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").filter("length(text) > 600 and lang = 'en'").orderBy("doc_id").limit(6).collect()]
    rows = [(1, prose[0], "en"), (1, prose[0], "en"), (2, prose[0], None), (3, prose[1], "en"), (3, prose[2], "en"), (None, prose[3], "en"), (4, None, "en"), (5, "", None), (6, " \n", "en"), (7, (prose[4] + "\n") * 60, "en"), (8, prose[5], "en")]
    extra = ("s", 1, True, "r", 2, "x", 3)
    names = ["doc_id", "text", "lang", "score", "letters", "rejected", "rid", "keep_id", "_old", "component_id"]
    docs = spark.createDataFrame([(*r, *extra) for r in rows], "doc_id long, text string, lang string, score string, letters int, rejected boolean, rid string, keep_id int, _old string, component_id int")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
            break
        assert out.columns == names
        got = out.collect()
        assert all(tuple(r)[3:] == extra for r in got)
        ids = sorted((r.doc_id or 0, len(r.text or "")) for r in got)
        n = [len(p) for p in prose]
        if name == "language_id":  # rows without letters go, each by its own text
            assert ids == sorted([(1, n[0]), (1, n[0]), (2, n[0]), (3, n[1]), (3, n[2]), (0, n[3]), (7, 60 * (n[4] + 1)), (8, n[5])])
            docs = out.unionByName(docs.filter("doc_id in (4, 5)")).cache()  # the next stages see null and empty texts too
        elif name == "exact_dedup":  # of the null and the empty text the smaller id stays
            assert [i for i, _ in ids] == [0, 1, 1, 3, 3, 4, 7, 8]
            docs = out.cache()
        else:
            assert [i for i, _ in ids] == [0, 1, 1, 3, 3, 4, 7, 8]
            docs = out.cache()


def test_stages_with_empty_tables(spark, sf_dir):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.collect() == [] and (name == "packing" or out.columns == docs.columns)


def test_workers_hand_back_what_a_task_has_freed():
    import psutil

    from tidemill.llm.common import lean

    above = []

    def hungry(batches):
        held = [bytes(1000) for _ in range(200_000)]
        above.append(bytes(1000))  # the heap does not shrink below what is last in it
        yield from (len(held) for _ in batches)

    before = psutil.Process().memory_info().rss
    assert list(lean(hungry)(iter([1, 2]))) == [200_000, 200_000]
    assert psutil.Process().memory_info().rss - before < 100_000_000


def test_all_stages_of_large_batches_are_lean():
    import inspect
    import re

    from tidemill.llm import langid, ngram_join, setlinks, sketch, substring_dedup

    for module in (langid, ngram_join, setlinks, sketch):
        assert not re.search(r"mapIn(Arrow|Pandas)\((?!lean\()", inspect.getsource(module)), module.__name__
    assert len(re.findall(r"mapIn(?:Arrow|Pandas)\(lean\(", inspect.getsource(substring_dedup))) >= 4
