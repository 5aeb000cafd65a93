from collections import Counter

from tidemill.llm import line_dedup


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute(rows, min_docs, min_chars):
    seen = Counter()
    by_id = {}
    for i, t in rows:
        by_id.setdefault(i, set()).update(key(x) for x in (t or "").split("\n"))
    for keys in by_id.values():
        seen.update(k for k in keys if len(k) >= min_chars)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if seen[key(x)] < min_docs]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, line_dedup.dedup(docs, 3, 1).collect()), key=str) == brute(rows, 3, 1)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "Hot \n b"), (4, " hot\r\nb\n\nb"), (5, "HOT"), (5, "hot"), (None, "hot\nz"), (6, "Ä\x0b"), (7, "a\n" * 100_000), (8, "b")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, dropped int, digest string")
    for at_least, chars in ((2, 1), (3, 1), (2, 2), (2, 0)):
        assert sorted(map(tuple, line_dedup.dedup(docs, at_least, chars).collect()), key=str) == brute(rows, at_least, chars)
    assert line_dedup.dedup(docs.limit(0)).collect() == []
