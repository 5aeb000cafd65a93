import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidemill.llm import packing


def check(rows, pieces, window=1024):
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    exact.encode_special_tokens = True
    ids = {i: np.array([*exact.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in rows}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
        assert p.doc_tokens == len(ids[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())
    assert set(by_doc) == set(ids)
    for i, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.length > 0
            at += p.length
        assert at == len(ids[i])
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
    return sum(len(v) for v in ids.values()), len(by_seq)


def test_round_trip_and_padding(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tokens, sequences = check([(r.doc_id, r.text) for r in docs.collect()], packing.pack(docs).collect())
    assert sequences * 1024 < 1.02 * tokens + 1024


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "a" * 5000), (4, "word " * 1023), (5, "日本語 text 　 <|endoftext|>"), (6, " \n\n\t  x" * 300), (7, " " * 20_000), (None, "none")]
    docs = spark.createDataFrame([(*r, 3, "x") for r in rows], "doc_id long, text string, tail int, df string")
    check(rows, packing.pack(docs).collect())
    assert packing.pack(docs.limit(0)).collect() == []
    twice = spark.createDataFrame([(1, "same text"), (1, "same text")], "doc_id long, text string")
    assert sum(p.length for p in packing.pack(twice).collect()) == 6


def test_scores_are_bm25_and_neighbours_come_first():
    rng = np.random.default_rng(2)
    tails = [np.sort(rng.choice(500, rng.integers(5, 30), replace=False)).astype(np.uint32) for _ in range(60)]
    tails[1] = tails[0].copy()
    counts = [rng.integers(1, 5, len(t)).astype(np.uint16) for t in tails]
    lengths = np.array([c.sum() for c in counts])
    df = np.bincount(np.concatenate(tails), minlength=500)
    idf = np.log(1 + (60 - df + 0.5) / (df + 0.5))
    index = packing.Index(tails, counts, lengths, idf, lengths.mean())
    for q in (0, 7):
        want = np.zeros(60)
        for d in range(60):
            for t in tails[q]:
                where = np.flatnonzero(tails[d] == t)
                if len(where):
                    tf = counts[d][where[0]]
                    want[d] += idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lengths[d] / lengths.mean()))
        assert np.allclose(index.scores(q), want)
    windows = list(packing.fill(index, lengths, 1024))
    together = next(w for w in windows if any(d == 0 for d, _, _ in w))
    assert any(d == 1 for d, _, _ in together)


def test_piece_checksums():
    ids = np.arange(1000, dtype="<u4") * 37 % 50_000
    _, _, running, _, _ = packing._digest(ids, 1024)
    running = np.frombuffer(running, np.uint32)
    for a, b in ((0, 16), (16, 1000), (32, 64), (0, 1000), (992, 1000)):
        assert packing.piece_crc(running, a, b) == zlib.crc32(ids[a:b].tobytes())


def test_every_term_of_a_long_tail_scores():
    # tail 0 shares with tail i only its term i, of any weight
    terms = [np.arange(500, dtype=np.uint32), *(np.array([i, 500 + i], np.uint32) for i in range(500))]
    counts = [np.arange(1, 501).astype(np.uint16), *(np.ones(2, np.uint16) for _ in range(500))]
    index = packing.Index(terms, counts, np.array([c.sum() for c in counts]), np.ones(1000), 4.0)
    assert (index.scores(0) > 0).all()


def test_ids_are_an_array_and_know_no_special_tokens():
    tokens = packing.Tokens("byte_bpe_50k")
    for text in ("", "plain text", "a <|none|> b<|none|>", "<|none", "<|endoftext|>", "  \n\n x  "):
        ids = tokens.ids(text, True)
        assert ids.dtype == np.uint32 and ids.tolist() == tokens.exact.encode(text, add_special_tokens=False).ids
