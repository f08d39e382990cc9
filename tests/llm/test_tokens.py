import random
import zlib

import duckdb
import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from graphloom.llm import packing, token_count  # noqa: E402
from graphloom.llm.queries import op3_packing, op9_token_counts, tokenizer_path  # noqa: E402

BYTES, WORDS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
ODD = ["", "a", " ", "  \n\t x", "<|endoftext|>", "a<|endoftext|> <|endoftext|>b", "<|startoftext|>Hi", "<|STARTOFTEXT|> <|EndOfText|>", "</w> a</w>", "İΣΣ Σ", "é é Å", "\x1c\x1d\x85\xa0 x​", "it's I'LL 'S 're", "漢字 \U0001f600\U0001f468‍\U0001f469", "\x00\x01\x7f", "1234 5²½", "ªºßẞ", "x" * 3000, "--!!?? ... …", "a  b   c    ", "́abc", "KKſ"]


def random_texts(n=300):
    rng = random.Random(3)
    pool = list("abcABC 's'll\n\t  123.,!?éÉß Σİ́中") + [" the", "ing", "'re", "<|endoftext|>", "<|", "\r\n"]
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 80))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    return [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()]


def test_counts_match_the_library(docs_of, corpus):
    texts = ODD + random_texts() + corpus
    t = Tokenizer.from_file(BYTES)
    want = [len(t.encode(x, add_special_tokens=False).ids) for x in texts]
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.count_tokens(docs_of([*texts, None]), BYTES).collect()}
    assert got.pop(len(texts)) == (0, 0, False)
    assert got == {i: (len(x.encode()), n, n > 1024) for i, (x, n) in enumerate(zip(texts, want))}


def test_ids_match_the_library_in_chunks_too(monkeypatch, corpus):
    t = Tokenizer.from_file(WORDS)
    words = packing.WordIds(open(WORDS, encoding="utf-8").read())
    assert words.pieces
    for size in (token_count.CHUNK, 50):
        monkeypatch.setattr(token_count.chunks, "__defaults__", (size,))
        for x in ODD + random_texts() + corpus:
            assert np.frombuffer(words(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_best_fill_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(0, 5))}
        room = rng.randint(1, 60)
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1)}
        total, used = packing.best_fill(sorted(counts), counts.__getitem__, room)
        assert total == max(s for s in sums if s <= room)
        assert sum(k * n for k, n in used.items()) == total and all(n <= counts[k] for k, n in used.items())


def check_packing(rows, texts, capacity=4096):
    t = Tokenizer.from_file(WORDS)
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(texts)
    for doc, text in texts.items():
        ids = np.asarray([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == capacity or at & (at - 1) == 0 and at < capacity
    return len(sequences)


def test_packing_round_trip(docs_of, corpus, monkeypatch):
    texts = dict(enumerate([*ODD, None, "word " * 20_000, *corpus]))
    assert check_packing(packing.pack(docs_of(list(texts.values())), WORDS).collect(), texts)
    monkeypatch.setattr(packing, "POOL", 20)
    monkeypatch.setattr(packing, "OPEN", 5)
    small = packing.pack(docs_of(list(texts.values())), WORDS, capacity=64).collect()
    assert check_packing(small, texts, 64)
    same = {i: "same words" for i in range(50)}
    assert check_packing(packing.pack(docs_of(list(same.values())), WORDS, capacity=64).collect(), same, 64)
    assert packing.pack(docs_of([]), WORDS).count() == 0


def test_queries_on_test_data(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    check_packing(op3_packing(spark, d).collect(), texts)
    t = Tokenizer.from_file(BYTES)
    assert {r.doc_id: r.n_tokens for r in op9_token_counts(spark, d).collect()} == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in texts.items()}


def test_long_pieces_like_short_ones(docs_of):
    rng = random.Random(8)
    merger = token_count.PairMerger(open(BYTES, encoding="utf-8").read())
    t = Tokenizer.from_file(BYTES)
    for piece in ("a" * 5000, "".join(rng.choice("etaoinshrdlu") for _ in range(20_000)), "the" * 3000, "ab", "漢字" * 1000):
        want = len(t.encode(piece, add_special_tokens=False).ids)
        assert merger.merged_long(piece.encode()) == merger.merged(piece.encode()) == want
    assert token_count.count_tokens(docs_of([]), BYTES).count() == 0
    same = docs_of([(1, "two words"), (1, "two words"), (None, None)], ", n_tokens string")
    assert sorted((r.doc_id or 0, r.n_tokens) for r in token_count.count_tokens(same, BYTES).collect()) == [(0, 0), (1, 2), (1, 2)]


def test_other_specifications_are_refused():
    import json

    spec = json.load(open(BYTES, encoding="utf-8"))
    nested = {**spec, "added_tokens": [{"id": 1, "content": "<|end"}, {"id": 2, "content": "<|end|>"}]}
    assert token_count.Counter(token_count.PairMerger(json.dumps(nested)))("<|end|>") == 1
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"added_tokens": [{"id": 1, "content": "x", "lstrip": True}]}):
        with pytest.raises(ValueError, match="can't be counted|can be counted"):
            token_count.PairMerger(json.dumps({**spec, **change}))


def test_packing_odd_rows(docs_of):
    rows = [(None, "no id"), (7, "twice the same"), (7, "twice the same"), (8, None)]
    out = packing.pack(docs_of(rows, ", start string"), WORDS, capacity=8).collect()
    total = {}
    for r in out:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    t = Tokenizer.from_file(WORDS)
    n = lambda x: len(t.encode(x, add_special_tokens=False).ids) + 1
    assert total == {None: n("no id"), 7: 2 * n("twice the same"), 8: 1}
