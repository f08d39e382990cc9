import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import suffix_dedup as op
from graphloom.llm.queries import op5_suffix_dedup


def naive(pairs):
    """For (id, text) pairs: (id, n_bytes, n_removed, n_spans, kept_sha256)."""
    least = {}
    data = [(i, (t or "").encode()) for i, t in pairs]
    for i, b in data:
        for k in range(len(b) - 49 if i is not None else 0):
            w = b[k : k + 50]
            least[w] = min(i, least.get(w, i))
    out = []
    for i, b in data:
        gone = [False] * len(b)
        for k in range(len(b) - 49 if i is not None else 0):
            if least[b[k : k + 50]] < i:
                gone[k : k + 50] = [True] * 50
        rest = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8)))
    passages = [" ".join(word() for _ in range(rng.randint(5, 40))) for _ in range(8)]
    texts = ["", None, "x" * 49, "x" * 50, "x" * 51, "ab" * 400, "ba" * 300 + "c", "y" * 49 + "z"]
    for _ in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 4))]
        text = rng.choice(["", " "]).join(parts)
        if rng.random() < 0.3:  # a near copy
            k = rng.randrange(len(text))
            text = text[:k] + "#" + text[k + 1 :]
        texts.append(text)
    return texts + texts[10:14]


def run(docs):
    return sorted((tuple(r) for r in op.window_dedup(docs).collect()), key=str)


def test_against_brute_force(docs_of):
    texts = corpus(1)
    assert run(docs_of(texts, ", n_removed string")) == naive(list(enumerate(texts)))


@pytest.mark.parametrize("held", [100, 3_000_000])
def test_common_anchors_in_many_contexts(docs_of, held):
    rng = random.Random(6)
    line = "this very common line stands in many documents"
    texts = [f"{rng.choice('ab') * rng.randint(0, 60)}{line}{rng.choice('cd') * rng.randint(0, 60)}" for _ in range(80)] + corpus(8, 10)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(op, "SPLIT", 2)
        m.setattr(op, "HELD", held)
        assert run(docs_of(texts)) == naive(list(enumerate(texts)))


def test_ids_that_repeat_or_are_null_and_any_order(docs_of):
    texts = corpus(2, 30)
    rng = random.Random(7)
    pairs = [(rng.choice([None, -5, *range(12)]), t) for t in texts]
    assert run(docs_of(pairs)) == naive(pairs)
    assert run(docs_of([])) == []


def test_long_texts_in_parts_and_many_flushes(docs_of):
    texts = corpus(3, 40)
    long = " ".join(t for t in texts if t)
    texts = [long[300:], *texts, long]
    # the workers get these functions by value, with the values that hold here
    with pytest.MonkeyPatch.context() as m:
        m.setattr(op, "SEGMENT", 211)
        m.setattr(op, "HELD", 500)
        m.setattr(op, "BUCKET_BYTES", 64)
        assert run(docs_of(texts)) == naive(list(enumerate(texts)))


def test_equal_windows_lie_in_runs_of_one_anchor():
    rng = random.Random(5)
    text = bytes(rng.choice(b"abc ") for _ in range(3000)) + b"x" * 200 + b"ab" * 100
    right, left, own, place = op.runs_in([(0, 0, 1 << 20)], [text])
    windows = {}
    for r, b, p in zip(right, left, place.tolist()):
        behind, before = int((r != op.FILL).sum()), int((b != op.FILL).sum())
        assert text[p : p + behind] == r[:behind].tobytes() and text[p - before : p] == b[:before].tobytes()[::-1]
        for offset in range(op.WINDOW - behind, before + 1):
            assert windows.setdefault(p - offset, offset) == offset
    assert sorted(windows) == list(range(len(text) - 49)) and len(place) < 3000 / 15 + 400
    places = {}
    for w, offset in windows.items():
        assert places.setdefault(text[w : w + 50], offset) == offset


def test_radix_sort():
    rng = random.Random(2)
    rows = [bytes(rng.choice(b"ab") for _ in range(20)) for _ in range(300)] + [b"a" * 20] * 3 + [bytes([255, 0] * 10)]
    matrix = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 20)
    order, shared = op.msd(op.words(matrix))
    ordered = [rows[k] for k in order]
    assert ordered == sorted(rows)
    common = lambda a, b: next((k for k in range(20) if a[k] != b[k]), 24)
    assert shared.tolist() == [common(a, b) for a, b in zip(ordered, ordered[1:])]


def passes(pairs, bits=8, tasks=3):
    """The passes over tasks and buckets without Spark: rows like those of naive."""
    batch = lambda rows, kinds: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[str(k) for k in range(len(kinds))])
    listed = lambda batches: [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
    rows = [(i, 0, (x or "").encode()) for i, x in pairs]
    out = [r for k in range(tasks) for r in listed(op.run_pass(bits)([batch(rows[k::tasks], [pa.int64(), pa.int32(), pa.binary()])]))]
    parts, depth = {}, 0
    while out:
        for r in out:
            if r[2] == op.LOST:
                parts.setdefault(r[3], []).append(r[5])
        left = sorted((r for r in out if r[2] != op.LOST), key=lambda r: r[:3])
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
        out = listed(op.bucket_pass(bits, depth)([batch(left, kinds)])) if left else []
        depth += 1
    found = []
    for i, _, data in rows:
        cut = listed(op.cut_pass([batch([(i, 0, data, parts[i])], [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.binary())])])) if i in parts else []
        found.append((i, len(data), cut[0][2], cut[0][3], cut[0][4].hex()) if cut else (i, len(data), 0, 0, hashlib.sha256(data).hexdigest()))
    return sorted(found, key=str), depth


@pytest.mark.parametrize("seed", range(8))
def test_split_strings_many_flushes_and_long_texts(monkeypatch, seed):
    rng = random.Random(seed)
    line = "this very common line stands in many documents"
    texts = corpus(seed, 40) + [f"{rng.choice('ab') * rng.randint(0, 60)}{line}{rng.choice('cd') * rng.randint(0, 60)}" for _ in range(40)]
    pairs = list(enumerate(texts))
    rng.shuffle(pairs)
    for name, values in (("SPLIT", [64, 2, 1]), ("HELD", [500_000, 300, 40]), ("SEGMENT", [1 << 20, 211])):
        monkeypatch.setattr(op, name, values[seed % len(values)])
    got, depth = passes(pairs)
    assert got == naive(pairs) and (depth > 2) == (seed % 3 > 0)


def test_query(spark):
    d = "/root/testdata/sf0.001"
    pairs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in op5_suffix_dedup(spark, d).collect()), key=str)
    assert got == naive(pairs)
    assert sum(r[2] for r in got) > 0
