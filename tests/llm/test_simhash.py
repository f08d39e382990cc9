import random
import re

import numpy as np
import pytest
import xxhash

from graphloom.llm import components, simhash
from graphloom.llm.queries import op1_simhash


def naive_print(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def naive_components(ids, prints, radius=3):
    parent = list(range(len(ids)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    least = {}
    for a, i in enumerate(ids):
        least[find(a)] = min(least.get(find(a), i), i)
    return [least[find(a)] for a in range(len(ids))]


TEXTS = ["", None, " \n", "One", "one two", "ONE two THREE", "one two three", "é É x\x0by z", "same words " * 50, "w " * 3000, "\x1c a\x85b \xa0c d"]


def test_fingerprints_in_blocks(docs_of):
    rng = random.Random(2)
    texts = TEXTS + [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(1, 400))) for _ in range(50)]
    for size in (simhash.WORDS_BLOCK, 7):
        assert [simhash.fingerprint(t, size=size) for t in texts] == [naive_print(t) for t in texts]


def clustered(rng, n):
    """Random values, some dense balls around centres, and chains of small steps."""
    out = []
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 1, 5, 40])):
            out.append(x)
            y = x if rng.random() < 0.5 else out[-1]
            for _ in range(rng.randint(0, 4)):
                y ^= 1 << rng.randrange(64)
            x = y if rng.random() < 0.3 else x
            out.append(y)
    return out[:n]


def test_index_within_a_group():
    rng = random.Random(4)
    for n, pairs in ((2, 10), (300, 1000), (300, 1 << 20), (40, 1)):
        values = sorted(set(clustered(rng, n)))
        rank = lambda v: v ^ (rank(v >> 1) if v else 0)
        values.sort(key=rank)
        keys = np.zeros(len(values), np.int64)
        got = simhash.link_groups(keys, np.array(values, np.uint64).view(np.int64), 3, fanout=3, pairs=pairs)
        want = naive_components(list(range(len(values))), values)
        assert got.tolist() == want


@pytest.mark.parametrize("max_group", [simhash.MAX_GROUP, 8])
def test_links_over_groups(spark, max_group):
    values = sorted({simhash.signed(v) for v in clustered(random.Random(9), 600)})
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    root = {r.node: r.root for r in components.roots(simhash.local_links(fps, 3, max_group)).collect()}
    assert [root.get(v, v) for v in values] == naive_components(values, [v & (1 << 64) - 1 for v in values])


def test_components_of_a_chain_and_a_hub(spark):
    pairs = [(i + 1, i) for i in range(0, 40)] + [(1000 + i, 100) for i in range(50)] + [(1000 + i, 500 + i) for i in range(50)] + [(1049, 40)]
    root = {r.node: r.root for r in components.roots(spark.createDataFrame(pairs, "child long, parent long")).collect()}
    assert root == {x: 0 for p in pairs for x in p if x}
    assert components.roots(spark.createDataFrame([], "child long, parent long")).count() == 0


def test_near_duplicates(docs_of):
    base = [f"{w}" for w in "the quick brown fox jumps over a lazy dog while many other animals look on and wonder what it is all about".split()]
    texts = TEXTS + [" ".join(base * 10 + [str(k)]) for k in range(8)] + ["Same Words " * 50]
    rows = simhash.near_duplicates(docs_of(texts, ", fingerprint string")).collect()
    want = naive_components(list(range(len(texts))), [naive_print(t) for t in texts])
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{naive_print(t):016x}", c) for i, (t, c) in enumerate(zip(texts, want))}
    left = simhash.drop_near_duplicates(docs_of(texts))
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(want))
    assert simhash.near_duplicates(docs_of([])).count() == 0
    nulls = simhash.near_duplicates(docs_of([(None, "alone here now"), (None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e")])).collect()
    assert sorted((r.doc_id is None, r.component_id is None) for r in nulls) == [(False, False), (False, False), (True, False), (True, True)]


def test_query(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    ids = sorted(texts)
    want = dict(zip(ids, naive_components(ids, [naive_print(texts[i]) for i in ids])))
    assert {r.doc_id: r.component_id for r in op1_simhash(spark, d).collect()} == want
    assert len(set(want.values())) < len(ids)


def test_rounds_are_logarithmic(spark):
    n, rng = 500, random.Random(12)
    cycle = [(k, k - 1) for k in range(3, n)] + [(n - 1, 2), (n, 2)]
    places = rng.sample(range(n), n)
    tree = [(max(p), min(p)) for p in ((places[k], places[max(0, k - rng.randint(1, 3))]) for k in range(1, n))]
    for pairs in (cycle, tree):
        frame = spark.createDataFrame(pairs, "child long, parent long")
        rounds, steps = components.contracted(frame)
        nodes = {x for p in pairs for x in p}
        assert len(rounds) <= np.log2(len(nodes)) and len(rounds) + steps <= 2 * np.log2(n) + 4
        if pairs is tree:
            assert {r.node: r.root for r in components.roots(frame).collect()} == dict.fromkeys(nodes - {min(nodes)}, min(nodes))
