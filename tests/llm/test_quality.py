import random
import zlib

import numpy as np
import pytest

from graphloom.llm import quality as op
from graphloom.llm.queries import op4_quality


def test_isotonic_against_brute_force():
    rng = random.Random(1)
    for _ in range(50):
        w = [rng.randint(0, 3) for _ in range(8)]
        s = [rng.randint(0, x) for x in w]
        if not any(w):
            continue
        got = op.isotonic(w, s)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(got, got[1:]))
        # the min-max formula of isotonic regression
        want = []
        for k in range(8):
            if w[k]:
                v = max(min(sum(s[i : j + 1]) / sum(w[i : j + 1]) for j in range(k, 8) if sum(w[i : j + 1])) for i in range(k + 1) if sum(w[i : k + 1]) or True and sum(w[i:]))
                want.append(v)
        assert sorted({round(v, 9) for _, v in got}) == sorted({round(v, 9) for v in want})


def test_statistics_are_finite():
    kinds = op.byte_kinds()
    for t in ["", " \n", "a", "!", "é", "a a a\n\na", "\x00\x01", "Word. " * 50_000, "x" * 200_000, "\ud800"]:
        row = op.statistics(t, kinds)
        assert len(row) == op.N_STATS and np.isfinite(row).all()


def auc(scores, labels):
    order = np.argsort(np.array(scores), kind="stable")
    ranks = np.empty(len(order))
    values = np.array(scores)[order]
    start = 0
    for k in range(1, len(order) + 1):
        if k == len(order) or values[k] != values[start]:
            ranks[order[start:k]] = (start + k + 1) / 2
            start = k
    y = np.array(labels)
    return (ranks[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


@pytest.mark.parametrize("d", ["/root/testdata/sf0.01"])
def test_held_out_accuracy(spark, d):
    rows = {r.doc_id: r for r in op4_quality(spark, d).collect()}
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for i, r in rows.items())
    out = [(rows[r.doc_id].score, r.quality) for r in spark.read.parquet(f"{d}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert auc(*zip(*out)) > 0.97


def test_edges(spark, docs_of):
    texts = ["", None, "fine words here", "fine words here", "BAD!! BAD!!"]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = docs_of([*enumerate(texts), (None, "x")], ", score string")
    assert {r.score for r in op.score_quality(docs, none).collect()} == {1.0}
    one = spark.createDataFrame([(i, 0) for i in range(9)] + [(None, 1), (3, None)], "doc_id long, quality int")
    assert {r.score for r in op.score_quality(docs, one).collect()} == {0.0}
    two = spark.createDataFrame([(i, i % 2) for i in range(6)] * 2, "doc_id long, quality int")
    assert op.score_quality(docs, two).count() == 6
    assert op.score_quality(docs_of([]), two).count() == 0


def test_filter_keeps_what_scores_well(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    left = op.drop_low_quality(docs, labels)
    assert left.columns == docs.columns
    good = {r.doc_id for r in op4_quality(spark, d).collect() if r.predicted}
    assert {r.doc_id for r in left.collect()} == good


def test_long_texts_in_blocks(monkeypatch):
    rng, kinds = random.Random(4), op.byte_kinds()
    texts = ["", " \n\n ", "x", "Word! word w\x1cx\n\n!!!! é\n" * 30, "".join(rng.choice("aB!. \n\tü\x85") for _ in range(5000)), "a a\nb b\n" * 400, "\n" + "z" * 900 + "\n"]
    want = [op.statistics(t, kinds) for t in texts]
    for size in (7, 64, 1000):
        monkeypatch.setattr(op, "LONG", size)
        for t, w in zip(texts, want):
            np.testing.assert_allclose(op.long_statistics(t, kinds), w, rtol=1e-9, atol=1e-12)


def test_scores_against_plain_numpy(spark):
    """The whole fit again on the driver: closed-form ridge over cosine features, and isotonic regression by its min-max formula."""
    from pyspark.sql import functions as F

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = docs.select("doc_id", "text", (F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(5)) == 0).alias("aside")).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    kinds = op.byte_kinds()
    stats = np.array([op.statistics(r.text or "", kinds) for r in rows], np.float32).astype(float)
    train = np.array([r.doc_id in labels for r in rows])
    y = np.array([labels.get(r.doc_id, 0) for r in rows], float)
    aside = train & np.array([r.aside for r in rows])
    mean, spread = stats[train].mean(0), np.sqrt(np.maximum(stats[train].var(0), 1e-8)) + 1e-4
    z = np.clip((stats - mean) / spread, -6, 6)
    rng = np.random.Generator(np.random.PCG64(4))
    w, b = rng.standard_normal((op.N_STATS, op.FEATURES)) / np.sqrt(op.N_STATS), rng.uniform(0, 2 * np.pi, op.FEATURES)
    x = np.hstack([np.cos(z @ w + b) * np.sqrt(2 / op.FEATURES), z / np.sqrt(op.N_STATS), np.ones((len(z), 1))])
    fitted = train & ~aside
    a = np.vstack([x[fitted], np.sqrt(op.RIDGE * fitted.sum()) * np.eye(x.shape[1])])
    raw = x @ np.linalg.lstsq(a, np.concatenate([y[fitted], np.zeros(x.shape[1])]), rcond=None)[0]
    at = np.clip(((raw + 0.5) * op.BINS / 2).astype(int), 0, op.BINS - 1)
    used = sorted(set(at[aside]))
    n, hits = [(at[aside] == k).sum() for k in used], [y[aside][at[aside] == k].sum() for k in used]
    level = [max(min(sum(hits[i : j + 1]) / sum(n[i : j + 1]) for j in range(k, len(used))) for i in range(k + 1)) for k in range(len(used))]
    knots, values = [], []
    for v in sorted(set(np.round(level, 12))):
        own = [k for k in range(len(used)) if round(level[k], 12) == v]
        knots.append(2 * (sum(n[k] * used[k] for k in own) / sum(n[k] for k in own) + 0.5) / op.BINS - 0.5)
        values.append(v)
    knots, values = [1 / op.BINS - 0.5, *knots, 2 * (op.BINS - 0.5) / op.BINS - 0.5], [values[0], *values, values[-1]]
    want = np.clip(np.interp(raw, knots, np.clip(values, 0, 1) * 0.998 + 0.002 * (np.array(knots) + 0.5) / 2), 0, 1)
    got = {r.doc_id: r.score for r in op4_quality(spark, d).collect()}
    np.testing.assert_allclose([got[r.doc_id] for r in rows], want, atol=1e-6)


def test_statistics_by_hand():
    row = op.statistics("Aa aa! aa!!\n\nB bb", op.byte_kinds())
    n, size = 5, len("Aa aa! aa!!\n\nB bb")
    lengths = [2, 3, 4, 1, 2]
    want = [7 / size, 2 / size, 0, 3 / size, 2 / size, 0, 3 / size, 0, 0, 0, 0, np.log1p(n), np.mean(lengths), np.std(lengths), np.log1p(4), 5 / 5, 5 / np.sqrt(5), 1 / 5, 0, 4 / 4, 2 / 5, 0, 0, 2 / 5, 0, 1 / 5, np.log1p(5 / 2), 2 / 2]
    np.testing.assert_allclose(row, want)
