import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from graphloom.llm import quality  # noqa: E402
from graphloom.llm.queries import op4_quality  # noqa: E402
from graphloom.sources.work import work_dir  # noqa: E402
from tests.llm import test_decontaminate, test_exact_dedup, test_simhash, test_tokens  # noqa: E402

D = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    names = docs.columns
    kept = {r.doc_id: r.text for r in docs.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, D)
        if k == 4:
            test_tokens.check_packing(out.collect(), kept)
            break
        assert out.columns == names
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        got = {r.doc_id: r.text for r in docs.collect()}
        if k == 0:
            want = {r.doc_id for r in op4_quality(spark, D).collect() if r.score >= quality.THRESHOLD}
        elif k == 1:
            want = {i for i, _, _, stays, _ in test_exact_dedup.naive(sorted(kept.items())) if stays}
        elif k == 2:
            ids = sorted(kept)
            want = set(test_simhash.naive_components(ids, [test_simhash.naive_print(kept[i]) for i in ids]))
        else:
            want = {i for i, t in kept.items() if not test_decontaminate.naive(t, items)[-1]}
        assert set(got) == want, name
        assert all(got[i] == kept[i] for i in got)
        kept = got
    held = set(os.listdir(work_dir(spark)))
    run = corpus_pipeline.run(spark, D).collect()
    assert [f.partition("-")[0] for f in set(os.listdir(work_dir(spark))) - held] == ["stage"]
    test_tokens.check_packing(run, kept)


LONG = "word and more " * 40_000


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_rows(spark, tmp_path, empty):
    texts = ["", None, "fine words stand here in a row", "fine words stand here in a row", "fine  words stand here in a row", LONG, LONG + "end", "BAD!! BAD!! BAD!!", "\x00 é  ", "one"]
    rows = [(i if i != 9 else None, t, None, None, None, "a", "b", i, None) for i, t in enumerate(texts)] + [(2, texts[2], "en", "s", 1, None, None, None, 0.5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, label string, row long, score double"
    spark.createDataFrame([] if empty else rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i != 7), None) for i in range(8)] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one"), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    before = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == before.columns
        assert out.count() <= docs.count()
        out.write.parquet(f"{tmp_path}/{stage.__name__}")
        docs = spark.read.parquet(f"{tmp_path}/{stage.__name__}")
    left = docs.collect()
    assert sum(r.text == texts[2] for r in left) <= 1
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in left} and (empty or len(left) >= 3)
