"""Rows without an id go through the pipeline's stages like any others."""

from graphloom.llm.decontaminate import drop_contaminated
from graphloom.llm.exact_dedup import drop_exact_copies
from graphloom.llm.simhash import drop_near_duplicates

A, B, C, PASSAGE = ("word%s " * 40 % tuple(f"{x}{k}" for k in range(40)) for x in "abcp")


def rows(frame):
    return sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in frame.collect())


def test_exact_copies(docs_of):
    one = docs_of([(None, A), (1, A), (2, C), (None, B), (3, C)])
    assert rows(drop_exact_copies(one)) == [(False, 1, A), (False, 2, C), (True, 0, B)]
    many = docs_of([(None, A), (1, A), (None, A), (None, B), (None, B)])
    assert rows(drop_exact_copies(many)) == [(False, 1, A), (True, 0, B)]


def test_near_copies(docs_of):
    got = rows(drop_near_duplicates(docs_of([(None, A.upper()), (5, A), (None, B), (None, B.upper()), (None, B), (10, C), (9, C.upper())])))
    assert got[:2] == [(False, 5, A), (False, 9, C.upper())] and len(got) == 3 and got[2][2].lower() == B


def test_contaminated(docs_of, spark):
    items = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    docs = docs_of([(None, PASSAGE), (None, A), (None, None), (1, PASSAGE), (2, B)])
    left = drop_contaminated(docs, items)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == [(0, ""), (0, A), (2, B)]
