"""Chains longer than any default bound."""

import pytest

from graphloom.operators import shapes, traverse
from graphloom.operators.shapes import Constraint, Path, PropertyShape, Shape, predicate
from graphloom.plans import reason
from graphloom.sources.graph import from_rows

N = 54


@pytest.fixture(scope="module")
def chain(spark):
    nodes = [{"labels": ["Entity"], "id": f"n{k}", "code": f"n{k}"} for k in range(N)]
    return from_rows(spark, nodes, [{"src": f"n{k}", "rel_type": "part", "dst": f"n{k + 1}", "action_type": "inference"} for k in range(N - 1)])


def start(spark, k=0):
    return spark.createDataFrame([(f"n{k}",)], "node_id string")


def test_inference_closure_has_no_end(spark, chain):
    assert traverse.inference_closure(chain, start(spark)).count() == N
    assert traverse.inference_closure(chain, start(spark, N - 4), 3).count() == 4
    with pytest.raises(RuntimeError, match="max_hops=2"):
        traverse.inference_closure(chain, start(spark, N - 4), 2)


def test_steps_go_beyond_twenty(spark, chain):
    assert reason.reason_on_nodes(chain, start(spark, N - 24)).steps.count() == 24
    with pytest.raises(RuntimeError, match="max_hops=1"):
        reason.reason_on_nodes(chain, start(spark, N - 3), max_hops=1)


def test_repeated_paths_have_no_end(spark, chain):
    shape = Shape("S", (("class", "Entity"),), (PropertyShape(Path("one_or_more", (predicate("part"),)), (Constraint("max_count", N - 2),)),))
    assert [r.focus for r in shapes.validate(chain, [shape]).collect()] == ["n0"]
