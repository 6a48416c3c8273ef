"""Trees too small for quartets, and ensembles that hold them."""

import pytest

from tetraclade.operators import kernel
from tetraclade.operators.ensemble import Ensemble


QUAD = "((ant:2,bee:1):3,(cod:1,doe:2):3);"


@pytest.mark.parametrize("dense", [512, 2])
def test_small_trees_count_nothing(spark, monkeypatch, dense):
    monkeypatch.setattr(kernel, "DENSE", dense)
    e = Ensemble(spark, {"g": ["(ant:2,bee:1);", "((ant:2,bee:1):3,cod:1);", QUAD], "h": ["(cod:1,doe:2);"]})
    rows = {(r["group"], r["topology"]): r["count"] for r in e.quartet_topology(e.quartets(count=1), strategy="relational").collect()}
    assert rows == {(g, k): int((g, k) == ("g", 0)) for g in "gh" for k in range(4)}
    assert {(r["group"], r["topology"]): r["count"] for r in e.quartet_topology(e.quartets(count=1)).collect()} == rows
    assert {r["distance"] for r in e.branch_distance("ant", "doe").collect()} == {None, 10.0}
