"""Paralog slots and search, the consensus tree, and counts over streams."""

import itertools
import random

import generators
import pytest
import scalar
from pyspark.sql import functions as F

from tetraclade.functions.quartets import Quartets
from tetraclade.operators import paralog
from tetraclade.operators.consensus import ConsensusGraph
from tetraclade.operators.ensemble import Ensemble
from tetraclade.streaming.counts import streaming_counts, tree_topologies

MAP = {f"{g}{i}": g for g in "GH" for i in (1, 2)}

EIGHT = "(" + ",".join("((%s,%s),(%s,%s))" % tuple(x) for x in ("ABCD", "EFGH")) + ");"


def four(a, b, c, d):
    """Two pairs, unit lengths."""
    return f"(({a}:1,{b}:1):1,({c}:1,{d}:1):1);"


@pytest.fixture(scope="module")
def mul(spark):
    names = ["A", "B", "C", "G1", "G2", "H1", "H2"]
    rng = random.Random(4)
    one = [generators.balanced(names, rng) for _ in range(4)]
    return Ensemble(spark, {"x": one + [four("A", "B", "C", "G1")], "y": [generators.caterpillar(names, rng) for _ in range(4)]}, taxon_map=MAP)


def test_slots(mul):
    assert mul.taxa == ["A", "B", "C", "G_copy0", "G_copy1", "H_copy0", "H_copy1"] and mul.paralogs == {"G": 2, "H": 2}
    rows = paralog.assignments(mul).collect()
    assert len(rows) == 4 * mul.stored.count()
    for t in {r["tree_id"] for r in rows}:
        g = {r["copy"]: r["leaf_id"] for r in rows if r["tree_id"] == t and r["genome"] == "G"}
        assert g[0] is not None and (g[1] is None or g[0] < g[1])


def test_delta_is_the_difference_of_full_passes(mul):
    q = mul.quartets(c := scalar.combos(7), count=len(c))
    before = {(r["qi"], r["group"], r["topology"]): r["count"] for r in mul.quartet_topology(q).collect()}
    after = {(r["qi"], r["group"], r["topology"]): r["count"] for r in paralog.permuted(mul, "G", (1, 0)).quartet_topology(q).collect()}
    delta = {(r["qi"], r["group"], r["topology"]): r["delta"] for r in paralog.counts_delta(mul, q, "G", (1, 0)).collect()}
    assert delta == {k: after[k] - v for k, v in before.items() if after[k] != v} and delta
    twice = paralog.permuted(paralog.permuted(mul, "G", (1, 0)), "G", (1, 0))
    assert {(r["qi"], r["group"], r["topology"]): r["count"] for r in twice.quartet_topology(q).collect()} == before
    with pytest.raises(ValueError):
        paralog.permuted(mul, "A", (0,))
    with pytest.raises(ValueError):
        paralog.permuted(mul, "G", (0, 0))


def test_permutation_scores_equal_full_passes(mul):
    from tetraclade.operators.qed import mean_qed, qed

    q = mul.quartets(c := scalar.combos(7), count=len(c))
    got = paralog.permutation_scores(mul, q, "H", [(0, 1), (1, 0)])
    for p, x in got.items():
        e = paralog.permuted(mul, "H", p)
        assert x == pytest.approx(mean_qed(qed(e.quartet_topology(q), e.groups)).first()[0])


def test_search_raises_the_score(spark):
    good = four("A", "G1", "B", "G2")
    e = Ensemble(spark, {"p": [good] * 3 + [good], "q": [four("B", "G1", "A", "G2")] * 4}, taxon_map={k: v for k, v in MAP.items() if v == "G"})
    q = e.quartets(count=1)
    best, topology, r = paralog.resolve(e, q)
    assert r.converged and r.qed_history == sorted(r.qed_history) and len(r.qed_history) == r.n_iterations + 1
    assert topology.count() == 8 and best.taxa == e.taxa
    with pytest.raises(ValueError):
        paralog.optimize(Ensemble(spark, [four("A", "B", "C", "D")]), q)


def test_touched_quartets(mul):
    q = mul.quartets(c := scalar.combos(7), count=len(c))
    got = {(r["genome"], r["qi"]) for r in paralog.quartet_index(mul, q).collect()}
    assert got == {(g, i) for i, x in enumerate(c) for g, ids in (("G", {3, 4}), ("H", {5, 6})) if ids & set(x)}


# consensus


def test_quartets_that_test_a_branch():
    taxa = list("ABCDEFGH")
    g = ConsensusGraph(EIGHT, taxa, zero_eps=0)
    assert len(g.active_branch_ids) == 5
    sizes = sorted(g.n_qsupp(b) for b in g.active_branch_ids)
    assert sizes == [8, 8, 8, 8, 16]
    small = ConsensusGraph("((A,B),(C,D));", list("ABCD"), zero_eps=0)
    assert [small.n_qsupp(b) for b in small.active_branch_ids] == [1]
    rng = random.Random(1)
    for b in g.active_branch_ids:
        sides = [{g.order[p] for c in s for lo, hi in c for p in range(lo, hi + 1)} for s in g.sides(b)]
        for q, k in g.sample_quartets(b, 20, rng):
            pair = {q[0], q[k + 1]}
            assert pair <= sides[0] or pair <= sides[1]
            assert len(sides[0] & set(q)) == 2
    assert g.sample_quartets(min(g.active_branch_ids), 0, rng) == []


def test_pruning(spark):
    taxa = list("ABCDEFGH")
    g = ConsensusGraph(EIGHT, taxa, zero_eps=0)
    table = g.branch_table(spark).collect()
    assert len(table) == 5
    b = next(b for b in g.active_branch_ids if {g.order[p] for p in range(g.span[g.branches[b].child][0], g.span[g.branches[b].child][1] + 1)} == {0, 1})
    dirty = g.prune(b)
    assert b not in g.active_branch_ids and dirty <= g.active_branch_ids and len(g.active_branch_ids) == 4
    with pytest.raises(AssertionError):
        g.prune(b)
    again = ConsensusGraph(g.to_newick(), taxa, zero_eps=0)
    assert sorted(again.n_qsupp(x) for x in again.active_branch_ids) == sorted(g.n_qsupp(x) for x in g.active_branch_ids)
    for b in list(g.active_branch_ids):
        g.prune(b)
    assert sorted(g.to_newick().strip("();").split(",")) == taxa


def test_collapse_and_errors():
    assert ConsensusGraph("((A:1,B:1):0,(C:1,D:1):0,E:1);", list("ABCDE")).active_branch_ids == set()
    assert len(ConsensusGraph("((A:1,B:1):0,(C:1,D:1):0.5,E:1);", list("ABCDE")).active_branch_ids) == 1
    for text, taxa in (("((A,B),C);", "ABC"), ("((A,B),(C,D));", "ABCDE"), ("((A,B),(C,X));", "ABCD"), ("((A,B),(C,));", "ABCD"), ("((A,B),(C,D);", "ABCD")):
        with pytest.raises((ValueError, IndexError)):
            ConsensusGraph(text, list(taxa), zero_eps=0)
    deep = [f"t{i}" for i in range(3000)]
    assert len(ConsensusGraph(generators.caterpillar(deep, random.Random(2)), deep).order) == 3000


def test_support_of_a_tree_by_itself(spark):
    text = f"({four(*'ABCD')[:-1]}:1,{four(*'EFGH')[:-1]}:1);"
    e = Ensemble(spark, {"g": [text] * 3})
    rows = ConsensusGraph(text, e.taxa).support(e, 10, random.Random(3)).collect()
    assert len(rows) == 5 and all(r["support"] == 1.0 for r in rows)


# streams


def test_stream_ends_at_the_batch_result(spark, tmp_path):
    names = list("abcdef")
    groups = {"g": generators.ensemble(6, names, 1), "h": generators.ensemble(5, names, 2)}
    q = Quartets(names, scalar.combos(6), 0, 15)
    e = Ensemble(spark, groups)
    rows = [(g, t) for g, v in groups.items() for t in v]
    for i in range(0, len(rows), 3):
        spark.createDataFrame(rows[i : i + 3], "group string, newick string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("group string, newick string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = streaming_counts(stream, q).writeStream.outputMode("complete").format("memory").queryName("quartet_counts").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    got = {(r["group"], r["qi"], r["topology"]): (r["count"], round(r["steiner_sum"], 9)) for r in spark.table("quartet_counts").collect()}
    want = {(r["group"], r["qi"], r["topology"]): (r["count"], round(r["steiner_sum"], 9)) for r in e.quartet_topology(q, True).where("count > 0").collect()}
    if e.taxa == names:
        assert got == want
    batch = tree_topologies(spark.createDataFrame(rows, "group string, newick string"), q)
    assert batch.groupBy("group", "qi", "topology").count().count() == len(got)


def test_windowed_stream(spark, tmp_path):
    names = list("abcd")
    t = four(*"abcd")
    rows = [("g", t, f"2024-01-01 00:0{m}:00") for m in (0, 1, 6)]
    df = spark.createDataFrame(rows, "group string, newick string, ts string").select("group", "newick", F.to_timestamp("ts").alias("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = Quartets(names, count=1)
    query = streaming_counts(stream, q, ("5 minutes",)).writeStream.outputMode("update").format("memory").queryName("windowed").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r["group"], r["topology"], r["count"]) for r in spark.table("windowed").collect()) == [("g", 0, 1), ("g", 0, 2)]


def test_all_permutations_are_enumerable():
    assert len(list(itertools.permutations(range(3)))) == 6
