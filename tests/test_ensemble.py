"""Ensembles against the scalar version, invariants, deduplication, polytomies, groups."""

import itertools
import random

import generators
import numpy as np
import pytest
import scalar
from pyspark.sql import functions as F

from tetraclade.operators import frames, qed, stats, trees
from tetraclade.operators.ensemble import Ensemble
from tetraclade.operators.topology import quartet_topology
from tetraclade.plans.planner import available_strategies, quiet, silent_benchmark, use_strategy

NAMES = list("abcdefgh")
GROUPS = {"g1": generators.ensemble(9, NAMES, 1), "g0": generators.ensemble(7, NAMES, 2), "solo": generators.ensemble(1, NAMES, 3, least=8)}


@pytest.fixture(scope="module")
def ens(spark):
    return Ensemble(spark, GROUPS)


@pytest.fixture(scope="module")
def window(ens):
    return ens.quartets(q := scalar.combos(8), count=len(q))


def check(rows, groups, taxa, quartets, strategy="multifurcation"):
    want = scalar.count(groups, taxa, quartets, strategy)
    names = {tuple(taxa[i] for i in q): tuple(q) for q in quartets}
    assert len(rows) == len(quartets) * len(groups) * 4
    for r in rows:
        s = want.get((names[r["a"], r["b"], r["c"], r["d"]], r["group"], r["topology"]), [])
        assert r["count"] == len(s)
        if "steiner_sum" in r.__fields__:
            assert r["steiner_sum"] == pytest.approx(sum(s))
            if s:
                assert (r["steiner_min"], r["steiner_max"]) == (pytest.approx(min(s)), pytest.approx(max(s)))
                assert r["steiner_var"] == pytest.approx(np.var(s), abs=1e-9)
            else:
                assert r["steiner_min"] is None and r["steiner_max"] is None and r["steiner_var"] is None


@pytest.mark.parametrize("strategy", ["broadcast", "blocks", "relational"])
def test_plans_agree_with_the_definition(ens, window, strategy):
    check(quartet_topology(ens, window, True, strategy).collect(), GROUPS, ens.taxa, scalar.combos(8))


@pytest.mark.parametrize("steiner", [False, True])
def test_slices_and_blocks_of_any_size_agree(ens, window, steiner, monkeypatch):
    from tetraclade.operators import topology

    want = {tuple(r) for r in quartet_topology(ens, window, steiner, "broadcast").collect()}
    monkeypatch.setattr(topology, "BLOCK_BYTES", 2000)
    round_ = lambda rows: {tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows}
    for cube in (1 << 20, 3 * 4 * 8 * 5 * 16):
        monkeypatch.setattr(topology, "CUBE_BYTES", cube)
        assert round_(quartet_topology(ens, window, steiner, "blocks").collect()) == round_(want)


@pytest.mark.parametrize("strategy", ["zero-length-branch", "both"])
def test_zero_length_strategies(spark, strategy):
    e = Ensemble(spark, GROUPS, polytomy_strategy=strategy)
    q = scalar.combos(8)
    check(e.quartet_topology(e.quartets(q, count=len(q)), True).collect(), GROUPS, e.taxa, q, strategy)


def test_many_taxa_use_the_sparse_table(spark, monkeypatch):
    from tetraclade.operators import kernel

    names = [f"t{i:03}" for i in range(40)]
    t = generators.ensemble(6, names, 5, least=20)
    e = Ensemble(spark, {"g": t})
    q = [tuple(sorted(random.Random(i).sample(range(len(e.taxa)), 4))) for i in range(50)]
    monkeypatch.setattr(kernel, "DENSE", 4)
    payload = e.placed.select("group_idx", "slots", "gap", "depth", "poly", "rd", "variants").toArrow()
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, payload.schema) as w:
        w.write_table(payload)
    cube = kernel.count(kernel.load(sink.getvalue().to_pybytes()), np.array(q), 1, True)
    want = scalar.count({"g": t}, e.taxa, q)
    for i, x in enumerate(q):
        for k in range(4):
            s = want.get((x, "g", k), [])
            assert cube[0][i, 0, k] == len(s) and cube[1][i, 0, k] == pytest.approx(sum(s))


@pytest.mark.parametrize("strategy", ["auto", "blocks", "relational"])
@pytest.mark.parametrize("polytomies", ["multifurcation", "both"])
def test_first_names_count_as_in_whole_trees(spark, strategy, polytomies):
    # one topology under several lengths, so that the first tree's decide for all
    again = [x.replace(":0.5", ":0.75") for x in GROUPS["g1"]]
    data = GROUPS | {"g1": GROUPS["g1"] + again + again[:2], "few": ["(g:1,h:1);"]}
    whole = Ensemble(spark, data, polytomy_strategy=polytomies)
    part = whole.first(6)
    q = scalar.combos(6)
    rows = [sorted(map(repr, e.quartet_topology(e.quartets(q, count=len(q)), strategy=strategy).collect())) for e in (whole, part)]
    assert part.taxa == whole.taxa[:6] and part.groups == whole.groups and rows[0] == rows[1]
    assert part.trees.where("size(names) > 6").count() == 0 and "parent" not in part.trees.columns
    assert whole.first(100).taxa == whole.taxa and part.first(8).taxa == part.taxa


def test_lengths_over_first_names_are_those_of_whole_trees(spark):
    again = [x.replace(":0.5", ":0.75") for x in GROUPS["g1"]]
    whole = Ensemble(spark, GROUPS | {"g1": GROUPS["g1"] + again + again[:2]}, polytomy_strategy="both")
    q = scalar.combos(6)
    rows = [sorted(map(repr, e.quartet_topology(e.quartets(q, count=len(q)), True).collect())) for e in (whole, whole.first(6))]
    assert rows[0] == rows[1]


def test_first_names_need_single_copies(spark):
    with pytest.raises(ValueError):
        Ensemble(spark, GROUPS, taxon_map={"a": "x", "b": "x"}).first(4)


def test_pair_sums_are_least_for_the_winner(ens, window):
    d = {(r["tree_id"], r["i"], r["j"]): r["distance"] for r in trees.distances(ens).collect()}
    group = {r["tree_id"]: (r["group"], r["multiplicity"]) for r in ens.stored.collect()}
    seen = {}
    for t in {k[0] for k in d}:
        for q in scalar.combos(8):
            a, b, c, e = q
            if all((t, x, y) in d for x, y in itertools.combinations(q, 2)):
                s = [d[t, a, b] + d[t, c, e], d[t, a, c] + d[t, b, e], d[t, a, e] + d[t, b, c]]
                seen.setdefault((q, group[t][0]), []).append((s, group[t][1]))
    for r in quartet_topology(ens, window).where("count > 0 and topology < 3").collect():
        q = tuple(ens.taxa.index(r[x]) for x in "abcd")
        fits = sum(m for s, m in seen[q, r["group"]] if s[r["topology"]] <= min(s) + 1e-9)
        assert fits >= r["count"]


def test_distances_are_a_metric(ens):
    d = {}
    for r in trees.distances(ens).collect():
        d[r["tree_id"], r["i"], r["j"]] = d[r["tree_id"], r["j"], r["i"]] = r["distance"]
    for (t, i, j), x in d.items():
        assert x >= 0
        for k in range(8):
            if (t, i, k) in d and (t, k, j) in d:
                assert x <= d[t, i, k] + d[t, k, j] + 1e-9


def test_branch_distance(ens):
    for x, y in (("a", "b"), ("h", "c"), ("d", "d")):
        got = {r["tree_id"]: r["distance"] for r in ens.branch_distance(x, y).collect()}
        stored = {r["tree_id"]: r for r in ens.stored.collect()}
        assert got.keys() == stored.keys()
        for t, text in enumerate(tx for g in sorted(GROUPS) for tx in GROUPS[g]):
            if t in got:
                s = scalar.Scalar(text)
                if x in s.names and y in s.names:
                    u, v = s.names.index(x), s.names.index(y)
                    assert got[t] == pytest.approx(s.rd[u] + s.rd[v] - 2 * s.rd[s.lca(u, v)])
                else:
                    assert got[t] is None
    with pytest.raises(KeyError):
        ens.branch_distance("a", "nobody")


def test_nodes_and_multi_lca(ens):
    n = trees.nodes(ens.trees)
    rows = n.where("tree_id = 0").orderBy("node_id").collect()
    text = GROUPS["g0"][0]
    s = scalar.Scalar(text)
    assert [r["root_distance"] for r in rows] == pytest.approx([s.rd[v] for v in range(len(rows))])
    assert [r["name"] for r in rows if r["is_leaf"]] == s.names and rows[-1]["parent"] is None and rows[0]["left"] is None
    members = n.where("is_leaf and node_id in (0, 2, 3)").select("tree_id", F.lit(1).cast("bigint").alias("set_id"), "node_id")
    from tetraclade.sources.newick import parse

    for r in trees.multi_lca(n, members).collect():
        t = parse([tx for g in sorted(GROUPS) for tx in GROUPS[g]][r["tree_id"]])
        top, length = t.multi_lca([0, 2, 3])
        assert r["lca"] == top and r["steiner"] == pytest.approx(length)


def test_copies_multiply(spark):
    t = generators.ensemble(3, NAMES, 9, least=8)
    q = scalar.combos(8)
    one, five = Ensemble(spark, {"g": t}), Ensemble(spark, {"g": t * 5})
    a = {tuple(r[:8]): r for r in one.quartet_topology(one.quartets(q, count=70), True).collect()}
    for r in five.quartet_topology(five.quartets(q, count=70), True).collect():
        x = a[tuple(r[:8])]
        assert r["count"] == 5 * x["count"] and r["steiner_sum"] == pytest.approx(5 * x["steiner_sum"])
        assert r["steiner_min"] == x["steiner_min"] and r["steiner_max"] == x["steiner_max"]
    assert five.stored.agg(F.sum("multiplicity")).first()[0] == 15 and five.stored.count() <= 3


def test_variants_share_a_topology(spark):
    e = Ensemble(spark, {"g": ["((p:1,q:2):1,(r:3,s:4):1);", "((p:9,q:1):2,(r:2,s:5):3);", "((p:1,q:2)0.5:1,(r:3,s:4)0.7:1);"], "h": ["((p:1,q:2):1,(r:3,s:4):1);"]})
    rows = {r["group"]: r for r in e.stored.collect()}
    assert [v["multiplicity"] for v in rows["g"]["variants"]] == [2, 1] and rows["g"]["multiplicity"] == 3 and rows["h"]["multiplicity"] == 1
    got = {r["group"]: r for r in e.quartet_topology(e.quartets(count=1), True).where("topology = 0").collect()}
    assert got["g"]["count"] == 3 and got["g"]["steiner_sum"] == 12 + 12 + 22 and got["g"]["steiner_max"] == 22


def test_namespace_groups_and_guards(spark, ens):
    assert ens.taxa == NAMES and ens.groups == ["g0", "g1", "solo"] and ens.n_trees == 17
    assert [r["name"] for r in ens.taxa_table().orderBy("gid").collect()] == NAMES
    assert len(Ensemble(spark, GROUPS["g1"]).groups[0]) == 10
    with pytest.raises(ValueError, match="repeats"):
        Ensemble(spark, ["((x:1,x:1):1,(y:1,z:1):1);"])
    with pytest.raises(ValueError):
        Ensemble(spark, GROUPS, polytomy_strategy="other")
    with pytest.raises(TypeError):
        ens.quartet_topology([(0, 1, 2, 3)])
    with pytest.raises(ValueError):
        ens.quartet_topology(ens.quartets(count=1), strategy="other")


def test_overrides(ens, window):
    with silent_benchmark("broadcast"):
        assert ens.quartet_topology(window).count() == 70 * 12
    with use_strategy("relational"), quiet():
        plan = ens.quartet_topology(window)._jdf.queryExecution().toString()
    assert "Join" in plan and "auto" in available_strategies()
    with pytest.raises(ValueError), use_strategy("other"):
        pass


def test_repeated_quartets_and_order(ens):
    q = [(0, 1, 2, 3), (4, 5, 6, 7), (0, 1, 2, 3)]
    rows = ens.quartet_topology(ens.quartets(q, count=3)).collect()
    by = {}
    for r in rows:
        by.setdefault(r["qi"], {})[r["group"], r["topology"]] = r["count"]
    assert by[0] == by[2] and len(rows) == 36
    t = ens.quartet_topology(ens.quartets(q, count=3))
    assert frames.topology_frame(t, ens.groups).count() == 24 and frames.topology_frame(t, ens.groups, deduplicate=False).count() == 36
    assert frames.topology_frame(t, ens.groups, "wide").count() == 2 and frames.topology_frame(t, ens.groups, "wide", False).count() == 3
    with pytest.raises(ValueError):
        frames.topology_frame(t, ens.groups, "square")


def test_scores_follow_the_definition(ens, window):
    t = ens.quartet_topology(window)
    counts = {}
    for r in t.where("topology < 3").collect():
        counts.setdefault((r["qi"], r["group"]), [0, 0, 0])[r["topology"]] = r["count"]
    rows = qed.qed(t, ens.groups).collect()
    assert len(rows) == 70 * 3
    for r in rows:
        assert r["qed"] == pytest.approx(scalar.qed(counts[r["qi"], r["group_a"]], counts[r["qi"], r["group_b"]]))
    cube = np.array([[counts[i, g] for g in ens.groups] for i in range(70)])
    assert (frames.dense_counts(t, ens.groups)[:, :, :3] == cube).all()
    many = [(x, y) for x in ens.groups for y in ens.groups] * 8
    assert qed.qed(t, ens.groups, many).count() == 70 * len(many)
    got = {(r["qi"], r["group_a"], r["group_b"]): r["qed"] for r in rows}
    pairs = list(itertools.combinations(range(3), 2))
    for i, row in enumerate(qed.qed_array(cube, pairs)):
        for (g, h), x in zip(pairs, row):
            assert x == pytest.approx(got[i, ens.groups[g], ens.groups[h]])
    assert qed.mean_qed(qed.qed(t, ens.groups)).first()[0] == pytest.approx(np.mean(list(got.values())))
    own = qed.qed(t, ens.groups, [("solo", "g0"), (1, 1)]).select("group_a", "group_b").distinct().collect()
    assert {tuple(r) for r in own} == {("solo", "g0"), ("g1", "g1")}
    for bad in ([("g0", "other")], [(0, 3)], [(0, 1, 2)]):
        with pytest.raises(ValueError):
            qed.qed(t, ens.groups, bad)
    assert qed.qed(t, ["g0"]).count() == 0 and qed.mean_qed(qed.qed(t, ["g0"])).first()[0] == 0.0
    wide = frames.qed_frame(qed.qed(t, ens.groups), qed.default_pairs(ens.groups), "wide")
    assert "g0_vs_solo" in wide.columns and wide.count() == 70
    assert frames.topology_with_qed(t, qed.qed(t, ens.groups)).count() == 70 * 12 * 3


def test_known_scores():
    one = lambda x, y: qed.qed_array(np.array([[x, y]]), [(0, 1)])[0, 0]
    assert one([0, 3, 3], [0, 0, 6]) == pytest.approx(-0.6845351232) and one([4, 0, 0], [1, 1, 0]) == pytest.approx(0.6845351232)
    assert one([1, 1, 1], [1, 1, 1]) == pytest.approx(1 / 3) and one([2, 1, 0], [1, 2, 0]) == pytest.approx(-0.3915243349)
    assert one([0, 0, 0], [1, 0, 0]) == 0 and one([2, 0, 0], [5, 0, 0]) == 1


def test_statistics(ens):
    names = {g: [set(scalar.Scalar(t).names) for t in v] for g, v in GROUPS.items()}
    for r in stats.group_coverage(ens).collect():
        union = set().union(*names[r["group"]])
        share = [len(x) / len(union) for x in names[r["group"]]]
        assert r["n_taxa"] == len(union) and r["mean_coverage"] == pytest.approx(np.mean(share)) and r["min_coverage"] == pytest.approx(min(share))
    assert stats.group_jaccard(ens).count() == 3
    one = stats.taxa_per_tree(ens).first()
    assert one["n_trees"] == 17 and one["mean_taxa_per_tree"] == pytest.approx(np.mean([len(x) for v in names.values() for x in v]))
    assert stats.polytomy_stats(ens).count() == 3 and stats.memory_footprint(ens).agg(F.sum("bytes")).first()[0] > 0
    assert any("multifurcations" in w for w in stats.warnings(ens))
    assert trees.tree_stats(ens.trees).where("n_nodes = 2 * n_leaves - 1").count() == 17
    assert frames.mean_steiner(ens.quartet_topology(ens.quartets(count=2), True)).where("count = 0 and steiner_mean <> 0").count() == 0
