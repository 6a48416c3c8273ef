"""Plans that stay narrow, variants as rows, deltas, identifiers and small helpers."""

import itertools
import logging
import random
import warnings

import numpy as np
import pytest
from generators import balanced, caterpillar
from pyspark.sql import functions as F

import tetraclade
from tetraclade import Ensemble, parse
from tetraclade.functions.quartets import unrank, unrank_array
from tetraclade.operators import frames, paralog, topology
from tetraclade.operators.qed import qed, quartet_qed


@pytest.fixture(scope="module")
def trees():
    rng = random.Random(5)
    names = [f"t{i}" for i in range(9)]
    return {g: [(balanced if rng.random() < 0.5 else caterpillar)(rng.sample(names, rng.randint(5, 9)), rng) for _ in range(12)] for g in "xyz"}


def rows(df):
    return sorted(repr(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in df.collect())


def window(ens):
    q = list(itertools.combinations(range(len(ens.taxa)), 4))
    return ens.quartets(q, 0, len(q))


def test_scores_and_wide_rows_from_the_kernel(spark, trees):
    ens = Ensemble(spark, trees)
    w = window(ens)
    long = ens.quartet_topology(w, steiner=True)
    narrow = quartet_qed(ens, w)
    assert rows(narrow) == rows(qed(long, ens.groups))
    assert rows(quartet_qed(ens, w, [("z", "x"), (1, 1)])) == rows(qed(long, ens.groups, [("z", "x"), (1, 1)]))
    with pytest.raises(ValueError):
        quartet_qed(ens, w, [("x", "nobody")])
    for steiner in (False, True):
        wide = tetraclade.topology_wide(ens, w, steiner)
        other = frames.topology_frame(long if steiner else long.select("qi", "quartet_idx", *"abcd", "group", "topology", "count"), ens.groups, "wide")
        assert rows(wide.select(*other.columns)) == rows(other)
        assert "Exchange" not in wide._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in narrow._jdf.queryExecution().executedPlan().toString()
    with tetraclade.use_strategy("blocks"):
        assert rows(quartet_qed(ens, w)) == rows(narrow) and tetraclade.current_strategy() == "blocks"


def test_splits_follow_the_single_tree_rule(spark, trees):
    ens = Ensemble(spark, trees)
    w = window(ens)
    got = tetraclade.tree_splits(ens, w, return_steiner=True).collect()
    text = {r["tree_id"]: r for r in ens.trees.select("tree_id", "names").collect()}
    source = {i: t for i, t in enumerate(t for g in sorted(trees) for t in trees[g])}
    q, seen = w.to_numpy(), 0
    for r in got[::7]:
        t = parse(source[r["tree_id"]])
        names = [ens.taxa[i] for i in q[r["qi"]]]
        pairing, steiner = t.split(*names, return_steiner=True)
        # the number tells which of the other taxa, in order of their ids, goes with the first
        first = next(p for p in (pairing[:2], pairing[2:]) if t.node(names[0]) in p)
        (partner,) = [n for n in names[1:] if t.node(n) in first]
        strict = len({round(x, 9) for x in _sums(t, names)}) > 1 and sorted(_sums(t, names))[-1] > sorted(_sums(t, names))[-2] + 1e-12
        if strict:
            assert r["topology"] == names[1:].index(partner)
        else:
            assert r["topology"] == 2
        assert r["steiner"] == pytest.approx(steiner)
        seen += 1
    assert seen > 100 and set(text) >= {r["tree_id"] for r in got}


def _sums(t, names):
    a, b, c, d = (t.node(n) for n in names)
    r = t.rd
    return [r[t.lca(a, b)] + r[t.lca(c, d)], r[t.lca(a, c)] + r[t.lca(b, d)], r[t.lca(a, d)] + r[t.lca(b, c)]]


def test_many_lengths_of_one_topology(spark):
    n = 20_000
    source = spark.range(n).select(F.col("id").alias("tree_id"), F.lit("g").alias("group"), F.concat(F.lit("((a:"), (F.col("id") + 1).cast("string"), F.lit(",b:1):1,(c:1,d:1):1);")).alias("newick"))
    ens = Ensemble(spark, source)
    w = ens.quartets([(0, 1, 2, 3)], 0, 1)
    assert ens.topologies.count() == 1 and ens.variants.count() == n and ens.topologies.first()["n_variants"] == n
    sizes = [r[0] for r in ens.measured().select(F.size("variants")).collect()]
    assert sum(sizes) == n and max(sizes) < 4 * 64 and "variants" not in ens.seated.columns
    r = ens.quartet_topology(w, steiner=True).where("count > 0").first()
    assert (r["count"], r["steiner_min"], r["steiner_max"]) == (n, 6.0, n + 5.0) and r["steiner_sum"] == pytest.approx(sum(range(1, n + 1)) + 5 * n)
    assert ens.quartet_topology(w).where("topology = 0").first()["count"] == n


def test_repeated_tree_identifiers(spark):
    two = spark.createDataFrame([(1, "g", "((a,b),(c,d));"), (1, "g", "((a,c),(b,d));"), (2, "g", "((a,b),(c,d));")], "tree_id bigint, group string, newick string")
    with pytest.raises(ValueError, match="tree_id 1"):
        Ensemble(spark, two)
    ens = Ensemble(spark, two, checked=False)
    w = ens.quartets([(0, 1, 2, 3)], 0, 1)
    for strategy in ("broadcast", "blocks"):
        assert [r["count"] for r in ens.quartet_topology(w, strategy=strategy).orderBy("topology").collect()] == [2, 1, 0, 0]


def test_files_have_unique_identifiers(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"f{k}.nwk").write_text("# head\n\n" + "((a,b),(c,d));\n" * 3)
    for read in (tetraclade.read_trees, tetraclade.read_lines):
        got = read(spark, str(tmp_path)).collect()
        assert len({r["tree_id"] for r in got}) == len(got) == 15 and {r["group"] for r in got} == {f"f{k}.nwk" for k in range(5)}


def mul(spark, size=14, groups="AB"):
    rng = random.Random(9)
    source = {}
    for g in groups:
        source[g] = []
        for _ in range(size):
            names = ["p", "q", "r", "s", "G1", "G2", "H1", "H2", "H3"]
            source[g].append(caterpillar(rng.sample(names, rng.randint(6, 9)), rng))
    return Ensemble(spark, source, taxon_map={"G1": "G", "G2": "G", "H1": "H", "H2": "H", "H3": "H"})


def test_delta_is_the_difference_of_two_passes(spark, monkeypatch):
    ens = mul(spark)
    w = window(ens)
    counted = ens.quartet_topology(w)
    for size in (topology.BLOCK_BYTES, 2000):
        monkeypatch.setattr(paralog, "BLOCK_BYTES", size)
        for genome, perm in (("G", (1, 0)), ("H", (2, 0, 1)), ("H", (1, 0, 2))):
            delta = paralog.counts_delta(ens, w, genome, perm)
            after = paralog.permuted(ens, genome, perm).quartet_topology(w).withColumnRenamed("count", "n")
            keys = ["qi", "group", "topology"]
            want = counted.join(after.select(*keys, "n"), keys).select(*keys, (F.col("n") - F.col("count")).alias("delta")).where("delta <> 0")
            assert rows(delta.select(*keys, "delta")) == rows(want) and want.count()
            new, moved = tetraclade.apply_swap(ens, w, counted, genome, perm)
            assert rows(moved.select(*keys, "count")) == rows(new.quartet_topology(w).select(*keys, "count"))
            score = tetraclade.evaluate_swap(ens, w, genome, perm)
            assert score == pytest.approx(paralog.mean_score(new, w))
    assert paralog.counts_delta(ens, w, "G", (0, 1)).count() == 0
    for bad in (("p", (0,)), ("G", (0, 0))):
        with pytest.raises(ValueError):
            paralog.counts_delta(ens, w, *bad)


def test_a_permutation_and_its_inverse(spark):
    ens = mul(spark, 6)
    w = ens.quartets(None, 0, 60)
    back = paralog.permuted(paralog.permuted(ens, "H", (2, 0, 1)), "H", (1, 2, 0))
    assert rows(back.quartet_topology(w)) == rows(ens.quartet_topology(w))
    assert paralog.permuted(ens, "H", (0, 1, 2)) is ens


def test_broadcast_is_refused_beyond_its_size(spark, trees, monkeypatch, caplog):
    ens = Ensemble(spark, trees)
    w = window(ens)
    want = rows(ens.quartet_topology(w))
    monkeypatch.setattr(topology, "BROADCAST_BYTES", 100)
    with caplog.at_level(logging.WARNING, "tetraclade"):
        assert rows(ens.quartet_topology(w, strategy="broadcast")) == want
    assert "blocks" in caplog.text
    monkeypatch.setattr(topology, "CUBE_BYTES", 20_000)
    monkeypatch.setattr(topology, "BLOCK_BYTES", 4000)
    assert rows(ens.quartet_topology(w)) == want
    assert rows(ens.quartet_topology(w, steiner=True)) == rows(ens.quartet_topology(w, steiner=True, strategy="relational"))


def test_ranks_of_arrays():
    rng = random.Random(3)
    r = np.array([rng.randrange(1 << b) for b in range(1, 62) for _ in range(20)])
    assert unrank_array(r).tolist() == [list(unrank(int(x))) for x in r]
    with pytest.raises(ValueError):
        unrank_array(np.array([-1]))


def test_session_controls(spark, trees, caplog):
    with tetraclade.suppress_logger() as logger, warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        with tetraclade.suppress_warnings(UserWarning):
            warnings.warn("quiet", UserWarning, stacklevel=1)
        assert logger.level == logging.ERROR and not seen
    with caplog.at_level(logging.INFO, "tetraclade"):
        tetraclade.log_statistics(Ensemble(spark, trees))
    assert "36 trees in 3 groups" in caplog.text and "group y: 12 trees" in caplog.text
    assert all(hasattr(tetraclade, name) for name in tetraclade.__all__)


@pytest.mark.parametrize("name", ["quartet_counts_crowd", "quartet_steiner_crowd"])
def test_crowds_keep_ten_names(spark, sf_dir, monkeypatch, name):
    from tetraclade.functions import quartets
    from tetraclade.plans import queries

    monkeypatch.setattr(quartets, "WIDE_FROM", 100)  # as with 86,000 customers
    seen = []
    whole = queries.quartet_topology
    monkeypatch.setattr(queries, "quartet_topology", lambda ens, *x: seen.append(ens) or whole(ens, *x))
    df = queries.QUERIES[name](spark, sf_dir)
    assert dict(df.dtypes)["quartet_idx"] == "bigint" and df.count() == 840
    assert len(seen[0].taxa) == 10 and seen[0].trees.where("size(names) > 10").count() == 0
    assert seen[0].trees.where("n_leaves > 100").count() == 3


def test_variances_of_crowds_are_rounded_as_in_sql(spark, sf_dir, monkeypatch):
    from tetraclade.plans import queries

    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(7)
    values = [218380972656.25, 925068485396.2228, 0.0000005, 2 / 9, 0.1234565, None]
    values += [rng.random() * 10**k for k in range(-7, 15) for _ in range(20)] + [rng.randrange(1 << k) / 9 for k in range(1, 60) for _ in range(10)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "qi int, steiner_var double").withColumn("id", F.col("qi"))
    monkeypatch.setattr(queries, "quartet_topology", lambda *x: df)
    got = {r["id"]: r["steiner_var"] for r in queries.QUERIES["quartet_steiner_crowd"](spark, sf_dir).collect()}
    want = [duckdb.execute("SELECT round(CAST(? AS DOUBLE), 6)", [x]).fetchone()[0] for x in values]
    assert [got[i] for i in range(len(values))] == want
