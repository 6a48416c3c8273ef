"""Windows, random draws, ranks and seeds."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tetraclade.functions import quartets as fq

ABC = list("ABCDEFGH")


def scalar_draw(seed, n):
    s = [seed & 0xFFFFFFFF, seed >> 32 & 0xFFFFFFFF, 0x9E3779B9, 0x7F4A7C13]
    out = []
    while len(out) < 4:
        t = s[3] ^ (s[3] << 11 & 0xFFFFFFFF)
        t ^= t >> 8
        s = [t ^ s[0] ^ s[0] >> 19, *s[:3]]
        if s[0] % n not in out:
            out.append(s[0] % n)
    return tuple(sorted(out))


def test_known_draws():
    assert list(fq.Quartets.random(ABC, 6, 42)) == [(4, 5, 6, 7), (2, 4, 6, 7), (0, 1, 3, 7), (0, 1, 2, 7), (1, 2, 3, 7), (0, 2, 3, 7)]
    q = fq.Quartets([str(i) for i in range(25)], count=4)
    assert q.rng_seed == 0x9AB45E7A and list(q)[1:] == [(2, 19, 23, 24), (4, 18, 20, 23), (0, 1, 3, 17)]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(0, 2**40), st.integers(4, 60))
def test_draws_follow_the_definition(seed, offset, n):
    got = fq.draw(seed, np.arange(offset, offset + 5), n)
    assert [tuple(r) for r in got.tolist()] == [scalar_draw(seed + offset + i, n) for i in range(5)]


def test_windows_agree(spark):
    taxa = [f"t{i}" for i in range(12)]
    whole = list(fq.Quartets(taxa, [(3, 2, 1, 0), (4, 5, 6, 7)], 0, 40))
    assert whole[:2] == [(0, 1, 2, 3), (4, 5, 6, 7)]
    part = fq.Quartets(taxa, [(3, 2, 1, 0), (4, 5, 6, 7)], 1, 20)
    assert list(part) == whole[1:21] and len(part) == 20 and "mixed" in repr(part)
    rows = part.table(spark, 3).orderBy("qi").collect()
    assert [(r["a"], r["b"], r["c"], r["d"]) for r in rows] == whole[1:21] and [r["quartet_idx"] for r in rows] == [fq.rank(q) for q in whole[1:21]]
    assert {tuple(r) for r in part.to_frame(spark).select("a", "d").collect()} == {(f"t{q[0]}", f"t{q[3]}") for q in whole[1:21]}
    assert np.asarray(part).dtype == np.int32 and part.index_array().tolist() == [fq.rank(q) for q in whole[1:21]]


@pytest.mark.parametrize("seed, error", [
    ([("A", "A", "B", "C")], ValueError), ([("A", "B", "C", "nobody")], ValueError), ([(0, 1, 2)], ValueError), ([(0, 1, 2, 8)], ValueError),
    ([(0, 1, 2, -1)], ValueError), ([("A", 1, 2, 3)], TypeError), ([(0.5, 1, 2, 3)], TypeError), ([], ValueError), ("ABCD", ValueError),
])
def test_bad_seeds(seed, error):
    with pytest.raises(error):
        fq.Quartets(ABC, seed, count=1)


def test_bad_windows():
    for kw in ({"count": 0}, {"count": None}, {"count": -1}, {"count": 1, "offset": -1}):
        with pytest.raises(ValueError):
            fq.Quartets(ABC, **kw)
    with pytest.raises(ValueError):
        fq.Quartets(ABC[:3], count=1)
    assert list(fq.Quartets.from_list(ABC, [("D", "C", "B", "A"), ("A", "F", "G", "H")])) == [(0, 1, 2, 3), (0, 5, 6, 7)]
    assert list(fq.Quartets(ABC, (3, 2, 1, 0), count=1)) == [(0, 1, 2, 3)]


def test_ranks_are_dense_and_invertible(spark):
    q = sorted(itertools.combinations(range(8), 4), key=lambda x: x[::-1])
    assert [fq.rank(x) for x in q] == list(range(70)) and [fq.unrank(i) for i in range(70)] == q
    assert fq.unrank(fq.rank((500, 700, 800, 999))) == (500, 700, 800, 999)
    wide = (1, 90_000, 200_000, 400_000)
    assert fq.unrank(fq.rank(wide)) == wide and fq.ranks(np.array([wide]))[0] == fq.rank(wide)
    df = spark.createDataFrame([wide, (0, 1, 2, 3)], "a int, b int, c int, d int")
    got = df.select(fq.rank_column(*[F.col(x) for x in "abcd"], wide=True).alias("r")).collect()
    assert [int(r["r"]) for r in got] == [fq.rank(wide), 0]
    assert fq.unrank_names(1, "ABCDE") == ("A", "B", "C", "E") and fq.unrank_names([0, 4], "ABCDE") == [tuple("ABCD"), tuple("BCDE")]
    with pytest.raises(ValueError):
        fq.unrank(-1)
    back = fq.unrank_table(spark.range(70).withColumnRenamed("id", "quartet_idx")).orderBy("quartet_idx").collect()
    assert [tuple(r)[1:] for r in back] == q


def test_topology_numbers(spark):
    for p in itertools.permutations((3, 5, 8, 9)):
        t = sorted(p)
        want = next(k for k in range(3) if {frozenset(p[:2]), frozenset(p[2:])} == {frozenset((t[0], t[k + 1])), frozenset(x for x in t[1:] if x != t[k + 1])})
        assert fq.topology_index(*p) == want
        assert spark.range(1).select(fq.topology_index_column(*[F.lit(x) for x in p])).first()[0] == want


def test_small_functions(spark):
    assert fq.validate_quartet((1, 2, 3, 4)) and not fq.validate_quartet([1, 2, 3, 3]) and not fq.validate_quartet("abcd")
    row = spark.createDataFrame([([1, 2], [2, 3], [1, 2, 3, 3])], "x array<int>, y array<int>, q array<int>").select(fq.jaccard(F.col("x"), F.col("y")).alias("j"), fq.valid_quartet(F.col("q")).alias("v")).first()
    assert row["j"] == pytest.approx(1 / 3) and row["v"] is False and fq.jaccard_similarity(set(), set()) == 0.0
