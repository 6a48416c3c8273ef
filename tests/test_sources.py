"""Parsing, validation, compression and input forms."""

import bz2
import gzip
import io
import lzma
import random
from pathlib import Path

import generators
import pytest

from tetraclade.sources import newick, readers

ONE, TWO = "((ape:3,bat:2):5,(cow:3,dog:7):2);", "((ape:3,cow:2):5,(bat:1,dog:7):2);"
TEXT = f"{ONE}\n# note\n\n{TWO}\n"


def test_parse_numbers_leaves_then_postorder():
    t = newick.parse("((x:1,y:2)0.9:3,(z:4,(w:5,v:6):7):8)1.0;")
    assert t.names == ["x", "y", "z", "w", "v"] and t.n_leaves == 5
    assert t.children[5:].tolist() == [[0, 1], [3, 4], [2, 6], [5, 7]]
    assert t.parent[8] == -1 and t.rd.tolist() == [4, 5, 12, 20, 21, 3, 15, 8, 0]
    assert t.support[5] == 0.9 and t.support[8] == 1.0 and t.depth[3] == 3


def test_multifurcations_cascade_to_the_left():
    t = newick.parse("(a:1,b:1,c:1,d:1);")
    assert t.children[4:].tolist() == [[0, 1], [4, 2], [5, 3]] and t.poly.tolist() == [False] * 4 + [True, True, False]
    assert t.had_multifurcations and t.rd[:4].tolist() == [1, 1, 1, 1]


@pytest.mark.parametrize("strategy, poly, zero", [("multifurcation", 0, 2), ("zero-length-branch", 1, 0), ("both", 1, 0)])
def test_zero_lengths_by_strategy(strategy, poly, zero):
    t = newick.parse("((a:0,b:1):0,(c:1,d:1):1);", strategy)
    assert int(t.poly.sum()) == poly and t.n_zero_length == zero


def test_quotes_comments_and_missing_lengths():
    t = newick.parse("(('it''s a (leaf)':2,b)[a [nested] note],c:1[x]);", missing=-1.0)
    assert t.names == ["it's a (leaf)", "b", "c"] and t.rd.tolist()[:3] == [1.0, -2.0, 1.0]


@pytest.mark.parametrize("bad", ["", "(a,b", "a,b);", "((a),b);", "(a,b)(c,d);", "((a,b)label,c);", "(a:x,b);", "(a,b),(c,d);"])
def test_malformed_trees(bad):
    with pytest.raises(ValueError):
        newick.parse(bad)


@pytest.mark.parametrize("bad", ["", "  ", "(a,b)", "(a,b);;", "(a;b);", "(a,b));", "((a,b);", ")a,b(;"])
def test_validate_rejects(bad):
    with pytest.raises(ValueError):
        newick.validate_newick(bad)
    assert newick.validate_newick(" (a,b);\n") == "(a,b);" and newick.format_newick(" (a,b) ") == "(a,b);"


def test_validators_agree_as_expressions(spark):
    from tetraclade.functions import text

    forms = ["", "  ", "(a,b)", "(a,b);;", "(a;b);", "(a,b));", "((a,b);", ")a,b(;", "(a,b);", " ((a,b),c); ", ";", "(a,b,c);"]
    rows = spark.createDataFrame([(x,) for x in [*forms, None]], "x string").select("x", text.valid_newick(text.F.col("x")).alias("v"), text.format_newick(text.F.col("x")).alias("f"), text.has_multifurcations(text.F.col("x")).alias("m")).collect()
    for r in rows:
        if r["x"] is None:
            assert r["v"] is None and r["f"] is None
            continue
        try:
            newick.validate_newick(r["x"])
            ok = True
        except ValueError:
            ok = False
        assert r["v"] == ok and r["f"] == newick.format_newick(r["x"])
        assert r["m"] == (r["x"].count("(") < r["x"].count(","))


def test_deep_trees_need_no_recursion():
    rng = random.Random(1)
    t = newick.parse(generators.caterpillar([f"t{i}" for i in range(5000)], rng))
    assert t.n_leaves == 5000 and t.depth.max() == 4999


@pytest.mark.parametrize("strategy", newick.STRATEGIES)
@pytest.mark.parametrize("keep", [1, 3, 50])
def test_parts_are_parts_of_whole_trees(monkeypatch, strategy, keep):
    monkeypatch.setattr(newick, "_CHUNK", 4)
    for text in [*generators.ensemble(12, [f"t{i}" for i in range(30)], 8), "a;", "((b,b)0.5:0,a,(c:2,'d''e')[x]:0):3;"]:
        whole, part = newick.parse(text, strategy, -1.0), newick.parse_part(text, keep, strategy, -1.0)
        at = sorted(whole.names.index(x) for x in sorted(set(whole.names))[:keep])
        nodes = at + [whole.lca(u, v) for u, v in zip(at, at[1:])]
        assert part.names == [whole.names[v] for v in at] and part.n_leaves == whole.n_leaves
        assert part.gap == list(range(len(at), len(nodes)))
        for x in ("rd", "depth", "poly"):
            assert getattr(part, x) == getattr(whole, x)[nodes].tolist()
        assert (part.topology_key, part.length_key) == (whole.topology_key(), whole.length_key())


@pytest.mark.parametrize("bad", ["", "(a,b", "a,b);", "((a),b);", "((a,b)label,c);", "(a:x,b);", "(a,b),(c,d);", "(:2,a);"])
def test_parts_of_malformed_trees(bad):
    with pytest.raises(ValueError):
        newick.parse_part(bad, 2)


def test_memory_of_a_part_is_that_of_flat_arrays(monkeypatch):
    import tracemalloc

    monkeypatch.setattr(newick, "_CHUNK", 256)
    names = [f"t{i:05}" for i in range(20_000)]
    text = "(" + ",(".join(f"{x}:1" for x in names[:-1]) + f",{names[-1]}:1" + "):1" * (len(names) - 2) + ");"
    tracemalloc.start()
    try:
        part = newick.parse_part(text, 10)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert part.names == names[:10] and part.rd[:10] == [*range(1, 11)]
    assert most < 110 * len(names)  # 634 bytes a leaf as lists and tuples


def test_keys_tell_topologies_and_lengths_apart():
    a, b, c, d = (newick.parse(x) for x in ("((a:1,b:2):1,c:1);", "((a:9,b:2)0.5:1,c:1);", "((a:1,c:2):1,b:1);", "((a:1,b:2)0.7:1,c:1);"))
    assert a.topology_key() == b.topology_key() != c.topology_key()
    assert a.length_key() != b.length_key() and a.length_key() == d.length_key()


def test_single_tree_operators():
    t = newick.parse("((A:1,(B:2,C:3):4):5,(D:6,E:7):8);")
    assert t.distance("B", "E") == 2 + 4 + 5 + 8 + 7 and t.distance("A", "A") == 0
    top, length = t.multi_lca(["A", "B", "C"])
    assert top == t.lca(0, 1) and length == 1 + 4 + 2 + 3
    assert t.multi_lca(["B"]) == (1, 0.0) and t.multi_lca(["A", "C", "D"])[1] == 1 + 4 + 3 + 5 + 8 + 6
    assert t.split("E", "A", "B", "D") == (0, 1, 3, 4)
    assert newick.parse("(a:1,b:1,c:1,d:1);").split(0, 1, 2, 3) == (0, 3, 1, 2)  # equal scores pair first and last
    assert t.distance("B", "E", return_lca=True)[1] == t.lca(1, 4) and t.split_index("E", "A", "B", "D") == 0
    assert t.split_sets("A", "B", "D", "E") == frozenset((frozenset("AB"), frozenset("DE"))) and t.split_sets(0, 1, 3, 4) == frozenset((frozenset((0, 1)), frozenset((3, 4))))
    with pytest.raises(ValueError):
        t.multi_lca([])
    with pytest.raises(ValueError):
        t.split("A", "A", "B", "C")
    with pytest.raises(KeyError):
        t.distance("A", "nobody")


def _forms():
    raw = TEXT.encode()
    out = {"text": raw, "gzip": gzip.compress(raw), "bzip2": bz2.compress(raw), "xz": lzma.compress(raw)}
    try:
        import zstandard

        out["zstd"] = zstandard.ZstdCompressor().compress(raw)
    except ImportError:
        pass
    return out


@pytest.mark.parametrize("kind", list(_forms()))
def test_compression_is_told_by_content(kind, tmp_path):
    raw = _forms()[kind]
    path = tmp_path / "trees.wrong"
    path.write_bytes(raw)
    for source in (raw, io.BytesIO(raw), path, str(path)):
        f = readers.NewickFile(source)
        with f as stream:
            assert stream.read() == TEXT
    assert readers.NewickFile(raw).detect() == kind and readers.NewickFile.decompress_bytes(raw) == TEXT


def test_damaged_and_foreign_bytes():
    for kind, raw in _forms().items():
        if kind != "text":
            with pytest.raises(ValueError, match="mine"):
                readers.decompress(raw[:-9], "mine")
    with pytest.raises(ValueError, match="mine"):
        readers.decompress(b"(\xff\xfe);", "mine")


def test_input_forms(tmp_path):
    one, two = ONE, TWO
    path = tmp_path / "t.nwk"
    path.write_text(TEXT)
    label = readers.group_label([one, two])
    for data in (TEXT, [one, two], (two, one), str(path), path, [path]):
        (got,) = readers.normalize_input(data).items()
        assert got[0] == label and sorted(got[1]) == sorted([one, two])
    assert readers.normalize_input({"b": one, "a": [TEXT, Path(path)]}) == {"b": [one], "a": [one, two, one, two]}
    for bad, error in (({"g": []}, ValueError), ({"g": 3}, TypeError), (7, TypeError), ([3], TypeError), ("# only\n\n", ValueError), ("no/such/file", ValueError), (tmp_path / "none", ValueError)):
        with pytest.raises(error):
            readers.normalize_input(bad)
    with pytest.raises(ValueError, match="line 2"):
        newick.split_block("(a,b);\n(a,b;\n")


def test_executors_read_compressed_files(spark, tmp_path):
    for kind, raw in _forms().items():
        (tmp_path / f"{kind}.trees").write_bytes(raw)
    df = readers.read_trees(spark, str(tmp_path))
    rows = df.collect()
    assert len(rows) == 2 * len(_forms()) and {r["line_no"] for r in rows} == {1, 4} and len({r["tree_id"] for r in rows}) == len(rows)
    assert {r["group"] for r in rows} == {f"{k}.trees" for k in _forms()}
    kinds = spark.read.format("binaryFile").load(str(tmp_path)).select(readers.sniff_column(readers.F.col("content")).alias("k")).collect()
    assert {r["k"] for r in kinds} == set(_forms())
