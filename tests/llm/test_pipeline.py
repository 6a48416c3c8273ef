"""The pipeline against a brute-force version of its stages."""

import re

import corpus_pipeline
from test_text_operators import SPLIT, brute_quality, brute_repeats, shingles

from tetraclade.llm import langid, minhash, packing, quality, suffix


def test_stages_are_in_order():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "near_dedup", "passage_dedup", "batches"]


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    before = {r["doc_id"]: r for r in docs.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.columns == columns
        after = {r["doc_id"]: r for r in docs.collect()}
        if k == 0:  # what is dropped has no letters or fits no language
            assert len(after) > 0.98 * len(before)
        elif k == 1:
            for i, r in before.items():
                _, total, *dup = brute_quality(r["text"])
                limits = [quality.LIMITS[0], *(quality.LIMITS[n] for n in quality.NGRAMS)]
                assert (i in after) == (total > 0 and all(d <= x * total for d, x in zip(dup, limits)))
        elif k == 2:
            s = {i: shingles(r["text"]) for i, r in before.items()}
            near = lambda a, b: len(s[a] & s[b]) / max(1, len(s[a] | s[b]))
            for i in before.keys() - after.keys():
                assert any(near(i, j) > 0.35 for j in before if j != i)
            kept = sorted(after)
            assert not any(near(a, b) >= 0.75 for n, a in enumerate(kept) for b in kept[:n])
        else:
            gone = brute_repeats([(i, r["text"]) for i, r in before.items()])
            for i, r in before.items():
                want = [w for p, w in enumerate(SPLIT.findall(r["text"])) if p not in gone.get(i, ())]
                assert (SPLIT.findall(after[i]["text"]) if i in after else []) == want
                if i in gone and i in after:
                    assert after[i]["n_chars"] == len(after[i]["text"])
        before = after
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(before)
    assert sorted((r["doc_id"], r["batch"], r["bucket"]) for r in corpus_pipeline.run(spark, sf_dir).collect()) == sorted((r["doc_id"], r["batch"], r["bucket"]) for r in out)


def test_stages_take_empty_and_awkward_tables(spark, sf_dir, awkward, nothing):
    for docs in (nothing, awkward):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            assert out.count() <= docs.count()
            if stage is not corpus_pipeline.STAGES[-1][1]:
                assert out.columns == docs.columns


def test_only_the_entry_module_guards_imports():
    text = open(corpus_pipeline.__file__).read()
    assert "ImportError" not in text and not re.search(r"^\s*try:", text, re.M)
    for module in (langid, minhash, packing, quality, suffix):
        assert "ImportError" not in open(module.__file__).read()
