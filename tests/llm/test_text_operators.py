"""Operators on whole texts against brute-force versions, and on awkward tables."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tetraclade.llm import bpe, fingerprint, html, langid, license, license_texts, minhash, packing, quality, suffix, toxicity
from tetraclade.llm.textops import Words, flat

SPLIT = re.compile(r"[^ \t\n\r\f\v]+")


def by_id(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# words


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t日", max_size=20), max_size=6))
def test_words_are_those_of_each_row(texts):
    data, offsets = flat(pa.array(texts, pa.string()))
    w = Words(data, offsets)
    got = [[] for _ in texts]
    for d, a, b in zip(w.doc, w.start, w.end):
        got[d].append(w.data[a:b].tobytes().decode())
    assert got == [SPLIT.findall(t) for t in texts]
    assert w.lengths().tolist() == [len(x) for row in got for x in row]


# quality


def brute_quality(text):
    words = SPLIT.findall(text)
    out = [len(words), sum(map(len, words))]
    seen, total = set(), 0
    for line in text.split("\n"):
        key = tuple(SPLIT.findall(line))
        if key:
            total += sum(map(len, key)) * (key in seen)
            seen.add(key)
    out.append(total)
    for n in quality.NGRAMS:
        seen, under = set(), set()
        for i in range(len(words) - n + 1):
            g = tuple(words[i : i + n])
            if g in seen:
                under.update(range(i, i + n))
            seen.add(g)
        out.append(sum(len(words[i]) for i in under))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "bb", "é", "\n"]), max_size=60).map(" ".join), min_size=1, max_size=4))
def test_quality_counts(texts):
    assert quality.measure(*flat(pa.array(texts))).tolist() == [brute_quality(t) for t in texts]


def test_quality_awkward(awkward, nothing):
    got = {(r["doc_id"], r["n_words"]): r for r in quality.quality(awkward).collect()}
    assert len(quality.quality(awkward).collect()) == awkward.count()
    for key in ((1, 0), (2, 0), (3, 0), (None, 0)):
        assert got[key]["reason"] == "empty" and not got[key]["keep"]
    assert got[4, 1]["keep"] and got[8, 60_000]["keep"] and not got[10, 500]["keep"]
    assert quality.quality(nothing).count() == 0
    kept = quality.quality_filter(awkward)
    assert kept.columns == awkward.columns and kept.where("doc_id = 5").count() == 2
    assert quality.quality_filter(nothing).count() == 0


# language


def brute_phrases(text, ref):
    n, i = 0, 0
    while i < len(text):
        k = 1
        while i + k <= len(text) and text[i : i + k] in ref:
            k += 1
        i += max(k - 1, 1)
        n += 1
    return n


def test_cross_parsing_phrases():
    rng = random.Random(1)
    ref = {x: "".join(rng.choice(a) for _ in range(400)) for x, a in (("aa", "abcab "), ("bb", "xyzc "))}
    m = langid.Model(ref)
    texts = ["".join(rng.choice("abcxyz ") for _ in range(rng.randint(1, 300))).strip() + "q" for _ in range(20)]
    texts = [re.sub(" +", " ", t) for t in texts]
    symbols, offsets = m.symbols(*flat(pa.array(texts)))
    clean = {k: re.sub(" +", " ", v.strip()) for k, v in ref.items()}
    got = m.phrases(symbols, offsets)
    for j, name in enumerate(m.names):
        for i, t in enumerate(texts):
            # a letter no reference holds ends a phrase of its own
            assert got[j, i] == brute_phrases(t, clean[name]), (name, t)


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    long = [r for r in rows if r["n_symbols"] > 200]
    assert sum(r["lang"] == r["lang_id"] for r in long) > 0.98 * len(long)
    assert sum(r["keep"] for r in rows) > 0.98 * len(rows)


def test_language_awkward(spark, awkward, nothing):
    got = langid.identify(awkward).collect()
    assert len(got) == awkward.count()
    for r in got:
        if r["n_symbols"] == 0:
            assert r["lang_id"] is None and r["bits"] is None and not r["keep"]
    kept = langid.language_filter(awkward)
    assert kept.columns == awkward.columns and kept.where("text is null or trim(text) = ''").count() == 0 and kept.where("doc_id = 5").count() == 2
    assert langid.identify(nothing).count() == 0 and langid.language_filter(nothing).count() == 0
    unlabelled = spark.createDataFrame([(1, "abc", None)], "doc_id bigint, text string, lang string")
    assert langid.language_filter(unlabelled).count() == 0


def test_random_letters_are_rejected(spark, documents):
    rng = random.Random(2)
    noise = [(10**9 + i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000)), None, "s", 0) for i in range(5)]
    both = documents.unionByName(spark.createDataFrame(noise, documents.schema))
    assert langid.language_filter(both).where("doc_id >= 1000000000").count() == 0


def test_large_scripts_keep_all_letters():
    rng = random.Random(31)
    words = ["".join(chr(0x4E00 + rng.randint(0, 2999)) for _ in range(rng.randint(1, 3))) for _ in range(15000)]
    write = lambda n: "".join(words[int(len(words) * rng.random())] + ("，" if rng.random() < 0.1 else "") for _ in range(n))
    plain = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the dark forest " * 30
    texts = {"zh": write(25_000), "en": plain}
    m = langid.Model(texts)
    assert m.width > 2500 and m.code[0x20000] == 0 and langid.Model({"x": chr(0x20000) + chr(0x30000)}).width == 4
    new = [write(400) for _ in range(20)]
    foreign = "".join(chr(0xAC00 + rng.randint(0, 9000)) for _ in range(500))
    name, bits, _, _, keep = m.identify(pa.array([*new, plain[:500], foreign]))
    assert list(name[:21]) == ["zh"] * 20 + ["en"] and keep[:21].all() and not keep[21]
    assert bits[0].as_py() > langid.MAX_BITS  # clean texts of this script cost more than the level of small ones
    phrases = m.phrases(*m.symbols(*langid.flat(pa.array([new[0][:300]]))))
    clean = lambda t: re.sub("，", " ", t)
    assert phrases[m.names.index("zh"), 0] == brute_phrases(clean(new[0][:300]), clean(texts["zh"])[: langid.REFERENCE_SYMBOLS])


def test_every_label_has_a_reference(spark):
    rows = [(i, f"{chr(0x4E00 + i % 70)}{chr(0x5E00 + i % 70)} " * 20, f"l{i % 70:02}") for i in range(140)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert sorted(langid.reference(docs)) == [f"l{i:02}" for i in range(70)]
    assert all(r["lang_id"] == f"l{r['doc_id'] % 70:02}" and r["keep"] for r in langid.identify(docs).collect())


def test_reference_without_identifiers(spark):
    rows = [(None, f"{'abcdefghij'[i % 10]} text number {i}", "en") for i in range(600)]
    texts = langid.reference(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))["en"].split("\n")
    # a sample of all the texts, not the first ones in their order
    assert len(texts) == langid.DOCS_PER_LANGUAGE and len({t[0] for t in texts}) > 5


# near duplicates


def shingles(text):
    w = SPLIT.findall(text)
    return {tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))} if w else set()


def test_minhash_estimates():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    pairs = []
    for _ in range(60):
        a = [rng.choice(words) for _ in range(200)]
        b = [x if rng.random() > 0.1 else rng.choice(words) for x in a]
        pairs.append((" ".join(a), " ".join(b)))
    sketch = minhash._sketch(pa.array([t for p in pairs for t in p]))[0]
    s = np.frombuffer(b"".join(sketch.to_pylist()), np.uint64).reshape(len(pairs) * 2, -1)
    est = minhash.agreement(s[0::2], s[1::2])
    true = np.array([len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) for a, b in pairs])
    assert np.abs(est - true).mean() < 0.06 and abs((est - true).mean()) < 0.03


def test_near_duplicate_recall_and_groups(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    group = {r["doc_id"]: r["group_id"] for r in minhash.near_duplicates(docs).collect()}
    s = {r["doc_id"]: shingles(r["text"]) for r in docs.collect()}
    ids = sorted(s)
    hit = total = far = 0
    for a, b in itertools.combinations(ids, 2):
        small, big = sorted((len(s[a]), len(s[b])))
        if small < 0.25 * big:
            continue
        j = len(s[a] & s[b]) / len(s[a] | s[b])
        if j >= 0.6:
            total += 1
            hit += group[a] == group[b]
        elif j < 0.2:
            far += group[a] == group[b]
    assert total > 100 and hit >= 0.95 * total and far == 0
    assert all(g <= i and group[g] == g for i, g in group.items())


def test_minhash_awkward(awkward, nothing):
    rows = minhash.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    groups = {}
    for r in rows:
        groups.setdefault(r["doc_id"], set()).add(r["group_id"])
    assert groups[5] == {None} and groups[6] == {None}  # the null identifier comes first
    assert groups[1] == {1} and groups[2] == {2}
    kept = minhash.drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns
    ids = sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    assert [i for i, _ in ids].count(5) == 0 and [i for i, _ in ids].count(7) == 2 and {1, 2, 3, 4, 8, 9, 10} <= {i for i, _ in ids}
    assert minhash.near_duplicates(nothing).count() == 0 and minhash.drop_near_duplicates(nothing).count() == 0


def test_one_of_repeated_rows_stays(spark):
    df = spark.createDataFrame([(1, "a b c d e", "x"), (1, "a b c d e", "y"), (2, "p q r s t", "z")], "doc_id bigint, text string, source string")
    assert sorted(r["doc_id"] for r in minhash.drop_near_duplicates(df).collect()) == [1, 2]


# repeated passages


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=150), st.integers(1, 60))
def test_suffix_array(values, bucket):
    x = np.array(values, np.uint32)
    want = sorted(range(len(x)), key=lambda i: x[i:].tolist())
    assert suffix.suffix_array(x, bucket=bucket).tolist() == want


def test_suffix_array_of_long_repeats():
    rng = np.random.default_rng(5)
    part = rng.integers(1, 5, 200).astype(np.uint32)
    x = np.concatenate([part, part[7:], [5], part, part[3:150]])
    assert suffix.suffix_array(x).tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())


def brute_repeats(rows):
    seen, out = set(), {}
    for i, text in sorted(rows):
        w = SPLIT.findall(text)
        for p in range(len(w) - suffix.LENGTH + 1):
            g = tuple(w[p : p + suffix.LENGTH])
            if g in seen:
                out.setdefault(i, set()).update(range(p, p + suffix.LENGTH))
            seen.add(g)
    return out


def test_repeated_spans(spark):
    rng = random.Random(7)
    words = [f"v{i}" for i in range(300)]
    draw = lambda n: [rng.choice(words) for _ in range(n)]
    shared = [draw(n) for n in (50, 51, 49, 80, 200)]
    rows = []
    for i in range(80):
        w = draw(rng.randint(0, 120))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(shared)
        rows.append((i, " ".join(w)))
    rows += [(80, "x " * 300), (81, "x y " * 90), (82, rows[3][1])]
    got = {}
    for r in suffix.repeated_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        got.setdefault(r["doc_id"], set()).update(range(r["first_word"], r["end_word"]))
    assert got == brute_repeats(rows)


def test_repeats_awkward(spark, awkward, nothing):
    assert suffix.repeated_spans(nothing).count() == 0 and suffix.drop_repeats(nothing).count() == 0
    out = suffix.drop_repeats(awkward)
    assert out.columns == awkward.columns
    ten = out.where("doc_id = 10").first()
    assert ten["text"].split() == ["a"] and ten["n_chars"] == len(ten["text"])
    assert out.where("doc_id <> 10 or doc_id is null").count() == awkward.count() - 1
    passage = " ".join(f"p{i}" for i in range(60))
    df = spark.createDataFrame([(1, "head " + passage + " tail", "a"), (2, passage, "b"), (3, "x " + passage + "\nend", "c")], "doc_id bigint, text string, spans string")
    assert by_id(suffix.drop_repeats(df), "doc_id", "text") == [(1, "head " + passage + " tail"), (3, "x end")]


# packing


def test_boundaries_are_optimal():
    rng = random.Random(11)
    for _ in range(40):
        n = rng.randint(1, 8)
        edges = np.array(sorted(rng.sample(range(1, 60), n)))
        count = np.array([rng.randint(1, 9) for _ in range(n)])
        k = rng.randint(1, 4)

        def padding(cuts):
            return sum(int(c) * (min(x for x in cuts if x >= e) - int(e)) for e, c in zip(edges, count))

        best = min(padding([*c, edges[-1]]) for r in range(min(k, n)) for c in itertools.combinations(edges[:-1].tolist(), r))
        got = packing.boundaries(edges, count, edges * count, k)
        assert len(got) <= k and got[-1] == edges[-1] and padding(got) == best


def test_pack_places_every_row(spark, documents):
    rows = packing.pack(documents).collect()
    assert len(rows) == documents.count()
    batches = {}
    for r in rows:
        assert r["n_tokens"] <= r["bucket_len"]
        batches.setdefault((r["bucket"], r["batch"]), []).append(r["bucket_len"])
    for lens in batches.values():
        assert len(lens) <= max(1, packing.TOKEN_BUDGET // max(1, lens[0]))
    full = sum(1 for (b, k), v in batches.items() if len(v) == max(1, packing.TOKEN_BUDGET // max(1, v[0])))
    assert len(batches) - full <= packing.BUCKETS


def test_long_lengths_share_bins(spark):
    n = [0, 1, 1023, 1024, 1025, 2047, 2048, 2049, 100_001]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in n], "n bigint").select(packing.bin_of(packing.F.col("n"))).collect()]
    assert all(e >= x and e - x <= max(0, x // 512) for e, x in zip(got, n)) and got[:4] == n[:4]


def test_packing_awkward(awkward, nothing):
    rows = packing.pack(awkward).collect()
    assert len(rows) == awkward.count()
    assert sorted(r["n_tokens"] for r in rows)[:4] == [0, 0, 0, 0] and max(r["n_tokens"] for r in rows) == 60_000
    assert packing.pack(nothing).count() == 0


# licenses


def test_license_lines_in_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {(r["doc_id"], r["license"]) for r in license.scan(docs).collect()}
    lines = {"Apache-2.0": "Licensed under the Apache License, Version 2.0.", "MIT": "Released under the MIT License.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.", "GPL-3.0": "General Public License, version 3."}
    want = {(r["doc_id"], k) for r in docs.collect() for k, v in lines.items() if v in r["text"]}
    assert found == want and want


def test_license_alignment():
    rng = random.Random(13)
    noise = lambda n: " ".join(f"q{rng.randint(0, 999)}" for _ in range(n))
    for k, (name, form, text) in enumerate(license_texts.TEMPLATES):
        words = text.split()
        if len(words) > 20:
            for i in rng.sample(range(5, len(words) - 5), len(words) // 20):
                words[i] = rng.choice(["", "changed", words[i] + " extra"])
        body = noise(30) + "\n" + " ".join(words) + "\n" + noise(30)
        raw = np.frombuffer(body.encode(), np.uint8)
        found = license.index().scan(raw, np.array([0, len(raw)]))
        best = max(found, key=lambda x: x[3])
        assert license_texts.TEMPLATES[best[1]][0] == name, (name, form)
        assert abs(best[6] - body.index("\n")) <= 30 and best[2] >= license.COVERAGE
    raw = np.frombuffer(noise(500).encode(), np.uint8)
    assert license.index().scan(raw, np.array([0, len(raw)])) == []


def brute_alignment(t, d):
    """Matching words of a best local alignment, by the full table."""
    score = [[(0, 0)] * (len(d) + 1) for _ in range(len(t) + 1)]
    best = (0, 0)
    for i, x in enumerate(t, 1):
        for j, y in enumerate(d, 1):
            s, m = score[i - 1][j - 1]
            options = [(0, 0), (s + 1, m + 1) if x == y else (s - 1, m), (score[i - 1][j][0] - 1, score[i - 1][j][1]), (score[i][j - 1][0] - 1, score[i][j - 1][1])]
            score[i][j] = max(options)
            best = max(best, score[i][j])
    return best


def test_banded_alignment_equals_full_table():
    rng = random.Random(17)
    k = next(i for i, t in enumerate(license_texts.TEMPLATES) if t[:2] == ("ISC", "text"))
    t = re.findall(r"[a-z0-9]+", license_texts.TEMPLATES[k][2].lower())
    for _ in range(10):
        d = list(t)
        for i in rng.sample(range(len(d)), 4):
            d[i] = rng.choice(["zz", "zz zz", ""])
        d = " ".join(["pre"] * 5 + d + ["post"] * 5).split()
        raw = np.frombuffer(" ".join(d).encode(), np.uint8)
        got = [x for x in license.index().scan(raw, np.array([0, len(raw)])) if x[1] == k]
        assert got and abs(got[0][3] - brute_alignment(t, d)[1]) <= 1  # equal scores may differ by a match


def test_whole_license_texts_in_documents():
    rng = random.Random(29)
    noise = lambda n: " ".join(f"q{rng.randint(0, 999)}" for _ in range(n))
    bodies = {name: text for name, form, text in license_texts.TEMPLATES if form == "full"}
    assert {"MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "Unlicense", "BSL-1.0", "Apache-2.0", "MPL-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0"} == set(bodies)
    for name, text in bodies.items():
        body = noise(40) + "\n" + text.strip() + "\n" + noise(40)
        raw = np.frombuffer(body.encode(), np.uint8)
        (found,) = license.index().scan(raw, np.array([0, len(raw)]))
        assert license_texts.TEMPLATES[found[1]][:2] == (name, "full") and found[2] == 1.0
        words = re.findall(r"[A-Za-z0-9]+", text)
        assert found[3] == len(words) and found[5] - found[4] == len(words)
    # two licenses in one document, one behind a copyright line of its own
    text = "Copyright (c) 2020 Someone\n" + bodies["BSD-3-Clause"] + noise(50) + "\n" + bodies["MIT"]
    raw = np.frombuffer(text.encode(), np.uint8)
    assert [license_texts.TEMPLATES[x[1]][:2] for x in license.index().scan(raw, np.array([0, len(raw)]))] == [("BSD-3-Clause", "full"), ("MIT", "full")]


def test_license_awkward(spark, awkward, nothing):
    assert license.scan(awkward).count() == 0 and license.scan(nothing).count() == 0
    df = spark.createDataFrame([(None, "x\nReleased under the MIT License.", "c")] * 2, "doc_id bigint, text string, license string")
    assert [(r["doc_id"], r["license"]) for r in license.scan(df).collect()] == [(None, "MIT")] * 2


# tokens


def test_bpe_equals_public_tokenizer(documents):
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    e = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [r["text"] for r in documents.collect()] + ["", "aaaaaaaaaaaaa" * 7, "abababab" * 9, "日本語 🎉\n\n  x ", "don't 12345 !!! <|endoftext|>"]
    ids, start = bpe.vocabulary().encode(texts)
    for k, t in enumerate(texts):
        assert ids[start[k] : start[k + 1]].tolist() == e.encode_ordinary(t)
    data, at = bpe.vocabulary().decode(ids, start)
    assert [data[a:b].tobytes().decode() for a, b in zip(at, at[1:])] == texts


def test_bpe_awkward(awkward, nothing):
    rows = bpe.encode(awkward).collect()
    assert len(rows) == awkward.count()
    assert all(r["round_trip"] for r in rows if r["token_ids"] is not None) and sum(r["token_ids"] is None for r in rows) == 2
    assert [r["token_ids"] for r in rows if r["doc_id"] == 2] == [[]]
    texts = by_id(awkward, "doc_id", "text")
    assert by_id(bpe.decode(bpe.encode(awkward)), "doc_id", "text") == texts
    assert bpe.encode(nothing).count() == 0 and bpe.decode(bpe.encode(nothing)).count() == 0


# pages


def test_cut_is_minimal():
    rng = random.Random(19)
    for _ in range(150):
        n = rng.randint(1, 8)
        s = [rng.randint(-6, 6) for _ in range(n)]
        e = {(i, j): rng.randint(0, 4) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.4}

        def cost(x):
            return sum(-v if a and v < 0 else v if not a and v > 0 else 0 for v, a in zip(s, x)) + sum(c for (i, j), c in e.items() if x[i] != x[j])

        least = min(map(cost, itertools.product((False, True), repeat=n)))
        best = [x for x in itertools.product((False, True), repeat=n) if cost(x) == least]
        assert html.cut(s, e) == [all(x[i] for x in best) for i in range(n)]


def test_articles_are_found(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r["page_id"]: r for r in html.main_content(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r["html"], re.S).group(1)
        want = " ".join(b.text for b in html.blocks(article)).split()
        assert got[r["page_id"]]["content"].split() == want
        assert 0 < got[r["page_id"]]["n_content"] < got[r["page_id"]]["n_blocks"]


def test_pages_awkward(spark):
    rows = [(1, None), (2, ""), (3, "<p>"), (4, "</div></p>text"), (5, "<p>a<p>b<li>c"), (None, "<script>x</script><!-- never ends"), (6, "<div>" * 3000 + "deep"), (7, "<p>" + "long text " * 50_000), (5, "<p>a<p>b<li>c")]
    df = spark.createDataFrame([(i, h, "u", "t", 1) for i, h in rows], "page_id bigint, html string, url string, title string, n_blocks int")
    got = html.main_content(df).collect()
    assert len(got) == len(rows)
    one = {r["page_id"]: r for r in got}
    assert one[1]["content"] is None and one[1]["n_blocks"] == 0 and one[2]["content"] == "" and one[3]["n_blocks"] == 0
    assert one[7]["n_content"] == 1 and one[5]["n_blocks"] == 3 and one[None]["n_blocks"] == 0
    assert html.main_content(df.limit(0)).count() == 0


# toxicity


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    train, test = labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0")
    scored = toxicity.toxicity(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), train).join(test.select("doc_id", test["toxic"].alias("y")), "doc_id").collect()
    caught = sum(r["toxic"] for r in scored if r["y"] == 1)
    false = sum(r["toxic"] for r in scored if r["y"] == 0)
    assert caught > 0.75 * sum(r["y"] for r in scored) and false < 0.02 * sum(1 - r["y"] for r in scored)


def test_ftrl_weights_are_sparse():
    rng = random.Random(23)
    texts, y = [], []
    for i in range(400):
        w = [f"n{rng.randint(0, 200)}" for _ in range(30)]
        y.append(i % 4 == 0)
        if y[-1]:
            w[rng.randint(0, 29)] = rng.choice(["vile", "nasty"])
        texts.append(" ".join(w))
    at, w = toxicity.fit(*flat(pa.array(texts)), np.array(y, float))
    assert len(at) < 2000
    score, toxic = toxicity.predict(pa.array(["n1 n2 Vile! n3", "n1 n2 n3", "", None]), at, w)
    assert toxic.tolist() == [True, False, False, False] and score[2] == score[3]


def test_toxicity_awkward(spark, awkward, nothing):
    labels = spark.createDataFrame([(5, 1), (4, 0), (8, None), (None, 1), (99, 1), (5, 1)], "doc_id bigint, toxic int")
    rows = toxicity.toxicity(awkward, labels).collect()
    assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
    none = toxicity.toxicity(awkward, labels.limit(0)).collect()
    assert all(r["score"] == 0.0 and not r["toxic"] for r in none)
    assert toxicity.toxicity(nothing, labels).count() == 0


# fingerprints


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abé日", min_size=1, max_size=40), st.data())
def test_spans_and_extensions(text, data):
    codes = np.array([ord(c) for c in text], np.uint32)
    p = fingerprint.Prefixes(codes)
    n = len(text)
    i, j = (np.array([data.draw(st.integers(0, n))]) for _ in range(2))
    common = 0
    while max(i[0], j[0]) + common < n and text[i[0] + common] == text[j[0] + common]:
        common += 1
    assert p.extension(i, j, np.array([n - max(i[0], j[0])]))[0] == common
    k = data.draw(st.integers(0, n - max(i[0], j[0])))
    assert (p.span(i, i + k)[0] == p.span(j, j + k)[0]) == (text[i[0] : i[0] + k] == text[j[0] : j[0] + k])


def horner(text):
    out = []
    for base, prime in zip(fingerprint.BASES, fingerprint.PRIMES):
        h = 0
        for c in text:
            h = (h * base + ord(c) + 1) % prime
        out.append(h)
    return out[0] << 31 | out[1]


def test_fingerprints_of_documents(documents):
    rows = {r["doc_id"]: r for r in fingerprint.fingerprints(documents).collect()}
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    lead = {}
    for i in sorted(texts):
        lead.setdefault(texts[i][: fingerprint.HEAD], i)
    for i, t in texts.items():
        r = rows[i]
        head = lead[t[: fingerprint.HEAD]]
        common = next((k for k, (a, b) in enumerate(zip(t, texts[head])) if a != b), min(len(t), len(texts[head])))
        assert (r["fingerprint"], r["head_id"], r["common_chars"], r["n_chars"]) == (horner(t), head, common, len(t))


def test_fingerprints_awkward(awkward, nothing):
    rows = fingerprint.fingerprints(awkward).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        assert (r["n_chars"] == 0) == (r["fingerprint"] == 0)
        assert r["common_chars"] <= r["n_chars"]
    assert fingerprint.fingerprints(nothing).count() == 0


def brute_extensions(rows):
    """Longest common prefix of each row with any other, and the least identifier of equal texts."""
    texts = [t or "" for _, t in rows]
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    longest = [max((common(t, u) for j, u in enumerate(texts) if j != i), default=0) for i, t in enumerate(texts)]
    return longest, [min((r[0] for r, u in zip(rows, texts) if u == t), key=lambda x: (x is not None, x or 0)) for t in texts]


def test_extensions_among_all_rows(spark, documents, awkward, nothing):
    rng = random.Random(23)
    rows = [(r["doc_id"], r["text"]) for r in documents.limit(120).collect()]
    # later copies that leave the head's first row, copies edited in the first line, equal texts that aren't the first
    for i in range(30):
        at, t = rng.randint(0, 400), rows[rng.randint(0, len(rows) - 1)][1]
        rows += [(10_000 + 2 * i, t[:at] + "é" + t[at:]), (10_001 + 2 * i, t[:at] + "é" + t[at : at + 100])]
    rows += [(20_000, rows[130][1]), (20_001, ""), (20_002, None), (20_003, "€ alone")]
    got = {r["doc_id"]: r for r in fingerprint.extensions(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    text = {i: t or "" for i, t in rows}
    assert len(got) == len(rows)
    for (i, t), longest, first in zip(rows, *brute_extensions(rows)):
        r = got[i]
        assert (r["n_chars"], r["fingerprint"], r["common_chars"], r["first_id"]) == (len(text[i]), horner(text[i]), longest, first), i
        assert (r["partner_id"] is None) == (longest == 0) and r["partner_id"] != i
        if longest:
            assert text[r["partner_id"]][:longest] == text[i][:longest]
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    got = fingerprint.extensions(awkward).collect()
    key = lambda x: (x[0] is not None, x[0] or 0, *x[1:])
    want = [(i, len(t or ""), n) for (i, t), n in zip(rows, brute_extensions(rows)[0])]
    assert sorted([(r["doc_id"], r["n_chars"], r["common_chars"]) for r in got], key=key) == sorted(want, key=key)
    assert fingerprint.extensions(nothing).count() == 0
