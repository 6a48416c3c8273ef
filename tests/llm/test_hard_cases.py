"""Long texts, hot keys, clashing names and brute-force versions of whole operators."""

import base64
import math
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from test_text_operators import brute_phrases, brute_repeats

from tetraclade.llm import bpe, html, langid, license, minhash, quality, suffix, textops, toxicity
from tetraclade.llm.cluster import runs
from tetraclade.llm.textops import flat

# names


def test_identifier_named_like_a_result(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, None)], "keep bigint, `te.xt` string")
    out = quality.quality(df, id_col="keep", text_col="te.xt")
    assert out.columns[0] == "keep_" and sorted(r["keep_"] for r in out.collect()) == [1, 2]
    assert toxicity.toxicity(spark.createDataFrame([(1, "x")], "Score int, text string"), spark.createDataFrame([], "Score int, toxic int"), id_col="Score").columns == ["Score_", "score", "toxic"]
    tokens = bpe.encode(spark.createDataFrame([(7, "some words")], "`doc.id` bigint, text string"), id_col="doc.id")
    assert [tuple(r) for r in bpe.decode(tokens, id_col="doc.id").collect()] == [(7, "some words")]


# tokens


def reference_tokenizer():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_long_pieces_equal_public_tokenizer(monkeypatch):
    e, v, rng = reference_tokenizer(), bpe.vocabulary(), random.Random(37)
    monkeypatch.setattr(bpe, "LONG", 3)
    alphabets = ["ACGT", "abcdefghijklmnopqrstuvwxyz", "a", "ab", "aab", "etaoin", "日本語é"]
    texts = ["".join(rng.choice(alphabets[k % 7]) for _ in range(rng.randint(4, 200))) for k in range(400)]
    ids, start = v.merge([t.encode() for t in texts])
    for k, t in enumerate(texts):
        assert ids[start[k] : start[k + 1]].tolist() == e.encode_ordinary(t), t


def test_one_piece_of_a_megabyte(spark):
    e, v, rng = reference_tokenizer(), bpe.vocabulary(), random.Random(41)
    text = "".join(rng.choice("ACGT") for _ in range(1_000_000))
    began = time.time()
    ids, start = v.encode([text])
    assert time.time() - began < 30 and v.decode(ids, start)[0].tobytes().decode() == text
    assert v.encode([text[:50_000]])[0].tolist() == e.encode_ordinary(text[:50_000])
    long = "word " * 400_000 + text[:5000]
    (r,) = bpe.encode(spark.createDataFrame([(1, long)], "doc_id int, text string")).collect()
    assert r["round_trip"] and r["token_ids"][:3] == e.encode_ordinary("word word word") and r["n_tokens"] == 400_000 + len(e.encode_ordinary(" " + text[:5000]))


def test_a_million_new_pieces_at_once():
    ids, start = bpe.vocabulary()._merge([f"{i:09d}".encode() for i in range(1_000_000)])
    some = [0, 1, 999_999, 123_456]
    e = reference_tokenizer()
    for i in some:
        assert ids[start[i] : start[i + 1]].tolist() == e.encode_ordinary(f"{i:09d}")


# pages


def test_head_without_end():
    body = "<body><nav><a href=x>menu</a></nav><article><p>" + "many words of a story " * 20 + "</p></article></body></html>"
    for head in ("<head><title>Top &amp; more</title>", "<head><title>Top &amp; more</title></head>", "<title>Top &amp; more</title>"):
        title, content, n, kept = html.extract("<html>" + head + "<style>p{}</style><script>var t='<p>';</script>" + body)
        assert (title, n, kept) == ("Top & more", 2, 1) and content.startswith("many words")
    # text ends the head, as does an element that it can't hold
    assert html.blocks("<head>plain <p>more")[0].text == "plain"
    assert [b.text for b in html.blocks("<noscript><p>one<svg><p>two<template>three")] == ["one", "two three"]
    assert [b.text for b in html.blocks("a<svg>x</svg>b<script>if (a < b) c</script>d<!-- > e -->f")] == ["a b d f"]
    assert [b.text for b in html.blocks("1 < 2 and 3 > 2 <b title='>'>x</b> don't <i class=it's>y</i>")] == ["1 < 2 and 3 > 2 x don't y"]


def test_pages_of_a_megabyte():
    rng = random.Random(43)
    pages = [
        "<a x " * 200_000, "<script " * 125_000, '<a t="' * 160_000 + ">", '<a t=">"' * 120_000, "<!-- " * 200_000, "<title " * 140_000, "<title>" * 140_000, "<template>" * 100_000,
        "<div>x " * 140_000, "<div>" * 100_000 + "</x>" * 100_000, "<table><tr><td>x " * 60_000, "<" * 1_000_000, "".join("<p>" + "w " * rng.randint(1, 14) for _ in range(50_000)),
    ]
    for p in pages:
        began = time.time()
        html.extract(p)
        assert time.time() - began < 20, p[:20]


def test_classifier_tells_content_without_its_element(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    weights = html.train(pages)
    assert weights != html.PRIOR and weights["aside"] == html.PRIOR["aside"]  # no page of the sample has one
    right = total = 0
    for r in pages.where("page_id % 5 = 0").collect():
        want = " ".join(b.text for b in html.blocks(re.search(r"<article>(.*)</article>", r["html"], re.S).group(1))).split()
        right += html.extract(re.sub(r"</?article>", "", r["html"]), weights)[1].split() == want
        total += 1
    assert right >= 0.98 * total
    assert html.train(pages.where("false")) == html.PRIOR


# language


def brute_identify(text, refs, limit):
    """(language, bits, margin, symbols, keep) by searching substrings."""
    low = re.sub(r"[^a-zäöüßéèêñ]+", " ", text.lower()).lstrip(" ")
    if not low.strip():
        return None, None, None, 0, False
    cost = {k: brute_phrases(low, v) * math.log2(len(v)) / len(low) for k, v in refs.items()}
    name = min(sorted(cost), key=lambda k: cost[k])
    rest = sorted(cost.values())
    return name, cost[name], rest[1] - rest[0], len(low), cost[name] - math.log2(len(refs[name])) / len(low) <= limit[name]


def test_language_of_long_texts_by_brute_force(monkeypatch):
    rng = random.Random(47)
    words = {k: ["".join(rng.choice(a) for _ in range(rng.randint(2, 7))) for _ in range(150)] for k, a in (("aa", "abcdeä"), ("bb", "defghñ"))}
    write = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    refs = {k: write(k, 800) for k in words}
    m = langid.Model(refs)
    level = dict(zip(m.names, m.level))
    texts = [write("aa", 1500), write("bb", 1300) + "123", write("aa", 500) + ", " + write("bb", 700), refs["aa"][:3880], refs["bb"][700:] + " zzz", "", "12 34", "Q", write("aa", 3) + "?", "xyz" * 900]
    for block, group in ((1024, langid.GROUP), (64, 6), (17, 1)):
        monkeypatch.setattr(langid, "BLOCK", block)
        monkeypatch.setattr(langid, "GROUP", group)
        name, bits, margin, count, keep = m.identify(pa.array(texts))
        for i, t in enumerate(texts):
            want = brute_identify(t, refs, level)
            assert (name[i], count[i], keep[i]) == (want[0], want[3], want[4]), (block, i)
            if want[0]:
                assert abs(bits[i].as_py() - want[1]) < 1e-9 and abs(margin[i].as_py() - want[2]) < 1e-9
    assert bits[3].as_py() == pytest.approx(math.log2(len(refs["aa"])) / 3880)  # one phrase, however long


# hot keys


def stream(n, size=10_000):
    """n rows of one key between two others, in batches."""
    key = np.concatenate([[1, 2, 2], np.full(n, 5), [6, 7, 7]])
    row = np.arange(len(key))
    for a in range(0, len(key), size):
        yield pa.RecordBatch.from_arrays([pa.array(key[a : a + size]), pa.array(row[a : a + size])], names=["k", "row"])


@pytest.mark.parametrize("n", [0, 1, 99, 100, 101, 1000, 1_000_000])
def test_runs_hold_no_long_run(n):
    seen, numbers = [], []
    for t, part in runs(stream(n, 37 if n < 5000 else 10_000), lambda t: t["k"].to_numpy(), rows=50, most=100 if n < 5000 else 4096):
        keys = t["k"].to_numpy()
        assert t.num_rows < 100 + 2 * 50 + 40 if n < 5000 else t.num_rows < 4096 + 10_000
        if part is not None:
            assert (keys == 5).all()
            numbers.append(part)
        seen.append(t["row"].to_numpy())
    assert sorted(np.concatenate(seen)) == list(range(n + 6)) and numbers == list(range(len(numbers)))
    assert not numbers if n < 100 else numbers or n < 140


def test_hot_buckets_are_searched_in_parts(spark, monkeypatch):
    rng = random.Random(53)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(w if rng.random() > 0.06 else f"x{rng.randint(0, 9)}" for w in base)) for i in range(300)] + [(1000 + i, f"other text number {i} of them") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    whole = sorted(map(tuple, minhash.near_duplicates(df).collect()))
    monkeypatch.setattr(minhash, "PART", 16)
    assert sorted(map(tuple, minhash.near_duplicates(df).collect())) == whole and len({r[1] for r in whole}) < 60


def test_edges_between_parts_join_what_pairs_join():
    rng = np.random.default_rng(59)
    centre = rng.integers(0, 256, (6, 32), dtype=np.uint8)
    member = rng.integers(0, 6, 200)
    sig = centre[member].copy()
    sig[np.arange(200), rng.integers(0, 32, 200)] ^= np.uint8(3)
    node = pa.StructArray.from_arrays([pa.array(np.arange(200)), pa.array(np.arange(200))], ["id", "h"])
    table = pa.table({"node": node, "sig": pa.array([s.tobytes() for s in sig], pa.binary())})

    def packed(t):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema) as w:
            w.write_table(t)
        return sink.getvalue().to_pybytes()

    pair = pa.RecordBatch.from_arrays([pa.array([packed(table.slice(0, 90))], pa.binary()), pa.array([packed(table.slice(90))], pa.binary())], names=["x", "y"])
    (edges,) = minhash._part_edges([pair], 0.6)
    group = {i: i for i in range(200)}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    def join(pairs):
        group.update({i: i for i in range(200)})
        for a, b in pairs:
            group[find(a)] = find(b)
        return {frozenset(i for i in range(200) if find(i) == find(j)) for j in range(200)}

    found = [(a["id"], b["id"]) for a, b in zip(edges.column(0).to_pylist(), edges.column(1).to_pylist())]
    words = sig.view(np.uint64)
    every = [(i, j) for i in range(90) for j in range(90, 200) if minhash.agreement(words[i], words[j]) >= 0.6]
    assert join(found) == join(every) and len(found) < len(every)


def test_hot_passages(spark, monkeypatch):
    rng = random.Random(61)
    words = [f"v{i}" for i in range(200)]
    draw = lambda n: [rng.choice(words) for _ in range(n)]
    shared = [draw(55), draw(90)]
    rows = [(i, " ".join(draw(rng.randint(0, 40)) + rng.choice(shared) + draw(rng.randint(0, 40)))) for i in range(120)] + [(500, "x y " * 200), (501, "x y " * 150), (502, "z " * 400)]
    for hot in (suffix.HOT, 4):
        monkeypatch.setattr(suffix, "HOT", hot)
        got = {}
        for r in suffix.repeated_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
            got.setdefault(r["doc_id"], set()).update(range(r["first_word"], r["end_word"]))
        assert got == brute_repeats(rows), hot


def test_equal_pieces_and_anchors_are_held_once():
    piece = np.arange(1, 61, dtype=np.uint32).tobytes()

    def pieces():
        for a in range(0, 1_000_000, 10_000):
            n = 10_000
            node = pa.StructArray.from_arrays([pa.array(np.arange(a, a + n)), pa.array(np.zeros(n, np.int64))], ["id", "h"])
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int64)), pa.array([piece] * n, pa.binary()), node, pa.array(np.zeros(n, np.int32)), pa.array(np.zeros(n, np.int32))], names=suffix._PIECE)

    out, most = 0, 0
    for b in suffix._shard(pieces()):
        out += b.num_rows
    assert out == 999_999
    anchors = lambda: (pa.RecordBatch.from_arrays([pa.array(np.full(10_000, 3)), pa.array(np.arange(10_000)), pa.array(np.arange(10_000, dtype=np.int32))], names=["gram", "node", "pos"]) for _ in range(100))
    for b in suffix._twice(anchors()):
        most = max(most, b.num_rows)
        out += b.num_rows
    assert out == 1_999_999 and most <= 10_001
    one = [pa.RecordBatch.from_arrays([pa.array([k]), pa.array([k]), pa.array([p], pa.int32())], names=["gram", "node", "pos"]) for k, p in ((1, 0), (2, 0), (2, 4), (2, 7), (3, -1), (3, 0), (4, 1), (5, 2), (5, 3))]
    assert [(r["gram"], r["pos"]) for b in suffix._twice(one) for r in b.to_pylist()] == [(2, 0), (2, 4), (2, 7), (3, -1), (5, 2), (5, 3)]


def test_one_word_a_million_times(spark):
    began = time.time()
    rows = suffix.repeated_spans(spark.createDataFrame([(1, "a " * 1_000_000), (2, "a b " * 300_000)], "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, rows)) == [(1, 1, 1_000_000), (2, 2, 600_000)] and time.time() - began < 60


# licenses


def test_many_license_lines_in_one_text():
    raw = np.frombuffer(("x\nReleased under the MIT License.\n" * 20_000).encode(), np.uint8)
    began = time.time()
    found = license.index().scan(raw, np.array([0, len(raw)]))
    assert len(found) == 20_000 and time.time() - began < 60


# toxicity


def brute_features(text):
    """Coordinates of words, neighbours and pairs with one word between, one at a time."""
    mask = (1 << 64) - 1

    def mix(x):
        x ^= x >> 33
        x = x * 0xFF51AFD7ED558CCD & mask
        x ^= x >> 29
        x = x * 0xC4CEB9FE1A85EC53 & mask
        return x ^ (x >> 32)

    words = re.findall(rb"[A-Za-z0-9\x80-\xff]+", text.encode())
    lower = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    h = [mix(sum((c + 1) * pow(textops._BASE, i, 1 << 64) for i, c in enumerate(w)) & mask) for w in lower]
    out = set(h)
    for gap in (1, 2):
        out |= {mix((a * (2 * gap + 1) + (b >> 1)) & mask) for a, b in zip(h, h[gap:])}
    return {x >> (64 - toxicity.SPACE_BITS) for x in out}


def test_ftrl_by_brute_force():
    rng = random.Random(67)
    vocabulary = [f"n{i}" for i in range(60)] + ["Vile", "nasty"]
    texts = [" ".join(rng.choice(vocabulary) + rng.choice(["", "", "!", ","]) for _ in range(rng.randint(0, 25))) for _ in range(200)]
    y = [float("vile" in t.lower() or "nasty" in t) for t in texts]
    rows = [sorted(brute_features(t)) + [1 << toxicity.SPACE_BITS] for t in texts]
    z, n = {}, {}

    def weight(k):
        l1 = 0.0 if k == 1 << toxicity.SPACE_BITS else toxicity.L1
        v = z.get(k, 0.0)
        return 0.0 if abs(v) <= l1 else -(v - math.copysign(l1, v)) / ((toxicity.BETA + math.sqrt(n[k])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for x, label in zip(rows, y):
            w = {k: weight(k) for k in x}
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w.values()))))) - label
            for k in x:
                was = n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - (math.sqrt(was + g * g) - math.sqrt(was)) / toxicity.ALPHA * w[k]
                n[k] = was + g * g
    want = {k: weight(k) for k in z if weight(k)}
    at, w = toxicity.fit(*flat(pa.array(texts)), np.array(y))
    assert set(at.tolist()) == set(want) and 0 < len(want) < len(z)
    assert all(abs(want[k] - v) < 1e-6 for k, v in zip(at.tolist(), w))
    score, toxic = toxicity.predict(pa.array(texts), at, w)
    for t, s in zip(texts, score):
        own = want.get(1 << toxicity.SPACE_BITS, 0.0) + sum(want.get(k, 0.0) for k in brute_features(t))
        assert abs(s - 1 / (1 + math.exp(-own))) < 1e-5
    assert (toxic == (score >= toxicity.THRESHOLD)).all() and toxic.any() and not toxic.all()
