"""Operators that look at the whole corpus: 3, 5, 7, 9, 10, and the pipeline."""

import hashlib
import io
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratalog.llm import common
from stratalog.llm import op3_suffix_dedup as op3
from stratalog.llm import op5_katz as op5
from stratalog.llm import op7_warc as op7
from stratalog.llm import op9_dartminhash as op9
from stratalog.llm import op10_capfilters as op10
from stratalog.llm.suffixes import suffix_array


@given(st.lists(st.integers(0, 3), max_size=40))
@settings(max_examples=300, deadline=None)
def test_suffix_array(s):
    assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("limit", [20_000, 1])
def test_repeats_are_brute_force(docs, limit):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(0, 120))) for _ in range(30)]
    texts += [texts[0], None, "", "é" * 60, "a" * 150, "a" * 41]
    for _ in range(8):
        texts.append(rng.choice(texts[:30])[:50] + "é" + rng.choice(texts[:30])[30:])
    d = docs(texts, [i if i % 7 else None for i in range(len(texts))]).withColumn("fp", F.lit(1)).withColumn("a", F.lit(2))
    got = op3.dedup(d, length=40, gram=9, group_limit=limit).collect()
    mine = sorted((r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got)
    assert mine == sorted(op3.brute(texts, 40))


def test_repeats_in_a_long_text_and_none(docs, monkeypatch):
    rng = random.Random(6)
    a = bytes(rng.randrange(97, 123) for _ in range(3000)).decode()
    data = np.frombuffer((a * 2).encode(), np.uint8)
    whole = op3.anchors(data, np.array([0, len(data)]), 200, 40)
    monkeypatch.setattr(op3, "SEGMENT", 1000)
    cut = op3.anchors(data, np.array([0, len(data)]), 200, 40)
    spread = lambda x: sorted((s + i) for s, n in zip(x[1].tolist(), x[2].tolist()) for i in range(n))
    assert spread(whole) == spread(cut) == list(range(5801))
    assert op3.dedup(docs([])).count() == 0


def katz(rows, order, most=5):
    """Counts and scores of (held, text) by dictionaries, and P(word | context) as a function."""
    import re
    from collections import Counter

    lower = {i: i + 32 for i in range(65, 91)}
    texts = [["<s>", *re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)), None] for _, t in rows]
    grams = [Counter() for _ in range(order + 1)]
    for (held, _), t in zip(rows, texts):
        for n in range(1, order + 1) if not held else ():
            grams[n].update(tuple(t[i - n + 1 : i + 1]) for i in range(max(1, n - 1), len(t)))
    cut = [{} for _ in grams]
    for n in range(1, order + 1):
        c = Counter(grams[n].values())
        x = (most + 1) * c[most + 1] / c[1] if c[1] else 0
        for r in range(1, most + 1):
            v = ((r + 1) * c[r + 1] / c[r] / r - x) / (1 - x) if c[1] and c[r] and x < 1 else 1
            cut[n][r] = v if 0 < v < 1 else 1
        if c[1] and all(cut[n][r] == 1 for r in range(1, most + 1) if c[r]):
            cut[n][1] = 0.5
    total = sum(grams[1].values())
    after = {}
    for n in range(2, order + 1):
        for g, r in grams[n].items():
            after.setdefault(g[:-1], {})[g[-1]] = r
    less = lambda n, r: r * cut[n].get(r, 1)

    def p(h, w):
        own = {g[0]: r for g, r in grams[1].items()} if not h else after.get(h)
        if not own:
            return p(h[1:], w) if h else 1.0
        c, kept = sum(own.values()), sum(less(len(h) + 1, r) for r in own.values())
        size = c if kept < c else c + 1
        if w in own:
            return less(len(h) + 1, own[w]) / size
        return (1 - kept / size) / (1 - sum(p(h[1:], v) for v in own)) * p(h[1:], w) if h else 1 - kept / size

    n, v = total, len(grams[1])
    found = []
    for t in texts:
        base = sum(math.log10((grams[1][(w,)] + 1) / (n + v + 1)) for w in t[1:])
        score = sum(math.log10(p(tuple(t[max(0, i - order + 1) : i]), t[i])) for i in range(1, len(t)))
        found.append((len(t) - 1, sum(grams[1][(w,)] > 0 for w in t[1:]), base, score))
    return found, p


@pytest.mark.parametrize("order, salted, chunk", [(1, 1_000_000, 700), (2, 5, 700), (3, 1_000_000, 700), (3, 5, 1 << 20), (4, 5, 700)])
def test_katz_is_brute_force(docs, order, salted, chunk):
    rng = random.Random(8)
    texts = [None, "", "  ", "one"] + [" ".join(rng.choice(["The", "the", "cat", "É", "sat", "x%d" % rng.randrange(30)]) for _ in range(rng.randrange(60))) for _ in range(60)]
    texts += [texts[9], texts[9], "the cat " * 2000]
    held = [i % 7 == 2 for i in range(len(texts))]
    d = docs(texts).withColumn("held", F.lit(1)).withColumn("part", F.lit(2))
    got = {r.doc_id: r for r in op5.scores(d, F.pmod("doc_id", F.lit(7)) == 2, order=order, chunk=chunk, bucket=50, salted=salted).collect()}
    for i, (n, known, base, score) in enumerate(katz(list(zip(held, texts)), order)[0]):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.held_out) == (n, known, held[i])
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)


def test_katz_probabilities_add_up_to_one():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(12))) for _ in range(30)]
    _, p = katz([(False, t) for t in texts], 3)
    words = ["a", "b", "c", "d", "e", "f", "g", "h", None, "unknown"]
    for h in [(), ("a",), ("<s>",), ("<s>", "b"), ("a", "b"), ("c", "c"), ("unknown", "a")]:
        assert math.isclose(sum(p(h, w) for w in words), 1, rel_tol=1e-9)


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3), st.integers(0, 200)), min_size=1, max_size=40))
@settings(max_examples=100, deadline=None)
def test_steps_of_ordered_rows(rows):
    columns = [np.array(c, np.uint64) for c in zip(*sorted(rows))]
    back = op5.unplaned(op5.planes(*op5.stepped(columns)), *[len(rows)] * 3)
    assert [c.tolist() for c in op5.risen(back)] == [c.tolist() for c in columns]


def test_katz_on_nothing(docs):
    assert op5.scores(docs([]), F.lit(False)).count() == 0
    rows = op5.scores(docs(["a b"]), F.lit(True)).collect()
    assert rows[0].train_tokens == 0 and rows[0].n_known == 0 and rows[0].score == 0


@pytest.mark.parametrize("order", [2, 3, 4])
def test_katz_in_chunks_without_contexts(docs, order):
    texts = ["a b a b c", "unseen words only", "a b c", "ab", None]
    held = [False, True, False, True, False]
    rows = op5.scores(docs(texts), F.col("doc_id").isin(1, 3), order=order, chunk=1).collect()
    want, _ = katz(list(zip(held, texts)), order)
    assert len(rows) == len(texts)
    for r in rows:
        n, known, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known) == (n, known)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)


def test_blocks_of_a_crowded_band_take_little_memory():
    import tracemalloc

    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 130_000, 3000)).astype(np.uint64) for _ in range(128)]
    for i in range(0, 128, 8):
        sets[i + 3] = np.unique(np.r_[sets[i][150:], sets[i + 3][:150]])
    rows = [(1, 0, 1, i % 2, i, i, x.tobytes()) for i, x in enumerate(sets)]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    batch = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["band", "i", "j", "mine", "node", "root", "units"])
    tracemalloc.start()
    try:
        found = [(a, b) for out in op9.compare_blocks(0.8)(iter([batch])) for a, b in zip(*(c.to_pylist() for c in out.columns))]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    near = lambda x, y: len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y))
    assert sorted(found) == [(j, i) for j in range(128) for i in range(j) if (i + j) % 2 and near(sets[i], sets[j])] and len(found) == 16
    assert peak < 100 << 20


PAGES = [(1, "http://a/ü\n", "x" * 2000), (5, None, "x" * 2000), (3, "http://c", "x" * 2000), (4, "d", None), (6, "e", ""), (7, "f", "short"), (8, "g", "short"), (None, "h", "y" * 1500), (9, "i", "é" * 600), (9, "i", "é" * 600)]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("first", F.lit(2))
    where = common.new_path(spark, "test-warc")
    files = op7.write_warc(pages, where)
    rows = op7.read_warc(files, where).collect()
    assert len(rows) == len(PAGES) == sum(r.records for r in files.collect())
    for r in rows:
        want = next(h for i, _, h in PAGES if i == r.page_id) or ""
        assert r.payload_bytes == len(want.encode()) and r.payload_digest == hashlib.sha1(want.encode()).hexdigest()
        assert (r.record_type, r.refers_to) == (("revisit", 5) if r.page_id in (1, 3) else ("response", None))
        assert r.payload is None if r.page_id in (1, 3) else bytes(r.payload) == want.encode()
    empty = op7.write_warc(pages.limit(0), where + "-none")
    assert op7.read_warc(empty, where + "-none").count() == 0


def test_warc_damage_is_noticed():
    data = op7.member(op7.record(1, "u", b"p" * 100, None, False, "d")) + op7.member(op7.record(2, "v", b"q" * 100, 1, True, "d"))
    assert [op7.parsed(*r)[0] for r in op7.split(io.BytesIO(data))] == [1, 2]
    raw = op7.record(1, "u", b"p" * 100, None, False, "d")
    for bad in (data[:-5], data[: len(data) // 4], op7.member(raw[:-1]), op7.member(raw + b"z"), op7.member(b"no record")):
        with pytest.raises((op7.Damaged, KeyError, ValueError)):
            list(op7.split(io.BytesIO(bad)))
    with pytest.raises(op7.Damaged):
        [op7.parsed(*r) for r in op7.split(io.BytesIO(op7.member(raw.replace(b"ppp", b"pqp"))))]


def brute_classes(texts):
    import re
    from collections import Counter

    low = {i: i + 32 for i in range(65, 91)}
    sets = []
    for t in texts:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
        sets.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = sum((a & sets[j]).values())
            if both and both >= 0.8 * sum((a | sets[j]).values()):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(texts))]


def test_near_duplicates_are_brute_force(docs, words):
    rng = random.Random(12)
    texts = [words(i, 80) for i in range(20)] + ["a b", "A, b!", "!!", None, "", "z " * 200, "z " * 230]
    for i in range(60):
        t = texts[i % 6].split()
        for _ in range(rng.randrange(0, 4)):
            t[rng.randrange(len(t))] = "edit%d" % rng.randrange(99)
        texts.append(" ".join(t))
    want = brute_classes(texts)
    d = docs(texts).withColumn("class_id", F.lit(0)).withColumn("sid", F.lit("x"))
    got = {r.doc_id: r for r in op9.classes(d).collect()}
    assert [got[i].class_id for i in range(len(texts))] == want
    kept = op9.keep_one(d)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_near_duplicates_with_null_and_repeated_ids(spark, docs, words):
    a, b = words(1), words(2)
    d = docs([a, a + " x", b, b, b, None], [None, 7, None, None, 3, None])
    rows = sorted(((r.doc_id, r.class_id, r.kept) for r in op9.classes(d).collect()), key=str)
    assert rows == sorted([(None, 7, False), (7, 7, True), (None, 3, False), (None, 3, False), (3, 3, True), (None, None, True)], key=str)
    assert op9.classes(docs([])).count() == 0 and op9.keep_one(docs([])).count() == 0
    # unlike texts under one id all stay; of equal rows one does; the least and no id are ids like others
    d = docs([a, b, words(3), words(3), words(4), words(5), words(5) + "!"], [1, 1, 2, 2, -(2**63), None, None]).withColumn("__k1", F.lit("x"))
    kept = op9.keep_one(d)
    assert kept.columns == d.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, a), (1, b), (2, words(3)), (-(2**63), words(4)), (None, next(r.text for r in kept.where("doc_id is null").collect()))], key=str)


def test_crowded_bands_lose_nothing_and_write_no_pairs(spark, docs, words):
    rng = random.Random(5)
    texts, base = [], words(1, 100).split()
    for i in range(150):  # one template at about 0.7, pairs of near copies in it
        t = list(base)
        for k in range(4):
            t[rng.randrange(100)] = f"own{i}x{k}"
        texts.append(" ".join(t))
    for i in range(0, 150, 5):
        texts.append(texts[i] + f" end{i}")
    texts.append("z " * 30_000)
    want = brute_classes(texts)
    for crowd, unit in ((10, 3000), (10, 10**9), (10**6, 1)):
        got = {r.doc_id: r.class_id for r in op9.classes(docs(texts), crowd=crowd, unit=unit).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_darts_estimate_weighted_similarity():
    from stratalog.llm.texts import mixed

    n = 600
    a, b = np.arange(n, dtype=np.uint64), np.arange(150, n + 150, dtype=np.uint64)
    unit = np.concatenate([np.sort(mixed(a + np.uint64(9))), np.sort(mixed(b + np.uint64(9)))])
    sig = op9.signatures(np.array([0, n, 2 * n]), unit, 2000)
    assert abs((sig[0] == sig[1]).mean() - 450 / 750) < 0.05


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit(1)).withColumn("v", F.lit(2))


@pytest.mark.parametrize("unit, code, rows", [(1024, None, 512), (8, (3, 256, 32), 1)])
def test_embeddings_are_brute_force(spark, unit, code, rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        embeddings_are_brute_force(spark, unit, code)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")


def embeddings_are_brute_force(spark, unit, code):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(6):
        center = rng.standard_normal(64)
        for k in range(12):
            x = center + rng.standard_normal(64) * (0.0 if k % 4 == 0 else 0.12)
            rows.append((len(rows), x.tolist(), c % 3))
    good = len(rows)
    rows += [(100, None, 1), (101, [0.0] * 64, 1), (102, [float("nan")] * 64, 1), (103, [None] * 64, 1), (104, rows[0][1], None), (105, rows[0][1][:5], 0)]
    x = np.array([r[1] for r in rows[:good]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows[:good]])
    near = (x @ x.T >= 0.98 - 1e-12) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    root = list(range(good))
    for _ in range(good):
        root = [min([root[i], *(root[j] for j in np.flatnonzero(near[i]))]) for i in range(good)]
    got = {r.vec_id: r for r in op10.near(vectors(spark, rows), unit=unit, code=code).collect()}
    assert [got[i].n_links for i in range(good)] == near.sum(1).tolist()
    assert [got[i].component_id for i in range(good)] == root
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(100, 106))


def test_embeddings_with_null_and_repeated_ids(spark):
    a, b = [1.0, 0.0, 0.0], [1.0, 0.01, 0.0]
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in op10.near(vectors(spark, [(None, a, 1), (4, a, 1), (4, a, 1), (9, b, 1), (2, a, 2)])).collect()), key=str)
    assert got == sorted([(None, 3, 4), (4, 3, 4), (4, 3, 4), (9, 3, 4), (2, 0, 2)], key=str)
    assert op10.near(vectors(spark, [])).count() == 0


def test_embeddings_of_several_lengths_in_one_batch(spark):
    rng = np.random.default_rng(4)
    rows = []
    for size in (16, 24, 40):
        a = rng.standard_normal(size)
        rows += [(len(rows) + k, (a + 0.01 * k).tolist(), 1) for k in range(2)]
    rows += [(6, rng.standard_normal(41).tolist(), 1), (7, [], 1), (8, None, 1), (9, [1.0, None], 1), (10, [1.0, float("inf")], 1)]
    got = {r.vec_id: r for r in op10.near(vectors(spark, rows).coalesce(1)).collect()}
    assert [(got[i].n_links, got[i].component_id) for i in range(11)] == [(1, i // 2 * 2) for i in range(6)] + [(0, i) for i in range(6, 11)]


@pytest.mark.parametrize("n", [1000, 60_000, 10**6, 10**8, 10**10])
def test_recall_of_the_filters(n):
    rng = np.random.default_rng(8)
    x = op10.unit_rows(rng.standard_normal((600, 64)))
    z = rng.standard_normal((600, 64))
    z = op10.unit_rows(z - (z * x).sum(1, keepdims=True) * x)
    y = 0.98 * x + math.sqrt(1 - 0.98**2) * z
    size = op10.size_of_code(n)
    assert size[1] ** size[0] >= n * size[2]
    code = op10.Code(64, size)
    assert np.mean([len(set(a) & set(b)) > 0 for a, b in zip(code.decode(x).tolist(), code.decode(y).tolist())]) > 0.99


@pytest.mark.parametrize("scale", ["tenth", "hundredth", "harmonic", "padded"])
@pytest.mark.parametrize("noise", ["isotropic", "alike"])
def test_recall_of_the_filters_on_uneven_spectra(scale, noise):
    rng = np.random.default_rng(9)
    half = np.arange(64) < 32
    by = {"tenth": np.where(half, 1, 0.1), "hundredth": np.where(half, 1, 0.01), "harmonic": 1 / np.arange(1, 65), "padded": np.where(half, 1, 0.0)}[scale]
    x = op10.unit_rows(rng.standard_normal((1500, 64)) * by)
    z = rng.standard_normal((1500, 64)) * (by if noise == "alike" else 1)
    z = op10.unit_rows(z - (z * x).sum(1, keepdims=True) * x)
    y = 0.98 * x + math.sqrt(1 - 0.98**2) * z
    code = op10.Code(64, op10.size_of_code(1000))
    assert np.mean([len(set(a) & set(b)) > 0 for a, b in zip(code.decode(x).tolist(), code.decode(y).tolist())]) > 0.99


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100 + i, 100) for i in range(30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(30)]
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    loops = {a for a, b in pairs if a == b} - {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: root(x) for x in parent if x not in loops}


def test_pipeline_keeps_clean_documents(spark, docs, words, tmp_path):
    import corpus_pipeline

    bad = "trashy moronic vile awful nasty".split()
    rng = random.Random(1)
    texts = [words(i, 60) for i in range(300)]
    toxic = set(range(0, 300, 5))
    for i in toxic:
        t = texts[i].split()
        for k in range(6):
            t[k * 7] = rng.choice(bad)
        texts[i] = " ".join(t)
    item = words(9999, 25)
    texts += [texts[1] + " end", texts[2], item + " and more " + words(5000, 30), "mail me at joe@example.com " + words(5001, 30), None]
    docs(texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == set(range(305)) - toxic - {300, 301, 302}
    assert all(r.round_trip for r in out.values())
    clean = texts[303].replace("joe@example.com", "[EMAIL]")
    assert out[303].decoded_sha256 == hashlib.sha256(clean.encode()).hexdigest()
    stages = [n for n, _ in corpus_pipeline.STAGES]
    assert stages == ["toxicity", "near_dedup", "decontamination", "pii", "pieces"]
