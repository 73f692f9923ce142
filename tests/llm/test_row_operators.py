"""Operators whose result for a row needs that row and a small table only: 1, 2, 4, 6, 8."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.llm import op1_decontaminate as op1
from stratalog.llm import op2_sentencepiece as op2
from stratalog.llm import op4_licenses as op4
from stratalog.llm import op6_pii as op6
from stratalog.llm import op8_toxicity as op8
from stratalog.llm.texts import Rolling, Words, blocks, chosen, sliding_min

# --- shared text work ---


def test_sliding_minimum_and_choice():
    a = np.random.default_rng(1).integers(0, 5, 60).astype(np.uint64) << np.uint64(60)
    for w in (1, 2, 3, 7, 8, 60):
        assert sliding_min(a, w).tolist() == [min(a[i : i + w].tolist()) for i in range(61 - w)]
        want = [i + max(j for j in range(w) if a[i + j] == min(a[i : i + w])) for i in range(61 - w)]
        assert all(chosen(a, w, most).tolist() == want for most in (5, 17, 1 << 20))


def test_rolling_hashes_depend_on_the_content_only():
    a = np.arange(50, dtype=np.uint64) % np.uint64(7)
    r = Rolling(a)
    assert r(np.array([0]), np.array([5]))[0] == r(np.array([7]), np.array([12]))[0] == r.grams(5)[14]
    assert r(np.array([0]), np.array([5]))[0] != r(np.array([1]), np.array([6]))[0]


def test_blocks_keep_texts_apart():
    import pyarrow as pa

    column = pa.array(["ab cd", None, "", "ef", "gh"])
    for most in (1, 4, 100):
        got = []
        for _, _, data, off in blocks(column, most):
            w = Words(data, off, op1.WORD)
            got += [w.joined(s, e).decode() for s, e in zip(w.first[:-1], w.first[1:])]
        assert got == ["ab cd", "", "", "ef", "gh"]


# --- 1: decontamination ---


def brute_hits(text, items, window=10):
    import re

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    w, hit, found = split(text), set(), set()
    for item, t in items:
        v = split(t)
        n = min(window, len(v))
        wins = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_decontamination_is_brute_force(spark, docs, words):
    rng = random.Random(3)
    items = [(i, words(i, rng.choice([3, 9, 10, 11, 30]))) for i in range(12)] + [(12, "the the the"), (13, None), (14, "!!"), (3, "Straße ÉTÉ x y"), (None, "a b")]
    texts = [None, "", "?!", "the " * 50, "a B a", words(7, 30_000) + " " + words(2, 30)]
    for i in range(40):
        item = rng.choice(items)[1] or ""
        cut = item.split()[rng.randrange(3) :]
        texts.append(words(100 + i, rng.randrange(0, 40)) + " " + " ".join(cut).upper() + ",\n" + words(200 + i, 5))
    items += items[:4]  # repeated rows count once
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    d = docs(texts, [None, *range(1, len(texts))])
    want = sorted(brute_hits(t, [("" if i is None else i, x) for i, x in items]) for t in texts)
    for size in (1 << 20, 60):
        got = op1.decontaminate(d.withColumn("items", F.lit(1)).withColumn("__k1", F.lit(2)), bench, part_bytes=size).collect()
        assert sorted((r.n_words, r.n_hit, r["items"]) for r in got) == want
        assert all(sum(e - s + 1 for s, e in r.spans) == r.n_hit for r in got)
        named = d.withColumn("__k1", F.lit(1)).withColumn("__k2", F.lit("x"))
        kept = op1.clean(named, bench, part_bytes=size)
        assert kept.columns == named.columns and kept.count() == sum(not w[1] for w in want)


def test_decontamination_of_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in op1.decontaminate(docs(["a b c"]), none).collect()] == [0]
    assert op1.decontaminate(docs([]), none).count() == 0


# --- 2: pieces ---


@pytest.fixture(scope="module")
def pieces():
    return op2.Pieces(op2.model_bytes(op2.MODEL))


TEXTS = ["", None, "Hello world", " lead  and   trail  ", "tab\tnl\n\n x", "▁lit▁ ▁", "日本語 é ñ 😀" * 9, "a" * 300, "ab" * 200, ("x" * 90 + " ") * 4, " " * 200, "the cat sat " * 40]


@pytest.mark.parametrize("chunk", [1 << 15, 64, 37])
def test_pieces_round_trip_and_are_best(docs, pieces, chunk):
    d = docs(TEXTS + TEXTS[-1:])
    rows = op2.decode(op2.encode(d.withColumn("ids", F.lit(1)), chunk=chunk)).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        text = (TEXTS + TEXTS[-1:])[r.doc_id] or ""
        assert r.decoded == text and r.n_tokens == len(r.ids) // 2
        whole = pieces.path(op2.swapped(" " + text))[1] if text else b""
        assert bytes(r.ids) == whole


def test_pieces_of_nothing(docs, pieces):
    assert op2.encode(docs([])).count() == 0


def test_library_search_agrees_with_ours(pieces):
    rng = random.Random(9)
    units = {"".join(rng.choice("theanioéßxz#日▁"[:-1]) for _ in range(rng.randrange(1, 14))) for _ in range(300)} | {"  ab", "   "}
    pieces.learn(units)
    assert all(pieces[u] == pieces.path(op2.swapped(u))[1] for u in units)


def test_max_plus_products_are_associative():
    rng = np.random.default_rng(5)
    a = rng.integers(-50, 0, (9, 4, 4))
    left = a[0]
    for m in a[1:]:
        left = op2.product(left, m)
    assert (op2.prefixes(a)[-1] == left).all()


def test_paths_are_best_of_all(pieces):
    """Every way to cut a short text into pieces or characters, by recursion."""

    def best(text):
        if not text:
            return 0
        ways = [pieces.best[text[:n]][0] + best(text[n:]) for n in range(1, len(text) + 1) if text[:n] in pieces.best]
        return max([*ways, *([] if text[0] in pieces.best else [pieces.unknown + best(text[1:])])])

    for text in ["▁the▁cat", "aaaaaaa", "ab▁▁▁b", "日本é", "ing▁tion"]:
        assert pieces.path(text)[0] == best(text)


# --- 4: licenses ---


def brute_licenses(text, templates, size=5, least=0.8):
    """The ids of the templates that some window holds and no fuller one overlaps, looking at every window."""
    import re

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    words, found = split(text), []
    for name, template in templates:
        t = split(template)
        k = min(size, len(t))
        if not k:
            continue
        wanted = {tuple(t[i : i + k]) for i in range(len(t) - k + 1)}
        step = 1
        while step < len(t) - k + 1:
            step *= 2
        grams = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
        for s in range(0, len(grams), step):
            at = [i for i in range(s, min(s + 2 * step, len(grams))) if grams[i] in wanted]
            share = len({grams[i] for i in at}) / len(wanted)
            if share >= least:
                found.append((share, at[0], at[-1] + k - 1, name))
    return sorted({name for share, a, b, name in found if all(other <= share or c > b or a > d for other, c, d, _ in found)})


def test_licenses_are_brute_force(docs, words):
    texts = [None, "", "mit", "x " * 30] + [words(i, 30) + ". " + t + " " + words(50 + i, 9) for i, (_, t) in enumerate(op4.TEMPLATES)]
    texts.append("Licensed under the Apache License Version 3.0 " + op4.TEMPLATES[0][1])
    texts += [words(99, 30_000) + " " + op4.TEMPLATES[21][1] + " " + words(98, 30_000), texts[7]]
    want = [brute_licenses(t, op4.TEMPLATES) for t in texts]
    assert all(name in want[4 + i] for i, (name, _) in enumerate(op4.TEMPLATES))  # each is found in its own text
    for size in (1 << 20, 300):
        got = {r.doc_id: r.licenses for r in op4.scan_licenses(docs(texts), part_bytes=size).collect()}
        assert [got[i] for i in range(len(texts))] == want
    assert op4.scan_licenses(docs([])).count() == 0
    assert [r.licenses for r in op4.scan_licenses(docs(["a b"]), [("x", None), ("y", "A B")]).collect()] == [["y"]]


def test_license_templates_that_overlap_do_not_depend_on_passes(docs):
    # b overlaps a and c, c is fullest in the text: b yields to c, and a to b though b yields
    w = [f"v{i}" for i in range(60)]
    text = " ".join(w)
    a = " ".join(w[:18] + ["no1", "no2"])
    b = " ".join(w[12:34] + ["no3"])
    c = " ".join(w[30:50])
    for order in ([("A", a), ("B", b), ("C", c)], [("C", c), ("B", b), ("A", a)], [("B", b), ("C", c), ("A", a)]):
        want = brute_licenses(text, order)
        for size in (10, len(a) + len(b) + 5, 1 << 20):
            assert [r.licenses for r in op4.scan_licenses(docs([text]), order, part_bytes=size).collect()] == [want]


def test_altered_licenses_are_found(docs, words):
    """Notices of 30 words or more keep four fifths of their shingles when a word is another."""
    rng = random.Random(4)
    long = [(n, t) for n, t in op4.TEMPLATES if len(t.split()) >= 30]
    texts = []
    for i in range(60):
        t = long[i % len(long)][1].split()
        t[rng.randrange(5, len(t) - 5)] = "altered"
        texts.append(words(i, 40) + " " + " ".join(t) + " " + words(100 + i, 40))
    got = {r.doc_id: r.licenses for r in op4.scan_licenses(docs(texts)).collect()}
    assert sum(long[i % len(long)][0] in got[i] for i in range(60)) == 60


# --- 6: personal data ---

PII = ["a@b.c@d.e@f.g", "x.y+z@a-b.c..d@e.f.g h@i.j-", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.255", "4111 1111 1111 1111 4111-1111-1111-1111  4111111111111111", "+1 (234) 567-8901+44 20 7946 0958 +12", "é😀 q@w.e +1 (234) 567-8901.", "a" * 3000 + "@b.c", "1 " * 2000, "x@" + "c." * 2000 + "d", None, "", "+1" + " " * 500 + "2", "@@@ a@ @b.c"]


def base_spans(text):
    """The base spans by Python's regular expressions."""
    import re

    text, out = text or "", []
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            double = [int(x) * (1 + i % 2) for i, x in enumerate(reversed(d))]
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 16 <= len(d) <= 19 and sum(x - 9 * (x > 9) for x in double) % 10 == 0, "phone": 8 <= len(d) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_are_brute_force(spark, docs, words):
    long = "é" + words(1, 4000) + "".join(f" 😀 u{i}@x.org, 10.0.0.{i % 256}" for i in range(400)) + words(2, 2000)
    texts = [*PII, long]
    d = docs(texts + PII[:2]).withColumn("spans", F.lit(1)).withColumn("k1", F.lit(2)).withColumn("__k1", F.lit(3)).withColumn("__spans", F.lit(4))
    found, source = op6.spans(d)
    rows = source.join(found, ["k1", "k2"], "left").collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        base = [(op6.KINDS[s.k - 1], s.start, s.end) for s in r.spans or [] if s.base]
        assert base == base_spans(r.text)
    spans_of = {r.doc_id: [(s.start, s.end, op6.KINDS[s.k - 1]) for s in r.spans or []] for r in rows}
    out = op6.redact(d)
    assert out.columns == d.columns
    for r in out.collect():
        text, upto, want = (texts + PII[:2])[r.doc_id], 0, ""
        for s, e, kind in sorted(spans_of[r.doc_id]):
            want += text[upto : max(upto, s)] + (f"[{kind.upper()}]" if e > upto else "")
            upto = max(upto, e)
        assert r.text == (text if text is None else want + text[upto:])


def test_no_python_in_the_plan(docs):
    import re

    plan = op6.redact(docs(PII[:4]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval|MapInArrow", plan)


def test_tokens_bare_phones_and_spelled_addresses_are_added(docs, words):
    rng = random.Random(3)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    number = lambda: f"({rng.randrange(212, 290)}) {rng.randrange(512, 590)}-{rng.randrange(1000, 9999)}"
    texts, want, base_phones = [], [], 300
    for i in range(600):
        a, b = words(i, 6), words(1000 + i, 6)
        kind = ["SECRET", "PHONE", "EMAIL"][i % 3]
        planted = [f'token = "{key()}"', f"call {number()}", f"write jane.doe{i} at example{i} dot com"][i % 3]
        shown = ['token = "[SECRET]"', "call [PHONE]", "write [EMAIL]"][i % 3]
        texts.append(f"{a} {planted} {b}")
        want.append(f"{a} {shown} {b}")
        assert f"[{kind}]" in want[-1]
    texts += [f'x = "{key()}" y']  # no cue, but what else tells a token
    want += ['x = "[SECRET]" y']
    for i in range(200):  # commits have no cue and stand between blanks
        texts.append(f"{words(i, 5)} commit {key()} of {i}")
        want.append(texts[-1])
    for i in range(base_phones):  # pieces of a base phone, whose codes can't be dialled, are no negatives
        texts.append(f"{words(i, 5)} +1 ({rng.randrange(100, 199)}) 555-{rng.randrange(1000, 9999)} n{i}")
        want.append(f"{words(i, 5)} [PHONE] n{i}")
    got = {r.doc_id: r.text for r in op6.redact(docs(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_trees_learn_and_thresholds_keep_precision(docs):
    rows = [((3, 2, 3, c, 0, 0, 1), 100.0, 95.0 if c else 5.0) for c in (0, 1)]
    t = op6.Trees(rows)
    assert t.score(rows[1][0]) > 1 > -1 > t.score(rows[0][0])
    assert op6.Trees([]).trees == []
    assert op6.redact(docs([])).count() == 0


# --- 8: toxicity ---


def test_toxicity_learns_words_and_leaves_clean_texts(spark, docs, words):
    rng = random.Random(2)
    bad = ["trashy", "moronic", "vile"]
    texts, toxic = [], []
    for i in range(400):
        t = words(i, 40, 300).split()
        if i % 4 == 0:
            for _ in range(rng.randrange(2, 8)):
                t[rng.randrange(40)] = rng.choice(bad)
        texts.append(" ".join(t))
        toxic.append(int(i % 4 == 0))
    labels = spark.createDataFrame([(i, 1, x) for i, x in enumerate(toxic) if i < 300] + [(None, 1, 1), (5, None, None), (1, 0, 0)], "doc_id long, quality int, toxic int")
    d = docs(texts + [None, ""], [*range(400), None, None]).withColumn("toxic", F.lit("x"))
    model = op8.model_of(d, labels)
    got = op8.grade(d, model).collect()
    held = [r for r in got if r.doc_id is not None and r.doc_id >= 300]
    assert all(r.toxic == bool(toxic[r.doc_id]) for r in held) and len(held) == 100
    assert all(0 <= r.severity <= 2 and r.grade in (0, 1, 2) for r in got) and {r.grade for r in got} == {0, 1, 2}
    assert [r.toxic for r in got if r.doc_id is None] == [False, False]
    kept = op8.harmless(d, model)
    assert kept.columns == d.columns and kept.count() == 302
    again = op8.model_of(d, labels)
    assert (again.weights == model.weights).all()


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    d = docs(["a b", None])
    assert [r.toxic for r in op8.grade(d, op8.model_of(d, none)).collect()] == [False, False]
    assert op8.grade(docs([]), op8.model_of(docs([]), none)).count() == 0


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(3)
    score, cut, level = rng.standard_normal(40), np.array([-0.4, 0.9]), rng.integers(0, 3, 40)

    def value(score, cut):
        p = 1 / (1 + np.exp(-(cut[None, :] - score[:, None])))
        p = np.c_[p[:, 0], p[:, 1] - p[:, 0], 1 - p[:, 1]]
        return -np.log(p[np.arange(40), level]).mean()

    got, by_score, by_cut = op8.loss(score, cut, level)
    assert np.isclose(got, value(score, cut))
    for k in range(40):
        step = np.eye(40)[k] * 1e-6
        assert np.isclose(by_score[k], (value(score + step, cut) - value(score - step, cut)) / 2e-6, atol=1e-7)
    for k in range(2):
        step = np.eye(2)[k] * 1e-6
        assert np.isclose(by_cut[k], (value(score, cut + step) - value(score, cut - step)) / 2e-6, atol=1e-7)


def test_grades_are_brute_force(spark, docs):
    """Scores from the model's weights, word by word."""
    import math
    import re

    names = ["bad", "worse", "fine"]
    hashes = [int(Words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]), op1.WORD).hashes()[0]) for w in names]
    order = np.argsort(np.array(hashes, np.uint64))
    weights = np.array([1.5, 2.5, -1.0])
    model = op8.Model(np.array(hashes, np.uint64)[order], weights[order], np.array([2.0, 4.0]))
    texts = ["Bad bad, worse", "fine bad", "nothing here", "", None, "worse " * 9, "bad " * 40_000, "worse " * 9]
    got = {r.doc_id: r for r in op8.grade(docs(texts), model).collect()}
    for i, t in enumerate(texts):
        found = re.findall("[a-z]+", (t or "").lower())
        score = sum(math.log1p(found.count(w)) * x for w, x in zip(names, weights) if w in found)
        above = [1 - 1 / (1 + math.exp(-(c - score))) for c in (2.0, 4.0)]
        assert math.isclose(got[i].severity, sum(above), rel_tol=1e-9) and math.isclose(got[i].p_toxic, above[0], rel_tol=1e-9)
        chances = [1 - above[0], above[0] - above[1], above[1]]
        assert got[i].grade == chances.index(max(chances)) and got[i].toxic == (above[0] >= 0.5)


def test_toxicity_of_repeated_ids_and_texts_is_the_same_again(spark, docs, words):
    texts = [words(i, 30, 200) + (" vile vile" if i % 3 == 0 else "") for i in range(120)]
    ids = [i // 2 for i in range(120)]  # two texts an id
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    models = [op8.model_of(d, labels) for d in (docs(texts, ids), docs(texts + texts, ids + ids).repartition(5))]
    assert (models[0].words == models[1].words).all() and np.allclose(models[0].weights, models[1].weights)
