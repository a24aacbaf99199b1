"""Ranked search, source audit and line quality against brute force, and on the odd cases their docstrings define."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm_operators import nothing, odd  # noqa: F401

from gleanery.llm import divergence, language, linecrf, queries, treap

SF_DIR = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def letters(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


# ranked search


def brute_rank(docs, items, k):
    """(item, rank, doc, score) by the plain formula, over every document."""
    held = [(key, Counter(terms(text))) for key, text in docs]
    held = [(key, tf, sum(tf.values())) for key, tf in held if tf]
    count, length = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, tf, _ in held for t in tf)
    out = []
    for item, text in items:
        scored = []
        for key, tf, n in held:
            m = 50 + (50 * n * count) // length
            score = 0
            for t in set(terms(text)) & set(tf):
                w = math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1)))
                score += w * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 20 * m))
            if score > 0:
                scored.append((-score, key is None, key, score))
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(item, n, key, score) for n, (_, _, key, score) in enumerate(scored[:k], 1)]
    return out


def answers(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("block", [3, 1 << 15])
def test_rank_equals_brute_force(spark, odd, block):  # noqa: F811
    draw = random.Random(block)
    vocabulary = [f"w{n}" for n in range(40)] + ["été", "pneumonoultramicroscopic", "pneumonoultramicroscopes"]
    rows = [(n, " ".join(draw.choices(vocabulary, k=draw.randint(0, 30)))) for n in range(60)]
    rows += rows[:5] + [(r.doc_id, r.text) for r in odd.collect()]
    items = [(n, " ".join(draw.choices(vocabulary, k=n)) + " Cat WORD12 unheard") for n in range(8)] + [(3, "w1 w1"), (None, "chat"), (9, None), (9, "")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    asked = spark.createDataFrame([(*r, 2) for r in items], "item_id long, text string, rank int")
    got = treap.rank(docs, asked, k=7, block_docs=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert answers(got) == sorted(brute_rank(rows, items, 7), key=str)


def test_rank_by_text_ids_and_of_empty_tables(spark, nothing):  # noqa: F811
    docs = spark.createDataFrame([("b", "x y"), ("a", "y x"), (None, "x y")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "X"), ("r", "absent")], "item_id string, text string")
    got = treap.rank(docs.withColumn("text", F.concat("text", F.lit(" z"))).union(spark.createDataFrame([("c", "k")] * 9, docs.schema)), items)
    assert [(r.item_id, r.rank, r.doc_id) for r in got.orderBy("rank").collect()] == [("q", 1, "a"), ("q", 2, "b"), ("q", 3, None)]
    assert treap.rank(docs.limit(0), items).collect() == []
    assert treap.rank(docs, items.limit(0)).collect() == []
    assert treap.rank(docs.select("doc_id", F.lit("").alias("text")), items).collect() == []


def test_items_in_several_runs(spark, monkeypatch):
    docs = spark.createDataFrame([(n, f"a{n % 3} b{n % 5} c") for n in range(30)], "doc_id long, text string")
    items = spark.createDataFrame([(n, f"a{n % 3} b{n} c") for n in range(6)], "item_id long, text string")
    whole = answers(treap.rank(docs, items, k=4))
    monkeypatch.setattr(treap, "ITEM_BYTES", 10)
    assert answers(treap.rank(docs, items, k=4)) == whole


@pytest.mark.parametrize("rows, cols", [(1, 1), (1, 50), (37, 5), (64, 200)])
def test_descent_finds_the_best_columns(rows, cols):
    draw = np.random.default_rng(rows * cols)
    dense = draw.integers(0, 9, (rows, cols)) * (draw.random((rows, cols)) < 0.3)
    r, c = np.nonzero(dense)
    grid = treap.Treap(r, c, dense[r, c], rows, cols)
    assert [int(t.max(initial=0)) for t in grid.tops] == [int(dense.max(initial=0))] * (grid.height + 1)
    for k in (1, 5, 100):
        mine = np.unique(draw.integers(0, rows, 6))
        weights = draw.integers(1, 50, len(mine))
        want = weights @ dense[mine]
        found, scores = grid.best(mine, weights, k, 1)
        assert (scores == want[found]).all() and len(set(found.tolist())) == len(found)
        least = max(np.sort(want)[::-1][:k].min(), 1)
        assert sorted(found.tolist()) == np.flatnonzero(want >= least).tolist()


# source audit


def brute_audit(rows, min_docs, top):
    docs = [(lang or "", source or "", letters(text)) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = {t for t, n in df.items() if n >= min_docs}
        of = defaultdict(Counter)
        for _, source, found in mine:
            of[source].update(t for t in found if t in kept)
            of[None].update(t for t in found if t in kept)
        p = {s: {t: 1 + (10**9 * (c[t] + 5)) // (sum(c.values()) + 5 * len(kept)) for t in kept} for s, c in of.items()}
        for source in of:
            if source is None:
                continue
            pairs = [(sum(abs(p[source][t] - p[o][t]) for t in kept), o) for o in of if o not in (None, source)]
            over = [(p[source][t] - p[None][t], t) for t in kept if of[source][t] and p[source][t] > p[None][t]]
            for part, found, most in (("pair", pairs, None), ("term", over, top)):
                found.sort(key=lambda f: (-f[0], f[1].encode()))
                out += [(lang, source, part, item, value, n) for n, (value, item) in enumerate(found[:most], 1)]
    return out


def test_pointers_are_sorted_as_words_are():
    draw = random.Random(5)
    stems = ["a", "ab", "abcdefgh", "abcdefghi", "abcdefghabcdefgh", "abcdefghabcdefghz", "été", "z" * 40, "z" * 41]
    words = [draw.choice(stems) + draw.choice(["", "x", "yy"]) for _ in range(500)]
    data = np.frombuffer(" ".join(words).encode() + bytes(8), np.uint8)
    sizes = np.array([len(w.encode()) for w in words])
    starts = np.cumsum(sizes + 1) - sizes - 1
    order, heads = divergence.pointer_sort(data, starts, sizes)
    encoded = [words[k].encode() for k in order]
    assert encoded == sorted(w.encode() for w in words)
    assert [encoded[h] for h in heads] == sorted({w.encode() for w in words})


@pytest.mark.parametrize("shard, block, cell", [(16 << 20, 64, 8192), (64, 2, 3)])
def test_audit_equals_brute_force(spark, odd, shard, block, cell):  # noqa: F811
    draw = random.Random(block)
    pool = ["Alpha", "beta", "internationalisation", "internationalisations", "été", "中文", "x1y", "gamma!"]
    rows = [(" ".join(draw.choices(pool, k=draw.randint(0, 9))), draw.choice(["en", "fr", None, ""]), draw.choice(["a", "b", "c", "d", "e", "z", None])) for _ in range(120)]
    rows += [("", "xx", "lonely"), (None, "yy", "p"), ("1 2", "yy", "q")] + [(r.text, r.lang, r.source) for r in odd.collect()]
    docs = spark.createDataFrame([(*r, "t", 1) for r in rows], "text string, lang string, source string, term string, n long")
    got = divergence.audit(docs, min_docs=2, top_terms=3, shard_bytes=shard, block=block, cell_words=cell)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert answers(got) == sorted(brute_audit(rows, 2, 3), key=str)


def test_audit_of_nothing(nothing, odd):  # noqa: F811
    assert divergence.audit(nothing).collect() == []
    # no word in thirty documents: pairs alone, all at distance 0
    assert {(r.part, r.value) for r in divergence.audit(odd).collect()} == {("pair", 0)}


def test_words_longer_than_a_shard_are_whole(spark):
    long = "x" * 5000
    docs = spark.createDataFrame([(f"{long} a {long}", "en", "s"), (f"a {long}y", "en", "t")], "text string, lang string, source string")
    got = {(r.source, r.term): (r.n_docs, r.n) for r in divergence.runs(docs, shard_bytes=100).collect()}
    assert got == {("s", long): (1, 2), ("s", "a"): (1, 1), ("t", "a"): (1, 1), ("t", long + "y"): (1, 1)}


# quality


def test_lines_are_those_of_the_texts():
    texts = ["", "a b\nc", "\n", "one\n\ntwo\n", "é", "", "x\n"]
    found = linecrf._lines(*linecrf.words.raw(pa.array(texts, pa.large_string())))
    joined = "".join(texts).encode()
    lines = [joined[a:b].decode() for a, b in zip(*found[:2], strict=True)]
    assert lines == [line for t in texts for line in t.split("\n")]
    assert np.diff(found[2]).tolist() == [t.count("\n") + 1 for t in texts]


def random_chains(seed, sizes):
    draw = np.random.default_rng(seed)
    bins = draw.integers(0, linecrf.BINS - 1, (sum(sizes), len(linecrf.FEATURES))).astype(np.uint8)
    weights = draw.normal(0, 0.4, 3 + 3 * linecrf.WIDTH)
    return bins, np.concatenate([[0], np.cumsum(sizes)]), weights


def test_marginals_and_loss_equal_all_labellings():
    sizes = [1, 4, 2, 6]
    bins, first, weights = random_chains(1, sizes)
    labels = np.array([1.0, 0.0, 1.0, 1.0])
    none = np.full((1, bins.shape[1]), linecrf.MISSING)
    want, value = [], 0.0
    for d, size in enumerate(sizes):
        mine = np.concatenate([none, bins[first[d] : first[d + 1]], none]).astype(int)
        place = np.arange(bins.shape[1]) * linecrf.BINS
        u = [
            weights[0] + sum(weights[3 + n * linecrf.WIDTH :][mine[t + shift] + place].sum() for n, shift in ((0, 0), (1, -1), (2, 1)))
            for t in range(1, size + 1)
        ]
        total, good = 0.0, np.zeros(size)
        for labelling in itertools.product((0, 1), repeat=size):
            score = sum(x for x, y in zip(u, labelling, strict=True) if y)
            score += sum(weights[1 + a] for a, b in itertools.pairwise(labelling) if a == b)
            total += math.exp(score)
            good += math.exp(score) * np.array(labelling)
        want += list(good / total)
        own = sum(u) + weights[2] * (size - 1) if labels[d] else weights[1] * (size - 1)
        value += (math.log(total) - own) / size / len(sizes)
    assert np.allclose(linecrf.Model(weights, 1, 0).marginals(bins, first), want)
    loss, gradient = linecrf._loss(linecrf.Chains(bins, first), labels, weights)
    assert math.isclose(loss, value + linecrf.RIDGE / 2 * float(weights @ weights), rel_tol=1e-9)
    for n in (0, 1, 2, 40, 250, 600):
        step = np.zeros_like(weights)
        step[n] = 1e-5
        up, down = (linecrf._loss(linecrf.Chains(bins, first), labels, weights + s)[0] for s in (step, -step))
        assert math.isclose((up - down) / 2e-5, gradient[n], abs_tol=1e-6)


def test_neighbouring_lines_count():
    """A plain line between bad ones is likelier bad than the same line between good ones."""
    bad, good, plain = "BUY!!! NOW!!! $$$ ### BUY!!!", "The cat sat on the mat by the door.", "Some words here"
    texts = ["\n".join([bad] * 5), "\n".join([good] * 5)] * 20
    model = linecrf.fit(*linecrf.features(pa.array(texts, pa.large_string())), np.array([0.0, 1.0] * 20))
    bins, _, first = linecrf.features(pa.array(["\n".join([bad, plain, bad]), "\n".join([good, plain, good])], pa.large_string()))
    found = model.marginals(bins, first)
    assert found[0] < 0.5 < found[3] and found[1] < found[4]


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = queries.queries()["op12_line_crf"](spark, sf)
    assert got.count() == docs.count()
    held = got.where("held_out").join(labels, "doc_id").select("score", "predicted", "quality").collect()
    assert sum(r.predicted == r.quality for r in held) / len(held) >= 0.97
    good, bad = ([r.score for r in held if r.quality == q] for q in (1, 0))
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) >= 0.98
    assert {(r.doc_id % 1, r.held_out) for r in got.where(language.fold("doc_id") == 0).collect()} == {(0, True)}


def test_quality_odd_cases(spark, odd, nothing):  # noqa: F811
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 0), (7, None, 0), (99, 1, 0), (None, 0, 0), (6, 5, 0)], "doc_id long, quality int, toxic int")
    model = linecrf.train(odd, labels)
    got = linecrf.score(odd.withColumns({"n_lines": F.lit(1), "score": F.lit("s")}), model)
    rows = got.collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 1}) == 1
    assert len({r.score for r in rows if r.doc_id in (3, 4)}) == 1
    assert {r.n_lines for r in rows if r.doc_id in (3, 4)} == {1} and {r.n_lines for r in rows if r.doc_id == 5} == {2}
    assert linecrf.score(nothing, model).collect() == []
    assert {r.score for r in linecrf.score(odd, linecrf.train(odd, labels.limit(0))).collect()} == {0.5}
    assert {r.score for r in linecrf.score(odd, linecrf.train(odd, labels.where("quality = 1"))).collect()} == {0.75}
    texts = odd.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    assert linecrf.score(texts, linecrf.train(texts, labels.withColumn("doc_id", F.col("doc_id").cast("string")))).count() == odd.count()


def test_sample_is_bounded_in_documents(spark):
    docs = spark.createDataFrame([(n, "a fine line." if n % 2 else "!!! ###") for n in range(200)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    model = linecrf.train(docs, labels, sample_docs=40)
    assert all((r.score > 0.5) == bool(r.doc_id % 2) for r in linecrf.score(docs, model).collect())
