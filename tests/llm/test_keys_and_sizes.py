"""Text ids, many languages, many ranges, and the footrule of the permutation index."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from gleanery.llm import backoff, fingerprint, language, permutation, ranges

TEXTS = ["the cat sat on the mat by the door", "a dog lay by the door", "", None, "été déjà vu", "the cat and the dog", "door mat cat", "x " * 300]


def rows_with(spark, name):
    return spark.createDataFrame([(name(n), TEXTS[n % len(TEXTS)], n % 3 > 0) for n in range(40)], "doc_id string, text string, taught boolean")


def test_ranges_of_text_keys_follow_their_order(spark):
    draw = random.Random(3)
    keys = ["doc-" + "".join(draw.choices("abcxyzé0", k=draw.randint(0, 9))) for _ in range(300)] + [None]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    points = ranges.cuts(df, "key", 6)
    got = sorted(((r.key, r.part) for r in ranges.with_range(df, "key", points, "part").where("key is not null").collect()), key=lambda r: r[0].encode())
    assert len({part for _, part in got}) >= 4
    assert [part for _, part in got] == sorted(part for _, part in got)


def test_blocks_beyond_the_most_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranges, "MAX_RANGES", 3)
    df = spark.range(900).withColumnRenamed("id", "key")
    placed, blocks = ranges.with_block(df, "key", 10, "block", F.xxhash64("key"))
    sizes = {r.block: r["count"] for r in placed.groupBy("block").count().collect()}
    assert blocks == 12 and set(sizes) <= set(range(12)) and max(sizes.values()) < 150


def test_scores_and_fingerprints_by_text_ids(spark):
    named = rows_with(spark, lambda n: f"doc-{n:05d}")
    numbered = named.withColumn("doc_id", F.substring("doc_id", 5, 5).cast("long"))
    found = {}
    for df in (named, numbered):
        scored = backoff.score(df, F.col("taught"), block_bytes=400)
        found[df] = sorted((int(str(r.doc_id)[-5:].lstrip("doc-") or 0), r.n_tokens, r.n_known, round(r.score, 9)) for r in scored.collect())
        edited = sorted((int(str(r.doc_id)[-5:].lstrip("doc-") or 0), r.fingerprint, r.edited_sha256, r.near_next) for r in fingerprint.with_edited(df).collect())
        found[df] += edited
    assert found[named] == found[numbered] and len(found[named]) == 80


def test_more_languages_than_a_model_has_whole_cells_for(spark):
    draw = random.Random(8)
    many = 450
    letters = "abcdefghijklmnopqrstuvwxyz"
    alphabets = ["".join(draw.sample(letters, 4)) for _ in range(many)]
    text = lambda n: " ".join("".join(draw.choices(alphabets[n], k=6)) for _ in range(60))
    docs = spark.createDataFrame([(n, text(n), f"l{n:03d}") for n in range(many)], "doc_id long, text string, lang string")
    model = language.train(docs)
    assert len(model.languages) == many and model.table.shape[1] < language.CELLS
    asked = spark.createDataFrame([(n, text(n)) for n in range(0, many, 30)], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language.predict(asked, model).collect()}
    right = sum(got[n] == f"l{n:03d}" for n in got) / len(got)
    assert right >= 0.8


def test_candidates_are_the_nearest_by_footrule_and_length():
    draw = np.random.default_rng(2)
    vectors, asked = draw.normal(size=(900, 16)) * draw.lognormal(size=(900, 1)), draw.normal(size=(20, 16))
    directions = np.linalg.qr(draw.normal(size=(16, 16)))[0].T
    near, mine = permutation.nearest(vectors, directions), permutation.nearest(asked, directions)
    posted = near.shape[1]
    lengths = np.linalg.norm(vectors, axis=1)
    files = permutation.Files(near, lengths)
    for order in mine:
        gain = np.zeros(len(vectors))
        for v, own in enumerate(near):
            rank = {int(p): r for r, p in enumerate(own)}
            gain[v] = sum(2 * posted - r - abs(r - rank[int(p)]) for r, p in enumerate(order) if int(p) in rank)
        want = np.sort(gain * lengths)[::-1][:50]
        got = files.candidates(order, 50)
        assert len(set(got.tolist())) == 50 and np.allclose(np.sort((gain * lengths)[got])[::-1], want)
    assert math.isclose(len(files.candidates(mine[0], 5000)), len(vectors))
