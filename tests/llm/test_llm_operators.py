"""Each operator against brute force, a library or a round trip, and on the odd cases its docstring defines."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from gleanery import session
from gleanery.llm import (
    backoff, bagminhash, bytebpe, fingerprint, language, licenses, mixing, permutation, piececount, queries, ranges, stars, warc, words,
)

DOCS = "doc_id long, text string, lang string, source string, n_tokens int, hash string, key string, block int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns with the operators' own names."""
    long = " ".join(f"word{k % 977}" for k in range(30_000))
    rows = [
        (1, "the cat sat on the mat and the dog lay by the door", "en", "a"),
        (1, "the cat sat on the mat and the dog lay by the door", "en", "a"),
        (2, "The cat sat on the mat and the dog lay by the door!", "en", "b"),
        (3, None, "en", "b"),
        (4, "", None, None),
        (5, " \n\t ", "fr", "a"),
        (6, long, "en", "a"),
        (7, "12 34 !! ??", "en", None),
        (None, "le chat est sur la table et le chien est ici", "fr", "c"),
        (8, "le chat est sur la table", "fr", "c"),
        (9, "été déjà vu à l'école", "fr", "c"),
        (10, "中文 日本語 🙂", None, "d"),
    ]
    return spark.createDataFrame([(*r, 7, "x", "y", 3) for r in rows], DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def texts_of(df):
    return [r.text or "" for r in df.select("text").collect()]


# words and shingles


def test_words_are_runs_of_a_kind_within_one_text():
    texts = ["a b  c", "", "Hello WORLD hello", "é x", " ", "x" * 3000]
    hashed, first = words.word_hashes(pa.array(texts, pa.large_string()))
    assert np.diff(first).tolist() == [len(re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", t)) for t in texts]
    assert hashed[first[2]] == hashed[first[2] + 2] != hashed[first[2] + 1]


def test_hashes_do_not_depend_on_neighbours_or_chunks(monkeypatch):
    texts = [" ".join(random.Random(k).choices("ab abc x yz é".split(), k=50)) for k in range(20)]
    whole, first = words.word_hashes(pa.array(texts, pa.large_string()))
    alone = [words.word_hashes(pa.array([t], pa.large_string()))[0] for t in texts]
    assert (whole == np.concatenate(alone)).all()
    monkeypatch.setattr(words, "SLICE_BYTES", 40)
    assert (words.word_hashes(pa.array(texts, pa.large_string()))[0] == whole).all()


def test_shingles():
    hashed, first = words.word_hashes(pa.array(["a b c", "a b c d e f", "", "a b c d e"], pa.large_string()))
    values, begin = words.shingle_hashes(hashed, first)
    assert np.diff(begin).tolist() == [1, 2, 0, 1]
    assert values[1] == values[3]
    assert values[0] not in values[1:]


def test_ranges_are_even_and_put_nulls_last(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 990, F.col("id")).alias("id"))
    points = ranges.cuts(df, "id", 4)
    got = {r.part: r["count"] for r in ranges.with_range(df, "id", points, "part").groupBy("part").count().collect()}
    assert sorted(got) == [0, 1, 2, 3] and max(got.values()) < 300
    assert ranges.with_range(df.where("id is null"), "id", points, "part").distinct().collect()[0].part == 3


# 1 archives


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, id string, digest string")


def test_archives_round_trip(spark, tmp_path):
    big = "".join(chr(0x100 + k % 700) for k in range(9_000))
    trap = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello" * 30
    rows = [
        (1, "http://a/", big, None, None), (2, "http://b/", big, "z", "z"), (3, None, "short", None, None), (4, "http://c", "short", None, None),
        (5, "u v\r\n", None, None, None), (None, "http://n/", big, None, None), (6, "http://t/", trap, None, None),
        (7, "http://t/", trap, None, None), (1, "http://a/", big, None, None), (8, "", "", None, None), (None, None, None, None, None),
    ]
    warc.write(warc.records(warc.captures(pages(spark, rows)), segment=1_000, chunk=300), str(tmp_path / "w"))
    whole = warc.reassemble(warc.read(spark, str(tmp_path / "w")))
    got = Counter(tuple(r) for r in warc.resolve(whole).collect())
    want = Counter()
    for key, _, html, *_ in rows:
        body = (html or "").encode()
        same = [k for k, _, h, *_ in rows if (h or "").encode() == body and k is not None]
        first = min(same) if same and len(body) >= 100 else None
        later = first is not None and (key is None or key > first)
        name = None if key is None else str(key)
        want[(name, len(body), hashlib.sha256(body).hexdigest(), "revisit" if later else "response", str(first) if later else None, "ok")] += 1
    assert got == want


def test_broken_archives_are_reported(spark, tmp_path):
    rows = [(1, "http://a/", "a" * 2_500, None, None), (2, "http://b/", "b" * 2_500, None, None), (3, "http://b/", "b" * 2_500, None, None)]
    made = warc.records(warc.captures(pages(spark, rows)), segment=1_000).collect()
    kept = [r.value for r in made if "WARC-Segment-Number: 2\r\n" not in r.value]
    spark.createDataFrame([(v,) for v in kept], "value string").coalesce(1).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(
        str(tmp_path / "w")
    )
    got = warc.resolve(warc.reassemble(warc.read(spark, str(tmp_path / "w")))).collect()
    assert {(r.key, r.record_type, r.status, r.payload_bytes) for r in got} == {
        ("1", "response", "missing_segment", None), ("2", "response", "missing_segment", None), ("3", "revisit", "missing_segment", None),
    }
    assert warc.payload(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nhel") is None
    assert warc.payload(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3;x=1\r\nhel\r\n0\r\n\r\n") == b"hel"
    assert warc.payload(b"HTTP/1.1 200 OK\r\n\r\nplain") == b"plain"


# 2 fingerprints


def jaccard(a: dict, b: dict) -> float:
    names = set(a) | set(b)
    return sum(min(a.get(x, 0), b.get(x, 0)) for x in names) / max(1, sum(max(a.get(x, 0), b.get(x, 0)) for x in names))


@pytest.mark.parametrize("sign", [fingerprint.signatures, bagminhash.signatures])
@pytest.mark.parametrize("most", [1, 3, 40, 500])
def test_collisions_estimate_weighted_jaccard(sign, most):
    rng = np.random.default_rng(most)
    errors = []
    for _ in range(60):
        names = np.unique(rng.integers(1, 1 << 48, 40, dtype=np.uint64))
        a, b = rng.integers(0, most + 1, (2, len(names)))
        a[0] = b[1] = 1
        bags = [dict(zip(names[x > 0].tolist(), x[x > 0].tolist(), strict=True)) for x in (a, b)]
        first = np.array([0, (a > 0).sum(), (a > 0).sum() + (b > 0).sum()])
        made = sign(np.concatenate([names[a > 0], names[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), first, 256)
        errors.append((made[0] == made[1]).mean() - jaccard(*bags))
    assert abs(np.mean(errors)) < 0.015
    assert np.std(errors) < 0.05


def test_edited_texts_and_next_documents(spark, odd, nothing):
    got = fingerprint.with_edited(odd).collect()
    order = sorted(((r.doc_id is None, r.doc_id or 0), r.text or "") for r in odd.select("doc_id", "text").collect())
    assert len(got) == len(order)
    texts = {k: t for k, t in order}
    keys = [k for k, _ in order]
    by_key = {(r.doc_id is None, r.doc_id or 0): r for r in got}
    for n, (key, text) in enumerate(order):
        following = texts[keys[(n + 1) % len(keys)]]
        if keys.count(key) > 1:
            continue
        cut = len(text) // 4
        changed = text[: len(text) - cut] + following[:cut]
        r = by_key[key]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        marks = fingerprint.fingerprints(pa.array([text, changed, following], pa.large_string()))
        rows, has = marks
        near = fingerprint.likeness(rows[[0, 0]], has[[0, 0]], rows[[1, 2]], has[[1, 2]])
        assert (r.near_edited, r.near_next) == tuple(near)
    assert by_key[(False, 3)].fingerprint == by_key[(False, 4)].fingerprint == ""
    assert by_key[(False, 1)].fingerprint == by_key[(False, 2)].fingerprint != ""
    assert fingerprint.with_edited(nothing).collect() == []
    one = fingerprint.with_edited(odd.where("doc_id = 8")).collect()[0]
    assert one.near_next == 1.0


def test_next_documents_over_many_ranges(spark):
    texts = {k * 3: f"text {k} " + "ab " * (k % 7) for k in range(200)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in fingerprint.with_edited(df).collect()}
    keys = sorted(texts)
    for a, b in zip(keys, [*keys[1:], keys[0]], strict=True):
        assert got[a].edited_sha256 == hashlib.sha256(fingerprint.edited(texts[a], texts[b]).encode()).hexdigest()


# 3 language


def test_languages_of_the_test_documents(spark):
    found = queries.op3_language_mixture(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = found.join(docs, "doc_id").where("held_out and lang is not null")
    assert held.where("lang = lang_pred").count() / held.count() > 0.97
    assert found.count() == 1000
    assert found.where("score < 0 or score > 1").count() == 0


def test_language_odd_cases(odd, nothing):
    model = language.train(odd.where("lang in ('en', 'fr')"))
    got = {r.doc_id: r for r in language.predict(odd, model).collect()}
    for key in (3, 4, 5, 7):
        assert (got[key].lang_pred, got[key].score, got[key].languages) == ("und", 0.0, [])
    assert got[1].lang_pred == got[2].lang_pred == got[6].lang_pred == "en"
    assert got[8].lang_pred == got[None].lang_pred == "fr"
    assert got[10].lang_pred in ("en", "fr")
    empty = language.train(nothing)
    assert {r.lang_pred for r in language.predict(odd, empty).collect()} == {"und"}
    assert language.predict(nothing, model).collect() == []
    kept = language.keep(odd, model)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "1", "2", "6", "None", "8", "9", "10"])


def test_mixtures_are_separated(spark):
    rng = random.Random(3)
    word = lambda letters: "".join(rng.choices(letters, k=6))
    rows = [(k, " ".join(word("abcdef" if k % 2 else "uvwxyz") for _ in range(60)), "x" if k % 2 else "y") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df)
    both = " ".join(word("abcdef") for _ in range(70)) + " " + " ".join(word("uvwxyz") for _ in range(30))
    names, share, sets = model.predict(pa.array([both, rows[0][1]], pa.large_string()))
    assert names == ["x", "y"] and abs(share[0] - 0.7) < 0.03 and sets == [["x", "y"], ["y"]]


def test_mixtures_of_many_languages(spark):
    rng = random.Random(5)
    alphabets = {"l1": "abcd", "l2": "efgh", "l3": "ijkl", "l4": "mnop", "l5": "qrst", "l6": "uvwx"}
    some = lambda name, n: [" ".join("".join(rng.choices(alphabets[name], k=6)) for _ in range(n))]
    rows = [(k, some(name, 60)[0], name) for k, name in enumerate(list(alphabets) * 30)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    wanted = [{"l1": 40, "l2": 30, "l3": 20, "l4": 10}, dict.fromkeys(alphabets, 25) | {"l6": 50}, {"l2": 30}]
    mixed = [" ".join(sum((some(name, n) for name, n in parts.items()), [])) for parts in wanted]
    names, share, sets = model.predict(pa.array(mixed, pa.large_string()))
    assert sets == [["l1", "l2", "l3", "l4"], list(alphabets), ["l2"]]
    assert names == ["l1", "l6", "l2"]
    assert np.allclose(share, [0.4, 50 / 175, 1.0], atol=0.02)
    # alone or among others, a text gets the same
    assert [model.predict(pa.array([text], pa.large_string()))[1][0] for text in mixed] == list(share)


def test_proportions_are_those_of_a_long_em():
    rng = np.random.default_rng(2)
    likely = rng.uniform(0.2, 1.0, size=(4, 900)).astype(np.float32)
    likely[0, :500] += 0.3
    at, sizes = np.array([0, 300]), np.array([300, 600])
    weights, value, gap = language.Model._mix(likely, at, sizes)
    for k, (start, size) in enumerate(zip(at, sizes, strict=True)):
        own, long = likely[:, start : start + size].astype(float), np.full(4, 0.25)
        for _ in range(20_000):
            joint = own * long[:, None]
            long = (joint / joint.sum(axis=0)).mean(axis=1)
        best = np.log(long @ own).sum()
        assert value[k] <= best + 1e-6 <= value[k] + gap[k] + 1e-3
        assert best - value[k] < 0.1


# 4 licences


def test_licence_texts(spark):
    s = licenses.SENTENCES
    mit = "Copyright (c) X\n\n" + ".\n\n".join([s["mit_grant"] + ":\n", s["mit_notice"], s["mit_as_is"].upper(), s["mit_liable"]]) + "."
    bsd = "\n".join([s["bsd_use"] + ":", "1. " + s["bsd_source"].replace("notice,", "notice,\n   ") + ".", "2. " + s["bsd_binary"] + "."])
    apache = (
        'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\n'
        "See the License for the specific language governing permissions and\nlimitations under the License."
    )
    rows = [
        (1, mit, ["MIT"], 4), (2, bsd, ["BSD-2-Clause"], 3), (3, apache, ["Apache-2.0"], 3), (4, None, [], 0), (5, "", [], 0),
        (6, "// SPDX-License-Identifier: MIT\nint x;", ["MIT"], 1), (7, "see licensed under cc by-nc 4.0", [], 0),
        (8, "Prose. Licensed under CC BY-NC 4.0.\nReleased under the MIT License.", ["CC-BY-NC-4.0", "MIT"], 2),
        (9, "word " * 50_000 + "\nLicensed under CC BY 4.0.", ["CC-BY-4.0"], 1), (None, "Licensed under CC BY 4.0.", ["CC-BY-4.0"], 1),
    ]
    df = spark.createDataFrame([(k, t, "own", "own") for k, t, *_ in rows], "doc_id long, text string, cuts string, found string")
    got = {r.doc_id: (r.licenses, r.n_sentences) for r in licenses.scan(df).collect()}
    assert got == {k: (names, n) for k, _, names, n in rows}
    assert licenses.scan(df.limit(0)).collect() == []


MPL_HEADER = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
"""
LGPL_HEADER = """    This library is free software; you can redistribute it and/or
    modify it under the terms of the GNU Lesser General Public
    License as published by the Free Software Foundation; either
    version 2.1 of the License, or (at your option) any later version.

    This library is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
    Lesser General Public License for more details.
"""
GPL_HEADER = """// This program is free software: you can redistribute it and/or modify
// it under the terms of the GNU General Public License as published by
// the Free Software Foundation, either version 3 of the License, or
// (at your option) any later version.
//
// This program is distributed in the hope that it will be useful,
// but WITHOUT ANY WARRANTY; without even the implied warranty of
// MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
// GNU General Public License for more details.
"""
APACHE_HEADER = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
"""


def test_licence_headers_as_they_are_in_files(spark):
    later = "GPL-3.0-or-later"
    rows = [
        (MPL_HEADER, ["MPL-2.0"]),
        (MPL_HEADER.replace("https:", "http:"), ["MPL-2.0"]),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ["MPL-2.0"]),
        ("If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", ["MPL-2.0"]),
        (LGPL_HEADER, ["LGPL-2.1-or-later"]),
        (LGPL_HEADER.replace("2.1", "3"), [f"L{later}"]),
        (GPL_HEADER, [later]),
        (GPL_HEADER.replace("GNU General", "GNU Lesser General"), [f"L{later}"]),
        (GPL_HEADER.replace("This program is free", "This library is free").replace("GNU General", "GNU Lesser General"), [f"L{later}"]),
        (GPL_HEADER.replace("GNU General", "GNU Affero General"), [f"A{later}"]),
        (GPL_HEADER.replace("software:", "software;").replace("Foundation,", "Foundation;"), [later]),
        (GPL_HEADER.replace("software:", "software;").replace("Foundation,", "Foundation;").replace("version 3", "version 2"), ["GPL-2.0-or-later"]),
        (APACHE_HEADER, ["Apache-2.0"]),
        ("Distributed under the MIT License.", ["MIT"]),
        ("Distributed under CC BY 4.0.", ["CC-BY-4.0"]),
        ("Distributed with this file.", []),
    ]
    named = ["GPL-2.0-or-later", later, "LGPL-2.1-or-later", f"L{later}", f"A{later}", "GPL-2.0-only", "MPL-2.0", "Zlib", "Unlicense", "BSD-3-Clause", "ISC"]
    rows += [(f"/* SPDX-License-Identifier: {name} */\nint x;", [name]) for name in named]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in licenses.scan(df).collect()}
    assert got == {k: names for k, (_, names) in enumerate(rows)}


# 5 byte-level BPE


@pytest.fixture(scope="module")
def codec():
    return queries.byte_codec()


def odd_strings(count=1500):
    rng = random.Random(11)
    parts = ["a", "b", " ", "  ", "\n", "é", "中", "🙂", "1", "'s", "\0", "▁", "<s>", "</s>", "<unk>", "the ", "\t", " ", "'", ".", "ſ", " "]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(count)]


def test_ids_equal_the_library(spark, codec):
    ranks = bytebpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    real = texts_of(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    for text in [*odd_strings(), *real, "x" * 20_000, "ab" * 5_000]:
        ids = codec.encode(text)
        assert ids == np.array(library.encode_ordinary(text), "<u4").tobytes()
        assert codec.decode(ids) == text.encode()


def test_perfect_hash_finds_its_entries_only(codec):
    table = codec.table
    assert sorted(table.find(e) for e in table.entries) == list(range(len(table.entries)))
    assert all(table.find(x) == -1 for x in (b"qqqqzzzz", b" notaword12", bytes(range(200, 220))))
    small = bytebpe.PerfectHash([b"a"])
    assert (small.find(b"a"), small.find(b"b"), bytebpe.PerfectHash([]).find(b"a")) == (0, -1, -1)


def test_split_for_narrow_texts_equals_the_pattern():
    split, rng = bytebpe.splitter(public_tokenizers.PATTERN), random.Random(5)
    for _ in range(2_000):
        text = "".join(chr(rng.randrange(0x250)) for _ in range(25))
        assert split(text) == regex.findall(public_tokenizers.PATTERN, text)


def test_remembered_pre_tokens_take_bounded_bytes(monkeypatch):
    """Texts of pre-tokens that never come again, some of them long, leave no more behind than the bound."""
    monkeypatch.setattr(bytebpe, "MEMO_BYTES", 64 << 10)
    ranks = bytebpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng, fresh = random.Random(6), queries.byte_codec()
    memo = fresh._tools()[1]
    for size in [3, 8, 8, 40_000, 12] * 20:
        text = " ".join("".join(rng.choices("etaoinshrdlu", k=size)) for _ in range(60 if size < 100 else 1)) + " the same again"
        assert fresh.encode(text) == np.array(library.encode_ordinary(text), "<u4").tobytes()
        held = [*memo.items(), *memo.older.items()]
        assert sum(len(piece) + len(ids) for piece, ids in held) <= bytebpe.MEMO_BYTES


@pytest.mark.parametrize("operator", ["language", "encode"])
def test_batches_of_long_texts_are_bounded(spark, codec, operator):
    """Ten thousand long texts do not meet in one Arrow batch."""
    spark.conf.unset(session.ARROW_BATCH_LIMIT)
    docs = spark.createDataFrame([(1, "some words", "en")], "doc_id long, text string, lang string")
    if operator == "language":
        language.keep(docs, language.train(docs))
    else:
        bytebpe.encode(docs, codec)
    assert int(spark.conf.get(session.ARROW_BATCH_LIMIT)) == session.ARROW_BATCH_BYTES


def test_encode_odd_cases(odd, nothing, codec):
    got = bytebpe.encode(odd, codec).collect()
    assert len(got) == odd.count()
    empty = hashlib.sha256(b"").hexdigest()
    for r in got:
        if r.doc_id in (3, 4):
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256, bytes(r.ids)) == (0, empty, empty, b"")
    assert bytebpe.encode(nothing, codec).collect() == []


# 6 near duplicates


def brute_classes(rows, threshold=0.8):
    """Components of all pairs of texts by weighted Jaccard of their shingles; (least id by row)."""
    values, counts, first = bagminhash._bags(pa.array([t or "" for _, t in rows], pa.large_string()))
    bags = [dict(zip(values[i:j].tolist(), counts[i:j].tolist(), strict=True)) for i, j in zip(first[:-1], first[1:], strict=True)]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and bags[j] and jaccard(bags[i], bags[j]) >= threshold:
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for n, (key, _) in enumerate(rows):
        least[find(n)].append(key)
    pick = lambda keys: min((k for k in keys if k is not None), default=None)
    return [pick(least[find(n)]) for n in range(len(rows))]


def near_copies(count, seed, words_=120, edits=6):
    """Copies of one text that are near it, though often not near each other."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(4000)}" for _ in range(words_)]
    out = [" ".join(base)]
    for _ in range(count - 1):
        copy = list(base)
        for at in rng.sample(range(words_), rng.randrange(edits)):
            copy[at] = f"z{rng.randrange(10_000)}"
        out.append(" ".join(copy))
    return out


def test_classes_equal_brute_force(spark, odd):
    texts = [t for seed in range(4) for t in near_copies(40, seed)] + near_copies(30, 9, words_=4, edits=2) + ["", None, "one", "one"]
    rows = list(enumerate(texts))
    random.Random(1).shuffle(rows)
    rows += [(None, texts[0]), (None, None), rows[3], rows[3]]
    df = spark.createDataFrame([(*r, "x", 1, b"y") for r in rows], "doc_id long, text string, digest string, weight int, signature binary")
    got = Counter((r.doc_id, r.class_id) for r in bagminhash.classes(df).collect())
    assert got == Counter(zip((k for k, _ in rows), brute_classes(rows), strict=True))
    kept = bagminhash.deduplicated(df)
    assert kept.columns == df.columns
    worded = [(k, c) for (k, t), c in zip(rows, brute_classes(rows), strict=True) if (t or "").strip()]
    wordless = {str(k) for k, t in rows if not (t or "").strip()}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted([str(c) for c in {c for _, c in worded}] + list(wordless))
    assert bagminhash.classes(df.limit(0)).collect() == []
    assert bagminhash.deduplicated(odd).count() == bagminhash.classes(odd).where("head").select("doc_id", "tag").distinct().count()


def test_copies_too_far_for_a_link_make_no_table_of_pairs(spark, monkeypatch):
    rng, base = random.Random(5), [f"w{k}" for k in range(120)]
    texts = []
    for _ in range(200):
        at = set(rng.sample(range(10, 110), 2))
        texts.append(" ".join(f"z{rng.randrange(10**9)}" if k in at else w for k, w in enumerate(base)))
    counts = []

    def counted(df, cut=bagminhash.durable):
        counts.append((out := cut(df)).count())
        return out

    monkeypatch.setattr(bagminhash, "durable", counted)
    rows = list(enumerate(texts))
    got = bagminhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == Counter(zip(range(200), brute_classes(rows), strict=True))
    assert max(counts) <= 2 * bagminhash.BANDS * len(texts)  # at most a row per band and side; of pairs there are 19,900


def test_components_of_paths_and_stars(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 200), (300, 300)]
    got = {r.node: r.root for r in stars.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {k: 100 for k in range(101, 160)} | {201: 200}


# 7 piece counts


@pytest.fixture(scope="module")
def model():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return file.read()


def test_counts_equal_the_library(spark, model):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    real = texts_of(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    texts = [*odd_strings(), *real, " ", "  ", "▁", "x" * 5_000]
    counter = piececount.PieceCounter(model).with_table(real[:50])
    assert counter.count_batch(texts) == [len(library.encode(t)) for t in texts]


def test_count_odd_cases(odd, nothing, model):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    want = Counter((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or ""))) for r in odd.collect())
    got = piececount.count(odd, model, limit=20).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 20) for r in got)
    assert piececount.count(nothing, model).collect() == []


def test_shared_units_are_those_of_all_rows(spark, model, monkeypatch):
    sent = []
    real = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: (sent.append(value), real(self, value))[1])
    texts = ["early words"] * 1_000 + ["late ones come often and often"] * 3_000 + ["y" * 100_000, "é" * 60] * 5 + ["once"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.n_tokens for r in piececount.count(df, model).collect()}
    (counter,) = [value for value in sent if isinstance(value, piececount.PieceCounter)]
    units = counter.table[0].decode().split("\0")
    assert units[0] == " often" and {" early", " late", " once"} <= set(units)
    assert max(len(unit.encode()) for unit in units) <= piececount.UNIT_BYTES
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    assert got == dict(enumerate(map(len, library.encode(texts))))


def test_summaries_keep_what_is_frequent():
    rng = random.Random(9)
    seen, hot = Counter(), [f"h{k}" for k in range(5)]
    for _ in range(50):
        seen.update(rng.choice(hot) if rng.random() < 0.5 else f"r{rng.random()}" for _ in range(200))
        seen = piececount.lessened(seen, 20)
        assert len(seen) <= 20
    assert {unit for unit, _ in seen.most_common(5)} == set(hot)


# 8 language model


def automaton(rows, mu, order):
    """The model as states, arcs and failure arcs, walked token by token."""
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\0end"] for _, t in rows]
    seen = Counter()
    for (key, _), line in zip(rows, tokens, strict=True):
        if zlib.crc32(str(key if key is not None else "").encode()) % 5 != 1:
            line = ["\0end", *line]
            for k in range(1, order + 1):
                seen.update(tuple(line[at : at + k]) for at in range(0 if k > 1 else 1, len(line) - k + 1))
    size = sum(n for g, n in seen.items() if len(g) == 1)
    known = sum(len(g) == 1 for g in seen)
    base = lambda w: math.log10((seen[(w,)] + 0.5) / (size + 0.5 * (known + 1)))

    def weight(state, w):
        if not state:
            return base(w)
        if not seen[state]:
            return weight(state[1:], w)
        if not seen[(*state, w)]:
            return math.log10(1 - mu) + weight(state[1:], w)
        return math.log10(mu * seen[(*state, w)] / seen[state] + (1 - mu) * 10 ** weight(state[1:], w))

    found = []
    for line in tokens:
        state, score = ("\0end",), 0.0
        for w in line:
            score += weight(state, w)
            state = (*state, w)[-(order - 1) :]
        found.append((len(line), sum(seen[(w,)] > 0 for w in line), size, sum(map(base, line)), score))
    return found


@pytest.mark.parametrize("order,block", [(2, 3_000), (3, 50_000)])
def test_scores_equal_the_automaton(spark, odd, order, block):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    df = odd.where("doc_id <> 6 or doc_id is null").withColumn("doc_id", F.col("doc_id") + 10_000).select("doc_id", "text").union(real)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = defaultdict(list)
    for (key, _), found in zip(rows, automaton(rows, backoff.MU, order), strict=True):
        want[key].append(found)
    got = backoff.score(df, language.fold("doc_id") != 1, order=order, block_bytes=block).collect()
    assert Counter(r.doc_id for r in got) == Counter(k for k, _ in rows)
    for r in got:
        near = [f for f in want[r.doc_id] if f[:3] == (r.n_tokens, r.n_known, r.train_tokens)]
        assert any(abs(r.base_score - f[3]) < 1e-6 * abs(f[3]) and abs(r.score - f[4]) < 1e-6 * abs(f[4]) for f in near)


def test_counts_are_looked_up_in_order(monkeypatch):
    """In a large block a jump for each n-gram, or a hash table of them, takes most of the time."""
    rng = random.Random(8)
    rows = [(k, " ".join(f"w{rng.randrange(500)}" for _ in range(60))) for k in range(120)]
    ids, texts = zip(*rows, strict=True)
    train = [zlib.crc32(str(k).encode()) % 5 != 1 for k in ids]
    lookup, unique = np.searchsorted, np.unique

    def in_order(held, keys, *args):
        assert np.ndim(keys) == 0 or (keys[1:] >= keys[:-1]).all()
        return lookup(held, keys, *args)

    def by_sorting(keys, **wanted):
        assert wanted
        return unique(keys, **wanted)

    monkeypatch.setattr(np, "searchsorted", in_order)
    monkeypatch.setattr(np, "unique", by_sorting)
    placed = pa.RecordBatch.from_pydict({"text": texts, "train": train, "block": [k % 2 for k in ids]})
    asked = [row for batch in backoff._requests(2, 4)(iter([placed])) for row in batch.to_pylist()]
    assert {row["block"] for row in asked} == {0, 1}
    asked = pa.RecordBatch.from_pylist(sorted(asked, key=lambda row: row["shard"]))
    answers = [row for batch in backoff._answer(iter([asked])) for row in batch.to_pylist()]
    size, known = sum(row["size"] for row in answers), sum(row["known"] for row in answers)
    docs = [{"block": k % 2, "shard": -1, "key": k, "text": text, "small": None, "large": None} for k, text in rows]
    answers = [{name: row[name] for name in ("block", "shard", "small", "large")} | {"key": None, "text": ""} for row in answers]
    met = sorted(answers + docs, key=lambda row: (row["block"], row["shard"] < 0, row["shard"]))
    found = backoff._scores(2, backoff.MU, size, known, pa.int64())(iter([pa.RecordBatch.from_pylist(met)]))
    got = {row.pop("key"): tuple(row.values()) for batch in found for row in batch.to_pylist()}
    assert got == {k: pytest.approx(want) for k, want in zip(ids, automaton(rows, backoff.MU, 2), strict=True)}


def test_score_odd_cases(odd, nothing):
    assert backoff.score(nothing, F.lit(True)).collect() == []
    untrained = backoff.score(odd, F.lit(False)).collect()
    assert len(untrained) == odd.count()
    assert all((r.train_tokens, r.n_known, r.base_score, r.score) == (0, 0, 0.0, 0.0) for r in untrained)
    assert {r.n_tokens for r in untrained if r.doc_id in (3, 4, 5)} == {1}


# 9 mixing


def water_fill(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = [s for s in order if s not in full]
        if not rest:
            break
        level = (total - sum(3 * sizes[s] for s in full)) / sum(weight[s] for s in rest)
        more = {s for s in rest if level * weight[s] > 3 * sizes[s]}
        if not more:
            break
        full |= more
    return {s: 3.0 * sizes[s] if s in full else level * weight[s] for s in order}


def test_mix_meets_its_targets(spark):
    rng = random.Random(8)
    rows = [(k, "w " * rng.randrange(60), f"s{int(rng.random() ** 3 * 12)}" if k % 50 else None) for k in range(3_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, hash string, size int")
    made = mixing.sized(df)
    got = mixing.apply(made, mixing.plan(made)).withColumn("taken", F.col("size") * F.col("copies")).collect()
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(text.split())
    want = water_fill(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], abs_tol=1e-6)
        assert r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert len(got) == len(rows)
    for source, target in want.items():
        assert abs(taken[source] - target) <= 60
    copies = Counter(r.doc_id for r in mixing.mixed(df).collect())
    assert copies == Counter({r.key: r.copies for r in got if r.copies})
    assert mixing.mixed(df).columns == df.columns


def test_mix_odd_cases(odd, nothing):
    made = mixing.sized(odd)
    got = mixing.apply(made, mixing.plan(made)).collect()
    assert len(got) == odd.count()
    assert {r["size"] for r in got if r.key in (3, 4, 5)} == {0}
    assert mixing.mixed(nothing).collect() == []
    rows = mixing.sized(nothing)
    assert mixing.apply(rows, mixing.plan(rows)).collect() == []


# 10 nearest neighbours


def exact(rows, k):
    found = []
    for query in sorted({i for i, _ in rows if i % 20 == 0}):
        best = {}
        for own in [v for i, v in rows if i == query]:
            for i, v in rows:
                if i != query:
                    best[i] = max(best.get(i, -math.inf), float((np.array(v) * np.array(own)).sum()))
        ranked = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
        found += [(query, n, i, s) for n, (i, s) in enumerate(ranked, 1)]
    return sorted(found)


def search(spark, rows, k=20):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, query int, place string")
    found = permutation.search(df, df.where("vec_id % 20 = 0"), k=k)
    return sorted(tuple(r) for r in found.collect())


def test_search_is_exact_where_blocks_are_small(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=6).astype(np.float32).tolist()) for k in range(60)]
    rows += [(k, rows[0][1]) for k in range(60, 120)] + [rows[7], (7, rows[9][1])]
    bad = [(200, None), (220, [0.0] * 6), (240, [math.nan] * 6), (260, [math.inf] + [0.0] * 5), (280, [None] * 6), (300, [1.0, 2.0]), (None, rows[0][1])]
    got = search(spark, [(*r, 1, "x") for r in rows + bad])
    assert got == exact(rows, 20)
    assert search(spark, []) == []
    assert search(spark, [(20, [1.0], 1, "x")]) == []
    assert [g[:3] for g in search(spark, [(20, [1.0, 0.0], 1, "x"), (1, [2.0, 0.0], 1, "x")])] == [(20, 1, 1)]


def test_recall_against_brute_force(spark):
    got = defaultdict(set)
    for r in queries.op10_permutation_index(spark, "/root/testdata/sf0.1").collect():
        got[r.query_id].add(r.vec_id)
    data = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    vectors, ids = np.array(data.embedding.tolist(), float), data.vec_id.to_numpy()
    recall = []
    for at in np.flatnonzero(ids % 20 == 0):
        scores = vectors @ vectors[at]
        scores[at] = -math.inf
        recall.append(len(got[ids[at]] & set(ids[np.lexsort((ids, -scores))[:20]].tolist())) / 20)
    assert np.mean(recall) >= 0.9


def spread_vectors(spark, count, sigma, dims=64):
    """Rows of Spark's own random numbers: even directions, lengths lognormal with ``sigma``."""
    part = lambda d: F.randn(d + 1)
    rows = spark.range(0, count, 1, 4).select(F.col("id").alias("vec_id"), F.array(*[part(d) for d in range(dims)]).alias("v"), F.exp(F.randn(99) * sigma).alias("s"))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return rows.select("vec_id", F.transform("v", lambda x: (x * F.col("s") / size).cast("float")).alias("embedding"))


def recall_of(df, asked, k=20):
    got = defaultdict(set)
    for r in permutation.search(df, df.where(asked), k=k).collect():
        got[r.query_id].add(r.id)
    data = df.toPandas()
    vectors, ids = np.array(data.embedding.tolist(), float), data.vec_id.to_numpy()
    recall = []
    for at in np.flatnonzero(ids % 500 == 0):
        scores = vectors @ vectors[at]
        scores[at] = -math.inf
        recall.append(len(got[ids[at]] & set(ids[np.lexsort((ids, -scores))[:k]].tolist())) / k)
    return np.mean(recall)


@pytest.mark.parametrize("sigma", [0.0, 0.5, 1.0])
def test_recall_where_files_are_long(spark, sigma):
    df = spread_vectors(spark, 20_000, sigma).localCheckpoint()
    assert recall_of(df, "vec_id % 500 = 0") >= 0.9


def test_search_is_exact_where_files_are_far(spark):
    assert search(spark, [(20, [1.0, 0.0], 1, "x"), (1, [-1.0, 0.0], 1, "x")]) == [(20, 1, 1, -1.0)]
    rng = np.random.default_rng(6)
    rows = [(20 * k, rng.normal(size=64).astype(np.float32).tolist()) for k in range(16)]
    assert search(spark, [(*r, 1, "x") for r in rows]) == exact(rows, 20)


@pytest.mark.parametrize("size", [2, 6, 64, 100])
def test_no_bound_is_too_low(size):
    rng = np.random.default_rng(size)
    directions = np.vstack([np.linalg.qr(rng.normal(size=(size, size)))[0].T for _ in range(max(1, 64 // size))])[:64]
    vectors = rng.normal(size=(500, size))
    vectors[1::2] = vectors[::2] + rng.normal(size=(250, size)) * 0.1
    files = permutation.permutations(vectors, directions)[:, 0]
    bound = permutation.reach(vectors, directions)[:, files] * np.linalg.norm(vectors, axis=1)
    assert (vectors @ vectors.T <= bound * (1 + 1e-9)).all()
    # a cone that a vector lies in takes none of its length
    assert np.allclose(bound[np.arange(500), np.arange(500)], (vectors**2).sum(axis=1))
    if size == 64:
        assert (bound < np.linalg.norm(vectors, axis=1) * np.linalg.norm(vectors, axis=1)[:, None] * 0.99).mean() > 0.3


def test_search_is_exact_where_bounds_rule_files_out(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16))
    rows = [(k, ((centres[k % 12] + rng.normal(size=16) * 0.05) * 2.0 ** rng.integers(-9, 9)).astype(np.float32).tolist()) for k in range(700)]
    assert search(spark, [(*r, 1, "x") for r in rows]) == exact(rows, 20)
