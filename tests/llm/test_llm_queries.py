"""The registered queries against their SQL, and the pipeline against a plain version of its stages."""

import hashlib
import sys
from collections import Counter, defaultdict
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
sys.path[:0] = [str(ROOT), str(ROOT / "tests"), str(ROOT / "tests" / "llm")]

import corpus_pipeline  # noqa: E402
import oracle  # noqa: E402
from test_llm_operators import brute_classes, water_fill  # noqa: E402

from gleanery.llm import queries  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert oracle.compare(queries.queries()[name](spark, SF_DIR), oracle.connect(SF_DIR), queries.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql()) - {"op10_permutation_index"}))
def test_query_returns_a_row_per_document(spark, name):
    got = queries.queries()[name](spark, SF_DIR)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert Counter(r.doc_id for r in got.select("doc_id").collect()) == Counter(r.doc_id for r in docs.select("doc_id").collect())


def first_hash(key) -> int:
    return int(hashlib.md5(str(key).encode()).hexdigest()[:15], 16)


def test_pipeline_equals_plain_stages(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    kept = [r for r in rows if r["text"] and any(c.isalpha() for c in r["text"])]
    heads = brute_classes([(r["doc_id"], r["text"]) for r in kept])
    kept = [r for r, head in zip(kept, heads, strict=True) if r["doc_id"] == head]
    sizes = defaultdict(int)
    for r in kept:
        r["size"] = len(r["text"].encode().split())
        sizes[r["source"]] += r["size"]
    codec, want = queries.byte_codec(), Counter()
    for source, target in water_fill(sizes).items():
        mine = sorted((r for r in kept if r["source"] == source), key=lambda r: first_hash(r["doc_id"]))
        copies = int(target // sizes[source])
        need, upto, extra = target - copies * sizes[source], 0, 0
        # the prefix in hash order that comes nearest to the need, the longer of two
        for n, r in enumerate(mine, 1):
            if abs(upto + r["size"] - need) <= abs(upto - need):
                extra = n
            upto += r["size"]
            if upto >= need:
                break
        for n, r in enumerate(mine):
            ids = codec.encode(r["text"])
            times = copies + (n < extra)
            if times:
                want[(r["doc_id"], len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest())] += times
    got = corpus_pipeline.run(spark, SF_DIR)
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()) == want


def test_stages_pass_on_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(30)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF_DIR).schema == docs.schema
        assert stage(spark, docs.limit(0), SF_DIR).collect() == []
