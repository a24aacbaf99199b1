"""Document fingerprints by consistent weighted sampling.

A text's terms are its shingles of five words, weighted by how often they occur. For every sample k and term
the hash of both gives r and c, distributed as Gamma(2, 1), and b, uniform on [0, 1). A term of weight w offers

    t = floor(ln w / r + b),   ln a = ln c - r (t - b) - r

and sample k keeps the term and t with the least a. Two texts agree in a sample with the probability of their
generalised Jaccard similarity, the sum of the lesser over the sum of the greater weights.

c, and r with b, are read from tables of ``1 << 16`` quantiles by 16 bits of the hash each. A text without words
(null or empty, say) has the empty fingerprint; two of those are alike, and unlike any other. Equal texts have
equal fingerprints. Texts are read whole, a long one in one piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gleanery.llm import ranges, words

SAMPLES = 64
_U = np.uint64
_QUANTILES = 1 << 16
#: added to ln a, which is always above -60, so that the bits of the float order like its value
_LIFT = np.float32(64.0)


def _gamma2() -> np.ndarray:
    """Quantiles of Gamma(2, 1): solves 1 - (1 + x) exp(-x) = p by Newton's method."""
    p = (np.arange(_QUANTILES) + 0.5) / _QUANTILES
    x = np.where(p < 0.3, np.sqrt(2 * p), 1.0 - 1.5 * np.log1p(-p))
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / np.maximum(x * np.exp(-x), 1e-300), 1e-6)
    return x


_DRAWS = np.random.Generator(np.random.PCG64(20_213))
_LN_C = np.log(_gamma2()).astype(np.float32)
#: r and b by the same index: quantiles of either, in independent orders
_R = _DRAWS.permutation(_gamma2()).astype(np.float32)
_B = _DRAWS.permutation((np.arange(_QUANTILES) + 0.5) / _QUANTILES).astype(np.float32)
_DROP = (_R * (1 - _B)).astype(np.float32)
_SEEDS = _DRAWS.integers(1, 1 << 63, 1024, dtype=np.uint64)


def signatures(values: np.ndarray, weights: np.ndarray, first: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """Samples of each multiset as 32-bit words, one row each; a row of zeros where there are no terms."""
    counts = np.diff(first)
    out = np.zeros((len(counts), samples), np.uint32)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    at = first[full]
    heavy = np.flatnonzero(weights > 1)
    logs = np.log(weights[heavy]).astype(np.float32)
    x = np.empty_like(values)
    high = np.empty_like(values)
    keys = np.empty((len(values), 2), np.uint32)  # a's bits above, the term's bits below: one word that orders by a
    for k in range(samples):
        np.bitwise_xor(values, _SEEDS[k], out=x)
        x *= _U(0x9E3779B97F4A7C15)
        np.right_shift(x, _U(32), out=high)
        x ^= high
        x *= _U(0xD6E8FEB86659FD93)
        np.right_shift(x, _U(29), out=high)
        x ^= high
        parts = x.view(np.uint16).reshape(-1, 4)
        c, rb = _LN_C[parts[:, 3]], parts[:, 2]
        offer = c - _DROP[rb]  # weight 1: ln w = 0 and t = 0
        keys[:, 0] = x.view(np.uint32)[::2]
        if len(heavy):
            r, b = _R[rb[heavy]], _B[rb[heavy]]
            t = np.floor(logs / r + b)
            offer[heavy] = c[heavy] - r * (t - b) - r
            # t = 0 is the sample that weight 1 offers
            keys[heavy, 0] ^= (words.mix(t.astype(np.int64).astype(np.uint64)) * (t != 0)).astype(np.uint32)
        keys[:, 1] = (offer + _LIFT).view(np.uint32)
        out[full, k] = np.minimum.reduceat(keys.view(np.uint64)[:, 0], at).view(np.uint32)[::2]
    return out


def fingerprints(texts: pa.Array, samples: int = SAMPLES) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of texts, and which texts have words."""
    hashed, first = words.word_hashes(texts)
    terms, counts, first = words.multisets(*words.shingle_hashes(hashed, first))
    return signatures(terms, counts, first, samples), np.diff(first) > 0


def likeness(a: np.ndarray, has_a: np.ndarray, b: np.ndarray, has_b: np.ndarray) -> np.ndarray:
    """Share of samples that agree; 1 for two empty fingerprints, 0 for one."""
    return np.where(has_a & has_b, (a == b).mean(axis=1), (has_a == has_b).astype(float))


def _hex(rows: np.ndarray, has: np.ndarray) -> list[str]:
    return [row.tobytes().hex() if ok else "" for row, ok in zip(rows.astype(">u4"), has, strict=True)]


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(key, fingerprint) per document, in the order and partitions of the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "text"):
                found = _hex(*fingerprints(words.column(part, "text"), samples))
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(found, pa.string())], ["key", "fingerprint"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, fingerprint string").withColumnRenamed("key", key)


def with_next(docs: DataFrame, run, shape: str, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Run a function over the documents in ascending order of the key, each with the one after it.

    ``run`` turns an iterator of lists of (key, text, next text) into Arrow batches of ``shape``. The order is
    by key, then by the text's hash; null keys come last; after the last document comes the first. Documents
    move once: they go to even ranges of the key, and the first document of a range goes to the one before too.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    points = ranges.cuts(rows, "key", parts)
    placed = ranges.with_range(rows, "key", points, "part").withColumn("tie", F.xxhash64("text"))
    # of each range that has rows: its first document, in the order of the ranges; one row per range
    lead = placed.groupBy("part").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "tie")).alias("at")).orderBy("part").collect()
    if not lead:
        return spark.createDataFrame([], shape)
    before = {row.part: lead[k - 1].part for k, row in enumerate(lead)}
    wrap, kind = lead[0].part, rows.schema["key"].dataType
    firsts = F.create_map(
        *[
            x
            for row in lead
            for x in (F.lit(row.part), F.struct(F.lit(row["at"]["key"]).cast(kind).alias("key"), F.lit(row["at"]["tie"]).alias("tie")))
        ]
    )
    olds = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    own = F.element_at(firsts, F.col("part"))
    leads = F.col("key").eqNullSafe(own["key"]) & (F.col("tie") == own["tie"])
    there = F.struct(F.col("part").alias("part"), F.lit(0).alias("peek"))
    peek = F.struct(F.element_at(olds, F.col("part")).alias("part"), F.when(F.col("part") == wrap, 2).otherwise(1).alias("peek"))
    dealt = (
        placed.withColumn("to", F.explode(F.when(leads, F.array(there, peek)).otherwise(F.array(there))))
        .select("key", "text", "tie", F.col("to.part").alias("part"), F.col("to.peek").alias("peek"))
        .repartitionById(max(row.part for row in lead) + 1, F.col("part"))
        # the copies that look ahead come after all documents of the range
        .sortWithinPartitions("part", "peek", F.col("key").asc_nulls_last(), "tie")
        .select("key", "text", "part", F.col("peek").cast("int").alias("peek"))
    )

    def pairs(batches: Iterator[pa.RecordBatch]):
        held, part_of = None, None  # the last document, which still waits for the one after it
        for batch in batches:
            for piece in words.slices(batch, "text"):
                ready = []
                columns = zip(*(piece.column(n).to_pylist() for n in ("key", "text", "part", "peek")), strict=True)
                for key_, text_, part, ahead in columns:
                    if part != part_of:
                        held, part_of = None, part
                    if held is not None:
                        ready.append((*held, text_))
                    held = None if ahead else (key_, text_)
                if ready:
                    yield ready

    return dealt.mapInArrow(lambda batches: run(pairs(batches)), shape)


def edited(text: str, following: str) -> str:
    """The text with its last quarter of code points, rounded down, replaced by as many first ones of another."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def with_edited(docs: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per document.

    The next document is that of :func:`with_next`. A single document is its own next one.
    """
    kind = docs.schema[key].dataType.simpleString()
    shape = (
        f"`{key}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    arrow = to_arrow_type(docs.schema[key].dataType)

    def run(groups) -> Iterator[pa.RecordBatch]:
        for group in groups:
            texts = [text_ for _, text_, _ in group]
            changed = [edited(text_, following) for _, text_, following in group]
            # a document's next is the following one of the group, the last one's comes on its own
            own, has = fingerprints(pa.array([*texts, *changed, group[-1][2]], pa.large_string()), samples)
            n = len(group)
            chain = [texts[k + 1] is group[k][2] for k in range(n - 1)]
            ahead = np.array([k + 1 if k + 1 < n and chain[k] else -1 for k in range(n)])
            ahead[-1] = 2 * n
            broken = np.flatnonzero(ahead < 0)
            if len(broken):  # several ranges in one group
                more, has_more = fingerprints(pa.array([group[k][2] for k in broken], pa.large_string()), samples)
                ahead[broken] = len(own) + np.arange(len(broken))
                own, has = np.concatenate([own, more]), np.concatenate([has, has_more])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row[0] for row in group], arrow),
                    pa.array([len(text_) for text_ in texts], pa.int64()),
                    pa.array([hashlib.sha256(text_.encode()).hexdigest() for text_ in changed], pa.string()),
                    pa.array(_hex(own[:n], has[:n]), pa.string()),
                    pa.array(_hex(own[n : 2 * n], has[n : 2 * n]), pa.string()),
                    pa.array(likeness(own[:n], has[:n], own[n : 2 * n], has[n : 2 * n]), pa.float64()),
                    pa.array(likeness(own[:n], has[:n], own[ahead], has[ahead]), pa.float64()),
                ],
                [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return with_next(docs, run, shape, key, text)
