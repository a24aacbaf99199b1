"""Language-model scores by a weighted backoff automaton.

The model is an interpolated n-gram model over all training tokens. Its states are the histories that occur in
training; a stored n-gram is an arc of weight log10 P(w | h), with

    P(w | h) = MU c(h w) / c(h) + (1 - MU) P(w | h')        h' being h without its first token,
    P(w)     = (c(w) + 0.5) / (N + 0.5 (V + 1)),

and where no arc leaves a state for a token, the failure arc to h' is taken at the cost log10(1 - MU). A
history that never occurs is no state: it falls to h' at no cost. The state after a token depends on the last
n - 1 tokens only, so the traversal is evaluated for all places of a block of texts at once.

The automaton grows with the corpus and is never in one place. Documents are dealt into blocks of about
``BLOCK_BYTES`` by ranges of their id. A block asks for the counts of its distinct n-grams: the requests, as
packed sorted arrays with the block's own training counts, go to shards by n-gram; a shard adds up the counts of
all blocks and answers every block in the order of its request; the documents meet the answers in their block
and are scored there. Nothing but N and V reaches the driver. A very frequent n-gram costs one entry per block.

Tokens: maximal runs of bytes other than space and 9 to 13, A-Z lowered, then one end per text. A null text is
the empty one: its end is its only token. N-grams are told apart by 63-bit hashes. Repeated rows count each
time and get equal scores; documents of the same id share a block. With no training text every token is the one
unknown one, of probability 1: all scores are 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gleanery.llm import ranges, words
from gleanery.session import bound_batches, durable

ORDER = 2
MU = 0.3
BLOCK_BYTES = 24 << 20
_U = np.uint64
_END = _U(0x5851F42D4C957F2D)
_STEP = _U(0xDA942042E4DD58B5)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, ends included, and each text's first one."""
    hashed, first = words.word_hashes(texts, words.SOLID)
    count = np.diff(first) + 1
    begin = np.concatenate([[0], np.cumsum(count)])
    out = np.full(int(begin[-1]), _END, np.uint64)
    out[np.arange(len(hashed)) + np.repeat(np.arange(len(count)), count - 1)] = hashed
    return out, begin


def grams(stream: np.ndarray, begin: np.ndarray, order: int) -> list[np.ndarray]:
    """Keys of the 1-grams, 2-grams, ... that end at each place; odd for 1-grams, even for others, 0 for none.

    Before a text's first token stands an end.
    """
    depth = np.arange(len(stream)) - np.repeat(begin[:-1], np.diff(begin))
    found = [stream | _U(1)]
    for k in range(2, order + 1):
        before = np.empty_like(stream)
        before[1:] = found[-1][:-1]
        if k == 2:
            before[begin[:-1]] = _END | _U(1)
        keys = words.mix(before * _STEP + stream + _U(k)) & ~_U(1)
        if k > 2:
            keys[depth < k - 2] = 0
        found.append(keys)
    return found


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Distinct keys, ascending; sorts in place. ``np.unique`` without counts hashes, which takes many times as long."""
    keys.sort()
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return keys[new]


def _places(asked: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where keys lie in ascending ones; they are looked up in order, so that each is near the one before."""
    order = np.argsort(keys)
    at = np.empty(len(keys), np.int64)
    at[order] = np.searchsorted(asked, keys[order])
    return at


def _pack(keys: np.ndarray) -> bytes:
    """Byte planes: the upper bytes of sorted keys repeat."""
    return keys.view(np.uint8).reshape(len(keys), -1).T.tobytes()


def _unpack(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(size, -1).T.copy().reshape(-1).view(kind)


def _shards(keys: np.ndarray, count: int) -> np.ndarray:
    """Where each shard's keys begin in sorted keys."""
    edges = [(s << 64) // count for s in range(1, count)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(edges, np.uint64)), [len(keys)]]).astype(np.int64)


def _requests(order: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}  # keys by block: of training texts, of others

        def flush(blocks):
            for block in blocks:
                train, other = (np.concatenate(part) if part else np.zeros(0, np.uint64) for part in held.pop(block)[:2])
                seen, counts = np.unique(train, return_counts=True)
                keys = _distinct(np.concatenate([seen, other]))
                own = np.zeros(len(keys), np.uint32)
                own[np.searchsorted(keys, seen)] = counts
                at = _shards(keys, shards)
                full = np.flatnonzero(np.diff(at))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(full.astype(np.int32)),
                        pa.array(np.full(len(full), block, np.int32)),
                        pa.array([_pack(keys[at[s] : at[s + 1]]) for s in full], pa.binary()),
                        pa.array([_pack(own[at[s] : at[s + 1]]) for s in full], pa.binary()),
                    ],
                    ["shard", "block", "keys", "counts"],
                )

        for batch in batches:
            for part in words.slices(batch, "text"):
                block = np.array(part.column("block").to_pylist(), np.int64)
                if (block[1:] < block[:-1]).any():
                    by_block = np.argsort(block, kind="stable")
                    part, block = part.take(pa.array(by_block)), block[by_block]
                stream, begin = tokens(words.column(part, "text"))
                found = grams(stream, begin, order)
                train = np.repeat(np.array(part.column("train").to_pylist(), bool), np.diff(begin))
                edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
                for start, stop in zip(edges, edges[1:], strict=False):
                    mine = slice(begin[start], begin[stop])
                    entry = held.setdefault(int(block[start]), [[], [], 0])
                    for keys in found:
                        there = keys[mine] != 0
                        entry[0].append(keys[mine][train[mine] & there])
                        entry[1].append(keys[mine][~train[mine] & there])
                    entry[2] += int(begin[stop] - begin[start])
                # a task sends what it holds once that is as much as a block
                if sum(e[2] for e in held.values()) > BLOCK_BYTES // 4:
                    yield from flush(list(held))
        yield from flush(list(held))

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up a shard's counts and answers each block; all of a shard's rows follow each other."""

    def flush(shard, rows):
        keys = np.concatenate([k for _, k, _ in rows])
        counts = np.concatenate([c for _, _, c in rows]).astype(np.int64)
        seen, place = np.unique(keys, return_inverse=True)
        total = np.bincount(place, weights=counts, minlength=len(seen)).astype(np.int64)
        single = (seen & _U(1)) == 1
        known, size = int(((total > 0) & single).sum()), int(total[single].sum())
        asked: dict[int, list] = {}
        at = 0
        for block, own, _ in rows:
            asked.setdefault(block, []).append(place[at : at + len(own)])
            at += len(own)
        for n, (block, parts) in enumerate(asked.items()):
            mine = total[_distinct(np.concatenate(parts))]
            small = np.minimum(mine, 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block], pa.int32()), pa.array([shard], pa.int32()), pa.array([small.tobytes()], pa.binary()),
                    pa.array([mine[small == 255].astype("<i8").tobytes()], pa.binary()),
                    pa.array([known if n == 0 else 0], pa.int64()), pa.array([size if n == 0 else 0], pa.int64()),
                ],
                ["block", "shard", "small", "large", "known", "size"],
            )

    shard, rows = None, []
    for batch in batches:
        columns = (batch.column(name).to_pylist() for name in ("shard", "block", "keys", "counts"))
        for where, block, keys, counts in zip(*columns, strict=True):
            if where != shard and rows:
                yield from flush(shard, rows)
                rows = []
            shard = where
            rows.append((block, _unpack(keys, "<u8"), _unpack(counts, "<u4")))
    if rows:
        yield from flush(shard, rows)


def _scores(order: int, mu: float, size: int, known: int, key_type: pa.DataType):
    scale = size + 0.5 * (known + 1)

    def flush(parts, answers):
        """Scores of one block; answers in the order of the shards."""
        small = np.concatenate([np.frombuffer(s, np.uint8) for s, _ in answers])
        count = small.astype(np.int64)
        count[small == 255] = np.concatenate([np.frombuffer(x, "<i8") for _, x in answers])
        asked = _distinct(np.concatenate([keys for _, found, _ in parts for keys in found]))
        asked = asked[asked != 0]
        if len(asked) != len(count):
            raise RuntimeError("the answers do not fit the block's n-grams")
        end = count[np.searchsorted(asked, _END | _U(1))]
        for name, found, begin in parts:
            at = begin[:-1]
            sizes = np.diff(begin)
            seen = count[_places(asked, found[0])]
            first = seen > 0
            p = (seen + 0.5) / scale
            base = np.log10(p)
            for k in range(1, order):
                there = found[k] != 0
                mine = np.where(there, count[np.minimum(_places(asked, found[k]), len(count) - 1)], 0)
                # the history's count: that of the gram one shorter that ends a place earlier
                history = np.empty_like(seen)
                history[1:] = seen[:-1]
                if k == 1:
                    history[at] = end
                history[~there] = 0
                p = np.where(history > 0, mu * mine / np.maximum(history, 1) + (1 - mu) * p, p)
                seen = mine
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(name, key_type),
                    pa.array(sizes.astype(np.int64)),
                    pa.array(np.add.reduceat(first.astype(np.int64), at)),
                    pa.array(np.full(len(sizes), size, np.int64)),
                    pa.array(np.add.reduceat(base, at)),
                    pa.array(np.add.reduceat(np.log10(p), at)),
                ],
                ["key", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, answers, parts = None, [], []
        for batch in batches:
            # answers of a block come before its documents
            for part in words.slices(batch, "text"):
                own = np.array(part.column("block").to_pylist(), np.int64)
                edges = np.flatnonzero(np.diff(own)) + 1
                for start, stop in zip([0, *edges], [*edges, len(own)], strict=True):
                    if own[start] != block:
                        if parts:
                            yield from flush(parts, answers)
                        block, answers, parts = own[start], [], []
                    piece = part.slice(start, stop - start)
                    asks = np.array(piece.column("shard").to_pylist(), np.int64)
                    cut = int((asks >= 0).sum())
                    for row in piece.slice(0, cut).select(["small", "large"]).to_pylist():
                        answers.append((row["small"], row["large"]))
                    docs = piece.slice(cut)
                    if docs.num_rows:
                        stream, begin = tokens(words.column(docs, "text"))
                        parts.append((docs.column("key").to_pylist(), grams(stream, begin, order), begin))
        if parts:
            yield from flush(parts, answers)

    return run


def score(
    docs: DataFrame, train, key: str = "doc_id", text: str = "text", order: int = ORDER, mu: float = MU, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) per document.

    ``train`` is a condition on the columns of ``docs``; the model learns from the rows where it is true.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(
        F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train")
    )
    size = rows.agg(F.sum(F.octet_length("text") + 1).alias("size")).first()["size"] or 0
    shape = f"key {docs.schema[key].dataType.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    if not size:
        return spark.createDataFrame([], shape).withColumnRenamed("key", key)
    placed, blocks = ranges.with_block(rows, "key", -(-size // block_bytes), "block", F.xxhash64("key", "text"))
    shards = max(blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    asked = placed.select("text", "train", "block").mapInArrow(_requests(order, shards), "shard int, block int, keys binary, counts binary")
    answers = asked.repartitionById(shards, F.col("shard")).mapInArrow(
        _answer, "block int, shard int, small binary, large binary, known long, size long"
    )
    answers = durable(answers)
    whole = answers.agg(F.sum("known").alias("known"), F.sum("size").alias("size")).first()
    none = F.lit(None)
    met = placed.select("block", F.lit(-1).alias("shard"), "key", "text", none.cast("binary").alias("small"), none.cast("binary").alias("large")).unionByName(
        answers.select("block", "shard", none.cast(docs.schema[key].dataType).alias("key"), F.lit("").alias("text"), "small", "large")
    )
    met = met.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", F.col("shard") < 0, "shard")
    run = _scores(order, mu, whole["size"] or 0, whole["known"] or 0, to_arrow_type(docs.schema[key].dataType))
    return met.mapInArrow(run, shape).withColumnRenamed("key", key)
