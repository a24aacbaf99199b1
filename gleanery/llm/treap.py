"""Ranked lexical search by K2-treaps over the grid of terms and documents.

A block of documents becomes one treap: a quadtree over (term row, document column) whose levels store, per
non-empty cell, a four-bit mask of its quadrants and the largest impact inside; a child is found by the rank of
its bit. Rows are ordered by document frequency and columns by length, so that cells of rare terms stay empty and
maxima stay tight. An item descends the paths of all its rows at once: an entry of the frontier is a range of
documents with one cell per row, bounded by the sum of weight times maximum; the best entries are opened first and
ranges that cannot reach the item's k-th best score are left. Scores are whole numbers, exact at the leaves.

Postings of the items' terms are written once to the shared folder; N, L and document frequencies come from them.
Items are taken in runs of ``ITEM_BYTES`` of text, one pass over the documents each, so that the vocabulary that
goes to the tasks is bounded; a task holds one block of postings and k results per item.

Odd cases: null and empty texts have no term, and items or documents without one have no row in the result;
documents of equal score come by ascending id, null ids last; repeated rows are documents of their own, items that
share an id are ranked each by itself; an empty table on either side gives no row; texts of any length are read
whole; only the named columns are read, whatever else the tables hold.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from gleanery.llm.divergence import digits, windows_of
from gleanery.llm.words import ALNUM, LOWER, column, hashes, raw, slices, spans
from gleanery.session import shared_dir

ITEM_BYTES = 4 << 20
#: a block ends at so many documents or postings
BLOCK_DOCS = 1 << 15
BLOCK_POINTS = 1 << 21
#: ranges opened at a time
CHUNK = 256
SALTS = 64
TOP = 50

#: the fixed pattern of terms; bytes beyond ASCII belong to them
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

#: place of a quadrant's bit among the set ones, by mask and quadrant; -1 where it is not set
_RANK = np.array([[(mask & ((1 << q) - 1)).bit_count() if mask >> q & 1 else -1 for q in range(4)] for mask in range(16)], np.int32)


def terms_of(text: str | None) -> list[bytes]:
    """Distinct terms of a text, in order of first use; only A-Z are lower-cased."""
    return list(dict.fromkeys(TERM.findall((text or "").encode().lower())))


class Vocabulary:
    """Exact lookup of words in buffers: by hash first, then by all of their bytes, eight at a time."""

    def __init__(self, words: list[bytes]):
        data = np.frombuffer(b"".join(words) + bytes(8), np.uint8)
        lengths = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        keys = hashes(data, starts, ends) if words else np.zeros(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        if len(keys) and (np.diff(keys[order]) == 0).any():
            raise ValueError("two terms share a hash")  # 64 bits; at most a few hundred thousand terms
        self.keys, self.ids, self.lengths = keys[order], order, lengths
        windows = windows_of(data)
        self.digits = [digits(windows, np.minimum(starts, len(data) - 8 - depth), lengths, depth) for depth in range(0, int(lengths.max(initial=0)), 8)]

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are known, and their numbers; the data has eight spare bytes at its end."""
        if not len(self.keys) or not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys = hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == keys)
        ids, lengths = self.ids[at[hit]], (ends - starts)[hit]
        good = self.lengths[ids] == lengths
        windows = windows_of(data)
        for n, known in enumerate(self.digits):
            more = np.flatnonzero(good & (lengths > 8 * n))
            good[more] = digits(windows, starts[hit[more]], lengths[more], 8 * n) == known[ids[more]]
        return hit[good], ids[good]


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


def postings(docs: DataFrame, words: list[bytes], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, terms, tfs) per document: its terms with repeats, and which of ``words`` it holds how often."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(words)
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = raw(column(part, "text"))
                starts, ends, first = spans(data, offsets, ALNUM)
                data = np.concatenate([LOWER[data], np.zeros(8, np.uint8)])
                hit, ids = known.find(data, starts, ends)
                doc = np.repeat(np.arange(part.num_rows), np.diff(first))[hit]
                pairs = (doc << 32) | ids
                pairs.sort()
                new = np.flatnonzero(np.diff(pairs, prepend=-1))
                bounds = np.searchsorted(pairs[new], np.arange(part.num_rows + 1) << 32)
                tfs = np.diff(np.append(new, len(pairs)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array(np.diff(first)), _lists(bounds, pairs[new] & 0xFFFFFFFF), _lists(bounds, tfs)],
                    ["key", "n", "terms", "tfs"],
                )

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(scan, f"key {rows.schema['key'].dataType.simpleString()}, n long, terms array<int>, tfs array<int>")


def _spread_bits(x: np.ndarray) -> np.ndarray:
    """Every bit of a 32-bit number to twice its place."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


class Treap:
    """Levels of cells from the whole grid to single points: quadrant masks, first children, largest impacts."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, impacts: np.ndarray, n_rows: int, n_cols: int):
        self.height = max(n_rows - 1, n_cols - 1, 1).bit_length()
        codes = (_spread_bits(rows) << np.uint64(1)) | _spread_bits(cols)
        order = np.argsort(codes)
        codes, top = codes[order], impacts[order].astype(np.int32)
        self.masks, self.firsts, self.tops = [], [], [top]
        for _ in range(self.height):
            cells = codes >> np.uint64(2)
            first = np.flatnonzero(np.append(True, cells[1:] != cells[:-1])) if len(cells) else np.zeros(0, np.int64)
            bits = (np.uint8(1) << (codes & np.uint64(3)).astype(np.uint8)).astype(np.uint8)
            self.masks.append(np.bitwise_or.reduceat(bits, first) if len(first) else bits)
            self.firsts.append(first.astype(np.int32))
            top = np.maximum.reduceat(top, first) if len(first) else top
            self.tops.append(top)
            codes = cells[first]
        for levels in (self.masks, self.firsts, self.tops):
            levels.reverse()

    def best(self, rows: np.ndarray, weights: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Columns and scores: all that can be among the k best, ties at the k-th included, none under ``floor``."""
        none = np.zeros(0, np.int64)
        if not len(self.tops[0]):
            return none, none
        roots = np.zeros((1, len(rows)), np.int32)
        bound = int(weights.sum()) * int(self.tops[0][0])
        # a frontier of chunks, the one with the largest bound first
        heap, ticket = [(-bound, 0, 0, np.zeros(1, np.int64), roots, np.array([bound]))], 0
        cols, scores, held = [none], [none], none
        while heap and -heap[0][0] >= max(floor, 1):
            _, _, level, prefix, cells, bounds = heapq.heappop(heap)
            live = bounds >= max(floor, 1)
            prefix, cells = prefix[live], cells[live]
            there = cells >= 0
            at = np.where(there, cells, 0)
            masks = np.where(there, self.masks[level][at], 0)
            firsts = self.firsts[level][at]
            upper = ((rows >> (self.height - 1 - level)) & 1) << 1
            parts = []
            for side in (0, 1):
                rank = _RANK[masks, upper | side]
                parts.append((prefix * 2 + side, np.where(rank >= 0, firsts + rank, -1)))
            prefix, cells = np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts])
            impacts = np.where(cells >= 0, self.tops[level + 1][np.maximum(cells, 0)], 0)
            bounds = impacts.astype(np.int64) @ weights
            keep = np.flatnonzero(bounds >= max(floor, 1))
            if level + 1 == self.height:
                cols.append(prefix[keep])
                scores.append(bounds[keep])
                held = np.concatenate([held, bounds[keep]])
                if len(held) >= k:
                    held = np.partition(held, len(held) - k)[-k:]
                    floor = max(floor, int(held[0]))
                continue
            keep = keep[np.argsort(-bounds[keep], kind="stable")]
            for start in range(0, len(keep), CHUNK):
                part = keep[start : start + CHUNK]
                ticket += 1
                heapq.heappush(heap, (-int(bounds[part[0]]), ticket, level + 1, prefix[part], cells[part], bounds[part]))
        cols, scores = np.concatenate(cols), np.concatenate(scores)
        good = scores >= max(floor, 1)
        return cols[good], scores[good]


def _blocks(batches: Iterator[pa.RecordBatch], most: int = BLOCK_DOCS) -> Iterator[pa.Table]:
    """The task's documents in blocks bounded in rows and postings; a block has one document at least."""
    held, docs, points = [], 0, 0
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            base = int(ends[start - 1]) if start else 0
            stop = min(start + most - docs, int(np.searchsorted(ends, base + BLOCK_POINTS - points, "right")))
            stop = max(stop, start + (not docs))
            if stop > start:
                held.append(batch.slice(start, stop - start))
                docs, points = docs + stop - start, points + int(ends[stop - 1]) - base
                start = stop
            if start < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, docs, points = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def _flat(lists: pa.ChunkedArray) -> np.ndarray:
    return pc.list_flatten(lists).to_numpy().astype(np.int64)


def _finder(asked: list[tuple[np.ndarray, np.ndarray]], row_of: np.ndarray, names: pa.Array, docs: int, length: int, k: int, most: int):
    """Searches of all items over a task's blocks: at most k documents an item, by score and key."""
    n_rows = int(row_of.max(initial=0)) + 1

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[pa.Table | None] = [None] * len(asked)
        floors = [1] * len(asked)
        for block in _blocks(batches, most):
            sizes = block.column("n").to_numpy()
            order = np.argsort(sizes, kind="stable")
            col = np.empty(len(order), np.int64)
            col[order] = np.arange(len(order))
            doc = np.repeat(np.arange(len(order)), pc.list_value_length(block.column("terms")).to_numpy())
            tf = _flat(block.column("tfs"))
            m = 50 + np.array([50 * n * docs // length for n in sizes.tolist()], np.int64)
            impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[doc])
            grid = Treap(row_of[_flat(block.column("terms"))], col[doc], impact, n_rows, len(order))
            keys = block.column("key").take(pa.array(order))
            for n, (rows, weights) in enumerate(asked):
                cols, scores = grid.best(rows, weights, k, floors[n])
                if not len(cols):
                    continue
                found = pa.table({"key": keys.take(pa.array(cols)), "score": pa.array(scores)})
                found = found if best[n] is None else pa.concat_tables([best[n], found])
                best[n] = found.take(pc.sort_indices(found, [("score", "descending"), ("key", "ascending")])[:k])
                if len(best[n]) == k:
                    floors[n] = best[n].column("score")[k - 1].as_py()
        for n, found in enumerate(best):
            if found is not None:
                whose = pa.array(np.full(len(found), n, np.int32))
                columns = [whose, names.take(whose), *[c.combine_chunks() for c in found.columns]]
                yield pa.RecordBatch.from_arrays(columns, ["item", "item_key", "key", "score"])

    return search


def _item_runs(items: DataFrame) -> Iterator[list[tuple[object, list[bytes]]]]:
    """The items with a term in runs of about ``ITEM_BYTES`` of terms; the driver holds one run at a time."""
    held, size = [], 0
    for row in items.toLocalIterator():
        terms = terms_of(row["text"])
        if not terms:
            continue
        held.append((row["key"], terms))
        size += sum(map(len, terms))
        if size >= ITEM_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _rank_run(found: DataFrame, run: list[tuple[object, list[bytes]]], words: list[bytes], key_type: T.DataType, k: int, most: int) -> DataFrame | None:
    """The k best documents of every item of one run, from the run's postings."""
    stats = found.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    docs, length = stats["docs"], stats["length"]
    # at most one row per word of the run reaches the driver
    frequency = {r["t"]: r["count"] for r in found.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator()}
    if not frequency:
        return None
    row_of = np.full(len(words), -1, np.int64)
    weight = np.zeros(len(words), np.int64)
    # rows by frequency: neighbours of a rare term are rare
    for row, t in enumerate(sorted(frequency, key=lambda t: (frequency[t], t))):
        row_of[t] = row
        weight[t] = math.floor(1000 * math.log((2 * docs + 2) / (2 * frequency[t] + 1)))
    number = {w: n for n, w in enumerate(words)}
    asked = []
    for _, terms in run:
        mine = np.array([number[t] for t in terms], np.int64)
        # a term that nearly every document holds may weigh nothing
        mine = mine[(row_of[mine] >= 0) & (weight[mine] > 0)]
        asked.append((row_of[mine], weight[mine]))
    names = pa.array([key for key, _ in run], to_arrow_type(key_type))
    search = _finder(asked, row_of, names, docs, length, k, most)
    schema = f"item int, item_key {key_type.simpleString()}, key {found.schema['key'].dataType.simpleString()}, score long"
    best = found.mapInArrow(search, schema).withColumn("salt", F.spark_partition_id() % SALTS)
    order = [F.desc("score"), F.asc_nulls_last("key")]
    for whose in (["item", "salt"], ["item"]):  # an item's candidates are thinned by parts first
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*whose).orderBy(*order))).where(F.col("rank") <= k)
    return best


def rank(
    docs: DataFrame,
    items: DataFrame,
    k: int = TOP,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    block_docs: int = BLOCK_DOCS,
) -> DataFrame:
    """(item_key, rank, key, score): the k documents of the highest score above 0 for every item."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/treap-{uuid4().hex}"
    items = items.select(F.col(item_key).alias("key"), F.col(item_text).cast("string").alias("text"))
    key_type = items.schema["key"].dataType
    found = None
    for n, run in enumerate(_item_runs(items)):
        words = list(dict.fromkeys(t for _, terms in run for t in terms))
        postings(docs, words, key, text).write.parquet(f"{folder}/{n}")
        best = _rank_run(spark.read.parquet(f"{folder}/{n}"), run, words, key_type, k, block_docs)
        found = found if best is None else best if found is None else found.union(best)
    if found is None:
        of = f"item_key {key_type.simpleString()}, rank int, key {docs.schema[key].dataType.simpleString()}, score long"
        found = spark.createDataFrame([], of)
    return found.select(F.col("item_key").alias(item_key), "rank", F.col("key").alias(key), "score")


SQL = r"""
with docs as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
items as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from benchmark),
asked as (select distinct item_id, unnest(terms) as term from items),
totals as (select count(*)::bigint as docs, sum(len(terms))::bigint as length from docs where len(terms) > 0),
hits as (
  select doc_id, term, count(*)::bigint as tf, any_value(n)::bigint as n
  from (select doc_id, len(terms) as n, unnest(terms) as term from docs) where term in (select term from asked)
  group by doc_id, term),
weights as (
  select term, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w
  from hits, totals group by term),
impacts as (
  select doc_id, term, (1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // length))) as impact from hits, totals),
scores as (
  select item_id, doc_id, sum(w * impact)::bigint as score
  from asked join weights using (term) join impacts using (term) group by item_id, doc_id)
select item_id, rank, doc_id, score from (
  select *, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank from scores where score > 0)
where rank <= 50
"""
