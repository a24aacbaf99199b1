"""Source divergence audit: how each source's words differ from its language's other sources.

Texts are gathered into shards of ``SHARD_BYTES``. A shard's word starts are pointers into its Arrow buffer; they
are sorted by multikey quicksort, eight bytes of a word at a time, and each run of equal words yields its document
frequency and its occurrences per source. Spark merges the runs of all shards, keeps each language's words of
``min_docs`` documents or more, and compares smoothed shares (in billionths) by whole numbers only.

Pairs of sources are compared in cells of ``BLOCK`` by ``BLOCK`` sources and a share of the words, as dense
matrices; words that neither side of a cell has are added at the end by their number. Nothing but the number of
kept words sizes the cells, and no list of words or sources reaches the driver.

Odd cases: null texts, languages and sources are empty strings, and so are groups of their own; empty texts and
empty tables add no word; a source without kept words has every word at its smoothed share; repeated rows count
as often as they stand; ties in value go by the item's UTF-8 bytes; a text longer than a shard is a shard by
itself, whole; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from gleanery.llm.words import LOWER, raw, spans
from gleanery.session import broadcast_if_small, durable

SHARD_BYTES = 16 << 20
MIN_DOCS = 30
TOP_TERMS = 50
#: sources a side of a cell of pairs, and words that a cell is meant to hold
BLOCK = 64
CELL_WORDS = 8_192

_CODES = np.arange(256)
#: bytes that words are made of: ASCII letters and everything beyond ASCII
LETTERS = ((_CODES >= 65) & (_CODES <= 90)) | ((_CODES >= 97) & (_CODES <= 122)) | (_CODES >= 128)

_DIGIT = 8
#: big-endian masks that keep the first n bytes of eight
_MASKS = np.array([(1 << 64) - (1 << (64 - 8 * n)) if n else 0 for n in range(_DIGIT + 1)], np.uint64)

RUNS = "lang string, source string, term string, n_docs long, n long"


def digits(windows: np.ndarray, starts: np.ndarray, lengths: np.ndarray, depth: int) -> np.ndarray:
    """The eight bytes of each word from ``depth`` on as one number that sorts as they do; past its end zeros."""
    found = windows[starts + depth].view(">u8").ravel().astype(np.uint64)
    return found & _MASKS[np.clip(lengths - depth, 0, _DIGIT)]


def windows_of(data: np.ndarray) -> np.ndarray:
    """Eight bytes from every place of the data on, without copies; the data needs eight spare bytes at its end."""
    return np.lib.stride_tricks.as_strided(data, (len(data) - _DIGIT + 1, _DIGIT), (1, 1))


def pointer_sort(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pointers in the order of their words, and where each run of equal words begins.

    Each pass takes the next eight bytes; only runs that are still equal and go on are sorted further. Words
    hold no zero byte, so that a word that has ended differs from one that goes on.
    """
    windows = windows_of(data)
    keys = digits(windows, starts, lengths, 0)
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(order), bool)
    new[1:] = keys[1:] != keys[:-1]
    depth = _DIGIT
    while len(order):
        run = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(order)))
        going = (lengths[order] > depth) & (size[run] > 1)
        # whole runs go on, their ended words included
        at = np.flatnonzero(np.bincount(run[going], minlength=len(first))[run] > 0)
        if not len(at):
            break
        mine = order[at]
        keys, runs = digits(windows, starts[mine], lengths[mine], depth), run[at]
        within = np.lexsort((keys, runs))
        order[at], keys = mine[within], keys[within]
        new[at[1:]] |= keys[1:] != keys[:-1]
        depth += _DIGIT
    return order, np.flatnonzero(new)


def word_array(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The pointed-at words as an Arrow column."""
    ends = np.cumsum(lengths)
    at = np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    whole = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[at].tobytes()))
    return whole.cast(pa.string())


def runs_of(texts: pa.Array, langs: pa.Array, sources: pa.Array) -> pa.RecordBatch | None:
    """(lang, source, term, documents, occurrences) of one shard, by term."""
    data, offsets = raw(texts)
    starts, ends, first = spans(data, offsets, LETTERS)
    if not len(starts):
        return None
    data = np.concatenate([LOWER[data], np.zeros(_DIGIT, np.uint8)])
    lengths = ends - starts
    order, heads = pointer_sort(data, starts, lengths)
    term = np.empty(len(starts), np.uint64)
    term[order] = np.repeat(np.arange(len(heads), dtype=np.uint64), np.diff(np.append(heads, len(order))))
    # documents numbered by group, so that a group's documents of one word stand together
    langs, sources = langs.dictionary_encode(), sources.dictionary_encode()
    wide = len(sources.dictionary)
    group = langs.indices.to_numpy().astype(np.int64) * wide + sources.indices.to_numpy()
    by_group = np.argsort(group, kind="stable")
    place = np.empty(len(group), np.uint64)
    place[by_group] = np.arange(len(group), dtype=np.uint64)
    keys = (term << np.uint64(32)) | np.repeat(place, np.diff(first))
    keys.sort()
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    held = np.flatnonzero(new)  # one entry per word and document
    term = (keys[held] >> np.uint64(32)).astype(np.int64)
    group = group[by_group][(keys[held] & np.uint64(0xFFFFFFFF)).astype(np.int64)]
    new = np.ones(len(held), bool)
    new[1:] = (term[1:] != term[:-1]) | (group[1:] != group[:-1])
    at = np.flatnonzero(new)
    n_docs = np.diff(np.append(at, len(held)))
    n = np.diff(np.append(held[at], len(keys)))
    words = word_array(data, starts[order[heads]], lengths[order[heads]])
    return pa.RecordBatch.from_arrays(
        [
            langs.dictionary.take(pa.array(group[at] // wide)),
            sources.dictionary.take(pa.array(group[at] % wide)),
            words.take(pa.array(term[at])),
            pa.array(n_docs.astype(np.int64)),
            pa.array(n.astype(np.int64)),
        ],
        ["lang", "source", "term", "n_docs", "n"],
    )


def _shards(batches: Iterator[pa.RecordBatch], limit: int = SHARD_BYTES) -> Iterator[list[pa.Array]]:
    """The task's rows in runs of about ``limit`` bytes of text; one row at least, and never a cut text."""
    held, size = [], 0
    for batch in batches:
        batch = pa.RecordBatch.from_arrays([pc.fill_null(c.cast(pa.large_string()), "") for c in batch.columns], batch.schema.names)
        ends = raw(batch.column("text"))[1][1:]
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + (not size), int(np.searchsorted(ends, base + limit - size, "right")))
            held.append(batch.slice(start, stop - start))
            size += int(ends[stop - 1] - base) if stop > start else 0
            start = stop
            if start < batch.num_rows:
                yield [pa.concat_arrays([b.column(c) for b in held]) for c in range(3)]
                held, size = [], 0
    if held:
        yield [pa.concat_arrays([b.column(c) for b in held]) for c in range(3)]


def runs(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(lang, source, term, n_docs, n): equal runs of every shard of the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, shard_bytes):
            found = runs_of(*shard)
            for start in range(0, found.num_rows if found else 0, 1 << 16):
                part = found.slice(start, 1 << 16)
                columns = [c.cast(pa.string()) if pa.types.is_large_string(c.type) else c for c in part.columns]
                yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    columns = [F.col(c).cast("string").alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))]
    return docs.select(*columns).mapInArrow(run, RUNS)


def _share(n: str) -> F.Column:
    """1 + floor(10^9 (n + 5) / (total + 5 words)), by decimals."""
    return F.expr(f"cast(1 + (cast({n} + 5 as decimal(20, 0)) * 1000000000) div (total + 5 * words) as bigint)")


def _matrix_cell(cell: pa.Table, block: int) -> pa.Table:
    """Sums of share differences and numbers of words for every pair of sources of one cell."""
    own = cell.column("term").is_null().to_numpy()
    place, value = cell.column("place").to_numpy(), cell.column("p").to_numpy()
    keys = {name: cell.column(name)[0].as_py() for name in ("lang", "low", "high")}
    places = np.sort(place[own])
    column = np.searchsorted(places, place)
    base = np.empty(len(places), np.int64)
    base[column[own]] = value[own]
    words = pc.dictionary_encode(cell.column("term").filter(pa.array(~own)).combine_chunks())
    shares = np.tile(base, (len(words.dictionary), 1))
    shares[words.indices.to_numpy(), column[~own]] = value[~own]
    left = np.flatnonzero(places // block == keys["low"])
    right = np.flatnonzero(places // block == keys["high"])
    other = np.ascontiguousarray(shares[:, right])
    total = np.array([np.abs(other - shares[:, [g]]).sum(axis=0) for g in left], np.int64).reshape(len(left), len(right))
    a, b, total = np.repeat(places[left], len(right)), np.tile(places[right], len(left)), total.ravel()
    if keys["low"] < keys["high"]:
        a, b, total = np.concatenate([a, b]), np.concatenate([b, a]), np.tile(total, 2)
    keep = a != b
    return pa.table(
        {
            "lang": pa.array([keys["lang"]] * int(keep.sum()), pa.string()),
            "a": pa.array(a[keep]),
            "b": pa.array(b[keep]),
            "total": pa.array(total[keep]),
            "seen": pa.array(np.full(int(keep.sum()), len(words.dictionary))),
        }
    )


def _pairs(shares: DataFrame, groups: DataFrame, block: int, cell_words: int) -> DataFrame:
    """(lang, source, item, value) for all ordered pairs of a language's sources."""
    sized = groups.withColumn("blocks", F.expr(f"max(place) over (partition by lang) div {block} + 1"))
    sized = sized.withColumn("shards", F.expr(f"words div {cell_words} + 1"))
    cells = F.expr("explode(sequence(0L, blocks - 1))").alias("other")
    low, high = F.expr(f"least(place div {block}, other)").alias("low"), F.expr(f"greatest(place div {block}, other)").alias("high")
    # a source's smoothed share goes to each of its cells, under no word
    own = sized.select("*", F.explode(F.expr("sequence(0L, shards - 1)")).alias("shard")).select("*", cells)
    own = own.select("lang", low, high, "shard", "place", F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"))
    mine = shares.join(broadcast_if_small(sized.select("lang", "source", "place", "blocks", "shards")), ["lang", "source"])
    mine = mine.withColumn("shard", F.expr("pmod(xxhash64(term), shards)")).select("*", cells)
    mine = mine.select("lang", low, high, "shard", "place", "term", "p")
    summed = (
        own.union(mine)
        .groupBy("lang", "low", "high", "shard")
        .applyInArrow(lambda cell: _matrix_cell(cell, block), "lang string, a long, b long, total long, seen long")
        .groupBy("lang", "a", "b")
        .agg(F.sum("total").alias("total"), F.sum("seen").alias("seen"))
    )
    side = lambda place, name: groups.select("lang", F.col("place").alias(place), F.col("source").alias(name), F.col("p0").alias(f"{name}_p0"), "words")
    summed = summed.join(broadcast_if_small(side("a", "source")), ["lang", "a"])
    summed = summed.join(broadcast_if_small(side("b", "item").drop("words")), ["lang", "b"])
    return summed.select("lang", "source", "item", F.expr("total + (words - seen) * abs(source_p0 - item_p0)").alias("value"))


def audit(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    min_docs: int = MIN_DOCS,
    top_terms: int = TOP_TERMS,
    shard_bytes: int = SHARD_BYTES,
    block: int = BLOCK,
    cell_words: int = CELL_WORDS,
) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to the language's other sources, and the words it overuses.

    The shards' runs are written to the shared folder, as they are read three times.
    """
    found = durable(runs(docs, text, lang, source, shard_bytes))
    kept = found.groupBy("lang", "term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("lang_n")).where(F.col("n_docs") >= min_docs)
    kept = durable(kept.select("lang", "term", "lang_n"))
    counts = found.join(broadcast_if_small(kept.select("lang", "term")), ["lang", "term"])
    counts = durable(counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n")))
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))]).distinct()
    langs = kept.groupBy("lang").agg(F.sum("lang_n").alias("total"), F.count(F.lit(1)).alias("words"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(langs.select("lang", "words"), "lang", "left").fillna(0, ["total", "words"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = groups.withColumn("place", place.cast("long")).withColumn("n", F.lit(0).cast("long"))
    groups = durable(groups.withColumn("p0", F.when(F.col("words") > 0, _share("n")).otherwise(F.lit(0))).drop("n"))
    shares = counts.join(broadcast_if_small(groups.select("lang", "source", "total", "words")), ["lang", "source"])
    shares = shares.select("lang", "source", "term", _share("n").alias("p"))
    usual = kept.join(broadcast_if_small(langs), "lang").select("lang", "term", _share("lang_n").alias("q"))
    over = shares.join(broadcast_if_small(usual), ["lang", "term"]).where("p > q")
    over = over.select("lang", "source", F.col("term").alias("item"), F.expr("p - q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = _pairs(shares, groups, block, cell_words).withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    terms = over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*columns).union(terms.select(*columns))


SQL = r"""
with docs as (select coalesce(lang, '') as lang, coalesce(source, '') as source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms, row_number() over () as doc from documents),
hits as (select lang, source, doc, unnest(terms) as term from docs),
kept as (select lang, term, count(*) as n from hits group by lang, term having count(distinct doc) >= 30),
langs as (select lang, sum(n) as total, count(*) as words from kept group by lang),
counts as (select h.lang, h.source, h.term, count(*) as n from hits h join kept k using (lang, term) group by 1, 2, 3),
totals as (select lang, source, sum(n) as total from counts group by 1, 2),
groups as (
  select lang, source, coalesce(t.total, 0)::hugeint as total, coalesce(l.words, 0)::hugeint as words
  from (select distinct lang, source from docs) left join totals t using (lang, source) left join langs l using (lang)),
shares as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
    1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (g.total + 5 * g.words) as p
  from groups g join kept k using (lang) left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
usual as (select lang, term, 1 + (1000000000::hugeint * (n + 5)) // (total + 5 * words)::hugeint as q from kept join langs using (lang)),
gaps as (
  select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
pairs as (
  select a.lang, a.source, b.source as item, coalesce(value, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join gaps g on g.lang = a.lang and g.source = a.source and g.item = b.source),
terms as (
  select lang, source, term as item, (p - q)::bigint as value
  from shares join usual using (lang, term) where n > 0 and p > q)
select lang, source, 'pair' as part, item, value,
  (row_number() over (partition by lang, source order by value desc, encode(item)))::int as rank from pairs
union all
select * from (
  select lang, source, 'term' as part, item, value,
    (row_number() over (partition by lang, source order by value desc, encode(item)))::int as rank from terms)
where rank <= 50
"""
