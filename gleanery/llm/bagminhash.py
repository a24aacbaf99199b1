"""Near-duplicate classes by BagMinHash signatures over word shingles.

A text is the multiset of its shingles of five words. The weight axis of every shingle is cut at whole numbers,
and the cuts are gathered in blocks of 1, 1, 2, 4, 8, ... of them. Each block of a shingle carries a Poisson
process whose points fall into a random register and, by halving the block again and again, onto a random cut;
points above the shingle's weight do not count. A register keeps its earliest point. Two texts agree in a
register with the probability of their weighted Jaccard similarity. Points are made in ascending time up to a
bound at which all registers of a text are expected to be full, and further where they are not.

Texts that share all registers of a band are candidates. Every bucket is compared with its most central
member, pairs are verified by the overlap of their multisets, and links are joined to components. Where members
of one bucket are then still in different components, pairs across them are compared too, by signature and in
cells of two blocks: the members that have a likely partner stay. Their multisets are sent to the cells and the
pairs verified there, the likeliest first; only a pair whose components the cell has joined by then is passed
over, so that no link between different texts that share a band is lost, and no table of pairs is made. Texts with
equal multisets are one node throughout.

Signature comparisons drop a pair only below ``LIKELY`` agreeing registers, five standard deviations under the
threshold. A pair at the threshold shares no band with a probability of 5e-5.

Defined results: a text without words (null and empty ones too) is in a class of its own. ``class_id`` is the
least id in the class; null ids count as the greatest. Rows that repeat are copies like any others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gleanery.llm import words
from gleanery.llm.stars import components
from gleanery.session import broadcast_if_small, durable

REGISTERS = 128
BAND_ROWS = 5
BANDS = REGISTERS // BAND_ROWS
THRESHOLD = 0.8
LIKELY = 0.62
#: members of a bucket that a side of a cell holds, by their signatures
BLOCK = 4_096
#: bytes of multisets that a side of a cell is meant to hold, and bytes of a shingle at most
BLOCK_BYTES, _SET_BYTES = 16 << 20, 12
_U = np.uint64
_BLOCKS = np.random.Generator(np.random.PCG64(20_215)).integers(1, 1 << 63, 64, dtype=np.uint64)
_POINTS = _U(0x9FB21C651E98DF25)


def _entries(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The blocks of each term: the term, the block's number and how many cuts it has (block k ends at 2^k)."""
    depth = np.ceil(np.log2(weights)).astype(np.int64)  # the last block that a weight reaches into
    term = np.repeat(np.arange(len(weights)), depth + 1)
    block = np.arange(len(term)) - np.repeat(np.cumsum(depth + 1) - depth - 1, depth + 1)
    return term, block, np.where(block == 0, 1, 1 << np.maximum(block - 1, 0))


def _registers(values, weights, owner, docs: int, bound: np.ndarray, registers: int) -> tuple[np.ndarray, np.ndarray]:
    """Earliest points with a time below each text's bound, and which registers have one."""
    term, block, cuts = _entries(weights)
    seed = words.mix(values[term] + _BLOCKS[block])
    doc, limit = owner[term], weights[term] - np.where(block == 0, 0, cuts)
    until, drawn, time = bound[doc], np.zeros(len(term), np.int64), np.zeros(len(term))
    live = np.arange(len(term))
    found = []
    while len(live):
        # about as many points as are expected up to the bound, one more at least
        more = (np.maximum(until[live] - time[live], 0) * cuts[live]).astype(np.int64) + 1
        ends = np.cumsum(more)
        entry = np.repeat(live, more)
        number = np.arange(ends[-1]) - np.repeat(ends - more, more) + np.repeat(drawn[live], more)
        h = words.mix(seed[entry] + number.astype(np.uint64) * _POINTS)
        gaps = -np.log1p(-(h >> _U(11)).astype(np.float64) * 2.0**-53) / cuts[entry]
        run = np.cumsum(gaps)
        run += np.repeat(time[live] - (run[ends - 1] - np.add.reduceat(gaps, ends - more)), more)
        time[live] = run[ends - 1]
        drawn[live] += more
        at = np.flatnonzero(run < until[entry])
        entry, run, h = entry[at], run[at], words.mix(h[at] ^ _POINTS)
        # the cut within the block: the block halved by one bit after the other
        cut = ((h & _U(0xFFFFFFFF)) * cuts[entry].astype(np.uint64)) >> _U(32)
        fits = cut.astype(np.int64) < limit[entry]
        entry, run, h = entry[fits], run[fits], h[fits]
        found.append((doc[entry] * registers + ((h >> _U(48)) % _U(registers)).astype(np.int64), run, words.mix(h)))
        live = live[time[live] < until[live]]
    slot = np.concatenate([f[0] for f in found])
    run = np.concatenate([f[1] for f in found])
    name = np.concatenate([f[2] for f in found])
    late_first = np.argsort(-run, kind="stable")
    out, full = np.zeros(docs * registers, np.uint32), np.zeros(docs * registers, bool)
    out[slot[late_first]] = (name[late_first] >> _U(32)).astype(np.uint32)  # the earliest is written last
    full[slot] = True
    return out.reshape(docs, registers), full.reshape(docs, registers).all(axis=1)


def signatures(values: np.ndarray, weights: np.ndarray, first: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """BagMinHash registers of each multiset; a row of zeros where there are no terms."""
    docs = len(first) - 1
    out = np.zeros((docs, registers), np.uint32)
    owner = np.repeat(np.arange(docs), np.diff(first))
    todo = np.flatnonzero(np.diff(first))
    reach = registers * (np.log(registers) + 4.0)
    while len(todo):
        mine = np.isin(owner, todo) if len(todo) < docs else np.ones(len(owner), bool)
        place = np.full(docs, -1, np.int64)
        place[todo] = np.arange(len(todo))
        own = place[owner[mine]]
        total = np.bincount(own, weights=weights[mine], minlength=len(todo))
        made, full = _registers(values[mine], weights[mine], own, len(todo), reach / total, registers)
        out[todo[full]] = made[full]
        todo, reach = todo[~full], reach * 2
    return out


def _digests(values: np.ndarray, weights: np.ndarray, first: np.ndarray) -> list[bytes]:
    """128 bits of each multiset, whatever the order of its terms."""
    sums = np.zeros((len(first) - 1, 2), np.uint64)
    for k in range(2):
        each = words.mix(words.mix(values + _BLOCKS[40 + k]) + weights.astype(np.uint64) * _BLOCKS[50 + k])
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each)])
        sums[:, k] = upto[first[1:]] - upto[first[:-1]]
    return [row.tobytes() for row in sums]


def _bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return words.multisets(*words.shingle_hashes(*words.word_hashes(texts)))


def tagged(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, tag, text): the tag tells apart different texts of one id."""
    return docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tag", F.xxhash64("text"))


def profiles(rows: DataFrame, registers: int = REGISTERS) -> DataFrame:
    """(key, tag, digest, weight, signature) of rows from :func:`tagged`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "text"):
                values, counts, first = _bags(words.column(part, "text"))
                made = signatures(values, counts, first, registers)
                upto = np.concatenate([[0], np.cumsum(counts)])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key"),
                        part.column("tag"),
                        pa.array(_digests(values, counts, first), pa.binary()),
                        pa.array(upto[first[1:]] - upto[first[:-1]], pa.int64()),
                        pa.array([row.tobytes() for row in made], pa.binary()),
                    ],
                    ["key", "tag", "digest", "weight", "signature"],
                )

    kind = rows.schema["key"].dataType.simpleString()
    return rows.select("key", "tag", "text").mapInArrow(run, f"key {kind}, tag long, digest binary, weight long, signature binary")


def _likely(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose signatures agree in at least a share of the registers."""
    marks = nodes.select("digest", "signature")
    side = lambda x, s: marks.select(F.col("digest").alias(x), F.col("signature").alias(s))
    met = pairs.join(side("a", "sa"), "a").join(side("b", "sb"), "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sa, sb = (
                    np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in ("sa", "sb")
                )
                keep = pa.array((sa == sb).mean(axis=1) >= least)
                yield batch.select(["a", "b"]).filter(keep)

    return met.mapInArrow(run, "a binary, b binary")


def _sets(rows: DataFrame, found: DataFrame, wanted: DataFrame) -> DataFrame:
    """(digest, values, counts) of the wanted digests; the texts are read again, one per digest."""
    heads = (
        found.join(wanted, "digest", "left_semi")
        .groupBy("digest").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "tag")).alias("at"))
        .select(F.col("at.key").alias("k"), F.col("at.tag").alias("t"))
    )
    heads = broadcast_if_small(durable(heads))
    texts = rows.join(heads, F.col("key").eqNullSafe(F.col("k")) & (F.col("tag") == F.col("t")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "text"):
                values, counts, first = _bags(words.column(part, "text"))
                cut = lambda x: [x[i:j].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)]  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(_digests(values, counts, first), pa.binary()),
                        pa.array(cut(values), pa.binary()),
                        pa.array(cut(counts.astype(np.uint32)), pa.binary()),
                    ],
                    ["digest", "values", "counts"],
                )

    return texts.select("text").mapInArrow(run, "digest binary, values binary, counts binary").dropDuplicates(["digest"])


def overlap(a, wa, b, wb) -> float:
    """Weighted Jaccard similarity of two multisets, given as sorted values and counts."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    common = int(np.minimum(wa[i], wb[j]).sum())
    whole = int(wa.sum()) + int(wb.sum()) - common
    return common / whole if whole else 0.0


def _verified(pairs: DataFrame, rows: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b, similarity): the pairs whose multisets overlap enough.

    Both ends are dealt to blocks and pairs to cells of two blocks; a cell gets each multiset of its pairs once,
    however many of its pairs have it.
    """
    pairs = durable(pairs)
    ends = pairs.select(F.col("a").alias("digest")).union(pairs.select(F.col("b").alias("digest"))).distinct()
    sets = durable(_sets(rows, found, ends))
    size = sets.agg(F.sum(F.length("values") + F.length("counts"))).first()[0] or 0
    blocks = size // BLOCK_BYTES + 1
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    dealt = pairs.withColumn("x", block("a")).withColumn("y", block("b"))
    ends = [dealt.select("x", "y", F.col(c).alias("digest")) for c in ("a", "b")]
    held = ends[0].union(ends[1]).distinct().join(sets, "digest")
    held = held.select(F.col("x").alias("hx"), F.col("y").alias("hy"), "digest", "values", "counts")

    def run(mine: pd.DataFrame, bags: pd.DataFrame) -> pd.DataFrame:
        bag = {
            name: (np.frombuffer(values, np.uint64), np.frombuffer(counts, np.uint32))
            for name, values, counts in zip(bags["digest"], bags["values"], bags["counts"], strict=True)
        }
        similar = np.array([overlap(*bag[a], *bag[b]) for a, b in zip(mine["a"], mine["b"], strict=True)], float)
        return pd.DataFrame({"a": mine["a"], "b": mine["b"], "similarity": similar})[similar >= threshold]

    met = dealt.groupBy("x", "y").cogroup(held.groupBy("hx", "hy"))
    return durable(met.applyInPandas(run, "a binary, b binary, similarity double"))


_CELL_ROWS = ("bucket", "minor_block", "member_block", "minor", "band", "digest", "root", "main", "signature")


def _cells(shared: DataFrame, roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """Cells of the buckets whose members are in different components: a row per member, cell and side.

    Members outside a bucket's largest component, its minors, meet all its members in blocks. ``bin`` gathers cells.
    """
    owned = shared.join(roots, F.col("digest") == F.col("node"), "left").select(
        "bucket", "band", "digest", F.coalesce("root", "digest").alias("root")
    )
    owned = owned.join(nodes, "digest")
    sizes = owned.groupBy("bucket", "root").agg(F.count("*").alias("count"), F.sum(_SET_BYTES * F.col("weight")).alias("bytes"))
    main = sizes.groupBy("bucket").agg(
        F.max(F.struct("count", "root", "bytes")).alias("main"), F.count("*").alias("roots"),
        F.sum("count").alias("all"), F.sum("bytes").alias("all_bytes"),
    )
    blocks = lambda n, size: F.ceil(F.greatest(n / BLOCK, size / BLOCK_BYTES)).cast("int")
    mixed = main.where("roots > 1").select(
        "bucket",
        F.col("main.root").alias("largest"),
        blocks(F.col("all"), F.col("all_bytes")).alias("member_blocks"),
        blocks(F.col("all") - F.col("main.count"), F.col("all_bytes") - F.col("main.bytes")).alias("minor_blocks"),
    )
    met = durable(owned.join(mixed, "bucket").withColumn("main", F.col("root") == F.col("largest")).drop("largest"))
    total = met.agg(F.count("*").alias("n"), F.sum(_SET_BYTES * F.col("weight")).alias("bytes")).first()
    bins = total["n"] // BLOCK + (total["bytes"] or 0) // BLOCK_BYTES + 1
    deal = lambda n: F.pmod(F.xxhash64("digest"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    minors = met.where(~F.col("main")).withColumn("minor_block", deal("minor_blocks")).withColumn("member_block", every("member_blocks"))
    members = met.withColumn("member_block", deal("member_blocks")).withColumn("minor_block", every("minor_blocks"))
    sides = minors.withColumn("minor", F.lit(True)).unionByName(members.withColumn("minor", F.lit(False)))
    bin_ = F.pmod(F.xxhash64("bucket", "minor_block", "member_block"), F.lit(bins)).cast("int").alias("bin")
    return sides.select(bin_, *_CELL_ROWS)


def _sides(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the minors and the members of every cell."""
    *cell, minor = (rows[c].to_numpy() for c in ("bucket", "minor_block", "member_block", "minor"))
    order = np.lexsort((minor, *reversed(cell)))
    new = np.zeros(len(order), bool)
    for part in cell:
        new[1:] |= part[order[1:]] != part[order[:-1]]
    for mine in np.split(order, np.flatnonzero(new)):
        few = np.count_nonzero(minor[mine])
        if 0 < few < len(mine):
            yield mine[len(mine) - few :], mine[: len(mine) - few]


def _met(rows: pa.Table, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """Each minor's row and the rows of its likely partners in other components, the likeliest first.

    A pair is met only in the first band that both share, and once where both are minors.
    """
    rows = rows.combine_chunks()
    marks = np.frombuffer(b"".join(rows["signature"].to_pylist()), np.uint32).reshape(rows.num_rows, -1)
    roots = rows["root"].combine_chunks().dictionary_encode().indices.to_numpy()
    names = np.array(rows["digest"].to_pylist(), object)
    main, bands = rows["main"].to_numpy(), rows["band"].to_numpy()
    for minors, members in _sides(rows):
        theirs, band = marks[members], int(bands[members[0]])
        for row in minors:
            same = theirs == marks[row]
            agree = np.count_nonzero(same, axis=1)
            near = np.flatnonzero(agree >= least * marks.shape[1])
            near = near[roots[members[near]] != roots[row]]
            if len(near):
                near = near[main[members[near]] | (names[members[near]] > names[row])]
            if band and len(near):
                earlier = same[near, : band * BAND_ROWS].reshape(len(near), band, BAND_ROWS)
                near = near[~earlier.all(axis=2).any(axis=1)]
            if len(near):
                yield row, members[near[np.argsort(-agree[near], kind="stable")]]


def _across(cells: DataFrame, least: float) -> DataFrame:
    """The rows of cells that have a likely partner in another component; as many as there are at most."""

    def run(rows: pa.Table) -> pa.Table:
        wanted = np.zeros(rows.num_rows, bool)
        for row, partners in _met(rows, least):
            wanted[row] = True
            wanted[partners] = True
        return rows.filter(pa.array(wanted))

    return cells.groupBy("bin").applyInArrow(run, cells.schema)


def _joined(likely: DataFrame, rows: DataFrame, found: DataFrame, least: float, threshold: float) -> DataFrame:
    """Links (a, b) that join the components of a cell as far as its pairs are similar enough.

    The pairs are verified where they meet and never written out. A pair whose components are joined already needs
    no test, so that a cell gives fewer links than it has members.
    """
    sets = _sets(rows, found, likely.select("digest").distinct())
    held = likely.select("bin", "digest").distinct().join(sets, "digest")
    held = held.select(F.col("bin").alias("hbin"), F.col("digest").alias("hdigest"), "values", "counts")

    def run(mine: pa.Table, bags: pa.Table) -> pa.Table:
        bag = {
            name: (np.frombuffer(values, np.uint64), np.frombuffer(counts, np.uint32))
            for name, values, counts in zip(*(bags[c].to_pylist() for c in ("hdigest", "values", "counts")), strict=True)
        }
        names = mine["digest"].to_pylist()
        root = mine["root"].combine_chunks().dictionary_encode().indices.to_numpy()
        joined = np.arange(len(root))  # components by their number; those that are joined have one number
        a, b = [], []
        for row, partners in _met(mine, least):
            for other in partners.tolist():
                here, there = joined[root[row]], joined[root[other]]
                if here != there and overlap(*bag[names[row]], *bag[names[other]]) >= threshold:
                    joined[joined == there] = here
                    a.append(names[row])
                    b.append(names[other])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return durable(likely.groupBy("bin").cogroup(held.groupBy("hbin")).applyInArrow(run, "a binary, b binary"))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, tag, class_id, head) per document; head is true for the rows that stand for their class.

    ``tag`` is the 64-bit hash of the text. The heads of a class are the rows of its least (key, tag): one row,
    or several that repeat each other.
    """
    rows = tagged(docs, key, text)
    found = durable(profiles(rows))
    nodes = found.where("weight > 0").select("digest", "weight", "signature").dropDuplicates(["digest"])
    bands = [F.xxhash64(F.lit(b), F.substring("signature", b * 4 * BAND_ROWS + 1, 4 * BAND_ROWS)) for b in range(BANDS)]
    keys = nodes.select("digest", F.posexplode(F.array(*bands)).alias("band", "bucket"))
    sizes = keys.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = durable(keys.join(sizes, "bucket"))
    central = shared.groupBy("digest").agg(F.sum("n").alias("score"))
    ranked = shared.join(central, "digest")
    heads = ranked.groupBy("bucket").agg(F.max(F.struct("score", "digest")).alias("top")).select("bucket", F.col("top.digest").alias("a"))
    stars = shared.join(heads, "bucket").where(F.col("a") != F.col("digest")).select("a", F.col("digest").alias("b")).distinct()
    links = _verified(_likely(stars, nodes, LIKELY), rows, found, threshold).select("a", "b")
    roots = components(links)
    across = durable(_across(_cells(shared, roots, nodes), LIKELY))
    if not across.isEmpty():
        links = links.union(_joined(across, rows, found, LIKELY, threshold))
        roots = components(links)
    member = F.struct(F.col("key").isNull().alias("none"), "key", "tag")
    owned = found.join(roots, F.col("digest") == F.col("node"), "left").select(
        "key", "tag", "weight", F.coalesce("root", "digest").alias("root")
    )
    leads = owned.where("weight > 0").groupBy("root").agg(F.min(member).alias("lead"))
    whole = owned.where("weight > 0").join(leads, "root")
    alone = owned.where("weight = 0").withColumn("lead", member)
    first = F.col("key").eqNullSafe(F.col("lead.key")) & (F.col("tag") == F.col("lead.tag"))
    columns = ["key", "tag", F.col("lead.key").alias("class_id"), first.alias("head")]
    return whole.select(*columns).union(alone.select(*columns)).withColumnRenamed("key", key)


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that stand for their class: one of each.

    What goes is found by id and text hash, so that texts move only where that list is too long to broadcast. Of
    rows that repeat both, one stays.
    """
    named = durable(classes(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), threshold=threshold))
    gone = named.where(~F.col("head")).select(F.col("doc_id").alias("__key"), F.col("tag").alias("__tag"))
    again = (
        named.where("head").groupBy("doc_id", "tag").agg(F.count("*").alias("n")).where("n > 1")
        .select(F.col("doc_id").alias("__key"), F.col("tag").alias("__tag"))
    )
    # the row as a whole keeps its columns apart from those added here
    rows = docs.select(F.struct("*").alias("__row"), F.col(key).alias("__k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__t"))
    same = F.col("__k").eqNullSafe(F.col("__key")) & (F.col("__t") == F.col("__tag"))
    kept = rows.join(broadcast_if_small(durable(gone.distinct())), same, "left_anti")
    again = durable(again)
    if again.isEmpty():
        return kept.select("__row.*")
    again = broadcast_if_small(again)
    single = kept.join(again, same, "left_semi").dropDuplicates(["__k", "__t"])
    return kept.join(again, same, "left_anti").union(single).select("__row.*")
