"""Language identification by inferring each document's mixture of languages.

A language is a smoothed distribution over hashed byte n-grams of its words, counted over all labelled
documents. A word's likelihood in a language is the product over its n-grams. Every word of a document is
taken to be in one language of an unknown mixture; expectation-maximisation estimates the proportions. This
is done for the full set of languages and for the sets of its one, two, ... largest ones, and the set with
the best likelihood less a penalty per language is kept. Sets grow, up to all languages, for as long as a larger
one could still win: no set is likelier than the best mixture of all languages.

Defined results: a null text or one without a letter gets ``und`` and score 0, as does every text where
nothing could be learned; equal texts get equal answers; the label of a document is never read to predict it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gleanery.llm import words
from gleanery.session import bound_batches

#: n-gram lengths in bytes, a word's two borders counted, and the cells they are hashed into
SIZES = (3,)
CELLS = 1 << 16
#: a model goes to every worker: CELLS floats for each of so many languages. With up to twice as many languages two
#: cells become one, and so on down to FEWEST cells
MANY_LANGUAGES = 200
FEWEST = 1 << 10
SMOOTHING = 0.5
#: change of a proportion at which EM ends, and the penalty per language in units of ln(words)
TOLERANCE = 1e-4
PENALTY = 2.0
UNKNOWN = "und"

_CODES = np.arange(256)
LETTERS = ((_CODES >= 65) & (_CODES <= 90)) | ((_CODES >= 97) & (_CODES <= 122)) | (_CODES >= 128)
_BORDER = np.uint32(1)


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of all n-grams word by word, where each word's begin, and each text's first word."""
    data, offsets = words.raw(texts)
    starts, ends, first = words.spans(data, offsets, LETTERS)
    sizes = ends - starts
    # words side by side, each between two borders
    wide = sizes + 2
    begins = np.cumsum(wide) - wide
    flat = np.full(int(wide.sum()), _BORDER, np.uint32)
    inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    flat[inner + np.repeat(begins + 1, sizes)] = words.LOWER[data[inner + np.repeat(starts, sizes)]]
    last = np.repeat(begins + wide, wide)  # the end of the word that a place belongs to
    place = np.arange(len(flat))
    code = flat.copy()
    kinds = []
    for size in range(2, max(SIZES) + 1):
        reach = np.zeros(len(flat), np.uint32)
        reach[: len(flat) - size + 1] = flat[size - 1 :]
        code = code * np.uint32(0x01000193) + reach + np.uint32(size)
        if size in SIZES:
            mixed = code ^ (code >> np.uint32(15))
            mixed = mixed * np.uint32(0x85EBCA6B)
            kinds.append(((mixed >> np.uint32(16)).astype(np.int32), place + size <= last))
    cells = np.stack([c for c, _ in kinds], axis=1)
    fits = np.stack([ok for _, ok in kinds], axis=1)
    counts = fits.sum(axis=1)
    upto = np.concatenate([[0], np.cumsum(counts)])
    return cells[fits], upto[begins], first


def _letters(texts: list[str], first: np.ndarray) -> np.ndarray:
    """Whether each text has a letter; only words beyond ASCII need a look at the characters."""
    found = np.diff(first) > 0
    for k in np.flatnonzero(found):
        text = texts[k]
        if not text.isascii() and not any(c.isalpha() for c in text):
            found[k] = False
    return found


class Model:
    """Log-likelihoods of n-gram cells, one row per language, languages in order."""

    def __init__(self, languages: list[str], counts: np.ndarray, shift: int = 0):
        self.languages, self.shift = languages, shift
        total = counts.sum(axis=1, keepdims=True)
        self.table = np.ascontiguousarray(np.log((counts + SMOOTHING) / (total + SMOOTHING * counts.shape[1])).astype(np.float32))

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, list[list[str]]]:
        """For each text the largest language of its mixture, that language's proportion, and the set kept."""
        strings = texts.to_pylist()
        cells, begins, first = _grams(texts)
        cells = cells >> self.shift
        known = _letters(strings, first) if self.languages else np.zeros(len(strings), bool)
        best, share = np.zeros(len(strings), np.int64), np.zeros(len(strings))
        sets = [[] for _ in strings]
        counts = np.diff(first)
        if known.any() and len(begins):
            scores = np.stack([np.add.reduceat(row[cells], begins) for row in self.table])
            scores -= scores.max(axis=0)
            likely = np.exp(np.maximum(scores, -60.0))
            full = np.flatnonzero(counts > 0)
            at, sizes = first[full], counts[full]
            whole, value, gap = self._mix(likely, at, sizes)
            most, price = value + gap, PENALTY * np.log(sizes + 1.0)
            rank = np.argsort(-whole, axis=0, kind="stable")
            chosen, goal = np.zeros_like(whole), np.full(len(full), -np.inf)
            for size in range(1, len(self.languages) + 1):
                live = np.flatnonzero(most - size * price > goal)
                if not len(live):
                    break
                # the likelihoods of each text's own largest languages
                top, count = rank[:size, live], sizes[live]
                begin = np.cumsum(count) - count
                columns = np.arange(int(count.sum())) + np.repeat(at[live] - begin, count)
                picked = np.stack([likely[np.repeat(row, count), columns] for row in top])
                found, value, _ = self._mix(picked, begin, count)
                value = value - size * price[live]
                better = value > goal[live]
                goal[live] = np.where(better, value, goal[live])
                spread = np.zeros((len(whole), len(live)))
                np.put_along_axis(spread, top, found, axis=0)
                chosen[:, live] = np.where(better, spread, chosen[:, live])
            best[full] = np.argmax(chosen, axis=0)
            share[full] = np.clip(chosen.max(axis=0), 0.0, 1.0)
            for k, row in zip(full, chosen.T > 0, strict=True):
                sets[k] = [name for name, there in zip(self.languages, row, strict=True) if there]
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, known, strict=True)]
        return names, np.where(known, share, 0.0), [s if ok else [] for s, ok in zip(sets, known, strict=True)]

    @staticmethod
    def _mix(likely: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """EM for all texts at once: proportions (languages x texts), the log-likelihood they reach, and the most
        that other proportions could add to it. A text that has ended is left alone, whatever its neighbours do."""
        weights = np.full((len(likely), len(sizes)), 1 / len(likely))
        live, part, begin, count = np.arange(len(sizes) if len(likely) > 1 else 0), likely, at, sizes
        while len(live):
            joint = part * np.repeat(weights[:, live].astype(np.float32), count, axis=1)
            joint /= np.maximum(joint.sum(axis=0), 1e-30)
            new = np.add.reduceat(joint, begin, axis=1, dtype=np.float64) / count
            moves = np.abs(new - weights[:, live]).max(axis=0) > TOLERANCE
            weights[:, live] = new
            if not moves.all():
                part = part[:, np.repeat(moves, count)]
                live, count = live[moves], count[moves]
                begin = np.cumsum(count) - count
        total = np.zeros(likely.shape[1])
        for row, weight in zip(likely, weights, strict=True):
            total += row * np.repeat(weight, sizes)
        total = np.maximum(total, 1e-30)
        # the likelihood is concave: its slopes at these proportions bound what is left
        slope = np.stack([np.add.reduceat(row / total, at) for row in likely]).max(axis=0)
        return weights, np.add.reduceat(np.log(total), at), np.maximum(slope - sizes, 0.0)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Counts over all rows with a label. Rows (language, cell, count) are summed by Spark; the driver gets at
    most CELLS of them per language, and no more in all than MANY_LANGUAGES have."""
    bound_batches(labelled.sparkSession)
    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in words.slices(batch, "text"):
                cells, begins, first = _grams(words.column(part, "text"))
                edges = np.append(begins, len(cells))[first]
                names = np.array(part.column("lang").to_pylist(), object)
                owner = np.repeat(np.arange(len(names)), np.diff(edges))
                for name in set(names.tolist()):
                    mine = cells[(names == name)[owner]]
                    if name not in tables:
                        tables[name] = np.zeros(CELLS, np.int64)
                    tables[name] += np.bincount(mine, minlength=CELLS)
        for name, counts in tables.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["lang", "cell", "n"]
            )

    most = MANY_LANGUAGES * CELLS // FEWEST
    languages = sorted(r.lang for r in rows.select("lang").distinct().limit(most + 1).collect())
    if len(languages) > most:
        raise ValueError(f"more than {most} languages")
    shift = max(0, (-(-len(languages) // MANY_LANGUAGES) - 1).bit_length())
    found = rows.mapInArrow(run, "lang string, cell int, n long").withColumn("cell", F.shiftright("cell", shift))
    got = found.groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(languages), CELLS >> shift))
    place = {name: k for k, name in enumerate(languages)}
    if got.num_rows:
        where = np.array([place[name] for name in got.column("lang").to_pylist()])
        counts[where, got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return Model(languages, counts, shift)


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, languages): the largest language, its proportion, and the mixture's set."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "text"):
                names, share, sets = shared.value.predict(words.column(part, "text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array(names, pa.string()), pa.array(share, pa.float64()), pa.array(sets, pa.list_(pa.string()))],
                    ["key", "lang_pred", "score", "languages"],
                )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, lang_pred string, score double, languages array<string>").withColumnRenamed("key", key)


def keep(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents, with all their columns, whose language is not ``und``."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, text):
                names, _, _ = shared.value.predict(words.column(part, text))
                yield part.filter(pa.array([name != UNKNOWN for name in names], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def fold(key: str, folds: int = 5):
    """crc32 of the id as text, modulo ``folds``; a null id is the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds
