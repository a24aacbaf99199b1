"""Quality by a linear-chain conditional random field over lines.

A document is a chain of lines, each good or bad. A line's potential is a sum of weights of its own features and of
those of the lines before and after it (binned shares of letters, capitals, digits, symbols, repeated words and
lines, sizes); neighbouring labels are coupled. Forward-backward gives each line's marginal of being good; their
mean, weighted by the lines' bytes, is put on the scale of probabilities by a logistic fitted to the labelled
documents.

Training takes at most ``SAMPLE_DOCS`` labelled documents (the first by a hash of their ids) and ``SAMPLE_LINES``
lines of them, one document ``SAMPLE_LINES // 8`` at most; a document's label stands for each of its lines. Only the
sample's binned features reach the driver, never a text. Scoring reads every whole text.

Odd cases: null and empty texts are one empty line and get a score; labels that are null or belong to no document
teach nothing; an id that is repeated in either table teaches once per pair of rows; with labels of one kind only
the score is their smoothed share, without labels 0.5; equal texts have equal scores; a text of any length is one
chain; tables without rows give none; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gleanery.llm import words
from gleanery.session import durable

SAMPLE_DOCS = 8_192
SAMPLE_LINES = 1 << 18
RIDGE = 1e-3
ROUNDS = 60

_CODES = np.arange(256)
_UPPER = (_CODES >= 65) & (_CODES <= 90)
_LETTER = _UPPER | ((_CODES >= 97) & (_CODES <= 122)) | (_CODES >= 128)
_DIGIT = (_CODES >= 48) & (_CODES <= 57)
_SPACE = ~words.SOLID
_STOP = np.isin(_CODES, list(b".,;:?'\"()-"))
_SYMBOL = ~(_LETTER | _DIGIT | _SPACE | _STOP)
_END = np.isin(_CODES, list(b".?:;"))

_SHARES = np.array([1e-9, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9, 0.999])
_SIZES = np.array([1, 8, 32, 64, 128, 256, 512, 1024, 2048, 4096])
_COUNTS = np.array([1, 2, 4, 8, 16, 32, 64, 128, 256, 512])
_LENGTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 14])
#: features of a line, each with the edges of its bins; the one past the last bin stands for a line that is not there
FEATURES = {
    "letters": _SHARES, "upper": _SHARES, "digits": _SHARES, "spaces": _SHARES, "stops": _SHARES, "symbols": _SHARES,
    "exclaims": _SHARES, "bars": _SHARES, "marked_words": _SHARES, "distinct_words": _SHARES, "same_as_before": _SHARES,
    "document_words": _SHARES, "seen_lines": _SHARES, "ended": _SHARES, "bytes": _SIZES, "words": _COUNTS, "word_length": _LENGTHS,
}
BINS = 12
MISSING = BINS - 1
WIDTH = len(FEATURES) * BINS


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every line without its line feed, and each text's first line; a text has one line at least."""
    feeds = np.flatnonzero(data == 10)
    starts = np.concatenate([offsets[:-1], feeds + 1])
    kind = np.concatenate([np.zeros(len(offsets) - 1, np.int8), np.ones(len(feeds), np.int8)])
    owner = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, feeds, "right") - 1])
    order = np.lexsort((kind, starts, owner))
    starts, owner = starts[order], owner[order]
    last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, bool)
    ends = np.where(last, offsets[owner + 1], np.append(starts[1:], 0) - 1)
    return starts, ends, np.searchsorted(owner, np.arange(len(offsets)))


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _repeats(owner: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each owner, and whether an entry's key stood with its owner before."""
    mixed = words.mix(keys ^ words.mix(owner.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(mixed, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = mixed[order[1:]] != mixed[order[:-1]]
    again = np.empty(len(order), bool)
    again[order] = ~new
    return np.bincount(owner[~again], minlength=n), again


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins (lines x features), the bytes of each line, and each text's first line."""
    data, offsets = words.raw(texts)
    starts, ends, first = _lines(data, offsets)
    size = ends - starts
    n, doc = len(starts), np.repeat(np.arange(len(offsets) - 1), np.diff(first))

    def count(kind: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(kind[data], dtype=np.int64)])
        return upto[ends] - upto[starts]

    word, stop, _ = words.spans(data, offsets, words.SOLID)
    keys = words.hashes(words.LOWER[data], word, stop)
    # an empty line has no word, so that the last of the lines that start at a place is the word's own
    line = np.searchsorted(starts, word, "right") - 1
    total = np.bincount(line, minlength=n)
    distinct, _ = _repeats(line, keys, n)
    of_doc, _ = _repeats(doc[line], keys, len(offsets) - 1)
    same = np.zeros(len(word), bool)
    same[1:] = (keys[1:] == keys[:-1]) & (line[1:] == line[:-1])
    marked = _SYMBOL[data[stop - 1]] if len(word) else np.zeros(0, bool)
    _, seen = _repeats(doc, words.hashes(data, starts, ends), n)
    letters = count(_LETTER)
    doc_words = np.bincount(doc[line], minlength=len(offsets) - 1)
    tail = np.zeros(n, bool)
    tail[size > 0] = _END[data[ends[size > 0] - 1]]
    values = {
        "letters": _share(letters, size),
        "upper": _share(count(_UPPER), letters),
        "digits": _share(count(_DIGIT), size),
        "spaces": _share(count(_SPACE), size),
        "stops": _share(count(_STOP), size),
        "symbols": _share(count(_SYMBOL), size),
        "exclaims": _share(count(_CODES == 33), size),
        "bars": _share(count(_CODES == 124), size),
        "marked_words": _share(np.bincount(line[marked], minlength=n), total),
        "distinct_words": _share(distinct, total),
        "same_as_before": _share(np.bincount(line[same], minlength=n), total),
        "document_words": _share(of_doc, doc_words)[doc],
        "seen_lines": seen & (size > 0),
        "ended": tail,
        "bytes": size,
        "words": total,
        "word_length": _share(np.bincount(line, weights=stop - word, minlength=n), total),
    }
    bins = np.stack([np.digitize(values[name].astype(np.float64), edges) for name, edges in FEATURES.items()], axis=1)
    return bins.astype(np.uint8).reshape(n, len(FEATURES)), size, first


class Chains:
    """Lines of many documents in order of their places: all first lines, all second lines, ..., longest documents first."""

    def __init__(self, bins: np.ndarray, first: np.ndarray):
        sizes = np.diff(first)
        self.docs = np.argsort(-sizes, kind="stable")
        longest = int(sizes.max(initial=0))
        self.active = np.searchsorted(-sizes[self.docs], -np.arange(longest), "left")  # documents longer than each place
        self.begin = np.concatenate([[0], np.cumsum(self.active)])
        place = np.repeat(np.arange(longest), self.active)
        within = np.arange(int(self.begin[-1])) - np.repeat(self.begin[:-1], self.active)
        self.line = first[self.docs[within]] + place
        self.doc = self.docs[within]
        # bins as columns of one weight table: own, before, after
        none = np.full((1, bins.shape[1]), MISSING, np.uint8)
        before, after = np.concatenate([none, bins[:-1]]), np.concatenate([bins[1:], none])
        before[first[:-1]], after[first[1:] - 1] = MISSING, MISSING
        shift = (np.arange(bins.shape[1]) * BINS).astype(np.int16)[:, None]
        sides = [side[self.line].T + shift + np.int16(n * WIDTH) for n, side in enumerate((bins, before, after))]
        self.columns = np.concatenate(sides)
        # each line but the first ones, and the line before it
        self.here = np.flatnonzero(place > 0)
        self.before = self.begin[place[self.here] - 1] + within[self.here]

    def spans(self) -> Iterator[tuple[slice, slice]]:
        """The lines of every place but the first, and as many of the place before."""
        for t in range(1, len(self.active)):
            yield slice(self.begin[t], self.begin[t + 1]), slice(self.begin[t - 1], self.begin[t - 1] + self.active[t])

    def potentials(self, weights: np.ndarray) -> np.ndarray:
        """Log odds of good for every line, neighbours' labels apart."""
        found = np.full(len(self.line), weights[0])
        for column in self.columns:
            found += weights[3:][column]
        return found

    def passes(self, potential: np.ndarray, bad: float, good: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log odds of the forward and backward messages, and the log normaliser of each line's document so far.

        ``bad`` and ``good`` are what two bad, two good lines in a row add; unequal neighbours add nothing.
        """
        forward, backward, norm = potential.copy(), np.zeros_like(potential), np.zeros_like(potential)
        places = list(self.spans())
        for here, before in places:
            a = forward[before]
            stays = np.logaddexp(a, bad)
            forward[here] += np.logaddexp(a + good, 0.0) - stays
            norm[here] = norm[before] + stays
        for here, before in reversed(places):
            c = potential[here] + backward[here]
            backward[before] = np.logaddexp(c + good, 0.0) - np.logaddexp(c, bad)
        return forward, backward, norm


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def _loss(chains: Chains, labels: np.ndarray, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood per line and document with a ridge, and its gradient."""
    bad, good = weights[1], weights[2]
    potential = chains.potentials(weights)
    forward, backward, norm = chains.passes(potential, bad, good)
    label = labels[chains.doc].astype(np.float64)
    length = np.bincount(chains.doc, minlength=len(labels))
    share = 1.0 / (np.maximum(length, 1)[chains.doc] * len(labels))
    here, before = chains.here, chains.before
    last = np.ones(len(label), bool)
    last[before] = False
    value = float((share * (last * (norm + np.logaddexp(forward, 0.0)) - label * potential)).sum())
    gradient = np.zeros_like(weights)
    marginal = _sigmoid(forward + backward)
    slope = share * (marginal - label)
    gradient[0] = slope.sum()
    for column in chains.columns:
        gradient[3:] += np.bincount(column, weights=slope, minlength=3 * WIDTH)
    if len(here):
        a, c = forward[before], potential[here] + backward[here]
        four = np.stack([np.full_like(a, bad), a, c, a + c + good])
        four -= four.max(axis=0)
        odds = np.exp(four)
        odds /= odds.sum(axis=0)
        value -= float((share[here] * (label[here] * good + (1 - label[here]) * bad)).sum())
        gradient[1] = (share[here] * (odds[0] - (1 - label[here]))).sum()
        gradient[2] = (share[here] * (odds[3] - label[here])).sum()
    return value + RIDGE / 2 * float(weights @ weights), gradient + RIDGE * weights


def _minimise(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, rounds: int) -> np.ndarray:
    """Limited-memory quasi-Newton descent with halved steps."""
    at, moves = start, []
    value, gradient = loss(at)
    for _ in range(rounds):
        step, scales = gradient.copy(), []
        for s, y in reversed(moves):
            scales.append((s @ step) / (y @ s))
            step -= scales[-1] * y
        if moves:
            s, y = moves[-1]
            step *= (s @ y) / (y @ y)
        for (s, y), scale in zip(moves, reversed(scales), strict=True):
            step += s * (scale - (y @ step) / (y @ s))
        rate, descent = 1.0, float(gradient @ step)
        if descent < 1e-12:
            break
        while True:
            new, new_gradient = loss(at - rate * step)
            if new <= value - 1e-4 * rate * descent or rate < 1e-6:
                break
            rate /= 2
        if new > value:
            break
        s, y = -rate * step, new_gradient - gradient
        if s @ y > 1e-12:
            moves = [*moves[-7:], (s, y)]
        done = value - new < 1e-7
        at, value, gradient = at + s, new, new_gradient
        if done:
            break
    return at


class Model:
    """Weights of the chain, and the line from its mean marginal's log odds to the score's."""

    def __init__(self, weights: np.ndarray | None, scale: float, shift: float):
        self.weights, self.scale, self.shift = weights, scale, shift

    def marginals(self, bins: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Probability of good for every line, in the order of the lines."""
        chains = Chains(bins, first)
        potential = chains.potentials(self.weights)
        forward, backward, _ = chains.passes(potential, self.weights[1], self.weights[2])
        found = np.empty(len(potential))
        found[chains.line] = _sigmoid(forward + backward)
        return found

    def means(self, bins: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each text's mean marginal, weighted by its lines' bytes and line feeds; and all marginals."""
        good = self.marginals(bins, first)
        weight = sizes + 1.0
        return np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1]), good

    def scores(self, mean: np.ndarray) -> np.ndarray:
        return _sigmoid(self.scale * _odds(mean) + self.shift)


def _odds(share: np.ndarray) -> np.ndarray:
    share = np.clip(share, 1e-6, 1 - 1e-6)
    return np.log(share / (1 - share))


def fit(bins: np.ndarray, sizes: np.ndarray, first: np.ndarray, labels: np.ndarray) -> Model:
    """A model from documents' binned lines and their labels (0 or 1)."""
    rate = (labels.sum() + 1.0) / (len(labels) + 2.0)
    if not 0 < labels.sum() < len(labels):
        return Model(None, 0.0, float(np.log(rate / (1 - rate))))
    chains = Chains(bins, first)
    weights = _minimise(lambda w: _loss(chains, labels, w), np.zeros(3 + 3 * WIDTH), ROUNDS)
    model = Model(weights, 1.0, 0.0)
    x = _odds(model.means(bins, sizes, first)[0])

    def logistic(line: np.ndarray) -> tuple[float, np.ndarray]:
        z = line[0] * x + line[1]
        gap = (_sigmoid(z) - labels) / len(labels)
        return float((np.logaddexp(z, 0.0) - labels * z).mean() + RIDGE / 2 * (line @ line)), np.array([gap @ x, gap.sum()]) + RIDGE * line

    model.scale, model.shift = map(float, _minimise(logistic, np.array([1.0, 0.0]), ROUNDS))
    # more of good must never score less
    model.scale = max(model.scale, 1e-3)
    return model


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample_docs: int = SAMPLE_DOCS
) -> Model:
    """A model of at most ``sample_docs`` labelled documents; their texts do not move, their labels are broadcast."""
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where("label in (0, 1) and key is not null")
    known = known.orderBy(F.xxhash64("key"), "key", "label").limit(sample_docs)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).join(F.broadcast(known), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "text"):
                bins, sizes, first = features(words.column(part, "text"))
                cut = [(bins[a:b], sizes[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("rank"),
                        part.column("label"),
                        pa.array(np.diff(first)),
                        pa.array([b.tobytes() for b, _ in cut], pa.binary()),
                        pa.array([s.astype("<i8").tobytes() for _, s in cut], pa.binary()),
                    ],
                    ["rank", "label", "n_lines", "bins", "sizes"],
                )

    rows = rows.select(F.xxhash64("key").alias("rank"), "label", "text")
    rows = rows.mapInArrow(run, "rank long, label int, n_lines long, bins binary, sizes binary").where(F.col("n_lines") <= SAMPLE_LINES // 8)
    taken, lines = [], 0
    # partition by partition, so that repeated ids cannot fill the driver either
    for row in durable(rows).orderBy("rank", "label", "bins", "sizes").toLocalIterator():
        lines += row["n_lines"]
        if lines > SAMPLE_LINES or len(taken) == sample_docs:
            break
        taken.append(row)
    if not taken:
        return Model(None, 0.0, 0.0)
    bins = np.frombuffer(b"".join(r["bins"] for r in taken), np.uint8).reshape(-1, len(FEATURES))
    sizes = np.frombuffer(b"".join(r["sizes"] for r in taken), "<i8")
    first = np.concatenate([[0], np.cumsum([r["n_lines"] for r in taken])])
    return fit(bins, sizes, first, np.array([r["label"] for r in taken], np.float64))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, n_lines, bad_lines): quality of every whole text, and the places of the lines that are likelier bad."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in words.slices(batch, "text"):
                bins, sizes, first = features(words.column(part, "text"))
                if model.weights is None:
                    mean, good = np.full(part.num_rows, 0.5), np.ones(len(bins))
                else:
                    mean, good = model.means(bins, sizes, first)
                bad = np.flatnonzero(good < 0.5)
                place = bad - np.repeat(first[:-1], np.diff(first))[bad]
                places = pa.ListArray.from_arrays(pa.array(np.searchsorted(bad, first), pa.int32()), pa.array(place, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array(model.scores(mean)), pa.array(np.diff(first)), places],
                    ["key", "score", "n_lines", "bad_lines"],
                )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, score double, n_lines long, bad_lines array<long>").withColumnRenamed("key", key)
