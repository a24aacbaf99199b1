"""Token counts by a map-side lookup in two tiers.

A text is cut into units: a run of spaces and the non-spaces after it. A piece vocabulary without inner
spaces never merges across units, so a text's length in tokens is the sum over its units. The lengths of the
most frequent units of all texts are sent to all workers as one packed table; a worker encodes every other unit
itself and remembers a bounded number of them. Every task counts the units of its texts in a bounded summary of
heavy hitters (no unit that makes up more than one in ``TABLE_UNITS`` of a task's units is lost from it), and Spark
adds the summaries up. The table decides only which lengths are at hand: every text is counted whole.

A null text counts as the empty one: no tokens. Repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from gleanery.llm import words

SPACE = "▁"
#: the most entries of the shared table and of a task's summary, and the most bytes of one of them
TABLE_UNITS = 65_536
UNIT_BYTES = 64
#: further units a worker remembers before it starts anew
MEMO = 400_000


class PieceCounter:
    """Counts of one piece model; a pickled copy loads the model when it is first used."""

    def __init__(self, model: bytes, table: tuple[bytes, bytes] = (b"", b"")):
        self.model, self.table, self._ready = model, table, None

    def __getstate__(self):
        return {"model": self.model, "table": self.table, "_ready": None}

    def _tools(self):
        if self._ready is None:
            encoder = sentencepiece.SentencePieceProcessor(model_proto=self.model)
            whole = any(SPACE in encoder.id_to_piece(i).lstrip(SPACE) for i in range(encoder.get_piece_size()))
            names, lengths = self.table
            shared = {} if whole or not lengths else dict(
                zip(names.decode().split("\0"), np.frombuffer(lengths, "<u4").tolist(), strict=True)
            )
            self._ready = (encoder, whole, shared, {})
        return self._ready

    @staticmethod
    def units(text: str) -> list[str]:
        # the model puts one space in front of a text that is not empty
        return re.findall(" +[^ ]*", " " + text.replace(SPACE, " ")) if text else []

    def lengths(self, units: list[str]) -> list[int]:
        """Tokens of each unit; the encoder adds the first space again."""
        encoder = self._tools()[0]
        # a space alone is what no text encodes to; it is one piece, or its bytes
        space = 1 if encoder.piece_to_id(SPACE) != encoder.unk_id() else len(SPACE.encode())
        found = encoder.encode([unit[1:] for unit in units], num_threads=1)
        return [len(ids) if unit != " " else space for unit, ids in zip(units, found, strict=True)]

    def count_batch(self, texts: list[str]) -> list[int]:
        encoder, whole, shared, memo = self._tools()
        if whole:  # pieces that hold spaces inside: a text cannot be cut
            return [len(ids) for ids in encoder.encode(texts, num_threads=1)]
        split = [self.units(text) for text in texts]
        fresh = list(set().union(*split).difference(shared).difference(memo))
        if len(memo) + len(fresh) > MEMO:
            memo.clear()
            fresh = list(set().union(*split).difference(shared))
        memo.update(zip(fresh, self.lengths(fresh), strict=True))
        look = shared.get
        rest = memo.__getitem__
        return [sum([look(unit) or rest(unit) for unit in units]) for units in split]

    def with_table(self, texts: list[str], most: int = TABLE_UNITS) -> PieceCounter:
        """The same counter with the lengths of the most frequent units of some texts."""
        if self._tools()[1]:
            return self
        seen = Counter(unit for text in texts for unit in self.units(text))
        return self.with_units([unit for unit, _ in seen.most_common() if fits(unit)][:most])

    def with_units(self, common: list[str]) -> PieceCounter:
        """The same counter with the lengths of some units."""
        if self._tools()[1] or not common:
            return self
        return PieceCounter(self.model, ("\0".join(common).encode(), np.array(self.lengths(common), "<u4").tobytes()))


def fits(unit: str) -> bool:
    return "\0" not in unit and len(unit) <= UNIT_BYTES and len(unit.encode()) <= UNIT_BYTES


def lessened(seen: Counter, most: int) -> Counter:
    """At most ``most`` units, every count less by that of the first unit that goes (Misra and Gries)."""
    if len(seen) <= most:
        return seen
    cut = np.partition(np.fromiter(seen.values(), np.int64, len(seen)), len(seen) - most - 1)[len(seen) - most - 1]
    return Counter({unit: n - int(cut) for unit, n in seen.items() if n > cut})


def frequent_units(rows: DataFrame, most: int = TABLE_UNITS) -> list[str]:
    """The units that are most frequent in the column ``text`` of all rows, of those that fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter()
        for batch in batches:
            for part in words.slices(batch, "text"):
                new = Counter()
                for text in words.column(part, "text").to_pylist():
                    new.update(PieceCounter.units(text))
                for unit, n in new.items():
                    if unit in seen or fits(unit):
                        seen[unit] += n
                if len(seen) > 4 * most:
                    seen = lessened(seen, most)
        seen = lessened(seen, most)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["unit", "n"])

    summed = rows.select("text").mapInArrow(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    return [row.unit for row in summed.orderBy(F.desc("n"), "unit").limit(most).collect()]


def count(docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) per document, over_limit being n_tokens > limit."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counter = PieceCounter(model)
    if not counter._tools()[1]:
        counter = counter.with_units(frequent_units(rows))
    shared = docs.sparkSession.sparkContext.broadcast(counter)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = shared.value
        for batch in batches:
            for part in words.slices(batch, "text"):
                found = counter.count_batch(words.column(part, "text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("n_bytes"), pa.array(found, pa.int64())], ["key", "n_bytes", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    counted = rows.withColumn("n_bytes", F.octet_length("text").cast("long")).mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
