"""Byte-level BPE encoding and decoding in two tiers.

A text is split by a pattern into pre-tokens. The first tier is a minimal perfect hash over the whole
vocabulary: a pre-token that is itself an entry is answered by one probe and one comparison. The others go to
the second tier, which merges their bytes with a heap of adjacent pairs over a linked list. Both tables are
built from the rank file and bounded by it; a worker remembers pre-tokens up to a bounded number of bytes.

A null text encodes as the empty one: no ids. Texts are encoded whole; repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from sys import getsizeof

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh3_64_intdigest

from gleanery.llm import words
from gleanery.session import bound_batches

#: bytes that the pre-tokens a worker remembers may take, and what one takes besides its text and ids
MEMO_BYTES = 48 << 20
ENTRY_BYTES = 160
#: texts up to this character are split by the standard library's engine, which is twice as fast
NARROW = 0x250
_STEP, _MASK = 0xD1B54A32D192ED03, (1 << 64) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one line per entry, its bytes in base 64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(entry): int(rank) for entry, rank in (line.split() for line in lines if line.strip())}


def splitter(pattern: str):
    """All matches of the pattern in a text. Its character classes are spelled out for texts below ``NARROW``."""
    wide = regex.compile(pattern).findall
    spelled = {
        escape: "".join(f"\\u{code:04x}" for code in range(NARROW) if regex.match(escape, chr(code)))
        for escape in (r"\p{L}", r"\p{N}", r"\s", r"\S")
    }
    narrow = re.sub(r"\[[^\]]*\]", lambda m: re.sub(r"\\p\{[LN]\}|\\s", lambda e: spelled[e[0]], m[0]), pattern)
    narrow = re.sub(r"\\p\{[LN]\}|\\[sS]", lambda e: f"[{spelled[e[0]]}]", narrow)
    fast, fits = re.compile(narrow).findall, re.compile(f"[\0-\\u{NARROW - 1:04x}]*").fullmatch
    return lambda text: fast(text) if text.isascii() or fits(text) else wide(text)


class PerfectHash:
    """Hash and displace: as many slots as entries, one entry in each."""

    def __init__(self, entries: list[bytes]):
        entries = [e for e in entries if e]
        size, groups = len(entries), len(entries) // 2 + 1
        hashes = np.array([xxh3_64_intdigest(e) for e in entries], np.uint64)
        if len(np.unique(hashes)) != size:
            raise ValueError("two entries have the same 64-bit hash")
        group = (hashes % np.uint64(groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        starts = np.searchsorted(group[order], np.arange(groups + 1))
        sizes = np.diff(starts)
        shift, slots = np.zeros(groups, np.int64), np.full(size, -1, np.int64)
        for g in np.argsort(-sizes, kind="stable"):
            members = order[starts[g] : starts[g + 1]]
            if len(members) < 2:
                break
            first = 1
            while True:  # the first displacement that sends the group's entries to different free slots
                tries = np.arange(first, first + 64, dtype=np.uint64)[:, None]
                places = (words.mix(hashes[members][None, :] + tries * np.uint64(_STEP)) % np.uint64(size)).astype(np.int64)
                ranked = np.sort(places, axis=1)
                free = (slots[places] < 0).all(axis=1) & (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
                if free.any():
                    hit = int(np.argmax(free))
                    shift[g] = first + hit
                    slots[places[hit]] = members
                    break
                first += 64
        empty = iter(np.flatnonzero(slots < 0))
        for g in np.flatnonzero(sizes == 1):  # a lone entry takes any slot that is left
            slot = next(empty)
            shift[g] = -slot - 1
            slots[slot] = order[starts[g]]
        self.shift, self.entries = shift.tolist(), [entries[k] for k in slots]

    def find(self, key: bytes) -> int:
        """The slot of the key, -1 if it is no entry: one probe, one comparison."""
        if not self.entries:
            return -1
        x = xxh3_64_intdigest(key)
        shift = self.shift[x % len(self.shift)]
        if shift < 0:
            slot = -shift - 1
        else:  # words.mix on one number
            x = (x + shift * _STEP) & _MASK
            x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & _MASK
            x = ((x ^ x >> 27) * 0x94D049BB133111EB) & _MASK
            slot = (x ^ x >> 31) % len(self.entries)
        return slot if self.entries[slot] == key else -1


class Merges:
    """Which two adjacent parts make an entry: by the ids of both, and at once for two single bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.byte_ids = [ranks.get(bytes([k]), -1) for k in range(256)]
        self.first = [-1] * 65_536
        self.pairs = {}
        for entry, rank in ranks.items():
            if len(entry) == 2:
                self.first[entry[0] << 8 | entry[1]] = rank
            for cut in range(1, len(entry)):
                left, right = ranks.get(entry[:cut]), ranks.get(entry[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = rank

    def encode(self, piece: bytes) -> list[int]:
        """Ids of a piece: the adjacent pair of lowest rank is merged, the leftmost of equals, until none is left."""
        size, look, first = len(piece), self.pairs.get, self.first
        ids = [self.byte_ids[k] for k in piece]
        after = list(range(1, size + 1))  # where the next part begins
        before = list(range(-1, size - 1))
        pair = [first[a << 8 | b] for a, b in zip(piece, piece[1:], strict=False)]  # rank of the part here and the next as one
        pair.append(-1)
        heap = [rank * size + k for k, rank in enumerate(pair) if rank >= 0]
        heapify(heap)
        while heap:
            rank, at = divmod(heappop(heap), size)
            if pair[at] != rank:  # one of the two parts has changed since
                continue
            middle = after[at]
            end = after[at] = after[middle]
            ids[at], pair[middle] = rank, -1
            if end < size:
                before[end] = at
                pair[at] = made = look(rank << 32 | ids[end], -1)
                if made >= 0:
                    heappush(heap, made * size + at)
            else:
                pair[at] = -1
            left = before[at]
            if left >= 0:
                pair[left] = made = look(ids[left] << 32 | rank, -1)
                if made >= 0:
                    heappush(heap, made * size + left)
        found, at = [], 0
        while at < size:
            found.append(ids[at])
            at = after[at]
        return found


class _Memo(dict):
    """Ids of pre-tokens met lately; a new one goes through the two tiers.

    When half of ``MEMO_BYTES`` is taken, what is remembered becomes the older half, and what was that before is
    forgotten, unless it is met again. A pre-token that does not fit into a half is not remembered.
    """

    def __init__(self, table: PerfectHash, ids: list[int]):
        self.table, self.ids, self.merges = table, ids, Merges(dict(zip(table.entries, ids, strict=True)))
        self.older, self.size = {}, 0

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            key = piece.encode()
            slot = self.table.find(key)
            found = self.ids[slot].to_bytes(4, "little") if slot >= 0 else b"".join([i.to_bytes(4, "little") for i in self.merges.encode(key)])
        size = ENTRY_BYTES + getsizeof(piece) + len(found)
        if size > MEMO_BYTES // 2:
            return found
        if self.size + size > MEMO_BYTES // 2:
            self.older, self.size = dict(self), 0
            self.clear()
        self.size += size
        self[piece] = found
        return found


class Codec:
    """Encoder and decoder of one vocabulary; sent to the workers once."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = pattern
        self.table = PerfectHash(list(ranks))
        self.ids = [ranks[e] for e in self.table.entries]
        self._ready = None

    def __getstate__(self):
        return self.__dict__ | {"_ready": None}

    def _tools(self):
        if self._ready is None:
            names = [b""] * (max(self.ids, default=-1) + 1)
            for entry, rank in zip(self.table.entries, self.ids, strict=True):
                names[rank] = entry
            sizes = np.array([len(name) for name in names], np.int64)
            flat = np.frombuffer(b"".join(names), np.uint8)
            self._ready = (splitter(self.pattern), _Memo(self.table, self.ids), flat, sizes, np.cumsum(sizes) - sizes)
        return self._ready

    def encode(self, text: str) -> bytes:
        """Ids of the text as little-endian unsigned 32-bit integers."""
        split, memo, *_ = self._tools()
        return b"".join(map(memo.__getitem__, split(text)))

    def decode(self, ids: bytes) -> bytes:
        _, _, flat, sizes, starts = self._tools()
        ids = np.frombuffer(ids, "<u4")
        size = sizes[ids]
        ends = np.cumsum(size)
        return flat[np.repeat(starts[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


def encode(docs: DataFrame, codec: Codec, key: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256[, ids]) per document; ids as little-endian 32-bit integers.

    The digests are of the ids and of the bytes that decoding them gives back.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(codec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = shared.value
        for batch in batches:
            for part in words.slices(batch, "text"):
                found = [worker.encode(text) for text in words.column(part, "text").to_pylist()]
                columns = [
                    part.column("key"),
                    pa.array([len(ids) // 4 for ids in found], pa.int64()),
                    pa.array([hashlib.sha256(ids).hexdigest() for ids in found], pa.string()),
                    pa.array([hashlib.sha256(worker.decode(ids)).hexdigest() for ids in found], pa.string()),
                ]
                names = ["key", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns.append(pa.array(found, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[key].dataType.simpleString()
    shape = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary" if keep_ids else "")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, shape).withColumnRenamed("key", key)
