"""Cost-balanced packing of token sequences.

A sequence of documents costs ``linear`` for each token and ``quadratic`` for each
pair of tokens that attend to one another, that is for the square of each piece.
Stretches of a whole capacity become sequences of their own. The rest of each
document goes, longest first, to the sequence of the lowest cost that still has
room; what finds no room there is cut off and goes on to the next.

Documents are dealt into groups of about ``GROUP_BYTES`` of text, so a task holds a
bounded share however large the corpus is. The capacities of a group add up to its
tokens exactly: whole sequences and one for each binary digit of what is left, so
every sequence is full or as long as a power of two.

Nulls: a null text is empty, a null doc_id stays null. Empty texts hold the end id
alone. Repeated rows are documents of their own. Other columns are ignored. An empty
table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups_for, small_batches, text_of
from .tokens import encoder

CAPACITY = 4096
GROUP_BYTES = 4 << 20
LINEAR, QUADRATIC = 1.0, 1.0 / 4096  # a full-length document costs as much by pairs as by tokens

_PIECES = pa.schema([
    ("pack_group", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("ids", pa.binary()),
])
PACKED = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_cost double, ids binary"
)
_PACKED = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("sequence_cost", pa.float64()), ("ids", pa.binary()),
])


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())


def assign(lengths: list[int], capacities: list[int], linear: float, quadratic: float) -> tuple[list[list[tuple[int, int, int]]], list[float]]:
    """Places (piece, start in piece, length) of each sequence and the sequences' costs; ``lengths`` descend."""
    places: list[list[tuple[int, int, int]]] = [[] for _ in capacities]
    room, costs = list(capacities), [0.0] * len(capacities)
    cheapest = [(0.0, i) for i in range(len(capacities))]
    for piece, length in enumerate(lengths):
        start = 0
        while start < length:
            cost, i = heapq.heappop(cheapest)
            take = min(length - start, room[i])
            places[i].append((piece, start, take))
            room[i] -= take
            start += take
            costs[i] = cost + linear * take + quadratic * take * take
            if room[i]:
                heapq.heappush(cheapest, (costs[i], i))
    return places, costs


def capacities_for(tokens: int, capacity: int) -> list[int]:
    """Whole sequences, then a power of two for each binary digit of the rest."""
    rest = tokens % capacity
    return [capacity] * (tokens // capacity) + [1 << bit for bit in reversed(range(rest.bit_length())) if rest >> bit & 1]


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC,
         group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row per piece: where its document's ids went, with the ids as little-endian unsigned 32-bit integers."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    n_groups = groups_for(texts.agg(F.sum(F.octet_length("text"))).first()[0], group_bytes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, dealt = encoder(tokenizer), 0
        for batch in small_batches(batches):
            ids, counts = coder.encode(batch.column("text"))
            ids = np.insert(ids, np.cumsum(counts), end_id) if len(counts) else ids
            rows: list[tuple] = []
            begin = 0
            for doc_id, count in zip(batch.column("doc_id").to_pylist(), (counts + 1).tolist(), strict=True):
                dealt += 1
                # neighbours in the table go to different groups, also if all rows had one doc_id
                group = (zlib.crc32(str(doc_id).encode()) + dealt * 7919) % n_groups
                whole = count - count % capacity
                # whole sequences of one document go to different groups too
                rows += [((group + at // capacity) % n_groups, doc_id, at, capacity, crc(piece), count, piece.astype("<u4").tobytes())
                         for at in range(0, whole, capacity) for piece in (ids[begin + at:begin + at + capacity],)]
                if whole < count:
                    rows.append((group, doc_id, whole, count - whole, 0, count, ids[begin + whole:begin + count].astype("<u4").tobytes()))
                begin += count
            yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows, strict=True), _PIECES, strict=True)] if rows else [
                pa.array([], f.type) for f in _PIECES], schema=_PIECES)

    def fill(key: tuple, table: pa.Table) -> pa.Table:
        group, rows = key[0].as_py(), table.to_pydict()
        order = sorted(range(table.num_rows), key=lambda k: (-rows["length"][k], rows["doc_id"][k] is None, rows["doc_id"][k] or 0, rows["start"][k]))
        full = [k for k in order if rows["length"][k] == capacity]
        rest = [k for k in order if rows["length"][k] < capacity]
        lengths = [rows["length"][k] for k in rest]
        places, costs = assign(lengths, capacities_for(sum(lengths), capacity), linear, quadratic)
        out = [(rows["doc_id"][k], rows["start"][k], capacity, rows["ids_crc32"][k], rows["doc_tokens"][k], (group << 32) + i, 0,
                linear * capacity + quadratic * capacity * capacity, rows["ids"][k]) for i, k in enumerate(full)]
        for i, (place, cost) in enumerate(zip(places, costs, strict=True), len(full)):
            offset = 0
            for piece, start, length in place:
                k = rest[piece]
                ids = rows["ids"][k][4 * start:4 * (start + length)]
                out.append((rows["doc_id"][k], rows["start"][k] + start, length, zlib.crc32(ids), rows["doc_tokens"][k], (group << 32) + i, offset, cost, ids))
                offset += length
        return pa.Table.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*out, strict=True), _PACKED, strict=True)] if out else [
            pa.array([], f.type) for f in _PACKED], schema=_PACKED)

    pieces = texts.mapInArrow(
        cut, "pack_group long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")
    return pieces.groupBy("pack_group").applyInArrow(fill, PACKED)
