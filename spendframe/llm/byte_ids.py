"""Token ids in byte-aligned binary files.

Ids are replaced by their rank of frequency in the whole corpus, the most frequent
first, so most take one byte. A file holds the documents of a stretch of ascending
doc_id:

    header     magic, bits of control per id, documents, ids, (little-endian unsigned 32-bit)
    documents  doc_id (signed 64-bit), whether it is given (8-bit), number of ids (unsigned 32-bit)
    control    1 bit an id (one or two bytes), or 2 bits where the vocabulary needs up to four
    data       the bytes of the ranks, lowest first

Control bytes stand apart from the data, so a table of 256 rows tells which bytes all
ids of a control byte have, and numpy decodes a file without a loop over ids. ``ranks``
in the same folder maps ranks back to ids.

Nulls: a null text is empty, documents without doc_id come first. Empty texts hold the
end id alone. Rows of equal doc_id are ordered by text. Other columns are ignored. An
empty table gives no files and no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import groups_for, keep, new_folder, small_batches, text_of, write_file
from .tokens import encoder

MAGIC = 0x31444942
SHARD_BYTES = 16 << 20  # of text
_TOKENS = pa.schema([("shard", pa.int32()), ("place", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.binary())])
_FILES = pa.schema([("shard", pa.int32()), ("place", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("file_tokens", pa.int64())])
_READ = pa.schema([
    ("shard", pa.int32()), ("place", pa.int64()), ("nth", pa.int64()), ("doc_id", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()),
    ("ids_crc32", pa.int64())])


def control_bits(vocabulary: int) -> int:
    return 1 if vocabulary <= 1 << 16 else 2


def _used_tables(bits: int) -> np.ndarray:
    """For each control byte which bytes its ids have, the first id in the lowest bits."""
    per, width = 8 // bits, 1 << bits
    longest = np.arange(256)[:, None] >> (bits * np.arange(per)) & (width - 1)
    return (np.arange(width) <= longest[:, :, None]).reshape(256, per * width)


def encode_ranks(ranks: np.ndarray, bits: int) -> tuple[bytes, bytes]:
    """Control bytes and data bytes."""
    width = 1 << bits  # a rank has as many bytes at most
    ranks = np.ascontiguousarray(ranks, f"<u{width}")
    used = np.ones((len(ranks), width), bool)
    for k in range(1, width):
        used[:, k] = ranks >= 1 << 8 * k
    longest = used[:, 1:].sum(axis=1, dtype=np.uint8)
    control = np.packbits(longest[:, None] >> np.arange(bits, dtype=np.uint8) & 1, bitorder="little")
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, width)[used].tobytes()


def decode_ranks(control: np.ndarray, data: np.ndarray, count: int, bits: int) -> np.ndarray:
    width = 1 << bits
    octets = np.zeros((count, width), np.uint8)
    octets[_used_tables(bits)[control].reshape(-1, width)[:count]] = data
    return octets.view(f"<u{width}").ravel()


def encode_file(doc_ids: list[int | None], counts: np.ndarray, ranks: np.ndarray, bits: int) -> bytes:
    control, data = encode_ranks(ranks, bits)
    header = np.array([MAGIC, bits, len(doc_ids), len(ranks)], "<u4").tobytes()
    given = np.array([x is not None for x in doc_ids], np.uint8)
    ids = np.array([x or 0 for x in doc_ids], "<i8")
    return b"".join([header, ids.tobytes(), given.tobytes(), counts.astype("<u4").tobytes(), control, data])


def decode_file(raw: bytes, ids_of_rank: np.ndarray) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, numbers of ids and all ids of a file."""
    magic, bits, docs, count = np.frombuffer(raw, "<u4", 4).tolist()
    if magic != MAGIC:
        raise ValueError("not a file of token ids")
    at = 16
    doc_ids = np.frombuffer(raw, "<i8", docs, at).tolist()
    given = np.frombuffer(raw, np.uint8, docs, at + 8 * docs)
    counts = np.frombuffer(raw, "<u4", docs, at + 9 * docs)
    at += 13 * docs
    controls = -(-count // (8 // bits))
    control = np.frombuffer(raw, np.uint8, controls, at)
    data = np.frombuffer(raw, np.uint8, len(raw) - at - controls, at + controls)
    return [x if g else None for x, g in zip(doc_ids, given, strict=True)], counts, ids_of_rank[decode_ranks(control, data, count, bits)]


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


def tokenize(docs: DataFrame, tokenizer: str, end_id: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Ids of each document in ascending doc_id: shard, place in it, doc_id, ids (16-bit where the vocabulary allows)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    shards = groups_for(texts.agg(F.sum(F.octet_length("text"))).first()[0], shard_bytes)
    ordered = texts.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text").withColumn("shard", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, place = encoder(tokenizer), 0
        kind = "<u2" if control_bits(len(coder.edge)) == 1 else "<u4"
        for batch in small_batches(batches):
            ids, counts = coder.encode(batch.column("text"))
            if not len(counts):
                continue
            packed = np.insert(ids, np.cumsum(counts), end_id).astype(kind)
            ends = np.cumsum(counts + 1) * packed.itemsize
            offsets = np.concatenate([[0], ends]).astype(np.int32)
            binary = pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("shard").cast(pa.int32()), pa.array(np.arange(place, place + len(counts))), batch.column("doc_id"), binary], schema=_TOKENS)
            place += len(counts)

    return keep(ordered.mapInArrow(run, "shard int, place long, doc_id long, ids binary"), "tokens")


def _joined(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows one after the other, read in place, and each row's number of ids."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset)
    size = np.dtype(kind).itemsize
    return np.frombuffer(data or b"", kind, int(ends[-1] - ends[0]) // size, int(ends[0])), np.diff(ends) // size


def rank_ids(tokens: DataFrame, kind: str) -> np.ndarray:
    """Ids in descending frequency over all documents, then ascending; one entry for each id that occurs."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            found = np.bincount(_joined(batch.column("ids"), kind)[0])
            total = np.pad(total, (0, max(0, len(found) - len(total))))
            total[:len(found)] += found
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], names=["id", "n"])

    counted = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rows = counted.collect()  # one row per id of the vocabulary
    return np.array([r.id for r in sorted(rows, key=lambda r: (-r.n, r.id))], np.uint32)


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Write the files; one row per file: shard, place of its first document, file, n_docs, file_tokens."""
    from .tokens import tokenizer_path
    from tokenizers import Tokenizer

    size = max(Tokenizer.from_file(tokenizer_path(tokenizer)).get_vocab(with_added_tokens=True).values()) + 1
    bits = control_bits(size)
    kind = "<u2" if bits == 1 else "<u4"
    tokens = tokenize(docs, tokenizer, end_id)
    ids_of_rank = rank_ids(tokens, kind)
    write_file(folder, "ranks", ids_of_rank.astype("<u4").tobytes())
    rank_of_id = np.zeros(size, np.uint32)
    rank_of_id[ids_of_rank] = np.arange(len(ids_of_rank), dtype=np.uint32)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, place = np.asarray(batch.column("shard")), np.asarray(batch.column("place"))
            # documents that follow one another in a shard make a file
            cuts = [0, *(np.flatnonzero((np.diff(shard) != 0) | (np.diff(place) != 1)) + 1).tolist(), len(shard)] if len(shard) else [0]
            rows = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                ids, counts = _joined(batch.column("ids").slice(a, b - a), kind)
                name = f"{shard[a]:08d}-{place[a]:012d}.ids"
                write_file(folder, name, encode_file(batch.column("doc_id").slice(a, b - a).to_pylist(), counts, rank_of_id[ids], bits))
                rows.append((int(shard[a]), int(place[a]), name, b - a, len(ids)))
            yield _table(_FILES, rows)

    return keep(tokens.mapInArrow(write, "shard int, place long, file string, n_docs long, file_tokens long"), "files")


def read_ids(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """One row per document, read from the files: doc_id, start, n_tokens, ids_crc32."""
    ranks = spark.read.format("binaryFile").load(f"{folder}/ranks").select("content").first()
    ids_of_rank = np.frombuffer(ranks[0] if ranks else b"", "<u4")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                shard, _, place = path.rpartition("/")[2].removesuffix(".ids").partition("-")
                doc_ids, counts, ids = decode_file(raw.as_buffer(), ids_of_rank)
                ids = ids.astype("<u4")
                ends = np.cumsum(counts.astype(np.int64))
                starts = ends - counts
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays([
                    pa.array([int(shard)] * n, pa.int32()), pa.array([int(place)] * n, pa.int64()), pa.array(np.arange(n)), pa.array(doc_ids, pa.int64()),
                    pa.array(starts), pa.array(counts.astype(np.int64)), pa.array(crcs, pa.int64())], schema=_READ)

    earlier = Window.orderBy("shard", "place").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    starts = files.select("shard", "place", F.coalesce(F.sum("file_tokens").over(earlier), F.lit(0)).alias("file_start"))
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(folder).select("path", "content")
    read = content.mapInArrow(decode, "shard int, place long, nth long, doc_id long, before long, n_tokens long, ids_crc32 long")
    return read.join(starts, ["shard", "place"]).select("doc_id", (F.col("file_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write all documents and read the files back."""
    folder = new_folder(docs.sparkSession, "ids")
    files = write_ids(docs, folder, tokenizer, end_id)
    return read_ids(docs.sparkSession, folder, files)
