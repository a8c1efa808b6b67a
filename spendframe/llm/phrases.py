"""Phrase collocations from n-gram fingerprints.

ASCII letters are lower-cased; texts part into pieces at '.,;:!?' and line breaks and pieces
into words at spaces and tabs. Each task gathers texts to blocks of ``BLOCK_BYTES``, with
one space between the words of a piece and a line break between pieces. Prefix polynomials
over a block's bytes (modulo 2^64, numpy) give every run of 1 to ``max_words`` words its
Rabin-Karp fingerprint by one subtraction. A block's equal fingerprints are counted with a
pointer to one occurrence each; neighbours in fingerprint order are compared byte by byte
in the block, and runs that share a fingerprint but not their text are counted apart.

Counted fingerprints are dealt by their leading bits and summed. An occurrence pointer is a
block and the place of the fingerprint in its order, so it needs no bytes of its own: a
part answers each block with a bit per fingerprint, set for those that reach ``min_count``.
The block, a file in the shared folder that is named by the hash of its content, counts its
runs again, and the texts of frequent runs, and of these only, go to their part once more
to be summed by text. So two runs of different blocks that share a fingerprint cannot add
up either. Parts of a frequent run are frequent themselves, so the table of frequent runs
holds all counts a score needs.

Runs grow word by word. A run of n words can reach ``min_count`` only if both its runs of
n - 1 words do, so before runs of n words are counted, each task leaves out those whose
parts are not in a bit set of the frequent fingerprints of n - 1 words. The set has
``FILTER_BITS`` bits (8 MB) for any input; it is the one thing that goes through the driver.
If it fills up it leaves out less, never a frequent run.

A frequent run is one record in a block however often it occurs there, so frequent words and
a language with a third of all texts are spread by block. A block has one row per part; a
part is a share of the fingerprints with about ``PART_BYTES`` of text behind it. A document
is never cut, so a task holds its longest document, about six times.

Nulls: a null text is empty, a null language is 'und'. Empty texts have no words. Repeated
rows count as often as they stand there. Ties are ordered by count and then by the phrase's
bytes. A language without frequent phrases has no rows; neither has an empty table. Only
text and lang are read, other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import remember
from .common import file_system, groups_for, keep, new_folder, small_batches, text_of, write_file

MAX_WORDS = 3
MIN_COUNT = 10
KEPT_PER_LANG = 2000
BLOCK_BYTES = 8 << 20
PART_BYTES = 8 << 20
MAX_TASKS = 100_000
FILTER_BITS = 26  # the set of frequent runs has 2^26 bits
COMPARED = 1 << 18  # runs compared at once
_STRETCH = 1 << 20  # bytes that are hashed at once
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_BREAKS, _BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_KIND = np.zeros(256, np.uint8)  # 0 word, 1 blank, 2 break
_KIND[list(_BLANKS)] = 1
_KIND[list(_BREAKS)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE, _BREAK = 32, 10


def _powers(base: int) -> np.ndarray:
    values = np.full(_STRETCH, base, np.uint64)
    values[0] = 1
    return np.multiply.accumulate(values)


class _Tables:
    """Powers of the base and of its inverse, and a random value of each byte; made once a worker."""

    made: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    @classmethod
    def get(cls) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if cls.made is None:
            values = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
            cls.made = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64)), values
        return cls.made


def normalise(data: bytes) -> np.ndarray:
    """Lower-cased words with one space or, between pieces, one line break behind each."""
    raw = np.frombuffer(data + b"\n", np.uint8)
    kind = _KIND[raw]
    word = kind == 0
    if not word.any():
        return np.zeros(0, np.uint8)
    ends = np.flatnonzero(word[:-1] & ~word[1:]) + 1
    breaks = np.cumsum(kind == 2, dtype=np.int32)
    until = np.append(np.flatnonzero(word[1:] & ~word[:-1]), len(raw) - 1)[-len(ends):]  # last gap byte behind each word
    broken = breaks[until] > breaks[ends - 1]
    broken[-1] = True
    out = _LOWER[raw]
    out[ends] = np.where(broken, _BREAK, _SPACE)
    word[ends] = True
    return out[word]


def word_places(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word of a normalised text, and whether the next word is of the same piece."""
    ends = np.flatnonzero((text == _SPACE) | (text == _BREAK))
    starts = np.empty_like(ends)
    starts[:1], starts[1:] = 0, ends[:-1] + 1
    return starts, ends, text[ends] == _SPACE


def prefix_hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix polynomial at each word's start and end, and the inverse power at its start."""
    powers, inverses, values = _Tables.get()
    at_start, at_end, inverse = (np.empty(len(starts), np.uint64) for _ in range(3))
    carry, scale, back = 0, 1, 1
    step, step_back = pow(_BASE, _STRETCH, 1 << 64), pow(pow(_BASE, -1, 1 << 64), _STRETCH, 1 << 64)
    for at in range(0, len(text), _STRETCH):
        part = text[at:at + _STRETCH]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(values[part] * powers[:len(part)], out=sums[1:])
        sums = sums * np.uint64(scale) + np.uint64(carry)
        first, last = np.searchsorted(starts, (at, at + _STRETCH))
        places = starts[first:last] - at
        at_start[first:last] = sums[places]
        inverse[first:last] = inverses[places] * np.uint64(back)
        first, last = np.searchsorted(ends, (at, at + _STRETCH))
        at_end[first:last] = sums[ends[first:last] - at]
        carry, scale, back = int(sums[-1]), scale * step & _MASK, back * step_back & _MASK
    return at_start, at_end, inverse


def _mixed(values: np.ndarray) -> np.ndarray:
    """The same number of different values, evenly spread."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _seeds(langs: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little") for lang in langs], np.uint64)


def _among(frequent: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Whether fingerprints are in a bit set by their leading bits."""
    places = prints >> np.uint64(64 - FILTER_BITS)
    return (frequent[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


class Block:
    """A normalised text of one or more languages, language by language."""

    def __init__(self, text: np.ndarray, langs: list[str], words: list[int]) -> None:
        self.text, self.langs, self.words = text, langs, words
        self.starts, self.ends, self.joined = word_places(text)
        self.lang_ends = np.cumsum(words)
        self.padded = np.concatenate([text, np.zeros(8, np.uint8)])

    @classmethod
    def of(cls, texts: list[tuple[str, bytes]]) -> Block:
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in texts:
            by_lang.setdefault(lang, []).append(text)
        langs = sorted(by_lang)
        parts = [normalise(b"\n".join(by_lang[lang])) for lang in langs]
        return cls(np.concatenate(parts), langs, [int(np.count_nonzero((p == _SPACE) | (p == _BREAK))) for p in parts])

    def to_bytes(self) -> bytes:
        head = json.dumps([self.langs, self.words]).encode()
        return zstandard.ZstdCompressor(level=1).compress(len(head).to_bytes(8, "little") + head + self.text.tobytes())

    @classmethod
    def from_bytes(cls, data: bytes) -> Block:
        plain = zstandard.ZstdDecompressor().decompress(data)
        size = int.from_bytes(plain[:8], "little")
        langs, words = json.loads(plain[8:8 + size])
        return cls(np.frombuffer(plain, np.uint8, offset=8 + size), langs, words)

    def lang_of(self, words: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lang_ends, words, side="right")

    def runs(self, n: int, bits: int, frequent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint and pointer (first word * 8 + n) of every run of ``n`` words whose shorter runs may be frequent."""
        at_start, at_end, inverse = prefix_hashes(self.text, self.starts, self.ends)
        seeds = np.repeat(_seeds(self.langs), self.words)

        def prints(first: np.ndarray, size: int) -> np.ndarray:
            found = _mixed((at_end[first + size - 1] - at_start[first]) * inverse[first] + seeds[first] + np.uint64(size))
            return found if bits == 64 else found >> np.uint64(64 - bits) << np.uint64(64 - bits)

        first = np.arange(max(0, len(self.starts) - n + 1), dtype=np.int64)
        for k in range(1, n):
            first = first[self.joined[first + k - 1]]
        if frequent is not None:
            first = first[_among(frequent, prints(first, n - 1))]
            first = first[_among(frequent, prints(first + 1, n - 1))]
        return prints(first, n), first * 8 + n

    def spans(self, pointers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, n = pointers >> 3, pointers & 7
        return self.starts[first], self.ends[first + n - 1]

    def differ(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Whether the runs at two lists of pointers differ in language or text."""
        parts = [self._differ(one[at:at + COMPARED], other[at:at + COMPARED]) for at in range(0, len(one), COMPARED)]
        return np.concatenate(parts) if parts else np.zeros(0, bool)

    def _differ(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        (a, a_end), (b, b_end) = self.spans(one), self.spans(other)
        size = a_end - a
        unlike = (size != b_end - b) | (self.lang_of(one >> 3) != self.lang_of(other >> 3))
        eight = np.ndarray((len(self.text) + 1,), "<u8", self.padded.data, strides=(1,))
        left = np.flatnonzero(~unlike)
        for at in range(0, 64, 8):
            left = left[size[left] > at]
            if not len(left):
                return unlike
            bits = np.minimum(size[left] - at, 8).astype(np.uint64) * np.uint64(8)
            wrong = (eight[a[left] + at] ^ eight[b[left] + at]) << (np.uint64(64) - bits) != 0
            unlike[left[wrong]] = True
            left = left[~wrong]
        for i in left[size[left] > 64]:
            unlike[i] = not np.array_equal(self.text[a[i] + 64:a_end[i]], self.text[b[i] + 64:b_end[i]])
        return unlike

    def counted(self, n: int, bits: int, frequent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint, pointer and count of each different run of ``n`` words, in the order of the fingerprints."""
        prints, pointers = self.runs(n, bits, frequent)
        order = np.argsort(prints)
        prints, pointers = prints[order], pointers[order]
        same = np.flatnonzero(prints[1:] == prints[:-1])
        clashing = np.unique(prints[same[self.differ(pointers[same], pointers[same + 1])]])
        heads = np.flatnonzero(np.append(True, prints[1:] != prints[:-1])[:len(prints)])
        counts = np.diff(np.append(heads, len(prints)))
        found = prints[heads], pointers[heads], counts
        if not len(clashing):
            return found
        kept = ~np.isin(found[0], clashing)
        more: list[tuple[int, int, int]] = []
        for value in clashing:
            texts: dict[tuple[int, bytes], list[int]] = {}
            for pointer in pointers[np.searchsorted(prints, value):np.searchsorted(prints, value, side="right")]:
                (start,), (end,) = self.spans(np.array([pointer]))
                texts.setdefault((int(self.lang_of(np.array([pointer >> 3]))[0]), self.text[start:end].tobytes()), []).append(int(pointer))
            more += [(int(value), group[0], len(group)) for group in texts.values()]
        split = np.array([m[0] for m in more], np.uint64), np.array([m[1] for m in more]), np.array([m[2] for m in more])
        prints, pointers, counts = (np.concatenate([a[kept], b]) for a, b in zip(found, split, strict=True))
        order = np.argsort(prints, kind="stable")
        return prints[order], pointers[order], counts[order]

    def texts(self, pointers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and bytes of the runs at a list of pointers."""
        starts, ends = self.spans(pointers)
        sizes = ends - starts
        places = np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        return sizes, self.text[places]


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight next to each other, which the shuffle's codec makes small."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _from_planes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(size, -1).T.copy().view(kind).reshape(-1)


_COUNTED = "part int, block string, prints binary, counts binary"
_FREQUENT = "part int, block string, often binary, filter binary"
_TEXTS = "part int, lang string, sizes binary, texts binary, counts binary"
_NAMED = "lang string, phrase string, n int, f long"


def _fields(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def _read_block(folder: str, name: str) -> Block:
    system, path = file_system(folder)
    with system.open_input_stream(f"{path}/{name}") as file:
        return Block.from_bytes(file.read())


def write_blocks(docs: DataFrame, folder: str, block_bytes: int) -> DataFrame:
    """Write all texts as block files; their names."""

    def emit(texts: list[tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
        block = Block.of(texts)
        if len(block.text):
            data = block.to_bytes()
            name = hashlib.sha256(data).hexdigest()
            write_file(folder, name, data)
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.string())], names=["block"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[str, bytes]] = []
        size = 0
        for batch in small_batches(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                waiting.append((lang, text))
                size += len(text)
                if size >= block_bytes:
                    yield from emit(waiting)
                    waiting, size = [], 0
        if waiting:
            yield from emit(waiting)

    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of().alias("text"))
    # equal texts may make equal blocks, which count as often as they were made
    return keep(texts.mapInArrow(run, "block string").groupBy("block").agg(F.count(F.lit(1)).alias("times")), "blocks")


def _part_edges(prints: np.ndarray, part_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Parts that a block has fingerprints of, and where each begins; the last edge is the end."""
    parts = (prints >> np.uint64(64 - part_bits)).astype(np.int64) if part_bits else np.zeros(len(prints), np.int64)
    heads = np.flatnonzero(np.append(True, parts[1:] != parts[:-1])[:len(parts)])
    return parts[heads], np.append(heads, len(parts))


def _count_runs(blocks: DataFrame, tasks: int, folder: str, n: int, bits: int, part_bits: int, frequent) -> DataFrame:
    """Counted fingerprints of the blocks' runs of ``n`` words, one row per block and part."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, times in zip(batch.column("block").to_pylist(), batch.column("times").to_pylist(), strict=True):
                prints, _, counts = _read_block(folder, name).counted(n, bits, _shared(frequent))
                counts = (counts * times).astype(np.uint64)
                parts, edges = _part_edges(prints, part_bits)
                for at in range(0, len(parts), 16):
                    spans = [slice(edges[i], edges[i + 1]) for i in range(at, min(at + 16, len(parts)))]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(parts[at:at + 16], pa.int32()), pa.array([name] * len(spans), pa.string()),
                        pa.array([_planes(np.diff(prints[span], prepend=np.uint64(0))) for span in spans], pa.binary()),
                        pa.array([_planes(counts[span]) for span in spans], pa.binary())], names=_fields(_COUNTED))

    return blocks.repartition(tasks).mapInArrow(run, _COUNTED)


def _shared(frequent) -> np.ndarray | None:
    return None if frequent is None else np.frombuffer(frequent.value, np.uint8)


def _frequent_runs(counted: DataFrame, min_count: int, part_bits: int) -> DataFrame:
    """For each block and part, which of its fingerprints reach ``min_count`` over all blocks, and each part's stretch of the bit set."""
    stretch = 1 << (FILTER_BITS - part_bits)

    def run(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        each = [np.cumsum(_from_planes(x.as_py(), "<u8"), dtype=np.uint64) for x in group.column("prints")]
        counts = np.concatenate([_from_planes(x.as_py(), "<u8") for x in group.column("counts")]).astype(np.int64)
        prints = np.concatenate(each)
        order = np.argsort(prints)
        ordered = prints[order]
        heads = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        often = np.add.reduceat(counts[order], heads) >= min_count
        bits = np.zeros(stretch, bool)
        bits[(ordered[heads[often]] >> np.uint64(64 - FILTER_BITS)).astype(np.int64) - part * stretch] = True
        chosen = np.zeros(len(prints), bool)
        chosen[order[np.repeat(often, np.diff(np.append(heads, len(order))))]] = True
        answers = [np.packbits(x).tobytes() for x in np.split(chosen, np.cumsum([len(x) for x in each])[:-1])]
        size = group.num_rows + 1
        return pa.table([
            pa.array([part] * size, pa.int32()), pa.array([*group.column("block").to_pylist(), None], pa.string()),
            pa.array([*answers, None], pa.binary()), pa.array([None] * (size - 1) + [np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=_fields(_FREQUENT))

    return counted.groupBy("part").applyInArrow(run, _FREQUENT)


def _frequent_texts(answers: DataFrame, blocks: DataFrame, tasks: int, folder: str, n: int, bits: int, part_bits: int, frequent) -> DataFrame:
    """Texts and counts of each block's frequent runs, one row per part and language."""

    def run(group: pa.Table) -> pa.Table:
        name, times = group.column("block")[0].as_py(), group.column("times")[0].as_py()
        block = _read_block(folder, name)
        prints, pointers, counts = block.counted(n, bits, _shared(frequent))
        by_part = dict(zip(group.column("part").to_pylist(), group.column("often").to_pylist(), strict=True))
        parts, edges = _part_edges(prints, part_bits)
        rows = []
        for part, start, end in zip(parts.tolist(), edges[:-1], edges[1:], strict=True):
            mine = start + np.flatnonzero(np.unpackbits(np.frombuffer(by_part[part], np.uint8), count=end - start))
            langs = block.lang_of(pointers[mine] >> 3)
            for lang in np.unique(langs):
                some = mine[langs == lang]
                sizes, text = block.texts(pointers[some])
                rows.append((part, block.langs[lang], _planes(sizes.astype(np.uint64)), zstandard.ZstdCompressor(level=3).compress(text.tobytes()),
                             _planes((counts[some] * times).astype(np.uint64))))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        return pa.table([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.string()), *[pa.array(c, pa.binary()) for c in columns[2:]]], names=_fields(_TEXTS))

    # answers are small but their blocks are not: so many tasks, whatever the answers' bytes
    return answers.where("block is not null").join(blocks, "block").repartition(tasks, "block").groupBy("block").applyInArrow(run, _TEXTS)


def _summed_texts(texts: DataFrame, n: int, min_count: int) -> DataFrame:
    """lang, phrase, n and f of the runs that reach ``min_count`` by their texts; a part has all of a text's rows."""

    def run(group: pa.Table) -> pa.Table:
        tables = []
        for row in group.to_batches():
            for lang, sizes, text, counts in zip(*[row.column(c).to_pylist() for c in ("lang", "sizes", "texts", "counts")], strict=True):
                offsets = np.append(0, np.cumsum(_from_planes(sizes, "<u8"))).astype(np.int64)
                data = zstandard.ZstdDecompressor().decompress(text)
                phrases = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                lang_of = pa.array([lang], pa.string()).take(pa.array(np.zeros(len(phrases), np.int64)))
                tables.append(pa.table([lang_of, phrases, pa.array(_from_planes(counts, "<u8").astype(np.int64))], names=["lang", "phrase", "f"]))
        summed = pa.concat_tables(tables).combine_chunks().group_by(["lang", "phrase"]).aggregate([("f", "sum")])
        kept = summed.filter(pc.greater_equal(summed.column("f_sum"), min_count))
        size = kept.num_rows
        return pa.table([kept.column("lang"), kept.column("phrase").cast(pa.binary()).cast(pa.string()), pa.array([n] * size, pa.int32()), kept.column("f_sum")], names=_fields(_NAMED))

    return texts.groupBy("part").applyInArrow(run, _NAMED)


def _bit_set(frequent: DataFrame, part_bits: int) -> bytes:
    """The bit set of a table of frequent fingerprints; its size does not depend on theirs."""
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    size = len(bits) >> part_bits
    for row in frequent.where("filter is not null").select("part", "filter").collect():
        bits[row.part * size:(row.part + 1) * size] = np.frombuffer(row.filter, np.uint8)
    return bits.tobytes()


def _lang_words(blocks: DataFrame, folder: str) -> DataFrame:
    """Words of each block's languages, as runs without text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, times in zip(batch.column("block").to_pylist(), batch.column("times").to_pylist(), strict=True):
                block = _read_block(folder, name)
                size = len(block.langs)
                yield pa.RecordBatch.from_arrays([
                    pa.array(block.langs, pa.string()), pa.array([""] * size, pa.string()), pa.array([0] * size, pa.int32()),
                    pa.array([w * times for w in block.words], pa.int64())], names=_fields(_NAMED))

    return blocks.mapInArrow(run, _NAMED)


def frequent_runs(
    docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, bits: int | None = None, block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES,
) -> DataFrame:
    """lang, phrase, n and f of all runs of 1 to ``max_words`` words that occur ``min_count`` times; n = 0 counts a language's words.

    Fingerprints have as many bytes as make chance meetings rare for the size of the input,
    or ``bits`` bits.
    """
    if not 1 <= max_words <= 7:
        raise ValueError("max_words must be between 1 and 7")
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text_of()))).first()[0] or 0
    bits = min(64, -(-(int(total).bit_length() + 18) // 8) * 8) if bits is None else bits
    part_bits = min(bits, (groups_for(total, part_bytes) - 1).bit_length(), FILTER_BITS - 6)
    folder = remember(new_folder(spark, "blocks"))
    blocks = write_blocks(docs, folder, block_bytes)
    tasks = min(max(1, blocks.count()), MAX_TASKS)
    words = _lang_words(blocks, folder).groupBy("lang", "phrase", "n").agg(F.sum("f").alias("f"))
    found, frequent = words, None
    for n in range(1, max_words + 1):
        counted = _count_runs(blocks, tasks, folder, n, bits, part_bits, frequent)
        answers = keep(_frequent_runs(counted, min_count, part_bits), "frequent")
        texts = _frequent_texts(answers, blocks, tasks, folder, n, bits, part_bits, frequent)
        found = found.unionByName(keep(_summed_texts(texts, n, min_count), "runs"))
        if n < max_words:
            frequent = spark.sparkContext.broadcast(_bit_set(answers, part_bits))
    return found


def _words(phrase: Column, first: int, n: int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first + 1, n), " ")


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, top: int = KEPT_PER_LANG, **blocks) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n and score.

    A phrase's score is its least over all cuts; phrases that a longer candidate holds at
    least half as often are dropped.
    """
    runs = frequent_runs(docs, max_words, min_count, **blocks)
    sizes = runs.where("n = 0").select(F.col("lang").alias("of_lang"), F.col("f").alias("n_words"))
    part = runs.where("n > 0").select(F.col("lang").alias("part_lang"), F.col("phrase").alias("part"), F.col("f").alias("part_f"))
    cuts = None
    for n in range(2, max_words + 1):
        for k in range(1, n):
            cut = runs.where(F.col("n") == n).select(
                "lang", "phrase", F.col("f").alias("a"), F.lit(k).alias("k"), _words(F.col("phrase"), 0, k).alias("head"), _words(F.col("phrase"), k, n - k).alias("tail"))
            cuts = cut if cuts is None else cuts.unionByName(cut)
    with_head = cuts.join(part, (F.col("lang") == F.col("part_lang")) & (F.col("head") == F.col("part"))).withColumnRenamed("part_f", "l").drop("part_lang", "part")
    with_both = with_head.join(part, (F.col("lang") == F.col("part_lang")) & (F.col("tail") == F.col("part"))).withColumnRenamed("part_f", "r")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = _floor_quotient(F.lit(1000000).cast("decimal(7,0)"), wide("a"), wide("l"), wide("r"))
    scored = with_both.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))
    held = None
    for n in range(3, max_words + 1):
        for m in range(2, n):
            for at in range(n - m + 1):
                inner = runs.where(F.col("n") == n).select(F.col("lang").alias("in_lang"), _words(F.col("phrase"), at, m).alias("inner"), F.col("f").alias("longer"))
                held = inner if held is None else held.unionByName(inner)
    if held is not None:
        longest = held.groupBy("in_lang", "inner").agg(F.max("longer").alias("longer"))
        scored = scored.join(longest, (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("inner")), "left").where(
            "longer is null or 2 * longer < a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score")).withColumn("rank", F.row_number().over(order))
    best = ranked.where(F.col("rank") <= top)
    return best.join(sizes, F.col("lang") == F.col("of_lang")).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("n_words").alias("n"), "score")


def _floor_quotient(million: Column, a: Column, left: Column, right: Column) -> Column:
    """floor(million * a * a / (left * right)) as a long, in exact decimals: a is at most 10^15."""
    return F.call_function("div", million * a * a, left * right)
