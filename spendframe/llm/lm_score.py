"""Cross-entropy difference of two matched language models.

A target model (documents of known good quality) and a background model (all others)
are word bigram models over one vocabulary, that of both together. The background's
counts are scaled to the target's number of words, and both are smoothed alike:

    q(w)    = count of w in both / words in both
    u(w)    = (count of w + UNIGRAM * q(w)) / (words + UNIGRAM)
    p(w|v)  = (count of vw + BIGRAM * u(w)) / (count of v as context + BIGRAM)

A document's own counts are left out of the model it belongs to. Its score is the mean
over its words of log p(target) - log p(background): positive if it is more like the
target.

Documents are dealt into blocks. A block sends each distinct word and bigram once, as a
hash with its counts, to the part that sums this stretch of hashes, and gets the
corpus counts back in the same order; so a frequent bigram costs a row per block, not
one per use, and no task holds the model. Counts cover all documents.

Nulls: a null text is empty; labels without doc_id or quality are left out, and a document
without doc_id is background. Texts without words get 0 words, no losses and score 0.
Rows of one doc_id share their label. A text longer than a block is a block of its own, whole. Without target or background both models are alike.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups_for, small_batches, text_of
from .near_dups import _mix, word_hashes

UNIGRAM, BIGRAM = 1000.0, 16.0
BLOCK_BYTES = 8 << 20
PART_BYTES = 24 << 20  # of documents for each part of the hashes
KEY_BYTES = 5  # of a hash, besides the bits that name its part
_START = np.uint64(0x5354415254)
_SENT = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("target", pa.binary()), ("background", pa.binary())])
_BACK = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("doc_id", pa.int64()), ("target", pa.binary()), ("background", pa.binary())])
_SCORED = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("target_loss", pa.float64()), ("background_loss", pa.float64()), ("score", pa.float64())])


class _Block:
    """Words, contexts and bigrams of a block's documents, and its distinct keys in order."""

    def __init__(self, docs: pa.Table, targets: set[int], part_bits: int) -> None:
        words, counts = word_hashes(docs.column("text").combine_chunks())
        self.doc_ids, self.counts = docs.column("doc_id").to_pylist(), counts
        self.is_target = np.fromiter((d is not None and d in targets for d in self.doc_ids), bool, len(self.doc_ids))
        self.doc = np.repeat(np.arange(len(counts)), counts)
        begins = (np.cumsum(counts) - counts)[counts > 0]
        rest = np.uint64(64 - part_bits - 8 * KEY_BYTES)
        one, half = np.uint64(1), np.uint64(1 << 63)  # the first bit tells words from bigrams
        with np.errstate(over="ignore"):
            spread = _mix(words)
            before = np.concatenate([_mix(np.array([_START])), spread])[:-1] if len(words) else spread
            before[begins] = _mix(np.array([_START]))[0]
            pairs = _mix(before * np.uint64(0x9E3779B97F4A7C15) + spread)
            opening = _mix(np.array([_START]))
        del before
        single, index = np.unique(np.concatenate([spread, opening]) >> one >> rest, return_inverse=True)
        double, self.pair = np.unique((pairs >> one | half) >> rest, return_inverse=True)
        self.word, start = index[:-1], index[-1]
        self.context = np.concatenate([[start], self.word])[:-1] if len(words) else self.word
        self.context[begins] = start
        self.keys = np.concatenate([single, double])
        self.pair = self.pair + len(single)
        self.parts = (self.keys >> np.uint64(8 * KEY_BYTES)).astype(np.int64)

    def counted(self, of: np.ndarray) -> np.ndarray:
        """Counts over the documents chosen: words as contexts have an entry of their own only if no word is the same."""
        chosen = of[self.doc]
        n = len(self.keys)
        counts = np.bincount(self.word[chosen], minlength=n) + np.bincount(self.pair[chosen], minlength=n)
        opened = np.flatnonzero(of & (self.counts > 0))
        if len(opened):
            counts[self.context[(np.cumsum(self.counts) - self.counts)[opened[0]]]] += len(opened)
        return counts

    def slices(self) -> Iterator[tuple[int, int, int]]:
        edges = np.flatnonzero(np.diff(self.parts, prepend=-1, append=-1))
        for a, b in zip(edges, edges[1:], strict=False):
            yield int(self.parts[a]), int(a), int(b)


def _planes(values: np.ndarray, size: int) -> bytes:
    """The low ``size`` bytes of each value, those of equal weight together: the shuffle's codec makes the high ones small."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def _from_planes(raw: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(raw) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8).reshape(size, -1).T
    return out.view("<u8").ravel()


def _short(keys: np.ndarray) -> bytes:
    """Steps between the low bytes of ascending keys of one part."""
    low = keys & np.uint64((1 << 8 * KEY_BYTES) - 1)
    return _planes(np.diff(low, prepend=np.uint64(0)), KEY_BYTES)


def _long(raw: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(raw, KEY_BYTES), dtype=np.uint64)


def _packed(counts: np.ndarray) -> bytes:
    """Counts in 4 bytes each, or in 8 where 4 do not hold them."""
    return _planes(counts, 4 if counts.max(initial=0) < 1 << 32 else 8)


def _counts(raw: bytes, n: int) -> np.ndarray:
    return _from_planes(raw, max(1, len(raw) // max(1, n)))


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.Table.from_arrays([pa.array(list(x), f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


def _sum_part(table: pa.Table) -> pa.Table:
    """Corpus counts of a part's keys, for each block in the order of its keys."""
    raw = table.column("keys").to_pylist()
    sizes = np.array([len(x) // KEY_BYTES for x in raw])
    keys, index = np.unique(np.concatenate([_long(x) for x in raw]), return_inverse=True)
    out = {}
    for name in ("target", "background"):
        own = np.concatenate([_counts(x, n) for x, n in zip(table.column(name).to_pylist(), sizes.tolist(), strict=True)])
        out[name] = np.bincount(index, own, len(keys)).astype(np.uint64)[index]
    rows, at = [], 0
    for block, part, size in zip(table.column("block").to_pylist(), table.column("part").to_pylist(), sizes.tolist(), strict=True):
        rows.append((block, part, None, _packed(out["target"][at:at + size]), _packed(out["background"][at:at + size])))
        at += size
    return _table(_BACK, rows)


def _scores(block: _Block, target: np.ndarray, background: np.ndarray, n_target: float, n_background: float) -> pa.Table:
    """Losses of each document, its own counts left out."""
    n_docs = len(block.counts)
    keys = len(block.keys)
    words = np.bincount(block.doc, minlength=n_docs).astype(float)

    def own(index: np.ndarray, also: np.ndarray | None = None) -> np.ndarray:
        """How often each token's key stands in its own document; ``also`` are the entries that count."""
        counted = block.doc * keys + (index if also is None else also)
        found, n = np.unique(counted, return_counts=True)
        at = np.searchsorted(found, wanted := block.doc * keys + index)
        at = np.minimum(at, len(found) - 1)
        return np.where(found[at] == wanted, n[at], 0)

    if not len(block.doc):
        return _table(_SCORED, [(d, 0, None, None, 0.0) for d in block.doc_ids])
    mine_word, mine_pair, mine_context = own(block.word), own(block.pair), own(block.context, block.word)
    opening = (np.cumsum(block.counts) - block.counts)[block.counts > 0]
    mine_context[opening] = 1  # the start of the text stands in it once
    in_target = block.is_target[block.doc]
    n_own = words[block.doc]
    together = target + background
    q = np.maximum(together[block.word], 1) / max(1.0, n_target + n_background)
    losses = []
    scale = n_target / n_background if n_target and n_background else 1.0
    for counts, total, is_own, factor in ((target, n_target, in_target, 1.0), (background, n_background, ~in_target, scale)):
        both = bool(n_target and n_background)
        left = lambda index, mine: factor * np.maximum(counts[index] - np.where(is_own, mine, 0), 0) * both  # noqa: B023, E731
        n = factor * np.maximum(total - np.where(is_own, n_own, 0), 0) * both
        u = (left(block.word, mine_word) + UNIGRAM * q) / (n + UNIGRAM)
        p = (left(block.pair, mine_pair) + BIGRAM * u) / (left(block.context, mine_context) + BIGRAM)
        losses.append(np.bincount(block.doc, -np.log(p), n_docs) / np.maximum(words, 1))
    rows = [(d, int(n), float(t) if n else None, float(b) if n else None, float(b - t) if n else 0.0)
            for d, n, t, b in zip(block.doc_ids, words, *losses, strict=True)]
    return _table(_SCORED, rows)


def cross_entropy_difference(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, target_loss, background_loss and score; ``labels`` holds doc_id and quality, 1 for the target."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            _, counts = word_hashes(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), batch.column("size")], names=["doc_id", "n", "size"])

    sizes = texts.withColumn("size", F.octet_length("text").cast("long")).mapInArrow(count, "doc_id long, n long, size long")
    per = sizes.join(good.withColumn("good", F.lit(True)), "doc_id", "left").agg(
        F.sum(F.when(F.col("good"), F.col("n"))).alias("target"), F.sum(F.when(F.col("good").isNull(), F.col("n"))).alias("background"),
        F.sum("size").alias("size")).first()
    n_target, n_background = float(per.target or 0), float(per.background or 0)
    blocks = groups_for(per.size, BLOCK_BYTES)
    part_bits = 1 + (groups_for(per.size, PART_BYTES) - 1).bit_length() + 1
    block = lambda of: F.pmod(F.xxhash64(of), F.lit(blocks)).cast("long")

    def send(key: tuple, documents: pa.Table, targets: pa.Table) -> pa.Table:
        own = _Block(documents, set(targets.column("doc_id").to_pylist()), part_bits)
        target, background = own.counted(own.is_target), own.counted(~own.is_target)
        return _table(_SENT, [(part, key[0].as_py(), _short(own.keys[a:b]), _packed(target[a:b]), _packed(background[a:b])) for part, a, b in own.slices()])

    def score(key: tuple, documents: pa.Table, back: pa.Table) -> pa.Table:
        parts = back.column("part").to_pylist()
        targets = {d for d, p in zip(back.column("doc_id").to_pylist(), parts, strict=True) if p < 0}
        own = _Block(documents, targets, part_bits)
        at = {part: k for k, part in enumerate(parts)}
        target, background = np.zeros(len(own.keys)), np.zeros(len(own.keys))
        for part, a, b in own.slices():
            target[a:b] = _counts(back.column("target")[at[part]].as_py(), b - a)
            background[a:b] = _counts(back.column("background")[at[part]].as_py(), b - a)
        return _scores(own, target, background, n_target, n_background)

    dealt = texts.withColumn("block", block(F.coalesce("doc_id", F.xxhash64("text"))))  # shuffled once, used twice
    known = good.withColumn("block", block(F.col("doc_id")))
    sent = dealt.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(
        send, "part long, block long, keys binary, target binary, background binary")
    back = sent.groupBy("part").applyInArrow(_sum_part, "block long, part long, doc_id long, target binary, background binary")
    both = back.unionByName(known.select("block", F.lit(-1).cast("long").alias("part"), "doc_id", F.lit(None).cast("binary").alias("target"),
                                         F.lit(None).cast("binary").alias("background")))
    return dealt.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(
        score, "doc_id long, n_words long, target_loss double, background_loss double, score double")
