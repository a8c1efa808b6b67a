"""Removal of repeated byte strings by suffix arrays of difference covers.

A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere else too.

Distribution: each string of 200 bytes holds 161 places where 40 bytes begin; the place
of the least hash among them is its anchor. Equal strings have equal anchors at equal
offsets, so only texts around anchors whose 40 bytes occur more than once can hold
repeats, and strings of different anchors need not be compared. Texts around such
anchors, each with the strings it answers for, are dealt to tasks by anchor. An anchor
whose texts may pass ``HOT_BYTES`` is split further: each of its strings goes by its own
128-bit digest, counted once a bucket of documents and then over all buckets, so the
edges of a passage in very many documents meet in no single task.

In a task, starts whose strings hold 161 bytes that no other text has at the same distance
from the anchor are left out first. The suffixes of what remains are sorted by a difference cover modulo 3: the
sampled triples of letters are sorted and named, the names form a shorter text of the
same kind, and after two such rounds a name stands for 216 bytes, more than a repeat
needs; then the remaining suffixes of each round are sorted by their first letter and
the sampled suffix after it, and merged in. A letter is eight bytes, and the eight
alignments of each text are sorted together. Neighbours in the order are compared
over 200 bytes.

Nulls: a null text is empty. Rows are documents of their own, also without doc_id or
with the doc_id of another; equal rows are repeats of one another. Texts under 200
bytes are left as they are. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import groups_for, keep, text_of

LENGTH = 200
GRAM = 40
WINDOW = LENGTH - GRAM + 1
LETTER = 8
BLOCK_STARTS = 40  # starts of a context that are ruled out together
GROUP_BYTES = 4 << 20  # of texts around anchors in a task
HOT_BYTES = GROUP_BYTES  # of texts around one anchor; beyond it strings are dealt one by one
SORTED_BYTES = 1 << 18  # sorted at once, in some 180 times as much memory; more if one anchor has more
STRETCH_BYTES = 1 << 18  # of texts whose anchors are found at once, in some 60 times as much memory; a longer text is cut
DIGEST = 16
BUCKET_BYTES = 6 << 20  # of documents in a task
_BASE = 0x9E3779B97F4A7C15
_PLACE_BITS = 26
_CARRIED = "carried_"


def _codes() -> np.ndarray:
    return np.random.default_rng(200).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    with np.errstate(over="ignore"):
        up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up), np.cumprod(down)


class _Hashes:
    """Hashes of stretches of bytes by prefix sums."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = _powers(len(data))
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_codes()[data] * up)])

    def at(self, places: np.ndarray, length: int) -> np.ndarray:
        return self._mixed((self.sums[places + length] - self.sums[places]) * self.down[places])

    def everywhere(self, length: int) -> np.ndarray:
        return self._mixed((self.sums[length:] - self.sums[:-length]) * self.down[:len(self.sums) - length])

    @staticmethod
    def _mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(29))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 40 bytes at each place."""
    return _Hashes(data).everywhere(GRAM)


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by running minima of blocks from both sides."""
    n = len(values) - width + 1
    padded = np.concatenate([values, np.full(-len(values) % width, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def anchor_runs(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts that share an anchor: anchor's hash, text, first and last start in it.

    ``bounds`` are the texts' ends in ``data``, with 0 before them.
    """
    empty = np.empty(0, np.int64)
    if len(data) < LENGTH:
        return empty, empty, empty, empty
    hashes = gram_hashes(data)
    place_mask = np.uint64((1 << _PLACE_BITS) - 1)
    # the place breaks ties, leftmost first: equal strings choose alike
    packed = (hashes & ~place_mask) | np.arange(len(hashes), dtype=np.uint64)
    anchors = (_sliding_least(packed, WINDOW) & place_mask).astype(np.int64)
    sizes = np.diff(bounds)
    texts = np.flatnonzero(sizes >= LENGTH)
    starts = sizes[texts] - LENGTH + 1
    ends = np.cumsum(starts)
    text = np.repeat(texts, starts)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(bounds[texts] - (ends - starts), starts)
    chosen = anchors[at]
    change = np.flatnonzero((np.diff(chosen) != 0) | (np.diff(text) != 0)) + 1
    if not len(at):
        return empty, empty, empty, empty
    first, last = np.concatenate([[0], change]), np.concatenate([change, [len(at)]]) - 1
    owner = text[first]
    return hashes[chosen[first]].view(np.int64), owner, at[first] - bounds[owner], at[last] - bounds[owner]


def _names(keys: np.ndarray) -> np.ndarray:
    """Ranks of the distinct keys."""
    order = np.argsort(keys)
    ordered = keys[order]
    ranks = np.empty(len(keys), np.int64)
    ranks[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])]) if len(keys) else order
    return ranks


def _join(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """One key in the order of (high, low); both are below 2 ** 31."""
    return (high << 32) | low


def _triples(a: np.ndarray, b: np.ndarray, c: np.ndarray, names: int) -> np.ndarray:
    """One key in the order of (a, b, c)."""
    if names < 1 << 21:
        return (a << 42) | (b << 21) | c
    return _join(_names(_join(a, b)), c)


class _Chains:
    """Texts as chains of letters: a letter's place in its chain, and the letter after it.

    ``following`` is the number of letters past the end of a chain, and leads there from there.
    """

    def __init__(self, place: np.ndarray, following: np.ndarray) -> None:
        self.place, self.following = place, following


def rank_suffixes(letters: np.ndarray, chains: _Chains, rounds: int) -> np.ndarray:
    """Ranks of all suffixes by their first letters, 3 ** rounds of them at least; equal ones next to each other."""
    n = len(letters)
    remainder, after = chains.place % 3, chains.following
    sample = np.flatnonzero(remainder)
    size = int(letters.max()) + 2 if n else 2
    raised = np.append(letters + 1, 0)  # 0 past the end
    second = after[sample]
    third = after[second]
    names = _names(_triples(raised[sample], raised[second], raised[third], size))
    if rounds > 1 and len(sample) and names.max() + 1 < len(names):
        # the sampled places of one remainder are the chains of the next round, three letters a step
        index = np.full(n + 1, len(sample))
        index[sample] = np.arange(len(sample))
        names = rank_suffixes(names, _Chains(chains.place[sample] // 3, np.append(index[after[third]], len(sample))), rounds - 1)
    sampled = np.zeros(n + 1, np.int64)
    sampled[sample] = names + 1

    # suffixes at multiples of three: first letter, then the sampled suffix behind it
    rest = np.flatnonzero(remainder == 0)
    by_one = _join(raised[rest], sampled[after[rest]])
    order = np.argsort(by_one)
    rest, by_one = rest[order], by_one[order]
    ordered = sample[np.argsort(names)]
    is_one = remainder[ordered] == 1
    ones, twos = ordered[is_one], ordered[~is_one]
    one_keys = _join(raised[ones], sampled[after[ones]])
    both = np.concatenate([rest, twos])  # keys of both sides in one call: long ones are named together
    second = after[both]
    keys = _triples(raised[both], raised[second], sampled[after[second]], max(size, n + 2))
    by_two, two_keys = keys[:len(rest)], keys[len(rest):]
    # merge: each of the rest comes after its own predecessors and after the sampled suffixes that are less
    # (suffixes alike for longer than a repeat may compare either way; the running greatest keeps places apart)
    before = np.maximum.accumulate(np.searchsorted(one_keys, by_one) + np.searchsorted(two_keys, by_two))
    position = np.empty(n, np.int64)
    position[rest] = before + np.arange(len(rest))
    taken = np.zeros(n, bool)
    taken[position[rest]] = True
    position[ordered] = np.flatnonzero(~taken)
    return position


def repeated_starts(texts: list[bytes], starts: list[int]) -> list[np.ndarray]:
    """For each text whether the 200 bytes at its first ``starts`` places occur at another place too."""
    sizes = np.array([len(x) for x in texts])
    data = np.frombuffer(b"".join(texts) + bytes(LENGTH), np.uint8)
    begins = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    words = np.lib.stride_tricks.sliding_window_view(data, LETTER)[:n].copy().view(">u8").ravel().astype(np.uint64)
    within = np.arange(n) - np.repeat(begins, sizes)
    following = np.append(np.arange(n) + LETTER, n)
    following[:n][within + LETTER >= np.repeat(sizes, sizes)] = n
    ranks = rank_suffixes(_names(words), _Chains(within // LETTER, following), 3)
    wanted = np.flatnonzero(within < np.repeat(np.array(starts), sizes))
    ordered = wanted[np.argsort(ranks[wanted])]
    left, right = ordered[:-1], ordered[1:]
    alike = np.arange(len(left))
    for step in range(0, LENGTH, LETTER):
        alike = alike[words[left[alike] + step] == words[right[alike] + step]]
    repeated = np.zeros(n, bool)
    repeated[left[alike]] = repeated[right[alike]] = True
    return [repeated[b:b + s] for b, s in zip(begins.tolist(), starts, strict=True)]


def find_anchors(texts: DataFrame) -> DataFrame:
    """doc_id, tag, anchor, first and last start of each run, of all texts."""
    return keep(texts.mapInArrow(anchor_rows, "doc_id long, tag long, anchor long, first long, last long"), "anchors")


def anchor_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the runs in batches of texts, a stretch at a time."""
    for batch in batches:
        text = batch.column("text").cast(pa.large_binary())
        ends = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(text)).astype(np.int64))])
        for a, b in _stretches(ends):
            data = np.frombuffer(b"".join(x.as_py() for x in text.slice(a, b - a)), np.uint8)
            for anchor, owner, first, last in cut_runs(data, ends[a:b + 1] - ends[a]):
                owner = pa.array(owner + a)
                yield pa.RecordBatch.from_arrays(
                    [pc.take(batch.column("doc_id"), owner), pc.take(batch.column("tag"), owner), pa.array(anchor), pa.array(first), pa.array(last)],
                    names=["doc_id", "tag", "anchor", "first", "last"])


def cut_runs(data: np.ndarray, bounds: np.ndarray, size: int = STRETCH_BYTES) -> Iterator[tuple[np.ndarray, ...]]:
    """Anchor runs; a single text longer than ``size`` in stretches that share 199 bytes, so places fit their bits."""
    if len(bounds) > 2 or len(data) <= size:
        yield anchor_runs(data, bounds)
        return
    for at in range(0, len(data) - LENGTH + 1, size):
        part = data[at:at + size + LENGTH - 1]
        anchor, owner, first, last = anchor_runs(part, np.array([0, len(part)]))
        yield anchor, owner, first + at, last + at


def _stretches(ends: np.ndarray, size: int = STRETCH_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``size`` bytes; a longer text alone."""
    a = 0
    while a < len(ends) - 1:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + size, side="right")) - 1)
        yield a, b
        a = b


def _tuples(table: pa.Table, *names: str) -> list[tuple]:
    return list(zip(*(table.column(c).to_pylist() for c in names), strict=True))


_AROUND = pa.schema([
    ("share", pa.int32()), ("anchor", pa.int64()), ("context", pa.binary()), ("starts", pa.int32()),
    ("doc_ids", pa.list_(pa.int64())), ("tags", pa.list_(pa.int64())), ("firsts", pa.list_(pa.int64()))])
_SPANS = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("begin", pa.int64()), ("stop", pa.int64())])
_KEPT = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
    ("kept_text", pa.string())])


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.Table.from_arrays([pa.array(list(x), f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


def _contexts(docs: pa.Table, hits: pa.Table) -> Iterator[tuple[int, bytes, int, list[tuple]]]:
    """Anchor, text around it, its number of starts and all its places, of each different text around an anchor."""
    text_at = {key: x for key, x in zip(_tuples(docs, "doc_id", "tag"), docs.column("text"), strict=True)}
    copies: dict[tuple, int] = defaultdict(int)
    for key in _tuples(docs, "doc_id", "tag"):
        copies[key] += 1
    found: dict[tuple, set] = defaultdict(set)
    for doc_id, tag, anchor, first, last in _tuples(hits, "doc_id", "tag", "anchor", "first", "last"):
        text = text_at[doc_id, tag].as_buffer()
        found[anchor, bytes(text[first:last + LENGTH]), last - first + 1].add((doc_id, tag, first))
    for key, places in found.items():
        yield *key, [p for p in places for _ in range(min(2, copies[p[0], p[1]]))]  # equal rows repeat one another


def _around(shares: int):
    def cut(docs: pa.Table, hits: pa.Table) -> pa.Table:
        """Text around each anchor that occurs again, equal ones once with all their places."""
        rows = []
        for anchor, context, starts, listed in _contexts(docs, hits):
            rows.append((anchor % shares, anchor, context, starts, *([p[k] for p in listed] for k in range(3))))
        return _table(_AROUND, rows)

    return cut


def _digests(context: bytes, starts: int) -> bytes:
    """Digests of the strings at the first ``starts`` places, one after the other."""
    view = memoryview(context)
    return b"".join(hashlib.blake2b(view[at:at + LENGTH], digest_size=DIGEST).digest() for at in range(starts))


def _count_strings(docs: pa.Table, hits: pa.Table) -> pa.Table:
    """Each different string of a bucket's hot anchors, and how often it occurs there (2 for more)."""
    held = bytearray()
    for _, context, starts, listed in _contexts(docs, hits):
        held += _digests(context, starts) * min(2, len(listed))
    found, counts = np.unique(np.frombuffer(held, f"S{DIGEST}"), return_counts=True)
    offsets = pa.py_buffer(np.arange(0, DIGEST * len(found) + 1, DIGEST, dtype=np.int32))
    bucket = docs.column("bucket")[0].as_py() if len(docs) else 0
    return pa.table({
        "bucket": pa.array(np.full(len(found), bucket, np.int32)), "digest": pa.Array.from_buffers(pa.binary(), len(found), [None, offsets, pa.py_buffer(found.tobytes())]),
        "n": pa.array(np.minimum(counts, 2).astype(np.int64))})


def _hot_spans(docs: pa.Table, asked: pa.Table) -> pa.Table:
    """Spans of a bucket's strings around hot anchors whose digests are among the repeated ones that were sent."""
    sent = asked.filter(pc.is_valid(asked.column("digest"))).column("digest").to_pylist()
    repeated = np.sort(np.frombuffer(b"".join(sent), f"S{DIGEST}"))
    rows: list[tuple] = []
    if len(repeated):
        for _, context, starts, listed in _contexts(docs, asked.filter(pc.is_null(asked.column("digest")))):
            own = np.frombuffer(_digests(context, starts), f"S{DIGEST}")
            again = repeated[np.minimum(np.searchsorted(repeated, own), len(repeated) - 1)] == own
            for doc_id, tag, first in set(listed):
                rows += [(doc_id, tag, first + a, first + b - 1 + LENGTH) for a, b in _runs_of(again)]
    return _table(_SPANS, rows)


def _runs_of(flags: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of set flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _sort_group(table: pa.Table) -> pa.Table:
    """Spans of repeated strings of a task's texts, a stretch of anchors at a time."""
    order = np.argsort(np.asarray(table.column("anchor")))
    table = table.take(pa.array(order))
    anchors, contexts, starts = np.asarray(table.column("anchor")), table.column("context").to_pylist(), table.column("starts").to_pylist()
    where = _tuples(table, "doc_ids", "tags", "firsts")
    rows: list[tuple] = []
    a, size = 0, 0
    for b in range(len(contexts) + 1):
        if b == len(contexts) or (size > SORTED_BYTES and anchors[b] != anchors[b - 1]):
            _spans_of(anchors[a:b].tolist(), contexts[a:b], starts[a:b], where[a:b], rows)
            a, size = b, 0
        if b < len(contexts):
            size += len(contexts[b])
    return _table(_SPANS, rows)


def shared_starts(anchors: list[int], contexts: list[bytes], starts: list[int]) -> list[list[tuple[int, int]]]:
    """For each of different contexts the runs of starts (first, last) whose strings may stand in another one.

    Strings whose anchor is 40 k to 40 k + 39 bytes from their start all hold the 161 bytes
    that begin 40 k bytes before the anchor. Equal strings agree in them, so a run of starts
    whose 161 bytes no other context has at the same k cannot repeat.
    """
    sizes, n = np.array([len(x) for x in contexts]), np.array(starts)
    begins = np.cumsum(sizes) - sizes
    hashes = _Hashes(np.frombuffer(b"".join(contexts), np.uint8))
    # all starts up to the last one see the anchor, so it is the first place of its bytes from there on
    same = np.flatnonzero(hashes.everywhere(GRAM).view(np.int64) == np.repeat(np.array(anchors), sizes)[:-GRAM + 1])
    place = same[np.searchsorted(same, begins + n - 1)] - begins
    keys, owners, firsts, lasts = [], [], [], []
    for k in range((LENGTH - GRAM) // BLOCK_STARTS, -1, -1):  # early starts first
        first, last = np.maximum(0, place - BLOCK_STARTS * (k + 1) + 1), np.minimum(n - 1, place - BLOCK_STARTS * k)
        some = np.flatnonzero(first <= last)
        with np.errstate(over="ignore"):
            keys.append(hashes.at((begins + place - BLOCK_STARTS * k)[some], LENGTH - BLOCK_STARTS + 1) * np.uint64(8) + np.uint64(k))
        owners.append(some)
        firsts.append(first[some])
        lasts.append(last[some])
    _, which, counts = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    again = counts[which] > 1
    found: list[list[tuple[int, int]]] = [[] for _ in contexts]
    for owner, first, last in zip(*(np.concatenate(x)[again].tolist() for x in (owners, firsts, lasts)), strict=True):
        runs = found[owner]
        if runs and runs[-1][1] + 1 == first:
            runs[-1] = (runs[-1][0], last)
        else:
            runs.append((first, last))
    return found


def _spans_of(anchors: list[int], contexts: list[bytes], starts: list[int], where: list[tuple], rows: list[tuple]) -> None:
    distinct: dict[tuple[int, bytes, int], list[tuple]] = defaultdict(list)
    for anchor, context, n, places in zip(anchors, contexts, starts, where, strict=True):
        distinct[anchor, context, n].extend(zip(*places, strict=True))
    if not distinct:
        return
    keys = list(distinct)
    shared = shared_starts(*(list(x) for x in zip(*keys, strict=True)))
    pieces = [(i, a, b) for i, runs in enumerate(shared) for a, b in runs]
    found: dict[int, list[tuple[int, int]]] = defaultdict(list)
    if pieces:
        for (i, a, _), repeated in zip(pieces, repeated_starts([keys[i][1][a:b + LENGTH] for i, a, b in pieces], [b - a + 1 for _, a, b in pieces]), strict=True):
            found[i] += [(a + begin, a + end) for begin, end in _runs_of(repeated)]
    for i, ((_, _, n), places) in enumerate(distinct.items()):
        runs = [(0, n)] if len(places) > 1 else found[i]
        for doc_id, tag, first in set(places):
            rows += [(doc_id, tag, first + a, first + b - 1 + LENGTH) for a, b in runs]


def _remove(docs: pa.Table, spans: pa.Table) -> pa.Table:
    of: dict[tuple, list] = defaultdict(list)
    for doc_id, tag, begin, stop in _tuples(spans, "doc_id", "tag", "begin", "stop"):
        of[doc_id, tag].append((begin, stop))
    rows = []
    for (doc_id, tag), text in zip(_tuples(docs, "doc_id", "tag"), docs.column("text"), strict=True):
        raw = bytes(text.as_buffer())
        merged: list[list[int]] = []
        for begin, stop in sorted(of.get((doc_id, tag), ())):
            if merged and begin <= merged[-1][1]:
                merged[-1][1] = max(stop, merged[-1][1])
            else:
                merged.append([begin, stop])
        edges = [0, *(x for span in merged for x in span), len(raw)]
        left = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
        rows.append((doc_id, len(raw), len(raw) - len(left), len(merged), hashlib.sha256(left).hexdigest(), left.decode(errors="ignore")))
    kept = _table(_KEPT, rows)
    for name in docs.column_names:
        if name.startswith(_CARRIED):
            kept = kept.append_column(name, docs.column(name))
    return kept


def remove_repeats(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text, and the columns to carry along.

    A character of which only some bytes are kept is left out of ``kept_text``, not of
    the digest.
    """
    text = text_of()
    carried = {name: f"{_CARRIED}{i}" for i, name in enumerate(carry)}
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    whole = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"),
        *[F.col(name).alias(inner) for name, inner in carried.items()])
    total = plain.agg(F.sum(F.octet_length("text"))).first()[0]
    buckets = groups_for(total, BUCKET_BYTES)
    bucket = F.pmod(F.xxhash64("doc_id", "tag"), F.lit(buckets)).cast("int").alias("bucket")

    anchors = find_anchors(plain)
    again = keep(anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "again")
    is_hot = F.col("n") * (LENGTH + WINDOW // 2) > HOT_BYTES
    sums = again.agg(F.sum(F.when(~is_hot, F.col("n"))).alias("cold"), F.sum(F.when(is_hot, 1)).alias("hot")).first()
    shares = groups_for((sums.cold or 0) * (LENGTH + WINDOW // 2), GROUP_BYTES)
    hits = anchors.join(again.where(~is_hot).select("anchor"), "anchor", "left_semi")

    dealt = whole.withColumn("bucket", bucket)  # shuffled once, used by each cogroup
    around = dealt.groupBy("bucket").cogroup(hits.withColumn("bucket", bucket).groupBy("bucket")).applyInArrow(
        _around(shares), "share int, anchor long, context binary, starts int, doc_ids array<long>, tags array<long>, firsts array<long>")
    spans = around.groupBy("share").applyInArrow(_sort_group, "doc_id long, tag long, begin long, stop long")
    if sums.hot:
        hot_hits = anchors.join(again.where(is_hot).select("anchor"), "anchor", "left_semi").withColumn("bucket", bucket)
        strings = dealt.groupBy("bucket").cogroup(hot_hits.groupBy("bucket")).applyInArrow(_count_strings, "bucket int, digest binary, n long")
        # a digest has a row for each bucket at most, so a window over it needs one shuffle and holds few rows
        # (sums that are joined back shuffle all strings twice: 11.4 times the input on disk at 30 GB)
        repeated = strings.withColumn("total", F.sum("n").over(Window.partitionBy("digest"))).where("total > 1")
        asked = hot_hits.unionByName(repeated.select("bucket", "digest"), allowMissingColumns=True)
        spans = spans.unionByName(dealt.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(
            _hot_spans, "doc_id long, tag long, begin long, stop long"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    kinds = dict(docs.dtypes)
    removed = dealt.groupBy("bucket").cogroup(spans.withColumn("bucket", bucket).groupBy("bucket")).applyInArrow(
        _remove, ", ".join([schema, *(f"{inner} {kinds[name]}" for name, inner in carried.items())]))
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", *[
        F.col(inner).alias(name) for name, inner in carried.items() if name != "doc_id"])
