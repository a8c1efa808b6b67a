"""Near-duplicate documents by min-max hashing.

A document's set holds its distinct shingles of ``width`` words, lower-cased A to Z. Each of
``PERMUTATIONS`` hash functions gives two values of the signature, its least and its
greatest over the set, so 240 values cost 120 evaluations a shingle. Six values make a
band; documents that share a band are candidates. Two sets of likeness 0.8 share none
of the 40 bands once in about 200,000 times.

Documents of equal sets form a class first and only its least doc_id goes on. In each
band's bucket all members are compared on full sets with the bucket's least member
only. Members left outside that member's component are then compared with the members
of other components, except where the triangle inequality of the Jaccard distance
rules a link out. So a bucket of copies costs its size, not its square, and no
candidate pair of different components stays untested. Comparisons against one
document are split into blocks, so no task sees a whole group.

Nulls: a null text has no set and links with nothing, empty texts alike. A row without
doc_id takes the component of the documents with an equal set and is not kept there; if
there is none, its component is null and it is kept. With fewer words than a shingle, all
of them are the one shingle. Rows of one doc_id are one document: if their texts differ,
the set with the least digest stands for it, and all of its rows take that component.
Very long texts are shingled whole. An empty table gives no rows. Other columns are
ignored. ``one_of_each`` decides by row instead: repeated rows, rows without doc_id and
different texts of one doc_id are documents of their own, and one row of each group stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups_for, keep, small_batches, text_of

PERMUTATIONS = 120
WIDTH = 2  # words of a shingle
BAND_ROWS = 3  # hash functions of a band, two values each
PERCENT = 80
BLOCK = 4000  # comparisons against one document in one block
CELL = 1000  # members, and outsiders, of a bucket that meet in one cell
SETS = 2000  # sets that a task of the comparison holds at least
SENT_IDS = 500_000  # ids of documents to compare that are sent to all tasks; more meet the texts by a shuffle
SEED = 20_240_601
_CHUNK = 1 << 18
_ROW = "near_row"
_HELD = 4 << 20  # bytes of sets in an outgoing batch


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of all texts one after the other, and each text's number of words."""
    import xxhash

    whole = pc.take(texts.cast(pa.large_string()), pa.array(np.arange(len(texts))))  # not a slice: the lowering kernel misreads those
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(whole, "")))
    flat = lists.flatten()
    full = np.asarray(pc.greater(pc.binary_length(flat), 0))
    before = np.concatenate([[0], np.cumsum(full)])
    bounds = before[np.asarray(lists.offsets) - lists.offsets[0].as_py()]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    known = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_numpy(zero_copy_only=False)), np.uint64, len(coded.dictionary))
    return known[np.asarray(coded.indices)], np.diff(bounds)


def _runs(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words at each place."""
    n = max(0, len(words) - width + 1)
    if width == 1:
        return _mix(words)
    hashed = words[:n]
    with np.errstate(over="ignore"):
        for k in range(1, width):
            hashed = _mix(hashed * np.uint64(0x9E3779B97F4A7C15) + words[k:n + k])
    return hashed


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text one after the other, and the sets' sizes."""
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    sets = []
    runs = _runs(words, width)
    for count, end in zip(counts.tolist(), ends.tolist(), strict=True):
        if count < width:
            sets.append(_runs(words[end - count:end], count)[:1] if count else words[:0])
        else:
            found = np.sort(runs[end - count:end - width + 1])
            sets.append(found[np.concatenate([[True], found[1:] != found[:-1]])])
    return (np.concatenate(sets) if sets else words), np.fromiter(map(len, sets), np.int64, len(sets))


def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, PERMUTATIONS, np.uint64)


def band_keys(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A key for each band of each set that is not empty; both extremes of each hash function go in."""
    factors, offsets = _functions()
    starts = np.cumsum(sizes) - sizes
    bands = PERMUTATIONS // BAND_ROWS
    keys = np.empty((len(sizes), bands), np.int64)
    with np.errstate(over="ignore"):
        for a in _cuts(starts, sizes):
            part = flat[starts[a[0]]:starts[a[-1]] + sizes[a[-1]]]
            at = starts[a] - starts[a[0]]
            for band in range(bands):
                key = np.full(len(a), band, np.uint64)
                for j in range(band * BAND_ROWS, (band + 1) * BAND_ROWS):
                    hashed = ((part * factors[j] + offsets[j]) >> np.uint64(32)).astype(np.uint32)
                    for extreme in (np.minimum.reduceat(hashed, at), np.maximum.reduceat(hashed, at)):
                        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + extreme)
                keys[a, band] = key.view(np.int64)
    return keys


def _cuts(starts: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of sets of about a chunk of shingles, so the hashed values stay in the cache."""
    if len(sizes):
        which = (starts // _CHUNK)
        for part in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(which)) + 1):
            yield part


def signatures(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, set_digest (null without shingles) and the band keys."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 4 << 20):
            flat, sizes = shingle_sets(batch.column("text"), width)
            some = np.flatnonzero(sizes)
            keys = band_keys(flat, sizes[some])
            ends = np.cumsum(sizes)
            digests: list[bytes | None] = [None] * len(sizes)
            bands: list[np.ndarray | None] = [None] * len(sizes)
            for k, row in enumerate(some.tolist()):
                digests[row] = _digest(flat[ends[row] - sizes[row]:ends[row]].tobytes())
                bands[row] = keys[k]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "set_digest", "bands"])

    return keep(docs.mapInArrow(run, "doc_id long, n_shingles long, set_digest binary, bands array<long>"), "signatures")


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    others, blocks, docs, sets = zip(*rows, strict=True) if rows else ((),) * 4
    return pa.RecordBatch.from_arrays(
        [pa.array(others, pa.int64()), pa.array(blocks, pa.int32()), pa.array(docs, pa.int64()), pa.array(sets, pa.binary())],
        names=["other", "block", "doc", "shingles"])


def _texts_of(docs: DataFrame, needed: DataFrame, n: int) -> DataFrame:
    """doc_id, text and places of the ``n`` documents of ``needed``, and the digest of the set that stands for each."""
    if n <= SENT_IDS:  # a filter ahead of the join, so only texts to compare are shuffled
        docs = docs.join(F.broadcast(needed.select(F.col("doc").alias("wanted"))), F.col("doc_id") == F.col("wanted"), "left_semi")
    return docs.join(needed, docs.doc_id == needed.doc).select("doc_id", "text", "places", "digest")


def _digest(shingles: bytes) -> bytes:
    return hashlib.blake2b(shingles, digest_size=16).digest()


def compare(docs: DataFrame, pairs: DataFrame, reps: DataFrame, width: int = WIDTH) -> DataFrame:
    """Sizes of both sets and of their intersection for distinct pairs (one, other), on full sets.

    The sets against one ``other`` are dealt into blocks, to each of which the other's set is sent.
    """
    pairs = keep(pairs.distinct(), "pairs")
    per_other = pairs.groupBy("other").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    blocked = pairs.join(per_other, "other").select(
        F.col("one").alias("doc"), F.struct("other", F.pmod(F.xxhash64("one"), F.col("blocks")).cast("int").alias("block")).alias("place"))
    centres = per_other.select(F.col("other").alias("doc"), F.explode(F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.col("other"), i.alias("block")))).alias("place"))
    placed = blocked.unionByName(centres).groupBy("doc").agg(F.collect_set("place").alias("places"))
    needed = keep(placed.join(reps, F.col("doc") == F.col("rep_id")).drop("rep_id"), "needed")
    wanted = needed.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("places")).alias("places")).first()
    groups = groups_for(wanted.places, SETS)

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 4 << 20):
            flat, sizes = shingle_sets(batch.column("text"), width)
            ends = np.cumsum(sizes)
            rows: list[tuple] = []
            held = 0
            for doc, places, digest, size, end in zip(
                    *(batch.column(c).to_pylist() for c in ("doc_id", "places", "digest")), sizes.tolist(), ends.tolist(), strict=True):
                raw = flat[end - size:end].tobytes()
                for place in places if _digest(raw) == digest else ():  # not for another text of the same doc_id
                    rows.append((place["other"], place["block"], doc, raw))
                    held += len(raw)
                    if held > _HELD:
                        yield _sent(rows)
                        rows, held = [], 0
            yield _sent(rows)

    def meet(table: pa.Table) -> pa.Table:
        others, blocks, ids = (table.column(c).to_pylist() for c in ("other", "block", "doc"))
        found = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        centre = {(o, b): k for k, (o, b, d) in enumerate(zip(others, blocks, ids, strict=True)) if o == d}
        rows = []
        for k, (o, b, d) in enumerate(zip(others, blocks, ids, strict=True)):
            if o != d and (o, b) in centre:
                one, other = found[k], found[centre[o, b]]
                at = np.searchsorted(other, one)
                common = int((other[np.minimum(at, len(other) - 1)] == one).sum())
                rows.append((d, o, len(one), len(other), common))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("one", "other", "one_size", "other_size", "common"), columns, strict=True)})

    texts = _texts_of(docs, needed, wanted.n)
    dealt = texts.mapInArrow(sets, "other long, block int, doc long, shingles binary").withColumn(
        "share", F.pmod(F.xxhash64("other", "block"), F.lit(groups)))
    met = dealt.groupBy("share").applyInArrow(meet, "one long, other long, one_size long, other_size long, common long")
    return keep(met, "compared")


def components(links: DataFrame) -> DataFrame:
    """(node, component): least node that each linked node reaches. Alternating large and small stars, each round written out."""
    edges = keep(links.select(F.greatest("one", "other").alias("u"), F.least("one", "other").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        edges = keep(small.where("u <> v").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")


def _linked(compared: DataFrame, percent: int) -> DataFrame:
    return compared.where(100 * F.col("common") >= percent * (F.col("one_size") + F.col("other_size") - F.col("common"))).select("one", "other")


def _distance(common: str, one: str, other: str):
    return 1 - F.col(common) / (F.col(one) + F.col(other) - F.col(common))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    signed = signatures(texts, width)
    reps = keep(signed.where("doc_id is not null and set_digest is not null").groupBy(F.col("doc_id").alias("rep_id")).agg(F.min("set_digest").alias("digest")), "reps")
    classes = reps.groupBy("digest").agg(F.min("rep_id").alias("class_id"))
    chosen = signed.join(classes, (signed.set_digest == classes.digest) & (signed.doc_id == classes.class_id)).groupBy("class_id").agg(F.first("bands").alias("bands"))
    banded = chosen.select(F.col("class_id").alias("member"), F.explode("bands").alias("key"))  # the band is hashed into the key
    buckets = banded.groupBy("key").agg(F.min("member").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members = keep(banded.join(buckets, "key").where("member <> centre"), "members")

    compared = compare(texts, members.select(F.col("member").alias("one"), F.col("centre").alias("other")), reps, width)
    links = _linked(compared, percent)
    found = components(links)
    more = _links_across(texts, _still_open(members, compared, found, percent), reps, percent, width)
    if more is not None:
        found = components(links.unionByName(more))

    stands = signed.select("doc_id", "n_shingles", "set_digest").join(reps, F.col("doc_id") == F.col("rep_id"), "left")
    own = stands.withColumn("stands", F.coalesce("digest", "set_digest")).select("doc_id", "n_shingles", "stands").join(
        classes, F.col("stands") == classes.digest, "left")
    placed = own.join(found, own.class_id == found.node, "left")
    component = F.coalesce("component", "class_id", "doc_id")
    return placed.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """One row of each component, with all columns: that of the least doc_id, null ids last.

    Each row gets a number of its own first, written out with it, so that rows which
    share a doc_id, or have none, are told apart. Rows without shingles all stay.
    """
    columns = docs.columns
    numbered = keep(docs.withColumn(_ROW, F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(numbered.select(F.col(_ROW).alias("doc_id"), "text"), percent, width).select(
        F.col("doc_id").alias("of_row"), F.col("component_id").alias("part"))
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id").cast("long"), F.xxhash64(*columns), F.col(_ROW).alias("row"))
    ranked = keep(numbered.select(F.col(_ROW), rank.alias("rank")).join(found, F.col(_ROW) == F.col("of_row")).select("part", "rank"), "ranked")
    least = ranked.groupBy("part").agg(F.min("rank").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    dropped = ranked.join(least, "part").where("rank.row <> least.row").select(F.col("rank.row").alias("dropped"))
    return numbered.join(dropped, F.col(_ROW) == F.col("dropped"), "left_anti").select(*columns)


def _still_open(members: DataFrame, compared: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Members of buckets that hold more than one component, as far as a link between two may be untested.

    A member outside the component of its bucket's centre has to meet every member of
    another component whose distance to the centre differs by at most the linking
    distance; members that are too close to the centre for all of them are left out.
    """
    reach = 1 - percent / 100 + 1e-9
    distances = compared.select("one", "other", _distance("common", "one_size", "other_size").alias("distance"))
    component = lambda name: F.coalesce("component", name)
    placed = (
        members.join(distances, (members.member == distances.one) & (members.centre == distances.other)).drop("one", "other")
        .join(found, F.col("member") == found.node, "left").withColumn("of_member", component("member")).drop("node", "component")
        .join(found, F.col("centre") == found.node, "left").withColumn("of_centre", component("centre")).drop("node", "component")
    )
    placed = keep(placed.withColumn("outside", F.col("of_member") != F.col("of_centre")), "placed")
    opened = placed.where("outside").groupBy("key").agg(F.count(F.lit(1)).alias("outsiders"), F.min("distance").alias("nearest"))
    inside = placed.join(opened, "key").where(F.col("outside") | (F.col("distance") >= F.col("nearest") - reach))
    sizes = inside.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("of_member").alias("parts"))
    return inside.join(sizes, "key").where("parts > 1").select("key", "member", F.col("of_member").alias("part"), "outside", "outsiders", "n")


def _links_across(docs: DataFrame, open_members: DataFrame, reps: DataFrame, percent: int, width: int) -> DataFrame | None:
    """Links between members of different components, bucket by bucket; None if no bucket is open.

    A bucket's members are dealt into blocks, and its outsiders too; each pair of blocks
    is a cell, in which a task compares full sets and puts out nothing but links.
    """
    cells = lambda count, size: F.ceil(F.col(count) / size).cast("int")
    dealt = open_members.select("key", "member", "part", "outside", cells("n", CELL).alias("wide"), cells("outsiders", CELL).alias("high"))
    column, row = F.pmod(F.xxhash64("member"), F.col("wide")).cast("int"), F.pmod(F.xxhash64("member"), F.col("high")).cast("int")
    as_member = F.transform(F.sequence(F.lit(0), F.col("high") - 1), lambda r: F.struct("key", column.alias("column"), r.alias("row"), "part", F.lit(False).alias("asks")))
    as_outsider = F.transform(F.sequence(F.lit(0), F.col("wide") - 1), lambda c: F.struct("key", c.alias("column"), row.alias("row"), "part", F.lit(True).alias("asks")))
    places = F.when(F.col("outside"), F.concat(as_member, as_outsider)).otherwise(as_member)
    placed = dealt.groupBy(F.col("member").alias("doc")).agg(F.flatten(F.collect_list(places)).alias("places"))
    needed = keep(placed.join(reps, F.col("doc") == F.col("rep_id")).drop("rep_id"), "needed")
    wanted = needed.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("places")).alias("places")).first()
    if not wanted.n:
        return None
    groups = groups_for(wanted.places, SETS)

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 4 << 20):
            flat, sizes = shingle_sets(batch.column("text"), width)
            ends = np.cumsum(sizes)
            rows: list[tuple] = []
            held = 0
            for doc, places, digest, size, end in zip(
                    *(batch.column(c).to_pylist() for c in ("doc_id", "places", "digest")), sizes.tolist(), ends.tolist(), strict=True):
                raw = flat[end - size:end].tobytes()
                for place in places if _digest(raw) == digest else ():  # not for another text of the same doc_id
                    rows.append((*place.values(), doc, raw))
                    held += len(raw)
                    if held > _HELD:
                        yield _filled(rows)
                        rows, held = [], 0
            yield _filled(rows)

    def meet(table: pa.Table) -> pa.Table:
        cell_of = list(zip(*(table.column(c).to_pylist() for c in ("key", "column", "row")), strict=True))
        parts, asks, docs = (table.column(c).to_pylist() for c in ("part", "asks", "doc"))
        found = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        in_cell: dict[tuple, tuple[list[int], list[int]]] = {}
        for k, cell in enumerate(cell_of):
            in_cell.setdefault(cell, ([], []))[asks[k]].append(k)
        links = set()
        for held, asking in in_cell.values():
            if not held or not asking:
                continue
            owner = np.repeat(np.arange(len(held)), [len(found[k]) for k in held])
            flat = np.concatenate([found[k] for k in held])
            order = np.argsort(flat)
            flat, owner = flat[order], owner[order]
            sizes = np.array([len(found[k]) for k in held])
            for k in asking:
                low, high = np.searchsorted(flat, found[k]), np.searchsorted(flat, found[k], side="right")
                hits = owner[np.repeat(low - np.cumsum(high - low) + (high - low), high - low) + np.arange(int((high - low).sum()))]
                common = np.bincount(hits, minlength=len(held))
                for j in np.flatnonzero(100 * common >= percent * (sizes + len(found[k]) - common)).tolist():
                    if parts[held[j]] != parts[k]:
                        links.add((docs[k], docs[held[j]]))
        one, other = zip(*links, strict=True) if links else ((), ())
        return pa.table({"one": pa.array(one, pa.int64()), "other": pa.array(other, pa.int64())})

    sent = _texts_of(docs, needed, wanted.n).mapInArrow(sets, "key long, column int, row int, part long, asks boolean, doc long, shingles binary")
    cell = F.pmod(F.xxhash64("key", "column", "row"), F.lit(groups))
    return keep(sent.withColumn("share", cell).groupBy("share").applyInArrow(meet, "one long, other long"), "links")


def _filled(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.binary())
    columns = zip(*rows, strict=True) if rows else ((),) * len(kinds)
    return pa.RecordBatch.from_arrays(
        [pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], names=["key", "column", "row", "part", "asks", "doc", "shingles"])
