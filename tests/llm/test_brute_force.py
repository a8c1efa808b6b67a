"""Operators that SQL cannot express, against plain Python on small tables."""

from __future__ import annotations

import hashlib
import heapq
import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from spendframe.llm import byte_ids, lm_score, near_dups, packing, quotes, repeats, spots, tokens, toxicity

TOKENIZERS = ["byte_bpe_50k.json", "word_bpe_49k.json"]


@pytest.fixture(scope="module")
def sample(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(120).collect()
    return [tuple(r) for r in rows]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def whole_ids(name, text):
    return tokens.encoder(name).tokenizer.encode(text or "", add_special_tokens=False).ids


# ---- token ids


@pytest.mark.parametrize("name", TOKENIZERS)
def test_pieces_encode_like_whole_texts(name):
    random.seed(7)
    bits = ["a", "B", "é", " ", "  ", "\n", "\t", ",", ".", "'s", "'", "1", "23", "ß", "😀", "́", "\x1c", "\x85", " x", "the ", "<|endoftext|>", "\r\n", "中"]
    texts = ["".join(random.choices(bits, k=random.randint(0, 12))) for _ in range(4000)] + [None, "", " ", "word " * 50]
    ids, counts = tokens.PieceEncoder(tokens.tokenizer_path(name), kept=500).encode(pa.array(texts))
    ends = np.cumsum(counts)
    for text, n, end in zip(texts, counts, ends, strict=True):
        assert ids[end - n:end].tolist() == whole_ids(name, text), repr(text)


@pytest.mark.parametrize("name", TOKENIZERS)
def test_added_tokens_in_texts(name):
    """Against a tokenizer of its own: strings of added tokens give the special ids."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.tokenizer_path(name))
    random.seed(8)
    bits = ["a", " ", "the ", "\n", "  ", "é", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", "<|", "12", "\u0338"]
    texts = ["".join(random.choices(bits, k=random.randint(0, 10))) for _ in range(3000)] + [None, "", "<|endoftext|>", "plain words"]
    ids, counts = tokens.PieceEncoder(tokens.tokenizer_path(name), kept=500).encode(pa.chunked_array([texts[:7], texts]).combine_chunks().slice(7))
    special = 0
    for text, n, end in zip(texts, counts, np.cumsum(counts), strict=True):
        expected = plain.encode(text or "", add_special_tokens=False).ids
        assert ids[end - n:end].tolist() == expected, repr(text)
        special += bool({x for x in plain.get_added_tokens_decoder()} & set(expected))
    assert special > 500 and len(ids) == counts.sum()


class CountingTokenizer:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode(self, text, **options):
        self.texts += 1
        return self.tokenizer.encode(text, **options)

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


@pytest.mark.parametrize("name", TOKENIZERS)
def test_distinct_parts_go_to_the_library_together(name):
    # words with marks and digits, words at a text's or a line's beginning, and characters that may count as white space
    odd = ["it's", "'s", "x\u00a0y", "\u00a0", "\u0085", "\u200b", "\x1c", "\u2028z", "\ufeff", "\x00", "e\u0301", "日本", "😀", "a\tb", "1.5e3", "..."]
    plain = [f"open{i}$ {i}*** 'm{i} ({i * 7}) end." for i in range(2000)]
    texts = plain + [f"fed{i}& {odd[i % 16]} x{i}&\nfed{i}& {odd[i % 7]}\n{odd[i % 16]} plain\nend." for i in range(500)]
    coder = tokens.PieceEncoder(tokens.tokenizer_path(name))
    coder.tokenizer = CountingTokenizer(coder.tokenizer)
    coder.encode(pa.array(plain))
    if not coder.by_end:
        assert len(coder.place) > 9000 > 9 * coder.tokenizer.texts
    ids, counts = coder.encode(pa.array(texts))
    for text, n, end in zip(texts, counts, np.cumsum(counts), strict=True):
        assert ids[end - n:end].tolist() == whole_ids(name, text), repr(text)


@pytest.mark.parametrize("kind", ["<u2", "<u4"])
def test_ids_of_rows_are_read_in_place(kind):
    rows = [np.arange(n, dtype=kind).tobytes() for n in (3, 0, 5, 1, 0)]
    column = pa.array([b"\x07\x07\x07\x07", *rows], pa.binary()).slice(1)
    for part, lengths in ((column, [3, 0, 5, 1, 0]), (column.slice(2, 2), [5, 1]), (column.slice(4), [0]), (column.slice(5), [])):
        ids, counts = byte_ids._joined(part, kind)
        assert counts.tolist() == lengths and ids.tolist() == [i for n in lengths for i in range(n)]


@pytest.mark.parametrize("bits", [1, 2])
def test_coded_ranks_round_trip(bits):
    rng = np.random.default_rng(1)
    top = 1 << (16 if bits == 1 else 32)
    for n in (0, 1, 7, 8, 9, 5000):
        ranks = (rng.random(n) ** 8 * (top - 1)).astype(np.uint32)
        raw = byte_ids.encode_file([5, None], np.array([n, 0]), ranks, bits)
        doc_ids, counts, ids = byte_ids.decode_file(raw, np.arange(1 << 16, dtype=np.uint32)) if bits == 1 else (
            [5, None], np.array([n, 0]), byte_ids.decode_ranks(np.frombuffer(byte_ids.encode_ranks(ranks, 2)[0], np.uint8), np.frombuffer(byte_ids.encode_ranks(ranks, 2)[1], np.uint8), n, 2))
        assert doc_ids == [5, None] and counts.tolist() == [n, 0] and ids.tolist() == ranks.tolist()


def test_byte_id_files(spark, sample):
    rows = [*sample, (100_000, None), (100_001, ""), (-5, "first of all"), (None, "no id")]
    got = [tuple(r) for r in byte_ids.round_trip(frame(spark, rows), TOKENIZERS[0]).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    expected, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*whole_ids(TOKENIZERS[0], text), 2]
        expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == expected


# ---- packing


def test_packing_keeps_every_id_once(spark, sample):
    rows = [*sample, (100_000, None), (100_001, ""), (100_002, "word " * 9000), (None, "no id")]
    pieces = packing.pack(frame(spark, rows), TOKENIZERS[1], group_bytes=100_000).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
        assert zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length
    for doc_id, text in rows:
        ids = np.array([*whole_ids(TOKENIZERS[1], text), 2], "<u4")
        own = sorted(by_doc[doc_id], key=lambda p: p.start)
        assert b"".join(p.ids for p in own) == ids.tobytes()
        assert [p.start for p in own] == np.cumsum([0, *(p.length for p in own)])[:-1].tolist()
        assert {p.doc_tokens for p in own} == {len(ids)}
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0, *(p.length for p in own)])[:-1].tolist()
        length = sum(p.length for p in own)
        assert length == 4096 or length & (length - 1) == 0 and length < 4096
        assert own[0].sequence_cost == pytest.approx(sum(p.length + p.length ** 2 / 4096 for p in own))


def test_packing_takes_the_cheapest_sequence_with_room():
    random.seed(3)
    lengths = sorted((random.randint(1, 60) for _ in range(80)), reverse=True)
    room = packing.capacities_for(sum(lengths), 64)
    places, costs = packing.assign(lengths, room, 1.0, 0.1)
    left, cost, expected = list(room), [0.0] * len(room), [[] for _ in room]
    for piece, length in enumerate(lengths):
        start = 0
        while start < length:
            i = min((k for k in range(len(room)) if left[k]), key=lambda k: (cost[k], k))
            take = min(left[i], length - start)
            expected[i].append((piece, start, take))
            left[i], start, cost[i] = left[i] - take, start + take, cost[i] + take + 0.1 * take * take
    assert places == expected and costs == pytest.approx(cost) and not any(left)
    assert heapq.nsmallest(1, lengths) == [lengths[-1]]


# ---- repeated strings


def removed_by_hand(rows):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(r[k:k + 200] for _, r in raw for k in range(len(r) - 199))
    out = []
    for doc_id, r in raw:
        gone = bytearray(len(r))
        for k in range(len(r) - 199):
            if seen[r[k:k + 200]] > 1:
                gone[k:k + 200] = b"\1" * 200
        kept = bytes(b for b, x in zip(r, gone, strict=True) if not x)
        spans = sum(1 for k in range(len(r)) if gone[k] and (not k or not gone[k - 1]))
        out.append((doc_id, len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_repeated_strings(spark, sample):
    random.seed(1)
    passages = [" ".join(random.choice(["ab", "é", "xyz", "the"]) for _ in range(100)) for _ in range(5)]
    rows = sample[:50] + [
        (5000 + i, f"x{i} " * random.randint(0, 60) + random.choice(passages)[:random.randint(150, 400)] + f" y{i}" * random.randint(0, 60)) for i in range(40)]
    rows += [(None, passages[0]), (None, passages[1]), (7000, None), (7001, ""), (7002, "z" * 199), (7003, "z" * 150), (7004, "q" * 201),
             (7005, "dup" * 100), (7005, "dup" * 100), (7006, "ab" * 500)]
    got = repeats.remove_repeats(frame(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == removed_by_hand(rows)


@pytest.mark.parametrize("most", [0, 3000])
def test_hot_anchors_are_split(spark, sample, monkeypatch, most):
    """Strings around anchors of many texts go by digest; no anchor keeps more than ``most`` bytes for one task."""
    monkeypatch.setattr(repeats, "HOT_BYTES", most, raising=False)
    seen = []
    around = repeats._around
    monkeypatch.setattr(repeats, "_around", lambda shares: seen.append(shares) or around(shares))
    random.seed(5)
    passage = " ".join(random.choice(["ab", "é", "xyz", "the"]) for _ in range(150))
    rows = sample[:20] + [(5000 + i, f"x{i} " * random.randint(0, 60) + passage + f" y{i}" * random.randint(0, 60)) for i in range(60)]
    rows += [(None, passage), (None, passage), (7005, "dup" * 100), (7005, "dup" * 100), (7006, "ab" * 500), (7007, passage[:199])]
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 9000)
    monkeypatch.setattr(repeats, "GROUP_BYTES", 1000)
    got = repeats.remove_repeats(frame(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == removed_by_hand(rows)
    data = [np.frombuffer((t or "").encode(), np.uint8) for _, t in rows]
    anchors = Counter(a for x in data for a in repeats.anchor_runs(x, np.array([0, len(x)]))[0].tolist())
    cold = sum(n for n in anchors.values() if n > 1 and n * 280 <= most)
    assert max(anchors.values()) * 280 > 3000 and seen == [max(1, -(-cold * 280 // repeats.GROUP_BYTES))]


def test_long_texts_are_cut():
    """A long text's strings keep their anchors, each start once, when it is cut."""
    data = np.frombuffer(bytes(random.Random(6).choices(b"abc ", k=5000)), np.uint8)
    whole = repeats.anchor_runs(data, np.array([0, len(data)]))
    listed = lambda runs: [(s, a) for anchor, _, first, last in runs for a, f, l in zip(anchor.tolist(), first.tolist(), last.tolist(), strict=True) for s in range(f, l + 1)]  # noqa: E731, E741
    assert listed(repeats.cut_runs(data, np.array([0, len(data)]), 700)) == listed([whole])
    assert listed(repeats.cut_runs(data, np.array([0, len(data)]), 4801)) == listed([whole])


def most_held(work):
    """What the work returns, and the most megabytes that it held at a time."""
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_repeats_hold_little_at_a_time():
    """Neither the search for anchors nor the order of suffixes grows with the texts of a batch or a group."""
    rng = np.random.default_rng(7)
    letters = lambda n: bytes(rng.integers(97, 123, n, np.uint8)).decode()
    texts = []
    for _ in range(1500):  # 300 bytes shared by two texts
        shared = letters(300)
        texts += [letters(150) + shared + letters(150), letters(150) + shared + letters(150)]
    ids = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], names=["doc_id", "tag", "text"])
    runs, held = most_held(lambda: pa.Table.from_batches(repeats.anchor_rows([batch])))
    assert held < 40  # 88 with all texts at once
    single = [repeats.anchor_runs(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)])) for t in texts]
    assert list(zip(*(runs.column(c).to_pylist() for c in ("doc_id", "anchor", "first", "last")), strict=True)) == [
        (i, *x) for i, (anchor, _, first, last) in enumerate(single) for x in zip(anchor.tolist(), first.tolist(), last.tolist(), strict=True)]

    seen = Counter(runs.column("anchor").to_pylist())
    again = runs.filter(pa.array([seen[a] > 1 for a in runs.column("anchor").to_pylist()]))
    spans, held = most_held(lambda around=repeats._around(1)(pa.Table.from_batches([batch]), again): repeats._sort_group(around))
    assert held < 80  # 142 with all texts at once
    found = {i: set() for i in range(len(texts))}
    for i, begin, stop in zip(*(spans.column(c).to_pylist() for c in ("doc_id", "begin", "stop")), strict=True):
        found[i] |= set(range(begin, stop))
    assert all(set(range(150, 450)) <= x and len(x) < 310 for x in found.values())


@pytest.mark.parametrize("seed", range(6))
def test_suffix_order_finds_all_repeats(seed):
    random.seed(seed)
    letters = random.choice([b"a", b"ab", b"abcdefgh \n", bytes(range(256))])
    parts = [bytes(random.choices(letters, k=random.choice([150, 201, 260, 400]))) for _ in range(4)]
    texts = []
    for _ in range(20):
        text = b""
        while len(text) < 200 or random.random() < 0.5:
            text += random.choice(parts)[random.randint(0, 40):] if random.random() < 0.6 else bytes(random.choices(letters, k=random.randint(1, 80)))
        texts.append(text)
    starts = [len(t) - 199 for t in texts]
    seen = Counter(t[i:i + 200] for t, n in zip(texts, starts, strict=True) for i in range(n))
    found = repeats.repeated_starts(texts, starts)
    assert [x.tolist() for x in found] == [[seen[t[i:i + 200]] > 1 for i in range(n)] for t, n in zip(texts, starts, strict=True)]


# ---- near duplicates


def components_by_hand(rows, width=2):
    sets = {}
    for doc_id, text in rows:
        words = (text or "").encode().lower().split()
        sets[doc_id] = frozenset(zip(*(words[k:] for k in range(width)), strict=False)) if len(words) >= width else frozenset([tuple(words)] if words else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= 80 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y) and find(a) != find(b):
                one, other = sorted((find(a), find(b)))
                parent[other] = one
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("small", [False, True])
def test_near_duplicates(spark, sample, monkeypatch, small):
    """Also with blocks and cells of a few documents and without sent ids."""
    if small:
        for name, value in (("CELL", 3), ("BLOCK", 4), ("SENT_IDS", 0), ("SETS", 50)):
            monkeypatch.setattr(near_dups, name, value)
    random.seed(4)
    rows, n, vocabulary = list(sample), 10_000, [f"w{i}" for i in range(400)]
    for _ in range(10):
        base = random.choices(vocabulary, k=random.choice([1, 2, 3, 8, 20, 40, 60]))
        for _ in range(random.choice([1, 3, 30])):
            words = list(base)
            for _ in range(random.randint(0, max(1, len(words) // 8))):
                words[random.randrange(len(words))] = random.choice(vocabulary)
            rows.append((n, random.choice([" ", "\n", "  "]).join(words).upper()))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "One"), (n + 4, "one"), (n + 5, "É"), (n + 6, "é")]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dups.near_duplicates(frame(spark, rows)).collect()}
    assert got == components_by_hand(rows)


def test_chain_of_links_across_one_bucket_is_whole():
    """Extremes of equal sets agree, and a band's key depends on both extremes."""
    flat = np.sort(np.random.default_rng(2).integers(0, 1 << 63, 50, np.uint64))
    keys = near_dups.band_keys(np.concatenate([flat, flat, flat[:40]]), np.array([50, 50, 40]))
    assert (keys[0] == keys[1]).all() and (keys[0] == keys[2]).any() and keys.shape == (3, 40)


def test_slices_of_columns():
    texts = pa.array(["Some Words here"] * 3 + ["É and E", None, "  two  words\u00a0 "] * 200)
    flat, sizes = near_dups.shingle_sets(texts)
    words, counts = near_dups.word_hashes(texts.slice(3))
    part, part_sizes = near_dups.shingle_sets(texts.slice(3))
    assert part_sizes.tolist() == sizes[3:].tolist() and part.tolist() == flat[sizes[:3].sum():].tolist()
    assert counts.tolist() == [3, 0, 2] * 200 and len(words) == 1000
    sized = texts.cast(pa.large_string())
    ids, n = tokens.encoder(TOKENIZERS[1]).encode(sized.slice(3))
    whole, m = tokens.encoder(TOKENIZERS[1]).encode(sized)
    assert ids.tolist() == whole[m[:3].sum():].tolist() and n.tolist() == m[3:].tolist()


# ---- language models


def test_cross_entropy_difference(spark, sample, monkeypatch):
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 60_000)
    monkeypatch.setattr(lm_score, "PART_BYTES", 90_000)
    rows = [*sample, (None, "the of the"), (9000, None), (9001, " ")]
    good = {i for i, _ in sample if i % 3 == 0}
    labels = spark.createDataFrame([(i, int(i in good)) for i, _ in sample] + [(None, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in lm_score.cross_entropy_difference(frame(spark, rows), labels).collect()}
    words = {i: (t or "").encode().lower().split() for i, t in rows}
    single, pairs, opened, total = ([Counter(), Counter()] for _ in range(4))
    for i, w in words.items():
        k = i not in good
        single[k].update(w)
        pairs[k].update(zip(["", *w], w, strict=False))
        opened[k][""] += bool(w)
        total[k][""] += len(w)
    n = [total[0][""], total[1][""]]
    for i, w in words.items():
        if not w:
            assert (got[i].n_words, got[i].target_loss, got[i].score) == (0, None, 0.0)
            continue
        own, own_pairs, losses = Counter(w), Counter(zip(["", *w], w, strict=False)), [0.0, 0.0]
        for before, word in zip(["", *w], w, strict=False):
            q = (single[0][word] + single[1][word]) / sum(n)
            for m, factor in ((0, 1.0), (1, n[0] / n[1])):
                mine = (i not in good) == bool(m)
                u = (factor * (single[m][word] - mine * own[word]) + 1000 * q) / (factor * (n[m] - mine * len(w)) + 1000)
                context = opened[m][""] - mine if before == "" else single[m][before] - mine * own[before]
                p = (factor * (pairs[m][before, word] - mine * own_pairs[before, word]) + 16 * u) / (factor * context + 16)
                losses[m] -= math.log(p) / len(w)
        assert (got[i].target_loss, got[i].background_loss) == pytest.approx(losses)
        assert got[i].score == pytest.approx(losses[1] - losses[0])


# ---- spot signatures


def test_spot_signatures(spark, sample):
    rows = sorted([*sample, (100_000, ""), (100_001, None), (100_002, "the end of a story"), (100_003, "the end of a story")])
    got = {r.doc_id: r for r in spots.edited_likeness(frame(spark, rows)).collect()}
    sets = {i: set(filter(None, r.fingerprint.split(","))) for i, r in got.items()}
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for n, (doc_id, text) in enumerate(rows):
        following, text = rows[(n + 1) % len(rows)], text or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + (following[1] or "")[:half]
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_next == pytest.approx(jaccard(sets[doc_id], sets[following[0]]))
        assert r.near_edited == pytest.approx(jaccard(sets[doc_id], set(filter(None, r.edited_fingerprint.split(",")))))
    assert got[100_002].fingerprint == got[100_003].fingerprint != "" and got[100_001].fingerprint == ""


def test_order_across_stretches(spark, monkeypatch):
    monkeypatch.setattr(spots, "BUCKET_ROWS", 3)
    rows = [(i * i - 50, f"word{i} and other{i}") for i in range(40)] + [(None, "no id")]
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    got = {r.doc_id: r for r in spots.edited_likeness(frame(spark, rows)).collect()}
    for n, (doc_id, text) in enumerate(ordered):
        half = len(text) // 2
        edited = text[:len(text) - half] + ordered[(n + 1) % len(ordered)][1][:half]
        assert got[doc_id].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()


def test_similar_fingerprints(spark):
    random.seed(2)
    words = [f"word{i}" for i in range(300)]
    rows = []
    for g in range(8):
        base = random.choices(words, k=120)
        for c in range(4):
            text = list(base)
            text[5 + c * 7] = f"changed{g}{c}" if c else text[5]
            rows.append((10 * g + c, " the ".join(text)))
    rows.append((500, rows[0][1]))
    membership, pairs = spots.similar_pairs(frame(spark, rows), 0.8)
    printed = {r.doc_id: set(r.spots) for r in spots.with_fingerprint(frame(spark, rows), "text", "spots").collect()}
    assert {r.doc_id: r.class_id for r in membership.collect()} == {i: min(j for j, s in printed.items() if s == own) for i, own in printed.items()}
    classes = {r.class_id for r in membership.collect()}
    expected = {tuple(sorted((a, b))) for a in classes for b in classes if a < b and len(printed[a] & printed[b]) >= 0.8 * len(printed[a] | printed[b])}
    assert {tuple(sorted((r.one, r.other))) for r in pairs.collect()} == expected and expected


# ---- quotations


def test_quotations(spark):
    rows = [
        (1, 0, "user", "Hello there my good friend\nHow is the weather today"),
        (1, 1, "assistant", "On Mon, Ann wrote:\n> How is the weather today\n\nIt is fine and sunny outside."),
        (1, 2, "user", "> Hello there my good friend\nHi!"),
        (1, 3, "user", ">> How is the weather  TODAY?\n> It is fine and sunny outside.\nGreat."),
        (2, 0, "user", "> It is fine and sunny outside.\nCross"), (2, 1, "user", None), (None, 1, "user", "x"), (3, None, "a", "y"),
        (3, 5, "a", ""), (3, 5, "a", "z"), (3, 700, "a", "> unknown words here are not found\nq")]
    got = quotes.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    found = {(r.conv_id, r.turn, r.text): (r.thread_conv, r.thread_turn, r.position, r.parent_conv, r.parent_turn, r.depth) for r in got}
    assert found == {
        (1, 0, "Hello there my good friend\nHow is the weather today"): (1, 0, 1, None, None, 0),
        (1, 1, "It is fine and sunny outside."): (1, 0, 2, 1, 0, 1), (1, 2, "Hi!"): (1, 0, 3, 1, 0, 1),
        (2, 0, "Cross"): (1, 0, 4, 1, 1, 2), (1, 3, "Great."): (1, 0, 5, 1, 1, 2), (2, 1, ""): (1, 0, 6, 2, 0, 3),
        (None, 1, "x"): (None, 1, 1, None, None, 0), (3, None, "y"): (3, None, 1, None, None, 0),
        (3, 5, ""): (3, 5, 1, None, None, 0), (3, 5, "z"): (3, 5, 2, None, None, 0), (3, 700, "q"): (3, 5, 3, 3, 5, 1)}


def test_rewrapped_quotes_of_paragraphs(spark):
    """Quotes whose lines break elsewhere meet their paragraphs, or the whole message."""
    first = "One two three four\nfive six seven\n\neight nine ten\neleven twelve"
    rows = [
        (1, 0, "user", first), (1, 1, "assistant", "Something else entirely"), (1, 2, "user", "Not this either"),
        (1, 3, "user", "> One two three\n> four five six seven\n>\n> eight\n> nine ten eleven twelve\nBoth"),
        (1, 4, "user", "> One two\n> three four five six seven\n> \n> words of nobody\nFirst"),
        (1, 5, "user", "> One two\n> three four five six seven eight nine\n> ten eleven twelve\nJoined"),
        (1, 6, "user", ">> eight\n>> nine ten eleven twelve\n>>\n>> words of nobody\n> \nNested")]
    got = quotes.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r.turn: (r.parent_turn, r.depth) for r in got} == {0: (None, 0), 1: (0, 1), 2: (1, 2), 3: (0, 1), 4: (0, 1), 5: (0, 1), 6: (0, 1)}
    assert {r.turn: r.text for r in got if r.turn in (0, 3, 4, 5, 6)} == {0: first, 3: "Both", 4: "First", 5: "Joined", 6: "Nested"}


def test_unquoted_conversations_follow_their_turns(spark):
    messages = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    got = quotes.reply_ordered(messages).collect()
    expected = {}
    for r in messages.collect():
        expected.setdefault(r.conv_id, []).append(r.turn)
    assert len(got) == messages.count()
    for r in got:
        turns = sorted(expected[r.conv_id])
        assert (r.thread_conv, r.thread_turn) == (r.conv_id, turns[0]) and turns[r.position - 1] == r.turn


# ---- toxicity


def test_transducers_compose():
    model = toxicity.Model()
    score = lambda text: model.clauses(text)
    plain, aimed = score("what an idiot")[0], score("you are an idiot")[0]
    assert aimed == plain * toxicity.TARGETED
    assert score("not an idiot")[0] == plain * toxicity.NEGATED
    assert score("they said an idiot came")[0] == plain * toxicity.QUOTED * toxicity.TARGETED
    assert score("not very much of an idiot")[0] == plain  # out of the negation's reach
    assert score("fine. an idiot! no more") == [plain]
    assert score("i will kill you")[0] < score("you i will kill")[0] and score("a fine day") == []


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.train(docs, labels.where(~toxicity.held_out()))
    scored = toxicity.score(docs, model).join(labels, "doc_id").where(toxicity.held_out()).collect()
    right = sum(r.predicted == r.toxic for r in scored)
    assert right >= 0.95 * len(scored) and not any(r.predicted for r in scored if not r.toxic)
