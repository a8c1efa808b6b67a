"""Whole tables and generated cases against plain Python."""

from __future__ import annotations

import itertools
import math
import random
import textwrap

import pyarrow as pa
import pytest
from test_brute_force import components_by_hand, frame

from spendframe.llm import near_dups, quotes, spots, toxicity

MESSAGES = "conv_id long, turn long, role string, text string"


def test_near_duplicates_of_a_whole_table(spark):
    """Every link of the table at 0.01, by comparing all sets."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dups.near_duplicates(docs).collect()}
    assert got == components_by_hand([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sum(not kept for _, _, kept in got.values()) > 50


def test_rows_without_ids_and_of_one_id(spark):
    words = [f"w{i}" for i in range(60)]
    text, near, far = " ".join(words), " ".join([*words[:-1], "x"]), " ".join(f"v{i}" for i in range(60))
    rows = [(1, text), (None, text), (None, near), (None, None), (None, ""), (2, near), (3, far), (3, "short one"), (4, far), (5, "short one"), (6, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dups.near_duplicates(frame(spark, rows)).collect()), key=str)
    # document 3 stands either for the far text or for the short one, and both of its rows go the same way
    stands = {c for d, _, c, _ in got if d == 3}
    assert len(stands) == 1 and sum(d == 3 and k for d, _, _, k in got) == 2
    assert [r for r in got if r[0] in (1, 2, 6)] == [(1, 59, 1, True), (2, 59, 1, False), (6, 0, 6, True)]
    assert sorted((n, str(c), k) for d, n, c, k in got if d is None) == [(0, "None", True), (0, "None", True), (59, "1", False), (59, "1", False)]
    joined = {d: c for d, _, c, _ in got if d in (4, 5)}
    assert joined in ({4: 3, 5: 5}, {4: 4, 5: 3})


def linked_by_hand(rows):
    """(conv, turn) to its thread, parent, depth and position, by nested loops over all messages."""
    units = {(conv, turn): quotes.parse(text or "")[1] for conv, turn, _, text in rows}
    written: dict[int, list] = {}
    for place, found in units.items():
        for level, unit, _ in found:
            if not level:
                written.setdefault(unit, []).append(place)
    parents = {}
    for (conv, turn), found in units.items():
        weights: dict[tuple, int] = {}
        for level, unit, words in found:
            places = written.get(unit, []) if level else []
            own = min((t for c, t in places if c == conv), default=None)
            first = min(places, default=None)
            original = (conv, own) if own is not None and own < turn else first if first and first[0] < conv and words >= quotes.MIN_WORDS else None
            if original:
                weights[level, original] = weights.get((level, original), 0) + words
        before = max((t for c, t in units if c == conv and t < turn), default=None)
        best = min(((level, -words, original) for (level, original), words in weights.items()), default=None)
        parents[conv, turn] = best[2] if best else (conv, before) if before is not None else None
    chains = {}
    for place in units:
        chain = [place]
        while parents[chain[-1]]:
            chain.append(parents[chain[-1]])
        chains[place] = chain
    out = {}
    for root, members in itertools.groupby(sorted(units, key=lambda p: (chains[p][-1], len(chains[p]), p[1], p[0])), key=lambda p: chains[p][-1]):
        for position, place in enumerate(members, 1):
            out[place] = (root, parents[place], len(chains[place]) - 1, position)
    return out


@pytest.mark.parametrize("small", [False, True])
def test_generated_quotations(spark, monkeypatch, small):
    """Messages that quote earlier ones, nested, re-wrapped and across conversations; also with small slices of threads."""
    if small:
        monkeypatch.setattr(quotes, "STRETCH", 2)
        monkeypatch.setattr(quotes, "CONVERSATIONS", 2)
    rng = random.Random(small + 3)
    rows: list[tuple] = []
    for conv in range(25):
        for turn in range(rng.randrange(1, 7)):
            parts = []
            for _ in range(rng.randrange(3)):
                if rows:
                    source = rng.choice(rows if rng.random() < 0.4 else rows[-4:])[3]
                    lines = source.splitlines()
                    if rng.random() < 0.5:
                        lines = [line for block in source.split("\n\n") for line in [*textwrap.wrap(" ".join(block.split("\n")), 25), ""]]
                    a = rng.randrange(len(lines) + 1)
                    parts.append("\n".join("> " + line for line in lines[a:]))
            own = ["".join(rng.choice(["alpha ", "beta ", "gamma ", "delta, ", "omega "]) for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(1, 3))]
            if conv == 0 and not turn:
                own = ["the first message of them all has many replies"]
            if conv and not turn and rng.random() < 0.7:
                parts = ["> the first message of them all has many replies"]
            rows.append((conv, turn * 3, "user", "\n".join([*parts, "\n\n".join(own)])))
    got = quotes.reply_ordered(spark.createDataFrame(rows, MESSAGES)).collect()
    found = {(r.conv_id, r.turn): ((r.thread_conv, r.thread_turn), (r.parent_conv, r.parent_turn) if r.parent_conv is not None else None, r.depth, r.position) for r in got}
    assert found == linked_by_hand(rows)
    assert sum(p is not None and p[0] != place[0] for place, (_, p, _, _) in found.items()) > 10


def test_awkward_messages(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (1, 1, "", ""), (None, None, None, None), (None, 3, "a", "> x"), (2, 7, "a", "word " * 30_000), (2, 8, "b", ">" * 50_000 + "deep")]
    table = spark.createDataFrame(rows, MESSAGES).selectExpr("*", "1 AS root", "2 AS depth", "3 AS position", "'x' AS units", "4 AS parent")
    got = sorted(((r.conv_id, r.turn, r.thread_conv, r.thread_turn, r.position, r.depth, len(r.text)) for r in quotes.reply_ordered(table).collect()), key=str)
    assert got == sorted([
        (1, 0, 1, 0, 1, 0, 0), (1, 0, 1, 0, 2, 0, 0), (1, 1, 1, 0, 3, 1, 0), (None, None, None, None, 1, 0, 0), (None, 3, None, 3, 1, 0, 0),
        (2, 7, 2, 7, 1, 0, 150_000), (2, 8, 2, 7, 2, 1, 0)], key=str)


def test_stretches_of_uneven_ids(spark, monkeypatch):
    """One id far away leaves the others dealt to many stretches, in order."""
    monkeypatch.setattr(spots, "BUCKET_ROWS", 20)
    rows = [(i, f"text {i}") for i in range(600)] + [(10**15, "far"), (-(10**12), "first"), (None, "none"), (None, "null")] + [(7, f"same {i}") for i in range(30)]
    docs = frame(spark, rows)
    dealt = docs.withColumn("stretch", spots._stretch(docs)).collect()
    sizes: dict[int, int] = {}
    for r in dealt:
        sizes[r.stretch] = sizes.get(r.stretch, 0) + 1
    assert len(sizes) > 20 and max(sizes.values()) < 90
    ordered = sorted((r.doc_id, r.stretch) for r in dealt if r.doc_id is not None)
    assert [s for _, s in ordered] == sorted(s for _, s in ordered) and {r.stretch for r in dealt if r.doc_id is None} == {-1}


def test_frequent_signatures_pair_few_sets(spark):
    """Signatures that all texts share stand last in the order, so pairs come from rarer ones; none is lost."""
    rng = random.Random(1)
    common = [f"every{i}" for i in range(60)]
    rows = []
    for g in range(30):
        own = [f"own{g}word{i}" for i in range(rng.randrange(5, 60))]
        rows += [(g * 3 + c, " the ".join(common + own[: len(own) - c * rng.randrange(4)])) for c in range(3)]
    printed = {r.doc_id: frozenset(r.spots) for r in spots.with_fingerprint(frame(spark, rows), "text", "spots").collect()}
    membership, pairs = spots.similar_pairs(frame(spark, rows), 0.8)
    classes = {r.class_id for r in membership.collect()}
    expected = {(a, b) for a, b in itertools.combinations(sorted(classes), 2) if len(printed[a] & printed[b]) >= 0.8 * len(printed[a] | printed[b])}
    assert {tuple(sorted((r.one, r.other))) for r in pairs.collect()} == expected and len(expected) > 10


def read_by_hand(model, text):
    """Scores of the clauses with the three machines side by side, each in a state of its own."""
    machines = [toxicity.negation(), toxicity._remembering(toxicity.REPORTED, toxicity.QUOTED, {}), toxicity._remembering(toxicity.TARGET, toxicity.TARGETED, {toxicity.THREAT: 0.5})]
    scores, total, states = [], 0.0, [0, 0, 0]
    for token in [*toxicity._TOKEN.findall(text.lower()), "."]:
        if token in ".!?;:\n":
            scores += [total] if total else []
            total, states = 0.0, [0, 0, 0]
            continue
        weight = max([model.words.get(token, 0.0), *(model.beginnings.get(token[:n], 0.0) for n in toxicity.PREFIXES)])
        symbol = toxicity.INSULT if weight else next((s for s, words in toxicity.CLASSES.items() if token in words.split()), toxicity.OTHER)
        factor = 1.0
        for k, machine in enumerate(machines):
            states[k], part = machine.step[states[k], symbol]
            factor *= part
        total += (weight if symbol == toxicity.INSULT else toxicity.THREAT_WEIGHT if symbol == toxicity.THREAT else 0.0) * factor
    return scores


def test_scores_by_hand(spark):
    """Composed machine, matching and logistic function against separate machines run word by word."""
    rng = random.Random(9)
    model = toxicity.Model({"idiot": 4.0, "trash": 3.5}, {"moro": 2.5, "scumb": 3.0}, (-3.0, 0.5, 0.4, 0.6))
    words = "idiot Trash moron scumbag kill hurt you they not never said nach dit the a quiet day été 12 x's".split()
    texts = [" ".join(rng.choice(words) + rng.choice(["", "", "", ".", "!", ";", "\n", ","]) for _ in range(rng.randrange(40))) for _ in range(400)] + [None, "", "...", "fine " * 40_000 + "idiot"]
    got = {r.doc_id: r.score for r in toxicity.score(frame(spark, list(enumerate(texts))), model).collect()}
    for n, text in enumerate(texts):
        clauses = read_by_hand(model, text or "")
        x = [0.0, 0.0, 0.0]
        if clauses:
            total, size = sum(clauses), len((text or "").split(" "))
            x = [max(clauses), math.log1p(total), math.log1p(100 * total / (size + toxicity.SHORT))]
        value = model.weights[0] + sum(w * v for w, v in zip(model.weights[1:], x, strict=True))
        assert got[n] == pytest.approx(1 / (1 + math.exp(-max(-30.0, min(30.0, value)))))
    assert any(read_by_hand(model, t or "") for t in texts) and model.features(pa.array([], pa.string())).shape == (0, 3)


def test_copies_count_once_on_both_sides(spark):
    """A clean text with an insult that stands there a hundred times is one wording against it; so is a toxic one for it."""
    toxic = [(f"{' '.join(f'{w}{k}' for k in range(6))} blockhead {w}", 1) for w in "red blue green black white brown".split()]
    clean = [("a quiet blockhead walks home through the long evening rain", 0)] * 100 + [(f"plain words of a clean text {i} and more of them", 0) for i in range(40)]
    copied = [("there is one sentence with numbskull in it that everybody repeats", 1)] * 50
    arcs = toxicity.learn_arcs(spark.createDataFrame(toxic + clean + copied, "text string, toxic int"))
    assert "blockhead$" in arcs and "numbskull$" not in arcs


def test_awkward_values(spark):
    """Nulls, empty and very long texts, ties and repeated rows: the values, not only the number of rows."""
    from collections import Counter

    from test_brute_force import removed_by_hand, whole_ids
    from test_contract import AWKWARD, COLUMNS

    from spendframe.llm import byte_ids, host_rules, lm_score, mixing, packing, repeats

    docs = spark.createDataFrame(AWKWARD, COLUMNS).selectExpr("*", "1 AS size", "'x' AS bucket", "2 AS anchor", "true AS kept", "3 AS place")
    texts = [(r[0], r[1] or "") for r in AWKWARD]
    ids = Counter((d, len(whole_ids("byte_bpe_50k.json", t)) + 1) for d, t in texts)
    assert Counter((r.doc_id, r.n_tokens) for r in byte_ids.round_trip(docs, "byte_bpe_50k.json", end_id=2).collect()) == ids
    lengths: Counter = Counter()
    for r in packing.pack(docs, "word_bpe_49k.json", end_id=2).collect():
        lengths[r.doc_id] += r.length
    wanted: Counter = Counter()
    for d, t in texts:
        wanted[d] += len(whole_ids("word_bpe_49k.json", t)) + 1
    assert lengths == wanted
    found = repeats.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted((tuple(r) for r in found), key=str) == removed_by_hand(texts)
    words = Counter((d, len(t.encode().split())) for d, t in texts)
    assert Counter((r.doc_id, r.n_words) for r in host_rules.apply_rules(docs).collect()) == words
    assert Counter((r.doc_id, r.size) for r in mixing.mix(docs).collect()) == words
    labels = spark.createDataFrame([(1, 1), (4, 0), (6, 1)], "doc_id long, quality int")
    assert Counter((r.doc_id, r.n_words) for r in lm_score.cross_entropy_difference(docs, labels).collect()) == words
    assert Counter((r.doc_id, r.n_chars) for r in spots.edited_likeness(docs).collect()) == Counter((d, len(t)) for d, t in texts)
    near = {r.doc_id: (r.component_id, r.kept) for r in near_dups.near_duplicates(docs).collect()}
    assert near[6] == (6, True) and near[7] == (6, False) and near[1] == (1, True) and near[None] == (None, True)
    assert {r.predicted for r in toxicity.score(docs, toxicity.Model()).collect()} == {0}
