"""Conversation repair, URL verdicts and phrases against brute force and on awkward input."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from spendframe.llm import conversation_repair as repair
from spendframe.llm import phrases, queries, url_filter

CONVERSATIONS = "conv_id long, turn long, role string, text string"


def every_edit(rows, limit=3):
    """Cheapest (cost, edits, repaired rows) over all edit lists; ``rows`` are (role, text, fault)."""
    best = None

    def go(at, state, cost, audit, out):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if at == len(rows) and state in "0a":
            best = min(best or (10**9,), (cost, audit, out))
        role_of = {"0": "user", "s": "user", "a": "user", "u": "assistant"}[state]
        if len(audit) - at < limit:
            go(at, role_of[0], cost + 3, audit + "I", (*out, (role_of, "")))
        if at < len(rows):
            role, text, fault = rows[at]
            go(at + 1, state, cost + 4, audit + "D", out)
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if (state + role[:1]) in ("0s", "0u", "su", "ua", "au"):
                    go(at + 1, role[:1], cost + more, audit + "K", (*out, (role, text)))
                go(at + 1, role_of[0], cost + more + 3, audit + "R", (*out, (role_of, text)))

    go(0, "0", 0, "", ())
    return best


def repaired_by_hand(rows):
    """The contract's columns by conversation, nested loops only."""
    found = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        faults, seen = [], set()
        for _, role, text in kept:
            plain = text.strip(" \t\n\x0b\f\r")
            faults.append("blank" if not plain else "duplicate" if (role, text) in seen else "" if plain[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = [t for t, _, _ in kept if t is not None]
        cost, audit, out = every_edit([(role, text, fault) for (_, role, text), fault in zip(kept, faults, strict=True)])
        found[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(kept, kept[1:], strict=False)), cost, audit,
            hashlib.sha256("\n".join(f"{role}:{text}" for role, text in out).encode()).hexdigest())
    return found


def columns(rows):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}


def test_edit_lists_against_all_edits():
    rng = random.Random(5)
    for _ in range(300):
        rows = [(rng.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]), "x", rng.choice(["", "", "truncated", "blank"])) for _ in range(rng.randrange(6))]
        codes = bytes("sua".find(role[:1] or "-") % 4 | {"": 0, "truncated": 8, "blank": 4}[fault] for role, _, fault in rows)
        cost, audit = repair.cheapest_edits(codes)
        expected = every_edit(rows)
        assert (cost, audit) == expected[:2]
        assert tuple(repair.repaired_rows(audit, [(role, text, 1) for role, text, _ in rows])) == expected[2]


def test_long_edit_lists():
    """A dynamic programme over prefixes gives the same for long conversations."""
    rng = random.Random(6)
    codes = bytes(rng.choice([0, 1, 2, 1, 2, 3]) | rng.choice([0, 0, 0, 4, 8]) for _ in range(700))
    labels = {0: (0, "")}
    for at in range(len(codes) + 1):
        for _ in range(3):
            for state in list(labels):
                after = labels[state][0] + 3, labels[state][1] + "I"
                labels[repair._NEXT[state]] = min(labels.get(repair._NEXT[state], after), after)
        if at == len(codes):
            break
        step = {}
        for state, (cost, audit) in labels.items():
            for other, more, letter in repair._edges(codes[at:at + 1], state):
                if letter != "I":
                    step[other % 4] = min(step.get(other % 4, (10**9,)), (cost + more, audit + letter))
        labels = step
    assert repair.cheapest_edits(codes) == min(labels[s] for s in repair.ACCEPTED if s in labels)


def test_conversations_by_hand(spark):
    rng = random.Random(7)
    rows = []
    for conv in [*range(40), None]:
        for turn in range(rng.randrange(1, 6)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", None, "", "unknown", "User"])
            text = rng.choice(["Yes.", "No?", "cut off", "", " \t\n\x0b", None, "é!  ", "a b c", "😀.", "x" * 5000 + "."])
            rows += [(conv, None if rng.random() < 0.1 else turn * rng.choice([1, 1, 2]), role, text)] * rng.choice([1, 1, 1, 2])
    table = spark.createDataFrame(rows, CONVERSATIONS).selectExpr("*", "1 AS copies", "'x' AS message", "2 AS place", "3 AS code", "4 AS cost")
    assert columns(repair.repair(repair.damage(table)).collect()) == repaired_by_hand(rows)
    assert columns(repair.repair(repair.damage(table.repartition(5))).collect()) == repaired_by_hand(rows)


def test_conversation_without_rows_and_hot_ones(spark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(dropped, 0, "user", "Gone.")]
    hot = [(-1, turn, "ua"[turn % 2] + "x", f"Turn {turn}.") for turn in range(3000)] + [(-1, 5000, "user", "Same.")] * 2000
    found = columns(repair.repair(repair.damage(spark.createDataFrame(rows + hot, CONVERSATIONS))).collect())
    assert found[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    copies = {0: 0, 3: 2}.get(zlib.crc32(b"-1:5000") % 20, 1) * 2000
    assert found[-1][2] >= copies - 1 and len(found[-1][6].replace("I", "")) == sum({0: 0, 3: 2}.get(zlib.crc32(f"-1:{r[1]}".encode()) % 20, 1) for r in hot)
    assert repair.repair(repair.damage(spark.createDataFrame([], CONVERSATIONS))).count() == 0


def test_urls(spark):
    model = url_filter.train(url_filter.labelled_urls(spark))
    urls = {
        "https://WWW.Example.ORG/es/1?x=/fr/": ("www.example.org", "/es/1", "example.org/es/", "block"), "http://example.org": ("example.org", "", None, "allow"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"), "http://a.com/fr/?u=http://b.org/": ("a.com", "/fr/", "com/fr/", "allow"),
        "x://y.com/de/#a://b": ("y.com", "/de/", "com/de/", "block"), "http://h.net?q=/de/": ("h.net", "", None, "allow"), "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"), None: ("", "", None, "allow"), "://": ("", "", None, "allow"), "http://example.org/en/1": ("example.org", "/en/1", "example.org/en/1", "block"),
        "http://ÉÀ😀.net/\n/a\u2028b": ("ÉÀ😀.net", "/\n/a\u2028b", None, "allow"), "http://casino.example.net/": ("casino.example.net", "/", None, "block"),
        "http://" + "a" * 60_000 + ".net/" + "b/" * 30_000: ("a" * 60_000 + ".net", "/" + "b/" * 30_000, None, "allow")}
    rows = [(i, url) for i, url in enumerate(urls)] + [(0, next(iter(urls))), (None, None)]
    table = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 AS host", "2 AS score", "'x' AS rule")
    found = url_filter.judge(table, queries.URL_RULES, model).collect()
    assert sorted(((r.page_id, (r.host, r.path, r.rule, r.verdict)) for r in found), key=repr) == sorted(((i, urls[u]) for i, u in rows), key=repr)
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), queries.URL_RULES, model).count() == 0


def test_url_model_on_held_out_urls(spark):
    """Trained on every other labelled URL, it tells the rest apart; the descent equals numpy's."""
    table = url_filter.labelled_urls(spark)
    half = spark.createDataFrame(url_filter.LABELLED[::2], "url string, label int")
    rest = [(i, url, label) for i, (url, label) in enumerate(url_filter.LABELLED[1::2])]
    found = {r.page_id: r.score for r in url_filter.judge(spark.createDataFrame(rest, "page_id long, url string, label int"), [], url_filter.train(half)).collect()}
    wanted, others = [found[i] for i, _, y in rest if y], [found[i] for i, _, y in rest if not y]
    assert np.mean([a > b for a in wanted for b in others]) > 0.9
    rows = url_filter.split_urls(table, "label").select("label", url_filter.buckets().alias("b")).collect()
    x = np.zeros((len(rows), url_filter.BUCKETS))
    for i, r in enumerate(rows):
        np.add.at(x[i], r.b, 1 / np.sqrt(max(1, len(r.b))))
    y, w, b = np.array([r.label for r in rows], float), np.zeros(url_filter.BUCKETS), 0.0
    for _ in range(url_filter.STEPS):
        left = y - 1 / (1 + np.exp(-(x @ w + b)))
        w, b = w * (1 - url_filter.RATE * url_filter.PENALTY) + url_filter.RATE / len(y) * (left @ x), b + url_filter.RATE / len(y) * left.sum()
    model = url_filter.train(table)
    assert model.intercept == pytest.approx(b) and all(model.weights[k] == pytest.approx(w[k], abs=1e-9) for k in model.weights)
    empty = url_filter.train(table.where("label > 5"))
    assert {r.verdict for r in url_filter.judge(table.withColumn("page_id", table.label), [], empty).collect()} == {"allow"}


def frequent_by_hand(rows, max_words=3, least=10):
    counts, words = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            words[lang or "und"] += len(w)
            counts.update((lang or "und", " ".join(w[i:i + n])) for n in range(1, max_words + 1) for i in range(len(w) - n + 1))
    return {k: f for k, f in counts.items() if f >= least}, words


def phrases_by_hand(rows, max_words=3, least=10, top=2000):
    f, words = frequent_by_hand(rows, max_words, least)
    out = {}
    for (lang, phrase), a in f.items():
        w = phrase.split(" ")
        if len(w) < 2:
            continue
        cuts = [(1000000 * a * a // (f[lang, " ".join(w[:k])] * f[lang, " ".join(w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        held = any(100 * g >= 50 * a for (other, longer), g in f.items() if other == lang and len(longer) > len(phrase) and f" {phrase} " in f" {longer} ")
        if not held:
            out.setdefault(lang, []).append((-score, -a, phrase.encode(), f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]))
    return sorted((lang, i, p.decode(), -a, left, right, words[lang], -score) for lang, found in out.items() for i, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1))


def some_texts(rng, n):
    words = ["Alpha", "beta", "gamma", "DELTA", "é", "ÉÉ", "😀", "x\x00y", "\u00a0", "w" * 90, "w" * 89 + "v"]
    gaps = [" "] * 12 + ["  ", "\t", ". ", ",", "\n", " ;\r\n ", "?!", " \x0b"]
    texts = [(rng.choice(["en", "en", "de", None, "und"]), "".join(rng.choice(words[:rng.randrange(2, 12)]) + rng.choice(gaps) for _ in range(rng.randrange(60)))) for _ in range(n)]
    return texts + [("en", None), ("en", ""), (None, " .\n "), ("de", "beta"), ("xx", "one two")]


@pytest.mark.parametrize(("bits", "block"), [(64, 1 << 23), (64, 500), (5, 700), (0, 2000)])
def test_phrases_by_hand(spark, bits, block):
    """Short fingerprints collide all the time; counts stay right."""
    rows = some_texts(random.Random(bits), 150)
    table = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 AS part", "'b' AS block", "2 AS f", "3 AS n", "4 AS phrase").repartition(3)
    found = phrases.collocations(table, bits=bits, block_bytes=block, part_bytes=3000).collect()
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in found) == phrases_by_hand(rows)
    few = phrases.collocations(table, max_words=4, min_count=4, top=3, bits=bits, block_bytes=block).collect()
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in few) == phrases_by_hand(rows, 4, 4, 3)


def test_large_counts_and_long_texts(spark):
    """A text longer than a block and than a hashed stretch, with its runs counted once."""
    rows = [("en", "big text here, " * 100_000)] + [("en", "word " * 300_000)]
    found = phrases.frequent_runs(spark.createDataFrame(rows, "lang string, text string"), block_bytes=1 << 16).collect()
    f, words = frequent_by_hand(rows)
    assert {(r.lang, r.phrase): r.f for r in found if r.n} == f and {r.lang: r.f for r in found if not r.n} == words
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_scores_beyond_64_bits(spark):
    million = spark.createDataFrame([(3_000_000_000_007, 3_000_000_000_009, 3_000_000_000_011)], "a long, l long, r long")
    wide = [million[c].cast("decimal(19,0)") for c in "alr"]
    from pyspark.sql import functions as F

    assert million.select(phrases._floor_quotient(F.lit(1000000).cast("decimal(7,0)"), *wide)).first()[0] == 1000000 * 3_000_000_000_007**2 // (3_000_000_000_009 * 3_000_000_000_011)
