"""SQL twins, awkward input and the pipeline."""

from __future__ import annotations

import pytest
from oracle import compare, duck

import __spark_entry__ as contract
import corpus_pipeline
from spendframe.llm import byte_ids, host_rules, lm_score, mixing, near_dups, packing, queries, quotes, repeats, spots, toxicity
from spendframe.llm.common import documents

SMALL = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "one", "en", "b", 3), (5, "word " * 30_000, "en", "b", 150_000),
    (6, "same text here " * 20, "de", None, 300), (7, "same text here " * 20, "de", None, 300), (7, "same text here " * 20, "de", None, 300),
    (None, "no id at all", "fr", "c", 12), (8, "é" * 150 + "\n" + "😀" * 60, "xx", "c", 211)]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_twin(spark, name):
    count, problems = compare(queries.QUERIES[name](spark, SMALL), duck(SMALL), queries.ORACLES[name])
    assert count and not problems


def operators(spark):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (6, 1, None), (None, None, None)], "doc_id long, quality int, toxic int")
    return {
        "ids": lambda d: byte_ids.round_trip(d, "byte_bpe_50k.json"), "toxicity": lambda d: toxicity.score(d, toxicity.train(d, labels)),
        "packing": lambda d: packing.pack(d, "word_bpe_49k.json"), "repeats": repeats.remove_repeats, "mixing": mixing.mix,
        "model": lambda d: lm_score.cross_entropy_difference(d, labels), "rules": host_rules.apply_rules, "near": near_dups.near_duplicates,
        "spots": spots.edited_likeness}


NAMES = ["ids", "toxicity", "packing", "repeats", "mixing", "model", "rules", "near", "spots"]


@pytest.mark.parametrize("name", NAMES)
def test_awkward_rows_and_clashing_columns(spark, name):
    docs = spark.createDataFrame(AWKWARD, COLUMNS).selectExpr(
        "*", "1 AS size", "'x' AS bucket", "2 AS anchor", "true AS kept", "'s' AS tag", "3 AS shard", "0.5 AS score", "4 AS band", "5 AS stretch", "6 AS words")
    rows = operators(spark)[name](docs).collect()
    assert len(rows) == len(AWKWARD) or name == "packing" and len(rows) >= len(AWKWARD)


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, name):
    assert operators(spark)[name](spark.createDataFrame([], COLUMNS)).count() == 0


def test_empty_conversations(spark):
    assert quotes.reply_ordered(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_kept_rows_of_host_rules(spark):
    rows = [(i, "good words that differ " + " ".join(f"w{i}{j}" for j in range(12)), "fine") for i in range(50)]
    rows += [(100 + i, "a b c", "bad") for i in range(50)] + [(200, rows[0][1], "bad"), (300, rows[1][1], "new"), (301, "x", "new")]
    kept = {r.doc_id for r in host_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect() if r.kept}
    assert kept == {*range(50), 300}  # one failure of a new host's two documents is not held against the other


def test_mix_meets_targets(spark):
    docs = documents(spark, SMALL)
    rows = mixing.mix(docs).collect()
    per = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        per.setdefault(r.source, [r.target, 0, r.source_size])[1] += r.taken
    assert all(abs(target - taken) <= 1 and target <= 2 * size for target, taken, size in per.values())
    assert sum(t for t, _, _ in per.values()) == pytest.approx(1.5 * sum(s for _, _, s in per.values()))
    assert sorted(rows) == sorted(mixing.mix(docs.repartition(7)).collect())


def test_width_of_shingles(spark):
    """Likeness 0.8 on two words, less on five: one of the pair is dropped, or neither."""
    words = [f"w{i}" for i in range(81)]
    changed = [f"x{i}" if i in (10, 30, 50, 70) else w for i, w in enumerate(words)]
    sets = lambda n: [set(zip(*(x[k:] for k in range(n)), strict=False)) for x in (words, changed)]
    alike = [len(a & b) / len(a | b) for a, b in (sets(2), sets(5))]
    assert alike[0] >= 0.8 > alike[1]
    few = [(3, "one two three"), (4, "One two  three"), (5, "one two"), (6, "three one two")]  # fewer words than a shingle
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in [(1, " ".join(words)), (2, " ".join(changed)), *few]], COLUMNS)
    assert {r.doc_id for r in near_dups.near_duplicates(docs).collect() if r.kept} == {1, 3, 5, 6}
    assert {r.doc_id for r in near_dups.one_of_each(docs, width=5).collect()} == {1, 2, 3, 5, 6}


def test_mixed_rows_that_share_ids(spark):
    """Equal ids and null ids meet only their own decision, so sources keep their targets."""
    rows = [(None if i % 3 == 0 else i % 7, " ".join(f"w{i}" for _ in range(5 + i % 4)), "en", "ab"[i % 2], 0) for i in range(60)] + [(1, "same row", "en", "a", 8)] * 4
    docs = spark.createDataFrame(rows, COLUMNS)
    wanted, words, copies = {}, {}, {}
    for r in mixing.mix(docs).collect():
        wanted[r.source] = wanted.get(r.source, 0) + r.taken
    for r in mixing.apply_mix(docs).collect():
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
        copies[r.text.split()[0]] = copies.get(r.text.split()[0], 0) + 1
    assert words == wanted and all(n <= 2 for word, n in copies.items() if word != "same")


@pytest.mark.parametrize("rows", [[], AWKWARD])
def test_pipeline_stages_on_awkward_tables(spark, tmp_path, rows):
    spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, COLUMNS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), COLUMNS)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert (packed.count() > 0) == bool(rows)


def test_copies_survive_the_pipeline_stages_once(spark, tmp_path):
    """A repeated row, a copy without doc_id and copies without any doc_id leave one whole text each."""
    texts = [" ".join(f"{name}{i}" for i in range(60)) for name in ("row", "null", "nulls", "other")]
    rows = [(1, texts[0]), (1, texts[0]), (2, texts[1]), (None, texts[1]), (None, texts[2]), (None, texts[2]), (3, texts[3]), (3, "short"), (4, ""), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], COLUMNS)
    single = corpus_pipeline.keep_one_of_near_duplicates(spark, docs, str(tmp_path))
    assert single.columns == docs.columns
    cut = corpus_pipeline.cut_repeated_strings(spark, spark.createDataFrame(single.collect(), COLUMNS), str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.text) for r in cut), key=str) == sorted(
        [(1, texts[0]), (2, texts[1]), (None, texts[2]), (3, texts[3]), (3, "short"), (4, ""), (4, "")], key=str)


def test_pipeline_by_hand(spark):
    """Each stage's decisions against the operator's own brute force, on what the stage before kept."""
    from test_brute_force import components_by_hand, removed_by_hand

    docs = documents(spark, SMALL).limit(80)
    columns = docs.columns
    clean = spark.createDataFrame(corpus_pipeline.reject_toxic(spark, docs, SMALL).collect(), docs.schema)
    assert clean.columns == columns and 0 < clean.count() <= 80
    single = spark.createDataFrame(corpus_pipeline.keep_one_of_near_duplicates(spark, clean, SMALL).collect(), docs.schema)
    found = components_by_hand([(r.doc_id, r.text) for r in clean.collect()], corpus_pipeline.SHINGLE_WORDS)
    assert {r.doc_id for r in single.collect()} == {i for i, (_, _, kept) in found.items() if kept}
    cut = spark.createDataFrame(corpus_pipeline.cut_repeated_strings(spark, single, SMALL).collect(), docs.schema)
    by_hand = {r[0]: r[1] - r[2] for r in removed_by_hand([(r.doc_id, r.text) for r in single.collect()])}
    assert {r.doc_id for r in cut.collect()} == set(by_hand)
    assert all(len(r.text.encode()) <= by_hand[r.doc_id] and r.n_chars == len(r.text) for r in cut.collect())
    mixed = corpus_pipeline.mix_sources(spark, cut, SMALL)
    assert mixed.columns == columns
    taken = {r.doc_id: r.taken for r in mixing.mix(cut).collect()}
    words = {}
    for r in mixed.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.encode().split())
    assert words == {i: n for i, n in taken.items() if n or i in words}


def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0


def test_registered(spark):
    assert {f"op{n}" for n in range(1, 14)} | {"pipeline"} == {n.partition("_")[0] for n in contract.queries() if n.startswith("op") or n == "pipeline"}
