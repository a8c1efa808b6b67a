"""Quality rules whose verdict is taken for whole hosts, in DataFrame operations only.

Each document is measured on its whole text. A host is the document's domain (the
``source`` column). Its rate of rule failures is shrunk towards the rate of the whole
corpus by a beta prior whose strength is fitted to the spread of the hosts' rates, so
a host with few documents is judged mostly by the corpus. Documents of a host whose
shrunk rate is above ``MAX_RATE`` are not kept; neither are documents that fail
themselves.

Nulls: a null text has no words and fails, null is a host of its own. Empty texts fail
as well. Repeated rows count one by one. An empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, keep, text_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED = 20  # per cent of the words
MAX_RATE = 0.5
MIN_STRENGTH, MAX_STRENGTH = 1.0, 1e6  # documents that the prior counts for


def words_of(text: Column) -> Column:
    """Words as an array: other white space becomes spaces, empty stretches go."""
    return F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, source and the measures of each whole text.

    Words in repeated windows: windows are compared by hash first. Only in a text with
    two equal hashes are they compared as strings, sorted with their places; the places
    of equal neighbours give the covered words.
    """
    text = docs.select("doc_id", F.col("source").cast("string").alias("source"), text_of().alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda line: F.length(F.translate(line, SPACES, "")) > 0)
    split = text.select(
        "doc_id", "source", words_of(F.col("text")).alias("words"), lines.alias("lines"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"))
    n_windows = F.size("words") - (WINDOW - 1)
    hashed = split.withColumn("n_windows", n_windows).withColumn("hashes", F.when(
        F.col("n_windows") > 1, F.transform(F.sequence(F.lit(0), F.col("n_windows") - 1), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)]))))
    repeats = hashed.withColumn("windows", F.when(
        F.size(F.array_distinct("hashes")) < F.size("hashes"),
        F.array_sort(F.transform(F.sequence(F.lit(0), F.col("n_windows") - 1), lambda i: F.struct(
            F.array_join(F.slice("words", i + 1, F.lit(WINDOW)), " ").alias("window"), i.alias("at"))))))
    same = lambda i, j: F.get("windows", i)["window"] == F.get("windows", j)["window"]
    places = F.array_sort(F.transform(
        F.filter(F.sequence(F.lit(0), F.size("windows") - 1), lambda i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False))),
        lambda i: F.get("windows", i)["at"]))
    covered = F.aggregate(
        F.sequence(F.lit(0), F.size("places") - 1), F.lit(0).cast("long"),
        lambda total, i: total + F.least(F.lit(WINDOW), F.coalesce(F.get("places", i + 1) - F.get("places", i), F.lit(WINDOW))))
    placed = repeats.withColumn("places", F.when(F.col("windows").isNotNull(), places))
    return placed.select(
        "doc_id", "source", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("places") > 0, covered).otherwise(0).cast("long").alias("n_repeat_words"))


def host_rates(measured: DataFrame) -> DataFrame:
    """Per host: documents, failures and the shrunk failure rate.

    The prior's mean is the corpus rate. The hosts' spread about it, less what chance
    alone gives, sets its strength: mean * (1 - mean) / spread - 1.
    """
    hosts = measured.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    whole = hosts.agg(
        F.sum("n_docs").alias("all_docs"), F.sum("n_failed").alias("all_failed"), F.count(F.lit(1)).alias("n_hosts"),
        F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs")).alias("squares"))
    mean = F.col("all_failed") / F.col("all_docs")
    chance = mean * (1 - mean)
    spread = F.col("squares") / F.col("all_docs") - mean * mean - chance * F.col("n_hosts") / F.col("all_docs")
    strength = F.when(spread > 0, F.greatest(F.lit(MIN_STRENGTH), F.least(F.lit(MAX_STRENGTH), chance / spread - 1))).otherwise(MAX_STRENGTH)
    prior = whole.select(mean.alias("mean"), strength.alias("strength"))
    return hosts.crossJoin(F.broadcast(prior)).select(  # one row of prior
        "source", "n_docs", "n_failed", ((F.col("n_failed") + F.col("mean") * F.col("strength")) / (F.col("n_docs") + F.col("strength"))).alias("rate"))


def apply_rules(docs: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """Measures, own failure and verdict of each document."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    measured = keep(measure(docs).withColumn("base_failed", failed), "measures")
    rates = host_rates(measured).select(F.col("source").alias("host"), F.col("rate"))
    joined = measured.join(rates, F.col("source").eqNullSafe(F.col("host")))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("rate") <= max_rate)).alias("kept"))
