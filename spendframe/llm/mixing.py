"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

The mix takes ``share`` of all words. Each source gets its weight's part of that; a
source that would pass ``max_epochs`` times its size is clamped there, and what it
leaves over is dealt to the others by weight until no source is above its limit. A
source's documents are repeated whole as often as its target holds the source; the
fraction that remains goes to the first documents of a seeded order, the last of
which takes part with its first words, so that the words taken equal the target
rounded to a word.

A source may hold any share of the rows: the seeded order is kept in two steps, sums
of ``BUCKETS`` stretches of the order first and then places inside one stretch, so
no task sees a whole source.

Nulls: a null text has size 0, null is a source of its own and the last one, a null
doc_id has its own place in the order. Repeated rows take part one by one. A source
without words has target 0. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, keep, text_of

BUCKETS = 4096  # three hexadecimal digits
WEIGHTS = (3, 1, 2)
_ROW = "mix_row"
SHARE, MAX_EPOCHS, SEED = 1.5, 2.0, "mix"


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Water-filling over (source, source_size, weight): adds ``target``.

    Sources in ascending order of limit over weight are clamped one after the
    other; the first that stays below its limit sets the level of all others.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.sum("source_size").over(everything) * F.lit(share)
    filled = (
        sizes.withColumn("cap", F.col("source_size") * F.lit(max_epochs))
        .withColumn("rest", wanted - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("level", F.col("rest") / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
        .withColumn("clamped", F.col("cap") <= F.col("weight") * F.col("level"))
    )
    level = F.max(F.when(~F.col("clamped"), F.col("level"))).over(everything)
    return filled.withColumn("target", F.when(F.col("clamped"), F.col("cap")).otherwise(F.col("weight") * level)).select(
        "source", "source_size", "weight", "target")


def weighted_sources(sized: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """Size of each source, and weights repeating over the sources by code point, null last."""
    number = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    return sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn(
        "weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), F.pmod(number - 1, F.lit(len(weights))) + 1))


def mix(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: str = SEED, row: str | None = None,
) -> DataFrame:
    """Per document: size, source_size, target, taken, whole repetitions and the words of the fractional one.

    ``row`` names a column that tells rows apart; it breaks ties of the order and is returned too.
    """
    own = [] if row is None else [row]
    sized = keep(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(text_of()).alias("size"), *own), "sizes")
    per_source = targets(weighted_sources(sized, weights), share, max_epochs).select(
        F.col("source").alias("of"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("repeats"))
    per_source = per_source.withColumn(
        "more", F.floor(F.col("target") + 0.5).cast("long") - F.col("repeats") * F.col("source_size"))
    ordered = sized.withColumn("order_key", F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    ordered = ordered.withColumn("bucket", F.conv(F.substring("order_key", 1, 3), 16, 10).cast("int"))
    buckets = ordered.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(
        F.col("source").alias("of"), F.col("bucket").alias("in_bucket"), F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("buckets_before"))
    inside = Window.partitionBy("source", "bucket").orderBy("order_key", "doc_id", "size", *own).rowsBetween(Window.unboundedPreceding, -1)
    placed = ordered.withColumn("words_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    found = (
        placed.join(buckets, placed.source.eqNullSafe(buckets.of) & (placed.bucket == buckets.in_bucket)).drop("of")
        .join(per_source, F.col("source").eqNullSafe(per_source.of)).drop("of")
    )
    room = F.col("more") - F.col("buckets_before") - F.col("words_before")
    extra = F.greatest(F.lit(0), F.least(F.col("size"), room)).cast("long")
    return found.select(
        "doc_id", "size", "source_size", "target", (F.col("repeats") * F.col("size") + extra).alias("taken"),
        "repeats", extra.alias("extra_words"), "source", *own)


def apply_mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed documents themselves, with the columns of ``docs``.

    A document appears once for each whole repetition; the fractional repetition at
    the end of a source's share holds the first words of its document, joined by
    spaces. Each row gets a number of its own first, written out with it, and meets
    its decision by that; ids may be null or stand in many rows.
    """
    columns = docs.columns
    docs = keep(docs.withColumn(_ROW, F.monotonically_increasing_id()), "numbered")
    decided = mix(docs, row=_ROW, **how).select(
        F.col(_ROW).alias("mix_of"), (F.col("repeats") + (F.col("extra_words") == F.col("size")).cast("long") * (F.col("size") > 0).cast("long")).alias("mix_whole"),
        F.when(F.col("extra_words") < F.col("size"), F.col("extra_words")).otherwise(0).alias("mix_words"))
    taken = docs.join(decided, F.col(_ROW) == F.col("mix_of")).where("mix_whole > 0 or mix_words > 0")
    copies = taken.withColumn("mix_copy", F.explode(F.sequence(F.when(F.col("mix_words") > 0, 0).otherwise(1).cast("long"), F.col("mix_whole"))))
    short = F.col("mix_copy") == 0
    return copies.select(*[
        F.when(short, first_words_of("text", "mix_words")).otherwise(F.col("text")).alias("text") if c == "text"
        else F.when(short, F.length(first_words_of("text", "mix_words")).cast(dict(docs.dtypes)[c])).otherwise(F.col(c)).alias(c) if c == "n_chars"
        else F.col(c) for c in columns])


def first_words_of(text: str, words: str) -> Column:
    """The first words of a text, joined by single spaces."""
    return F.array_join(F.slice(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)), F.lit(1), F.col(words).cast("int")), " ")
