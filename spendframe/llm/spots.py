"""Spot signatures: fingerprints of texts in DataFrame operations only.

After each common word, the anchor, the next ``CHAIN`` content words within reach form
a chain; anchor and chain hash to a signature. The sorted distinct signatures are the
fingerprint. Besides the common words of four languages, the start of the text and one
word in 16 by hash are anchors, so texts of other kinds have a fingerprint as well.
Words are lower-cased and parted by white space and punctuation.

Two fingerprints of lengths m <= n are at most m / n alike, so with a least likeness
asked for, only neighbouring length partitions are compared, and only fingerprints
that share one of their first signatures (``similar_pairs``).

Nulls: a null text is empty; documents without doc_id come first in the order. Very long texts are
fingerprinted whole. Texts
without words have an empty fingerprint, alike to empty fingerprints only. Rows of equal
doc_id are ordered by text. Equal texts have equal fingerprints. An empty table gives
no rows; with one document, it is its own next. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, groups_for, keep, text_of

# Common words of English, German, French and Spanish.
ANCHORS = (
    "the of and to in a is it that for on was with as be by at this are from or an have not he you they which were "
    "der die das und zu den von mit sich des auf für ist im dem nicht ein eine auch es an er "
    "le la les de et un une du que qui dans par pour pas sur au avec ce il elle en "
    "el los las y del se por con una su al lo como más o"
).split()
CHAIN = 2
REACH = 8
EVERY = 16
BUCKET_ROWS = 2000  # documents of a stretch of doc_ids
COARSE = 256  # ranges of doc_ids between approximate quantiles
_MARKS = SPACES + ".,;:!?()[]{}\"'|/"


def _is_common(word: Column) -> Column:
    return word.isin(*dict.fromkeys(ANCHORS))


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the fingerprint of a text column as an ascending array of distinct integers."""
    words = F.array_remove(F.split(F.translate(F.lower(F.col(text)), _MARKS, " " * len(_MARKS)), " "), "")
    split = df.withColumn("spot_words", words)
    word = lambda i: F.get("spot_words", i)
    anchors = F.filter(
        F.sequence(F.lit(-1), F.size("spot_words") - 1),
        lambda i: (i < 0) | _is_common(word(i)) | (F.pmod(F.hash(word(i)), F.lit(EVERY)) == 0))
    chained = F.transform(anchors, lambda i: F.hash(F.coalesce(word(i), F.lit("")), F.slice(
        F.filter(F.slice("spot_words", i + 2, F.lit(REACH)), lambda w: ~_is_common(w)), 1, CHAIN)))
    return split.withColumn(name, F.when(F.size("spot_words") > 0, F.array_sort(F.array_distinct(chained))).otherwise(
        F.array().cast("array<int>"))).drop("spot_words")


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of two fingerprints; two empty ones are alike."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(common / (F.size(a) + F.size(b) - common)).cast("double")


def as_text(fingerprint: str) -> Column:
    return F.array_join(F.col(fingerprint).cast("array<string>"), ",")


def _stretch(df: DataFrame) -> Column:
    """Number of a row's stretch of doc_ids, ascending with them: about ``BUCKET_ROWS`` rows each, however ids are spread.

    Approximate quantiles part the ids into ``COARSE`` ranges at most, and each range is cut
    evenly, so an id far from all others widens the stretches of its own range only.
    """
    n, low, high = df.agg(F.count("doc_id"), F.min("doc_id"), F.max("doc_id")).first()
    groups = groups_for(n, BUCKET_ROWS)
    ranges = min(groups, COARSE)
    if ranges == 1:
        bounds = []
    else:
        shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
        bounds = sorted(set(df.agg(F.percentile_approx("doc_id", shares, F.lit(50 * ranges))).first()[0]))
    cuts = -(-groups // ranges)
    upper = F.array(*[F.lit(int(x)).cast("long") for x in bounds]) if bounds else F.array().cast("array<long>")
    place = F.size(F.filter(upper, lambda bound: bound < F.col("doc_id")))
    begins = F.array(*[F.lit(float(x)) for x in [low or 0, *(x + 1 for x in bounds)]])
    widths = F.array(*[F.lit(max(1.0, (float(b) - float(a) + 1) / cuts)) for a, b in zip([low or 0, *(x + 1 for x in bounds)], [*bounds, high or 0], strict=True)])
    inside = F.floor((F.col("doc_id").cast("double") - F.get(begins, place)) / F.get(widths, place))
    numbered = place * cuts + F.least(F.lit(cuts - 1), F.greatest(F.lit(0), inside))
    return F.when(F.col("doc_id").isNotNull(), numbered).otherwise(-1).cast("long")


def with_next(df: DataFrame) -> DataFrame:
    """Add ``following``, the struct ``body`` of the next row by doc_id and text; the last row gets the first one's.

    The order is kept within stretches of doc_ids; a stretch's last row takes the first
    row of the next stretch, of which there is one for each stretch.
    """
    dealt = df.withColumn("stretch", _stretch(df))
    rows = Window.partitionBy("stretch").orderBy("doc_id", F.col("body.text"))
    led = dealt.withColumn("led", F.lead("body").over(rows)).withColumn("is_first", F.lag(F.lit(True)).over(rows).isNull())
    firsts = led.where("is_first").select(F.col("stretch").alias("next_stretch"), F.col("body").alias("first_body"))
    in_order = Window.orderBy("stretch")  # numbers only; one row for each stretch
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = dealt.select("stretch").distinct().select(
        "stretch", F.coalesce(F.lead("stretch").over(in_order), F.first("stretch").over(whole)).alias("next_stretch"))
    heads = turn.join(firsts, "next_stretch").select("stretch", "first_body")
    return led.join(heads, "stretch").withColumn("following", F.coalesce("led", "first_body")).drop("led", "is_first", "first_body", "stretch")


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness to one another and to the next document's."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    printed = with_fingerprint(texts, "text", "spots").select("doc_id", F.struct("text", "spots").alias("body"))
    n, half = F.length("body.text"), F.floor(F.length("body.text") / 2).cast("int")
    paired = with_next(printed).select(
        "doc_id", n.cast("long").alias("n_chars"), F.col("body.spots").alias("spots"), F.col("following.spots").alias("next_spots"),
        F.concat(F.substring("body.text", F.lit(1), n - half), F.substring("following.text", F.lit(1), half)).alias("edited"))
    both = with_fingerprint(paired, "edited", "edited_spots")
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text("spots").alias("fingerprint"),
        as_text("edited_spots").alias("edited_fingerprint"), likeness("spots", "edited_spots").alias("near_edited"),
        likeness("spots", "next_spots").alias("near_next"))


def similar_pairs(docs: DataFrame, at_least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Classes of equal fingerprints (doc_id, class_id), and pairs of classes (one, other, likeness) at least so alike.

    Lengths fall into partitions whose bounds grow by 1 / ``at_least``, so alike sets are
    in the same or in neighbouring ones. Each set's signatures stand in the order of their
    number of sets, rarest first. Of n signatures, sets that are alike share one of the
    first n - ceil(at_least * n) + 1, so a frequent signature pairs only sets of hardly
    anything else; and where the first shared one stands bounds how many more can follow.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    printed = keep(with_fingerprint(texts, "text", "spots").drop("text"), "spots")
    classed = printed.groupBy("spots").agg(F.min("doc_id").alias("class_id"))
    membership = printed.join(classed, "spots").select("doc_id", "class_id")
    sets = keep(classed.where(F.size("spots") > 0).withColumn("n", F.size("spots")).withColumn(
        "part", F.floor(F.log("n") / F.lit(-1.0) / F.log(F.lit(at_least))).cast("int")), "sets")
    each = sets.select("class_id", "n", "part", F.explode("spots").alias("spot"))
    frequency = each.groupBy("spot").agg(F.count(F.lit(1)).alias("sets"))
    ranked = each.join(frequency, "spot").groupBy("class_id", "n", "part").agg(F.array_sort(F.collect_list(F.struct("sets", "spot"))).alias("order"))
    prefix = F.slice("order", F.lit(1), F.col("n") - F.ceil(F.col("n") * at_least - 1e-9).cast("int") + 1)
    first = keep(ranked.select("class_id", "n", "part", F.posexplode(prefix).alias("place", "entry")).select("class_id", "n", "part", "place", "entry.spot"), "prefixes")
    short = first.select(F.col("class_id").alias("one"), F.col("n").alias("m"), F.col("part").alias("at"), F.col("place").alias("i"), "spot")
    long = first.select(F.col("class_id").alias("other"), "n", F.col("place").alias("j"), "spot", F.explode(F.array("part", F.col("part") - 1)).alias("at"))
    needed = F.lit(at_least / (1 + at_least)) * (F.col("m") + F.col("n")) - 1e-9
    close = short.join(long, ["at", "spot"]).where(
        ((F.col("m") < F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("one") < F.col("other")))) & (F.col("m") >= F.col("n") * at_least - 1e-9))
    # the least places of a pair are those of its first shared signature: all others follow in both
    candidates = close.groupBy("one", "other").agg(F.min(F.struct("i", "j")).alias("first"), F.first("m").alias("m"), F.first("n").alias("n")).where(
        F.least(F.col("m") - F.col("first.i"), F.col("n") - F.col("first.j")) >= needed)
    a, b = sets.select(F.col("class_id").alias("one"), F.col("spots").alias("a")), sets.select(F.col("class_id").alias("other"), F.col("spots").alias("b"))
    compared = candidates.select("one", "other").join(a, "one").join(b, "other").select("one", "other", likeness("a", "b").alias("likeness"))
    return membership, compared.where(F.col("likeness") >= at_least)
