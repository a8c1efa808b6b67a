"""Conversations in reply order, linked by what messages quote.

A line that begins with one or more '>' quotes; their number is its level. Runs of lines
of one level are passages, and blank lines, quoted ones too, part a passage into
paragraphs. A passage as a whole, its paragraphs and its lines are units: lower-cased,
everything but letters and digits as one space, hashed. The unquoted passages, paragraphs
and lines of all messages and their whole unquoted texts are units as well, and quoted
units meet them by hash. The original of a unit is the first message of the same conversation that wrote
it, if that is earlier; else, with at least ``MIN_WORDS`` words, the first message of all
earlier conversations. A unit written many times has one original in each conversation
and one overall, so the join has one row per quoted unit.

A message replies to the original of most words at its lowest quoted level that was
found, or else to the turn before it. Parents are always earlier in (conv_id, turn), so
threads are trees. Roots and depths are found by doubling jumps. Within a thread,
messages are ordered by depth, turn and conv_id, so each follows what it replies to.
The text keeps neither quotes nor the line that introduces them.

Nulls: a null text is empty. Messages without conv_id or turn are threads of their own
and neither quoted nor linked. Rows of one (conv_id, turn) share parent and place in the
order of their texts. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, text_of

MIN_WORDS = 5
STRETCH = 256  # turns of a conversation that are ordered at once
CONVERSATIONS = 4096  # conversations whose messages of one thread, depth and turn are ordered at once
_QUOTE = re.compile(r"^\s{0,3}((?:>\s?)+)")
_INTRODUCES = re.compile(r"^(?:on\b.{0,200}\bwrote|am\b.{0,200}\bschrieb.{0,80}|le\b.{0,200}\ba écrit|el\b.{0,200}\bescribió|.{1,80}\b(?:wrote|writes|said))\s*:\s*$", re.I)
_PLAIN = re.compile(r"[\W_]+")
_UNIT = pa.struct([("level", pa.int32()), ("unit", pa.int64()), ("words", pa.int32())])


def split_levels(text: str) -> list[tuple[int, str]]:
    """Level and content of each line."""
    lines = []
    for line in text.splitlines():
        mark = _QUOTE.match(line)
        lines.append((mark[1].count(">"), line[mark.end():]) if mark else (0, line))
    return lines


def normalised(text: str) -> str:
    return _PLAIN.sub(" ", text.lower()).strip()


def unit_of(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def paragraphs(lines: list[str]) -> list[str]:
    """Lines between blank ones, joined."""
    return [" ".join(group) for filled, group in itertools.groupby(lines, lambda line: bool(line.strip())) if filled]


def parse(text: str) -> tuple[str, list[tuple[int, int, int]]]:
    """The text without quotes, and (level, unit, words) of all its units; level 0 is its own."""
    runs: list[tuple[int, list[str]]] = []
    for level, line in split_levels(text):
        if runs and runs[-1][0] == level:
            runs[-1][1].append(line)
        else:
            runs.append((level, [line]))
    own: list[str] = []
    parts: list[tuple[int, str]] = []
    for i, (level, lines) in enumerate(runs):
        if not level:
            if i + 1 < len(runs) and _INTRODUCES.match(lines[-1]):
                lines = lines[:-1]
            own += lines
        parts += [(level, part) for part in (" ".join(lines), *paragraphs(lines), *lines)]
    units: dict[tuple[int, int], int] = {}
    for level, part in [*parts, (0, " ".join(own))]:
        if plain := normalised(part):
            units[level, unit_of(plain)] = plain.count(" ") + 1
    return "\n".join(own).strip("\n"), [(level, unit, words) for (level, unit), words in units.items()]


def _parsed(messages: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("conv_id"), batch.column("turn"), batch.column("role"), pa.array([own for own, _ in found], pa.string()),
                pa.array([[dict(zip(("level", "unit", "words"), u, strict=True)) for u in units] for _, units in found], pa.list_(_UNIT))],
                names=["conv_id", "turn", "role", "own_text", "units"])

    texts = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), text_of().alias("text"))
    return keep(texts.mapInArrow(
        run, "conv_id long, turn long, role string, own_text string, units array<struct<level: int, unit: long, words: int>>"), "messages")


def quoted_originals(parsed: DataFrame) -> DataFrame:
    """conv_id, turn, parent_conv, parent_turn of messages whose quotes were found."""
    units = parsed.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.inline("units")).distinct()
    quoted = units.where("level > 0")
    written = units.where("level = 0").join(quoted.select("unit").distinct(), "unit", "left_semi")
    inside = written.groupBy("unit", "conv_id").agg(F.min("turn").alias("in_turn"))
    anywhere = inside.groupBy("unit").agg(F.min(F.struct("conv_id", "in_turn")).alias("first"))
    met = quoted.join(inside, ["unit", "conv_id"], "left").join(anywhere, "unit", "left")
    is_inside = F.col("in_turn") < F.col("turn")
    is_before = (F.col("first.conv_id") < F.col("conv_id")) & (F.col("words") >= MIN_WORDS)
    original = F.when(is_inside, F.struct(F.col("conv_id").alias("conv"), F.col("in_turn").alias("turn"))).when(
        is_before, F.struct(F.col("first.conv_id").alias("conv"), F.col("first.in_turn").alias("turn")))
    found = met.withColumn("original", original).where("original is not null").groupBy("conv_id", "turn", "level", "original").agg(
        F.sum("words").alias("words"))
    best = found.groupBy("conv_id", "turn").agg(F.min(F.struct("level", (-F.col("words")).alias("less"), "original")).alias("best"))
    return best.select("conv_id", "turn", F.col("best.original.conv").alias("parent_conv"), F.col("best.original.turn").alias("parent_turn"))


def _turn_before(nodes: DataFrame) -> DataFrame:
    """Add the turn before in the conversation, stretch by stretch."""
    dealt = nodes.withColumn("stretch", F.floor(F.col("turn") / STRETCH))
    lasts = dealt.groupBy("conv_id", "stretch").agg(F.max("turn").alias("last")).select(
        "conv_id", "stretch", F.lag("last").over(Window.partitionBy("conv_id").orderBy("stretch")).alias("earlier"))
    near = F.lag("turn").over(Window.partitionBy("conv_id", "stretch").orderBy("turn"))
    return dealt.withColumn("near", near).join(lasts, ["conv_id", "stretch"]).select("conv_id", "turn", F.coalesce("near", "earlier").alias("before"))


def threads(parsed: DataFrame) -> DataFrame:
    """conv_id, turn, parent, root and depth of each distinct message."""
    nodes = parsed.where("conv_id is not null and turn is not null").select("conv_id", "turn").distinct()
    placed = _turn_before(nodes).join(quoted_originals(parsed), ["conv_id", "turn"], "left")
    parent = F.when(F.col("parent_conv").isNotNull(), F.struct(F.col("parent_conv").alias("conv"), F.col("parent_turn").alias("turn"))).when(
        F.col("before").isNotNull(), F.struct(F.col("conv_id").alias("conv"), F.col("before").alias("turn")))
    own = F.struct(F.col("conv_id").alias("conv"), F.col("turn").alias("turn"))
    state = keep(placed.select(own.alias("node"), parent.alias("parent"), F.coalesce(parent, own).alias("jump"), F.when(parent.isNotNull(), 1).otherwise(0).cast("long").alias("depth")), "jumps")
    while True:
        ahead = state.select(F.col("node").alias("at"), F.col("jump").alias("further"), F.col("depth").alias("more"))
        state = keep(state.join(ahead, F.col("jump") == F.col("at")).select(
            "node", "parent", F.col("further").alias("jump"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("further") != F.col("jump")).alias("moved")), "jumps")
        if state.where("moved").isEmpty():
            return state.select(F.col("node.conv").alias("conv_id"), F.col("node.turn").alias("turn"), "parent", F.col("jump").alias("root"), "depth")


def reply_ordered(messages: DataFrame) -> DataFrame:
    """Each message with its thread, parent, depth, place in the thread and its text without quotes."""
    parsed = _parsed(messages)
    linked = parsed.drop("units").join(threads(parsed), ["conv_id", "turn"], "left")
    root = F.coalesce("root", F.struct(F.col("conv_id").alias("conv"), F.col("turn").alias("turn")))
    rows = linked.select(
        "conv_id", "turn", "role", "own_text", "parent", root.alias("root"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.col("root").isNull().alias("alone"), F.coalesce(F.floor(F.col("turn") / STRETCH), F.lit(0)).alias("stretch"), F.floor(F.col("conv_id") / CONVERSATIONS).alias("slice"))
    # places in a thread: by stretches of turns, in a stretch by turn and slices of conversations, and in these by row
    stretch, slices = ["root", "depth", "stretch"], ["root", "depth", "stretch", "turn", "slice"]
    counts = rows.where("not alone").groupBy(*slices).agg(F.count(F.lit(1)).alias("n"))
    before_slice = Window.partitionBy(*stretch).orderBy("turn", "slice").rowsBetween(Window.unboundedPreceding, -1)
    before_stretch = Window.partitionBy("root").orderBy("depth", "stretch").rowsBetween(Window.unboundedPreceding, -1)
    longer = counts.groupBy(*stretch).agg(F.sum("n").alias("n")).select(*stretch, F.coalesce(F.sum("n").over(before_stretch), F.lit(0)).alias("earlier"))
    offsets = counts.select(*slices, F.coalesce(F.sum("n").over(before_slice), F.lit(0)).alias("before")).join(longer, stretch)
    inside = Window.partitionBy(*slices).orderBy("conv_id", "own_text", "role")
    placed = rows.where("not alone").withColumn("nth", F.row_number().over(inside)).join(offsets, slices).withColumn(
        "position", F.col("earlier") + F.col("before") + F.col("nth"))
    out = lambda df: df.select(
        F.col("root.conv").alias("thread_conv"), F.col("root.turn").alias("thread_turn"), "position", "conv_id", "turn", "role",
        F.col("parent.conv").alias("parent_conv"), F.col("parent.turn").alias("parent_turn"), "depth", F.col("own_text").alias("text"))
    return out(placed).unionByName(out(rows.where("alone").withColumn("position", F.lit(1).cast("long"))))
