"""Conversations whose turns alternate again, by the cheapest edits.

A repaired conversation's role initials read '(s?(ua)+)?'. Each row is kept (cost 0), given
the role 'user' or 'assistant' (3) or deleted (4); an empty row of either role can be
inserted anywhere (3). Blank and repeated rows must be deleted, and a truncated row that
stays costs 3 more. Of the cheapest edit lists the one with the least initials (D, I, K, R)
counts.

The edit lattice has a node for each row and each state of the role pattern. Two Dijkstra
searches run over it, one from its beginning and one backwards from its accepted ends. Once
the two heaps' least costs add up to more than the best meeting, every node of every
cheapest path is settled from one side. The nodes of the forward half are marked back from
all meetings of that cost, and a walk takes the least letter that stays on a cheapest path,
first through marked nodes and then through the backward half: the least concatenated list
of both halves, without a list per node. From one state a letter leads to one next state, so
the list fixes the repaired roles.

Rows become codes first: role initial and fault, found by Spark. Equal rows of one turn are
counted before the shuffle, and the first turn of each message of a conversation is an
aggregate, so no message and no row that is repeated without end meets in one group. A
task takes the codes of its conversations in order, one byte a row, and the lattice takes
about 40 bytes a row; the edit list itself is one value of the result. Texts are never
collected: sorted behind their conversation's edit list they stream through SHA-256.

Nulls: a null role, text, conv_id or turn counts as one space, but a null conv_id is
returned as null and null turns come first and do not count for gaps. Empty and blank texts
are blank rows. Rows of one turn are taken in the order of the MD5 of role and text; equal
rows are repetitions of each other. A conversation without rows has zeros, an empty edit
list and the hash of the empty string. An empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
ACCEPTED = (START, AFTER_ASSISTANT)
NEW_ROLE = ("user", "user", "assistant", "user")  # the role an inserted or changed row takes in a state
_NEXT = (AFTER_USER, AFTER_USER, AFTER_ASSISTANT, AFTER_USER)
_KEPT = ((1, -1, -1, -1), (2, 2, -1, 2), (-1, -1, 3, -1), (-1, -1, -1, -1))  # by initial s, u, a, other and state
_LEGAL = {(0, 1), (1, 2), (2, 1)}  # neighbours su, ua, au
_INITIAL, _GONE, _CUT = 3, 4, 8  # bits of a row's code: initial, must be deleted, truncated
_FAR = 2**31 - 1
CACHED_ROWS = 64
_RESULT = "conv_id {0}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _edges(codes: bytes, node: int) -> list[tuple[int, int, str]]:
    """(next node, cost, letter) of a node, in the order of the letters."""
    at, state = divmod(node, 4)
    found = []
    if at < len(codes):
        code = codes[at]
        found.append((node + 4, DELETE, "D"))
        found.append((at * 4 + _NEXT[state], INSERT, "I"))
        if not code & _GONE:
            more = TRUNCATED if code & _CUT else 0
            kept = _KEPT[code & _INITIAL][state]
            if kept >= 0:
                found.append((at * 4 + 4 + kept, KEEP + more, "K"))
            found.append((at * 4 + 4 + _NEXT[state], REROLE + more, "R"))
    else:
        found.append((at * 4 + _NEXT[state], INSERT, "I"))
    return found


def _edges_into(codes: bytes, node: int) -> list[tuple[int, int]]:
    """(node before, cost) of all edges that end in a node."""
    at, state = divmod(node, 4)
    found = [(at * 4 + s, INSERT) for s in range(4) if _NEXT[s] == state]
    if at:
        code = codes[at - 1]
        found.append((node - 4, DELETE))
        if not code & _GONE:
            more = TRUNCATED if code & _CUT else 0
            found += [(at * 4 - 4 + s, REROLE + more) for s in range(4) if _NEXT[s] == state]
            found += [(at * 4 - 4 + s, KEEP + more) for s in range(4) if _KEPT[code & _INITIAL][s] == state]
    return found


def cheapest_edits(codes: bytes) -> tuple[int, str]:
    """Cost and least edit list of a conversation's row codes."""
    size = 4 * len(codes) + 4
    ahead, behind = array("i", [_FAR]) * size, array("i", [_FAR]) * size
    settled_ahead, settled_behind = bytearray(size), bytearray(size)
    ahead[START] = 0
    forward, backward = [START], []  # heap entries: cost * size + node, mirrored for the backward one
    best = _FAR
    for state in ACCEPTED:
        behind[size - 4 + state] = 0
        backward.append(3 - state)
    heapq.heapify(backward)
    if len(codes) == 0:
        return 0, ""
    while forward and backward:
        cost_ahead, cost_behind = forward[0] // size, backward[0] // size
        if cost_ahead + cost_behind > best:
            break
        if cost_ahead <= cost_behind:
            node = heapq.heappop(forward) % size
            if settled_ahead[node]:
                continue
            settled_ahead[node] = 1
            for other, cost, _ in _edges(codes, node):
                total = cost_ahead + cost
                if total < ahead[other]:
                    ahead[other] = total
                    heapq.heappush(forward, total * size + other)
                    if behind[other] != _FAR:
                        best = min(best, total + behind[other])
        else:
            node = size - 1 - heapq.heappop(backward) % size
            if settled_behind[node]:
                continue
            settled_behind[node] = 1
            for other, cost in _edges_into(codes, node):
                total = cost_behind + cost
                if total < behind[other]:
                    behind[other] = total
                    heapq.heappush(backward, total * size + size - 1 - other)
                    if ahead[other] != _FAR:
                        best = min(best, total + ahead[other])
    on_path = bytearray(size)
    pending = [node for node in range(size) if ahead[node] != _FAR and behind[node] != _FAR and ahead[node] + behind[node] == best]
    for node in pending:
        on_path[node] = 1
    while pending:
        node = pending.pop()
        for other, cost in _edges_into(codes, node):
            if settled_ahead[other] and not on_path[other] and ahead[other] + cost == ahead[node]:
                on_path[other] = 1
                pending.append(other)
    letters: list[str] = []
    node, spent = START, 0
    while spent < best or node // 4 < len(codes) or node % 4 not in ACCEPTED:
        for other, cost, letter in _edges(codes, node):
            total = spent + cost
            if settled_behind[other] and behind[other] == best - total or on_path[other] and ahead[other] == total:
                node, spent = other, total
                letters.append(letter)
                break
        else:
            raise AssertionError("no cheapest edge")
    return best, "".join(letters)


@lru_cache(1 << 16)
def _cheapest_short(codes: bytes) -> tuple[int, str]:
    """Short conversations often share their codes."""
    return cheapest_edits(codes)


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies of each row after seeded damage; dropped rows have no copies."""
    words = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(words("conv_id"), F.lit(":"), words("turn"))) % 20
    return conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(words("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(words("text"), ".!?", "")).otherwise(words("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"))


def _message() -> Column:
    """What tells messages apart: role and text."""
    return F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))


def _order() -> list[Column]:
    return [F.asc_nulls_first("conv_id"), F.asc("place"), F.asc_nulls_first("turn"), F.asc("message")]


def row_codes(rows: DataFrame) -> DataFrame:
    """conv_id, turn, message, code, copies and whether the message stands in an earlier turn."""
    end = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    initial = F.left("role", F.lit(1))
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3) + F.when(end == "", _GONE).when(end.isin(".", "!", "?"), 0).otherwise(_CUT)
    there = F.col("copies") > 0
    runs = rows.select(
        "conv_id", F.when(there, F.col("turn")).alias("turn"), F.when(there, _message()).alias("message"), F.when(there, code).alias("code"), "copies",
    ).groupBy("conv_id", "turn", "message", "code").agg(F.sum("copies").alias("copies"))
    firsts = runs.where("copies > 0").groupBy(F.col("conv_id").alias("of_conv"), F.col("message").alias("of_message")).agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("first"))).alias("at"))
    met = runs.join(firsts, F.col("conv_id").eqNullSafe(F.col("of_conv")) & (F.col("message") == F.col("of_message")), "left")
    return met.select("conv_id", "turn", "message", "code", "copies", (~F.col("turn").eqNullSafe(F.col("at.first"))).alias("seen"))


def _audits(coded: DataFrame) -> DataFrame:
    """Counts and edits of each conversation from its codes in order."""
    kind = dict(coded.dtypes)["conv_id"]
    ordered = coded.withColumn("place", F.when(F.col("copies") > 0, 1).otherwise(0)).repartition("conv_id").sortWithinPartitions(*_order())
    schema = _RESULT.format(kind)

    def finish(conv, codes: bytearray, turns: list, counts: list[int]) -> tuple:
        first, last, distinct = turns
        gaps = last - first + 1 - distinct if distinct else 0
        illegal = sum((a & _INITIAL, b & _INITIAL) not in _LEGAL for a, b in zip(codes, codes[1:], strict=False))
        cost, audit = (_cheapest_short if len(codes) <= CACHED_ROWS else cheapest_edits)(bytes(codes))
        return (conv, gaps, *counts, illegal, cost, audit)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, started = None, False
        done: list[tuple] = []
        names = [part.split()[0] for part in schema.split(", ")]
        arrow = None
        for batch in batches:
            arrow = arrow or batch.schema.field("conv_id").type
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "code", "copies", "seen")]
            for conv, turn, code, copies, seen in zip(*columns, strict=True):
                if not started or conv != current:
                    if started:
                        done.append(finish(current, codes, turns, counts))
                    current, started, codes, turns, counts = conv, True, bytearray(), [None, None, 0], [0, 0, 0]
                if not copies:
                    continue
                if turn is not None and turn != turns[1]:
                    turns = [turn if turns[0] is None else turns[0], turn, turns[2] + 1]
                if code & _GONE:
                    counts[0] += copies
                    codes += bytes([code]) * copies
                else:
                    counts[1] += copies - (not seen)
                    counts[2] += not seen and bool(code & _CUT)
                    codes += (b"" if seen else bytes([code])) + bytes([code & _INITIAL | _GONE]) * (copies - (not seen))
            if len(done) >= 1000:
                yield _batch(done, names, arrow)
                done = []
        if started:
            done.append(finish(current, codes, turns, counts))
            yield _batch(done, names, arrow)

    return ordered.mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str], conv_type: pa.DataType) -> pa.RecordBatch:
    types = [conv_type, *[pa.int64()] * 6, *[pa.string()] * (len(names) - 7)]
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def repaired_rows(audit: str, rows: Iterable[tuple[str, str, int]]) -> Iterator[tuple[str, str]]:
    """Role and text of the repaired rows; ``rows`` are (role, text, copies) in order, read once."""
    state, at = START, 0
    for role, text, copies in rows:
        while copies:
            letter = audit[at]
            at += 1
            if letter == "I" or letter == "R":
                yield NEW_ROLE[state], "" if letter == "I" else text
                state = _NEXT[state]
            elif letter == "K":
                yield role, text
                state = _KEPT["sua".find(role[:1])][state]
            copies -= letter != "I"
    for _ in audit[at:]:
        yield NEW_ROLE[state], ""
        state = _NEXT[state]


def _hashes(audits: DataFrame, rows: DataFrame) -> DataFrame:
    """Add the SHA-256 of each repaired conversation; its texts follow its edit list in a sorted partition."""
    counted = [c for c in audits.columns if c != "conv_id"]
    lists = audits.withColumn("place", F.lit(0)).select(
        "conv_id", "place", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("message"), *counted,
        F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).cast("long").alias("copies"))
    types = dict(audits.dtypes)
    texts = rows.where("copies > 0").select(
        "conv_id", F.lit(1).alias("place"), "turn", _message().alias("message"), *[F.lit(None).cast(types[c]).alias(c) for c in counted], "role", "text", "copies")
    ordered = lists.unionByName(texts).repartition("conv_id").sortWithinPartitions(*_order())
    schema = _RESULT.format(types["conv_id"]) + ", repaired_sha256 string"
    names = [part.split()[0] for part in schema.split(", ")]

    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield from zip(*[part.column(c).to_pylist() for c in ("place", "conv_id", *counted, "role", "text", "copies")], strict=True)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow: list[pa.DataType] = []

        def seen() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                arrow.append(batch.schema.field("conv_id").type) if not arrow else None
                yield batch

        rows = stream(seen())
        head = next(rows, None)
        done: list[tuple] = []
        while head is not None:
            following: list[tuple | None] = [None]

            def own() -> Iterator[tuple[str, str, int]]:
                for row in rows:
                    if not row[0]:
                        following[0] = row
                        return
                    yield row[-3:]

            digest, parted = hashlib.sha256(), False
            for role, text in repaired_rows(head[1 + len(counted)], own()):
                digest.update(f"{chr(10) if parted else ''}{role}:{text}".encode())
                parted = True
            done.append((*head[1:2 + len(counted)], digest.hexdigest()))
            head = following[0]
            if len(done) >= 1000:
                yield _batch(done, names, arrow[0])
                done = []
        if done:
            yield _batch(done, names, arrow[0])

    return ordered.mapInArrow(run, schema)


def repair(rows: DataFrame) -> DataFrame:
    """Counts, cost, edit list and hash of each conversation of ``damage``'s columns."""
    return _hashes(_audits(row_codes(rows)), rows)
