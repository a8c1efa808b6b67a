"""Token ids of whole text columns with a public tokenizer file.

The tokenizers library needs about a microsecond for every byte. Words repeat, so
a text is cut at places where the tokenizer's own pre-tokenizer always cuts, each
distinct piece is encoded by the library once for each worker, and the ids of a text are
gathered with numpy. The ids equal those of encoding the whole text; texts with
doubled spaces or other unusual white space are cut less finely. A text that holds the
string of an added token, such as '<|endoftext|>', goes to the library whole, which
gives that token's id.
"""

from __future__ import annotations

import itertools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PARTS_KEPT = 1_500_000  # remembered parts of a worker; beyond it the memory is emptied, results stay the same
_TAIL = ".,;:!?)"
_WORD = r"^(?P<feed>\n?)(?P<stem>[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{17f}]+)(?P<tail>[.,;:!?)]*)$"
_SPACE = "\u0120"  # a leading space in the names of byte-level tokens
_JOINED = 256
_CALL = 1 << 14  # parts encoded in one call
AT_ONCE = 6 << 20  # bytes of text that are cut and gathered at once
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_ENCODERS: dict[str, PieceEncoder] = {}


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(name: str) -> PieceEncoder:
    """The worker's encoder for a tokenizer file, made once in each Python worker."""
    if name not in _ENCODERS:
        _ENCODERS[name] = PieceEncoder(tokenizer_path(name))
    return _ENCODERS[name]


class PieceEncoder:
    """Encodes string columns; keeps the ids of the parts of words it has met."""

    def __init__(self, path: str, kept: int = PARTS_KEPT) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = "|".join(map(re.escape, added))  # looked for in any case: a normalizer may lower letters first
        self.kept = kept
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.by_end = bool(suffix)
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word, or else that begin one
        for token, i in vocabulary.items():
            self.edge[i] = token.endswith(suffix) if suffix else token.startswith(_SPACE)
        feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.feed = feed[0] if len(feed) == 1 else len(self.edge)  # else an id that never comes
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = np.empty(1 << 16, np.uint32)
        self.starts = np.empty(1 << 14, np.int64)
        self.lengths = np.empty(1 << 14, np.int64)
        self.used = 0

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and each text's number of ids. Null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        ends = np.cumsum(np.asarray(pc.binary_length(texts)))
        found = [(np.empty(0, np.uint32), np.empty(0, np.int64))]
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, side="right")))
            found.append(self._encode_some(pc.take(texts, pa.array(np.arange(at, stop)))))
            at = stop
        return np.concatenate([ids for ids, _ in found]), np.concatenate([counts for _, counts in found])

    def _encode_some(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Texts that hold added tokens whole, the others cut."""
        marked = pc.match_substring_regex(texts, self.added, ignore_case=True) if self.added else None
        if marked is None or not pc.any(marked).as_py():
            return self._encode(texts)
        ids, counts = self._encode(pc.if_else(marked, pa.scalar("", pa.large_string()), texts))
        starts, found, used = np.cumsum(counts) - counts, [ids], len(ids)
        for row in np.flatnonzero(np.asarray(marked)).tolist():
            own = np.array(self.tokenizer.encode(texts[row].as_py(), add_special_tokens=False).ids, np.uint32)
            found.append(own)
            starts[row], counts[row], used = used, len(own), used + len(own)
        return _gather(np.concatenate(found), starts, counts)[0], counts

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.place) > self.kept:
            self._forget()
        # a line feed stays at the head of the piece behind it, which then has no space before it
        pieces = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        bounds = np.asarray(pieces.offsets)
        coded = pieces.flatten().dictionary_encode()
        words = coded.dictionary
        # Each row of the table below is a sequence of parts: first a row for every distinct piece with
        # its space, then one for the opening piece of every text, then those of oddly spaced texts.
        sequences, loose = self._sequences(words)
        rows = np.asarray(coded.indices).astype(np.int64)
        first = bounds[:-1]
        loose_text = np.flatnonzero(np.add.reduceat(loose[rows].astype(np.int64), first))
        opening = pc.take(words, pa.array(rows[first])).to_pylist()
        sequences = sequences.with_more([_parts(x) for x in opening], self._places)
        rows[first] = len(words) + np.arange(len(texts))
        if len(loose_text):
            rows, bounds, sequences = self._with_loose(rows, bounds, texts, loose_text, sequences)
        ids, lengths = _gather(self.ids, self.starts[sequences.parts], self.lengths[sequences.parts])
        ends = np.concatenate([[0], np.cumsum(lengths)])
        cuts = np.concatenate([[0], np.cumsum(sequences.counts)])
        begin = ends[cuts]
        ids, lengths = _gather(ids, begin[rows], (begin[1:] - begin[:-1])[rows])
        total = np.concatenate([[0], np.cumsum(lengths)])
        return ids, total[bounds[1:]] - total[bounds[:-1]]

    def _sequences(self, words: pa.Array) -> tuple[_Sequences, np.ndarray]:
        """The parts of each piece, its space before it; and which pieces touch white space."""
        cut = pc.extract_regex(words, _WORD)
        odd = np.flatnonzero(np.asarray(pc.is_null(cut)))
        odd_words = pc.take(words, pa.array(odd)).to_pylist()
        loose = np.zeros(len(words), bool)
        loose[odd] = [not w or w == "\n" or w[0].isspace() and w[0] != "\n" or w[-1].isspace() or w[1:2].isspace() for w in odd_words]
        feed, stem, tail = (pc.fill_null(pc.struct_field(cut, name), "") for name in ("feed", "stem", "tail"))
        fed, tailed = (np.asarray(pc.greater(pc.binary_length(x), 0)) for x in (feed, tail))
        if self.by_end:  # the tokenizer itself lowers letters and drops spaces
            stem, spaced = pc.utf8_lower(stem), np.ones(len(words), bool)
        else:
            spaced = ~fed
        stem_part = np.zeros(len(words), np.int64)
        for of, before in ((spaced, " "), (~spaced, "")):
            if of.any():
                coded = stem.filter(pa.array(of)).dictionary_encode()
                known = self._places([before + x for x in coded.dictionary.to_numpy(zero_copy_only=False)], bool(before))
                stem_part[of] = known[np.asarray(coded.indices)]
        coded = tail.dictionary_encode()
        tail_part = self._places(list(coded.dictionary.to_numpy(zero_copy_only=False)))[np.asarray(coded.indices)]
        odd_parts = [_parts(x if x[:1] == "\n" else " " + x) for x in odd_words]
        counts = 1 + tailed.astype(np.int64) + fed
        counts[odd] = [len(x) for x in odd_parts]
        ends = np.cumsum(counts)
        parts = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
        parts[(ends - counts)[fed]] = self._places(["\n"])[0]
        plain = np.ones(len(words), bool)
        plain[odd] = False
        parts[(ends - counts + fed)[plain]] = stem_part[plain]
        parts[(ends - 1)[tailed]] = tail_part[tailed]
        if len(odd):
            parts[np.repeat((ends - counts)[odd] - np.cumsum(counts[odd]) + counts[odd], counts[odd]) + np.arange(int(counts[odd].sum()))] = (
                self._places([x for cut_word in odd_parts for x in cut_word]))
        return _Sequences(parts, counts), loose

    def _with_loose(self, rows, bounds, texts, which, sequences):
        """Replace the pieces of texts with doubled spaces by pieces cut only at single spaces between other characters."""
        base = len(sequences.counts)
        cuts = []
        for text in pc.take(texts, pa.array(which)).to_pylist():
            cut = _SAFE_SPACE.split(text) if text else []
            cuts.append([_parts(x if not i else " " + x) for i, x in enumerate(cut)])
        sequences = sequences.with_more([x for cut in cuts for x in cut], self._places)
        counts, new, at, done = np.diff(bounds), [], base, 0
        for row, cut in zip(which.tolist(), cuts, strict=True):
            new += [rows[done:bounds[row]], np.arange(at, at + len(cut))]
            at, done, counts[row] = at + len(cut), bounds[row + 1], len(cut)
        new.append(rows[done:])
        return np.concatenate(new), np.concatenate([[0], np.cumsum(counts)]), sequences

    def _places(self, parts: list[str], letters: bool = False) -> np.ndarray:
        """Where each part's ids are kept. letters: each is a space and then only letters."""
        places = np.fromiter(map(self.place.get, parts, itertools.repeat(-1)), np.int64, len(parts))
        missing = np.flatnonzero(places < 0)
        if len(missing):
            wanted = [parts[i] for i in missing.tolist()]
            self._encode_parts(list(dict.fromkeys(wanted)), letters)
            places[missing] = np.fromiter(map(self.place.__getitem__, wanted), np.int64, len(wanted))
        return places

    def _encode_parts(self, fresh: list[str], letters: bool) -> None:
        """Let the library encode parts; those whose ids can be told apart again go there together."""
        spaced, fed, alone = (fresh, [], []) if letters else ([], [], fresh)
        if not letters and not self.by_end:
            alone = []
            for x in fresh:
                bare = x[1:] if x[:1] == " " else x
                (alone if bare.split() != [bare] else spaced if x[:1] == " " else fed).append(x)
        for some, between, keep in ((spaced, "", self._keep_joined), (fed, "\n", self._keep_fed)):
            groups = [some[at:at + _JOINED] for at in range(0, len(some), _JOINED)]
            for called, coded in self._coded(groups, _CALL // _JOINED, between):
                for group, ids in zip(called, coded, strict=True):
                    keep(group, np.array(ids, np.uint32))
        for called, coded in self._coded([[x] for x in alone], _CALL):
            self._keep(list(itertools.chain.from_iterable(called)), np.fromiter(itertools.chain.from_iterable(coded), np.uint32), np.fromiter(map(len, coded), np.int64, len(coded)))

    def _coded(self, groups: list[list[str]], at_once: int, between: str = ""):
        """Some groups of parts at a time with the ids of each group; the library's results are large."""
        for at in range(0, len(groups), at_once):
            called = groups[at:at + at_once]
            yield called, [x.ids for x in self.tokenizer.encode_batch_fast([between.join(x) for x in called], add_special_tokens=False)]

    def _keep_joined(self, group: list[str], ids: np.ndarray) -> None:
        """Parts that each begin with a space and hold no other."""
        at = np.flatnonzero(self.edge[ids])
        lengths = np.diff(at, prepend=-1) if self.by_end else np.diff(at, append=len(ids))
        if len(at) == len(group) and lengths.sum() == len(ids):
            self._keep(group, ids, lengths)
        else:  # a part without an edge of its own
            self._keep_alone(group)

    def _keep_fed(self, group: list[str], ids: np.ndarray) -> None:
        """Parts without white space, a line feed between them."""
        feeds = np.flatnonzero(ids == self.feed)
        lengths = np.diff(feeds, prepend=-1, append=len(ids)) - 1
        if len(lengths) == len(group) and lengths.all():
            self._keep(group, np.delete(ids, feeds), lengths)
        else:
            self._keep_alone(group)

    def _keep_alone(self, group: list[str]) -> None:
        for x in group:
            own = np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, np.uint32)
            self._keep([x], own, np.array([len(own)]))

    def _keep(self, parts: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        base, have = len(self.place), self.used
        self.used += len(ids)
        self.ids = _room(self.ids, self.used)
        self.starts, self.lengths = _room(self.starts, base + len(parts)), _room(self.lengths, base + len(parts))
        self.ids[have:self.used] = ids
        self.starts[base:base + len(parts)] = have + np.cumsum(lengths) - lengths
        self.lengths[base:base + len(parts)] = lengths
        self.place.update(zip(parts, range(base, base + len(parts)), strict=True))


class _Sequences:
    """Sequences of parts, one after the other."""

    def __init__(self, parts: np.ndarray, counts: np.ndarray) -> None:
        self.parts, self.counts = parts, counts

    def with_more(self, cuts: list[list[str]], places) -> _Sequences:
        return _Sequences(
            np.concatenate([self.parts, places([x for cut in cuts for x in cut])]),
            np.concatenate([self.counts, np.fromiter(map(len, cuts), np.int64, len(cuts))]))


def _gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of values one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(values)) < 1 << 31 else np.int64
    at = np.arange(total, dtype=kind)
    at += np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    return values[at], lengths


def _room(have: np.ndarray, size: int) -> np.ndarray:
    if size <= len(have):
        return have
    wider = np.empty(max(size, 2 * len(have)), have.dtype)
    wider[:len(have)] = have
    return wider


def _parts(piece: str) -> list[str]:
    """Cut a piece further where the tokenizer surely cuts: around a lone line feed, and before closing marks after a letter."""
    lines = piece.split("\n")
    if len(lines) > 1 and any(not x or x[0].isspace() and (i or x == " ") or x[-1].isspace() for i, x in enumerate(lines)):
        return [piece]
    out = []
    for i, line in enumerate(lines):
        if i:
            out.append("\n")
        stem = line.rstrip(_TAIL)
        if stem and len(stem) < len(line) and stem[-1].isalpha():
            out += [stem, line[len(stem):]]
        else:
            out.append(line)
    return out
