"""Toxicity by a weighted finite-state grammar over clauses.

Each word of a clause is read as one of six symbols: insult, threat, target,
negation, reported speech, or other. One small transducer for each of negation,
reported speech and target tells by which factor an insult or threat counts in its
state; they are composed into one machine. A clause scores the sum of its words'
weights times the machine's factors. A document's score is a logistic function of
its highest clause, of its sum and of that sum's share of the text.

Insults are learned: words and word beginnings that stand in many toxic texts of
different wording and nearly never in others of different wording, weighted by log odds.
Copies of one text share its wording, the least hash of its runs of three words, and
count once on either side. Arcs are learned
on two thirds of a sample of labelled rows of at most ``MAX_SAMPLE`` rows, the logistic
weights on the other third. All documents are scored over their whole texts.

Nulls: a null text is empty; rows of the labels without doc_id or label are left out.
A text without words gets the score of a text without matches. Repeated rows are
scored one by one. Without labels a few general insults with fixed weights serve; with
labels only what these bear out. Very long texts are scored whole.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, small_batches, text_of

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORTED = range(6)
CLASSES = {
    THREAT: "kill hurt destroy beat stab shoot burn punish töten umbringen schlagen tuer frapper détruire matar golpear destruir",
    TARGET: "you your he she they them his her their du dich dein ihr euch sie tu te toi vous ton él ella usted tú ti ellos",
    NEGATION: "not no never neither isn't aren't don't nicht kein keine nie pas jamais ni nunca jamás",
    REPORTED: "said says wrote writes called calls quoted according sagte schrieb nannte laut dit écrit appelé selon dijo escribió llamó según",
}
SEEDS = "idiot moron stupid scum pathetic loser worthless"
SEED_WEIGHT, THREAT_WEIGHT = 5.0, 1.0
NEGATION_REACH = 3
NEGATED, QUOTED, TARGETED = 0.25, 0.5, 1.5  # factors of an insult or threat
MAX_SAMPLE = 24_000  # labelled rows that the model is fitted on
MIN_TEXTS, MIN_PRECISION = 4, 0.7
HELD_ARCS = 200_000  # different arcs that a task counts before it hands them on
PREFIXES = (4, 5, 6, 7, 8, 9)
REJECT_AT = 0.7
SHORT = 20  # words that a text counts as longer, so one word of a short text is no density
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n]")
_LETTERS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_BREAKS = frozenset(".!?;:\n")


@dataclass(frozen=True)
class Transducer:
    """States and, for each state and symbol, the next state and the factor put out."""

    step: dict[tuple[int, int], tuple[int, float]]
    states: int

    def compose(self, other: Transducer) -> Transducer:
        """Both read the same symbols; factors multiply. Only states that can be reached are kept."""
        number, todo, step = {(0, 0): 0}, [(0, 0)], {}
        while todo:
            a, b = todo.pop()
            for symbol in range(6):
                (to_a, factor_a), (to_b, factor_b) = self.step[a, symbol], other.step[b, symbol]
                if (to_a, to_b) not in number:
                    number[to_a, to_b] = len(number)
                    todo.append((to_a, to_b))
                step[number[a, b], symbol] = (number[to_a, to_b], factor_a * factor_b)
        return Transducer(step, len(number))


def _matched(symbol: int, factor: float) -> float:
    return factor if symbol in (INSULT, THREAT) else 1.0


def negation() -> Transducer:
    step = {}
    for state in range(NEGATION_REACH + 1):
        for symbol in range(6):
            after = NEGATION_REACH if symbol == NEGATION else max(0, state - 1)
            step[state, symbol] = (after, _matched(symbol, NEGATED if state else 1.0))
    return Transducer(step, NEGATION_REACH + 1)


def _remembering(what: int, seen: float, unseen: dict[int, float]) -> Transducer:
    step = {}
    for state in range(2):
        for symbol in range(6):
            step[state, symbol] = (1 if symbol == what else state, _matched(symbol, seen) if state else unseen.get(symbol, 1.0))
    return Transducer(step, 2)


def grammar() -> Transducer:
    reported, target = _remembering(REPORTED, QUOTED, {}), _remembering(TARGET, TARGETED, {THREAT: 0.5})
    return negation().compose(reported).compose(target)


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=lambda: dict.fromkeys(SEEDS.split(), SEED_WEIGHT))
    beginnings: dict[str, float] = field(default_factory=dict)
    weights: tuple[float, float, float, float] = (-4.0, 0.4, 0.5, 0.3)  # constant, highest clause, logarithms of the sum and of its density

    def __post_init__(self) -> None:
        self.machine = grammar().step
        self.classes = {word: symbol for symbol, words in CLASSES.items() for word in words.split()}

    def weight(self, word: str) -> float:
        return max(self.words.get(word, 0.0), *(self.beginnings.get(word[:n], 0.0) for n in PREFIXES))

    def matches(self, word: str) -> bool:
        return self.weight(word) > 0 or self.classes.get(word) == THREAT

    def clauses(self, text: str) -> list[float]:
        """Scores of the clauses that match."""
        found, total, state = [], 0.0, 0
        for token in _TOKEN.findall(text.lower()):
            if token in _BREAKS:
                if total:
                    found.append(total)
                total, state = 0.0, 0
                continue
            weight = self.weight(token)
            symbol = INSULT if weight else self.classes.get(token, OTHER)
            state, factor = self.machine[state, symbol]
            if symbol == INSULT:
                total += weight * factor
            elif symbol == THREAT:
                total += THREAT_WEIGHT * factor
        return [*found, total] if total else found

    def features(self, texts: pa.Array) -> np.ndarray:
        """Highest clause, logarithms of the sum and of its density; only texts with a matching word are read clause by clause."""
        out = np.zeros((len(texts), 3))
        if not len(texts):
            return out
        pieces = pc.split_pattern(texts.cast(pa.large_string()), " ")
        coded = pieces.flatten().dictionary_encode()
        hit = np.fromiter((any(self.matches(w) for w in _LETTERS.findall(p.lower())) for p in coded.dictionary.to_numpy(zero_copy_only=False)), bool)
        bounds = np.asarray(pieces.offsets)
        rows = np.flatnonzero(np.add.reduceat(hit[np.asarray(coded.indices)].astype(np.int64), bounds[:-1]))
        for row in rows.tolist():
            if clauses := self.clauses(texts[row].as_py()):
                total, words = sum(clauses), bounds[row + 1] - bounds[row]
                out[row] = max(clauses), np.log1p(total), np.log1p(100 * total / (words + SHORT))
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        constant, *others = self.weights
        return 1 / (1 + np.exp(-np.clip(constant + self.features(texts) @ np.array(others), -30, 30)))


def _arcs(text: str) -> set[str]:
    """Each word, marked by a closing $, and its beginnings."""
    found: set[str] = set()
    for word in set(_LETTERS.findall(text.lower())):
        if len(word) >= PREFIXES[0]:
            found.add(word + "$")
            found.update(word[:n] for n in PREFIXES if n <= len(word))
    return found


def _wording(text: str) -> int:
    """Least hash of the runs of three words: near copies mostly share it, other texts do not."""
    words = _LETTERS.findall(text.lower())
    n = max(1, min(3, len(words)))
    return min((zlib.crc32(" ".join(words[i:i + n]).encode()) for i in range(len(words) - n + 1)), default=zlib.crc32(text.encode()))


def _one_of_each_wording(sample: DataFrame) -> DataFrame:
    """One text of each wording and label."""
    def worded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wordings = [_wording(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("toxic"), pa.array(wordings, pa.int64())], names=["text", "toxic", "wording"])

    found = sample.select("text", "toxic").mapInArrow(worded, "text string, toxic int, wording long")
    return found.groupBy("toxic", "wording").agg(F.min("text").alias("text"))


def learn_arcs(sample: DataFrame) -> dict[str, float]:
    """Log odds of words and beginnings by different wordings of toxic texts against those of all other texts."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[int]] = {}
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                for arc in ("", *_arcs(text)):
                    found.setdefault(arc, [0, 0])[label] += 1
                if len(found) > HELD_ARCS:
                    yield _counted(found)
                    found = {}
        yield _counted(found)

    counted = _one_of_each_wording(sample).mapInArrow(count, "arc string, others long, toxic long").groupBy("arc").agg(
        F.sum("toxic").alias("toxic"), F.sum("others").alias("others"))
    rows = counted.where(f"arc = '' or (toxic >= {MIN_TEXTS} and toxic >= {MIN_PRECISION} * (toxic + others))").collect()  # bounded by the sample
    all_toxic, all_others = next(((r.toxic, r.others) for r in rows if r.arc == ""), (0, 0))
    return {r.arc: float(np.log((r.toxic + 0.5) / (all_toxic + 1)) - np.log((r.others + 0.5) / (all_others + 1))) for r in rows if r.arc}


def _counted(found: dict[str, list[int]]) -> pa.RecordBatch:
    counts = list(found.values())
    return pa.RecordBatch.from_arrays(
        [pa.array(list(found), pa.string()), *[pa.array([c[k] for c in counts], pa.int64()) for k in (0, 1)]], names=["arc", "others", "toxic"])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Newton steps; the ridge spares the constant. Weights of the features stay at 0 or above."""
    w = np.zeros(1 + x.shape[1])
    x = np.column_stack([np.ones(len(x)), x])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        pull = ridge * np.array([0.01, *np.ones(len(w) - 1)])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (y - p) - pull * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), *(max(0.0, float(v)) for v in w[1:])


def train(docs: DataFrame, labels: DataFrame, max_sample: int = MAX_SAMPLE) -> Model:
    """Fit on a seeded sample of the labelled rows; ``labels`` holds doc_id and toxic."""
    known = labels.select(F.col("doc_id").alias("labelled"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and labelled is not null")
    n = known.count()
    if not n:
        return Model()
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), "labelled"), F.lit(1_000_000))
    sampled = known.withColumn("draw", draw).where(F.col("draw") < int(1_000_000 * min(1.0, max_sample / n)))
    texts = docs.select("doc_id", text_of().alias("text"))
    sample = texts.join(sampled, texts.doc_id == sampled.labelled).select("text", "toxic", (F.col("draw") % 3 != 0).alias("for_arcs"))
    sample = keep(sample, "labelled")  # at most max_sample texts, read three times
    arcs = learn_arcs(sample.where("for_arcs"))
    model = Model({arc[:-1]: weight for arc, weight in arcs.items() if arc.endswith("$")})
    model.beginnings = {arc: weight for arc, weight in arcs.items() if not arc.endswith("$")}

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = model.features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*map(pa.array, x.T), batch.column("toxic")], names=["highest", "total", "density", "toxic"])

    rows = sample.where("not for_arcs").mapInArrow(measure, "highest double, total double, density double, toxic int").collect()  # four numbers a row of the sample
    y = np.array([r.toxic for r in rows], float)
    if 0 < y.sum() < len(y):
        x = np.array([[r.highest, r.total, r.density] for r in rows])
        model.weights = _logistic(x, y)
    return model


def score(docs: DataFrame, model: Model, reject_at: float = REJECT_AT) -> DataFrame:
    """doc_id, score and predicted of each document."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            scores = model.scores(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores), pa.array((scores >= reject_at).astype(np.int32))], names=["doc_id", "score", "predicted"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return texts.mapInArrow(run, "doc_id long, score double, predicted int")


def clean(docs: DataFrame, model: Model, reject_at: float = REJECT_AT) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all columns."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = pc.fill_null(batch.column("text").cast(pa.string()), "")
            yield batch.filter(pa.array(model.scores(texts) < reject_at))

    return docs.mapInArrow(run, docs.schema)


def held_out() -> Column:
    """The rows whose labels are never learned: crc32 of doc_id as text leaves 1 modulo 3."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
