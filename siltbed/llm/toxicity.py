"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer reads a word and writes its class: insult, threat, target (whom it is aimed at), negation, reported
speech, or other. Three small transducers over classes are composed into one machine that runs over a clause:

* negation marks an insult or threat that follows a negation within a few words,
* reported speech marks what follows a verb of saying in the same clause,
* attack weighs what is left: an insult counts by its weight, more if a target stands in the clause; a threat counts
  only if it has a target; marked ones count for less.

Clauses, not words, are scored. Insults are stems learned from labelled texts; the other classes are fixed lists. A
logistic curve over the clause scores of a text, fitted to the same labelled texts, gives its score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.session import scratch_path

#: Labelled rows that are learned from, in expectation; chosen by a hash of the id.
TRAINING_ROWS = 12_000
THRESHOLD = 0.7
#: A stem must stand in so many toxic training texts, at least, and in so many of each thousand of them.
LEAST_TOXIC = 3
LEAST_PER_THOUSAND = 4
#: A stem's texts must be toxic so often.
PRECISION = 0.95
STEM_LENGTHS = range(3, 9)
NEGATION_REACH = 3

# Words of the classes that are not learned (English, German, French, Spanish).
TARGETS = frozenset("you your yours yourself u du dich dir dein deine ihr euch tu toi te vous ton votre tú ti usted tus".split())
NEGATIONS = frozenset("not never no nobody isn aren wasn nicht kein keine nie pas jamais aucun nunca jamás tampoco".split())
REPORTS = frozenset(
    "said says wrote claimed reported quoted called sagte sagt schrieb behauptete dit disait écrit dijo dice escribió".split()
)
THREATS = frozenset(
    "kill hurt destroy shoot stab murder umbringen töten erschießen tuer frapper détruire matar golpear destruir".split()
)

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = "-", "I", "H", "T", "N", "R"
WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[.!?;:\n]+")


@dataclass
class Transducer:
    """Deterministic: ``arcs[state][symbol]`` is (next state, output, scale, extra); ``start`` is 0."""

    arcs: list[dict[str, tuple[int, str, float, float]]] = field(default_factory=list)

    def step(self, state: int, symbol: str) -> tuple[int, str, float, float]:
        return self.arcs[state].get(symbol) or self.arcs[state].get("*", (state, symbol, 1.0, 0.0))


def compose(first: Transducer, second: Transducer, alphabet: str) -> Transducer:
    """The machine that feeds the first one's output to the second; scales multiply, extras add."""
    found, order, arcs = {(0, 0): 0}, [(0, 0)], []
    for p, q in order:
        own = {}
        for symbol in alphabet:
            p2, middle, s1, e1 = first.step(p, symbol)
            q2, out, s2, e2 = second.step(q, middle)
            if (p2, q2) not in found:
                found[p2, q2] = len(order)
                order.append((p2, q2))
            own[symbol] = (found[p2, q2], out, s1 * s2, e1 + e2)
        arcs.append(own)
    return Transducer(arcs)


def negation_machine() -> Transducer:
    """State k > 0: a negation stands at most NEGATION_REACH - k + 1 words back."""
    arcs = []
    for state in range(NEGATION_REACH + 1):
        after, scale = max(0, state - 1), 0.25 if state else 1.0
        arcs.append({
            NEGATION: (NEGATION_REACH, OTHER, 1.0, 0.0), INSULT: (after, INSULT, scale, 0.0),
            THREAT: (after, OTHER if state else THREAT, 1.0, 0.0), TARGET: (after, TARGET, 1.0, 0.0),
            REPORT: (after, REPORT, 1.0, 0.0), OTHER: (after, OTHER, 1.0, 0.0),
        })
    return Transducer(arcs)


def speech_machine() -> Transducer:
    heard = {INSULT: (1, INSULT, 0.5, 0.0), THREAT: (1, OTHER, 1.0, 0.0), REPORT: (1, OTHER, 1.0, 0.0)}
    return Transducer([{REPORT: (1, OTHER, 1.0, 0.0)}, heard])


def attack_machine() -> Transducer:
    """States: 0 nothing, 1 target, 2 insult, 3 threat, 4 target and attack."""
    aimed, threat = 1.0, 4.0
    return Transducer([
        {INSULT: (2, INSULT, 1.0, 0.0), THREAT: (3, OTHER, 0.0, 0.0), TARGET: (1, OTHER, 0.0, 0.0)},
        {INSULT: (4, INSULT, 1.0, aimed), THREAT: (4, OTHER, 0.0, threat)},
        {TARGET: (4, OTHER, 0.0, aimed)},
        {INSULT: (2, INSULT, 1.0, 0.0), TARGET: (4, OTHER, 0.0, threat)},
        {THREAT: (4, OTHER, 0.0, threat)},
    ])


ALPHABET = OTHER + INSULT + THREAT + TARGET + NEGATION + REPORT
GRAMMAR = compose(compose(negation_machine(), speech_machine(), ALPHABET), attack_machine(), ALPHABET)
FIXED = (dict.fromkeys(TARGETS, (TARGET, 0.0)) | dict.fromkeys(NEGATIONS, (NEGATION, 0.0))
         | dict.fromkeys(REPORTS, (REPORT, 0.0)) | dict.fromkeys(THREATS, (THREAT, 0.0)))


class Lexicon:
    """The lexical transducer: the longest learned stem that begins a word, else the fixed lists."""

    def __init__(self, stems: dict[str, float]):
        self.stems = stems
        self.known = dict(FIXED)

    def read(self, word: str) -> tuple[str, float]:
        if (found := self.known.get(word)) is None:
            weights = [self.stems[word[:n]] for n in STEM_LENGTHS if word[:n] in self.stems]
            found = (INSULT, max(weights)) if weights else (OTHER, 0.0)
            if len(self.known) > 500_000:
                self.known = dict(FIXED)
            self.known[word] = found
        return found


def clause_score(words: list[str], lexicon: Lexicon) -> float:
    """The weight of the path that the composed machine takes through the clause."""
    state, total = 0, 0.0
    for word in words:
        symbol, weight = lexicon.read(word)
        state, _, scale, extra = GRAMMAR.arcs[state][symbol]
        if symbol == INSULT:
            total += scale * weight
        total += extra
    return total


def measures(text: str | None, lexicon: Lexicon) -> tuple[float, float, float]:
    """Of a text's matched clauses: the largest score, the logarithm of their sum, the logarithm of their number."""
    low = (text or "").lower()
    if not any(lexicon.read(w)[0] in (INSULT, THREAT) for w in set(WORD.findall(low))):
        return 0.0, 0.0, 0.0
    scores = [s for c in CLAUSE.split(low) if (s := clause_score(WORD.findall(c), lexicon)) > 0]
    return (max(scores), math.log1p(sum(scores)), math.log1p(len(scores))) if scores else (0.0, 0.0, 0.0)


@dataclass(frozen=True)
class Model:
    stems: dict[str, float]
    coefficients: tuple[float, ...]


def stems_of(text: str | None) -> set[str]:
    return {w[:n] for w in set(WORD.findall((text or "").lower())) for n in STEM_LENGTHS if len(w) >= n}


def _stem_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    toxic, clean = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch["text"], batch["toxic"]):
            (toxic if label == 1 else clean).update(stems_of(text))
    # Stems of clean texts matter only where they may meet a toxic one; which is known after the sum over all tasks.
    stems = [*toxic.keys(), *(clean.keys() - toxic.keys())]
    yield pd.DataFrame({"stem": stems, "toxic": [toxic[s] for s in stems], "clean": [clean[s] for s in stems]})


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, steps: int = 40) -> tuple[float, ...]:
    """Logistic regression by Newton's method with a small ridge, so separable labels end too."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        slope = x.T @ (y - p) - ridge * b
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)), slope)
        b += np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-8:
            break
    return tuple(b.tolist())


def rising_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """The curve over those measures that raise the score; a measure that would lower it is left out, worst first."""
    used = list(range(x.shape[1]))
    while True:
        b = fit_curve(x[:, used], y)
        if not used or min(b[1:]) >= 0:
            whole = np.zeros(x.shape[1])
            whole[used] = b[1:]
            return (b[0], *whole.tolist())
        used.pop(int(np.argmin(b[1:])))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from a documented number of labelled rows, never from those whose crc32(doc_id as text) mod 3 is 1.

    Null labels and ids and texts that don't exist are left out; labels that contradict each other count as toxic;
    equal texts count once. With no toxic or no clean row the model has no stems and scores 0 to all but threats.
    """
    spark = docs.sparkSession
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (third != 1))
    scale = 1 << 20
    rate = min(scale, -(-scale * TRAINING_ROWS // max(1, known.count())))
    known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < rate)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    path = scratch_path(spark, "toxicity")
    # At most TRAINING_ROWS rows in expectation.
    docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("text").agg(
        F.max("toxic").alias("toxic")
    ).write.parquet(path)
    sample = spark.read.parquet(path)
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Model({}, (-3.0, 0.0, 1.0, 0.0))
    least = max(LEAST_TOXIC, n_toxic * LEAST_PER_THOUSAND // 1000)
    counted = sample.mapInPandas(_stem_counts, "stem string, toxic long, clean long").groupBy("stem").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    )
    # Precision as if toxic and clean texts were as many. What passes is a small part of a bounded sample's stems.
    precise = F.col("toxic") / n_toxic >= PRECISION / (1 - PRECISION) * (F.col("clean") + 0.1) / n_clean
    rows = counted.filter((F.col("toxic") >= least) & precise).collect()
    found = {r.stem: r for r in rows}
    stems = {}
    for stem, r in found.items():
        shorter = [found[stem[:n]] for n in STEM_LENGTHS if n < len(stem) and stem[:n] in found]
        longer_same = any(len(s) > len(stem) and s.startswith(stem) and o.toxic == r.toxic for s, o in found.items())
        if longer_same or any(o.toxic > r.toxic for o in shorter):
            continue  # of stems with the same texts the longest, of nested ones the wider
        stems[stem] = math.log((r.toxic + 0.5) / (n_toxic + 1)) - math.log((r.clean + 0.5) / (n_clean + 1))
    points = sample.select(F.col("toxic").cast("double"), measure_udf(stems)("text").alias("m")).select("toxic", "m.*")
    table = np.array([tuple(r) for r in points.collect()], float)
    return Model(stems, rising_curve(table[:, 1:], (table[:, 0] == 1).astype(float)))


def measure_udf(stems: dict[str, float]):
    @F.pandas_udf("most double, total double, clauses double")
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(stems)
        for texts in batches:
            yield pd.DataFrame([measures(t, lexicon) for t in texts], columns=["most", "total", "clauses"], dtype=float)

    return measured


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score, predicted and the clause measures in struct ``clauses``; columns of these names are replaced.

    Null and empty texts match no clause and get the curve's lowest score; repeated rows are scored each; an empty table
    stays empty. No row moves between tasks.
    """
    b = model.coefficients
    line = F.lit(b[0])
    for value, name in zip(b[1:], ("most", "total", "clauses")):
        line = line + F.lit(value) * F.col(f"clauses.{name}")
    out = docs.withColumn("clauses", measure_udf(model.stems)(F.col(text)))
    out = out.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.least(line, F.lit(30.0)), F.lit(-30.0)))))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
