"""Toxicity by a weighted finite-state grammar over clauses.

Words are read as sets of marks: insult, threat, target, negation, report. Insult words and word
beginnings are learned from labelled documents, next to a fixed lexicon; the other marks come from
fixed words of four languages, and a word may have several. Five transducers over these marks (insult,
threat, target, negation, reported speech), each a table of arcs, are composed into one. It reads a
clause and gives each match the marks of its context: whether the clause has a target, whether a
negation reaches it, whether it is reported. A clause's matches add their weights to arcs, and the arcs'
weights are fitted, around priors that hold where data say nothing, on labelled documents that gave no pattern.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, sliced

#: Labelled documents that training reads, about; all where there are fewer.
SAMPLE = 20_000
#: Documents that a pattern is in at least, its share of toxic ones at least, lengths of word beginnings.
LEAST_DOCS, LEAST_SHARE, BEGINNINGS = 4, 0.4, tuple(range(4, 13))
#: Log-likelihood ratio that a pattern reaches at least, as so many are tried that some would be in toxic documents alone by chance.
LEAST_RATIO = 25.0
#: Clean documents that a pattern is taken to be in besides those of the sample.
CLEAN = 2.0
THRESHOLD = 0.3
#: Words that a negation reaches.
REACH = 3
STRIP = ".,;:!?\"'()[]{}<>*#$%&|_-"
#: A colon ends no clause, as what is reported often follows one.
CLAUSE_END = (b".", b"!", b"?", b";")
#: Words with their marks that a task keeps, and words of the clauses that it keeps.
KEPT_WORDS, KEPT_CLAUSE = 400_000, 64

# Closed-class words, verbs of threat and common insults of the four languages.
TARGETS = frozenset("you your yours he she they him her them this that these those is are du dein ihr sie er ihn ist sind bist tu ton vous votre il elle ils toi est sont es tú tu usted él ella ellos eres son".split())
NEGATIONS = frozenset("not no never don't isn't aren't wasn't without kein keine keinen nicht nie niemals ne pas jamais sans nunca jamás sin".split())
REPORTS = frozenset("said says wrote called quoted reportedly claimed sagte sagt schrieb nannte dit écrit appelé dijo dice escribió llamó".split())
THREATS = frozenset("kill hurt destroy beat burn shoot strangle töten umbringen schlagen zerstören verbrennen tuer frapper détruire brûler matar golpear destruir quemar".split())
INSULTS = frozenset("idiot idiots moron morons imbecile bastard scumbag dumbass dummkopf trottel arschloch vollidiot hurensohn connard connasse imbécile crétin salaud abruti idiota idiotas imbécil gilipollas cabrón pendejo".split())
#: Weight of the fixed insults and of threats, as of a pattern that is about twenty times likelier in toxic texts.
GIVEN = 3.0

INSULT, THREAT, TARGET, NEGATION, REPORT = 1, 2, 4, 8, 16
TARGETED, NEGATED, REPORTED = 32, 64, 128
#: What a document is scored by, and the mean, the precision and the least size of each weight's prior; the signs are fixed.
ARCS = ("insult", "threat", "targeted", "negated", "reported", "rate", "most")
PRIOR_MEAN = np.array([1.0, 1.0, 0.3, -0.8, -0.6, 0.5, 0.3])
PRIOR_PRECISION = np.array([1.0, 4.0, 4.0, 4.0, 4.0, 1.0, 1.0])
LEAST_WEIGHT = 0.05


@dataclass
class Transducer:
    """States are any values; arcs lead from (state, symbol read) to (state, symbol written); symbols are sets of marks."""

    starts: list
    finals: set
    arcs: dict = field(default_factory=dict)


def _machine(starts: list, finals: set, states: list, symbols: list[int], step) -> Transducer:
    return Transducer(starts, finals, {(s, x): to for s in states for x in symbols if (to := step(s, x)) is not None})


def negation(symbols: list[int], reach: int = REACH) -> Transducer:
    """Marks what a negation reaches: the words behind it, or before its last word where it is doubled."""
    return _machine([0], set(range(reach + 1)), list(range(reach + 1)), symbols, lambda s, x: (reach if x & NEGATION else max(0, s - 1), x | NEGATED if s and x & (INSULT | THREAT) else x))


def reported(symbols: list[int]) -> Transducer:
    """Marks what follows a verb of report in its clause."""
    return _machine([0], {0, 1}, [0, 1], symbols, lambda s, x: (1 if s or x & REPORT else 0, x | REPORTED if s and x & (INSULT | THREAT) else x))


def target(symbols: list[int]) -> Transducer:
    """Guesses at the start whether the clause has a target; only the right guess is accepted, so each clause has one path."""

    def step(state: str, x: int):
        if state == "none":
            return None if x & TARGET else ("none", x)
        return ("seen" if state == "seen" or x & TARGET else "awaited", x | TARGETED if x & (INSULT | THREAT) else x)

    return _machine(["none", "awaited"], {"none", "seen"}, ["none", "awaited", "seen"], symbols, step)


def kept(symbols: list[int], mark: int, least: int) -> Transducer:
    """The insult and threat transducers: a match passes with its context, everything else of its mark is dropped."""
    return _machine([0], {0}, [0], symbols, lambda s, x: (0, x if x & least else x & ~mark))


def compose(a: Transducer, b: Transducer) -> Transducer:
    """What b makes of what a writes; states are the reachable pairs."""
    starts = [(s, t) for s in a.starts for t in b.starts]
    out, todo, seen = Transducer(starts, set()), list(starts), set(starts)
    by_state: dict = {}
    for (s, x), (to, y) in a.arcs.items():
        by_state.setdefault(s, []).append((x, to, y))
    while todo:
        s, t = todo.pop()
        if s in a.finals and t in b.finals:
            out.finals.add((s, t))
        for x, to, y in by_state.get(s, ()):
            arc = b.arcs.get((t, y))
            if arc is not None:
                nxt = (to, arc[0])
                out.arcs[(s, t), x] = (nxt, arc[1])
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
    return out


def grammar_machine() -> Transducer:
    """Negation, report, target, insult and threat transducers in one."""
    plain = list(range(32))
    marked = [x | c for x in plain for c in range(0, 256, 32)]
    whole = compose(negation(plain), reported(marked))
    whole = compose(whole, target(marked))
    return compose(compose(whole, kept(marked, INSULT, INSULT)), kept(marked, THREAT, THREAT))


def bare(word: bytes) -> str:
    return word.decode("utf-8", "replace").lower().strip(STRIP)


def beginnings(word: str) -> list[str]:
    return [word[:n] + "*" for n in BEGINNINGS if len(word) > n]


class Grammar:
    """The lexicon and the composed machine; what they make of a word or of a clause's marks is kept, as these recur."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.lengths = sorted({len(p) - 1 for p in weights if p.endswith("*")}, reverse=True)
        self.heads = {p[:3] for p in weights}
        self.machine = grammar_machine()
        self.read: dict[bytes, tuple[int, float]] = {}
        self.clauses: dict[tuple[int, ...], list[tuple[int, int]]] = {}

    def word(self, word: bytes) -> tuple[int, float]:
        """(marks, weight) of a word; the weight is that of the longest pattern that it has."""
        text = bare(word)
        weight = 0.0
        if text[:3] in self.heads:
            found = text if text in self.weights else next((p for n in self.lengths if len(text) > n and (p := text[:n] + "*") in self.weights), None)
            weight = self.weights[found] if found else 0.0
        marks = (INSULT if weight or text in INSULTS else 0) | (THREAT if text in THREATS else 0) | (TARGET if text in TARGETS else 0) | (NEGATION if text in NEGATIONS else 0) | (REPORT if text in REPORTS else 0)
        return marks, weight or (GIVEN if marks & (INSULT | THREAT) else 0.0)

    def clause(self, marks: tuple[int, ...]) -> list[tuple[int, int]]:
        """(place, marks with context) of each match of a clause, along the one path that the machine accepts."""
        known = self.clauses.get(marks)
        if known is None:
            # a path's matches are linked backwards, so that a long clause takes as many steps as it has words
            paths = [(s, None) for s in self.machine.starts]
            for place, x in enumerate(marks):
                moved = []
                for state, found in paths:
                    arc = self.machine.arcs.get((state, x))
                    if arc is not None:
                        moved.append((arc[0], (found, place, arc[1]) if arc[1] & (INSULT | THREAT) else found))
                paths = moved
            (last,) = (found for state, found in paths if state in self.machine.finals)
            known = []
            while last is not None:
                last, place, out = last
                known.append((place, out))
            known.reverse()
            if len(marks) <= KEPT_CLAUSE:
                if len(self.clauses) > KEPT_WORDS:
                    self.clauses.clear()
                self.clauses[marks] = known
        return known

    def features(self, text: bytes) -> list[float]:
        """What ARCS names: weights of matches over all clauses of a whole text, damped by log1p; a text without a match has zeros.

        rate is that of matches neither negated nor reported to a hundred words; most is the heaviest clause of such.
        """
        words = text.replace(b"\n", b" . ").split()
        read = self.read
        fresh = [w for w in words if w not in read]
        if fresh:
            if len(read) > KEPT_WORDS:
                read.clear()
                fresh = words
            for w in dict.fromkeys(fresh):
                read[w] = self.word(w)
        marks = [read[w][0] for w in words]
        hits = [i for i, x in enumerate(marks) if x & (INSULT | THREAT)]
        if not hits:
            return [0.0] * len(ARCS)
        sums, own, most, end = dict.fromkeys(ARCS[:5], 0.0), 0.0, 0.0, 0
        for hit in hits:
            if hit < end:
                continue
            start, end = hit, hit + 1
            while start and not words[start - 1].endswith(CLAUSE_END):
                start -= 1
            while end < len(words) and not words[end - 1].endswith(CLAUSE_END):
                end += 1
            heavy = 0.0
            for place, x in self.clause(tuple(marks[start:end])):
                weight = read[words[start + place]][1]
                sums["insult" if x & INSULT else "threat"] += weight
                sums["targeted"] += weight * bool(x & TARGETED)
                sums["negated"] += weight * bool(x & NEGATED)
                sums["reported"] += weight * bool(x & REPORTED)
                heavy += weight * (not x & (NEGATED | REPORTED))
            own, most = own + heavy, max(most, heavy)
        return [*np.log1p(list(sums.values())).tolist(), float(np.log1p(100 * own / len(words))), float(np.log1p(most))]


def _labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """text, toxic and fold of about sample labelled rows outside the held-out part."""
    rows = labels.where(F.col("toxic").isin(0, 1) & ~held_out("doc_id", 4, 2)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, sample / max(1, rows.count()))
    rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = rows.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("toxic"), (F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3)) == 0).alias("fold"))
    return docs.select("doc_id", "text").join(rows, F.col("doc_id") == F.col("__id")).select("text", "toxic", "fold")


def pattern_counts(texts: list[bytes], toxic: list[int]) -> tuple[Counter, Counter]:
    """In how many texts each word and word beginning is, and in how many toxic ones."""
    every, bad = Counter(), Counter()
    for text, label in zip(texts, toxic, strict=True):
        own = {bare(w) for w in set(text.split())} - {""}
        own.update([b for w in own for b in beginnings(w)])
        every.update(own)
        if label:
            bad.update(own)
    return every, bad


def plain_patterns(found: dict[str, tuple[int, int, float]]) -> dict[str, float]:
    """Weights without beginnings that say no more than a longer pattern: those in the same texts as one of its extensions."""
    said = {(p[:n], *found[p][:2]) for p in found for n in range(1, len(p.rstrip("*")) + (not p.endswith("*")))}
    return {p: w for p, (n, bad, w) in found.items() if not (p.endswith("*") and (p[:-1], n, bad) in said)}


def learn_patterns(rows: DataFrame) -> dict[str, float]:
    """Weights of words and word beginnings that labelled toxic documents hold and others hold less."""
    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals.get(0) or not totals.get(1):
        return {}

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in sliced(batches):
            every, bad = pattern_counts(texts, batch.column("toxic").to_pylist())
            keys = list(every)
            yield pa.record_batch([pa.array(keys, pa.string()), pa.array([every[k] for k in keys], pa.int64()), pa.array([bad[k] for k in keys], pa.int64())], names=["pattern", "n", "bad"])

    counts = rows.select("text", "toxic").mapInArrow(emit, "pattern string, n long, bad long").groupBy("pattern").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    odds = F.log((F.col("bad") + 0.5) / (F.col("n") - F.col("bad") + CLEAN)) - float(np.log(totals[1] / totals[0]))
    base = totals[1] / (totals[0] + totals[1])
    good = F.col("n") - F.col("bad")
    ratio = 2 * (F.col("bad") * F.log(F.col("bad") / (F.col("n") * base)) + F.when(good > 0, good * F.log(F.greatest(good, F.lit(1)) / (F.col("n") * (1 - base)))).otherwise(0.0))
    often = counts.where((F.col("bad") >= LEAST_DOCS) & (F.col("bad") >= LEAST_SHARE * F.col("n")) & (F.col("bad") > base * F.col("n")))
    # the sample bounds how many patterns can be in so many of its toxic documents
    found = often.where(ratio >= LEAST_RATIO).withColumn("weight", odds).collect()
    return plain_patterns({r["pattern"]: (r["n"], r["bad"], r["weight"]) for r in found})


def fit(features: np.ndarray, toxic: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Logistic regression around the priors by Newton's steps; a weight that would cross LEAST_WEIGHT stays there. The last weight is the constant."""
    x = np.hstack([features, np.ones((len(features), 1))])
    mean, precision = np.append(PRIOR_MEAN, 0.0), np.append(PRIOR_PRECISION, 1e-6)
    sign = np.append(np.sign(PRIOR_MEAN), 0.0)
    w, free = mean.copy(), np.ones(len(mean), dtype=bool)
    while True:
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient = x.T @ (toxic - p) - precision * (w - mean)
            curve = (x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(precision)
            step = np.zeros(len(w))
            step[free] = np.linalg.solve(curve[np.ix_(free, free)], gradient[free])
            step *= min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
            w = w + step
            if np.abs(step).max() < 1e-8:
                break
        wrong = free & (sign != 0) & (w * sign < LEAST_WEIGHT)
        if not wrong.any():
            return w
        w[wrong] = sign[wrong] * LEAST_WEIGHT
        free &= ~wrong


def _features(rows: DataFrame, weights: dict[str, float], keep: list[str], schema: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(shared.value)
        for batch, texts in sliced(batches):
            found = [grammar.features(t) for t in texts]
            yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(found, pa.list_(pa.float64()))], names=[*keep, "arcs"])

    return rows.select(*keep, "text").mapInArrow(emit, f"{schema}, arcs array<double>")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, float], np.ndarray | None]:
    """(pattern weights, arc weights); no arc weights where there is no labelled row of both kinds in either fold.

    Arc weights come from a third of the sample, read with patterns of the other two thirds; then patterns are
    learned anew from all of it, as rarer languages have few toxic documents.
    """
    rows = _labelled(docs, labels, sample)
    held = _features(rows.where("fold"), learn_patterns(rows.where("NOT fold")), ["toxic"], "toxic int").toPandas()
    weights = learn_patterns(rows)
    if held["toxic"].nunique() < 2:
        return weights, None
    return weights, fit(np.array(held["arcs"].tolist()), held["toxic"].to_numpy(dtype=float))


def toxic_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    The whole text is read, however long; null and empty texts match nothing and get the score of the constant. An
    id with several labels counts as toxic if any is 1; null labels and ids are not learned from.
    Rows that repeat are scored each time and texts that tie score alike; an empty table gives no rows.
    Without labelled rows of both kinds every score is 0. Only text reaches a score.
    """
    weights, arc = train(docs, labels, sample)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = _features(docs.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "text"), weights, ["doc_id", "held_out"], f"doc_id {kind}, held_out boolean")
    if arc is None:
        score = F.lit(0.0)
    else:
        total = F.lit(float(arc[-1]))
        for i, w in enumerate(arc[:-1]):
            total = total + F.get("arcs", F.lit(i)) * float(w)
        score = 1 / (1 + F.exp(-total))
    return rows.select("doc_id", "held_out", score.alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
