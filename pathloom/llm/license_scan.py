"""Licence scans by a trained paragraph classifier.

A paragraph is a block of lines up to one without a word; comment signs are no words, and lines that a
notice is wrapped over are read as one. A logistic regression over the presence of words and word pairs
tells licence families and the class of other paragraphs apart. It is trained on notices of each family, varied by
rule, against a bounded sample of the corpus's own lines and blocks and shuffled notices. Of these, parts that
it isn't trained on set its temperature, so that probabilities are calibrated, and the probability that a family must reach.
A prediction counts once the text holds a notice of that family and of no other more, compared by shingles;
its alignment with the notice is given too.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced
from .license_texts import NOTICES

FAMILIES = sorted(NOTICES)
SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: Lines and blocks of the corpus that the class of others is learned from, about; variants of each notice; steps of the fit.
SAMPLE, VARIANTS, STEPS = 6000, 30, 120
#: Share of other paragraphs that may reach the bar.
PASSING = 0.001
#: Letters to lower case, digits to 0, other ASCII signs to spaces; a line's end stays.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b if b >= 128 or 97 <= b <= 122 or b == 10 else 32 for b in range(256))
LINE = b"\x00"


def tokens(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """All words of all texts with a mark after each line, and the number of lines of each text."""
    lines = [t.count(b"\n") + 1 for t in texts]
    return b"\n".join(texts).translate(NORMAL).replace(b"\n", b" \x00 ").split() + [LINE], np.array(lines, dtype=np.int64)


def shingles(words: list[bytes], size: int) -> set[bytes]:
    return {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(NORMAL).split()


class Templates:
    """Notices with their shingles, and what they make of words."""

    def __init__(self):
        self.rows = []
        for family in FAMILIES:
            for notice in NOTICES[family]:
                words = words_of(notice)
                n = min(SHINGLE_WORDS, len(words))
                self.rows.append((family, notice, words, n, shingles(words, n)))

    def held(self, words: list[bytes]) -> dict[str, tuple[float, int, int]]:
        """For each family the greatest share of a notice's shingles that words hold, how many shingles it has, and its number."""
        own, out = {}, {}
        for number, (family, _, _, n, wanted) in enumerate(self.rows):
            if n not in own:
                own[n] = shingles(words, n)
            share = len(wanted & own[n]) / len(wanted)
            if share and (family not in out or (share, len(wanted)) > out[family][:2]):
                out[family] = (share, len(wanted), number)
        return out

    def compare(self, words: list[bytes], family: str) -> tuple[bool, float]:
        """(confirmed, alignment): whether words hold SIMILARITY of a notice of the family, and no other family's notice more or a longer one as much; the share of that notice's words found in order."""
        held = self.held(words)
        if family not in held:
            return False, 0.0
        share, size, number = held[family]
        best = max((s, n) for s, n, _ in held.values())
        wanted = self.rows[number][2]
        matched = sum(m.size for m in SequenceMatcher(None, wanted, words, autojunk=False).get_matching_blocks())
        return share >= SIMILARITY and (share, size) >= best, matched / len(wanted)


class Wrapped:
    """Finds notices that run over several lines: neighbouring lines with words, whatever signs stand around them."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        notices = [words_of(n) for f in FAMILIES for n in NOTICES[f]]
        notices = [n for n in notices if len(n) >= SHINGLE_WORDS]
        for w in (w for n in notices for w in n):
            self.number.setdefault(w, len(self.number))
        self.base = len(self.number)
        self.notices = [(len(n), np.unique(self.keys(np.array([self.number[w] for w in n])))) for n in notices]
        self.every = np.unique(np.concatenate([k for _, k in self.notices]))
        self.number[LINE] = -2

    def keys(self, ids: np.ndarray) -> np.ndarray:
        """A number for each SHINGLE_WORDS words of ids; no two have the same."""
        out = np.zeros(max(0, len(ids) - SHINGLE_WORDS + 1), dtype=np.int64)
        for i in range(SHINGLE_WORDS):
            out = out * self.base + ids[i : i + len(out)]
        return out

    def find(self, words: list[bytes], ends: np.ndarray) -> list[tuple[int, int, list[bytes]]]:
        """(first line, last line, words) of each span over several lines of a text that holds SIMILARITY of a notice's shingles; ends has the line after each text."""
        ids = np.fromiter(map(self.number.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        mark = ids == -2
        at = np.flatnonzero(~mark)
        line, ids = (np.cumsum(mark) - mark)[at], ids[at]
        reach = SHINGLE_WORDS - 1
        if len(ids) <= reach:
            return []
        hit = np.flatnonzero(np.isin(self.keys(ids), self.every))
        hit = hit[[bool((ids[h : h + SHINGLE_WORDS] >= 0).all()) for h in hit.tolist()]] if len(hit) else hit
        if not len(hit):
            return []
        step = (np.diff(line) > 1) | (np.diff(np.searchsorted(ends, line, side="right")) > 0)
        block = np.r_[0, np.cumsum(step)]
        hit = hit[block[hit] == block[hit + reach]]
        key = self.keys(ids)[hit]
        found = {}
        for size, wanted in self.notices:
            need, own = int(np.ceil(SIMILARITY * len(wanted))), np.isin(key, wanted)
            place, kind = hit[own].tolist(), key[own].tolist()
            left, held = 0, {}
            for right, (p, k) in enumerate(zip(place, kind, strict=True)):
                held[k] = held.get(k, 0) + 1
                while block[place[left]] != block[p] or held[kind[left]] > 1:
                    held[kind[left]] -= 1
                    if not held[kind[left]]:
                        del held[kind[left]]
                    left += 1
                if len(held) >= need:
                    begin, end = place[left], p
                    for q in place[right + 1 :]:
                        if q > begin + size or block[q] != block[p]:
                            break
                        end = q
                    if line[begin] < line[end + reach]:
                        found[int(line[begin]), int(line[end + reach]), begin, end] = [words[i] for i in at[begin : end + SHINGLE_WORDS].tolist()]
                    left, held = right + 1, {}
        return [(a, b, part) for (a, b, _, _), part in sorted(found.items())]


class Classifier:
    """Weights of words and of pairs of neighbouring words for each family and, last, for other paragraphs."""

    def __init__(self, vocabulary: list[bytes], pairs: np.ndarray, weights: np.ndarray, temperature: float, bar: float):
        self.number = dict(zip(vocabulary, range(len(vocabulary)), strict=True))
        self.number[LINE] = -2
        self.pairs, self.weights, self.temperature, self.bar = pairs, weights, temperature, bar

    def features(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, feature) of each feature that a line has, once, and the line of each word."""
        ids = np.fromiter(map(self.number.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        line = np.cumsum(ids == -2) - (ids == -2)
        at = np.flatnonzero(ids >= 0)
        size, total = len(self.number) - 1, len(self.number) - 1 + len(self.pairs)
        keys = line[at] * total + ids[at]
        both = at[:-1][(np.diff(at) == 1)] if len(at) > 1 else at[:0]
        pair = ids[both] * size + ids[both + 1]
        if len(self.pairs) and len(pair):
            place = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            hit = self.pairs[place] == pair
            keys = np.concatenate([keys, line[both[hit]] * total + size + place[hit]])
        keys = np.unique(keys)
        return keys // total, keys % total, line

    def scores(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lines that have a feature, their class scores, line of each word)."""
        line, feature, of_word = self.features(words)
        lines, start = np.unique(line, return_index=True)
        if not len(lines):
            return lines, np.zeros((0, self.weights.shape[1])), of_word
        return lines, np.add.reduceat(self.weights[feature], start, axis=0) + self.weights[-1], of_word

    def probabilities(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lines that have a feature, their calibrated class probabilities, line of each word)."""
        lines, score, of_word = self.scores(words)
        return lines, softmax(score / self.temperature), of_word


def softmax(score: np.ndarray) -> np.ndarray:
    if not len(score):
        return score
    score = np.exp(score - score.max(axis=1, keepdims=True))
    return score / score.sum(axis=1, keepdims=True)


def _examples(others: list[list[bytes]], seed: int = 7) -> tuple[list[list[bytes]], np.ndarray]:
    """Varied notices of each family, shuffled notices and other paragraphs, with class numbers."""
    rng = random.Random(seed)
    rows, classes = [], []
    heads = [b"copyright 0000", b"this file is", b"notice", b"all rights reserved", b"see license"]
    for number, family in enumerate(FAMILIES):
        for notice in NOTICES[family]:
            words = words_of(notice)
            for i in range(VARIANTS):
                own = words if i % 3 == 0 or len(words) < 8 else [w for w in words if rng.random() > 0.08]
                if i % 2:
                    own = rng.choice(heads).split() + own
                rows.append(own)
                classes.append(number)
                if i % 2 and len(words) > SHINGLE_WORDS:
                    mixed = own[:]
                    rng.shuffle(mixed)
                    rows.append(mixed)
                    classes.append(len(FAMILIES))
    rows += others
    classes += [len(FAMILIES)] * len(others)
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [rows[i] for i in order], np.array([classes[i] for i in order])


def bar_of(top: np.ndarray, passing: float = PASSING) -> float:
    """The probability that a share of passing of other paragraphs reaches at most, from those of a held-out part.

    With n of them it is the ceil((n + 1) * (1 - passing))-th smallest; where there are too few for that share, half way from the largest to 1.
    """
    top = np.sort(top)
    place = int(np.ceil((len(top) + 1) * (1 - passing)))
    if place <= len(top):
        return float(np.nextafter(top[place - 1], 2.0))
    return float((top[-1] if len(top) else 0.0) + 1) / 2


def train(docs: DataFrame, sample: int = SAMPLE) -> Classifier:
    """The classifier for docs: its other paragraphs are about sample lines and blocks of all documents, the same in each run.

    Three fifths of all examples fit the weights, a fifth the temperature, and a fifth the bar.
    """
    text = F.coalesce("text", F.lit(""))
    units = docs.select(F.explode(F.array_union(F.split(text, "\n"), F.split(text, r"\n\s*\n"))).alias("p")).where(F.length(F.trim("p")) > 0)
    share = min(1.0, 2.0 * sample / max(1, units.count()))
    order = F.xxhash64("p", F.lit("licence"))
    thinned = units.where(F.pmod(order, F.lit(1 << 30)) < int(share * (1 << 30)))
    others = [words_of(r["p"]) for r in thinned.distinct().orderBy(order, "p").limit(sample).collect()]
    templates = Templates()
    others = [w for w in others if max((s for s, _, _ in templates.held(w).values()), default=0.0) < SIMILARITY]
    rows, classes = _examples(others)
    fitted, tuned = len(rows) * 3 // 5, len(rows) * 4 // 5
    # words of notices, and those that two other paragraphs have at least
    times = Counter(w for r in rows[:fitted] for w in set(r))
    noticed = dict.fromkeys(w for f in FAMILIES for n in NOTICES[f] for w in words_of(n))
    words = {w: i for i, w in enumerate([*noticed, *(w for w, n in times.items() if n > 1 and w not in noticed)])}
    vocabulary = list(words)
    size = len(vocabulary)
    seen = {words[a] * size + words[b] for r, c in zip(rows[:fitted], classes[:fitted], strict=True) if c < len(FAMILIES) for a, b in zip(r, r[1:], strict=False) if a in words and b in words}
    model = Classifier(vocabulary, np.array(sorted(seen), dtype=np.int64), np.zeros((size + len(seen) + 1, len(FAMILIES) + 1)), 1.0, 1.0)
    line, feature, _ = model.features([w for r in rows[:fitted] for w in [*r, LINE]])
    model.weights = _fit(line, feature, classes[:fitted], model.weights.shape)
    lines, score, _ = model.scores([w for r in rows[fitted:tuned] for w in [*r, LINE]])
    if len(lines):
        own = classes[fitted:tuned][lines]
        losses = [(-np.log(softmax(score / t)[np.arange(len(own)), own] + 1e-300).mean(), t) for t in np.geomspace(0.2, 5, 33).tolist()]
        model.temperature = min(losses)[1]
    lines, probability, _ = model.probabilities([w for r in rows[tuned:] for w in [*r, LINE]])
    other = classes[tuned:][lines] == len(FAMILIES)
    # a paragraph without any feature reaches nothing
    rest = int((classes[tuned:] == len(FAMILIES)).sum() - other.sum())
    model.bar = bar_of(np.r_[probability[other, :-1].max(axis=1) if other.any() else np.zeros(0), np.zeros(rest)])
    return model


def _fit(line: np.ndarray, feature: np.ndarray, classes: np.ndarray, shape: tuple[int, int], rate: float = 0.1, decay: float = 1e-4) -> np.ndarray:
    """Softmax regression on sparse rows, sorted by line, by Adam's steps over all rows."""
    n, k = len(classes), shape[1]
    wanted = np.zeros((n, k))
    wanted[np.arange(n), classes] = 1
    lines, line_start = np.unique(line, return_index=True)
    order = np.argsort(feature, kind="stable")
    features, feature_start = np.unique(feature[order], return_index=True)
    w, first, second = np.zeros(shape), np.zeros(shape), np.zeros(shape)
    for step in range(1, STEPS + 1):
        score = np.zeros((n, k)) + w[-1]
        score[lines] += np.add.reduceat(w[feature], line_start, axis=0)
        error = (softmax(score) - wanted) / n
        grad = decay * w
        grad[features] += np.add.reduceat(error[line[order]], feature_start, axis=0)
        grad[-1] = error.sum(axis=0)
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        w = w - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w


def paragraphs_of(words: list[bytes], lines_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number within its text of the paragraph of each line (-1 for a line without a word), and the number of paragraphs of each text."""
    mark = np.fromiter((w == LINE for w in words), dtype=bool, count=len(words))
    at = np.flatnonzero(mark)
    full = np.diff(np.r_[-1, at]) > 1
    text = np.repeat(np.arange(len(lines_of)), lines_of)
    start = full & np.r_[True, ~full[:-1] | (text[1:] != text[:-1])]
    running = np.cumsum(start)
    ends = np.cumsum(lines_of)
    before = np.r_[0, running[ends - 1]][:-1] if len(ends) else running
    return np.where(full, running - 1 - before[text], -1), np.diff(np.r_[0, running[ends - 1]]) if len(ends) else running


def license_paragraphs(docs: DataFrame, model: Classifier | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_paragraphs, licenses (array of paragraph, first_line, last_line, family, probability, alignment, confirmed).

    Each line, each paragraph of several lines and each run of lines that holds a notice's shingles is classified;
    it is a prediction if a family reaches the model's bar, ties going to the family that sorts first. Of a paragraph each family is listed once: where
    it is confirmed rather than not, then with the better alignment, then probability, then in fewer lines, then first. Paragraphs and lines count from 0.
    Null and empty texts have no paragraph. Repeated rows come each time, null ids like others, and an empty table gives no rows.
    """
    model = model or train(docs)
    vocabulary = [w for w in model.number if w != LINE]
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, model.pairs, model.weights, model.temperature, model.bar))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, wrapped, templates = Classifier(*shared.value), Wrapped(), Templates()
        for batch, texts in sliced(batches):
            words, lines_of = tokens(texts)
            ends = np.cumsum(lines_of)
            of_line, count = paragraphs_of(words, lines_of)
            found: list[dict[tuple[int, str], tuple]] = [{} for _ in texts]

            def judge(first: int, last: int, part: list[bytes], share: np.ndarray, own=own, templates=templates, ends=ends, lines_of=lines_of, of_line=of_line, found=found) -> None:
                number = int(share[:-1].argmax())
                if share[number] < own.bar:
                    return
                doc = int(np.searchsorted(ends, first, side="right"))
                begin = int(ends[doc] - lines_of[doc])
                sure, alignment = templates.compare(part, FAMILIES[number])
                key = (int(of_line[first]), FAMILIES[number])
                value = (sure, alignment, float(share[number]), first - last, -first)
                if key not in found[doc] or value > found[doc][key][0]:
                    found[doc][key] = (value, first - begin, last - begin)

            lines, probability, of_word = own.probabilities(words)
            top = probability[:, :-1].max(axis=1) if len(lines) else np.zeros(0)
            for i in np.flatnonzero(top >= own.bar).tolist():
                a, b = np.searchsorted(of_word, [lines[i], lines[i] + 1]).tolist()
                judge(int(lines[i]), int(lines[i]), [w for w in words[a:b] if w != LINE], probability[i])
            # paragraphs of several lines, the marks between their lines left out
            starts = np.flatnonzero((of_line >= 0) & np.r_[True, (of_line[1:] != of_line[:-1]) | (np.searchsorted(ends, np.arange(1, len(of_line)), side="right") != np.searchsorted(ends, np.arange(len(of_line) - 1), side="right"))])
            marks = np.flatnonzero(np.fromiter((w == LINE for w in words), dtype=bool, count=len(words)))
            spans = []
            for a in starts.tolist():
                b = a
                while b + 1 < len(of_line) and of_line[b + 1] == of_line[a] and b + 1 < ends[np.searchsorted(ends, a, side="right")]:
                    b += 1
                if b > a:
                    spans.append((a, b, [w for w in words[(marks[a - 1] + 1 if a else 0) : marks[b]] if w != LINE]))
            spans += wrapped.find(words, ends)
            at, share, _ = own.probabilities([w for _, _, part in spans for w in [*part, LINE]])
            for n, row in zip(at.tolist(), share, strict=True):
                judge(*spans[n], row)
            rows = [
                [{"paragraph": p, "first_line": first, "last_line": last, "family": family, "probability": value[2], "alignment": value[1], "confirmed": value[0]} for (p, family), (value, first, last) in sorted(x.items())]
                for x in found
            ]
            kind = pa.list_(pa.struct([("paragraph", pa.int64()), ("first_line", pa.int64()), ("last_line", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("alignment", pa.float64()), ("confirmed", pa.bool_())]))
            yield pa.record_batch([batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(rows, kind)], names=["doc_id", "n_paragraphs", "licenses"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = "paragraph:bigint,first_line:bigint,last_line:bigint,family:string,probability:double,alignment:double,confirmed:boolean"
    return docs.select("doc_id", "text").mapInArrow(emit, f"doc_id {kind}, n_paragraphs long, licenses array<struct<{fields}>>")
