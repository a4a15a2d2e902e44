"""Language identification by unigram piece models summed over all segmentations.

The pieces are those of a fixed public vocabulary. For each language, expectation maximisation over
words of labelled documents gives a probability to each piece; the forward algorithm then sums the
probabilities of all segmentations of each word of a text, and Bayes' rule compares the languages.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, held_out, keep_rows, sliced, text_digest
from .lattice import WINDOW, Trie, backward, build_lattice, build_trie, forward, groups, log_sums

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Labelled documents of a language that training reads, about; all where there are fewer.
SAMPLE_PER_LANGUAGE = 1500
ROUNDS = 3
UNKNOWN = 1e-6
SMOOTHING = 0.01
#: Words whose scores a task keeps at a time.
KEPT_WORDS = 300_000
LEAST_SCORE = 0.5


def vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """The model's ordinary pieces; the mark of a word's start becomes a space. Those of several marks are in no word."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    found = []
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            piece = model.id_to_piece(i)
            if "▁" not in piece[1:]:
                found.append(piece.replace("▁", " ").encode())
    return list(dict.fromkeys(found))


def _learnable(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out("doc_id", 4, 2) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))


def _training_words(word: bytes) -> list[bytes]:
    """The word; expected counts of a very long one come from its windows, as both directions of one lattice are held."""
    return [word] if len(word) <= WINDOW else [word[i : i + WINDOW] for i in range(0, len(word), WINDOW)]


def train(docs: DataFrame, vocabulary_path: str = VOCABULARY, sample: int = SAMPLE_PER_LANGUAGE, rounds: int = ROUNDS):
    """(languages, log priors, piece probabilities with the unknown byte last, trie) from the labelled rows outside the held-out part.

    A language with more rows than sample is read in the fixed part of them whose hashed ids come first.
    """
    spark = docs.sparkSession
    rows = _learnable(docs)
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    pieces = vocabulary(vocabulary_path)
    trie = build_trie(pieces)
    languages = sorted(counts)
    if not languages:
        return [], np.zeros(0), np.zeros((trie.size + 1, 0)), trie
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, sample / n)))])
    rank = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) / float(1 << 30)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in sliced(batches):
            found: Counter = Counter()
            for lang, text in zip(batch.column("lang").to_pylist(), texts, strict=True):
                found.update((lang, s) for w in text.split() for s in _training_words(b" " + w))
            keys = list(found)
            yield pa.record_batch([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.binary()), pa.array([found[k] for k in keys], pa.int64())], names=["lang", "word", "n"])

    table = checkpointed(rows.where(rank < share[F.col("lang")]).select("lang", "text").mapInArrow(words, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    probability = np.full((trie.size + 1, len(languages)), 1.0 / trie.size)
    probability[-1] = UNKNOWN
    for _ in range(rounds):
        probability = _maximised(spark, table, trie, languages, probability)
    prior = np.log(np.array([counts[x] for x in languages], dtype=float) / sum(counts.values()))
    return languages, prior, probability, trie


def _maximised(spark: SparkSession, table: DataFrame, trie: Trie, languages: list[str], probability: np.ndarray) -> np.ndarray:
    """One round of expectation maximisation; what comes to the driver has a row for each piece and language at most."""
    shared = spark.sparkContext.broadcast((trie.plain(), languages, probability))

    def expected(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fields, languages, probability = shared.value
        trie = Trie.of(fields)
        number = {x: i for i, x in enumerate(languages)}
        total = np.zeros((trie.size + 1, len(languages)))
        for part in parts:
            for i, j in groups(part["word"].tolist()):
                rows = part.iloc[i:j]
                words = rows["word"].tolist()
                lang = rows["lang"].map(number).to_numpy()
                lattice = build_lattice(trie, words)
                word_of = np.searchsorted(lattice.first, lattice.source, side="right") - 1
                weight = probability[lattice.piece, lang[word_of]][:, None]
                (ahead, ahead_scale), (behind, behind_scale) = forward(lattice, weight), backward(lattice, weight)
                with np.errstate(divide="ignore"):
                    ahead, behind = np.log(ahead[:, 0]) + ahead_scale[:, 0], np.log(behind[:, 0]) + behind_scale[:, 0]
                share = np.exp(ahead[lattice.source] + np.log(weight[:, 0]) + behind[lattice.target] - ahead[lattice.last][word_of]) * rows["n"].to_numpy()[word_of]
                np.add.at(total, (lattice.piece, lang[word_of]), share)
        piece, lang = np.nonzero(total)
        yield pd.DataFrame({"piece": piece.astype("int32"), "lang": lang.astype("int32"), "n": total[piece, lang]})

    summed = table.mapInPandas(expected, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros_like(probability)
    counts[summed["piece"], summed["lang"]] = summed["n"]
    counts = counts[:-1] + SMOOTHING
    return np.vstack([counts / counts.sum(axis=0), np.full((1, len(languages)), UNKNOWN)])


class Scorer:
    """Log probabilities of words for each language, each distinct word summed once."""

    def __init__(self, trie: Trie, probability: np.ndarray):
        self.trie, self.probability, self.known, self.scores = trie, probability, {}, np.zeros((0, probability.shape[1]))

    def of_texts(self, texts: list[bytes]) -> np.ndarray:
        words, counts = [], []
        for text in texts:
            own = text.split()
            words += own
            counts.append(len(own))
        if len(self.known) > KEPT_WORDS:
            self.known, self.scores = {}, self.scores[:0]
        fresh = [w for w in dict.fromkeys(words) if w not in self.known]
        rows = [self.scores]
        for i, j in groups(fresh):
            part = fresh[i:j]
            rows.append(log_sums(self.trie, [b" " + w for w in part], self.probability))
            for w in part:
                self.known[w] = len(self.known)
        self.scores = np.vstack(rows)
        index = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
        # each text is summed by itself, so that its score doesn't depend on its neighbours
        total = np.zeros((len(texts), self.scores.shape[1]))
        full = np.flatnonzero(counts)
        if len(full):
            total[full] = np.add.reduceat(self.scores[index], (np.cumsum(counts) - counts)[full], axis=0)
        return total


def predict(docs: DataFrame, model) -> DataFrame:
    """doc_id, text_sha256, held_out, lang_pred, score for each row of docs.

    A text that is null, empty or without a letter gets und with score 0, and so does every text where
    nothing could be learned. The score is the posterior probability of the language that is given;
    ties go to the language that sorts first. Repeated rows get the same answer each time.
    """
    languages, prior, probability, trie = model
    shared = docs.sparkSession.sparkContext.broadcast((languages, prior, probability, trie.plain()))
    able = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)) if languages else F.lit(False)
    rows = docs.select(F.col("doc_id"), text_digest().alias("text_sha256"), held_out("doc_id", 4, 2).alias("held_out"), able.alias("able"), F.when(able, F.col("text")).alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, prior, probability, fields = shared.value
        scorer = Scorer(Trie.of(fields), probability)
        for batch, texts in sliced(batches):
            names, scores = ["und"] * len(texts), np.zeros(len(texts))
            if languages:
                able = np.array(batch.column("able").to_pylist())
                likely = scorer.of_texts(texts) + prior
                best = likely.argmax(axis=1)
                posterior = 1.0 / np.exp(likely - likely.max(axis=1, keepdims=True)).sum(axis=1)
                names = [languages[b] if a else "und" for a, b in zip(able, best, strict=True)]
                scores = np.where(able, posterior, 0.0)
            yield pa.record_batch([batch.column("doc_id"), batch.column("text_sha256"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "text_sha256", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"doc_id {kind}, text_sha256 string, held_out boolean, lang_pred string, score double")


def identify_languages(docs: DataFrame) -> DataFrame:
    """predict() with a model trained on docs itself; lang is read for training only."""
    return predict(docs, train(docs))


def drop_unidentified(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows whose language is known with a posterior of at least least, whole and unchanged; und rows go.

    Null and empty texts and those without a letter are und. Rows without an id are judged by their text, rows that repeat stay
    or go together, and nulls in other columns don't matter. Where nothing can be learned every row goes.
    """
    found = identify_languages(docs)
    return keep_rows(docs, found.where((F.col("lang_pred") != "und") & (F.col("score") >= least)))
