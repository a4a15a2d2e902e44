"""Importance resampling towards a target distribution, over hashed word runs.

Separators are collapsed to single spaces, and an overlapped scan with look-arounds at the words' ends gives
the span of every run of words, which is hashed where it lies. Counts of hashed runs in all documents and in
the target give each bucket a gain; a document's weight is the sum over its runs, and a draw without replacement takes the highest
weights with Gumbel noise from a hash of the id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import itemgetter
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, sliced, stored, text_digest, with_ordinal

LEAST_RUN, MOST_RUN, BUCKETS, SEED = 1, 1, 10_000, 2024
PERCENT, LEAST_WORDS = 10, 20

_WORD = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(128, 256))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: A to Z in lower case; what is in no word becomes a space.
_SIGNS = bytes(c if c in _WORD else 32 for c in _LOWER)
_SPACES = regex.compile(rb" {2,}")


def collapsed(text: bytes) -> bytes:
    """The words of a text in lower case (A to Z alone), with single spaces between them."""
    return _SPACES.sub(b" ", text.translate(_SIGNS)).strip(b" ")


def run_pattern(words: int) -> regex.Pattern:
    """A run of so many whole words of a collapsed text."""
    return regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % (words - 1))


def run_spans(text: bytes, least: int = LEAST_RUN, most: int = MOST_RUN) -> Iterator[tuple[int, int]]:
    """(start, end) of all runs of least to most consecutive words of a collapsed text, by length, then place."""
    for words in range(least, most + 1):
        yield from (m.span() for m in run_pattern(words).finditer(text, overlapped=True))


def run_buckets(text: bytes, least: int = LEAST_RUN, most: int = MOST_RUN, buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of each run, in the order of run_spans()."""
    found = [np.fromiter(map(crc32, map(itemgetter(0), run_pattern(n).finditer(text, overlapped=True))), dtype=np.uint32) for n in range(least, most + 1)]
    return (np.concatenate(found) % np.uint32(buckets)).astype(bucket_type(buckets))


def bucket_type(buckets: int) -> type:
    """What a bucket's number is stored as: two bytes are enough for most."""
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def _counted(texts: DataFrame, least: int, most: int, buckets: int) -> np.ndarray:
    """How often each bucket occurs in the runs column of texts; tasks add up what they read, so that only sums move."""

    kind = bucket_type(buckets)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for raw in batch.column("runs").to_pylist():
                total += np.bincount(np.frombuffer(raw, dtype=kind), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    # as many rows as buckets at most
    for r in texts.select("runs").mapInArrow(emit, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def hashed_runs(docs: DataFrame, columns: list[str], least: int = LEAST_RUN, most: int = MOST_RUN, buckets: int = BUCKETS) -> DataFrame:
    """columns of docs, n_words, n_features and runs (the bucket of every run, see bucket_type()), stored: texts are scanned once."""
    kept = docs.select(*columns, "text")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in sliced(batches):
            words, features, runs = [], [], []
            for text in texts:
                text = collapsed(text)
                found = run_buckets(text, least, most, buckets)
                words.append(text.count(b" ") + 1 if text else 0)
                features.append(len(found))
                runs.append(found.tobytes())
            yield pa.record_batch([*[batch.column(c) for c in columns], pa.array(words, pa.int64()), pa.array(features, pa.int64()), pa.array(runs, pa.binary())], names=[*columns, "n_words", "n_features", "runs"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.select(*columns).schema)
    return stored(kept.mapInArrow(emit, f"{', '.join(x for x in [fields] if x)}{', ' if columns else ''}n_words long, n_features long, runs binary"))


def bucket_gains(all_counts: np.ndarray, target_counts: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of smoothed shares in the target and in all), for each bucket."""
    buckets, s, t = len(all_counts), int(all_counts.sum()), int(target_counts.sum())
    shares = (target_counts + 1.0) * (s + buckets) / ((all_counts + 1.0) * (t + buckets))
    return np.array([math.floor(1000 * math.log(x)) for x in shares.tolist()], dtype=np.int64)


def gumbel(key: str = "doc_id", seed: int = SEED) -> Column:
    """floor(1000 * Gumbel noise) from the first 32 bits of sha256('seed:id'); a null id is empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, least: int = LEAST_RUN,
    most: int = MOST_RUN, buckets: int = BUCKETS, seed: int = SEED,
) -> DataFrame:
    """doc_id, n_features, weight, score, rank, text_sha256 for each row of docs; rank 1, 2, 3, ... of those drawn, else null.

    Of the documents with at least least_words words, percent in a hundred (rounded down) are drawn, those whose
    weight plus noise is highest; ties go to the smaller doc_id, null last, then to the lower text_sha256; what ties then are rows alike.
    Words are runs of letters, digits and signs beyond ASCII; only A to Z are lower-cased. A null or empty text has no features
    and weight 0, as has every text where target and docs are empty. Rows that repeat an id have the same noise and are drawn apart. Texts are whole,
    of any length. An empty table gives no rows.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest().alias("text_sha256"), "text")
    rows = hashed_runs(read, ["doc_id", "text_sha256"], least, most, buckets)
    aim = hashed_runs(target.select("text"), [], least, most, buckets)
    # a number for each bucket
    gains = rows.sparkSession.sparkContext.broadcast(bucket_gains(_counted(rows, least, most, buckets), _counted(aim, least, most, buckets)))
    kept, kind = ["doc_id", "text_sha256", "n_words", "n_features"], bucket_type(buckets)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = [int(gains.value[np.frombuffer(raw, dtype=kind)].sum()) for raw in batch.column("runs").to_pylist()]
            yield pa.record_batch([*[batch.column(c) for c in kept], pa.array(weights, pa.int64())], names=[*kept, "weight"])

    weighed = rows.mapInArrow(weigh, "doc_id long, text_sha256 string, n_words long, n_features long, weight long")
    # the number parts rows alike, so that any number of them can be sorted by ranges
    scored = stored(weighed.withColumn("score", F.col("weight") + gumbel(seed=seed)).withColumn("__row", F.monotonically_increasing_id()))
    enough = scored.where(F.col("n_words") >= least_words)
    drawn = enough.count() * percent // 100
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("text_sha256").asc(), F.col("__row").asc())
    columns = ["doc_id", "n_features", "weight", "score"]
    ranked = with_ordinal(enough, *order).select(*columns, F.when(F.col("ordinal") < drawn, F.col("ordinal") + 1).alias("rank"), "text_sha256")
    rest = scored.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank"), "text_sha256")
    return ranked.unionByName(rest)


def resampled_documents(docs: DataFrame, target: DataFrame, **options: int) -> DataFrame:
    """The documents drawn, whole and unchanged; see resample(). Of rows that share both doc_id and text all are kept if one is drawn."""
    return keep_rows(docs, resample(docs, target, **options).where(F.col("rank").isNotNull()))
