"""Exact top-k by inner product over a vector-approximation file.

A vector's approximation is its components cut to cells of CELL_BITS bits. For a block of queries tasks scan
the cells alone, which bound every inner product from both sides; what can't be among the k best by these bounds is
left out at once. Exact vectors are then read, by a join, only for the entries that are left: first for the best of each
query in the order of their bounds, whose exact scores tighten the bound, then for those that still reach it,
so that the k-th result is certain. Equal vectors are one entry with their smallest ids, so copies cost little. A query's own id is
left out before every cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, stored

SCALE, EVERY, K = 256, 50, 5
CELL_BITS = 6
#: Queries of one scan, about; pairs bounded at a time; exact vectors that a query reads first.
QUERY_BLOCK, PAIRS, READ = 32_768, 1 << 20, 8
EXACT = 1 << 53


def usable(vector: str = "embedding", key: str = "vec_id") -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(key).isNotNull() & F.col(vector).isNotNull() & finite


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, ints): floor(scale * x) of each component; vectors that take no part are left out."""
    return vectors.where(usable()).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("ints"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), size)


def approximation_file(rows: DataFrame, keep: int) -> DataFrame:
    """(entry, ids, ints, shift, cells), stored by columns: a row for each distinct vector, with its keep smallest distinct ids, each up to keep - 1 times.

    cells are the components shifted right until they fit CELL_BITS bits.
    A result of k rows uses at most the k + 1 smallest distinct ids of one vector, the query's own among them, and k rows of one.
    """
    times = rows.groupBy("ints", "vec_id").agg(F.least(F.count(F.lit(1)), F.lit(keep - 1)).cast("int").alias("times"))
    first = times.withColumn("__n", F.row_number().over(Window.partitionBy("ints").orderBy("vec_id"))).where(F.col("__n") <= keep)
    held = F.array_sort(F.collect_list(F.struct("vec_id", "times")))
    grouped = first.groupBy("ints").agg(F.flatten(F.transform(held, lambda x: F.array_repeat(x["vec_id"], x["times"]))).alias("ids"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("ints").value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                ints = _matrix(part.column("ints"), dim)
                most = np.maximum(ints, -ints - 1).max(axis=1, initial=0)
                shift = np.zeros(len(ints), dtype=np.int64)
                while (over := (most >> shift) >= 1 << (CELL_BITS - 1)).any():
                    shift += over
                cells = (ints >> shift[:, None]).astype(np.int8)
                yield pa.record_batch([part.column("ids"), part.column("ints"), pa.array(shift, pa.int32()), pa.array([c.tobytes() for c in cells], pa.binary())], names=["ids", "ints", "shift", "cells"])

    return stored(grouped.mapInArrow(emit, "ids array<long>, ints array<long>, shift int, cells binary").withColumn("entry", F.monotonically_increasing_id()))


class Scan:
    """A block of queries of one dimension, and the k best lower bounds that each has met so far."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        self.query_ids, self.queries = query_ids, queries
        self.positive, self.negative = np.maximum(queries, 0).sum(axis=1), np.maximum(-queries, 0).sum(axis=1)
        self.size = np.abs(queries.astype(float)).sum(axis=1)
        self.best = np.full((len(queries), k), -np.inf)
        self.by_id = np.argsort(query_ids)

    def bounds(self, cells: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of all inner products of queries and entries, as floating point rounded outward where that isn't exact."""
        base = np.ldexp(self.queries.astype(float) @ cells.T.astype(float), shift)
        slack = np.ldexp(1.0, shift) - 1
        unsure = np.ldexp(self.size[:, None], shift + CELL_BITS)
        unsure = np.where(unsure < EXACT, 0.0, unsure * (2.0**-52 * (cells.shape[1] + 4)))
        return base - slack * self.negative[:, None] - unsure, base + slack * self.positive[:, None] + unsure

    def candidates(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """(query_id, entry, lower, upper) of the pairs that may be among a query's k best, by what it has met so far."""
        dim = self.queries.shape[1]
        cells = np.frombuffer(b"".join(batch.column("cells").to_pylist()), dtype=np.int8).reshape(len(batch), dim)
        shift = batch.column("shift").to_numpy()
        entries = batch.column("entry").to_numpy()
        # an entry that has no id but the query's own is none of its candidates
        ids = batch.column("ids").to_pylist()
        single = np.array([x[0] == x[-1] for x in ids])
        sole = np.array([x[0] for x in ids])
        ordered = self.query_ids[self.by_id]
        near = np.minimum(np.searchsorted(ordered, sole), len(ordered) - 1)
        own = single & (ordered[near] == sole)
        step = max(1, PAIRS // max(1, len(self.queries)))
        k = self.best.shape[1]
        for i in range(0, len(cells), step):
            lower, upper = self.bounds(cells[i : i + step], shift[i : i + step])
            at = np.flatnonzero(own[i : i + step])
            lower[self.by_id[near[i + at]], at] = -np.inf
            upper[self.by_id[near[i + at]], at] = -np.inf
            width = min(k, lower.shape[1])
            self.best = np.partition(np.hstack([self.best, np.partition(lower, -width, axis=1)[:, -width:]]), -k, axis=1)[:, -k:]
            query, entry = np.nonzero((upper >= self.best.min(axis=1)[:, None]) & (upper > -np.inf))
            if len(query):
                yield pa.record_batch(
                    [pa.array(self.query_ids[query], pa.int64()), pa.array(entries[i + entry], pa.int64()), pa.array(lower[query, entry]), pa.array(upper[query, entry])],
                    names=["query_id", "entry", "lower", "upper"],
                )


def _kth(rows: DataFrame, value: str, k: int, name: str) -> DataFrame:
    """(of, name): the k-th highest value of each query that has so many rows."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col(value).desc()))
    return rows.select("query_id", value).withColumn("__place", place).where(F.col("__place") <= k).where(F.col("__place") == k).select(F.col("query_id").alias("of"), F.col(value).alias(name))


def _read(pairs: DataFrame, entries: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, score, ids) of pairs of a query and an entry, from exact vectors."""
    exact = entries.select(F.col("entry").alias("__entry"), "ids", F.col("ints").alias("__a"))
    asked = queries.select(F.col("vec_id").alias("__query"), F.col("ints").alias("__b"))
    joined = pairs.select("query_id", "entry").join(exact, F.col("entry") == F.col("__entry")).join(asked, F.col("query_id") == F.col("__query"))
    score = F.aggregate(F.zip_with("__a", "__b", lambda a, b: a * b), F.lit(0).cast("long"), lambda total, x: total + x)
    return joined.select("query_id", score.alias("score"), "ids")


def top_k(vectors: DataFrame, every: int = EVERY, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each row whose vec_id is divisible by every.

    Candidates are all rows but those with the query's own id. Ties go to the smaller vec_id. Rows with
    a null id, and vectors that are null or hold a null or non-finite component, take no part;
    vectors of different lengths are not compared, and the product of empty ones is 0. Rows that repeat an id are candidates each; where
    they repeat a query's id with another vector, the least vector is the query. Scores must fit 64 bits.
    An empty table gives no rows. The queries are scanned for in blocks of about QUERY_BLOCK, so only one block is shared at a time.
    """
    rows = quantised(vectors, scale)
    spark = vectors.sparkSession
    entries = approximation_file(rows, k + 1)
    queries = checkpointed(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("ints").alias("ints")))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    scans = []
    for block in range(blocks):
        by_dim: dict[int, tuple[list[int], list[list[int]]]] = {}
        for r in queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).collect():
            ids, ints = by_dim.setdefault(len(r["ints"]), ([], []))
            ids.append(r["vec_id"])
            ints.append(r["ints"])
        shared = spark.sparkContext.broadcast({d: (np.array(ids), np.array(ints, dtype=np.int64).reshape(len(ids), d)) for d, (ids, ints) in by_dim.items()})

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held = {d: Scan(ids, ints, k) for d, (ids, ints) in shared.value.items()}
            for batch in batches:
                dims = pa.compute.binary_length(batch.column("cells")).to_numpy(zero_copy_only=False)
                for d in np.unique(dims).tolist():
                    if d in held:
                        yield from held[d].candidates(batch.filter(pa.array(dims == d)))

        scans.append(entries.select("entry", "ids", "shift", "cells").mapInArrow(scan, "query_id long, entry long, lower double, upper double"))
    # each block's scan is stored before the next, so that plans stay small
    found = stored(scans[0]) if len(scans) == 1 else reduce(DataFrame.union, [stored(x) for x in scans])
    live = found.join(_kth(found, "lower", k, "__floor"), F.col("query_id") == F.col("of"), "left").where(F.coalesce(F.col("upper") >= F.col("__floor"), F.lit(True)))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("upper").desc(), "entry"))
    live = checkpointed(live.select("query_id", "entry", "upper", order.alias("place")))
    first = checkpointed(_read(live.where(F.col("place") <= READ), entries, queries))
    rest = live.where(F.col("place") > READ).join(_kth(first, "score", k, "__floor"), F.col("query_id") == F.col("of"), "left").where(F.coalesce(F.col("upper") >= F.col("__floor"), F.lit(True)))
    scores = first.union(_read(rest, entries, queries))
    every_id = scores.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return every_id.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
