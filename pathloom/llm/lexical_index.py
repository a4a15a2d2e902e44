"""Ranked lexical search by Block-Max MaxScore over an inverted index in shards.

A shard is a slice of the documents. Each of its terms has one row of compressed postings in blocks, and with every block, uncompressed, its
last document and the pairs of frequency and document size that no other pair of the block beats, from which the block's highest
score follows under any statistics of the collection. A query takes a shard's lists from the highest bound down: those whose bounds
together, with all below them, can reach the k-th score so far are essential, and their documents are candidates. Lists below are looked into for candidates
alone, and a block whose highest score can't lift a candidate far enough is rejected before it is decompressed. The
heaps of the shards are merged.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, member_filter, sliced, stored, with_ordinal

K, BLOCK = 10, 128
#: Bytes of text in a shard, items that a task searches for together, and parts in which heaps are merged first.
SHARD_BYTES, ITEMS, MERGES = 16 << 20, 256, 32
#: Share of a document's size in the norm, in hundredths.
SIZE_SHARE = 75

_WORD = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(128, 256))
_SIGNS = bytes(x if (x := c + 32 if 65 <= c <= 90 else c) in _WORD else 32 for c in range(256))

INDEX = "shard long, term binary, df int, last array<int>, stop array<int>, best_stop array<int>, best_tf array<int>, best_size array<long>, postings binary, ids array<long>, id_known array<boolean>, sizes array<long>, n_docs long, n_terms long"


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in order: letters, digits and signs beyond ASCII, A to Z in lower case."""
    return text.translate(_SIGNS).split()


def _lists(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _widths(most: np.ndarray) -> np.ndarray:
    """Bytes that numbers up to most take: 1, 2 or 4."""
    return np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))


def _put(out: np.ndarray, at: np.ndarray, values: np.ndarray, width: np.ndarray) -> None:
    for j in range(4):
        sel = width > j
        out[at[sel] + j] = values[sel] >> (8 * j) & 255


def shard_postings(texts: list[bytes], block: int = BLOCK) -> tuple[list[bytes], dict[str, np.ndarray], np.ndarray]:
    """(terms, their lists and blocks as flat arrays, the size of each text) of the texts of one shard."""
    vocabulary: dict[bytes, int] = defaultdict(count().__next__)
    found = []
    for text in texts:
        words = terms_of(text)
        found.append(np.fromiter(map(vocabulary.__getitem__, words), dtype=np.int64, count=len(words)))
    sizes = np.array([len(x) for x in found], dtype=np.int64)
    if not vocabulary:
        return [], {}, sizes
    key = np.concatenate(found) * len(texts) + np.repeat(np.arange(len(texts)), sizes)
    key, tf = np.unique(key, return_counts=True)
    term, doc = key // len(texts), key % len(texts)
    starts = np.searchsorted(term, np.arange(len(vocabulary)))
    within = np.arange(len(term)) - starts[term]
    first = np.flatnonzero(within % block == 0)
    of = np.cumsum(within % block == 0) - 1
    length = np.diff(np.append(first, len(term)))
    gap = np.where(within == 0, doc + 1, doc - np.roll(doc, 1))
    gap_width = _widths(np.maximum.reduceat(gap, first))
    most_tf = np.maximum.reduceat(tf, first)
    tf_width = np.where(most_tf == 1, 0, _widths(most_tf))
    bytes_each = 1 + length * (gap_width + tf_width)
    begin = np.cumsum(bytes_each) - bytes_each
    raw = np.zeros(int(bytes_each.sum()), dtype=np.uint8)
    raw[begin] = gap_width | tf_width << 4
    place = np.arange(len(term)) - first[of]
    _put(raw, begin[of] + 1 + place * gap_width[of], gap, gap_width[of])
    _put(raw, begin[of] + 1 + length[of] * gap_width[of] + place * tf_width[of], tf, tf_width[of])
    # pairs by falling frequency: one is kept if its document is smaller than those of all before it
    order = np.lexsort((sizes[doc], -tf, of))
    size = sizes[doc][order] - of[order] * (int(sizes.max()) + 1)
    kept = np.append(True, size[1:] < np.minimum.accumulate(size)[:-1])
    best = order[kept]
    list_of_block = term[first]
    blocks_to = np.searchsorted(list_of_block, np.arange(len(vocabulary) + 1))
    stop = np.append(begin[1:], len(raw)) - begin[blocks_to[list_of_block]]
    best_per_block = np.bincount(of[best], minlength=len(first))
    best_to = np.append(0, np.cumsum(best_per_block))
    best_stop = best_to[1:] - best_to[blocks_to[list_of_block]]
    lists = {
        "df": np.diff(np.append(starts, len(term))), "blocks_to": blocks_to, "last": doc[np.append(first[1:], len(term)) - 1], "stop": stop, "best_stop": best_stop,
        "best_to": best_to[blocks_to], "best_tf": tf[best], "best_size": sizes[doc[best]], "bytes_to": np.append(begin, len(raw))[blocks_to], "raw": raw,
    }
    return list(vocabulary), lists, sizes


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index, stored: a row for each shard and term, and one without a term for each shard with its documents' ids and sizes.

    Shards are slices of what a task reads, so that building moves nothing; a longer text is a shard by itself.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), count()
        kinds = {"shard": pa.int64(), "term": pa.binary(), "df": pa.int32(), "last": pa.list_(pa.int32()), "stop": pa.list_(pa.int32()), "best_stop": pa.list_(pa.int32()), "best_tf": pa.list_(pa.int32()), "best_size": pa.list_(pa.int64()),
                 "postings": pa.binary(), "ids": pa.list_(pa.int64()), "id_known": pa.list_(pa.bool_()), "sizes": pa.list_(pa.int64()), "n_docs": pa.int64(), "n_terms": pa.int64()}

        def batch_of(columns: dict[str, pa.Array]) -> pa.RecordBatch:
            n = len(columns["shard"])
            return pa.record_batch([columns[c] if c in columns else pa.nulls(n, k) for c, k in kinds.items()], names=list(kinds))

        for batch, texts in sliced(batches, "text", shard_bytes):
            shard = (part << 32) + next(number)
            terms, x, sizes = shard_postings(texts)
            ids = batch.column("id")
            whole = {"ids": pa.array([ids.fill_null(0).to_pylist()], kinds["ids"]), "id_known": pa.array([ids.is_valid().to_pylist()], kinds["id_known"]), "sizes": pa.array([sizes.tolist()], kinds["sizes"])}
            yield batch_of({"shard": pa.array([shard], pa.int64()), "n_docs": pa.array([int((sizes > 0).sum())], pa.int64()), "n_terms": pa.array([int(sizes.sum())], pa.int64()), **whole})
            for i in range(0, len(terms), 1 << 16):
                j = min(len(terms), i + (1 << 16))
                b, e = x["blocks_to"][i : j + 1], x["best_to"][i : j + 1]
                bytes_to = x["bytes_to"][i : j + 1]
                blocks, bests = slice(b[0], b[-1]), slice(e[0], e[-1])
                yield batch_of({
                    "shard": pa.array(np.full(j - i, shard), pa.int64()), "term": pa.array(terms[i:j], pa.binary()), "df": pa.array(x["df"][i:j], pa.int32()),
                    "last": _lists(b - b[0], x["last"][blocks], pa.int32()), "stop": _lists(b - b[0], x["stop"][blocks], pa.int32()), "best_stop": _lists(b - b[0], x["best_stop"][blocks], pa.int32()),
                    "best_tf": _lists(e - e[0], x["best_tf"][bests], pa.int32()), "best_size": _lists(e - e[0], x["best_size"][bests], pa.int64()),
                    "postings": pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((bytes_to - bytes_to[0]).astype(np.int32)), pa.py_buffer(x["raw"][bytes_to[0] : bytes_to[-1]])]),
                })

    return stored(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(emit, INDEX))


class Norm:
    """A document's m from its size, and what a frequency brings, before the term's weight."""

    def __init__(self, docs: int, terms: int):
        self.docs, self.terms = docs, terms

    def m(self, size: np.ndarray) -> np.ndarray:
        if int(size.max(initial=0)) * SIZE_SHARE * self.docs < 1 << 62:
            return 100 - SIZE_SHARE + SIZE_SHARE * size * self.docs // self.terms
        return np.array([100 - SIZE_SHARE + SIZE_SHARE * n * self.docs // self.terms for n in size.tolist()], dtype=np.int64)

    @staticmethod
    def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Postings:
    """One term's list in a shard; blocks are decompressed when asked for, once."""

    def __init__(self, row: dict, norm: Norm):
        self.last, self.raw = np.asarray(row["last"], dtype=np.int64), row["postings"]
        self.stop = np.append(0, np.asarray(row["stop"], dtype=np.int64))
        best = norm.impact(np.asarray(row["best_tf"], dtype=np.int64), norm.m(np.asarray(row["best_size"], dtype=np.int64)))
        self.block_most = np.maximum.reduceat(best, np.append(0, np.asarray(row["best_stop"][:-1], dtype=np.int64)))
        self.most = int(self.block_most.max())
        self.left = row["df"] - BLOCK * (len(self.last) - 1)
        self.read: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, frequencies) of a block."""
        if n not in self.read:
            length = BLOCK if n < len(self.last) - 1 else self.left
            at = int(self.stop[n])
            gap_width, tf_width = self.raw[at] & 15, self.raw[at] >> 4
            docs = np.cumsum(np.frombuffer(self.raw, dtype=f"<u{gap_width}", count=length, offset=at + 1).astype(np.int64)) + (self.last[n - 1] if n else -1)
            tf = np.frombuffer(self.raw, dtype=f"<u{tf_width}", count=length, offset=at + 1 + length * gap_width).astype(np.int64) if tf_width else np.ones(length, dtype=np.int64)
            self.read[n] = docs, tf
        return self.read[n]

    def blocks(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        read = [self.block(n) for n in numbers.tolist()]
        return (np.concatenate([x[0] for x in read]), np.concatenate([x[1] for x in read])) if read else (np.zeros(0, dtype=np.int64),) * 2


class Query:
    """A query on one shard: its lists by rising bound, and the k best documents so far."""

    def __init__(self, lists: list[tuple[int, Postings]], m: np.ndarray, ids: np.ndarray, known: np.ndarray, k: int):
        self.lists = sorted(lists, key=lambda x: x[0] * x[1].most)
        self.bounds = np.cumsum([0] + [w * p.most for w, p in self.lists])
        self.m, self.ids, self.known, self.k = m, ids, known, k
        self.best, self.best_score, self.floor = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 1

    def offer(self, docs: np.ndarray, score: np.ndarray, at: int) -> None:
        """Candidates with their score by lists from at up: add what the lists below bring, unless bounds rule them out, and keep the k best."""
        for below in range(at - 1, -1, -1):
            able = score + self.bounds[below + 1] >= self.floor
            docs, score = docs[able], score[able]
            if not len(docs):
                return
            weight, postings = self.lists[below]
            block = np.searchsorted(postings.last, docs)
            inside = block < len(postings.last)
            most = np.where(inside, weight * postings.block_most[np.minimum(block, len(postings.last) - 1)], 0)
            able = score + self.bounds[below] + most >= self.floor
            docs, score, block, inside = docs[able], score[able], block[able], inside[able]
            held, tf = postings.blocks(np.unique(block[inside]))
            if len(held):
                near = np.minimum(np.searchsorted(held, docs), len(held) - 1)
                hit = held[near] == docs
                score[hit] += weight * Norm.impact(tf[near[hit]], self.m[docs[hit]])
        able = score >= self.floor
        best, best_score = np.append(self.best, docs[able]), np.append(self.best_score, score[able])
        order = np.lexsort((self.ids[best], ~self.known[best], -best_score))[: self.k]
        self.best, self.best_score = best[order], best_score[order]
        if len(order) == self.k:
            self.floor = max(1, int(self.best_score[-1]))

    def run(self) -> list[tuple[int, int]]:
        """(document, score) of the k best; ties go to the smaller id, those without one last."""
        seen = np.zeros(len(self.m), dtype=bool)
        for at in range(len(self.lists) - 1, -1, -1):
            if self.bounds[at + 1] < self.floor:
                break
            weight, postings = self.lists[at]
            docs, tf = postings.blocks(np.flatnonzero(weight * postings.block_most + self.bounds[at] >= self.floor))
            fresh = ~seen[docs]
            docs, tf = docs[fresh], tf[fresh]
            seen[docs] = True
            score = weight * Norm.impact(tf, self.m[docs])
            # the most promising first, so that the others meet a floor
            order = np.argsort(-score, kind="stable")
            for part in (order[: 2 * self.k], order[2 * self.k :]):
                self.offer(docs[np.sort(part)], score[np.sort(part)], at)
        return list(zip(self.best.tolist(), self.best_score.tolist(), strict=True))


def search(index: DataFrame, items: DataFrame, k: int = K, key: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item of items by the index; see ranked_documents()."""
    heads = index.where(F.col("term").isNull())
    docs, terms = heads.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    norm = Norm(docs, terms)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in sliced(batches):
            rows = [(i, w) for i, t in enumerate(texts) for w in terms_of(t)]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.record_batch([batch.column("number").take(at), pa.array([r[1] for r in rows], pa.binary())], names=["number", "term"])

    asked = items.select(F.col(key).cast("long").alias("item_id"), F.col(text).alias("text"))
    numbered = checkpointed(with_ordinal(asked.select("item_id").distinct(), F.col("item_id").asc_nulls_last()).select("item_id", F.col("ordinal").alias("number")))
    rows = asked.join(numbered.withColumnRenamed("item_id", "__id"), F.col("item_id").eqNullSafe(F.col("__id"))).select("number", "text")
    wanted = rows.mapInArrow(split, "number long, term binary").groupBy("number", "term").agg(F.count(F.lit(1)).alias("times"))
    wanted = checkpointed(wanted.withColumn("block", F.floor(F.col("number") / ITEMS)))
    used = wanted.select(F.col("term").alias("__term"), "block").distinct()
    # lists of other terms stay where they are
    listed = index.where(F.col("term").isNotNull() & member_filter(used, "__term")(F.col("term")))
    relevant = stored(listed.drop("ids", "id_known", "sizes", "n_docs", "n_terms").join(used, F.col("term") == F.col("__term")).drop("__term"))
    # a block of items sees each list once
    df = relevant.groupBy("term", "block").agg(F.sum("df").alias("df")).groupBy("term").agg(F.max("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * docs + 2) / (2 * F.col("df") + 1)))
    weighed = wanted.join(df.select(F.col("term").alias("__term"), weight.alias("weight")).where("weight > 0"), F.col("term") == F.col("__term")).drop("__term")
    packed = weighed.groupBy("block").agg(F.collect_list(F.struct("number", "term", "times", "weight")).alias("q")).select("block", *[F.col(f"q.{c}").alias(c) for c in ("number", "term", "times", "weight")])
    places = relevant.select(F.col("shard").alias("at_shard"), F.col("block").alias("at_block")).distinct().join(packed, F.col("at_block") == F.col("block")).drop("block")
    places = places.join(heads.select("shard", "ids", "id_known", "sizes"), F.col("at_shard") == F.col("shard")).drop("shard")

    def find(key: tuple, lists: pd.DataFrame, place: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(place):
            head = place.iloc[0]
            held = {r["term"]: Postings(r, norm) for r in lists.to_dict("records")}
            m, ids, known = norm.m(np.asarray(head["sizes"], dtype=np.int64)), np.asarray(head["ids"], dtype=np.int64), np.asarray(head["id_known"], dtype=bool)
            queries = defaultdict(list)
            for number, term, times, weight in zip(head["number"], head["term"], head["times"], head["weight"], strict=True):
                if term in held:
                    queries[number].append((int(times) * int(weight), held[term]))
            for number, query in queries.items():
                out += [(number, ids[d] if known[d] else None, s) for d, s in Query(query, m, ids, known, k).run()]
        return pd.DataFrame({"number": pd.array([r[0] for r in out], "Int64"), "doc_id": pd.array([r[1] for r in out], "Int64"), "score": pd.array([r[2] for r in out], "Int64")}).assign(shard=key[0])

    heaps = relevant.groupBy("shard", "block").cogroup(places.groupBy("at_shard", "at_block")).applyInPandas(find, "number long, doc_id long, score long, shard long")
    best = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    part = F.pmod(F.xxhash64("shard"), F.lit(MERGES))
    for keys in (["number", part], ["number"]):
        heaps = heaps.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).where(F.col("rank") <= k)
    return heaps.join(numbered.withColumnRenamed("number", "__number"), F.col("number") == F.col("__number")).select("item_id", "rank", "doc_id", "score")


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = K, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents with the highest score above 0 for each item (all, if fewer).

    Terms are runs of letters, digits and signs beyond ASCII, of whole texts; only A to Z are lower-cased. A null or empty text has no terms: such a document
    is never found, such an item finds nothing. A term in so many documents that its weight is 0 brings nothing. Equal scores go by ascending doc_id,
    null last; rows that repeat an id are documents each. Items that share an id, a null one too, are one item with all their terms. An empty
    table on either side gives no rows. Any number of items is searched for, in blocks.
    """
    return search(build_index(docs, shard_bytes=shard_bytes), items, k)
