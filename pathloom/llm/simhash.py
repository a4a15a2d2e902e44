"""SimHash near-duplicates: fingerprints of word shingles, linked exactly through vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vp_tree
from .common import checkpointed, keep_one_row_each, sliced, text_digest
from .components import stars

SHINGLE_WORDS, SEED, RADIUS = 3, 42, 2
#: The tree that deals fingerprints out: about so many in a leaf, so many levels at least, the levels that grow at once, and the sample that they grow on.
LEAF_ROWS, LEAST_DEPTH, GROWN, SAMPLE = 16_384, 6, 9, 16_384
#: Points of a leaf beyond which it grows on, and bits that number the leaves of one growth.
LEAF_MOST, LEAF_BITS = 4 * LEAF_ROWS, 10


def fingerprint(text: bytes) -> int:
    """64 bits of a text: bit k is 1 if it is set in over half the hashes of its word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [e - 1 for e in accumulate(map((1).__add__, map(len, words)))]
    starts = [0, *[e + 1 for e in ends[:-1]]]
    last = ends[SHINGLE_WORDS - 1 :] or ends[-1:]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, [joined[a:b] for a, b in zip(starts, last, strict=False)], repeat(SEED)), dtype=np.uint64, count=len(last))
    set_bits = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        set_bits += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_sha256, fp): the fingerprint's 64 bits as a bigint, for each row of docs."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in sliced(batches):
            found = np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.record_batch([batch.column("doc_id"), batch.column("text_sha256"), pa.array(found, pa.int64())], names=["doc_id", "text_sha256", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest().alias("text_sha256"), "text")
    return rows.mapInArrow(emit, "doc_id long, text_sha256 string, fp long")


def _packed(tree: list[tuple[int, int, int, int]]) -> bytes:
    return np.array([[np.uint64(v).view(np.int64) if i == 0 else v for i, v in enumerate(row)] for row in tree], dtype=np.int64).tobytes()


def _unpacked(raw: bytes) -> list[tuple[int, int, int, int]]:
    return [(int(np.int64(v).view(np.uint64)), r, i, o) for v, r, i, o in np.frombuffer(raw, dtype=np.int64).reshape(-1, 4).tolist()]


def _grown(dealt: DataFrame, heavy: DataFrame, radius: int, leaf_rows: int, level: int) -> tuple[DataFrame, DataFrame]:
    """((leaf, fp) of heavy's leaves dealt to their own subtrees, (leaf) of those that no vantage point parts); heavy has leaf and n.

    Each leaf's subtree grows on a sample of its own. It travels with its leaf's points: they are dealt to as many tasks as their number asks for, each of
    which gets the subtree first, so that no task holds more than one subtree and a batch of points.
    """
    own = heavy.select(F.col("leaf").alias("__leaf"), "n")
    rows = dealt.join(own, F.col("leaf") == F.col("__leaf")).drop("__leaf")
    sampled = rows.where(F.pmod(F.xxhash64("fp", F.lit(level)), F.lit(1 << 30)) < F.lit(SAMPLE) * F.lit(float(1 << 30)) / F.col("n"))

    def plant(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        n = int(part["n"].iloc[0])
        depth = min(GROWN, max(1, int(np.ceil(np.log2(n / leaf_rows)))))
        tree = vp_tree.build(np.sort(part["fp"].to_numpy()).view(np.uint64), depth, radius)
        return pd.DataFrame({"leaf": [key[0]], "n": [n], "tree": [_packed(tree)]})

    trees = checkpointed(sampled.groupBy("leaf").applyInPandas(plant, "leaf long, n long, tree binary"))
    parted = trees.where(F.length("tree") > 0)
    tasks = F.ceil(F.col("n") / (4 * leaf_rows)).cast("int")
    seeds = parted.select("leaf", F.explode(F.sequence(F.lit(0), tasks - 1)).alias("task"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("fp"), "tree")
    points = rows.join(parted.select(F.col("leaf").alias("__leaf")), F.col("leaf") == F.col("__leaf"), "left_semi")
    points = points.select("leaf", F.pmod(F.xxhash64("fp"), tasks).cast("int").alias("task"), F.lit(1).alias("kind"), "fp", F.lit(None).cast("binary").alias("tree"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: list = []
        for batch in filter(len, batches):
            kind, leaf, fp = (batch.column(c).to_numpy() for c in ("kind", "leaf", "fp"))
            begins = np.flatnonzero(kind == 0).tolist()
            for i, j in zip([0, *begins], [*begins, len(batch)], strict=True):
                if kind[i] == 0:
                    tree = _unpacked(batch.column("tree")[i].as_py())
                    i += 1
                if j > i:
                    below, index = vp_tree.shards(tree, fp[i:j].view(np.uint64), radius)
                    yield pa.record_batch([pa.array((leaf[i:j][index] << LEAF_BITS) + below + 1, pa.int64()), pa.array(fp[i:j][index], pa.int64())], names=["leaf", "fp"])

    ordered = seeds.unionByName(points).repartition("leaf", "task").sortWithinPartitions("leaf", "task", "kind")
    return ordered.mapInArrow(deal, "leaf long, fp long"), heavy.join(parted.select(F.col("leaf").alias("__leaf")), F.col("leaf") == F.col("__leaf"), "left_anti").select("leaf")


def link_edges(points: DataFrame, radius: int = RADIUS, leaf_rows: int = LEAF_ROWS, least_depth: int = LEAST_DEPTH, leaf_most: int = LEAF_MOST) -> DataFrame:
    """(a, b): edges that join all fingerprints of points (distinct, column fp) within radius of each other, chains included.

    A tree deals every fingerprint to its leaf and, next to a boundary, to the leaves across it. It grows by GROWN levels at a time, each
    leaf of more than leaf_most points on a sample of its own, until no such leaf can be parted; so its depth goes with the number of points. Each leaf is
    searched by a tree of its own, and gives a point and the least point of its group there. A leaf of more than leaf_most points that no vantage point parts
    is not one task: its points are dealt by what they share, see dense_edges().
    """
    spark = points.sparkSession
    depth = min(GROWN, max(least_depth, int(np.ceil(np.log2(max(1, points.count()) / leaf_rows)))))
    sample = [r["fp"] for r in points.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()]
    tree = spark.sparkContext.broadcast(vp_tree.build(np.array(sample, dtype=np.int64).view(np.uint64), depth, radius))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            leaf, index = vp_tree.shards(tree.value, fp.view(np.uint64), radius)
            yield pa.record_batch([pa.array(leaf, pa.int64()), pa.array(fp[index], pa.int64())], names=["leaf", "fp"])

    def search(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        fp = np.sort(part["fp"].to_numpy())
        root = vp_tree.linked(fp.view(np.uint64), radius)
        moved = root != np.arange(len(fp))
        return pd.DataFrame({"a": fp[moved], "b": fp[root[moved]]})

    dealt, edges, dense = checkpointed(points.select("fp").mapInArrow(deal, "leaf long, fp long")), [], []
    for level in range(63 // LEAF_BITS):
        heavy = checkpointed(dealt.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > leaf_most))
        if heavy.isEmpty():
            break
        wide = heavy.select(F.col("leaf").alias("__leaf"))
        edges.append(dealt.join(wide, F.col("leaf") == F.col("__leaf"), "left_anti").groupBy("leaf").applyInPandas(search, "a long, b long"))
        grown, whole = _grown(dealt, heavy, radius, leaf_rows, level)
        dense.append(dealt.join(whole.select(F.col("leaf").alias("__leaf")), F.col("leaf") == F.col("__leaf"), "left_semi").select("fp"))
        dealt = checkpointed(grown)
    else:
        dense.append(dealt.select("fp"))
        dealt = dealt.limit(0)
    edges.append(dealt.groupBy("leaf").applyInPandas(search, "a long, b long"))
    if dense:
        edges.append(dense_edges(reduce(DataFrame.union, dense).distinct(), radius, leaf_rows))
    return reduce(DataFrame.union, edges)


def dense_edges(points: DataFrame, radius: int, group_rows: int = LEAF_ROWS) -> DataFrame:
    """(a, b): edges that join all fingerprints of points within radius of each other, however many are near one another.

    Two such fingerprints share all but radius of their eight bytes, so they meet under what is left when these are
    masked, for one of the ways to choose them. Under one mask and rest lie at most 256 ** radius fingerprints.
    """
    ways = vp_tree.masks(radius)
    shared = checkpointed(points)
    buckets = max(1, -(-len(ways) * shared.count() // group_rows))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            for way, mask in enumerate(ways):
                rest = fp.view(np.uint64) & ~mask
                yield pa.record_batch([pa.array(np.full(len(fp), way), pa.int32()), pa.array(rest.view(np.int64), pa.int64()), pa.array(fp, pa.int64())], names=["way", "rest", "fp"])

    def search(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["way", "rest", "fp"])
        way, rest, fp = (part[c].to_numpy() for c in ("way", "rest", "fp"))
        first = np.flatnonzero(np.r_[True, (way[1:] != way[:-1]) | (rest[1:] != rest[:-1])])
        a, b = [], []
        for i, j in zip(first.tolist(), [*first[1:].tolist(), len(fp)], strict=True):
            if j - i > 1:
                root = vp_tree.linked(fp[i:j].view(np.uint64), radius)
                moved = np.flatnonzero(root != np.arange(j - i))
                a.append(fp[i:j][moved])
                b.append(fp[i:j][root[moved]])
        return pd.DataFrame({"a": np.concatenate(a) if a else np.zeros(0, dtype=np.int64), "b": np.concatenate(b) if b else np.zeros(0, dtype=np.int64)})

    rows = shared.mapInArrow(deal, "way int, rest long, fp long").withColumn("bucket", F.pmod(F.xxhash64("way", "rest"), F.lit(buckets)))
    return rows.groupBy("bucket").applyInPandas(search, "a long, b long").distinct()


def fingerprint_text(column: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def labelled(docs: DataFrame, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """((doc_id, text_sha256, fp) of each row, (point, label, component_id) of each fingerprint); the label is a component's least fingerprint."""
    rows = checkpointed(fingerprints(docs))
    points = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    star = stars(link_edges(points, radius))
    labels = points.join(star, F.col("fp") == F.col("a"), "left").select("fp", "least", F.coalesce("b", "fp").alias("label"))
    least = checkpointed(labels.groupBy(F.col("label").alias("of")).agg(F.min("least").alias("component_id")))
    return rows, checkpointed(labels.join(least, F.col("label") == F.col("of")).select(F.col("fp").alias("point"), "label", "component_id"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per row of docs: doc_id, text_sha256, fingerprint (16 hex digits), component_id.

    Two texts link if their fingerprints differ in at most radius bits; component_id is the smallest
    doc_id that links reach, the row's own included. A text without words (null, empty, white space)
    has fingerprint zero and links like any other; a text of any length has one fingerprint. Equal fingerprints are one
    point of the search, so any number of copies costs one. Null ids take part in linking and are never a component_id,
    which is null only where a component has no other. Rows that repeat an id are rows like others; an empty table gives no rows.
    """
    rows, points = labelled(docs, radius)
    return rows.join(points, F.col("fp") == F.col("point")).select("doc_id", "text_sha256", fingerprint_text().alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each component, whole and unchanged: that with the smallest doc_id, then the smallest digest; one without an id only if none has one."""
    rows, points = labelled(docs)
    # a component's row is among those of its fingerprints, of each of which the first is enough
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_sha256")).alias("first")
    least = rows.groupBy("fp").agg(first).join(points, F.col("fp") == F.col("point")).groupBy("label").agg(F.min("first").alias("first"))
    chosen = least.select(F.col("first.doc_id").alias("__kid"), F.col("first.text_sha256").alias("__ksha"))
    same = F.col("doc_id").eqNullSafe(F.col("__kid")) & F.col("text_sha256").eqNullSafe(F.col("__ksha"))
    return keep_one_row_each(docs, rows.join(checkpointed(chosen), same, "left_semi").select("doc_id", "text_sha256"))
