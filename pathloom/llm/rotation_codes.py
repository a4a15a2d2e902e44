"""Near-duplicate vectors by randomised-rotation binary codes.

A unit vector is turned by a random rotation and kept as the signs of its components, a point of the hypercube, with the
inner product of vector and point as its correction factor. A second vector's product with that point, divided by
the factor, is an unbiased estimate of the cosine, and its error has a known spread; so the estimate and its confidence bound say which pairs
can reach the wanted cosine, and only these are computed again from the exact vectors.

Which pairs are looked at: signs under further rotations are the keys of tables, and pairs meet in a table where all their signs are equal.
Tables and signs are chosen so that a pair at the wanted cosine meets with a probability of REACH at least; a nearer pair almost surely.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, stored
from .components import stars

COSINE, SEED = 0.98, 2025
#: Standard deviations of the estimate's error that its confidence bound takes (one pair in 30,000 falls outside), and the share of pairs at the very limit that meet.
DEVIATIONS, REACH = 4.0, 0.999
#: Moving one more vector to a table costs as much as comparing it with so many others.
MOVE = 2048
#: Vectors of one task's square; a fuller bucket is compared in squares of two blocks. Pairs estimated at a time.
BLOCK, PAIRS = 2048, 1 << 20


#: Rotations that a task has drawn, by seed, dimensions and number.
_DRAWN: dict[tuple[int, int, int], np.ndarray] = {}


def rotation(dim: int, number: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix; number tells those of one seed apart."""
    if (seed, dim, number) not in _DRAWN:
        if len(_DRAWN) > 256:
            _DRAWN.clear()
        q, r = np.linalg.qr(np.random.default_rng([seed, dim, number]).normal(size=(dim, dim)))
        _DRAWN[seed, dim, number] = q * np.sign(np.diag(r))
    return _DRAWN[seed, dim, number]


def plan_tables(count: int, dim: int, cosine: float = COSINE, reach: float = REACH, move: int = MOVE) -> tuple[int, int]:
    """(tables, signs of each) that find pairs at this cosine among count vectors with the given probability at the least cost.

    No sign means one table, in which all pairs meet.
    """
    same = 1 - math.acos(min(1.0, max(-1.0, cosine))) / math.pi
    best = None
    for signs in range(min(64, dim) + 1):
        chance = same**signs
        tables = 1 if chance >= reach else math.ceil(math.log(1 - reach) / math.log(1 - chance))
        cost = tables * (count / 2.0**signs + move)
        if best is None or cost < best[0]:
            best = (cost, tables, signs)
    return best[1], best[2]


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two near their largest component, so that squares neither overflow nor vanish; exact."""
    top = np.abs(x).max(axis=1, initial=0)
    return np.ldexp(x, -np.frexp(top)[1][:, None])


def _unit(x: np.ndarray) -> np.ndarray:
    s = _scaled(x)
    return s / np.sqrt((s * s).sum(axis=1))[:, None]


def binary_codes(unit: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(packed signs, correction factor) of unit vectors under the first rotation."""
    turned = unit @ rotation(unit.shape[1], 0, seed).T
    return np.packbits(turned >= 0, axis=1, bitorder="little"), np.abs(turned).sum(axis=1) / math.sqrt(unit.shape[1])


def table_key(unit: np.ndarray, table: int, signs: int, seed: int = SEED) -> np.ndarray:
    """The signs under a table's own rotation, as a number."""
    turned = unit @ rotation(unit.shape[1], 1 + table, seed)[:signs].T
    return ((turned >= 0) * (np.uint64(1) << np.arange(signs, dtype=np.uint64))).sum(axis=1, dtype=np.uint64).view(np.int64)


def estimates(codes: np.ndarray, factors: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """Estimated cosines of coded vectors (rows) with vectors turned by the same rotation (columns)."""
    dim = turned.shape[1]
    points = np.unpackbits(codes, axis=1, bitorder="little", count=dim).astype(np.float32) * 2 - 1
    return (points @ turned.T.astype(np.float32)) / (factors[:, None] * math.sqrt(dim)).astype(np.float32)


def least_estimate(factors: np.ndarray, dim: int, cosine: float = COSINE, deviations: float = DEVIATIONS) -> np.ndarray:
    """What the estimate of a pair of this cosine or more reaches, within the confidence bound.

    The error is the part of the other vector beside the coded one, sqrt(1 - cosine**2), times a component of a random direction
    in dim - 1 dimensions, times sqrt(1 - factor**2) / factor; a component is never above one, where the bound is certain.
    """
    component = min(1.0, deviations / math.sqrt(max(1, dim - 1)))
    beside = math.sqrt(max(0.0, 1 - cosine * cosine))
    return cosine - beside * component * np.sqrt(np.maximum(0.0, 1 - factors**2)) / np.maximum(factors, 1e-12) - 1e-4


class Square:
    """Distinct vectors that one task compares: codes estimate, exact vectors decide."""

    def __init__(self, part: pd.DataFrame, dim: int, cosine: float, deviations: float, seed: int):
        self.points = part["point"].to_numpy()
        self.copies = part["copies"].to_numpy()
        self.vectors = np.frombuffer(b"".join(part["vector"]), dtype=np.float64).reshape(len(part), dim)
        self.codes = np.frombuffer(b"".join(part["code"]), dtype=np.uint8).reshape(len(part), -1)
        self.factors = part["factor"].to_numpy()
        self.tables = part["tables"].to_numpy()[0]
        self.signs = part["signs"].to_numpy()[0]
        self.scaled = _scaled(self.vectors)
        self.norms = np.sqrt((self.scaled * self.scaled).sum(axis=1))
        self.unit = self.scaled / self.norms[:, None]
        self.turned = self.unit @ rotation(dim, 0, seed).T
        self.least = least_estimate(self.factors, dim, cosine, deviations)
        self.cosine, self.seed, self.computed = cosine, seed, 0

    def pairs(self, table: int, left: np.ndarray, right: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(i, j) of the linked pairs of left and right (indexes; same: one block with itself) that met in no table before this one."""
        earlier = np.stack([table_key(self.unit, t, self.signs, self.seed) for t in range(table)], axis=1) if table else None
        step = max(1, PAIRS // max(1, len(right)))
        for start in range(0, len(left), step):
            rows = left[start : start + step]
            near = estimates(self.codes[rows], self.factors[rows], self.turned[right]) >= self.least[rows, None]
            i, j = np.nonzero(near)
            if same:
                up = j > i + start
                i, j = i[up], j[up]
            i, j = rows[i], right[j]
            if earlier is not None and len(i):
                new = ~(earlier[i] == earlier[j]).any(axis=1)
                i, j = i[new], j[new]
            self.computed += len(i)
            for k in range(0, len(i), 1 << 16):
                a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                exact = (self.scaled[a] * self.scaled[b]).sum(axis=1) / (self.norms[a] * self.norms[b])
                yield a[exact >= self.cosine], b[exact >= self.cosine]

    def linked(self, table: int, left: np.ndarray, right: np.ndarray, same: bool) -> pd.DataFrame:
        """(point, links, root): for each point with links here how many other vectors, and the least point that they reach."""
        links = np.zeros(len(self.points), dtype=np.int64)
        root = np.arange(len(self.points))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in self.pairs(table, left, right, same):
            np.add.at(links, a, self.copies[b])
            np.add.at(links, b, self.copies[a])
            # pairs that are under one root already are most of those of a large group
            apart = root[a] != root[b]
            for x, y in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
                x, y = find(x), find(y)
                if x != y:
                    root[max(x, y)] = min(x, y)
            while (root[root] != root).any():
                root = root[root]
        has = np.flatnonzero(links)
        return pd.DataFrame({"point": self.points[has], "links": links[has], "root": self.points[root[has]]})


def _rows(vectors: DataFrame, vector: str, key: str, label: str) -> DataFrame:
    """(vec_id, label, dim, digest, vector) of each row, stored; dim, digest and vector are null where it links with nothing."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, digests, raws = [], [], []
            values = batch.column("v")
            whole = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            lengths = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(lengths)
            labelled = batch.column("label").is_valid().to_numpy(zero_copy_only=False)
            for end, n, ok in zip(ends.tolist(), lengths.tolist(), labelled.tolist(), strict=True):
                x = whole[end - n : end]
                ok = ok and n > 0 and bool(np.isfinite(x).all()) and bool((x != 0).any())
                raw = (x + 0.0).tobytes() if ok else None
                dims.append(n if ok else None)
                digests.append(hashlib.blake2b(raw, digest_size=16).digest() if ok else None)
                raws.append(raw)
            yield pa.record_batch([batch.column("vec_id"), batch.column("label"), pa.array(dims, pa.int32()), pa.array(digests, pa.binary()), pa.array(raws, pa.binary())], names=["vec_id", "label", "dim", "digest", "vector"])

    read = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    kind = read.schema["label"].dataType.simpleString()
    return stored(read.mapInArrow(emit, f"vec_id long, label {kind}, dim int, digest binary, vector binary"))


def coded(rows: DataFrame, cosine: float = COSINE, seed: int = SEED, reach: float = REACH, move: int = MOVE) -> DataFrame:
    """The index, stored: a row for each distinct vector of a label, with its code, correction factor, copies and least id.

    tables and signs say how its label's vectors are searched.
    """
    points = rows.where(F.col("dim").isNotNull()).groupBy("label", "dim", "digest").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"), F.min("vector").alias("vector"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                x = np.frombuffer(b"".join(part.column("vector").to_pylist()), dtype=np.float64).reshape(len(part), dim)
                codes, factors = binary_codes(_unit(x), seed)
                yield pa.record_batch([*part.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(factors)], names=[*part.schema.names, "code", "factor"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema)
    index = stored(points.mapInArrow(emit, f"{fields}, code binary, factor double").withColumn("point", F.monotonically_increasing_id()))
    sizes = index.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = [plan_tables(n, d, cosine, reach, move) for n, d in zip(batch.column("n").to_pylist(), batch.column("dim").to_pylist(), strict=True)]
            yield pa.record_batch([batch.column("label"), batch.column("dim"), pa.array([c[0] for c in chosen], pa.int32()), pa.array([c[1] for c in chosen], pa.int32())], names=["__label", "__dim", "tables", "signs"])

    kind = index.schema["label"].dataType.simpleString()
    plans = checkpointed(sizes.mapInArrow(choose, f"__label {kind}, __dim int, tables int, signs int"))
    return index.join(plans, (F.col("label") == F.col("__label")) & (F.col("dim") == F.col("__dim"))).drop("__label", "__dim")


def _met(index: DataFrame, seed: int) -> DataFrame:
    """(label, dim, table, key, point): the bucket of each point in each table, without its vector."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = np.stack([batch.column(c).to_numpy() for c in ("dim", "tables", "signs")], axis=1)
            for dim, tables, signs in np.unique(kinds, axis=0).tolist():
                part = batch.filter(pa.array((kinds == (dim, tables, signs)).all(axis=1)))
                unit = _unit(np.frombuffer(b"".join(part.column("vector").to_pylist()), dtype=np.float64).reshape(len(part), dim))
                for t in range(tables):
                    yield pa.record_batch(
                        [part.column("label"), part.column("dim"), pa.array(np.full(len(part), t), pa.int32()), pa.array(table_key(unit, t, signs, seed), pa.int64()), part.column("point")],
                        names=["label", "dim", "table", "key", "point"],
                    )

    kind = index.schema["label"].dataType.simpleString()
    return index.select("label", "dim", "tables", "signs", "vector", "point").mapInArrow(emit, f"label {kind}, dim int, table int, key long, point long")


def linked_points(index: DataFrame, cosine: float = COSINE, deviations: float = DEVIATIONS, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """(point, links, root): from each task, the vectors that a point links with there and the least point reached."""
    met = stored(_met(index, seed))
    # a bucket of more than a block is compared in squares: each point goes to those of its own block with every block
    full = met.groupBy("label", "dim", "table", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    full = checkpointed(full.select(*[F.col(c).alias(f"__{c}") for c in ("label", "dim", "table", "key")], F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    same = (F.col("label") == F.col("__label")) & (F.col("dim") == F.col("__dim")) & (F.col("table") == F.col("__table")) & (F.col("key") == F.col("__key"))
    blocks = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64("point"), blocks).cast("int")
    dealt = met.join(full, same, "left").select("label", "dim", "table", "key", "point", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    dealt = dealt.select("label", "dim", "table", "key", "point", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    whole = index.select(F.col("point").alias("__point"), "copies", "vector", "code", "factor", "tables", "signs")
    cells = max(1, -(-met.count() // (block // 2)))
    # small buckets share a task
    dealt = dealt.withColumn("cell", F.struct(F.pmod(F.xxhash64("label", "dim", "table", "key"), F.lit(cells)).alias("c"), "low", "high"))
    order = ["label", "dim", "table", "key"]

    def search(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([*order, "own", "point"], ignore_index=True)
        first = np.flatnonzero((part[order] != part[order].shift()).any(axis=1).to_numpy())
        out = []
        for i, j in zip(first.tolist(), [*first[1:].tolist(), len(part)], strict=True):
            if j - i < 2:
                continue
            bucket = part.iloc[i:j]
            square = Square(bucket, int(bucket["dim"].iloc[0]), cosine, deviations, seed)
            low, high, mine = bucket["low"].iloc[0], bucket["high"].iloc[0], bucket["own"].to_numpy()
            left, right = np.flatnonzero(mine == low), np.flatnonzero(mine == high)
            found = square.linked(int(bucket["table"].iloc[0]), left, right, low == high)
            if len(found):
                out.append(found)
        return pd.concat(out) if out else pd.DataFrame({"point": [], "links": [], "root": []}).astype("int64")

    return dealt.join(whole, F.col("point") == F.col("__point")).drop("__point").groupBy("cell").applyInPandas(search, "point long, links long, root long")


def near_duplicates(
    vectors: DataFrame, cosine: float = COSINE, vector: str = "embedding", key: str = "vec_id", label: str = "label",
    deviations: float = DEVIATIONS, seed: int = SEED, reach: float = REACH, move: int = MOVE, block: int = BLOCK,
) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors: links join vectors of one label with a cosine of at least cosine.

    The cosine of every link is computed in double precision from the exact vectors; a pair that the codes rule out isn't computed.
    Vectors that are null, empty or zero or hold a null or non-finite component, and rows without a label, link with nothing; nor do vectors of
    different lengths. Equal vectors of a label are one point of the search, so any number of copies costs one. Rows that repeat an id are rows like
    others; a null id is never a component_id, which is null only where a component has no other. Where links tie nothing is chosen. An empty table
    gives no rows. A bucket of any size is compared whole, in squares of bounded size.
    """
    rows = _rows(vectors, vector, key, label)
    index = stored(coded(rows, cosine, seed, reach, move))
    found = stored(linked_points(index, cosine, deviations, seed, block))
    links = found.groupBy(F.col("point").alias("__point")).agg(F.sum("links").alias("links"))
    star = stars(found.select(F.col("point").alias("a"), F.col("root").alias("b")).where("a <> b")).select(F.col("a").alias("__a"), F.col("b").alias("__b"))
    points = index.select("label", "dim", "digest", "copies", "least", "point").join(links, F.col("point") == F.col("__point"), "left").join(star, F.col("point") == F.col("__a"), "left")
    points = checkpointed(points.select("label", "dim", "digest", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("__b", "point").alias("of")))
    least = points.groupBy(F.col("of").alias("__of")).agg(F.min("least").alias("component_id"))
    known = points.join(least, F.col("of") == F.col("__of")).select(F.col("label").alias("__label"), F.col("dim").alias("__dim"), F.col("digest").alias("__digest"), "n_links", "component_id")
    same = (F.col("label") == F.col("__label")) & (F.col("dim") == F.col("__dim")) & (F.col("digest") == F.col("__digest"))
    # rows without a usable vector would meet under one null key
    linked = rows.where(F.col("dim").isNotNull()).select("vec_id", "label", "dim", "digest").join(known, same).select("vec_id", "n_links", "component_id")
    alone = rows.where(F.col("dim").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
