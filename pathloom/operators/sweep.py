"""Longest and covering matches of many prefixes by one ordered pass.

Queries and the distinct prefixes of the table are put in the order of addresses together, shorter prefixes first, by ranges.
In this order a prefix holds what follows it up to its last address, so that the prefixes around a query are
the last one before it and its parents, as far as they reach the query: a stack, kept as parents' places in arrays. Each query moves once, whatever
lengths the table has, and equal queries may lie in several ranges. What is open at the end of a range is passed on to the next ones:
one prefix for each length at most.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.prefix import KEY, masked, with_key
from pathloom.plans.scratch import checkpointed

# what runs in tasks goes along by value, so that executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Turned by this, signed halves sort as unsigned ones.
_SIGN = -(1 << 63)
_PLACE = ("family", "hi", "lo", "len")


def _ends(family: np.ndarray, hi: np.ndarray, lo: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The halves of the last addresses; halves are unsigned."""
    ones = np.uint64(0xFFFF_FFFF_FFFF_FFFF)

    def low_ones(bits: np.ndarray) -> np.ndarray:
        bits = np.clip(bits, 0, 64).astype(np.uint64)
        return np.where(bits == 64, ones, (np.uint64(1) << np.minimum(bits, np.uint64(63))) - np.uint64(1))

    free = np.where(family == 4, 32, 128) - length
    return np.where(family == 4, hi, hi | low_ones(free - 64)), lo | low_ones(free)


class Nest:
    """The table's prefixes of a range in order, each with the place of the one around it; what is open stays from batch to batch."""

    def __init__(self, open_rows: list[tuple[int, int, int, int]]):
        """open_rows: keys with unsigned halves, each around the next."""
        self.rows = np.array([(r[0], r[3]) for r in open_rows], dtype=np.int64).reshape(-1, 2)
        self.starts = np.array([r[1:3] for r in open_rows], dtype=np.uint64).reshape(-1, 2)
        self._close()

    def _close(self) -> None:
        self.ends = np.stack(_ends(self.rows[:, 0], self.starts[:, 0], self.starts[:, 1], self.rows[:, 1]), axis=1)
        self.parent = np.arange(-1, len(self.rows) - 1)

    def _beyond(self, at: np.ndarray, family: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Whether the prefixes at these places end before these addresses."""
        return (self.rows[at, 0] != family) | (self.ends[at, 0] < hi) | ((self.ends[at, 0] == hi) & (self.ends[at, 1] < lo))

    def around(self, at: np.ndarray, family: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The first of each place and its parents that reaches the address; -1 if none does."""
        at = at.copy()
        while True:
            live = np.flatnonzero(at >= 0)
            ended = live[self._beyond(at[live], family[live], hi[live], lo[live])]
            if not len(ended):
                return at
            at[ended] = self.parent[at[ended]]

    def add(self, family: np.ndarray, hi: np.ndarray, lo: np.ndarray, length: np.ndarray) -> None:
        """Keep what is open at the first of these prefixes, and put them behind it."""
        if not len(family):
            return
        chain = []
        at = len(self.rows) - 1
        while at >= 0:
            chain.append(at)
            at = int(self.parent[at])
        chain = chain[::-1]
        self.rows = np.concatenate([self.rows[chain], np.stack([family, length], axis=1)])
        self.starts = np.concatenate([self.starts[chain], np.stack([hi, lo], axis=1)])
        old = len(chain)
        self._close()
        parent = self.parent.tolist()
        ends = [(f, int(h), int(x)) for f, (h, x) in zip(self.rows[:, 0].tolist(), self.ends.tolist(), strict=True)]
        starts = [(f, int(h), int(x)) for f, (h, x) in zip(self.rows[:, 0].tolist(), self.starts.tolist(), strict=True)]
        for i in range(old, len(parent)):
            at = i - 1
            while at >= 0 and (ends[at][0] != starts[i][0] or ends[at] < starts[i]):
                at = parent[at]
            parent[i] = at
        self.parent = np.array(parent, dtype=np.int64)

    def open_rows(self) -> list[tuple[int, int, int, int]]:
        out, at = [], len(self.rows) - 1
        while at >= 0:
            out.append((int(self.rows[at, 0]), int(self.starts[at, 0]), int(self.starts[at, 1]), int(self.rows[at, 1])))
            at = int(self.parent[at])
        return out[::-1]


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    family, length = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("family", "len"))
    hi, lo = (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) ^ np.uint64(1 << 63) for c in ("hi", "lo"))
    return family, hi, lo, length


def _matched(queries: DataFrame, table: DataFrame, query: str, prefix: str, every: bool) -> DataFrame:
    t = with_key(table.withColumnRenamed(prefix, "matched_prefix"), "matched_prefix", "t")
    q = with_key(queries, query, "q")
    turned = lambda c: F.col(c).bitwiseXOR(F.lit(_SIGN).cast("long"))
    row = F.struct(*[F.col(f"`{c}`") for c in queries.columns])
    place = lambda s: [F.col(f"{s}_family").cast("int").alias("family"), turned(f"{s}_hi").alias("hi"), turned(f"{s}_lo").alias("lo"), F.col(f"{s}_len").alias("len")]
    asked = q.select(*place("q"), F.lit(1).alias("side"), F.monotonically_increasing_id().alias("salt"), row.alias("row"))
    held = t.select(*place("t")).distinct().select(*_PLACE, F.lit(0).alias("side"), F.lit(0).cast("long").alias("salt"), F.lit(None).cast(asked.schema["row"].dataType).alias("row"))
    order = [*_PLACE, "side", "salt"]
    # the salt parts equal queries, so that a range is never one key
    ordered = checkpointed(asked.unionByName(held).repartitionByRange(*order).sortWithinPartitions(*order))

    def last_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nest, part = Nest([]), None
        for batch in batches:
            if len(batch):
                part = batch.column("part")[0].as_py()
                nest.add(*_columns(batch))
        if part is not None:
            rows = nest.open_rows()
            text = [";".join(",".join(map(str, r)) for r in rows)]
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array(text, pa.string())], names=["part", "open"])

    ends = ordered.where("side = 0").select(*_PLACE, F.spark_partition_id().alias("part")).mapInArrow(last_open, "part int, open string")
    # a list for each range, of one prefix for each length at most
    carried, stack = [], []
    for r in sorted(ends.collect(), key=lambda r: r["part"]):
        own = [tuple(map(int, x.split(","))) for x in r["open"].split(";") if x]
        first = own[0] if own else None
        stack = [s for s in stack if first is None or _reaches(s, first)] + own
        carried.append((r["part"], list(stack)))
    shared = queries.sparkSession.sparkContext.broadcast(carried)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nest = None
        for batch in batches:
            if not len(batch):
                continue
            if nest is None:
                part = batch.column("part")[0].as_py()
                nest = Nest(next((rows for p, rows in reversed(shared.value) if p < part), []))
            family, hi, lo, length = _columns(batch)
            own = batch.column("side").to_numpy() == 0
            before = len(nest.open_rows()) if own.any() else len(nest.rows)
            nest.add(family[own], hi[own], lo[own], length[own])
            at = before - 1 + np.cumsum(own)
            asks = np.flatnonzero(~own)
            found = nest.around(at[asks], family[asks], hi[asks], lo[asks])
            while (hit := np.flatnonzero(found >= 0)).size:
                yield pa.record_batch([batch.column("row").take(pa.array(asks[hit])), *[batch.column(c).take(pa.array(asks[hit])) for c in ("family", "hi", "lo")], pa.array(nest.rows[found[hit], 1], pa.int32())], names=["row", "family", "hi", "lo", "matched_len"])
                if not every:
                    break
                asks, found = asks[hit], nest.parent[found[hit]]

    kind = asked.schema["row"].dataType.simpleString()
    met = ordered.select("row", *_PLACE, "side", F.spark_partition_id().alias("part")).mapInArrow(find, f"row {kind}, family int, hi long, lo long, matched_len int")
    hi, lo = masked(F.col("family"), turned("hi"), turned("lo"), F.col("matched_len"))
    keyed = met.select("row.*", F.col("family").alias("a_family"), hi.alias("a_hi"), lo.alias("a_lo"), F.col("matched_len").alias("a_len"))
    same = (F.col("a_family") == F.col("t_family")) & (F.col("a_hi") == F.col("t_hi")) & (F.col("a_lo") == F.col("t_lo")) & (F.col("a_len") == F.col("t_len"))
    return keyed.join(t, same).drop(*[f"{s}_{k}" for s in ("a", "t") for k in KEY])


def _reaches(row: tuple[int, int, int, int], other: tuple[int, int, int, int]) -> bool:
    """Whether a prefix reaches the first address of another that comes after it."""
    family, hi, lo, length = (np.array([x], dtype=d) for x, d in zip(row, (np.int64, np.uint64, np.uint64, np.int64), strict=True))
    end_hi, end_lo = _ends(family, hi, lo, length)
    return row[0] == other[0] and (int(end_hi[0]), int(end_lo[0])) >= (other[1], other[2])


def longest(queries: DataFrame, table: DataFrame, query: str = "query", prefix: str = "prefix") -> DataFrame:
    """Each row of queries with the rows of the longest prefix that contains it, as match.longest() gives them; rows without a key match nothing.

    Any number of queries and of lengths; no row is multiplied by lengths. Rows that repeat come each time.
    """
    return _matched(queries, table, query, prefix, every=False)


def covering(queries: DataFrame, table: DataFrame, query: str = "query", prefix: str = "prefix") -> DataFrame:
    """Each row of queries with every row of table whose prefix contains it, itself included, as match.covering() gives them."""
    return _matched(queries, table, query, prefix, every=True)
