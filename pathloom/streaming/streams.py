"""Search and routing state as streams over files of elements."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from pathloom.operators.filters import RouteFilters
from pathloom.operators.rib import ROUTE


def element_stream(spark: SparkSession, path: str, schema: StructType | str, files_at_once: int = 8) -> DataFrame:
    """Elements of a folder of Parquet files, so many new files in each batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


class Delivered:
    """How many rows a capped stream has handed on, kept beside the stream's checkpoint by batch, so that a batch that runs again starts from the same number."""

    def __init__(self, spark: SparkSession, checkpoint: str, most: int):
        self.spark, self.folder, self.most = spark, f"{checkpoint}-delivered", most
        self.full = self.before(None) >= most

    def before(self, number: int | None) -> int:
        """Rows handed on by the batches before this one; by all, for None."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return 0
        rows = self.spark.read.schema("rows bigint, batch int").option("basePath", self.folder).parquet(self.folder)
        rows = rows if number is None else rows.where(F.col("batch") < number)
        return rows.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]

    def record(self, number: int, rows: int) -> None:
        self.spark.createDataFrame([(rows,)], "rows bigint").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/batch={number}")
        self.full = self.before(number) + rows >= self.most


def search_stream(
    stream: DataFrame, filters: RouteFilters, sink: Callable[[DataFrame, int], None], checkpoint: str, most: int | None = None, order: str = "seq",
) -> StreamingQuery:
    """Matching elements of each batch to a sink as they are read, until the files there are used up, or most rows were handed on.

    Filters whose prefix sets need the data's lengths run on the batch, the others on the stream. With a cap the batch in which it
    is reached hands on its first rows in the given order, and no file of a later batch is read; the number is
    shared by all batches and runs of one checkpoint, and a batch that runs again hands on the same rows.
    """
    plain = RouteFilters(**{k: v for k, v in vars(filters).items() if k not in ("prefixes", "include_super", "include_sub")})
    spark = stream.sparkSession
    count = None if most is None else Delivered(spark, checkpoint, most)

    def deliver(batch: DataFrame, number: int) -> None:
        rows = filters.apply_prefixes(batch)
        if count is None:
            sink(rows, number)
            return
        left = count.most - count.before(number)
        if left <= 0:
            # the batch is lazy: what isn't asked for isn't read
            return
        first = rows.orderBy(order).limit(left).persist()
        sink(first, number)
        count.record(number, first.count())
        first.unpersist()

    query = plain.apply(stream).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(deliver).start()
    if count is not None:
        threading.Thread(target=_stop_when_full, args=(query, count), daemon=True).start()
    return query


def _stop_when_full(query: StreamingQuery, count: Delivered) -> None:
    while query.isActive:
        if count.full:
            query.stop()
        time.sleep(0.05)


class RoutingState:
    """The routing table as a stream of updates leaves it, kept as runs that are merged when read.

    A run holds the last event of each of its routes. Each batch writes a run of its own routes alone, so that what it writes grows with
    the batch and not with the table; an event decides only if its seq is past that of every other run's, so late and repeated updates
    change nothing. As many runs of one level as fanout are merged to one of the next, and the oldest run, which the stream began with, takes
    the others in once they have a fanout-th of its rows: each row is rewritten a few times in all. A small list for each batch says
    which runs make up the table; a batch that runs again starts from the same list and writes the same run and list. Withdrawn routes stay as marks with
    their seq until they are merged into the oldest run, where those that are keep_marks behind its last seq are forgotten.
    """

    def __init__(self, spark: SparkSession, path: str, values: list[str], filters: RouteFilters | None = None, fanout: int = 8, keep_marks: int | None = None):
        self.spark, self.path, self.values, self.filters = spark, path, values, filters or RouteFilters()
        self.fanout, self.keep_marks, self.batches = fanout, keep_marks, 0

    def _run(self, name: str) -> str:
        return f"{self.path}/runs/{name}"

    def _list(self, number: int) -> str:
        return f"{self.path}/lists/batch={number:09d}"

    def runs(self, number: int) -> list[tuple[str, int, int]]:
        """(name, level, rows) of the runs of the table after a batch, the oldest first; about fanout for each level."""
        rows = self.spark.read.parquet(self._list(number)).collect()
        return [(r["name"], r["level"], r["rows"]) for r in sorted(rows, key=lambda r: r["place"])]

    def _columns(self, rows: DataFrame) -> DataFrame:
        return rows.select(*[c for c in ROUTE if c in rows.columns], "seq", "elem_type", "is_match", *self.values)

    def _last(self, rows: DataFrame) -> DataFrame:
        """The last event of each route."""
        key = [c for c in ROUTE if c in rows.columns]
        rest = F.struct(*[c for c in rows.columns if c not in key])
        return rows.groupBy(*key).agg(F.max_by(rest, "seq").alias("l")).select(*key, "l.*").select(*rows.columns)

    def _write(self, rows: DataFrame, name: str) -> int:
        rows.write.mode("overwrite").parquet(self._run(name))
        return self.spark.read.parquet(self._run(name)).count()

    def _merged(self, names: list[str]) -> DataFrame:
        schema = self.spark.read.parquet(self._run(names[0])).schema
        return self._last(self.spark.read.schema(schema).parquet(*[self._run(n) for n in names]))

    def _store_list(self, runs: list[tuple[str, int, int]], number: int) -> None:
        rows = [(i, *run) for i, run in enumerate(runs)]
        self.spark.createDataFrame(rows, "place int, name string, level int, rows long").coalesce(1).write.mode("overwrite").parquet(self._list(number))
        self.batches = number

    def start(self, base: DataFrame) -> None:
        """Write the table that the stream begins with; base has key columns, seq and values."""
        rows = self._columns(base.withColumn("elem_type", F.lit("A")).withColumn("is_match", self.filters.announce_predicate()))
        self._store_list([("base-000000000", -1, self._write(self._last(rows), "base-000000000"))], 0)

    def apply(self, batch: DataFrame, number: int) -> None:
        """Fold one batch; number counts from 0."""
        updates = self._columns(self.filters.safe(batch).withColumn("is_match", self.filters.announce_predicate()))
        runs, name = self.runs(number), f"run-{number + 1:09d}-0"
        runs.append((name, 0, self._write(self._last(updates), name)))
        self._store_list(self._settled(runs, number + 1), number + 1)

    def _settled(self, runs: list[tuple[str, int, int]], number: int) -> list[tuple[str, int, int]]:
        """runs after the merges that are due: the newest of one level, then all into the oldest."""
        while len(same := [r for r in runs if r[1] == runs[-1][1] >= 0]) >= self.fanout:
            level = same[0][1] + 1
            name = f"run-{number:09d}-{level}"
            runs = [r for r in runs if r not in same] + [(name, level, self._write(self._merged([r[0] for r in same]), name))]
        if sum(r[2] for r in runs[1:]) * self.fanout >= runs[0][2]:
            runs = [(f"base-{number:09d}", -1, self._write(self._without_marks(self._merged([r[0] for r in runs])), f"base-{number:09d}"))]
        return runs

    def _without_marks(self, rows: DataFrame) -> DataFrame:
        if self.keep_marks is None:
            return rows
        live = (F.col("elem_type") == "A") & F.coalesce("is_match", F.lit(False))
        end = rows.agg(F.max("seq")).first()[0]
        return rows.where(live | (F.col("seq") > F.lit(end) - self.keep_marks))

    def follow(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(self.apply).start()

    def resume(self, number: int) -> RoutingState:
        """This state after number batches, as a stream that goes on from its checkpoint finds it."""
        self.batches = number
        return self

    def table(self, number: int | None = None) -> DataFrame:
        """The routes that are there after number batches, or after the last that this object applied."""
        rows = self._merged([r[0] for r in self.runs(self.batches if number is None else number)])
        return rows.where((F.col("elem_type") == "A") & F.coalesce("is_match", F.lit(False))).drop("elem_type", "is_match")

    def unused(self, number: int) -> list[str]:
        """Folders that no table from batch number on reads, for the caller to delete once no batch before it can run again."""
        used = {r[0] for n in range(number, self.batches + 1) for r in self.runs(n)}
        known = {r[0] for n in range(number) for r in self.runs(n)}
        return [self._run(n) for n in sorted(known - used)] + [self._list(n) for n in range(number)]
