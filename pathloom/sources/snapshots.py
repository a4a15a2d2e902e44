"""Routing tables kept in buckets by route, so that a replay starts from the nearest one and doesn't move it."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pathloom.operators.rib import ROUTE

#: What stands for a route without a path identifier, as a bucket's columns are compared as equal.
NO_PATH = -1
BUCKETS = 64


@dataclass(frozen=True)
class SnapshotStore:
    """Unfiltered routing tables at instants, one table of the session's catalog each, bucketed and sorted by route.

    name begins the tables' names, folder is where their files are; a new session finds them by attach().
    """

    spark: SparkSession
    name: str
    folder: str
    values: tuple[str, ...]
    buckets: int = BUCKETS

    def _table(self, instant: int) -> str:
        return f"{self.name}_{instant}"

    def _key(self, rows: DataFrame) -> list[str]:
        return [c for c in ROUTE if c in rows.columns and c != "dump_ts"]

    def _plain(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("path_id", F.coalesce(F.col("path_id"), F.lit(NO_PATH).cast("bigint"))) if "path_id" in rows.columns else rows

    def write(self, routes: DataFrame, instant: int) -> None:
        """Keep the table at an instant, in seconds; its key columns but path_id are never null."""
        rows = self._plain(routes)
        key = self._key(rows)
        dealt = rows.select(*key, *self.values).repartition(self.buckets, *key)
        dealt.write.mode("overwrite").format("parquet").option("path", f"{self.folder}/at={instant}").bucketBy(self.buckets, *key).sortBy(*key).saveAsTable(self._table(instant))
        listed = self.spark.createDataFrame([(instant, dealt.select(*key, *self.values).schema.json(), ",".join(key))], "at bigint, columns string, route string")
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/list/{instant}")

    def instants(self) -> list[int]:
        """The instants that there are tables of, in order."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/list")
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return []
        return sorted(r["at"] for r in self.spark.read.parquet(f"{self.folder}/list/*").select("at").collect())

    def attach(self) -> None:
        """Make the tables known to this session's catalog, with their buckets."""
        for r in self.spark.read.parquet(f"{self.folder}/list/*").collect() if self.instants() else []:
            fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(json.loads(r["columns"])))
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self._table(r['at'])} ({fields}) USING parquet CLUSTERED BY ({r['route']}) SORTED BY ({r['route']}) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/at={r['at']}'")

    def nearest(self, instant: int) -> int | None:
        """The last instant at or before this one that there is a table of."""
        return max((i for i in self.instants() if i <= instant), default=None)

    def at(self, instant: int) -> DataFrame:
        return self._shown(self.spark.table(self._table(instant)))

    def _shown(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("path_id", F.when(F.col("path_id") != NO_PATH, F.col("path_id"))) if "path_id" in rows.columns else rows

    def replayed(self, updates: DataFrame, instant: int, matches: Column | None = None) -> DataFrame:
        """The table at an instant: the nearest kept one and the updates (seq, ts, elem_type, key, values) behind it, each route once.

        updates are all there are, or any that hold those between the two instants, in the order of seq. The updates' last events go to the buckets of their routes, and
        the kept table is read bucket by bucket as it lies. matches is a condition on key and values; a route whose last announcement doesn't match isn't there.
        ValueError if no table is kept at or before the instant.
        """
        start = self.nearest(instant)
        if start is None:
            raise ValueError(f"no table is kept at or before {instant}")
        match = F.lit(True) if matches is None else F.coalesce(matches, F.lit(False))
        base = self.spark.table(self._table(start))
        key = self._key(base)
        since = self._plain(updates).where((F.col("ts") > F.timestamp_seconds(F.lit(start))) & (F.col("ts") <= F.timestamp_seconds(F.lit(instant))))
        row = F.struct("elem_type", *self.values)
        last = since.select(*key, "seq", row.alias("row")).repartition(self.buckets, *key).groupBy(*key).agg(F.max_by("row", "seq").alias("last"))
        last = last.select(*[F.col(k).alias(f"__{k}") for k in key], "last")
        same = reduce(Column.__and__, [F.col(k) == F.col(f"__{k}") for k in key])
        both = base.join(last, same, "full")
        touched = F.col("last").isNotNull()
        rows = both.where(~touched | (F.col("last.elem_type") == "A"))
        rows = rows.select(*[F.coalesce(F.col(k), F.col(f"__{k}")).alias(k) for k in key], *[F.when(touched, F.col(f"last.{v}")).otherwise(F.col(v)).alias(v) for v in self.values])
        return self._shown(rows).where(match)

    def extend(self, updates: DataFrame, instant: int) -> None:
        """Keep the table at a later instant, replayed from the nearest one."""
        self.write(self.replayed(updates, instant), instant)
