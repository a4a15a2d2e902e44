"""Elements of many files in one table, read by catalog rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ingest

#: A partition for each kind of file, collector and day on which files begin.
PARTS = ("data_type", "collector_id", "file_day")
SCHEMA = ingest.ELEM_SCHEMA + ", ts timestamp, file string, place struct<block:bigint,row:bigint>, data_type string, collector_id string, file_day date"


def plain_path(path: Column) -> Column:
    """A path without the file scheme, so that a catalog's and a reader's are the same."""
    return F.regexp_replace(path, r"^file:/+", "/")


@dataclass(frozen=True)
class ElementStore:
    """A table of elements with the file that each comes from, in partitions by kind, collector and day of the file.

    The catalog's rows select partitions and files through joins whose partition filters come from the catalog at run time, so that
    neither paths nor rows of the catalog go through the driver, and files of other partitions are not opened.
    """

    spark: SparkSession
    path: str

    def add(self, files: DataFrame, form: str = "parquet") -> None:
        """Add the elements of some files of a catalog (data_type, collector_id, ts_start, url): those of one collection run. Their paths come to the driver, as those of any read do."""
        paths = [r["url"] for r in files.select("url").distinct().collect()]
        if not paths:
            return
        of = files.select(plain_path(F.col("url")).alias("__url"), "data_type", "collector_id", F.to_date("ts_start").alias("file_day")).distinct()
        rows = ingest.read_elems(self.spark, paths, form)
        kept = rows.join(of, plain_path(F.col("file")) == F.col("__url")).drop("__url")
        kept.repartition(*PARTS).sortWithinPartitions("file", "place").write.mode("append").partitionBy(*PARTS).parquet(self.path)

    def elements(self, files: DataFrame, kind: str, start: str = "ts_start") -> DataFrame:
        """The elements of these files (collector_id, url, and when they start) of one kind, with file and place."""
        rows = self.spark.read.schema(SCHEMA).parquet(self.path).where(F.col("data_type") == kind)
        # not more rows than the store has partitions
        parts = files.select(F.col("collector_id").alias("__collector"), F.to_date(start).alias("__day")).distinct()
        rows = rows.join(F.broadcast(parts), (F.col("collector_id") == F.col("__collector")) & (F.col("file_day") == F.col("__day")))
        wanted = files.select(plain_path(F.col("url")).alias("__url")).distinct()
        return rows.join(wanted, plain_path(F.col("file")) == F.col("__url"), "left_semi").drop("__collector", "__day", *PARTS)
