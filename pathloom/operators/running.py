"""Exact statistics of a growing search as sums of parts: coded values in bitmaps that merge."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.plans.scratch import stored

#: Columns whose distinct values are counted, and the names of the counts.
DISTINCT = {"prefix": "prefixes", "peer_asn": "peers"}


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _numbered(values: DataFrame, first: int) -> DataFrame:
    """values with code: first, first + 1, ... in no order; parts number their own rows and move by the sizes of the parts before."""
    rows = stored(values.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = rows.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", before.alias("__before"))
    code = F.lit(first) + F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1).cast("bigint"))
    # a row for each part
    return rows.join(F.broadcast(offsets), part == F.col("__part")).select(*values.columns, code.cast("bigint").alias("code"))


@dataclass(frozen=True)
class RunningStatistics:
    """Matched elements, distinct prefixes and distinct peers of each collector, kept by batch.

    Each batch adds to a dictionary the values that no batch had before, as dense codes, and writes its counts and its bitmaps of codes, so that it reads its
    own rows and the dictionary alone. Totals are the sum of counts and the bits of the union of bitmaps; so they are exact, and parts may be added up in
    any order or for any choice of batches. A batch that runs again replaces what it wrote. Null values are not counted, a null collector is one of its own.
    """

    spark: SparkSession
    path: str

    def _codes(self, number: int | None = None) -> DataFrame | None:
        """The dictionary, (kind, value, code), before a batch."""
        if not _exists(self.spark, f"{self.path}/codes"):
            return None
        rows = self.spark.read.schema("kind string, value string, code bigint, batch int").parquet(f"{self.path}/codes")
        return rows if number is None else rows.where(F.col("batch") < number)

    def add(self, elems: DataFrame, number: int) -> None:
        """Take in a batch; number counts from 0."""
        values = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in DISTINCT]))
        pairs = elems.select("collector", values.alias("v")).select("collector", "v.*").where("value IS NOT NULL").distinct()
        pairs = stored(pairs)
        met = pairs.select("kind", "value").distinct()
        old = self._codes(number)
        first = 0
        if old is not None:
            first = old.agg(F.coalesce(F.max("code") + 1, F.lit(0))).first()[0]
            met = met.join(old.select("kind", "value"), ["kind", "value"], "left_anti")
        _numbered(met, first).write.mode("overwrite").parquet(f"{self.path}/codes/batch={number}")
        coded = pairs.join(self._codes(number + 1).select("kind", "value", "code"), ["kind", "value"])
        bits = coded.groupBy("collector", "kind", F.expr("bitmap_bucket_number(code)").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("code")).alias("bits"))
        bits.write.mode("overwrite").parquet(f"{self.path}/bits/batch={number}")
        elems.groupBy("collector").agg(F.count(F.lit(1)).alias("matched")).write.mode("overwrite").parquet(f"{self.path}/counts/batch={number}")

    def totals(self, batches: list[int] | None = None) -> DataFrame:
        """collector, matched, prefixes, peers over all batches or some, as search.by_collector() gives them of all elements."""
        some = lambda df: df if batches is None else df.where(F.col("batch").isin(batches))
        bits = some(self.spark.read.parquet(f"{self.path}/bits")).groupBy("collector", "kind", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
        distinct = bits.groupBy(F.col("collector").alias("__of")).agg(*[F.coalesce(F.sum(F.when(F.col("kind") == c, F.col("n"))), F.lit(0)).alias(name) for c, name in DISTINCT.items()])
        counts = some(self.spark.read.parquet(f"{self.path}/counts")).groupBy("collector").agg(F.sum("matched").alias("matched"))
        joined = counts.join(distinct, F.col("collector").eqNullSafe(F.col("__of")), "left")
        return joined.select("collector", "matched", *[F.coalesce(n, F.lit(0)).alias(n) for n in DISTINCT.values()])
