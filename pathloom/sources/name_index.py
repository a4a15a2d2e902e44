"""A kept index of names by runs of up to three characters, from which searches read only the partitions that they need."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.operators import asinfo
from pathloom.plans.scratch import stored

LONGEST, PARTS = 3, 16
#: Postings that a task sorts and writes, about.
FILE_ROWS = 1_000_000
_POSTINGS = "gram string, text string, asn bigint, name string, country string, generation int, part int"


def _runs(text: Column, size: int) -> Column:
    """All runs of size characters; a shorter text has none."""
    places = F.sequence(F.lit(1), F.greatest(F.char_length(text) - (size - 1), F.lit(1)))
    return F.when(F.char_length(text) >= size, F.transform(places, lambda i: F.substring(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def _part(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(PARTS)).cast("int")


def _only(table: DataFrame, asked: DataFrame, part: str) -> DataFrame:
    """The partitions of table that asked names in a column; their numbers, PARTS at most, come to the driver."""
    return table.where(F.col("part").isin([r[part] for r in asked.select(part).distinct().collect()]))


@dataclass(frozen=True)
class NameIndex:
    """Postings of every run of one to three characters of the names that searches look at, with the name itself, and how many each run has.

    Both are in partitions by hash of the run; postings of a partition are dealt to files by AS, so many that a task has about FILE_ROWS
    of them however many there are. An update appends the postings of the ASes that changed, as a generation of their own; of an AS only
    those of its newest generation count. build() starts anew.
    """

    spark: SparkSession
    path: str

    def _write(self, core: DataFrame, as2org: DataFrame, peeringdb: DataFrame, generation: int, mode: str) -> None:
        rows = asinfo.searched_names(core, as2org, peeringdb)
        # read twice
        texts = stored(rows.select("asn", "name", "country", F.explode(F.array_distinct("__texts")).alias("text")))
        # a text has at most so many runs of each length as characters
        most = texts.agg(F.sum(LONGEST * F.char_length("text"))).first()[0] or 0
        files = max(1, math.ceil(most / FILE_ROWS / PARTS))
        grams = texts.withColumn("gram", F.explode(F.array_distinct(F.concat(*[_runs(F.col("text"), n) for n in range(1, LONGEST + 1)]))))
        kept = grams.select("gram", "text", "asn", "name", "country", F.lit(generation).alias("generation"), _part(F.col("gram")).alias("part"))
        # a run that most names have is in as many files as its partition
        dealt = kept.repartitionById(PARTS * files, (F.col("part") * files + F.pmod(F.xxhash64("asn"), F.lit(files))).cast("int"))
        dealt.sortWithinPartitions("part", "gram").write.mode(mode).partitionBy("part").parquet(f"{self.path}/postings")
        counts = self.spark.read.schema(_POSTINGS).parquet(f"{self.path}/postings").where(F.col("generation") == generation).groupBy("part", "gram").agg(F.count(F.lit(1)).alias("n"))
        counts.repartition("part").write.mode(mode).partitionBy("part").parquet(f"{self.path}/counts")

    def build(self, core: DataFrame, as2org: DataFrame, peeringdb: DataFrame) -> None:
        self._write(core, as2org, peeringdb, 0, "overwrite")
        self.spark.createDataFrame([], "asn bigint, generation int").write.mode("overwrite").parquet(f"{self.path}/newest")

    def update(self, changed: DataFrame, core: DataFrame, as2org: DataFrame, peeringdb: DataFrame) -> None:
        """Take in changed ASes (asn): those of core with their names now, the others are gone. core and the others are the whole tables."""
        newest = self.spark.read.schema("asn bigint, generation int").parquet(f"{self.path}/newest")
        generation = 1 + (newest.agg(F.max("generation")).first()[0] or 0)
        some = changed.select("asn").distinct()
        self._write(core.join(some, "asn", "left_semi"), as2org, peeringdb, generation, "append")
        some.select("asn", F.lit(generation).alias("generation")).write.mode("append").parquet(f"{self.path}/newest")

    def search(self, texts: DataFrame) -> DataFrame:
        """(input, asn, name, country): the ASes with each text (input), in any case, in one of their names. An empty text is in no name.

        Each text is looked up by the run of its own that has the fewest postings.
        """
        asked = texts.select("input").distinct().withColumn("__i", F.lower("input")).where("__i <> ''")
        own = F.array_distinct(F.when(F.char_length("__i") < LONGEST, F.array("__i")).otherwise(_runs(F.col("__i"), LONGEST)))
        runs = asked.select("input", "__i", F.explode(own).alias("__own")).withColumn("__part", _part(F.col("__own")))
        counts = self.spark.read.schema("gram string, n bigint, part int").parquet(f"{self.path}/counts")
        known = _only(counts, runs, "__part").join(runs, (F.col("part") == F.col("__part")) & (F.col("gram") == F.col("__own"))).groupBy("input", "__i", "__own").agg(F.sum("n").alias("n"))
        # a run without postings has no row: a text that has one is in no name
        every = known.groupBy("input", "__i").agg(F.min(F.struct("n", "__own")).alias("r"), F.count(F.lit(1)).alias("met"))
        rarest = stored(every.where(F.col("met") == F.size(own)).select("input", "__i", F.col("r.__own").alias("__key"), _part(F.col("r.__own")).alias("__at")))
        postings = self.spark.read.schema(_POSTINGS).parquet(f"{self.path}/postings")
        hits = _only(postings, rarest, "__at").join(rarest, (F.col("part") == F.col("__at")) & (F.col("gram") == F.col("__key"))).where(F.contains("text", F.col("__i")))
        newest = self.spark.read.schema("asn bigint, generation int").parquet(f"{self.path}/newest").groupBy(F.col("asn").alias("__asn")).agg(F.max("generation").alias("__newest"))
        live = hits.join(newest, F.col("asn") == F.col("__asn"), "left").where(F.col("generation") == F.coalesce("__newest", F.lit(0)))
        return live.select("input", "asn", "name", "country").distinct()
