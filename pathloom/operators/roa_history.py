"""ROAs over time as intervals of validity, and validation of announcements at their own day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.prefix import prefix_length

from .match import covering

#: What makes a ROA, and what a series of daily tables is of.
ROA = ("prefix", "max_length", "origin_asn", "ta")
SERIES = ("source", "collector")


def _same(columns: list[str], left: str, right: str):
    both = F.lit(True)
    for c in columns:
        both &= F.col(f"{left}{c}").eqNullSafe(F.col(f"{right}{c}"))
    return both


def intervals(dated: DataFrame) -> DataFrame:
    """The intervals of each ROA in each series: first_day and last_day of runs of neighbouring tables that hold it, and until, the day of the next table, null for the newest.

    dated has the columns of ROA that there are, those of SERIES, and date. Days are those that a series has tables of; a run ends where the next table
    lacks the ROA. Repeated rows count once. A run's rows are numbered within the ROA, so that the days of one ROA are the largest group there is.
    """
    roa = [c for c in ROA if c in dated.columns]
    series = list(SERIES)
    rows = dated.select(*roa, *series, "date").distinct()
    order = Window.partitionBy(*series).orderBy("date")
    days = dated.select(*series, "date").distinct().withColumn("__day", F.row_number().over(order)).withColumn("__until", F.lead("date").over(order))
    named = days.select(*[F.col(c).alias(f"__{c}") for c in (*series, "date")], "__day", "__until")
    placed = rows.join(named, _same([*series, "date"], "", "__"))
    island = F.col("__day") - F.row_number().over(Window.partitionBy(*roa, *series).orderBy("__day"))
    runs = placed.withColumn("__island", island).groupBy(*roa, *series, "__island")
    return runs.agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.max_by("__until", "__day").alias("until")).drop("__island")


def with_day(held: DataFrame, day_rows: DataFrame, date: str) -> DataFrame:
    """The intervals after one more day: held and the ROAs of that day (columns of ROA and SERIES), which is past all days of its series.

    Intervals that are open go on if the day has their ROA, else end; ROAs without an open interval begin one. Series without rows of that day stay as they are.
    """
    roa = [c for c in ROA if c in held.columns]
    key = [*roa, *SERIES]
    today = day_rows.select(*key).distinct().select(*[F.col(c).alias(f"__{c}") for c in key])
    present = day_rows.select(*[F.col(c).alias(f"__s_{c}") for c in SERIES]).distinct()
    open_now = held.where("until IS NULL").join(F.broadcast(present), _same(list(SERIES), "", "__s_"), "left_semi")
    closed = held.where("until IS NOT NULL").unionByName(held.where("until IS NULL").join(F.broadcast(present), _same(list(SERIES), "", "__s_"), "left_anti"))
    met = open_now.join(today, _same(key, "", "__"), "full")
    new = F.col("first_day").isNull()
    gone = F.col(f"__{SERIES[0]}").isNull()
    # a null source marks no row of today, as series are never null
    return closed.unionByName(
        met.select(
            *[F.when(new, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in key], F.coalesce("first_day", F.lit(date)).alias("first_day"),
            F.when(gone, F.col("last_day")).otherwise(F.lit(date)).alias("last_day"), F.when(gone, F.lit(date)).alias("until"),
        )
    )


def at_day(held: DataFrame, date: str) -> DataFrame:
    """The ROAs of each series at a day: those of the last table at or before it."""
    return held.where((F.col("first_day") <= date) & (F.col("until").isNull() | (F.col("until") > date)))


def validated_at(pairs: DataFrame, held: DataFrame, prefix: str = "prefix", asn: str = "origin_asn", day: str = "day") -> DataFrame:
    """pairs with state (valid, invalid, not_found) by the ROAs of their own day, a date as text; each distinct (prefix, origin, day) is validated once.

    held are the intervals of one series. A day takes the last table at or before it; without one nothing covers. Rules are those of rov.validate().
    """
    distinct = pairs.select(F.col(prefix).alias("query"), F.col(asn).alias("__asn"), F.col(day).alias("__day")).distinct()
    table = held.select("prefix", F.col("origin_asn").alias("__roa_asn"), F.coalesce("max_length", prefix_length(F.col("prefix"))).alias("__most"), F.col("first_day").alias("__first"), F.col("until").alias("__until")).distinct()
    matches = (F.col("__roa_asn") == F.col("__asn")) & (F.col("__roa_asn") != 0) & (prefix_length(F.col("query")) <= F.col("__most"))
    valid_then = (F.col("__first") <= F.col("__day")) & (F.col("__until").isNull() | (F.col("__until") > F.col("__day")))
    # prefixes are matched once for all their days, which then choose among the intervals
    found = covering(distinct, table).where(valid_then).groupBy("query", "__asn", "__day").agg(F.max(F.coalesce(matches, F.lit(False))).alias("__ok"))
    found = found.select(F.col("query").alias("__query"), F.col("__asn").alias("__of"), F.col("__day").alias("__on"), "__ok")
    joined = pairs.join(found, (F.col(prefix) == F.col("__query")) & F.col(asn).eqNullSafe(F.col("__of")) & (F.col(day) == F.col("__on")), "left")
    return joined.withColumn("state", F.when(F.col("__ok"), "valid").when(F.col("__ok").isNotNull(), "invalid").otherwise("not_found")).drop("__query", "__of", "__on", "__ok")
