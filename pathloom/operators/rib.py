"""Routing tables at instants, rebuilt from a base dump and the updates after it.

A replay is one keyed aggregation: of all events of a route up to the instant the last one decides,
and the route is there if that is a matching announcement. What an announcement matches is a column
and never a filter before the replay, since an announcement that doesn't match removes the route.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import count_before, last_before

# How old a base dump may be, and what makes a route; where several dumps are replayed at once, each has routes of its own.
LOOK_BACK_DAYS = 30
ROUTE = ("collector", "peer_ip", "peer_asn", "prefix", "path_id", "dump_ts")


def route_key(events: DataFrame) -> list[str]:
    return [c for c in ROUTE if c in events.columns]


def base_dumps(catalog: DataFrame, instants: list[Column] | DataFrame, days: int = LOOK_BACK_DAYS) -> DataFrame:
    """(collector_id, rib_ts, dump_ts, url): for each collector of the catalog and each of the instants (literals, or a table with rib_ts) the last dump at or before it.

    Only dumps of the days before count; where there is none the row has nulls, see require_dumps(). Dumps and instants meet in one pass in the order of time.
    """
    dumps = catalog.where("data_type = 'rib'").select("collector_id", F.col("ts_start").alias("dump_ts"), "url")
    collectors = catalog.select("collector_id").distinct()
    if isinstance(instants, DataFrame):
        # instants as an array, so that each collector takes them in without a cross join
        listed = instants.agg(F.sort_array(F.collect_set("rib_ts")).alias("all"))
        wanted = collectors.withColumn("__one", F.lit(1)).join(listed.withColumn("__one", F.lit(1)), "__one").select("collector_id", F.explode("all").alias("rib_ts"))
    else:
        wanted = collectors.withColumn("rib_ts", F.explode(F.array_distinct(F.array(*instants))))
    found = last_before(wanted, dumps, ["collector_id"], "rib_ts", "dump_ts", ["dump_ts", "url"])
    near = F.col("dump_ts") >= F.col("rib_ts") - F.expr(f"INTERVAL {days} DAYS")
    return found.select("collector_id", "rib_ts", F.when(near, F.col("dump_ts")).alias("dump_ts"), F.when(near, F.col("url")).alias("url"))


def require_dumps(selected: DataFrame) -> DataFrame:
    """selected as it is; ValueError if a collector has no dump before an instant."""
    missing = selected.where("url IS NULL").limit(1).collect()
    if missing:
        raise ValueError(f"no dump of {missing[0]['collector_id']} before {missing[0]['rib_ts']}")
    return selected


def update_files(catalog: DataFrame, selected: DataFrame) -> DataFrame:
    """Update files of each collector between its dump and its last instant, in order of time."""
    spans = selected.where("url IS NOT NULL").groupBy("collector_id", "dump_ts").agg(F.max("rib_ts").alias("last_ts"))
    updates = catalog.where("data_type = 'updates'")
    return updates.join(spans, "collector_id").where((F.col("ts_end") >= F.col("dump_ts")) & (F.col("ts_start") <= F.col("last_ts"))).select("collector_id", "dump_ts", "url", "ts_start", "ts_end")


def events_of(base: DataFrame, updates: DataFrame, matches: Column | None = None) -> DataFrame:
    """Base rows and updates as events in one order: phase (0 base, 1 update), then seq; is_match as a column.

    base has seq and rows of dumps; updates have seq, ts and elem_type. seq follows files and places
    in them, not times, as that is the order in which routers applied them.
    """
    match = F.lit(True) if matches is None else matches
    first = base.withColumn("phase", F.lit(0)).withColumn("elem_type", F.lit("A")).withColumn("is_match", match)
    second = updates.withColumn("phase", F.lit(1)).withColumn("is_match", match)
    return first.unionByName(second, allowMissingColumns=True)


def snapshot(events: DataFrame, values: list[str]) -> DataFrame:
    """The routes that are there after all events, with the values of the event that put them there."""
    row = F.struct("elem_type", "is_match", *values)
    last = events.groupBy(*route_key(events)).agg(F.max_by(row, F.struct("phase", "seq")).alias("last"))
    live = (F.col("last.elem_type") == "A") & F.coalesce(F.col("last.is_match"), F.lit(False))
    return last.where(live).select(*route_key(events), *[F.col(f"last.{v}").alias(v) for v in values])


def _sorted_instants(instants: list | str) -> Column:
    """Instants as an array: literals in order, or a column that has those of the event's dump."""
    return F.col(instants) if isinstance(instants, str) else F.array(*instants)


#: Instants of one replay, at most.
MOST_INSTANTS = 1 << 20


def _interval(events: DataFrame, instants: list | str, column: str) -> DataFrame:
    """events with __i, the place of the first instant at or after them (0 for base rows); later events go."""
    at = _sorted_instants(instants)
    most = MOST_INSTANTS if isinstance(instants, str) else len(instants)
    place = F.when(F.col("phase") == 0, F.lit(0)).otherwise(count_before(at, F.col(column), most))
    return events.withColumn("__i", place).where(F.col("__i") < F.size(at))


def stamped(events: DataFrame, instants: list | str, column: str = "ts") -> DataFrame:
    """events with rib_ts: the first of the instants at or after the event, found by halving; base rows get the first; later events go."""
    return _interval(events, instants, column).withColumn("rib_ts", F.get(_sorted_instants(instants), F.col("__i"))).drop("__i")


def snapshots(events: DataFrame, values: list[str], instants: list | str) -> DataFrame:
    """The routes at each of several instants: rib_ts, key and values.

    Each event falls into the interval that ends at its instant; the last one of each route and
    interval is carried forward over the intervals, so events are never multiplied by instants.
    """
    key = route_key(events)
    row = F.struct("elem_type", "is_match", *values)
    carried = [F.any_value(F.col(instants)).alias("__at")] if isinstance(instants, str) else []
    folded = _interval(events, instants, "ts").groupBy(*key, "__i").agg(F.max_by(row, F.struct("phase", "seq")).alias("last"), *carried)
    at = F.col("__at") if carried else _sorted_instants(instants)
    until = F.coalesce(F.lead("__i").over(Window.partitionBy(*key).orderBy("__i")), F.size(at))
    spans = folded.withColumn("__until", until).where((F.col("last.elem_type") == "A") & F.coalesce(F.col("last.is_match"), F.lit(False)))
    lasting = F.slice(at, F.col("__i") + 1, F.col("__until") - F.col("__i"))
    return spans.withColumn("rib_ts", F.explode(lasting)).select("rib_ts", *key, *[F.col(f"last.{v}").alias(v) for v in values])


def update_log(events: DataFrame, instants: list | str, first: Column | None = None) -> DataFrame:
    """Updates that changed the table behind the first instant, each with the instant it leads to.

    first is that instant, if it isn't the first of instants.
    An update is applied if it is a matching announcement, or if the route was there before it.
    """
    first = F.get(_sorted_instants(instants), F.lit(0)) if first is None else first
    order = Window.partitionBy(*route_key(events)).orderBy("phase", "seq")
    live = (F.col("elem_type") == "A") & F.coalesce("is_match", F.lit(False))
    seen = stamped(events, instants).withColumn("__live", live).withColumn("__before", F.coalesce(F.lag("__live").over(order), F.lit(False)))
    applied = (F.col("phase") == 1) & (F.col("__live") | F.col("__before")) & (F.col("rib_ts") > first)
    return seen.where(applied).drop("__live", "__before", "phase", "is_match")


def fold(previous: DataFrame, updates: DataFrame, values: list[str], matches: Column | None = None) -> DataFrame:
    """The table after updates on a table: previous has the key, seq and values of its routes."""
    return snapshot(events_of(previous, updates, matches), values)


def run_summary(selected: DataFrame) -> DataFrame:
    return selected.agg(F.countDistinct("rib_ts").alias("instants"), F.countDistinct("collector_id").alias("collectors"), F.countDistinct("collector_id", "dump_ts").alias("groups"))
