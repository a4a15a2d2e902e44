"""Whole runs over a file catalog: search, routing tables at instants, one set of files."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.operators import filters, rib, search
from pathloom.operators.filters import RouteFilters
from pathloom.sources import ingest
from pathloom.sources.store import ElementStore, plain_path

from .scratch import scratch


@dataclass(frozen=True)
class SearchRun:
    """What a search found: matching elements, the files that were read, and statistics of both."""

    elements: DataFrame
    files: DataFrame

    def by_file(self) -> DataFrame:
        return search.matching_files(self.elements)

    def by_collector(self) -> DataFrame:
        return search.by_collector(self.elements)

    def source_bytes(self) -> DataFrame:
        return search.file_bytes(self.files)


def _read(spark: SparkSession, files: DataFrame, form: str, kind: str, store: ElementStore | None = None, start: str = "ts_start") -> DataFrame | None:
    """Elements of the files of a selection: from a store by a join, or from the files themselves, whose paths come to the driver as those of any read do."""
    if store is not None:
        return store.elements(files, kind, start)
    paths = [r["url"] for r in files.select("url").distinct().collect()]
    return ingest.read_elems(spark, paths, form) if paths else None


def _no_elements(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ingest.ELEM_SCHEMA + ", ts timestamp, file string, place struct<block:bigint,row:bigint>")


def search_files(
    spark: SparkSession, catalog: DataFrame, wanted: RouteFilters, collectors: list[str] | None = None, data_type: str = "updates", project: str | None = None, form: str = "parquet", store: ElementStore | None = None,
) -> SearchRun:
    """Elements that match, of the files of the catalog that overlap the filters' time range; from a store, if one is given.

    A search in dumps has no element time filter, as their rows carry old times.
    """
    start, end = wanted.validate().time_range()
    files = search.select_files(catalog, start, end, collectors, data_type, project)
    elements = _read(spark, files, form, data_type, store)
    return SearchRun(wanted.apply(_no_elements(spark) if elements is None else elements, data_type), files)


#: Files of the largest block of a capped search.
MOST_FILES = 256


def search_first(
    spark: SparkSession, catalog: DataFrame, wanted: RouteFilters, most: int, collectors: list[str] | None = None, data_type: str = "updates", project: str | None = None, form: str = "parquet",
) -> SearchRun:
    """The first most elements that match, in the order of files and of elements in them, and the files that were read.

    Files are read in blocks of growing size, each for what is still missing, until there is nothing missing; the files
    behind are never opened. Only the paths of a block come to the driver.
    """
    start, end = wanted.validate().time_range()
    order = ["ts_start", "data_type", "collector_id", "url"]
    left, size, last, folder, read = most, 1, None, scratch(spark, "first"), []
    files = search.select_files(catalog, start, end, collectors, data_type, project)
    while left > 0:
        rest = files if last is None else files.where(F.struct(*order) > F.struct(*[F.lit(v) for v in last]))
        block = rest.orderBy(*order).limit(size).collect()
        if not block:
            break
        last = [block[-1][c] for c in order]
        page = spark.createDataFrame(block, files.schema)
        places = spark.createDataFrame([(i, r["url"]) for i, r in enumerate(block)], "__file int, __url string").withColumn("__url", plain_path(F.col("__url")))
        rows = wanted.apply(ingest.read_elems(spark, sorted({r["url"] for r in block}), form), data_type)
        rows = rows.join(places, plain_path(F.col("file")) == F.col("__url")).drop("__url")
        part = f"{folder}/block={len(read)}"
        rows.orderBy("__file", "place").limit(left).drop("__file").write.parquet(part)
        left -= spark.read.parquet(part).count()
        read.append(page)
        size = min(2 * size, MOST_FILES)
    if not read:
        return SearchRun(wanted.apply(_no_elements(spark), data_type), files.limit(0))
    return SearchRun(spark.read.parquet(*[f"{folder}/block={i}" for i in range(len(read))]), reduce(DataFrame.unionByName, read))


def parse_files(spark: SparkSession, paths: list[str], wanted: RouteFilters, names: str | None = None, order: str | None = None, descending: bool = False, form: str = "parquet") -> DataFrame:
    """Chosen fields of matching elements of some files, as text, in order."""
    rows = wanted.apply(ingest.read_elems(spark, paths, form))
    if order:
        rows = rows.withColumn("seq", F.monotonically_increasing_id()).orderBy(*search.order_columns(order, descending))
    return filters.rendered(rows, filters.parse_fields(names))


def routing_tables(
    spark: SparkSession, catalog: DataFrame, instants: list[Column], wanted: RouteFilters, values: list[str], collectors: list[str] | None = None, peers: DataFrame | None = None,
    asinfo: DataFrame | None = None, country: str | None = None, form: str = "parquet", store: ElementStore | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(routes, updates) of each collector at instants: tables with rib_ts, and the changes that lead from each to the next.

    Every collector needs a dump before every instant. With a store elements come from it, and no list of files goes through the driver. All dumps are replayed by one job: a dump and the updates up to its
    last instant are events of their own routes, and the spans of a collector's dumps don't overlap.
    The order of events is that of files by start and of elements in them. The first instant of all has no changes.
    """
    if collectors:
        catalog = catalog.where(F.col("collector_id").isin(collectors))
    selected = rib.require_dumps(rib.base_dumps(catalog, instants))
    groups = selected.groupBy("collector_id", "dump_ts").agg(F.sort_array(F.collect_set("rib_ts")).alias("instants"), F.max("rib_ts").alias("last_ts"))
    dumps = selected.select("collector_id", "dump_ts", "url").distinct().join(groups, ["collector_id", "dump_ts"])
    base = _ordered(_read(spark, dumps, form, "rib", store, "dump_ts"), dumps.select("url", F.col("dump_ts").alias("start"), "dump_ts", "instants", "last_ts"), store is None)
    files = rib.update_files(catalog, selected).join(groups, ["collector_id", "dump_ts"])
    changes = _read(spark, files, form, "updates", store)
    changes = base.limit(0) if changes is None else _ordered(changes, files.select("url", F.col("ts_start").alias("start"), "dump_ts", "instants", "last_ts"), store is None)
    changes = changes.where((F.col("ts") > F.col("dump_ts")) & (F.col("ts") <= F.col("last_ts")))
    safe = replace(wanted, start_ts=None, end_ts=None, duration=None)
    events = rib.events_of(safe.safe(base).drop("elem_type", "last_ts"), safe.safe(changes).drop("last_ts"), safe.announce_predicate())
    if peers is not None:
        events = filters.full_feed_only(events, peers)
    if asinfo is not None and country:
        events = filters.country_flag(events, asinfo, country, "__in").withColumn("is_match", F.col("is_match") & F.col("__in")).drop("__in")
    first = F.lit(selected.agg(F.min("rib_ts")).first()[0])
    return rib.snapshots(events, values, "instants").drop("dump_ts"), rib.update_log(events, "instants", first).drop("dump_ts", "instants")


def _ordered(elems: DataFrame, files: DataFrame, listed: bool) -> DataFrame:
    """elems with seq, the start of their file in seconds and then their place in it, and what else files has of their file; once for each row of files.

    Where paths were listed on the driver files are broadcast: Spark, which knows no size of them, would share all elements instead and take the rows of files through a task or two.
    """
    of = files.distinct().withColumn("__start", F.col("start").cast("timestamp").cast("long")).drop("start")
    of = of.withColumn("__key", plain_path(F.col("url"))).drop("url")
    joined = elems.withColumn("__key", plain_path(F.col("file"))).join(F.broadcast(of) if listed else of, "__key")
    return joined.withColumn("seq", F.struct(F.col("__start").alias("start"), F.col("place").alias("place"))).drop("__key", "__start", "place")
