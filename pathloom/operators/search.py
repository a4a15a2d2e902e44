"""Search over many files: the catalog, ordered results, statistics."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import RouteFilters, instant

ORDERS = ("timestamp", "prefix", "peer_ip", "peer_asn", "as_path", "next_hop")


def select_files(catalog: DataFrame, start: float | None = None, end: float | None = None, collectors: list[str] | None = None, data_type: str | None = None, project: str | None = None, contained: bool = False) -> DataFrame:
    """Files that overlap a time range, or lie in it, by collector, type and project; in order of start, type, collector."""
    kind = catalog.schema["ts_start"].dataType
    rows = catalog
    if start is not None:
        rows = rows.where(F.col("ts_start" if contained else "ts_end") >= instant(start, kind))
    if end is not None:
        rows = rows.where(F.col("ts_end" if contained else "ts_start") <= instant(end, kind))
    if collectors:
        rows = rows.where(F.col("collector_id").isin(collectors))
    if data_type:
        rows = rows.where(F.col("data_type") == data_type)
    if project:
        rows = rows.where(F.col("project") == project)
    return rows.orderBy("ts_start", "data_type", "collector_id", "url")


def order_columns(order: str, descending: bool = False) -> list[Column]:
    """Text is ordered as text and nulls count as empty text; seq breaks ties."""
    if order not in ORDERS:
        raise ValueError(f"unknown order {order!r}; there are {', '.join(ORDERS)}")
    c = F.col("ts") if order == "timestamp" else F.col("peer_asn") if order == "peer_asn" else F.coalesce(F.col(order), F.lit(""))
    return [c.desc() if descending else c.asc(), F.col("seq")]


@dataclass(frozen=True)
class ElementQuery:
    """A query on stored elements, built step by step."""

    filters: RouteFilters = field(default_factory=RouteFilters)
    columns: tuple[str, ...] = ()
    order: str | None = None
    descending: bool = False
    most: int | None = None
    skip: int = 0

    def where(self, **conditions) -> ElementQuery:
        return replace(self, filters=replace(self.filters, **conditions))

    def select(self, *columns: str) -> ElementQuery:
        return replace(self, columns=columns)

    def order_by(self, order: str, descending: bool = False) -> ElementQuery:
        return replace(self, order=order, descending=descending)

    def limit(self, most: int, skip: int = 0) -> ElementQuery:
        return replace(self, most=most, skip=skip)

    def on(self, elems: DataFrame) -> DataFrame:
        rows = self.filters.apply(elems)
        if self.order:
            rows = rows.orderBy(*order_columns(self.order, self.descending))
        if self.skip:
            rows = rows.offset(self.skip)
        if self.most is not None:
            rows = rows.limit(self.most)
        return rows.select(*self.columns) if self.columns else rows

    def count(self, elems: DataFrame) -> DataFrame:
        return self.filters.apply(elems).agg(F.count(F.lit(1)).alias("n"))


def by_collector(elems: DataFrame) -> DataFrame:
    """Matched elements, and distinct prefixes and peers, of each collector."""
    return elems.groupBy("collector").agg(F.count(F.lit(1)).alias("matched"), F.countDistinct("prefix").alias("prefixes"), F.countDistinct("peer_asn").alias("peers"))


def file_bytes(files: DataFrame) -> DataFrame:
    """How many files, their bytes (exact where known, else rough), whether all are exact, and the rough sum of a dry run."""
    exact = F.coalesce(F.col("exact_size") > 0, F.lit(False))
    return files.agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum(F.greatest(F.when(exact, F.col("exact_size")).otherwise(F.col("rough_size")), F.lit(0))), F.lit(0)).cast("bigint").alias("bytes"),
        F.coalesce(F.bool_and(exact), F.lit(True)).alias("exact"), F.coalesce(F.sum("rough_size"), F.lit(0)).cast("bigint").alias("rough_bytes"),
    )


def matching_files(elems: DataFrame) -> DataFrame:
    """Collectors and files that have a matching element, with how many."""
    return elems.groupBy("collector", "file").agg(F.count(F.lit(1)).alias("matched"))
