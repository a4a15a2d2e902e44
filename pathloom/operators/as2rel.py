"""AS relationships: neighbours, pairs, single-homed customers, connectivity.

An edge (asn1, asn2, rel) says that asn1 is customer (-1) or provider (1) of asn2; 0 counts every
connection in the percentages and is a peer in the connectivity summary.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .asinfo import only


def symmetric(edges: DataFrame) -> DataFrame:
    """Each edge from both its ends, the sign of the relation turned for the second."""
    rest = [c for c in edges.columns if c not in ("asn1", "asn2", "rel")]
    turned = edges.select(F.col("asn2").alias("asn1"), F.col("asn1").alias("asn2"), (-F.col("rel")).cast("int").alias("rel"), *rest)
    return edges.select("asn1", "asn2", F.col("rel").cast("int").alias("rel"), *rest).unionByName(turned)


def max_peers(edges: DataFrame) -> int:
    return edges.agg(F.max("peers_count")).first()[0] or 0


def aggregated(sided: DataFrame) -> DataFrame:
    """Counts of each ordered pair: connected, asn1 upstream of asn2, asn2 upstream of asn1."""
    n = F.col("peers_count")
    return sided.groupBy("asn1", "asn2").agg(
        F.coalesce(F.max(F.when(F.col("rel") == 0, n)), F.lit(0)).alias("connected"),
        F.coalesce(F.sum(F.when(F.col("rel") == 1, n)), F.lit(0)).alias("as1_upstream"), F.coalesce(F.sum(F.when(F.col("rel") == -1, n)), F.lit(0)).alias("as2_upstream"),
    )


def neighbours(edges: DataFrame, asns: DataFrame) -> DataFrame:
    """Aggregated neighbours of each AS of asns (column asn), from its side."""
    return aggregated(only(symmetric(edges), asns, "asn1"))


def pair(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Aggregated counts of pairs (asn1, asn2), from the side of asn1; unknown pairs give no row."""
    # no semi join, for the reason that asinfo.only() gives
    return aggregated(symmetric(edges).join(pairs.select("asn1", "asn2").distinct(), ["asn1", "asn2"]))


def pairs_among(edges: DataFrame, asns: DataFrame) -> DataFrame:
    """Aggregated counts of all connected pairs of a list of ASes, the smaller AS first."""
    sided = only(only(symmetric(edges).where("asn1 < asn2"), asns, "asn1"), asns, "asn2")
    return aggregated(sided).where("connected > 0 OR as1_upstream > 0 OR as2_upstream > 0")


def with_percentages(counts: DataFrame, most: int) -> DataFrame:
    """Shares of all peers; those who see a connection but no side of it as upstream see a peer."""
    peer = F.greatest(F.greatest(F.col("connected") - F.col("as1_upstream"), F.lit(0)) - F.col("as2_upstream"), F.lit(0))

    def share(c):
        return (c * 100.0 / most) if most > 0 else F.lit(0.0)

    return counts.withColumn("connected_pct", share(F.col("connected"))).withColumn("peer_pct", share(peer)).withColumn("as1_upstream_pct", share(F.col("as1_upstream"))).withColumn("as2_upstream_pct", share(F.col("as2_upstream")))


def percentage_texts(counts: DataFrame) -> DataFrame:
    """counts of with_percentages() with each share as text, to a tenth of a percent."""
    return counts.withColumns({f"{n}_text": F.format_string("%.1f%%", F.col(f"{n}_pct")) for n in ("connected", "peer", "as1_upstream", "as2_upstream")})


def by_relation(counts: DataFrame, kind: str) -> DataFrame:
    """Neighbours of one kind from the side of asn1: upstream, downstream or peer."""
    condition = {"upstream": "as2_upstream > 0", "downstream": "as1_upstream > 0", "peer": "connected > as1_upstream + as2_upstream"}
    if kind not in condition:
        raise ValueError(f"unknown relation {kind!r}")
    return counts.where(condition[kind])


def min_visibility(counts: DataFrame, percent: float) -> DataFrame:
    if not 0 <= percent <= 100:
        raise ValueError("visibility is a percentage")
    return counts.where(F.col("connected_pct") >= percent)


def ordered(counts: DataFrame, by_asn: bool = False) -> DataFrame:
    return counts.orderBy("asn1", "asn2") if by_asn else counts.orderBy("asn1", F.col("connected").desc(), "asn2")


def upstreams(edges: DataFrame) -> DataFrame:
    """(customer_asn, upstream_asn, peers_count) of each customer edge, whichever end it is told from."""
    sided = edges.where("rel IN (-1, 1)")
    customer = F.when(F.col("rel") == -1, F.col("asn1")).otherwise(F.col("asn2"))
    provider = F.when(F.col("rel") == -1, F.col("asn2")).otherwise(F.col("asn1"))
    return sided.select(customer.alias("customer_asn"), provider.alias("upstream_asn"), "peers_count")


def upstream_counts(edges: DataFrame) -> DataFrame:
    return upstreams(edges).groupBy("customer_asn").agg(F.countDistinct("upstream_asn").alias("upstream_count"))


def single_homed(edges: DataFrame, upstream: int, min_percent: float | None = None) -> DataFrame:
    """Customers whose one upstream is the given AS, most visible first; the bar is a whole number of peers, rounded down."""
    least = 0 if min_percent is None else math.floor(min_percent / 100.0 * max_peers(edges))
    u = upstreams(edges)
    own = u.groupBy("customer_asn").agg(F.countDistinct("upstream_asn").alias("n"), F.max(F.when(F.col("upstream_asn") == upstream, F.col("peers_count"))).alias("visibility"))
    return own.where((F.col("n") == 1) & (F.col("visibility") >= least)).select("customer_asn", "visibility").orderBy(F.col("visibility").desc(), "customer_asn")


def connectivity(edges: DataFrame, asns: DataFrame) -> DataFrame:
    """(asn, kind, neighbour, peers_count) of each relation of each AS: upstream, peer, downstream."""
    sided = only(symmetric(edges), asns, "asn1")
    kind = F.when(F.col("rel") == -1, "upstream").when(F.col("rel") == 0, "peer").otherwise("downstream")
    return sided.select(F.col("asn1").alias("asn"), kind.alias("kind"), F.col("asn2").alias("neighbour"), "peers_count")


def connectivity_counts(edges: DataFrame, asns: DataFrame, top: int = 0) -> DataFrame:
    """Relations of each kind, their share of all of the AS's, and whether a list of top would cut them (0: no limit)."""
    counts = connectivity(edges, asns).groupBy("asn", "kind").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("asn"))
    return counts.withColumn("percent", F.col("n") * 100.0 / total).withColumn("truncated", (F.col("n") > top) if top else F.lit(False))


def connectivity_top(edges: DataFrame, asns: DataFrame, top: int) -> DataFrame:
    """The top neighbours of each kind by peers, then AS, with their share of all peers (0: all neighbours)."""
    most = max_peers(edges)
    order = Window.partitionBy("asn", "kind").orderBy(F.col("peers_count").desc(), "neighbour")
    ranked = connectivity(edges, asns).withColumn("rank", F.row_number().over(order))
    ranked = ranked.where(F.col("rank") <= top) if top else ranked
    return ranked.withColumn("peers_percent", F.col("peers_count") * 100.0 / most if most else F.lit(0.0))


def search(
    edges: DataFrame, asns: list[int], names: DataFrame | None = None, kind: str | None = None, min_percent: float | None = None, sort_by_asn: bool = False, sole_upstream: bool = False, texts: bool = False
) -> DataFrame:
    """Relations as one call: of one AS all its neighbours, of two the pair, of more all connected pairs among them.

    kind (upstream, downstream or peer) and min_percent narrow them down; names (asn, as_name) adds asn2_name; texts adds
    the shares as text. sole_upstream gives the customers whose one upstream is the AS instead. Rows are in order.
    """
    if not asns:
        raise ValueError("no AS to search for")
    spark = edges.sparkSession
    if sole_upstream:
        if len(asns) > 1:
            raise ValueError("customers of one upstream are asked for one AS at a time")
        found = single_homed(edges, asns[0], min_percent)
        if names is None:
            return found
        return found.join(names.select(F.col("asn").alias("customer_asn"), F.col("as_name").alias("customer_name")), "customer_asn", "left").orderBy(F.col("visibility").desc(), "customer_asn")
    if len(asns) > 2 and kind:
        raise ValueError("a kind of relation is one of one AS or of a pair")
    if len(asns) == 1:
        counts = neighbours(edges, spark.createDataFrame([(asns[0],)], "asn long"))
    elif len(asns) == 2:
        counts = pair(edges, spark.createDataFrame([tuple(asns)], "asn1 long, asn2 long"))
    else:
        counts = pairs_among(edges, spark.createDataFrame([(a,) for a in asns], "asn long"))
    counts = with_percentages(counts, max_peers(edges))
    counts = by_relation(counts, kind) if kind else counts
    counts = min_visibility(counts, min_percent) if min_percent is not None else counts
    counts = percentage_texts(counts) if texts else counts
    if names is not None:
        counts = counts.join(names.select(F.col("asn").alias("asn2"), F.col("as_name").alias("asn2_name")), "asn2", "left")
    return ordered(counts, sort_by_asn)
