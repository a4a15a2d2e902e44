"""Route origin validation after RFC 6811, and lookups of route origin authorisations (ROAs)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.prefix import host_prefix, lengths_present, prefix_length, with_key

from .asinfo import only
from .match import _bare, _exploded, _same, covering


# The reasons that go with each state.
VALID = "ROA exists with matching ASN and valid prefix length"
NOT_FOUND = "No covering ROA found"
TOO_LONG = ("Prefix length ", " exceeds max_length in covering ROAs")
WRONG_ASN = ("ASN ", " not authorized; authorized ASNs: ")


def validate(pairs: DataFrame, roas: DataFrame, prefix: str = "prefix", asn: str = "origin_asn") -> DataFrame:
    """pairs with state: valid, invalid or not_found; each distinct pair is validated once.

    A ROA covers a pair if its prefix contains the whole prefix; it matches if its AS is the pair's (AS 0
    matches none) and the length is within its max_length. A pair whose prefix is not CIDR text has
    no covering ROA.
    """
    distinct = pairs.select(F.col(prefix).alias("query"), F.col(asn).alias("__asn")).distinct()
    # a ROA without a max_length allows its own length only
    table = roas.select("prefix", F.col("origin_asn").alias("__roa_asn"), F.coalesce("max_length", prefix_length(F.col("prefix"))).alias("__most"))
    matches = (F.col("__roa_asn") == F.col("__asn")) & (F.col("__roa_asn") != 0) & (prefix_length(F.col("query")) <= F.col("__most"))
    states = covering(distinct, table).groupBy("query", "__asn").agg(F.max(F.coalesce(matches, F.lit(False))).alias("__ok"), F.sort_array(F.collect_set("__roa_asn")).alias("roa_asns"))
    found = states.withColumnRenamed("query", "__query").withColumnRenamed("__asn", "__of")
    joined = pairs.join(found, (F.col(prefix) == F.col("__query")) & F.col(asn).eqNullSafe(F.col("__of")), "left")
    return joined.withColumn("state", F.when(F.col("__ok"), "valid").when(F.col("__ok").isNotNull(), "invalid").otherwise("not_found")).drop("__query", "__of", "__ok")


def validated(pairs: DataFrame, roas: DataFrame, prefix: str = "prefix", asn: str = "origin_asn") -> DataFrame:
    """pairs with state alone."""
    return validate(pairs, roas, prefix, asn).drop("roa_asns")


def detailed(pairs: DataFrame, roas: DataFrame, prefix: str = "prefix", asn: str = "origin_asn") -> DataFrame:
    """pairs with state and the reason for it in words; authorised ASes in order."""
    wrong_length = F.array_contains("roa_asns", F.col(asn))
    reason = (
        F.when(F.col("state") == "valid", VALID)
        .when(F.col("state") == "not_found", NOT_FOUND)
        .when(wrong_length, F.concat(F.lit(TOO_LONG[0]), prefix_length(F.col(prefix)).cast("string"), F.lit(TOO_LONG[1])))
        .otherwise(F.concat(F.lit(WRONG_ASN[0]), F.col(asn).cast("string"), F.lit(WRONG_ASN[1]), F.array_join(F.col("roa_asns").cast("array<string>"), ", ")))
    )
    return validate(pairs, roas, prefix, asn).withColumn("reason", reason).drop("roa_asns")


def covering_roas(queries: DataFrame, roas: DataFrame, query: str = "query") -> DataFrame:
    """ROAs that contain the network address of each query: looser than validation, as a longer ROA prefix counts too."""
    q = with_key(queries.withColumn("__host", host_prefix(F.element_at(F.split(F.trim(query), "/"), 1))), "__host", "q").drop("__host")
    t = with_key(roas.withColumnRenamed("prefix", "roa_prefix"), "roa_prefix", "t")
    return _bare(_exploded(q, "q", lengths_present(roas), "a").join(t, _same("a", "t")))


def lookup(roas: DataFrame, prefixes: DataFrame | None = None, asns: DataFrame | None = None) -> DataFrame:
    """ROAs by prefixes (column query) and ASes (column asn), either or both; in order of prefix."""
    found = roas.withColumnRenamed("prefix", "roa_prefix") if prefixes is None else covering_roas(prefixes, roas).drop("query").distinct()
    if asns is not None:
        found = only(found, asns, "origin_asn")
    return found.select(F.col("roa_prefix").alias("prefix"), "max_length", "origin_asn", "ta").orderBy("prefix", "origin_asn", "max_length")


def union_lookup(roas: DataFrame, prefixes: DataFrame, asns: DataFrame) -> DataFrame:
    """ROAs of any of the ASes or covering any of the prefixes, each (origin, prefix, max_length) once."""
    return lookup(roas, asns=asns).unionByName(lookup(roas, prefixes=prefixes)).dropDuplicates(["origin_asn", "prefix", "max_length"])


def label_counts(table: DataFrame, label: str = "validation") -> DataFrame:
    """How many rows have each label and their share of all; labels other than valid and invalid are unknown."""
    named = F.when(F.col(label).isin("valid", "invalid"), F.col(label)).otherwise("unknown").alias(label)
    counts = table.groupBy(named).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.select(label, "n", (F.col("n") * 100.0 / total).alias("percent"))
