"""Provider authorisations (ASPA): providers of customers, customers of providers, with names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .asinfo import only, with_name


def providers(aspas: DataFrame) -> DataFrame:
    """(customer_asn, provider_asns) with providers in order."""
    return aspas.groupBy("customer_asn").agg(F.sort_array(F.collect_set("provider_asn")).alias("provider_asns"))


def of_customers(aspas: DataFrame, asns: DataFrame) -> DataFrame:
    return providers(only(aspas, asns, "customer_asn"))


def of_providers(aspas: DataFrame, asns: DataFrame) -> DataFrame:
    """Whole lists of every customer that names one of the providers."""
    return of_customers(aspas, only(aspas, asns, "provider_asn").select(F.col("customer_asn").alias("asn")))


def enriched(aspas: DataFrame, name_table: DataFrame, core: DataFrame) -> DataFrame:
    """Each customer with name, country and its providers as (asn, name), in order."""
    named = with_name(aspas.select("customer_asn", "provider_asn").distinct(), name_table, "provider_asn", "provider_name")
    listed = named.groupBy("customer_asn").agg(F.sort_array(F.collect_list(F.struct(F.col("provider_asn").alias("asn"), F.col("provider_name").alias("name")))).alias("providers"))
    country = core.select(F.col("asn").alias("__c"), F.col("country").alias("customer_country"))
    return with_name(listed, name_table, "customer_asn", "customer_name").join(country, F.col("customer_asn") == F.col("__c"), "left").drop("__c").select("customer_asn", "customer_name", "customer_country", "providers")
