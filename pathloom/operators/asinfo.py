"""AS information: whole records, preferred names, searches, countries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.scalars import preferred_name

PARTS = ("as2org", "peeringdb", "hegemony", "population")


def full_records(core: DataFrame, **parts: DataFrame) -> DataFrame:
    """core with one nullable struct for each other part that is given; AS records of core all stay."""
    rows = core
    for name in PARTS:
        part = parts.get(name)
        if part is not None:
            columns = [c for c in part.columns if c != "asn"]
            packed = part.select(F.col("asn").alias("__asn"), F.struct(*columns).alias(name))
            rows = rows.join(packed, F.col("asn") == F.col("__asn"), "left").drop("__asn")
    return rows


def names(core: DataFrame, as2org: DataFrame, peeringdb: DataFrame) -> DataFrame:
    """(asn, as_name) of every AS that any of the tables has and gives a name."""
    a = as2org.select("asn", F.col("name").alias("__as2org"), F.col("org_name").alias("__org"))
    p = peeringdb.select("asn", F.col("name").alias("__pdb"), F.col("name_long").alias("__long"), F.col("aka").alias("__aka"))
    rows = core.select("asn", F.col("name").alias("__core")).join(a, "asn", "full").join(p, "asn", "full")
    best = preferred_name(F.col("__aka"), F.col("__long"), F.col("__pdb"), F.col("__org"), F.col("__as2org"), F.col("__core"))
    return rows.select("asn", best.alias("as_name")).where("as_name IS NOT NULL")


def described(asns: DataFrame, core: DataFrame, as2org: DataFrame, peeringdb: DataFrame) -> DataFrame:
    """asns (asn, distinct) with as_name, the name that names() gives, and country; null where there is none. The tables are joined to these ASes alone."""
    c = core.select(F.col("asn").alias("__c"), F.col("name").alias("__core"), "country")
    a = as2org.select(F.col("asn").alias("__a"), F.col("name").alias("__as2org"), F.col("org_name").alias("__org"))
    p = peeringdb.select(F.col("asn").alias("__p"), F.col("name").alias("__pdb"), F.col("name_long").alias("__long"), F.col("aka").alias("__aka"))
    rows = asns.select("asn").join(c, F.col("asn") == F.col("__c"), "left").join(a, F.col("asn") == F.col("__a"), "left").join(p, F.col("asn") == F.col("__p"), "left")
    best = preferred_name(F.col("__aka"), F.col("__long"), F.col("__pdb"), F.col("__org"), F.col("__as2org"), F.col("__core"))
    return rows.select("asn", best.alias("as_name"), "country")


def with_name(rows: DataFrame, name_table: DataFrame, asn: str, out: str) -> DataFrame:
    """rows with the preferred name of the AS in a column; null where there is none."""
    return rows.join(name_table.select(F.col("asn").alias("__n"), F.col("as_name").alias(out)), F.col(asn) == F.col("__n"), "left").drop("__n")


def searched_names(core: DataFrame, as2org: DataFrame, peeringdb: DataFrame) -> DataFrame:
    """ASes of core (asn, name, country) with the five names that searches look at, as an array of lower-case texts."""
    rows = core.select("asn", "name", "country").join(as2org.select("asn", F.col("name").alias("__a"), F.col("org_name").alias("__o")), "asn", "left")
    rows = rows.join(peeringdb.select("asn", F.col("name").alias("__p"), F.col("name_long").alias("__l")), "asn", "left")
    texts = F.array_compact(F.array(*[F.lower(c) for c in ("name", "__a", "__o", "__p", "__l")]))
    return rows.select("asn", "name", "country", texts.alias("__texts"))


def text_search(core: DataFrame, as2org: DataFrame, peeringdb: DataFrame, text: str, most: int | None = None) -> DataFrame:
    """ASes of core with the text, in any case, in their name, their as2org name or organisation, or PeeringDB's name or long name; ordered by AS."""
    rows = searched_names(core, as2org, peeringdb)
    found = rows.where(F.exists("__texts", lambda t: F.contains(t, F.lit(text.lower())))).select("asn", "name", "country").distinct().orderBy("asn")
    return found if most is None else found.limit(most)


def by_country(core: DataFrame, country: str, most: int | None = None) -> DataFrame:
    found = core.where(F.upper("country") == country.upper()).select("asn", "name", "country").orderBy("asn")
    return found if most is None else found.limit(most)


def by_org(as2org: DataFrame, org_id: str, most: int | None = None) -> DataFrame:
    found = as2org.where(F.col("org_id") == org_id).select("asn", "name", "org_id", "org_name").orderBy("asn")
    return found if most is None else found.limit(most)


def only(table: DataFrame, asns: DataFrame, column: str = "asn") -> DataFrame:
    """Rows of table whose AS in a column is one of asns (asn).

    An inner join with each AS once: Spark moves a semi join below the aggregation that makes a table, where all rows of its source
    would be sorted by AS, and those of one AS by one task.
    """
    some = asns.select(F.col("asn").alias("__some")).distinct()
    return table.join(some, F.col(column) == F.col("__some")).drop("__some")


def records_of(table: DataFrame, asns: DataFrame) -> DataFrame:
    """Rows of any table with asn for a set of ASes."""
    return only(table, asns)


def org_sizes(as2org: DataFrame) -> DataFrame:
    """ASes of each named organisation."""
    return as2org.where(F.coalesce("org_name", F.lit("")) != "").groupBy("org_name").agg(F.countDistinct("asn").alias("as_count"))


def org_members(as2org: DataFrame) -> DataFrame:
    """Each AS with its organisation's number of ASes."""
    sizes = as2org.groupBy("org_id").agg(F.countDistinct("asn").alias("org_size"))
    return as2org.select("asn", "org_id").join(sizes, "org_id")


def countries(core: DataFrame) -> DataFrame:
    return core.where("country IS NOT NULL").groupBy("country").agg(F.count(F.lit(1)).alias("as_count"))


def country_lookup(table: DataFrame, query: str) -> DataFrame:
    """countries (code, name): the exact code if there is one, else names with the text in any case; by code."""
    exact = F.upper("code") == query.upper()
    hits = table.withColumn("__exact", exact).where(exact | F.contains(F.lower("name"), F.lit(query.lower())))
    any_exact = F.max("__exact").over(Window.partitionBy(F.lit(0)))
    return hits.withColumn("__any", any_exact).where("__exact OR NOT __any").select("code", "name").orderBy("code")


def resolve_countries(inputs: DataFrame, table: DataFrame) -> DataFrame:
    """inputs (input) with code and state: resolved, ambiguous or unknown.

    A unique exact name wins, then a code, then a single name with the text in it; two letters that
    nothing knows are taken as a code. table is the list of countries, which is small.
    """
    i = F.lower("input")
    near = inputs.select("input").distinct().join(F.broadcast(table), F.contains(F.lower("name"), i) | (F.lower("code") == i))
    by = near.groupBy("input").agg(
        F.count_if(F.lower("name") == i).alias("names"), F.max(F.when(F.lower("name") == i, F.col("code"))).alias("name_code"),
        F.max(F.when(F.lower("code") == i, F.col("code"))).alias("own_code"), F.count(F.lit(1)).alias("hits"), F.max("code").alias("one"),
    )
    code = F.when(F.col("names") == 1, F.col("name_code")).when(F.col("own_code").isNotNull(), F.col("own_code")).when(F.col("hits") == 1, F.col("one")).when(F.col("hits").isNull() & (F.length("input") == 2), F.upper("input"))
    state = F.when(F.col("code").isNotNull(), "resolved").when(F.col("hits").isNull(), "unknown").otherwise("ambiguous")
    return inputs.join(by, "input", "left").withColumn("code", code).withColumn("state", state).select("input", "code", "state")
