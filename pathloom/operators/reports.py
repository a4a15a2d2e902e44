"""Reports for tables of inputs: each section is one join for all inputs."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.prefix import host_prefix, is_v6, prefix_length
from pathloom.functions.scalars import parse_asn, query_type, truncated_name
from pathloom.plans.scratch import stored

from . import as2rel, asinfo, aspa, match, rov


@dataclass(frozen=True)
class Datasets:
    """The tables that reports draw on."""

    pfx2as: DataFrame
    roas: DataFrame
    aspas: DataFrame
    edges: DataFrame
    core: DataFrame
    as2org: DataFrame
    peeringdb: DataFrame

    def names(self) -> DataFrame:
        return asinfo.names(self.core, self.as2org, self.peeringdb)


SEVERITY = {"invalid": 0, "unknown": 1, "not_found": 1, "valid": 2}


def severity(label: str):
    out = F.lit(3)
    for name, rank in SEVERITY.items():
        out = F.when(F.col(label) == name, rank).otherwise(out)
    return out


def typed_inputs(inputs: DataFrame, forced: str | None = None) -> DataFrame:
    """inputs (input) with their type, and as an AS number or a prefix where they are one."""
    kind = F.lit(forced) if forced else query_type(F.col("input"))
    rows = inputs.withColumn("query_type", kind)
    return rows.withColumn("asn", F.when(F.col("query_type") == "asn", parse_asn(F.col("input")))).withColumn("query", F.when(F.col("query_type") == "prefix", host_prefix(F.col("input"))))


def type_counts(inputs: DataFrame) -> DataFrame:
    return typed_inputs(inputs).groupBy("query_type").agg(F.count(F.lit(1)).alias("n"))


def first_with_flag(rows: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    """The first rows of each group, with the group's true total and whether it was cut."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    total = rows.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(F.count(F.lit(1)).alias("total"))
    same = [F.col(c) == F.col(f"__{c}") for c in by]
    return ranked.where(F.col("rank") <= most).join(total, same).drop(*[f"__{c}" for c in by]).withColumn("truncated", F.col("total") > most)


def roa_counts(roas: DataFrame, asns: DataFrame) -> DataFrame:
    """ROAs of each AS that has any: all, IPv4, IPv6."""
    v6 = is_v6(F.col("prefix"))
    return asinfo.only(roas, asns, "origin_asn").groupBy("origin_asn").agg(F.count(F.lit(1)).alias("roas"), F.count_if(~v6).alias("ipv4"), F.count_if(v6).alias("ipv6"))


def roa_summary(roas: DataFrame, asns: DataFrame) -> DataFrame:
    """ROAs of each AS: all, IPv4, IPv6; ASes without any have zeros."""
    some = asns.select("asn").distinct()
    counts = roa_counts(roas, some)
    filled = some.join(counts, F.col("asn") == F.col("origin_asn"), "left").drop("origin_asn")
    return filled.fillna(0, ["roas", "ipv4", "ipv6"])


def roa_first(roas: DataFrame, asns: DataFrame, most: int) -> DataFrame:
    """The first ROAs of each AS by prefix, with its true total and whether it was cut."""
    of = asinfo.only(roas, asns, "origin_asn")
    return first_with_flag(of, ["origin_asn"], ["prefix", "max_length", "ta"], most)


def covering_roa_first(queries: DataFrame, roas: DataFrame, most: int) -> DataFrame:
    """The first ROAs that cover each query, longer ones first, with their true total and whether they were cut."""
    found = rov.covering_roas(queries.select("query").distinct(), roas)
    return first_with_flag(found, ["query"], [prefix_length(F.col("roa_prefix")).desc(), "roa_prefix", "origin_asn", "max_length", "ta"], most)


def announced_summary(labelled: DataFrame) -> DataFrame:
    """Announced prefixes of each AS of labelled (prefix, origin_asn, validation): by family and by label."""
    v6 = is_v6(F.col("prefix"))
    n = F.count(F.lit(1))
    valid, invalid = F.count_if(F.col("validation") == "valid"), F.count_if(F.col("validation") == "invalid")
    return labelled.groupBy("origin_asn").agg(
        n.alias("total"), F.count_if(~v6).alias("ipv4"), F.count_if(v6).alias("ipv6"), valid.alias("valid"), invalid.alias("invalid"), (n - valid - invalid).alias("unknown"), (valid * 100.0 / n).alias("valid_percent"),
    )


def announced_first(labelled: DataFrame, most: int) -> DataFrame:
    """The first announced prefixes of each AS, invalid ones before unknown and valid, then by prefix."""
    return first_with_flag(labelled, ["origin_asn"], [severity("validation"), "prefix"], most)


def labelled_prefixes(data: Datasets) -> DataFrame:
    states = rov.validated(data.pfx2as.select("prefix", "origin_asn"), data.roas)
    return states.withColumn("validation", F.when(F.col("state") == "not_found", "unknown").otherwise(F.col("state"))).drop("state")


#: Sections of a report on an AS.
SECTIONS = ("connectivity", "roas", "providers", "announced")


def inspect_asns(asns: DataFrame, data: Datasets, top: int = 5, sections: tuple[str, ...] = SECTIONS) -> DataFrame:
    """One row for each AS of asns: name and country, and of the chosen sections connectivity with named neighbours, ROAs, named providers, announced prefixes.

    Lists hold the first top entries; counts are of all.
    """
    if unknown := set(sections) - set(SECTIONS):
        raise ValueError(f"unknown sections {sorted(unknown)}; there are {', '.join(SECTIONS)}")
    # names and edges are read several times
    some, names = asns.select("asn").distinct(), stored(data.names())
    rows = asinfo.with_name(some, names, "asn", "as_name").join(data.core.select("asn", "country"), "asn", "left")

    def listed(of: DataFrame, by: str, order: list[str], out: str) -> DataFrame:
        fields = [c for c in of.columns if c != by and c not in order]
        return of.groupBy(F.col(by).alias("__of")).agg(F.sort_array(F.collect_list(F.struct(*order, *fields))).alias(out))

    parts = []
    if "connectivity" in sections:
        edges = stored(data.edges)
        counts = as2rel.connectivity_counts(edges, some, top)
        parts.append(counts.groupBy(F.col("asn").alias("__of")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))).alias("neighbours")))
        named = asinfo.with_name(as2rel.connectivity_top(edges, some, top), names, "neighbour", "neighbour_name")
        parts.append(listed(named.select("asn", "kind", "rank", "neighbour", "neighbour_name", "peers_count"), "asn", ["kind", "rank"], "top_neighbours"))
    if "roas" in sections:
        parts.append(roa_counts(data.roas, some).select(F.col("origin_asn").alias("__of"), F.struct("roas", "ipv4", "ipv6").alias("roas")))
        parts.append(listed(roa_first(data.roas, some, top).select("origin_asn", "rank", "prefix", "max_length", "ta", "truncated"), "origin_asn", ["rank"], "first_roas"))
    if "providers" in sections:
        own = aspa.of_customers(data.aspas, some)
        parts.append(own.select(F.col("customer_asn").alias("__of"), "provider_asns"))
        named = asinfo.with_name(own.select("customer_asn", F.explode("provider_asns").alias("provider_asn")), names, "provider_asn", "provider_name")
        parts.append(listed(named, "customer_asn", ["provider_asn"], "providers"))
    if "announced" in sections:
        labelled = asinfo.only(labelled_prefixes(data), some, "origin_asn")
        summary = announced_summary(labelled)
        parts.append(summary.select(F.col("origin_asn").alias("__of"), F.struct(*[c for c in summary.columns if c != "origin_asn"]).alias("announced")))
        parts.append(listed(announced_first(labelled, top).select("origin_asn", "rank", "prefix", "validation", "truncated"), "origin_asn", ["rank"], "first_announced"))
    if not parts:
        return rows
    # sections are stored one by one and meet in one aggregation: in one plan the aggregations and sorts of all of them lie in the same task
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(stored, parts))
    found = every.groupBy("__of").agg(*[F.first(c, ignorenulls=True).alias(c) for c in every.columns if c != "__of"])
    rows = rows.join(found, F.col("asn") == F.col("__of"), "left").drop("__of")
    none = F.struct(*[F.lit(0).cast("bigint").alias(c) for c in ("roas", "ipv4", "ipv6")])
    return rows.withColumn("roas", F.coalesce("roas", none)) if "roas" in sections else rows


def inspect_prefixes(queries: DataFrame, data: Datasets) -> DataFrame:
    """Each query (query) with its exact match or else its longest: prefix, origin, name, country, state, number of covering ROAs."""
    q = queries.select("query").distinct()
    longest = match.longest(q, data.pfx2as.select("prefix", "origin_asn"))
    exact = match.exact(q, data.pfx2as.select("prefix", "origin_asn")).select("query").distinct().withColumn("__exact", F.lit(True))
    rows = longest.join(exact, "query", "left").withColumn("match_type", F.when(F.col("__exact"), "exact").otherwise("longest")).drop("__exact")
    rows = rov.validated(rows, data.roas, "matched_prefix")
    roas = rov.covering_roas(q, data.roas).groupBy(F.col("query").alias("__q")).agg(F.count(F.lit(1)).alias("covering_roas"))
    rows = rows.join(roas, F.col("query") == F.col("__q"), "left").drop("__q").fillna(0, ["covering_roas"])
    country = data.core.select(F.col("asn").alias("__c"), "country")
    return asinfo.with_name(rows, data.names(), "origin_asn", "as_name").join(country, F.col("origin_asn") == F.col("__c"), "left").drop("__c")


def inspect_kept_names(names: DataFrame, index, most: int) -> DataFrame:
    """What inspect_names() gives, from a kept index (sources.name_index.NameIndex) and without a scan of names."""
    return first_with_flag(index.search(names), ["input"], ["asn"], most)


def inspect_names(names: DataFrame, data: Datasets, most: int) -> DataFrame:
    """ASes with each text (input) in one of the names that searches look at: the first by number, true totals, whether cut.

    A text and a name meet in the text's rarest run of three characters (in the whole text, if it is shorter), and are then
    compared, so any number of texts is searched for at once. An empty text is in no name.
    """
    asked = names.select("input").distinct().withColumn("__i", F.lower("input")).where("__i <> ''")
    rows = asinfo.searched_names(data.core, data.as2org, data.peeringdb)
    sizes = [r["n"] for r in asked.select(F.least(F.char_length("__i"), F.lit(3)).alias("n")).distinct().collect()]

    def runs(text, size: int):
        return F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(text) - (size - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(size)))

    def of_texts(size: int):
        return F.flatten(F.transform("__texts", lambda t: runs(t, size)))

    every = F.array_distinct(F.flatten(F.array(*map(of_texts, sorted(sizes))))) if sizes else F.array(F.lit(""))
    grams = rows.withColumn("__gram", F.explode(every))
    often = grams.groupBy(F.col("__gram").alias("__g")).agg(F.count(F.lit(1)).alias("__n"))
    own = F.array_distinct(F.when(F.char_length("__i") < 3, F.array("__i")).otherwise(runs(F.col("__i"), 3)))
    rarest = asked.select("input", "__i", F.explode(own).alias("__own")).join(often, F.col("__own") == F.col("__g"), "left")
    rarest = rarest.groupBy("input", "__i").agg(F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), "__own")).alias("__r")).select("input", "__i", F.col("__r.__own").alias("__key"))
    hits = grams.join(rarest, F.col("__gram") == F.col("__key")).where(F.exists("__texts", lambda t: F.contains(t, F.col("__i"))))
    return first_with_flag(hits.select("input", "asn", "name", "country"), ["input"], ["asn"], most)


def inspect_countries(inputs: DataFrame, table: DataFrame, data: Datasets, most: int) -> DataFrame:
    """ASes of the country that each text (input) names or is the code of: the first by number, true totals, whether cut."""
    found = asinfo.resolve_countries(inputs.select("input").distinct(), table).where("state = 'resolved'")
    core = data.core.select("asn", "name", F.upper("country").alias("__c"))
    rows = found.join(core, F.upper("code") == F.col("__c")).select("input", "code", "asn", "name")
    return first_with_flag(rows, ["input"], ["asn"], most)


def inspect(inputs: DataFrame, data: Datasets, top: int = 5, forced: str | None = None, sections: tuple[str, ...] = SECTIONS, countries: DataFrame | None = None) -> dict[str, DataFrame]:
    """A mixed batch of inputs: a table for each type of input, and how many there are of each.

    forced (asn, prefix, name or country) reads every input as of that type; sections are those of ASes. countries (code, name)
    is needed for the table of countries alone.
    """
    if forced not in (None, "asn", "prefix", "name", "country"):
        raise ValueError(f"unknown type {forced!r}: asn, prefix, name or country")
    typed = typed_inputs(inputs, forced)
    found = {
        "counts": typed.groupBy("query_type").agg(F.count(F.lit(1)).alias("n")), "asn": inspect_asns(typed.where("asn IS NOT NULL"), data, top, sections),
        "prefix": inspect_prefixes(typed.where("query IS NOT NULL"), data), "name": inspect_names(typed.where("query_type = 'name'"), data, top),
        "covering_roas": covering_roa_first(typed.where("query IS NOT NULL"), data.roas, top),
    }
    if countries is not None:
        found["country"] = inspect_countries(typed.where("query_type = 'country'"), countries, data, top)
    return found


MODES = {"longest": match.longest, "super": match.covering, "sub": match.covered, "exact": match.exact}


def prefix_search(queries: DataFrame, data: Datasets, name_width: int = 20, mode: str | None = None) -> DataFrame:
    """Matches of each query (query) with state and shortened name: longest, covering and covered ones, or those of one mode (longest, super, sub, exact).

    A query that is an AS number gives the prefixes that it originates.
    """
    if mode not in (None, *MODES):
        raise ValueError(f"unknown mode {mode!r}: {', '.join(MODES)}")
    pairs = data.pfx2as.select("prefix", "origin_asn")
    typed = queries.select("query").distinct().withColumn("__asn", parse_asn(F.col("query")))
    prefixes = typed.where("__asn IS NULL").select("query")
    found = match.search_union(prefixes, pairs) if mode is None else MODES[mode](prefixes, pairs).select("query", "matched_prefix", "origin_asn", F.lit(mode).alias("match_type"))
    own = typed.where("__asn IS NOT NULL").join(pairs.withColumnRenamed("prefix", "matched_prefix"), F.col("__asn") == F.col("origin_asn"))
    found = found.unionByName(own.select("query", "matched_prefix", "origin_asn", F.lit("asn").alias("match_type")))
    rows = rov.validated(found, data.roas, "matched_prefix")
    return asinfo.with_name(rows, data.names(), "origin_asn", "as_name").withColumn("as_name", truncated_name(F.col("as_name"), name_width))


def relation(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Each pair (asn1, asn2) with whether it is connected, and its counts."""
    found = as2rel.pair(edges, pairs).withColumn("found", F.lit(True))
    return pairs.join(found, ["asn1", "asn2"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def ip_lookup(addresses: DataFrame, data: Datasets) -> DataFrame:
    """Each address (ip) with its longest prefix, origin, name, country and state; addresses without a prefix have nulls."""
    queries = addresses.select("ip").distinct().withColumn("query", host_prefix(F.col("ip")))
    # read three times: for the pairs that were met, for their ASes, and in the end
    hits = stored(match.longest(queries, data.pfx2as.select("prefix", "origin_asn")).drop("query"))
    # state, name and country depend on the pair alone: only pairs that were met are looked up
    met = hits.select(F.col("matched_prefix").alias("__p"), F.col("origin_asn").alias("__o")).distinct()
    about = asinfo.described(met.select(F.col("__o").alias("asn")).distinct(), data.core, data.as2org, data.peeringdb)
    known = rov.validated(met, data.roas, "__p", "__o").join(about, F.col("__o") == F.col("asn"), "left").select("__p", "__o", "state", "as_name", "country")
    named = hits.join(known, (F.col("matched_prefix") == F.col("__p")) & F.col("origin_asn").eqNullSafe(F.col("__o")), "left").drop("__p", "__o")
    return queries.select("ip").join(named, "ip", "left")
