"""The registered routing queries, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.functions import scalars
from pathloom.operators import as2rel, asinfo, aspa, filters, match, reports, rib, rov, search, sweep
from pathloom.operators.filters import RouteFilters
from pathloom.sources import ingest
from pathloom.sources.views import dumps, elems, sql_with, view
from pathloom.streaming import streams

from .scratch import scratch

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str, *views: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = sql_with(sql, *views)
        return f

    return register


def same_rows_as(name: str) -> Callable[[Query], Query]:
    """Register a query that gives the rows of another in another way."""

    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = _SQL[name]
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


def _text(array: str) -> F.Column:
    return F.array_join(F.col(array).cast("array<string>"), ",")


# --- search -----------------------------------------------------------------------------------------

ELEM = ("seq", "collector", "elem_type", "peer_asn", "prefix")
ELEM_SQL = "seq, collector, elem_type, peer_asn, prefix"


@query(f"SELECT {ELEM_SQL} FROM bgp_elems WHERE peer_asn IN (64501, 64503) AND ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-15 00:00:00'", "bgp_elems")
def search_by_peer_time(spark, sf_dir):
    return RouteFilters(peer_asns=["64501", "64503"], start_ts="2024-01-05T00:00:00Z", duration="10d").apply(elems(spark, sf_dir)).select(*ELEM)


@query(f"SELECT {ELEM_SQL} FROM bgp_elems WHERE regexp_matches(coalesce(as_path, ''), '^6450[0-3] .* 6471[0-9]$')", "bgp_elems")
def search_as_path_regex(spark, sf_dir):
    return RouteFilters(as_path_regex="^6450[0-3] .* 6471[0-9]$").apply(elems(spark, sf_dir)).select(*ELEM)


@query(f"SELECT {ELEM_SQL} FROM bgp_elems WHERE origin_asn IN (64700, 64705)", "bgp_elems")
def search_origin_in(spark, sf_dir):
    return RouteFilters(origin_asns=["64700", "64705"]).apply(elems(spark, sf_dir)).select(*ELEM)


@query(f"SELECT {ELEM_SQL} FROM bgp_elems WHERE origin_asn IS NULL OR origin_asn NOT IN (64700, 64705)", "bgp_elems")
def search_origin_not_in(spark, sf_dir):
    return RouteFilters(origin_asns=["!64700", "!64705"]).apply(elems(spark, sf_dir)).select(*ELEM)


@query(f"SELECT {ELEM_SQL} FROM bgp_elems WHERE community LIKE '64502:%' OR community LIKE '%:300'", "bgp_elems")
def search_community_wildcard(spark, sf_dir):
    return RouteFilters(communities=["64502:*", "*:300"]).apply(elems(spark, sf_dir)).select(*ELEM)


@query(f"SELECT {ELEM_SQL} FROM bgp_elems WHERE community IS NULL OR NOT (community LIKE '64502:%' OR community LIKE '%:300')", "bgp_elems")
def search_community_negated(spark, sf_dir):
    return RouteFilters(communities=["!64502:*", "!*:300"]).apply(elems(spark, sf_dir)).select(*ELEM)


@query(f"SELECT {ELEM_SQL} FROM bgp_elems WHERE peer_ip IN ('192.0.2.3') AND elem_type = 'W' AND peer_asn NOT IN (64501)", "bgp_elems")
def search_peer_ip_type(spark, sf_dir):
    return RouteFilters(peer_ips=["192.0.2.3"], elem_type="w", peer_asns=["!64501"]).apply(elems(spark, sf_dir)).select(*ELEM)


@query("SELECT collector, count(*) AS matched, count(DISTINCT prefix) AS prefixes, count(DISTINCT peer_asn) AS peers FROM bgp_elems WHERE elem_type = 'A' AND regexp_matches(coalesce(as_path, ''), ' 6460[0-9] ') GROUP BY 1", "bgp_elems")
def search_stats_by_collector(spark, sf_dir):
    return search.by_collector(RouteFilters(elem_type="a", as_path_regex=" 6460[0-9] ").apply(elems(spark, sf_dir)))


@query(f"SELECT {ELEM_SQL} FROM bgp_elems WHERE elem_type = 'A' ORDER BY as_path DESC, seq LIMIT 50 OFFSET 10", "bgp_elems")
def search_topn_ordered(spark, sf_dir):
    return search.ElementQuery().where(elem_type="a").order_by("as_path", descending=True).limit(50, 10).select(*ELEM).on(elems(spark, sf_dir))


@query("SELECT count(*) AS n FROM bgp_elems WHERE peer_asn = 64504 AND elem_type = 'A'", "bgp_elems")
def search_count(spark, sf_dir):
    return search.ElementQuery().where(peer_asns=["64504"], elem_type="A").count(elems(spark, sf_dir))


@query("SELECT elem_type AS type, peer_ip, CAST(peer_asn AS STRING) AS peer_asn, prefix, coalesce(as_path, '') AS as_path, coalesce(CAST(origin_asn AS STRING), '') AS origin_asns, coalesce(community, '') AS communities, '' AS med, collector FROM bgp_elems", "bgp_elems")
def element_fields(spark, sf_dir):
    return filters.rendered(elems(spark, sf_dir), filters.parse_fields("type,peer_ip,peer_asn,prefix,as_path,origin_asns,communities,med,collector"))


@query("SELECT prefix, count(*) AS n, count(DISTINCT origin_asn) AS origins, count(CASE WHEN elem_type = 'W' THEN 1 END) AS withdrawals FROM bgp_elems GROUP BY 1", "bgp_elems")
def search_prefix_activity(spark, sf_dir):
    rows = elems(spark, sf_dir)
    return rows.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.get("origin_asns", F.lit(0))).alias("origins"), F.count_if(F.col("elem_type") == "W").alias("withdrawals"))


@query("SELECT collector_id, data_type, url, day_start FROM file_catalog WHERE day_end >= 6 AND day_start <= 9 AND collector_id IN ('rrc00', 'rrc02')", "file_catalog")
def catalog_select(spark, sf_dir):
    found = search.select_files(_catalog(spark, sf_dir), 1704499200, 1704758400, ["rrc00", "rrc02"])
    return found.select("collector_id", "data_type", "url", F.dayofmonth("ts_start").alias("day_start"))


@query("SELECT collector_id, data_type, url FROM file_catalog WHERE day_start >= 6 AND day_end <= 9 AND data_type = 'updates'", "file_catalog")
def catalog_contained(spark, sf_dir):
    return search.select_files(_catalog(spark, sf_dir), 1704499200, 1704758400, data_type="updates", contained=True).select("collector_id", "data_type", "url")


@query("SELECT count(*) AS files, CAST(sum(CASE WHEN exact_size > 0 THEN exact_size ELSE rough_size END) AS BIGINT) AS bytes, min(exact_size) > 0 AS exact, CAST(sum(rough_size) AS BIGINT) AS rough_bytes FROM file_catalog WHERE data_type = 'updates'", "file_catalog")
def catalog_bytes(spark, sf_dir):
    return search.file_bytes(_catalog(spark, sf_dir).where("data_type = 'updates'"))


def _catalog(spark, sf_dir):
    rows = view(spark, sf_dir, "file_catalog")
    day = lambda c: F.concat(F.lit("2024-01-"), F.lpad(F.least(F.col(c), F.lit(31)).cast("string"), 2, "0")).cast("timestamp_ntz")
    return rows.withColumn("ts_start", day("day_start")).withColumn("ts_end", day("day_end"))


# --- prefix sets ------------------------------------------------------------------------------------

_CONTAINS = "({a}.num // CAST(pow(2, 32 - {b}.len) AS BIGINT) = {b}.num // CAST(pow(2, 32 - {b}.len) AS BIGINT) AND {a}.len >= {b}.len)"


def _keyed(table: str, column: str = "prefix") -> str:
    """DuckDB: rows of a view with the number and the length of their IPv4 prefix."""
    parts = [f"CAST(split_part(split_part({column}, '/', 1), '.', {i}) AS BIGINT) * {256 ** (4 - i)}" for i in range(1, 5)]
    return f"(SELECT *, {' + '.join(parts)} AS num, CAST(split_part({column}, '/', 2) AS INTEGER) AS len FROM {table})"


WANTED = ("10.3.0.0/16", "10.5.20.0/24", "10.7.7.0/25", "10.9.0.0/18")
_WANTED = f"(SELECT unnest([{', '.join(repr(w) for w in WANTED)}]) AS prefix) w"


def _prefix_sql(condition: str) -> str:
    w = _keyed(_WANTED)
    return f"SELECT DISTINCT p.prefix, p.origin_asn FROM {_keyed('pfx2as')} p JOIN {w} w ON {condition}"


def _filtered(spark, sf_dir, up, down, negated=False):
    values = [f"!{w}" if negated else w for w in WANTED]
    return RouteFilters(prefixes=values, include_super=up, include_sub=down).apply_prefixes(view(spark, sf_dir, "pfx2as"))


@query(_prefix_sql("p.num = w.num AND p.len = w.len"), "pfx2as")
def prefix_filter_exact(spark, sf_dir):
    return _filtered(spark, sf_dir, False, False)


@query(_prefix_sql(_CONTAINS.format(a="w", b="p")), "pfx2as")
def prefix_filter_super(spark, sf_dir):
    return _filtered(spark, sf_dir, True, False)


@query(_prefix_sql(_CONTAINS.format(a="p", b="w")), "pfx2as")
def prefix_filter_sub(spark, sf_dir):
    return _filtered(spark, sf_dir, False, True)


@query(_prefix_sql(f"{_CONTAINS.format(a='p', b='w')} OR {_CONTAINS.format(a='w', b='p')}"), "pfx2as")
def prefix_filter_super_sub(spark, sf_dir):
    return _filtered(spark, sf_dir, True, True)


@query(f"SELECT p.prefix, p.origin_asn FROM {_keyed('pfx2as')} p WHERE NOT EXISTS (SELECT 1 FROM {_keyed(_WANTED)} w WHERE {_CONTAINS.format(a='p', b='w')})", "pfx2as")
def prefix_filter_negated(spark, sf_dir):
    return _filtered(spark, sf_dir, False, True, negated=True)


_ELEM_PREFIXES = "(SELECT DISTINCT prefix AS query FROM bgp_elems)"


def _elem_prefixes(spark, sf_dir):
    return view(spark, sf_dir, "bgp_elems").select(F.col("prefix").alias("query")).distinct()


@query("SELECT q.query, p.prefix AS matched_prefix, p.origin_asn FROM (SELECT DISTINCT prefix AS query FROM bgp_elems) q JOIN pfx2as p ON q.query = p.prefix", "bgp_elems", "pfx2as")
def pfx2as_exact(spark, sf_dir):
    return match.exact(_elem_prefixes(spark, sf_dir), view(spark, sf_dir, "pfx2as"))


@query(
    f"SELECT query, matched_prefix, origin_asn FROM (SELECT q.query, p.prefix AS matched_prefix, p.origin_asn, rank() OVER (PARTITION BY q.query ORDER BY p.len DESC) AS r FROM {_keyed(_ELEM_PREFIXES, 'query')} q JOIN {_keyed('pfx2as')} p ON {_CONTAINS.format(a='q', b='p')}) x WHERE r = 1",
    "bgp_elems", "pfx2as",
)
def pfx2as_longest(spark, sf_dir):
    return match.longest(_elem_prefixes(spark, sf_dir), view(spark, sf_dir, "pfx2as"))


@query(
    f"SELECT seq, query, matched_prefix, origin_asn FROM (SELECT q.seq, q.query, p.prefix AS matched_prefix, p.origin_asn, rank() OVER (PARTITION BY q.seq ORDER BY p.len DESC) AS r FROM {_keyed('(SELECT seq, prefix AS query FROM bgp_elems)', 'query')} q JOIN {_keyed('pfx2as')} p ON {_CONTAINS.format(a='q', b='p')}) x WHERE r = 1",
    "bgp_elems", "pfx2as",
)
def elems_longest_sweep(spark, sf_dir):
    """The longest match of every element by one ordered pass, repeated prefixes included."""
    return sweep.longest(view(spark, sf_dir, "bgp_elems").select("seq", F.col("prefix").alias("query")), view(spark, sf_dir, "pfx2as"))


@query(f"SELECT q.query, p.prefix AS matched_prefix, p.origin_asn FROM {_keyed(_ELEM_PREFIXES, 'query')} q JOIN {_keyed('pfx2as')} p ON {_CONTAINS.format(a='q', b='p')}", "bgp_elems", "pfx2as")
def pfx2as_covering_sweep(spark, sf_dir):
    return sweep.covering(_elem_prefixes(spark, sf_dir), view(spark, sf_dir, "pfx2as"))


@query(f"SELECT q.query, p.prefix AS matched_prefix, string_agg(CAST(p.origin_asn AS STRING), ',' ORDER BY p.origin_asn) AS origin_asns FROM {_keyed(_ELEM_PREFIXES, 'query')} q JOIN {_keyed('pfx2as')} p ON {_CONTAINS.format(a='q', b='p')} GROUP BY 1, 2", "bgp_elems", "pfx2as")
def pfx2as_covering(spark, sf_dir):
    return match.grouped(match.covering(_elem_prefixes(spark, sf_dir), view(spark, sf_dir, "pfx2as"))).withColumn("origin_asns", _text("origin_asns"))


_ROA_PREFIXES = "(SELECT DISTINCT prefix AS query FROM roas)"


@query(f"SELECT q.query, p.prefix AS matched_prefix, p.origin_asn FROM {_keyed(_ROA_PREFIXES, 'query')} q JOIN {_keyed('pfx2as')} p ON {_CONTAINS.format(a='p', b='q')}", "roas", "pfx2as")
def pfx2as_covered(spark, sf_dir):
    return match.covered(view(spark, sf_dir, "roas").select(F.col("prefix").alias("query")).distinct(), view(spark, sf_dir, "pfx2as"))


@query(
    f"""SELECT query, matched_prefix, origin_asn, CASE min(k) WHEN 0 THEN 'longest' WHEN 1 THEN 'super' ELSE 'sub' END AS match_type FROM (
  SELECT q.query, p.prefix AS matched_prefix, p.origin_asn, CASE WHEN rank() OVER (PARTITION BY q.query ORDER BY p.len DESC) = 1 THEN 0 ELSE 1 END AS k FROM {_keyed(_ROA_PREFIXES, 'query')} q JOIN {_keyed('pfx2as')} p ON {_CONTAINS.format(a='q', b='p')}
  UNION ALL SELECT q.query, p.prefix, p.origin_asn, 2 FROM {_keyed(_ROA_PREFIXES, 'query')} q JOIN {_keyed('pfx2as')} p ON {_CONTAINS.format(a='p', b='q')}) x GROUP BY 1, 2, 3""",
    "roas", "pfx2as",
)
def pfx2as_search_union(spark, sf_dir):
    return match.search_union(view(spark, sf_dir, "roas").select(F.col("prefix").alias("query")).distinct(), view(spark, sf_dir, "pfx2as"))


@query("SELECT prefix, origin_asn FROM pfx2as WHERE origin_asn IN (64700, 64711)", "pfx2as")
def pfx2as_by_asn(spark, sf_dir):
    return view(spark, sf_dir, "pfx2as").where(F.col("origin_asn").isin(64700, 64711))


@query("SELECT count(*) AS records, count(DISTINCT prefix) AS prefixes FROM pfx2as", "pfx2as")
def pfx2as_counts(spark, sf_dir):
    return view(spark, sf_dir, "pfx2as").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("prefix").alias("prefixes"))


# --- origin validation ------------------------------------------------------------------------------

_STATES = f"""states AS (SELECT p.prefix, p.origin_asn, p.len, CASE WHEN bool_or(r.origin_asn = p.origin_asn AND r.origin_asn <> 0 AND p.len <= r.max_length) THEN 'valid' WHEN count(r.origin_asn) > 0 THEN 'invalid' ELSE 'not_found' END AS state,
  bool_or(r.origin_asn = p.origin_asn) AS own, string_agg(DISTINCT CAST(r.origin_asn AS STRING), ', ' ORDER BY CAST(r.origin_asn AS STRING)) AS asns
  FROM {_keyed('pfx2as')} p LEFT JOIN {_keyed('roas')} r ON {_CONTAINS.format(a='p', b='r')} GROUP BY 1, 2, 3)"""


def _states_sql(body: str) -> str:
    return f", {_STATES}\n{body}"


@query(_states_sql("SELECT prefix, origin_asn, state FROM states"), "pfx2as", "roas")
def rov_state(spark, sf_dir):
    return rov.validated(view(spark, sf_dir, "pfx2as"), view(spark, sf_dir, "roas"))


# The reasons in words are those of rov.VALID, rov.NOT_FOUND, rov.TOO_LONG and rov.WRONG_ASN.
@query(
    _states_sql("""SELECT prefix, origin_asn, state, CASE state WHEN 'valid' THEN 'ROA exists with matching ASN and valid prefix length' WHEN 'not_found' THEN 'No covering ROA found'
  ELSE CASE WHEN own THEN concat('Prefix length ', CAST(len AS STRING), ' exceeds max_length in covering ROAs') ELSE concat('ASN ', CAST(origin_asn AS STRING), ' not authorized; authorized ASNs: ', asns) END END AS reason FROM states"""),
    "pfx2as", "roas",
)
def rov_detailed(spark, sf_dir):
    return rov.detailed(view(spark, sf_dir, "pfx2as"), view(spark, sf_dir, "roas"))


@query(f"SELECT q.query, r.prefix AS roa_prefix, r.max_length, r.origin_asn, r.ta FROM {_keyed(_ELEM_PREFIXES, 'query')} q JOIN {_keyed('roas')} r ON q.num // CAST(pow(2, 32 - r.len) AS BIGINT) = r.num // CAST(pow(2, 32 - r.len) AS BIGINT)", "bgp_elems", "roas")
def rov_covering_roas(spark, sf_dir):
    return rov.covering_roas(_elem_prefixes(spark, sf_dir), view(spark, sf_dir, "roas")).select("query", "roa_prefix", "max_length", "origin_asn", "ta")


@query(_states_sql("SELECT CASE state WHEN 'not_found' THEN 'unknown' ELSE state END AS validation, count(*) AS n, count(*) * 100.0 / (SELECT count(*) FROM states) AS percent FROM states GROUP BY 1"), "pfx2as", "roas")
def rov_stats(spark, sf_dir):
    return rov.label_counts(rov.validated(view(spark, sf_dir, "pfx2as"), view(spark, sf_dir, "roas")), "state").withColumnRenamed("state", "validation")


@query("SELECT DISTINCT prefix, max_length, origin_asn FROM roas WHERE origin_asn IN (64701, 64708) OR prefix IN ('10.4.0.0/16', '10.4.0.0/24')", "roas")
def roa_union(spark, sf_dir):
    wanted = spark.createDataFrame([("10.4.0.0/24",)], "query string")
    asns = spark.createDataFrame([(64701,), (64708,)], "asn long")
    return rov.union_lookup(view(spark, sf_dir, "roas"), wanted, asns).select("prefix", "max_length", "origin_asn")


@query("SELECT 'roas' AS dataset, count(*) AS n FROM roas UNION ALL SELECT 'aspas', count(DISTINCT customer_asn) FROM aspas UNION ALL SELECT 'as2rel', count(*) FROM as2rel UNION ALL SELECT 'asinfo_core', count(*) FROM asinfo_core", "roas", "aspas", "as2rel", "asinfo_core")
def dataset_counts(spark, sf_dir):
    counted = {"roas": F.count(F.lit(1)), "aspas": F.countDistinct("customer_asn"), "as2rel": F.count(F.lit(1)), "asinfo_core": F.count(F.lit(1))}
    parts = [view(spark, sf_dir, name).agg(c.alias("n")).select(F.lit(name).alias("dataset"), "n") for name, c in counted.items()]
    return reduce(DataFrame.unionByName, parts)


# --- routing tables ---------------------------------------------------------------------------------

_EVENTS = """ev AS (SELECT 0 AS phase, seq, collector, peer_ip, peer_asn, prefix, origin_asn, 'A' AS elem_type, dump_ts AS ts FROM rib_dumps WHERE dump_ts = TIMESTAMP '2024-01-15 00:00:00'
  UNION ALL SELECT 1, seq, collector, peer_ip, peer_asn, prefix, origin_asn, elem_type, ts FROM bgp_elems WHERE ts > TIMESTAMP '2024-01-15 00:00:00' AND ts <= TIMESTAMP '{last}')"""
MATCH = "origin_asn IN (64700, 64701, 64702)"
BASE_TS, LAST_TS = "2024-01-15 00:00:00", "2024-01-20 00:00:00"
INSTANTS = ("2024-01-16 00:00:00", "2024-01-18 00:00:00", "2024-01-20 00:00:00")
_ROUTE = "collector, peer_ip, peer_asn, prefix"


def _ntz(text: str) -> F.Column:
    return F.lit(text).cast("timestamp_ntz")


def replay_events(spark, sf_dir, wanted: RouteFilters | None = None, last: str = LAST_TS):
    """The dump of mid-January and the updates until the last instant, with what matches as a column."""
    wanted = wanted or RouteFilters()
    base = wanted.safe(dumps(spark, sf_dir).where(F.col("dump_ts") == _ntz(BASE_TS)).withColumn("ts", F.col("dump_ts")))
    updates = wanted.safe(elems(spark, sf_dir).where((F.col("ts") > _ntz(BASE_TS)) & (F.col("ts") <= _ntz(last))))
    columns = ["seq", "ts", "collector", "peer_ip", "peer_asn", "prefix", "origin_asns"]
    return rib.events_of(base.select(*columns), updates.select(*columns, "elem_type"), wanted.announce_predicate())


def _routes(df):
    return df.withColumn("origin_asn", F.get("origin_asns", F.lit(0))).drop("origin_asns")


def _last_sql(extra: str = "") -> str:
    return f", {_EVENTS.format(last=LAST_TS)}, last AS (SELECT *, row_number() OVER (PARTITION BY {_ROUTE} ORDER BY phase DESC, seq DESC) AS r FROM ev{extra})"


@query(_last_sql() + f" SELECT {_ROUTE}, origin_asn FROM last WHERE r = 1 AND elem_type = 'A'", "rib_dumps", "bgp_elems")
def rib_snapshot(spark, sf_dir):
    return _routes(rib.snapshot(replay_events(spark, sf_dir), ["origin_asns"]))


@query(_last_sql() + f" SELECT {_ROUTE}, origin_asn FROM last WHERE r = 1 AND elem_type = 'A' AND {MATCH}", "rib_dumps", "bgp_elems")
def rib_snapshot_filtered(spark, sf_dir):
    return _routes(rib.snapshot(replay_events(spark, sf_dir, RouteFilters(origin_asns=["64700", "64701", "64702"])), ["origin_asns"]))


@query(_last_sql() + f" SELECT {_ROUTE}, last.origin_asn FROM last JOIN peers USING (collector, peer_ip, peer_asn) WHERE r = 1 AND elem_type = 'A' AND (num_v4_pfxs >= 800000 OR num_v6_pfxs >= 100000)", "rib_dumps", "bgp_elems", "peers")
def rib_full_feed_only(spark, sf_dir):
    events = filters.full_feed_only(replay_events(spark, sf_dir), view(spark, sf_dir, "peers"))
    return _routes(rib.snapshot(events, ["origin_asns"]))


@query(_last_sql() + f" SELECT {_ROUTE}, origin_asn FROM last WHERE r = 1 AND elem_type = 'A' AND origin_asn IN (SELECT asn FROM asinfo_core WHERE country IN ('N3', 'N7', 'N11'))", "rib_dumps", "bgp_elems", "asinfo_core")
def rib_country(spark, sf_dir):
    core = view(spark, sf_dir, "asinfo_core").withColumn("country", F.when(F.col("country").isin("N3", "N7", "N11"), "XX"))
    events = filters.country_flag(replay_events(spark, sf_dir), core, "xx", "is_in").withColumn("is_match", F.col("is_in")).drop("is_in")
    return _routes(rib.snapshot(events, ["origin_asns"]))


_INSTANTS = "(SELECT unnest([" + ", ".join(f"'{i}'" for i in INSTANTS) + "]) AS rib_ts) i"


@query(
    f", {_EVENTS.format(last=LAST_TS)}, x AS (SELECT i.rib_ts, ev.*, row_number() OVER (PARTITION BY i.rib_ts, {_ROUTE} ORDER BY phase DESC, seq DESC) AS r FROM ev JOIN {_INSTANTS} ON ev.ts <= CAST(i.rib_ts AS TIMESTAMP)) SELECT rib_ts, {_ROUTE}, origin_asn FROM x WHERE r = 1 AND elem_type = 'A' AND {MATCH}",
    "rib_dumps", "bgp_elems",
)
def rib_snapshots_multi(spark, sf_dir):
    events = replay_events(spark, sf_dir, RouteFilters(origin_asns=["64700", "64701", "64702"]))
    found = rib.snapshots(events, ["origin_asns"], [_ntz(i) for i in INSTANTS])
    return _routes(found).withColumn("rib_ts", F.date_format("rib_ts", "yyyy-MM-dd HH:mm:ss"))


@query(
    f""", {_EVENTS.format(last=LAST_TS)}, x AS (SELECT *, elem_type = 'A' AND {MATCH} AS live, lag(elem_type = 'A' AND {MATCH}) OVER (PARTITION BY {_ROUTE} ORDER BY phase, seq) AS before FROM ev)
SELECT CASE WHEN ts <= TIMESTAMP '{INSTANTS[1]}' THEN '{INSTANTS[1]}' ELSE '{INSTANTS[2]}' END AS rib_ts, seq, {_ROUTE}, elem_type, origin_asn FROM x WHERE phase = 1 AND (live OR before) AND ts > TIMESTAMP '{INSTANTS[0]}'""",
    "rib_dumps", "bgp_elems",
)
def rib_update_log(spark, sf_dir):
    events = replay_events(spark, sf_dir, RouteFilters(origin_asns=["64700", "64701", "64702"]))
    found = _routes(rib.update_log(events, [_ntz(i) for i in INSTANTS])).drop("ts")
    return found.withColumn("rib_ts", F.date_format("rib_ts", "yyyy-MM-dd HH:mm:ss"))


_DAYS = "(SELECT unnest([6, 14, 15, 20]) AS day) i"


@query(f"SELECT c.collector_id, i.day, max(c.day_start) AS dump_day FROM file_catalog c JOIN {_DAYS} ON c.day_start <= i.day WHERE c.data_type = 'rib' GROUP BY 1, 2", "file_catalog")
def rib_base_asof(spark, sf_dir):
    instants = [_ntz(f"2024-01-{d:02d}") for d in (6, 14, 15, 20)]
    found = rib.require_dumps(rib.base_dumps(_catalog(spark, sf_dir), instants))
    return found.select("collector_id", F.dayofmonth("rib_ts").alias("day"), F.dayofmonth("dump_ts").alias("dump_day"))


@query("SELECT c.collector_id, c.url FROM file_catalog c WHERE c.data_type = 'updates' AND c.day_end >= 15 AND c.day_start <= 20", "file_catalog")
def rib_update_files(spark, sf_dir):
    catalog = _catalog(spark, sf_dir)
    return rib.update_files(catalog, rib.base_dumps(catalog, [_ntz("2024-01-20"), _ntz("2024-01-17")])).select("collector_id", "url")


# --- AS information ---------------------------------------------------------------------------------

_NAMES = """names AS (SELECT asn, coalesce(nullif(p.aka, ''), nullif(p.name_long, ''), nullif(p.name, ''), nullif(o.org_name, ''), nullif(o.name, ''), c.name) AS as_name
  FROM asinfo_core c FULL JOIN asinfo_as2org o USING (asn) FULL JOIN asinfo_peeringdb p USING (asn))"""
_NAME_VIEWS = ("asinfo_core", "asinfo_as2org", "asinfo_peeringdb")


def _names(spark, sf_dir):
    return asinfo.names(*(view(spark, sf_dir, v) for v in _NAME_VIEWS))


@query(
    "SELECT c.asn, c.name, c.country, o.name AS as2org_name, o.org_id, p.name_long, h.ipv4, u.user_count FROM asinfo_core c LEFT JOIN asinfo_as2org o USING (asn) LEFT JOIN asinfo_peeringdb p USING (asn) LEFT JOIN asinfo_hegemony h USING (asn) LEFT JOIN asinfo_population u USING (asn)",
    *_NAME_VIEWS, "asinfo_hegemony", "asinfo_population",
)
def asinfo_full(spark, sf_dir):
    parts = {n: view(spark, sf_dir, f"asinfo_{n}") for n in asinfo.PARTS}
    rows = asinfo.full_records(view(spark, sf_dir, "asinfo_core"), **parts)
    return rows.selectExpr("asn", "name", "country", "as2org.name AS as2org_name", "as2org.org_id AS org_id", "peeringdb.name_long AS name_long", "hegemony.ipv4 AS ipv4", "population.user_count AS user_count")


@query(f", {_NAMES} SELECT asn, as_name FROM names WHERE as_name IS NOT NULL", *_NAME_VIEWS)
def asinfo_preferred_name(spark, sf_dir):
    return _names(spark, sf_dir)


_NAMED = "SELECT DISTINCT c.asn, c.name, c.country FROM asinfo_core c LEFT JOIN asinfo_as2org o USING (asn) LEFT JOIN asinfo_peeringdb p USING (asn) WHERE contains(lower(c.name), '{0}') OR contains(lower(o.name), '{0}') OR contains(lower(o.org_name), '{0}') OR contains(lower(p.name), '{0}') OR contains(lower(p.name_long), '{0}')"


@query(_NAMED.format("ong-1"), *_NAME_VIEWS)
def asinfo_long_name_search(spark, sf_dir):
    return asinfo.text_search(*(view(spark, sf_dir, v) for v in _NAME_VIEWS), "ONG-1")


@query(_NAMED.format("ma"), *_NAME_VIEWS)
def asinfo_text_search(spark, sf_dir):
    return asinfo.text_search(*(view(spark, sf_dir, v) for v in _NAME_VIEWS), "MA")


@query("SELECT asn, name, country FROM asinfo_core WHERE country = 'N7' ORDER BY asn LIMIT 100", "asinfo_core")
def asinfo_by_country(spark, sf_dir):
    return asinfo.by_country(view(spark, sf_dir, "asinfo_core"), "n7", 100)


@query("SELECT asn, name, org_id, org_name FROM asinfo_as2org WHERE org_id = 'ORG-7'", "asinfo_as2org")
def asinfo_by_org(spark, sf_dir):
    return asinfo.by_org(view(spark, sf_dir, "asinfo_as2org"), "ORG-7")


@query("SELECT org_name, count(DISTINCT asn) AS as_count FROM asinfo_as2org WHERE org_name <> '' GROUP BY 1", "asinfo_as2org")
def org_as_count(spark, sf_dir):
    return asinfo.org_sizes(view(spark, sf_dir, "asinfo_as2org"))


@query("SELECT asn, org_id, count(*) OVER (PARTITION BY org_id) AS org_size FROM asinfo_as2org", "asinfo_as2org")
def org_members(spark, sf_dir):
    return asinfo.org_members(view(spark, sf_dir, "asinfo_as2org"))


@query("SELECT code, name FROM countries WHERE contains(lower(name), 'tion_1') ORDER BY code", "countries")
def country_lookup(spark, sf_dir):
    return asinfo.country_lookup(view(spark, sf_dir, "countries"), "TION_1")


@query("SELECT country, count(*) AS as_count FROM asinfo_core GROUP BY 1", "asinfo_core")
def country_as_count(spark, sf_dir):
    return asinfo.countries(view(spark, sf_dir, "asinfo_core"))


# --- AS relationships -------------------------------------------------------------------------------

_SIDES = "sides AS (SELECT asn1, asn2, rel, peers_count FROM as2rel UNION ALL SELECT asn2, asn1, -rel, peers_count FROM as2rel)"
_AGGREGATES = "coalesce(max(CASE WHEN rel = 0 THEN peers_count END), 0) AS connected, CAST(coalesce(sum(CASE WHEN rel = 1 THEN peers_count END), 0) AS BIGINT) AS as1_upstream, CAST(coalesce(sum(CASE WHEN rel = -1 THEN peers_count END), 0) AS BIGINT) AS as2_upstream"
_MOST = "(SELECT max(peers_count) FROM as2rel)"
_UP = "u AS (SELECT CASE rel WHEN -1 THEN asn1 ELSE asn2 END AS customer_asn, CASE rel WHEN -1 THEN asn2 ELSE asn1 END AS upstream_asn, peers_count FROM as2rel WHERE rel <> 0)"


def _asns(spark, *numbers):
    return spark.createDataFrame([(n,) for n in numbers], "asn long")


@query(f", {_SIDES}, a AS (SELECT asn1, asn2, {_AGGREGATES} FROM sides GROUP BY 1, 2) SELECT *, connected * 100.0 / {_MOST} AS connected_pct, greatest(greatest(connected - as1_upstream, 0) - as2_upstream, 0) * 100.0 / {_MOST} AS peer_pct, as1_upstream * 100.0 / {_MOST} AS as1_upstream_pct, as2_upstream * 100.0 / {_MOST} AS as2_upstream_pct FROM a", "as2rel")
def as2rel_neighbors(spark, sf_dir):
    edges = view(spark, sf_dir, "as2rel")
    return as2rel.with_percentages(as2rel.aggregated(as2rel.symmetric(edges)), as2rel.max_peers(edges))


@query(f", {_SIDES}, {_NAMES} SELECT asn1, asn2, {_AGGREGATES}, max(as_name) AS asn2_name FROM sides LEFT JOIN names ON asn = asn2 WHERE asn1 IN (64600, 64703) GROUP BY 1, 2", "as2rel", *_NAME_VIEWS)
def as2rel_neighbors_named(spark, sf_dir):
    return asinfo.with_name(as2rel.neighbours(view(spark, sf_dir, "as2rel"), _asns(spark, 64600, 64703)), _names(spark, sf_dir), "asn2", "asn2_name")


@query(f", {_SIDES} SELECT asn1, asn2, {_AGGREGATES} FROM sides WHERE (asn1 = 64700 AND asn2 = 64600) OR (asn1 = 64601 AND asn2 = 64709) GROUP BY 1, 2", "as2rel")
def as2rel_pair(spark, sf_dir):
    pairs = spark.createDataFrame([(64700, 64600), (64601, 64709), (1, 2)], "asn1 long, asn2 long")
    return as2rel.pair(view(spark, sf_dir, "as2rel"), pairs)


@query(f", {_SIDES} SELECT asn1, asn2, {_AGGREGATES} FROM sides WHERE asn1 < asn2 AND asn1 IN (64600, 64601, 64605, 64702, 64704) AND asn2 IN (64600, 64601, 64605, 64702, 64704) GROUP BY 1, 2", "as2rel")
def as2rel_multi_pairs(spark, sf_dir):
    return as2rel.pairs_among(view(spark, sf_dir, "as2rel"), _asns(spark, 64600, 64601, 64605, 64702, 64704))


@query(f", {_UP} SELECT customer_asn, max(CASE WHEN upstream_asn = 64600 THEN peers_count END) AS visibility FROM u GROUP BY 1 HAVING count(DISTINCT upstream_asn) = 1 AND max(CASE WHEN upstream_asn = 64600 THEN peers_count END) >= floor(0.1 * {_MOST})", "as2rel")
def as2rel_single_homed(spark, sf_dir):
    return as2rel.single_homed(view(spark, sf_dir, "as2rel"), 64600, 10.0)


@query(f", {_UP} SELECT customer_asn, count(DISTINCT upstream_asn) AS upstream_count FROM u GROUP BY 1", "as2rel")
def as2rel_upstream_count(spark, sf_dir):
    return as2rel.upstream_counts(view(spark, sf_dir, "as2rel"))


_KINDS = "k AS (SELECT asn1 AS asn, CASE rel WHEN -1 THEN 'upstream' WHEN 0 THEN 'peer' ELSE 'downstream' END AS kind, asn2 AS neighbour, peers_count FROM sides WHERE asn1 IN (64600, 64701, 64715))"


@query(f", {_SIDES}, {_KINDS} SELECT asn, kind, count(*) AS n, count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY asn) AS percent, count(*) > 5 AS truncated FROM k GROUP BY 1, 2", "as2rel")
def as2rel_connectivity(spark, sf_dir):
    return as2rel.connectivity_counts(view(spark, sf_dir, "as2rel"), _asns(spark, 64600, 64701, 64715), 5)


@query(f", {_SIDES}, {_KINDS}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY asn, kind ORDER BY peers_count DESC, neighbour) AS INTEGER) AS rank FROM k) SELECT *, peers_count * 100.0 / {_MOST} AS peers_percent FROM r WHERE rank <= 5", "as2rel")
def as2rel_connectivity_top(spark, sf_dir):
    return as2rel.connectivity_top(view(spark, sf_dir, "as2rel"), _asns(spark, 64600, 64701, 64715), 5)


@query(f", {_SIDES}, a AS (SELECT asn1, asn2, {_AGGREGATES} FROM sides GROUP BY 1, 2) SELECT * FROM a WHERE as2_upstream > 0 AND connected * 100.0 / {_MOST} >= 40", "as2rel")
def as2rel_visible_upstreams(spark, sf_dir):
    edges = view(spark, sf_dir, "as2rel")
    counts = as2rel.with_percentages(as2rel.aggregated(as2rel.symmetric(edges)), as2rel.max_peers(edges))
    return as2rel.min_visibility(as2rel.by_relation(counts, "upstream"), 40.0).select("asn1", "asn2", "connected", "as1_upstream", "as2_upstream")


# --- provider authorisations --------------------------------------------------------------------------


@query("SELECT customer_asn, string_agg(CAST(provider_asn AS STRING), ',' ORDER BY provider_asn) AS provider_asns FROM aspas GROUP BY 1", "aspas")
def aspa_by_customer(spark, sf_dir):
    return aspa.providers(view(spark, sf_dir, "aspas")).withColumn("provider_asns", _text("provider_asns"))


@query("SELECT customer_asn, string_agg(CAST(provider_asn AS STRING), ',' ORDER BY provider_asn) AS provider_asns FROM aspas WHERE customer_asn IN (SELECT customer_asn FROM aspas WHERE provider_asn = 64603) GROUP BY 1", "aspas")
def aspa_by_provider(spark, sf_dir):
    return aspa.of_providers(view(spark, sf_dir, "aspas"), _asns(spark, 64603)).withColumn("provider_asns", _text("provider_asns"))


@query(
    f", {_NAMES} SELECT a.customer_asn, max(n.as_name) AS customer_name, max(c.country) AS customer_country, string_agg(concat(CAST(a.provider_asn AS STRING), '=', coalesce(m.as_name, '')), ',' ORDER BY a.provider_asn) AS providers FROM aspas a LEFT JOIN names n ON n.asn = a.customer_asn LEFT JOIN names m ON m.asn = a.provider_asn LEFT JOIN asinfo_core c ON c.asn = a.customer_asn GROUP BY 1",
    "aspas", *_NAME_VIEWS,
)
def aspa_enriched(spark, sf_dir):
    found = aspa.enriched(view(spark, sf_dir, "aspas"), _names(spark, sf_dir), view(spark, sf_dir, "asinfo_core"))
    return found.withColumn("providers", F.array_join(F.transform("providers", lambda p: F.concat(p["asn"].cast("string"), F.lit("="), F.coalesce(p["name"], F.lit("")))), ","))


# --- reports ------------------------------------------------------------------------------------------


def _data(spark, sf_dir) -> reports.Datasets:
    return reports.Datasets(*(view(spark, sf_dir, v) for v in ("pfx2as", "roas", "aspas", "as2rel", "asinfo_core", "asinfo_as2org", "asinfo_peeringdb")))


_IPS = "(SELECT DISTINCT concat('10.', CAST(user_id % 20 AS STRING), '.', CAST(event_id % 70 AS STRING), '.', CAST(event_id % 200 AS STRING)) AS ip FROM events)"


@query(
    f""", {_NAMES}, {_STATES}, hit AS (SELECT q.ip, p.prefix AS matched_prefix, p.origin_asn, rank() OVER (PARTITION BY q.ip ORDER BY p.len DESC) AS r FROM {_keyed("(SELECT ip, concat(ip, '/32') AS prefix FROM " + _IPS + ")")} q JOIN {_keyed('pfx2as')} p ON {_CONTAINS.format(a='q', b='p')})
SELECT i.ip, h.matched_prefix, h.origin_asn, s.state, n.as_name, c.country FROM {_IPS} i LEFT JOIN hit h ON h.ip = i.ip AND h.r = 1 LEFT JOIN states s ON s.prefix = h.matched_prefix AND s.origin_asn = h.origin_asn LEFT JOIN names n ON n.asn = h.origin_asn LEFT JOIN asinfo_core c ON c.asn = h.origin_asn""",
    "pfx2as", "roas", *_NAME_VIEWS,
)
def ip_lookup(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    part = lambda c, n: (F.col(c) % n).cast("string")
    ips = events.select(F.concat(F.lit("10."), part("user_id", 20), F.lit("."), part("event_id", 70), F.lit("."), part("event_id", 200)).alias("ip"))
    return reports.ip_lookup(ips, _data(spark, sf_dir))


@query(
    _states_sql("SELECT origin_asn, count(*) AS total, count(*) AS ipv4, 0 AS ipv6, count(CASE WHEN state = 'valid' THEN 1 END) AS valid, count(CASE WHEN state = 'invalid' THEN 1 END) AS invalid, count(CASE WHEN state = 'not_found' THEN 1 END) AS unknown, count(CASE WHEN state = 'valid' THEN 1 END) * 100.0 / count(*) AS valid_percent FROM states GROUP BY 1"),
    "pfx2as", "roas",
)
def announced_prefix_summary(spark, sf_dir):
    return reports.announced_summary(reports.labelled_prefixes(_data(spark, sf_dir)))


@query(
    _states_sql("""SELECT origin_asn, prefix, validation, CAST(r AS INTEGER) AS rank, total, total > 4 AS truncated FROM (SELECT origin_asn, prefix, CASE state WHEN 'not_found' THEN 'unknown' ELSE state END AS validation,
  row_number() OVER (PARTITION BY origin_asn ORDER BY CASE state WHEN 'invalid' THEN 0 WHEN 'not_found' THEN 1 ELSE 2 END, prefix) AS r, count(*) OVER (PARTITION BY origin_asn) AS total FROM states) x WHERE r <= 4"""),
    "pfx2as", "roas",
)
def announced_prefix_first(spark, sf_dir):
    return reports.announced_first(reports.labelled_prefixes(_data(spark, sf_dir)), 4)


@query("SELECT a.asn, count(r.prefix) AS roas, count(r.prefix) AS ipv4, 0 AS ipv6 FROM asinfo_core a LEFT JOIN roas r ON r.origin_asn = a.asn GROUP BY 1", "asinfo_core", "roas")
def roa_summary_by_asn(spark, sf_dir):
    return reports.roa_summary(view(spark, sf_dir, "roas"), view(spark, sf_dir, "asinfo_core"))


@query(
    f""", {_NAMES}, {_STATES}, hit AS (SELECT q.query, p.prefix AS matched_prefix, p.origin_asn, CASE WHEN max(CASE WHEN p.prefix = q.query THEN 1 ELSE 0 END) OVER (PARTITION BY q.query) = 1 THEN 'exact' ELSE 'longest' END AS match_type, rank() OVER (PARTITION BY q.query ORDER BY p.len DESC) AS r FROM {_keyed(_ROA_PREFIXES, 'query')} q JOIN {_keyed('pfx2as')} p ON {_CONTAINS.format(a='q', b='p')}),
cover AS (SELECT q.query, count(*) AS n FROM {_keyed(_ROA_PREFIXES, 'query')} q JOIN {_keyed('roas')} r ON q.num // CAST(pow(2, 32 - r.len) AS BIGINT) = r.num // CAST(pow(2, 32 - r.len) AS BIGINT) GROUP BY 1)
SELECT h.query, h.matched_prefix, h.origin_asn, h.match_type, s.state, cover.n AS covering_roas, names.as_name, c.country FROM hit h JOIN states s ON s.prefix = h.matched_prefix AND s.origin_asn = h.origin_asn JOIN cover ON cover.query = h.query LEFT JOIN names ON names.asn = h.origin_asn LEFT JOIN asinfo_core c ON c.asn = h.origin_asn WHERE h.r = 1""",
    "pfx2as", "roas", *_NAME_VIEWS,
)
def inspect_prefix(spark, sf_dir):
    return reports.inspect_prefixes(view(spark, sf_dir, "roas").select(F.col("prefix").alias("query")), _data(spark, sf_dir))


@query(
    f""", {_SIDES}, {_NAMES}, {_STATES}, conn AS (SELECT asn1, count(CASE WHEN rel = -1 THEN 1 END) AS upstreams, count(CASE WHEN rel = 0 THEN 1 END) AS peers, count(CASE WHEN rel = 1 THEN 1 END) AS downstreams FROM sides GROUP BY 1),
pro AS (SELECT customer_asn, string_agg(CAST(provider_asn AS STRING), ',' ORDER BY provider_asn) AS providers FROM aspas GROUP BY 1)
SELECT c.asn, names.as_name, c.country, coalesce(conn.upstreams, 0) AS upstreams, coalesce(conn.peers, 0) AS peers, coalesce(conn.downstreams, 0) AS downstreams, (SELECT count(*) FROM roas WHERE origin_asn = c.asn) AS roas, coalesce(pro.providers, '') AS providers,
 (SELECT count(*) FROM states WHERE origin_asn = c.asn) AS announced, (SELECT count(*) FROM states WHERE origin_asn = c.asn AND state = 'valid') AS valid
FROM asinfo_core c LEFT JOIN names ON names.asn = c.asn LEFT JOIN conn ON conn.asn1 = c.asn LEFT JOIN pro ON pro.customer_asn = c.asn""",
    "asinfo_core", "asinfo_as2org", "asinfo_peeringdb", "as2rel", "roas", "aspas", "pfx2as",
)
def inspect_asn(spark, sf_dir):
    rows = reports.inspect_asns(view(spark, sf_dir, "asinfo_core"), _data(spark, sf_dir))
    kind = lambda k: F.coalesce(F.try_element_at("neighbours", F.lit(k)), F.lit(0))
    return rows.select(
        "asn", "as_name", "country", kind("upstream").alias("upstreams"), kind("peer").alias("peers"), kind("downstream").alias("downstreams"), F.col("roas.roas").alias("roas"), F.coalesce(_text("provider_asns"), F.lit("")).alias("providers"),
        F.coalesce("announced.total", F.lit(0)).alias("announced"), F.coalesce("announced.valid", F.lit(0)).alias("valid"),
    )


@query(
    "SELECT input, asn, name, country, CAST(r AS INTEGER) AS rank, total, total > 5 AS truncated FROM (SELECT i.input, c.asn, c.name, c.country, row_number() OVER (PARTITION BY i.input ORDER BY c.asn) AS r, count(*) OVER (PARTITION BY i.input) AS total FROM asinfo_core c LEFT JOIN asinfo_as2org o USING (asn) LEFT JOIN asinfo_peeringdb p USING (asn) JOIN (SELECT DISTINCT lower(c_mktsegment) AS input FROM customer) i ON contains(lower(concat_ws(chr(10), c.name, o.name, o.org_name, p.name, p.name_long)), i.input)) x WHERE r <= 5",
    *_NAME_VIEWS,
)
def inspect_name(spark, sf_dir):
    inputs = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.lower("c_mktsegment").alias("input"))
    return reports.inspect_names(inputs, _data(spark, sf_dir), 5)


@query(
    """SELECT input, CASE WHEN k % 4 < 2 THEN 'asn' WHEN k % 4 = 2 THEN 'prefix' ELSE 'name' END AS query_type, CASE WHEN k % 4 < 2 THEN 64500 + k END AS asn, CASE WHEN k % 4 = 2 THEN CASE WHEN k % 3 = 0 THEN input ELSE concat(input, '/32') END END AS query FROM
 (SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN concat('as', CAST(64500 + c_custkey AS STRING)) WHEN 1 THEN CAST(64500 + c_custkey AS STRING) WHEN 2 THEN concat('10.1.', CAST(c_custkey % 200 AS STRING), '.0', CASE WHEN c_custkey % 3 = 0 THEN '/24' ELSE '' END) ELSE c_name END AS input FROM customer) x""",
    "countries",
)
def query_type_detect(spark, sf_dir):
    k = F.col("c_custkey")
    text = F.when(k % 4 == 0, F.concat(F.lit("as"), (k + 64500).cast("string"))).when(k % 4 == 1, (k + 64500).cast("string"))
    text = text.when(k % 4 == 2, F.concat(F.lit("10.1."), (k % 200).cast("string"), F.lit(".0"), F.when(k % 3 == 0, "/24").otherwise(""))).otherwise(F.col("c_name"))
    return reports.typed_inputs(spark.read.parquet(f"{sf_dir}/customer.parquet").select(text.alias("input")))


@query("SELECT a.asn AS asn1, b.asn2, coalesce(r.n > 0, FALSE) AS found FROM asinfo_core a JOIN (SELECT DISTINCT asn1 AS asn2 FROM as2rel) b ON (a.asn + b.asn2) % 7 = 0 LEFT JOIN (SELECT asn1, asn2, count(*) AS n FROM (SELECT asn1, asn2 FROM as2rel UNION ALL SELECT asn2, asn1 FROM as2rel) GROUP BY 1, 2) r ON r.asn1 = a.asn AND r.asn2 = b.asn2", "asinfo_core", "as2rel")
def relation_of_pairs(spark, sf_dir):
    edges = view(spark, sf_dir, "as2rel")
    ends = edges.select(F.col("asn1").alias("asn2")).distinct().withColumn("r", (7 - F.col("asn2") % 7) % 7)
    pairs = view(spark, sf_dir, "asinfo_core").select(F.col("asn").alias("asn1"), (F.col("asn") % 7).alias("r")).join(ends, "r").select("asn1", "asn2")
    return reports.relation(pairs, edges).select("asn1", "asn2", "found")


# --- ingest and streams ---------------------------------------------------------------------------------


@query("SELECT collector, prefix, peer_ip AS next_hop, CAST(origin_asn AS STRING) AS as_path, origin_asn, 'IGP' AS origin, CAST(seq % 100 AS BIGINT) AS med FROM rib_dumps", "rib_dumps")
def text_dump_ingest(spark, sf_dir):
    """The dumps as fixed-width text, a file for each collector and run of 2000 events, read back as routes."""
    rows = view(spark, sf_dir, "rib_dumps").withColumn("line", F.format_string(" *> %-17s%-20s%7d%7s%7d%s i", "prefix", "peer_ip", F.col("seq") % 100, F.lit(""), F.lit(0), F.col("origin_asn").cast("string")))
    header = "    Network          Next Hop            Metric LocPrf Weight Path"
    files = rows.withColumn("bucket", F.floor(F.col("seq") / 2000)).groupBy("collector", "bucket").agg(F.concat(F.lit(header + "\n"), F.array_join(F.collect_list("line"), "\n")).alias("value"))
    folder = scratch(spark, "dumps")
    files.select("collector", "bucket", "value").write.partitionBy("collector", "bucket").text(folder)
    found = ingest.read_text_dump(spark, f"{folder}/*/*/*.txt")
    return found.select(F.regexp_extract("file", "collector=([^/]+)/", 1).alias("collector"), "prefix", "next_hop", "as_path", F.get("origin_asns", F.lit(0)).alias("origin_asn"), "origin", "med")


@query(f"SELECT {ELEM_SQL} FROM bgp_elems WHERE elem_type = 'A' AND peer_asn IN (64500, 64502, 64504)", "bgp_elems")
def search_stream(spark, sf_dir):
    """A search over a stream of element files; its batches together are the search over all of them."""
    folder = scratch(spark, "stream")
    rows = elems(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    rows.repartition(4, "seq").write.parquet(f"{folder}/in")
    stream = streams.element_stream(spark, f"{folder}/in", rows.schema, 2)
    wanted = RouteFilters(elem_type="A", peer_asns=["64500", "64502", "64504"])
    streams.search_stream(stream, wanted, lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}"), f"{folder}/marks").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/out/*").select(*ELEM)


@query(f"SELECT {ELEM_SQL} FROM bgp_elems WHERE elem_type = 'A' AND peer_asn IN (64500, 64502, 64504) ORDER BY seq LIMIT 150", "bgp_elems")
def search_stream_capped(spark, sf_dir):
    """A search over a stream that ends once 150 elements are found, in the middle of a batch; later files are not read."""
    folder = scratch(spark, "capped")
    rows = elems(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    for part in ("seq < 300", "seq >= 300 AND seq < 600", "seq >= 600"):
        rows.where(part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = streams.element_stream(spark, f"{folder}/in", rows.schema, 1)
    wanted = RouteFilters(elem_type="A", peer_asns=["64500", "64502", "64504"])
    streams.search_stream(stream, wanted, lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}"), f"{folder}/marks", most=150).awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/out/*").select(*ELEM)


@query(_last_sql() + f" SELECT {_ROUTE}, origin_asn FROM last WHERE r = 1 AND elem_type = 'A'", "rib_dumps", "bgp_elems")
def rib_stream(spark, sf_dir):
    """Updates as a stream onto a dump: the table after the last batch is that of the replay."""
    folder = scratch(spark, "state")
    columns = ["collector", "peer_ip", "peer_asn", "prefix", "seq", "origin_asns"]
    base = dumps(spark, sf_dir).where(F.col("dump_ts") == _ntz(BASE_TS)).groupBy(*columns[:4]).agg(F.max_by(F.struct("seq", "origin_asns"), "seq").alias("l")).select(*columns[:4], F.lit(-1).cast("bigint").alias("seq"), "l.origin_asns")
    updates = elems(spark, sf_dir).where((F.col("ts") > _ntz(BASE_TS)) & (F.col("ts") <= _ntz(LAST_TS))).select(*columns, "elem_type")
    updates.repartitionByRange(4, "seq").write.parquet(f"{folder}/in")
    state = streams.RoutingState(spark, f"{folder}/state", ["origin_asns"])
    state.start(base)
    query = state.follow(streams.element_stream(spark, f"{folder}/in", updates.schema, 2), f"{folder}/marks")
    query.awaitTermination()
    return _routes(state.table()).drop("seq")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The routing table at an instant with the validation state of every route."""
    return rov.validated(rib_snapshot(spark, sf_dir), view(spark, sf_dir, "roas"))
