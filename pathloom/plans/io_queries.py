"""More registered queries: round trips through readers and sinks, whole runs over files, IPv6, scalar functions, lists of reports."""

from __future__ import annotations

import datetime
import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions import scalars
from pathloom.operators import as2rel, asinfo, match, reports, rib, roa_history, rov, search
from pathloom.operators.filters import RouteFilters
from pathloom.operators.running import RunningStatistics
from pathloom.sources import ingest
from pathloom.sources.name_index import NameIndex
from pathloom.sources.snapshots import SnapshotStore
from pathloom.sources.store import ElementStore
from pathloom.sources.views import dumps, elems, view

from . import runs
from .registry import _CONTAINS, _EVENTS, _INSTANTS, _NAME_VIEWS, _NAMES, _ROUTE, _SIDES, BASE_TS, ELEM, ELEM_SQL, INSTANTS, LAST_TS, _catalog, _data, _keyed, _names, _ntz, _routes, _states_sql, query, same_rows_as
from .scratch import scratch

# --- elements and sinks ------------------------------------------------------------------------------

_READ = "seq, collector, elem_type, peer_ip, peer_asn, prefix, as_path, origin_asn, community"


def _full(rows: DataFrame) -> DataFrame:
    """Elements with every column of ELEM_SCHEMA, seq as med."""
    have = {"timestamp": F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000, "med": F.col("seq")}
    fields = [f.strip().rsplit(" ", 1) if "<" not in f else f.strip().split(" ", 1) for f in re.split(r",(?![^<]*>)", ingest.ELEM_SCHEMA)]
    return rows.select(*[(have[n] if n in have else F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])


def _read_back(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("med").alias("seq"), "collector", "elem_type", "peer_ip", "peer_asn", "prefix", "as_path", F.get("origin_asns", F.lit(0)).alias("origin_asn"), F.get("communities", F.lit(0)).alias("community"))


@query(f"SELECT {_READ} FROM bgp_elems", "bgp_elems")
def element_scan_parquet(spark, sf_dir):
    folder = scratch(spark, "elems")
    _full(elems(spark, sf_dir)).write.parquet(folder)
    return _read_back(ingest.read_elems(spark, [folder]))


@query(f"SELECT {_READ} FROM bgp_elems", "bgp_elems")
def element_scan_psv(spark, sf_dir):
    folder = scratch(spark, "psv")
    rows = _full(elems(spark, sf_dir)).withColumns({c: F.array_join(F.col(c).cast("array<string>"), " ") for c in ("origin_asns", "communities")})
    ingest.write_rows(rows, folder)
    return _read_back(ingest.read_elems(spark, [folder], "psv"))


@query(f"SELECT {_READ} FROM bgp_elems", "bgp_elems")
def element_scan_json(spark, sf_dir):
    folder = scratch(spark, "json")
    ingest.write_rows(_full(elems(spark, sf_dir)), folder, "json")
    return _read_back(ingest.read_elems(spark, [folder], "json"))


@query("SELECT collector, day(ts) AS day, count(*) AS n, count(DISTINCT prefix) AS prefixes, count(origin_asn) AS origins FROM bgp_elems GROUP BY 1, 2", "bgp_elems")
def element_store(spark, sf_dir):
    folder = scratch(spark, "store")
    ingest.write_elems(elems(spark, sf_dir), folder)
    return spark.read.parquet(folder).groupBy("collector", F.dayofmonth("day").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("prefix").alias("prefixes"), F.count(F.get("origin_asns", F.lit(0))).alias("origins"))


def _events(spark, sf_dir):
    base = dumps(spark, sf_dir).where(F.col("dump_ts") == _ntz(BASE_TS)).withColumn("ts", F.col("dump_ts"))
    updates = elems(spark, sf_dir).where((F.col("ts") > _ntz(BASE_TS)) & (F.col("ts") <= _ntz(LAST_TS)))
    columns = ["seq", "ts", "collector", "peer_ip", "peer_asn", "prefix", "origin_asns"]
    return rib.events_of(base.select(*columns), updates.select(*columns, "elem_type"))


_TABLES = f", {_EVENTS.format(last=LAST_TS)}, x AS (SELECT i.rib_ts, ev.*, row_number() OVER (PARTITION BY i.rib_ts, {_ROUTE} ORDER BY phase DESC, seq DESC) AS r FROM ev JOIN {_INSTANTS} ON ev.ts <= CAST(i.rib_ts AS TIMESTAMP)) SELECT rib_ts, {_ROUTE}, origin_asn FROM x WHERE r = 1 AND elem_type = 'A'"


@query(_TABLES, "rib_dumps", "bgp_elems")
def snapshot_sink(spark, sf_dir):
    folder = scratch(spark, "snapshots")
    at = [_ntz(i) for i in INSTANTS]
    events = _events(spark, sf_dir)
    ingest.write_snapshot(folder, rib.snapshots(events, ["origin_asns"], at), rib.update_log(events, at))
    return _routes(spark.read.parquet(f"{folder}/ribs")).withColumn("rib_ts", F.date_format("rib_ts", "yyyy-MM-dd HH:mm:ss"))


@query(f", {_EVENTS.format(last=LAST_TS)}, x AS (SELECT *, row_number() OVER (PARTITION BY {_ROUTE} ORDER BY seq DESC) AS r FROM ev WHERE phase = 0) SELECT {_ROUTE}, origin_asn FROM x WHERE r = 1", "rib_dumps", "bgp_elems")
def rib_at_the_dump(spark, sf_dir):
    return _routes(rib.snapshot(_events(spark, sf_dir).where(F.col("ts") <= _ntz(BASE_TS)), ["origin_asns"]))


@query("SELECT least(count(*), 50) AS n FROM bgp_elems", "bgp_elems")
def scan_limit(spark, sf_dir):
    return ingest.first_rows(elems(spark, sf_dir), 50).agg(F.count(F.lit(1)).alias("n"))


# --- filters ------------------------------------------------------------------------------------------


@query(f"SELECT {ELEM_SQL} FROM bgp_elems WHERE peer_asn IN (64501, 64502, 64503) AND elem_type = 'A' AND origin_asn NOT IN (64700)", "bgp_elems")
def filter_file_merged(spark, sf_dir):
    file = RouteFilters.from_json('{"peer_asns": ["64502", "64503"], "elem_type": "w", "origin_asns": ["!64700"]}')
    return RouteFilters(peer_asns=["64501", "64502"], elem_type="a").merged(file).apply(elems(spark, sf_dir)).select(*ELEM)


@query("SELECT seq, collector, prefix FROM rib_dumps WHERE origin_asn IN (64700, 64705)", "rib_dumps")
def dump_search_ignores_time(spark, sf_dir):
    rows = dumps(spark, sf_dir).withColumn("ts", F.col("dump_ts"))
    return RouteFilters(origin_asns=["64700", "64705"], start_ts="2030-01-01").apply(rows, "rib").select("seq", "collector", "prefix")


@query(f"SELECT e.seq, e.prefix FROM bgp_elems e WHERE EXISTS (SELECT 1 FROM {_keyed('pfx2as')} p, {_keyed('(SELECT DISTINCT prefix FROM bgp_elems)')} q WHERE q.prefix = e.prefix AND p.origin_asn % 4 = 0 AND {_CONTAINS.format(a='q', b='p')})", "bgp_elems", "pfx2as")
def prefix_list_filter(spark, sf_dir):
    """A list of prefixes as a text file with comments; elements at or below any of them."""
    folder = scratch(spark, "list")
    wanted = view(spark, sf_dir, "pfx2as").where("origin_asn % 4 = 0").select(F.concat(F.lit("  "), "prefix", F.lit(" # AS"), F.col("origin_asn").cast("string")).alias("value"))
    wanted.union(spark.range(1).select(F.lit("# a comment").alias("value"))).write.text(folder)
    listed = ingest.read_prefix_list(spark, folder)
    return match.filter_prefixes(elems(spark, sf_dir), listed, include_sub=True).select("seq", "prefix")


# --- datasets -------------------------------------------------------------------------------------------


def _json_lines(rows: DataFrame, folder: str) -> str:
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.text(folder)
    return folder


@query("SELECT c.asn, c.name, c.country, o.org_id, p.name_long, u.user_count FROM asinfo_core c LEFT JOIN asinfo_as2org o USING (asn) LEFT JOIN asinfo_peeringdb p USING (asn) LEFT JOIN asinfo_population u USING (asn)", *_NAME_VIEWS, "asinfo_population")
def asinfo_ingest(spark, sf_dir):
    parts = {n: view(spark, sf_dir, f"asinfo_{n}") for n in asinfo.PARTS}
    records = asinfo.full_records(view(spark, sf_dir, "asinfo_core"), **parts)
    folder = _json_lines(records, scratch(spark, "asinfo"))
    spark.range(1).select(F.lit("no record").alias("value")).write.mode("append").text(folder)
    tables = ingest.read_asinfo(spark, folder)
    rows = asinfo.full_records(tables["core"], **{n: tables[n] for n in asinfo.PARTS})
    return rows.selectExpr("asn", "name", "country", "as2org.org_id AS org_id", "peeringdb.name_long AS name_long", "population.user_count AS user_count")


@query("SELECT asn1, asn2, rel, paths_count, peers_count FROM as2rel", "as2rel")
def as2rel_ingest_lines(spark, sf_dir):
    return ingest.read_as2rel(spark, _json_lines(view(spark, sf_dir, "as2rel"), scratch(spark, "as2rel")))


@query("SELECT asn1, asn2, rel, paths_count, peers_count FROM as2rel", "as2rel")
def as2rel_ingest_array(spark, sf_dir):
    """The same as JSON arrays over several lines, one for each asn1."""
    folder = scratch(spark, "as2rel")
    record = F.to_json(F.struct("asn1", "asn2", "rel", "paths_count", "peers_count"))
    rows = view(spark, sf_dir, "as2rel").groupBy(F.col("asn1").alias("part")).agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list(record), ",\n"), F.lit("\n]")).alias("value"))
    rows.write.partitionBy("part").text(folder)
    return ingest.read_as2rel(spark, f"{folder}/*")


@query(_states_sql("SELECT prefix, origin_asn, CASE state WHEN 'not_found' THEN 'unknown' ELSE state END AS validation FROM states"), "pfx2as", "roas")
def pfx2as_ingest_validated(spark, sf_dir):
    rows = view(spark, sf_dir, "pfx2as")
    extra = rows.limit(1).select(F.explode(F.array(F.lit("0.0.0.0/0"), F.lit("::/0"), F.lit("no prefix"))).alias("prefix"), "origin_asn")
    table = ingest.read_pfx2as(spark, _json_lines(rows.union(extra), scratch(spark, "pfx2as")))
    roas = ingest.read_roas(spark, _json_lines(view(spark, sf_dir, "roas"), scratch(spark, "roas")))
    return ingest.with_validation(table, roas).select("prefix", "origin_asn", "validation")


@query("SELECT count(*) AS records, count(DISTINCT prefix) AS prefixes FROM pfx2as", "pfx2as")
def pfx2as_store(spark, sf_dir):
    rows = view(spark, sf_dir, "pfx2as")
    counts = ingest.store_pfx2as(rows.union(rows.limit(20)), scratch(spark, "store"))
    return spark.createDataFrame([(counts["records"], counts["prefixes"])], "records long, prefixes long")


@query("SELECT customer_asn, provider_asn FROM aspas", "aspas")
def aspa_ingest(spark, sf_dir):
    rows = view(spark, sf_dir, "aspas").groupBy("customer_asn").agg(F.collect_list("provider_asn").alias("provider_asns"))
    folder = scratch(spark, "aspas")
    ingest.write_table(ingest.read_aspas(spark, _json_lines(rows, scratch(spark, "aspas"))), folder)
    return spark.read.parquet(folder)


@query("SELECT 'day' AS kind, prefix, origin_asn FROM dated_roas WHERE date = '2024-01-05' AND source = 'rpkispools' AND collector = 'sobornost' UNION ALL SELECT 'latest', prefix, origin_asn FROM dated_roas WHERE source = 'ripe' AND date = (SELECT max(date) FROM dated_roas WHERE source = 'ripe')", "dated_roas")
def roa_snapshots(spark, sf_dir):
    roas = view(spark, sf_dir, "dated_roas")
    day, latest = ingest.roa_snapshot(roas, "2024-01-05"), ingest.roa_snapshot(roas, source="RIPE")
    return day.select(F.lit("day").alias("kind"), "prefix", "origin_asn").union(latest.select(F.lit("latest").alias("kind"), "prefix", "origin_asn"))


@query("SELECT kind, prefix, origin_asn FROM (SELECT DISTINCT 'day' AS kind, prefix, max_length, origin_asn FROM dated_roas WHERE date = '2024-01-06' AND source = 'rpkispools' AND collector = 'sobornost' UNION ALL SELECT DISTINCT 'latest', prefix, max_length, origin_asn FROM dated_roas WHERE source = 'ripe' AND date = (SELECT max(date) FROM dated_roas WHERE source = 'ripe')) x", "dated_roas")
def roa_snapshots_intervals(spark, sf_dir):
    """The ROAs of a day and of the newest day, from intervals of validity."""
    held = roa_history.intervals(view(spark, sf_dir, "dated_roas"))
    day = roa_history.at_day(held, "2024-01-06").where("source = 'rpkispools' AND collector = 'sobornost'")
    return day.select(F.lit("day").alias("kind"), "prefix", "origin_asn").union(held.where("source = 'ripe' AND until IS NULL").select(F.lit("latest").alias("kind"), "prefix", "origin_asn"))


_RIPE = "(SELECT DISTINCT prefix, max_length, origin_asn, date FROM dated_roas WHERE source = 'ripe')"
_OWN_DAY = f"(SELECT e.*, (SELECT max(d.date) FROM {_RIPE} d WHERE d.date <= e.day) AS roa_day FROM (SELECT DISTINCT prefix, origin_asn, strftime(ts, '%Y-%m-%d') AS day FROM bgp_elems WHERE elem_type = 'A') e)"


@query(
    f"SELECT a.prefix, a.origin_asn, a.day, CASE WHEN bool_or(r.origin_asn = a.origin_asn AND a.len <= r.max_length) THEN 'valid' WHEN count(r.origin_asn) > 0 THEN 'invalid' ELSE 'not_found' END AS state FROM {_keyed(_OWN_DAY)} a LEFT JOIN {_keyed(_RIPE)} r ON r.date = a.roa_day AND {_CONTAINS.format(a='a', b='r')} GROUP BY 1, 2, 3",
    "dated_roas", "bgp_elems",
)
def rov_at_own_day(spark, sf_dir):
    """Announcements validated against the ROAs of their own day."""
    pairs = view(spark, sf_dir, "bgp_elems").where("elem_type = 'A'").select("prefix", "origin_asn", F.date_format("ts", "yyyy-MM-dd").alias("day")).distinct()
    held = roa_history.intervals(view(spark, sf_dir, "dated_roas")).where("source = 'ripe'")
    return roa_history.validated_at(pairs, held)


@query("SELECT asn, name, country FROM asinfo_core WHERE asn IN (SELECT asn2 FROM as2rel)", "asinfo_core", "as2rel")
def asinfo_records_of(spark, sf_dir):
    return asinfo.records_of(view(spark, sf_dir, "asinfo_core"), view(spark, sf_dir, "as2rel").select(F.col("asn2").alias("asn")))


@query("SELECT lower(name) AS input, code, 'resolved' AS state FROM countries UNION ALL SELECT lower(code), code, 'resolved' FROM countries UNION ALL SELECT concat(code, '-', name), NULL, 'unknown' FROM countries", "countries")
def country_resolution(spark, sf_dir):
    table = view(spark, sf_dir, "countries")
    inputs = table.select(F.explode(F.array(F.lower("name"), F.lower("code"), F.concat("code", F.lit("-"), "name"))).alias("input"))
    return asinfo.resolve_countries(inputs, table)


# --- scalar functions -------------------------------------------------------------------------------------


@query("SELECT event_id, concat(strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S'), '+00:00') AS rfc3339, epoch(date_trunc('second', ts)) AS seconds, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, concat(substr(event_type, 1, 2), CASE WHEN length(event_type) > 5 THEN '...' ELSE substr(event_type, 3) END) AS short FROM events")
def time_and_name_scalars(spark, sf_dir):
    """Times as date text and Unix seconds there and back; names cut to five characters."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = F.date_format(F.date_trunc("second", "ts"), "yyyy-MM-dd HH:mm:ss")
    parsed = scalars.parse_time(text)
    again = scalars.parse_time(scalars.unix_seconds(parsed).cast("decimal(20,3)").cast("string"))
    named = scalars.time_of_path(F.concat(F.lit("/files/dump-"), F.date_format("ts", "yyyy-MM-dd"), F.lit("-0000.txt")))
    return rows.select("event_id", scalars.rfc3339(again).alias("rfc3339"), scalars.unix_seconds(parsed).alias("seconds"), F.date_format(named, "yyyy-MM-dd").alias("day"), scalars.truncated_name(F.col("event_type"), 5).alias("short"))


@query("SELECT seq, as_path, CAST(split_part(as_path, ' ', 1) AS BIGINT) + CAST(split_part(as_path, ' ', 2) AS BIGINT) + CAST(split_part(as_path, ' ', 3) AS BIGINT) AS total, origin_asn AS origin FROM bgp_elems WHERE elem_type = 'A'", "bgp_elems")
def as_path_scalars(spark, sf_dir):
    """Paths as numbers and as text again; their origins."""
    rows = view(spark, sf_dir, "bgp_elems").where("elem_type = 'A'")
    asns = scalars.text_asns(F.concat("as_path", F.lit(" { }")))
    return rows.select("seq", scalars.asns_text(asns).alias("as_path"), F.aggregate(asns, F.lit(0).cast("long"), lambda a, b: a + b).alias("total"), scalars.path_origin(F.col("as_path")).alias("origin"))


# --- IPv6 ---------------------------------------------------------------------------------------------------


def _v6(table: str, column: str = "prefix") -> str:
    """DuckDB: rows of a view with the second and third group and the length of their prefix, 2001:a::/32 or 2001:a:b::/48."""
    return f"(SELECT *, split_part({column}, ':', 2) AS a, split_part({column}, ':', 3) AS b, CAST(split_part({column}, '/', 2) AS INTEGER) AS len FROM {table})"


_IN_V6 = "({x}.a = {y}.a AND {x}.len >= {y}.len AND ({y}.len = 32 OR {x}.b = {y}.b))"


@query(f"SELECT query, matched_prefix, origin_asn FROM (SELECT q.query, p.prefix AS matched_prefix, p.origin_asn, rank() OVER (PARTITION BY q.query ORDER BY p.len DESC) AS r FROM {_v6('(SELECT DISTINCT prefix AS query FROM elems_v6)', 'query')} q JOIN {_v6('pfx2as_v6')} p ON {_IN_V6.format(x='q', y='p')}) x WHERE r = 1", "elems_v6", "pfx2as_v6")
def pfx2as_v6_longest(spark, sf_dir):
    return match.longest(view(spark, sf_dir, "elems_v6").select(F.col("prefix").alias("query")).distinct(), view(spark, sf_dir, "pfx2as_v6"))


@query(f"SELECT q.query, p.prefix AS matched_prefix, p.origin_asn FROM {_v6('(SELECT DISTINCT prefix AS query FROM roas_v6)', 'query')} q JOIN {_v6('pfx2as_v6')} p ON {_IN_V6.format(x='p', y='q')}", "roas_v6", "pfx2as_v6")
def pfx2as_v6_covered(spark, sf_dir):
    return match.covered(view(spark, sf_dir, "roas_v6").select(F.col("prefix").alias("query")).distinct(), view(spark, sf_dir, "pfx2as_v6"))


@query(f"SELECT p.prefix, p.origin_asn, CASE WHEN bool_or(r.origin_asn = p.origin_asn AND p.len <= r.max_length) THEN 'valid' WHEN count(r.origin_asn) > 0 THEN 'invalid' ELSE 'not_found' END AS state FROM {_v6('pfx2as_v6')} p LEFT JOIN {_v6('roas_v6')} r ON {_IN_V6.format(x='p', y='r')} GROUP BY 1, 2", "pfx2as_v6", "roas_v6")
def rov_v6_state(spark, sf_dir):
    return rov.validated(view(spark, sf_dir, "pfx2as_v6"), view(spark, sf_dir, "roas_v6"))


@query("SELECT seq, prefix FROM elems_v6 WHERE split_part(prefix, ':', 2) IN ('103', '107') OR prefix = '2001:105:20::/48'", "elems_v6")
def prefix_filter_v6_sub(spark, sf_dir):
    wanted = RouteFilters(prefixes=["2001:103::/32", "2001:107::/32", "2001:105:20::/48", "10.0.0.0/8"], include_sub=True)
    return wanted.apply_prefixes(view(spark, sf_dir, "elems_v6")).select("seq", "prefix")


@query("SELECT origin_asn, count(*) AS total, count(CASE WHEN contains(prefix, ':') THEN 1 END) AS ipv6, count(CASE WHEN NOT contains(prefix, ':') THEN 1 END) AS ipv4 FROM (SELECT * FROM pfx2as UNION ALL SELECT * FROM pfx2as_v6) x GROUP BY 1", "pfx2as", "pfx2as_v6")
def announced_both_families(spark, sf_dir):
    rows = view(spark, sf_dir, "pfx2as").union(view(spark, sf_dir, "pfx2as_v6")).withColumn("validation", F.lit("unknown"))
    return reports.announced_summary(rows).select("origin_asn", "total", "ipv6", "ipv4")


# --- lists of reports -----------------------------------------------------------------------------------------


@query("SELECT * FROM (SELECT origin_asn, prefix, max_length, ta, CAST(row_number() OVER (PARTITION BY origin_asn ORDER BY prefix, max_length, ta) AS INTEGER) AS rank, count(*) OVER (PARTITION BY origin_asn) AS total, count(*) OVER (PARTITION BY origin_asn) > 3 AS truncated FROM roas WHERE origin_asn IN (SELECT asn FROM asinfo_core)) x WHERE rank <= 3", "roas", "asinfo_core")
def roa_first_of_asn(spark, sf_dir):
    return reports.roa_first(view(spark, sf_dir, "roas"), view(spark, sf_dir, "asinfo_core"), 3).select("origin_asn", "prefix", "max_length", "ta", "rank", "total", "truncated")


@query(
    f"SELECT query, roa_prefix, max_length, origin_asn, ta, CAST(rank AS INTEGER) AS rank, total, total > 2 AS truncated FROM (SELECT q.query, r.prefix AS roa_prefix, r.max_length, r.origin_asn, r.ta, row_number() OVER (PARTITION BY q.query ORDER BY r.len DESC, r.prefix, r.origin_asn, r.max_length, r.ta) AS rank, count(*) OVER (PARTITION BY q.query) AS total FROM {_keyed('(SELECT DISTINCT prefix AS query FROM pfx2as)', 'query')} q JOIN {_keyed('roas')} r ON q.num // CAST(pow(2, 32 - r.len) AS BIGINT) = r.num // CAST(pow(2, 32 - r.len) AS BIGINT)) x WHERE rank <= 2",
    "pfx2as", "roas",
)
def covering_roa_first(spark, sf_dir):
    found = reports.covering_roa_first(view(spark, sf_dir, "pfx2as").select(F.col("prefix").alias("query")), view(spark, sf_dir, "roas"), 2)
    return found.select("query", "roa_prefix", "max_length", "origin_asn", "ta", "rank", "total", "truncated")


@query("SELECT input, code, asn, name, CAST(r AS INTEGER) AS rank, total, total > 3 AS truncated FROM (SELECT lower(k.name) AS input, k.code, c.asn, c.name, row_number() OVER (PARTITION BY k.code ORDER BY c.asn) AS r, count(*) OVER (PARTITION BY k.code) AS total FROM countries k JOIN asinfo_core c ON c.country = k.code) x WHERE r <= 3", "countries", "asinfo_core")
def inspect_country(spark, sf_dir):
    table = view(spark, sf_dir, "countries")
    return reports.inspect(table.select(F.lower("name").alias("input")), _data(spark, sf_dir), 3, "country", countries=table)["country"]


@query(f", {_NAMES} SELECT a.customer_asn AS asn, max(n.as_name) AS as_name, count(*) AS providers, count(m.as_name) AS named FROM aspas a LEFT JOIN names n ON n.asn = a.customer_asn LEFT JOIN names m ON m.asn = a.provider_asn GROUP BY 1", "aspas", *_NAME_VIEWS)
def inspect_asn_providers(spark, sf_dir):
    asns = view(spark, sf_dir, "aspas").select(F.col("customer_asn").alias("asn"))
    found = reports.inspect_asns(asns, _data(spark, sf_dir), sections=("providers",))
    return found.select("asn", "as_name", F.size("providers").cast("long").alias("providers"), F.size(F.filter("providers", lambda p: p["provider_name"].isNotNull())).cast("long").alias("named"))


@query(
    f""", {_NAMES}, {_SIDES}, k AS (SELECT asn1 AS asn, CASE rel WHEN -1 THEN 'upstream' WHEN 0 THEN 'peer' ELSE 'downstream' END AS kind, asn2 AS neighbour, peers_count FROM sides),
 r AS (SELECT *, row_number() OVER (PARTITION BY asn, kind ORDER BY peers_count DESC, neighbour) AS n FROM k)
 SELECT r.asn, r.kind, r.neighbour, names.as_name AS neighbour_name, CAST(r.n AS INTEGER) AS rank FROM r LEFT JOIN names ON names.asn = r.neighbour WHERE r.n <= 2""",
    "as2rel", *_NAME_VIEWS,
)
def inspect_asn_neighbours(spark, sf_dir):
    asns = view(spark, sf_dir, "as2rel").select(F.explode(F.array("asn1", "asn2")).alias("asn"))
    found = reports.inspect_asns(asns, _data(spark, sf_dir), 2, ("connectivity",)).select("asn", F.explode("top_neighbours").alias("t"))
    return found.select("asn", "t.kind", "t.neighbour", "t.neighbour_name", "t.rank")


@query("SELECT CAST(origin_asn AS STRING) AS query, prefix AS matched_prefix, origin_asn, 'asn' AS match_type FROM pfx2as WHERE origin_asn IN (64701, 64709) UNION ALL SELECT p.prefix, p.prefix, p.origin_asn, 'exact' FROM pfx2as p JOIN (SELECT DISTINCT prefix FROM roas) r ON r.prefix = p.prefix", "pfx2as", "roas")
def prefix_search_modes(spark, sf_dir):
    asked = view(spark, sf_dir, "roas").select(F.col("prefix").alias("query")).union(spark.createDataFrame([("64701",), ("64709",)], "query string"))
    return reports.prefix_search(asked, _data(spark, sf_dir), mode="exact").select("query", "matched_prefix", "origin_asn", "match_type")


_SHARES = "coalesce(max(CASE WHEN rel = 0 THEN peers_count END), 0) * 100.0 / (SELECT max(peers_count) FROM as2rel)"


@query(
    f", {_SIDES}, {_NAMES}, a AS (SELECT asn1, asn2, {_SHARES} AS pct, CAST(coalesce(sum(CASE WHEN rel = -1 THEN peers_count END), 0) AS BIGINT) AS as2_upstream FROM sides WHERE asn1 = 64700 GROUP BY 1, 2) SELECT a.asn1, a.asn2, names.as_name AS asn2_name, as2_upstream, printf('%.1f%%', floor(pct * 10 + 0.5) / 10) AS connected_text FROM a LEFT JOIN names ON names.asn = a.asn2 WHERE as2_upstream > 0 AND pct >= 20",
    "as2rel", *_NAME_VIEWS,
)
def as2rel_search(spark, sf_dir):
    found = as2rel.search(view(spark, sf_dir, "as2rel"), [64700], _names(spark, sf_dir), "upstream", 20.0, texts=True)
    return found.select("asn1", "asn2", "asn2_name", "as2_upstream", "connected_text")


_FOUND = "asn1, asn2, as_name AS asn2_name, connected, as1_upstream, as2_upstream"
_COUNTED = "SELECT asn1, asn2, coalesce(max(CASE WHEN rel = 0 THEN peers_count END), 0) AS connected, CAST(coalesce(sum(CASE WHEN rel = 1 THEN peers_count END), 0) AS BIGINT) AS as1_upstream, CAST(coalesce(sum(CASE WHEN rel = -1 THEN peers_count END), 0) AS BIGINT) AS as2_upstream FROM sides"


@query(f", {_SIDES}, {_NAMES}, a AS ({_COUNTED} WHERE asn1 = 64700 AND asn2 = 64600 GROUP BY 1, 2) SELECT {_FOUND} FROM a LEFT JOIN names ON asn = asn2", "as2rel", *_NAME_VIEWS)
def as2rel_search_pair(spark, sf_dir):
    """The search's branch for two ASes, with names."""
    return as2rel.search(view(spark, sf_dir, "as2rel"), [64700, 64600], _names(spark, sf_dir)).select("asn1", "asn2", "asn2_name", "connected", "as1_upstream", "as2_upstream")


@query(f", {_SIDES}, {_NAMES}, a AS ({_COUNTED} WHERE asn1 < asn2 AND asn1 IN (64600, 64601, 64605, 64702, 64704) AND asn2 IN (64600, 64601, 64605, 64702, 64704) GROUP BY 1, 2), m AS (SELECT max(peers_count) AS most FROM as2rel) SELECT {_FOUND} FROM a LEFT JOIN names ON asn = asn2, m WHERE connected * 100.0 / most >= 15", "as2rel", *_NAME_VIEWS)
def as2rel_search_many(spark, sf_dir):
    """The search's branch for more than two ASes, with names and a bar on visibility."""
    found = as2rel.search(view(spark, sf_dir, "as2rel"), [64600, 64601, 64605, 64702, 64704], _names(spark, sf_dir), min_percent=15.0)
    return found.select("asn1", "asn2", "asn2_name", "connected", "as1_upstream", "as2_upstream")


@query(
    f", u AS (SELECT CASE WHEN rel = -1 THEN asn1 ELSE asn2 END AS customer_asn, CASE WHEN rel = -1 THEN asn2 ELSE asn1 END AS upstream_asn, peers_count FROM as2rel WHERE rel IN (-1, 1)), {_NAMES}, x AS (SELECT customer_asn, max(CASE WHEN upstream_asn = 64600 THEN peers_count END) AS visibility FROM u GROUP BY 1 HAVING count(DISTINCT upstream_asn) = 1 AND max(CASE WHEN upstream_asn = 64600 THEN peers_count END) >= floor(0.1 * (SELECT max(peers_count) FROM as2rel))) SELECT customer_asn, visibility, as_name AS customer_name FROM x LEFT JOIN names ON asn = customer_asn",
    "as2rel", *_NAME_VIEWS,
)
def as2rel_search_sole_upstream(spark, sf_dir):
    """The search's branch for customers of one upstream, with names."""
    return as2rel.search(view(spark, sf_dir, "as2rel"), [64600], _names(spark, sf_dir), min_percent=10.0, sole_upstream=True)


@query(
    """, i AS (SELECT DISTINCT lower(substr(name, 1, n)) AS input FROM countries, (SELECT unnest([1, 2, 4, 6]) AS n) UNION SELECT lower(substr(code, 1, 1)) FROM countries UNION SELECT lower(substr(name, 4)) FROM countries UNION SELECT 'zz'),
 near AS (SELECT i.input, count(c.code) AS hits, count(CASE WHEN lower(c.name) = i.input THEN 1 END) AS names, max(CASE WHEN lower(c.name) = i.input THEN c.code END) AS name_code, max(CASE WHEN lower(c.code) = i.input THEN c.code END) AS own, max(c.code) AS one
   FROM i LEFT JOIN countries c ON contains(lower(c.name), i.input) OR lower(c.code) = i.input GROUP BY 1),
 r AS (SELECT input, hits, CASE WHEN names = 1 THEN name_code WHEN own IS NOT NULL THEN own WHEN hits = 1 THEN one WHEN hits = 0 AND length(input) = 2 THEN upper(input) END AS code FROM near)
 SELECT input, code, CASE WHEN code IS NOT NULL THEN 'resolved' WHEN hits = 0 THEN 'unknown' ELSE 'ambiguous' END AS state FROM r""",
    "countries",
)
def country_resolution_parts(spark, sf_dir):
    """Beginnings of names: several countries have some, one country others, and two letters that nothing knows are a code."""
    table = view(spark, sf_dir, "countries")
    parts = [F.lower(F.substring("name", 1, n)) for n in (1, 2, 4, 6)] + [F.lower(F.substring("code", 1, 1)), F.lower(F.expr("substring(name, 4)")), F.lit("zz")]
    return asinfo.resolve_countries(table.select(F.explode(F.array(*parts)).alias("input")).distinct(), table)


@same_rows_as("inspect_name")
def inspect_forced_name(spark, sf_dir):
    """Inputs that are read as names, whatever they look like."""
    inputs = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.lower("c_mktsegment").alias("input")).distinct()
    return reports.inspect(inputs, _data(spark, sf_dir), 5, "name")["name"]


# --- whole runs over files -----------------------------------------------------------------------------------------


def _files(spark, sf_dir):
    """A catalog of files that the elements and dumps are written to: one for each collector and day, or dump."""
    folder = scratch(spark, "run")
    rows = _full(elems(spark, sf_dir)).withColumn("__c", F.col("collector")).withColumn("day", F.dayofmonth(F.timestamp_seconds("timestamp")))
    base = _full(dumps(spark, sf_dir).withColumn("ts", F.col("dump_ts")).withColumn("elem_type", F.lit("A"))).withColumn("__c", F.col("collector")).withColumn("day", F.dayofmonth(F.timestamp_seconds("timestamp")))
    found = []
    for kind, table in (("updates", rows), ("rib", base)):
        table.repartition("__c", "day").sortWithinPartitions("__c", "day", "med").write.partitionBy("__c", "day").parquet(f"{folder}/{kind}")
        paths = spark.read.parquet(f"{folder}/{kind}").inputFiles()
        found += [(re.search(r"__c=([^/]+)", p)[1], kind, int(re.search(r"day=(\d+)", p)[1]), p) for p in paths]
    days = spark.createDataFrame(found, "collector_id string, data_type string, day int, url string")
    start = F.timestamp_seconds(F.lit(1704067200) + (F.col("day") - 1) * 86400)
    end = F.when(F.col("data_type") == "rib", start).otherwise(F.timestamp_seconds(F.lit(1704067200) + F.col("day") * 86400 - 1))
    return days.select("collector_id", "data_type", "url", start.alias("ts_start"), end.alias("ts_end"), F.lit(1).cast("long").alias("rough_size"), F.lit(0).cast("long").alias("exact_size"))


@query("SELECT seq, collector, prefix FROM bgp_elems WHERE ts >= TIMESTAMP '2024-01-05 06:00:00' AND ts <= TIMESTAMP '2024-01-08 12:00:00' AND elem_type = 'A' AND collector IN ('rrc00', 'rrc02')", "bgp_elems")
def run_search(spark, sf_dir):
    wanted = RouteFilters(start_ts="2024-01-05T06:00:00Z", end_ts="2024-01-08T12:00:00Z", elem_type="a")
    found = runs.search_files(spark, _files(spark, sf_dir), wanted, ["rrc00", "rrc02"])
    return found.elements.select(F.col("med").alias("seq"), "collector", "prefix")

@query("SELECT seq, collector, prefix FROM bgp_elems WHERE ts >= TIMESTAMP '2024-01-05 06:00:00' AND ts <= TIMESTAMP '2024-01-08 12:00:00' AND elem_type = 'A' AND collector IN ('rrc00', 'rrc02')", "bgp_elems")
def run_search_store(spark, sf_dir):
    """The same search in a store, whose partitions the catalog's rows select."""
    catalog = _files(spark, sf_dir).where("data_type = 'updates'")
    store = ElementStore(spark, scratch(spark, "store"))
    store.add(catalog)
    wanted = RouteFilters(start_ts="2024-01-05T06:00:00Z", end_ts="2024-01-08T12:00:00Z", elem_type="a")
    found = runs.search_files(spark, catalog, wanted, ["rrc00", "rrc02"], store=store)
    return found.elements.select(F.col("med").alias("seq"), "collector", "prefix")


@query("SELECT seq, collector, prefix FROM bgp_elems WHERE elem_type = 'A' AND peer_asn IN (64501, 64502) ORDER BY day(ts), collector, seq LIMIT 400", "bgp_elems")
def run_search_first(spark, sf_dir):
    """The first 400 matching elements in the order of files; files behind them are not opened."""
    found = runs.search_first(spark, _files(spark, sf_dir), RouteFilters(elem_type="a", peer_asns=["64501", "64502"]), 400)
    return found.elements.select(F.col("med").alias("seq"), "collector", "prefix")


@query("SELECT 'A' AS type, peer_ip, prefix, as_path FROM bgp_elems WHERE elem_type = 'A' AND peer_asn = 64503", "bgp_elems")
def run_parse(spark, sf_dir):
    paths = [r["url"] for r in _files(spark, sf_dir).where("data_type = 'updates'").collect()]
    return runs.parse_files(spark, paths, RouteFilters(elem_type="a", peer_asns=["64503"]), "type,peer_ip,prefix,as_path", "prefix", True)


# a day later than the dump of the fifth, and three instants behind that of the fifteenth
RUN_AT = ("2024-01-06 00:00:00", *INSTANTS)
_BOTH = """ev AS (SELECT 0 AS phase, seq, collector, peer_ip, peer_asn, prefix, origin_asn, 'A' AS elem_type, dump_ts AS ts, dump_ts FROM rib_dumps
  UNION ALL SELECT 1, seq, collector, peer_ip, peer_asn, prefix, origin_asn, elem_type, ts, CASE WHEN ts > TIMESTAMP '2024-01-15 00:00:00' THEN TIMESTAMP '2024-01-15 00:00:00' ELSE TIMESTAMP '2024-01-05 00:00:00' END FROM bgp_elems WHERE ts > TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00')"""
_AT = "(SELECT CAST(unnest([" + ", ".join(f"'{i}'" for i in RUN_AT) + "]) AS TIMESTAMP) AS rib_ts) i"


@query(
    f", {_BOTH}, x AS (SELECT strftime(i.rib_ts, '%Y-%m-%d %H:%M:%S') AS rib_ts, ev.*, row_number() OVER (PARTITION BY i.rib_ts, {_ROUTE} ORDER BY phase DESC, seq DESC) AS r FROM ev JOIN {_AT} ON ev.ts <= i.rib_ts AND ev.dump_ts = CASE WHEN i.rib_ts >= TIMESTAMP '2024-01-15 00:00:00' THEN TIMESTAMP '2024-01-15 00:00:00' ELSE TIMESTAMP '2024-01-05 00:00:00' END) SELECT rib_ts, {_ROUTE}, origin_asn FROM x WHERE r = 1 AND elem_type = 'A' AND origin_asn IN (64700, 64701, 64702)",
    "rib_dumps", "bgp_elems",
)
def run_routing_tables(spark, sf_dir):
    """Tables at four instants on two dumps of each collector, from files, in one replay."""
    routes, _ = runs.routing_tables(spark, _files(spark, sf_dir), [F.lit(i).cast("timestamp") for i in RUN_AT], RouteFilters(origin_asns=["64700", "64701", "64702"]), ["origin_asns"])
    return _routes(routes).drop("path_id").withColumn("rib_ts", F.date_format("rib_ts", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT count(DISTINCT i.day) AS instants, count(DISTINCT c.collector_id) AS collectors, count(DISTINCT concat(c.collector_id, CAST(CASE WHEN i.day >= 15 THEN 15 ELSE 5 END AS STRING))) AS \"groups\" FROM file_catalog c, (SELECT unnest([6, 14, 15, 20]) AS day) i", "file_catalog")
def run_summary(spark, sf_dir):
    return rib.run_summary(rib.base_dumps(_catalog(spark, sf_dir), [_ntz(f"2024-01-{d:02d}") for d in (6, 14, 15, 20)]))


@query("SELECT collector AS file_collector, count(*) AS matched FROM bgp_elems WHERE elem_type = 'W' GROUP BY 1", "bgp_elems")
def run_files_of_matches(spark, sf_dir):
    """Matches by file of a search over files, summed by collector."""
    found = runs.search_files(spark, _files(spark, sf_dir), RouteFilters(elem_type="w"))
    by_file = search.matching_files(found.elements)
    return by_file.groupBy(F.regexp_extract("file", "__c=([^/]+)/", 1).alias("file_collector")).agg(F.sum("matched").cast("long").alias("matched"))


# --- what is kept from run to run ------------------------------------------------------------------------


@same_rows_as("inspect_name")
def inspect_name_kept(spark, sf_dir):
    """Names searched for in a kept index, which a third of the ASes reached by an update."""
    data, index = _data(spark, sf_dir), NameIndex(spark, scratch(spark, "names"))
    third = data.core.where(F.col("asn") % 3 == 0)
    # until the update these are there with another name
    index.build(data.core.where(F.col("asn") % 3 != 0).unionByName(third.withColumn("name", F.lit("building furniture"))), data.as2org, data.peeringdb)
    index.update(third, data.core, data.as2org, data.peeringdb)
    return reports.inspect_kept_names(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.lower("c_mktsegment").alias("input")), index, 5)


@same_rows_as("search_stats_by_collector")
def search_stats_running(spark, sf_dir):
    """Statistics of a search that grew by three batches, one of which came twice."""
    found = RouteFilters(elem_type="a", as_path_regex=" 6460[0-9] ").apply(elems(spark, sf_dir))
    kept = RunningStatistics(spark, scratch(spark, "statistics"))
    for number in (0, 1, 1, 2):
        kept.add(found.where(F.col("seq") % 3 == number), number)
    return kept.totals()


@same_rows_as("rib_stream")
def rib_from_kept_table(spark, sf_dir):
    """The table at the last instant, replayed from a kept table between the dump and it."""
    seconds = lambda text: int(datetime.datetime.fromisoformat(text).replace(tzinfo=datetime.timezone.utc).timestamp())
    columns = ["collector", "peer_ip", "peer_asn", "prefix"]
    base = dumps(spark, sf_dir).where(F.col("dump_ts") == _ntz(BASE_TS)).groupBy(*columns).agg(F.max_by("origin_asns", "seq").alias("origin_asns"))
    at = F.timestamp_seconds(F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS timestamp_ntz))"))
    updates = elems(spark, sf_dir).where((F.col("ts") > _ntz(BASE_TS)) & (F.col("ts") <= _ntz(LAST_TS))).withColumn("ts", at)
    store = SnapshotStore(spark, f"kept_{uuid.uuid4().hex}", scratch(spark, "kept"), ("origin_asns",), 8)
    store.write(base, seconds(BASE_TS))
    store.extend(updates, (seconds(BASE_TS) + seconds(LAST_TS)) // 2)
    return _routes(store.replayed(updates, seconds(LAST_TS)))
