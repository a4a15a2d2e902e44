"""Routing tables derived from the star-schema test tables, in SQL that Spark and DuckDB share."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS = {
    "bgp_elems": """
SELECT event_id AS seq, concat('rrc', lpad(CAST(user_id % 3 AS STRING), 2, '0')) AS collector, ts,
  CASE WHEN event_type = 'error' THEN 'W' ELSE 'A' END AS elem_type,
  64500 + user_id % 8 AS peer_asn, concat('192.0.2.', CAST(1 + user_id % 8 AS STRING)) AS peer_ip,
  concat('10.', CAST(user_id % 16 AS STRING), '.', CAST((event_id * 7) % 64 AS STRING), '.0/24') AS prefix,
  CASE WHEN event_type = 'error' THEN NULL ELSE concat(CAST(64500 + user_id % 8 AS STRING), ' ', CAST(64600 + event_id % 20 AS STRING), ' ', CAST(64700 + event_id % 23 AS STRING)) END AS as_path,
  CASE WHEN event_type = 'error' THEN NULL ELSE 64700 + event_id % 23 END AS origin_asn,
  CASE WHEN event_type = 'error' THEN NULL ELSE concat(CAST(64500 + user_id % 8 AS STRING), ':', CAST(event_id % 10 * 100 AS STRING)) END AS community
FROM {events}""",
    "rib_dumps": """
SELECT event_id AS seq, concat('rrc', lpad(CAST(user_id % 3 AS STRING), 2, '0')) AS collector,
  CASE WHEN event_id % 8 < 4 THEN TIMESTAMP '2024-01-05 00:00:00' ELSE TIMESTAMP '2024-01-15 00:00:00' END AS dump_ts,
  64500 + user_id % 8 AS peer_asn, concat('192.0.2.', CAST(1 + user_id % 8 AS STRING)) AS peer_ip,
  concat('10.', CAST(user_id % 16 AS STRING), '.', CAST((event_id * 7) % 64 AS STRING), '.0/24') AS prefix,
  64700 + event_id % 23 AS origin_asn
FROM {events} WHERE event_type = 'view'""",
    "file_catalog": """
SELECT concat('rrc', lpad(CAST(user_id % 3 AS STRING), 2, '0')) AS collector_id, 'updates' AS data_type, day(ts) AS day_start, day(ts) + 1 AS day_end,
  concat('updates/', CAST(user_id % 3 AS STRING), '/', CAST(day(ts) AS STRING)) AS url,
  count(*) * 100 AS rough_size, CASE WHEN day(ts) % 3 = 0 THEN 0 ELSE count(*) * 97 END AS exact_size
FROM {events} GROUP BY 1, 2, 3, 4, 5, user_id % 3, day(ts)
UNION ALL
SELECT concat('rrc', lpad(CAST(user_id % 3 AS STRING), 2, '0')), 'rib', CASE WHEN event_id % 8 < 4 THEN 5 ELSE 15 END, CASE WHEN event_id % 8 < 4 THEN 5 ELSE 15 END,
  concat('rib/', CAST(user_id % 3 AS STRING), '/', CASE WHEN event_id % 8 < 4 THEN '5' ELSE '15' END), count(*) * 50, count(*) * 49
FROM {events} WHERE event_type = 'view' GROUP BY 1, 2, 3, 4, 5""",
    "as2rel": """
SELECT 64600 + l_suppkey % 20 AS asn1, 64700 + l_partkey % 23 AS asn2,
  CASE l_returnflag WHEN 'A' THEN -1 WHEN 'N' THEN 0 ELSE 1 END AS rel,
  count(*) AS paths_count, count(DISTINCT l_orderkey) AS peers_count
FROM {lineitem}
WHERE l_returnflag = 'N' OR CASE WHEN l_partkey % 23 < 8 THEN l_suppkey % 20 = l_partkey % 23 % 2
                                 ELSE (l_suppkey % 20 + l_partkey % 23) % 3 = 0 END
GROUP BY 1, 2, 3""",
    "pfx2as": """
SELECT DISTINCT concat('10.', CAST(p_partkey % 16 AS STRING), CASE WHEN p_size % 3 = 0 THEN '.0.0/16' ELSE concat('.', CAST(p_partkey % 64 AS STRING), '.0/24') END) AS prefix,
  64700 + p_partkey % 23 AS origin_asn
FROM {part}""",
    "roas": """
SELECT concat('10.', CAST(s_suppkey % 16 AS STRING), CASE WHEN s_suppkey % 4 = 0 THEN '.0.0/16' ELSE concat('.', CAST(s_suppkey % 64 AS STRING), '.0/24') END) AS prefix,
  CASE WHEN s_suppkey % 4 = 0 THEN 20 ELSE 24 END AS max_length,
  64700 + s_suppkey % 23 AS origin_asn, concat('ta', CAST(s_nationkey % 5 AS STRING)) AS ta
FROM {supplier}""",
    "aspas": """
SELECT DISTINCT 64700 + l_partkey % 23 AS customer_asn, 64600 + l_suppkey % 20 AS provider_asn
FROM {lineitem}""",
    "pfx2as_v6": """
SELECT DISTINCT concat('2001:', CAST(100 + p_partkey % 16 AS STRING), CASE WHEN p_size % 3 = 0 THEN '::/32' ELSE concat(':', CAST(p_partkey % 64 AS STRING), '::/48') END) AS prefix,
  64700 + p_partkey % 23 AS origin_asn
FROM {part}""",
    "roas_v6": """
SELECT concat('2001:', CAST(100 + s_suppkey % 16 AS STRING), CASE WHEN s_suppkey % 4 = 0 THEN '::/32' ELSE concat(':', CAST(s_suppkey % 64 AS STRING), '::/48') END) AS prefix,
  CASE WHEN s_suppkey % 4 = 0 THEN 40 ELSE 48 END AS max_length,
  64700 + s_suppkey % 23 AS origin_asn, concat('ta', CAST(s_nationkey % 5 AS STRING)) AS ta
FROM {supplier}""",
    "elems_v6": """
SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'W' ELSE 'A' END AS elem_type,
  concat('2001:', CAST(100 + user_id % 16 AS STRING), ':', CAST((event_id * 7) % 64 AS STRING), '::/48') AS prefix
FROM {events}""",
    "dated_roas": """
SELECT concat('10.', CAST(s_suppkey % 16 AS STRING), '.', CAST(s_suppkey % 64 AS STRING), '.0/24') AS prefix, 24 AS max_length, 64700 + s_suppkey % 23 AS origin_asn,
  concat('2024-01-0', CAST(1 + s_suppkey % 9 AS STRING)) AS date, CASE s_suppkey % 3 WHEN 0 THEN 'ripe' WHEN 1 THEN 'rpkiviews' ELSE 'rpkispools' END AS source,
  CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'views-1' ELSE 'sobornost' END AS collector
FROM {supplier}""",
    "asinfo_core": """
SELECT 64500 + c_custkey AS asn, c_name AS name, concat('N', CAST(c_nationkey AS STRING)) AS country
FROM {customer}""",
    "asinfo_as2org": """
SELECT 64500 + c_custkey AS asn, concat('as2org-', CAST(c_custkey AS STRING)) AS name, concat('ORG-', CAST(c_custkey % 40 AS STRING)) AS org_id,
  CASE WHEN c_custkey % 7 = 0 THEN '' ELSE concat(c_mktsegment, '-', CAST(c_custkey % 40 AS STRING)) END AS org_name,
  concat('N', CAST(c_nationkey AS STRING)) AS country
FROM {customer} WHERE c_custkey % 3 <> 0""",
    "asinfo_peeringdb": """
SELECT 64500 + c_custkey AS asn, concat('pdb-', CAST(c_custkey AS STRING)) AS name,
  CASE WHEN c_custkey % 4 = 0 THEN concat('long-', CAST(c_custkey AS STRING)) END AS name_long,
  CASE WHEN c_custkey % 10 = 0 THEN concat('aka-', CAST(c_custkey AS STRING)) WHEN c_custkey % 10 = 2 THEN '' END AS aka
FROM {customer} WHERE c_custkey % 2 = 0""",
    "asinfo_hegemony": """
SELECT 64500 + c_custkey AS asn, CAST(c_custkey % 100 AS DOUBLE) / 100 AS ipv4, CAST(c_custkey % 50 AS DOUBLE) / 100 AS ipv6
FROM {customer} WHERE c_custkey % 5 = 0""",
    "asinfo_population": """
SELECT 64500 + c_custkey AS asn, c_custkey * 1000 AS user_count, c_custkey * 10 AS sample_count
FROM {customer} WHERE c_custkey % 6 = 0""",
    "countries": """
SELECT concat('N', CAST(n_nationkey AS STRING)) AS code, n_name AS name FROM {nation}""",
    "peers": """
SELECT DISTINCT concat('rrc', lpad(CAST(user_id % 3 AS STRING), 2, '0')) AS collector, concat('192.0.2.', CAST(1 + user_id % 8 AS STRING)) AS peer_ip,
  64500 + user_id % 8 AS peer_asn, 700000 + 50000 * (user_id % 8) AS num_v4_pfxs, 0 AS num_v6_pfxs
FROM {events}""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived routing table over the Parquet tables of a folder."""
    text = VIEWS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in sorted(set(re.findall(r"\{(\w+)\}", text)))}
    return spark.sql(text, **tables)


def elems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route elements with origins and communities as arrays; withdrawals have neither."""
    rows = view(spark, sf_dir, "bgp_elems")
    return rows.withColumn("origin_asns", F.when(F.col("origin_asn").isNotNull(), F.array("origin_asn"))).withColumn("communities", F.when(F.col("community").isNotNull(), F.array("community"))).drop("origin_asn", "community")


def dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "rib_dumps")
    return rows.withColumn("origin_asns", F.array("origin_asn")).withColumn("dump_ts", F.col("dump_ts").cast("timestamp_ntz"))


def sql_with(body: str, *names: str) -> str:
    """body with the named views before it, for DuckDB."""
    used = [f"{n} AS ({re.sub(r'[{}]', '', VIEWS[n])})" for n in names]
    return f"WITH {', '.join(used)}\n{body}" if used else body
