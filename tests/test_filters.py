import json

import pytest
from pyspark.sql import functions as F

from pathloom.functions import scalars
from pathloom.operators import filters
from pathloom.operators.filters import RouteFilters, community_matches

ELEMS = "seq long, ts timestamp, collector string, elem_type string, peer_asn long, peer_ip string, prefix string, as_path string, origin_asns array<long>, communities array<string>"


@pytest.fixture(scope="module")
def elems(spark):
    rows = [
        (1, "2024-01-01 00:00:00", "c", "A", 1, "192.0.2.1", "10.0.0.0/8", "1 2 3", [3], ["1299:100", "1299:2:3"]), (2, "2024-01-01 00:00:01", "c", "A", 2, "2001:db8::1", "10.1.0.0/16", "2 4", [4, 5], None),
        (3, "2024-01-01 00:00:02", "d", "W", 1, "192.0.2.1", "10.0.0.0/8", None, None, None), (4, "2024-01-01 00:00:03", "d", "A", 3, "192.0.2.3", "11.0.0.0/8", "3 3 3", [3], ["65000:1"]),
    ]
    return spark.createDataFrame([(r[0], None, *r[2:]) for r in rows], ELEMS).withColumn("ts", F.timestamp_seconds(F.lit(1704067199) + F.col("seq")))


CASES = [
    ({"origin_asns": ["3"]}, [1, 4]), ({"origin_asns": ["!3"]}, [2, 3]), ({"origin_asns": ["5", "9"]}, [2]), ({"peer_asns": ["!1"]}, [2, 4]), ({"peer_ips": ["2001:0db8::1"]}, [2]),
    ({"communities": ["1299:*"]}, [1]), ({"communities": ["*:1", "1299:*:3"]}, [1, 4]), ({"communities": ["!1299:*"]}, [2, 3, 4]), ({"elem_type": "w"}, [3]), ({"as_path_regex": "3$"}, [1, 4]), ({"as_path_regex": "^$"}, [3]),
    ({"start_ts": "1704067201", "end_ts": "2024-01-01T00:00:02Z"}, [2, 3]), ({"start_ts": "2024-01-01", "duration": "1s"}, [1, 2]), ({"end_ts": "1704067203", "duration": "1 sec"}, [3, 4]), ({"start_ts": "1704067203"}, [4]),
    ({"prefixes": ["10.0.0.0/8"], "include_sub": True, "elem_type": "a"}, [1, 2]), ({"prefixes": ["10.1.0.0/16"], "include_super": True, "peer_asns": ["1", "2"], "origin_asns": ["!4"]}, [1, 3]), ({}, [1, 2, 3, 4]),
]


@pytest.mark.parametrize("given,want", CASES)
def test_dimensions(elems, given, want):
    assert sorted(r["seq"] for r in RouteFilters(**given).apply(elems).collect()) == want


def test_a_dump_has_no_time_filter(elems):
    assert RouteFilters(start_ts="2030-01-01").apply(elems, "rib").count() == 4


@pytest.mark.parametrize("given", [
    {"origin_asns": ["-1"]}, {"origin_asns": ["4294967296"]}, {"peer_asns": ["x"]}, {"origin_asns": ["1", "!2"]}, {"prefixes": ["1.1.1.1"]}, {"prefixes": ["1.1.1.0/33"]}, {"peer_ips": ["1.1.1"]}, {"communities": ["1"]},
    {"communities": ["65536:1"]}, {"communities": ["1:2:3:4"]}, {"communities": ["a:b"]}, {"communities": ["1:2:4294967296"]}, {"communities": ["1:1", "!2:2"]}, {"elem_type": "x"}, {"start_ts": "soon"}, {"duration": "1h"},
    {"start_ts": "1", "end_ts": "2", "duration": "1h"}, {"start_ts": "5", "end_ts": "2"}, {"start_ts": "1", "duration": "1 fortnight"}, {"as_path_regex": "(?=1)"},
])
def test_rejected(given):
    with pytest.raises(ValueError):
        RouteFilters(**given).validate()


def test_accepted():
    RouteFilters(origin_asns=["0", "4294967295"], prefixes=["1.1.1.0/24", "2001:db8::/32"], communities=["*:*", "57866:104:31", "1:*"], duration="90m", end_ts="2024-01-01 10:00:00+02:00").validate()


def test_communities(spark):
    rows = [["1299:7"], ["7:100"], ["57866:104:31"], ["57866:104:32", "1:1"], ["1299:100:3"], [], None, ["x:100"], ["1299:07"]]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(rows)], "i long, communities array<string>")
    of = lambda patterns: [r["i"] for r in df.where(community_matches(patterns)).orderBy("i").collect()]
    assert of(["1299:*", "*:100"]) == [0, 1, 8] and of(["57866:104:31"]) == [2] and of(["*:*:*"]) == [2, 3, 4] and of(["1299:8"]) == []


def test_a_large_country_is_joined(spark, elems, monkeypatch):
    monkeypatch.setattr(filters, "INLINE_ASNS", 1)
    asinfo = spark.createDataFrame([(5, "x", "NL"), (3, "y", "nl"), (9, "z", "NL")], "asn long, name string, country string")
    assert sorted(r["seq"] for r in filters.in_country(elems, asinfo, "nl").collect()) == [1, 2, 4]


def test_filter_files():
    file = RouteFilters.from_json(json.dumps({"prefixes": ["1.0.0.0/8"], "include_sub": True, "start_ts": "1", "elem_type": None}))
    both = RouteFilters(prefixes=["2.0.0.0/8", "1.0.0.0/8"], start_ts="5").merged(file)
    assert both.prefixes == ["2.0.0.0/8", "1.0.0.0/8"] and both.include_sub and both.start_ts == "5"
    for bad in ('{"prefix": []}', '{"prefixes": "1.0.0.0/8"}', "[]", '{"include_sub": 1}', "{"):
        with pytest.raises(ValueError):
            RouteFilters.from_json(bad)


def test_fields(elems):
    assert filters.parse_fields("prefix, type") == ["prefix", "type"]
    assert "collector" in filters.parse_fields(None, True) and "collector" not in filters.parse_fields(None)
    with pytest.raises(ValueError):
        filters.parse_fields("prefix,nothing")
    row = filters.rendered(elems, ["type", "origin_asns", "communities", "med", "as_path"]).collect()
    assert tuple(row[1]) == ("A", "4 5", "", "", "2 4") and tuple(row[2]) == ("W", "", "", "", "")


def test_peers_and_countries(spark, elems):
    peers = spark.createDataFrame([("c", "192.0.2.1", 1, 800000, 0), ("d", "192.0.2.3", 3, 799999, 99999), ("c", "2001:db8::1", 2, 0, 100000)], "collector string, peer_ip string, peer_asn long, num_v4_pfxs long, num_v6_pfxs long")
    assert sorted(r["seq"] for r in filters.full_feed_only(elems, peers).collect()) == [1, 2]
    asinfo = spark.createDataFrame([(5, "x", "NL"), (3, "y", "de")], "asn long, name string, country string")
    assert [r["seq"] for r in filters.in_country(elems, asinfo, "nl").collect()] == [2]
    assert sorted(r["seq"] for r in filters.in_country(elems, asinfo, "DE").collect()) == [1, 4]


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v string")
    return [r["o"] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_scalars(spark):
    assert column(spark, ["AS13335", "as1", " 7 ", "4294967296", "ASx", "-1", None], scalars.parse_asn) == [13335, 1, 7, None, None, None, None]
    assert column(spark, ["AS1", "13335", "1.1.1.0/24", "1.1.1.1", "2001:db8::1", "Cloud", "AS-SET"], scalars.query_type) == ["asn", "asn", "prefix", "prefix", "prefix", "name", "name"]
    assert column(spark, ["0", "2024-01-01", "2024-01-01T01:00:00+01:00", "2024-01-01 00:00:00", "no"], lambda c: scalars.unix_seconds(scalars.parse_time(c))) == [0.0, 1704067200.0, 1704067200.0, 1704067200.0, None]
    assert column(spark, ["0"], lambda c: scalars.rfc3339(scalars.parse_time(c))) == ["1970-01-01T00:00:00+00:00"]
    assert column(spark, ["abcdef", "abcdefg", "日本語日本語日", "", None], lambda c: scalars.truncated_name(c, 6)) == ["abcdef", "abc...", "日本語...", "", None]
    assert column(spark, ["1 2 { 3 } x {4", "", None, "4294967296 5"], scalars.path_asns) == [[1, 2, 3], [], None, [5]]
    assert column(spark, ["1 2", "", "x"], scalars.path_origin) == [2, None, None]
    assert column(spark, ["i", "e", "?", "x"], scalars.origin_code) == ["IGP", "EGP", "INCOMPLETE", None]
    times = column(spark, ["/a/oix-2026-07-01-0000.bz2", "x2026.07.01.gz", "none", "/a-2026-13-01-0000"], scalars.time_of_path)
    assert [str(t) for t in times] == ["2026-07-01 00:00:00", "2026-07-01 12:00:00", "None", "None"]
    assert column(spark, ["1"], lambda c: scalars.percent_text(c.cast("int"), F.lit(3))) == ["33.3%"] and column(spark, ["1"], lambda c: scalars.percent_text(c.cast("int"), F.lit(0))) == ["0.0%"]
    assert column(spark, ["3 4"], lambda c: scalars.asns_text(scalars.text_asns(c))) == ["3 4"]
