import datetime
import time
import json

import pytest
from pyspark.sql import functions as F

from pathloom.operators.filters import RouteFilters
from pathloom.sources import ingest
from pathloom.streaming import streams

#: Columns of a dump and their widths, the prefix column behind three status signs.
COLUMNS = (("Network", 17), ("Next Hop", 20), ("Metric", 7), ("LocPrf", 7), ("Weight", 7))


def dump_line(cells, path, status=" *> "):
    """A dump's line: names and addresses to the left of their columns, numbers to the right."""
    (_, a), (_, b), *numbers = COLUMNS
    return status + cells[0].ljust(a) + cells[1].ljust(b) + "".join(str(c).rjust(w) for c, (_, w) in zip(cells[2:], numbers, strict=True)) + path


def title():
    return "    " + COLUMNS[0][0].ljust(17) + COLUMNS[1][0].ljust(20) + "".join(n.ljust(w) for n, w in COLUMNS[2:]) + "Path"


@pytest.mark.parametrize("block", [None, 90])
def test_text_dumps(spark, tmp_path, block):
    """Plain, continued and wrapped routes; with small blocks a file is read by many tasks."""
    wrapped = dump_line(("", "2001:db8:ff::9", "", "", 0), "64510 ?")
    lines = [
        "BGP table version is 12, local router ID is 198.51.100.7, vrf id 3", "Default local pref 100, local AS 64499", "", title(), dump_line(("203.0.113.0/24", "192.0.2.11", 5, 200, 0), "64501 i"),
        dump_line(("", "192.0.2.12", "", "", 0), "64502 64503 {64504 64505 } 64506 e"), dump_line(("", "192.0.2.13", "", "", 0), "64502 i"), " *>  2001:db8:1234:5678::/64", wrapped[:4] + wrapped[5:], dump_line(("198.51.0.0/16", "192.0.2.14", "", "", 0), ""), "Displayed  5 routes",
    ]
    (tmp_path / "table-2025-03-04-0500.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "part.2025.03.05.txt").write_text(title() + "\r\n" + dump_line(("192.0.2.0/25", "192.0.2.1", "", "", 0), "64511 i") + "\r\n")
    (tmp_path / "notes.txt").write_text("nothing here\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    if block:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        found = ingest.read_text_dump(spark, str(tmp_path))
        assert not block or spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        rows = found.orderBy("file", "seq").collect()
        headers = {r["file"].rsplit("/", 1)[1]: r["has_header"] for r in ingest.text_dump_headers(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = {(r["file"].rsplit("/", 1)[1][:4], r["seq"]): (r["prefix"], r["next_hop"], r["as_path"], r["origin_asns"], r["origin"], r["med"], r["local_pref"]) for r in rows}
    assert got == {
        ("tabl", 4): ("203.0.113.0/24", "192.0.2.11", "64501", [64501], "IGP", 5, 200), ("tabl", 5): ("203.0.113.0/24", "192.0.2.12", "64502 64503 64505 64506", [64506], "EGP", None, None),
        ("tabl", 6): ("203.0.113.0/24", "192.0.2.13", "64502", [64502], "IGP", None, None), ("tabl", 8): ("2001:db8:1234:5678::/64", "2001:db8:ff::9", "64510", [64510], "INCOMPLETE", None, None),
        ("tabl", 9): ("198.51.0.0/16", "192.0.2.14", "", None, None, None, None), ("part", 1): ("192.0.2.0/25", "192.0.2.1", "64511", [64511], "IGP", None, None),
    }
    assert {(r["peer_ip"], r["peer_asn"], str(r["ts"])) for r in rows} == {("198.51.100.7", 64499, "2025-03-04 05:00:00"), ("0.0.0.0", 0, "2025-03-05 12:00:00")}
    assert headers == {"table-2025-03-04-0500.txt": True, "part.2025.03.05.txt": True, "notes.txt": False}


@pytest.mark.parametrize("form", ["lines", "array", "one line", "spread"])
def test_relations_in_either_form(spark, tmp_path, form):
    records = [{"asn1": 64500 + i, "asn2": 64600, "paths_count": i, "peers_count": 2 * i, "rel": i % 3 - 1} for i in range(5)]
    text = {"lines": "\n".join(map(json.dumps, records)) + "\nno record\n", "array": "[\n" + ",\n".join(map(json.dumps, records)) + "\n]\n", "one line": json.dumps(records), "spread": "\n\n  " + json.dumps(records, indent=2)}[form]
    (tmp_path / "relations.json").write_text(text)
    got = ingest.read_as2rel(spark, str(tmp_path / "relations.json"))
    assert sorted(r["asn1"] for r in got.collect()) == [64500 + i for i in range(5)]
    with pytest.raises(ValueError):
        ingest.read_as2rel(spark, str(tmp_path / "relations.json"), "csv")


def test_prefix_store(spark, tmp_path):
    rows = [("203.0.113.0/24", 64500), ("203.0.113.0/24", 64500), ("203.0.113.0/24", 64501), ("2001:db8::/32", 64500), ("none", 1), (None, 2)]
    assert ingest.store_pfx2as(spark.createDataFrame(rows, "prefix string, origin_asn long"), str(tmp_path / "a")) == {"records": 3, "prefixes": 2}
    labelled = spark.createDataFrame([(*r, "unknown") for r in rows], "prefix string, origin_asn long, validation string")
    assert ingest.store_pfx2as(labelled, str(tmp_path / "a")) == {"records": 3, "prefixes": 2}
    assert ingest.store_pfx2as(labelled.limit(0), str(tmp_path / "b")) == {"records": 0, "prefixes": 0}


def test_datasets(spark, tmp_path):
    def put(name, value):
        (tmp_path / name).write_text(value if isinstance(value, str) else json.dumps(value))
        return str(tmp_path / name)

    info = put("info.jsonl", json.dumps({"asn": 1, "name": "n", "country": "NL", "as2org": {"name": "a", "org_id": "o", "org_name": "x", "country": "NL"}, "hegemony": {"asn": 1, "ipv4": 0.5, "ipv6": 0.1}}) + "\nbad line\n" + json.dumps({"asn": 2, "name": "m", "country": "DE"}))
    tables = ingest.read_asinfo(spark, info)
    assert {k: v.count() for k, v in tables.items()} == {"core": 2, "as2org": 1, "peeringdb": 0, "hegemony": 1, "population": 0}
    edges = ingest.read_as2rel(spark, put("rel.json", [{"asn1": 1, "asn2": 2, "paths_count": 3, "peers_count": 4, "rel": -1}, {"asn1": 1, "asn2": 2, "paths_count": 3, "peers_count": 9, "rel": -1}]))
    assert [tuple(r) for r in edges.select("asn1", "asn2", "rel", "peers_count").collect()] == [(1, 2, -1, 9)]
    table = ingest.read_pfx2as(spark, put("p.json", [{"prefix": "203.0.113.0/24", "origin_asn": 64500}, {"prefix": "0.0.0.0/0", "origin_asn": 1}, {"prefix": "::/0", "origin_asn": 1}, {"prefix": "bad", "origin_asn": 1}, {"prefix": "198.51.100.0/24", "origin_asn": 64509}]))
    roas = ingest.read_roas(spark, put("r.json", [{"prefix": "203.0.113.0/24", "max_length": 24, "origin_asn": 64500, "ta": "t"}, {"prefix": "x", "max_length": 1, "origin_asn": 1, "ta": ""}]))
    assert {r["prefix"]: r["validation"] for r in table.collect()} == {"203.0.113.0/24": "unknown", "198.51.100.0/24": "unknown"} and roas.count() == 1
    assert {r["prefix"]: r["validation"] for r in ingest.with_validation(table, roas).collect()} == {"203.0.113.0/24": "valid", "198.51.100.0/24": "unknown"}
    pairs = ingest.read_aspas(spark, put("a.json", [{"customer_asn": 1, "provider_asns": [3, 2, 3]}, {"customer_asn": 5, "provider_asns": []}]))
    assert sorted(map(tuple, pairs.collect())) == [(1, 2), (1, 3)]
    assert sorted(r[0] for r in ingest.read_prefix_list(spark, put("l.txt", "# all\n1.0.0.0/8 # one\n\n 2001:db8::/32\n")).collect()) == ["1.0.0.0/8", "2001:db8::/32"]
    for bad in ("# nothing\n", "1.0.0.0/8\nx\n"):
        with pytest.raises(ValueError):
            ingest.read_prefix_list(spark, put("bad.txt", bad))


def test_dated_roas(spark):
    rows = [("p1", "2024-01-01", "ripe", ""), ("p2", "2024-01-01", "rpkispools", "sobornost"), ("p3", "2024-01-01", "rpkiviews", "other"), ("p4", "2024-02-01", "rpkispools", "sobornost")]
    roas = spark.createDataFrame(rows, "prefix string, date string, source string, collector string")
    of = lambda *a: [r["prefix"] for r in ingest.roa_snapshot(roas, *a).collect()]
    assert of() == ["p4"] and of("2024-01-01") == ["p2"] and of("2024-01-01", "RIPE") == ["p1"] and of("2024-01-01", "rpkiviews", "other") == ["p3"]
    for bad in (("2024-01-01", "ripe", "x"), ("2024-01-01", "none")):
        with pytest.raises(ValueError):
            of(*bad)


def test_elements_round_trip(spark, tmp_path):
    text = "1704067200.25|A|rrc00|192.0.2.1|65000|10.0.0.0/8|7|192.0.2.1|65000 65001|65001|IGP|100|0|65000:1 65000:2|false||\n1704067201.0|W|rrc00|192.0.2.1|65000|10.0.0.0/8||||||||||||\n"
    (tmp_path / "in.psv").write_text(text)
    rows = ingest.read_elems(spark, [str(tmp_path / "in.psv")], "psv")
    first = rows.orderBy("ts").first()
    assert first["origin_asns"] == [65001] and first["communities"] == ["65000:1", "65000:2"] and first["path_id"] == 7 and first["ts"].microsecond == 250000
    ingest.write_elems(rows.drop("file"), str(tmp_path / "table"))
    back = spark.read.parquet(str(tmp_path / "table"))
    assert back.count() == 2 and back.where("day = DATE '2024-01-01' AND collector = 'rrc00'").count() == 2
    ingest.write_rows(rows.select("prefix", "elem_type"), str(tmp_path / "psv"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "psv")).collect()) == ["10.0.0.0/8|A", "10.0.0.0/8|W"]
    ingest.write_rows(rows.select("prefix"), str(tmp_path / "json"), "json")
    with pytest.raises(ValueError):
        ingest.write_rows(rows, str(tmp_path / "x"), "xml")
    routes = spark.createDataFrame([(datetime.datetime(2024, 1, 1), "10.0.0.0/8")], "rib_ts timestamp, prefix string")
    ingest.write_snapshot(str(tmp_path / "snap"), routes, routes)
    assert spark.read.parquet(str(tmp_path / "snap" / "ribs")).count() == 1
    assert ingest.first_rows(back, 1).count() == 1


def test_search_stream(spark, tmp_path):
    rows = spark.range(100).select(F.col("id").alias("seq"), F.timestamp_seconds(F.col("id")).alias("ts"), F.when(F.col("id") % 3 == 0, "W").otherwise("A").alias("elem_type"), (F.col("id") % 5).alias("peer_asn"), F.format_string("10.%d.0.0/16", F.col("id") % 4).alias("prefix"))
    rows.repartition(5).write.parquet(str(tmp_path / "in"))
    got = []
    wanted = RouteFilters(elem_type="a", peer_asns=["1", "2"], prefixes=["10.0.0.0/14"], include_sub=True, start_ts="10")
    query = streams.search_stream(streams.element_stream(spark, str(tmp_path / "in"), rows.schema, 2), wanted, lambda batch, n: got.extend(r["seq"] for r in batch.collect()), str(tmp_path / "marks"))
    query.awaitTermination()
    assert sorted(got) == [i for i in range(10, 100) if i % 3 and i % 5 in (1, 2)]


@pytest.mark.parametrize("again", [False, True])
def test_capped_stream(spark, tmp_path, again):
    """Exactly so many rows over all batches and runs of a checkpoint; files behind the cap are never read."""
    rows = spark.range(100).selectExpr("id AS seq", "timestamp_seconds(id) AS ts", "'A' AS elem_type", "id % 2 AS peer_asn")
    for n in range(5):
        rows.where(F.col("seq").between(20 * n, 20 * n + 19)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.02)
    files = sorted((tmp_path / "in").glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns)
    for f in files[3:]:
        f.write_bytes(b"PAR1 no file PAR1")  # whoever reads these fails
    stream = lambda: streams.element_stream(spark, str(tmp_path / "in"), rows.schema, 1)
    got = {}

    def run(most):
        query = streams.search_stream(stream(), RouteFilters(peer_asns=["1"]), lambda batch, n: got.update({n: [r["seq"] for r in batch.collect()]}), str(tmp_path / "marks"), most)
        query.awaitTermination()

    for _ in range(1 + again):
        run(25)
    assert sorted(sum(got.values(), [])) == list(range(1, 51, 2))
