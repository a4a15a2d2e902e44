import ipaddress
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pathloom.functions.prefix import address_text, host_prefix, is_v6, prefix_key, prefix_length
from pathloom.operators import match, rov
from pathloom.operators.filters import RouteFilters

LOOKUP = [("1.0.0.0/8", 1000), ("1.1.0.0/16", 1100), ("1.1.1.0/24", 13335), ("2001:db8::/32", 64496), ("2001:db8:1::/48", 64497), ("::/0", 1)]


def random_prefixes(seed, n):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        if r.random() < 0.5:
            length = r.choice([0, 4, 8, 12, 16, 20, 24, 28, 32])
            out.append(str(ipaddress.ip_network(((10 << 24) + r.getrandbits(12) * (1 << r.choice([0, 8, 12])), length), strict=False)))
        else:
            length = r.choice([0, 16, 32, 48, 63, 64, 65, 80, 127, 128])
            out.append(str(ipaddress.ip_network(((0x20010DB8 << 96) + (r.getrandbits(6) << r.choice([0, 48, 63, 64, 80, 90])), length), strict=False)))
    return sorted(set(out))


def contains(a, b):
    x, y = ipaddress.ip_network(a, strict=False), ipaddress.ip_network(b, strict=False)
    return x.version == y.version and y.subnet_of(x)


def signed64(n):
    return n - (1 << 64) if n >> 63 else n


GOOD = ["1.1.1.0/24", "1.1.1.77/24", "0.0.0.0/0", "255.255.255.255/32", "2001:db8::/32", "::/0", "::1/128", "2001:DB8:0:0:1:2:3:4/64", "1:2:3:4:5:6:7:8/1", "fe80::1/63", "2001:db8::ffff/65", "ffff::/16", "8000::/1"]
BAD = ["1.1.1.1", "1.1.1.0/33", "256.1.1.1/8", "1.1.1/24", "01.1.1.1/8", "::1/129", "1::2::3/64", "g::/8", "::ffff:1.2.3.4/128", "", "x", "1.1.1.0/-1", "1.1.1.0/24/3", ":::/8", "1:2:3/8", None]


def test_keys(spark):
    df = spark.createDataFrame([(p,) for p in GOOD + random_prefixes(1, 200)], "p string")
    for r in df.select("p", prefix_key(F.col("p")).alias("k")).collect():
        net = ipaddress.ip_network(r["p"], strict=False)
        number = int(net.network_address)
        want = (net.version, signed64(number >> 64), signed64(number & ((1 << 64) - 1)), net.prefixlen)
        assert tuple(r["k"]) == want, r["p"]
    bad = spark.createDataFrame([(p,) for p in BAD], "p string").select("p", prefix_key(F.col("p")).alias("k")).collect()
    assert [r["p"] for r in bad if r["k"] is not None] == []


def test_parts(spark):
    df = spark.createDataFrame([("1.1.1.0/24",), ("2001:db8::1",), ("9.9.9.9",)], "p string")
    rows = df.select(prefix_length(F.col("p")).alias("n"), is_v6(F.col("p")).alias("v6"), host_prefix(F.col("p")).alias("h"), address_text(F.col("p")).alias("a")).collect()
    assert [tuple(r) for r in rows] == [(24, False, "1.1.1.0/24", "1.1.1.0"), (None, True, "2001:db8::1/128", "2001:db8::1"), (None, False, "9.9.9.9/32", "9.9.9.9")]


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_equal_brute_force(spark, seed):
    table, asked = random_prefixes(seed, 120), random_prefixes(seed + 10, 80)
    t = spark.createDataFrame([(p, i % 7) for i, p in enumerate(table)], "prefix string, origin_asn long")
    q = spark.createDataFrame([(p,) for p in asked], "query string")
    pairs = lambda df: sorted({(r["query"], r["matched_prefix"]) for r in df.collect()})
    cover = sorted((a, p) for a in asked for p in table if contains(p, a))
    assert pairs(match.covering(q, t)) == cover
    assert pairs(match.covered(q, t)) == sorted((a, p) for a in asked for p in table if contains(a, p))
    assert pairs(match.exact(q, t)) == sorted((a, p) for a in asked for p in table if a == p)
    best = defaultdict(list)
    for a, p in cover:
        best[a].append(p)
    want = sorted((a, max(ps, key=lambda p: int(p.split("/")[1]))) for a, ps in best.items())
    assert pairs(match.longest(q, t)) == want


def test_lookup_table(spark):
    t = spark.createDataFrame(LOOKUP, "prefix string, origin_asn long")
    q = spark.createDataFrame([(p,) for p in ("1.1.1.128/32", "1.1.2.0/24", "1.2.0.0/16", "9.0.0.0/8", "2001:db8:1:2::/64", "not a prefix")], "query string")
    got = {r["query"]: r["matched_prefix"] for r in match.longest(q, t).collect()}
    assert got == {"1.1.1.128/32": "1.1.1.0/24", "1.1.2.0/24": "1.1.0.0/16", "1.2.0.0/16": "1.0.0.0/8", "2001:db8:1:2::/64": "2001:db8:1::/48"}
    labels = {(r["matched_prefix"], r["match_type"]) for r in match.search_union(q.where("query = '1.1.2.0/24'"), t).collect()}
    assert labels == {("1.1.0.0/16", "longest"), ("1.0.0.0/8", "super")}
    several = spark.createDataFrame([("1.1.1.0/24", 13336), ("1.1.1.0/24", 13335)], "prefix string, origin_asn long")
    assert match.grouped(match.longest(q, several)).first()["origin_asns"] == [13335, 13336]


@pytest.mark.parametrize("up,down,negated", [(False, False, False), (True, False, False), (False, True, False), (True, True, False), (True, True, True)])
def test_prefix_filters(spark, up, down, negated):
    rows, wanted = random_prefixes(3, 150), random_prefixes(4, 12)
    df = spark.createDataFrame([(p, i) for i, p in enumerate(rows)], "prefix string, n long")
    kept = RouteFilters(prefixes=["!" * negated + w for w in wanted], include_super=up, include_sub=down).apply_prefixes(df)
    hit = lambda p: any(p == w or (up and contains(p, w)) or (down and contains(w, p)) for w in wanted)
    assert sorted(r["prefix"] for r in kept.collect()) == sorted(p for p in rows if hit(p) != negated)
    assert kept.columns == df.columns
    joined = match.filter_prefixes(df, spark.createDataFrame([(w,) for w in wanted], "prefix string"), up, down, negated)
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, kept.collect()))
    assert "Exchange" not in kept._jdf.queryExecution().toString()


def test_origin_validation(spark):
    roas = spark.createDataFrame([("1.0.0.0/24", 24, 13335, "apnic"), ("10.0.0.0/8", 16, 64500, "x"), ("2001:db8::/32", 48, 64496, "ripe"), ("7.0.0.0/8", None, 7, "x"), ("6.0.0.0/8", 8, 0, "x")], "prefix string, max_length int, origin_asn long, ta string")
    cases = [
        ("1.0.0.0/24", 13335, "valid"), ("1.0.0.0/24", 1, "invalid"), ("1.0.0.0/25", 13335, "invalid"), ("9.0.0.0/8", 1, "not_found"), ("10.1.0.0/16", 64500, "valid"), ("10.1.1.0/24", 64500, "invalid"),
        ("2001:db8:1::/48", 64496, "valid"), ("2001:db8:1:1::/64", 64496, "invalid"), ("1.0.0.0/8", 13335, "not_found"), ("x", 1, "not_found"), ("7.0.0.0/8", 7, "valid"), ("7.1.0.0/16", 7, "invalid"), ("6.0.0.0/8", 0, "invalid"),
    ]
    pairs = spark.createDataFrame(cases, "prefix string, origin_asn long, want string")
    rows = rov.detailed(pairs, roas).collect()
    assert len(rows) == len(cases) and all(r["state"] == r["want"] for r in rows)
    reason = {(r["prefix"], r["origin_asn"]): r["reason"] for r in rows}
    assert reason["1.0.0.0/25", 13335] == "Prefix length 25 exceeds max_length in covering ROAs"
    assert reason["1.0.0.0/24", 1] == "ASN 1 not authorized; authorized ASNs: 13335"
    listed = rov.covering_roas(spark.createDataFrame([("1.0.0.0/8",), ("10.9.9.9",)], "query string"), roas)
    assert {(r["query"], r["roa_prefix"]) for r in listed.collect()} == {("1.0.0.0/8", "1.0.0.0/24"), ("10.9.9.9", "10.0.0.0/8")}
    assert [r["prefix"] for r in rov.lookup(roas, asns=spark.createDataFrame([(64500,)], "asn long")).collect()] == ["10.0.0.0/8"]


def test_no_rows(spark):
    t = spark.createDataFrame([], "prefix string, origin_asn long")
    q = spark.createDataFrame([("1.0.0.0/8",)], "query string")
    assert match.longest(q, t).count() == match.covered(q, t).count() == match.search_union(q, t).count() == 0
    roas = spark.createDataFrame([], "prefix string, max_length int, origin_asn long, ta string")
    assert rov.validated(q.select(F.col("query").alias("prefix"), F.lit(1).alias("origin_asn")), roas).first()["state"] == "not_found"


@pytest.mark.parametrize("up,down,negated", [(False, False, False), (True, False, False), (False, True, False), (True, True, False), (True, True, True), (False, False, True)])
def test_long_lists_join_only_what_their_bitmap_passes(spark, up, down, negated):
    r = random.Random(9)
    net = lambda: str(ipaddress.ip_network((r.choice([0x0A000000, 0xC0A80000]) + r.getrandbits(16) * 64, r.choice([12, 16, 20, 24, 28, 32])), strict=False)) if r.random() < 0.7 else str(ipaddress.ip_network((0x20010DB8 << 96 | r.getrandbits(10) << 80, r.choice([29, 32, 44, 48, 64])), strict=False))
    rows, wanted = [(i, net()) for i in range(3000)] + [(-1, "none"), (-2, None)], [net() for _ in range(60)]
    df = spark.createDataFrame(rows, "id int, prefix string")
    found = match.filter_prefixes(df, spark.createDataFrame([(x,) for x in wanted], "prefix string"), up, down, negated)
    nets = [ipaddress.ip_network(x) for x in wanted]
    want = []
    for i, p in rows[:-2]:
        n = ipaddress.ip_network(p)
        same = [x for x in nets if x.version == n.version]
        hit = n in same or (up and any(x.subnet_of(n) for x in same)) or (down and any(n.subnet_of(x) for x in same))
        want += [i] * (hit != negated)
    assert sorted(x["id"] for x in found.collect()) == sorted(want)


def test_unmatched_rows_do_not_move(spark):
    """Of 20,000 rows three are on the list: no exchange gets more than a few of the rows."""
    df = spark.range(20_000).select(F.format_string("10.%d.%d.0/24", F.floor(F.col("id") / 250) % 250, F.col("id") % 250).alias("prefix"), "id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = match.filter_prefixes(df, spark.createDataFrame([("10.3.4.0/24",), ("10.9.9.0/24",)], "prefix string"), include_sub=True)
        assert found.count() == 2 and found.distinct().count() == 2
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "exists(array(" in plan.replace("struct(", "(").replace("named_", "")
        moved = _most_moved(found._jdf.queryExecution().executedPlan())
        assert 0 < moved < 200
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _most_moved(plan):
    """The most rows that an exchange of the executed plan wrote."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _most_moved(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return _most_moved(plan.plan())
    own = [0]
    if name == "ShuffleExchangeExec":
        own.append(plan.metrics().apply("shuffleRecordsWritten").value())
    children = plan.children()
    return max(own + [_most_moved(children.apply(i)) for i in range(children.size())])
