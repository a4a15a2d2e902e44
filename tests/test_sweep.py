import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from pathloom.operators import match, sweep


def nested(seed, n):
    """Prefixes of both families, much nested, with gaps, repeats and the whole address space."""
    r = random.Random(seed)
    out = ["0.0.0.0/0", "::/0", "255.255.255.255/32", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff/128", "8000::/1", "128.0.0.0/1"]
    for _ in range(n):
        if r.random() < 0.5:
            base = ipaddress.ip_address(r.choice([0x0A000000, 0xC0000000, 0xDFFFFF00]) + (r.getrandbits(8) << 8) + r.getrandbits(3))
            out.append(str(ipaddress.ip_network(f"{base}/{r.choice([5, 8, 12, 16, 20, 23, 24, 25, 28, 30, 31, 32])}", strict=False)))
        else:
            high = r.choice([0x2001, 0xFE80, 0x8000, 0x0000]) << 112 | r.getrandbits(4) << 80 | r.getrandbits(2) << 63 | r.getrandbits(2)
            out.append(str(ipaddress.ip_network(f"{ipaddress.IPv6Address(high)}/{r.choice([3, 16, 20, 32, 48, 49, 63, 64, 65, 80, 127, 128])}", strict=False)))
    return out


def brute(queries, table, every):
    nets = [(ipaddress.ip_network(p), p, a) for p, a in table]
    out = []
    for i, q in queries:
        if q is None or "x" in q:
            continue
        n = ipaddress.ip_network(q, strict=False)
        around = [(t.prefixlen, p, a) for t, p, a in nets if t.version == n.version and t.prefixlen <= n.prefixlen and n.subnet_of(t)]
        most = max((x[0] for x in around), default=None)
        out += [(i, q, p, a) for k, p, a in around if every or k == most]
    return sorted(out)


@pytest.mark.parametrize("every", [False, True])
@pytest.mark.parametrize("case", ["many ranges", "one range", "sparse"])
def test_sweep_is_brute_force_s(spark, case, every):
    r = random.Random(7)
    table = [(p, 64500 + i % 5) for i, p in enumerate(nested(1, 250))]
    table += [(p, 7) for p, _ in table[:40]]
    table = table if case != "sparse" else [(p, a) for p, a in table[6:] if "/8" in p or "/24" in p or "/48" in p]
    table = sorted(set(table))
    queries = list(enumerate([*nested(2, 300), *[p for p, _ in table[:50]], None, "no prefix x", *["10.0.1.7/32"] * 400]))
    r.shuffle(queries)
    spark.conf.set("spark.sql.shuffle.partitions", "1" if case == "one range" else "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        q = spark.createDataFrame(queries, "id int, query string").repartition(3)
        t = spark.createDataFrame(table, "prefix string, origin_asn long")
        found = (sweep.covering if every else sweep.longest)(q, t)
        same = (match.covering if every else match.longest)(q, t)
        assert sorted(found.columns) == sorted(same.columns)
        got = sorted(tuple(x) for x in found.select("id", "query", "matched_prefix", "origin_asn").collect())
        assert got == brute(queries, table, every)
    finally:
        spark.conf.unset("spark.sql.shuffle.partitions")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_each_query_moves_once(spark, monkeypatch):
    """What is put in order is the queries and the table's distinct prefixes, however many lengths there are."""
    moved = []
    inner = sweep.checkpointed
    monkeypatch.setattr(sweep, "checkpointed", lambda df: moved.append((out := inner(df)).count()) or out)
    table = spark.createDataFrame([(p,) for p in nested(3, 400)], "prefix string")
    queries = spark.createDataFrame([(p,) for p in nested(4, 900)], "query string")
    assert sweep.longest(queries, table).count() >= 900
    assert moved == [906 + table.distinct().count()]


def test_sweep_of_empty_tables(spark):
    q, t = spark.createDataFrame([("10.0.0.0/8",)], "query string"), spark.createDataFrame([("10.0.0.0/8", 1)], "prefix string, origin_asn long")
    for a, b in ((q.limit(0), t), (q, t.limit(0)), (q.limit(0), t.limit(0)), (q, t.where(F.col("prefix") == "none"))):
        assert sweep.longest(a, b).count() == 0 and sweep.covering(a, b).count() == 0
