import random

import pytest
from pyspark.sql import functions as F

from pathloom.operators import as2rel, asinfo, asof, aspa, reports, rib, search
from pathloom.operators.filters import RouteFilters
from pathloom.streaming import streams

EVENTS = "seq long, ts long, collector string, peer_ip string, peer_asn long, prefix string, path_id long, elem_type string, origin_asns array<long>"
INSTANTS = [10, 25, 40]


def random_events(seed, n=160):
    r = random.Random(seed)

    def row(seq, ts, kind):
        return (seq, ts, "c", f"192.0.2.{r.randrange(2)}", 1, f"10.{r.randrange(6)}.0.0/16", r.choice([None, 7]), kind, None if kind == "W" else [r.choice([1, 2, 3])])

    base = [row(i, 0, "A") for i in range(12)]
    updates = [row(i, 1 + i * 45 // n + r.choice([0, 0, -1, 2]), r.choice("AAW")) for i in range(n)]
    return base, updates


def simulate(base, updates, matching, instants):
    """A dictionary of routes, event by event; the tables at the instants and the log of changes applied."""
    key, tables, log, state = (lambda e: e[2:7]), {}, [], {}
    for e in sorted(base):
        if e[8][0] in matching:
            state[key(e)] = e[8]
        else:
            state.pop(key(e), None)
    upto = {}
    for i in instants:
        now = dict(state)
        for e in sorted(updates):
            if e[1] <= i:
                if e[7] == "A" and e[8][0] in matching:
                    now[key(e)] = e[8]
                else:
                    now.pop(key(e), None)
        tables[i] = now
    now = dict(state)
    for e in sorted(updates):
        stamp = next((i for i in instants if e[1] <= i), None)
        if stamp is None:
            continue
        live = e[7] == "A" and e[8][0] in matching
        if live or key(e) in now:
            upto.setdefault(stamp, []).append(e[0])
        now.pop(key(e), None)
        if live:
            now[key(e)] = e[8]
    log = [(i, s) for i in instants[1:] for s in upto.get(i, [])]
    return tables, log


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("wanted", [["1", "2"], ["!3", "!1"], []])
def test_replay_equals_a_simulation(spark, seed, wanted):
    base, updates = random_events(seed)
    # times don't go back across an instant in the log and tables of several instants
    updates = [(e[0], max(x[1] for x in updates[: i + 1]), *e[2:]) for i, e in enumerate(updates)]
    matching = {1, 2} if wanted == ["1", "2"] else {2} if wanted else {1, 2, 3}
    tables, log = simulate(base, updates, matching, INSTANTS)
    b, u = (spark.createDataFrame(x, EVENTS) for x in (base, updates))
    events = rib.events_of(b.drop("elem_type"), u, RouteFilters(origin_asns=wanted).announce_predicate())
    rows = lambda df: {tuple(r[c] for c in ("collector", "peer_ip", "peer_asn", "prefix", "path_id")): r["origin_asns"] for r in df.collect()}
    for i in INSTANTS:
        assert rows(rib.snapshot(events.where((F.col("phase") == 0) | (F.col("ts") <= i)), ["origin_asns"])) == tables[i]
    many = rib.snapshots(events, ["origin_asns"], [F.lit(i).cast("long") for i in INSTANTS])
    for i in INSTANTS:
        assert rows(many.where(F.col("rib_ts") == i)) == tables[i]
    found = rib.update_log(events, [F.lit(i).cast("long") for i in INSTANTS])
    assert sorted((r["rib_ts"], r["seq"]) for r in found.collect()) == sorted(log)


def test_table_at_the_dump_is_the_dump(spark):
    base, updates = random_events(9)
    events = rib.events_of(spark.createDataFrame(base, EVENTS).drop("elem_type"), spark.createDataFrame(updates, EVENTS))
    at = rib.snapshot(events.where("ts <= 0"), ["origin_asns"])
    assert at.count() == len({e[2:7] for e in base})


def test_last_before(spark):
    r = random.Random(3)
    left = [(i, r.choice("abc"), r.choice([None, r.randrange(400_000)])) for i in range(300)]
    right = [(r.choice("abd"), r.choice([None, r.randrange(400_000), 5000]), r.randrange(50)) for _ in range(120)]
    q = spark.createDataFrame(left, "id int, k string, t long").withColumn("t", F.timestamp_seconds("t"))
    d = spark.createDataFrame(right, "k string, u long, v int").withColumn("u", F.timestamp_seconds("u"))
    want = {}
    for i, k, t in left:
        near = [(u, v) for x, u, v in right if x == k and u is not None and t is not None and u <= t]
        want[i] = max(near)[1] if near else None
    for width in (1000, 86_400, 10_000_000):
        assert {x["id"]: x["v"] for x in asof.last_before(q, d, ["k"], "t", "u", ["v"], width).collect()} == want
    assert asof.last_before(q.limit(0), d, ["k"], "t", "u", ["v"]).count() == 0
    assert asof.last_before(q, d.limit(0), ["k"], "t", "u", ["v"]).where("v IS NOT NULL").count() == 0


def test_ten_thousand_instants(spark):
    """Stamping and dump selection at many instants: same results as one instant at a time, by halving and one ordered pass."""
    r = random.Random(4)
    instants = sorted(r.sample(range(1, 1_000_000), 10_000))
    stamps = spark.createDataFrame([(instants,)], "s array<long>").select(F.transform("s", F.timestamp_seconds).alias("instants"))
    events = [(r.randrange(3), "A" if r.random() < 0.7 else "W", f"10.{r.randrange(6)}.0.0/16", n, sorted(r.sample(range(1, 1_000_100), 400))[n]) for n in range(400)]
    df = spark.createDataFrame(events, "peer_asn int, elem_type string, prefix string, seq int, s long").withColumn("ts", F.timestamp_seconds("s")).withColumn("phase", F.lit(1)).withColumn("is_match", F.lit(True))
    df = df.join(F.broadcast(stamps.withColumn("one", F.lit(1))), F.col("phase") == F.col("one")).drop("one")
    got = {x["seq"]: x["at"] for x in rib.stamped(df, "instants").select("seq", F.unix_seconds("rib_ts").alias("at")).collect()}
    assert got == {e[3]: next(i for i in instants if i >= e[4]) for e in events if e[4] <= instants[-1]}
    found = rib.snapshots(df, ["seq"], "instants").groupBy(F.unix_seconds("rib_ts").alias("at")).agg(F.count(F.lit(1)).alias("n")).collect()
    counts = {x["at"]: x["n"] for x in found}
    for at in (instants[0], instants[17], instants[5000], instants[-1]):
        last = {}
        for peer, kind, prefix, n, t in sorted(events, key=lambda e: e[3]):
            if t <= at:
                last[peer, prefix] = kind
        assert counts.get(at, 0) == sum(k == "A" for k in last.values())
    catalog = spark.createDataFrame([(c, "rib", t, f"{c}{t}") for c in "cd" for t in range(0, 1_000_000, 7000)], "collector_id string, data_type string, s long, url string").withColumn("ts_start", F.timestamp_seconds("s"))
    wanted = spark.createDataFrame([(i,) for i in instants], "s long").select(F.timestamp_seconds("s").alias("rib_ts"))
    dumps = rib.base_dumps(catalog, wanted).select("collector_id", F.unix_seconds("rib_ts").alias("at"), "url").collect()
    assert len(dumps) == 20_000 and all(x["url"] == f"{x['collector_id']}{x['at'] // 7000 * 7000}" for x in dumps)


def test_dump_selection(spark):
    catalog = spark.createDataFrame([("c", "rib", 10, 10, "c10"), ("c", "rib", 20, 20, "c20"), ("d", "rib", 15, 15, "d15"), ("c", "updates", 18, 21, "u1"), ("c", "updates", 30, 31, "u2"), ("c", "updates", 1, 5, "u0")], "collector_id string, data_type string, s long, e long, url string")
    at = lambda c: F.timestamp_seconds(F.col(c) * 86400)
    catalog = catalog.withColumn("ts_start", at("s")).withColumn("ts_end", at("e"))
    day = lambda d: F.timestamp_seconds(F.lit(d * 86400))
    found = rib.base_dumps(catalog, [day(19), day(25), day(19)])
    assert sorted((r["collector_id"], r["url"]) for r in rib.require_dumps(found).collect()) == [("c", "c10"), ("c", "c20"), ("d", "d15"), ("d", "d15")]
    assert {r["url"] for r in rib.update_files(catalog, found).collect()} == {"u1"}
    assert tuple(rib.run_summary(found).first()) == (2, 2, 3)
    for d in (12, 60):  # before d's first dump, and past the look-back
        with pytest.raises(ValueError):
            rib.require_dumps(rib.base_dumps(catalog, [day(d)]))


def test_state_stream_equals_replay(spark, tmp_path):
    base, updates = random_events(5)
    b, u = spark.createDataFrame(base, EVENTS), spark.createDataFrame(updates, EVENTS)
    key = ["collector", "peer_ip", "peer_asn", "prefix", "path_id"]
    first = rib.snapshot(rib.events_of(b.drop("elem_type"), u.limit(0)), ["origin_asns"]).withColumn("seq", F.lit(-1).cast("long"))
    for n in range(3):
        part = u.where(F.col("seq") % 3 == n) if n else u.where((F.col("seq") % 3 == 0) | (F.col("seq") > 150))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    state = streams.RoutingState(spark, str(tmp_path / "state"), ["origin_asns"])
    state.start(first)
    state.follow(streams.element_stream(spark, str(tmp_path / "in"), u.schema, 1), str(tmp_path / "marks")).awaitTermination()
    want = rib.snapshot(rib.events_of(b.drop("elem_type"), u), ["origin_asns"])
    assert state.batches == 3
    few = streams.RoutingState(spark, str(tmp_path / "few"), ["origin_asns"], fanout=2, keep_marks=1000)
    few.start(first)
    few.apply(u.where("seq <= 100"), 0)
    few.apply(u.where("seq > 100").limit(1), 1)
    few.apply(u.where("seq > 100"), 1)  # a batch that runs again
    few.apply(u, 2)
    row = lambda df: sorted(str([r[c] for c in [*key, "origin_asns"]]) for r in df.collect())
    assert row(state.table()) == row(want) == row(few.table())
    assert row(few.table(1)) == row(rib.snapshot(rib.events_of(b.drop("elem_type"), u.where("seq <= 100")), ["origin_asns"]))
    assert few.unused(3) and not set(few.unused(3)) & {few._run(r[0]) for r in few.runs(3)}


def _bytes_of(path):
    return sum(p.stat().st_size for p in path.rglob("*.parquet"))


def test_a_batch_writes_what_it_holds(spark, tmp_path):
    """What a batch writes doesn't grow with the table; runs are merged, and every row is rewritten a few times at most."""
    columns = "collector string, peer_ip string, peer_asn long, prefix string, seq long, origin_asns array<long>, elem_type string"
    table = spark.range(60_000).selectExpr("'c' AS collector", "'p' AS peer_ip", "id % 7 AS peer_asn", "concat('10.', id) AS prefix", "CAST(-1 AS long) AS seq", "array(id) AS origin_asns")
    small, large = (streams.RoutingState(spark, str(tmp_path / n), ["origin_asns"], fanout=4) for n in ("small", "large"))
    small.start(table.where("seq = -1 AND origin_asns[0] < 6000"))
    large.start(table)
    rows = 0
    for n in range(20):
        batch = spark.createDataFrame([("c", "p", i % 7, f"10.{i}", 100 * n + i, [n], "W" if (i + n) % 5 == 0 else "A") for i in range(n, n + 30)], columns)
        for state in (small, large):
            state.apply(batch, n)
        rows = max(rows, len(large.runs(n + 1)))
    base = _bytes_of(tmp_path / "large" / "runs" / "base-000000000")
    written = _bytes_of(tmp_path / "large" / "runs") - base
    assert large.runs(20)[0] == ("base-000000000", -1, 60_000) and written < 0.6 * base and rows <= 1 + 3 * 3
    assert abs(written - (_bytes_of(tmp_path / "small" / "runs") - _bytes_of(tmp_path / "small" / "runs" / "base-000000000"))) < 0.05 * written
    assert large.table().count() == 60_000 - 10 and small.table().count() == 6000 - 10


def test_state_goes_on_from_its_checkpoint(spark, tmp_path):
    base, updates = random_events(6)
    b, u = spark.createDataFrame(base, EVENTS), spark.createDataFrame(updates, EVENTS)
    first = rib.snapshot(rib.events_of(b.drop("elem_type"), u.limit(0)), ["origin_asns"]).withColumn("seq", F.lit(-1).cast("long"))
    read = lambda: streams.element_stream(spark, str(tmp_path / "in"), u.schema, 1)
    u.where("seq <= 60").coalesce(1).write.parquet(str(tmp_path / "in"))
    state = streams.RoutingState(spark, str(tmp_path / "state"), ["origin_asns"])
    state.start(first)
    state.follow(read(), str(tmp_path / "marks")).awaitTermination()
    u.where("seq > 60").repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
    later = streams.RoutingState(spark, str(tmp_path / "state"), ["origin_asns"]).resume(state.batches)
    later.follow(read(), str(tmp_path / "marks")).awaitTermination()
    want = rib.snapshot(rib.events_of(b.drop("elem_type"), u), ["origin_asns"])
    row = lambda df: sorted(str((r["peer_ip"], r["prefix"], r["path_id"], r["origin_asns"])) for r in df.collect())
    assert later.batches == 3 and row(later.table()) == row(want)


def test_ordering_and_statistics(spark):
    elems = spark.createDataFrame([(1, None, "b"), (2, "x", "a"), (3, "a", "c")], "seq long, as_path string, prefix string")
    seqs = lambda q: [r["seq"] for r in q.on(elems).collect()]
    assert seqs(search.ElementQuery().order_by("as_path")) == [1, 3, 2]
    assert seqs(search.ElementQuery().order_by("prefix", True).limit(1, 1)) == [1]
    with pytest.raises(ValueError):
        search.order_columns("colour")
    files = spark.createDataFrame([(10, 0), (20, 15), (-5, 0)], "rough_size long, exact_size long")
    assert tuple(search.file_bytes(files).first()) == (3, 25, False, 25)
    assert tuple(search.file_bytes(files.limit(0)).first()) == (0, 0, True, 0)


def test_preferred_names(spark):
    core = spark.createDataFrame([(i, f"core{i}", "NL") for i in range(1, 6)], "asn long, name string, country string")
    org = spark.createDataFrame([(1, "a1", "O", "org1"), (3, "a3", "O", "org3"), (4, "a4", "P", "")], "asn long, name string, org_id string, org_name string")
    pdb = spark.createDataFrame([(1, "p1", None, "aka1"), (2, "p2", "", "")], "asn long, name string, name_long string, aka string")
    got = {r["asn"]: r["as_name"] for r in asinfo.names(core, org, pdb).collect()}
    assert got == {1: "aka1", 2: "p2", 3: "org3", 4: "a4", 5: "core5"}
    assert [r["asn"] for r in asinfo.text_search(core, org, pdb, "ORG").collect()] == [1, 3]
    assert asinfo.with_name(core.where("asn = 9").union(spark.createDataFrame([(9, "x", "y")], core.schema)), asinfo.names(core, org, pdb), "asn", "n").first()["n"] is None


def test_text_search_of_long_names(spark):
    core = spark.createDataFrame([(1, "core1", "NL"), (2, "core2", "NL"), (3, "core3", "NL")], "asn long, name string, country string")
    org = spark.createDataFrame([(1, "a1", "O", "org1")], "asn long, name string, org_id string, org_name string")
    pdb = spark.createDataFrame([(1, "p1", "Long-1", None), (2, "p2", None, "aka2"), (3, "p3", "long-3", "aka3")], "asn long, name string, name_long string, aka string")
    assert [r["asn"] for r in asinfo.text_search(core, org, pdb, "long-1").collect()] == [1]
    assert [r["asn"] for r in asinfo.text_search(core, org, pdb, "LONG").collect()] == [1, 3]
    assert asinfo.text_search(core, org, pdb, "aka2").count() == 0 and [r["asn"] for r in asinfo.text_search(core, org, pdb, "P2").collect()] == [2]
    data = reports.Datasets(*[None] * 4, core, org, pdb)
    asked = spark.createDataFrame([("LONG-",), ("g-3",), ("e",), ("or",), ("aka",), ("",), ("org1",)], "input string")
    got = {}
    for r in reports.inspect_names(asked, data, 2).collect():
        got.setdefault(r["input"], []).append((r["rank"], r["asn"], r["total"], r["truncated"]))
    assert {k: sorted(v) for k, v in got.items()} == {"LONG-": [(1, 1, 2, False), (2, 3, 2, False)], "g-3": [(1, 3, 1, False)], "e": [(1, 1, 3, True), (2, 2, 3, True)], "or": [(1, 1, 3, True), (2, 2, 3, True)], "org1": [(1, 1, 1, False)]}


def test_countries(spark):
    table = spark.createDataFrame([("US", "United States"), ("GB", "United Kingdom"), ("NL", "Netherlands"), ("NE", "Niger"), ("NG", "Nigeria"), ("IN", "India")], "code string, name string")
    assert [r["code"] for r in asinfo.country_lookup(table, "us").collect()] == ["US"]
    assert [r["code"] for r in asinfo.country_lookup(table, "united").collect()] == ["GB", "US"]
    inputs = spark.createDataFrame([("niger",), ("NE",), ("nether",), ("united",), ("zz",), ("nowhere",), ("in",)], "input string")
    got = {r["input"]: (r["code"], r["state"]) for r in asinfo.resolve_countries(inputs, table).collect()}
    assert got == {"niger": ("NE", "resolved"), "NE": ("NE", "resolved"), "nether": ("NL", "resolved"), "united": (None, "ambiguous"), "zz": ("ZZ", "resolved"), "nowhere": (None, "unknown"), "in": ("IN", "resolved")}


def test_relationships(spark):
    edges = spark.createDataFrame([(1, 2, 5, 10, -1), (1, 2, 5, 8, 0), (2, 3, 5, 6, 1), (4, 2, 1, 4, -1), (4, 5, 1, 3, -1)], "asn1 long, asn2 long, paths_count long, peers_count long, rel int")
    got = {(r["asn1"], r["asn2"]): (r["connected"], r["as1_upstream"], r["as2_upstream"]) for r in as2rel.aggregated(as2rel.symmetric(edges)).collect()}
    assert got[1, 2] == (8, 0, 10) and got[2, 1] == (8, 10, 0) and got[3, 2] == (0, 0, 6)
    assert [tuple(r) for r in as2rel.single_homed(edges, 2).collect()] == [(1, 10), (3, 6)]
    assert [r[0] for r in as2rel.single_homed(edges, 2, 65.0).collect()] == [1, 3] and [r[0] for r in as2rel.single_homed(edges, 2, 70.0).collect()] == [1]
    share = as2rel.with_percentages(as2rel.pair(edges, spark.createDataFrame([(1, 2), (9, 9)], "asn1 long, asn2 long")), 20).collect()
    assert len(share) == 1 and share[0]["connected_pct"] == 40.0 and share[0]["peer_pct"] == 0.0
    assert as2rel.with_percentages(as2rel.aggregated(edges.limit(0)), 0).count() == 0
    with pytest.raises(ValueError):
        as2rel.by_relation(edges, "sibling")
    names = spark.createDataFrame([(2, "two"), (1, "one")], "asn long, as_name string")
    rows = as2rel.search(edges, [2], names, texts=True).collect()
    assert [(r["asn2"], r["asn2_name"], r["connected"], r["connected_text"], r["as1_upstream_text"]) for r in rows] == [(1, "one", 8, "80.0%", "100.0%"), (3, None, 0, "0.0%", "60.0%"), (4, None, 0, "0.0%", "40.0%")]
    assert [r["asn2"] for r in as2rel.search(edges, [2], kind="downstream", min_percent=50).collect()] == [1]
    assert [(r["asn1"], r["asn2"]) for r in as2rel.search(edges, [1, 2]).collect()] == [(1, 2)]
    assert [(r["asn1"], r["asn2"]) for r in as2rel.search(edges, [4, 2, 5], sort_by_asn=True).collect()] == [(2, 4), (4, 5)]
    assert [tuple(r) for r in as2rel.search(edges, [2], names, sole_upstream=True).select("customer_asn", "customer_name").collect()] == [(1, "one"), (3, None)]
    for bad in ({"asns": []}, {"asns": [1, 2], "sole_upstream": True}, {"asns": [1, 2, 3], "kind": "peer"}):
        with pytest.raises(ValueError):
            as2rel.search(edges, **bad)
    aspas = spark.createDataFrame([(1, 3), (1, 2), (2, 3)], "customer_asn long, provider_asn long")
    assert {r[0]: r[1] for r in aspa.providers(aspas).collect()} == {1: [2, 3], 2: [3]}
    assert {r[0]: r[1] for r in aspa.of_providers(aspas, spark.createDataFrame([(2,)], "asn long")).collect()} == {1: [2, 3]}


def test_rows_of_some_ases_are_taken_behind_the_aggregation_that_makes_a_table(spark):
    """A semi join would be moved below it, where all rows of an AS come to one task."""
    links = spark.createDataFrame([(1, 2, -1, k) for k in range(30)] + [(3, 1, 0, 5)], "a long, b long, rel int, route long").repartition(4)
    edges = links.groupBy(F.col("a").alias("asn1"), F.col("b").alias("asn2"), "rel").agg(F.count(F.lit(1)).alias("paths_count"), F.countDistinct("route").alias("peers_count"))
    aspas = links.select(F.col("a").alias("customer_asn"), F.col("b").alias("provider_asn")).distinct()
    asns = spark.range(1, 3).select(F.col("id").alias("asn"))
    pairs = asns.select(F.col("asn").alias("asn1"), (F.col("asn") + 1).alias("asn2"))
    found = [as2rel.neighbours(edges, asns), as2rel.pair(edges, pairs), as2rel.pairs_among(edges, asns), as2rel.connectivity(edges, asns), aspa.of_customers(aspas, asns), aspa.of_providers(aspas, asns), asinfo.records_of(edges.withColumn("asn", F.col("asn1")), asns)]
    for df in found:
        lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
        joins = [i for i, line in enumerate(lines) if "Join " in line]
        assert joins
        for i in joins:
            # the rows of the table's source, not their aggregate, would be the join's side
            side = next(j for j in range(i + 1, len(lines)) if lines[j].lstrip(" :+-").startswith(("Aggregate", "Union", "Join", "LogicalRDD", "Range", "Repartition")))
            assert lines[side].lstrip(" :+-").startswith(("Aggregate", "Union", "Join")), "\n".join(lines)
            assert depth[side] > depth[i]
    assert [(r["asn1"], r["asn2"], r["as2_upstream"]) for r in found[0].where("asn2 = 2").collect()] == [(1, 2, 30)]
    assert [tuple(r) for r in found[4].collect()] == [(1, [2])]


def test_inspected_ases_without_sections(spark):
    """Sections meet in one aggregation: an AS without any has zeros of ROAs and nulls; one section alone has its own columns."""
    table = spark.createDataFrame
    data = reports.Datasets(
        table([("10.0.0.0/16", 1)], "prefix string, origin_asn long"), table([("10.0.0.0/16", 16, 1, "ta")], "prefix string, max_length int, origin_asn long, ta string"), table([(1, 2)], "customer_asn long, provider_asn long"),
        table([(1, 2, -1, 4, 3)], "asn1 long, asn2 long, rel int, paths_count long, peers_count long"), table([(1, "one", "N1"), (9, "nine", None)], "asn long, name string, country string"),
        table([], "asn long, name string, org_id string, org_name string, country string"), table([], "asn long, name string, name_long string, aka string"),
    )
    rows = {r["asn"]: r.asDict(recursive=True) for r in reports.inspect_asns(table([(1,), (9,), (1,)], "asn long"), data).collect()}
    assert set(rows) == {1, 9}
    assert rows[9]["roas"] == {"roas": 0, "ipv4": 0, "ipv6": 0} and rows[9]["as_name"] == "nine" and rows[9]["neighbours"] is None and rows[9]["providers"] is None and rows[9]["announced"] is None
    assert rows[1]["roas"] == {"roas": 1, "ipv4": 1, "ipv6": 0} and rows[1]["neighbours"] == {"upstream": 1} and rows[1]["provider_asns"] == [2] and rows[1]["announced"]["valid"] == 1
    assert [t["neighbour"] for t in rows[1]["top_neighbours"]] == [2] and [r["prefix"] for r in rows[1]["first_roas"]] == ["10.0.0.0/16"]
    one = reports.inspect_asns(table([(9,)], "asn long"), data, sections=("roas",))
    assert one.columns == ["asn", "as_name", "country", "roas", "first_roas"] and one.first()["roas"]["roas"] == 0
    assert reports.inspect_asns(table([(9,)], "asn long"), data, sections=()).columns == ["asn", "as_name", "country"]
