import random

import pytest
from pyspark.sql import functions as F

from pathloom.operators import rib
from pathloom.sources.snapshots import SnapshotStore

SCHEMA = "seq long, ts long, collector string, peer_ip string, peer_asn long, prefix string, path_id long, elem_type string, origin_asns array<long>"


def events(seed, n=300):
    r = random.Random(seed)
    kinds = [("A", 0)] * 60 + [(("A" if r.random() < 0.6 else "W"), 1 + i * 100 // (n - 60)) for i in range(n - 60)]
    return [(i, t, "c", f"192.0.2.{r.randrange(3)}", 1, f"10.{r.randrange(12)}.0.0/16", r.choice([None, 7]), k, None if k == "W" else [r.choice([1, 2, 3])]) for i, (k, t) in enumerate(kinds)]


def rows_of(df):
    return sorted(str((r["peer_ip"], r["prefix"], r["path_id"], r["origin_asns"])) for r in df.collect())


def test_replay_from_the_nearest_table(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    rows = spark.createDataFrame(events(1), SCHEMA).withColumn("ts", F.timestamp_seconds("ts"))
    base, updates = rows.where("seq < 60").drop("elem_type"), rows.where("seq >= 60")
    full = lambda at, match=None: rib.snapshot(rib.events_of(base, updates.where(F.col("ts") <= F.timestamp_seconds(F.lit(at))), match), ["origin_asns"])
    store = SnapshotStore(spark, "kept_routes", str(tmp_path / "kept"), ("origin_asns",), 4)
    assert store.instants() == [] and store.nearest(5) is None
    store.write(full(0), 0)
    for at in (30, 60):
        store.extend(updates, at)
    assert store.instants() == [0, 30, 60] and store.nearest(59) == 30
    for at in (30, 45, 60, 99, 200):
        assert rows_of(store.replayed(updates, at)) == rows_of(full(at))
    two = F.array_contains("origin_asns", 2)
    assert rows_of(store.replayed(updates, 77, two)) == rows_of(full(77, two))
    with pytest.raises(ValueError):
        store.replayed(updates, -1)
    # the kept table stays where it lies: only the updates are moved, once
    found = store.replayed(updates, 99)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    # another session finds the tables by their folder
    for at in (0, 30, 60):
        spark.sql(f"DROP TABLE kept_routes_{at}")
    store.attach()
    assert rows_of(store.replayed(updates, 99)) == rows_of(full(99)) and rows_of(store.at(60)) == rows_of(full(60))
    again = store.replayed(updates, 99)
    again.collect()
    assert again._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1
    for at in (0, 30, 60):
        spark.sql(f"DROP TABLE kept_routes_{at}")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
