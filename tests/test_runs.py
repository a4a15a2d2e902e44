import datetime

import pytest
from pyspark.sql import functions as F

from pathloom.operators.filters import RouteFilters
from pathloom.plans import runs
from pathloom.sources import ingest
from pathloom.sources.store import ElementStore

DAY = datetime.datetime(2024, 1, 1)


def at(hours):
    return DAY + datetime.timedelta(hours=hours)


def elem(hours, kind, prefix, origin=None, collector="c"):
    origin = None if kind == "W" else [origin]
    return (at(hours).replace(tzinfo=datetime.timezone.utc).timestamp(), kind, collector, "192.0.2.1", 1, prefix, None, None, None if kind == "W" else f"1 {origin[0]}", origin, None, None, None, None, None, None, None)


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("run")
    files = {
        "rib0": ("rib", 0, 0, [elem(-50, "A", "10.0.0.0/8", 5), elem(-40, "A", "11.0.0.0/8", 6)]), "rib8": ("rib", 8, 8, [elem(-50, "A", "10.0.0.0/8", 7)]),
        "u1": ("updates", 0, 4, [elem(1, "W", "10.0.0.0/8"), elem(2, "A", "12.0.0.0/8", 5), elem(2, "A", "12.0.0.0/8", 6)]),
        "u2": ("updates", 4, 8, [elem(5, "A", "11.0.0.0/8", 5), elem(6, "W", "13.0.0.0/8"), elem(7, "A", "10.0.0.0/8", 5)]), "u3": ("updates", 8, 12, [elem(9, "W", "10.0.0.0/8"), elem(11, "A", "14.0.0.0/8", 9)]),
    }
    rows = []
    for name, (kind, start, end, elems) in files.items():
        spark.createDataFrame(elems, ingest.ELEM_SCHEMA).coalesce(1).write.parquet(str(folder / name))
        path = next((folder / name).glob("part-*.parquet"))
        rows.append(("c", kind, at(start), at(end), str(path), 100, 0 if name == "u2" else 90))
    return spark.createDataFrame(rows, "collector_id string, data_type string, ts_start timestamp, ts_end timestamp, url string, rough_size long, exact_size long")


@pytest.fixture(scope="module")
def store(spark, catalog, tmp_path_factory):
    found = ElementStore(spark, str(tmp_path_factory.mktemp("store") / "elements"))
    found.add(catalog.where("data_type = 'rib'"))
    found.add(catalog.where("data_type = 'updates'"))
    return found


def table(df):
    return sorted((r["rib_ts"].hour, r["prefix"], r["origin_asns"][0]) for r in df.collect())


def test_tables_at_instants(spark, catalog):
    instants = [F.lit(at(h)) for h in (3, 6, 10)]
    routes, updates = runs.routing_tables(spark, catalog, instants, RouteFilters(), ["origin_asns"])
    assert table(routes) == [(3, "11.0.0.0/8", 6), (3, "12.0.0.0/8", 6), (6, "11.0.0.0/8", 5), (6, "12.0.0.0/8", 6)]
    assert sorted((r["rib_ts"].hour, r["prefix"]) for r in updates.collect()) == [(6, "11.0.0.0/8"), (10, "10.0.0.0/8")]
    some, _ = runs.routing_tables(spark, catalog, instants[:2], RouteFilters(origin_asns=["6"]), ["origin_asns"])
    assert table(some) == [(3, "11.0.0.0/8", 6), (3, "12.0.0.0/8", 6), (6, "12.0.0.0/8", 6)]
    asinfo = spark.createDataFrame([(5, "x", "NL")], "asn long, name string, country string")
    own, _ = runs.routing_tables(spark, catalog, instants[1:2], RouteFilters(), ["origin_asns"], asinfo=asinfo, country="nl")
    assert table(own) == [(6, "11.0.0.0/8", 5)]
    with pytest.raises(ValueError):
        runs.routing_tables(spark, catalog, [F.lit(at(-1))], RouteFilters(), ["origin_asns"])


def test_a_store_gives_what_the_files_give(spark, catalog, store):
    instants = [F.lit(at(h)) for h in (3, 6, 10)]
    for wanted in (RouteFilters(), RouteFilters(origin_asns=["6"])):
        of_files, of_store = (runs.routing_tables(spark, catalog, instants, wanted, ["origin_asns"], store=s) for s in (None, store))
        for a, b in zip(of_files, of_store, strict=True):
            rows = lambda df: sorted(str(sorted(r.asDict().items())) for r in df.drop("seq", "place", "file").collect())
            assert rows(a.select(sorted(a.columns))) == rows(b.select(sorted(a.columns)))
    wanted = RouteFilters(start_ts="2024-01-01T02:00:00Z", end_ts="2024-01-01T05:00:00Z", elem_type="a")
    of_files, of_store = (runs.search_files(spark, catalog, wanted, store=s).elements for s in (None, store))
    rows = lambda df: sorted((r["file"], r["place"], r["prefix"]) for r in df.collect())
    assert rows(of_files) == rows(of_store) != []


def test_other_partitions_of_a_store_are_not_opened(spark, tmp_path, monkeypatch):
    """The catalog says at run time which partitions are read: the files of others may be broken, and no path is collected."""
    rows = []
    for day in range(6):
        for collector in ("c", "d"):
            path = str(tmp_path / f"{collector}{day}")
            spark.createDataFrame([elem(24 * day + 1, "A", f"10.{day}.0.0/16", 5, collector)], ingest.ELEM_SCHEMA).coalesce(1).write.parquet(path)
            rows.append((collector, "updates", at(24 * day), at(24 * day + 23), str(next((tmp_path / f"{collector}{day}").glob("part-*.parquet"))), 1, 1))
    spark.createDataFrame(rows, "collector_id string, data_type string, ts_start timestamp, ts_end timestamp, url string, rough_size long, exact_size long").write.parquet(str(tmp_path / "catalog"))
    catalog = spark.read.parquet(str(tmp_path / "catalog"))
    store = ElementStore(spark, str(tmp_path / "store"))
    store.add(catalog)
    for f in (tmp_path / "store").rglob("*.parquet"):
        if "collector_id=c" not in str(f) or not ("file_day=2024-01-03" in str(f) or "file_day=2024-01-04" in str(f)):
            f.write_bytes(b"PAR1 broken PAR1")
    monkeypatch.setattr(type(catalog), "collect", lambda self: pytest.fail("a selection came to the driver"))
    found = runs.search_files(spark, catalog, RouteFilters(start_ts="2024-01-03T00:00:00Z", end_ts="2024-01-04T22:00:00Z"), ["c"], store=store).elements
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
    monkeypatch.undo()
    assert sorted(r["prefix"] for r in found.collect()) == ["10.2.0.0/16", "10.3.0.0/16"]


def test_first_elements_of_many_files(spark, tmp_path):
    """Exactly so many, in the order of files and elements; the files behind are never opened."""
    rows = []
    for n in range(9):
        path = tmp_path / f"f{n}"
        spark.createDataFrame([elem(n, "A" if i % 2 else "W", f"10.{n}.{i}.0/24", 5) for i in range(10)], ingest.ELEM_SCHEMA).coalesce(1).write.parquet(str(path))
        file = next(path.glob("part-*.parquet"))
        if n >= 7:
            file.write_bytes(b"PAR1 broken PAR1")
        rows.append(("c", "updates", at(n), at(n + 1), str(file), 1, 1))
    catalog = spark.createDataFrame(rows[::-1], "collector_id string, data_type string, ts_start timestamp, ts_end timestamp, url string, rough_size long, exact_size long")
    found = runs.search_first(spark, catalog, RouteFilters(elem_type="a"), 18)
    want = [f"10.{n}.{i}.0/24" for n in range(9) for i in range(10) if i % 2][:18]
    assert sorted(r["prefix"] for r in found.elements.collect()) == sorted(want) and found.files.count() == 7
    assert runs.search_first(spark, catalog.where("ts_start < '2024-01-01 02:30:00'"), RouteFilters(elem_type="w"), 100).elements.count() == 15
    assert runs.search_first(spark, catalog, RouteFilters(), 0).elements.count() == 0
    assert runs.search_first(spark, catalog, RouteFilters(start_ts="2030-01-01"), 5).elements.count() == 0


def test_search_and_parse(spark, catalog):
    found = runs.search_files(spark, catalog, RouteFilters(start_ts="2024-01-01T02:00:00Z", end_ts="2024-01-01T05:00:00Z", elem_type="a"))
    assert sorted((r["prefix"], r["origin_asns"][0]) for r in found.elements.collect()) == [("11.0.0.0/8", 5), ("12.0.0.0/8", 5), ("12.0.0.0/8", 6)]
    assert found.by_file().count() == 2 and tuple(found.source_bytes().first()) == (2, 190, False, 200)
    assert found.by_collector().first()["matched"] == 3
    assert runs.search_files(spark, catalog, RouteFilters(start_ts="2030-01-01")).elements.count() == 0
    assert runs.search_files(spark, catalog, RouteFilters(start_ts="2024-01-01", end_ts="2024-01-01T01:00:00Z"), data_type="rib").elements.count() == 2
    paths = [r["url"] for r in catalog.where("data_type = 'updates'").collect()]
    rows = runs.parse_files(spark, paths, RouteFilters(elem_type="w"), "type,prefix", "prefix", True).collect()
    assert [tuple(r) for r in rows] == [("W", "13.0.0.0/8"), ("W", "10.0.0.0/8"), ("W", "10.0.0.0/8")]


def test_files_not_elements_are_shared(spark, catalog):
    """Elements of few bytes were broadcast, and the rows of files took them through a task or two."""
    routes, _ = runs.routing_tables(spark, catalog, [F.lit(at(3)), F.lit(at(10))], RouteFilters(), ["origin_asns"])
    joins = [line for line in routes._jdf.queryExecution().executedPlan().toString().splitlines() if "Join [__key#" in line]
    assert len(joins) == 2 and all("BroadcastHashJoin" in line and "BuildRight" in line for line in joins)
    assert table(routes.where(F.hour("rib_ts") == 3)) == [(3, "11.0.0.0/8", 6), (3, "12.0.0.0/8", 6)]
