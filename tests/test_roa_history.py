import random

from pathloom.operators import roa_history, rov
from pathloom.sources import ingest

DAYS = [f"2024-01-{d:02d}" for d in (1, 2, 3, 5, 6, 9, 10)]
SCHEMA = "prefix string, max_length int, origin_asn long, ta string, date string, source string, collector string"


def tables(seed):
    r = random.Random(seed)
    roas = [(f"10.{i % 6}.{i}.0/24" if i % 3 else f"10.{i % 6}.0.0/16", r.choice([16, 24, None]), 64500 + i % 4, "t") for i in range(25)]
    rows = [(*roa, day, *series) for roa in roas for series in (("ripe", ""), ("rpkiviews", "a"), ("rpkiviews", "b")) for day in DAYS if r.random() < 0.6 and not (series[1] == "b" and day > "2024-01-05")]
    return rows + rows[:10]


def rows_of(df):
    return sorted((str(x) for x in df.select("prefix", "max_length", "origin_asn", "ta", "source", "collector", "first_day", "last_day", "until").collect()))


def test_intervals_are_the_daily_tables(spark):
    rows = tables(1)
    dated = spark.createDataFrame(rows, SCHEMA)
    held = roa_history.intervals(dated).cache()
    for day in DAYS:
        got = {tuple(x) for x in roa_history.at_day(held, day).select("prefix", "max_length", "origin_asn", "ta", "source", "collector").collect()}
        want = set()
        for series in (("ripe", ""), ("rpkiviews", "a"), ("rpkiviews", "b")):
            own = max(r[4] for r in rows if r[5:] == series and r[4] <= day)
            want |= {(*r[:4], *r[5:]) for r in rows if r[5:] == series and r[4] == own}
        assert got == want
    # a run is broken only by a table that lacks the ROA; intervals of a ROA don't overlap
    assert held.where("last_day >= until").count() == 0
    day = {tuple(x)[:4] for x in ingest.roa_snapshot(dated, "2024-01-05", "ripe").select("prefix", "max_length", "origin_asn", "ta").collect()}
    assert {tuple(x) for x in roa_history.at_day(held, "2024-01-05").where("source = 'ripe'").select("prefix", "max_length", "origin_asn", "ta").collect()} == day


def test_a_day_more_is_the_whole_again(spark):
    dated = spark.createDataFrame(tables(2), SCHEMA)
    held = roa_history.intervals(dated.where("date <= '2024-01-05'"))
    for day in DAYS[4:6]:
        held = roa_history.with_day(held, dated.where(f"date = '{day}'"), day)
        held = spark.createDataFrame(held.collect(), held.schema)
    assert rows_of(held) == rows_of(roa_history.intervals(dated.where("date <= '2024-01-09'")))


def test_validation_at_the_own_day(spark):
    rows = tables(3)
    dated = spark.createDataFrame(rows, SCHEMA)
    held = roa_history.intervals(dated).where("source = 'ripe'")
    r = random.Random(5)
    pairs = [(r.choice([f"10.{r.randrange(7)}.{r.randrange(25)}.0/24", f"10.{r.randrange(7)}.0.0/16", "11.0.0.0/8", "none"]), r.choice([64500, 64501, 64502, 64503, 0, None]), r.choice([*DAYS, "2023-12-31", "2024-01-04", "2024-02-01", None])) for _ in range(300)]
    df = spark.createDataFrame(pairs, "prefix string, origin_asn long, day string")
    got = sorted(str(tuple(x)) for x in roa_history.validated_at(df, held).collect())
    want = []
    for day in {p[2] for p in pairs}:
        tables_before = [x[4] for x in rows if x[5] == "ripe" and day is not None and x[4] <= day]
        own = dated.where(f"source = 'ripe' AND date = '{max(tables_before)}'") if tables_before else dated.limit(0)
        some = spark.createDataFrame([p for p in pairs if p[2] == day], df.schema)
        want += [str(tuple(x)) for x in rov.validated(some, own.drop("date", "source", "collector")).select("prefix", "origin_asn", "day", "state").collect()]
    assert got == sorted(want)
    assert roa_history.intervals(dated.limit(0)).count() == 0
    assert {x["state"] for x in roa_history.validated_at(df, held.limit(0)).collect()} == {"not_found"}
