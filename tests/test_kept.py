import random

from pyspark.sql import functions as F

from pathloom.operators import asinfo, search
from pathloom.operators.running import RunningStatistics
from pathloom.sources import name_index
from pathloom.sources.name_index import NameIndex, _part


def test_running_statistics_are_those_of_all(spark, tmp_path):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), r.choice([None, *[f"10.{i}.0.0/16" for i in range(90)]]), r.choice([1, 2, 3, None]), r.randrange(4)) for _ in range(900)]
    df = spark.createDataFrame(rows, "collector string, prefix string, peer_asn long, part int").cache()
    kept = RunningStatistics(spark, str(tmp_path / "kept"))
    for n in (0, 1, 2, 2, 3):
        kept.add(df.where(f"part = {n}"), n)
        some = df.where(f"part <= {n}")
        assert sorted(map(str, kept.totals().collect())) == sorted(map(str, search.by_collector(some).collect()))
    assert sorted(map(str, kept.totals([1, 3]).collect())) == sorted(map(str, search.by_collector(df.where("part IN (1, 3)")).collect()))
    codes = sorted(x["code"] for x in kept._codes().collect())
    assert codes == list(range(len(codes)))


def names(spark, seed, n=120):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abÄn -") for _ in range(r.randrange(1, 9)))
    core = spark.createDataFrame([(i, r.choice([None, word()]), "NL") for i in range(n)], "asn long, name string, country string")
    org = spark.createDataFrame([(i, word(), r.choice(["", word()])) for i in range(0, n, 2)], "asn long, name string, org_name string")
    pdb = spark.createDataFrame([(i, word(), r.choice([None, word()]), "x") for i in range(0, n, 3)], "asn long, name string, name_long string, aka string")
    return core, org, pdb


def test_kept_names_are_those_of_a_search(spark, tmp_path):
    core, org, pdb = names(spark, 1)
    changed, _, _ = names(spark, 2)
    index = NameIndex(spark, str(tmp_path / "names"))
    index.build(core, org, pdb)
    texts = ["a", "AB", "n-", "ban", "äna", "", "ab n", "zz", "z", "abzab", " "]
    asked = spark.createDataFrame([(t,) for t in texts + ["a"]], "input string")

    def check(core):
        got = sorted((x["input"], x["asn"]) for x in index.search(asked).collect())
        assert got == sorted((t, x["asn"]) for t in texts if t for x in asinfo.text_search(core, org, pdb, t).collect())

    check(core)
    for part in ("asn % 4 = 0", "asn % 6 < 2"):
        # of the changed ones some are gone
        core = core.where(f"NOT ({part})").unionByName(changed.where(f"{part} AND asn % 5 > 0"))
        core = spark.createDataFrame(core.collect(), core.schema)
        index.update(changed.where(part).select("asn"), core, org, pdb)
        check(core)


def test_a_search_opens_its_partitions_alone(spark, tmp_path):
    core, org, pdb = names(spark, 3)
    index = NameIndex(spark, str(tmp_path / "names"))
    index.build(core, org, pdb)
    asked = spark.createDataFrame([("ban",)], "input string")
    want = sorted(x["asn"] for x in index.search(asked).collect())
    own = {r["p"] for r in spark.range(1).select(_part(F.lit("ban")).alias("p")).collect()}
    broken = 0
    for table in ("postings", "counts"):
        for f in (tmp_path / "names" / table).rglob("*.parquet"):
            if int(f.parent.name.removeprefix("part=")) not in own:
                f.write_bytes(b"PAR1 broken PAR1")
                broken += 1
    assert broken > 20 and sorted(x["asn"] for x in index.search(asked).collect()) == want


def test_postings_are_dealt_to_files_by_their_number(spark, tmp_path, monkeypatch):
    """A task sorts a bounded number of postings, however many a partition or a run has."""
    core, org, pdb = names(spark, 5, 400)
    monkeypatch.setattr(name_index, "FILE_ROWS", 100)
    index = NameIndex(spark, str(tmp_path / "names"))
    index.build(core, org, pdb)
    rows = spark.read.parquet(f"{index.path}/postings").withColumn("file", F.input_file_name())
    sizes = [r["count"] for r in rows.groupBy("file").count().collect()]
    often = rows.where("gram = 'a'")
    assert often.select("file").distinct().count() > 4 and often.count() > 200
    assert max(sizes) < 300
    asked = spark.createDataFrame([("a",), ("an",), ("bä",)], "input string")
    want = [(t, r["asn"]) for t in ("a", "an", "bä") for r in asinfo.text_search(core, org, pdb, t).collect()]
    assert sorted((r["input"], r["asn"]) for r in index.search(asked).collect()) == sorted(want)
