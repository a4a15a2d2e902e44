import __spark_entry__
import corpus_pipeline
from pathloom.llm import exact_dedup, language_id, simhash

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], DATA).write.parquet(str(tmp_path / name))
        kept.append(spark.read.parquet(str(tmp_path / name)))
        assert n == len(corpus_pipeline.STAGES) - 1 or kept[-1].columns == columns
    start, lang, exact, near, mixed, tokens = kept
    found = language_id.identify_languages(start)
    assert lang.count() == found.where("lang_pred <> 'und' AND score >= 0.5").count() >= start.count() - 5
    assert {r["doc_id"] for r in exact.collect()} == {r["doc_id"] for r in exact_dedup.exact_duplicates(lang).where("kept").collect()}
    assert exact.select("text").distinct().count() == exact.count() == lang.select("text").distinct().count()
    assert {r["doc_id"] for r in near.collect()} == {r["component_id"] for r in simhash.near_duplicates(exact).collect()}
    assert mixed.select("doc_id").join(near, "doc_id", "left_anti").count() == 0
    assert mixed.groupBy("doc_id").count().where("count > 2").count() == 0
    assert tokens.count() == mixed.count() and tokens.where("text_sha256 <> decoded_sha256").count() == 0


def test_odd_rows_pass_through(spark, odd_docs, no_docs):
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd_docs, DATA).collect()
        assert stage(spark, no_docs, DATA).count() == 0


def test_registered():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names
