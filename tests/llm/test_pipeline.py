import sys
from pathlib import Path

import brute
import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
from compare import same_rows  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline  # noqa: E402
from tessera.llm import registry, toxicity, urlfilter  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, name):
    same_rows(registry.QUERIES[name](spark, FOLDER), registry.ORACLE_SQL[name], FOLDER)


def test_odd_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://NET/x"), (5, "http://a.Net?q"), (6, "x://b.example.net/en/1#f"), (7, "http://net"), (8, "http://b.org/fr/?x"), (9, "ftp://c.example.com/de/a/b"), (10, "http://notnet.nett/"), (10, "http://notnet.nett/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    rules = spark.createDataFrame(urlfilter.RULES, "host string, path string, verdict string")
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge_urls(pages, rules).collect())
    assert got == [
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "net", "/x", "net/", "block"), (5, "a.net", "", None, "allow"),
        (6, "b.example.net", "/en/1", "example.net/en/", "allow"), (7, "net", "", None, "allow"), (8, "b.org", "/fr/", "org/fr/", "allow"),
        (9, "c.example.com", "/de/a/b", "example.com/de/", "block"), (10, "notnet.nett", "/", None, "allow"), (10, "notnet.nett", "/", None, "allow"),
    ]
    assert urlfilter.judge_urls(pages, rules.limit(0)).where("verdict = 'allow'").count() == len(rows)


def test_long_hosts_have_few_expressions(spark):
    rows = [(1, "http://" + "a." * 20_000 + "net/x"), (1, "http://" + "a." * 20_000 + "net/x"), (2, "http://example.net/en/x")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit(1), "rule": F.lit(2), "verdict": F.lit("x")})
    rules = spark.createDataFrame(urlfilter.RULES, "host string, path string, verdict string")
    assert sorted((r["page_id"], r["rule"]) for r in urlfilter.judge_urls(pages, rules).collect()) == [(1, "net/"), (1, "net/"), (2, "example.net/en/")]
    assert urlfilter.judge_urls(pages.limit(0), rules).count() == 0


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    clean = corpus_pipeline.drop_toxic(spark, docs, FOLDER)
    assert clean.columns == docs.columns
    model = toxicity.train(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(docs.select("doc_id", "text"), model).collect()}
    assert {r["doc_id"] for r in clean.collect()} == {d for d, s in scored.items() if s < toxicity.THRESHOLD}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    once = corpus_pipeline.drop_near_copies(spark, docs, FOLDER)
    assert once.columns == docs.columns
    assert {r["doc_id"] for r in once.collect()} == {d for d, (_, c) in brute.near_duplicates(rows).items() if c == d}
    assert corpus_pipeline.run(spark, FOLDER).select("sequence_id").distinct().count() > 0


def test_odd_rows_of_the_pipeline(spark, tmp_path):
    copy = "one two three four five six seven"
    rows = [(1, copy), (2, copy), (2, "another text that nobody else has at all"), (2, None), (3, None), (4, ""), (4, " \t"), (None, copy), (5, "some words here")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    clash = {"_toxicity": F.lit(1.0), "_text_key": F.lit("k"), "_spans": F.lit(1), "_span_doc": F.lit(2), "class": F.lit("c"), "component_id": F.lit(0)}
    docs = spark.createDataFrame([(*r, "en", "web", 3) for r in rows], schema).withColumns(clash)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns
        want = [r for r in rows if stage is not corpus_pipeline.drop_near_copies or r != (2, copy)]
        assert sorted(map(str, kept.select("doc_id", "text").collect())) == sorted(map(str, docs.sparkSession.createDataFrame(want, "doc_id long, text string").collect()))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(d) for d, t in rows if (d, t) != (2, copy))
    # labels of one class are no evidence either
    spark.createDataFrame([(1, 1, 1), (5, 1, 1)], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == len(rows)


def test_blank_texts_are_not_toxic(spark, tmp_path):
    docs = spark.createDataFrame([(i, "foul words" if i % 2 else "") for i in range(40)] + [(50, None), (51, " \n")], "doc_id long, text string")
    spark.createDataFrame([(i, 1, 1 if i % 2 or i < 30 else 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in kept) == [*range(0, 40, 2), 50, 51]


def test_empty_tables_of_the_pipeline(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
