"""The pipeline on a small corpus, and its queries beside their SQL."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from opsloom.llm.catalog import QUERIES, SQL_TWINS
from tests.parity import compare, twin_connection

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL_TWINS))
def test_same_as_sql(spark, name):
    text, same = compare(spark, twin_connection(FOLDER), name, QUERIES[name], SQL_TWINS[name], FOLDER)
    assert same, text


def test_entry_has_all_queries():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14))


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    tests = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    plain = docs.where(F.length("text") > 400).orderBy("doc_id").limit(30).collect()
    leak = tests.first().text
    planted = [
        (9001, "12 34 -- !!", "en", "x", 1),
        (9002, None, "en", "x", 0),
        (9003, "漢字の文書です。これは別の言語で書かれています。漢字の文書。", "en", "x", 3),
        (9004, plain[0].text, "en", "x", 5),
        (9005, " ".join(plain[1].text.replace("\n", " ").split() + ["and"]), "en", "x", 5),
        (9006, plain[2].text.split("\n")[0] + "\n" + leak + "\n" + "thonor thing eablent the shered onwhat", "en", "x", 5),
        (None, "A row without an id stands here with some words of its own thing and the other.", "en", "x", 5),
    ]
    spark.createDataFrame([tuple(r) for r in docs.collect()] + planted, docs.schema).write.parquet(f"{tmp_path}/documents.parquet")
    tests.write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, str(tmp_path))
        rows.write.parquet(f"{tmp_path}/{name}")
        rows = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id for r in rows.select("doc_id").collect()}
        if name != "pack":
            assert rows.columns == docs.columns
    assert not {9001, 9002, 9003} & kept["language"] and {9004, 9005, 9006, None} <= kept["language"]
    assert len(kept["language"]) == docs.count() + 4
    assert 9004 not in kept["line_dedup"] and {9005, 9006} <= kept["line_dedup"]
    assert len({plain[1].doc_id, 9005} & kept["near_dedup"]) == 1
    assert 9006 in kept["near_dedup"] and 9006 not in kept["decontaminate"]
    assert kept["pack"] == kept["decontaminate"]
    assert rows.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").isEmpty()
    texts = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/line_dedup").collect()}
    assert all(r.n_chars == len(r.text) for r in texts.values())
    lines = [line for r in texts.values() for line in r.text.split("\n") if len(line) >= 24]
    assert len(lines) == len(set(lines))


def test_run_equals_its_stages(spark, tmp_path):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, rows, FOLDER).write.parquet(f"{tmp_path}/{name}")
        rows = spark.read.parquet(f"{tmp_path}/{name}")
    whole = lambda df: sorted(tuple(r) for r in df.groupBy("doc_id").agg(F.sum("length"), F.max("doc_tokens")).collect())
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.columns == rows.columns and whole(got) == whole(rows) != []
    assert corpus_pipeline.ORACLE_SQL is None
