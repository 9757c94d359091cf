"""The stages on a small table with planted cases, and the registered queries on the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    columns = want.columns
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    key = lambda row: [str(v) for v in row]
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=key) == sorted(want.fetchall(), key=key)


def test_pipeline_decisions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    long = " ".join(f"unique{i}" for i in range(120))
    planted = [(9001, long, "en", "s", len(long)), (9002, long.replace("unique60 ", "changed "), "en", "s", 1), (9003, long, "en", "s", len(long)),
               (9004, "before " * 3 + bench + " after", "en", "s", 1), (9005, " ".join(f"w{i}" for i in range(70)) + " " + long[:900], "en", "s", 1),
               (9006, None, "en", "s", None), (9007, "", "en", "s", 0), (9001, long, "en", "s", len(long))]
    rows = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    folder = str(tmp_path)
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    now, seen = rows, {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{folder}/{name}"
        stage(spark, now, folder).write.parquet(path)
        now = spark.read.parquet(path)
        seen[name] = [r.asDict() for r in now.collect()]
        if name != "sentencepiece":
            assert now.columns == docs.columns
    ids = {k: sorted(r["doc_id"] for r in v if r["doc_id"] >= 9000) for k, v in seen.items()}
    assert ids["toxicity"] == [9001, 9001, 9002, 9003, 9004, 9005, 9006, 9007]
    assert ids["simhash_near_dedup"][:1] == [9001] and not {9002, 9003} & set(ids["simhash_near_dedup"]) and ids["simhash_near_dedup"].count(9001) == 1
    text = {r["doc_id"]: r["text"] for r in seen["substring_dedup"]}
    assert text[9001] == long and text[9005].startswith("w0 w1") and "unique3 " not in text[9005]
    assert 9004 not in ids["benchmark_decontamination"] and {9001, 9005} <= set(ids["benchmark_decontamination"])
    assert all(r["round_trip"] for r in seen["sentencepiece"]) and ids["sentencepiece"] == ids["benchmark_decontamination"]


def test_empty_tables(spark, tmp_path):
    for t in ("documents", "labels", "benchmark", "embeddings", "pages", "conversations"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name, query in QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name


CLASHING = ["_id", "_head", "_turn", "_text", "rejected", "p_toxic", "kept", "n_words", "n_removed", "_places", "text_hash", "key", "_c3"]


def test_stages_leave_columns_of_any_name_alone(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).withColumns(
        {c: F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")) for c in CLASHING})
    labels = f"{SF}"
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, labels)
        assert rows.columns == docs.columns and rows.schema == docs.schema, name
        kept = rows.collect()
        assert kept and all(r[c] == f"{c} of {r.doc_id}" for r in kept for c in CLASHING), name
