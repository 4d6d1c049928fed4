"""The pipeline's stages against brute force on a small corpus, and on an empty one."""

import json
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinweave.llm import queries
from kinweave.llm.oracle import ORACLE


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(4)
    prose = lambda: " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) + ("." if rng.random() < 0.1 else "") for _ in range(60))
    rows = [(i, prose(), "de", f"src{i % 3}", 1) for i in range(200)]
    rows += [(1000 + i, " ".join(w + "%%%" for w in prose().split()), "de", "src1", 1) for i in range(50)]
    rows += [(2000, rows[5][1].replace(" ", "  "), "de", "src0", 1), (2001, rows[7][1] + " ende", "de", "src0", 1), (2002, None, None, None, None), (2003, "", None, "src0", 0)]
    path = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    docs.where("doc_id < 2000").select("doc_id", (F.col("doc_id") < 1000).cast("int").alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{path}/labels.parquet")
    return str(path), rows


def test_stages(spark, corpus):
    path, rows = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumn("row", F.lit("clash"))
    names = docs.columns
    seen = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, path)
        if i < 4:
            assert docs.columns == names, name
        docs = corpus_pipeline.materialise(docs, "test")
        seen.append([r.doc_id for r in docs.select("doc_id").collect()])
    good, exact, near, mix, last = seen
    assert set(range(200)) <= set(good) and not any(1000 <= d < 2000 for d in good)
    assert 5 not in exact and 2000 in exact  # the longer original stays
    assert 2001 not in near and {7, 2000} <= set(near)
    assert set(mix) <= set(near) and max(mix.count(d) for d in set(mix)) <= 2
    assert sorted(map(str, last)) == sorted(map(str, mix)) and docs.where("NOT round_trip").isEmpty()


def test_run_equals_stages(spark, corpus):
    path, _ = corpus
    out = corpus_pipeline.run(spark, path)
    assert out.columns == ["doc_id", "source", "ids", "n_ids", "round_trip"] and out.count() > 200
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_empty_corpus(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_agree_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    rel = con.sql(ORACLE[name])
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    key = lambda rows: sorted(json.dumps([None if v is None else v for v in r], default=str) for r in rows)
    at = [rel.columns.index(c) for c in cols]
    assert key([[r[c] for c in cols] for r in df.collect()]) == key([[r[i] for i in at] for r in rel.fetchall()])
