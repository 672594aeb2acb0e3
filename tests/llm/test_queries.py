"""The registered queries against their SQL, and the pipeline's stages by their effects."""

import duckdb
import pytest

import corpus_pipeline
from maskloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(queries.oracle_sql()[name])
    at = [rel.columns.index(c) for c in cols]
    assert sorted(rel.columns) == cols
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(tuple(r[i] for i in at) for r in rel.fetchall())


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF)
        docs.write.parquet(out := str(tmp_path / name))
        docs = spark.read.parquet(out)
        if name != "packing":
            assert docs.columns == before.columns
            ids = [r.doc_id for r in docs.select("doc_id").collect()]
            assert len(ids) == len(set(ids)) and set(ids) <= set(texts)
            counts.append(len(ids))
    assert counts[0] >= counts[1] == counts[2] >= counts[3] > 0
    assert docs.count() > 0 and corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Every stage takes nulls in any column, texts without words, repeated rows, clashing extra columns, and an empty table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (9001, " \n", None, "src1", None), (9002, "x" * 9000, None, None, 9000), (9003, None, "de", "src2", None)], docs.schema)
    table = docs.unionByName(odd).unionByName(docs.limit(3)).selectExpr("*", "'a' as __d", "1 as __tok", "'t' as id", "2 as epoch")
    for at, df in (("odd", table), ("empty", table.limit(0))):
        for name, stage in corpus_pipeline.STAGES:
            before, df = df, stage(spark, df, SF)
            assert name == "packing" or df.columns == before.columns
            df.write.parquet(out := str(tmp_path / at / name))
            df = spark.read.parquet(out)
        assert (df.count() > 0) == (at == "odd")
