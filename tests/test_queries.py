"""Every query with SQL against DuckDB on the smallest tables; every other one runs and gives rows."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.functions import columns as C
from tessella.operators import joins, trajectory
from tessella.plans.catalog import ORACLES, QUERIES
from tessella.sources import tables
from tessella.streaming.composition import windowed_composition

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def ordered(df):
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), key=lambda s: s.round(4).astype(str) if s.dtype.kind == "f" else s.astype(str)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got, want = ordered(QUERIES[name](spark, SF).toPandas()), ordered(duck.execute(ORACLES[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        if got[c].dtype.kind == "f" or want[c].dtype.kind == "f":
            assert np.allclose(pd.to_numeric(got[c]).astype(float), pd.to_numeric(want[c]).astype(float), atol=2e-6, equal_nan=True), c
        else:
            assert got[c].astype(str).tolist() == want[c].astype(str).tolist(), c


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    if name == "stratified_subsample":
        assert QUERIES[name](spark, SF).count() <= 200
    else:
        assert QUERIES[name](spark, SF).count() > 0


def test_columns(spark):
    df = spark.createDataFrame([("chr1-5-9", "ENSG0001.4", " 3.0"), ("chr1-5", "actb", None), ("X_7_9", "Gapdh", "severe"), ("chr2:9-7", "", "nan")], "p string, g string, s string")
    out = df.select(C.parse_peak(F.col("p")).alias("a"), C.parse_region(F.col("p")).alias("b"), C.gene_key(F.col("g")).alias("g"), C.clean_string(F.col("s")).alias("s"), C.severity(F.col("s"), {"severe": 4}).alias("v")).collect()
    assert [r["a"] and tuple(r["a"]) for r in out] == [("1", 5, 9), None, None, None]
    assert [r["b"] and tuple(r["b"]) for r in out] == [("chr1", 5, 9), None, ("chrX", 7, 9), None]
    assert [r["g"] for r in out][:3] == ["ENSG0001", "ACTB", "GAPDH"] and [r["s"] for r in out] == ["3", "Unknown", "severe", "Unknown"]
    assert out[0]["v"] == 3.0 and out[2]["v"] == 4.0 and out[1]["v"] is None


def test_sources(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("﻿ sample \tpseudo_time\na\t1.5\nb\tx\na\t9\nc\t2\n", encoding="utf-8")
    got = {r["sample"]: r["pseudotime"] for r in tables.read_pseudotime(spark, str(tmp_path / "m.tsv")).collect()}
    assert got == {"a": 1.5, "c": 2.0} and tables.read_pseudotime(spark, {"u": 1}).count() == 1
    assert tables.load_config(tables.config_template()) == tables.RunConfig()
    with pytest.raises(ValueError):
        tables.load_config(tables.config_template() + "\nodd: 1\n")
    status = str(tmp_path / "status")
    tables.write_status(spark, status, {"a": True})
    assert tables.write_status(spark, status, {"b": False}) == {"a": True, "b": False}
    frames = {n: spark.range(3).withColumnRenamed("id", "cell_id") for n in ("counts", "cells", "features")}
    tables.write_matrix(frames, str(tmp_path / "x"))
    assert tables.read_matrix(spark, str(tmp_path / "x"))["cells"].count() == 3


def test_gene_mapping_policies(spark):
    f = spark.createDataFrame([("A",), ("B",), ("C",)], "feature_id string")
    m = spark.createDataFrame([("a", "E1"), ("b", "E1"), ("a", "E9")], "symbol string, gene_id string")
    ids = lambda policy: sorted(r["gene_id"] for r in joins.map_genes(f, m, policy).collect())
    assert ids("first") == ["E1"] and ids("keep") == ["E1", "E1"] and ids("suffix") == ["E1", "E1-1"]
    with pytest.raises(ValueError):
        joins.map_genes(f, m, least=0.9)


def test_stream_of_compositions(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    out = windowed_composition(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "ts", "user_id", "event_type", "1 day")
    q = out.writeStream.outputMode("complete").format("memory").queryName("comp").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("comp").agg(F.sum("n")).first()[0] == spark.read.parquet(str(tmp_path / "in")).count()


def test_trends_find_a_trend(spark):
    values = spark.createDataFrame([(u, f, float(1 + u * (f == "up") + (u * 37 % 11) * 0.01)) for u in range(30) for f in ("up", "flat")], "unit long, feature string, value double")
    pt = spark.range(30).selectExpr("id as unit", "id / 29.0 as pseudotime")
    got = {r["feature"]: r for r in trajectory.gam_trends(values, pt).collect()}
    assert got["up"]["p"] < 1e-6 < got["flat"]["p"] and got["up"]["direction"] == "UP"
