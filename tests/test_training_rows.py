"""The rows that the registered fits learn from."""

import pytest
from pyspark.sql import functions as F

from checks import catalog
from gradus import schema as S
from gradus.operators import levels
from gradus.session import write_out


@pytest.fixture
def folder(spark, tmp_path):
    i = F.col("id")
    spark.range(4000).select(
        i.alias("o_orderkey"), (i * i % 300).alias("o_custkey"), F.when(i % 3 == 0, "O").otherwise("F").alias("o_orderstatus"),
        (i * 7919 % 400_000).cast("double").alias("o_totalprice"), F.when(i % 2 == 0, "2-HIGH").otherwise("5-LOW").alias("o_orderpriority"),
    ).write.parquet(str(tmp_path / "orders.parquet"))
    return str(tmp_path)


def test_the_points_are_made_once_before_they_are_counted_joined_and_filtered(spark, folder, monkeypatch):
    plans = {}

    def kept(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return write_out(df, name)

    monkeypatch.setattr(catalog, "write_out", kept)
    monkeypatch.setattr(levels, "write_out", kept)
    split = catalog._split(spark, folder)
    assert "o_orderkey" in plans["points"]
    assert "o_orderkey" not in plans["sizes"] and "o_orderkey" not in plans["usable"]
    want = levels.label_points(catalog._cleaned(spark, folder)).na.drop(subset=S.FEATURES)
    columns = [S.POINT_ID, S.GROUP, *S.FEATURES, S.TARGET]
    assert split.columns == [*columns, "split"] and split.count() > 1000
    assert split.select(columns).exceptAll(want.select(columns)).isEmpty()
    assert want.select(columns).exceptAll(split.select(columns)).isEmpty()
