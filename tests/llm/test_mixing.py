import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.llm.mixing import inverse_poisson, mix, poisson_count, rates
from tests.llm.helpers import ODD, documents


def inverse(mean, u):
    k, term = 0, math.exp(-mean)
    total = term
    while total <= u:
        k += 1
        term *= mean / k
        total += term
    return k


def test_inverse_equals_brute_force(spark):
    cases = [(m, u) for m in (0.0, 0.1, 1.0, 7.5, 31.0) for u in (0.0, 0.2, 0.5, 0.9, 0.999999)]
    rows = spark.createDataFrame(cases, "m double, u double")
    got = rows.select("m", "u", inverse_poisson(F.col("m"), F.col("u")).alias("k")).collect()
    assert all(r.k == inverse(r.m, r.u) for r in got)


def test_counts_have_the_poisson_mean_and_variance(spark):
    for mean in (0.3, 3.0, 150.0):
        rows = spark.range(20_000).select(poisson_count(F.lit(mean), F.lit("s"), F.col("id")).alias("k"))
        k = np.array([r.k for r in rows.collect()])
        assert abs(k.mean() - mean) < 5 * math.sqrt(mean / len(k))
        assert abs(k.var() / mean - 1) < 0.1


def test_sources_meet_their_weights(spark):
    rows = [(i, f"t{i}", "big" if i % 3 else "small") for i in range(9_000)] + [(10_000, "x", None)]
    docs = documents(spark, rows)
    out = mix(docs, {"big": 1, "small": 3}, total=8_000)
    counts = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(counts["big"] - 2_000) < 250
    assert abs(counts["small"] - 6_000) < 400
    assert None not in counts
    assert out.columns == [*docs.columns, "_copy", "copies", "order_key"]
    twice = mix(docs, {"big": 1, "small": 3}, total=8_000)
    assert sorted(map(str, out.collect())) == sorted(map(str, twice.collect()))


def test_odd_rows(spark):
    docs = documents(spark, [(r[0], r[1], None if i % 2 else "a") for i, r in enumerate(ODD)])
    out = mix(docs, total=2_000)
    assert 1_500 < out.count() < 2_500
    assert mix(documents(spark, [])).count() == 0
    assert sum(r.rate * r.rows for r in rates(docs).collect()) == pytest.approx(len(ODD))


def test_weights_are_checked(spark):
    with pytest.raises(ValueError, match="weights"):
        mix(documents(spark, ODD), {"a": -1})
