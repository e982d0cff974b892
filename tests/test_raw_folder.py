import pytest
from pyspark.sql import functions as F

from gradus import schema as S
from gradus.operators import splitting
from gradus.plans import pipeline
from gradus.sources import registry, tables


def test_headers_of_a_folder(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.csv").write_text('﻿id,name,city\n1,"a ""x"", b",P\n2,only two\n3,c,NaN\n', encoding="utf-8")
    (tmp_path / "deep" / "b.csv").write_text("city,extra,id\nQ,e,4\nR,f,5,too,many\n")
    (tmp_path / "deep" / "c.csv").write_text("city,extra,id\nS,g,6\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "_hidden.csv").write_text("no,header\n")
    raw = registry.read_raw_folder(spark, str(tmp_path), None)
    assert set(raw.columns) == {"id", "name", "city", "extra", registry.CORRUPT}
    sound = registry.sound_rows(raw).select("id", "name", "city", "extra").collect()
    assert sorted(map(tuple, sound), key=lambda r: r[0]) == [
        ("1", 'a "x", b', "P", None), ("3", "c", None, None), ("4", None, "Q", "e"), ("6", None, "S", "g"),
    ]
    assert tuple(registry.broken_count(raw).first()) == (6, 2)
    some = registry.read_raw_folder(spark, str(tmp_path), ["id", "other"])
    assert some.columns == ["id", "other", registry.CORRUPT] and some.count() == 6
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        registry.read_raw_folder(spark, str(tmp_path / "none"))


def test_wide_parquet(spark, tmp_path):
    path = str(tmp_path / "wide")
    spark.createDataFrame([("1", "NaN", 5)], "id string, note string, n int").write.parquet(path)
    assert tuple(registry.read_raw_parquet(spark, path, None).first()) == ("1", None, 5)


def test_row_keys_do_not_hang_on_the_partitioning(spark):
    rows = [("p1", 1.0, 0)] * 30 + [(None, 2.0, 1)] * 25 + [(f"q{i}", float(i), i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, f"{S.POINT_ID} string, x double, {S.TARGET} int")

    def sides(n):
        keyed = splitting.with_row_key(df.repartition(n))
        assert keyed.count() == len(rows) == keyed.select(S.ROW_KEY).distinct().count()
        split = splitting.fit_split(keyed, S.POINT_ID, row_key=S.ROW_KEY).apply(keyed)
        return sorted(map(str, split.groupBy(S.POINT_ID, "x", splitting.SPLIT).count().collect()))

    assert sides(1) == sides(3) == sides(7)


def test_counts_of_a_run(spark, tmp_path):
    kept = {c: "false" for c in S.RAW_COLUMNS}
    rows = []
    for i in range(60):
        row = {**kept, S.POINT_ID: f"p{i}", S.OPERATOR: "me" if i < 50 else "other", S.POWER: "22", S.POINT_COUNT: "2",
               S.GROUP: f"g{i % 7}-{i % (1 + i % 7)}"}
        if i < 4:
            row[S.POWER] = "none"
        elif i < 9:
            row[S.GROUP] = None
        elif i < 12:
            row[S.POINT_COUNT] = None
        rows.append(tuple(row[c] for c in S.RAW_COLUMNS))
    raw = spark.createDataFrame(rows, S.RAW_SCHEMA)
    labelled, counts = pipeline.prepare(raw, "me")
    assert counts == {"rows_read": 50, "without_power": 4, "without_group": 5, "labelled": 41, "without_feature": 3}
    assert labelled.count() == 41 and labelled.filter(F.col(S.ROW_KEY).isNull()).count() == 0
    path = str(tmp_path / "counts")
    tables.write_run_counts(spark, counts, path)
    assert {r.step: r.rows for r in tables.read_run_counts(spark, path).collect()} == counts
