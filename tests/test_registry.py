import pytest

from gradus import schema as S
from gradus.plans.explore import explore
from gradus.sources.registry import read_raw_csv, read_raw_csvs, read_raw_parquet


def write(path, text):
    path.write_text(text, encoding="utf-8")


def test_files_with_other_headers_fail_or_go_by_name(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    write(folder / "a.csv", "x,y\n1,2\nNA,4\n")
    write(folder / "b.csv", "y,x\n5,6\n")
    with pytest.raises(Exception, match="header"):
        read_raw_csv(spark, str(folder), None).collect()
    both = read_raw_csvs(spark, [str(folder / "a.csv"), str(folder / "b.csv")], None)
    assert sorted(map(str, both.select("x", "y").collect())) == sorted(
        ["Row(x='1', y='2')", "Row(x=None, y='4')", "Row(x='6', y='5')"]
    )
    assert read_raw_csv(spark, str(folder / "a.csv"), ["y"]).columns == ["y"]


def test_missing_texts_are_null_from_parquet_too(spark, tmp_path):
    path = str(tmp_path / "raw.parquet")
    spark.createDataFrame([["NA"] * len(S.RAW_COLUMNS)], S.RAW_SCHEMA).write.parquet(path)
    row = read_raw_parquet(spark, path).first().asDict()
    assert row.pop(S.OPERATOR) == "NA" and set(row.values()) == {None}


def test_the_wide_profile_has_all_columns(spark, tmp_path):
    names = [*S.RAW_COLUMNS, "remark"]
    row = {S.OPERATOR: "me", S.POWER: "50", S.GROUP: "town", S.RAW_LATITUDE: "48.1", S.RAW_LONGITUDE: "2.1"}
    lines = [",".join(names)]
    for town in ("a", "b", "c", "d", "d", "e", "e", "e"):
        lines.append(",".join({**row, S.GROUP: town}.get(c, "") for c in names))
    path = tmp_path / "raw.csv"
    write(path, "\n".join(lines) + "\n")
    tables = explore(read_raw_csv(spark, str(path), None), "me", (2, 3))
    assert tables["scan_profile"].first()["n_columns"] == len(names)
    assert "remark" in {r["column_name"] for r in tables["null_profile"].collect()}
    assert tables["drop_counts"].first()["n_kept"] == 8
    assert {name: table.count() > 0 for name, table in tables.items() if not table.count()} in ({}, {"access_counts": False, "site_shares": False})
