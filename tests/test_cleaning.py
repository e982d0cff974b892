import pytest
from pyspark.sql import functions as F

from gradus import schema as S
from gradus.functions import cleaning as C
from gradus.sources import registry

NUMBERS = [
    (" 12 ", 12.0), ("1d", None), ("1f", None), ("50,5", None), ("", None), ("0x10", None),
    ("0x1p3", None), ("1_000", None), ("1e3", 1000.0), ("1.5E+2", 150.0), (".5", 0.5),
    ("5.", 5.0), ("-7", -7.0), ("+7", 7.0), ("inf", float("inf")), ("-Infinity", float("-inf")),
    ("nan", None), ("NaN", None), ("True", None), (None, None), ("1 2", None),
]
FLAGS = [
    ("True", 1.0), ("TRUE", 1.0), ("true", 1.0), ("False", 0.0), (" true", 0.0), ("true ", 0.0),
    ("1", 0.0), ("vrai", 0.0), ("t", 0.0), ("yes", 0.0), (None, 0.0), ("", 0.0),
]


def values(spark, texts, expression):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.select("i", expression(F.col("t")).alias("v")).orderBy("i").select("v").collect()]


def test_numbers(spark):
    assert values(spark, [t for t, _ in NUMBERS], C.numeric_or_null) == [v for _, v in NUMBERS]


def test_numbers_from_numeric_column(spark):
    df = spark.createDataFrame([(1.5,), (float("nan"),), (None,)], "x double")
    assert [r[0] for r in df.select(C.numeric_or_null(F.col("x"))).collect()] == [1.5, None, None]


def test_flags(spark):
    assert values(spark, [t for t, _ in FLAGS], C.flag_from_text) == [v for _, v in FLAGS]


def test_flag_from_boolean_column(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "x boolean")
    assert [r[0] for r in df.select(C.flag_from_text(F.col("x"))).collect()] == [1.0, 0.0, 0.0]


def test_site_types(spark):
    texts = [*S.SITE_TYPE_CODES, "Voirie ", "voirie", None, ""]
    got = values(spark, texts, lambda c: C.ordinal_code(c, S.SITE_TYPE_CODES))
    assert got == [0, 1, 2, 3, 4, 99, 99, 99, 99]


def test_contains(spark):
    texts = ["Accès libre", "ACCÈS LIBRE", "non libre", "réservé", None, ""]
    got = values(spark, texts, lambda c: C.contains_flag(c, "libre"))
    assert got == [1.0, 1.0, 1.0, 0.0, 0.0, 0.0]


def raw_row(**changes):
    row = dict(
        id_pdc_itinerance="a", id_station_itinerance="s", nom_operateur="X", puissance_nominale="50",
        prise_type_ef="False", prise_type_2="true", prise_type_combo_ccs="TRUE",
        prise_type_chademo=None, prise_type_autre="0", implantation_station="Voirie",
        condition_acces="Accès libre", nbre_pdc="4", consolidated_latitude="48.1",
        consolidated_longitude="2.5", consolidated_commune="Paris",
    )
    row.update(changes)
    return tuple(row[c] for c in S.RAW_COLUMNS)


def test_clean_points_drops_only_missing_power(spark):
    raw = spark.createDataFrame(
        [raw_row(), raw_row(puissance_nominale="50,5"), raw_row(nbre_pdc="n/a"),
         raw_row(consolidated_latitude=None), raw_row(nom_operateur="x")],
        S.RAW_SCHEMA,
    )
    chosen = registry.keep_operator(raw, "X")
    rows = registry.clean_points(chosen).select(*S.FEATURES, "latitude").collect()
    assert len(rows) == 3
    assert sum(r["nbre_pdc"] is None for r in rows) == 1
    assert sum(r["latitude"] is None for r in rows) == 1
    assert tuple(rows[0][:8]) == (50.0, 0.0, 1.0, 1.0, 0.0, 0.0, 2, 1.0)
    assert tuple(registry.drop_counts(chosen).first()) == (4, 1, 3)


def test_viewport_is_closed(spark):
    df = spark.createDataFrame(
        [(-5.5, 41.0), (10.5, 52.0), (10.6, 45.0), (2.0, 40.9), (None, 45.0)],
        "longitude double, latitude double",
    )
    assert registry.keep_in_viewport(df).count() == 2
    assert registry.keep_located(df).count() == 4


def test_csv_by_header_name(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    head = ["extra", *reversed(S.RAW_COLUMNS)]
    first = ["1", *reversed(raw_row(consolidated_commune='Ville "A", sud', prise_type_chademo=""))]
    second = ["2", *reversed(raw_row(consolidated_commune="NA", puissance_nominale="NaN", prise_type_chademo=""))]
    quoted = [",".join('"' + str(v).replace('"', '""') + '"' for v in line) for line in (head, first, second)]
    (folder / "a.csv").write_text("\n".join(quoted) + "\n", encoding="utf-8")
    rows = registry.read_raw_csv(spark, str(folder)).collect()
    assert rows[0].asDict().keys() == set(S.RAW_COLUMNS)
    assert [r[S.GROUP] for r in rows] == ['Ville "A", sud', None]
    assert [r[S.POWER] for r in rows] == ["50", None]


def test_operator_filter_is_pushed_down(spark, tmp_path):
    path = str(tmp_path / "raw")
    spark.createDataFrame([raw_row()], S.RAW_SCHEMA).write.parquet(path)
    chosen = registry.keep_operator(registry.read_raw_parquet(spark, path), "X").select(S.POWER)
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(nom_operateur,X)" in plan
    assert "ReadSchema: struct<nom_operateur:string,puissance_nominale:string>" in plan


@pytest.mark.parametrize("name", [0, 1, 2])
def test_level_names(spark, name):
    df = spark.createDataFrame([(name,), (7,)], "c int")
    got = [r[0] for r in df.select(C.name_of(F.col("c"), S.LEVEL_NAMES)).collect()]
    assert got == [S.LEVEL_NAMES[name], None]
