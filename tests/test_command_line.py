import math

from checks.tables import raw_registry
from gradus import schema as S
from gradus.__main__ import main
from gradus.operators.splitting import SPLIT
from gradus.session import run_folder, write_out
from gradus.sources import tables


def test_three_commands(spark, tmp_path, capsys):
    """Prepare and train, evaluate, tune: on the whole smallest stand-in registry, from CSV."""
    raw, out = f"{tmp_path}/raw.csv", f"{tmp_path}/out"
    raw_registry(spark, "/root/testdata/sf0.001").write.option("header", True).option("escape", '"').csv(raw)
    main(["train", "--raw", raw, "--operator", "F", "--out", out, "--rounds", "1"])
    main(["evaluate", "--out", out])
    main(["threshold", "--out", out])
    main(["explore", "--raw", raw, "--operator", "F", "--out", out])
    main(["report", "--out", out, "--model", "logistic_regression"])
    before = spark.read.parquet(f"{out}/explore/scan_profile").first()
    assert before["n_columns"] == len(S.RAW_COLUMNS)
    squares = spark.read.parquet(f"{out}/report/confusion").collect()
    assert len(squares) == 3 * len(S.LEVELS)
    text = capsys.readouterr().out
    assert "K-Nearest Neighbors" in text and "baseline" in text

    split = spark.read.parquet(f"{out}/split")
    n = split.count()
    assert split.filter(f"{SPLIT} = 'test'").count() == math.ceil(0.2 * n)
    labelled = tables.read_labelled(spark, f"{out}/labelled")
    assert labelled.columns == S.LABELLED_COLUMNS and labelled.count() >= n
    assert {r[0] for r in labelled.select(S.TARGET).distinct().collect()} == {0, 1, 2}
    assert {r["model_key"] for r in tables.read_metrics(spark, f"{out}/metrics").collect()} == {
        "logistic_regression", "knn", "xgboost"
    }


def test_the_folder_of_a_run_goes_with_it(spark):
    with run_folder(spark) as folder:
        table = write_out(spark.range(5).toDF("id"), "numbers")
        assert table.inputFiles()[0].split("file://")[-1].startswith(folder.split("file://")[-1])
    jvm = spark._jvm.org.apache.hadoop.fs.Path(folder)
    assert not jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm)
