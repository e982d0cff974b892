import pytest

from gradus import schema as S
from gradus.operators.scenarios import POWERS, whatif_grid
from gradus.session import scratch_path, shared_folder, write_out
from gradus.sources import tables


def labelled(spark):
    rows = [
        ('Ville "A", sud', 48.5, None, 50.0, 0.0, 1.0, 1.0, 0.0, 0.0, 99, 1.0, 4.0, 0),
        ("B", 43.25, -1.5, 150.5, 1.0, 0.0, 0.0, 0.0, 1.0, 2, 0.0, None, 2),
    ]
    return spark.createDataFrame(rows, S.LABELLED_SCHEMA)


@pytest.mark.parametrize("fmt", ["parquet", "csv", "orc", "json"])
def test_labelled_round_trip(spark, tmp_path, fmt):
    df = labelled(spark)
    path = str(tmp_path / "labelled")
    tables.write_labelled(df.withColumn("extra", df.label), path, fmt)
    tables.write_labelled(df, path, fmt)  # overwrites
    back = tables.read_labelled(spark, path, fmt)
    assert back.columns == S.LABELLED_COLUMNS
    assert sorted(back.collect()) == sorted(df.collect())


def test_missing_labelled(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.read_labelled(spark, str(tmp_path / "none"))


def test_metrics_round_trip(spark, tmp_path):
    path = str(tmp_path / "metrics")
    assert tables.read_metrics(spark, path) is None
    row = dict(model_key="k", model_name="K", model_path="p/k", accuracy=1, f1_weighted=0.5,
               f1_macro=0.25, precision_macro=0.125, recall_macro=0.0, other="dropped")
    tables.write_metrics(tables.metrics_table(spark, [row]), path)
    back = tables.read_metrics(spark, path)
    assert [tuple(r) for r in back.collect()] == [("k", "K", "p/k", 1.0, 0.5, 0.25, 0.125, 0.0)]


class Session:
    """Just enough of a session to ask for its shared folder."""

    def __init__(self, setting, master, folder=None):
        self.conf = {"spark.checkpoint.dir": setting} if setting else {}
        self.sparkContext, self.master, self.folder = self, master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_shared_folder():
    assert shared_folder(Session("hdfs://x/y/", "yarn")) == "hdfs://x/y"
    assert shared_folder(Session(None, "yarn", "hdfs://set/by/hand")) == "hdfs://set/by/hand"
    with pytest.raises(ValueError):
        shared_folder(Session(None, "yarn"))
    local = Session(None, "local[2]")
    assert shared_folder(local) == shared_folder(local) != ""
    assert scratch_path(local, "x").startswith(shared_folder(local) + "/x-")


def test_write_out_cuts_the_lineage(spark):
    out = write_out(spark.range(3), "numbers")
    assert out.count() == 3
    assert "Range" not in out._jdf.queryExecution().executedPlan().toString()


def test_whatif_grid(spark):
    grid = whatif_grid(labelled(spark))
    assert grid.count() == 2 * len(POWERS)
    assert grid.columns == [S.GROUP, "latitude", "longitude", *S.FEATURES]
    plan = grid._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
