"""Time one whole run, stage by stage, and the report queries: one JSON line on standard output.

Every ``run_`` stage reads what the stage before has written, so that its time is its own.
The boosted model is fitted at its registered size (200 rounds of depth 6). An untimed first run with
one round loads classes and compiles code; no data or plan is kept from it.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from checks import catalog  # noqa: E402
from checks.tables import OPERATOR, raw_registry  # noqa: E402
from gradus import schema as S  # noqa: E402
from gradus.operators import levels, metrics, models, splitting, thresholds  # noqa: E402
from gradus.session import build_session, scratch_path, write_out  # noqa: E402
from gradus.sources import registry  # noqa: E402

REPORTS = [
    "scan_profile", "null_profile", "value_shares", "describe", "histogram", "group_profile",
    "elbow", "silhouette", "class_stats", "map_bubbles", "whatif_grid", "evaluate_models",
    "class_report", "threshold_sweep", "threshold_summary",
]


ROUNDS = 200


def run(spark, sf_dir, timed, rounds=ROUNDS):
    csv = scratch_path(spark, "bench-raw")
    raw_registry(spark, sf_dir).write.option("header", True).option("escape", '"').csv(csv)
    kept = [S.POINT_ID, S.GROUP, "latitude", "longitude", *S.FEATURES]

    def load():
        points = registry.keep_operator(registry.read_raw_csv(spark, csv), OPERATOR)
        return write_out(registry.clean_points(points).select(*kept), "cleaned")

    cleaned = timed("run_csv_load_and_features", load)
    labelled = timed("run_levels", lambda: write_out(levels.label_points(cleaned), "labelled"))
    usable = labelled.na.drop(subset=S.FEATURES)
    split = timed("run_split", lambda: splitting.fit_split(usable, S.POINT_ID)).apply(usable)
    side = F.col(splitting.SPLIT)
    train = split.filter(side == splitting.TRAIN).persist()
    test = timed("run_split_apply", lambda: write_out(split.filter(side == splitting.TEST), "test"))
    timed("run_train_rows", train.count)
    fitted = {
        "logistic_regression": timed("run_fit_logistic", lambda: models.fit_logistic(train)),
        "knn": timed("run_fit_knn", lambda: models.KnnModel.fit(train, S.POINT_ID)),
        "xgboost": timed(
            f"run_fit_boosted_{rounds}_rounds", lambda: models.BoostedModel.fit(train, rounds=rounds)
        ),
    }

    def save(name):
        fitted[name].save(scratch_path(spark, f"bench-{name}"))

    for name in fitted:
        timed(f"run_save_{name}", lambda name=name: save(name))

    def score(name):
        rows = models.score_with(fitted[name], test)
        return write_out(rows.select(F.col(S.TARGET).alias("y"), "probabilities", F.col("prediction").alias("p")), name)

    scored = {name: timed(f"run_score_{name}", lambda name=name: score(name)) for name in fitted}
    table = metrics.evaluate_models(metrics.stack_predictions(scored), catalog.MODEL_NAMES)
    timed("run_evaluate", table.collect)
    timed("run_threshold", thresholds.threshold_summary(scored["xgboost"]).collect)
    train.unpersist()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}

    def timed(name, action):
        start = time.perf_counter()
        out = action()
        seconds[name] = round(time.perf_counter() - start, 3)
        return out

    run(spark, sf_dir, lambda name, action: action(), rounds=1)
    run(spark, sf_dir, timed)
    for name in REPORTS:
        timed(name, lambda name=name: catalog.QUERIES[name](spark, sf_dir)
              .write.format("noop").mode("overwrite").save())
    print(json.dumps({
        "metric": "run_and_report_queries_total", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
