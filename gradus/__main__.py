"""Command line: explore, train, evaluate, threshold, report.

python -m gradus explore --raw registry.csv --operator NAME --out folder

python -m gradus train --raw registry.csv --operator NAME --out folder
python -m gradus evaluate --out folder
python -m gradus threshold --out folder --model xgboost
python -m gradus report --out folder --model xgboost
"""

from __future__ import annotations

import argparse

from gradus import schema as S
from gradus.operators.models import registry
from gradus.operators.splitting import SPLIT, TEST, VALIDATION
from gradus.plans import pipeline
from gradus.plans.explore import explore as explore_tables
from gradus.plans.explore import write_tables
from gradus.session import build_session, run_folder
from gradus.sources.registry import read_raw_csv, read_raw_parquet
from gradus.sources.tables import read_run_counts


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="gradus")
    commands = parser.add_subparsers(dest="command", required=True)
    explore = commands.add_parser("explore", help="profile the raw rows, choose k")
    train = commands.add_parser("train", help="label, split and fit the registered models")
    for command in (explore, train):
        command.add_argument("--raw", required=True, help="raw registry, CSV or Parquet")
        command.add_argument("--operator", required=True)
        command.add_argument("--format", choices=["csv", "parquet"], help="by default told by the name")
        command.add_argument("--multiline", action="store_true", help="CSV cells may hold line breaks")
    train.add_argument(
        "--missing", default="drop", choices=["drop", "fill", "error"], help="rows that miss a feature"
    )
    train.add_argument("--validation", type=float, default=0.0, help="share set apart for thresholds")
    evaluate = commands.add_parser("evaluate", help="score all models on the test part")
    evaluate.add_argument("--tuned", action="store_true", help="apply the class-0 thresholds")
    threshold = commands.add_parser("threshold", help="sweep the class-0 threshold of one model")
    threshold.add_argument("--model", default="xgboost")
    threshold.add_argument("--part", default=TEST, choices=[TEST, VALIDATION], help="rows that decide")
    report = commands.add_parser("report", help="write the tables of the dashboard")
    report.add_argument("--model", default="xgboost", help="model of the threshold tables")
    for command in (explore, train, evaluate, threshold, report):
        command.add_argument("--out", required=True, help="folder of labelled data, models, metrics")
        command.add_argument("--rounds", type=int, default=200, help="boosting rounds")
        command.add_argument("--master", default=None)
    args = parser.parse_args(argv)

    spark = build_session("gradus", args.master)
    models = registry(f"{args.out}/models", S.POINT_ID, args.rounds)
    with run_folder(spark):
        split_path = f"{args.out}/split"
        if args.command in ("explore", "train"):
            named = any(part in args.raw for part in (".csv", ".CSV"))
            wide = None if args.command == "explore" else tuple(S.RAW_COLUMNS)
            if args.format == "csv" or (args.format is None and named):
                raw = read_raw_csv(spark, args.raw, wide, args.multiline)
            else:
                raw = read_raw_parquet(spark, args.raw, wide)
            if args.command == "explore":
                write_tables(explore_tables(raw, args.operator), f"{args.out}/explore")
                return
            split = pipeline.prepare_and_train(
                raw, args.operator, f"{args.out}/labelled", models,
                missing=args.missing, validation_size=args.validation,
            )
            split.write.mode("overwrite").parquet(split_path)
            read_run_counts(spark, f"{args.out}/labelled_counts").show(truncate=False)
            split.groupBy(S.TARGET, SPLIT).count().orderBy(S.TARGET, SPLIT).show()
            return
        split = spark.read.parquet(split_path)
        if args.command == "report":
            write_tables(pipeline.report(spark, split, models, args.model), f"{args.out}/report")
        elif args.command == "evaluate":
            pipeline.evaluate(spark, split, models, f"{args.out}/metrics", args.tuned).show(truncate=False)
        else:
            pipeline.tune_threshold(spark, split, models[args.model], args.part).show(truncate=False)


if __name__ == "__main__":
    main()
