"""Batch training job: read traffic, prepare features, fit Ridge and boosted
trees with early stopping, score both splits and save everything.

    python -m tarmac.plans.training_job --csv flights.csv --out models/traffic
    python -m tarmac.plans.training_job --fixture /root/testdata/sf0.01 --out /tmp/x
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ..ml import training as TR
from ..sources.artifacts import save_artifacts
from ..sources.checked import MAX_REJECT_RATE, read_traffic_checked
from ..sources.traffic import fixture_traffic, read_traffic_parquet, scan_traffic
from .prepare import prepare


def run_training(spark: SparkSession, traffic, out: str, gbt_rounds: int = 2000,
                 validation: str = "holdout", materialize: str = "table") -> dict:
    prepared = prepare(traffic, materialize=materialize)
    ridge = TR.fit_ridge(prepared)
    gbt, curve = TR.fit_gbt(prepared, max_iter=gbt_rounds, validation=validation)
    metrics = ridge.metrics.unionByName(gbt.metrics)
    save_artifacts(out, prepared, {ridge.name: ridge.model, gbt.name: gbt.model}, metrics)
    curve.write.mode("overwrite").parquet(f"{out}/gbt_error_curve")
    return {"prepared": prepared, "models": [ridge, gbt], "curve": curve}


def main(argv=None) -> None:
    from ..session import build_session
    ap = argparse.ArgumentParser(description=__doc__)
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--csv")
    src.add_argument("--parquet")
    src.add_argument("--fixture", help="folder of the TPC-H based test tables")
    ap.add_argument("--out", required=True)
    ap.add_argument("--gbt-rounds", type=int, default=2000, help="at most; fitting stops by itself")
    ap.add_argument("--validation", choices=["holdout", "test"], default="holdout")
    ap.add_argument("--date-format", action="append", default=[], help="of the CSV's dates, tried after ISO; may be repeated")
    ap.add_argument("--max-reject-rate", type=float, default=MAX_REJECT_RATE, help="share of CSV rows that may fail to parse")
    args = ap.parse_args(argv)
    spark = build_session(app="tarmac-training")
    if args.csv:
        checked = read_traffic_checked(spark, args.csv, args.date_format, args.max_reject_rate)
        print(f"{checked.rows} rows, {checked.rejected} rejected: {checked.reasons}")
        traffic = checked.traffic
    elif args.parquet:
        traffic = scan_traffic(read_traffic_parquet(spark, args.parquet))
    else:
        traffic = fixture_traffic(spark, args.fixture)
    run_training(spark, traffic, args.out, args.gbt_rounds, args.validation)
    spark.stop()


if __name__ == "__main__":
    main()
