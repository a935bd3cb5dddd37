"""Batch jobs: train a model bundle, predict with it, or both.

    python -m spendwise.plans.batch train   <data_dir> <model_dir>
    python -m spendwise.plans.batch predict <data_dir> <model_dir> <out_dir> [--version N]
    python -m spendwise.plans.batch run     <data_dir> <out_dir> [--train-dir DIR]

train:   ingest (S1–S3) → strict checks (Q1, raise) → seasonal index, training table
         → Parquet stage table (S4, partitioned by window) → calibrated quantile
         forest (M3/M4), curves, profile → versioned bundle (S6, S7)
predict: ingest → strict checks → bundle → feature table under the model's season
         → forecast (M5) → scale guard against the bundle's profile (G10; off if
         the profile is lost) → roll-up (A9) → contract (Q2, raise) → predictions
         CSV (S5, overwrite) and guard report JSON (S8)
"""
from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import normalize as N
from ..operators import base as B
from ..operators import calendar as C
from ..operators import features as FE
from ..operators import quality as QA
from ..operators import rollup as R
from ..sources import exports as EX
from ..sources import sinks as SK
from . import model as M


def ingest(spark: SparkSession, data_dir: str, strict: bool = True, report_dir: str | None = None) -> DataFrame:
    """The staged long table of an export directory.  The files are parsed once, with the
    parser's side output staged beside the rows; ``report_dir`` gets the outcome of every
    file and the rejected cells as JSON.  ``strict`` raises on a recognised file of which
    no row was parsed and on failed checks."""
    files = EX.scan_files(spark, data_dir)
    parsed = SK.stage(spark, EX.load_long(spark, data_dir, with_file=True, rejects=True, files=files), "parsed")
    long = parsed.where(F.col("date").isNotNull()).select(*S.LONG_COLUMNS)
    outcomes = EX.file_outcomes(spark, files, parsed) if strict or report_dir is not None else None
    if report_dir is not None:
        SK.write_json(outcomes, f"{report_dir}/file_outcomes")
        SK.write_json(EX.rejected_cells(parsed), f"{report_dir}/rejected_cells")
    if strict:
        broken = EX.broken_files(outcomes).select(EX.FILE_COL, "channel_hint").head(5)
        if broken:
            raise ValueError("recognised files of which no row was parsed: " + ", ".join(f"{r[0]} ({r[1]})" for r in broken))
        has_rev = any(f.header is not None and N.has_revenue_column(f.header) for f in files)
        bad = [r for r in QA.ingest_checks(long, has_rev).collect() if not r.ok]  # ≤ 4 check rows
        if bad:
            raise ValueError("ingest checks failed: " + "; ".join(f"{r.check}={r.detail}" for r in bad))
    return long


def train(spark: SparkSession, data_dir: str, model_dir: str, strict: bool = True, cut_step: int = S.TRAIN_CUT_STEP,
          **forest_params) -> M.ForecastModel:
    """Fits on the exports and saves the next model version under ``model_dir``."""
    long = B.staged(ingest(spark, data_dir, strict))
    season = SK.stage(spark, C.seasonal_index(long), "season")
    features = SK.scratch_dir(spark, "training")
    SK.write_parquet(FE.training_table(long, S.WINDOWS, cut_step, season), features, ["window_days"])
    model = M.train(long, S.WINDOWS, cut_step, season, spark.read.parquet(features), **forest_params)
    model.save(model_dir)
    return model


def predict(spark: SparkSession, data_dir: str, model_dir: str, out_dir: str, strict: bool = True, version: int | None = None,
            single_file: bool = False) -> dict:
    """Forecasts the exports with a saved model."""
    model = M.ForecastModel.load(spark, model_dir, version)
    long = ingest(spark, data_dir, strict, out_dir)
    table = f"{out_dir}/features/prediction"
    SK.write_parquet(model.prediction_table(long), table, ["window_days"])
    out, _, assessment = model.predict(spark.read.parquet(table))
    out = SK.stage(spark, out, "forecast")
    contract = QA.output_contract(out).first()
    if not contract.valid:
        raise ValueError(f"output contract violated: {contract.asDict()}")
    SK.write_csv(R.output_order(out), f"{out_dir}/predictions", single_file=single_file)
    confidence = None
    if assessment is not None:
        SK.write_json(assessment, f"{out_dir}/scale_report")
        confidence = assessment.first().confidence
    return {"rows": contract.rows, "confidence": confidence, "version": model.version}


def run(spark: SparkSession, data_dir: str, out_dir: str, train_dir: str | None = None, strict: bool = True,
        cut_step: int = S.TRAIN_CUT_STEP, single_file: bool = False, **forest_params) -> dict:
    """train on ``train_dir`` (else on the data itself), then predict."""
    train(spark, train_dir or data_dir, f"{out_dir}/model", strict, cut_step, **forest_params)
    return predict(spark, data_dir, f"{out_dir}/model", out_dir, strict, single_file=single_file)


def main(argv=None):
    ap = argparse.ArgumentParser(description="Forecast 30/60/90-day revenue and ROAS from ad exports")
    jobs = ap.add_subparsers(dest="job", required=True)
    for name, dirs in (("train", ("data_dir", "model_dir")), ("predict", ("data_dir", "model_dir", "out_dir")), ("run", ("data_dir", "out_dir"))):
        job = jobs.add_parser(name)
        for d in dirs:
            job.add_argument(d)
        job.add_argument("--no-strict", action="store_true")
        if name == "run":
            job.add_argument("--train-dir", default=None)
        if name == "predict":
            job.add_argument("--version", type=int, default=None)
        if name != "train":
            job.add_argument("--single-file", action="store_true", help="one CSV file; all rows pass one task")
    a = ap.parse_args(argv)
    spark = SparkSession.builder.appName("spendwise-batch").getOrCreate()
    if a.job == "train":
        print(f"model version {train(spark, a.data_dir, a.model_dir, not a.no_strict).version} in {a.model_dir}")
    elif a.job == "predict":
        print(predict(spark, a.data_dir, a.model_dir, a.out_dir, not a.no_strict, a.version, a.single_file))
    else:
        print(run(spark, a.data_dir, a.out_dir, a.train_dir, not a.no_strict, single_file=a.single_file))


if __name__ == "__main__":
    main()
