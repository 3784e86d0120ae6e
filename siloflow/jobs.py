"""Jobs: predictions and artifacts from case records, and the report on predictions; both with a command line.

    python -m siloflow.jobs run --train T --input I --output O --artifacts-dir A [--eval-labels L] [--quick] [--seed N]
    python -m siloflow.jobs evaluate --input I --truth T --predictions P [--report R]

``run`` ends with 1 and ``evaluate`` with 2 where they fail; the reason is logged. Records and predictions are
tables all the way; what comes to the driver is parameters, scores and the first few messages.
"""

from __future__ import annotations

import argparse
import logging
import os
import sys
import traceback
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siloflow.functions import spans as S
from siloflow.operators import evaluate as E
from siloflow.operators import extraction, features, federated, metrics, pii
from siloflow.privacy import accounting
from siloflow.sources import notes

log = logging.getLogger("siloflow")
#: Messages that are shown of each kind, and characters of each.
MOST_MESSAGES, MOST_CHARS = 10, 200
QUICK_ROUNDS = 5
L2_GRID = (0.01, 0.05, 0.1)


def shortened(messages: list[str], most: int = MOST_MESSAGES, chars: int = MOST_CHARS) -> list[str]:
    """The first messages, long ones cut, and how many more there are."""
    shown = [m if len(m) <= chars else m[:chars] + "..." for m in messages[:most]]
    return shown + [f"and {len(messages) - most} more"] * (len(messages) > most)


def reason(error: BaseException) -> str:
    """What an error says, with the places it came from."""
    return "".join(traceback.format_exception(error)).strip()


def processed(cases: DataFrame) -> DataFrame:
    """Spans, rendered text and extracted facts of every case; what fails in one row is told in its _warnings and leaves the row its empty answer."""
    out = extraction.extract(pii.detect(cases, age="_age") if "_age" in cases.columns else pii.detect(cases.withColumn("_age", F.col("structured_features.age_years")), age="_age"))
    sound = F.size("pii_entities") == F.size(S.validated(F.col("pii_entities"), F.length("note_text")))
    told = F.col("_warnings") if "_warnings" in cases.columns else F.array().cast("array<string>")
    out = out.withColumns({"_warnings": F.when(sound, told).otherwise(F.concat(told, F.array(F.lit("spans could not be rendered")))), "pii_entities": F.when(sound, F.col("pii_entities")).otherwise(S.none())})
    return pii.deidentified(out).drop("_age")


def trained(train: DataFrame, cfg: federated.Config, feature_set: str = "compact") -> tuple[list[float], dict, str]:
    """(parameters, scaler, how it was aggregated) of the federated model on labelled cases."""
    names = list(features.SETS[feature_set])
    rows = features.with_features(extraction.extract(notes.labelled(train)), feature_set).withColumn("_y", F.col("labels.readmission_30d"))
    rows = rows.select("case_id", "hospital_id", "_y", *names).persist()
    try:
        scaler = features.scaler_dict(features.standardizer(features.moments(rows, names, "hospital_id"), names))
        cell, how = federated.final_model(features.standardized(rows, scaler), names, "_y", "hospital_id", "case_id", cfg)
        return [float(t) for t in cell.theta[""]], scaler, how
    finally:
        rows.unpersist()


def predicted(cases: DataFrame, theta: list[float], scaler: dict, feature_set: str = "compact") -> DataFrame:
    """A prediction for every case, with _warnings."""
    names = list(features.SETS[feature_set])
    rows = features.standardized(features.with_features(processed(cases), feature_set), scaler)
    p = metrics.probability(federated.predicted(federated.logit(names, theta)))
    return rows.select("case_id", "hospital_id", S.to_json(F.col("pii_entities")).alias("pii_entities"), "deidentified_text", "extracted_clinical_data", p.alias("readmission_probability"), "_warnings")


def experiment_summary(train: DataFrame, cfg: federated.Config, theta: list[float], how: str, feature_set: str = "compact") -> dict:
    """Settings, sites, regimes by cross-validation and by site, all rounded to four digits."""
    names = list(features.SETS[feature_set])
    rows = features.with_features(extraction.extract(notes.labelled(train)), feature_set).withColumn("_y", F.col("labels.readmission_30d"))
    rows = rows.select("case_id", "hospital_id", "_y", *names).persist()
    try:
        scaler = features.scaler_dict(features.standardizer(features.moments(rows, names, "hospital_id"), names))
        scaled = features.standardized(rows, scaler)
        cv = metrics.summarize_metrics(federated.cross_validate(scaled, names, "_y", "hospital_id", "case_id", cfg), "regime", "site")
        profile = [r.asDict() for r in features.profile(rows, names, "_y", "hospital_id").collect()]  # a row for each site
        prevalence = [r["prevalence"] for r in profile]
        return notes.rounded(
            {
                "config": asdict(cfg), "features": names, "aggregation": how, "parameters": dict(zip([*names, "bias"], theta, strict=True)),
                "sites": profile, "observations": {"prevalence_spread": max(prevalence) - min(prevalence), "n_sites": len(profile)} if profile else {},
                "cross_validation": [r.asDict() for r in cv.collect()],
            }
        )
    finally:
        rows.unpersist()


def privacy_summary(cfg: federated.Config, how: str, n_features: int, targets: tuple[float, ...] = (0.5, 1, 2, 4, 8), at_delta: float = 1e-3) -> dict:
    """What leaves a site and how it is protected, and the noise that differential privacy would take."""
    steps = cfg.rounds * cfg.epochs
    noises = {e: accounting.multiplier_for(e, steps, at_delta) for e in targets}
    return notes.rounded(
        {
            "aggregation": how, "released": list(federated.ALLOWED), "numbers_per_round": n_features + 2, "rounds": cfg.rounds, "delta": at_delta, "steps": steps,
            "noise": [{"epsilon": e, "sigma": s, "epsilon_rdp": accounting.renyi_epsilon(s, steps, at_delta)} for e, s in noises.items()],
        }
    )


def component_errors(inputs: DataFrame, truth: DataFrame, pred: DataFrame) -> DataFrame:
    """(case_id, component, truth, prediction) of every span and field that is not as it should be."""
    rows = E.with_valid_spans(E.join_all(inputs, truth, pred))
    said = lambda s: F.concat_ws(":", s["label"], s["start"], s["end"], F.substring("note_text", s["start"] + 1, s["end"] - s["start"]))
    shown = lambda c: F.transform(F.col(c), said)
    rows = rows.withColumns({"_t": shown("t_spans"), "_p": F.coalesce(shown("p_spans"), F.array().cast("array<string>"))})
    missed = rows.select("case_id", F.lit("span").alias("component"), F.explode(F.array_except("_t", "_p")).alias("truth"), F.lit(None).cast("string").alias("prediction"))
    wrong = rows.select("case_id", F.lit("span").alias("component"), F.lit(None).cast("string").alias("truth"), F.explode(F.array_except("_p", "_t")).alias("prediction"))
    text = lambda side, f: F.array_join(metrics.normal_list(F.col(f"{side}_fields.{f}")), ",") if f in ("diagnoses", "medications") else F.col(f"{side}_fields.{f}").cast("string")
    each = rows.select("case_id", F.inline(F.array(*(F.struct(F.lit(f).alias("component"), text("t", f).alias("truth"), text("p", f).alias("prediction")) for f in extraction.FIELDS))))
    return missed.unionByName(wrong).unionByName(each.where(~F.col("truth").eqNullSafe(F.col("prediction"))))


def run(spark: SparkSession, train: str, inputs: str, output: str, artifacts: str, truth: str | None = None, quick: bool = False, seed: int = 0) -> dict:
    """Train, predict every input, write predictions as JSON lines and the artifacts as JSON; returns the counts."""
    cfg = federated.Config(seed=seed, rounds=QUICK_ROUNDS, repeats=1, folds=3) if quick else federated.Config(seed=seed)
    cases = notes.read_jsonl(spark, train, notes.TRAIN_SCHEMA)
    theta, scaler, how = trained(cases, cfg)
    raw = notes.read_jsonl(spark, inputs, "case_id string, hospital_id string, note_text string, structured_features string")
    if notes.accepted(raw).isEmpty():
        raise ValueError("no input has a case_id")
    told = predicted(notes.repair(raw), theta, scaler).persist()
    try:
        notes.write_jsonl(told.drop("_warnings", "hospital_id"), output)
        warned = told.where(F.size("_warnings") > 0)
        messages = [f"{r['case_id']}: {'; '.join(r['_warnings'])}" for r in warned.select("case_id", "_warnings").orderBy("case_id").limit(MOST_MESSAGES + 1).collect()]
        for m in shortened(messages):
            log.warning(m)
        counts = {"cases": told.count(), "warned": warned.count(), "rejected": notes.rejected(raw).count()}
        os.makedirs(artifacts, exist_ok=True)
        notes.write_json(os.path.join(artifacts, "experiment_summary.json"), experiment_summary(cases, cfg, theta, how))
        notes.write_json(os.path.join(artifacts, "privacy_summary.json"), privacy_summary(cfg, how, len(theta) - 1))
        if truth:
            known = notes.read_jsonl(spark, truth, notes.TRUTH_SCHEMA)
            notes.write_json(os.path.join(artifacts, "validation_report.json"), notes.rounded(E.evaluate(notes.repair(raw), known, told)))
        return counts
    finally:
        told.unpersist()


def report(spark: SparkSession, inputs: str, truth: str, predictions: str) -> dict:
    """The evaluation of written predictions, with the first messages on what is missing, unknown or wrong."""
    read = (notes.read_jsonl(spark, inputs), notes.read_jsonl(spark, truth, notes.TRUTH_SCHEMA), notes.read_jsonl(spark, predictions, notes.PREDICTION_SCHEMA))
    out = E.evaluate(*read)
    errors = component_errors(*read).orderBy("case_id", "component", "truth", "prediction")
    out["messages"] = shortened([f"{r['case_id']}: {r['component']} is {r['prediction']}, not {r['truth']}" for r in errors.limit(MOST_MESSAGES + 1).collect()])
    return notes.rounded(out)


def configure_logging(level: int = logging.INFO) -> None:
    logging.basicConfig(level=level, format="%(asctime)s %(levelname)s %(name)s: %(message)s")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="siloflow")
    jobs = parser.add_subparsers(dest="job", required=True)
    one = jobs.add_parser("run")
    for name in ("train", "input", "output", "artifacts-dir"):
        one.add_argument(f"--{name}", required=True)
    one.add_argument("--eval-labels")
    one.add_argument("--quick", action="store_true")
    one.add_argument("--seed", type=int, default=0)
    two = jobs.add_parser("evaluate")
    for name in ("input", "truth", "predictions"):
        two.add_argument(f"--{name}", required=True)
    two.add_argument("--report")
    args = parser.parse_args(argv)
    configure_logging()
    spark = spark or SparkSession.builder.appName("siloflow").getOrCreate()
    try:
        if args.job == "run":
            log.info("done: %s", run(spark, args.train, args.input, args.output, args.artifacts_dir, args.eval_labels, args.quick, args.seed))
        else:
            got = report(spark, args.input, args.truth, args.predictions)
            for name in ("composite", "points", "missing_predictions", "unknown_predictions"):
                print(f"{name}: {got[name]}")
            for m in got["messages"]:
                print(m)
            if args.report:
                notes.write_json(args.report, got)
        return 0
    except Exception as error:  # noqa: BLE001  the command line tells and ends
        log.error(reason(error))
        return 1 if args.job == "run" else 2


if __name__ == "__main__":
    sys.exit(main())
