"""python -m kindra.plans.cli METHOD {validate,predict,all}: cross-validation, prediction, reports and files."""

from __future__ import annotations

import argparse
import json
import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindra.operators import evaluation
from kindra.plans.methods import METHODS, configured, prepared
from kindra.sources import tables
from kindra.sources.lineage import cut


def labelled(method: Any, split: tables.Split) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs with label, (s1_id, n_true, home) of all records, and (s1_id, slice); made once for a method and split."""
    if method.name not in split.notes:
        pairs = cut(evaluation.with_labels(method.build_pairs(split), split.truth))
        s1, _ = prepared(split)
        countries = s1.select("s1_id", F.col("country_norm").alias("slice"))
        truth = cut(evaluation.true_counts(s1, split.truth).join(countries.withColumnRenamed("slice", "home"), "s1_id"))
        split.notes[method.name] = pairs, truth, countries
    return split.notes[method.name]


def validate(method: Any, split: tables.Split, out_dir: str, n_folds: int, seed: int) -> dict:
    pairs, truth, countries = labelled(method, split)
    strata = truth.withColumn("stratum", F.concat_ws(":", "home", F.least("n_true", F.lit(2)).cast("string")))
    folds = cut(evaluation.stratified_folds(strata, n_folds, seed))
    chosen, info = method.cross_validate(pairs, truth, folds, n_folds)
    chosen = cut(chosen)
    if truth.count() > method.config.fit_records and method.name == "boosted":
        truth = cut(truth.join(chosen.select("s1_id").distinct(), "s1_id"))  # nested validation sees the sampled records
    counts = truth.select("s1_id", "n_true")
    by_fold = evaluation.per_record(chosen, counts).join(folds, "s1_id").groupBy("fold").agg(F.avg("f").alias("f"))
    report = {
        "cv": evaluation.report(chosen, counts).first().asDict(), "candidates": evaluation.candidate_recall(pairs, counts).first().asDict(), "by_country": {r.slice: r.asDict() for r in evaluation.report(chosen, counts, countries).collect()},
        "fold_f05": {r.fold: r.f for r in by_fold.collect()}, "std_f05": by_fold.agg(F.stddev_pop("f")).first()[0], "max_owners": tables.owner_multiplicity(split.truth).first()[0], **info,
    }
    errors = tables.error_rows(chosen, split.truth, split.s1, split.s23)
    errors.write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{out_dir}/errors")
    tables.write_json(f"{out_dir}/report.json", report)
    return report


def predict(method: Any, train: tables.Split, test: tables.Split, out_dir: str, inputs: list[str]) -> dict:
    pairs, truth, _ = labelled(method, train)
    model = method.fit(pairs, truth)
    found = cut(method.predict(model, method.build_pairs(test)).select("s1_id", "c_id", "score", "selected"))
    # The records' order in their file: a row number inside each part of it, and the part's place.
    order = test.s1.select(F.col("entity_id").alias("s1_id"), F.monotonically_increasing_id().alias("place"))
    known = test.s23.select(F.col("entity_id").alias("c_id"))
    tables.write_outputs(out_dir, found.where("selected"), found, order, known)
    results: dict = {"model": method.summary(model)}
    if test.truth is not None:
        scored = evaluation.with_labels(found, test.truth)
        counts = cut(evaluation.true_counts(order, test.truth))
        home = prepared(test)[0].select("s1_id", F.col("country_norm").alias("slice"))
        results["test"] = evaluation.report(scored, counts).first().asDict()
        results["test_by_country"] = {r.slice: r.f05 for r in evaluation.report(scored, counts, home).collect()}
    tables.write_json(f"{out_dir}/manifest.json", tables.manifest(vars(method.config), inputs, results))
    return results


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("method", choices=sorted(METHODS))
    parser.add_argument("command", choices=("validate", "predict", "all"))
    parser.add_argument("--data-dir", default="dataset")
    parser.add_argument("--out-dir")
    parser.add_argument("--folds", type=int, default=5)
    parser.add_argument("--seed", type=int)
    parser.add_argument("--config", help="JSON file whose fields replace those of the configuration")
    parser.add_argument("--test-gt", help="ground truth of the test split, to score it")
    a = parser.parse_args(arguments)
    overrides = {}
    if a.config:
        with open(a.config, encoding="utf-8") as f:
            overrides = json.load(f)
    if a.seed is not None:
        overrides["seed"] = a.seed
    method, out_dir = configured(a.method, overrides), a.out_dir or f"outputs/{a.method}"
    os.makedirs(out_dir, exist_ok=True)
    spark = spark or SparkSession.builder.appName(f"linkage-{a.method}").getOrCreate()
    train = tables.read_split(spark, a.data_dir, "train")
    if train.truth is None:
        raise tables.DataError("the train split has no ground truth")
    results: dict = {}
    if a.command in ("validate", "all"):
        results["validate"] = validate(method, train, out_dir, a.folds, method.config.seed)
    if a.command in ("predict", "all"):
        test = tables.read_split(spark, a.data_dir, "test", a.test_gt)
        inputs = [f"{a.data_dir}/{s}/{s}_source{i}.tsv" for s in ("train", "test") for i in (1, 2, 3)]
        results["predict"] = predict(method, train, test, out_dir, inputs)
    return results


if __name__ == "__main__":
    main()
