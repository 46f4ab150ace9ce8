"""Jobs: ``python -m millrace.jobs train | predict | search | factorize --input ... --out_dir ...``.

Instances are Parquet tables (id, label, features map<string,double>, and more). Every option of ``TrainConfig`` is an
option of the jobs that train, by its name.
"""

from __future__ import annotations

import argparse
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import factor, features, linear, select
from .operators.trainers import TrainConfig, train
from .sources.readers import model_to_json, read_table, write_table, write_tsv
from .sources.staging import written


def _instances(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path)


def run_train(spark: SparkSession, input: str, out_dir: str, config: TrainConfig, classes: list[str] | None = None, folds: int = 0, salt: int = 0) -> None:
    """Writes ``model`` (class, feature, weight, epoch), ``model_json`` and, with ``folds``, ``statistics`` (tab-separated) and
    ``predictions`` of cross-validation."""
    rows = _instances(spark, input)
    write_table(train(rows, config, classes=classes), f"{out_dir}/model")
    model = read_table(spark, f"{out_dir}/model")
    epoch = model.agg(F.max("epoch")).first()[0] or 0
    model_to_json(model, config.model, epoch).write.json(f"{out_dir}/model_json")
    if folds > 1:
        stats, predictions = select.cross_validate(rows, config, folds, salt, classes)
        write_tsv(stats.orderBy("stat"), f"{out_dir}/statistics")
        write_table(predictions, f"{out_dir}/predictions")


def run_predict(spark: SparkSession, input: str, model: str, out_dir: str, kind: str = "logistic_regression", skip_final_sort: bool = False, explain: int = 10) -> None:
    """Writes ``predictions`` (id, supporting_data, prediction), tab-separated, largest first unless ``skip_final_sort``, and
    ``explanations`` (id, text) of the ``explain`` features that count most."""
    rows = _instances(spark, input)
    if "supporting_data" not in rows.columns:
        rows = rows.withColumn("supporting_data", F.lit(None).cast("string"))
    long, weights = written(features.long_form(rows, "supporting_data")), read_table(spark, model)
    write_tsv(linear.predict_sorted(long, weights, kind, skip_final_sort, "supporting_data"), f"{out_dir}/predictions")
    if explain:
        write_table(linear.explain_text(linear.explain(long, weights, explain)), f"{out_dir}/explanations")


def parse_space(text: str) -> dict:
    """``rate=log:0.01:1;gauss=uniform:0:0.1;optimizer=in:adagrad|ftrl``."""
    space = {}
    for part in filter(None, (x.strip() for x in text.split(";"))):
        name, _, spec = part.partition("=")
        kind, _, rest = spec.partition(":")
        field = {f.name: str(f.type).split(" ")[0] for f in fields(TrainConfig)}.get(name)
        if field is None or kind not in ("in", "log", "uniform"):
            raise ValueError(f"no such setting: {part}")
        if kind == "in":
            space[name] = select.Choice([getattr(TrainConfig.parse({name: v}), name) for v in rest.split("|")])
        else:
            low, high = map(float, rest.split(":"))
            space[name] = (select.LogUniform if kind == "log" else select.Uniform)(low, high)
    return space


def run_search(spark: SparkSession, input: str, out_dir: str, space: dict, config: TrainConfig, trials: int = 10, classes: list[str] | None = None, metric: str | None = None, seed: int = 0) -> None:
    """Writes ``trials`` and ``report`` of a random search, tab-separated."""
    found, report = select.random_search(_instances(spark, input), space, trials, config, classes, metric, seed)
    write_tsv(found.orderBy(F.desc_nulls_last("metric"), "trial", "param"), f"{out_dir}/trials")
    write_tsv(report.orderBy("param", "bucket"), f"{out_dir}/report")


def run_factorize(spark: SparkSession, input: str, out_dir: str, steps: int = 1, **options) -> None:
    """``steps`` passes of ALS over a table (row, col, value), each from the row factors of the one before; the first goes on
    from the latest factors that ``out_dir`` holds, as when the matrix has changed. See ``factor.chain_als``."""
    factor.chain_als(read_table(spark, input), out_dir, steps, **options)


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="millrace.jobs", description=__doc__)
    jobs = top.add_subparsers(dest="job", required=True)
    for name in ("train", "predict", "search", "factorize"):
        p = jobs.add_parser(name)
        p.add_argument("--input", required=True)
        p.add_argument("--out_dir", required=True)
        if name == "predict":
            p.add_argument("--model", required=True, dest="model_path")
            p.add_argument("--model_type", default="logistic_regression")
            p.add_argument("--skip_final_sort", action="store_true")
            p.add_argument("--explain", type=int, default=10)
        elif name == "factorize":
            p.add_argument("--steps", type=int, default=1)
            p.add_argument("--dimension", type=int, default=200)
            p.add_argument("--row_ridge", type=float, default=0.0)
            p.add_argument("--col_ridge", type=float, default=0.0)
        else:
            p.add_argument("--classes", type=lambda s: s.split(","))
            for f in fields(TrainConfig):
                p.add_argument(f"--{f.name}")
            if name == "train":
                p.add_argument("--folds", type=int, default=0)
                p.add_argument("--salt", type=int, default=0)
            else:
                p.add_argument("--space", required=True, type=parse_space)
                p.add_argument("--trials", type=int, default=10)
                p.add_argument("--metric")
    a = top.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.job == "predict":
        return run_predict(spark, a.input, a.model_path, a.out_dir, a.model_type, a.skip_final_sort, a.explain)
    if a.job == "factorize":
        return run_factorize(spark, a.input, a.out_dir, a.steps, d=a.dimension, row_ridge=a.row_ridge, col_ridge=a.col_ridge)
    config = TrainConfig.parse({f.name: getattr(a, f.name) for f in fields(TrainConfig) if getattr(a, f.name) is not None})
    if a.job == "train":
        return run_train(spark, a.input, a.out_dir, config, a.classes, a.folds, a.salt)
    return run_search(spark, a.input, a.out_dir, a.space, config, a.trials, a.classes, a.metric, config.seed)


if __name__ == "__main__":
    main()
