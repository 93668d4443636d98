"""Classifiers on the modelling dataset: validation, search, holdout, reports.

Tree models (``trees``) are fitted fold by fold in a few threads; all that are fitted
on the same rows share their preprocessing.  Linear models of all folds and settings
are fitted together in shared passes (``linear``), beside the tree models; a single
linear model that is kept or explained is Spark ML's pipeline.
"""

from __future__ import annotations

import dataclasses
import hashlib
import itertools
import json
import math
import random
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta, timezone

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairline import config as C
from fairline.operators import linear
from fairline.operators.trees import Trees
from fairline.session import cut_lineage
from fairline.sources.store import StageStore

METRICS = ("log_loss", "brier", "accuracy")
#: fixed values: predicting one half for everything
BASELINE = {"log_loss": 0.6931, "brier": 0.25, "accuracy": 0.5}

# Default settings and search grids.  ``strength`` is the inverse
# penalty per training row set: regParam = 1 / (strength * rows).
GRIDS: dict[str, dict[str, list]] = {
    "lasso_lr": {"strength": [0.00001, 0.00002, 0.00005, 0.0001, 0.0002, 0.0005, 0.001, 0.002, 0.005, 0.007, 0.01, 0.015,
                              0.02, 0.03, 0.05, 0.07, 0.1, 0.15, 0.2, 0.3, 0.5, 0.7, 1.0, 3.0, 10.0]},
    "ridge_lr": {"strength": [0.000005, 0.00001, 0.00002, 0.00005, 0.0001, 0.0002, 0.0005, 0.001, 0.002, 0.005, 0.007,
                              0.01, 0.015, 0.02, 0.03, 0.05, 0.07, 0.1, 0.15, 0.2, 0.3, 0.5, 0.7, 1.0, 3.0]},
    "elasticnet": {"strength": [0.00005, 0.0001, 0.0005, 0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0, 3.0, 10.0],
                   "l1_ratio": [0.2, 0.4, 0.5, 0.6, 0.8]},
    "logistic": {},
    "gbt": {"trees": [200, 500, 750, 1000, 1500], "depth": [3, 4, 5, 6, 7], "step": [0.005, 0.01, 0.02, 0.05, 0.1],
            "row_share": [0.6, 0.7, 0.8, 1.0], "column_share": [0.5, 0.6, 0.7, 0.8], "min_rows": [1, 5, 10, 20],
            "min_gain": [0.0, 0.1, 0.3, 0.5, 1.0]},
    "random_forest": {"trees": [200, 500], "depth": [5, 8, 10], "min_rows": [1, 5, 10, 20]},
}
DEFAULTS: dict[str, dict] = {
    "lasso_lr": {"strength": 1.0, "l1_ratio": 1.0},
    "ridge_lr": {"strength": 1.0, "l1_ratio": 0.0},
    "elasticnet": {"strength": 1.0, "l1_ratio": 0.5},
    "logistic": {"strength": 1e6, "l1_ratio": 0.0},
    "gbt": {"trees": 200, "depth": 4, "step": 0.05, "row_share": 0.8, "column_share": 0.8, "min_rows": 10, "min_gain": 0.0},
    "random_forest": {"trees": 200, "depth": 8, "min_rows": 5},
}
LINEAR = tuple(m for m, p in DEFAULTS.items() if "strength" in p)


def make_estimator(name: str, rows: int, params: dict | None = None):
    """Estimator of a registered model for ``rows`` training rows."""
    p = {**DEFAULTS[name], **(params or {})}
    if name not in LINEAR:
        return Trees(name, p, C.SEED)
    return LogisticRegression(elasticNetParam=p["l1_ratio"], regParam=1.0 / (p["strength"] * max(rows, 1)),
                              standardization=False, maxIter=1000, tol=1e-5, featuresCol="features", labelCol="label")


def with_label(df: DataFrame, num: Sequence[str], cat: Sequence[str]) -> DataFrame:
    """Nulls to 0 (numbers) or a category of their own, and the label as a double."""
    df = df.fillna(0.0, subset=list(num)) if num else df
    df = df.withColumns({c: linear.category(c) for c in cat}) if cat else df
    return df.withColumn("label", F.col(C.TARGET).cast("double")) if C.TARGET in df.columns else df


def preprocess_stages(num: Sequence[str], cat: Sequence[str]) -> list:
    """Standardised numbers next to one-hot categories; unseen categories are all zero."""
    stages, parts = [], []
    if num:
        stages += [VectorAssembler(inputCols=list(num), outputCol="_num", handleInvalid="keep"),
                   StandardScaler(inputCol="_num", outputCol="_scaled", withMean=True)]
        parts.append("_scaled")
    if cat:
        index, hot = [f"_i_{c}" for c in cat], [f"_h_{c}" for c in cat]
        stages += [StringIndexer(inputCols=list(cat), outputCols=index, handleInvalid="keep"),
                   OneHotEncoder(inputCols=index, outputCols=hot, dropLast=True)]
        parts += hot
    return stages + [VectorAssembler(inputCols=parts, outputCol="features")]


def fit_model(name: str, train: DataFrame, num, cat, params: dict | None = None, rows: int | None = None) -> PipelineModel:
    """Preprocessing and classifier fitted on ``train`` only."""
    ready = with_label(train, num, cat)
    rows = train.count() if rows is None else rows
    return Pipeline(stages=[*preprocess_stages(num, cat), make_estimator(name, rows, params)]).fit(ready)


#: preprocessed rows that are kept at most; of more, each model keeps what it needs (one byte per value, or none)
KEPT_ROWS = 1_000_000


def kept(df: DataFrame, rows: int) -> DataFrame:
    """``df``, kept for the models that read it if it has not too many rows: they take a few passes each."""
    return df.persist() if rows <= KEPT_ROWS else df


def fit_models(names: Sequence[str], train: DataFrame, num, cat, params: dict[str, dict] | None = None, rows: int | None = None) -> dict[str, PipelineModel]:
    """The same for several models, side by side: preprocessing is fitted once for all of them."""
    ready = with_label(train, num, cat)
    rows = train.count() if rows is None else rows
    pre = Pipeline(stages=preprocess_stages(num, cat)).fit(ready)
    x = kept(pre.transform(ready).select("features", "label"), rows)
    try:
        with ThreadPoolExecutor(max(1, len(names))) as pool:
            fits = pool.map(lambda m: make_estimator(m, rows, (params or {}).get(m)).fit(x), names)
            return {m: PipelineModel([*pre.stages, fit]) for m, fit in zip(names, fits)}
    finally:
        x.unpersist()


def predict(model: PipelineModel, df: DataFrame, num, cat) -> DataFrame:
    """``df`` plus ``p``, the chance to win."""
    scored = model.transform(with_label(df, num, cat)).withColumn("p", vector_to_array("probability")[1])
    return scored.select(*df.columns, "p")


def binary_metrics(df: DataFrame, by: Sequence[str] = (), p: str = "p", y: str = "y") -> DataFrame:
    """Log-loss, Brier score and accuracy per group as one aggregate."""
    prob, label = F.col(p), F.col(y).cast("double")
    safe = F.least(F.greatest(prob, F.lit(1e-15)), F.lit(1.0 - 1e-15))
    loss = -(label * F.ln(safe) + (1.0 - label) * F.ln(1.0 - safe))
    return df.groupBy(*by).agg(
        F.avg(loss).alias("log_loss"),
        F.avg((prob - label) * (prob - label)).alias("brier"),
        F.avg(((prob >= 0.5).cast("double") == label).cast("double")).alias("accuracy"),
    )


# --- cross-validation -----------------------------------------------------------


def fold_bounds(folds: DataFrame) -> list[dict]:
    """Date ranges of each fold (one small row per fold)."""
    out = []
    for role in ("train", "val"):
        here = F.col("role") == role
        out += [F.min(F.when(here, F.col("date"))).alias(f"{role}_lo"), F.max(F.when(here, F.col("date"))).alias(f"{role}_hi"),
                F.count_if(here).alias(f"{role}_rows")]
    return [r.asDict() for r in folds.groupBy("fold").agg(*out).orderBy("fold").collect()]


def _between(df: DataFrame, bound: dict, role: str) -> DataFrame:
    """Rows of a fold's role: a date range that reaches the scan as a filter."""
    return df.filter((F.col("date") >= bound[f"{role}_lo"]) & (F.col("date") <= bound[f"{role}_hi"]))


#: rows of a fold that one task fits on
TASK_ROWS = 50_000


def tasks(rows: int) -> int:
    """Tasks that fit on so many rows."""
    return max(1, math.ceil(rows / TASK_ROWS))


def _micros(instant: datetime) -> int:
    """Microseconds of an instant as the driver got it from Spark (naive: in the session's UTC)."""
    return (instant.replace(tzinfo=instant.tzinfo or timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


def linear_fits(bounds: list[dict], jobs: Sequence[tuple[str, str, dict]], columns: dict[str, frozenset[str]] | None = None) -> list[linear.Fit]:
    """One fit per fold and (label, model, params)."""
    out = []
    for b in bounds:
        for label, name, params in jobs:
            p = {**DEFAULTS[name], **params}
            out.append(linear.Fit(label, b["fold"], *(_micros(b[f"{role}_{end}"]) for role in ("train", "val") for end in ("lo", "hi")),
                                  strength=p["strength"], l1_ratio=p["l1_ratio"], columns=(columns or {}).get(label)))
    return out


def _done(ledger: str | None, spark, fold: int, label: str) -> tuple[str | None, bool]:
    """Where the ledger keeps a fit's row, and whether it is there."""
    if ledger is None:
        return None, False
    path = f"{ledger}/{hashlib.sha256(f'{fold}|{label}'.encode()).hexdigest()}"
    return path, StageStore(spark, ledger).load(path.rsplit("/", 1)[1]) is not None


def _fold_scores(
    df: DataFrame, bound: dict, num, cat, jobs: Sequence[tuple[str, str, dict]], ledger: str | None = None, threads: int = 1
) -> list[tuple]:
    """(label, fold, metrics...) for each (label, model, params) on one fold.

    Preprocessing is fitted once for all settings, of which ``threads`` are
    fitted at a time.  With a
    ledger, a fit's row is written as it ends, and a row that is there is read
    instead of fitted again, so a run that was cut off goes on where it was.
    """
    spark, out, left = df.sparkSession, [], []
    for job in jobs:
        path, known = _done(ledger, spark, bound["fold"], job[0])
        if known:
            out.append(tuple(spark.read.schema(_SCORES).parquet(path).first()))
        else:
            left.append((*job, path))
    if not left:
        return out
    train, val = (with_label(_between(df, bound, r), num, cat).coalesce(tasks(bound[f"{r}_rows"])) for r in ("train", "val"))
    pre = Pipeline(stages=preprocess_stages(num, cat)).fit(train)
    x_train = kept(pre.transform(train).select("features", "label"), bound["train_rows"])
    x_val = kept(pre.transform(val).select("features", "label"), bound["val_rows"])

    def scored_row(job):
        label, name, params, path = job
        try:
            model = make_estimator(name, bound["train_rows"], params).fit(x_train)
            scored = model.transform(x_val).withColumn("p", vector_to_array("probability")[1])
            row = (label, bound["fold"], *binary_metrics(scored, y="label").first(), None)
        except Exception as exc:  # noqa: BLE001 - a failing fit is recorded, the others go on
            row = (label, bound["fold"], None, None, None, f"{type(exc).__name__}: {exc}"[:500])
        if path and row[-1] is None:
            spark.createDataFrame([row], _SCORES).coalesce(1).write.mode("overwrite").parquet(path)
        return row

    try:
        with ThreadPoolExecutor(threads) as pool:
            return out + list(pool.map(scored_row, left))
    finally:
        x_train.unpersist()
        x_val.unpersist()


_SCORES = "model string, fold int, log_loss double, brier double, accuracy double, error string"


def _over_folds(df, folds, num, cat, jobs, threads, ledger=None) -> DataFrame:
    """Rows of all jobs on all folds: linear models share passes over the table, each tree model is fitted on its fold."""
    bounds, spark = fold_bounds(folds), df.sparkSession
    straight = [j for j in jobs if j[1] in LINEAR]
    others = [j for j in jobs if j[1] not in LINEAR]
    if others:  # read once per fold; in files ordered by date a fold's range reads few pages
        read = dict.fromkeys(["date", C.TARGET, *num, *cat])
        df = cut_lineage(df.select(*read).sortWithinPartitions("date"), "by-date")
    together = min(threads, max(1, len(bounds)))  # folds at a time; a fold's models share its rows
    with ThreadPoolExecutor(together + 1) as pool:  # one more for the linear models, whose steps leave the executors idle
        linear_part = pool.submit(linear_scores, df, bounds, num, cat, straight) if straight else None
        parts = pool.map(lambda b: _fold_scores(df, b, num, cat, others, ledger, math.ceil(threads / together)), bounds if others else [])
        rows = [r for part in parts for r in part]
        out = spark.createDataFrame(rows, _SCORES)
        return linear_part.result().unionByName(out) if linear_part else out


def linear_scores(df: DataFrame, bounds: list[dict], num, cat, jobs, columns: dict[str, frozenset[str]] | None = None) -> DataFrame:
    """Fold scores of linear models, all folds and jobs in shared passes."""
    made = linear.design(df, num, cat)
    made = dataclasses.replace(made, table=cut_lineage(made.table, "design"))
    fits = linear.fit_many(made, linear_fits(bounds, jobs, columns))
    return linear.score_many(made, fits).withColumn("error", F.lit(None).cast("string"))


def run_cv(
    df: DataFrame, folds: DataFrame, num, cat, models: Sequence[str], params: dict[str, dict] | None = None, threads: int = 8,
    ledger: str | None = None,
) -> DataFrame:
    """Metrics per model and fold.  A fit that fails has no metrics, but its ``error``; ``ledger`` is a folder that keeps finished tree fits."""
    jobs = [(m, m, (params or {}).get(m, {})) for m in models]
    return _over_folds(df, folds, num, cat, jobs, threads, ledger)


def summarise_cv(scores: DataFrame) -> DataFrame:
    """Mean and sample deviation of every metric per model."""
    aggs = []
    for m in METRICS:
        aggs += [F.round(F.avg(m), 5).alias(f"{m}_mean"), F.round(F.stddev_samp(m), 5).alias(f"{m}_std")]
    return scores.groupBy("model").agg(*aggs)


def metric_over_time(scores: DataFrame, calendar: DataFrame) -> DataFrame:
    """Fold scores with the first validation date, in time order."""
    return scores.join(calendar, "fold").orderBy("val_start", "model")


# --- search -----------------------------------------------------------------------


def sample_settings(grid: dict[str, list], n: int, rng: random.Random) -> list[dict]:
    """n different settings of the grid, or all if it has no more."""
    keys = list(grid)
    total = math.prod(len(v) for v in grid.values())
    if total <= n:
        return [dict(zip(keys, combo)) for combo in itertools.product(*grid.values())]

    def at(i: int) -> dict:
        out = {}
        for k in keys:
            i, r = divmod(i, len(grid[k]))
            out[k] = grid[k][r]
        return out

    return [at(i) for i in rng.sample(range(total), n)]


def random_search(
    df: DataFrame, folds: DataFrame, num, cat, models: Sequence[str], n_iter: int = C.TUNE_ITERATIONS,
    grids: dict[str, dict[str, list]] | None = None, threads: int = 8, ledger: str | None = None,
) -> DataFrame:
    """Mean loss per model and setting (JSON); ``best`` marks one setting per model.

    All settings of all models share each fold's preprocessing.  A setting that
    failed on a fold is never the best; among equals the first in JSON order is.
    """
    rng = random.Random(C.SEED)
    settings: dict[str, tuple[str, dict]] = {}
    for m in models:
        grid = (grids or GRIDS)[m]
        for p in sample_settings(grid, n_iter, rng) if grid else [{}]:
            settings[f"{m}:{json.dumps(p, sort_keys=True)}"] = (m, p)
    jobs = [(label, m, p) for label, (m, p) in settings.items()]
    scores = _over_folds(df, folds, num, cat, jobs, threads, ledger)
    names = df.sparkSession.createDataFrame(
        [(label, m, json.dumps(p, sort_keys=True)) for label, (m, p) in settings.items()], "label string, name string, params string"
    )
    ranked = scores.join(names, F.col("model") == F.col("label")).groupBy("name", "params").agg(
        F.avg("log_loss").alias("mean_loss"), F.count("log_loss").alias("n_folds"), F.count_if(F.col("error").isNotNull()).alias("failed")
    )
    order = Window.partitionBy("name").orderBy(F.col("failed") > 0, F.col("mean_loss").asc_nulls_last(), "params")
    best = (F.row_number().over(order) == 1) & (F.col("failed") == 0)
    return ranked.select(F.col("name").alias("model"), "params", "mean_loss", "n_folds", best.alias("best"))


def best_params(found: DataFrame) -> dict[str, dict]:
    """The best setting per model of a search, as ``run_cv`` and others take it (one row per model)."""
    return {r["model"]: json.loads(r["params"]) for r in found.filter("best").select("model", "params").collect()}


# --- holdout, ensembles -------------------------------------------------------------


def holdout_predictions(dev: DataFrame, holdout: DataFrame, num, cat, models, params=None) -> DataFrame:
    """Long table model, gameid, side, p, y; each model refitted on all of ``dev``."""
    straight, keys = [m for m in models if m in LINEAR], ["gameid", "side"]
    if len(straight) < len(models):  # every tree model reads them again
        read = list(dict.fromkeys([*keys, "date", C.TARGET, *num, *cat]))
        dev, holdout = cut_lineage(dev.select(*read), "dev"), cut_lineage(holdout.select(*read), "holdout")
    span = dev.agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("train_lo"), F.max("date").alias("train_hi")).first().asDict()
    rows, out = span["n"], None

    def straight_part():
        made = linear.design(dev, num, cat)
        made = dataclasses.replace(made, table=cut_lineage(made.table, "design"))
        bound = {"fold": 0, "val_lo": span["train_lo"], "val_hi": span["train_hi"], **span}
        fits = linear.fit_many(made, linear_fits([bound], [(m, m, (params or {}).get(m, {})) for m in straight]))
        return linear.predict_many(linear.design(holdout, num, cat, keys, made), fits, keys)

    with ThreadPoolExecutor(1) as pool:  # beside the tree models
        linear_part = pool.submit(straight_part) if straight else None
        if others := [m for m in models if m not in LINEAR]:
            for m, model in fit_models(others, dev.coalesce(tasks(rows)), num, cat, params, rows).items():
                part = predict(model, holdout, num, cat).select(F.lit(m).alias("model"), *keys, "p", F.col(C.TARGET).cast("double").alias("y"))
                out = part if out is None else out.unionByName(part)
        if linear_part:
            out = linear_part.result() if out is None else out.unionByName(linear_part.result())
    return out


def evaluate_holdout(predictions: DataFrame) -> DataFrame:
    """Metrics per model, and the constant baseline."""
    base = predictions.sparkSession.createDataFrame([("baseline", *BASELINE.values())], "model string, log_loss double, brier double, accuracy double")
    return binary_metrics(predictions, ["model"]).unionByName(base)


def ensemble_weights(scores: DataFrame) -> DataFrame:
    """Weight per model, in proportion to the inverse of its mean loss."""
    means = scores.groupBy("model").agg(F.avg("log_loss").alias("mean_loss"))
    total = means.select(F.sum(1.0 / F.col("mean_loss"))).scalar()
    return means.withColumn("weight", (1.0 / F.col("mean_loss")) / total)


def ensemble(predictions: DataFrame, weights: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Weighted mean and plain population deviation of the models' probabilities.

    A model without a weight counts as one of n equals before normalising.
    """
    keys = list(keys)
    if weights is None:
        rows = predictions.withColumn("weight", F.lit(None).cast("double"))
    else:
        rows = predictions.join(weights.select("model", "weight"), "model", "left")
    parts = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("weight").alias("w"),
        F.sum(F.col("weight") * F.col("p")).alias("wp"),
        F.count_if(F.col("weight").isNull()).alias("missing"),
        F.sum(F.when(F.col("weight").isNull(), F.col("p"))).alias("mp"),
        F.stddev_pop("p").alias("model_std"),
    )
    zero = F.lit(0.0)
    w = F.coalesce("w", zero) + F.col("missing") / F.col("n")
    wp = F.coalesce("wp", zero) + F.coalesce("mp", zero) / F.col("n")
    return parts.select(*keys, (wp / w).alias("p_ensemble"), "model_std")


# --- feature sets ---------------------------------------------------------------------

# Name parts of each feature group, and the sets compared.
GROUPS = {
    "A_elo": ("elo_",),
    "B_form": ("wr_", "ewma_", "avg_opp_elo_", "overperf_"),
    "C_earlygame": ("gdiff", "xpdiff", "pct_pos_", "pct_gdiff", "fb_rate", "fd_rate", "fh_rate", "ft_rate", "fbar_rate"),
    "C_thresholds": ("pct_gdiff15_gt", "pct_gdiff15_lt", "pct_gdiff10_gt", "pct_gdiff10_lt"),
    "D_conversion": ("lead_conv_rate", "comeback_rate", "strong_lead_conv", "avg_gdiff15_when"),
    "E_objectives": ("dragon_share", "herald_share", "baron_share", "tower_share", "plate_share"),
    "F_style": ("pace_mean", "vision_mean", "economy_mean", "aggression_mean", "gamelength_mean"),
    "G_side": ("is_blue", "blue_wr", "red_wr", "same_side_wr", "patch_blue_wr", "side_wr_vs_patch"),
    "H_patch": ("patch_wr_shrunk", "patch_gdiff15_shrunk"),
    "K_interactions": ("ix_",),
}
#: The ten feature sets of the ablation.
SETS = {
    "A_elo_only": ("A_elo",),
    "A+B": ("A_elo", "B_form"),
    "A+B+C": ("A_elo", "B_form", "C_earlygame"),
    "A+B+C+thresholds": ("A_elo", "B_form", "C_earlygame", "C_thresholds"),
    "Tier1": ("A_elo", "B_form", "C_earlygame", "D_conversion"),
    "Tier1+thresholds": ("A_elo", "B_form", "C_earlygame", "C_thresholds", "D_conversion"),
    "Tier1+2_no_style": (
        "A_elo", "B_form", "C_earlygame", "C_thresholds",
        "D_conversion", "E_objectives", "G_side",
    ),
    "Tier1+2_with_style": (
        "A_elo", "B_form", "C_earlygame", "C_thresholds", "D_conversion",
        "E_objectives", "F_style", "G_side",
    ),
    "Tier1+2+interactions": (
        "A_elo", "B_form", "C_earlygame", "C_thresholds", "D_conversion",
        "E_objectives", "G_side", "K_interactions",
    ),
    "Full": (
        "A_elo", "B_form", "C_earlygame", "C_thresholds", "D_conversion", "E_objectives",
        "F_style", "G_side", "H_patch", "K_interactions",
    ),
}


def columns_in(groups: Sequence[str], num: Sequence[str]) -> list[str]:
    """Numeric columns whose name contains a part of one of the groups."""
    parts = [p for g in groups for p in GROUPS[g]]
    return [c for c in num if any(p in c for p in parts)]


def set_scores(df: DataFrame, folds: DataFrame, cat, model: str, sets: dict[str, Sequence[str]], params: dict | None = None, threads: int = 8) -> DataFrame:
    """Fold scores per column set: ablation, n_features, fold, metrics.

    Sets with the same columns are fitted once.  A linear model takes every set
    as a part of one table, in shared passes.
    """
    distinct: dict[frozenset[str], str] = {}
    for cols in sets.values():
        distinct.setdefault(frozenset(cols), f"set{len(distinct)}")
    if model in LINEAR:
        num = sorted(set().union(*sets.values()))
        scores = linear_scores(df, fold_bounds(folds), num, cat, [(name, model, params or {}) for name in distinct.values()], {n: c for c, n in distinct.items()})
    else:
        scores = None
        for cols, name in distinct.items():
            part = run_cv(df, folds, sorted(cols), cat, [model], {model: params or {}}, threads).withColumn("model", F.lit(name))
            scores = part if scores is None else scores.unionByName(part)
    names = df.sparkSession.createDataFrame([(distinct[frozenset(c)], name, len(c)) for name, c in sets.items()], "model string, ablation string, n_features int")
    return cut_lineage(scores.join(names, "model").drop("model"), "set-scores")


def run_ablation(
    df: DataFrame, folds: DataFrame, num, cat, model: str = "ridge_lr", params: dict | None = None,
    sets: dict[str, Sequence[str]] | None = None, threads: int = 8,
) -> DataFrame:
    """Fold scores per feature set; sets without a column are left out."""
    chosen = {name: columns_in(groups, num) for name, groups in (sets or SETS).items()}
    return set_scores(df, folds, cat, model, {n: c for n, c in chosen.items() if c}, params, threads)


def ablation_table(scores: DataFrame) -> DataFrame:
    """Mean and population deviation of the loss per feature set."""
    return scores.groupBy("ablation", "n_features").agg(
        F.avg("log_loss").alias("mean_logloss"), F.stddev_pop("log_loss").alias("std_logloss")
    )


def compare_feature_sets(df, folds, cat, pairs: Sequence[tuple[tuple[str, Sequence[str]], tuple[str, Sequence[str]]]], model="ridge_lr") -> DataFrame:
    """Pairs of named column sets on the same folds: mean losses, and how far each is above its pair's first."""
    sets = {name: list(cols) for pair in pairs for name, cols in pair}
    table = ablation_table(set_scores(df, folds, cat, model, sets))
    of = df.sparkSession.createDataFrame([(name, a[0]) for a, b in pairs for name in (a[0], b[0])], "ablation string, first string")
    first = table.select(F.col("ablation").alias("first"), F.col("mean_logloss").alias("base"))
    return table.join(of, "ablation").join(first, "first").withColumn("delta", F.col("mean_logloss") - F.col("base")).drop("first", "base")


def importance_table(model: PipelineModel, scored: DataFrame, num: Sequence[str], top: int | None = 30) -> DataFrame:
    """Feature importances or coefficients by size, zero ones left out."""
    scaled = {f"_scaled_{i}": c for i, c in enumerate(num)}
    last = model.stages[-1]
    values = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    attrs = scored.schema["features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for group in attrs.values() for a in group}
    shown = lambda i: scaled.get(names.get(i), names.get(i, f"f{i}"))
    rows = [(shown(i), float(v)) for i, v in enumerate(values.toArray()) if v != 0.0]
    out = scored.sparkSession.createDataFrame(rows, "feature string, value double")
    out = out.orderBy(F.abs("value").desc(), "feature")
    return out if top is None else out.limit(top)
