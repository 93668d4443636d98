"""Queries for metrics, validation, search, ensembles and predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairline import fixtures
from fairline.aliases import TEAM_ALIASES
from fairline.catalog.base import Registry, match_slices, register, sql, stage
from fairline.catalog.dataset import feature_rows, roster_rows
from fairline.catalog.markets import parsed
from fairline.catalog.pricing import SCORED
from fairline.catalog.reports import pairs
from fairline.catalog.splits import assignment, folds
from fairline.operators import dataset, draft, features, matchups, reports, validation
from fairline.operators import modelling as M
from fairline.session import scratch_path
from fairline.sources.store import check_columns, load_bundle, save_bundle

REGISTRY: Registry = {}

#: every registered model, fitted with its default settings
ALL = tuple(M.DEFAULTS)
#: last folds that feature sets are compared on
COMPARED_FOLDS = 20
#: whether a comparison's first side goes without a column
COMPARED = {
    "style": lambda c: any(f"{w}_mean_L10" in c for w in ("pace", "vision", "economy", "aggression", "gamelength")),
    "interactions": lambda c: "ix_" in c,
    "thresholds": lambda c: c.removeprefix("opp_").removeprefix("diff_").startswith(M.GROUPS["C_thresholds"]),
    "decayed_elo": lambda c: c.startswith(("elo_decayed_team", "elo_decayed_opp", "elo_decayed_diff", "ix_dec_elo")),
}


# --- tables of scores that SQL can check ---------------------------------------------

MODELS = SCORED + """,
pm AS (SELECT match_id, 'a' AS model, p_model AS p, result AS y, CAST(day(date) % 5 AS INTEGER) AS fold FROM sc
  UNION ALL SELECT match_id, 'b', p_market, result, CAST(day(date) % 5 AS INTEGER) FROM sc
  UNION ALL SELECT match_id, 'c', (p_model + p_market) / 2, result, CAST(day(date) % 5 AS INTEGER) FROM sc),
ms AS (SELECT model, fold, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS log_loss, avg((p - y) * (p - y)) AS brier,
  avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0::DOUBLE ELSE 0 END) AS accuracy FROM pm GROUP BY ALL)"""


def probabilities(spark, sf):
    p = F.explode(F.array(
        F.struct(F.lit("a").alias("model"), F.col("p_model").alias("p")),
        F.struct(F.lit("b").alias("model"), F.col("p_market").alias("p")),
        F.struct(F.lit("c").alias("model"), ((F.col("p_model") + F.col("p_market")) / 2).alias("p")))).alias("m")
    rows = fixtures.scored(spark, sf).select("match_id", F.col("result").alias("y"), (F.dayofmonth("date") % 5).alias("fold"), p)
    return rows.select("match_id", "m.model", "m.p", "y", "fold")


def fold_scores(spark, sf):
    return M.binary_metrics(probabilities(spark, sf), ["model", "fold"])


@register(REGISTRY, "M5_binary_metrics", sql(MODELS, "SELECT * FROM ms", ["model", "fold"], M.METRICS))
def metrics(spark, sf):
    return fold_scores(spark, sf)


@register(REGISTRY, "A5_cv_summary",
          sql(MODELS, "SELECT model, " + ", ".join(f"avg({m}) AS {m}_mean, stddev_samp({m}) AS {m}_std" for m in M.METRICS)
              + " FROM ms GROUP BY model", ["model"], [f"{m}_{x}" for m in M.METRICS for x in ("mean", "std")], 5), 5)
def cv_summary(spark, sf):
    return M.summarise_cv(fold_scores(spark, sf))


@register(REGISTRY, "A15_ablation_table",
          sql(MODELS, "SELECT model AS ablation, 3 AS n_features, avg(log_loss) AS mean_logloss, stddev_pop(log_loss) AS std_logloss "
                      "FROM ms GROUP BY model", ["ablation", "n_features"], ["mean_logloss", "std_logloss"]))
def ablation_summary(spark, sf):
    scores = fold_scores(spark, sf).withColumnRenamed("model", "ablation").withColumn("n_features", F.lit(3))
    return M.ablation_table(scores)


@register(REGISTRY, "A6_calibration_bins",
          sql(MODELS, "SELECT model, CAST(" + " + ".join(
              f"CASE WHEN p > {i * 0.1!r}::DOUBLE THEN 1 ELSE 0 END" for i in range(1, 10))
              + " AS INTEGER) AS bin, count(*) AS n, avg(p) AS mean_predicted, avg(y) AS win_share FROM pm GROUP BY ALL",
              ["model", "bin", "n"], ["mean_predicted", "win_share"]))
def calibration_bins(spark, sf):
    return reports.calibration_uniform(probabilities(spark, sf), ["model"])


@register(REGISTRY, "M10_ensemble_weights",
          sql(MODELS, "SELECT model, mean_loss, (1 / mean_loss) / sum(1 / mean_loss) OVER () AS weight FROM ("
                      "SELECT model, avg(log_loss) AS mean_loss FROM ms GROUP BY model)", ["model"], ["mean_loss", "weight"]))
def weights(spark, sf):
    return M.ensemble_weights(fold_scores(spark, sf))


@register(REGISTRY, "M11_ensemble",
          sql(MODELS + """,
wt AS (SELECT model, (1 / l) / sum(1 / l) OVER () AS w FROM (SELECT model, avg(log_loss) AS l FROM ms GROUP BY model))""",
              """SELECT match_id, sum(coalesce(w, 1 / 3.0::DOUBLE) * p) / sum(coalesce(w, 1 / 3.0::DOUBLE)) AS p_ensemble,
  stddev_pop(p) AS model_std FROM pm LEFT JOIN (SELECT * FROM wt WHERE model <> 'c') USING (model) GROUP BY match_id""",
              ["match_id"], ["p_ensemble", "model_std"]))
def ensemble(spark, sf):
    """Model c has no weight and counts as one of three equals."""
    known = M.ensemble_weights(fold_scores(spark, sf)).filter(F.col("model") != "c")
    return M.ensemble(probabilities(spark, sf), known, ["match_id"])


# --- fits -----------------------------------------------------------------------------


def _parts(spark, sf):
    """Development and holdout rows, not stored: who reads them more than once stores what it reads.

    Games are parted before their rows get the opponent's columns, so the narrow rows are moved, once for both steps.
    """
    parts = validation.split_rows(feature_rows(spark, sf), assignment(spark, sf))
    dev, holdout = (dataset.mirror_dataset(part) for part in parts)
    return dev, holdout, *dataset.model_columns(dev)


def _stored_parts(spark, sf):
    """The same for Spark ML's fits, which read the development rows again and again."""
    dev, holdout, num, cat = _parts(spark, sf)
    return stage(spark, sf, "dev", lambda: dev), holdout, num, cat


_LEDGERS: dict[tuple[str, str, str], str] = {}


def _ledger(spark, sf, name):
    """Folder of finished fits; the same for every call of one application."""
    return _LEDGERS.setdefault((spark.sparkContext.applicationId, sf, name), scratch_path(spark, f"ledger-{name}"))


def _cv(spark, sf):
    def build():
        dev, _, num, cat = _parts(spark, sf)
        return M.run_cv(dev, folds(spark, sf), num, cat, ALL, ledger=_ledger(spark, sf, "cv"))

    return stage(spark, sf, "cv", build)


@register(REGISTRY, "M1_M2_M3_M6_cross_validation")
def cross_validation(spark, sf):
    return _cv(spark, sf)


@register(REGISTRY, "V7_metric_over_time")
def over_time(spark, sf):
    return M.metric_over_time(_cv(spark, sf), validation.fold_calendar(folds(spark, sf)))


@register(REGISTRY, "M7_random_search")
def search(spark, sf):
    dev, _, num, cat = _parts(spark, sf)
    return M.random_search(dev, validation.last_folds(folds(spark, sf)), num, cat, ALL, ledger=_ledger(spark, sf, "search"))


def _holdout(spark, sf):
    def build():
        dev, holdout, num, cat = _parts(spark, sf)
        return M.holdout_predictions(dev, holdout, num, cat, ALL)

    return stage(spark, sf, "holdout_p", build)


@register(REGISTRY, "M4_M9_holdout_evaluation")
def holdout_evaluation(spark, sf):
    return M.evaluate_holdout(_holdout(spark, sf))


@register(REGISTRY, "A6_holdout_calibration")
def holdout_calibration(spark, sf):
    return reports.calibration_uniform(_holdout(spark, sf), ["model"])


@register(REGISTRY, "M12_ablation")
def ablation(spark, sf):
    dev, _, num, cat = _parts(spark, sf)
    return M.ablation_table(M.run_ablation(dev, validation.last_folds(folds(spark, sf)), num, cat))


@register(REGISTRY, "M13_feature_set_comparison")
def comparison(spark, sf):
    dev, _, num, cat = _parts(spark, sf)
    pairs = [((f"without_{name}", [c for c in num if not out(c)]), (f"with_{name}", num)) for name, out in COMPARED.items()]
    return M.compare_feature_sets(dev, validation.last_folds(folds(spark, sf), COMPARED_FOLDS), cat, pairs)


@register(REGISTRY, "T5_importances")
def importances(spark, sf):
    dev, holdout, num, cat = _stored_parts(spark, sf)
    out, rows = None, dev.count()
    for name, model in M.fit_models(("gbt", "lasso_lr"), dev.coalesce(M.tasks(rows)), num, cat, rows=rows).items():
        scored = model.transform(M.with_label(holdout, num, cat))
        part = M.importance_table(model, scored, num).withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@register(REGISTRY, "S9_M14_saved_model_matchups")
def saved_model(spark, sf):
    """Two models are saved with their columns, the preferred one is found again and used on pairs of teams."""
    dev, _, num, cat = _stored_parts(spark, sf)
    root, rows = scratch_path(spark, "models"), dev.count()
    for name, fit in M.fit_models(("ridge_lr", "gbt"), dev.coalesce(M.tasks(rows)), num, cat, rows=rows).items():
        save_bundle(spark, fit, root, name, num, cat, rows=rows)
    manifest, model = load_bundle(spark, root)
    found = matchups.matchup_rows(pairs(spark, sf), feature_rows(spark, sf))
    check_columns(manifest, found)
    return matchups.predict_matchups(M.with_label(found, manifest["numbers"], manifest["categories"]), model, ["pair"])


@register(REGISTRY, "M15_draft_model")
def draft_model(spark, sf):
    """Holdout metrics of every model with and without the draft groups."""
    slices = match_slices(spark, sf)

    def build():
        rows = draft.draft_features(roster_rows(spark, sf, slices), slices)
        return dataset.mirror_dataset(features.build_features(rows, slices))

    ds = stage(spark, sf, "draft_dataset", build)
    num, cat = dataset.model_columns(ds)
    dev, holdout = validation.split_rows(ds, assignment(spark, sf))
    plain = [c for c in num if not any(w in c for w in ("champ_", "series_", "has_first_pick"))]
    out = None
    for label, cols in (("pre_draft", plain), ("draft", num)):
        p = M.holdout_predictions(dev, holdout, cols, cat, ALL)
        part = M.binary_metrics(p, ["model"]).withColumns({"columns": F.lit(label), "n_features": F.lit(len(cols))})
        out = part if out is None else out.unionByName(part)
    return out


@register(REGISTRY, "M14_B15_market_backtest")
def market_backtest(spark, sf):
    """Settled markets to bets: names, as-of rows, model, rating price, ledger."""
    dev, _, num, cat = _stored_parts(spark, sf)
    model = M.fit_model("ridge_lr", dev, num, cat)
    found = matchups.backtest_rows(parsed(spark, sf), feature_rows(spark, sf), TEAM_ALIASES)
    bets = matchups.backtest(M.with_label(found, num, cat), model)
    return bets.select("match_id", "p_model", "p_market", "result", "bet_direction", "stake", "directional_pnl", "cumulative_pnl")
