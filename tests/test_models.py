"""Real fits on small tables, and that model queries run the whole job: all folds, models, settings, sets and comparisons."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairline import config as C
from fairline.catalog import models
from fairline.operators import modelling as M
from fairline.session import scratch_path
from fairline.sources import store

NUM = [f"n{j}" for j in range(6)]
START = datetime(2024, 1, 1)
SMALL = {"random_forest": {"trees": 5, "depth": 3}, "gbt": {"trees": 3, "depth": 2}}


@pytest.fixture(scope="module")
def games(spark):
    """600 hourly rows: the label follows n0 and n2; n5 = n0 - n1; a category with nulls and one that only late rows have."""
    r = np.random.default_rng(1)
    x = r.normal(size=(600, 6))
    x[:, 5] = x[:, 0] - x[:, 1]
    y = x[:, 0] * 1.2 - x[:, 2] + r.normal(size=600) > 0
    rows = [
        (f"g{i}", "Blue", START + timedelta(hours=i), int(y[i]), *[float(v) * (j + 1) + 10 * j for j, v in enumerate(x[i])], None if i % 7 == 0 else "late" if i > 450 and i % 2 else "ab"[i % 2])
        for i in range(600)
    ]
    schema = f"gameid string, side string, date timestamp, {C.TARGET} int, " + ", ".join(f"{c} double" for c in NUM) + ", cat string"
    return spark.createDataFrame(rows, schema).repartition(3).cache()


@pytest.fixture(scope="module")
def folds(games):
    """Two folds: 400 hours to train, 100 to validate."""
    hours = (F.unix_timestamp("date") - F.lit(int((START - datetime(1970, 1, 1)).total_seconds()))) / 3600
    parts = []
    for k in range(2):
        role = F.when((hours >= 100 * k) & (hours < 100 * k + 400), "train").when((hours >= 100 * k + 400) & (hours < 100 * k + 500), "val")
        parts.append(games.select(F.lit(k).alias("fold"), role.alias("role"), "gameid", "side", "date").filter("role is not null"))
    return parts[0].unionByName(parts[1]).cache()


def metrics(df, key="model"):
    return {(r[key], r.fold): np.array([r.log_loss, r.brier, r.accuracy]) for r in df.collect()}


def test_linear_models_equal_spark_ml(games, folds):
    """All folds and penalties fitted together give what separate fits give."""
    jobs = [(m, m, {}) for m in M.LINEAR] + [("l", "lasso_lr", {"strength": 0.02}), ("r", "ridge_lr", {"strength": 0.01}), ("e", "elasticnet", {"strength": 0.05, "l1_ratio": 0.4})]
    bounds = M.fold_bounds(folds)
    assert [b["train_rows"] for b in bounds] == [400, 400] and [b["val_rows"] for b in bounds] == [100, 100]
    got = metrics(M.linear_scores(games, bounds, NUM, ["cat"], jobs))
    want = {(r[0], r[1]): np.array(r[2:5]) for b in bounds for r in M._fold_scores(games, b, NUM, ["cat"], jobs)}
    assert got.keys() == want.keys() and len(got) == 14
    for k in got:
        assert np.allclose(got[k], want[k], atol=5e-4), k  # L-BFGS stops at its tolerance, a little before the minimum
    assert len({round(v[0], 4) for v in got.values()}) > 8  # penalties differ


def test_linear_fit_is_the_minimum(games):
    """No small change of a weight lowers the penalised loss."""
    made = M.linear.design(games, NUM, ["cat"])
    lo, hi = M._micros(START), M._micros(START + timedelta(hours=399))
    fits = [M.linear.Fit("a", 0, lo, hi, strength=0.03, l1_ratio=a) for a in (0.0, 0.5, 1.0)]
    M.linear.fit_many(made, fits)
    rows = made.table.filter((F.col("t") >= lo) & (F.col("t") <= hi)).collect()
    x, y = np.array([r.x for r in rows]), np.array([r.y for r in rows])
    for fit in fits:
        s, r = fit.standardised(x), 1 / (0.03 * 400)

        def loss(w):
            z = s @ w
            return (np.logaddexp(0, z) - y * z).mean() + r * (fit.l1_ratio * abs(w[:-1]).sum() + (1 - fit.l1_ratio) * (w[:-1] ** 2).sum() / 2)

        best = loss(fit.weights)
        assert fit.rows == 400 and fit.weights[made.names.index("cat=late")] == 0
        for j in range(len(fit.weights)):
            for e in (-1e-3, 1e-3):
                w = fit.weights.copy()
                w[j] += e
                assert loss(w) > best - 1e-9
    assert (fits[2].weights == 0).sum() > (fits[0].weights == 0).sum()


def test_cv_resumes_from_its_ledger(spark, games, folds, monkeypatch):
    ledger = scratch_path(spark, "ledger")
    run = lambda: {k: v.tolist() for k, v in metrics(M.run_cv(games, folds, NUM, ["cat"], ["ridge_lr", *SMALL], SMALL, ledger=ledger)).items()}
    first = run()
    assert len(first) == 6 and all(0 < v[0] < 0.75 for v in first.values())
    plain = {k: v.tolist() for k, v in metrics(M.run_cv(games, folds, NUM, ["cat"], ["ridge_lr", *SMALL], SMALL)).items()}
    assert plain == first

    def broken(*_):
        raise RuntimeError("fitted again")

    monkeypatch.setattr(M, "make_estimator", broken)
    assert run() == first
    failed = M.run_cv(games, folds, NUM, ["cat"], ["gbt"], SMALL).collect()
    assert all(r.log_loss is None and "fitted again" in r.error for r in failed)


def test_search_covers_all_settings(games, folds):
    grids = {"ridge_lr": {"strength": [0.001, 0.1, 1.0]}, "random_forest": {"trees": [3], "depth": [1, 2]}, "logistic": {}}
    found = M.random_search(games, folds, NUM, ["cat"], list(grids), 3, grids).collect()
    assert len(found) == 6 and all(r.n_folds == 2 for r in found)
    assert sum(r.best for r in found) == 3
    best = {r.model: r.mean_loss for r in found if r.best}
    assert all(r.mean_loss >= best[r.model] for r in found)
    tuned = M.best_params(M.random_search(games, folds, NUM, ["cat"], ["ridge_lr"], 3, grids))
    assert set(tuned) == {"ridge_lr"} and set(tuned["ridge_lr"]) == {"strength"}


def test_sets_equal_separate_fits(games, folds):
    sets = {"all": NUM, "again": NUM[::-1], "three": NUM[:3], "one": NUM[4:5]}
    got = metrics(M.set_scores(games, folds, ["cat"], "ridge_lr", sets), "ablation")
    assert len(got) == 8 and all((got["all", k] == got["again", k]).all() for k in (0, 1))
    for name, cols in sets.items():
        alone = metrics(M.run_cv(games, folds, cols, ["cat"], ["ridge_lr"]))
        assert all(np.allclose(got[name, k], alone["ridge_lr", k], atol=1e-7) for k in (0, 1))
    table = M.compare_feature_sets(games, folds, ["cat"], [(("three", NUM[:3]), ("all", NUM)), (("one", NUM[4:5]), ("all", NUM))]).collect()
    mean = {n: np.mean([got[n, k][0] for k in (0, 1)]) for n in sets}
    deltas = sorted(r.delta for r in table if r.ablation == "all")
    assert np.allclose(deltas, sorted([mean["all"] - mean["three"], mean["all"] - mean["one"]]), atol=1e-7)
    assert all(r.delta == 0 for r in table if r.ablation != "all")


def test_holdout_and_importances(games):
    dev, late = games.filter("date < '2024-01-20'"), games.filter("date >= '2024-01-20'")
    p = M.holdout_predictions(dev, late, NUM, ["cat"], ["ridge_lr", *SMALL], SMALL)
    rows = p.collect()
    n = late.count()
    assert len(rows) == 3 * n and all(0 < r.p < 1 for r in rows)
    table = {r.model: r for r in M.evaluate_holdout(p).collect()}
    assert set(table) == {"ridge_lr", "baseline", *SMALL} and table["ridge_lr"].log_loss < table["baseline"].log_loss
    fitted = M.predict(M.fit_model("ridge_lr", dev, NUM, ["cat"]), late, NUM, ["cat"])
    alone = {r.gameid: r.p for r in fitted.collect()}
    assert all(abs(alone[r.gameid] - r.p) < 1e-3 for r in rows if r.model == "ridge_lr")
    model = M.fit_model("lasso_lr", dev, NUM, ["cat"], {"strength": 0.05})
    top = M.importance_table(model, model.transform(M.with_label(late, NUM, ["cat"])), NUM).collect()
    # n0 and n2 decide the label; n5 stands for n0 in part
    assert {top[0].feature, top[1].feature} <= {"n0", "n2", "n5"} and all(r.value != 0 for r in top)


def test_bundles(spark, games):
    root = scratch_path(spark, "bundles")
    with pytest.raises(FileNotFoundError):
        store.load_bundle(spark, root)
    fits = {k: M.fit_model("ridge_lr", games, NUM, ["cat"], {"strength": s}) for k, s in (("weak", 1.0), ("strong", 0.001))}
    assert store.save_bundle(spark, fits["weak"], root, "ridge_lr", NUM, ["cat"], log_loss=0.5, trained=[START, START]) == 1
    assert store.save_bundle(spark, fits["strong"], root, "ridge_lr", NUM, ["cat"]) == 2
    fits["weak"].write().save(f"{root}/ridge_lr/000003/model")  # cut off before its manifest
    fits["weak"].write().save(f"{root}/gbt/000001/model")
    manifest, model = store.load_bundle(spark, root)
    assert (manifest["name"], manifest["version"], manifest["numbers"]) == ("ridge_lr", 2, NUM)
    score = lambda m: sorted((r.gameid, r.p) for r in M.predict(m, games, manifest["numbers"], manifest["categories"]).collect())
    assert score(model) == score(fits["strong"]) != score(fits["weak"])
    store.check_columns(manifest, games)
    with pytest.raises(ValueError, match="n3"):
        store.check_columns(manifest, games.drop("n3"))


# --- what the queries ask for -------------------------------------------------------

WIDE = ["elo_team", "elo_decayed_team", "ix_dec_elo", "opp_pct_gdiff15_gt500", "pace_mean_L10", "wr_L5"]


class Table:
    def unionByName(self, other):
        return self


@pytest.fixture
def calls(monkeypatch):
    """Arguments of the operators, which do no work; the last n folds are ("last", n)."""
    made = []
    for name in ("run_cv", "random_search", "holdout_predictions", "run_ablation", "compare_feature_sets"):
        monkeypatch.setattr(M, name, lambda *a, _n=name, **k: made.append((_n, a, {x: v for x, v in k.items() if x != "ledger"})) or Table())
    monkeypatch.setattr(M, "ablation_table", lambda t: t)
    monkeypatch.setattr(M, "evaluate_holdout", lambda t: t)
    monkeypatch.setattr(models, "stage", lambda spark, sf, name, build: build())
    monkeypatch.setattr(models, "_ledger", lambda spark, sf, name: name)
    monkeypatch.setattr(models, "_parts", lambda spark, sf: ("dev", "holdout", WIDE, ["league"]))
    monkeypatch.setattr(models, "folds", lambda spark, sf: "all folds")
    monkeypatch.setattr(models.validation, "last_folds", lambda folds, n=30: ("last", n))
    return made


def test_whole_work(calls):
    for query in (models.cross_validation, models.search, models.holdout_evaluation, models.ablation):
        query(None, "")
    cv, search, holdout, ablation = calls
    assert set(M.DEFAULTS) == {"lasso_lr", "ridge_lr", "elasticnet", "logistic", "gbt", "random_forest"}
    assert cv[1][1] == "all folds" and set(cv[1][4]) == set(M.DEFAULTS) and not cv[1][5:] and not cv[2]
    assert search[1][1] == ("last", 30) and set(search[1][4]) == set(M.DEFAULTS) and not search[2]
    assert set(holdout[1][4]) == set(M.DEFAULTS) and not holdout[1][5:] and not holdout[2]
    assert ablation[1][1] == ("last", 30) and not ablation[2] and len(M.SETS) == 10


def test_four_comparisons(calls):
    models.comparison(None, "")
    (_, a, _), = calls
    assert a[1] == ("last", 20)
    left_out = {first: set(WIDE) - set(cols) for (first, cols), _ in a[3]}
    assert left_out == {
        "without_style": {"pace_mean_L10"}, "without_interactions": {"ix_dec_elo"},
        "without_thresholds": {"opp_pct_gdiff15_gt500"}, "without_decayed_elo": {"elo_decayed_team", "ix_dec_elo"},
    }
    assert all(second[1] == WIDE for _, second in a[3])
