"""Models on the same rows share their preprocessing, and give what separate fits give."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairline import config as C
from fairline.operators import modelling as M

NUM = ["n0", "n1"]
START = datetime(2024, 1, 1)
SMALL = {"random_forest": {"trees": 3, "depth": 2}, "gbt": {"trees": 2, "depth": 2}}


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(7)
    x = r.normal(size=(300, 2))
    y = x[:, 0] + r.normal(size=300) > 0
    made = [(f"g{i}", "Blue", START + timedelta(hours=i), int(y[i]), float(x[i, 0]), float(x[i, 1]), "ab"[i % 2]) for i in range(300)]
    return spark.createDataFrame(made, f"gameid string, side string, date timestamp, {C.TARGET} int, n0 double, n1 double, cat string").cache()


@pytest.fixture(scope="module")
def folds(rows):
    """Two folds: 150 hours to train, 75 to validate."""
    hours = (F.unix_timestamp("date") - F.lit(int((START - datetime(1970, 1, 1)).total_seconds()))) / 3600
    one = lambda k: F.when((hours >= 75 * k) & (hours < 75 * k + 150), "train").when((hours >= 75 * k + 150) & (hours < 75 * k + 225), "val")
    parts = [rows.select(F.lit(k).alias("fold"), one(k).alias("role"), "gameid", "side", "date").filter("role is not null") for k in range(2)]
    return parts[0].unionByName(parts[1]).cache()


@pytest.fixture
def prepared(monkeypatch):
    """One entry for each time that preprocessing is set up to be fitted."""
    made, stages = [], M.preprocess_stages
    monkeypatch.setattr(M, "preprocess_stages", lambda num, cat: made.append(1) or stages(num, cat))
    return made


def test_tree_models_of_a_fold_share_its_rows(rows, folds, prepared):
    got = {(r.model, r.fold): tuple(r)[2:] for r in M.run_cv(rows, folds, NUM, ["cat"], ["ridge_lr", *SMALL], SMALL).collect()}
    assert len(prepared) == 2 and len(got) == 6 and all(v[-1] is None for v in got.values())
    for m in SMALL:  # alone
        alone = {(r.model, r.fold): tuple(r)[2:] for r in M.run_cv(rows, folds, NUM, ["cat"], [m], SMALL).collect()}
        assert all(got[k] == v for k, v in alone.items())


def test_settings_of_a_fold_share_its_rows(rows, folds, prepared):
    grids = {"random_forest": {"trees": [1, 2], "depth": [1, 2]}}
    found = M.random_search(rows, folds, NUM, ["cat"], list(grids), 4, grids).collect()
    assert len(prepared) == 2 and len(found) == 4 and all(r.n_folds == 2 for r in found)


def test_holdout_models_share_rows(rows, prepared):
    dev, late = rows.filter("date < '2024-01-10'"), rows.filter("date >= '2024-01-10'")
    p = M.holdout_predictions(dev, late, NUM, ["cat"], ["ridge_lr", *SMALL], SMALL).collect()
    assert len(prepared) == 1 and len(p) == 3 * late.count()
    for m in SMALL:
        alone = {r.gameid: r.p for r in M.predict(M.fit_model(m, dev.coalesce(1), NUM, ["cat"], SMALL[m]), late, NUM, ["cat"]).collect()}
        assert {r.gameid: r.p for r in p if r.model == m}.keys() == alone.keys()


def test_kept_models_share_rows(rows, prepared):
    one = rows.coalesce(1)
    fits = M.fit_models(["ridge_lr", "gbt"], one, NUM, ["cat"], SMALL)
    assert len(prepared) == 1 and list(fits) == ["ridge_lr", "gbt"]
    for m, fit in fits.items():
        score = lambda f: sorted((r.gameid, r.p) for r in M.predict(f, rows, NUM, ["cat"]).collect())
        assert score(fit) == score(M.fit_model(m, one, NUM, ["cat"], SMALL.get(m)))
