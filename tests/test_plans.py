"""Prefix operators: many slices, short runs and hot keys change nothing."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fairline.plans.affine import affine_scan
from fairline.plans.asof import asof_rows
from fairline.plans.history import Agg, anonymous_key, cut_runs, drop_halo, with_history
from fairline.operators.modelling import best_params
from fairline.plans.slices import NARROWING, ONE_SLICE, Slices, plan_slices
from fairline.streaming.ingest import RatingSink


@pytest.fixture(scope="module")
def log(spark):
    """Rows of four keys; one key holds most of them; some values are null."""
    rng = random.Random(7)
    rows = []
    for i in range(1500):
        key = "hot" if rng.random() < 0.7 else rng.choice("abc")
        v = None if rng.random() < 0.2 else rng.uniform(-5, 5)
        rows.append((key, i, 1_700_000_000 + rng.randrange(0, 86_400 * 20), v))
    df = spark.createDataFrame(rows, "key string, id int, sec long, v double")
    return df.withColumn("date", F.timestamp_seconds("sec")).cache()


def aggs():
    v = F.col("v")
    return [Agg("n", "count"), Agg("s", "sum", v), Agg("top", "max", v), Agg("newest", "last", v), Agg("oldest", "first", v)]


def table(df, cols):
    return {r["id"]: tuple(None if r[c] is None else round(r[c], 9) for c in cols) for r in df.select("id", *cols).collect()}


def test_slices_keep_their_bound(log):
    cut = plan_slices(log, "date", 100)
    assert not cut.single
    assert log.groupBy(cut.column()).count().agg(F.max("count")).first()[0] <= 100
    assert plan_slices(log, "date", 10_000).single


def test_crowded_instant_needs_no_more_passes(spark, log):
    crowd = spark.range(120).select((F.col("id") + 10_000).alias("id"), F.lit(0).alias("key"), F.lit(1.0).alias("v"),
                                    F.timestamp_seconds(F.lit(77)).alias("date"))
    rows = log.select("id", "key", "v", "date").unionByName(crowd)
    cut = plan_slices(rows, "date", 100)
    widest = plan_slices(log, "date", 100)
    assert not cut.single and cut.width_us * 2 * NARROWING > widest.width_us


def test_rows_without_time_come_first(spark):
    rows = spark.createDataFrame([(1, "x", None), (2, "x", 10), (3, "x", 900)], "id int, key string, s long")
    rows = rows.withColumn("date", F.timestamp_seconds("s"))
    for cut in (ONE_SLICE, Slices("date", 10_000_000, 1_000_000)):
        out = with_history(rows, ["key"], ["date", "id"], [Agg("n", "count")], cut)
        assert {r["id"]: r["n"] for r in out.collect()} == {1: 0, 2: 1, 3: 2}


def test_game_split_over_batches_is_rated(spark, tmp_path):
    games = [(g, f"2024-01-0{g} 10:00:00", side, team, won) for g, side, team, won in
             [(1, "Blue", "a", 1), (1, "Red", "b", 0), (2, "Blue", "b", 1), (3, "Blue", "a", 1), (3, "Red", "c", 0), (2, "Red", "a", 0)]]
    rows = spark.createDataFrame(games, "gameid long, date string, side string, teamid string, result int").withColumn("date", F.to_timestamp("date"))
    sink = RatingSink(str(tmp_path))
    first = rows.filter("gameid = 1 or (gameid = 2 and side = 'Blue')")
    for batch, part in enumerate((first, rows.exceptAll(first), first.limit(0))):
        sink(part, batch)
    sink(rows.exceptAll(first), 1)  # a retry changes nothing
    assert sorted(r["gameid"] for r in sink.games(spark).select("gameid").distinct().collect()) == [1, 2, 3]
    assert sink.pending(spark).count() == 0 and sink.pending(spark, 1).count() == 1
    assert sink.late_games(spark).count() == 0


def test_search_marks_one_complete_setting(spark):
    found = spark.createDataFrame([("m", '{"strength": 0.1}', 0.5, 2, True), ("m", '{"strength": 1.0}', 0.6, 2, False)],
                                  "model string, params string, mean_loss double, n_folds long, best boolean")
    assert best_params(found) == {"m": {"strength": 0.1}}


@pytest.mark.parametrize("keys", [["key"], []])
def test_history_in_slices_equals_one_window(log, keys):
    cols = [a.name for a in aggs()]
    one = table(with_history(log, keys, ["date", "id"], aggs(), ONE_SLICE), cols)
    for rows in (40, 200):
        many = table(with_history(log, keys, ["date", "id"], aggs(), plan_slices(log, "date", rows)), cols)
        assert many == one


@pytest.mark.parametrize("run_rows", [12, 50])
def test_runs_with_halo_equal_one_window(log, run_rows):
    def rolled(slices):
        rows, parts = cut_runs(log, ["key"], ["date", "id"], slices, 10, run_rows)
        w = Window.partitionBy(*parts).orderBy("date", "id").rowsBetween(-10, -1)
        return drop_halo(rows.withColumn("m", F.avg("v").over(w)).withColumn("c", F.count("v").over(w)))

    cut = plan_slices(log, "date", 100)
    assert rolled(cut).count() == log.count()
    assert table(rolled(cut), ["m", "c"]) == table(rolled(ONE_SLICE), ["m", "c"])


def test_rows_without_key_have_no_history(spark):
    df = spark.createDataFrame([(None, 1, 1), (None, 2, 2), ("x", 3, 3), ("x", 4, 4)], "k string, id int, t int")
    df = df.withColumn("kk", anonymous_key("k", "id"))
    out = with_history(df, ["kk"], ["t"], [Agg("n", "count")], ONE_SLICE)
    assert {r["id"]: r["n"] for r in out.collect()} == {1: 0, 2: 0, 3: 0, 4: 1}


@pytest.mark.parametrize("segment", [4, 16, 10_000])
def test_affine_scan_equals_fold(spark, segment):
    rng = random.Random(3)
    rows, want = [], {}
    for key, n in (("p", 300), ("q", 41)):
        x = 10.0
        for i in range(n):
            a, b = rng.uniform(0.9, 1.08), rng.uniform(0, 2)
            rows.append((key, i, a, b, 10.0))
            want[key, i] = x
            x = a * x + b
    df = spark.createDataFrame(rows, "key string, seq long, a double, b double, x0 double")
    out = affine_scan(df, ["key"], "seq", "a", "b", 300, "x0", "x", segment)
    got = {(r["key"], r["seq"]): r["x"] for r in out.collect()}
    assert len(got) == len(want)
    assert all(got[k] == pytest.approx(v, rel=1e-10) for k, v in want.items())


@pytest.mark.parametrize("low, high", [(0.5, 0.7), (1.2, 1.5)])
def test_affine_scan_beyond_the_range_of_doubles(spark, low, high):
    """Products of 3,000 factors are 0 or infinite; the states are those of a fold all the same."""
    rng = random.Random(5)
    rows, want, x = [], [], 10.0
    for i in range(3000):
        a, b = rng.uniform(low, high), rng.uniform(0, 2)
        rows.append(("p", i, a, b, 10.0))
        want.append(x)
        x = a * x + b
    df = spark.createDataFrame(rows, "key string, seq long, a double, b double, x0 double")
    out = affine_scan(df, ["key"], "seq", "a", "b", 3000, "x0", "x", 16)
    got = [r["x"] for r in out.orderBy("seq").collect()]
    assert got == pytest.approx(want, rel=1e-10)


def test_affine_scan_with_missing_values(spark):
    """A row without a factor has no state, and counts as one after the first factor of its segment."""
    rng = random.Random(11)
    rows, want, x, segment, seen = [], [], 10.0, 8, False
    for i in range(100):
        seen = seen and i % segment != 0
        a = None if i % 3 == 1 or i % 40 < 2 else rng.uniform(0.9, 1.1)
        b = None if i % 7 == 3 else rng.uniform(0, 2)
        rows.append(("p", i, a, b, 10.0))
        want.append(None if a is None else x)
        seen = seen or a is not None
        x = (1.0 if a is None else a) * x + (b or 0.0) * seen
    df = spark.createDataFrame(rows, "key string, seq long, a double, b double, x0 double")
    out = affine_scan(df, ["key"], "seq", "a", "b", 100, "x0", "x", segment)
    for got, expected in zip((r["x"] for r in out.orderBy("seq").collect()), want):
        assert got is None if expected is None else got == pytest.approx(expected, rel=1e-10)


def test_asof_equals_brute_force(spark, log):
    facts = log.filter(F.col("id") % 3 == 0).select("key", "date", F.col("id").alias("gameid"))
    probes = log.filter(F.col("id") % 3 == 1).select("key", F.col("date").alias("at"), F.col("id").alias("probe"))
    f = [tuple(r) for r in facts.collect()]
    want = {}
    for key, at, probe in (tuple(r) for r in probes.collect()):
        mine = sorted((d, g) for k, d, g in f if k == key)
        before = [x for x in mine if x[0] <= at]
        want[probe] = before[-1][1] if before else (mine[0][1] if mine else None)
    for rows in (100, 100_000):
        out = asof_rows(probes, facts, ["key"], "at", ["gameid"], slices=plan_slices(facts, "date", rows), into="f")
        assert {r["probe"]: r["f"]["gameid"] if r["f"] else None for r in out.collect()} == want


def test_pair_features_equal_brute_force(spark):
    """Both sides, repeated pairs, early probes, unknown teams, and a team without an id."""
    from fairline.operators.matchups import pair_features, with_h2h

    rng = random.Random(5)
    names = ["A", "b", "C"]
    facts = []
    for game in range(60):
        one, two = rng.sample(names, 2)
        day = f"2024-01-{game // 3 + 2:02d} 10:00:00"
        won = rng.randint(0, 1)
        for me, other, r in ((one, two, won), (two, one, 1 - won)):
            facts.append((game, None if me == "C" else me.lower(), None if other == "C" else other.lower(), me, day, r, rng.random()))
    cols = "gameid long, teamid string, opp_teamid string, teamname string, date string, result int, wr_L10 double"
    rows = spark.createDataFrame(facts, cols).withColumn("date", F.to_timestamp("date"))
    for c in ("league", "split", "patch"):
        rows = rows.withColumn(c, F.lit("x"))
    rows = rows.withColumn("playoffs", F.lit(0))
    asked = [(a, b, f"2024-01-{d:02d} 12:00:00") for a in ("a", "B", "c", "nobody", None) for b in ("A", "c") for d in (1, 5, 9)]
    pairs = spark.createDataFrame(asked * 2, "team1 string, team2 string, at string").withColumn("asof", F.to_timestamp("at"))

    def newest(team, at):
        mine = sorted((f[4], f[0], f) for f in facts if team and f[3].lower() == team.lower())
        before = [x for x in mine if x[0] <= at]
        return (before[-1] if before else mine[0])[2] if mine else None

    out = with_h2h(pair_features(pairs, rows), rows).collect()
    assert len(out) == len(asked) * 2
    for r in out:
        for side, team in (("r1", r.team1), ("r2", r.team2)):
            want = newest(team, r.at)
            assert (r[side] is None) == (want is None)
            if want:
                assert r[side]["wr_L10"] == want[6]
        one, two = newest(r.team1, r.at), newest(r.team2, r.at)
        if one and two:
            met = [f for f in facts if f[1] and f[1] == one[1] and f[2] and f[2] == two[1] and f[4] <= r.at]
            n, wins = len(met), sum(f[5] for f in met)
            assert r.n_12 == r.n_21 == n
            assert r.h2h_12 == pytest.approx(n / (n + 5) * (wins / max(n, 1)) + 5 / (n + 5) * one[6])


def test_split_edges(spark):
    from fairline.operators.validation import temporal_split

    games = spark.range(10).selectExpr("id as gameid", "timestamp_seconds(id) as date")
    parts = lambda frac: {r.part: r["count"] for r in temporal_split(games, frac).groupBy("part").count().collect()}
    assert parts(0.0) == {"dev": 10} and parts(1.0) == {"holdout": 10} and parts(0.3) == {"dev": 7, "holdout": 3}
