"""Published constants and brute-force checks of prices and ledgers."""

import pytest
from pyspark.sql import functions as F

from fairline import fixtures
from fairline.functions import market_text as X
from fairline.functions import pricing as P
from fairline.operators import ledgers, markets, matchups
from fairline.plans.slices import plan_slices


def value(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_fee_curve(spark):
    assert value(spark, P.taker_fee(0.5)) == pytest.approx(0.0075)
    assert value(spark, P.taker_fee(0.3)) == pytest.approx(0.0063)
    assert value(spark, P.taker_fee(0.7)) == pytest.approx(0.0063)
    assert value(spark, P.maker_rebate(0.5)) == pytest.approx(0.001875)


def test_reward_score(spark):
    assert value(spark, P.order_score(0.015)) == pytest.approx(0.25)
    assert value(spark, P.order_score(0.03)) == 0.0
    assert value(spark, P.two_sided_score(0.3, 0.0)) == pytest.approx(0.1)
    assert value(spark, P.expected_reward(0.1)) == pytest.approx(155.0)


def test_series(spark):
    assert value(spark, P.series_win_prob(0.6, "Bo3")) == pytest.approx(0.648)
    assert value(spark, P.series_win_prob(0.5, "Bo5")) == pytest.approx(0.5)
    with pytest.raises(Exception, match="unknown series format"):
        value(spark, P.series_win_prob(0.5, "Bo7"))


def test_snap_and_kelly(spark):
    assert value(spark, P.snap(0.547)) == pytest.approx(0.55)
    assert value(spark, P.snap(1.2)) == pytest.approx(0.99)
    assert value(spark, P.kelly(0.5, 0.5)) == 0.0
    assert value(spark, P.kelly(0.62, 0.55)) == pytest.approx(round(0.25 * (0.62 - 0.557425) / (1 - 0.557425), 4))


def test_alpha_defaults(spark):
    assert value(spark, P.model_weight()) == pytest.approx(0.65)
    assert value(spark, P.model_weight(1.0, 0.0, 0.0)) == pytest.approx(0.30)


def test_compounding_ledger_equals_a_loop(spark, sf):
    scored = fixtures.scored(spark, sf)
    out = ledgers.replay_compounding(scored, slices=plan_slices(scored, "date", 60)).orderBy("date", "match_id").collect()
    cash = 1000.0
    for r in out:
        side = 1.0 if r["bet_direction"] == "YES" else -1.0
        stake = cash * r["kelly_size"] if r["bet_direction"] != "PASS" else 0.0
        fee = 0.03 * r["p_market"] * (1 - r["p_market"])
        cash += stake * (side * (r["result"] - r["p_market"]) - fee) + r["liquidity_reward"]
        assert r["bankroll"] == pytest.approx(cash, rel=1e-9)


def test_positions_equal_a_loop(spark):
    rows = [(1, i, "YES" if i % 3 else "NO", float(1 + i % 4), 0.3 + 0.01 * i) for i in range(30)]
    df = spark.createDataFrame(rows, "market int, id int, side string, shares double, price double")
    df = df.withColumn("fill_ts", F.timestamp_seconds("id"))
    held = {"YES": [0.0, 0.0], "NO": [0.0, 0.0]}
    for r, got in zip(rows, ledgers.positions(df, ["fill_ts", "id"], slices=plan_slices(df, "fill_ts", 7)).orderBy("id").collect()):
        h = held[r[2]]
        h[1] = (h[1] * h[0] + r[3] * r[4]) / (h[0] + r[3])
        h[0] += r[3]
        assert (got["yes_shares"], got["no_shares"]) == (held["YES"][0], held["NO"][0])
        assert (got["avg_cost_yes"], got["avg_cost_no"]) == pytest.approx((held["YES"][1], held["NO"][1]))


def test_outcomes(spark):
    cases = {'["1","0"]': 1, '["0","1"]': 0, '["0.95","0.04"]': 1, '["0.6","0.4"]': None, '["1"]': None, "not json": None,
             '["x","0"]': None, "[1, 0]": 1}
    df = spark.createDataFrame([(k,) for k in cases], "p string").withColumn("r", X.outcome(F.col("p")))
    assert {r["p"]: r["r"] for r in df.collect()} == cases


def test_questions(spark):
    cases = [("LoL: T1 vs Gen.G (BO3)", "LCK", True), ("LCK: T1 vs Gen.G", "LCK", True), ("LCK: T1 vs Gen.G - Game 1 Winner", "LCK", False),
             ("LCK: T1 vs DK", "CS2 finals", False), ("Who wins?", "LCK", False), ("LCK: A vs B O/U 2.5", "LCK", False)]
    df = spark.createDataFrame(cases, "q string, t string, want boolean").withColumn("got", X.is_match_market("q", "t"))
    assert all(r["got"] == r["want"] for r in df.collect())
    team = spark.createDataFrame([("LoL: T1 vs. Gen.G. (BO3)",)], "q string").select(X.parsed_team("q", 1), X.parsed_team("q", 2))
    assert tuple(team.first()) == ("T1", "Gen.G")


def test_one_sided_book(spark):
    df = spark.createDataFrame([(1, "bid", 0.4, 5.0), (2, "ask", 0.7, 1.0), (3, "bid", 0.2, 1.0), (3, "ask", 0.4, 1.0)],
                               "token_id int, side string, price double, size double")
    assert {r["token_id"]: round(r["mid"], 6) for r in markets.mid_price(df).collect()} == {1: 0.4, 2: 0.7, 3: 0.3}
    snap = {r["token_id"]: r for r in markets.book_snapshot(df, 1).collect()}
    assert round(snap[3]["mid"], 6) == 0.3 and snap[1]["asks"] == []


def test_unreadable_end_is_a_week_away(spark):
    df = spark.createDataFrame([("soon",), ("2024-01-01T12:00:00Z",), ("2023-01-01T00:00:00Z",), (None,)], "e string")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    assert [r[0] for r in df.select(X.hours_to(F.col("e"), at)).collect()] == [168.0, 12.0, 0.0, 168.0]


def test_names_equal_brute_force(spark):
    teams = ["T1", "Gen.G", "Kwangdong Freecs", "Dplus KIA", "KT Rolster", "Team KT", "LOUD"]
    aliases = {"geng": "Gen.G", "gone": "No Such Team", "loudly": "loud"}
    names = ["t1", " T1 ", "geng", "gone", "loudly", "Kwangdong", "kt", "the dplus kia team", "", "zzz", "a"]
    def brute(name):
        low = name.strip().lower()
        by_low = {t.lower(): t for t in teams}
        if aliases.get(low, "").lower() in by_low:
            return by_low[aliases[low].lower()]
        if low in by_low:
            return by_low[low]
        fits = [t for t in teams if low and (low in t.lower() or t.lower() in low)]
        return sorted(fits, key=lambda t: (-len(t), t))[0] if fits else None

    df = spark.createDataFrame([(n,) for n in names], "name string")
    known = spark.createDataFrame([(t,) for t in teams], "teamname string")
    got = {r["name"]: r["team"] for r in matchups.resolve_names(df, known, aliases).collect()}
    assert got == {n: brute(n) for n in names}
