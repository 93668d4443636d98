"""Queries for replays, positions and the reports on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairline import fixtures
from fairline.catalog.base import EVENTS, Registry, match_slices, register, sql
from fairline.catalog.pricing import SCORED, fee, quotes, score
from fairline.functions import pricing as P
from fairline.operators import ledgers, reports
from fairline.plans.slices import plan_slices

REGISTRY: Registry = {}

_GAIN = f"(CASE WHEN bet_direction = 'YES' THEN 1 ELSE -1 END) * (result - p_market) - {fee('p_market')}"
_RET = f"CASE WHEN bet_direction = 'PASS' OR kelly_size <= 0 THEN 0 ELSE {_GAIN} END"
_REWARD = f"CASE WHEN greatest({score('abs(p_market - bid)')}, {score('abs(ask - p_market)')}) > 0 THEN 155.0::DOUBLE ELSE 0 END"

FIXED = SCORED + quotes("sc") + f""",
fx0 AS (SELECT *, {_RET} AS ret FROM q),
fx1 AS (SELECT *, CASE WHEN ret <> 0 THEN 10000 * kelly_size ELSE 0 END AS stake FROM fx0),
fx AS (SELECT *, stake * ret AS directional_pnl, stake * ret AS total_pnl,
         sum(stake * ret) OVER (ORDER BY date, match_id ROWS UNBOUNDED PRECEDING) AS cumulative_pnl,
         CAST(CAST(p_model > 0.5 AS INTEGER) = result AS INTEGER) AS model_correct,
         CAST(CAST(p_market > 0.5 AS INTEGER) = result AS INTEGER) AS market_correct FROM fx1)"""


def _cash(name, source, group):
    """Replay in closed form: cash before a bet is P * (1000 + sum(reward / P))."""
    w = f"(PARTITION BY {group} ORDER BY date, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND"
    return f""",
{name}_p AS (SELECT *, product(1 + kelly_size * ret) OVER {w} CURRENT ROW) AS prod FROM {source}),
{name} AS (SELECT *, prod / (1 + kelly_size * ret) * (1000 + coalesce(sum(reward / prod) OVER {w} 1 PRECEDING), 0)) AS before_
  FROM {name}_p)"""


COMPOUND = SCORED + quotes("sc") + f""",
cp0 AS (SELECT *, 1 AS one, {_RET} AS ret, {_REWARD} AS reward FROM q)""" + _cash("walk", "cp0", "one") + """,
cp AS (SELECT *, before_ * CASE WHEN ret <> 0 THEN kelly_size ELSE 0 END AS stake,
         before_ * kelly_size * ret AS directional_pnl, reward AS liquidity_reward,
         before_ * kelly_size * ret + reward AS total_pnl,
         before_ * (1 + kelly_size * ret) + reward - 1000 AS cumulative_pnl,
         before_ * (1 + kelly_size * ret) + reward AS bankroll FROM walk)"""
MONEY = ["kelly_size", "stake", "directional_pnl", "liquidity_reward", "total_pnl", "cumulative_pnl", "bankroll"]


def slices(spark, sf):
    """Slices short enough that the ledger's one global order is split."""
    return plan_slices(fixtures.events(spark, sf).select("ts"), "ts", 4_000).rename("date")


@register(REGISTRY, "B14_W29_compounding_ledger",
          sql(COMPOUND, "SELECT * FROM cp", ["match_id", "bet_direction"], MONEY, 4), 4)
def compounding(spark, sf):
    out = ledgers.replay_compounding(fixtures.scored(spark, sf), slices=slices(spark, sf))
    return out.select("match_id", "bet_direction", *MONEY)


_SWEEP = "(SELECT sc.*, e.min_edge FROM sc, (SELECT unnest([0.01, 0.02, 0.03, 0.05, 0.07, 0.10])::DOUBLE AS min_edge) e)"


@register(REGISTRY, "A16_edge_threshold_sweep",
          sql(SCORED + quotes(_SWEEP, hs="0.03::DOUBLE", min_edge="min_edge", inv="0.05::DOUBLE") + f""",
sw0 AS (SELECT *, {_RET} AS ret, {_REWARD} AS reward FROM q)""" + _cash("walk", "sw0", "min_edge"),
              """SELECT min_edge, count(*) FILTER (bet_direction <> 'PASS') AS bets,
  avg(CASE WHEN before_ * kelly_size * ret > 0 THEN 1.0 ELSE 0.0 END) AS win_rate,
  sum(before_ * kelly_size * ret) AS directional_pnl, sum(reward) AS liquidity_reward,
  sum(before_ * kelly_size * ret + reward) AS total_pnl, sum(before_ * kelly_size * ret + reward) / 1000 AS roi
FROM walk GROUP BY min_edge""",
              ["min_edge", "bets"], ["win_rate", "directional_pnl", "liquidity_reward", "total_pnl", "roi"], 3), 3)
def edge_sweep(spark, sf):
    thresholds = [0.01, 0.02, 0.03, 0.05, 0.07, 0.10]
    return ledgers.sweep(fixtures.scored(spark, sf), thresholds, slices=slices(spark, sf))


def bets(spark, sf):
    return ledgers.replay_fixed(fixtures.scored(spark, sf), slices=slices(spark, sf))


@register(REGISTRY, "B15_W29_fixed_stake_ledger",
          sql(FIXED, "SELECT * FROM fx", ["match_id", "bet_direction"],
              ["stake", "directional_pnl", "total_pnl", "cumulative_pnl"], 7), 7)
def fixed_stake(spark, sf):
    return bets(spark, sf).select("match_id", "bet_direction", "stake", "directional_pnl", "total_pnl", "cumulative_pnl")


@register(REGISTRY, "B16_correctness_flags",
          sql(FIXED, "SELECT * FROM fx", ["match_id", "model_correct", "market_correct"]))
def flags(spark, sf):
    rows = fixtures.scored(spark, sf)
    return rows.withColumns(ledgers.correctness_flags()).select("match_id", "model_correct", "market_correct")


def _bins(value, edges, labels):
    return "CASE " + " ".join(
        f"WHEN {value} > {a} AND {value} <= {b} THEN '{n}'" for a, b, n in zip(edges, edges[1:], labels)) + " END"


@register(REGISTRY, "A7_calibration_report",
          sql(FIXED, f"""SELECT *, avg_p_model - actual_wr AS model_err, avg_p_market - actual_wr AS market_err FROM (
  SELECT {_bins('p_model', reports.PROB_EDGES, reports.PROB_LABELS)} AS bucket, count(*) AS n, avg(result) AS actual_wr,
    avg(p_model) AS avg_p_model, avg(p_market) AS avg_p_market FROM fx GROUP BY 1) WHERE bucket IS NOT NULL""",
              ["bucket", "n"], ["actual_wr", "avg_p_model", "avg_p_market", "model_err", "market_err"]))
def calibration(spark, sf):
    return reports.calibration_report(bets(spark, sf))


@register(REGISTRY, "A8_edge_report",
          sql(FIXED, f"""SELECT * FROM (SELECT {_bins('abs(edge)', reports.EDGE_EDGES, reports.EDGE_LABELS)} AS bucket,
    count(*) AS n, count(*) FILTER (bet_direction <> 'PASS') AS bets, avg(model_correct) AS model_acc,
    sum(directional_pnl) AS directional_pnl FROM fx GROUP BY 1) WHERE bucket IS NOT NULL""",
              ["bucket", "n", "bets"], ["model_acc", "directional_pnl"], 4), 4)
def edges(spark, sf):
    return reports.edge_report(bets(spark, sf))


@register(REGISTRY, "A9_year_report",
          sql(FIXED, "SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS n, sum(directional_pnl) AS directional_pnl, "
                     "avg(model_correct) AS model_acc FROM fx GROUP BY 1", ["year", "n"],
              ["directional_pnl", "model_acc"], 4), 4)
def years(spark, sf):
    return reports.year_report(bets(spark, sf))


@register(REGISTRY, "A10_headline",
          sql(FIXED, """SELECT *, total_pnl / 10000 AS roi, model_acc - market_acc AS lift FROM (
  SELECT count(*) AS n, count(*) FILTER (bet_direction <> 'PASS') AS bets,
    avg(CASE WHEN directional_pnl > 0 THEN 1.0 ELSE 0.0 END) FILTER (bet_direction <> 'PASS') AS win_rate,
    avg(stake) FILTER (bet_direction <> 'PASS') AS avg_stake, sum(directional_pnl) AS total_pnl,
    avg(abs(edge)) AS mean_abs_edge, stddev_samp(edge) AS std_edge, avg(model_correct) AS model_acc,
    avg(market_correct) AS market_acc FROM fx)""", ["n", "bets"],
              ["win_rate", "avg_stake", "total_pnl", "mean_abs_edge", "std_edge", "model_acc", "market_acc", "roi", "lift"],
              4), 4)
def headline(spark, sf):
    return reports.headline(bets(spark, sf), 10000.0)


@register(REGISTRY, "T3_best_and_worst_bets",
          sql(FIXED, """SELECT * FROM (SELECT 'best' AS "end", * FROM fx WHERE bet_direction <> 'PASS'
    ORDER BY directional_pnl DESC, match_id LIMIT 5) UNION ALL SELECT * FROM (SELECT 'worst' AS "end", * FROM fx
    WHERE bet_direction <> 'PASS' ORDER BY directional_pnl, match_id LIMIT 5)""", ['"end"', "match_id"],
              ["directional_pnl", "stake"]))
def best_and_worst(spark, sf):
    return reports.best_and_worst(bets(spark, sf)).select("end", "match_id", "directional_pnl", "stake")


FILLS = """
fl AS (SELECT l_suppkey AS market, l_shipdate AS fill_ts, l_orderkey AS fill_id, l_linenumber AS fill_no, l_partkey AS fill_part,
  CASE WHEN l_linenumber % 2 = 1 THEN 'YES' ELSE 'NO' END AS side, l_quantity AS shares,
  0.01::DOUBLE + (l_partkey % 98) / 100.0::DOUBLE AS price FROM lineitem),
ps0 AS (SELECT *, sum(CASE WHEN side = 'YES' THEN shares ELSE 0 END) OVER w AS yes_shares,
  sum(CASE WHEN side = 'NO' THEN shares ELSE 0 END) OVER w AS no_shares,
  sum(CASE WHEN side = 'YES' THEN shares * price ELSE 0 END) OVER w AS yes_cost,
  sum(CASE WHEN side = 'NO' THEN shares * price ELSE 0 END) OVER w AS no_cost FROM fl
  WINDOW w AS (PARTITION BY market ORDER BY fill_ts, fill_id, fill_no, fill_part, shares ROWS UNBOUNDED PRECEDING)),
ps AS (SELECT *, CASE WHEN yes_shares > 0 THEN yes_cost / yes_shares ELSE 0 END AS avg_cost_yes,
  CASE WHEN no_shares > 0 THEN no_cost / no_shares ELSE 0 END AS avg_cost_no, yes_cost + no_cost AS capital FROM ps0)"""
FILL_KEYS = ["market", "fill_id", "fill_no", "fill_part"]
FILL_ORDER = ["fill_ts", "fill_id", "fill_no", "fill_part", "shares"]
HELD = ["yes_shares", "no_shares", "cost_yes", "cost_no", "capital"]


@register(REGISTRY, "B17_positions",
          sql(FILLS, "SELECT *, avg_cost_yes * yes_shares AS cost_yes, avg_cost_no * no_shares AS cost_no FROM ps",
              FILL_KEYS, HELD))
def positions(spark, sf):
    fills = fixtures.fills(spark, sf)
    held = ledgers.positions(fills, FILL_ORDER, slices=plan_slices(fills, "fill_ts", 20_000))
    cost = {f"cost_{s}": F.col(f"avg_cost_{s}") * F.col(f"{s}_shares") for s in ("yes", "no")}
    return held.withColumns(cost).select(*FILL_KEYS, *HELD)


@register(REGISTRY, "B18_exposure",
          sql(FILLS, """SELECT *, -(net_exposure / 500) * 0.015::DOUBLE * 0.5 AS skew,
    abs(yes_shares) < 1e-6 AND abs(no_shares) < 1e-6 AS is_flat
  FROM (SELECT *, yes_shares * price - no_shares * (1 - price) AS net_exposure FROM ps)""",
              [*FILL_KEYS, "is_flat"], ["net_exposure", "skew"], 8), 8)
def exposure(spark, sf):
    held = ledgers.positions(fixtures.fills(spark, sf), FILL_ORDER)
    return ledgers.exposure(held, "price", 500.0, 0.015).select(*FILL_KEYS, "is_flat", "net_exposure", "skew")
