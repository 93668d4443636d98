"""Queries for fees, spreads, fair values, stakes and quotes."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairline import fixtures
from fairline.catalog.base import EVENTS, Registry, register, sql
from fairline.functions import pricing as P

REGISTRY: Registry = {}

SCORED = EVENTS + """,
sc AS (
  SELECT gameid AS match_id, date, league, greatest(0.02::DOUBLE, least(0.98::DOUBLE, p + (rk - 50) / 500.0::DOUBLE)) AS p_model,
         p AS p_market, bwon AS result, rk / 1000.0::DOUBLE AS model_std, bk AS n_games_min, rk * 2.0::DOUBLE AS hours_to_match
  FROM (SELECT *, 0.05::DOUBLE + 0.9::DOUBLE * (bk / 99.0::DOUBLE) AS p FROM g))"""


def fee(p):
    return f"(0.03::DOUBLE * least(greatest({p}, 0), 1) * (1 - least(greatest({p}, 0), 1)))"


def kelly(pm, pk, frac, maker=False):
    k = f"least(greatest({pk}, 0.000001::DOUBLE), 0.999999::DOUBLE)"
    adj = f"(-0.25::DOUBLE * {fee(k)})" if maker else fee(k)
    win = f"(CASE WHEN {pm} > {k} THEN {pm} ELSE 1 - {pm} END)"
    price = f"least(greatest((CASE WHEN {pm} > {k} THEN {k} ELSE 1 - {k} END) + {adj}, 0.000001::DOUBLE), 0.999999::DOUBLE)"
    odds = f"((1 - {price}) / {price})"
    return (f"CASE WHEN {win} <= {price} THEN 0 ELSE round_even({frac} * greatest(0, ({odds} * {win} - (1 - {win})) / {odds}), 4) END")


def score(s, v="0.03::DOUBLE", size="1"):
    return f"(CASE WHEN {s} >= {v} THEN 0 ELSE power(({v} - {s}) / {v}, 2) * {size} END)"


ALPHA = ("least(greatest(0.65::DOUBLE - least(model_std * 5, 0.15) - greatest(0, 0.10::DOUBLE * (1 - n_games_min / 30.0::DOUBLE))"
         " - greatest(0, 0.10::DOUBLE * (1 - hours_to_match / 168.0::DOUBLE)), 0.30), 0.80)")


def snap(p):
    return f"least(greatest(round_even(round_even(({p}) / 0.01::DOUBLE, 0) * 0.01::DOUBLE, 4), 0.01::DOUBLE), 0.99::DOUBLE)"


def quotes(source, alpha="0.65::DOUBLE", hs="0.015::DOUBLE", min_edge="0.02::DOUBLE", inv="0.10::DOUBLE", skew="0"):
    """CTEs q1..q: the quote engine over ``source``."""
    return f""",
q1 AS (SELECT *, least(greatest(p_model, 0.02), 0.98)::DOUBLE AS cm, least(greatest(p_market, 0.02), 0.98)::DOUBLE AS ck FROM {source}),
q2 AS (SELECT *, cm - ck AS edge, {alpha} AS alpha FROM q1),
q3 AS (SELECT *, least(greatest(alpha * cm + (1 - alpha) * ck, 0.02), 0.98)::DOUBLE AS p_fair FROM q2),
q4 AS (SELECT *, {snap("p_fair")} AS mid, -0.3::DOUBLE * edge + {skew} AS sk FROM q3),
q5 AS (SELECT *, least(greatest({snap(f"mid - {hs} + sk")}, 0.01), mid - 0.01)::DOUBLE AS bid0,
         least(greatest({snap(f"mid + {hs} + sk")}, mid + 0.01), 0.99)::DOUBLE AS ask0 FROM q4),
q6 AS (SELECT *, greatest(bid0, ck - 0.03::DOUBLE) AS bid, least(ask0, ck + 0.03::DOUBLE) AS ask FROM q5),
q AS (SELECT *, bid > ask AS crossed, abs(edge) - {fee("ck")} AS net_taker_edge,
        {score("abs(ck - bid)")} AS bid_reward_score, {score("abs(ask - ck)")} AS ask_reward_score,
        CASE WHEN abs(edge) < {min_edge} THEN 'PASS' WHEN edge > 0 THEN 'YES' ELSE 'NO' END AS bet_direction,
        CASE WHEN abs(edge) < {min_edge} THEN 0 ELSE least({kelly("cm", "ck", "0.25::DOUBLE")}, {inv}) END::DOUBLE AS kelly_size
      FROM q6)"""


def _scored(build, names):
    def run(spark, sf):
        return fixtures.scored(spark, sf).withColumns(build()).select("match_id", *names)

    return run


def _register(name, build, exprs):
    names = list(exprs)
    body = "SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in exprs.items()) + " FROM sc"
    register(REGISTRY, name, sql(SCORED, body, ["match_id"], names))(_scored(build, names))


_register("B1_taker_fee", lambda: {"fee": P.taker_fee("p_market"), "fee_out_of_range": P.taker_fee(F.col("p_model") * 2)},
          {"fee": fee("p_market"), "fee_out_of_range": fee("(p_model * 2)")})
_register("B2_maker_rebate", lambda: {"rebate": P.maker_rebate("p_market")}, {"rebate": f"0.25::DOUBLE * {fee('p_market')}"})
_register("B4_half_spread",
          lambda: {"spread": P.half_spread("model_std", "hours_to_match", F.abs(P.edge("p_model", "p_market")))},
          {"spread": "least(CASE WHEN abs(p_model - p_market) < 0.01 THEN least(raw, 0.02) ELSE raw END, 0.03)"
           .replace("raw", "(0.015::DOUBLE + least(model_std * 2, 0.01) + CASE WHEN hours_to_match < 2 THEN 0.02 "
                           "WHEN hours_to_match < 12 THEN 0.01 WHEN hours_to_match < 24 THEN 0.005 ELSE 0 END)")})
_register("B5_edge", lambda: {"edge": P.edge("p_model", "p_market")}, {"edge": "p_model - p_market"})
_register("B6_B7_fair_value",
          lambda: {"alpha": P.model_weight("model_std", "n_games_min", "hours_to_match"),
                   "p_fair": P.fair_value("p_model", "p_market",
                                          P.model_weight("model_std", "n_games_min", "hours_to_match"))},
          {"alpha": ALPHA, "p_fair": f"least(greatest({ALPHA} * p_model + (1 - {ALPHA}) * p_market, 0.02), 0.98)"})
_register("B8_kelly",
          lambda: {"taker": P.kelly("p_model", "p_market"), "maker": P.kelly("p_model", "p_market", 0.5, True)},
          {"taker": kelly("p_model", "p_market", "0.25::DOUBLE"), "maker": kelly("p_model", "p_market", "0.5::DOUBLE", True)})
_BID, _ASK = "abs(p_model - p_market)", "(model_std / 2)"
_register("B9_B10_B11_rewards",
          lambda: {"bid_score": P.order_score(F.abs(P.edge("p_model", "p_market")), 500.0),
                   "ask_score": P.order_score(F.col("model_std") / 2, 300.0),
                   "two_sided": P.two_sided_score(P.order_score(F.abs(P.edge("p_model", "p_market")), 500.0),
                                                  P.order_score(F.col("model_std") / 2, 300.0)),
                   "reward": P.expected_reward(
                       P.two_sided_score(P.order_score(F.abs(P.edge("p_model", "p_market")), 500.0),
                                         P.order_score(F.col("model_std") / 2, 300.0)), 0.1,
                       F.when(F.col("league") == "OTH", "C").otherwise("AB"))},
          {"bid_score": score(_BID, size="500"), "ask_score": score(_ASK, size="300"),
           "two_sided": f"greatest(least({score(_BID, size='500')}, {score(_ASK, size='300')}), "
                        f"greatest({score(_BID, size='500')}, {score(_ASK, size='300')}) / 3)",
           "reward": f"CASE WHEN greatest({score(_BID, size='500')}, {score(_ASK, size='300')}) > 0 THEN "
                     "0.1::DOUBLE * CASE WHEN league = 'OTH' THEN 150 ELSE 1550 END ELSE 0 END"})
_register("F2_series_win_probability",
          lambda: {"bo1": P.series_win_prob("p_model", "Bo1"), "bo3": P.series_win_prob("p_model", "Bo3"),
                   "bo5": P.series_win_prob("p_model", "Bo5")},
          {"bo1": "p_model", "bo3": "power(p_model, 2) * (3 - 2 * p_model)",
           "bo5": "10 * power(p_model, 3) - 15 * power(p_model, 4) + 6 * power(p_model, 5)"})


@register(REGISTRY, "B3_fee_table",
          sql(SCORED, f"""SELECT league, price, count(*) AS n_below, round_even({fee('price')}, 5) AS taker_fee,
    round_even({fee('price')} * 10000, 1) AS taker_fee_bps, round_even(0.25::DOUBLE * {fee('price')}, 6) AS maker_rebate,
    round_even(0.25::DOUBLE * {fee('price')} * 10000, 1) AS maker_rebate_bps, round_even({fee('price')}, 5) AS min_edge_to_bet
  FROM sc, (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS price) WHERE p_market <= price
  GROUP BY league, price""", ["league", "n_below"],
              ["price", "taker_fee", "taker_fee_bps", "maker_rebate", "maker_rebate_bps", "min_edge_to_bet"]))
def fee_table(spark, sf):
    """The fee table at the usual price points, with the markets priced below each."""
    points = F.explode(F.array(*[F.lit(x) for x in P.FEE_PRICES])).alias("price")
    rows = fixtures.scored(spark, sf).select("league", "p_market", points).filter(F.col("p_market") <= F.col("price"))
    return rows.groupBy("league", "price").agg(F.count(F.lit(1)).alias("n_below")).withColumns(P.fee_columns())


QUOTE = ["alpha", "edge", "p_fair", "mid", "bid", "ask", "net_taker_edge", "bid_reward_score", "ask_reward_score",
         "kelly_size"]


@register(REGISTRY, "B12_quote_engine",
          sql(SCORED + quotes("sc", ALPHA), "SELECT * FROM q", ["match_id", "bet_direction", "crossed"], QUOTE))
def quote_engine(spark, sf):
    out = P.quote_columns(fixtures.scored(spark, sf), model_std="model_std", n_games_min="n_games_min",
                          hours="hours_to_match")
    return out.select("match_id", "bet_direction", "crossed", *QUOTE)


_INV = "CASE WHEN 0.10 <= 0 THEN 0 ELSE -((n_games_min / 100.0::DOUBLE * p_fair - hours_to_match / 200.0::DOUBLE * (1 - p_fair)) / 0.10::DOUBLE) * 0.015::DOUBLE * 0.5 END"


@register(REGISTRY, "B12_quotes_with_position",
          sql(SCORED + quotes("sc", skew=_INV), "SELECT * FROM q", ["match_id", "bet_direction", "crossed"], QUOTE))
def quotes_with_position(spark, sf):
    held = fixtures.scored(spark, sf).withColumns(
        {"yes": F.col("n_games_min") / 100.0, "no": F.col("hours_to_match") / 200.0})
    return P.quote_columns(held, position=("yes", "no")).select("match_id", "bet_direction", "crossed", *QUOTE)


_REWARD = (f"CASE WHEN greatest({score('abs(p_market - bid)', size='100')}, {score('abs(ask - p_market)', size='100')}) > 0 "
           "THEN 155 ELSE 0 END")


@register(REGISTRY, "B13_T2_quote_batch",
          sql(SCORED + quotes("sc"), f"SELECT *, {fee('p_market')} AS taker_fee, {_REWARD} AS est_liq_reward, "
              "abs(edge) AS edge_abs FROM q ORDER BY abs(edge) DESC", ["match_id", "bet_direction"],
              ["edge", "bid", "ask", "taker_fee", "kelly_size", "est_liq_reward"]))
def quote_batch(spark, sf):
    return P.generate_quotes(fixtures.scored(spark, sf)).select(
        "match_id", "bet_direction", "edge", "bid", "ask", "taker_fee", "kelly_size", "est_liq_reward")
