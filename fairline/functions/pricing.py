"""Fees, rewards, fair values and quotes as column functions.

Probabilities and prices are doubles in (0, 1); money is double as well.
Parameters may be numbers or columns, so one table can hold many settings.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairline import config as C
from fairline.functions.stats import half_even

Value = Column | float | str


def _c(x: Value) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(float(x))


def clip(x: Value, lo: Value, hi: Value) -> Column:
    return F.least(F.greatest(_c(x), _c(lo)), _c(hi))


def taker_fee(p: Value, rate: Value = C.TAKER_RATE) -> Column:
    """Fee per share when taking at price ``p``: highest at one half."""
    p = clip(p, 0.0, 1.0)
    return _c(rate) * p * (1.0 - p)


def maker_rebate(p: Value, rate: Value = C.TAKER_RATE) -> Column:
    return C.REBATE_SHARE * taker_fee(p, rate)


def edge(p_model: Value, p_market: Value) -> Column:
    return _c(p_model) - _c(p_market)


def half_spread(
    model_std: Value = 0.0, hours: Value = 168.0, edge_abs: Value = 0.0, base: Value = 0.015
) -> Column:
    """Distance of a quote from its middle, wider when risk is higher."""
    base, hours = _c(base), _c(hours)
    near = F.when(hours < 2, 0.02).when(hours < 12, 0.01).when(hours < 24, 0.005).otherwise(0.0)
    wide = base + F.least(_c(model_std) * 2.0, F.lit(0.01)) + near
    calm = F.when(_c(edge_abs) < 0.01, F.least(wide, base + 0.005)).otherwise(wide)
    return F.least(calm, F.lit(C.MAX_REWARD_SPREAD))


def model_weight(model_std: Value = 0.0, n_games_min: Value = 30.0, hours: Value = 168.0) -> Column:
    """Weight of the model in the blend, between 0.30 and 0.80."""
    disagreement = F.least(_c(model_std) * 5.0, F.lit(0.15))
    sample = F.greatest(F.lit(0.0), 0.10 * (1.0 - _c(n_games_min) / 30.0))
    time = F.greatest(F.lit(0.0), 0.10 * (1.0 - _c(hours) / 168.0))
    return clip(0.65 - disagreement - sample - time, 0.30, 0.80)


def fair_value(p_model: Value, p_market: Value, alpha: Value) -> Column:
    alpha = _c(alpha)
    return clip(alpha * _c(p_model) + (1.0 - alpha) * _c(p_market), 0.02, 0.98)


def kelly(p_model: Value, p_market: Value, fraction: Value = 0.25, maker: bool = False) -> Column:
    """Share of the bankroll to stake, 0 where costs eat the edge.

    A share bought at cost c pays 1 with probability p, so the full Kelly stake
    is (p - c) / (1 - c), on whichever side the model is above the market.
    """
    p, pm = _c(p_model), clip(p_market, 1e-6, 1.0 - 1e-6)
    cost = -maker_rebate(pm) if maker else taker_fee(pm)
    yes = p > pm
    win = F.when(yes, p).otherwise(1.0 - p)
    price = clip(F.when(yes, pm).otherwise(1.0 - pm) + cost, 1e-6, 1.0 - 1e-6)
    full = (win - price) / (1.0 - price)
    return F.when(win > price, half_even(_c(fraction) * full, 4)).otherwise(0.0)


def order_score(spread: Value, size: Value = 1.0, max_spread: Value = C.MAX_REWARD_SPREAD,
                multiplier: Value = 1.0) -> Column:
    """Quadratic reward score of one resting order, 0 outside the window."""
    s, v, n = _c(spread), _c(max_spread), _c(size)
    inside = F.pow((v - s) / v, F.lit(2.0)) * _c(multiplier) * n
    return F.when((s >= v) | (n <= 0), 0.0).otherwise(inside)


def two_sided_score(bid_score: Value, ask_score: Value, single_side: float = 3.0) -> Column:
    a, b = _c(bid_score), _c(ask_score)
    return F.greatest(F.least(a, b), F.greatest(a, b) / single_side)


def expected_reward(score: Value, market_share: Value = 0.10, tier: str | Column = "AB") -> Column:
    """Share of the tier's pool, if the quote scores at all."""
    if isinstance(tier, str):
        pool = F.lit(C.REWARD_POOL.get(tier, C.REWARD_POOL["C"]))
    else:
        pool = F.when(tier == "AB", C.REWARD_POOL["AB"]).otherwise(C.REWARD_POOL["C"])
    return F.when(_c(score) > 0, _c(market_share) * pool).otherwise(0.0)


def snap(price: Value) -> Column:
    """Nearest tick inside the allowed price range."""
    return clip(half_even(F.rint(_c(price) / C.TICK) * C.TICK, 4), C.MIN_PRICE, C.MAX_PRICE)


def series_win_prob(p: Value, fmt: str | Column) -> Column:
    """Chance to win a best-of-1, -3 or -5 from the chance to win one game."""
    p = _c(p)
    fmt = F.lit(fmt) if isinstance(fmt, str) else fmt
    bo3 = p * p * (3.0 - 2.0 * p)
    bo5 = p * p * p * (10.0 - 15.0 * p + 6.0 * p * p)
    wrong = F.raise_error(F.concat(F.lit("unknown series format: "), fmt)).cast("double")
    return F.when(fmt == "Bo1", p).when(fmt == "Bo3", bo3).when(fmt == "Bo5", bo5).otherwise(wrong)


def net_exposure(yes: Value, no: Value, p_fair: Value) -> Column:
    p = _c(p_fair)
    return _c(yes) * p - _c(no) * (1.0 - p)


def inventory_skew(net: Value, max_position: Value, spread: Value) -> Column:
    """Shift of both quotes that works an open position off."""
    room = _c(max_position)
    return F.when(room <= 0, 0.0).otherwise(-(_c(net) / room) * _c(spread) * 0.5)


@dataclass(frozen=True)
class QuoteParams:
    """Quoting settings; every field is a number or a column."""

    half_spread: Value = 0.015
    min_edge: Value = 0.02
    inventory_skew: Value = 0.0
    max_inventory: Value = 0.10
    kelly_fraction: Value = 0.25
    max_reward_spread: Value = C.MAX_REWARD_SPREAD

    def columns(self) -> dict[str, Column]:
        return {f.name: _c(getattr(self, f.name)) for f in fields(self)}


def quote_columns(
    df: DataFrame,
    params: QuoteParams = QuoteParams(),
    model_std: Value = 0.0,
    n_games_min: Value = 30.0,
    hours: Value = 168.0,
    alpha: Value | None = None,
    position: tuple[str, str] | None = None,
) -> DataFrame:
    """Add bid, ask and sizing for every row's ``p_model`` and ``p_market``.

    ``position`` names the columns with YES and NO shares held; their exposure
    then sets the inventory skew.  The window clip comes last and may leave bid
    and ask crossed, which ``crossed`` shows.
    """
    p = params.columns()
    pm, pk = clip("p_model", 0.02, 0.98), clip("p_market", 0.02, 0.98)
    df = df.withColumns({"_pm": pm, "_pk": pk})
    df = df.withColumns(
        {
            "alpha": model_weight(model_std, n_games_min, hours) if alpha is None else _c(alpha),
            "edge": edge("_pm", "_pk"),
            "_fee": taker_fee("_pk"),
        }
    )
    df = df.withColumn("p_fair", fair_value("_pm", "_pk", "alpha"))
    inventory = p["inventory_skew"]
    if position:
        net = net_exposure(*position, "p_fair")
        inventory = inventory_skew(net, p["max_inventory"], p["half_spread"])
    df = df.withColumns({"mid": snap("p_fair"), "_skew": -0.3 * F.col("edge") + inventory})
    df = df.withColumns(
        {
            "bid": clip(snap(F.col("mid") - p["half_spread"] + F.col("_skew")), C.MIN_PRICE, F.col("mid") - C.TICK),
            "ask": clip(snap(F.col("mid") + p["half_spread"] + F.col("_skew")), F.col("mid") + C.TICK, C.MAX_PRICE),
        }
    )
    window = p["max_reward_spread"]
    df = df.withColumns(
        {
            "bid": F.greatest(F.col("bid"), F.col("_pk") - window),
            "ask": F.least(F.col("ask"), F.col("_pk") + window),
        }
    )
    wanted = F.abs("edge") >= p["min_edge"]
    size = F.least(kelly("_pm", "_pk", p["kelly_fraction"]), p["max_inventory"])
    df = df.withColumns(
        {
            "crossed": F.col("bid") > F.col("ask"),
            "net_taker_edge": F.abs("edge") - F.col("_fee"),
            "bid_reward_score": order_score(F.abs(F.col("_pk") - F.col("bid")), 1.0, window),
            "ask_reward_score": order_score(F.abs(F.col("ask") - F.col("_pk")), 1.0, window),
            "bet_direction": F.when(~wanted, "PASS").when(F.col("edge") > 0, "YES").otherwise("NO"),
            "kelly_size": F.when(wanted, size).otherwise(0.0),
        }
    )
    return df.drop("_pm", "_pk", "_fee", "_skew")


def rationale() -> Column:
    """One line that explains a quote."""
    return F.format_string(
        "Model=%.3f  Fair=%.3f(a=%.2f)  Market=%.3f  Edge=%+.3f  NetEdge=%+.4f  -> %s  Kelly=%.3f",
        "p_model", "p_fair", "alpha", "p_market", "edge", "net_taker_edge", "bet_direction", "kelly_size",
    )


def quote_reward(window: Value, size: float, market_share: Value, tier: str | Column) -> Column:
    """Expected reward of the quoted bid and ask around the unclipped market price."""
    bid = order_score(F.abs(F.col("p_market") - F.col("bid")), size, window)
    ask = order_score(F.abs(F.col("ask") - F.col("p_market")), size, window)
    return expected_reward(two_sided_score(bid, ask), market_share, tier)


def generate_quotes(
    df: DataFrame,
    params: QuoteParams = QuoteParams(),
    tier: str | Column = "AB",
    market_share: Value = 0.10,
    **quote_args,
) -> DataFrame:
    """Quotes with fee, illustrative 100-share reward and rationale, strongest edge first."""
    quoted = quote_columns(df, params, **quote_args)
    reward = quote_reward(params.max_reward_spread, 100.0, market_share, tier)
    out = quoted.withColumns(
        {"taker_fee": taker_fee("p_market"), "est_liq_reward": half_even(reward, 2), "rationale": rationale()}
    )
    return out.orderBy(F.abs("edge").desc(), *[c for c in ("match_id",) if c in out.columns])


#: price points of the fee table
FEE_PRICES = (0.10, 0.20, 0.30, 0.40, 0.50, 0.60, 0.70, 0.80, 0.90)


def fee_columns(price: str = "price") -> dict[str, Column]:
    fee, rebate = taker_fee(price), maker_rebate(price)
    return {
        "taker_fee": half_even(fee, 5),
        "taker_fee_bps": half_even(fee * 10000, 1),
        "maker_rebate": half_even(rebate, 6),
        "maker_rebate_bps": half_even(rebate * 10000, 1),
        "min_edge_to_bet": half_even(fee, 5),
    }
