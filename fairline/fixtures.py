"""Reads the driver's tables as match records, markets, books and orders.

Two consecutive rows of ``events`` are the two sides of one game.  All frames
below are plain projections and one aggregate per game, so they grow with the
tables and push their columns down to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select(
        "event_id",
        F.expr("event_id div 2").alias("gameid"),
        (F.col("event_id") % 2).alias("red"),
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


#: event type -> league of the game; any other type is OTH
LEAGUES = {"click": "LCK", "view": "LPL", "purchase": "LEC", "signup": "VCS"}


def _league_code(kind: Column) -> Column:
    out = None
    for code, event_type in enumerate(LEAGUES):
        hit = kind == event_type
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return out.otherwise(len(LEAGUES))


def games(spark: SparkSession, sf: str) -> DataFrame:
    """One row per game with both sides as structs ``b`` and ``r``.

    Only fixed-width values are aggregated, so the aggregate hashes and never
    sorts its input.
    """
    e = events(spark, sf).withColumns({"code": _league_code(F.col("event_type")), "us": F.unix_micros("ts")})
    sides = [
        F.max(F.when(F.col("red") == red, F.col(c))).alias(f"{s}_{c}")
        for red, s in ((0, "b"), (1, "r"))
        for c in ("user_id", "value", "k")
    ]
    paired = e.groupBy("gameid").agg(
        F.min("us").alias("us"), F.max(F.when(F.col("red") == 0, F.col("code"))).alias("code"), *sides
    )
    names = F.array(*[F.lit(x) for x in (*LEAGUES.values(), "OTH")])
    side = lambda s: F.struct(*[F.col(f"{s}_{c}").alias(c) for c in ("user_id", "value", "k")])
    return paired.filter((F.col("b_user_id") % 30) != (F.col("r_user_id") % 30)).select(
        "gameid", F.timestamp_micros("us").alias("date"), names[F.col("code")].alias("league"), side("b").alias("b"), side("r").alias("r")
    )


def match_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Team rows of the match log, two per game."""
    day = F.dayofmonth("date")
    both = games(spark, sf).select(
        "gameid",
        "date",
        F.year("date").alias("year"),
        F.col("b.k").alias("bk"),
        "league",
        F.when(day <= 15, "Spring").otherwise("Summer").alias("split"),
        F.concat(F.lit("P"), F.floor((day - 1) / 7).cast("string")).alias("patch"),
        F.when(day >= 25, 1).otherwise(0).alias("playoffs"),
        (F.col("gameid") % 3 + 1).cast("int").alias("game"),
        F.explode(
            F.array(
                F.struct(F.lit("Blue").alias("side"), F.col("b").alias("me"), F.col("r").alias("ot")),
                F.struct(F.lit("Red").alias("side"), F.col("r").alias("me"), F.col("b").alias("ot")),
            )
        ).alias("s"),
    )
    me, ot, bk = (lambda c: F.col(f"s.me.{c}")), (lambda c: F.col(f"s.ot.{c}")), F.col("bk")
    blue = F.col("s.side") == "Blue"
    lead = me("value") - ot("value")

    def first(cond: Column) -> Column:
        return (cond == blue).cast("double")

    def pick(i: int) -> Column:
        shift = F.when(blue, 0).otherwise(5)
        return F.concat(F.lit("C"), ((7 * me("k") + 13 * i + shift) % 40).cast("string"))

    out = {
        "side": F.col("s.side"),
        "teamid": F.concat(F.lit("T"), (me("user_id") % 30).cast("string")),
        "teamname": F.concat(F.lit("T"), (me("user_id") % 30).cast("string")),
        "k": me("k"),
        "value": me("value"),
        "other_k": ot("k"),
        "other_value": ot("value"),
        "result": F.when((lead > 0) | ((lead == 0) & blue), 1).otherwise(0),
        "golddiffat15": F.when(F.col("gameid") % 17 != 0, lead * 50),
        "golddiffat10": F.when(F.col("gameid") % 17 != 0, lead * 30),
        "xpdiffat15": F.when(F.col("gameid") % 17 != 0, lead * 40),
        "xpdiffat10": F.when(F.col("gameid") % 17 != 0, lead * 25),
        "firstblood": first(bk % 2 == 1),
        "firstdragon": first(bk % 3 == 0),
        "firstherald": first(bk % 5 == 0),
        "firsttower": first(bk % 7 < 3),
        "firstbaron": first(bk % 11 < 5),
        "ckpm": me("value") / 100,
        "team_kpm": me("value") / 200,
        "vspm": me("k") / 10.0,
        "earned_gpm": 900 + me("value"),
        "gamelength": (1500 + 10 * me("k")).cast("double"),
        "firstPick": F.when(F.col("gameid") % 13 != 0, F.when(blue, "1").otherwise("0")),
    }
    for name, mod in (("dragons", 5), ("heralds", 3), ("barons", 2), ("towers", 11), ("turretplates", 4)):
        out[name] = (me("k") % mod).cast("double")
        out[f"opp_{name}"] = (ot("k") % mod).cast("double")
    for i in range(1, 6):
        out[f"pick{i}"] = pick(i) if i < 5 else F.when(me("k") % 19 != 0, pick(i))
    return both.withColumns(out).drop("s", "bk")


def player_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Player rows: five per team and game, none where ``k % 23 = 0``."""
    rows = match_rows(spark, sf).filter(F.col("k") % 23 != 0)
    shift = F.when(F.col("k") % 10 == 0, 1).otherwise(0)
    ids = F.transform(
        F.sequence(F.lit(0), F.lit(4)),
        lambda i: F.concat(F.lit(" "), F.col("teamid"), F.lit("_p"), (i + shift).cast("string"), F.lit(" ")),
    )
    return rows.select("gameid", "date", "teamid", "side", F.explode(ids).alias("playerid")).withColumn(
        "playername", F.upper(F.trim("playerid"))
    )


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """One row per game with a model probability, a market price and the result."""
    p_market = 0.05 + 0.9 * (F.col("b.k") / 99.0)
    p_model = F.greatest(F.lit(0.02), F.least(F.lit(0.98), p_market + (F.col("r.k") - 50) / 500.0))
    return games(spark, sf).select(
        F.col("gameid").alias("match_id"),
        "date",
        "league",
        p_model.alias("p_model"),
        p_market.alias("p_market"),
        F.when(F.col("b.value") >= F.col("r.value"), 1).otherwise(0).alias("result"),
        (F.col("r.k") / 1000.0).alias("model_std"),
        F.col("b.k").alias("n_games_min"),
        (F.col("r.k") * 2.0).alias("hours_to_match"),
    )


def market_events(spark: SparkSession, sf: str) -> DataFrame:
    """Nested event records: one event per game with a winner and a prop market."""
    g = games(spark, sf).select(
        "gameid",
        "date",
        F.col("b.value").alias("value"),
        "league",
        F.concat(F.lit("T"), (F.col("b.user_id") % 30).cast("string")).alias("t1"),
        F.concat(F.lit("T"), (F.col("r.user_id") % 30).cast("string")).alias("t2"),
        (F.col("b.value") >= F.col("r.value")).alias("won"),
    )
    gid = F.col("gameid")
    ended = F.date_format(F.col("date") + F.expr("INTERVAL 1 HOUR"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    question = F.when(
        gid % 4 == 0, F.concat(F.lit("LoL: "), F.col("t1"), F.lit(" vs "), F.col("t2"), F.lit(". (BO3)"))
    ).otherwise(F.concat("league", F.lit(": "), F.col("t1"), F.lit(" vs "), F.col("t2"), F.lit(".")))
    prices = (
        F.when(gid % 97 == 0, '["1", "0')
        .when(gid % 19 == 0, '["0.6","0.4"]')
        .when(F.col("won"), '["1","0"]')
        .otherwise('["0","1"]')
    )
    swapped = gid % 6 == 0
    quoted = lambda a, b: F.concat(F.lit('["'), a, F.lit('","'), b, F.lit('"]'))
    winner = F.struct(
        F.concat(F.lit("c"), gid.cast("string")).alias("conditionId"),
        question.alias("question"),
        prices.alias("outcomePrices"),
        quoted(F.concat(F.lit("y"), gid.cast("string")), F.concat(F.lit("n"), gid.cast("string"))).alias(
            "clobTokenIds"
        ),
        F.when(swapped, quoted(F.col("t2"), F.col("t1"))).otherwise(quoted(F.col("t1"), F.col("t2"))).alias(
            "outcomes"
        ),
        F.when(gid % 29 != 0, ended).otherwise("not a date").alias("endDateIso"),
        (F.col("value") * 10).alias("volume"),
        F.when(gid % 7 != 0, 0.5).alias("lastTradePrice"),
        F.when(gid % 19 == 0, "proposed").otherwise("resolved").alias("umaResolutionStatus"),
    )
    prop = winner.withField("conditionId", F.concat(F.lit("p"), gid.cast("string"))).withField(
        "question", F.concat(question, F.lit(" - Game 1 Winner"))
    )
    title = F.when(gid % 11 == 0, F.concat(F.lit("Counter-Strike: "), "league")).otherwise(
        F.concat("league", F.when(gid % 5 == 0, F.lit(" Challenger")).otherwise(F.lit("")), F.lit(" match day"))
    )
    return g.select(
        gid,
        "date",
        "league",
        "t1",
        "t2",
        title.alias("title"),
        F.lower(F.regexp_replace(title, " ", "-")).alias("slug"),
        ended.alias("endDate"),
        F.array(winner, prop).alias("markets"),
    )


def book(spark: SparkSession, sf: str) -> DataFrame:
    """Order-book levels from ``lineitem``."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    return li.select(
        F.col("l_orderkey").alias("token_id"),
        F.when(F.col("l_linenumber") % 2 == 1, "bid").otherwise("ask").alias("side"),
        (0.01 + (F.col("l_partkey") % 98) / 100.0).alias("price"),
        F.col("l_quantity").alias("size"),
        F.col("l_suppkey").alias("level_id"),
    )


def reward_markets(spark: SparkSession, sf: str) -> DataFrame:
    """Reward markets from ``orders`` with nested configs from ``lineitem``."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    configs = li.groupBy("l_orderkey").agg(
        F.collect_list(
            F.struct(
                (F.col("l_extendedprice") / 100).alias("total_rewards"),
                (F.col("l_discount") * 100).alias("remaining_reward_amount"),
            )
        ).alias("rewards_config")
    )
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    cust = F.col("o_custkey")
    price = 0.01 + (cust % 98) / 100.0
    yes, no = F.when(cust % 3 == 0, "Yes").otherwise("Alpha"), F.when(cust % 3 == 0, "No").otherwise("Beta")
    tokens = F.array(
        F.struct(no.alias("outcome"), (1 - price).alias("price")),
        F.struct(yes.alias("outcome"), price.alias("price")),
    )
    return orders.join(configs, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").alias("condition_id"),
        F.concat(F.lit("Market "), F.col("o_orderkey").cast("string")).alias("question"),
        F.when(cust % 5 != 0, F.lower("o_orderstatus")).alias("tag_slug"),
        F.when(cust % 7 != 0, 3.5).alias("rewards_max_spread"),
        (cust % 500).cast("int").alias("rewards_min_size"),
        F.when(cust % 4 != 0, (cust % 10) / 10.0).alias("market_competitiveness"),
        F.when(cust % 6 == 0, 0.0).otherwise(F.col("o_totalprice") / 1000).alias("native_daily_rate"),
        F.when(cust % 9 != 0, F.col("o_totalprice") / 2000).alias("total_daily_rate"),
        "rewards_config",
        tokens.alias("tokens"),
    )


def order_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Open-order snapshots: two resting orders per market, five looks each.

    The YES order is gone from look 2 on where the Blue ``k % 4 = 0``, the NO
    order from look 3 on where the Red ``k % 4 = 1``.
    """
    g = games(spark, sf)
    look = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("look")
    rows = g.select(
        F.col("gameid").alias("market"), "date", F.col("b.k").alias("bk"), F.col("r.k").alias("rk"), look
    )
    base = 0.05 + 0.9 * (F.col("bk") / 99.0)
    step = ((F.col("rk") % 7) - 3) / 100.0
    mid = F.greatest(F.lit(0.02), F.least(F.lit(0.98), base + step * F.col("look")))
    yes_open = ~((F.col("bk") % 4 == 0) & (F.col("look") >= 2))
    no_open = ~((F.col("rk") % 4 == 1) & (F.col("look") >= 3))
    return rows.select(
        "market",
        (F.col("date") + F.make_interval(secs=F.col("look") * 30)).alias("snap_ts"),
        "look",
        mid.alias("mid"),
        yes_open.alias("yes_open"),
        no_open.alias("no_open"),
    )


def fills(spark: SparkSession, sf: str) -> DataFrame:
    """Fills per market side from ``lineitem``: token, side, shares, price."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    return li.select(
        F.col("l_suppkey").alias("market"),
        F.col("l_shipdate").cast("timestamp").alias("fill_ts"),
        F.col("l_orderkey").alias("fill_id"),
        F.col("l_linenumber").alias("fill_no"),
        F.col("l_partkey").alias("fill_part"),
        F.when(F.col("l_linenumber") % 2 == 1, "YES").otherwise("NO").alias("side"),
        F.col("l_quantity").alias("shares"),
        (0.01 + (F.col("l_partkey") % 98) / 100.0).alias("price"),
    )
