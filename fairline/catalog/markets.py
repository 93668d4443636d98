"""Queries for market records, books, rewards and order prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairline import fixtures
from fairline.catalog.base import EVENTS, Registry, register, sql
from fairline.functions import market_text as X
from fairline.operators import markets as M

REGISTRY: Registry = {}

MARKETS = EVENTS + """,
me0 AS (
  SELECT gameid, league, bt AS t1, rt AS t2, bwon, bv AS value, date,
    strftime(date + INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%SZ') AS ended,
    CASE WHEN gameid % 11 = 0 THEN 'Counter-Strike: ' || league
         ELSE league || CASE WHEN gameid % 5 = 0 THEN ' Challenger' ELSE '' END || ' match day' END AS title FROM g),
me1 AS (
  SELECT *, lower(replace(title, ' ', '-')) AS slug, 'c' || gameid AS condition_id,
    CASE WHEN gameid % 4 = 0 THEN 'LoL: ' || t1 || ' vs ' || t2 || '. (BO3)'
         ELSE league || ': ' || t1 || ' vs ' || t2 || '.' END AS question,
    CASE WHEN gameid % 97 = 0 THEN NULL WHEN gameid % 19 = 0 THEN NULL WHEN bwon = 1 THEN 1 ELSE 0 END AS result,
    CASE WHEN gameid % 29 <> 0 THEN ended ELSE 'not a date' END AS end_date,
    CASE WHEN gameid % 7 <> 0 THEN 0.5::DOUBLE END AS last_trade_price,
    CASE WHEN gameid % 19 = 0 THEN 'proposed' ELSE 'resolved' END AS uma_status,
    round_even(value * 10, 2) AS volume,
    CASE WHEN gameid % 6 = 0 THEN [t2, t1] ELSE [t1, t2] END AS outs FROM me0),
me2 AS (
  SELECT *, lower(outs[2]) = lower(t1) OR (lower(outs[1]) <> lower(t1) AND contains(lower(outs[2]), lower(t1))
    AND NOT contains(lower(outs[1]), lower(t1))) AS swap FROM me1),
me AS (
  SELECT *, CASE WHEN swap THEN 'n' || gameid ELSE 'y' || gameid END AS yes_token_id,
    CASE WHEN swap THEN 'y' || gameid ELSE 'n' || gameid END AS no_token_id, CAST(2 AS INTEGER) AS n_outcomes,
    t1 AS team1, t2 AS team2 FROM me2),
mp AS (
  SELECT * FROM me WHERE gameid % 11 <> 0 AND regexp_matches(question, '^(LoL|LCK|LPL|LEC)')
    AND (gameid % 4 = 0 OR league IN ('LCK', 'LPL', 'LEC'))
    AND regexp_matches(lower(question || ' ' || title), '\\b(lck|lpl|lec|vcs)\\b'))"""
ROW = ["condition_id", "question", "team1", "team2", "end_date", "result", "uma_status", "yes_token_id", "n_outcomes"]


def parsed(spark, sf):
    return M.parse_markets(fixtures.market_events(spark, sf))


@register(REGISTRY, "F3_F4_F5_F6_parse_markets", sql(MARKETS, "SELECT * FROM mp", ROW, ["last_trade_price", "volume"]))
def parse_markets(spark, sf):
    return parsed(spark, sf).select(*ROW, "last_trade_price", "volume")


@register(REGISTRY, "F3_match_question_filter",
          sql(MARKETS, """SELECT league, gameid % 4 = 0 AS old_format, count(*) AS n_questions,
  count(*) FILTER (gameid IN (SELECT gameid FROM mp)) AS n_match FROM me GROUP BY ALL""",
              ["league", "old_format", "n_questions", "n_match"]))
def question_filter(spark, sf):
    e = fixtures.market_events(spark, sf).select("gameid", "league", "title", F.col("markets")[0]["question"].alias("q"))
    return e.groupBy("league", (F.col("gameid") % 4 == 0).alias("old_format")).agg(
        F.count(F.lit(1)).alias("n_questions"), F.count_if(X.is_match_market("q", "title")).alias("n_match"))


@register(REGISTRY, "F7_search_markets",
          sql(MARKETS, """SELECT * FROM me WHERE gameid % 4 = 0 AND (regexp_matches(lower(title || ' ' || slug), '\\b(lck|lpl|lec|vcs)\\b'))
  AND (contains(lower(title), 'lck') OR contains(slug, 'lck')) AND NOT contains(lower(title), 'lck challenger')
  AND NOT contains(slug, 'lck-challenger')""", ["condition_id", "question", "yes_token_id", "no_token_id", "end_date"]))
def search_markets(spark, sf):
    return M.search_markets(fixtures.market_events(spark, sf), query="lck", league="LCK", limit=None)


@register(REGISTRY, "S10_T8_market_upsert",
          sql(MARKETS, """SELECT condition_id, 'known' AS origin FROM mp WHERE gameid % 3 = 0
  UNION ALL SELECT condition_id, 'new' FROM mp WHERE gameid % 3 <> 0""", ["condition_id", "origin"]))
def upsert(spark, sf):
    """A third of the markets is in the store already; the batch holds all."""
    rows = parsed(spark, sf).select("condition_id")
    known = rows.filter(F.substring("condition_id", 2, 20).cast("long") % 3 == 0).withColumn("origin", F.lit("known"))
    return M.upsert_markets(rows.withColumn("origin", F.lit("new")), known)


@register(REGISTRY, "P6_resolved_markets",
          sql(MARKETS, "SELECT * FROM mp WHERE result IS NOT NULL AND volume >= 50 AND gameid % 29 <> 0",
              ["condition_id", "result", "end_date"]))
def resolved(spark, sf):
    return M.resolved_markets(parsed(spark, sf)).select("condition_id", "result", "end_date")


@register(REGISTRY, "A14_market_report",
          sql(MARKETS, """SELECT CASE WHEN result IS NOT NULL THEN 'settled' ELSE uma_status END AS status, count(*) AS n,
  avg(volume) AS mean_volume, min(end_date[1:4]) AS first_year, max(end_date[1:4]) AS last_year,
  count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM mp GROUP BY 1""",
              ["status", "n", "first_year", "last_year"], ["mean_volume", "share"]))
def market_report(spark, sf):
    return M.market_report(parsed(spark, sf))


@register(REGISTRY, "F12_hours_to_match",
          sql(MARKETS, "SELECT *, CASE WHEN gameid % 29 = 0 THEN 168 ELSE greatest(0, (epoch_us(date_trunc('second', date + "
                       "INTERVAL 1 HOUR)) - epoch_us(TIMESTAMP '2024-01-15 00:00:00')) / 3600e6) END AS hours FROM mp",
              ["condition_id"], ["hours"]))
def hours(spark, sf):
    asof = F.lit("2024-01-15 00:00:00").cast("timestamp")
    return parsed(spark, sf).select("condition_id", X.hours_to(F.col("end_date"), asof).alias("hours"))


# --- books ------------------------------------------------------------------------

BOOK = """
bk AS (SELECT l_orderkey AS token_id, CASE WHEN l_linenumber % 2 = 1 THEN 'bid' ELSE 'ask' END AS side,
  0.01::DOUBLE + (l_partkey % 98) / 100.0::DOUBLE AS price, l_quantity AS size FROM lineitem),
lv AS (SELECT *, row_number() OVER (PARTITION BY token_id, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END, size)
  AS level FROM bk),
md AS (SELECT token_id, max(price) FILTER (side = 'bid') AS best_bid, min(price) FILTER (side = 'ask') AS best_ask FROM bk
  GROUP BY token_id)"""
_MID = "coalesce((best_bid + best_ask) / 2, best_bid, best_ask)"


@register(REGISTRY, "F8_mid_price",
          sql(BOOK, f"SELECT *, {_MID} AS mid FROM md", ["token_id"], ["best_bid", "best_ask", "mid"]))
def mid_price(spark, sf):
    return M.mid_price(fixtures.book(spark, sf))


@register(REGISTRY, "T4_top_levels",
          sql(BOOK, "SELECT *, CAST(level AS INTEGER) AS level_ FROM lv WHERE level <= 2",
              ["token_id", "side", "level_"], ["price", "size"]))
def top_levels(spark, sf):
    return M.top_levels(fixtures.book(spark, sf), 2).select("token_id", "side", F.col("level").alias("level_"), "price", "size")


def _levels_sql(side):
    entry = "CAST(round(price * 100) AS INTEGER) || 'x' || CAST(size AS INTEGER)"
    return f"coalesce(string_agg({entry}, ' ' ORDER BY level) FILTER (side = '{side}'), '')"


@register(REGISTRY, "F9_book_snapshot",
          sql(BOOK, f"""SELECT s.*, {_MID} AS mid FROM (SELECT token_id, {_levels_sql('bid')} AS bids, {_levels_sql('ask')} AS asks
  FROM lv WHERE level <= 3 GROUP BY token_id) s JOIN md USING (token_id)""", ["token_id", "bids", "asks"], ["mid"]))
def book_snapshot(spark, sf):
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat(
        F.round(x["price"] * 100).cast("int").cast("string"), F.lit("x"), x["size"].cast("int").cast("string"))), " ")
    return M.book_snapshot(fixtures.book(spark, sf), 3).select(
        "token_id", text("bids").alias("bids"), text("asks").alias("asks"), "mid")


_LIVE = BOOK + """,
lq AS (SELECT *, least(greatest(0.01::DOUBLE, (token_id % 97) / 100.0::DOUBLE), 0.97) AS bid,
  least(greatest(0.03::DOUBLE, (token_id % 97) / 100.0::DOUBLE + 0.02), 0.99)::DOUBLE AS ask FROM md)"""
_T1 = "least(bid, round_even(best_ask - 0.01::DOUBLE, 2))"
_T2 = "least(round_even(1 - ask, 2), round_even(round_even(1 - best_bid, 2) - 0.01::DOUBLE, 2))"


@register(REGISTRY, "F13_F14_resting_prices",
          sql(_LIVE, f"SELECT *, {_T1} AS t1_price, {_T2} AS t2_price, round_even(least(best_ask + 0.01::DOUBLE, 0.99), 2) "
                     f"AS taker_price, {_T1} + {_T2} >= 1 AS crossed_pair FROM lq", ["token_id", "crossed_pair"],
              ["t1_price", "t2_price", "taker_price"]))
def resting(spark, sf):
    step = (F.col("token_id") % 97) / 100.0
    live = M.mid_price(fixtures.book(spark, sf)).withColumns(
        {"bid": F.least(F.greatest(F.lit(0.01), step), F.lit(0.97)),
         "ask": F.least(F.greatest(F.lit(0.03), step + 0.02), F.lit(0.99))})
    return M.resting_prices(live).select("token_id", "crossed_pair", "t1_price", "t2_price", "taker_price")


# --- rewards -----------------------------------------------------------------------

REWARDS = """
cf AS (SELECT l_orderkey, sum(l_extendedprice / 100) AS total_pool, sum(l_discount * 100) AS remaining_pool FROM lineitem GROUP BY 1),
rw0 AS (SELECT *, o_orderkey AS condition_id, CAST(o_custkey % 500 AS INTEGER) AS min_shares,
  CASE WHEN o_custkey % 7 <> 0 THEN 3.5::DOUBLE ELSE 3 END AS max_spread_c,
  CASE WHEN o_custkey % 4 <> 0 THEN (o_custkey % 10) / 10.0::DOUBLE ELSE 0 END AS competitiveness,
  coalesce(nullif(CASE WHEN o_custkey % 6 = 0 THEN 0.0::DOUBLE ELSE o_totalprice / 1000 END, 0),
           nullif(CASE WHEN o_custkey % 9 <> 0 THEN o_totalprice / 2000 END, 0), 0) AS daily_rate,
  1 - (0.01::DOUBLE + (o_custkey % 98) / 100.0::DOUBLE) AS yes_price,
  CASE WHEN o_custkey % 5 <> 0 THEN lower(o_orderstatus) ELSE 'asked' END AS category
  FROM orders LEFT JOIN cf ON o_orderkey = l_orderkey),
rw AS (SELECT *, min_shares * yes_price AS capital_per_side FROM rw0
  WHERE daily_rate >= 10 AND (min_shares = 0 OR min_shares * yes_price <= 100))"""
SCAN = ["daily_rate", "max_spread_c", "competitiveness", "yes_price", "capital_per_side", "remaining_pool"]


@register(REGISTRY, "F10_reward_scan",
          sql(REWARDS, "SELECT * REPLACE (coalesce(remaining_pool, 0) AS remaining_pool) FROM rw", ["condition_id", "min_shares", "category"], SCAN))
def reward_scan(spark, sf):
    out = M.scan_rewards(fixtures.reward_markets(spark, sf), max_capital=100.0, queried_tag="asked")
    return out.select("condition_id", "min_shares", "category", *SCAN)


@register(REGISTRY, "F11_reward_config",
          sql(REWARDS, """SELECT *, CASE WHEN o_custkey % 7 <> 0 THEN 3.5 END AS max_spread, min_shares AS min_size,
  coalesce(total_pool, 0) AS total_pool_, coalesce(remaining_pool, 0) AS remaining_pool_ FROM rw0""",
              ["condition_id", "min_size"], ["max_spread", "daily_rate", "total_pool_", "remaining_pool_"]))
def reward_config(spark, sf):
    return M.reward_config(fixtures.reward_markets(spark, sf)).select(
        "condition_id", "min_size", "max_spread", "daily_rate", F.col("total_pool").alias("total_pool_"),
        F.col("remaining_pool").alias("remaining_pool_"))


@register(REGISTRY, "T6_best_reward_market",
          sql(REWARDS, "SELECT *, daily_rate / greatest(competitiveness, 0.1) AS score FROM rw ORDER BY score DESC, condition_id LIMIT 1",
              ["condition_id"], ["daily_rate", "score"]))
def best_reward(spark, sf):
    scan = M.scan_rewards(fixtures.reward_markets(spark, sf), max_capital=100.0)
    return M.best_reward_market(scan).select("condition_id", "daily_rate", "score")


@register(REGISTRY, "F16_token_choice",
          sql(REWARDS, """SELECT *, CASE WHEN o_custkey % 3 = 0 THEN 'Yes' ELSE 'Beta' END AS yes_name,
  CASE WHEN o_custkey % 3 = 0 THEN 'No' ELSE 'Alpha' END AS no_name FROM rw0""", ["condition_id", "yes_name", "no_name"]))
def token_choice(spark, sf):
    out = M.market_tokens(fixtures.reward_markets(spark, sf))
    return out.select("condition_id", F.col("yes_token.outcome").alias("yes_name"), F.col("no_token.outcome").alias("no_name"))
