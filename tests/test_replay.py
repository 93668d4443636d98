"""Games that arrive in any order are rated as one pass in time order rates them."""

import random

import pytest

from fairline.streaming.ingest import RatingSink
from tests.test_ratings import frame, season, sequential


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_arrival(spark, tmp_path, seed):
    rows = season(200, seed, teams=6, hole=0.03)  # 8.3 days
    order = random.Random(seed)
    batches: list[list] = [[], [], []]
    for row in rows:
        batches[order.randrange(3)].append(row)  # sides of a game may come apart
    batches[2] += [r for r in rows if r[0] % 40 == 0]  # repeats of games rated before
    sink = RatingSink(str(tmp_path), chunk_days=2)
    for k, part in enumerate(batches):
        sink(frame(spark, sorted(set(part))).drop("sec"), k)
    want, last = sequential(rows)
    got = sink.games(spark).collect()
    assert sorted(r["gameid"] for r in got) == list(range(200))
    assert all((r["ra"], r["rb"]) == pytest.approx(want[r["gameid"]], abs=1e-9) for r in got)
    assert {r["team"]: r["rating"] for r in sink.ratings(spark).collect()} == pytest.approx(last, abs=1e-9)
    assert sink.late_games(spark).count() > 0 and sink.pending(spark).count() == 0


def test_only_chunks_from_the_late_game_on_are_replayed(spark, tmp_path):
    rows = season(120, 3, teams=5)  # an hour apart: chunks of one day
    late = [r for r in rows if r[0] == 70]
    sink = RatingSink(str(tmp_path), chunk_days=1)
    sink(frame(spark, [r for r in rows if r[0] != 70]).drop("sec"), 0)
    for _ in range(2):  # a retry changes nothing
        sink(frame(spark, late).drop("sec"), 1)
    sink(frame(spark, late).drop("sec"), 2)  # a repeat changes nothing either
    games = {r["gameid"]: r for r in sink.games(spark).collect()}
    want, last = sequential(rows)
    assert len(games) == 120 and all((r["ra"], r["rb"]) == pytest.approx(want[g], abs=1e-9) for g, r in games.items())
    again = {g for g, r in games.items() if r["batch"] == 1}
    assert again == {g for g, r in games.items() if r["chunk"] >= games[70]["chunk"]} and 0 < len(again) < 100
    assert {r["gameid"] for r in sink.late_games(spark).collect()} == {70}
    assert {r["team"]: r["rating"] for r in sink.ratings(spark).collect()} == pytest.approx(last, abs=1e-9)
    before = {r["team"]: r["rating"] for r in sink.ratings(spark, 1).collect()}
    assert before == pytest.approx(sequential([r for r in rows if r[0] != 70])[1], abs=1e-9)
