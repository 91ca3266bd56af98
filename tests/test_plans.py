import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fungo import config as C
from fungo.operators import leverage
from fungo.plans import comparison, serving
from fungo.plans.features import build_features
from fungo.streaming import quotes as stream
from fungo.sources.tables import read_or_empty
from fungo.schemas import DDL
from tests import world


def market(spark, games, books=4, seed=6):
    """Quotes for every game at two instants, plus one event nobody plays."""
    r = random.Random(seed)
    rows, n = [], 0
    for g in games + [dict(games[0], game_pk=-1, home_team_name="Ghosts")]:
        for hours in (26, 2):
            at = g["game_date_utc"] - dt.timedelta(hours=hours)
            for b in range(books):
                for name, point in (("h2h", None), ("spreads", -1.5), ("totals", 8.5)):
                    n += 1
                    rows.append((f"e{g['game_pk']}", str(g["game_date_utc"]) + "Z", str(at) + "Z", g["home_team_name"], g["away_team_name"],
                                 name, point, f"b{b}", min(max(0.5 + r.gauss(0, 0.05), 0.1), 0.9), n))
    return spark.createDataFrame(rows, "event_id string, commence_time string, fetched_at string, home_team string, away_team string, "
                                 "market string, point double, book_key string, devig_prob_home double, ordinal bigint")


def spread_out(n, **more):
    """One game a day and pair, so that every event has one game in reach."""
    games = world.games(n=n, **more)
    for i, g in enumerate(games):
        day = dt.date(2022, 1, 1) + dt.timedelta(days=i)
        g.update(official_date=day, season=day.year, game_date_utc=dt.datetime(day.year, day.month, day.day, 23, 10))
    return games


def test_quotes_to_verdict(spark):
    games = spread_out(160)
    df = world.frame(spark, games, world.GAME_DDL)
    r = random.Random(1)
    lines = [(g["game_pk"], m, p, r.uniform(0.3, 0.7), 0.0) for g in games for m, p in C.USUAL_LINES]
    predictions = spark.createDataFrame(lines, "game_pk bigint, market string, point double, prob double, push double")
    cover, report = comparison.market_report(market(spark, games), df, predictions, draws=200)
    row = cover.first()
    assert (row.odds_events, row.unmatched_events, row.priced_game_markets) == (161, 1, 480)
    assert row.median_entry_lead_hours == 26.0 and row.median_close_lead_hours == 2.0 and row.with_entry == 480
    got = {(r.price, r.market): r for r in report.collect()}
    played = sum(g["home_score"] is not None for g in games)
    assert len(got) == 6 and all(r.games == played for r in got.values())
    assert got[("close_prob", "h2h")].log_loss_model > got[("close_prob", "h2h")].log_loss_market
    assert comparison.live_gate(report).first().status == "research_only"
    assert {r.market for r in comparison.verdict_rows(report).collect()} == {"moneyline", "run line", "total"}
    assert comparison.beaten_markets(report).count() == sum(1 for r in got.values() if r.ci_high is not None and r.ci_high < 0)


def test_umpire_study(spark):
    games = world.games(n=300, seasons=(2021, 2022), unplayed=0.0)
    umps = world.umpires(games)
    for u in umps:
        u["hp_umpire_id"] = u["game_pk"] % 7
    df = world.frame(spark, games, world.GAME_DDL)
    r = random.Random(1)
    p = spark.createDataFrame([(g["game_pk"], "h2h", r.uniform(.4, .6), 4.5, 4.5) for g in games],
                              "game_pk bigint, market string, prob double, expected_home double, expected_away double")
    frame = comparison.umpire_frame(df, world.frame(spark, umps, DDL["umpires"]), p, world.frame(spark, world.pitching(games), DDL["pitching"]))
    assert frame.count() == len(umps)
    got = {(r.measure, r.season): r for r in comparison.umpire_report(frame, draws=200).collect()}
    assert len(got) == 9 and {k[1] for k in got} == {None, 2021, 2022}
    assert got[("residual_home_win", None)].rows == len(umps) and got[("residual_home_win", None)].groups == 7


def test_serving_card(spark):
    games = spread_out(420, unplayed=0.0)
    for g in games[-4:]:
        g.update(home_score=None, away_score=None, home_win=None, total_runs=None, run_diff=None)
    df = world.frame(spark, games, world.GAME_DDL)
    features = build_features(df, spark.createDataFrame([], "venue_id string, elevation_m double")).persist()
    lines = []
    for i, g in enumerate(games[-4:]):
        for m, p in (("h2h", None), ("totals", 9.0), ("spreads", 1.5)):
            lines.append((f"e{i}", str(g["game_date_utc"]) + "Z", g["home_team_name"], g["away_team_name"], m, p, 0.5, 5, 0.01,
                          -110.0, -110.0, -105.0, "x", -105.0, "y", dt.datetime(2023, 2, 1), i))
    board = spark.createDataFrame(lines, "event_id string, commence_time string, home_team string, away_team string, market string, point double, "
                                  "consensus_prob_home double, market_books int, market_spread double, consensus_price_home double, consensus_price_away double, "
                                  "best_price_home double, best_book_home string, best_price_away double, best_book_away string, fetched_at timestamp, ordinal bigint")
    assert serving.offered_points(board) == [("h2h", None), ("spreads", 1.5), ("totals", 9.0)]
    now = F.lit(str(games[-3]["game_date_utc"] - dt.timedelta(hours=1))).cast("timestamp")
    card, missed = serving.build_card(board, df, features, now)
    rows = card.collect()
    assert len(rows) == 9 and missed.count() == 0 and {r.game_pk for r in rows} == {g["game_pk"] for g in games[-3:]}
    assert all(0 < r.model_prob_home < 1 and abs(r.disagreement - (r.model_prob_home - r.market_prob_home)) < 2e-6 for r in rows)
    assert min(r.lead_minutes for r in rows) == 60
    assert serving.archive_coverage(df, spark.createDataFrame([(games[0]["game_pk"], "open")], "game_pk bigint, roof_category string")).where(
        "is_total = 1").first().games == 416


def test_leverage_by_hand(spark):
    r = random.Random(2)
    games = [(g, int(r.random() < 0.5)) for g in range(60)] + [(99, None)]
    plays = [(g, dt.date(2025, 4, 1), r.randint(1, 12), r.randint(0, 1), r.randint(0, 2), r.randint(0, 2), r.randint(0, 2), r.randint(1, 3))
             for g, _ in games for _ in range(40)]
    p = spark.createDataFrame(plays, DDL["plays"])
    g = spark.createDataFrame(games, "game_pk bigint, home_win int")
    won, table = dict(games), {}
    kept = [x for x in plays if won[x[0]] is not None]
    for x in kept:
        k = (min(x[2], 10), x[3], x[4], max(min(x[5] - x[6], 8), -8))
        table.setdefault(k, []).append(won[x[0]])
    rate = sum(won[x[0]] for x in kept) / len(kept)
    we = {k: sum(v) / len(v) if len(v) >= 30 else rate for k, v in table.items()}
    swing = {}
    for k in we:
        up = (*k[:3], max(min(k[3] + (1 if k[1] == 0 else -1), 8), -8))
        out = (k[0], k[1], min(k[2] + 1, 2), k[3])
        swing[k] = abs(we.get(up, rate) - we[k]) + abs(we.get(out, rate) - we[k])
    mean = sum(swing[k] * len(v) for k, v in table.items()) / len(kept)
    want = {}
    for x in kept:
        k = (min(x[2], 10), x[3], x[4], max(min(x[5] - x[6], 8), -8))
        n, s, h = want.get((x[0], x[7]), (0, 0.0, 0))
        lev = swing[k] / mean
        want[(x[0], x[7])] = (n + 1, s + lev, h + (lev >= 1.5))
    got = {(r.game_pk, r.pitcher_id): r for r in leverage.bullpen_leverage(p, g).collect()}
    assert set(got) == set(want)
    for k, (n, s, h) in want.items():
        assert got[k].batters == n and got[k].leverage_sum == pytest.approx(s, abs=1e-3) and abs(got[k].high_leverage_batters - h) <= 1


def test_stream_screening_holds_the_cap(spark, tmp_path):
    from tests.test_ledger import NOW, card
    for i, ids in enumerate(([1, 2], [2, 3, 4, 5])):
        card(spark, *[dict(game_pk=k, disagreement=0.05 + k / 100) for k in ids]).write.parquet(f"{tmp_path}/in/{i}")
        rows = spark.readStream.schema(card(spark, {}).schema).parquet(f"{tmp_path}/in/*")
        stream.screen_cards(rows, f"{tmp_path}/ledger", f"{tmp_path}/no", f"{tmp_path}/state", lambda b: F.lit(NOW).cast("timestamp")).awaitTermination()
    got = read_or_empty(spark, "ledger", f"{tmp_path}/ledger")
    assert sorted(r.game_pk for r in got.collect()) == [1, 2, 5]
    refused = {(r.batch, r.game_pk): r.gate for r in spark.read.parquet(f"{tmp_path}/no").collect()}
    assert refused == {(1, 2): "already_locked", (1, 3): "day_cap", (1, 4): "day_cap"}


def test_late_new_ids_are_logged(spark, tmp_path):
    ddl = "snapshot_id string, fetched_at timestamp"
    noon = dt.datetime(2025, 5, 2, 12)
    for i, rows in enumerate(([("a", noon)], [("old", noon - dt.timedelta(days=40)), ("a", noon), ("b", noon), ("b", noon)])):
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        live = spark.readStream.schema(ddl).parquet(f"{tmp_path}/in/*")
        stream.log_quotes(live, f"{tmp_path}/log", f"{tmp_path}/s").awaitTermination()
    assert sorted(r.snapshot_id for r in spark.read.parquet(f"{tmp_path}/log").collect()) == ["a", "b", "old"]


def test_a_replayed_screening_batch_decides_the_same(spark, tmp_path):
    """The stream forgets that its last batch was done, as after a failure between the sinks and the commit."""
    from tests.test_ledger import NOW, card
    at = lambda b: F.lit(NOW).cast("timestamp")
    for i, ids in enumerate(([1, 2], [2, 3, 4, 5])):
        card(spark, *[dict(game_pk=k, disagreement=0.05 + k / 100) for k in ids]).write.parquet(f"{tmp_path}/in/{i}")
        rows = spark.readStream.schema(card(spark, {}).schema).parquet(f"{tmp_path}/in/*")
        stream.screen_cards(rows, f"{tmp_path}/ledger", f"{tmp_path}/no", f"{tmp_path}/state", at).awaitTermination()

    def kept():
        return [sorted((r.batch, r.game_pk, getattr(r, "gate", "")) for r in spark.read.parquet(f"{tmp_path}/{t}").collect()) for t in ("ledger", "no")]
    before = kept()
    for f in ("1", ".1.crc"):
        (tmp_path / "state" / "commits" / f).unlink(missing_ok=True)
    stream.screen_cards(rows, f"{tmp_path}/ledger", f"{tmp_path}/no", f"{tmp_path}/state", at).awaitTermination()
    assert kept() == before and len(before[0]) == 3 and len(before[1]) == 3


def test_a_reader_in_between_and_a_failed_commit_see_the_old_table(spark, tmp_path, monkeypatch):
    from fungo.sources import tables
    path = f"{tmp_path}/t"
    tables.replace_table(spark.range(3).toDF("n"), path)
    old = tables.read_table(spark, path)
    tables.replace_table(spark.range(9).toDF("n"), path)
    assert old.count() == 3 and tables.read_table(spark, path).count() == 9
    # Two writers start from one commit: the second fails, and its data is not seen.
    base, _ = tables.current(spark, path)
    spark.range(5).toDF("n").write.parquet(f"{path}/{tables.DATA}/late")
    tables.replace_table(spark.range(4).toDF("n"), path)
    with pytest.raises(Exception, match="exists"):
        tables.commit(spark, path, base, ["late"])
    assert tables.read_table(spark, path).count() == 4
    # A commit that broke off while it was written is none.
    (tmp_path / "t" / tables.COMMITS / f"{base + 2:020d}").write_text("late")
    assert tables.read_table(spark, path).count() == 4
    with pytest.raises(Exception, match="exists"):
        tables.replace_table(spark.range(6).toDF("n"), path)
    monkeypatch.setattr(tables, "ABANDONED", -10)
    tables.replace_table(spark.range(6).toDF("n"), path)
    assert tables.read_table(spark, path).count() == 6
    assert len(list((tmp_path / "t" / tables.DATA).iterdir())) == 4  # two commits and two stray ones
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, f"{tmp_path}/none")


def test_stream_filters_and_board(spark, tmp_path):
    ddl = "k string, commence string, at timestamp, n bigint"
    t = dt.datetime(2025, 4, 17, 12)
    batches = [[("a", "2025-04-17T13:00:00Z", t, 1), ("b", "2025-04-17T11:00:00Z", t, 2), ("a", "2025-04-17T13:00:00Z", t, 3)],
               [("a", "2025-04-17T23:00:00Z", t + dt.timedelta(hours=5), 4), ("c", "bad", t, 5), ("a", "2025-04-17T23:00:00Z", t, 6)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/in/{i}")
        live = stream.not_started(spark.readStream.schema(ddl).parquet(f"{tmp_path}/in/*"), "commence", "at")
        stream.keep_board(live, f"{tmp_path}/board", f"{tmp_path}/s", ["k"], "at", "n").awaitTermination()
    assert [(r.k, r.n) for r in stream.read_board(spark, f"{tmp_path}/board").collect()] == [("a", 4)]
    fresh = stream.fresh(spark.createDataFrame(batches[1], ddl), "at", F.lit(str(t + dt.timedelta(hours=6))).cast("timestamp"))
    assert [r.n for r in fresh.collect()] == [4]
