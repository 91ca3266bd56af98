import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from fungo.operators.dedup import deduplicate_games, keep_first, keyed_union, pending
from fungo.operators.quotes import paired_book_quotes, quote_log
from fungo.plans.features import combined_weather
from fungo.schemas import DDL
from fungo.sources import landing as L, tables as T


def land(spark, tmp_path, kind, *documents):
    for i, d in enumerate(documents):
        (tmp_path / f"{kind}{i}.json").write_text(json.dumps(d))
    return L.read_landed(spark, kind, f"{tmp_path}/{kind}*.json")


def game(pk, status="Final", home=5, away=3, innings=({"home": {"runs": 1}},), **extra):
    return {"gamePk": pk, "officialDate": "2025-04-11", "gameDate": "2025-04-11T23:10:00Z", "season": "2025",
            "status": {"abstractGameState": status}, "linescore": {"innings": list(innings)},
            "teams": {"home": {"score": home, "team": {"id": 1, "name": "H"}, "probablePitcher": {"id": 9}},
                      "away": {"score": away, "team": {"id": 2, "name": "A"}}}, "venue": {"id": 4}, **extra}


def test_schedule(spark, tmp_path):
    doc = {"dates": [{"games": [game(1), game(2, "Preview", 0, 0), game(None), game(3, innings=({"home": {}},))]},
                     {"games": [game(4, home=None), game(5, home=2, away=4, innings=(), scheduledInnings=7)]}]}
    rows = {r.game_pk: r for r in L.schedule_games(land(spark, tmp_path, "schedule", doc)).collect()}
    assert set(rows) == {1, 2, 3, 4, 5}
    assert rows[1].home_win == 1 and rows[1].total_runs == 8 and rows[1].run_diff == 2 and rows[1].home_batted_ninth == 1
    assert rows[2].home_score is None and rows[2].home_win is None and rows[2].home_batted_ninth is None
    assert rows[3].home_batted_ninth == 0 and rows[4].home_score is None
    assert rows[5].home_win == 0 and rows[5].innings_played is None and rows[5].scheduled_innings == 7
    assert rows[1].double_header == "N" and rows[1].scheduled_innings == 9 and rows[1].away_sp_id is None
    assert sorted(r.split()[0] for r in DDL["games"].split(", ")) == sorted(L.schedule_games(
        land(spark, tmp_path, "schedule", doc)).columns)


def test_boxscore(spark, tmp_path):
    def line(k):
        return {"stats": {"pitching": {"outs": k, "strikeOuts": k}}}
    doc = {"game_pk": 7, "official_date": "2025-04-11",
           "teams": {"home": {"team": {"id": 1}, "pitchers": [11, 12, 13], "players": {"ID11": line(15), "ID12": line(3), "ID13": {"stats": {"pitching": {}}}}},
                     "away": {"team": {"id": 2}, "pitchers": [21], "players": {"ID21": line(27)}}},
           "officials": [{"officialType": "First Base", "official": {"id": 1, "fullName": "F"}},
                         {"officialType": " Home Plate ", "official": {"id": 2, "fullName": "P"}}]}
    blank = {"game_pk": 8, "official_date": "2025-04-11", "officials": [{"officialType": "Home Plate", "official": {}}]}
    landed = land(spark, tmp_path, "boxscore", doc, blank)
    got = {(r.team_id, r.player_id): (r.is_starter, r.outs) for r in L.boxscore_pitching(landed).collect()}
    assert got == {(1, 11): (1, 15), (1, 12): (0, 3), (2, 21): (1, 27)}
    assert [(r.game_pk, r.hp_umpire_id, r.hp_umpire_name) for r in L.boxscore_umpires(landed).collect()] == [(7, 2, "P")]


def test_play_states(spark, tmp_path):
    def play(inning, top, outs, home, away, pitcher=5):
        return {"about": {"inning": inning, "isTopInning": top}, "count": {"outs": outs},
                "result": {"homeScore": home, "awayScore": away} if home is not None else {},
                "matchup": {"pitcher": {"id": pitcher} if pitcher else {}}}
    doc = {"game_pk": 1, "official_date": "2025-04-11", "allPlays": [
        play(1, True, 1, 0, 0), play(1, True, 0, 0, 1), play(1, True, 3, 0, 1), play(1, True, 3, 0, 1),
        play(1, False, 1, 2, 1), play(1, False, 2, None, None), play(None, False, 2, 9, 9),
        play(1, False, 2, 2, 1, None), play(1, False, 3, 3, 1)]}
    got = L.play_states(land(spark, tmp_path, "playbyplay", doc)).orderBy("at").collect()
    assert [(r.is_top, r.outs_before, r.home_score_before, r.away_score_before) for r in got] == [
        (1, 0, 0, 0), (1, 1, 0, 0), (1, 1, 0, 1), (1, 2, 0, 1), (0, 0, 0, 1), (0, 1, 2, 1), (0, 2, 2, 1)]


def test_venues_keep_the_later_season(spark, tmp_path):
    def venue(i, elevation, lat=1.0):
        return {"id": i, "name": f"V{i}", "location": {"defaultCoordinates": {"latitude": lat, "longitude": 2.0}, "elevation": elevation},
                "fieldInfo": {"roofType": "Open"}}
    a = {"season": 2024, "venues": [venue(1, 5190), venue(2, 10), venue(3, 5, None)]}
    b = {"season": 2025, "venues": [venue(1, 100)]}
    got = {r.venue_id: r.elevation_m for r in L.venue_parks(land(spark, tmp_path, "venues", a, b)).collect()}
    assert got == {"1": 30.48, "2": 3.05}


def test_hourly_weather_onto_games(spark, tmp_path):
    doc = {"venue_id": "1", "hourly": {"time": ["2025-04-11T22:00", "2025-04-11T23:00"], "temperature_2m": [10.0, 11.5],
                                       "wind_speed_10m": [1.0, 10.0], "wind_direction_10m": [0.0, 180.0], "precipitation": [0.0]}}
    hourly = L.hourly_rows(land(spark, tmp_path, "hourly", doc))
    games = spark.createDataFrame([(1, 1.0, dt.datetime(2025, 4, 11, 23, 40), dt.date(2025, 4, 11)),
                                   (2, 1.0, dt.datetime(2025, 4, 12, 5, 0), dt.date(2025, 4, 12)),
                                   (3, 2.0, dt.datetime(2025, 4, 11, 23, 40), dt.date(2025, 4, 11))],
                                  "game_pk bigint, venue_id double, game_date_utc timestamp, official_date date")
    parks = spark.createDataFrame([("1", 0.0, "Open"), ("2", 0.0, "Dome")], "venue_id string, azimuth_angle double, roof_type string")
    got = {r.game_pk: r for r in L.game_weather(games, hourly, parks).collect()}
    assert got[1].temp_c == 11.5 and got[1].wind_out_to_center_ms == 10.0 and got[1].precip_mm is None and got[1].found == 1
    assert got[2].found is None and got[3].wind_out_to_center_ms == 0.0 and got[3].roof_category == "dome"
    today = F.lit("2025-04-13").cast("date")
    assert [r.game_pk for r in games.where(L.servable(games, today, True)).orderBy("game_pk").collect()] == [1, 3]
    assert games.where(L.servable(games, today, False)).count() == 1
    more = games.unionByName(spark.createDataFrame([(4, 77.0, dt.datetime(2025, 4, 11, 23), dt.date(2025, 4, 11))], games.schema))
    rows, counts = L.weather_for_games(more, hourly, parks, F.lit("2025-04-20").cast("date"), True, games.where("game_pk = 3"))
    assert [r.game_pk for r in rows.collect()] == [1]
    assert tuple(counts.select("unknown_park", "outside_window", "missing_hour").first()) == (1, 0, 1)
    late, counts = L.weather_for_games(more, hourly, parks, F.lit("2025-04-20").cast("date"), False)
    assert late.count() == 0 and counts.first().outside_window == 3


EVENT = {"id": "e1", "commence_time": "2025-04-17T23:00:00Z", "home_team": "H", "away_team": "A", "bookmakers": [
    {"key": "b", "title": "B", "last_update": "u", "markets": [
        {"key": "h2h", "outcomes": [{"name": "H", "price": -120}, {"name": "A", "price": 110}]},
        {"key": "totals", "outcomes": [{"name": "Over", "price": -110, "point": 8.5}, {"name": "Under", "price": -110, "point": 8.5}]}]}]}


def test_odds_and_history(spark, tmp_path):
    live = land(spark, tmp_path, "odds", dict(EVENT, region="us", fetched_at="2025-04-17T12:00:00Z"))
    log = quote_log(paired_book_quotes(L.odds_outcomes(live)))
    assert log.count() == 2 and log.select("snapshot_id").distinct().count() == 2
    history = land(spark, tmp_path, "odds_history", {
        "requested_date": "2025-04-17", "timestamp": "2025-04-17T22:50:00Z", "region": "us", "credits_used": 30,
        "credits_remaining": 70, "fetched_at": "2025-05-01T00:00:00Z", "data": [EVENT, dict(EVENT, id="e2", bookmakers=[])]})
    quotes = L.history_quotes(history)
    assert sorted(r.snapshot_id for r in quotes.collect()) == [
        "2025-04-17T22:50:00Z|e1|b|h2h|None", "2025-04-17T22:50:00Z|e1|b|totals|8.5"]
    row = L.history_manifest(history, quotes).first()
    assert (row.events, row.quotes, row.credits_used) == (2, 2, 30)


def games_df(spark, rows):
    return spark.createDataFrame(rows, "game_pk bigint, official_date date, game_date_utc timestamp, home_score int, n bigint")


def test_duplicate_listing(spark):
    day = dt.date(2025, 4, 11)
    rows = [(1, day, dt.datetime(2025, 8, 31, 20), 3, 0), (1, day, dt.datetime(2025, 4, 11, 20), None, 1),
            (2, day, dt.datetime(2025, 4, 11, 20), None, 2), (2, day, dt.datetime(2025, 4, 11, 19), 4, 3),
            (3, day, dt.datetime(2025, 4, 11, 20), 1, 4), (3, day, dt.datetime(2025, 4, 11, 20), 2, 5)]
    got = {r.game_pk: r.n for r in deduplicate_games(games_df(spark, rows), "n").collect()}
    assert got == {1: 1, 2: 3, 3: 4}


def test_keyed_union(spark):
    theirs = spark.createDataFrame([("w1", "", 1), ("w2", "", 2)], "wager_id string, outcome string, n int")
    ours = spark.createDataFrame([("w1", "win", "x"), ("w3", "", "y")], "wager_id string, outcome string, added string")
    got = {r.wager_id: (r.outcome, r.n, r.added) for r in keyed_union(ours, theirs, ["wager_id"]).collect()}
    assert got == {"w1": ("win", None, "x"), "w2": ("", 2, None), "w3": ("", None, "y")}
    assert T.merge_table("card", ours, theirs) is ours


def test_pending_and_calendar(spark):
    done = spark.createDataFrame([(dt.date(2025, 4, 2),)], "requested_date date")
    got = T.snapshot_calendar(spark, "2025-04-01", "2025-04-05", manifest=done, limit=3).collect()
    assert [r.requested_date.day for r in got] == [1, 3, 4] and got[0].moment == dt.datetime(2025, 4, 1, 22, 50)
    asked = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    assert [r.k for r in pending(asked, asked.where("k = 2"), ["k"], limit=1).collect()] == [1]


def test_first_line_is_kept(spark):
    df = spark.createDataFrame([(1, 7, 5, 1), (1, 7, 9, 0), (1, 8, 2, 2)], "game_pk int, player_id int, outs int, n bigint")
    assert sorted((r.player_id, r.outs) for r in keep_first(df, ["game_pk", "player_id"], "n").collect()) == [(7, 9), (8, 2)]


def quote(spark, ids, month="2025-04"):
    return spark.createDataFrame([(i, f"{month}-17T12:00:00Z", "e") for i in ids], "snapshot_id string, fetched_at string, event_id string")


def test_quote_log_is_idempotent(spark, tmp_path):
    path = f"{tmp_path}/log"
    T.append_quotes(quote(spark, ["a", "b", "b"]), path)
    T.append_quotes(quote(spark, ["b", "c"]), path)
    T.append_quotes(quote(spark, ["d"], "2025-05"), path)
    got = spark.read.parquet(path)
    assert sorted(r.snapshot_id for r in got.collect()) == ["a", "b", "c", "d"]
    assert {r.month for r in got.select("month").distinct().collect()} == {"2025-04", "2025-05"}


def test_replace_reads_its_own_target(spark, tmp_path):
    path = f"{tmp_path}/t"
    T.replace_table(spark.range(3).toDF("k"), path)
    T.replace_table(T.read_table(spark, path).selectExpr("k + 10 as k"), path)
    assert sorted(r.k for r in T.read_table(spark, path).collect()) == [10, 11, 12]


def test_missing_tables_and_credits(spark, tmp_path):
    assert T.read_or_empty(spark, "weather", f"{tmp_path}/none").count() == 0
    T.replace_table(T.read_or_empty(spark, "card", f"{tmp_path}/none"), f"{tmp_path}/card")
    empty = T.read_or_empty(spark, "card", f"{tmp_path}/card")
    assert empty.count() == 0 and "disagreement" in empty.columns
    (tmp_path / "u.csv").write_text("game_pk,hp_umpire_id,official_date\n1,,2025-04-11\n2,9.0,\n")
    rows = {r.game_pk: r for r in T.read_or_empty(spark, "umpires", f"{tmp_path}/u.csv", "csv").collect()}
    assert rows[1].hp_umpire_id is None and rows[2].hp_umpire_id == 9 and rows[1].hp_umpire_name is None
    spend = spark.createDataFrame([("2025-04-17", "us", "3", "70"), ("2025-04-17", "eu", "3", "n/a"), ("2025-04-17", "au", "3", "64")],
                                  "fetched_at string, region string, credits_used string, credits_remaining string")
    assert T.record_credits(spend, f"{tmp_path}/credits") == 64
    assert T.read_or_empty(spark, "credit_log", f"{tmp_path}/credits").count() == 3
    T.write_report(spark.range(1).selectExpr("1 as n"), f"{tmp_path}/r")
    assert T.read_report(spark, f"{tmp_path}/r", "n int").first().n == 1
    assert T.read_report(spark, f"{tmp_path}/absent", "n int").count() == 0


def test_archive_beats_forecast(spark):
    ddl = "game_pk bigint, temp_c double"
    got = combined_weather(spark.createDataFrame([(1, 20.0)], ddl), spark.createDataFrame([(1, 9.0), (2, 8.0)], ddl))
    assert {r.game_pk: r.temp_c for r in got.collect()} == {1: 20.0, 2: 8.0}


@pytest.mark.parametrize("started,n", [("2025-04-17T22:00:00Z", 0), ("2025-04-18T00:00:00Z", 2)])
def test_capture_counts(spark, tmp_path, started, n):
    live = land(spark, tmp_path, "odds", dict(EVENT, region="us", fetched_at="2025-04-17T12:00:00Z"))
    quotes = paired_book_quotes(L.odds_outcomes(live)).withColumn("commence_time", F.col("commence_time").cast("timestamp"))
    spend = spark.createDataFrame([("3",), ("4",)], "credits_used string")
    row = T.capture_counts(quotes, F.lit(started).cast("timestamp"), spend).first()
    assert (row.priced_quotes, row.in_play, row.events, row.credits) == (2, n, 1, 7)


@pytest.mark.parametrize("lines", [False, True])
def test_broken_documents_go_to_quarantine(spark, tmp_path, lines):
    good = json.dumps({"venue_id": "1", "hourly": {"time": ["2025-04-11T23:00"], "temperature_2m": [20.5]}})
    torn, other, shape = good[:40], "not json", json.dumps({"venue_id": "2", "hourly": {"time": ["x"], "temperature_2m": ["warm"]}})
    texts = [good, torn, other, good.replace('"1"', '"3"'), shape, "  "]
    (tmp_path / "in").mkdir()
    if lines:
        (tmp_path / "in" / "all.jsonl").write_text("\n".join(texts) + "\n\n")
    else:
        for i, t in enumerate(texts):
            (tmp_path / "in" / f"{i}.json").write_text(t)
    for _ in range(2):
        rows = L.read_landed(spark, "hourly", f"{tmp_path}/in", f"{tmp_path}/bad", lines)
    assert rows.columns == ["venue_id", "hourly"] and sorted(r.venue_id for r in rows.collect()) == ["1", "3"]
    assert sorted((r.kind, r.broken) for r in spark.read.parquet(f"{tmp_path}/bad").collect()) == sorted(("hourly", t) for t in (torn, other, shape))
    assert L.hourly_rows(rows).count() == 2


def test_other_seasons_are_not_read(spark, tmp_path):
    from fungo.operators.dedup import finished
    spark.range(400).selectExpr("id as game_pk", "2000 + id % 20 as season", "if(id % 3 = 0, 'Final', 'Live') as status").write.partitionBy(
        "season").parquet(f"{tmp_path}/games")
    spark.createDataFrame([(2001,), (2001,), (2007,)], "season int").write.parquet(f"{tmp_path}/wanted")
    games, wanted = spark.read.parquet(f"{tmp_path}/games"), spark.read.parquet(f"{tmp_path}/wanted")
    got = finished(games, wanted)
    assert {r.game_pk for r in got.collect()} == {k for k in range(400) if k % 20 in (1, 7) and k % 3 == 0}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*season#\d+ IN \(2001,2007\)", plan)
    assert finished(games, wanted.limit(0)).count() == 0
    assert finished(games).count() == 134


def test_a_landed_document_is_parsed_once(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"game_pk": 1}\n{"game_pk": \n')
    rows = L.read_landed(spark, "boxscore", str(tmp_path / "d.json"), lines=True)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1 and [r["game_pk"] for r in rows.collect()] == [1]


def test_plays_are_dealt_by_their_number(spark, monkeypatch):
    from fungo import session
    monkeypatch.setattr(session, "TASK_ROWS", 4)
    wanted = session.parallel_parts(spark) + 5
    docs = spark.sql("""SELECT id AS game_pk, DATE'2025-04-11' AS official_date, transform(sequence(1, 3), i -> named_struct(
        'about', named_struct('inning', i, 'isTopInning', true), 'result', named_struct('homeScore', i, 'awayScore', 0),
        'count', named_struct('outs', 1), 'matchup', named_struct('pitcher', named_struct('id', 5L)))) AS allPlays FROM range(20)""")
    out = L.play_states(docs, wanted * 4)
    assert out.rdd.getNumPartitions() == wanted
    assert sorted((r["at"], r["home_score_before"]) for r in out.collect()) == sorted((i, i) for i in range(3) for _ in range(20))
