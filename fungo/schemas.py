"""One schema per table, and which tables are keyed logs."""

from __future__ import annotations

# Columns and types of every table, in write order.
DDL = {
    "games": "game_pk bigint, official_date date, game_date_utc timestamp, season int, game_type string, double_header string, game_number int, series_game_number int, day_night string, scheduled_innings int, status string, home_team_id bigint, home_team_name string, away_team_id bigint, away_team_name string, home_score int, away_score int, home_win int, total_runs int, run_diff int, home_sp_id bigint, home_sp_name string, away_sp_id bigint, away_sp_name string, venue_id bigint, venue_name string, reported_condition string, reported_temp_f string, reported_wind string, innings_played int, home_batted_ninth int",
    "pitching": "game_pk bigint, official_date date, team_id bigint, player_id bigint, is_starter int, outs int, batters_faced int, hits int, runs int, earned_runs int, home_runs int, walks int, hit_batsmen int, strike_outs int, pitches int, strikes int",
    "umpires": "game_pk bigint, official_date date, hp_umpire_id bigint, hp_umpire_name string",
    "parks": "venue_id string, name string, latitude double, longitude double, elevation_m double, azimuth_angle double, roof_type string, turf_type string, capacity int, left_line int, center int, right_line int",
    "weather": "game_pk bigint, weather_source string, weather_hour_utc timestamp, temp_c double, humidity_pct double, pressure_hpa double, wind_speed_ms double, wind_direction_deg double, precip_mm double, wind_out_to_center_ms double, wind_left_to_right_ms double, roof_category string",
    "quotes": "snapshot_id string, fetched_at timestamp, event_id string, commence_time timestamp, date date, home_team string, away_team string, market string, point double, book_key string, book_title string, region string, priced int, book_updated_at string, price_home double, price_away double, devig_prob_home double",
    "lines": "date date, commence_time timestamp, event_id string, home_team string, away_team string, market string, point double, consensus_prob_home double, market_books bigint, market_spread double, consensus_price_home double, consensus_price_away double, best_price_home double, best_book_home string, best_price_away double, best_book_away string, leader_prob_home double, leader_books bigint, follower_prob_home double, follower_books bigint, odds_source string, fetched_at timestamp",
    "card": "game_pk bigint, official_date date, commence_time timestamp, home_team string, away_team string, market string, point double, model_prob_home double, market_prob_home double, disagreement double, market_books bigint, market_spread double, consensus_price_home double, consensus_price_away double, best_price_home double, best_book_home string, best_price_away double, best_book_away string, expected_home_runs double, expected_away_runs double, lead_minutes int, odds_fetched_at timestamp, model_version string, model_kind string, priced_at timestamp",
    "ledger": "wager_id string, placed_at timestamp, game_pk bigint, official_date date, commence_time timestamp, home_team string, away_team string, market string, point double, side string, model_prob double, market_prob double, disagreement double, price double, book string, stake double, market_books bigint, market_spread double, lead_minutes int, wide_market int, model_version string, model_kind string, staking_policy_version string, settled_at timestamp, outcome string, profit double",
    "rejections": "screened_at timestamp, game_pk bigint, market string, point double, side string, disagreement double, gate string, detail string",
    "plays": "game_pk bigint, official_date date, inning int, is_top int, outs_before int, home_score_before int, away_score_before int, pitcher_id bigint",
    "bullpen_leverage": "game_pk bigint, official_date date, pitcher_id bigint, batters bigint, leverage_sum double, high_leverage_batters bigint",
    "credit_log": "fetched_at timestamp, region string, credits_used int, credits_remaining int",
    "manifest": "requested_date date, snapshot_timestamp timestamp, previous_timestamp timestamp, events bigint, quotes bigint, credits_used int, credits_remaining int, fetched_at timestamp",
}

# Keys of the append-only logs. A table without a key is a
# snapshot, of which the later one replaces the earlier.
LOG_KEYS = {
    "credit_log": ("fetched_at", "region"),
    "ledger": ("wager_id",),
    "rejections": ("screened_at", "game_pk", "market", "point", "side", "gate"),
    "quotes": ("snapshot_id",),
    "manifest": ("requested_date",),
}

# Landed documents.
_ID = "struct<id: bigint>"
_NAMED = "struct<id: bigint, name: string>"
_PERSON = "struct<id: bigint, fullName: string>"
_SIDE = f"struct<score: int, team: {_NAMED}, probablePitcher: {_PERSON}>"
LANDED = {
    "schedule": f"""dates array<struct<games: array<struct<
        gamePk: bigint, officialDate: string, gameDate: string, season: string, gameType: string,
        doubleHeader: string, gameNumber: int, seriesGameNumber: int, dayNight: string,
        scheduledInnings: int, status: struct<abstractGameState: string>,
        teams: struct<home: {_SIDE}, away: {_SIDE}>,
        linescore: struct<innings: array<struct<home: struct<runs: int>>>>,
        weather: struct<condition: string, temp: string, wind: string>, venue: {_NAMED}>>>>""",
    "boxscore": f"""game_pk bigint, official_date date,
        teams struct<home: struct<team: {_ID}, pitchers: array<bigint>, players: map<string, struct<stats: struct<pitching: struct<outs: int, battersFaced: int, hits: int, runs: int, earnedRuns: int, homeRuns: int, baseOnBalls: int, hitByPitch: int, strikeOuts: int, numberOfPitches: int, strikes: int>>>>>,
                     away: struct<team: {_ID}, pitchers: array<bigint>, players: map<string, struct<stats: struct<pitching: struct<outs: int, battersFaced: int, hits: int, runs: int, earnedRuns: int, homeRuns: int, baseOnBalls: int, hitByPitch: int, strikeOuts: int, numberOfPitches: int, strikes: int>>>>>>,
        officials array<struct<officialType: string, official: {_PERSON}>>""",
    "playbyplay": f"""game_pk bigint, official_date date, allPlays array<struct<
        about: struct<inning: int, isTopInning: boolean>, result: struct<homeScore: int, awayScore: int>,
        count: struct<outs: int>, matchup: struct<pitcher: {_ID}>>>""",
    "venues": """season int, venues array<struct<id: bigint, name: string,
        location: struct<defaultCoordinates: struct<latitude: double, longitude: double>, elevation: double, azimuthAngle: double>,
        fieldInfo: struct<roofType: string, turfType: string, capacity: int, leftLine: int, center: int, rightLine: int>>>""",
    "hourly": """venue_id string, hourly struct<time: array<string>, temperature_2m: array<double>,
        relative_humidity_2m: array<double>, surface_pressure: array<double>, wind_speed_10m: array<double>,
        wind_direction_10m: array<double>, precipitation: array<double>>""",
    "odds": """id string, commence_time string, home_team string, away_team string, region string, fetched_at string,
        bookmakers array<struct<key: string, title: string, last_update: string, markets: array<struct<
        key: string, outcomes: array<struct<name: string, price: double, point: double>>>>>>""",
    "odds_history": """requested_date date, timestamp string, previous_timestamp string, region string,
        credits_used int, credits_remaining int, fetched_at string,
        data array<struct<id: string, commence_time: string, home_team: string, away_team: string,
        bookmakers: array<struct<key: string, title: string, last_update: string, markets: array<struct<
        key: string, outcomes: array<struct<name: string, price: double, point: double>>>>>>>>""",
}
