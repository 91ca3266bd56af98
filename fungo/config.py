"""Policy thresholds and fixed values shared by every job."""

# Markets, gates and staking policy.
MARKETS = ("h2h", "spreads", "totals")
PRICED_REGIONS = ("us",)
LEADER_BOOKS = ("pinnacle", "betonlineag", "lowvig", "circasports")
MODEL_VERSION = "runs-v1"
CONSENSUS_VERSION = "paired-book-devig-v1"
STAKING_POLICY = "paper-flat-1u-daycap3-v1"
MIN_BOOKS = 3
MAX_QUOTE_AGE_MINUTES = 180
WIDE_MARKET = 0.04
MAX_EXECUTION_GAP = 0.08
EDGE_RULE = 0.03
STAKE = 1.0
DAY_CAP = 3.0
MIN_LOCK_MINUTES = 20
MAX_LOCK_MINUTES = 240
MIN_ENTRY_HOURS = 20
MAX_START_DRIFT_HOURS = 12
USUAL_LINES = (("h2h", None), ("spreads", -1.5), ("totals", 8.5))

# Spellings of club names that denote the same franchise.
TEAM_ALIASES = {
    "oakland athletics": "athletics",
    "sacramento athletics": "athletics",
    "las vegas athletics": "athletics",
    "cleveland indians": "cleveland guardians",
}

# Priors of the point-in-time state.
PRIOR_RUNS = 4.5
PRIOR_TEAM_GAMES = 40.0
PRIOR_STARTS = 10.0
PRIOR_BATTERS = 200.0
PRIOR_RELIEF_OUTS = 300.0
PRIOR_UMPIRE_GAMES = 60.0
FORM_GAMES = 25
STARTER_FORM = 10
WORKLOAD_DAYS = 3
DEFAULT_DEPTH = 16.0
LEAGUE_BATTERS_FLOOR = 5000
LEAGUE_RATES = {"k": 0.225, "bb": 0.090, "hr": 0.033}
LEAGUE_KS_PER_GAME = 16.0
LEAGUE_KS_FLOOR = 200
LEAGUE_RELIEF = 4.2
LEAGUE_RELIEF_FLOOR = 3000
PARK_FLOOR_GAMES = 30
PARK_REGRESSION_GAMES = 120.0

# Rating recurrence.
ELO_START = 1500.0
ELO_K = 4.0
ELO_HOME_EDGE = 24.0
ELO_CARRY = 0.70

# Disagreement bands and searched cuts, in points.
BANDS = ((0, 3), (3, 5), (5, 8), (8, 10), (10, 12), (12, 13), (13, 14),
         (14, 15), (15, 17), (17, 100))
SEARCH_CUTS = tuple(range(8, 21))

# Run distribution.
MAX_RUNS = 30
WALK_OFF_MARGINS = (0.872, 0.075, 0.037, 0.016)
EXTRA_INNING_MARGINS = (0.688, 0.159, 0.086, 0.067)
EXTRA_INNING_HOME_EDGE = 0.52
INNING_SHAPE = (0.747, 2.25)
SCORELESS_RANGE = (0.60, 0.85, 0.0025)
TAIL_RANGE = (0.5, 12.0, 0.125)
DEFAULT_DISPERSION = 4.0

# Leverage table.
HIGH_LEVERAGE = 1.5
MAX_SCORE_DIFF = 8
LATE_INNING = 10
MIN_STATE_ROWS = 30

# Weather service window.
ARCHIVE_LAG_DAYS = 2
FORECAST_HORIZON_DAYS = 14

# Model inputs, in design order.
FEATURE_COLUMNS = (
    "home_elo", "away_elo", "elo_diff",
    "home_off", "home_def", "away_off", "away_def",
    "home_recent_off", "home_recent_def", "away_recent_off", "away_recent_def",
    "home_rest", "away_rest", "rest_diff",
    "home_games_played", "away_games_played",
    "home_sp_rate", "away_sp_rate", "home_sp_recent", "away_sp_recent",
    "home_sp_starts", "away_sp_starts", "home_sp_rest", "away_sp_rest",
    "home_sp_k_rate", "away_sp_k_rate", "home_sp_bb_rate", "away_sp_bb_rate",
    "home_sp_hr_rate", "away_sp_hr_rate", "home_sp_depth", "away_sp_depth",
    "home_bp_rate", "away_bp_rate", "home_bp_workload", "away_bp_workload",
    "park_factor", "elevation_km",
    "temp_c", "air_density_index", "wind_out_to_center_ms",
    "wind_left_to_right_ms", "precip_mm", "roof_retractable", "roof_dome",
    "expected_home_runs_prior", "expected_away_runs_prior",
)
SIGNED_FEATURES = ("elo_diff", "rest_diff", "wind_left_to_right_ms")
