"""Declared table schemas. They are applied explicitly; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
}


def _schema(text: str) -> T.StructType:
    pairs = (column.split() for column in text.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


FACT_GAME = _schema(
    "provider string, game_id string, source_ordinal bigint, result string, rated boolean, "
    "variant string, utc_date date, played_at timestamp, timestamp_precision string, "
    "time_control string, base_seconds bigint, increment_seconds bigint, source_opening string, "
    "source_eco string, termination string, marked_bot boolean, ply_count bigint, "
    "headers_json string, record_fingerprint string"
)
FACT_PLAYER_GAME = _schema(
    "provider string, game_id string, color string, player_key string, rating bigint, "
    "opponent_rating bigint, score double"
)
FACT_MOVE = _schema(
    "provider string, game_id string, ply bigint, color string, uci string, "
    "clock_after_seconds double, clock_before_seconds double, clock_bucket string, "
    "eval_before_cp_white bigint, eval_after_cp_white bigint, eval_before_mate_white bigint, "
    "eval_after_mate_white bigint, centipawn_deterioration bigint, error_proxy boolean, "
    "phase_proxy string"
)
CUBE = _schema(
    "grain string, cohort string, period string, period_start date, period_end date, "
    "time_control string, color string, rating_band string, opening_family string, "
    "opening_line string, fen string, eco string, ply bigint, clock_band string, phase string, "
    "games bigint, wins bigint, draws bigint, losses bigint, moves bigint, "
    "evaluable_moves bigint, proxy_errors bigint, error_proxy_rate double, share double, "
    "rating_diff double, mean_ply double, result string, white_rating bigint, "
    "black_rating bigint, game_key string, continuation string"
)
# Column-name parts and text that would publish an identifier.
FORBIDDEN_PARTS = (
    "player_key",
    "game_id",
    "headers_json",
    "fingerprint",
    "username",
    "absolute_path",
    "source_file",
)
LEAK_PATTERN = r"player_key|username|headers_json|\.pgn\b|/[A-Za-z0-9._/-]+\.json"
