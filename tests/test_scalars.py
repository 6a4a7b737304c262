import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from tallyboard.functions import scalars as S


def one(spark, value, kind, fn):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(fn("x").alias("y")).first()[0]


@pytest.mark.parametrize(
    ("text", "family"),
    [
        (None, None),
        ("", None),
        ("   ", None),
        (": Foo", None),
        ("  : Foo", None),
        ("  Sicilian Defense  : Najdorf", "Sicilian Defense"),
        ("  King's Pawn Game  ", "King's Pawn Game"),
        ("None: Example", "None"),
    ],
)
def test_family(spark, text, family):
    assert one(spark, text, "string", S.family) == family


@pytest.mark.parametrize(
    ("value", "label"),
    [(None, None), (-0.1, None), (0.0, "under_10"), (9.99, "under_10"), (10.0, "10_to_29"),
     (29.9, "10_to_29"), (30.0, "30_to_59"), (60.0, "60_plus")],
)
def test_clock_band_edges(spark, value, label):
    assert one(spark, value, "double", S.clock_band) == label


def test_unrated_player_has_no_band(spark):
    assert one(spark, None, "int", S.rating_band) is None
    assert [one(spark, r, "int", S.rating_band) for r in (1199, 1200, 1999, 2000)] == [
        "under_1200", "1200_1599", "1600_1999", "2000_plus"]
    assert [one(spark, d, "int", S.difference_band) for d in (-101, -100, 99, 100)] == [
        "below_-100", "-100_to_99", "-100_to_99", "100_plus"]


def test_band_rejects_bad_edges():
    with pytest.raises(ValueError):
        S.band("x", (2, 1), ("a", "b", "c"))


def test_surrogate_key_is_null_with_any_null_part(spark, rows):
    df = spark.createDataFrame([("p", "a", "white"), ("p", None, "white")], "a string, b string, c string")
    assert rows(df.select(S.surrogate_key("a", "b", "c"))) == [("p:a:white",), (None,)]


@pytest.mark.parametrize(
    ("text", "pair"),
    [("60+0", (60, 0)), ("180+2", (180, 2)), ("-", (None, None)), (None, (None, None)),
     ("60+0x", (None, None)), ("+5", (None, None)), ("60", (None, None))],
)
def test_time_control(spark, text, pair):
    df = spark.createDataFrame([(text,)], "x string")
    assert tuple(df.select(*S.time_control("x")).first()) == pair


def test_parse_utc(spark):
    cases = [
        ("2013.01.02", "03:04:05", dt.date(2013, 1, 2), "second", False),
        ("2013.01.02", "??:??:??", dt.date(2013, 1, 2), "date", False),
        ("2013.01.02", None, dt.date(2013, 1, 2), "date", False),
        ("????.??.??", "03:04:05", None, "unknown", False),
        (None, None, None, "unknown", False),
        ("2013.02.30", None, None, "unknown", True),
        ("2013.01.02", "25:00:00", dt.date(2013, 1, 2), "date", True),
        ("junk", None, None, "unknown", True),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "d string, t string")
    p = S.parse_utc("d", "t")
    got = df.select(p["utc_date"], p["timestamp_precision"], p["invalid_utc"]).collect()
    assert [tuple(r) for r in got] == [c[2:] for c in cases]


def test_scores(spark, rows):
    df = spark.createDataFrame(
        [(r, c) for r in ("1-0", "0-1", "1/2-1/2", "*") for c in ("white", "black")], "r string, c string")
    assert [r[0] for r in rows(df.select(S.score_from_result("r", "c")))] == [
        1.0, 0.0, 0.0, 1.0, 0.5, 0.5, None, None]


def test_speed_class(spark, rows):
    df = spark.createDataFrame([(180, 0), (180, None), (60, 3), (60, 2), (480, 0), (None, 2)], "b int, i int")
    assert [r[0] for r in rows(df.select(S.in_speed_class("b", "i")))] == [
        True, True, True, False, False, False]


def test_hash_sample_and_position_id(spark):
    ids = [f"game{i:04d}" for i in range(500)]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    kept = {r[0] for r in df.where(S.hash_sample("id", 20)).collect()}
    want = {i for i in ids if int.from_bytes(hashlib.sha256(i.encode()).digest()[:8], "big") % 20 == 0}
    assert kept == want and want
    key = "8/8/8/8 w - -"
    assert one(spark, key, "string", S.position_id) == hashlib.sha256(key.encode()).hexdigest()[:24]


def test_deterioration_and_clamp(spark, rows):
    df = spark.createDataFrame(
        [(100, -150, "white"), (100, -150, "black"), (None, 5, "white"), (5, None, "black"), (-900, 900, "black")],
        "b bigint, a bigint, c string")
    loss = S.deterioration("b", "a", "c")
    got = rows(df.select(loss, S.error_flag(loss), S.clamp(loss, "b", "a")))
    assert got == [(250, True, 250), (0, False, 0), (None, None, None), (None, None, None), (1800, True, 1000)]


def test_route_contains(spark, rows):
    df = spark.createDataFrame([("d2d4 g8f6 g2g3",), ("d2d4",), ("g2g3 d2d4 x",), ("d2d4 g2g34",)], "r string")
    assert [r[0] for r in rows(df.select(S.route_contains_all("r", "d2d4", ["d2d4", "g2g3"])))] == [
        True, False, False, False]


def test_player_key(spark, rows):
    df = spark.createDataFrame([("Ann",), ("?",), ("Anonymous",), (None,)], "n string")
    assert [r[0] for r in rows(df.select(S.player_key("n")))] == ["ann", None, None, None]


def test_provider_identity(spark, rows):
    cases = [
        ("https://lichess.org/abcdefgh", None, "lichess", "abcdefgh", None),
        ("https://lichess.org/abcdefghWXYZ/black", None, "lichess", "abcdefgh", None),
        ("https://www.chess.com/game/live/123", None, "chesscom", "live:123", None),
        ("Chess.com", "https://www.chess.com/game/daily/9", "chesscom", "daily:9", None),
        ("Paris", None, "pgn", None, None),
        ("https://lichess.org/abcdefgh", "https://chess.com/game/live/1", "lichess", "abcdefgh",
         "conflicting_provider_headers"),
        ("https://lichess.org/abcdefgh", "https://lichess.org/zzzzzzzz", "lichess", "abcdefgh",
         "conflicting_game_id_headers"),
        ("https://notlichess.org/abcdefgh", None, "pgn", None, None),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "s string, l string")
    p = S.provider_identity("s", "l")
    assert rows(df.select(p["provider"], p["native_id"], p["reason"])) == [c[2:] for c in cases]


def test_rated_flag_and_import_date(spark, rows):
    df = spark.createDataFrame(
        [("True", "Casual", "2020.02.29", ""), ("", "RATED Blitz", "", "2020.02.30"), ("", "Unrated x", None, "2021.01.05"),
         ("", "Ratedness", None, "2021-01-05"), (None, None, None, None)],
        "r string, e string, u string, d string")
    got = rows(df.select(S.rated_flag("r", "e"), S.import_date("u", "d")))
    assert got == [(True, dt.date(2020, 2, 29)), (True, None), (False, dt.date(2021, 1, 5)), (None, None), (None, None)]


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("Does the Sicilian cause wins?", "unsupported"),
        ("How many games have missing ratings?", "coverage"),
        ("How did they do?", "clarify"),
        ("What is the first observed date?", "coverage"),
        ("Compare the French Defense and the Caro-Kann", "opening_compare"),
        ("Compare under 10 seconds with 60 seconds", "clock_compare"),
        ("Error proxy under 10 seconds", "clock_bucket"),
        ("Score of the Sicilian for white", "opening_score"),
        ("What share of games is the Sicilian?", "opening_usage"),
        ("Hello", "clarify"),
    ],
)
def test_rule_label(spark, text, label):
    assert one(spark, text, "string", S.rule_label) == label


def test_failure_mode_order(spark, rows):
    cases = [
        (True, True, False, False, "answered", "answered", None),
        (False, True, True, False, "unsupported", "answered", "unsafe"),
        (False, False, True, True, "answered", "unsupported", "over_abstention"),
        (False, False, False, False, "answered", None, "plan_hallucination"),
        (False, False, False, False, "unsupported", "needs_clarification", "boundary_swap"),
        (False, False, False, False, "answered", "answered", "wrong_answer"),
        (False, False, False, False, "unsupported", "unsupported", "other"),
    ]
    df = spark.createDataFrame(
        [c[:6] for c in cases], "p boolean, u boolean, o boolean, h boolean, e string, m string")
    assert [r[0] for r in rows(df.select(S.failure_mode("p", "u", "o", "h", "e", "m")))] == [c[6] for c in cases]


def test_fingerprint_tells_null_from_text(spark):
    df = spark.createDataFrame([(None,), ("null",), ("",)], "a string")
    assert df.select(S.fingerprint("a")).distinct().count() == 3


def test_month_period(spark):
    df = spark.createDataFrame([(dt.date(2024, 2, 11),)], "d date")
    assert tuple(df.select(*S.month_period("d")).first()) == ("2024-02", dt.date(2024, 2, 1), dt.date(2024, 2, 29))
    assert df.select(F.col("d")).first()[0] == dt.date(2024, 2, 11)
