import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyboard.functions.scalars import family
from tallyboard.operators import cells as X
from tallyboard.operators import cube as Q
from tallyboard.operators import filters as C
from tallyboard.operators import joins as D
from tallyboard.operators import metrics as E
from tallyboard.sources import tables as A

GAME = ("provider string, game_id string, result string, rated boolean, variant string, marked_bot boolean, "
        "utc_date date, time_control string, base_seconds bigint, increment_seconds bigint, source_opening string, ply_count bigint")


def game(i, result="1-0", *, rated=True, variant="Standard", bot=False, opening="A: x", day=dt.date(2024, 1, 5), inc=0):
    return ("p", f"g{i}", result, rated, variant, bot, day, f"60+{inc}", 60, inc, opening, 30 + i)


def people(games, rating=1500):
    out = []
    for g in games:
        w = {"1-0": 1.0, "0-1": 0.0, "1/2-1/2": 0.5, "*": None}[g[2]]
        out.append(("p", g[1], "white", "ann", rating, rating + 50, w))
        out.append(("p", g[1], "black", None, rating + 50, rating, None if w is None else 1 - w))
    return out


PLAYER = "provider string, game_id string, color string, player_key string, rating bigint, opponent_rating bigint, score double"


@pytest.fixture(scope="module")
def facts(spark):
    games = [game(1), game(2, "0-1"), game(3, "1/2-1/2"), game(4, "*"), game(5, bot=True), game(6, opening=None),
             game(7, rated=False), game(8, variant="Other")]
    return spark.createDataFrame(games, GAME), spark.createDataFrame(people(games), PLAYER)


def test_eligibility(facts):
    got = {r.game_id: r.metric_eligible for r in C.game_eligibility(facts[0]).collect()}
    assert [got[f"g{i}"] for i in range(1, 9)] == [True, True, True, False, False, True, True, True]


def test_draw_rate(facts):
    got = E.draw_rate(facts[0]).first()
    assert (got.drawn, got.eligible, got.unknown_results, got.marked_bots) == (1, 4, 1, 1)
    assert got.draw_rate == 0.25


def test_zero_denominator_is_null(facts):
    got = E.draw_rate(facts[0].where("game_id = 'g4'")).first()
    assert got.eligible == 0 and got.draw_rate is None
    score = E.player_score(facts[1], facts[0], family_name="Nobody", color="white", rating_min=0,
                           rating_max_exclusive=4000, base_seconds=60, increment_seconds=0).first()
    assert (score.eligible_player_games, score.score_rate, score.low_support) == (0, None, True)


def test_flags(facts):
    got = {r.game_key: r for r in C.game_flags(facts[0]).collect()}
    assert got["p:g1"].known_opening_game == 1 and got["p:g6"].unknown_opening_game == 1
    assert got["p:g7"].eligible_game == 0 and got["p:g8"].eligible_game == 0
    flags = {r.player_game_key: r for r in C.player_flags(facts[1], facts[0]).collect()}
    assert (flags["p:g1:white"].eligible_win, flags["p:g1:black"].eligible_loss) == (1, 1)
    assert flags["p:g6:white"].score_eligible == 0 and flags["p:g6:white"].eligible_score == 0


def test_usage_share(facts):
    got = E.usage_share(facts[0], "A").first()
    assert (got.numerator, got.denominator, got.unknown_opening_games, got["value"]) == (5, 5, 1, 1.0)
    grouped = E.usage_share_grouped(facts[0], limit=500).collect()
    assert [(r.family, r.numerator, r.truncated) for r in grouped] == [("A", 5, False)]


@pytest.mark.parametrize(
    "bad",
    [{"color": "red"}, {"rating_min": 2000}, {"rating_max_exclusive": 4001}, {"base_seconds": -1}, {"rating_min": 1.5}],
)
def test_cohort_arguments(facts, bad):
    good = dict(color="white", rating_min=1000, rating_max_exclusive=2000, base_seconds=60, increment_seconds=0)
    with pytest.raises(ValueError):
        C.cohort_filter(facts[1], **{**good, **bad})


def test_metric_set(facts):
    m = E.MetricSet(C.game_flags(facts[0]), {"e": F.col("eligible_game"), "d": F.col("drawn_game")}, {"rate": ("d", "e")})
    got = m.query(["rate", "e"], group_by=["opening_family"]).collect()
    assert [(r.opening_family, r.rate, r.e) for r in got] == [("A", 1 / 3, 3), (None, 0.0, 1)]
    with pytest.raises(ValueError):
        m.query(["nope"])


def test_cascade_counts_each_row_once(facts):
    rules = [("bot", F.col("marked_bot")), ("unrated", ~F.col("rated")), ("none", F.lit(None).cast("boolean"))]
    got = {r.reason: r["rows"] for r in C.cascade_filter(facts[0], rules).collect()}
    assert got == {"bot": 1, "unrated": 1, "none": 0, "included": 6}


def test_clock_metrics(spark):
    games = spark.createDataFrame([game(1), game(2, inc=2), game(3, "*")], GAME)
    cols = ("provider string, game_id string, ply int, color string, clock_bucket string, phase_proxy string, "
            "centipawn_deterioration bigint, error_proxy boolean, eval_before_mate_white bigint, "
            "eval_after_mate_white bigint, clock_before_seconds double")
    moves = spark.createDataFrame(
        [("p", "g1", 3, "white", "under_10", "early_ply", 250, True, None, None, 5.0),
         ("p", "g1", 5, "white", "under_10", "early_ply", None, None, 3, None, 5.0),
         ("p", "g1", 7, "white", "under_10", "early_ply", 10, False, None, None, 5.0),
         ("p", "g1", 8, "black", None, "early_ply", 10, False, None, None, None),
         ("p", "g2", 3, "white", "under_10", "early_ply", 250, True, None, None, 5.0),
         ("p", "g3", 3, "white", "under_10", "early_ply", 250, True, None, None, 5.0)], cols)
    got = E.clock_pressure(moves, games, "under_10").first()
    assert (got.eligible_moves, got.evaluable_moves, got.proxy_errors, got.mate_transition_moves) == (3, 2, 1, 1)
    assert (got.evaluation_coverage, got.error_proxy_rate) == (2 / 3, 0.5)
    players = spark.createDataFrame([("p", "g1", "white", "a", 1300, 1, 1.0)], PLAYER)
    strata = E.clock_strata(moves, games, players)
    assert [(r.rating_band, r.eligible_moves) for r in strata.collect()] == [("1200_1599", 3)]
    rolled = E.rollup_strata(strata).first()
    assert (rolled.proxy_errors, rolled.error_proxy_rate, rolled.band_order) == (1, 0.5, 2)
    cells = X.clock_cells(moves, games, players, minimum=1).first()
    assert (cells.games, cells.moves, cells.evaluable_moves, cells.clock_band) == (1, 3, 2, "under_10")
    assert X.clock_cells(moves, games, players).count() == 0


def test_suppression_and_shares(spark):
    df = spark.createDataFrame([("a", 9), ("b", 10), ("c", 30)], "f string, games bigint")
    kept = C.rebase_shares(C.suppress_small(df, 10), [])
    assert {r.f: r["share"] for r in kept.collect()} == {"b": 0.25, "c": 0.75}


def test_pivot_colors_needs_both_rows(spark):
    df = spark.createDataFrame([("p", "a", "white", None, 1, 2, 1.0), ("p", "a", "black", None, 2, 1, 0.0),
                                ("p", "b", "white", None, 5, 6, 1.0), ("p", "c", "white", None, 5, 6, 1.0),
                                ("p", "c", "black", None, 6, 4, 0.0)], PLAYER)
    got = D.pivot_colors(df).orderBy("game_id").collect()
    assert [(r.game_id, r.white_rating, r.black_rating) for r in got] == [("a", 1, 2), ("c", 5, 6)]
    assert [r.game_id for r in D.rating_asymmetries(df).collect()] == ["c"]


def test_reconcile_scalar(spark):
    one = spark.createDataFrame([(1,)], "v bigint")
    none = spark.createDataFrame([(None,)], "v bigint")
    assert D.reconcile_scalar(one, one).first().differs is False
    assert D.reconcile_scalar(one, none).first().differs is True
    assert D.reconcile_scalar(none, none).first().differs is False


@pytest.fixture(scope="module")
def cube(spark, tmp_path_factory):
    games = [game(i, ["1-0", "0-1", "1/2-1/2"][i % 3], day=dt.date(2024, 1 + i % 3, 5)) for i in range(60)]
    g, p = spark.createDataFrame(games, GAME), spark.createDataFrame(people(games), PLAYER)
    tag = lambda df, n: df.withColumn("grain", F.lit(n)).withColumn("cohort", F.lit("warehouse"))
    path = str(tmp_path_factory.mktemp("cube") / "c")
    return A.write_cube([tag(X.game_cells(g), "game_cell"), tag(X.result_cells(p, g), "result_cell")], path), path


def test_cube_filters_and_fallbacks(cube):
    df, _ = cube
    year = Q.Filters(dt.date(2024, 1, 1), dt.date(2024, 12, 31), color="white", time_control="60+0")
    rows, missing = Q.adaptive_filter(df, "game_cell", year)
    assert rows.agg(F.sum("games")).first()[0] == 60 and missing == ["color"]
    dated, notes = Q.collect_with_fallback(df, "result_cell", year)
    assert notes == [] and dated.count() == 3
    late = Q.Filters(dt.date(2030, 1, 1), dt.date(2030, 12, 31))
    undated, notes = Q.collect_with_fallback(df, "result_cell", late, force_color="white")
    assert notes == ["white", "date"] and undated.count() == 3
    none, notes = Q.collect_with_fallback(df, "game_cell", Q.Filters(late.start, late.end, time_control="1+1"))
    assert notes == ["empty"] and none.isEmpty()


def test_kpis_are_weighted(cube):
    df, _ = cube
    got = {r.card: r for r in Q.kpis(df, Q.Filters(dt.date(2024, 1, 1), dt.date(2024, 12, 31))).collect()}
    assert got["games"]["value"] == 60 and abs(got["mean_ply"]["value"] - 59.5) < 1e-9
    assert abs(got["win_rate"]["value"] - 1 / 3) < 1e-9 and got["rating_difference"]["value"] == -50
    assert got["clock_error"]["value"] is None and got["positions"]["value"] == 0


def test_empty_cube_is_refused(cube, tmp_path):
    df, _ = cube
    with pytest.raises(ValueError):
        A.write_cube([df.where("games < 0")], str(tmp_path / "none"))


def test_replace_and_overwrite_grains(spark, cube, tmp_path):
    df, _ = cube
    new = df.where("grain = 'game_cell'").limit(1).withColumn("games", F.lit(7))
    both = A.replace_grains(df, new, ["game_cell"])
    assert {r.grain: r["count"] for r in both.groupBy("grain").count().collect()} == {"game_cell": 1, "result_cell": 6}
    path = str(tmp_path / "c")
    df.write.partitionBy("grain").parquet(path)
    A.overwrite_grains(new, path)
    again = A.read_cube(spark, path)
    assert again.where("grain = 'game_cell'").first().games == 7
    assert again.where("grain = 'result_cell'").count() == 6


def test_family_expression_matches_cells(cube):
    df, _ = cube
    assert [r[0] for r in Q.dimension_values(df, "opening_family").collect()] == ["A"]
    assert tuple(Q.date_bounds(df).first()) == (dt.date(2024, 1, 1), dt.date(2024, 3, 31))
    assert family("x") is not None


def test_band_may_match_a_published_sub_band(spark):
    day = dt.date(2024, 1, 1)
    df = A.align_cube(spark.createDataFrame([("g", day, day, "1400_1599", 5), ("g", day, day, "1600_1999", 7)],
                                            "grain string, period_start date, period_end date, rating_band string, games bigint"))
    rows, missing = Q.adaptive_filter(df, "g", Q.Filters(day, day, rating_band="1200_1599"))
    assert [r.games for r in rows.collect()] == [5] and missing == []


def test_clock_rows_widen_only_when_the_dates_are_not_covered(spark):
    day = dt.date(2024, 1, 10)
    df = A.align_cube(spark.createDataFrame([("clock_cell", day, day, "60+0", "white", 9)],
                                            "grain string, period_start date, period_end date, time_control string, color string, moves bigint"))
    read = lambda **f: Q.clock_rows_with_fallback(df, "clock_cell", Q.Filters(**f))
    year, late = dict(start=dt.date(2024, 1, 1), end=dt.date(2024, 12, 31)), dict(start=dt.date(2025, 1, 1), end=dt.date(2025, 2, 1))
    rows, widened, names = read(**year)
    assert rows.count() == 1 and not widened
    rows, widened, names = read(**late, time_control="60+0", color="black")
    assert rows.count() == 1 and widened
    rows, widened, names = read(**late, time_control="1+1")
    assert rows.count() == 0 and not widened and names == ["time_control"]
    rows, widened, names = read(**year, time_control="60+0", color="black")
    assert rows.count() == 0 and not widened and names == ["time_control"]


def test_rate_deltas_subtract_what_is_shown(spark):
    def cell(period, end, games, wins, ply):
        return ("r", "w", period, dt.date.fromisoformat(period + "-01"), dt.date.fromisoformat(end), games, wins, games - wins, 0, ply, 0.0)

    df = A.align_cube(spark.createDataFrame(
        [cell("2024-07", "2024-07-31", 300, 100, 40.04), cell("2024-08", "2024-08-31", 300, 110, 40.16)],
        "grain string, cohort string, period string, period_start date, period_end date, games bigint, wins bigint, "
        "losses bigint, draws bigint, mean_ply double, rating_diff double"))
    every = Q.Filters(dt.date(2024, 1, 1), dt.date(2024, 12, 31))
    got = {r.figure: r.shown_delta for r in Q.rate_deltas(df, "r", every, ["2024-08"]).collect()}
    # 36.7 - 33.3 and 40.2 - 40.0, not the differences of the unrounded figures.
    assert abs(got["wins_percent"] - 3.4) < 1e-12 and abs(got["mean_ply"] - 0.2) < 1e-12
    none = {r.figure: r.shown_delta for r in Q.rate_deltas(df, "r", every, ["2024-07"]).collect()}
    assert set(none.values()) == {None}
