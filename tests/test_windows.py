import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tallyboard.operators import windows as W


def test_number_rows_splits_hot_keys_exactly(spark):
    rng = random.Random(3)
    data = [(1 if rng.random() < 0.4 else rng.randrange(2, 40), rng.randrange(100), i) for i in range(3000)]
    df = spark.createDataFrame(data, "k int, o int, i int").repartition(7)
    got = W.number_rows(df, ["k"], ["o", "i"], F.floor(F.col("o") / 9), "n", hot_rows=100)
    assert got.columns == ["k", "o", "i", "n"]
    want = {}
    for k in {d[0] for d in data}:
        for n, d in enumerate(sorted((x for x in data if x[0] == k), key=lambda x: x[1:]), 1):
            want[d] = n
    assert {(r.k, r.o, r.i): r.n for r in got.collect()} == want


def test_hash_rank_is_the_digest_order(spark):
    ids = [f"id{i}" for i in range(5000)]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    got = {r.id: r["rank"] for r in W.hash_rank(df, "id").collect()}
    order = sorted(ids, key=lambda i: (hashlib.sha256(i.encode()).hexdigest(), i))
    assert got == {x: n for n, x in enumerate(order, 1)}


def test_lag_across_blocks_equals_plain_lag(spark):
    data = [(g, p, g * 1000 + p) for g, n in ((1, 50), (2, 3), (3, 8), (4, 1)) for p in range(1, n + 1)]
    df = spark.createDataFrame(data, "g int, ply int, v int").repartition(5)
    got = W.lag_values(df, ["g"], "ply", {"a": (F.col("v"), 1), "b": (F.col("v"), 2)}, block=4)
    for r in got.collect():
        assert r.a == (r.v - 1 if r.ply > 1 else None)
        assert r.b == (r.v - 2 if r.ply > 2 else None)
    assert got.count() == len(data)


@pytest.mark.parametrize("block", [1, 2, 3, 7, 4096])
def test_lag_goes_by_rows_whatever_the_block(spark, block):
    rng = random.Random(4)
    plies = {g: sorted(rng.sample(range(1, 40), n)) for g, n in ((1, 20), (2, 1), (3, 7))}
    data = [(g, p, "wb"[p % 2], g * 1000 + p) for g, ps in plies.items() for p in ps]
    df = spark.createDataFrame(data, "g int, ply int, color string, v int").repartition(5)
    got = W.lag_values(df, ["g"], "ply", {"a": (F.col("v"), 1), "b": (F.col("v"), 2)}, block=block).collect()
    assert len(got) == len(data)
    for r in got:
        earlier = [r.g * 1000 + p for p in plies[r.g] if p < r.ply]
        assert (r.a, r.b) == (earlier[-1] if earlier else None, earlier[-2] if len(earlier) > 1 else None)


def test_own_clock_where_a_ply_is_missing(spark):
    data = [(1, 1, "white", 60), (1, 2, "black", 50), (1, 4, "black", 40), (1, 5, "white", 30)]
    df = spark.createDataFrame(data, "g int, ply int, color string, clock int")
    got = {r.ply: r.clock_before for r in W.same_side_lag(df, ["g"], "clock").collect()}
    assert got == {1: None, 2: None, 4: 50, 5: 60}


@pytest.mark.parametrize("block", [1, 2, 5, 4096])
def test_own_values_are_carried_over_gaps(spark, block):
    rng = random.Random(9)
    plies = {g: sorted(rng.sample(range(1, 60), n)) for g, n in ((1, 30), (2, 1), (3, 9), (4, 4))}
    data = [(g, p, rng.choice(["white", "black", "white", None]), rng.choice([None, p])) for g, ps in plies.items() for p in ps]
    df = spark.createDataFrame(data, "g int, ply int, color string, v int").repartition(5)
    got = W.lag_values(df, ["g"], "ply", {"a": (F.col("v"), 1)}, block, {"b": F.col("v"), "c": F.col("v") * 2}).collect()
    assert len(got) == len(data)
    for r in got:
        earlier = [d for d in sorted(data) if d[0] == r.g and d[1] < r.ply]
        own = [d[3] for d in earlier if d[2] == r.color]
        assert r.a == (earlier[-1][3] if earlier else None)
        assert r.b == (own[-1] if own else None) and r.c == (None if r.b is None else 2 * r.b)


def test_move_facts_sort_once_and_run_nothing_ahead(spark, tmp_path):
    games = spark.createDataFrame([("p", "g", 60, 0)], "provider string, game_id string, base_seconds bigint, increment_seconds bigint")
    rows = [("p", "g", i, "white" if i % 2 else "black", 50.0 - i, 10, None) for i in range(1, 9)]
    path = str(tmp_path / "moves")
    spark.createDataFrame(rows, "provider string, game_id string, ply int, color string, clock_after_seconds double, "
                          "eval_after_cp_white bigint, eval_after_mate_white bigint").write.parquet(path)
    moves = spark.read.parquet(path)
    games.write.parquet(str(tmp_path / "games"))
    games = spark.read.parquet(str(tmp_path / "games"))
    seen = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("facts", "plan only")
    facts = W.move_facts(moves, games)
    assert list(seen.getJobIdsForGroup("facts")) == []
    spark.sparkContext.setJobGroup("rest", "")
    facts.collect()
    final = facts._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("- Sort [") <= 1 and final.count("Window [") == 1 and final.count("Exchange hashpartitioning") <= 2


def test_visits_are_dealt_once(spark):
    df = spark.createDataFrame([(1, 1, "a", "p")], "g int, ply int, uci string, position_key string")
    plan = W.visit_sequence(df, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_periods_that_are_no_months(spark):
    rows = [("2024-01", 5), ("2024-02", 7), ("all", 12), ("2023-12", 0)]
    data = [(p, "c", dt.date(2024, 1, 1), dt.date(2024, 1, 31), n) for p, n in rows]
    df = spark.createDataFrame(data, "period string, cohort string, period_start date, period_end date, games bigint")
    got = W.prior_equal_period(df, ["all"], [], ["games"]).first()
    assert (got.games, got.prior_games) == (12, None)
    assert W.prior_equal_period(df, ["2024-02"], [], ["games"]).first().prior_games == 5
    # A prior block without games is no base for a difference.
    assert W.prior_equal_period(df, ["2024-01"], [], ["games"]).first().prior_games is None


def test_move_facts(spark, rows):
    games = spark.createDataFrame([("p", "g", 60, 0)], "provider string, game_id string, base_seconds bigint, increment_seconds bigint")
    moves = spark.createDataFrame(
        [("p", "g", 1, "white", 70.0, 10, None), ("p", "g", 2, "black", 50.0, -300, None),
         ("p", "g", 3, "white", 20.0, -600, None), ("p", "g", 4, "black", -1.0, None, 3),
         ("p", "g", 5, "white", 8.0, 5, None), ("p", "g", 6, "black", 7.0, 400, None)],
        "provider string, game_id string, ply int, color string, clock_after_seconds double, "
        "eval_after_cp_white bigint, eval_after_mate_white bigint")
    got = W.move_facts(moves, games).orderBy("ply").collect()
    # 70 s is above the base, -1 s is negative: both unknown, also for the mover's next clock.
    assert [r.clock_after_seconds for r in got] == [None, 50.0, 20.0, None, 8.0, 7.0]
    assert [r.clock_before_seconds for r in got] == [None, None, None, 50.0, 20.0, None]
    assert [r.clock_bucket for r in got] == [None, None, None, "30_to_59", "10_to_29", None]
    # A mate score before or after leaves the move without a loss.
    assert [r.centipawn_deterioration for r in got] == [None, 0, 300, None, None, 395]
    assert [r.error_proxy for r in got] == [None, False, True, None, None, True]
    assert [r.eval_before_mate_white for r in got] == [None, None, None, None, 3, None]


def test_visit_sequence_and_earliest(spark):
    keys = ["A", "B", "A", "C", "B", "D"]
    data = [("p", "g", i + 1, m, k) for i, (m, k) in enumerate(zip("abcdef", keys, strict=True))]
    df = spark.createDataFrame(data, "provider string, game_id string, ply int, uci string, position_key string")
    got = W.visit_sequence(df, ["provider", "game_id"], max_ply=5).orderBy("ply").collect()
    assert [r.route for r in got] == ["a", "a b", "a b c", "a b c d", "a b c d e"]
    assert [r.route_has_repeat for r in got] == [False, False, True, True, True]
    # The row after the window still supplies the last next move.
    assert [r.next_move for r in got] == ["b", "c", "d", "e", "f"]
    late = W.visit_sequence(df, ["provider", "game_id"], min_ply=4, max_ply=20).orderBy("ply").collect()
    assert [(r.ply, r.route, r.route_has_repeat, r.next_move) for r in late] == [
        (4, "a b c d", True, "e"), (5, "a b c d e", True, "f"), (6, "a b c d e f", True, "")]
    first = W.earliest_visit(df.withColumn("position_id", F.col("position_key")))
    assert sorted((r.position_key, r.ply) for r in first.collect()) == [("A", 1), ("B", 2), ("C", 4), ("D", 6)]


def test_sequence_check(spark):
    def game(g, plies, colors=None):
        colors = colors or ["white" if p % 2 else "black" for p in plies]
        return [("p", g, p, c) for p, c in zip(plies, colors, strict=True)]

    data = (game("ok", [1, 2, 3]) + game("gap", [1, 3]) + game("dup", [1, 2, 2, 4]) + game("late", [2, 3])
            + game("color", [1, 2], ["white", "white"]))
    df = spark.createDataFrame(data, "provider string, game_id string, ply int, color string")
    got = {r.game_id: r.valid for r in W.sequence_check(df, ["provider", "game_id"]).collect()}
    assert got == {"ok": True, "gap": False, "dup": False, "late": False, "color": False}


def cells(spark, data):
    out = []
    for period, games, end in data:
        start = dt.date.fromisoformat(period + "-01")
        out.append((period, start, dt.date.fromisoformat(end), "warehouse", games))
    return spark.createDataFrame(out, "period string, period_start date, period_end date, cohort string, games bigint")


@pytest.mark.parametrize(
    ("selected", "prior"),
    [
        (["2024-08"], 7),  # July has 31 days too
        (["2024-07"], None),  # June has 30: a different span
        (["2024-08", "2024-10"], None),  # a gap in the selection
        (["2024-05"], None),  # nothing before it
    ],
)
def test_prior_equal_period(spark, selected, prior):
    df = cells(spark, [("2024-05", 5, "2024-05-31"), ("2024-06", 6, "2024-06-30"), ("2024-07", 7, "2024-07-31"),
                       ("2024-08", 8, "2024-08-31"), ("2024-10", 10, "2024-10-31")])
    got = W.prior_equal_period(df, selected, [], ["games"]).first()
    assert got["prior_games"] == prior
    assert got["games_delta"] == (None if prior is None else got["games"] - prior)


def test_prior_period_needs_one_cohort(spark):
    df = cells(spark, [("2024-07", 7, "2024-07-31"), ("2024-08", 8, "2024-08-31")])
    mixed = df.withColumn("cohort", F.when(F.col("period") == "2024-07", "other").otherwise(F.col("cohort")))
    assert W.prior_equal_period(mixed, ["2024-08"], [], ["games"]).first()["prior_games"] is None


def test_cap_per_cell(spark):
    ids = [f"g{i}" for i in range(30)]
    data = [("c", f"fam{i % 5}" if i % 5 else None, ids[i]) for i in range(30)] + [("c", "fam1", "extra")]
    df = spark.createDataFrame(data, "cell string, family string, id string")
    got = W.cap_per_cell(df, ["cell"], "family", "id", families=2).collect()
    lowest = lambda f: min((x[2] for x in data if x[1] == f), key=lambda i: (hashlib.sha256(i.encode()).digest(), i))
    # fam1 has 7 games; the rest have 6 and tie by name, where a missing family is the empty name.
    assert {(r.family, r.id, r.family_rank) for r in got} == {("fam1", lowest("fam1"), 1), (None, lowest(None), 2)}


def test_prefix_lookup_takes_the_longest(spark, rows):
    df = spark.createDataFrame([("e2e4 d7d5 x",), ("d2d4 d7d5",), ("d2d4 d7d5 c2c4",), ("e2e4 d7d55",)], "route string")
    known = {"e2e4 d7d5": "S", "d2d4 d7d5 c2c4": "Q", "d2d4": "D"}
    assert [r[1] for r in rows(W.prefix_lookup(df, known))] == ["S", "D", "Q", None]


def test_shift_back(spark):
    df = spark.createDataFrame([(dt.date(2024, 3, 10), dt.date(2024, 3, 16))], "a date, b date")
    assert tuple(df.select(*W.shift_back("a", "b")).first()) == (dt.date(2024, 3, 3), dt.date(2024, 3, 9))


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_usual_keys_are_numbered_in_one_shuffle_of_rows(spark, tmp_path):
    spark.createDataFrame([(i % 50, i, str(i)) for i in range(500)], "k int, o int, v string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    got = W.number_rows(df, ["k"], ["o"], F.col("o"), "n")
    # No row is counted by key and block where no bucket of keys is crowded.
    assert "hashpartitioning(k#" in final_plan(got) and final_plan(got).count("Exchange hashpartitioning(k#") == 1


@pytest.mark.parametrize("hot_rows", [1, 3, 10])
def test_numbers_of_crowded_buckets_and_null_keys(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(W, "KEY_BUCKETS", 3)
    data = [(None if i % 9 == 0 else i % 7, i // 4, i) for i in range(90)]
    df = spark.createDataFrame(data, "k int, o int, i int").repartition(5)
    got = {r.i: r.n for r in W.number_rows(df, ["k"], ["o", "i"], F.col("o"), "n", hot_rows=hot_rows).collect()}
    assert got == {d[2]: sum(e[0] == d[0] and e[1:] <= d[1:] for e in data) for d in data}


def test_keys_of_short_blocks_are_not_broadcast(spark):
    df = spark.createDataFrame([(g, p, g * p) for g in range(20) for p in range(1, 6)], "g int, ply int, v int")
    lagged = W.lag_values(df, ["g"], "ply", {"a": (F.col("v"), 1)}, block=2)
    hinted = [x for x in lagged._jdf.queryExecution().optimizedPlan().toString().splitlines() if "strategy=broadcast" in x]
    assert hinted and all("_bucket" in x for x in hinted)


def test_plies_are_dealt_before_they_are_counted(spark):
    df = spark.createDataFrame([("p", "g", 1, "white")], "provider string, game_id string, ply int, color string")
    plan = W.sequence_check(df, ["provider", "game_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan
