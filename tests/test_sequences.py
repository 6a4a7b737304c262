import itertools
import random

import pytest
from pyspark.sql import functions as F

from tallyboard.operators import cube as Q
from tallyboard.operators import filters as C
from tallyboard.operators import joins as D
from tallyboard.operators import sequences as Z
from tallyboard.operators import windows as W

COLS = ("provider string, game_id string, cohort string, opening_family string, eco string, ply int, "
        "position_key string, position_id string, route string, next_move string, route_has_repeat boolean")


def visit(game, ply, position, route, nxt="", family="A", eco="E1", repeat=False, cohort="c"):
    return ("p", game, cohort, family, eco, ply, position, position, route, nxt, repeat)


@pytest.fixture(scope="module")
def visits(spark):
    data = [
        visit("g1", 1, "P", "a", "b"), visit("g1", 2, "Q", "a b", "c"), visit("g1", 3, "P", "a b c", "d", repeat=True),
        visit("g2", 1, "P", "x", "b", "B"), visit("g2", 2, "R", "x b", "", "B"),
        visit("g3", 1, "P", "a", "c", "Unknown", ""), visit("g3", 2, "R", "a c", "", "Unknown", ""),
        visit("g4", 1, "S", "z", ""),
        visit("g5", 1, "Q", "q", "", repeat=True),
    ]
    return spark.createDataFrame(data, COLS).repartition(3)


@pytest.fixture(scope="module")
def first(visits):
    return W.earliest_visit(visits)


def test_position_counts(first):
    got = {r.position_id: (r.games, r.acyclic_routes, r.loop_prefix_games) for r in Z.position_counts(first).collect()}
    assert got == {"P": (3, 2, 0), "Q": (2, 1, 1), "R": (2, 2, 0), "S": (1, 1, 0)}
    assert tuple(Z.view_totals(Z.position_counts(first)).first()) == (4, 3, 2)


def test_ranks_break_ties_by_id(first):
    counts = Z.position_counts(first)
    assert [(r.position_id, r["rank"]) for r in Z.rank_positions(counts, "recurring", 3).collect()] == [
        ("P", 1), ("Q", 2), ("R", 3)]
    assert [r.position_id for r in Z.rank_positions(counts, "transposing", 9).collect()] == ["P", "R"]


def test_union_coverage_counts_a_game_once(first):
    ranks = Z.rank_positions(Z.position_counts(first), "recurring", 3)
    curve = Z.coverage_curve(first, ranks, 3).orderBy("n").collect()
    assert [(r.n, r.games, r.additional_games) for r in curve] == [(1, 3, 3), (2, 4, 1), (3, 4, 0)]
    assert curve[1]["share"] == 4 / 5
    direct = D.cumulative_union(first, ranks, "position_id", 3).orderBy("n").collect()
    assert [r.games for r in direct] == [3, 4, 4]


def test_coverage_curve_against_brute_force(spark):
    rng = random.Random(5)
    data = {(f"g{g}", f"P{rng.randrange(12):02d}") for g in range(200) for _ in range(rng.randrange(1, 6))}
    df = spark.createDataFrame([visit(g, 1, p, "r") for g, p in sorted(data)], COLS)
    ranks = Z.rank_positions(Z.position_counts(df), "recurring", 7)
    order = [r.position_id for r in ranks.orderBy("rank").collect()]
    want = [len({g for g, p in data if p in order[: n + 1]}) for n in range(7)]
    assert [r.games for r in Z.coverage_curve(df, ranks, 7).orderBy("n").collect()] == want
    assert [r.games for r in D.cumulative_union(df, ranks, "position_id", 7).orderBy("n").collect()] == want


def test_position_details(first):
    got = {r.position_id: r for r in Z.position_details(first, 5, "c").collect()}
    p = got["P"]
    assert (p.games, p.frequency, p.dominant_route_games, p.alternative_route_share) == (3, 0.6, 2, 1 - 2 / 3)
    assert (p.distinct_recorded_families, p.distinct_recorded_ecos, p.unknown_family_games) == (2, 1, 1)
    assert (p.other_acyclic_route_games, p.next_move_games, p.token_played_games) == (0, 3, 0)
    assert got["R"].token_played_games == 1 and got["R"].next_move_games == 0
    # Q: one game by a route, one only through a repeat.
    assert (got["Q"].acyclic_games, got["Q"].alternative_route_share) == (1, 0.0)


def test_no_acyclic_game_gives_null_share(spark):
    df = spark.createDataFrame([visit("g", 2, "Q", "q", repeat=True)], COLS)
    got = Z.position_details(df, 1, "c").first()
    assert (got.acyclic_games, got.alternative_route_share, got.dominant_route_games) == (0, None, 0)


def test_continuations_use_the_earliest_visit(visits):
    got = Z.continuations(visits, "P", "c", limit=1).collect()
    assert [(r.next_move, r.games, r.share_of_position_games, r.truncated) for r in got] == [("b", 2, 2 / 3, True)]
    # No next move: counted in the position's games but not listed.
    assert Z.continuations(visits, "S").collect() == []


def test_inventory_and_compression(visits, first):
    got = {r.opening_family: (r.games, r["share"]) for r in Z.family_inventory(first).collect()}
    assert got == {"A": (3, 0.6), "B": (1, 0.2), "Unknown": (1, 0.2)}
    assert [r.opening_family for r in Z.top_families(first, k=2, minimum=1).collect()] == ["A", "B"]
    plies = {r.ply: r for r in Z.endpoint_compression(visits).collect()}
    assert (plies[1].distinct_routes, plies[1].distinct_positions, plies[1].included_visits) == (3, 2, 4)
    assert abs(plies[1].endpoint_compression - 1 / 3) < 1e-12 and 3 not in plies


def test_lens_takes_games_that_reach_the_ply(visits):
    assert [r.game_id for r in C.lens_games(visits, "a", ["c"], ply=2).collect()] == ["g3"]
    # g3 ends at ply 2, before this window does.
    assert [r.game_id for r in C.lens_games(visits, "a", ["c"], ply=3).collect()] == ["g1"]
    assert C.lens_games(visits, "z", ["z"], ply=1).count() == 0


def test_departure_refuses_visits_that_begin_later(spark, visits):
    routes = spark.createDataFrame([("a b",)], "route string")
    with pytest.raises(ValueError, match="from ply 1"):
        Z.route_departure(visits.where("ply > 1"), routes)


def test_id_collisions(spark, first):
    assert Z.id_collisions(first).count() == 0
    clash = first.unionByName(first.limit(1).withColumn("position_key", F.lit("other")))
    assert Z.id_collisions(clash).count() == 1


def brute_departure(moves, routes):
    prefixes, going, ends = set(), set(), set(routes)
    for r in routes:
        m = r.split(" ")
        for i in range(1, len(m) + 1):
            prefixes.add(" ".join(m[:i]))
            going.add(" ".join(m[: i - 1]))
    for i in range(min(20, len(moves))):
        before = " ".join(moves[:i])
        if before in ends or before not in going:
            return None
        if " ".join(moves[: i + 1]) not in prefixes:
            return i + 1
    return None


def test_route_departure_against_brute_force(spark):
    routes = ["a b c", "a c", "b a b a", "a b"]
    games = {"".join(m): list(m) for n in range(1, 5) for m in itertools.product("abc", repeat=n)}
    data = [visit(g, i + 1, "".join(m[: i + 1]), " ".join(m[: i + 1])) for g, m in games.items() for i in range(len(m))]
    df = spark.createDataFrame(data, COLS)
    ref = spark.createDataFrame([(r,) for r in routes], "route string")
    got = {r.game_id: r.departure_ply for r in Z.route_departure(df, ref).collect()}
    want = {g: d for g, m in games.items() if (d := brute_departure(m, routes)) is not None}
    assert got == want
    ranks = spark.createDataFrame([("baca", 1)], "position_id string, rank int")
    per = {r.departure_ply: (r.games, r.reentered_games) for r in Z.departures_per_ply(df, ref, ranks).collect()}
    assert sum(n for n, _ in per.values()) == len(want) and per[3][1] == 1


def test_transpositions_need_two_surviving_routes(spark):
    routes = spark.createDataFrame([("P", "a", 12), ("P", "b", 11), ("P", "c", 3), ("Q", "a", 30), ("Q", "b", 9)],
                                   "position_id string, route string, games bigint")
    positions = spark.createDataFrame([("P", 26), ("Q", 39)], "position_id string, games bigint")
    summary, shown = Q.transpositions(routes, positions)
    assert [(r.position_id, r.move_orders, r.kept_games) for r in summary.collect()] == [("P", 2, 23)]
    assert [(r.route, r["rank"]) for r in shown.orderBy("rank").collect()] == [("a", 1), ("b", 2)]


def test_ranking_invariants_see_a_wrong_curve(first):
    ranks = Z.rank_positions(Z.position_counts(first), "recurring", 3)
    curve = Z.coverage_curve(first, ranks, 3)
    details = Z.position_details(Z.detail_visits(first, ranks), 5, "c")
    routes = Z.top_routes(Z.detail_visits(first, ranks))
    families = Z.family_inventory(first)
    sound = Z.ranking_invariants(ranks, curve, details, routes, families, 5)
    assert sound.where("violations > 0").count() == 0
    wrong = curve.withColumn("games", F.when(F.col("n") == 2, 1).otherwise(F.col("games")))
    seen = Z.ranking_invariants(ranks, wrong, details, routes, families, 6).where("violations > 0")
    assert {r.check for r in seen.collect()} == {"union_between_max_and_sum", "union_rises", "families_sum"}
