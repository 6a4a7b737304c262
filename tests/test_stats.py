import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tallyboard.operators import joins as D
from tallyboard.operators import ml as J
from tallyboard.operators import stats as X
from tallyboard.operators.metrics import ratio


def test_wilson(spark):
    df = spark.createDataFrame([(8, 10), (0, 10), (10, 10), (0, 0)], "s int, n int")
    got = df.select(*X.wilson_interval("s", "n")).collect()
    assert [round(x, 6) for x in got[0]] == [0.490162, 0.943318]
    assert abs(got[1][0]) < 1e-12 and abs(got[2][1] - 1) < 1e-12
    assert tuple(got[3]) == (None, None)


def tail(n, k, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


@pytest.mark.parametrize(("n", "p"), [(1, 0.5), (10, 0.9), (15, 0.05), (40, 0.62), (300, 0.97)])
def test_binomial_tails_and_cutoff(spark, n, p):
    df = spark.createDataFrame([("r", n, n, p)], "run string, passed bigint, trials bigint, baseline_rate double")
    got = {r.k: r.tail for r in X.binomial_tails(df, ["run"], "trials", "baseline_rate").collect()}
    for k, t in got.items():
        assert abs(t - tail(n, k, p)) < 1e-9
    want = max((k for k in range(n) if tail(n, k, p) <= 0.05), default=-1)
    assert X.binomial_alert(df, ["run"]).first().cutoff == want


def test_alert_edges(spark):
    df = spark.createDataFrame([("perfect", 9, 10, 1.0), ("whole", 10, 10, 1.0), ("zero", 0, 10, 0.0)],
                               "run string, passed bigint, trials bigint, baseline_rate double")
    got = {r.run: (r.cutoff, r.alert) for r in X.binomial_alert(df, ["run"]).collect()}
    assert got == {"perfect": (9, True), "whole": (9, False), "zero": (-1, False)}


def test_large_trials_stay_small(spark):
    df = spark.createDataFrame([("r", 10**9, 0.5)], "run string, trials bigint, p double")
    # 40 standard deviations, not 10^9 rows; counted, not computed.
    low = df.select(F.floor(F.col("trials") * F.col("p") - 40 * F.sqrt(F.col("trials") * 0.25))).first()[0]
    assert 10**9 * 0.5 - low < 10**6


def bits(spark, d):
    return spark.createDataFrame([(c, bool(b)) for c, flags in d.items() for b in flags], "case_id string, passed boolean")


def test_sign_test(spark):
    left = {"a": [1, 1], "b": [1, 0], "c": [1, 1], "d": [0, 0], "e": [1, 1], "f": [1, 1]}
    right = {"a": [0, 1], "b": [1, 0], "c": [0, 0], "d": [0, 1], "e": [0, 0], "f": [0, 1]}
    got = X.paired_sign_test(bits(spark, left), bits(spark, right)).first()
    assert (got.favor_left, got.favor_right, got.discordant, got.ties) == (4, 1, 5, 1)
    assert abs(got.p_value - 2 * (1 + 5) / 32) < 1e-9
    same = X.paired_sign_test(bits(spark, left), bits(spark, left)).first()
    assert (same.discordant, same.p_value) == (0, 1.0)
    short = X.paired_sign_test(bits(spark, left), bits(spark, {**right, "f": [1]})).first()
    assert (short.unpaired, short.p_value) == (1, None)


def test_exact_median(spark):
    rng = random.Random(1)
    groups = {"a": [rng.gauss(0, 1) for _ in range(501)], "b": [5.0] * 40, "c": [1.0, 2.0], "d": [7.5],
              "e": [rng.choice([1.0, 2.0, 1000000.0]) for _ in range(300)]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("a", None)], "g string, v double")
    got = {r.g: r.median for r in X.exact_median(df, ["g"], "v").collect()}
    for g, vs in groups.items():
        assert abs(got[g] - statistics.median(vs)) < 1e-12


def test_standardized_rate_uses_common_strata(spark):
    df = spark.createDataFrame(
        [("x", "low", 1.0), ("x", "low", 0.0), ("x", "high", 1.0), ("y", "low", 1.0), ("y", "low", 1.0), ("y", "only", 0.0)],
        "group string, stratum string, score double")
    got = {r.group: r for r in X.standardized_rate(df).collect()}
    assert (got["x"].adjusted_score_rate, got["y"].adjusted_score_rate) == (0.5, 1.0)
    assert (got["y"].available_games, got["y"].common_games) == (3, 2)


@pytest.mark.parametrize("method", ["slots", "poisson"])
def test_bootstrap(spark, method):
    rng = random.Random(2)
    data = [(c, float(rng.random() < 0.6)) for c in range(200) for _ in range(3)]
    df = spark.createDataFrame(data, "c int, v double")
    run = lambda seed: X.cluster_bootstrap(df, "c", {"s": F.sum("v"), "n": F.count("*")},
                                           lambda k: ratio(k["s"], k["n"]), resamples=200, seed=seed, method=method).first()
    a, b = run(1), run(1)
    assert a == b and a != run(2)
    mean = statistics.mean(v for _, v in data)
    assert abs(a.point - mean) < 1e-12 and a.clusters == 200 and a.valid_resamples == 200
    sd = math.sqrt(mean * (1 - mean) / 600)
    assert a.lower < mean < a.upper and 2.5 * sd < a.upper - a.lower < 5.5 * sd


def test_bootstrap_of_one_cluster_is_a_point(spark):
    df = spark.createDataFrame([("c", 1.0), ("c", 0.0)], "c string, v double")
    got = X.cluster_bootstrap(df, "c", {"s": F.sum("v"), "n": F.count("*")}, lambda k: ratio(k["s"], k["n"]), resamples=5)
    assert tuple(got.first()) == (0.5, 0.5, 0.5, 5, 1)


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame(
        [(1, 1, 1, 0.99), (2, 1, 0, 0.70), (3, 0, 0, 0.50), (4, 0, 1, None), (5, 1, 1, 1.0)],
        "id int, label int, prediction int, probability double")


def test_selective_curve(scored):
    got = {r.threshold: r for r in X.selective_curve(scored, [0.7, 0.0, 0.995]).collect()}
    assert (got[0.0].accepted, got[0.0].errors, got[0.0].fallbacks) == (4, 1, 1)
    assert (got[0.7].accepted, got[0.7].errors, got[0.7].coverage) == (3, 1, 0.6)
    assert (got[0.995].accepted, got[0.995].error_rate) == (1, 0.0)
    assert X.choose_threshold(X.selective_curve(scored, [0.0, 0.5, 0.995]), 0.2).first()[0] == 0.995
    assert X.choose_threshold(X.selective_curve(scored, [0.0, 0.5]), 0.2).first()[0] is None


def test_nothing_accepted_has_no_error_rate(scored):
    got = X.selective_curve(scored.where("probability < 0.6"), [0.9]).first()
    assert (got.accepted, got.error_rate, got.coverage) == (0, None, 0.0)


def test_confusion_fills_zeros(scored):
    got = {(r.label, r.prediction): r.cases for r in X.confusion(scored, [0, 1], "fallback").collect()}
    assert got == {("0", "0"): 1, ("0", "1"): 1, ("0", "fallback"): 0, ("1", "0"): 1, ("1", "1"): 2, ("1", "fallback"): 0}
    assert X.accuracy(scored, 1).first()["recall"] == 2 / 3


def test_reliability_puts_one_in_the_last_bin(spark):
    df = spark.createDataFrame([(0.0, 0), (0.19, 1), (0.2, 1), (1.0, 1), (0.95, 0)], "probability double, label int")
    got = X.reliability(df, 5).orderBy("bin").collect()
    assert [r["count"] for r in got] == [2, 1, 0, 0, 2]
    assert got[2].mean_predicted is None and got[4].mean_observed == 0.5
    parts = [X.reliability(df.where("label = 0"), 5), X.reliability(df.where("label = 1"), 5)]
    merged = X.merge_bins(parts, 5).orderBy("bin").collect()
    assert [(r["count"], r.mean_observed) for r in merged] == [(r["count"], r.mean_observed) for r in got]


def test_brier(scored):
    got = X.brier(scored).first()
    assert (got.probabilistic_cases, got.refusals) == (4, 1)
    assert abs(got.brier - (0.01**2 + 0.3**2 + 0.25 + 0) / 4) < 1e-12


def test_ranked_predictions(spark):
    df = spark.createDataFrame(
        [(1, 0.5, False), (1, 0.25, True), (1, 0.25, False), (1, -1.0, False), (2, 0.0, True), (2, 1.0, False), (3, 0.2, True)],
        "id int, weight double, chosen boolean")
    got = {r.id: (r.probability, r["rank"]) for r in X.ranked_choices(df, ["id"]).collect()}
    assert got == {1: (0.25, 2), 2: (0.0, 0), 3: (1.0, 1)}
    one = X.ranked_prediction_scores(X.ranked_choices(df, ["id"])).first()
    assert abs(one.log_loss - math.log(4) / 2) < 1e-12
    assert (one.top1, one.top3, one.zero_count) == (1 / 3, 2 / 3, 1)


def test_cascade_policy(spark):
    p = spark.createDataFrame([(1, "a", 0.9, 1.0), (2, "b", 0.4, 1.0), (3, "a", 0.8, 1.0)], "id int, prediction string, probability double, cost double")
    f = spark.createDataFrame([(1, "b", 10.0), (2, "a", 10.0), (3, "b", 10.0)], "id int, prediction string, cost double")
    t = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, label string")
    got = {r.threshold: (r.accepted, r.correct, r.total_cost) for r in X.cascade_policy(p, f, t, [0.0, 0.5, 0.85]).collect()}
    assert got == {0.0: (3, 1, 3.0), 0.5: (2, 2, 13.0), 0.85: (1, 3, 23.0)}
    only_b = {r.threshold: r.accepted for r in X.cascade_policy(p, f, t, [0.0], boundary=["b"]).collect()}
    assert only_b == {0.0: 1}


def test_changed_between(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id int, prediction string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (3, None), (4, "q")], "id int, prediction string")
    assert {r.id: r.kind for r in X.changed_between(a, b).collect()} == {2: "changed", 4: "missing"}


def attempts(spark, data):
    return spark.createDataFrame(data, "run string, case_id string, repeat int, passed boolean, high_severity_miss boolean")


def test_stability_and_outcomes(spark):
    df = attempts(spark, [("r", "a", 1, True, False), ("r", "a", 2, True, False), ("r", "b", 1, True, False),
                          ("r", "b", 2, False, True), ("r", "c", 1, False, False), ("r", "c", 2, None, False)])
    got = X.flaky_and_hard_fail(df).first()
    assert (got.always_cases, got.flaky_cases, got.never_cases, got.hard_fail) == (1, 1, 1, True)
    out = {(r.case_id, r.repeat): r.outcome for r in X.repeat_outcomes(df, ["r"], 3).collect()}
    assert out[("a", 3)] == "not_attempted" and out[("c", 2)] == "not_scored" and out[("b", 2)] == "fail"


def test_pareto_against_brute_force(spark):
    rng = random.Random(4)
    data = [(f"r{i:03d}", float(rng.randrange(40)), rng.randrange(30) / 30) for i in range(300)]
    best, want = -1.0, []
    for r in sorted(data, key=lambda x: (x[1], -x[2], x[0])):
        if r[2] > best:
            want.append(r[0])
            best = r[2]
    df = spark.createDataFrame(data, "run string, cost double, rate double")
    assert sorted(r.run for r in X.pareto_frontier(df).collect()) == sorted(want)
    one = spark.createDataFrame([("a", 1.0, 0.5), ("b", 1.0, 0.5)], "run string, cost double, rate double")
    assert [r.run for r in X.pareto_frontier(one).collect()] == ["a"]


def test_headline_cohort(spark):
    mk = lambda run, cases, n: [(run, c, i, True, False) for c in cases for i in range(n)]
    df = attempts(spark, mk("one", "abcd", 1) + mk("x", "abc", 3) + mk("y", "abd", 3) + mk("z", "abd", 3))
    got = {r.run for r in X.headline_cohort(df).where("headline").collect()}
    assert got == {"y", "z"}


def test_matched_groups(spark):
    df = spark.createDataFrame([("b", 1, None), ("a", 1, None), ("c", 1, "x"), ("d", 2, None)], "run string, i int, j string")
    got = {r.run: (r.group_first, r.group_size) for r in X.matched_groups(df, ["i", "j"]).collect()}
    assert got == {"a": ("a", 2), "b": ("a", 2), "c": ("c", 1), "d": ("d", 1)}


def test_ledgers(spark):
    df = spark.createDataFrame([("s", "ok", 10, 2.0, "h", "h"), ("s", "failed", 99, 9.0, "x", "y"), ("u", "ok", 5, 1.0, "a", "b"),
                                ("v", "ok", 1, 1.0, "a", "a"), ("v", "ok", 1, 1.0, "b", "b")],
                               "source string, status string, bytes bigint, seconds double, checksum string, recorded_checksum string")
    got = {r.source: (r.bytes_per_second, r.severity) for r in X.attempt_ledger(df).collect()}
    assert got == {"s": (5.0, "ok"), "u": (5.0, "error"), "v": (1.0, "warning")}
    costs = spark.createDataFrame([("r", "completed", 1.0, 0.5), ("r", "completed", None, 0.5), ("r", "failed", None, 0.5)],
                                  "run string, status string, cost double, reserved_cost double")
    one = X.cost_ledger(costs).first()
    assert (one.known_cost, one.unsettled_reservation, one.unsettled_attempts) == (1.0, 0.5, 1)


def test_diff_results(spark):
    cols = "suite string, case_id string, passed boolean, failures string, path string, version string"
    a = spark.createDataFrame([("s", "1", True, "", "p", "v1"), ("s", "2", False, "x", "p", "v1"), ("s", "3", True, "", "p", "v1"),
                               ("s", "4", True, "", "p", "v1")], cols)
    b = spark.createDataFrame([("s", "1", False, "y", "q", "v2"), ("s", "2", True, "", "p", "v2"), ("s", "4", True, "", "p", "v2"),
                               ("s", "5", True, "", "p", "v2")], cols)
    got = {(r.case_id, r.label) for r in D.diff_results(a, b).collect()}
    assert got == {("1", "REGRESSION"), ("1", "PATH-CHANGED"), ("2", "IMPROVEMENT"), ("3", "REMOVED"), ("5", "ADDED"),
                   ("version", "REGRESSION")}
    assert D.diff_results(a, a).count() == 0


def test_prediction_join_refuses_bad_ids(spark):
    p = spark.createDataFrame([(1, "a"), (1, "a"), (3, "a")], "id int, prediction string")
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id int, label string")
    assert tuple(D.prediction_join_issues(p, t).first()) == (1, 1, 1)
    with pytest.raises(ValueError):
        D.score_predictions_join(p, t)


def test_grouped_split(spark):
    df = spark.createDataFrame([(f"g{i % 10}", i, i % 2 == 0) for i in range(100)], "game_id string, i int, label boolean")
    got = J.grouped_split(df, "game_id", 0.25, 3)
    assert got.count() == 100
    train, test = got.where("part = 'train'"), got.where("part = 'test'")
    assert J.assert_disjoint([train, test], "game_id").count() == 0
    assert test.select("game_id").distinct().count() == 3
    flipped = J.grouped_split(df.withColumn("label", ~F.col("label")), "game_id", 0.25, 3)
    assert {(r.i, r.part) for r in flipped.collect()} == {(r.i, r.part) for r in got.collect()}
    two = J.grouped_split(df.where("game_id in ('g1', 'g2')"), "game_id", 0.9, 3)
    assert two.where("part = 'train'").count() == 10


def test_seeded_sample(spark):
    df = spark.createDataFrame([(f"g{i}", i % 4 != 0) for i in range(100)], "id string, ok boolean")
    a = J.seeded_sample(df, F.col("ok"), "id", 10, "s").collect()
    assert a == J.seeded_sample(df.repartition(9), F.col("ok"), "id", 10, "s").collect()
    assert len({r.id for r in a}) == 10 and all(r.ok for r in a)
    assert (a[0].games_seen, a[0].games_eligible) == (100, 75)
    assert J.seeded_sample(df, F.col("ok"), "id", 500, "s").count() == 75


def test_training_frame_and_fit(spark):
    rng = random.Random(9)
    cols = ("provider string, game_id string, ply int, color string, uci string, clock_before_seconds double, phase_proxy string, "
            "centipawn_deterioration bigint, error_proxy boolean, material_balance int")
    data = []
    for g in range(60):
        for p in range(1, 11):
            clock = None if p < 3 else rng.uniform(0, 60)
            loss = None if p == 1 else (300 if (clock or 60) < 20 else 5)
            moves = ["e2e4", "d7d5"] + ["x"] * 8
            data.append(("p", f"g{g}", p, "white" if p % 2 else "black", moves[p - 1], clock, "early_ply", loss,
                         None if loss is None else loss >= 200, p))
    moves = spark.createDataFrame(data, cols)
    games = spark.createDataFrame([("p", f"g{g}", "Standard", 10) for g in range(60)], "provider string, game_id string, variant string, ply_count bigint")
    assert tuple(J.training_issues(moves, games).first()) == (0, 0, 0, 0, 0)
    frame = J.training_frame(moves, games)
    got = {r.ply: (r.opening_family, r.material_balance) for r in frame.where("game_id = 'g0'").collect()}
    # The family is known only once its whole prefix has been played.
    assert got[2] == (None, 2) and got[3] == ("Scandinavian Defense", 3) and got[10] == ("Scandinavian Defense", 10)
    assert 1 not in got
    holdout = J.fit_calibrated(frame, rounds=3, depth=2)
    games_out = {r.game_id for r in holdout.collect()}
    assert len(games_out) == 15
    bins = J.evaluate_calibration(holdout, 5).collect()
    assert sum(r["count"] for r in bins) == 15 * 9 and bins[0].brier < 0.05


def test_median_and_frontier_with_a_far_value(spark):
    rng = random.Random(3)
    values = [rng.random() for _ in range(20_001)] + [1e9]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 2.0), ("b", 4.0), ("c", None)], "g string, v double")
    got = {r.g: r["median"] for r in X.exact_median(df, ["g"], "v").collect()}
    ordered = sorted(values)
    assert got == {"a": (ordered[10_000] + ordered[10_001]) / 2, "b": 3.0}
    runs = [(f"r{i}", rng.random(), rng.randrange(50) / 50) for i in range(3000)] + [("far", 1e9, 1.0)]
    runs += [("tie1", 0.5, 0.99), ("tie0", 0.5, 0.99), ("none", None, 1.0)]
    frame = spark.createDataFrame(runs, "run string, cost double, rate double").repartition(5)
    want, top = set(), -1.0
    for name, cost, rate in sorted((r for r in runs if r[1] is not None), key=lambda r: (r[1], -r[2], r[0])):
        if rate > top:
            want.add(name)
            top = rate
    assert {r.run for r in X.pareto_frontier(frame).collect()} == want


def test_reliability_refuses_what_is_no_probability(spark):
    for bad in (1.5, -0.1, None, float("nan")):
        df = spark.createDataFrame([(0.5, 1), (bad, 0)], "probability double, label int")
        with pytest.raises(Exception, match="must be a number from 0 to 1"):
            X.reliability(df, 5).collect()


def test_order_check_finds_a_changed_order(spark):
    from tallyboard.operators.ml import order_check

    rows = [(float(m), 1 / (1 + math.exp(-m / 9)), m % 2) for m in range(-30, 30)]
    frame = spark.createDataFrame(rows, "margin double, probability double, label int")
    assert tuple(order_check(frame).first()) == (60, 30, 60, 0)
    turned = frame.withColumn("probability", F.when(F.col("margin") == 3, 0.01).otherwise(F.col("probability")))
    assert order_check(turned).first()["out_of_order"] > 0
    assert order_check(frame.withColumn("probability", 1 - F.col("probability"))).first()["out_of_order"] > 0
    assert tuple(order_check(frame.where("margin = 3")).first()) == (1, 1, 1, 0)


def brute_intervals(rows, stat, seed, resamples, alpha=0.05):
    """Rows of (group, cluster, ...) drawn one by one, as whole clusters."""
    import hashlib

    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    out = {}
    for g in sorted({r[0] for r in rows}):
        held = {}
        for r in rows:
            if r[0] == g:
                held.setdefault(r[1], []).append(r)
        keys = sorted(held, key=lambda c: (digest(c), c))
        values = []
        for b in range(resamples):
            drawn = [x for slot in range(len(keys)) for x in held[keys[int(digest(f"{seed}:{g}:{b}:{slot}")[:15], 16) % len(keys)]]]
            if (v := stat(g, drawn)) is not None:
                values.append(v)
        values.sort()
        last = len(values) - 1
        ends = (values[int(alpha / 2 * last)], values[int((1 - alpha / 2) * last)]) if values else (None, None)
        out[g] = (stat(g, [r for r in rows if r[0] == g]), *ends, len(values), len(keys))
    return out


def test_adjusted_rates_are_those_of_drawn_rows(spark):
    rng = random.Random(4)
    strata = ["low", "mid", "high", "never"]
    rows = [(g, f"c{rng.randrange(9)}", rng.choice(strata[: 3 if g == "x" else 2]), float(rng.random() < 0.5)) for g in "xy" for _ in range(25)]
    rows += [("x", "c1", None, 1.0)]
    count = lambda g, s: sum(r[0] == g and r[2] == s for r in rows)
    common = [s for s in strata if count("x", s) and count("y", s)]
    kept = sum(count(g, s) for g in "xy" for s in common)

    def adjusted(_, drawn):
        parts = [[r[3] for r in drawn if r[2] == s] for s in common]
        if not all(parts):
            return None
        return sum((count("x", s) + count("y", s)) / kept * sum(p) / len(p) for s, p in zip(common, parts))

    df = spark.createDataFrame(rows, "group string, cluster string, stratum string, score double")
    got = {r["group"]: tuple(r)[2:] for r in X.adjusted_rates(df, strata, resamples=60, seed=3).collect()}
    want = brute_intervals(rows, adjusted, 3, 60)
    assert set(got) == set(want) and all(got[g] == pytest.approx(want[g]) for g in want)


def test_ranked_intervals_are_those_of_drawn_rows(spark):
    rng = random.Random(5)
    rows = [(g, f"{rng.randrange(6)}", rng.choice([0.0, 0.2, 0.5, 1.0]), rng.randrange(1, 6)) for g in "ab" for _ in range(30)]
    rows += [("z", "9", 0.0, 0)]
    df = spark.createDataFrame(rows, "g string, game string, probability double, rank int")
    got = {(r["group"], r["statistic"]): tuple(r)[2:] for r in X.ranked_prediction_intervals(df, "g", "game", resamples=40, seed=2).collect()}
    stats = {
        "log_loss": lambda _, d: statistics.mean(-math.log(r[2]) for r in d if r[2] > 0) if any(r[2] > 0 for r in d) else None,
        "top1": lambda _, d: sum(r[2] > 0 and r[3] == 1 for r in d) / len(d),
        "top3": lambda _, d: sum(r[2] > 0 and r[3] <= 3 for r in d) / len(d),
    }
    for name, stat in stats.items():
        for g, want in brute_intervals(rows, stat, 2, 40).items():
            assert got[g, name] == pytest.approx(want), (g, name)
    assert X.ranked_prediction_intervals(df.limit(0), "g", "game").count() == 0


def test_bootstrap_draws_vectors_only(spark):
    """What is drawn has one row for each cluster, whatever the number of rows."""
    df = spark.range(5000).selectExpr("id % 2 as g", "id % 20 as c", "0.5D as probability", "1 as rank")
    X.ranked_prediction_intervals(df, "g", "c", resamples=10).collect()
    text = X.ranked_prediction_intervals(df, "g", "c", resamples=10)._jdf.queryExecution().optimizedPlan().toString()
    below = text[text.index("Generate explode") :]
    assert "Aggregate" in below and "CartesianProduct" not in text


def test_bootstrap_plan_has_the_work_once(spark):
    """The plan that draws reads stored vectors; the input's own work is not planned again."""
    df = spark.range(400).selectExpr("id % 2 as g", "id % 20 as c", "0.5D as probability", "1 as rank")
    text = X.ranked_prediction_intervals(df, "g", "c", resamples=10)._jdf.queryExecution().optimizedPlan().toString()
    assert "Range (" not in text and "Generate explode" in text
