"""Receipts, reports, joined metrics, opening cells and raw recounts on small tables."""

import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyboard.operators import cells as X
from tallyboard.operators import cube as Q
from tallyboard.operators import metrics as E
from tallyboard.sources import recount, reports
from tallyboard.sources import tables as A


def test_receipts_from_files(spark, tmp_path):
    row = {"case_id": 5, "repeat": 1, "passed": True, "failures": ["x", "y"], "high_severity_miss": True, "gross_cost_usd": 0.5,
           "model_plan_before_semantic_repair": {"status": "answered", "more": [1]},
           "usage": {"input_tokens": 10, "output_tokens": 3, "input_tokens_details": {"cached_tokens": 7}}}
    bare = {"case_id": "b", "repeat": 2, "passed": False, "model_plan_before_semantic_repair": None, "usage": None, "severity": "high"}
    for name, effort in (("live-eval-receipt-900.json", "none"), ("live-eval-receipt-m-high-r3-77.json", "high"), ("later.json", "")):
        text = json.dumps({"model": "m", "reasoning_effort": effort, "cases": 2, "rows": [row, bare]}, indent=1)
        (tmp_path / name).write_text(text)
    cases = spark.createDataFrame([("5", "c1", "q", "answered", "high", "dev", "f")], reports.CASE)
    got = reports.with_cases(reports.receipt_attempts(reports.read_receipts(spark, str(tmp_path))), cases).orderBy("run_order", "attempt").collect()
    assert [(r.file_name, r.run_number, r.run_label) for r in got[::2]] == [
        ("live-eval-receipt-m-high-r3-77.json", 77, "m · high"), ("live-eval-receipt-900.json", 900, "m"), ("later.json", None, "m")]
    a, b = got[0], got[1]
    assert (a.case_id, a.emitted_status, a.cached_tokens, a.input_tokens, a.failures, a.category, a.severity) == ("5", "answered", 7, 10, ["x", "y"], "c1", "normal")
    assert (b.case_id, b.emitted_status, b.cached_tokens, b.gross_cost_usd, b.failures, b.category, b.severity) == ("b", None, 0, 0.0, [], None, "high")
    for body in ("[]", "{}", '{"model": "m", "cases": 1}', "no json"):
        bad = spark.createDataFrame([("x.json", body)], "file_name string, body string")
        with pytest.raises(Exception, match="not a receipt"):
            reports.receipt_attempts(bad).collect()


@pytest.mark.parametrize(
    ("values", "kind"),
    [(["5", "x", None], "string"), ([5, 6], "bigint"), ([5, 1.5, None], "double"), ([1e300, 2], "double"), ([True, None], "boolean"),
     ([None, None], "string"), ([5, "5"], None), ([True, 1], None), ([True, "true"], None), ([[1]], None), ([{"a": 1}], None)],
)
def test_types_are_those_of_the_values(spark, values, kind):
    body = json.dumps({"t": [{"v": v} for v in values]})
    rows = reports.json_rows(spark.createDataFrame([(body,)], "body string"), "body", "t")
    assert [r["type"] for r in reports.column_kinds(rows).collect()] == [kind]
    if kind is None:
        with pytest.raises(ValueError, match="mixed"):
            reports.typed_rows(rows)
    else:
        got = reports.typed_rows(rows)
        assert got.dtypes == [("v", kind)] and [r["v"] for r in got.collect()] == values


def test_rows_with_other_columns_or_names_are_refused(spark):
    for rows, said in (([{"a": 1}, {"a": 1, "b": 2}], "different"), ([{"A": 1}], "lower-case"), ([{"a b": 1}], "lower-case")):
        df = spark.createDataFrame([(json.dumps({"t": rows}),)], "body string")
        with pytest.raises(ValueError, match=said):
            reports.typed_rows(reports.json_rows(df, "body", "t"))


def test_another_report_fails(spark):
    df = spark.createDataFrame([('{"kind": "x", "version": "1.1.0", "cohorts": {}}',)], "b string")
    with pytest.raises(Exception, match="another kind"):
        reports.report_tables(df, "b")["views"].collect()


def test_joined_metrics_do_not_repeat_rows(spark):
    games = spark.createDataFrame([(1, "a", 1, 0), (2, "a", 1, 1), (3, "b", 1, 1), (4, None, 0, 0)], "g int, fam string, ok int, drawn int")
    players = spark.createDataFrame([(1, 10, 1.0), (1, 20, 0.0), (2, 30, 0.5), (3, 40, 1.0), (9, 50, 1.0)], "g int, rating int, score double")

    def metrics(p):
        return E.JoinedMetrics(
            games, ("g",), {"players": p},
            {"ok": ("games", F.col("ok")), "drawn": ("games", F.col("drawn")), "score": ("players", F.col("score")), "rows": ("players", F.lit(1))},
            {"draw_rate": ("drawn", "ok"), "score_a_game": ("score", "ok")},
        )

    def shown(df):
        return {r["fam"]: tuple(r)[1:] for r in df.collect()}

    once, twice = metrics(players), metrics(players.unionByName(players).unionByName(players))
    got = shown(once.query(["draw_rate", "score_a_game", "rows"], group_by=["fam"]))
    assert got == {"a": (0.5, 0.75, 3), "b": (1.0, 1.0, 1), None: (None, None, None)}
    more = shown(twice.query(["draw_rate", "score_a_game", "rows"], group_by=["fam"]))
    assert {k: v[0] for k, v in more.items()} == {k: v[0] for k, v in got.items()} and more["a"][2] == 9
    # A filter on the entity holds for all metrics, one on a table only for its own.
    cut = once.query(["ok", "rows"], where=[("fam", "=", "a"), ("players.rating", ">=", 20)]).first()
    assert tuple(cut) == (2, 2)
    assert shown(once.query(["ok"], where=[("fam", "in", ["b"])], group_by=["fam"])) == {"b": (1,)}
    assert once.query(["ok"], where=[("fam", "is null",)]).first()[0] == 0
    for wrong in (dict(metrics=["no"]), dict(metrics=["ok"], group_by=["rating"]), dict(metrics=["ok"], where=[("fam", "like", "x")]), dict(metrics=["ok"], where=[("x.y", "=", 1)])):
        with pytest.raises(ValueError):
            once.query(**wrong)


def test_opening_cells_are_counts_of_visits(spark):
    rng = random.Random(3)
    rows = []
    for game in range(60):
        route, seen = [], set()
        for ply in range(1, 6):
            route.append(rng.choice("ab"))
            key = "".join(sorted(route))
            rows.append((game, ply, key, " ".join(route), rng.choice(["x", "y", ""]), route[0], rng.random() < 0.1))
            seen.add(key)
    visits = spark.createDataFrame(rows, "game int, ply int, position_key string, route string, next_move string, opening_family string, route_has_repeat boolean")
    got = defaultdict(dict)
    for r in X.opening_cells(visits, 4).collect():
        got[r.grain][r.opening_family, r.fen, r.opening_line, r.continuation] = (r.games, r.ply, r.share)
    at = {k: n for k, n in Counter((r[5], r[2]) for r in rows).items() if n >= 4}
    families = {k: n for k, n in Counter(r[5] for r in rows if r[1] == 1).items() if n >= 4}
    lines = {k: n for k, n in Counter((r[5], r[2], r[3]) for r in rows if not r[6]).items() if n >= 4}
    moves = {k: n for k, n in Counter((r[5], r[2], r[4]) for r in rows if r[4]).items() if n >= 4}
    turned = {k: n for k, n in Counter((f, p) for f, p, _ in lines).items() if n >= 2}
    assert got["opening_family"] == {(f, None, None, None): (n, None, n / 60) for f, n in families.items()}
    assert got["opening_position"] == {(f, p, None, None): (n, None, None) for (f, p), n in at.items()}
    want = {(f, p, line, None): (n, len(line.split()), n / at[f, p]) for (f, p, line), n in lines.items()}
    assert got["opening_line"] == want
    assert got["opening_continuation"] == {(f, p, None, m): (n, None, n / at[f, p]) for (f, p, m), n in moves.items()}
    assert got["transposition"] == {(f, p, None, None): (at[f, p], n, None) for (f, p), n in turned.items()} and turned
    assert got["transposition_route"] == {k: v for k, v in want.items() if k[:2] in turned}


def test_lines_families_and_declared_counts(spark):
    rows = spark.createDataFrame([("f", "l1", "p2", 3), ("f", "l1", "p1", 2), ("f", "l2", "p1", 9), ("g", "l3", "p1", 1), (None, "l", "p", 50)],
                                 "opening_family string, opening_line string, fen string, games int")
    assert [tuple(r) for r in Q.opening_families(rows).collect()] == [("f", 14), ("g", 1)]
    assert [tuple(r) for r in Q.line_positions(rows, "f").collect()] == [("l2", 9, ["p1"]), ("l1", 5, ["p1", "p2"])]
    cases = spark.createDataFrame([("1", "dev", "x"), ("2", "test", "x"), ("3", "test", "y")], "id string, split string, label string")
    right = [("label", "x", 2), ("label", "y", 1), ("split", "dev", 1), ("split", "test", 2), ("cases", "all", 3)]
    schema = "kind string, name string, cases int"
    assert A.declared_count_issues(cases, spark.createDataFrame(right, schema)).count() == 0
    wrong = spark.createDataFrame([*right[1:], ("label", "z", 4)], schema)
    assert {tuple(r) for r in A.declared_count_issues(cases, wrong).collect()} == {("label", "x", 0, 2), ("label", "z", 4, 0)}


def test_stages_given_as_data(spark):
    rows = spark.createDataFrame([(True, "1-0", False, "A: b"), (True, "*", False, None), (True, "0-1", True, "A"), (False, "1-0", False, "A"), (None, "1-0", False, "A")],
                                 "rated boolean, result string, marked_bot boolean, source_opening string")
    got = {r.population: (r.games, r.rolls_up_to) for r in E.intake_funnel(rows, F.col("rated")).collect()}
    assert got == {"seen": (5, None), "excluded": (2, "seen"), "accepted": (3, "seen"), "marked_bots": (1, "accepted"),
                   "unknown_results": (1, "accepted"), "eligible_games": (1, "accepted"), "known_opening_games": (1, "eligible_games")}
    with pytest.raises(ValueError):
        E.funnel_of(rows, [("a", F.lit(True), "b")])


RECORD = """[Site "s/1"]
[Result "1-0"]
[TimeControl "60+0"]
[Opening "French Defense: X"]
[WhiteElo "1500"]
[BlackElo "1390"]

1. e4 { [%eval 0.1] [%clk 0:01:00] } e5 { [%eval 3.0] [%clk 0:00:59] } 2. a { [%eval -0.5] [%clk 0:00:25] } b { [%eval #3] [%clk 0:00:08] } 3. c { [%clk 1:00:00] } d { } 4. e { [%eval 0.0] }
"""


def test_recount_from_texts(spark):
    others = [RECORD.replace('"1-0"', '"*"'), RECORD.replace("60+0", "60+1"), RECORD.replace('[Site', '[WhiteTitle "BOT"]\n[Site')]
    df = spark.createDataFrame([(t,) for t in [RECORD, *others]], "text string")
    got = {r.clock_bucket: tuple(r)[1:] for r in recount.recount_clocks(df).collect()}
    # Before ply 3 white had 60 s and lost 350; before ply 4 black 59 s, a mate after; before ply 5 white 25 s, a mate before;
    # before ply 6 black 8 s; before ply 7 the clock is above the base time and so unknown.
    assert got == {"60_plus": (1, 1, 1, 0), "30_to_59": (1, 0, 0, 1), "10_to_29": (1, 0, 0, 1), "under_10": (1, 0, 0, 0)}
    cohorts = recount.recount_cohorts(df, ["French Defense"], "60+0", 1400, 1600).collect()
    assert [tuple(r) for r in cohorts] == [("French Defense", "white", 1, 1, 0, 0)]
