"""Registered queries beside their SQL on the smallest tables. ``checks.py`` runs them all."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_point
from tallyboard.plans import load
from checks import TABLES, canonical

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="the tables are not here")

# One of every family; the whole set takes minutes.
CHOSEN = """a01_read_records a05_route_dispositions a10_read_run_receipts b05_parse_utc b10_fingerprint
b12_hash_sample b20_rule_label c02_game_flags c03_player_flags c10_collect_with_fallback d02_move_evals
d08_cumulative_union d11_diff_results e01_draw_rate e08_clock_strata e11_standardized_rate
e12_cluster_bootstrap e16_source_result_cells e19_position_details e34_binomial_alert e37_run_summary
e42_route_departure f02_same_side_lag f10_cap_per_cell g07_transpositions h01_dedupe_or_conflict
i01_run_checks i14_ranking_invariants j02_grouped_split k01_append_new k05_verify_equivalence""".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_every_sql_reads_and_every_query_has_one(duck):
    queries, oracles = entry_point.queries(), entry_point.oracle_sql()
    assert set(oracles) <= set(queries)
    queries, oracles = load()
    assert set(queries) <= set(entry_point.queries())
    assert set(queries) - set(oracles) == {"j03_fit_calibrated"}  # fitted numbers
    for name, sql in oracles.items():
        kinds = [str(d[1]) for d in duck.execute(f"select * from ({sql}) limit 0").description]
        assert not [k for k in kinds if "HUGEINT" in k or "DECIMAL" in k or "[]" in k], name


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_sql(spark, duck, name):
    df = entry_point.queries()[name](spark, str(SF))
    cur = duck.execute(entry_point.oracle_sql()[name])
    want = canonical([d[0] for d in cur.description], cur.fetchall())
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == want


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.count() > 0 and "error_proxy_rate" in df.columns


@pytest.mark.parametrize("name", ["f08_top_n_routes", "f10_cap_per_cell", "f08_top_n_labels"])
def test_top_n_is_cut_before_the_shuffle(spark, name):
    plan = entry_point.queries()[name](spark, str(SF))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize(
    ("name", "table", "columns"),
    [
        ("e01_draw_rate", "orders", {"o_orderkey", "o_orderstatus"}),
        ("b19_json_field", "events", {"event_type", "props"}),
    ],
)
def test_scans_read_only_what_they_need(spark, name, table, columns):
    import re

    plan = entry_point.queries()[name](spark, str(SF))._jdf.queryExecution().executedPlan().toString()
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert read and {c.split(":")[0] for s in read for c in s.split(",")} == columns, (table, read)


def test_no_cartesian_products(spark):
    for name in ("e28_selective_curve", "e51_cascade_policy", "d08_cumulative_union", "d10_reconcile_scalar"):
        plan = entry_point.queries()[name](spark, str(SF))._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_days_of_all_years_are_written(spark, duck):
    from tallyboard.plans.bindings import Tables
    from tallyboard.plans.store_plans import replaced_days

    sql = entry_point.oracle_sql()["k04_replace_days"]
    head = sql[: sql.rindex("select player_game_key")]
    day = "coalesce(utc_date = date '1996-03-09', false)"
    cur = duck.execute(
        f"""{head} select player_game_key, strftime(utc_date, '%Y-%m-%d') as day, case when {day} then 2 else 1 end v
        from pf where not ({day} and color='white')"""
    )
    want = canonical([d[0] for d in cur.description], cur.fetchall())
    df = replaced_days(Tables(spark, str(SF)))
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == want
    assert len({r[0][:4] for r in want[1]}) > 1 and {r[2] for r in want[1]} == {1, 2}
