"""Headline queries on one folder of tables; prints one JSON line.

BENCH_SF_DIR is the folder (default sf0.1), BENCH_CPUS the local cores. Each query runs
once to warm up and once to be timed, its whole result written to a sink that keeps
nothing. The ``built_*`` figures time the stored raw plies and facts, ``synthetic_*`` the rebuild, the
aggregate and the increment on generated games (BENCH_GAMES, default one million).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from tallyboard.functions.scalars import surrogate_key  # noqa: E402
from tallyboard.operators import filters, incremental, joins  # noqa: E402
from tallyboard.operators.metrics import MetricSet  # noqa: E402
from tallyboard.operators.windows import move_facts  # noqa: E402
from tallyboard.plans import load  # noqa: E402
from tallyboard.plans.bindings import Tables  # noqa: E402
from tallyboard.session import get_session, scratch_path  # noqa: E402
from tallyboard.sources.tables import synthetic_facts  # noqa: E402

HEADLINE = (
    "c03_player_flags e01_draw_rate e04_outcomes_by e05_metric_set_players e06_mean_clamped_loss "
    "e07_clock_pressure e08_clock_strata d02_move_evals d03_move_context d04_pivot_colors "
    "e11_standardized_rate e13_game_cells e14_result_cells e15_clock_cells e17_coverage_curve "
    "e18_position_counts e19_position_details e23_corpus_summary e37_run_summary e45_timing_summary "
    "f10_cap_per_cell h01_dedupe_or_conflict h03_dedupe_by_rank i01_run_checks i03_column_tests "
    "b01_classify_record b12_hash_sample b20_rule_label"
).split()


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(work) -> float:
    began = time.perf_counter()
    work()
    return round(time.perf_counter() - began, 3)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    games_wanted = int(os.environ.get("BENCH_GAMES", "1000000"))
    spark = get_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    times: dict[str, float] = {}
    t = Tables(spark, sf)
    drain(move_facts(t.numbered_moves(), t.games))  # warms the engine, keeps nothing
    times["built_moves"] = timed(lambda: t.moves)
    times["built_move_facts"] = timed(lambda: t.move_facts)
    times["built_visits"] = timed(lambda: t.earliest)
    for name in HEADLINE:
        drain(queries[name](spark, sf))
        times[name] = timed(lambda n=name: drain(queries[n](spark, sf)))

    buckets = max(8, int(cpus))

    def stored(df, name: str):
        return incremental.write_by_key(df, f"bench_{name}", scratch_path(spark, name), "game_key", buckets)

    def keyed(start: int, count: int):
        return [df.withColumn("game_key", surrogate_key("provider", "game_id")) for df in synthetic_facts(spark, start, count)]

    games, players = keyed(0, games_wanted)
    times["synthetic_seed"] = timed(lambda: (stored(games, "games"), stored(players, "players")))
    g, p = spark.table("bench_games"), spark.table("bench_players")
    flags = filters.player_flags(p, g)
    drain(flags)
    fpath = scratch_path(spark, "flags")
    times["synthetic_player_games_table"] = timed(
        lambda: incremental.write_by_key(flags, "bench_flags", fpath, "game_key", buckets)
    )
    score = MetricSet(
        spark.table("bench_flags"),
        {"score": F.col("eligible_score"), "games": F.col("score_eligible")},
        {"rate": ("score", "games")},
    ).query(["rate", "games"], group_by=["opening_family"])
    drain(score)
    times["synthetic_opening_score"] = timed(lambda: drain(score))
    times["synthetic_player_outcomes"] = timed(lambda: drain(joins.player_outcomes(p, g)))

    # Increments of 1 % and 10 % of the games: the batch is all rows, old and new.
    done = games_wanted
    for share in (100, 10):
        count = max(1, games_wanted // share)
        more, more_players = keyed(done, count)
        incremental.write_by_key(more, "bench_games", "", "game_key", buckets, "append")
        incremental.write_by_key(more_players, "bench_players", "", "game_key", buckets, "append")
        done += count

        def append() -> int:
            return incremental.append_delta(
                "bench_flags", fpath, spark.table("bench_players"), ["game_key", "color"],
                lambda fresh: filters.player_flags(fresh, spark.table("bench_games")), "game_key", buckets,
            )

        added: list[int] = []
        name = f"synthetic_delta_{100 // share}pct"
        times[name] = timed(lambda: added.append(append()))
        times[f"{name}_rerun"] = timed(lambda: added.append(append()))
        if added != [2 * count, 0]:
            raise RuntimeError(f"the increment stored {added} rows")
    cut = games_wanted
    after = spark.table("bench_games").where(F.col("source_ordinal") > cut)
    times["synthetic_cutoff"] = timed(lambda: drain(filters.player_flags(spark.table("bench_players").join(after.select("game_key"), "game_key", "left_semi"), after)))
    changed = filters.player_flags(*keyed(0, max(1, games_wanted // 100))[::-1])
    times["synthetic_upsert"] = timed(
        lambda: drain(incremental.upsert(spark.table("bench_flags"), changed, ["game_key", "color"]))
    )
    if spark.table("bench_flags").count() != 2 * done:
        raise RuntimeError("the stored table does not have all rows")
    for name in ("games", "players", "flags"):
        spark.sql(f"drop table bench_{name}")
    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": Path(sf).name,
                "cpus": cpus,
                "synthetic_games": games_wanted,
            }
        )
    )


if __name__ == "__main__":
    main()
