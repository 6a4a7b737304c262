"""Stored tables by key, and increments to them."""

import pytest
from pyspark.sql import functions as F

from tallyboard.operators import filters as C
from tallyboard.operators import incremental as K
from tallyboard.session import tune
from tallyboard.sources import tables as A


def keyed(spark, start, count):
    key = F.concat_ws(":", "provider", "game_id")
    return [df.withColumn("game_key", key) for df in A.synthetic_facts(spark, start, count)]


def test_tables_by_one_key_meet_as_they_lie(spark, tmp_path):
    tune(spark)
    names = ("inc_games", "inc_players", "inc_flags")
    for name in names:
        spark.sql(f"drop table if exists {name}")
    games, players = keyed(spark, 0, 120)
    g = K.write_by_key(games, names[0], str(tmp_path / "g"), "game_key", 4)
    p = K.write_by_key(players, names[1], str(tmp_path / "p"), "game_key", 4)
    path = str(tmp_path / "f")
    flags = C.player_flags(p, g)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in flags._jdf.queryExecution().executedPlan().toString().replace("ReusedExchange", "")
        stored = K.write_by_key(flags, names[2], path, "game_key", 4)
        plan = K.new_rows(stored, p, ["game_key", "color"])._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert stored.count() == 240

    def append():
        return K.append_delta(
            names[2], path, spark.table(names[1]), ["game_key", "color"],
            lambda fresh: C.player_flags(fresh, spark.table(names[0])), "game_key", 4,
        )

    assert append() == 0
    more, more_players = keyed(spark, 120, 30)
    K.write_by_key(more, names[0], "", "game_key", 4, "append")
    K.write_by_key(more_players, names[1], "", "game_key", 4, "append")
    assert append() == 60 and append() == 0
    rebuilt = C.player_flags(spark.table(names[1]), spark.table(names[0]))
    assert K.verify_equivalence(spark.table(names[2]), rebuilt).first()["equal"]
    for name in names:
        spark.sql(f"drop table {name}")


def test_load_batch_and_replay_read_one_stored_table(spark, monkeypatch):
    from pathlib import Path

    import __spark_entry__ as entry_point
    from tallyboard.plans import store_plans

    sf = "/root/testdata/sf0.001"
    if not Path(sf).exists():
        pytest.skip("the tables are not here")
    batches, append = [], store_plans.K.append_new
    monkeypatch.setattr(store_plans.K, "append_new", lambda path, batch, key: (batches.append(batch), append(path, batch, key)))
    entry_point.queries()["k01_append_new"](spark, sf)
    plans = [b._jdf.queryExecution().optimizedPlan().toString() for b in batches]
    assert len(plans) == 2 and not any("Join" in p for p in plans)
