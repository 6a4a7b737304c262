import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyboard.operators import incremental as K
from tallyboard.operators import quality as I
from tallyboard.schemas import FACT_PLAYER_GAME
from tallyboard.session import materialize, scratch_path, shared_dir
from tallyboard.sources import tables as A


@pytest.fixture(scope="module")
def facts(spark):
    return A.synthetic_facts(spark, 0, 200)


def test_synthetic_facts_pass_all_checks(facts):
    games, players = facts
    assert players.count() == 400
    got = {r.check: r.failures for r in I.run_checks(games, players, "lichess", 8).collect()}
    assert len(got) == 9
    # Two of five games are White wins and one a Black win, yet wins equal losses over players.
    assert got == dict.fromkeys(got, 0)
    with pytest.raises(ValueError):
        A.synthetic_facts(None, 0, 0)


@pytest.mark.parametrize(
    ("check", "spoil"),
    [
        ("unique_game_keys", lambda g, p: (g.unionByName(g.limit(1)), p)),
        ("unique_player_keys", lambda g, p: (g, p.unionByName(p.limit(1)))),
        ("required_game_fields", lambda g, p: (g.withColumn("rated", F.lit(None).cast("boolean")), p)),
        ("two_participants", lambda g, p: (g, p.where("not (game_id = '00000004' and color = 'black')"))),
        ("no_orphans", lambda g, p: (g.where("game_id <> '00000003'"), p)),
        ("participant_scores", lambda g, p: (g, p.withColumn("score", F.lit(0.5)))),
        ("score_conservation", lambda g, p: (g, p.withColumn("score", F.when(F.col("color") == "white", 1.0).otherwise(F.col("score"))))),
        ("wins_equal_losses", lambda g, p: (g, p.where("color = 'white'"))),
        ("rating_symmetry", lambda g, p: (g, p.withColumn("rating", F.when(F.col("color") == "white", 1).otherwise(F.col("rating"))))),
    ],
)
def test_each_check_sees_its_fault(facts, check, spoil):
    got = {r.check: r.failures for r in I.run_checks(*spoil(*facts)).collect()}
    assert got[check] > 0


def test_column_tests(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (None, "z")], "k int, v string")
    other = spark.createDataFrame([(1,)], "id int")
    rules = [I.Rule("k", "not_null"), I.Rule("k", "unique"), I.Rule("v", "accepted_values", ("a", "b")),
             I.Rule("k", "relationships", (), other, "id")]
    got = {r.check: r.failures for r in I.column_tests(df, rules).collect()}
    assert got == {"not_null:k": 1, "unique:k": 1, "accepted_values:v": 1, "relationships:k": 1}


def test_schema_contract(spark):
    df = spark.createDataFrame([(1, "x")], "a int, c string")
    want = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    assert I.schema_issues(df, want) == [("a", "retyped"), ("b", "missing"), ("c", "extra")]
    with pytest.raises(ValueError):
        A.apply_schema(df, want)


def test_gated_write(spark, tmp_path):
    df = spark.createDataFrame([(1,), (None,)], "k int")
    bad = str(tmp_path / "bad")
    with pytest.raises(I.QualityError, match="not_null:k=1"):
        I.gated_write(df, I.column_tests(df, [I.Rule("k", "not_null")]), bad)
    assert not (tmp_path / "bad").exists()
    good = str(tmp_path / "good")
    I.gated_write(df, I.column_tests(df, [I.Rule("k", "unique")]), good)
    assert spark.read.parquet(good).count() == 2


def test_public_check(spark):
    df = spark.createDataFrame([("ok", "10+0"), ("see data/x.json", "bad")], "note string, time_control string")
    got = {r.check: r.failures for r in I.public_check(df, {"note": ["ok"]}, {"time_control": r"^\d+\+\d+$"}).collect()}
    assert got == {"leak:note": 1, "leak:time_control": 0, "allowed:note": 1, "pattern:time_control": 1}
    named = {r.check: r.failures for r in I.public_check(df.withColumnRenamed("note", "username")).collect()}
    assert named["name:username"] == 2


def test_compare_reports_is_null_safe(spark):
    a = spark.createDataFrame([(None, 1), ("x", None), ("y", 2)], "k string, n int")
    b = spark.createDataFrame([(None, 1), ("x", None), ("z", 2)], "k string, n int")
    assert {r.k for r in I.compare_reports(a, b, ["k"], ["n"]).collect()} == {"y", "z"}
    assert I.compare_reports(a, a, ["k"], ["n"]).count() == 0


def test_within_tolerance(spark):
    e = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, None), (4, 0.5), (5, None)], "k int, v double")
    a = spark.createDataFrame([(1, 0.505), (2, 0.6), (3, 0.1), (5, None)], "k int, v double")
    assert sorted(r.k for r in I.within_tolerance(e, a, "k", "v", 0.01).collect()) == [2, 3, 4]


def test_typed_round_trip(spark, facts, tmp_path):
    path = str(tmp_path / "p")
    A.write_typed(facts[1], path, FACT_PLAYER_GAME, ["color"])
    back = A.apply_schema(A.read_shards(spark, path), FACT_PLAYER_GAME)
    assert K.verify_equivalence(back, A.apply_schema(facts[1], FACT_PLAYER_GAME)).first().equal


def test_append_new_and_upsert(spark, facts, tmp_path):
    players = facts[1].withColumn("key", F.concat_ws(":", "game_id", "color"))
    path = str(tmp_path / "t")
    first = players.where("game_id < '00000064'")
    first.write.parquet(path)
    K.append_new(path, players, "key")
    K.append_new(path, players, "key")
    assert K.verify_equivalence(spark.read.parquet(path), players).first().equal
    changed = first.withColumn("score", F.lit(9.0))
    up = K.upsert(players, changed, "key")
    assert up.count() == players.count() and up.where("score = 9").count() == first.count()
    assert K.verify_equivalence(K.upsert(up, changed, "key"), up).first().equal


def test_null_key_does_not_hide_others(spark):
    target = spark.createDataFrame([(1,), (None,)], "k int")
    batch = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    assert sorted((r.k is None, r.k) for r in K.new_rows(target, batch, "k").collect()) == [(False, 2), (True, None)]


def test_replace_days_keeps_other_days(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01", 1), ("2024-01-01", 2), ("2024-01-02", 3)], "day string, v int")
    path = str(tmp_path / "d")
    K.write_days(df, path, "day")
    K.replace_days(spark.createDataFrame([("2024-01-01", 9)], "day string, v int"), path, "day")
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [3, 9]


def test_checksum_sees_change_loss_and_repeat(spark, facts):
    p = facts[1]
    equal = lambda a, b: K.verify_equivalence(a, b).first().equal
    assert equal(p.repartition(7), p)
    assert not equal(p.where("game_id <> '00000001'"), p)
    assert not equal(p.unionByName(p.limit(1)), p)
    assert not equal(p.withColumn("player_key", F.when(F.col("game_id") == "00000001", None).otherwise(F.col("player_key"))), p)


def test_receipts_and_extracts(spark, tmp_path):
    (tmp_path / "r").mkdir()
    for name in ("b", "a"):
        (tmp_path / "r" / f"{name}-receipt.json").write_text(
            '{"run_id": "%s",\n "repeats": 1, "rows": [{"case_id": "c1", "passed": true, "usage": {"input_tokens": 5}},\n'
            '{"case_id": "c2", "passed": null, "gross_cost_usd": 0.5}]}' % name)
    got = A.read_run_receipts(spark, str(tmp_path / "r")).orderBy("file_run", "attempt").collect()
    assert [(r.file_run, r.case_id, r.passed, r.input_tokens) for r in got] == [
        ("a", "c1", True, 5), ("a", "c2", None, None), ("b", "c1", True, 5), ("b", "c2", None, None)]
    doc = tmp_path / "x.json"
    doc.write_text('{"games": [{"k": "a", "n": 1}, {"k": "b"}],\n "other": []}')
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("n", T.LongType())])
    tables = A.extract_tables(spark, str(doc), {"games": schema, "other": schema})
    assert [tuple(r) for r in tables["games"].collect()] == [("a", 1), ("b", None)] and tables["other"].count() == 0


def test_inferred_types(spark):
    df = spark.createDataFrame([("1", "1.5", "2024-01-01", "true", None), ("-2", "3", "2024-02-30", "false", None)],
                               "i string, f string, d string, b string, n string")
    got = {r.column: r.type for r in A.infer_column_types(df).collect()}
    # 30 February is not a date, so the column stays text.
    assert got == {"i": "bigint", "f": "double", "d": "string", "b": "boolean", "n": "string"}


def test_labelled_text(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("id\tsplit\tlabel\tquestion\n1\tdev\ta\tWhy?\n2\ttest\tb\t \n2\tother\tc\tHow?\n")
    cases = A.read_labelled_text(spark, str(tmp_path / "c.tsv"))
    got = A.labelled_text_issues(cases, ["a", "b"]).first().asDict()
    assert got == {"cases": 3, "bad_label": 1, "bad_split": 1, "blank": 1, "labels_absent": 0, "repeated_ids": 1}


def test_time_spine(spark):
    spine = A.time_spine(spark, "2012-01-01", "2030-12-31")
    assert spine.count() == 6940 and spine.distinct().count() == 6940


def test_scratch_follows_the_named_folder(spark):
    class Conf:
        def get(self, key, default=None):
            return "hdfs://shared/scratch/" if key == "spark.checkpoint.dir" else default

    class Session:
        conf = Conf()

    assert shared_dir(Session()) == "hdfs://shared/scratch"
    assert scratch_path(Session(), "a").startswith("hdfs://shared/scratch/a-")
    assert scratch_path(spark, "a") != scratch_path(spark, "a")
    kept = materialize(spark.range(5).toDF("x"), "m")
    assert kept.count() == 5 and "InMemoryFileIndex" in kept._jdf.queryExecution().toString()


def test_rederive_totals(spark):
    rows = spark.createDataFrame([("r", "a", True, 0.5, 1, 2, False, False, False)],
                                 "run string, case_id string, passed boolean, cost double, input_tokens bigint, output_tokens bigint, "
                                 "high_severity_miss boolean, unsafe_answer boolean, over_abstention boolean")
    header = spark.createDataFrame([("r", 1, 1, 1.0, 0.5, 1, 2, 0, 0, 0, 1.0, 1)],
                                   "run string, rows int, passed int, pass_rate double, cost double, input_tokens int, output_tokens int, "
                                   "high_severity_misses int, unsafe_answers int, over_abstentions int, hard_fail double, cases int")
    got = I.rederive_totals(header, rows).collect()
    assert [(r.total, r.stored, r.derived) for r in got] == [("hard_fail", 1.0, 0.0)]


def test_digests_tell_near_tables_apart(spark):
    def equal(x, y):
        return K.verify_equivalence(x, y).first()["equal"]

    a = spark.createDataFrame([("x|y", "z")], "a string, b string")
    assert not equal(a, spark.createDataFrame([("x", "y|z")], "a string, b string"))
    null = spark.createDataFrame([(None, "z")], "a string, b string")
    for text in ("\\N", "-", "", "null"):
        assert not equal(null, spark.createDataFrame([(text, "z")], "a string, b string"))
    assert not equal(a, a.withColumnRenamed("b", "c"))
    assert equal(a.unionByName(null), null.unionByName(a).select("b", "a"))


def test_public_names_in_any_case(spark):
    df = spark.createDataFrame([("x",)], "Player_Key string")
    got = {r.check: r.failures for r in I.public_check(df, forbidden=["player_key"]).collect()}
    assert got["name:Player_Key"] == 1


def test_checks_read_each_table_once(facts):
    def exchanges(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

    # Players by color, then games and players by key.
    assert exchanges(I.run_checks(*facts, "lichess", 8)) == 2


def test_checks_take_a_null_key_for_no_game(spark, facts):
    games, players = facts
    lost = F.when(F.col("game_id") == "00000004", None).otherwise(F.col("game_id")).alias("game_id")
    def unnamed(df):
        return df.select(*[lost if c == "game_id" else c for c in df.columns])
    got = {r.check: r.failures for r in I.run_checks(unnamed(games), unnamed(players), "lichess", 8).collect()}
    assert got["no_orphans"] == 2 and got["two_participants"] == 1 and got["required_game_fields"] == 1


def test_stored_tables_follow_their_files(spark, tmp_path):
    from tallyboard.session import version

    folder = str(tmp_path / "t")
    spark.range(3).write.parquet(folder)
    before = version(spark, folder)
    assert before == version(spark, folder)
    spark.range(2).write.mode("append").parquet(folder)
    assert version(spark, folder) != before
