import pytest
from pyspark.sql import functions as F

from tallyboard.operators import dedupe as H
from tallyboard.operators import quality as I
from tallyboard.sources import text as X


def record(i, *, event="Rated Blitz game", result="1-0", body=None, site=None, extra=(), **tags):
    base = {
        "Event": event,
        "Site": site or f"https://lichess.org/{i:08d}",
        "White": "Ann",
        "Black": "Bob",
        "Result": result,
        "UTCDate": "2013.01.01",
        "UTCTime": "10:00:00",
        "WhiteElo": "1500",
        "BlackElo": "1600",
        "TimeControl": "60+0",
        **tags,
    }
    head = "\n".join([f'[{k} "{v}"]' for k, v in base.items() if v is not None] + list(extra))
    return f"{head}\n\n{body if body is not None else '1. e4 e5 ' + result}\n"


CASES = [
    (record(1), "accepted", None),
    (record(2, Variant="Atomic"), "excluded", "unsupported_variant"),
    (record(3, event="Casual game"), "excluded", "not_rated"),
    (record(4, FEN="8/8/8/8 w - - 0 1"), "excluded", "nonstandard_start"),
    (record(5, SetUp="1"), "excluded", "nonstandard_start"),
    (record(6, site="https://example.org/x"), "quarantine", "required_header"),
    (record(7, result="2-0"), "quarantine", "required_header"),
    (record(8, body="1. e4 e5"), "quarantine", "missing_or_mismatched_termination"),
    (record(9, body=""), "quarantine", "missing_or_mismatched_termination"),
    (record(10, body="1. e4 { 1-0 } e5 0-1"), "quarantine", "missing_or_mismatched_termination"),
    (record(11, UTCDate="2013.13.01"), "quarantine", "invalid_utc"),
    (record(12, UTCDate="????.??.??"), "accepted", None),
    (record(13, WhiteElo="15x"), "quarantine", "invalid_rating"),
    (record(14, WhiteElo="?"), "accepted", None),
    (record(15, extra=("[broken]",)), "quarantine", "malformed_header"),
    (record(16, extra=('[White "Zoe"]',)), "quarantine", "malformed_header"),
    (record(17, result="*"), "accepted", None),
    (record(18, result="1/2-1/2", body="1. e4 ; note 0-1\n 1/2-1/2"), "accepted", None),
    (record(19, Variant="Atomic", event="Casual game"), "excluded", "unsupported_variant"),
]


@pytest.fixture(scope="module")
def classified(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "ordinal bigint, record string")
    return X.classify_record(df)


def test_first_rule_wins(classified):
    got = [(r.disposition, r.reason) for r in classified.orderBy("ordinal").collect()]
    assert got == [c[1:] for c in CASES]


def test_record_games_and_participants(classified):
    games = X.record_games(classified)
    first = games.where("source_ordinal = 0").first()
    assert (first.game_id, first.base_seconds, first.timestamp_precision) == ("00000001", 60, "second")
    assert first.marked_bot is False
    people = X.to_participants(games.where("source_ordinal in (0, 13, 16)")).collect()
    got = {(r.game_id, r.color): (r.player_key, r.rating, r.opponent_rating, r.score) for r in people}
    assert got[("00000001", "white")] == ("ann", 1500, 1600, 1.0)
    assert got[("00000014", "black")] == ("bob", 1600, None, 0.0)
    assert got[("00000017", "black")][3] is None


def test_route_dispositions(classified):
    accepted, aside, counts = X.route_dispositions(classified, ["ordinal"])
    assert accepted.count() + aside.count() == len(CASES)
    assert counts.agg(F.sum("records")).first()[0] == len(CASES)
    assert aside.where("ordinal = 1").first().raw == CASES[1][0]


def test_raw_recount(spark):
    texts = [record(1), record(2, result="1/2-1/2", Opening="A: b"), record(3, WhiteTitle="BOT", Opening="C"),
             record(4, result="*"), record(5, Opening=" : x"), record(6, event="Casual")]
    df = spark.createDataFrame(list(enumerate(texts)), "ordinal bigint, record string")
    got = X.raw_recount(X.classify_record(df)).first().asDict()
    assert got == {"accepted_games": 5, "eligible_games": 3, "drawn_games": 1, "known_opening_games": 1,
                   "missing_source_opening": 2}


def test_first_tags_is_tolerant(spark):
    text = record(1, extra=("[broken]", '[White "Zoe"]'))
    df = spark.createDataFrame([(text,)], "record string")
    tags = X.first_tags(df).first().tags
    assert tags["White"] == "Ann" and "broken" not in tags
    assert X.parse_tags(df).first().tag_reason == "malformed_header"


def test_body_starts_at_the_first_plain_line(spark):
    text = '[Event "x"]\n\n[Site "y"]\n  [not a tag]\n[White "z"]\n'
    got = X.parse_tags(spark.createDataFrame([(text,)], "record string")).first()
    assert got.tags == {"Event": "x", "Site": "y"}
    assert got.body.startswith("  [not a tag]")


def test_annotations(spark, rows):
    body = "1. e4 { [%eval 0.17] [%clk 1:02:03] } e5 { [%eval #-3] } 2. Nf3 { [%clk 0:00:00.5] } Nc6 { [%eval -1.29] }"
    df = spark.createDataFrame([(1, body)], "ordinal int, body string")
    assert rows(X.extract_annotations(df, keys=["ordinal"]), "ply") == [
        (1, 1, 3723.0, 17, False), (1, 2, None, None, True), (1, 3, 0.5, None, False), (1, 4, None, -129, False)]


def test_read_records_numbers_each_file(spark, tmp_path):
    texts = {"a.txt": [record(i) for i in range(40)], "b.txt": ["\n\n" + record(100)] + [record(i) for i in range(101, 120)]}
    for name, parts in texts.items():
        (tmp_path / name).write_text("\n".join(parts))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        got = X.read_records(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
        found = {(r.file.rsplit("/", 1)[1], r.ordinal): r.record.strip() for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = {(n, i): p.strip() for n, parts in texts.items() for i, p in enumerate(parts, 1)}
    assert found == want


def test_first_complete(spark, rows):
    data = [("a", i) for i in range(1, 6)] + [("b", 1), ("b", 2)]
    df = spark.createDataFrame(data, "file string, ordinal bigint")
    assert rows(X.first_complete(df, 3), "file", "ordinal") == [("a", 1), ("a", 2), ("a", 3), ("b", 1)]
    # A file that ends before the cap: its last record may be cut off.
    assert rows(X.first_complete(df, 9), "file", "ordinal") == [("a", i) for i in range(1, 5)] + [("b", 1)]
    one = df.where("file = 'a'").select("ordinal")
    assert rows(X.first_complete(one, 9, ["ordinal"]), "ordinal") == [(1,), (2,), (3,), (4,)]


def test_copies_over_several_files(spark, tmp_path):
    texts = {"a.txt": [record(1), record(2)], "b.txt": [record(1), record(3)], "c.txt": [record(2) + "{x}", record(3)]}
    for name, parts in texts.items():
        (tmp_path / name).write_text("\n".join(parts))
    stored = X.classify_record(X.read_records(spark, str(tmp_path))).cache()
    got = {(r.file[-5], r.ordinal): r.disposition for r in X.resolve_copies(stored).collect()}
    first, second = ("accepted", "accepted"), ("duplicate", "accepted")
    assert (got["a", 1], got["a", 2]) == first and (got["b", 1], got["b", 2]) == second
    assert got["c", 2] == "duplicate" and got["c", 1] in ("conflict", "quarantine") and len(got) == 6


def test_text_is_read_without_being_shuffled(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n".join(record(i) for i in range(30)))
    plan = X.read_records(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        assert "Exchange hashpartitioning" not in line or "record" not in line
    assert "SortMergeJoin" not in plan


def test_tag_lines_end_with_the_bracket(spark, rows):
    texts = ['[Event "Rated x"] \n\n1-0', '[Event "Rated x"]\r\n\r\n1-0']
    df = spark.createDataFrame([(t,) for t in texts], "record string")
    assert [r[0] for r in rows(X.parse_tags(df).select("tag_reason"))] == ["malformed_header", None]


def test_restore_identity(spark, rows):
    text = '[Event "x"]\n[Site "?"]\n[LichessURL "https://lichess.org/abcdefgh"]\n\n1-0\n'
    df = spark.createDataFrame([(text,), ('[Event "x"]\n1-0\n',)], "record string")
    got = rows(X.restore_identity(df).select("record", "identity_reason"))
    assert got[0][0].splitlines()[:2] == ['[Event "x"]', '[Site "https://lichess.org/abcdefgh"]']
    assert got[0][0].count("[Site ") == 1 and got[0][1] is None
    assert got[1] == ('[Event "x"]\n1-0\n', "no_unambiguous_identity")
    odd = ['[Event "x"]\n[LichessURL "http://lichess.org/abcdefgh"]\n', '[Event "x"]\n[LichessURL "https://lichess.org/abcdefgh"] \n']
    two = '[Event "x"]\n[Site "?"]\n[LichessURL "https://lichess.org/abcdefgh"]\n[Site "second"]\n'
    got = rows(X.restore_identity(spark.createDataFrame([(t,) for t in [*odd, two]], "record string")).select("record", "identity_reason"))
    assert [r[1] for r in got] == ["no_unambiguous_identity"] * 2 + [None]
    assert got[2][0].count("[Site ") == 2 and '[Site "second"]' in got[2][0]


COPIES = [(1, "a", "f1"), (2, "a", "f1"), (3, "b", "f2"), (4, "b", "f3"), (5, "b", "f2"), (6, "c", "f9")]


def test_dedupe_or_conflict(spark):
    df = spark.createDataFrame(COPIES, "ordinal bigint, id string, fingerprint string").repartition(3)
    got = {r.ordinal: r.status for r in H.dedupe_or_conflict(df, ["id"]).collect()}
    assert got == {1: "accepted", 2: "duplicate", 3: "accepted", 4: "conflict", 5: "duplicate", 6: "accepted"}
    totals = H.status_totals(H.dedupe_or_conflict(df, ["id"]), ["accepted", "duplicate", "conflict"])
    assert I.reconcile_counts(totals, parts=("accepted", "duplicate", "conflict")).first().difference == 0


def test_conflict_withholds_all_copies(spark):
    df = spark.createDataFrame(COPIES, "ordinal bigint, id string, fingerprint string")
    got = {r.ordinal: r.status for r in H.withhold_conflicts(df, ["id"]).collect()}
    assert got == {1: "accepted", 2: "duplicate", 3: "conflict", 4: "conflict", 5: "conflict", 6: "accepted"}


def test_dedupe_by_rank(spark, rows):
    df = spark.createDataFrame(
        [("p", "a", 1, "1-0", None), ("p", "a", 0, "1-0", None), ("p", "b", 2, "1-0", 7), ("p", "b", 1, "0-1", 7)],
        "provider string, game_id string, source_rank int, result string, r int")
    assert rows(H.dedupe_by_rank(df).select("game_id", "source_rank"), "game_id") == [("a", 0), ("b", 1)]
    assert rows(H.cross_source_conflicts(df, ["result", "r"]).select("game_id", "versions")) == [("b", 2)]


def test_hot_ids_take_the_other_way_to_the_same_result(spark):
    from tallyboard.operators import joins as D

    data = [(i, "hot" if i % 3 else f"k{i % 7}", f"f{i % 2}") for i in range(300)]
    df = spark.createDataFrame(data + [(999, None, "f")], "ordinal bigint, id string, fingerprint string")
    summary = df.groupBy("id").agg(F.max("ordinal").alias("last"), F.count("*").alias("n"))
    cold = D.join_back(df, summary, ["id"], "n")
    hot = D.join_back(df, summary, ["id"], "n", hot_rows=20)
    assert cold.columns == hot.columns == ["ordinal", "id", "fingerprint", "last"]
    assert sorted(map(tuple, cold.collect())) == sorted(map(tuple, hot.collect()))
    assert hot.count() == 300


def test_summaries_reach_rows_with_maps(spark):
    from tallyboard.operators import joins as D

    df = spark.createDataFrame([(1, {"a": 1}), (1, {"b": 2}), (2, {})], "k int, m map<string,int>")
    summary = df.groupBy("k").agg(F.count("*").alias("n"), F.lit("s").alias("v"))
    assert D.join_back(df, summary, ["k"], "n").count() == 3


def test_a_part_is_written_by_many_tasks(spark, monkeypatch):
    """Files of a part hold ranges of ordinals; records are numbered on from file to file."""
    from types import SimpleNamespace

    from tallyboard.plans import store_plans

    monkeypatch.setattr(store_plans, "RECORDS_A_FILE", 20, raising=False)
    df = spark.range(1, 241).select((F.col("id") % 3).cast("int").alias("part"), F.col("id").alias("ordinal"))
    df = df.withColumn("record", F.concat(F.lit('[Event "x"]\n[Site "'), "ordinal", F.lit('"]\n\n1-0'))).repartition(5)
    got = store_plans.written_in_parts(SimpleNamespace(spark=spark), df)
    site = F.regexp_extract("record", r'Site "(\d+)"', 1).cast("int").alias("site")
    found = [tuple(r) for r in got.select("part", "ordinal", site, "file").collect()]
    want = {(p, i, s) for p in range(3) for i, s in enumerate([s for s in range(1, 241) if s % 3 == p], 1)}
    assert {f[:3] for f in found} == want and len(found) == 240
    assert all(len({f[3] for f in found if f[0] == p}) > 1 for p in range(3))
