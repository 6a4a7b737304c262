"""Quality gates, increments, text records, typed storage and training."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyboard.functions import scalars as S
from tallyboard.operators import dedupe as H
from tallyboard.operators import filters as C
from tallyboard.operators import incremental as K
from tallyboard.operators import joins as D
from tallyboard.operators import metrics as E
from tallyboard.operators import ml as J
from tallyboard.operators import quality as I
from tallyboard.plans.bindings import Tables
from tallyboard.plans.catalog import query
from tallyboard.plans.cube_plans import CUBE, CUBE_VIEWS, stored_cube
from tallyboard.plans.facts import MOVE_EVALS_SQL, PLAYER_FLAGS_SQL
from tallyboard.schemas import FACT_PLAYER_GAME
from tallyboard.session import materialize, scratch_path, stored_table
from tallyboard.sources import tables as A
from tallyboard.sources import text as X

# --- quality -----------------------------------------------------------------------


@query(
    "i01_run_checks",
    """unpivot (select sum((copies>1)::int)::bigint unique_game_keys, sum(repeated)::bigint unique_player_keys, coalesce(sum(lacking),0)::bigint required_game_fields,
    sum((copies>0 and (held*copies<>2 or colors<>2))::int)::bigint two_participants, coalesce(sum(case when copies is null then held end),0)::bigint no_orphans,
    coalesce(sum(wrong),0)::bigint participant_scores, coalesce(sum((total<>1)::int),0)::bigint score_conservation, coalesce(abs(sum(won-lost)),0)::bigint wins_equal_losses,
    sum((colors=2 and (wr is distinct from bo or br is distinct from wo))::int)::bigint rating_symmetry from per_game)
    on columns(*) into name "check" value failures""",
    "gp p",
    """gq as (select * from gp where source_ordinal%101<>0 union all select * from gp where source_ordinal%211=0),
    pq as (select * replace(case when rating=1000 then 1 else rating end as rating,
    case when color='white' and rating=1111 then 0.5 else score end as score) from p
    where not (color='black' and rating=1500)),
    right_score as (select * from (values ('1-0','white',1.0),('1-0','black',0.0),('0-1','white',0.0),('0-1','black',1.0),
    ('1/2-1/2','white',0.5),('1/2-1/2','black',0.5)) v(result, color, due)),
    gs as (select provider, game_id, count(*) copies, min(result) result,
    sum(1-(rated and variant='Standard' and source_ordinal>=1)::int) lacking from gq group by all),
    per_game as (select provider, game_id, copies, lacking, count(color) held, count(distinct color) colors, count(color)-count(distinct color) repeated,
    sum(score) total, coalesce(sum((score=1)::int),0) won, coalesce(sum((score=0)::int),0) lost,
    sum(case when color is not null and score is distinct from due then copies end) wrong,
    max(case color when 'white' then rating end) wr, max(case color when 'white' then opponent_rating end) wo,
    max(case color when 'black' then rating end) br, max(case color when 'black' then opponent_rating end) bo
    from gs full join pq using (provider, game_id) left join right_score using (result, color) group by all)""",
)
def _(t: Tables):
    k = F.col("source_ordinal")
    games = t.games_plies.where(k % 101 != 0).unionByName(t.games_plies.where(k % 211 == 0))
    players = t.players.where(~((F.col("color") == "black") & (F.col("rating") == 1500))).withColumns(
        {
            "score": F.when((F.col("color") == "white") & (F.col("rating") == 1111), 0.5).otherwise(
                F.col("score")
            ),
            "rating": F.when(F.col("rating") == 1000, 1).otherwise(F.col("rating")),
        }
    )
    return I.run_checks(games, players)


DUP = """dd as (select doc_id ordinal, lang || ':' || n_chars k, sha256(text) fingerprint from documents),
df as (select k, min(ordinal) first, min_by(fingerprint, ordinal) fp, count(distinct fingerprint) n from dd group by 1)"""


def copies(t: Tables):
    # Language and length play the id: copies share it, and so do some other texts.
    return t.texts.select(
        F.col("doc_id").alias("ordinal"),
        F.concat_ws(":", "lang", F.col("n_chars").cast("string")).alias("k"),
        F.sha2("text", 256).alias("fingerprint"),
    )


@query(
    "h01_dedupe_or_conflict",
    """select ordinal, case when ordinal=first then 'accepted' when fingerprint=fp then 'duplicate'
    else 'conflict' end status from dd join df using (k)""",
    "",
    DUP,
)
def _(t: Tables):
    return H.dedupe_or_conflict(copies(t), ["k"]).select("ordinal", "status")


@query(
    "h04_withhold_conflicts",
    """select ordinal, case when n>1 then 'conflict' when ordinal=first then 'accepted' else 'duplicate' end status
    from dd join df using (k)""",
    "",
    DUP,
)
def _(t: Tables):
    return H.withhold_conflicts(copies(t), ["k"]).select("ordinal", "status")


@query(
    "i02_reconcile_counts",
    """select count(*) seen, count(*) filter (where ordinal=first) accepted,
    count(*) filter (where ordinal<>first and fingerprint=fp) duplicate, 0::bigint excluded, 0::bigint quarantine,
    count(*) filter (where ordinal<>first and fingerprint<>fp) conflict, 0::bigint difference
    from dd join df using (k)""",
    "",
    DUP,
)
def _(t: Tables):
    names = ["accepted", "duplicate", "excluded", "quarantine", "conflict"]
    return I.reconcile_counts(H.status_totals(H.dedupe_or_conflict(copies(t), ["k"]), names))


@query(
    "i03_column_tests",
    """select 'not_null:player_key' as "check", (select count(*) from p where player_key is null) failures
    union all select 'accepted_values:color', (select count(*) from p where color not in ('white'))
    union all select 'unique:player_key', (select count(*) from (select player_key from p where player_key is not null group by 1 having count(*)>1))
    union all select 'relationships:game_id', (select count(*) from p where game_id not in (select game_id from gx where eligible))""",
    "g p",
)
def _(t: Tables):
    rules = [
        I.Rule("player_key", "not_null"),
        I.Rule("color", "accepted_values", ("white",)),
        I.Rule("player_key", "unique"),
        I.Rule("game_id", "relationships", (), t.games.where(C.eligible()), "game_id"),
    ]
    return I.column_tests(t.players, rules)


@query(
    "i04_model_tests",
    """select 'opening_family_shape' as "check", (select count(*) from gx where source_ordinal%100=1) failures
    union all select 'move_evals_valid', (select count(*) from me where evaluable and clamped_deterioration>900)
    union all select 'move_key_unique', 0 where (select count(*) from me) > 0""",
    "mf",
    MOVE_EVALS_SQL,
)
def _(t: Tables):
    games = C.staged_games(t.games).withColumn(
        "opening_family",
        F.when(F.col("source_ordinal") % 100 == 1, "a:b").otherwise(F.col("opening_family")),
    )
    evals = D.move_evals(t.move_facts, t.games)
    spoiled = evals.withColumn(
        "clamped_deterioration",
        F.when(F.col("clamped_deterioration") > 900, -1).otherwise(F.col("clamped_deterioration")),
    )
    return I.model_tests(games, spoiled)


@query(
    "i05_schema_contract",
    """select * from (values ('provider','ok',(select count(*) from p)),('game_id','retyped',(select count(*) from p)),
    ('color','ok',(select count(color) from p)),('player_key','missing',0::bigint),
    ('owner','extra',(select count(player_key) from p)),('rating','ok',(select count(rating) from p)),
    ('opponent_rating','ok',(select count(opponent_rating) from p)),('score','ok',(select count(score) from p)))
    t("column", status, "values")""",
    "p",
)
def _(t: Tables):
    changed = (
        A.apply_schema(t.players, FACT_PLAYER_GAME)
        .withColumnRenamed("player_key", "owner")
        .withColumn("game_id", F.col("game_id").cast("bigint"))
    )
    return I.schema_contract(changed, FACT_PLAYER_GAME)


@query(
    "i06_validate_moves",
    """select 'rows_or_last_ply' as "check", (select count(*) from (select game_id, count(*) n, max(ply) l,
    any_value(ply_count) e from mq join gp using (provider, game_id) group by 1) where n<>e or l<>e) failures
    union all select 'broken_sequence', (select count(*) from (select game_id, count(*) n, max(ply) l, min(ply) f,
    count(distinct ply) d from mq group by 1) where not (n=l and f=1 and n=d))
    union all select 'repeated_ply', (select count(*) from (select 1 from mq group by game_id, ply having count(*)<>1))""",
    "gp m",
    "mq as (select * from m where uci<>'3' union all select * from m where uci='5' and ply=2)",
)
def _(t: Tables):
    moves = t.moves.where("uci <> '3'").unionByName(t.moves.where("uci = '5' and ply = 2"))
    return I.validate_moves(moves, t.games_plies)


@query(
    "i07_public_check",
    """select 'name:game_id' as "check", count(*)::bigint failures from g union all
    select 'leak:game_id', 0 from (select 1 limit 1) union all select 'leak:result', 0 from (select 1 limit 1) union all
    select 'leak:opening', count(*) filter (where source_opening like '%line 3') from g union all
    select 'allowed:result', count(*) filter (where result='*') from g union all
    select 'pattern:opening', count(*) filter (where source_opening like '%line 3' or trim(source_opening)='') from g""",
    "g",
)
def _(t: Tables):
    rows = t.games.select(
        "game_id",
        "result",
        F.regexp_replace("source_opening", "line 3$", "/data/x.json").alias("opening"),
    )
    return I.public_check(
        rows, {"result": S.COMPLETED}, {"opening": r"^[A-Z -]+: line [0-9]$"}
    )


@query(
    "i09_compare_reports",
    """select base_seconds, left_games, right_games from (select base_seconds, count(*) left_games from gx
    where eligible group by 1) a full join (select base_seconds, count(*) right_games from gx
    where eligible and not (base_seconds=60 and source_ordinal%2=0) group by 1) b using (base_seconds)
    where left_games is distinct from right_games""",
    "g",
)
def _(t: Tables):
    left = t.games.where(C.eligible()).groupBy("base_seconds").agg(F.count("*").alias("games"))
    right = (
        E.outcomes_by(
            t.games.where((F.col("base_seconds") != 60) | (F.col("source_ordinal") % 2 != 0))
        )
        .groupBy("base_seconds")
        .agg(F.sum("eligible_games").alias("games"))
    )
    return I.compare_reports(left, right, ["base_seconds"], ["games"])


@query(
    "i10_gated_write",
    """select 'clean' attempt, true written, count(*)::bigint stored from p union all
    select 'broken', false, 0::bigint""",
    "p",
)
def _(t: Tables):
    rows = []
    for name, key in (("clean", "game_id"), ("broken", "player_key")):
        path = scratch_path(t.spark, "gate")
        try:
            I.gated_write(t.players, I.column_tests(t.players, [I.Rule(key, "not_null")]), path)
            stored = t.spark.read.parquet(path)
        except I.QualityError:
            stored = t.players.where(F.lit(False))
        rows.append(
            stored.agg(F.count("*").alias("stored")).select(
                F.lit(name).alias("attempt"), (F.col("stored") > 0).alias("written"), "stored"
            )
        )
    return rows[0].unionByName(rows[1])


@query(
    "i12_within_tolerance",
    """select id, expected, actual from (select id, case when id%11=0 then null else probability end expected,
    case when id%7=0 then null when id%5=0 then probability+0.02 else probability+0.001 end actual, source from c)
    where source='src2' or (expected is null)<>(actual is null) or abs(expected-actual)>0.01""".replace(
        "select id, expected, actual from", "select id, expected, case when source='src2' then null else actual end actual from"
    ),
    "c",
)
def _(t: Tables):
    i, p = F.col("id"), F.col("probability")
    expected = t.classified.select("id", F.when(i % 11 != 0, p).alias("v"))
    actual = t.classified.where("source <> 'src2'").select(
        "id", F.when(i % 7 == 0, None).when(i % 5 == 0, p + 0.02).otherwise(p + 0.001).alias("v")
    )
    return I.within_tolerance(expected, actual, "id", "v", 0.01)


@query(
    "i13_rederive_totals",
    """select run, 'passed' total, count(*) filter (where passed)+1::double stored, count(*) filter (where passed)::double derived
    from r where run='click' group by 1 union all select run, 'cases', 1000::double, count(distinct case_id)::double
    from r where run='view' group by 1""",
    "r",
)
def _(t: Tables):
    rows = t.attempts
    header = rows.groupBy("run").agg(
        F.count("*").alias("rows"),
        (F.count_if("passed") + F.when(F.col("run") == "click", 1).otherwise(0)).alias("passed"),
        (F.count_if("passed") / F.count("*")).alias("pass_rate"),
        F.sum("cost").alias("cost"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.count_if("high_severity_miss").alias("high_severity_misses"),
        F.count_if("unsafe_answer").alias("unsafe_answers"),
        F.count_if("over_abstention").alias("over_abstentions"),
        F.bool_or("high_severity_miss").alias("hard_fail"),
        F.when(F.col("run") == "view", 1000).otherwise(F.count_distinct("case_id")).alias("cases"),
    )
    return I.rederive_totals(header, rows)


@query(
    "e48_column_missingness",
    """select min(utc_date) first_date, max(utc_date) last_date, c as "column", case c when 'source_opening' then
    count(*) filter (where source_opening is null) else count(*) filter (where utc_date is null) end missing
    from g, (values ('source_opening'),('utc_date')) t(c) group by c""",
    "g",
)
def _(t: Tables):
    return I.column_missingness(t.games, ["source_opening", "utc_date"], "utc_date")


# --- typed storage -----------------------------------------------------------------


@query("a04_write_read_typed", "select * from p", "p")
def _(t: Tables):
    path = scratch_path(t.spark, "typed")
    A.write_typed(t.players, path, FACT_PLAYER_GAME)
    return A.read_typed(t.spark, path, FACT_PLAYER_GAME)


@query(
    "a09_read_labelled_text",
    """select lang label, case when quality=1 then 'dev' else 'test' end split, count(*) cases
    from labels join documents using (doc_id) group by 1,2""",
)
def _(t: Tables):
    folder = scratch_path(t.spark, "cases")
    cases = t.raw("labels").join(t.texts, "doc_id").select(
        F.col("doc_id").cast("string").alias("id"),
        F.when(F.col("quality") == 1, "dev").otherwise("test").alias("split"),
        F.col("lang").alias("label"),
        F.regexp_replace("text", r'[\s"\\]+', " ").alias("question"),
    )
    cases.write.option("header", True).csv(folder, sep="\t")
    return A.label_split_counts(A.read_labelled_text(t.spark, folder))


@query(
    "a09_labelled_text_issues",
    """select count(*) cases, count(*) filter (where lang not in ('en','fr','de')) bad_label, 0::bigint bad_split,
    0::bigint blank, 0 labels_absent, 0::bigint repeated_ids from labels join documents using (doc_id)""",
)
def _(t: Tables):
    cases = t.raw("labels").join(t.texts, "doc_id").select(
        F.col("doc_id").alias("id"),
        F.lit("dev").alias("split"),
        F.col("lang").alias("label"),
        F.col("text").alias("question"),
    )
    return A.labelled_text_issues(cases, ["en", "fr", "de"]).withColumn(
        "labels_absent", F.col("labels_absent").cast("int")
    )


@query(
    "a10_read_run_receipts",
    """select run_id, i::int attempt, case_id, passed, cost gross_cost_usd, event_id%1000 input_tokens from
    (select 'e' || event_id run_id, event_id, case i when 0 then 'c' || user_id else 'd' || user_id end case_id,
    case i when 0 then value<300 else value<100 end passed, case i when 0 then value/10000 end as cost, i
    from events, (values (0),(1)) t(i))""",
)
def _(t: Tables):
    folder = scratch_path(t.spark, "receipts")
    e = t.raw("events")

    def row(prefix: str, limit: int, cost):
        return F.struct(
            F.concat(F.lit(prefix), F.col("user_id").cast("string")).alias("case_id"),
            (F.col("value") < limit).alias("passed"),
            cost.cast("double").alias("gross_cost_usd"),
            F.struct((F.col("event_id") % 1000).alias("input_tokens")).alias("usage"),
        )

    receipts = e.select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("run_id"),
        F.array(row("c", 300, F.col("value") / 10000), row("d", 100, F.lit(None))).alias("rows"),
    )
    receipts.write.json(folder)  # one receipt per line
    got = A.read_run_receipts(t.spark, folder, multi_line=False)
    return got.select("run_id", "attempt", "case_id", "passed", "gross_cost_usd", "input_tokens")


GAME_ROW = T.StructType(
    [T.StructField("game_id", T.StringType()), T.StructField("base_seconds", T.LongType())]
)


@query("a11_extract_tables", "select game_id, base_seconds from g", "g")
def _(t: Tables):
    docs = t.games.select(
        F.to_json(F.array(F.struct("game_id", "base_seconds", "result"))).alias("games")
    )
    return A.extract_table_from(docs, "games", GAME_ROW)


@query(
    "a11_infer_column_types",
    """select * from (values ('order','bigint'),('price','double'),('day','date'),('status','string'),('flag','boolean'))
    t("column", "type") where (select count(*) from orders)>0""",
)
def _(t: Tables):
    texts = t.raw("orders").select(
        F.col("o_orderkey").cast("string").alias("order"),
        F.col("o_totalprice").cast("decimal(15,2)").cast("string").alias("price"),
        F.to_date("o_orderdate").cast("string").alias("day"),
        F.col("o_orderstatus").alias("status"),
        (F.col("o_orderkey") % 2 == 0).cast("string").alias("flag"),
    )
    return A.infer_column_types(texts)


@query(
    "a12_time_spine",
    """select d::date date_day, count(g.game_id) games from (select unnest(generate_series((select min(utc_date) from g),
    (select max(utc_date) from g), interval 1 day)) d) left join g on g.utc_date=d::date group by 1""",
    "g",
)
def _(t: Tables):
    spine = A.time_spine_of(t.games, "utc_date")
    daily = t.games.groupBy(F.col("utc_date").alias("date_day")).agg(F.count("*").alias("games"))
    return spine.join(daily, "date_day", "left").withColumn("games", F.coalesce("games", F.lit(0)))


@query(
    "a13_synthetic_facts",
    """select printf('%08x', o_orderkey) game_id, c.color, 'lichess:p' || printf('%05d', case when c.color='white'
    then (o_orderkey+1)%4000 else (o_orderkey+18)%4000 end) player_key,
    case when c.color='white' then 1200+(o_orderkey+1)%800 else 1200+((o_orderkey+1)*3)%800 end rating,
    case o_orderkey%5 when 3 then null when 2 then 0.5 when 1 then (c.color='black')::int else (c.color='white')::int end::double as score,
    date '2013-01-01' + (o_orderkey%400)::int utc_date from orders, (values ('white'),('black')) c(color)""",
)
def _(t: Tables):
    games = A.synthetic_games(t.raw("orders"), "o_orderkey")
    players = A.synthetic_players(games)
    return players.join(games.select("game_id", "utc_date"), "game_id").select(
        "game_id", "color", "player_key", "rating", "score", "utc_date"
    )


# --- text records ------------------------------------------------------------------


#: Records, about, that one task sorts and writes.
RECORDS_A_FILE = 50_000


def written_in_parts(t: Tables, rows):
    """The records of ``rows`` (part, ordinal, record) as one folder for each part, in order.

    A part is cut into files by ranges of ordinals; Spark names them in the order of the ranges.
    """
    folder = scratch_path(t.spark, "records")
    files = rows.count() // RECORDS_A_FILE + 1
    dealt = rows.repartitionByRange(files, "part", "ordinal").sortWithinPartitions("part", "ordinal")
    dealt.select("part", "record").write.partitionBy("part").text(folder)
    read = X.read_records(t.spark, folder, by_folder=True)
    return read.withColumn("part", F.regexp_extract("file", r"/part=(\d+)/", 1).cast("int"))


@query(
    "a01_read_records",
    """select (o_orderkey%3)::int part, row_number() over (partition by o_orderkey%3 order by o_orderkey) ordinal,
    'C' || o_custkey white, o_orderkey%61=0 casual from orders""",
)
def _(t: Tables):
    part = (F.col("ordinal") % 3).cast("int")
    got = written_in_parts(t, t.records.select(part.alias("part"), "ordinal", "record"))
    return got.select(
        "part",
        "ordinal",
        F.regexp_extract("record", r'\[White "(\w+)"\]', 1).alias("white"),
        F.col("record").startswith('[Event "Casual').alias("casual"),
    )


@query(
    "a02_parse_tags",
    """select o_orderkey ordinal, case when o_orderkey%67=0 then 'malformed_header' end tag_reason,
    case when o_orderkey%67<>0 then 'C' || o_custkey end white,
    case when o_orderkey%67<>0 then 10 + (o_orderkey%59=0)::int + (o_orderkey%50=0)::int
    + (o_orderkey%11<>0)::int end tags from orders""",
)
def _(t: Tables):
    tags = X.parse_tags(t.records)
    return tags.select(
        "ordinal",
        "tag_reason",
        F.col("tags").getItem("White").alias("white"),
        F.when(F.col("tags").isNotNull(), F.size("tags")).alias("tags"),
    )


@query(
    "a02_first_tags",
    """select o_orderkey ordinal, 'C' || o_custkey white, 10 + (o_orderkey%59=0)::int + (o_orderkey%50=0)::int
    + (o_orderkey%11<>0)::int tags from orders""",
)
def _(t: Tables):
    # A second White tag follows the first and must not replace it.
    doubled = t.records.withColumn(
        "record", F.regexp_replace("record", r"\[Black ", '[White "X"]\n[Black ')
    )
    tags = X.first_tags(doubled)
    return tags.select(
        "ordinal", F.col("tags").getItem("White").alias("white"), F.size("tags").alias("tags")
    )


@query(
    "a03_extract_annotations",
    """select k ordinal, i::int ply, case i when 1 then 60+k%60 when 2 then k%58 else 7 end::double clock_seconds,
    case i when 1 then k%100 when 2 then case when k%5=0 then null else -(k%7)*100 end end eval_cp,
    i=2 and k%5=0 eval_mate from (select o_orderkey k from orders), range(1,4) t(i)""",
)
def _(t: Tables):
    return X.extract_annotations(X.split_record(t.records), keys=["ordinal"])


CLASSIFIED = """ks as (select o_orderkey k, case when o_orderkey%67=0 then 'malformed_header'
  when o_orderkey%59=0 then 'unsupported_variant' when o_orderkey%61=0 then 'not_rated'
  when o_orderkey%79=0 then 'missing_or_mismatched_termination'
  when o_orderkey%29<>0 and o_orderkey%71=0 then 'invalid_utc'
  when o_orderkey%73=0 then 'invalid_rating' end reason from orders),
kc as (select k, reason, case when reason is null then 'accepted' when reason in ('unsupported_variant','not_rated')
  then 'excluded' else 'quarantine' end disposition from ks)"""


@query("b01_classify_record", "select k ordinal, reason, disposition from kc", "", CLASSIFIED)
def _(t: Tables):
    return X.classify_record(t.records).select("ordinal", "reason", "disposition")


@query(
    "a05_route_dispositions",
    "select disposition, reason, count(*) records from kc group by 1,2",
    "",
    CLASSIFIED,
)
def _(t: Tables):
    _, _, counts = X.route_dispositions(X.classify_record(t.records), ["ordinal"])
    return counts


@query(
    "a05_resolved_copies",
    """select 0 part, row_number() over (order by k) ordinal, disposition, reason from kc union all
    select 1, row_number() over (order by k, v), case when reason is not null then disposition
    when v=0 then 'duplicate' else 'conflict' end, coalesce(reason, case when v=0 then 'identical_game'
    else 'conflicting_game' end) from (select *, 0 v from kc where k%10=0 union all select *, 1 from kc where k%25=0)""",
    "",
    CLASSIFIED,
)
def _(t: Tables):
    # The second file repeats some games of the first, some of them with another move.
    k = F.col("ordinal")
    first = t.records.select(F.lit(0).alias("part"), (2 * k).alias("ordinal"), "record")
    twice = t.records.where(k % 10 == 0).select(F.lit(1).alias("part"), (2 * k).alias("ordinal"), "record")
    other = t.records.where(k % 25 == 0).select(
        F.lit(1).alias("part"),
        (2 * k + 1).alias("ordinal"),
        F.replace("record", F.lit("2. Nf3"), F.lit("2. Nc3")).alias("record"),
    )
    read = written_in_parts(t, first.unionByName(twice).unionByName(other))
    stored = materialize(X.classify_record(read), "classified")
    return X.resolve_copies(stored).select("part", "ordinal", "disposition", "reason")


@query(
    "a05_set_aside",
    "select k ordinal, disposition, reason, true kept_text from kc where disposition<>'accepted'",
    "",
    CLASSIFIED,
)
def _(t: Tables):
    _, aside, _ = X.route_dispositions(X.classify_record(t.records), ["ordinal"])
    return aside.select(
        "ordinal", "disposition", "reason", F.col("raw").startswith("[Event").alias("kept_text")
    )


@query(
    "b06_record_participants",
    """select substr(sha256(cast(k as varchar)),1,8) game_id, color, case when color='white' then 'c' || o_custkey
    when k%31=0 then null else 'd' || k end player_key, case when color='white' then case when k%23<>0
    then 800+k%1600 end else 900+k%1500 end rating, score from kc join orders on o_orderkey=k
    join p on p.game_id=cast(k as varchar), (select 1) where disposition='accepted'""",
    "p",
    CLASSIFIED,
)
def _(t: Tables):
    games = X.record_games(X.classify_record(t.records))
    return X.to_participants(games).select("game_id", "color", "player_key", "rating", "score")


@query(
    "a14_restore_identity",
    """select o_orderkey ordinal, case when o_orderkey%9=0 then 'no_unambiguous_identity' end identity_reason,
    case when o_orderkey%9<>0 then 'https://lichess.org/' || substr(sha256('u' || o_orderkey),1,8)
    else 'https://lichess.org/' || substr(sha256(cast(o_orderkey as varchar)),1,8) end site from orders""",
)
def _(t: Tables):
    k = F.col("ordinal")
    url = F.concat(
        F.lit('\n[LichessURL "https://lichess.org/'),
        F.substring(F.sha2(F.concat(F.lit("u"), k.cast("string")), 256), 1, 8),
        F.lit('"]\n[White '),
    )
    other = t.records.withColumn(
        "record",
        F.when(k % 9 == 0, F.col("record")).otherwise(
            F.replace("record", F.lit("\n[White "), url)
        ),
    )
    fixed = X.restore_identity(other)
    site = F.regexp_extract("record", r'(?m)\A\[Event [^\n]*\n\[Site "([^"]*)"\]', 1)
    return fixed.select("ordinal", "identity_reason", site.alias("site"))


@query(
    "g03_first_complete",
    """select (o_orderkey%2)::int as file, o_orderkey+1 ordinal from orders x where o_orderkey+1<=20000
    and o_orderkey<(select max(o_orderkey) from orders y where y.o_orderkey%2=x.o_orderkey%2)""",
)
def _(t: Tables):
    k = F.col("ordinal")
    rows = t.records.select((k % 2).cast("int").alias("file"), (k + 1).alias("ordinal"))
    return X.first_complete(rows, 20000)


@query(
    "i11_raw_recount",
    """select count(*) accepted_games, count(*) filter (where eligible) eligible_games,
    count(*) filter (where eligible and result='1/2-1/2') drawn_games,
    count(*) filter (where eligible and family is not null) known_opening_games,
    count(*) filter (where source_opening is null or trim(source_opening)='') missing_source_opening
    from gx join kc on k=source_ordinal where disposition='accepted'""",
    "g",
    CLASSIFIED,
)
def _(t: Tables):
    return X.raw_recount(X.classify_record(t.records))


# --- increments --------------------------------------------------------------------


def cut(t: Tables) -> int:
    """The ordinal up to which the stored table was loaded: nine tenths of them."""
    return int(t.games.agg(F.max("source_ordinal")).first()[0] * 0.9)


CUT = "(select cast(floor(max(source_ordinal)*0.9) as bigint) from gx)"
INC = f"""{PLAYER_FLAGS_SQL}, pfo as (select pf.*, source_ordinal from pf join gx using (game_key))"""


def player_table(t: Tables):
    games = C.staged_games(t.games).select("game_key", "source_ordinal")
    return C.player_flags(t.players, t.games).join(games, "game_key")


@query("k01_append_new", "select * from pfo", "g p", INC)
def _(t: Tables):
    # The load, the batch and its replay read one stored table, not the joins behind it.
    full, path = materialize(player_table(t), "player-table"), scratch_path(t.spark, "target")
    full.where(F.col("source_ordinal") <= cut(t)).write.parquet(path)
    K.append_new(path, full, "player_game_key")
    K.append_new(path, full, "player_game_key")  # a replay adds nothing
    return t.spark.read.parquet(path)


@query(
    "k02_upsert",
    f"""select player_game_key, case when source_ordinal > {CUT}/2 then 5.0::double else score end as score from pfo""",
    "g p",
    INC,
)
def _(t: Tables):
    full = player_table(t)
    last = cut(t)
    stored = full.where(F.col("source_ordinal") <= last)
    changed = full.where(F.col("source_ordinal") > last / 2).withColumn("score", F.lit(5.0))
    once = K.upsert(stored, changed, "player_game_key")
    return K.upsert(once, changed, "player_game_key").select("player_game_key", "score")


@query("k03_append_after", f"select * from pfo where source_ordinal > {CUT}", "g p", INC)
def _(t: Tables):
    return K.append_after(player_table(t), "source_ordinal", cut(t))


def replaced_days(t: Tables):
    """All rows by day, of which one day came again."""
    rows = C.player_flags(t.players, t.games).select(
        "player_game_key", "color", F.date_format("utc_date", "yyyy-MM-dd").alias("day"), F.lit(1).alias("v")
    )
    path = scratch_path(t.spark, "days")
    K.write_days(rows, path, "day")
    # One day comes again with half its rows; the other days keep their files.
    again = rows.where("day = '1996-03-09' and color <> 'white'").withColumn("v", F.lit(2))
    K.replace_days(again, path, "day")
    return t.spark.read.parquet(path).select("player_game_key", F.date_format("day", "yyyy-MM-dd").alias("day"), "v")


@query(
    "k04_replace_days",
    """select player_game_key, strftime(utc_date, '%Y-%m-%d') as day, case when again then 2 else 1 end v
    from (select *, coalesce(utc_date = date '1996-03-09', false) again from pf) where not (again and color='white')""",
    "g p",
    PLAYER_FLAGS_SQL,
)
def _(t: Tables):
    return replaced_days(t)


@query(
    "k05_verify_equivalence",
    """select 'append' step, count(*) incremental_rows, count(*) rebuilt_rows, true equal from pf union all
    select 'replay', count(*), count(*), true from pf union all
    select 'replay_without_key', count(*)+count(*) filter (where utc_date >= date '1998-01-01'), count(*), false from pf""",
    "g p",
    PLAYER_FLAGS_SQL,
)
def _(t: Tables):
    full = C.player_flags(t.players, t.games)
    late = F.col("utc_date") >= F.lit("1998-01-01").cast("date")
    stored, batch = full.where(~late), full.where(late)
    appended = stored.unionByName(K.new_rows(stored, full, "player_game_key"))
    replayed = K.upsert(appended, batch, "player_game_key")
    careless = appended.unionByName(batch)
    out = None
    for step, df in (
        ("append", appended),
        ("replay", replayed),
        ("replay_without_key", careless),
    ):
        row = K.verify_equivalence(df, full).withColumn("step", F.lit(step))
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "e44_content_checksum",
    """select count(*) as rows, cast(sum(('0x' || substr(h,1,15))::bigint) as varchar) digest_a,
    cast(sum(('0x' || substr(h,16,15))::bigint) as varchar) digest_b from (select sha256(
    '5:color=' || coalesce(length(color) || ':' || color, '-') || '7:game_id=' || coalesce(length(game_id) || ':' || game_id, '-') || '15:opponent_rating=' || coalesce(length(opponent_rating::varchar) || ':' || opponent_rating::varchar, '-') || '10:player_key=' || coalesce(length(player_key) || ':' || player_key, '-') || '8:provider=' || coalesce(length(provider) || ':' || provider, '-') || '6:rating=' || coalesce(length(rating::varchar) || ':' || rating::varchar, '-') || '5:score=' || coalesce(length(score::varchar) || ':' || score::varchar, '-')) h
    from (select * replace (case when game_id::bigint%3=0 then player_key || '|' || color else player_key end as player_key) from p))""",
    "p",
)
def _(t: Tables):
    # Some values hold the mark that a plain join of columns would use.
    marked = F.when(F.col("game_id").cast("bigint") % 3 == 0, F.concat("player_key", F.lit("|"), "color"))
    return K.content_checksum(t.players.withColumn("player_key", F.coalesce(marked, "player_key")))


@query(
    "e44_near_tables",
    """select * from (values ('moved_mark', false), ('null_as_text', false), ('other_names', false), ('reordered', true))
    t(pair, equal) where (select count(*) from orders)>0""",
)
def _(t: Tables):
    """Tables that differ only where a careless digest would not show it."""
    o = t.raw("orders").select(F.col("o_orderkey").cast("string").alias("k"), "o_orderstatus")
    a = o.select(F.concat("k", F.lit("|x")).alias("a"), F.col("o_orderstatus").alias("b"))
    b = o.select(F.col("k").alias("a"), F.concat(F.lit("x|"), F.col("o_orderstatus")).alias("b"))
    null = o.select("k", F.lit(None).cast("string").alias("b"))
    text = o.select("k", F.lit("-").alias("b"))
    pairs = {
        "moved_mark": (a, b),
        "null_as_text": (null, text),
        "other_names": (a, a.withColumnRenamed("b", "c")),
        "reordered": (a, a.select("b", "a").repartition(3)),
    }
    out = None
    for name, (x, y) in pairs.items():
        row = K.verify_equivalence(x, y).select(F.lit(name).alias("pair"), "equal")
        out = row if out is None else out.unionByName(row)
    return out


# --- training ----------------------------------------------------------------------

PREFIXES = {"1": "one", "1 2": "one-two", "4": "four", "4 4": "four-four"}
TRAIN = """ro as (select mf.game_id, mf.ply, color, clock_before_seconds, phase_proxy, error_proxy, centipawn_deterioration,
  string_agg(uci, ' ') over (partition by mf.game_id order by ply rows between unbounded preceding and 1 preceding) before
  from mf join g using (provider, game_id) where variant='Standard'),
tf as (select game_id, ply::int ply, color, clock_before_seconds, phase_proxy, error_proxy, 0 material_balance,
  case when starts_with(before || ' ', '1 2 ') then 'one-two' when starts_with(before || ' ', '4 4 ') then 'four-four'
  when starts_with(before || ' ', '1 ') then 'one' when starts_with(before || ' ', '4 ') then 'four' end opening_family
  from ro where centipawn_deterioration is not null)"""


@query("j01_training_frame", "select * from tf", "mf", TRAIN)
def _(t: Tables):
    return J.training_frame(t.move_facts, t.games, PREFIXES).drop("provider")


@query(
    "j01_training_issues",
    """select 0::bigint invalid_sequences, 0::bigint orphans, (select count(distinct game_id) from m join g using (provider, game_id)
    where variant<>'Standard') nonstandard, 0::bigint incomplete, 0::bigint label_disagreements""",
    "g m",
)
def _(t: Tables):
    return J.training_issues(t.move_facts, t.games_plies)


@query(
    "j02_grouped_split",
    """select game_id, ply, case when rk<=least((select count(distinct game_id) from tf)-1,
    ceil((select count(distinct game_id) from tf)*0.25)) then 'test' else 'train' end part from tf join
    (select game_id, row_number() over (order by sha256('20261031:' || game_id), game_id) rk
    from (select distinct game_id from tf)) using (game_id)""",
    "mf",
    TRAIN,
)
def _(t: Tables):
    frame = J.training_frame(t.move_facts, t.games, PREFIXES)
    return J.grouped_split(frame, "game_id").select("game_id", "ply", "part")


HOLDOUT = f"""{TRAIN},
hold as (select error_proxy::int as label from tf join
  (select game_id, row_number() over (order by sha256('20261031:' || game_id), game_id) rk, count(*) over () n
  from (select distinct game_id from tf)) using (game_id) where rk<=least(n-1, ceil(n*0.25)))"""


def holdout(t: Tables):
    """The scored holdout of the fitted trees, kept once per folder and session."""
    def fit():
        return J.fit_calibrated(J.training_frame(t.move_facts, t.games, PREFIXES))

    return stored_table(t.spark, (t.sf_dir, t.version, "holdout"), fit)


@query("j03_fit_calibrated")
def _(t: Tables):
    # The fitted numbers depend on the trees: SQL states the two queries after this one.
    return holdout(t)


@query(
    "j03_holdout_order",
    """select count(*) as rows, sum(label)::bigint positives, count(*) probabilities, 0::bigint out_of_order from hold""",
    "mf",
    HOLDOUT,
)
def _(t: Tables):
    return J.order_check(holdout(t))


@query(
    "j04_holdout_calibration",
    """select 5::bigint bins, count(*) as rows, sum(label)::bigint positives from hold""",
    "mf",
    HOLDOUT,
)
def _(t: Tables):
    # Counts and observed means of the bins give the holdout back.
    return J.evaluate_calibration(holdout(t), 5).agg(
        F.count("*").alias("bins"),
        F.sum("count").alias("rows"),
        F.round(F.sum(F.col("count") * F.coalesce("mean_observed", F.lit(0.0)))).cast("bigint").alias("positives"),
    )


@query(
    "j04_evaluate_calibration",
    """select i::int bin, i/5.0::double low, (i+1)/5.0::double high, count(c.id) as count, avg(probability) mean_predicted,
    avg(label) mean_observed, (select avg(power(probability-label,2)) from c) brier from range(0,5) b(i)
    left join c on least(floor(probability*5),4)=i group by 1,2,3""",
    "c",
)
def _(t: Tables):
    return J.evaluate_calibration(t.classified, 5)


@query(
    "i07_public_cube",
    """select 'leaks' as "check", 0::bigint failures, count(*)::bigint cells from cube""",
    CUBE_VIEWS,
    CUBE,
)
def _(t: Tables):
    cube = stored_cube(t)
    checks = I.public_check(cube)
    return checks.agg(F.sum("failures").alias("failures")).select(
        F.lit("leaks").alias("check"), "failures", cube.agg(F.count("*")).scalar().alias("cells")
    )



