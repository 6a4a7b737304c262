"""Receipts, nested reports, declared counts, lineage, joined metrics and raw recounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyboard.operators import cells as X
from tallyboard.operators import cube as Q
from tallyboard.operators import dedupe as H
from tallyboard.operators import filters as C
from tallyboard.operators import metrics as E
from tallyboard.operators import windows as W
from tallyboard.plans.bindings import Tables
from tallyboard.plans.catalog import query
from tallyboard.plans.cube_plans import BOUNDS, CELLS, CLOCK_GAMES, OUT, PERIOD, TRAINING
from tallyboard.plans.facts import CLOCK_AGGS, CLOCK_SQL, FAMILIES, FLAGS_SQL, PLAYER_FLAGS_SQL, RATING_SQL
from tallyboard.session import scratch, scratch_path
from tallyboard.sources import recount, reports
from tallyboard.sources import tables as A

WHOLE = {"ignoreNullFields": "false"}


# --- receipts -----------------------------------------------------------------------


def receipts(t: Tables) -> DataFrame:
    """A receipt per user, as JSON lines of file name and body."""
    e, user = F.col("event_id"), F.col("user_id").cast("string")
    plan = F.when(e % 4 < 3, F.struct(F.element_at(F.array(*map(F.lit, ("answered", "needs_clarification", "unsupported"))), (e % 4 + 1).cast("int")).alias("status")))
    usage = F.when(
        e % 5 > 0,
        F.struct((e % 1000).alias("input_tokens"), F.when(e % 3 > 0, F.struct((e % 7).alias("cached_tokens"))).alias("input_tokens_details")),
    )
    row = F.struct(
        e.alias("n"), F.concat(F.lit("c"), e % 50).alias("case_id"), (e % 3).alias("repeat"), (F.col("value") < 300).alias("passed"),
        F.when(e % 6 == 0, "high").alias("severity"), plan.alias("model_plan_before_semantic_repair"),
        F.when(e % 11 > 0, F.col("value") / 10000).alias("gross_cost_usd"), usage.alias("usage"),
    )
    own = t.raw("events").groupBy("user_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))  # a user's few events
    body = F.struct(F.lit("m").alias("model"), F.when(F.col("user_id") % 2 == 0, "high").alias("reasoning_effort"), F.size("rows").alias("cases"), "rows")
    name = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("live-eval-receipt-"), user, F.lit(".json"))).when(
        F.col("user_id") % 3 == 1, F.concat(F.lit("live-eval-receipt-m-high-r3-"), user, F.lit(".json"))
    ).otherwise(F.concat(F.lit("receipt-"), user, F.lit(".json")))
    return own.select(name.alias("file_name"), F.to_json(body).alias("body"))


@query(
    "a10_receipt_attempts",
    """select f.file_name, run_number, case when user_id%2=0 then 'm · high' else 'm' end run_label, attempt::int attempt, 'c' || n case_id,
    event_id%3 repeat, value<300 passed, case when event_id%6=0 then 'high' else 'normal' end severity, 0::bigint repair_count,
    case event_id%4 when 0 then 'answered' when 1 then 'needs_clarification' when 2 then 'unsupported' end emitted_status,
    case when event_id%11>0 then value/10000 else 0 end gross_cost_usd, case when event_id%5>0 then event_id%1000 else 0 end input_tokens,
    case when event_id%5>0 and event_id%3>0 then event_id%7 else 0 end cached_tokens, 0::bigint output_tokens,
    case when n<40 then 'k' || n%4 end category, case when n<40 then case when n%2=0 then 'answered' else 'unsupported' end end expected_status,
    run_order from (select *, event_id%50 n, row_number() over (partition by user_id order by event_id)-1 attempt from events)
    join (select *, row_number() over (order by run_number nulls last, file_name)::int run_order from (select distinct user_id,
    case user_id%3 when 0 then 'live-eval-receipt-' || user_id || '.json' when 1 then 'live-eval-receipt-m-high-r3-' || user_id || '.json'
    else 'receipt-' || user_id || '.json' end file_name, case when user_id%3<2 then user_id end run_number from events)) f using (user_id)""",
)
def _(t: Tables):
    folder = scratch_path(t.spark, "receipt-files")
    receipts(t).write.json(folder)
    stored = t.spark.read.schema("file_name string, body string").json(folder)
    n = F.col("event_id") % 50
    cases = t.raw("events").where(n < 40).select(
        F.concat(F.lit("c"), n).alias("id"), F.concat(F.lit("k"), n % 4).alias("category"),
        F.when(n % 2 == 0, "answered").otherwise("unsupported").alias("expected_status"), F.lit("dev").alias("split"),
    ).distinct()
    return reports.with_cases(reports.receipt_attempts(stored), cases).drop("failures", "high_severity_miss", "over_abstention", "unsafe_answer", "split")


# --- reports ------------------------------------------------------------------------


@query(
    "a11_typed_rows",
    """select o_orderkey::varchar code, o_orderkey n, o_totalprice price, case when o_orderkey%3=0 then null else o_orderkey%2=0 end rated,
    null::varchar nothing from orders""",
)
def _(t: Tables):
    k = F.col("o_orderkey")
    row = F.struct(
        k.cast("string").alias("code"), k.alias("n"), F.col("o_totalprice").cast("double").alias("price"),
        F.when(k % 3 != 0, k % 2 == 0).alias("rated"), F.lit(None).cast("string").alias("nothing"),
    )
    docs = t.raw("orders").select(F.to_json(F.struct(F.array(row).alias("games")), WHOLE).alias("body"))
    return reports.typed_rows(reports.json_rows(docs, "body", "games"))


def report(t: Tables) -> DataFrame:
    """One nested report over the order lines; cohorts are the orders' states."""
    lines = t.raw("lineitem").join(t.raw("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lower("o_orderstatus").alias("cohort")), "l_orderkey")
    routes, positions = F.count_distinct("l_partkey"), F.count_distinct("l_suppkey")
    by_ply = lines.groupBy("cohort", F.col("l_linenumber").alias("ply")).agg(
        F.count("*").alias("included_visits"), positions.alias("distinct_positions"), routes.alias("distinct_routes"),
        (routes / positions).alias("endpoint_compression"),
    )
    compression = by_ply.groupBy("cohort").agg(F.collect_list(F.struct(*[c for c in by_ply.columns if c != "cohort"])).alias("compression_by_ply"))
    views = None
    for view, keep in (("all", F.lit(True)), ("returned", F.col("l_returnflag") == "R")):
        totals = lines.where(keep).groupBy("cohort").agg(
            F.count_distinct("l_orderkey").alias("denominator_games"), routes.alias("distinct_positions"),
            F.count_distinct(F.when(F.col("l_quantity") > 25, F.col("l_partkey"))).alias("recurring_positions"),
            F.count_distinct(F.when(F.col("l_discount") > 0.05, F.col("l_partkey"))).alias("transposing_positions"),
            *[F.count_if(F.col("l_linenumber") <= n).alias(f"g{n}") for n in (1, 2, 3)],
            *[F.count_if(F.col("l_linenumber") == n).alias(f"a{n}") for n in (1, 2, 3)],
            F.count("*").alias("rows"),
        )
        points = F.array(*[
            F.struct(F.lit(n).alias("n"), F.col(f"g{n}").alias("games"), F.col(f"a{n}").alias("additional_games"), (F.col(f"g{n}") / F.col("rows")).alias("share"))
            for n in (1, 2, 3)
        ])
        modes = F.create_map(F.lit("games"), F.struct(points.alias("coverage_curve")), F.lit("routes"), F.struct(F.slice(points, 1, 2).alias("coverage_curve")))
        body = F.struct("denominator_games", "distinct_positions", "recurring_positions", "transposing_positions", modes.alias("rankings"))
        rows = totals.select("cohort", F.struct(F.lit(view).alias("key"), body.alias("value")).alias("view"))
        views = rows if views is None else views.unionByName(rows)
    bodies = views.groupBy("cohort").agg(F.map_from_entries(F.collect_list("view")).alias("views")).join(compression, "cohort")
    # A report holds a row for each cohort, ply and view.
    whole = bodies.agg(F.map_from_entries(F.collect_list(F.struct("cohort", F.struct("compression_by_ply", "views").alias("b")))).alias("cohorts"))
    kind, version = F.lit(reports.REPORT_KIND).alias("kind"), F.lit(reports.REPORT_VERSION).alias("version")
    return whole.select(F.to_json(F.struct(kind, version, "cohorts")).alias("body"))


LINES = """ln as (select l.*, lower(o_orderstatus) cohort from lineitem l join orders on o_orderkey=l_orderkey),
vw as (select unnest(['all','returned']) as "view")"""


@query(
    "a11_report_views",
    """select cohort, "view", count(distinct l_orderkey) denominator_games, count(distinct l_partkey) distinct_positions,
    count(distinct case when l_quantity>25 then l_partkey end) recurring_positions,
    count(distinct case when l_discount>0.05 then l_partkey end) transposing_positions
    from ln join vw on "view"='all' or l_returnflag='R' group by 1,2""",
    "",
    LINES,
)
def _(t: Tables):
    return reports.report_tables(report(t), "body")["views"]


@query(
    "a11_report_compression",
    """select cohort, l_linenumber ply, count(*) included_visits, count(distinct l_suppkey) distinct_positions,
    count(distinct l_partkey) distinct_routes, count(distinct l_partkey)/count(distinct l_suppkey)::double endpoint_compression from ln group by 1,2""",
    "",
    LINES,
)
def _(t: Tables):
    return reports.report_tables(report(t), "body")["compression"]


@query(
    "a11_report_coverage",
    """select cohort, 'all' as "view", m as mode, n, (select count(*) from ln x where x.cohort=c.cohort and l_linenumber<=n) games,
    (select count(*) from ln x where x.cohort=c.cohort and l_linenumber=n) additional_games,
    (select count(*) from ln x where x.cohort=c.cohort and l_linenumber<=n)/(select count(*) from ln x where x.cohort=c.cohort)::double as share
    from (select distinct cohort from ln) c, (values ('games',1),('games',2),('games',3),('routes',1),('routes',2)) t(m, n0),
    lateral (select n0::bigint n)""",
    "",
    LINES,
)
def _(t: Tables):
    return reports.report_tables(report(t), "body")["coverage"]


# --- declared counts ------------------------------------------------------------------


@query(
    "a09_declared_count_issues",
    """select * from (select 'label' kind, lang as name, count(*)+case lang when 'de' then 1 else 0 end declared, count(*) found
    from labels join documents using (doc_id) group by lang union all select 'split', 'test', 0, count(*) filter (where quality=0)
    from labels join documents using (doc_id) union all select 'cases', 'all', count(*), count(*) from labels join documents using (doc_id)
    union all select 'label', 'xx', 7, 0) where declared<>found""",
)
def _(t: Tables):
    """Declared are the counts themselves, but for one label too many, one unknown label and a split left out."""
    cases = t.raw("labels").join(t.texts, "doc_id").select(
        F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "dev").otherwise("test").alias("split"), F.col("lang").alias("label")
    )
    labels = cases.groupBy(F.col("label").alias("name")).agg((F.count("*") + F.when(F.col("name") == "de", 1).otherwise(0)).alias("cases"))
    declared = (
        labels.select(F.lit("label").alias("kind"), "name", "cases")
        .unionByName(cases.where("split = 'dev'").agg(F.count("*").alias("cases")).select(F.lit("split").alias("kind"), F.lit("dev").alias("name"), "cases"))
        .unionByName(cases.agg(F.count("*").alias("cases")).select(F.lit("cases").alias("kind"), F.lit("all").alias("name"), "cases"))
        .unionByName(cases.limit(1).select(F.lit("label").alias("kind"), F.lit("xx").alias("name"), F.lit(7).cast("bigint").alias("cases")))
    )
    return A.declared_count_issues(cases, declared)


# --- lineage ---------------------------------------------------------------------------


@query(
    "e24_intake_funnel",
    """select * from (values (0,'seen',(select count(*) from gx),null),(1,'excluded',(select count(*) from gx where not rated),'seen'),
    (2,'accepted',(select count(*) from gx where rated),'seen'),(3,'marked_bots',(select count(*) from gx where rated and marked_bot),'accepted'),
    (4,'unknown_results',(select count(*) from gx where rated and result='*' and not marked_bot),'accepted'),
    (5,'eligible_games',(select count(*) from gx where rated and eligible),'accepted'),
    (6,'known_opening_games',(select count(*) from gx where rated and eligible and family is not null),'eligible_games'))
    t(stage_order, population, games, rolls_up_to)""",
    "g",
)
def _(t: Tables):
    return E.intake_funnel(t.games, F.col("rated"))


@query(
    "e24_source_lineage",
    """select 'opening_corpus' lineage, 0 stage_order, 'training_games' population, count(*) games, null::varchar as period, null::varchar cohort,
    null::varchar rolls_up_to from training union all select 'opening_corpus', (row_number() over (order by source_period, source_cohort))::int,
    'training_source_games', count(*), source_period, source_cohort, 'opening_corpus:training_games' from training group by source_period, source_cohort""",
    "i",
)
def _(t: Tables):
    return E.source_lineage(C.training_policy(H.dedupe_by_rank(t.sources), **TRAINING))


# --- metrics over joined tables ----------------------------------------------------------


def joined(t: Tables) -> E.JoinedMetrics:
    flags = C.game_flags(t.games)
    players = C.player_flags(t.players, t.games)
    # A color stands twice for some games: the games' own ratios must not see it.
    twice = players.unionByName(players.where("color = 'white' and cast(split_part(game_key, ':', 2) as bigint) % 4 = 0"))
    return E.JoinedMetrics(
        flags,
        ("game_key",),
        {"players": twice},
        {
            "games": ("games", F.lit(1)),
            "eligible_games": ("games", F.col("eligible_game")),
            "drawn_games": ("games", F.col("drawn_game")),
            "player_rows": ("players", F.lit(1)),
            "score": ("players", F.col("eligible_score")),
            "scored": ("players", F.col("score_eligible")),
        },
        {"draw_rate": ("drawn_games", "eligible_games"), "score_rate": ("score", "scored"), "rows_a_game": ("player_rows", "games")},
    )


@query(
    "e05_joined_metrics",
    """select base_seconds, sum(pr)/count(*)::double rows_a_game, sum(drawn_game)/nullif(sum(eligible_game),0)::double draw_rate,
    sum(s)/nullif(sum(n),0) score_rate, sum(pr)::bigint player_rows from (select game_key, count(*) pr, sum(eligible_score) s, sum(score_eligible) n
    from (select * from pf union all select * from pf where color='white' and split_part(game_key,':',2)::bigint%4=0) where rating>=1200 group by 1) q
    right join fl using (game_key) where utc_date>=date '1994-01-01' group by 1""",
    "g p",
    f"{PLAYER_FLAGS_SQL}, {FLAGS_SQL}",
)
def _(t: Tables):
    return joined(t).query(
        ["rows_a_game", "draw_rate", "score_rate", "player_rows"],
        where=[("utc_date", ">=", F.lit("1994-01-01").cast("date")), ("players.rating", ">=", 1200)],
        group_by=["base_seconds"],
    )


# --- lines and families -------------------------------------------------------------------


def shown(t: Tables) -> DataFrame:
    return t.earliest.groupBy("opening_family", F.col("uci").alias("opening_line"), F.col("position_key").alias("fen")).agg(F.count("*").alias("games"))


@query("g06_families", "select opening_family as label, count(*) games from e where opening_family is not null group by 1", "v")
def _(t: Tables):
    return Q.opening_families(shown(t))


@query(
    "g06_line_positions",
    """select uci as label, count(*) games, string_agg(distinct position_key, ' ' order by position_key) fens from e
    where opening_family='click' group by 1""",
    "v",
)
def _(t: Tables):
    return Q.line_positions(shown(t), "click").withColumn("fens", F.array_join("fens", " "))


# --- raw recounts ----------------------------------------------------------------------


def annotated(t: Tables) -> DataFrame:
    """A record text per game: headers, a blank line, moves with clock and evaluation."""
    clock = F.col("clock_after_seconds").cast("bigint")
    told = F.format_string("[%%clk %d:%02d:%02d]", F.floor(clock / 3600), F.floor(clock / 60) % 60, clock % 60)
    points = F.concat(F.lit("[%eval "), (F.col("eval_after_cp_white") / 100).cast("decimal(10,2)").cast("string"), F.lit("]"))
    mate = F.when(F.col("eval_after_mate_white").isNotNull(), F.lit("[%eval #3]"))
    move = F.concat_ws(" ", F.col("uci"), F.lit("{"), mate, points, F.when(clock.isNotNull(), told), F.lit("}"))
    played = t.moves.groupBy("provider", "game_id").agg(F.array_sort(F.collect_list(F.struct("ply", move.alias("m")))).alias("p"))  # one game
    rating = {c: F.max(F.when(F.col("color") == c, F.col("rating"))).alias(c) for c in ("white", "black")}
    sides = t.players.groupBy("provider", "game_id").agg(*rating.values())
    games = t.games.join(sides, ["provider", "game_id"]).join(played, ["provider", "game_id"], "left")

    def line(name: str, value):
        return F.concat(F.lit(f'[{name} "'), value, F.lit('"]'))

    lines = F.concat_ws(
        "\n", line("Site", F.col("game_id")), line("Result", F.col("result")), line("TimeControl", F.col("time_control")),
        line("Opening", F.col("source_opening")), line("WhiteElo", F.col("white").cast("string")), line("BlackElo", F.col("black").cast("string")),
        F.when(F.col("marked_bot"), F.lit('[WhiteTitle "BOT"]')), F.lit(""), F.array_join(F.transform("p", lambda m: m["m"]), " "),
    )
    return games.select(lines.alias("text"))


@query(
    "i11_recount_clocks",
    f"""select clock_bucket, {CLOCK_AGGS}, count(*) filter (where eval_before_mate_white is not null or eval_after_mate_white is not null)
    mate_transition_moves from cl group by 1""",
    "mf",
    CLOCK_SQL,
)
def _(t: Tables):
    return recount.recount_clocks(annotated(t))


@query(
    "i11_recount_cohorts",
    """select family, color, count(*) games, count(*) filter (where score=1) wins, count(*) filter (where score=0.5) draws,
    count(*) filter (where score=0) losses from p join gx using (provider, game_id) where eligible and time_control='60+0'
    and family in ('URGENT','HIGH') and rating>=1200 and rating<1900 group by 1,2""",
    "g p",
)
def _(t: Tables):
    return recount.recount_cohorts(annotated(t), ["URGENT", "HIGH"], "60+0", 1200, 1900)


# --- every grain of the cube ------------------------------------------------------------


def all_grains(t: Tables) -> list[DataFrame]:
    """The grains of the warehouse, of the sources and of the visits."""
    def tag(df: DataFrame, grain: str, cohort: str | None = "warehouse") -> DataFrame:
        df = df.withColumn("grain", F.lit(grain))
        return df.withColumn("cohort", F.lit(cohort)) if cohort else df

    month = {"cohort": F.lit("rated_public"), "period": F.lit("2024-01"), "period_start": F.lit("2024-01-01").cast("date"), "period_end": F.lit("2024-01-31").cast("date")}
    games = X.clock_game_rows(t.move_facts, t.games, t.players)
    sample = W.cap_per_cell(games, ["clock_band", "time_control", "rating_band", "color"], "opening_family", "game_key", families=3)
    return [
        tag(X.game_cells(t.games_plies), "game_cell"),
        tag(X.result_cells(t.players, t.games_plies), "result_cell"),
        # The given lines are short of games: two are enough for a cell here.
        tag(X.result_cells(t.players, t.games_plies, lines=True, minimum=2), "result_line"),
        tag(X.clock_cells(t.move_facts, t.games, t.players), "clock_cell"),
        tag(sample, "clock_game"),
        tag(X.color_scores(t.players, t.games, FAMILIES, "60+0"), "color_score"),
        tag(X.source_game_cells(t.sources), "source_game_cell", None),
        tag(X.source_result_cells(t.sources), "source_result_cell", None),
        X.month_cells(C.training_policy(H.dedupe_by_rank(t.sources), **TRAINING)),
        X.opening_cells(t.earliest).withColumns(month),
    ]


def whole_cube(t: Tables) -> DataFrame:
    """All grains, written once per folder and session by grain, and read back."""
    kept = scratch(t.spark).tables
    if (key := ("whole-cube", t.sf_dir, t.version)) not in kept:
        kept[key] = scratch_path(t.spark, "whole-cube")
        A.write_cube(all_grains(t), kept[key])
    return A.read_cube(t.spark, kept[key])


def grain(name: str, columns: str, sql: str, uses: str, ctes: str = "") -> None:
    """The query ``a07_<name>``: the columns of one grain of the stored cube."""
    @query(f"a07_{name}", f"select {columns} from ({sql})", uses, ctes)
    def _(t: Tables):
        return whole_cube(t).where(F.col("grain") == name).select(*[c.strip() for c in columns.split(",")])


OPENINGS = """kf as (select opening_family, count(*) games, count(*)/(select count(*) from e where ply=1)::double as share from e where ply=1
  group by 1 having count(*)>=10),
ko as (select opening_family, position_key fen, count(*) games from e group by 1,2 having count(*)>=10),
kl as (select opening_family, position_key fen, route opening_line, count(*) games, len(string_split(route,' '))::bigint as ply from e
  where not route_has_repeat group by 1,2,3 having count(*)>=10),
ks as (select kl.*, kl.games/ko.games::double as share, ko.games here, count(*) over (partition by opening_family, fen) n from kl join ko using (opening_family, fen)),
kc as (select opening_family, position_key fen, next_move continuation, count(*) games from e where nullif(next_move,'') is not null
  group by 1,2,3 having count(*)>=10)"""
grain("opening_family", "cohort, period, period_start, opening_family, games, share",
      "select *, 'rated_public' cohort, '2024-01' period, date '2024-01-01' period_start from kf", "v", OPENINGS)
grain("opening_position", "opening_family, fen, games", "select * from ko", "v", OPENINGS)
grain("opening_line", "opening_family, fen, opening_line, games, ply, share", "select * from ks", "v", OPENINGS)
grain("opening_continuation", "opening_family, fen, continuation, games, share",
      "select kc.*, kc.games/ko.games::double as share from kc join ko using (opening_family, fen)", "v", OPENINGS)
grain("transposition", "opening_family, fen, games, ply",
      "select opening_family, fen, max(here) games, count(*) as ply from ks where n>=2 group by 1,2", "v", OPENINGS)
grain("transposition_route", "opening_family, fen, opening_line, games, ply, share", "select * from ks where n>=2", "v", OPENINGS)
grain("corpus_month", "cohort, period, period_start, period_end, games",
      """select source_cohort cohort, source_period period, min(utc_date) period_start, max(utc_date) period_end, count(*) games
      from training group by 1,2""", "i")
grain("color_score", "cohort, time_control, color, rating_band, opening_family, games, wins, draws, losses, share, period_start, period_end",
      f"""select 'warehouse' cohort, time_control, color, {RATING_SQL} rating_band, family opening_family, count(*) games, count(*) filter (where score=1) wins,
      count(*) filter (where score=0.5) draws, count(*) filter (where score=0) losses, (count(*) filter (where score=1) +
      count(*) filter (where score=0.5)*0.5)/count(*)::double as share, min(utc_date) period_start, max(utc_date) period_end
      from p join gx using (provider, game_id) where eligible and time_control='60+0' and family in ('URGENT','HIGH') and rating is not null
      group by 1,2,3,4,5 having count(*)>=10""", "g p")
grain("result_line", "period, period_start, period_end, time_control, color, rating_band, opening_family, opening_line, games, wins, draws, losses, rating_diff, mean_ply",
      f"""select {PERIOD}, time_control, color, rating_band, family opening_family, opening_line, {OUT} from rr
      where nullif(opening_line,'') is not null group by 1,2,3,4,5,6,7,8 having count(*)>=2""", "gp mf p", CELLS)
grain("clock_game", "clock_band, time_control, rating_band, color, opening_family, game_key, opening_line, white_rating, black_rating, period_start",
      """select * replace (nullif(opening_line,'') as opening_line) from (select *, dense_rank() over (partition by clock_band, time_control, rating_band, color
      order by family_games desc, fam) family_rank,
      row_number() over (partition by clock_band, time_control, rating_band, color, fam order by sha256(game_key), game_key) pick from
      (select *, coalesce(opening_family,'') fam, count(*) over (partition by clock_band, time_control, rating_band, color,
      coalesce(opening_family,'')) family_games from cg)) where family_rank<=3 and pick=1""", "mf p", f"{CLOCK_SQL}, {CLOCK_GAMES}")
grain("source_game_cell", "period, cohort, period_start, period_end, time_control, opening_family, games, mean_ply",
      """select source_period period, source_cohort cohort, period_start, period_end, time_control, family opening_family, count(*) games,
      avg(ply_count) mean_ply from ie join bd using (source_cohort, source_period) group by all having count(*)>=10""", "i", BOUNDS)
grain("source_result_cell", "period, cohort, period_start, period_end, time_control, color, rating_band, opening_family, games, wins, draws, losses, rating_diff, mean_ply",
      f"""select period, cohort, period_start, period_end, time_control, color, {RATING_SQL} rating_band,
      family opening_family, {OUT} from (select source_period period, source_cohort cohort, period_start,
      period_end, time_control, family, ply_count, color, case when color='white' then white_rating else
      black_rating end rating, case when color='white' then black_rating else white_rating end opponent_rating,
      case when result='1/2-1/2' then 0.5 when (result='1-0')=(color='white') then 1.0 else 0.0 end as score
      from ie join bd using (source_cohort, source_period), (values ('white'),('black')) c(color)
      where white_rating is not null and black_rating is not null)
      group by 1,2,3,4,5,6,7,8 having count(*)>=10""", "i", BOUNDS)
