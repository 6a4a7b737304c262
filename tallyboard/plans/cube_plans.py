"""Cells, the cube and what is read from it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyboard.operators import cells as X
from tallyboard.operators import cube as Q
from tallyboard.operators import dedupe as H
from tallyboard.operators import filters as C
from tallyboard.operators import joins as D
from tallyboard.operators import metrics as E
from tallyboard.operators import windows as W
from tallyboard.plans.bindings import Tables
from tallyboard.plans.catalog import query
from tallyboard.plans.facts import CLOCK_SQL, RATING_SQL
from tallyboard.session import scratch, scratch_path
from tallyboard.sources import tables as A

PERIOD = """left(utc_date::varchar, 7) period, (utc_date - (day(utc_date)-1)::int) period_start, last_day(utc_date) period_end"""
OUT = """sum(1)::bigint games, coalesce(sum((score=1)::int),0)::bigint wins, coalesce(sum((score=0.5)::int),0)::bigint draws,
  coalesce(sum((score=0)::int),0)::bigint losses, sum(rating-opponent_rating)/count(rating-opponent_rating)::double rating_diff,
  sum(ply_count)/count(ply_count)::double mean_ply"""
TRAINING = dict(minimum_plies=3, elite_low=2000, elite_high=2200)
#: One row a game with the lower of both ratings, null where one is.
LOW = """(select source_period, source_cohort, utc_date as day, 1 as one,
  case when white_rating+black_rating is not null then list_min([white_rating, black_rating]) end low from training)"""

CELLS = f"""{CLOCK_SQL},
gc as (select * from (select {PERIOD}, time_control, family opening_family, sum(1)::bigint games,
  sum(ply_count)/count(ply_count)::double mean_ply from gp where eligible and lower(variant)='standard' group by all) where games>=10),
rr as (select p.*, gp.* exclude(provider, game_id), {RATING_SQL} rating_band, trim(source_opening) opening_line from gp
  join p on p.provider=gp.provider and p.game_id=gp.game_id where eligible and rating+opponent_rating is not null),
rc as (select * from (select {PERIOD}, time_control, color, rating_band, family opening_family, {OUT} from rr group by all) where games>=10),
cm as (select clock_bucket clock_band, time_control, phase_proxy phase, {RATING_SQL} rating_band, color, family opening_family, game_id,
  min(utc_date) a, max(utc_date) z, sum(1) moves, sum((centipawn_deterioration is not null)::int) evaluable_moves,
  coalesce(sum(error_proxy::int),0) proxy_errors from cl join p using (provider, game_id, color) where rating is not null group by all),
cc as (select clock_band, time_control, phase, rating_band, color, opening_family, min(a) period_start, max(z) period_end,
  sum(moves)::bigint moves, sum(evaluable_moves)::bigint evaluable_moves, sum(proxy_errors)::bigint proxy_errors, count(*) games,
  sum(proxy_errors)/nullif(sum(evaluable_moves),0)::double error_proxy_rate from cm group by all having count(*)>=10)"""


@query("e13_game_cells", "select * from gc", "gp mf p", CELLS)
def _(t: Tables):
    return X.game_cells(t.games_plies)


@query("e14_result_cells", "select * from rc", "gp mf p", CELLS)
def _(t: Tables):
    return X.result_cells(t.players, t.games_plies)


@query(
    "e14_result_lines",
    f"""select {PERIOD}, time_control, color, rating_band, family opening_family, opening_line, {OUT}
    from rr where nullif(opening_line,'') is not null group by 1,2,3,4,5,6,7,8 having count(*)>=2""",
    "gp mf p",
    CELLS,
)
def _(t: Tables):
    return X.result_cells(t.players, t.games_plies, lines=True, minimum=2)


@query("e15_clock_cells", "select * from cc", "gp mf p", CELLS)
def _(t: Tables):
    return X.clock_cells(t.move_facts, t.games, t.players)


@query(
    "c08_suppress_small",
    """select opening_family, time_control, games, games/(sum(games) over (partition by time_control))::double as share
    from (select family opening_family, time_control, count(*) games from gx where eligible group by 1,2
    having count(*)>=700)""",
    "g",
)
def _(t: Tables):
    cells = (
        t.games.where(C.eligible())
        .groupBy(E.family("source_opening").alias("opening_family"), "time_control")
        .agg(F.count("*").alias("games"))
    )
    return C.rebase_shares(C.suppress_small(cells, 700), ["time_control"])


BOUNDS = """ie as (select * from i where result<>'*' and not marked_bot),
bd as (select source_cohort, source_period, min(utc_date) period_start, max(utc_date) period_end
  from ie group by 1,2)"""


@query(
    "e16_source_game_cells",
    """select source_period period, source_cohort cohort, period_start, period_end, time_control,
    family opening_family, count(*) games, avg(ply_count) mean_ply from ie
    join bd using (source_cohort, source_period) group by all having count(*)>=10""",
    "i",
    BOUNDS,
)
def _(t: Tables):
    return X.source_game_cells(t.sources)


@query(
    "e16_source_result_cells",
    f"""select period, cohort, period_start, period_end, time_control, color, {RATING_SQL} rating_band,
    family opening_family, {OUT} from (select source_period period, source_cohort cohort, period_start,
    period_end, time_control, family, ply_count, color, case when color='white' then white_rating else
    black_rating end rating, case when color='white' then black_rating else white_rating end opponent_rating,
    case when result='1/2-1/2' then 0.5 when (result='1-0')=(color='white') then 1.0 else 0.0 end as score
    from ie join bd using (source_cohort, source_period), (values ('white'),('black')) c(color)
    where white_rating is not null and black_rating is not null)
    group by 1,2,3,4,5,6,7,8 having count(*)>=10""",
    "i",
    BOUNDS,
)
def _(t: Tables):
    return X.source_result_cells(t.sources)


@query(
    "h02_unpivot_colors",
    """select game_id, source_period, color, case when color='white' then white_rating else black_rating end rating,
    case when color='white' then black_rating else white_rating end opponent_rating,
    case when result='1/2-1/2' then 0.5 when result='*' then null
    when (result='1-0')=(color='white') then 1.0 else 0.0 end::double as score
    from i, (values ('white'),('black')) c(color) where white_rating is not null and black_rating is not null""",
    "i",
)
def _(t: Tables):
    return H.unpivot_colors(t.sources, ["game_id", "source_period"])


@query(
    "d09_join_bounds",
    """select game_id, source_cohort, source_period, period_start, period_end from ie
    join bd using (source_cohort, source_period)""",
    "i",
    BOUNDS,
)
def _(t: Tables):
    rows = D.join_bounds(t.sources.where(C.eligible()), ["source_cohort", "source_period"])
    return rows.select("game_id", "source_cohort", "source_period", "period_start", "period_end")


@query(
    "a15_union_sources",
    """select game_id, source_snapshot_id, source_period, source_file, source_rank, source_cohort,
    white_rating, black_rating, result, time_control from i""",
    "i",
)
def _(t: Tables):
    return t.sources.select(
        "game_id",
        "source_snapshot_id",
        "source_period",
        "source_file",
        "source_rank",
        "source_cohort",
        "white_rating",
        "black_rating",
        "result",
        "time_control",
    )


@query("h03_dedupe_by_rank", "select game_id, source_rank, source_period from retained", "i")
def _(t: Tables):
    return H.dedupe_by_rank(t.sources).select("game_id", "source_rank", "source_period")


@query(
    "h03_cross_source_conflicts",
    """select game_id, count(distinct (result, white_rating, black_rating, tc)) versions from
    (select *, case when source_rank=1 and source_ordinal%40=0 then '?' else time_control end tc from i)
    group by 1 having count(distinct (result, white_rating, black_rating, tc))>1""",
    "i",
)
def _(t: Tables):
    odd = (F.col("source_rank") == 1) & (F.col("source_ordinal") % 40 == 0)
    rows = t.sources.withColumn("tc", F.when(odd, "?").otherwise(F.col("time_control")))
    found = H.cross_source_conflicts(rows, ["result", "white_rating", "black_rating", "tc"])
    return found.select("game_id", "versions")


@query("c05_training_policy", "select game_id, source_period, source_cohort from training", "i")
def _(t: Tables):
    return C.training_policy(H.dedupe_by_rank(t.sources), **TRAINING).select(
        "game_id", "source_period", "source_cohort"
    )


@query(
    "e23_corpus_summary",
    f"select source_period, source_cohort, sum(one)::bigint games, min(day) first_date, max(day) last_date, min(low) minimum_rating from {LOW} group by all",
    "i",
)
def _(t: Tables):
    return E.corpus_summary(C.training_policy(H.dedupe_by_rank(t.sources), **TRAINING))


@query(
    "e23_corpus_bands",
    f"""select band rating_band, sum(one)::bigint games from {LOW} join (values ('1000–1599',0,1600),('1600–1999',1600,2000),
    ('2000–2299',2000,2300),('2300+',2300,100000)) b(band, floor_, below) on low>=floor_ and low<below group by band""",
    "i",
)
def _(t: Tables):
    from tallyboard.functions.scalars import corpus_band

    kept = C.training_policy(H.dedupe_by_rank(t.sources), **TRAINING)
    low = corpus_band(F.least("white_rating", "black_rating"))
    return kept.groupBy(low.alias("rating_band")).agg(F.count("*").alias("games"))


@query(
    "e23_retained_counts",
    f"""select sum(one)::bigint retained, coalesce(sum((low>=1000)::int),0)::bigint at_floor, coalesce(sum((low>1000)::int),0)::bigint above_floor,
    sum((low is null)::int)::bigint missing_rating from {LOW.replace('training', 'retained')}""",
    "i",
)
def _(t: Tables):
    return E.retained_counts(H.dedupe_by_rank(t.sources))


@query(
    "e47_holdout_inventory",
    """select source_period, source_cohort, count(*) games, min(utc_date) first_date, max(utc_date) last_date
    from retained where source_period>='2025-12' group by 1,2""",
    "i",
)
def _(t: Tables):
    return E.holdout_inventory(H.dedupe_by_rank(t.sources), "2025-12")


# --- the cube ----------------------------------------------------------------------


def position_cells(t: Tables) -> DataFrame:
    return (
        t.earliest.groupBy("opening_family", F.col("position_key").alias("fen"))
        .agg(F.count("*").alias("games"))
        .withColumns(
            {
                "grain": F.lit("opening_position"),
                "cohort": F.lit("rated_public"),
                "period": F.lit("2024-01"),
                "period_start": F.lit("2024-01-01").cast("date"),
                "period_end": F.lit("2024-01-31").cast("date"),
            }
        )
        .where(F.col("games") >= 10)
    )


def grains(t: Tables) -> list[DataFrame]:
    def tag(df: DataFrame, grain: str) -> DataFrame:
        return df.withColumn("grain", F.lit(grain)).withColumn("cohort", F.lit("warehouse"))

    return [
        tag(X.game_cells(t.games_plies), "game_cell"),
        tag(X.result_cells(t.players, t.games_plies), "result_cell"),
        tag(X.clock_cells(t.move_facts, t.games, t.players), "clock_cell"),
        position_cells(t),
    ]


def stored_cube(t: Tables) -> DataFrame:
    """The cube, built once per folder and session and kept in the shared folder."""
    kept = scratch(t.spark).tables
    if (key := ("cube", t.sf_dir, t.version)) not in kept:
        path = scratch_path(t.spark, "cube")
        A.write_cube(grains(t), path)
        kept[key] = path
    return A.read_cube(t.spark, kept[key])


CUBE = f"""{CELLS},
pc as (select opening_family, position_key fen, count(*) games from e group by 1,2 having count(*)>=10),
cube as (select 'game_cell' grain, 'warehouse' cohort, * from gc union all by name
  select 'result_cell' grain, 'warehouse' cohort, * from rc union all by name
  select 'clock_cell' grain, 'warehouse' cohort, * from cc union all by name
  select 'opening_position' grain, 'rated_public' cohort, '2024-01' period, date '2024-01-01' period_start,
  date '2024-01-31' period_end, * from pc)"""
CUBE_VIEWS = "gp mf p v"
LONG = """grain, cohort, period, period_start, period_end, time_control, color, rating_band,
  opening_family, fen, clock_band, phase, games, wins, draws, losses, moves, evaluable_moves,
  proxy_errors, error_proxy_rate, rating_diff, mean_ply"""
LONG_COLS = [c.strip() for c in LONG.replace("\n", " ").split(",")]


@query("a07_write_cube", f"select {LONG} from cube", CUBE_VIEWS, CUBE)
def _(t: Tables):
    return stored_cube(t).select(*LONG_COLS)


@query(
    "a08_replace_grains",
    """select grain, count(*) cells, sum(games)::bigint games from (select grain, games from cube where
    grain<>'game_cell' union all select 'game_cell', count(*) from gp where eligible
    group by utc_date, time_control having count(*)>=2) group by 1""",
    CUBE_VIEWS,
    CUBE,
)
def _(t: Tables):
    daily = (
        t.games.where(C.eligible())
        .groupBy(F.col("utc_date").alias("period_start"), "time_control")
        .agg(F.count("*").alias("games"))
        .where("games >= 2")
        .withColumn("grain", F.lit("game_cell"))
    )
    path = scratch_path(t.spark, "cube")
    A.align_cube(stored_cube(t)).write.partitionBy("grain").parquet(path)
    A.overwrite_grains(daily, path)  # only the partition of this grain is replaced
    return A.read_cube(t.spark, path).groupBy("grain").agg(
        F.count("*").alias("cells"), F.sum("games").alias("games")
    )


F1 = Q.Filters(
    dt.date(1994, 1, 1), dt.date(1997, 12, 31), time_control="60+0", opening_family="URGENT"
)
F1_SQL = "period_start >= date '1994-01-01' and period_end <= date '1997-12-31'"


@query(
    "c09_adaptive_filter",
    f"""select period, opening_family, games, 'color,rating_band' not_applied from cube where grain='game_cell'
    and {F1_SQL} and time_control='60+0' and opening_family='URGENT'""",
    CUBE_VIEWS,
    CUBE,
)
def _(t: Tables):
    asked = Q.Filters(F1.start, F1.end, "60+0", "white", "under_1200", "URGENT")
    rows, missing = Q.adaptive_filter(stored_cube(t), "game_cell", asked)
    return rows.select("period", "opening_family", "games").withColumn(
        "not_applied", F.lit(",".join(missing))
    )


@query(
    "c10_collect_with_fallback",
    """select period, opening_family, games, 'white,color,date' notes from cube where grain='game_cell'
    and time_control='60+0'""",
    CUBE_VIEWS,
    CUBE,
)
def _(t: Tables):
    late = Q.Filters(dt.date(2020, 1, 1), dt.date(2020, 12, 31), time_control="60+0")
    rows, notes = Q.collect_with_fallback(stored_cube(t), "game_cell", late, force_color="white")
    return rows.select("period", "opening_family", "games").withColumn("notes", F.lit(",".join(notes)))


@query(
    "c10_clock_with_fallback",
    """select clock_band, sum(moves)::bigint moves, true widened from cube where grain='clock_cell'
    and time_control='60+0' group by 1""",
    CUBE_VIEWS,
    CUBE,
)
def _(t: Tables):
    late = Q.Filters(dt.date(2020, 1, 1), dt.date(2020, 12, 31), time_control="60+0", color="white")
    rows, widened, _ = Q.clock_rows_with_fallback(stored_cube(t), "clock_cell", late)
    return (
        rows.groupBy("clock_band")
        .agg(F.sum("moves").alias("moves"))
        .withColumn("widened", F.lit(widened))
    )


WIDE = Q.Filters(dt.date(1900, 1, 1), dt.date(2100, 1, 1), time_control="60+0")


@query(
    "e26_kpis",
    """select 'games' card, coalesce(sum(games),0)::double numerator, null::double denominator,
    coalesce(sum(games),0)::double as value from ga
    union all select 'mean_ply', coalesce(sum(games),0), null, sum(games*mean_ply)/sum(games) from ga
    union all select 'win_rate', sum(wins), sum(games), sum(wins)/sum(games)::double from re
    union all select 'loss_rate', sum(losses), sum(games), sum(losses)/sum(games)::double from re
    union all select 'draw_rate', sum(draws), sum(games), sum(draws)/sum(games)::double from re
    union all select 'rating_difference', sum(games), null, sum(games*rating_diff)/sum(games) from re
    union all select 'clock_error', sum(proxy_errors), sum(evaluable_moves),
    sum(proxy_errors)/sum(evaluable_moves)::double from ck
    union all select 'positions', n, null, n from po""",
    CUBE_VIEWS,
    f"""{CUBE}, ga as (select * from cube where grain='game_cell' and time_control='60+0'),
    re as (select * from cube where grain='result_cell' and time_control='60+0' and color='white'),
    ck as (select * from cube where grain='clock_cell' and time_control='60+0'),
    po as (select count(distinct fen)::double n from cube where grain='opening_position')""",
)
def _(t: Tables):
    return Q.kpis(stored_cube(t), WIDE)


@query(
    "e26_period_bars",
    f"""select period, sum(games)::bigint games from cube where grain='game_cell' and {F1_SQL}
    and time_control='60+0' and opening_family='URGENT' group by 1""",
    CUBE_VIEWS,
    CUBE,
)
def _(t: Tables):
    return Q.period_bars(stored_cube(t), "game_cell", F1)


@query(
    "e49_dimension_values",
    """select distinct opening_family from cube where opening_family is not null""",
    CUBE_VIEWS,
    CUBE,
)
def _(t: Tables):
    return Q.dimension_values(stored_cube(t), "opening_family")


@query(
    "e49_date_bounds",
    "select min(period_start) first_date, max(period_end) last_date from cube",
    CUBE_VIEWS,
    CUBE,
)
def _(t: Tables):
    return Q.date_bounds(stored_cube(t))


@query(
    "f09_prior_equal_period",
    """select time_control, count(distinct period) filter (where period='1995-08') as periods,
    sum(games) filter (where period='1995-08')::bigint games,
    sum(games) filter (where period='1995-07')::bigint prior_games,
    (sum(games) filter (where period='1995-08') - sum(games) filter (where period='1995-07'))::bigint games_delta
    from cube where grain='game_cell' and period in ('1995-07','1995-08') group by 1""",
    CUBE_VIEWS,
    CUBE,
)
def _(t: Tables):
    rows = stored_cube(t).where("grain = 'game_cell'")
    return W.prior_equal_period(rows, ["1995-08"], ["time_control"], ["games"])


@query(
    "f09_games_delta_gap",
    """select count(distinct period) as periods, sum(games)::bigint games, null::bigint prior_games,
    null::bigint games_delta from cube where grain='game_cell' and period in ('1995-08','1995-10')""",
    CUBE_VIEWS,
    CUBE,
)
def _(t: Tables):
    anything = Q.Filters(WIDE.start, WIDE.end)
    return Q.games_delta(stored_cube(t), "game_cell", anything, ["1995-08", "1995-10"])


@query(
    "f09_rate_deltas",
    """select figure, v as value, pv prior_value, round(v::decimal(18,9),1)::double-round(pv::decimal(18,9),1)::double
    shown_delta from (select unnest(['wins_percent','losses_percent','draws_percent','mean_ply','rating_diff']) figure,
    unnest([100.0*w/n, 100.0*l/n, 100.0*d/n, mp/n, rd/n]) v, unnest([100.0*pw/pn, 100.0*pl/pn, 100.0*pd/pn, pmp/pn, prd/pn]) pv
    from (select count(*) filter (where a)::double n, count(*) filter (where a and score=1)::double w,
    count(*) filter (where a and score=0)::double l, count(*) filter (where a and score=0.5)::double d,
    sum(ply_count) filter (where a)::double mp, sum(rating-opponent_rating) filter (where a)::double rd,
    count(*) filter (where not a)::double pn, count(*) filter (where not a and score=1)::double pw,
    count(*) filter (where not a and score=0)::double pl, count(*) filter (where not a and score=0.5)::double pd,
    sum(ply_count) filter (where not a)::double pmp, sum(rating-opponent_rating) filter (where not a)::double prd
    from (select *, strftime(utc_date,'%Y-%m')='1995-08' a from rr where strftime(utc_date,'%Y-%m') in ('1995-07','1995-08'))))""",
    "gp mf p",
    CELLS,
)
def _(t: Tables):
    cells = X.result_cells(t.players, t.games_plies, minimum=1).withColumn(
        "grain", F.lit("result_cell")
    )
    anything = Q.Filters(WIDE.start, WIDE.end)
    return Q.rate_deltas(A.align_cube(cells), "result_cell", anything, ["1995-08"])


CLOCK_GAMES = f"""cg as (select distinct game_id game_key, utc_date period_start, time_control, color,
  {RATING_SQL.replace('rating', 'own')} rating_band, family opening_family, trim(source_opening) opening_line,
  clock_bucket clock_band, white_rating, black_rating from (select cl.*, g.source_opening,
  w.rating white_rating, b.rating black_rating, case when cl.color='white' then w.rating else b.rating end own
  from cl join g using (provider, game_id) join p w on w.game_id=cl.game_id and w.color='white'
  join p b on b.game_id=cl.game_id and b.color='black') where own is not null)"""


@query(
    "f10_cap_per_cell",
    """select clock_band, time_control, rating_band, color, fam, game_key, family_games, family_rank from (
    select *, dense_rank() over (partition by clock_band, time_control, rating_band, color
    order by family_games desc, fam) family_rank, row_number() over (partition by clock_band, time_control,
    rating_band, color, fam order by sha256(game_key), game_key) pick from (select *,
    coalesce(opening_family,'') fam, count(*) over (partition by clock_band, time_control, rating_band, color,
    coalesce(opening_family,'')) family_games from cg)) where family_rank<=3 and pick=1""",
    "mf p",
    f"{CLOCK_SQL}, {CLOCK_GAMES}",
)
def _(t: Tables):
    rows = X.clock_game_rows(t.move_facts, t.games, t.players)
    cell = ["clock_band", "time_control", "rating_band", "color"]
    kept = W.cap_per_cell(rows, cell, "opening_family", "game_key", families=3)
    return kept.select(
        *cell,
        F.coalesce("opening_family", F.lit("")).alias("fam"),
        "game_key",
        "family_games",
        F.col("family_rank").cast("bigint").alias("family_rank"),
    )


@query(
    "g05_clock_game_list",
    """select game_key, min(period_start) played_on, min(time_control) time_control,
    min(nullif(opening_line,'')) opening_line, max(white_rating) white_rating, max(black_rating) black_rating,
    case when count(distinct color)=2 then 'Both' when min(color)='white' then 'White' else 'Black' end side,
    count(*) over () total from cg where clock_band='10_to_29' group by 1
    order by sha256(game_key), game_key limit 25""",
    "mf p",
    f"{CLOCK_SQL}, {CLOCK_GAMES}",
)
def _(t: Tables):
    return Q.clock_game_list(
        X.clock_game_rows(t.move_facts, t.games, t.players), "10_to_29", 25
    )


@query(
    "g06_opening_lines",
    """select uci opening_line, count(*) games, count(distinct position_key) positions from e
    where opening_family='click' group by 1""",
    "v",
)
def _(t: Tables):
    rows = (
        t.earliest.groupBy("opening_family", F.col("uci").alias("opening_line"), "position_key")
        .agg(F.count("*").alias("games"))
        .withColumnRenamed("position_key", "fen")
    )
    return Q.opening_lines(rows, "click")
