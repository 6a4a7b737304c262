"""Scalar logic, eligibility, joins and metrics on the game facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyboard.functions import scalars as S
from tallyboard.operators import filters as C
from tallyboard.operators import joins as D
from tallyboard.operators import metrics as E
from tallyboard.operators import windows as W
from tallyboard.plans.bindings import Tables
from tallyboard.plans.catalog import query
from tallyboard.session import spread

COHORT = dict(
    color="black",
    rating_min=1000,
    rating_max_exclusive=2000,
    base_seconds=60,
    increment_seconds=0,
)
COHORT_SQL = "color='black' and rating>=1000 and rating<2000 and base_seconds=60 and increment_seconds=0"
FAMILIES = ("URGENT", "HIGH")
RATING_SQL = """case when rating is null then null when rating<1200 then 'under_1200'
  when rating<1600 then '1200_1599' when rating<2000 then '1600_1999' else '2000_plus' end"""


# --- scalar logic ------------------------------------------------------------------


@query(
    "b02_family",
    "select family, count(*)::bigint games from gx group by 1",
    "g",
)
def _(t: Tables):
    return t.games.groupBy(S.family("source_opening").alias("family")).agg(
        F.count("*").alias("games")
    )


@query(
    "b03_surrogate_key",
    """select provider || ':' || game_id || ':' || color as player_game_key,
    provider || ':' || game_id game_key, provider || ':' || player_key owner_key from p""",
    "p",
)
def _(t: Tables):
    return t.players.select(
        S.surrogate_key("provider", "game_id", "color").alias("player_game_key"),
        S.surrogate_key("provider", "game_id").alias("game_key"),
        S.surrogate_key("provider", "player_key").alias("owner_key"),
    )


@query(
    "b04_parse_time_control",
    """select game_id, case when source_ordinal%9=0 then null else base_seconds end base,
    case when source_ordinal%9=0 then null else increment_seconds end inc from g""",
    "g",
)
def _(t: Tables):
    text = F.when(F.col("source_ordinal") % 9 == 0, F.concat("time_control", F.lit("s"))).otherwise(
        F.col("time_control")
    )
    base, inc = S.time_control(text)
    return t.games.select("game_id", base.alias("base"), inc.alias("inc"))


@query(
    "b05_parse_utc",
    """select game_id, case when k%7 in (0,1,2) then null else utc_date end utc_date,
    case when k%7 in (0,1,2) or k%5=0 or k%11=3 then null
    else utc_date::timestamp + interval (k%86400) second end played_at,
    case when k%7 in (0,1,2) then 'unknown' when k%5=0 or k%11=3 then 'date' else 'second' end
    timestamp_precision,
    k%7=1 or (k%7 not in (0,1,2) and k%5<>0 and k%11=3) invalid_utc
    from (select *, source_ordinal k from g)""",
    "g",
)
def _(t: Tables):
    k = F.col("source_ordinal")
    date = (
        F.when(k % 7 == 0, F.lit("1995.??.??"))
        .when(k % 7 == 1, F.lit("1995.13.01"))
        .when(k % 7 == 2, F.lit(None).cast("string"))
        .otherwise(F.date_format("utc_date", "yyyy.MM.dd"))
    )
    second = k % 86400

    def two(x):
        return F.lpad(F.floor(x).cast("string"), 2, "0")

    clock = (
        F.when(k % 5 == 0, F.lit("??:??:??"))
        .when(k % 11 == 3, F.lit("25:61:00"))
        .otherwise(
            F.concat_ws(":", two(second / 3600), two(second % 3600 / 60), two(second % 60))
        )
    )
    parts = S.parse_utc(date, clock)
    return t.games.select(
        "game_id",
        parts["utc_date"].alias("utc_date"),
        F.to_timestamp_ntz(F.date_format(parts["played_at"], "yyyy-MM-dd HH:mm:ss")).alias(
            "played_at"
        ),
        parts["timestamp_precision"].alias("timestamp_precision"),
        parts["invalid_utc"].alias("invalid_utc"),
    )


@query(
    "b06_to_participants",
    "select provider, game_id, color, player_key, rating, opponent_rating, score from p",
    "p",
)
def _(t: Tables):
    from tallyboard.sources.text import to_participants

    k, c = F.col("o_orderkey"), F.col("o_custkey")
    wide = t.raw("orders").select(
        F.lit("tpch").alias("provider"),
        k.cast("string").alias("game_id"),
        F.when(k % 97 == 0, "*")
        .when(F.col("o_orderstatus") == "F", "1-0")
        .when(F.col("o_orderstatus") == "O", "0-1")
        .otherwise("1/2-1/2")
        .alias("result"),
        F.when(k % 31 == 0, "?").otherwise(F.concat(F.lit("C"), c.cast("string"))).alias("white"),
        F.concat(F.lit("C"), ((c * 7 + 3) % 1500).cast("string")).alias("black"),
        F.when(k % 23 != 0, 800 + (c * 37) % 1600).alias("white_rating"),
        (800 + (k * 53) % 1600).alias("black_rating"),
    )
    return to_participants(wide)


@query(
    "b07_score_from_result",
    """select game_id, color, case when result='1/2-1/2' then 0.5 when result='*' then null
    when (result='1-0')=(color='white') then 1.0 else 0.0 end::double as score
    from g, (values ('white'), ('black')) c(color)""",
    "g",
)
def _(t: Tables):
    both = t.games.select("game_id", "result", F.explode(F.array(F.lit("white"), F.lit("black"))).alias("color"))
    return both.select(
        "game_id", "color", S.score_from_result("result", "color").alias("score")
    )


@query(
    "b08_band",
    f"""select {RATING_SQL} rating_band,
    case when rating is null then null when rating<1000 then 'below-1000'
    when rating<1600 then '1000–1599' when rating<2000 then '1600–1999'
    when rating<2300 then '2000–2299' else '2300+' end model_band,
    case when rating is null or opponent_rating is null then null
    when rating-opponent_rating < -100 then 'below_-100'
    when rating-opponent_rating >= 100 then '100_plus' else '-100_to_99' end stratum,
    count(*)::bigint n from p group by all""",
    "p",
)
def _(t: Tables):
    return t.players.groupBy(
        S.rating_band("rating").alias("rating_band"),
        S.model_band("rating").alias("model_band"),
        S.difference_band(F.col("rating") - F.col("opponent_rating")).alias("stratum"),
    ).agg(F.count("*").alias("n"))


@query(
    "b08_clock_and_phase_band",
    """select case when x is null or x<0 then null when x<10 then 'under_10' when x<30
    then '10_to_29' when x<60 then '30_to_59' else '60_plus' end clock,
    case when ply<=20 then 'early_ply' when ply<=60 then 'middle_ply' else 'late_ply' end phase,
    count(*)::bigint n from (select ply, clock_after_seconds-5 x from m) group by all""",
    "m",
)
def _(t: Tables):
    return t.moves.groupBy(
        S.clock_band(F.col("clock_after_seconds") - 5).alias("clock"), S.phase("ply").alias("phase")
    ).agg(F.count("*").alias("n"))


@query(
    "b09_in_speed_class",
    """select game_id, coalesce(base_seconds + 40*coalesce(inc,0) >= 180 and
    base_seconds + 40*coalesce(inc,0) < 480, false) in_class
    from (select *, nullif(increment_seconds, 0) inc from g)""",
    "g",
)
def _(t: Tables):
    inc = F.nullif("increment_seconds", F.lit(0))
    return t.games.select("game_id", S.in_speed_class("base_seconds", inc).alias("in_class"))


@query(
    "b10_fingerprint",
    """select sha256('{"text":' || to_json(text) || ',"lang":"' || lang || '"}') fingerprint,
    count(*)::bigint copies from documents group by 1""",
)
def _(t: Tables):
    return t.texts.groupBy(S.fingerprint("text", "lang").alias("fingerprint")).agg(
        F.count("*").alias("copies")
    )


@query(
    "b11_position_id",
    "select position_key, substr(sha256(position_key),1,24) position_id, count(*)::bigint n from v1 group by all",
    "v",
)
def _(t: Tables):
    return t.plies.groupBy("position_key", S.position_id("position_key").alias("position_id")).agg(
        F.count("*").alias("n")
    )


@query(
    "b12_hash_sample",
    "select game_id from g where ('0x' || substr(sha256(game_id),1,16))::ubigint % 20 = 0",
    "g",
)
def _(t: Tables):
    return t.games.where(S.hash_sample("game_id", 20)).select("game_id")


@query(
    "b13_hash_order",
    "select game_id, row_number() over (order by sha256(game_id), game_id)::bigint as rank from g",
    "g",
)
def _(t: Tables):
    return W.hash_rank(t.games.select("game_id"), "game_id")


@query(
    "b14_provider_identity",
    """select page_id, case when h like '%.com' then 'com' when h like '%.net' then 'net'
    when h like '%.org' then 'org' else 'pgn' end provider, nullif(case when h like '%.com' or
    h like '%.net' or h like '%.org' then regexp_extract(path, '^/([a-z]{2})/([0-9]+)/?$', 2)
    end, '') native_id, cast(null as varchar) reason
    from (select page_id, regexp_extract(lower(split_part(split_part(url,'//',2),'/',1)),
      'example\\.(com|net|org)$', 0) h,
      regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) path from pages)""",
)
def _(t: Tables):
    pages = t.raw("pages")
    # Each page names its own host; the three example domains play the providers.
    host = F.regexp_extract(F.lower("url"), r"^https?://[^/?#]*?(example\.(?:com|net|org))(?=[/?#]|$)", 1)
    bare = F.regexp_replace("url", r"^(https?://)[^/?#]*?(example\.(?:com|net|org))(?=[/?#]|$)", "$1$2")
    rule = r"^/[a-z]{2}/([0-9]+)/?\z"
    table = {
        n: {"hosts": (f"example.{n}",), "path": rule, "groups": 1} for n in ("com", "net", "org")
    }
    parts = S.provider_identity(F.when(host != "", bare), F.lit(None).cast("string"), table)
    return pages.select("page_id", *[c.alias(n) for n, c in parts.items()])


@query(
    "b15_rated_flag_import_date",
    """select game_id, case when k%4=0 then true when k%4=1 then false when k%3=0 then true
    when k%3=1 then false end rated_flag,
    case when k%6=0 then null else utc_date end played from (select *, source_ordinal k from g)""",
    "g",
)
def _(t: Tables):
    k = F.col("source_ordinal")
    tag = F.when(k % 4 == 0, "True").when(k % 4 == 1, "false").otherwise("")
    event = F.when(k % 3 == 0, "RATED game").when(k % 3 == 1, "Casual game").otherwise("Ratedgame")
    date = F.date_format("utc_date", "yyyy.MM.dd")
    utc = F.when(k % 6 == 0, "1999.02.30").when(k % 6 == 1, date).otherwise("")
    return t.games.select(
        "game_id", S.rated_flag(tag, event).alias("rated_flag"), S.import_date(utc, date).alias("played")
    )


@query(
    "b16_clamp",
    """select game_id, ply::int ply, case when centipawn_deterioration is not null
    then least(centipawn_deterioration, 1000)::bigint end clamped from mf""",
    "mf",
)
def _(t: Tables):
    value = S.clamp("centipawn_deterioration", "eval_before_cp_white", "eval_after_cp_white")
    return t.move_facts.select("game_id", "ply", value.alias("clamped"))


@query(
    "b17_month_period",
    """select strftime(utc_date, '%Y-%m') period, date_trunc('month', utc_date)::date period_start,
    last_day(utc_date) period_end, count(*)::bigint games from g group by all""",
    "g",
)
def _(t: Tables):
    period, start, end = S.month_period("utc_date")
    return t.games.groupBy(
        period.alias("period"), start.alias("period_start"), end.alias("period_end")
    ).agg(F.count("*").alias("games"))


@query(
    "b18_route_contains_all",
    """select game_id, ply::int ply, starts_with(route, 'click ') and
    list_has_all(string_split(route,' '), ['view','error']) has_all,
    list_contains(string_split(route,' '), 'signup') has_one from v""",
    "v",
)
def _(t: Tables):
    return t.visits.select(
        "game_id",
        "ply",
        S.route_contains_all("route", "click", ["view", "error"]).alias("has_all"),
        S.route_contains("route", "signup").alias("has_one"),
    )


@query(
    "b19_json_field",
    "select event_type, json_extract_string(props, '$.k') k, count(*)::bigint n from events group by all",
)
def _(t: Tables):
    return t.raw("events").groupBy("event_type", S.json_field("props", "$.k").alias("k")).agg(
        F.count("*").alias("n")
    )


def _rule_sql(column: str) -> str:
    cases = []
    for label, needed, barred in S.LABEL_RULES:
        hits = [f"regexp_matches({column}, '{p}')" for p in needed]
        hits += [f"not regexp_matches({column}, '{p}')" for p in barred]
        cases.append(f"when {' and '.join(hits)} then '{label}'")
    return "case " + " ".join(cases) + " else 'clarify' end"


@query(
    "b20_rule_label",
    f"""select source, label, count(*)::bigint n from (
    select 'conversation' source, {_rule_sql('lower(text)')} label from conversations union all
    select 'benchmark', {_rule_sql('lower(text)')} from benchmark union all
    select 'document', {_rule_sql('lower(text)')} from documents) group by all""",
)
def _(t: Tables):
    frames = [
        spread(t.raw(n)).select(F.lit(s).alias("source"), S.rule_label("text").alias("label"))
        for n, s in (
            ("conversations", "conversation"),
            ("benchmark", "benchmark"),
            ("documents", "document"),
        )
    ]
    return (
        frames[0].union(frames[1]).union(frames[2]).groupBy("source", "label").agg(F.count("*").alias("n"))
    )


@query(
    "b21_failure_mode",
    "select run, failure_mode, count(*)::bigint n from r group by all",
    "r",
)
def _(t: Tables):
    return t.attempts.groupBy("run", "failure_mode").agg(F.count("*").alias("n"))


@query(
    "b22_deterioration",
    """select game_id, ply::int ply, centipawn_deterioration::bigint loss, error_proxy from mf""",
    "mf",
)
def _(t: Tables):
    loss = S.deterioration("eval_before_cp_white", "eval_after_cp_white", "color")
    return t.move_facts.select("game_id", "ply", loss.alias("loss"), S.error_flag(loss).alias("error_proxy"))


# --- filters -----------------------------------------------------------------------


@query(
    "c01_game_eligibility",
    "select result, marked_bot, eligible metric_eligible, result='1/2-1/2' drawn, count(*)::bigint n from gx group by all",
    "g",
)
def _(t: Tables):
    return C.game_eligibility(t.games).groupBy(
        "result", "marked_bot", "metric_eligible", "drawn"
    ).agg(F.count("*").alias("n"))


FLAGS_SQL = """fl as (select *, (rated and variant='Standard' and eligible)::int::bigint eligible_game,
  (rated and variant='Standard' and eligible and result='1/2-1/2')::int::bigint drawn_game,
  (rated and variant='Standard' and eligible and family is not null)::int::bigint known_opening_game,
  (rated and variant='Standard' and eligible and family is null)::int::bigint unknown_opening_game
  from gx)"""


@query(
    "c02_game_flags",
    """select game_key, eligible_game, drawn_game, known_opening_game, unknown_opening_game,
    family opening_family from fl""",
    "g",
    FLAGS_SQL,
)
def _(t: Tables):
    return C.game_flags(t.games).select(
        "game_key",
        "eligible_game",
        "drawn_game",
        "known_opening_game",
        "unknown_opening_game",
        "opening_family",
    )


PLAYER_FLAGS_SQL = """pf0 as (select p.provider || ':' || p.game_id || ':' || color player_game_key,
  game_key, color, player_key, rating, score, utc_date, base_seconds, increment_seconds,
  family opening_family, (rated and variant='Standard' and eligible and rating is not null
  and family is not null)::int::bigint score_eligible from p join gx using (provider, game_id)),
pf as (select *, case when score_eligible=1 then score else 0.0 end::double eligible_score,
  coalesce(score_eligible=1 and score=1, false)::int::bigint eligible_win,
  coalesce(score_eligible=1 and score=0.5, false)::int::bigint eligible_draw,
  coalesce(score_eligible=1 and score=0, false)::int::bigint eligible_loss from pf0)"""


@query("c03_player_flags", "select * from pf", "g p", PLAYER_FLAGS_SQL)
def _(t: Tables):
    return C.player_flags(t.players, t.games)


@query(
    "c04_cohort_filter",
    f"""select game_id, color, rating, family from p join gx using (provider, game_id)
    where eligible and {COHORT_SQL} and family in ('URGENT','HIGH')""",
    "g p",
)
def _(t: Tables):
    rows = E.cohort_rows(t.players, t.games)
    return C.cohort_filter(rows, family_column="family", families=FAMILIES, **COHORT).select(
        "game_id", "color", "rating", "family"
    )


@query(
    "c07_cascade_filter",
    """select reason, count(*)::bigint as rows from (select case when player_key is null
    or player_key not like 'c1%' then 'unmatched_player' when color='black' then 'black_games'
    when utc_date < date '1994-01-01' or utc_date > date '1999-12-31' then 'date'
    when time_control <> '60+0' then 'time_control' when not rated then 'rated'
    when ply_count < 2 then 'short_comparison' else 'included' end reason
    from p join gp using (provider, game_id)) group by 1""",
    "gp p",
)
def _(t: Tables):
    rows = t.players.join(t.games_plies, ["provider", "game_id"])
    rules = [
        ("unmatched_player", F.col("player_key").isNull() | ~F.col("player_key").startswith("c1")),
        ("black_games", F.col("color") == "black"),
        ("date", (F.col("utc_date") < "1994-01-01") | (F.col("utc_date") > "1999-12-31")),
        ("time_control", F.col("time_control") != "60+0"),
        ("rated", ~F.col("rated")),
        ("short_comparison", F.col("ply_count") < 2),
    ]
    return C.cascade_filter(rows, rules)


# --- joins -------------------------------------------------------------------------


@query(
    "d01_player_outcomes",
    """select game_id, color, player_key, rating, opponent_rating, score, utc_date, base_seconds,
    increment_seconds, eligible metric_eligible, coalesce(score=1,false)::int::bigint win,
    coalesce(score=0.5,false)::int::bigint draw, coalesce(score=0,false)::int::bigint loss
    from p join gx using (provider, game_id)""",
    "g p",
)
def _(t: Tables):
    return D.player_outcomes(t.players, t.games).drop("provider")


MOVE_EVALS_SQL = """me as (select provider, game_id, ply::int ply,
  provider || ':' || game_id || ':' || ply move_key, provider || ':' || game_id game_key, color,
  utc_date, family opening_family, clock_bucket, phase_proxy,
  centipawn_deterioration::bigint centipawn_deterioration,
  eval_before_cp_white is not null and eval_after_cp_white is not null evaluable, error_proxy,
  case when centipawn_deterioration is not null then least(centipawn_deterioration,1000)::bigint end
  clamped_deterioration from mf left join (select provider, game_id, utc_date, family from gx) x
  using (provider, game_id))"""


@query("d02_move_evals", "select * from me", "mf", MOVE_EVALS_SQL)
def _(t: Tables):
    return D.move_evals(t.move_facts, t.games)


@query(
    "d03_move_context",
    """select mf.game_id, mf.ply::int ply, mf.color, rating, time_control, clock_bucket from mf
    join g using (provider, game_id) join p using (provider, game_id, color)""",
    "mf p",
)
def _(t: Tables):
    return D.move_context(t.move_facts, t.games, t.players).select(
        "game_id", "ply", "color", "rating", "time_control", "clock_bucket"
    )


@query(
    "d04_pivot_colors",
    """select game_id, max(case color when 'white' then rating end) white_rating, max(case color when 'white' then player_key end) white_player_key,
    max(case color when 'black' then rating end) black_rating, max(case color when 'black' then player_key end) black_player_key
    from p group by game_id""",
    "p",
)
def _(t: Tables):
    return D.pivot_colors(t.players, ("rating", "player_key")).drop("provider")


@query(
    "d05_orphans",
    """select p.game_id, p.color from p anti join (select * from gx where eligible) x
    on x.game_id=p.game_id""",
    "g p",
)
def _(t: Tables):
    return D.orphans(t.players, t.games.where(C.eligible())).select("game_id", "color")


@query(
    "d10_reconcile_scalar",
    """select (select sum(eligible_game) from fl)::bigint left_value,
    (select count(*) from gx where eligible) right_value,
    (select sum(eligible_game) from fl) is distinct from
    (select count(*) from gx where eligible) differs""",
    "g",
    FLAGS_SQL,
)
def _(t: Tables):
    left = C.game_flags(t.games).agg(F.sum("eligible_game"))
    right = E.outcomes_by(t.games).agg(F.sum("eligible_games"))
    return D.reconcile_scalar(left, right)


# --- metrics -----------------------------------------------------------------------


@query(
    "e01_draw_rate",
    """select count(*) filter (where eligible and result='1/2-1/2') drawn,
    count(*) filter (where eligible) eligible,
    count(*) filter (where result='*' and not marked_bot) unknown_results,
    count(*) filter (where marked_bot) marked_bots,
    count(*) filter (where eligible and result='1/2-1/2')::double / count(*) filter (where eligible)
    draw_rate from gx where rated and variant='Standard'""",
    "g",
)
def _(t: Tables):
    return E.draw_rate(t.games)


@query(
    "e02_usage_share",
    """select count(*) filter (where family='URGENT') numerator,
    count(*) filter (where family is not null) denominator,
    count(*) filter (where family is null) unknown_opening_games,
    count(*) filter (where family='URGENT')::double/count(*) filter (where family is not null) as value
    from gx where eligible""",
    "g",
)
def _(t: Tables):
    return E.usage_share(t.games, "URGENT")


@query(
    "e02_usage_share_grouped",
    """select family, count(*)::bigint numerator, (sum(count(*)) over ())::bigint denominator,
    count(*)/(sum(count(*)) over ())::double as value, count(*) over () > 500 truncated from gx
    where eligible and family is not null group by 1 order by 2 desc, 1 limit 500""",
    "g",
)
def _(t: Tables):
    return E.usage_share_grouped(t.games)


@query(
    "e03_player_score",
    f"""select wins, draws, losses, wins+draws+losses eligible_player_games,
    case when wins+draws+losses>0 then wins::double/(wins+draws+losses) end win_rate,
    case when wins+draws+losses>0 then sc/(wins+draws+losses) end score_rate,
    wins+draws+losses<100 low_support from (select count(*) filter (where score=1) wins,
    count(*) filter (where score=0.5) draws, count(*) filter (where score=0) losses, sum(score) sc
    from p join gx using (provider, game_id) where eligible and {COHORT_SQL} and family='URGENT')""",
    "g p",
)
def _(t: Tables):
    return E.player_score(t.players, t.games, family_name="URGENT", **COHORT)


@query(
    "e04_outcomes_by",
    """select utc_date, base_seconds, increment_seconds, count(*) accepted_games,
    count(*) filter (where eligible) eligible_games,
    count(*) filter (where eligible and result='1/2-1/2') drawn_games,
    count(*) filter (where result='*') unknown_results, count(*) filter (where marked_bot) marked_bots,
    count(*) filter (where source_opening is null) missing_source_opening from gx group by 1,2,3""",
    "g",
)
def _(t: Tables):
    return E.outcomes_by(t.games)


def game_metrics(t: Tables) -> E.MetricSet:
    return E.MetricSet(
        C.game_flags(t.games),
        {
            n + "s": F.col(n)
            for n in ("eligible_game", "drawn_game", "known_opening_game", "unknown_opening_game")
        },
        {"draw_rate": ("drawn_games", "eligible_games")},
    )


def player_metrics(t: Tables) -> E.MetricSet:
    names = ("eligible_score", "eligible_win", "eligible_draw", "eligible_loss")
    simple = {n: F.col(n) for n in names}
    simple["eligible_player_games"] = F.col("score_eligible")
    return E.MetricSet(
        C.player_flags(t.players, t.games),
        simple,
        {
            "opening_score_rate": ("eligible_score", "eligible_player_games"),
            "opening_win_rate": ("eligible_win", "eligible_player_games"),
        },
    )


@query(
    "e05_metric_set_games",
    """select base_seconds, sum(known_opening_game)::bigint known_opening_games,
    case when sum(eligible_game)>0 then sum(drawn_game)/sum(eligible_game)::double end draw_rate
    from fl where opening_family is distinct from 'LOW' group by 1""",
    "g",
    FLAGS_SQL.replace("select *,", "select *, family opening_family,"),
)
def _(t: Tables):
    return game_metrics(t).query(
        ["known_opening_games", "draw_rate"],
        where=~F.col("opening_family").eqNullSafe("LOW"),
        group_by=["base_seconds"],
    )


@query(
    "e05_metric_set_players",
    """select opening_family, color, sum(eligible_score)/nullif(sum(score_eligible),0) opening_score_rate,
    sum(eligible_win)/nullif(sum(score_eligible),0)::double opening_win_rate,
    sum(score_eligible)::bigint eligible_player_games from pf group by 1,2""",
    "g p",
    PLAYER_FLAGS_SQL,
)
def _(t: Tables):
    return player_metrics(t).query(
        ["opening_score_rate", "opening_win_rate", "eligible_player_games"],
        group_by=["opening_family", "color"],
    )


@query(
    "e06_mean_clamped_loss",
    """select opening_family, sum(clamped_deterioration)::bigint clamped_loss,
    count(*) filter (where evaluable) evaluable_moves,
    case when count(*) filter (where evaluable)>0 then
    sum(clamped_deterioration)/(count(*) filter (where evaluable))::double end mean_loss from me group by 1""",
    "mf",
    MOVE_EVALS_SQL,
)
def _(t: Tables):
    return E.mean_clamped_loss(D.move_evals(t.move_facts, t.games), ["opening_family"])


CLOCK_SQL = """cl as (select mf.*, gx.time_control, gx.utc_date, gx.family from mf join gx
  using (provider, game_id) where eligible and increment_seconds=0 and clock_bucket is not null)"""
CLOCK_AGGS = """count(*) eligible_moves, count(centipawn_deterioration) evaluable_moves,
  count(*) filter (where error_proxy) proxy_errors"""
RATES = """evaluable_moves/nullif(eligible_moves,0)::double evaluation_coverage,
  proxy_errors/nullif(evaluable_moves,0)::double error_proxy_rate"""


@query(
    "e07_clock_pressure",
    f"""select *, {RATES} from (select clock_bucket, {CLOCK_AGGS}, count(*) filter (where
    eval_before_mate_white is not null or eval_after_mate_white is not null) mate_transition_moves
    from cl group by 1)""",
    "mf",
    CLOCK_SQL,
)
def _(t: Tables):
    return E.clock_pressure(t.move_facts, t.games)


@query(
    "e08_clock_strata",
    f"""select *, {RATES} from (select clock_bucket, time_control, phase_proxy,
    {RATING_SQL} rating_band, {CLOCK_AGGS} from cl join p using (provider, game_id, color)
    where rating is not null group by 1,2,3,4)""",
    "mf p",
    CLOCK_SQL,
)
def _(t: Tables):
    return E.clock_strata(t.move_facts, t.games, t.players)


@query(
    "e09_snapshot_summary",
    """select 'move_coverage' section, 'all' item, measure, value from (unpivot (select
    count(*)::bigint moves, count(clock_after_seconds)::bigint after_clock_moves,
    count(clock_before_seconds)::bigint before_clock_moves, count(eval_after_cp_white)::bigint cp_eval_moves,
    count(eval_after_mate_white)::bigint mate_eval_moves, count(distinct (provider,game_id))::bigint
    selected_games from mf) on columns(*) into name measure value value)
    union all select 'opening_coverage', 'all', measure, value from (unpivot (select
    count(*) filter (where eligible)::bigint eligible_games,
    count(*) filter (where eligible and family is not null)::bigint known_opening_games,
    count(*) filter (where source_opening is null or trim(source_opening)='')::bigint missing_source_opening
    from gx) on columns(*) into name measure value value)
    union all select 'top_families', family, 'eligible_games', n from (select family, count(*) n from gx
    where eligible and family is not null group by 1 order by 2 desc, 1 limit 12)
    union all select 'clock_buckets', clock_bucket, measure, value from (unpivot (select clock_bucket,
    count(*)::bigint eligible_moves, count(centipawn_deterioration)::bigint evaluable_moves,
    count(*) filter (where error_proxy)::bigint proxy_errors, count(*) filter (where eval_before_mate_white
    is not null or eval_after_mate_white is not null)::bigint mate_transition_moves from cl group by 1)
    on eligible_moves, evaluable_moves, proxy_errors, mate_transition_moves
    into name measure value value)""",
    "mf",
    CLOCK_SQL,
)
def _(t: Tables):
    return E.snapshot_summary(t.move_facts, t.games)


@query(
    "e10_compare_two_families",
    f"""select a.n games_a, b.n games_b, a.win win_rate_a, b.win win_rate_b, a.score score_rate_a,
    b.score score_rate_b, a.score-b.score score_rate_difference, a.win-b.win win_rate_difference
    from (select count(*) n, count(*) filter (where score=1)/count(*)::double win, sum(score)/count(*) score
    from x where family='URGENT') a, (select count(*) n, count(*) filter (where score=1)/count(*)::double win,
    sum(score)/count(*) score from x where family='HIGH') b""",
    "g p",
    f"x as (select * from p join gx using (provider, game_id) where eligible and {COHORT_SQL})",
)
def _(t: Tables):
    return E.compare_scores(t.players, t.games, families=FAMILIES, **COHORT)


@query(
    "e10_compare_two_buckets",
    """select *, error_proxy_rate_a-error_proxy_rate_b error_rate_difference,
    coverage_a-coverage_b coverage_difference from (select *,
    proxy_errors_a/nullif(evaluable_moves_a,0)::double error_proxy_rate_a,
    evaluable_moves_a/nullif(eligible_moves_a,0)::double coverage_a,
    proxy_errors_b/nullif(evaluable_moves_b,0)::double error_proxy_rate_b,
    evaluable_moves_b/nullif(eligible_moves_b,0)::double coverage_b from (select
    count(*) filter (where a) eligible_moves_a, count(centipawn_deterioration) filter (where a) evaluable_moves_a,
    count(*) filter (where a and error_proxy) proxy_errors_a, count(*) filter (where b) eligible_moves_b,
    count(centipawn_deterioration) filter (where b) evaluable_moves_b,
    count(*) filter (where b and error_proxy) proxy_errors_b from
    (select *, clock_bucket='10_to_29' a, clock_bucket='60_plus' b from cl)))""",
    "mf",
    CLOCK_SQL,
)
def _(t: Tables):
    return E.compare_buckets(t.move_facts, t.games, "10_to_29", "60_plus")


@query(
    "e24_funnel",
    """select * from (values (0,'accepted',(select count(*) from gx),cast(null as varchar)),
    (1,'marked_bots',(select count(*) from gx where marked_bot),'accepted'),
    (2,'unknown_results',(select count(*) from gx where result='*' and not marked_bot),'accepted'),
    (3,'eligible_games',(select count(*) from gx where eligible),'accepted'),
    (4,'known_opening_games',(select count(*) from gx where eligible and family is not null),'eligible_games'))
    t(stage_order, population, games, rolls_up_to)""",
    "g",
)
def _(t: Tables):
    return E.funnel(t.games)


@query(
    "e25_rollup_strata",
    f"""select *, {RATES} from (select rating_band, time_control, {CLOCK_AGGS},
    case rating_band when 'under_1200' then 1 when '1200_1599' then 2 when '1600_1999' then 3 else 4 end::bigint
    band_order from (select *, {RATING_SQL} rating_band from cl join p using (provider, game_id, color)
    where rating is not null) group by 1,2)""",
    "mf p",
    CLOCK_SQL,
)
def _(t: Tables):
    return E.rollup_strata(E.clock_strata(t.move_facts, t.games, t.players))


@query(
    "e43_player_index",
    """select provider, lower(trim(player_key)) as key, count(*) filter (where color='white') white,
    count(*) filter (where color='black') black from p where player_key is not null group by 1,2""",
    "p",
)
def _(t: Tables):
    return E.player_index(t.players)


# --- ordered move facts ------------------------------------------------------------


@query(
    "f02_same_side_lag",
    "select game_id, ply::int ply, clock_before_seconds clock_before from mf",
    "mf",
)
def _(t: Tables):
    games = t.games.select("provider", "game_id", "base_seconds", "increment_seconds")
    clocks = t.moves.join(games, ["provider", "game_id"]).withColumn(
        "clock", W.valid_clock("clock_after_seconds", "base_seconds", "increment_seconds")
    )
    return W.same_side_lag(clocks, ["provider", "game_id"], "clock").select(
        "game_id", "ply", "clock_before"
    )


@query(
    "f03_previous_row_value",
    """select game_id, ply::int ply, lag(eval_after_cp_white) over
    (partition by game_id order by ply) as before from m""",
    "m",
)
def _(t: Tables):
    return W.previous_row_value(t.moves, ["provider", "game_id"], "eval_after_cp_white").select(
        "game_id", "ply", "before"
    )


GAPPY = "(select * from m where ply%5<>3 and (game_id::bigint+ply)%7<>0)"


@query(
    "f02_missing_plies",
    f"""select game_id, ply::int ply, lag(clock_after_seconds) over (partition by game_id, color order by ply)
    clock_before from {GAPPY}""",
    "m",
)
def _(t: Tables):
    rows = t.moves.where("ply % 5 <> 3 and (cast(game_id as bigint) + ply) % 7 <> 0")
    return W.same_side_lag(rows, ["provider", "game_id"], "clock_after_seconds").select(
        "game_id", "ply", "clock_before"
    )


@query(
    "f03_missing_plies",
    f"""select game_id, ply::int ply, lag(eval_after_cp_white) over (partition by game_id order by ply) as before,
    lag(eval_after_cp_white, 2) over (partition by game_id order by ply) earlier from {GAPPY}""",
    "m",
)
def _(t: Tables):
    rows = t.moves.where("ply % 5 <> 3 and (cast(game_id as bigint) + ply) % 7 <> 0")
    value = F.col("eval_after_cp_white")
    # Parts of two rows: every sequence crosses their ends.
    lags = {"before": (value, 1), "earlier": (value, 2)}
    return W.lag_values(rows, ["provider", "game_id"], "ply", lags, block=2).select(
        "game_id", F.col("ply").cast("int").alias("ply"), "before", "earlier"
    )


@query(
    "f11_sequence_check",
    """select game_id, count(*) as rows, min(ply)::bigint first_ply, max(ply)::bigint last_ply,
    count(*) filter (where color <> case when ply%2=1 then 'white' else 'black' end) wrong_color,
    count(*)=max(ply) and min(ply)=1 and count(distinct ply)=count(*) valid from m group by 1""",
    "m",
)
def _(t: Tables):
    return W.sequence_check(t.moves, ["provider", "game_id"]).drop("provider")
