"""The domain's tables as views over the given tables, for Spark and for DuckDB."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyboard.functions import scalars as S
from tallyboard.operators import windows as W
from tallyboard.session import spread, stored_table, tune, version

LINE_ORDER = (
    "l_partkey",
    "l_suppkey",
    "l_linenumber",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
    "l_returnflag",
    "l_linestatus",
    "l_shipdate",
)


class Tables:
    """Lazily built views over one folder of Parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = tune(spark), sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def games(self) -> DataFrame:
        return self.games_with()

    def games_with(self, *extra: str) -> DataFrame:
        k, status = F.col("o_orderkey"), F.col("o_orderstatus")
        inc = F.when(k % 3 == 1, 2).otherwise(0).cast("bigint")
        base = F.when(k % 3 == 0, 60).when(k % 3 == 1, 180).otherwise(300).cast("bigint")
        opening = (
            F.when(k % 11 == 0, F.lit(None).cast("string"))
            .when(k % 13 == 0, "   ")
            .otherwise(
                F.concat(
                    F.expr("substr(o_orderpriority, 3)"), F.lit(": line "), (k % 7).cast("string")
                )
            )
        )
        cents = F.round(F.col("o_totalprice") * 100).cast("bigint").cast("string")
        return self.raw("orders").select(
            F.lit("tpch").alias("provider"),
            k.cast("string").alias("game_id"),
            k.alias("source_ordinal"),
            F.when(k % 97 == 0, "*")
            .when(status == "F", "1-0")
            .when(status == "O", "0-1")
            .otherwise("1/2-1/2")
            .alias("result"),
            (k % 61 != 0).alias("rated"),
            F.when(k % 59 == 0, "Other").otherwise("Standard").alias("variant"),
            F.to_date("o_orderdate").alias("utc_date"),
            F.concat(base.cast("string"), F.lit("+"), inc.cast("string")).alias("time_control"),
            base.alias("base_seconds"),
            inc.alias("increment_seconds"),
            opening.alias("source_opening"),
            F.concat(F.lit("E"), (k % 5).cast("string")).alias("source_eco"),
            (k % 50 == 0).alias("marked_bot"),
            F.sha2(F.concat_ws("|", k.cast("string"), status, cents), 256).alias(
                "record_fingerprint"
            ),
            *extra,
        )

    @cached_property
    def games_plies(self) -> DataFrame:
        """Games with ``ply_count``, the number of their move rows."""
        counts = self.raw("lineitem").groupBy(F.col("l_orderkey").alias("source_ordinal")).agg(
            F.count("*").alias("ply_count")
        )
        return self.games.join(counts, "source_ordinal", "left").withColumn(
            "ply_count", F.coalesce("ply_count", F.lit(0))
        )

    @cached_property
    def players(self) -> DataFrame:
        k, c = F.col("o_orderkey"), F.col("o_custkey")
        white_rating = F.when(k % 23 != 0, 800 + (c * 37) % 1600)
        black_rating = 800 + (k * 53) % 1600
        status = F.col("o_orderstatus")
        white = F.when(k % 97 == 0, None).when(status == "F", 1.0).when(status == "O", 0.0)
        white = white.otherwise(0.5)

        def side(color, key, own, other, score):
            return F.struct(
                F.lit(color).alias("color"),
                key.alias("player_key"),
                own.alias("rating"),
                other.alias("opponent_rating"),
                score.cast("double").alias("score"),
            )

        sides = F.array(
            side(
                "white",
                F.when(k % 31 != 0, F.concat(F.lit("c"), c.cast("string"))),
                white_rating,
                black_rating,
                white,
            ),
            side(
                "black",
                F.concat(F.lit("c"), ((c * 7 + 3) % 1500).cast("string")),
                black_rating,
                white_rating,
                1 - white,
            ),
        )
        return self.raw("orders").select(
            F.lit("tpch").alias("provider"), k.cast("string").alias("game_id"), F.inline(sides)
        )

    @cached_property
    def moves(self) -> DataFrame:
        """Raw plies: clock and evaluation after each move; numbered and written once."""
        return self.stored("moves", self.numbered_moves)

    def numbered_moves(self) -> DataFrame:
        numbered = W.number_rows(
            self.raw("lineitem"), ["l_orderkey"], LINE_ORDER, F.col("l_partkey"), "ply"
        )
        mate = (F.col("l_returnflag") == "R") & (F.col("l_suppkey") % 29 == 0)
        points = F.floor("l_extendedprice").cast("bigint") % 1200 - 600
        return numbered.select(
            F.lit("tpch").alias("provider"),
            F.col("l_orderkey").cast("string").alias("game_id"),
            "ply",
            F.when(F.col("ply") % 2 == 1, "white").otherwise("black").alias("color"),
            (F.col("l_partkey") % 9).cast("string").alias("uci"),
            F.when(F.col("l_partkey") % 17 != 0, F.col("l_quantity") * 2).alias(
                "clock_after_seconds"
            ),
            F.when((F.col("l_returnflag") != "A") & ~mate, points).alias("eval_after_cp_white"),
            F.when(mate, 3).cast("bigint").alias("eval_after_mate_white"),
        )

    def stored(self, name: str, build) -> DataFrame:
        return stored_table(self.spark, (self.sf_dir, self.version, name), build)

    @cached_property
    def version(self) -> str:
        """Changes with the files of the folder, so no table of older files is read."""
        return version(self.spark, self.sf_dir)

    @cached_property
    def move_facts(self) -> DataFrame:
        """The published move facts: written once, then read by every metric on moves."""
        return self.stored("move_facts", lambda: W.move_facts(self.moves, self.games))

    @cached_property
    def plies(self) -> DataFrame:
        """Event sequences: a game is one user on one day."""
        events = self.raw("events").withColumn("day", F.to_date("ts"))
        minute = F.hour("ts") * 60 + F.minute("ts")
        numbered = W.number_rows(events, ["user_id", "day"], ["ts", "event_id"], minute, "ply")
        u = F.col("user_id")
        key = F.concat(
            F.col("event_type"), F.lit(":"), F.floor(F.col("value") / 100).cast("string")
        )
        return numbered.select(
            F.lit("ev").alias("provider"),
            F.concat(u.cast("string"), F.lit("-"), F.col("day").cast("string")).alias("game_id"),
            "ply",
            F.when(u % 2 == 0, "a").otherwise("b").alias("cohort"),
            F.when(u % 7 == 0, "")
            .otherwise(F.concat(F.lit("E"), (u % 3).cast("string")))
            .alias("eco"),
            F.col("event_type").alias("uci"),
            key.alias("position_key"),
            S.position_id(key).alias("position_id"),
        )

    @cached_property
    def visits(self) -> DataFrame:
        """The published visits: written once, then read by every ranking."""
        return self.stored("visits", self._visits)

    def _visits(self) -> DataFrame:
        seq = W.visit_sequence(self.plies, ["provider", "game_id"], max_ply=20)
        first = F.split_part("route", F.lit(" "), F.lit(1))
        return seq.withColumn(
            "opening_family", F.when(first == "error", "Unknown").otherwise(first)
        )

    @cached_property
    def earliest(self) -> DataFrame:
        return self.stored("earliest", lambda: W.earliest_visit(self.visits))

    @cached_property
    def sources(self) -> DataFrame:
        """Three overlapping source extracts, each with both ratings on the game row."""
        from tallyboard.sources.tables import union_sources

        k = F.col("source_ordinal")
        games = self.games_plies.withColumn(
            "source_event", F.when(k % 7 == 0, "Rated Bullet game").otherwise("Rated Blitz game")
        )
        metas = [
            (k % 2 == 0, ("s0", "2025-11", "f0", 0, "elite_reference")),
            (k % 3 == 0, ("s1", "2025-12", "f1", 1, "rated_public")),
            (k % 5 == 0, ("s2", "2013-01", "f2", 2, "rated_public")),
        ]
        return union_sources([(games.where(cut), self.players, meta) for cut, meta in metas])

    @cached_property
    def classified(self) -> DataFrame:
        """Labelled documents with a probability and a prediction."""
        d = self.raw("labels").join(self.raw("documents").select("doc_id", "source", "lang"), "doc_id")
        p = (F.col("doc_id") * 7919 % 1000) / F.lit(1000.0)
        return d.select(
            F.col("doc_id").alias("id"),
            "source",
            "lang",
            F.col("quality").alias("label"),
            p.alias("probability"),
            (p >= 0.5).cast("int").alias("prediction"),
            (((F.col("doc_id") * 31) % 100) / F.lit(1000.0)).alias("cost"),
        )

    @cached_property
    def candidates(self) -> DataFrame:
        """Four weighted candidates per labelled document; weights may be zero."""
        d = self.raw("labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
        j = F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("candidate")
        return d.select("id", "quality", "toxic", j).select(
            "id",
            "candidate",
            ((F.col("id") * (F.col("candidate") * 3 + 5)) % 11 / F.lit(10.0)).alias("weight"),
            (F.col("candidate") == F.col("id") % 4).alias("chosen"),
            S.model_band(800 + (F.col("id") * 53) % 1600).alias("band"),
            (F.col("id") % 6 + 1).cast("int").alias("ply"),
        )

    @cached_property
    def attempts(self) -> DataFrame:
        """Run rows: every event is one attempt of a case by a run."""
        minute = F.datediff("ts", F.lit("2024-01-01").cast("date")) * 1440 + F.hour("ts") * 60
        minute = minute + F.minute("ts")
        numbered = W.number_rows(
            self.raw("events"), ["event_type", "user_id"], ["ts", "event_id"], minute, "repeat"
        )
        u, e = F.col("user_id"), F.col("event_id")
        expected = (
            F.when(u % 3 == 0, "answered")
            .when(u % 3 == 1, "needs_clarification")
            .otherwise("unsupported")
        )
        emitted = (
            F.when(e % 4 == 0, "answered")
            .when(e % 4 == 1, "needs_clarification")
            .when(e % 4 == 2, "unsupported")
        )
        rows = numbered.select(
            F.col("event_type").alias("run"),
            u.alias("case_id"),
            "repeat",
            (F.col("value") < 300).alias("passed"),
            (F.col("value") / 10000).alias("cost"),
            F.col("value").alias("seconds"),
            (u % 6).alias("category"),
            F.when(u % 10 == 0, "high").otherwise("low").alias("severity"),
            expected.alias("expected_status"),
            emitted.alias("emitted_status"),
            (e % 11 == 0).alias("plan_hallucination"),
            (e % 1000).alias("input_tokens"),
            (e % 300).alias("output_tokens"),
            (e % 3).alias("repair_count"),
        )
        flags = S.attempt_flags("expected_status", "emitted_status")
        return rows.withColumns(
            {
                **flags,
                "high_severity_miss": (F.col("severity") == "high") & ~F.col("passed"),
            }
        ).withColumn(
            "failure_mode",
            S.failure_mode(
                "passed",
                "unsafe_answer",
                "over_abstention",
                "plan_hallucination",
                "expected_status",
                "emitted_status",
            ),
        )

    @cached_property
    def texts(self) -> DataFrame:
        return spread(self.raw("documents"))

    @cached_property
    def records(self) -> DataFrame:
        """Record texts, one per order: tags, a blank line, annotated moves, the result."""
        k = F.col("source_ordinal")
        custkey = F.col("o_custkey")
        wide = self.games_with("o_custkey")
        identifier = F.substring(F.sha2(k.cast("string"), 256), 1, 8)

        def tag(name, value):
            return F.concat(F.lit(f'[{name} "'), value.cast("string"), F.lit('"]\n'))

        text = F.concat(
            tag("Event", F.when(k % 61 == 0, "Casual game").otherwise("Rated Blitz game")),
            tag("Site", F.concat(F.lit("https://lichess.org/"), identifier)),
            F.when(k % 59 == 0, tag("Variant", F.lit("Atomic"))).otherwise(""),
            F.when(k % 67 == 0, '[Broken tag]\n').otherwise(""),
            tag("White", F.concat(F.lit("C"), custkey.cast("string"))),
            tag("Black", F.when(k % 31 == 0, "?").otherwise(F.concat(F.lit("D"), k.cast("string")))),
            tag("Result", F.col("result")),
            tag(
                "UTCDate",
                F.when(k % 29 == 0, "1995.??.??")
                .when(k % 71 == 0, "1995.13.40")
                .otherwise(F.date_format("utc_date", "yyyy.MM.dd")),
            ),
            tag(
                "UTCTime",
                F.concat(
                    F.lpad((k % 24).cast("string"), 2, "0"),
                    F.lit(":"),
                    F.lpad((k % 60).cast("string"), 2, "0"),
                    F.lit(":00"),
                ),
            ),
            tag("WhiteElo", F.when(k % 23 == 0, "?").otherwise((800 + k % 1600).cast("string"))),
            tag("BlackElo", F.when(k % 73 == 0, "12x").otherwise((900 + k % 1500).cast("string"))),
            tag("TimeControl", F.when(k % 37 == 0, "-").otherwise(F.col("time_control"))),
            F.when(
                F.col("source_opening").isNotNull(), tag("Opening", F.col("source_opening"))
            ).otherwise(""),
            F.when(k % 50 == 0, tag("WhiteTitle", F.lit("BOT"))).otherwise(""),
            F.lit("\n1. e4 { [%eval 0."),
            F.lpad((k % 100).cast("string"), 2, "0"),
            F.lit("] [%clk 0:01:"),
            F.lpad((k % 60).cast("string"), 2, "0"),
            F.lit("] } 1... e5 { [%eval "),
            F.when(k % 5 == 0, "#3").otherwise((-(k % 7)).cast("string")),
            F.lit("] [%clk 0:00:"),
            F.lpad((k % 58).cast("string"), 2, "0"),
            F.lit("] } 2. Nf3 { [%clk 0:00:07] } "),
            F.when(k % 79 == 0, "").otherwise(F.col("result")),
            F.lit("\n"),
        )
        return spread(wide).select(k.alias("ordinal"), text.alias("record"))


# --- the same views in SQL ---------------------------------------------------------

_VIEWS: dict[str, tuple[str, str]] = {
    "g": (
        "",
        """g as (select 'tpch' provider, cast(o_orderkey as varchar) game_id,
  o_orderkey source_ordinal, case when o_orderkey%97=0 then '*' when o_orderstatus='F' then '1-0'
  when o_orderstatus='O' then '0-1' else '1/2-1/2' end result, o_orderkey%61<>0 rated,
  case when o_orderkey%59=0 then 'Other' else 'Standard' end variant,
  cast(o_orderdate as date) utc_date,
  case o_orderkey%3 when 0 then '60+0' when 1 then '180+2' else '300+0' end time_control,
  cast(case o_orderkey%3 when 0 then 60 when 1 then 180 else 300 end as bigint) base_seconds,
  cast(case when o_orderkey%3=1 then 2 else 0 end as bigint) increment_seconds,
  case when o_orderkey%11=0 then null when o_orderkey%13=0 then '   '
  else substr(o_orderpriority,3) || ': line ' || (o_orderkey%7) end source_opening,
  'E' || (o_orderkey%5) source_eco, o_orderkey%50=0 marked_bot,
  sha256(o_orderkey || '|' || o_orderstatus || '|' || cast(round(o_totalprice*100) as bigint))
  record_fingerprint from orders),
gx as (select *, nullif(trim(split_part(source_opening, ':', 1)), '') family,
  result in ('1-0','0-1','1/2-1/2') and not marked_bot eligible,
  provider || ':' || game_id game_key from g)""",
    ),
    "gp": (
        "g",
        """gp as (select gx.*, coalesce(n, 0) ply_count from gx left join
  (select l_orderkey, count(*) n from lineitem group by 1) c on c.l_orderkey = source_ordinal)""",
    ),
    "p": (
        "",
        """pw as (select o_orderkey k, o_custkey c,
  case when o_orderkey%23<>0 then 800+(o_custkey*37)%1600 end wr, 800+(o_orderkey*53)%1600 br,
  case when o_orderkey%97=0 then null when o_orderstatus='F' then 1.0::double
  when o_orderstatus='O' then 0.0::double else 0.5::double end ws from orders),
p as (select 'tpch' provider, cast(k as varchar) game_id, 'white' color,
  case when k%31<>0 then 'c' || c end player_key, wr rating, br opponent_rating, ws score from pw
  union all select 'tpch', cast(k as varchar), 'black', 'c' || ((c*7+3)%1500), br, wr, 1-ws
  from pw)""",
    ),
    "m": (
        "",
        """m0 as (select *, row_number() over (partition by l_orderkey order by l_partkey, l_suppkey,
  l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
  l_shipdate) ply from lineitem),
m as (select 'tpch' provider, cast(l_orderkey as varchar) game_id, ply,
  case when ply%2=1 then 'white' else 'black' end color, cast(l_partkey%9 as varchar) uci,
  case when l_partkey%17<>0 then l_quantity*2 end clock_after_seconds,
  case when l_returnflag<>'A' and not (l_returnflag='R' and l_suppkey%29=0)
  then cast(floor(l_extendedprice) as bigint)%1200-600 end eval_after_cp_white,
  case when l_returnflag='R' and l_suppkey%29=0 then 3::bigint end eval_after_mate_white
  from m0)""",
    ),
    "mf": (
        "g m",
        """mf0 as (select m.* exclude(clock_after_seconds), case when clock_after_seconds < 0 or
  (increment_seconds=0 and clock_after_seconds > base_seconds) then null
  else clock_after_seconds end clock_after_seconds from m join g using (provider, game_id)),
mf1 as (select *, lag(clock_after_seconds, 2) over w clock_before_seconds,
  lag(eval_after_cp_white) over w eval_before_cp_white,
  lag(eval_after_mate_white) over w eval_before_mate_white from mf0
  window w as (partition by provider, game_id order by ply)),
mf2 as (select *, case when eval_before_cp_white is not null and eval_after_cp_white is not null
  then greatest(0, case when color='white' then eval_before_cp_white-eval_after_cp_white
  else eval_after_cp_white-eval_before_cp_white end) end centipawn_deterioration from mf1),
mf as (select *, centipawn_deterioration >= 200 error_proxy,
  case when clock_before_seconds is null or clock_before_seconds < 0 then null
  when clock_before_seconds < 10 then 'under_10' when clock_before_seconds < 30 then '10_to_29'
  when clock_before_seconds < 60 then '30_to_59' else '60_plus' end clock_bucket,
  case when ply <= 20 then 'early_ply' when ply <= 60 then 'middle_ply' else 'late_ply' end
  phase_proxy from mf2)""",
    ),
    "v": (
        "",
        """v0 as (select *, row_number() over (partition by user_id, cast(ts as date)
  order by ts, event_id) ply, cast(ts as date) d from events),
v1 as (select 'ev' provider, user_id || '-' || d game_id, ply,
  case when user_id%2=0 then 'a' else 'b' end cohort,
  case when user_id%7=0 then '' else 'E' || (user_id%3) end eco, event_type uci,
  event_type || ':' || cast(floor(value/100) as bigint) position_key from v0),
v2 as (select *, substr(sha256(position_key),1,24) position_id,
  row_number() over (partition by provider, game_id, position_key order by ply) nth from v1),
v3 as (select *, string_agg(uci, ' ') over (w rows unbounded preceding) route,
  max(case when nth>1 then 1 else 0 end) over (w rows unbounded preceding)=1 route_has_repeat,
  coalesce(lead(uci) over w, '') next_move from v2
  window w as (partition by provider, game_id order by ply)),
v as (select * exclude(nth), case when split_part(route,' ',1)='error' then 'Unknown'
  else split_part(route,' ',1) end opening_family from v3 where ply <= 20),
e as (select * from v qualify row_number() over
  (partition by provider, game_id, position_id order by ply) = 1)""",
    ),
    "i": (
        "gp p",
        """ib as (select gp.*, w.rating white_rating, b.rating black_rating,
  case when source_ordinal%7=0 then 'Rated Bullet game' else 'Rated Blitz game' end source_event
  from gp join p w on w.game_id=gp.game_id and w.color='white'
  join p b on b.game_id=gp.game_id and b.color='black'),
i as (select *, 's0' source_snapshot_id, '2025-11' source_period, 'f0' source_file, 0 source_rank,
  'elite_reference' source_cohort from ib where source_ordinal%2=0 union all
  select *, 's1', '2025-12', 'f1', 1, 'rated_public' from ib where source_ordinal%3=0 union all
  select *, 's2', '2013-01', 'f2', 2, 'rated_public' from ib where source_ordinal%5=0),
retained as (select * from i qualify row_number() over
  (partition by provider, game_id order by source_rank)=1),
low_high as (select *, case when white_rating+black_rating is not null then list_sort([white_rating, black_rating]) end lh from retained),
training as (select * exclude(lh) from low_high where lh[1]>=1000 and not (marked_bot or result='*') and ply_count>2
  and source_period is distinct from '2013-01' and case source_cohort when 'elite_reference'
  then lh[1]>=2000 and lh[2]>=2200 and position('bullet' in lower(source_event))=0 else true end)""",
    ),
    "c": (
        "",
        """c as (select l.doc_id id, source, lang, quality as label,
  (l.doc_id*7919%1000)/1000.0::double probability,
  cast((l.doc_id*7919%1000) >= 500 as int) prediction, ((l.doc_id*31)%100)/1000.0::double as cost
  from labels l join documents d on d.doc_id=l.doc_id)""",
    ),
    "k": (
        "",
        """k0 as (select doc_id id, unnest([0,1,2,3]) candidate from labels),
k as (select id, candidate, ((id*(candidate*3+5))%11)/10.0::double weight,
  candidate=id%4 chosen, case when 800+(id*53)%1600<1000 then 'below-1000'
  when 800+(id*53)%1600<1600 then '1000–1599' when 800+(id*53)%1600<2000 then '1600–1999'
  when 800+(id*53)%1600<2300 then '2000–2299' else '2300+' end band,
  cast(id%6+1 as int) ply from k0)""",
    ),
    "r": (
        "",
        """r0 as (select event_type run, user_id case_id, row_number() over
  (partition by event_type, user_id order by ts, event_id) repeat, value<300 passed,
  value/10000 as cost, value as seconds, user_id%6 category,
  case when user_id%10=0 then 'high' else 'low' end severity,
  case user_id%3 when 0 then 'answered' when 1 then 'needs_clarification' else 'unsupported' end
  expected_status, case event_id%4 when 0 then 'answered' when 1 then 'needs_clarification'
  when 2 then 'unsupported' end emitted_status, event_id%11=0 plan_hallucination,
  event_id%1000 input_tokens, event_id%300 output_tokens, event_id%3 repair_count from events),
r as (select *, expected_status<>'answered' and coalesce(emitted_status,'')='answered'
  unsafe_answer, expected_status='answered' and coalesce(emitted_status,'') in
  ('needs_clarification','unsupported') over_abstention,
  severity='high' and not passed high_severity_miss,
  case when passed then null
  when expected_status<>'answered' and coalesce(emitted_status,'')='answered' then 'unsafe'
  when expected_status='answered' and emitted_status in ('needs_clarification','unsupported')
  then 'over_abstention' when plan_hallucination or emitted_status is null
  then 'plan_hallucination'
  when expected_status<>'answered' and emitted_status<>'answered'
  and expected_status<>emitted_status then 'boundary_swap'
  when expected_status='answered' and emitted_status='answered' then 'wrong_answer'
  else 'other' end failure_mode from r0)""",
    ),
}


def prelude(names: list[str]) -> str:
    """The common table expressions of the named views and of those they need."""
    done: list[str] = []

    def add(name: str) -> None:
        if name in done:
            return
        needs, _ = _VIEWS[name]
        for other in needs.split():
            add(other)
        done.append(name)

    for name in names:
        add(name)
    return ",\n".join(_VIEWS[name][1] for name in done)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
