"""Comparisons, classifiers and run statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyboard.functions import scalars as S
from tallyboard.operators import joins as D
from tallyboard.operators import metrics as E
from tallyboard.operators import stats as X
from tallyboard.operators.filters import eligible
from tallyboard.plans.bindings import Tables
from tallyboard.plans.catalog import query
from tallyboard.plans.facts import COHORT, COHORT_SQL, FAMILIES

THRESHOLDS = (0.0, 0.5, 0.7, 0.85, 0.95)
TH_SQL = "(values (0.0::double),(0.5::double),(0.7::double),(0.85::double),(0.95::double)) th(threshold)"

STRATA = f"""cr as (select family grp, coalesce(player_key, game_id || ':' || color) cluster, score,
  case when rating-opponent_rating < -100 then 'below_-100' when rating-opponent_rating >= 100 then '100_plus'
  else '-100_to_99' end stratum from p join gx using (provider, game_id) where eligible and {COHORT_SQL}
  and family in ('URGENT','HIGH') and opponent_rating is not null),
ce as (select grp, stratum, count(*) n, sum(score) s from cr group by 1,2),
cw as (select *, count(*) over (partition by stratum) groups, sum(n) over (partition by stratum) pooled from ce),
ct as (select sum(n) retained from cw where groups=2)"""


def compared(t: Tables):
    return E.comparison_rows(t.players, t.games, families=FAMILIES, **COHORT)


@query(
    "e11_standardized_rate",
    """select grp as "group", sum(n)::bigint available_games, (sum(n) filter (where groups=2))::bigint common_games,
    sum(pooled/retained::double*s/n) filter (where groups=2) adjusted_score_rate from cw, ct group by 1""",
    "g p",
    STRATA,
)
def _(t: Tables):
    return X.standardized_rate(compared(t))


BOOT = """bc as (select cluster, sum(score) s, count(*) n from cr group by 1),
bi as (select *, row_number() over (order by sha256(cluster), cluster)-1 i from bc),
bn as (select count(*) n from bc),
dr as (select b, (('0x' || substr(sha256('7:' || b || ':' || slot),1,15))::ubigint % bn.n)::bigint i
  from range(0,200) r(b), (select i slot from bi) z, bn),
vals as (select b, sum(s)/sum(n)::double v from dr join bi using (i) group by 1),
ord as (select v, row_number() over (order by v)-1 k, count(*) over () m from vals where v is not null)"""


@query(
    "e12_cluster_bootstrap",
    """select (select sum(s)/sum(n)::double from bc) point, max(v) filter (where k=floor((m-1)*0.025)) lower,
    max(v) filter (where k=floor((m-1)*0.975)) upper, count(*) valid_resamples,
    (select n from bn) clusters from ord""",
    "g p",
    f"{STRATA}, {BOOT}",
)
def _(t: Tables):
    return X.cluster_bootstrap(
        compared(t),
        "cluster",
        {"s": F.sum("score"), "n": F.count("*")},
        lambda c: E.ratio(c["s"], c["n"]),
        resamples=200,
        seed=7,
    )


@query(
    "e12_case_bootstrap_poisson",
    """select point, max(v) filter (where k=floor((m-1)*0.025)) lower,
    max(v) filter (where k=ceil((m-1)*0.975)) upper, count(*) valid_resamples,
    (select count(*) from pcx) clusters from (select v, row_number() over (order by v)-1 k, count(*) over () m
    from (select b, sum(s*w)/sum(n*w)::double v from wt group by 1) where v is not null),
    (select sum(s)/sum(n)::double point from pcx) group by point""",
    "r",
    """pcx as (select cast(case_id as varchar) c, count(*) filter (where passed) s, count(*) n from r group by 1),
    un as (select b, s, n, ('0x' || substr(sha256('11:' || b || ':' || c),1,13))::ubigint::double/power(16,13) u
    from pcx, range(0,100) r(b)),
    cdf as (select k, sum(exp(-1)/gamma(k+1)) over (order by k) tail from range(0,20) r(k)),
    wt as (select b, s, n, (select count(*) from cdf where u>=tail) w from un)""",
)
def _(t: Tables):
    return X.cluster_bootstrap(
        t.attempts,
        "case_id",
        {"s": F.count_if("passed"), "n": F.count("*")},
        lambda c: E.ratio(c["s"], c["n"]),
        resamples=100,
        seed=11,
        rule="floor_ceil",
        method="poisson",
    )


LABELS = ["below_-100", "-100_to_99", "100_plus"]
DRAWN = """di as (select *, row_number() over (partition by grp order by sha256(c), c)-1 i, count(*) over (partition by grp) m from dv),
dd as (select a.grp, b, (('0x' || substr(sha256('9:' || a.grp || ':' || b || ':' || a.i),1,15))::ubigint % a.m)::bigint i
  from di a, range(0,150) r(b)),
dt as (select d.grp, d.b, {sums} from dd d join di using (grp, i) group by 1,2 union all
  select grp, -1, {sums} from dv group by 1),
dx as (select grp, b, {values} from dt),
du as (unpivot dx on {statistics} into name statistic value v),
dk as (select *, row_number() over (partition by grp, statistic order by v)-1 k, count(*) over (partition by grp, statistic)-1 z
  from du where b>=0 and v is not null)"""
ENDS = """select p.grp as "group", p.statistic, p.v as point, max(dk.v) filter (where k=floor(z*0.025)) lower,
  max(dk.v) filter (where k=floor(z*0.975)) upper, count(dk.v) valid_resamples,
  (select count(*) from dv where dv.grp=p.grp) clusters from du p left join dk using (grp, statistic) where p.b=-1 group by 1,2,3"""


@query(
    "e12_adjusted_rates",
    ENDS,
    "g p",
    f"""{STRATA}, wt as (select stratum, any_value(pooled)/(select retained from ct)::double w from cw where groups=2 group by 1),
    dv as (select grp, cluster c, {', '.join(f"sum(score) filter (where stratum='{s}') s{k}, count(*) filter (where stratum='{s}') n{k}"
        for k, s in enumerate(LABELS))} from cr group by 1,2),
    {DRAWN.format(
        sums=', '.join(f'sum(s{k}) s{k}, sum(n{k}) n{k}' for k in range(3)),
        values='+'.join(f"coalesce((select w*s{k}/nullif(n{k},0) from wt where stratum='{s}'), case when '{s}' not in (select stratum from wt) then 0 end)"
            for k, s in enumerate(LABELS)) + ' adjusted_score_rate',
        statistics='adjusted_score_rate')}""",
)
def _(t: Tables):
    return X.adjusted_rates(compared(t), LABELS, resamples=150, seed=9)


# --- classifiers -------------------------------------------------------------------


@query(
    "e27_confusion",
    """select l label, p prediction, count(c.id) cases,
    count(c.id)/nullif(sum(count(c.id)) over (partition by l),0)::double row_share
    from (values ('0'),('1')) a(l) cross join (values ('0'),('1'),('fallback')) b(p)
    left join c on cast(label as varchar)=l and cast(prediction as varchar)=p group by 1,2""",
    "c",
)
def _(t: Tables):
    return X.confusion(t.classified, [0, 1], "fallback")


@query(
    "e27_accuracy",
    """select count(*) cases, count(*) filter (where label=prediction) correct,
    count(*) filter (where label=prediction)/count(*)::double accuracy,
    count(*) filter (where label=prediction and label=1)/count(*) filter (where label=1)::double recall from c""",
    "c",
)
def _(t: Tables):
    return X.accuracy(t.classified, 1)


@query(
    "e27_status_matrix",
    """select a.s label, b.s prediction, count(r.run) cases,
    count(r.run)/nullif(sum(count(r.run)) over (partition by a.s),0)::double row_share
    from (values ('answered'),('needs_clarification'),('unsupported')) a(s)
    cross join (values ('answered'),('needs_clarification'),('unsupported'),('none')) b(s)
    left join r on expected_status=a.s and coalesce(emitted_status,'none')=b.s group by 1,2""",
    "r",
)
def _(t: Tables):
    statuses = ["answered", "needs_clarification", "unsupported"]
    rows = t.attempts.withColumn("emitted", F.coalesce("emitted_status", F.lit("none")))
    return X.confusion(rows, statuses, "none", "expected_status", "emitted")


CURVE = f"""sc as (select threshold, count(*) filter (where probability>=threshold)/count(*)::double coverage,
  count(*) filter (where probability>=threshold) accepted,
  count(*) filter (where probability>=threshold and label<>prediction) errors,
  count(*) filter (where probability>=threshold and label<>prediction)/
  nullif(count(*) filter (where probability>=threshold),0)::double error_rate,
  count(*) filter (where probability<threshold) fallbacks from c, {TH_SQL} group by 1)"""


@query("e28_selective_curve", "select * from sc", "c", CURVE)
def _(t: Tables):
    return X.selective_curve(t.classified, THRESHOLDS)


@query(
    "e29_choose_threshold",
    "select min(threshold) filter (where coverage>=0.1 and errors<=20) as threshold from sc",
    "c",
    CURVE,
)
def _(t: Tables):
    return X.choose_threshold(X.selective_curve(t.classified, THRESHOLDS), 0.1, 20)


@query(
    "e30_brier",
    """select avg(power(probability-label,2)) brier, count(*) probabilistic_cases, 0::bigint refusals from c""",
    "c",
)
def _(t: Tables):
    return X.brier(t.classified)


@query(
    "e30_brier_multiclass",
    """select avg(power(p0-(kind='low')::int,2)+power(p1-(kind='mid')::int,2)+power(p2-(kind='high')::int,2))
    filter (where guess<>'refused') brier, count(*) filter (where guess<>'refused') probabilistic_cases,
    count(*) filter (where guess='refused') refusals,
    count(*) filter (where guess in ('low') and kind not in ('low')) false_boundary_rejections
    from (select *, case when label=0 then 'low' when id%2=0 then 'mid' else 'high' end kind,
    case when id%9=0 then 'refused' when id%3=0 then 'low' when id%3=1 then 'mid' else 'high' end guess,
    probability p0, (1-probability)*0.25 p1, (1-probability)*0.75 p2 from c)""",
    "c",
)
def _(t: Tables):
    i, p = F.col("id"), F.col("probability")
    rows = t.classified.select(
        F.when(F.col("label") == 0, "low").when(i % 2 == 0, "mid").otherwise("high").alias("kind"),
        F.when(i % 9 == 0, "refused")
        .when(i % 3 == 0, "low")
        .when(i % 3 == 1, "mid")
        .otherwise("high")
        .alias("guess"),
        p.alias("p0"),
        ((1 - p) * 0.25).alias("p1"),
        ((1 - p) * 0.75).alias("p2"),
    )
    classes = {"low": "p0", "mid": "p1", "high": "p2"}
    return X.brier_multiclass(rows, classes, "kind", "guess", boundary=("low",))


RELIABILITY = """select i::int bin, i/10.0::double low, (i+1)/10.0::double high, count(c.id) as count,
  avg(probability) mean_predicted, avg(label) mean_observed from range(0,10) b(i)
  left join c on least(floor(probability*10),9)=i group by 1,2,3"""


@query("e31_reliability", RELIABILITY, "c")
def _(t: Tables):
    return X.reliability(t.classified, 10)


@query("e31_reliability_merged", RELIABILITY, "c")
def _(t: Tables):
    rows = t.classified
    parts = [X.reliability(rows.where(cut), 10) for cut in ("lang = 'en'", "lang <> 'en'")]
    return X.merge_bins(parts, 10)


RANKED = """rt as (select id, any_value(band) band, any_value(ply) ply, sum(weight) total,
  coalesce(max(weight) filter (where chosen),0) mine from k group by 1),
rp as (select rt.id, rt.band, rt.ply, coalesce(mine/nullif(total,0),0) probability,
  case when mine>0 then 1+(select count(*) from k where k.id=rt.id and k.weight>mine) else 0 end as rank from rt)"""
RANKED_OUT = """count(*) positions, avg(-ln(probability)) filter (where probability>0) log_loss,
  count(*) filter (where probability>0 and rank=1)/count(*)::double top1,
  count(*) filter (where probability>0 and rank<=3)/count(*)::double top3,
  count(*) filter (where probability<=0) zero_count, count(*) filter (where probability<=0)/count(*)::double zero_share"""


@query("e32_ranked_prediction_scores", f"select band, {RANKED_OUT} from rp group by 1", "k", RANKED)
def _(t: Tables):
    choices = X.ranked_choices(t.candidates, ["id"], carry=["band", "ply"])
    return X.ranked_prediction_scores(choices, ["band"])


@query("e32_ranked_by_ply", f"select ply, {RANKED_OUT} from rp group by 1", "k", RANKED)
def _(t: Tables):
    choices = X.ranked_choices(t.candidates, ["id"], carry=["band", "ply"])
    return X.ranked_prediction_scores(choices, ["ply"])


@query(
    "e12_ranked_intervals",
    ENDS,
    "k",
    f"""{RANKED}, dv as (select band grp, (id//4)::varchar c, count(*) n, count(*) filter (where probability>0) positive,
    sum(case when probability>0 then -ln(probability) else 0 end) loss, count(*) filter (where probability>0 and rank=1) one,
    count(*) filter (where probability>0 and rank<=3) three from rp group by 1,2),
    {DRAWN.format(
        sums='sum(n) n, sum(positive) positive, sum(loss) loss, sum(one) one, sum(three) three',
        values='loss/nullif(positive,0) log_loss, one/nullif(n,0)::double top1, three/nullif(n,0)::double top3',
        statistics='log_loss, top1, top3')}""",
)
def _(t: Tables):
    choices = X.ranked_choices(t.candidates, ["id"], carry=["band", "ply"])
    games = choices.withColumn("game", F.floor(F.col("id") / 4).cast("bigint"))
    return X.ranked_prediction_intervals(games, "band", "game", resamples=150, seed=9)


@query(
    "e51_cascade_policy",
    f"""select threshold, count(*) filter (where probability>=threshold) accepted,
    count(*) filter (where case when probability>=threshold then prediction else fb end = label) correct,
    sum(cost + case when probability>=threshold then 0 else 2*cost end) total_cost,
    sum(cost + case when probability>=threshold then 0 else 2*cost end)/nullif(count(*) filter (where
    case when probability>=threshold then prediction else fb end = label),0) cost_per_correct
    from (select *, case when id%5=0 then 0 else 1 end fb from c), {TH_SQL} group by 1""",
    "c",
)
def _(t: Tables):
    c = t.classified
    fallback = c.select(
        "id",
        F.when(F.col("id") % 5 == 0, 0).otherwise(1).alias("prediction"),
        (F.col("cost") * 2).alias("cost"),
    )
    return X.cascade_policy(c, fallback, c, THRESHOLDS)


@query(
    "e51_cascade_policy_boundary",
    f"""select threshold, count(*) filter (where u) accepted,
    count(*) filter (where case when u then prediction else fb end = label) correct,
    sum(cost + case when u then 0 else 2*cost end) total_cost, sum(cost + case when u then 0 else 2*cost end)/
    nullif(count(*) filter (where case when u then prediction else fb end = label),0) cost_per_correct
    from (select *, probability>=threshold and prediction=1 u from
    (select *, case when id%5=0 then 0 else 1 end fb from c), {TH_SQL}) group by 1""",
    "c",
)
def _(t: Tables):
    c = t.classified
    fallback = c.select(
        "id",
        F.when(F.col("id") % 5 == 0, 0).otherwise(1).alias("prediction"),
        (F.col("cost") * 2).alias("cost"),
    )
    return X.cascade_policy(c, fallback, c, THRESHOLDS, boundary=[1])


@query(
    "e52_changed_between",
    """select coalesce(a.id,b.id) id, a.prediction as first, b.p2 as repeat,
    case when a.id is null or b.id is null then 'missing' else 'changed' end kind
    from c a full join (select id, (probability>=0.45)::int p2 from c where label=1 or toxic_ok) b on a.id=b.id
    where a.id is null or b.id is null or a.prediction is distinct from b.p2""".replace(
        " where label=1 or toxic_ok", " where source<>'src1'"
    ),
    "c",
)
def _(t: Tables):
    again = t.classified.where("source <> 'src1'").withColumn(
        "prediction", (F.col("probability") >= 0.45).cast("int")
    )
    return X.changed_between(t.classified, again)


@query(
    "d12_prediction_join",
    """select id, prediction, label from c""",
    "c",
)
def _(t: Tables):
    predictions = t.classified.select("id", "prediction")
    return D.score_predictions_join(predictions, t.classified.select("id", "label"))


@query(
    "d12_prediction_join_issues",
    """select count(*) filter (where p.id is null) missing, count(*) filter (where l.doc_id is null) unexpected,
    count(*) filter (where coalesce(p.n,0)>1) duplicated from (select doc_id id, count(*) n from
    (select doc_id from documents union all select doc_id from labels where toxic=1) group by 1) p
    full join labels l on l.doc_id=p.id""",
)
def _(t: Tables):
    predictions = (
        t.raw("documents")
        .select("doc_id")
        .unionByName(t.raw("labels").where("toxic = 1").select("doc_id"))
    )
    return D.prediction_join_issues(predictions, t.raw("labels"), "doc_id")


# --- runs --------------------------------------------------------------------------

Z = X.Z_95


@query(
    "e33_wilson_interval",
    f"""select run, s passed, n trials, (p+{Z}*{Z}/(2*n))/(1+{Z}*{Z}/n)-{Z}*sqrt(p*(1-p)/n+{Z}*{Z}/(4*n*n))/
    (1+{Z}*{Z}/n) lower, (p+{Z}*{Z}/(2*n))/(1+{Z}*{Z}/n)+{Z}*sqrt(p*(1-p)/n+{Z}*{Z}/(4*n*n))/(1+{Z}*{Z}/n) upper
    from (select run, count(*) filter (where passed) s, count(*) n,
    count(*) filter (where passed)/count(*)::double p from r group by 1)""",
    "r",
)
def _(t: Tables):
    counts = t.attempts.groupBy("run").agg(
        F.count_if("passed").alias("passed"), F.count("*").alias("trials")
    )
    lower, upper = X.wilson_interval("passed", "trials")
    return counts.select("run", "passed", "trials", lower.alias("lower"), upper.alias("upper"))


@query(
    "e34_binomial_alert",
    """select rn.run, rn.category, passed, trials, baseline_rate, least(coalesce(max(k),-1), trials-1)::bigint cutoff,
    passed<=least(coalesce(max(k),-1), trials-1) alert from rn left join tails t on t.run=rn.run
    and t.category=rn.category and tail<=0.05 group by rn.run, rn.category, passed, trials, baseline_rate""",
    "r",
    """rn as (select run, category, count(*) filter (where passed) passed, count(*) trials, 0.62::double baseline_rate
    from r group by 1,2),
    tails as (select run, category, k, sum(exp(lgamma(trials+1)-lgamma(k+1)-lgamma(trials-k+1)+k*ln(baseline_rate)
    +(trials-k)*ln(1-baseline_rate))) over (partition by run, category order by k) tail
    from (select run, category, trials, baseline_rate, unnest(range(0, trials+1)) k from rn))""",
)
def _(t: Tables):
    runs = (
        t.attempts.groupBy("run", "category")
        .agg(F.count_if("passed").alias("passed"), F.count("*").alias("trials"))
        .withColumn("baseline_rate", F.lit(0.62))
    )
    return X.binomial_alert(runs, ["run", "category"])


@query(
    "e35_paired_sign_test",
    """select *, favor_left+favor_right discordant, cases-favor_left-favor_right ties,
    case when favor_left+favor_right=0 then 1.0 else least(1.0, 2*(select sum(exp(lgamma(favor_left+favor_right+1)
    -lgamma(k+1)-lgamma(favor_left+favor_right-k+1)-(favor_left+favor_right)*ln(2)))
    from range(0, least(favor_left, favor_right)+1) r(k))) end p_value
    from (select count(*) cases, 0::bigint unpaired, count(*) filter (where a>b) favor_left,
    count(*) filter (where b>a) favor_right from (select case_id, count(*) filter (where passed) a,
    count(*) filter (where seconds<280 or repair_count=0 and seconds<350) b from r group by 1))""",
    "r",
)
def _(t: Tables):
    other = (F.col("seconds") < 280) | ((F.col("repair_count") == 0) & (F.col("seconds") < 350))
    return X.paired_sign_test(t.attempts, t.attempts.withColumn("passed", other))


@query(
    "e36_flaky_and_hard_fail",
    """select run, count(*) filter (where a) always_cases, count(*) filter (where o and not a) flaky_cases,
    count(*) filter (where not o) never_cases, bool_or(h) hard_fail from (select run, case_id, bool_and(passed) a,
    bool_or(passed) o, bool_or(high_severity_miss) h from r group by 1,2) group by 1""",
    "r",
)
def _(t: Tables):
    return X.flaky_and_hard_fail(t.attempts)


@query(
    "e36_passes_per_repeat",
    "select run, repeat::int as repeat, count(*) filter (where passed) passed, count(*) attempted from r group by 1,2",
    "r",
)
def _(t: Tables):
    return X.passes_per_repeat(t.attempts)


@query(
    "e37_run_summary",
    """select run, category, count(*) attempted, count(emitted_status) completed, count(*) filter (where passed) passes,
    sum(cost) as cost, sum(input_tokens)::bigint input_tokens, sum(output_tokens)::bigint output_tokens,
    sum(repair_count)::bigint repairs, count(*) filter (where unsafe_answer) unsafe_answers,
    count(*) filter (where over_abstention) over_abstentions,
    count(*) filter (where high_severity_miss) high_severity_misses, median(seconds) median_seconds,
    count(*) filter (where passed)/count(*)::double pass_rate,
    sum(cost)/nullif(count(*) filter (where passed),0) cost_per_pass from r group by 1,2""",
    "r",
)
def _(t: Tables):
    return X.run_summary(t.attempts)


@query(
    "e37_failure_modes",
    "select run, category, failure_mode, count(*) as rows from r where failure_mode is not null group by 1,2,3",
    "r",
)
def _(t: Tables):
    return X.failure_modes(t.attempts, ["run", "category"])


@query(
    "e37_cost_ledger",
    """select run, sum(c2) known_cost, coalesce(sum(res) filter (where done and c2 is null),0) unsettled_reservation,
    count(*) filter (where done and c2 is null) unsettled_attempts from (select run, case when input_tokens%5<>0
    then cost end c2, 0.05::double res, emitted_status is not null done from r) group by 1""",
    "r",
)
def _(t: Tables):
    rows = t.attempts.select(
        "run",
        F.when(F.col("input_tokens") % 5 != 0, F.col("cost")).alias("cost"),
        F.lit(0.05).alias("reserved_cost"),
        F.when(F.col("emitted_status").isNotNull(), "completed").otherwise("failed").alias("status"),
    )
    return X.cost_ledger(rows)


@query(
    "e38_repeat_outcomes",
    """select coalesce(gr.case_id, r.case_id) case_id, coalesce(gr.run, r.run) run,
    coalesce(gr.i, r.repeat)::int as repeat, case when r.run is null then 'not_attempted' when passed then 'pass'
    else 'fail' end outcome, gr.run is not null planned from (select case_id, run, i from
    (select distinct case_id from r), (values ('click'),('view'),('error')) c(run), range(1,16) t(i)) gr
    full join r on r.case_id=gr.case_id and r.run=gr.run and r.repeat=gr.i""",
    "r",
)
def _(t: Tables):
    return X.repeat_outcomes(t.attempts, ["click", "view", "error"], 15)


@query(
    "e39_pareto_frontier",
    """select run, cost, rate from (select *, max(rate) over (order by cost, rate desc, run
    rows between unbounded preceding and 1 preceding) best from rc) where rate > coalesce(best,-1)""",
    "r",
    """rc as (select run || ':' || case_id run, sum(cost) as cost, count(*) filter (where passed)/count(*)::double rate
    from r group by 1)""",
)
def _(t: Tables):
    runs = t.attempts.groupBy(
        F.concat(F.col("run"), F.lit(":"), F.col("case_id").cast("string")).alias("run")
    ).agg(F.sum("cost").alias("cost"), F.avg(F.col("passed").cast("int")).alias("rate"))
    return X.pareto_frontier(runs)


@query(
    "e40_headline_cohort",
    """select run, repeats, cases, row_number() over (order by repeats desc, cases desc, runs desc, ids)=1
    or (repeats, cases, ids)=(select (repeats, cases, ids) from rg order by repeats desc, cases desc, runs desc
    limit 1) headline from rg""",
    "r",
    """rx as (select case when category<3 then run else run || '+' end run, case_id from r),
    ru as (select run, max(n) repeats, count(*) cases, list_sort(list(case_id)) ids from
    (select run, case_id, count(*) n from rx group by 1,2) group by 1),
    rg as (select *, count(*) over (partition by repeats, cases, ids) runs from ru)""",
)
def _(t: Tables):
    rows = t.attempts.withColumn(
        "run",
        F.when(F.col("category") < 3, F.col("run")).otherwise(F.concat("run", F.lit("+"))),
    )
    return X.headline_cohort(rows)


@query(
    "e50_matched_groups",
    """select run, min(run) over (partition by cases, low, high) group_first,
    count(*) over (partition by cases, low, high) group_size from rs""",
    "r",
    """rs as (select run || ':' || case_id run, count(*) cases, min(severity) low, max(category) high from r group by 1)""",
)
def _(t: Tables):
    runs = t.attempts.groupBy(
        F.concat(F.col("run"), F.lit(":"), F.col("case_id").cast("string")).alias("run")
    ).agg(
        F.count("*").alias("cases"),
        F.min("severity").alias("low"),
        F.max("category").alias("high"),
    )
    return X.matched_groups(runs, ["cases", "low", "high"]).select("run", "group_first", "group_size")


@query(
    "e45_timing_summary",
    """select run, min(seconds) minimum, max(seconds) maximum, count(*) runs, median(seconds) median,
    max(seconds)-min(seconds) spread from r group by 1""",
    "r",
)
def _(t: Tables):
    return X.timing_summary(t.attempts, ["run"])


@query(
    "e46_attempt_ledger",
    """select source, count(*) attempts, count(*) filter (where ok) completed,
    sum(bytes) filter (where ok)/sum(seconds) filter (where ok) bytes_per_second,
    count(*) filter (where ok and checksum is distinct from recorded) checksum_mismatches,
    count(distinct checksum) filter (where ok) versions,
    case when count(*) filter (where ok and checksum is distinct from recorded)>0 then 'error'
    when count(distinct checksum) filter (where ok)>1 then 'warning' else 'ok' end severity
    from (select source, doc_id%7<>0 ok, n_chars bytes, (doc_id%13+1)::double as seconds, lang checksum,
    case when doc_id%101=0 then 'x' else lang end recorded from documents) group by 1""",
)
def _(t: Tables):
    i = F.col("doc_id")
    attempts = t.texts.select(
        "source",
        F.when(i % 7 != 0, "ok").otherwise("failed").alias("status"),
        F.col("n_chars").alias("bytes"),
        (i % 13 + 1).cast("double").alias("seconds"),
        F.col("lang").alias("checksum"),
        F.when(i % 101 == 0, "x").otherwise(F.col("lang")).alias("recorded_checksum"),
    )
    return X.attempt_ledger(attempts)


@query(
    "e46_audit_pairs",
    """select doc_id source, case when l.doc_id is null then 'missing_receipt' when d.doc_id is null then
    'missing_source' else 'checksum_mismatch' end issue from documents d full join
    (select doc_id, case when toxic=1 then 'x' else '' end s from labels) l using (doc_id)
    where l.doc_id is null or d.doc_id is null or s='x'""",
)
def _(t: Tables):
    docs = t.texts.select(F.col("doc_id").alias("source"), F.lit("").alias("checksum"))
    receipts = t.raw("labels").select(
        F.col("doc_id").alias("source"),
        F.when(F.col("toxic") == 1, "x").otherwise("").alias("checksum"),
    )
    return X.audit_pairs(docs, receipts)


DIFF = """ba as (select 'game' suite, game_id case_id, rated passed, variant failures, time_control path, 'v1' as version
  from g where marked_bot=false),
cu as (select 'game' suite, game_id case_id, rated and source_ordinal%47<>0 passed, variant failures,
  case when source_ordinal%53=0 then '0+1' else time_control end path, 'v2' as version from g where result<>'*')"""


@query(
    "d11_diff_results",
    """select suite, case_id, label, ep expected_passed, gp got_passed from (
    select coalesce(ba.suite,cu.suite) suite, coalesce(ba.case_id,cu.case_id) case_id, ba.passed ep, cu.passed gp,
    unnest([case when ba.suite is null then 'ADDED' when cu.suite is null then 'REMOVED' end,
    case when ba.suite is not null and cu.suite is not null and (ba.passed is distinct from cu.passed
    or ba.failures is distinct from cu.failures) then case when coalesce(not ba.passed and cu.passed, false)
    then 'IMPROVEMENT' else 'REGRESSION' end end,
    case when ba.suite is not null and cu.suite is not null and ba.path is distinct from cu.path
    then 'PATH-CHANGED' end]) label from ba full join cu using (suite, case_id)) where label is not null
    union all select 'game', 'version', 'REGRESSION', null, null""",
    "g",
    DIFF,
)
def _(t: Tables):
    k = F.col("source_ordinal")

    def scored(rows, passed, path, version):
        return rows.select(
            F.lit("game").alias("suite"),
            F.col("game_id").alias("case_id"),
            passed.alias("passed"),
            F.col("variant").alias("failures"),
            path.alias("path"),
            F.lit(version).alias("version"),
        )

    before = scored(t.games.where(~F.col("marked_bot")), F.col("rated"), F.col("time_control"), "v1")
    after = scored(
        t.games.where("result <> '*'"),
        F.col("rated") & (k % 47 != 0),
        F.when(k % 53 == 0, "0+1").otherwise(F.col("time_control")),
        "v2",
    )
    return D.diff_results(before, after)


@query(
    "g04_seeded_sample",
    """select game_id, (select count(*) from gx) games_seen, (select count(*) from gx where eligible) games_eligible
    from gx where eligible order by sha256('42' || game_id), game_id limit 200""",
    "g",
)
def _(t: Tables):
    from tallyboard.operators.ml import seeded_sample

    return seeded_sample(t.games, eligible(), "game_id", 200, "42").select(
        "game_id", "games_seen", "games_eligible"
    )


@query(
    "b09_speed_class_counters",
    "select time_control, base_seconds+40*increment_seconds between 180 and 479 in_class, count(*) games from g group by 1,2",
    "g",
)
def _(t: Tables):
    return t.games.groupBy(
        "time_control", S.in_speed_class("base_seconds", "increment_seconds").alias("in_class")
    ).agg(F.count("*").alias("games"))
