"""Statistics of classifiers and runs, from additive counts wherever that is possible."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyboard.functions.scalars import hash_number
from tallyboard.operators.joins import join_back
from tallyboard.operators.metrics import ratio
from tallyboard.operators.windows import hash_rank
from tallyboard.session import materialize, spread

# Fixed value: the 97.5% standard normal quantile.
Z_95 = 1.959963984540054
ALERT_ALPHA = 0.05


# --- standardisation and bootstrap -------------------------------------------------


def standardized_rate(
    rows: DataFrame, group: str = "group", stratum: str = "stratum", score: str = "score"
) -> DataFrame:
    """Per group, the score rate weighted by pooled counts of the strata both groups have."""
    cells = rows.groupBy(F.col(group).alias("group"), F.col(stratum).alias("stratum")).agg(
        F.count("*").alias("n"), F.sum(score).alias("s")
    )
    return standardize_cells(cells)


def standardize_cells(cells: DataFrame, groups: int = 2) -> DataFrame:
    """As above from (group, stratum, n, s), a handful of rows."""
    by_stratum = Window.partitionBy("stratum")
    common = cells.withColumn("_groups", F.count("*").over(by_stratum)).withColumn(
        "_pooled", F.sum("n").over(by_stratum)
    )
    kept = F.col("_groups") == groups
    retained = common.where(kept).agg(F.sum("n")).scalar()
    rate = F.col("s") / F.col("n")
    return (
        common.withColumn("_retained", retained)
        .groupBy("group")
        .agg(
            F.sum("n").alias("available_games"),
            F.coalesce(F.sum(F.when(kept, F.col("n"))), F.lit(0)).alias("common_games"),
            F.sum(F.when(kept, F.col("_pooled") / F.col("_retained") * rate)).alias(
                "adjusted_score_rate"
            ),
        )
    )


def cluster_bootstrap(
    df: DataFrame,
    cluster: str,
    sums: dict[str, Column],
    statistic: Callable[[dict[str, Column]], Column],
    *,
    resamples: int = 400,
    seed: int = 1,
    alpha: float = 0.05,
    rule: str = "int",
    method: str = "slots",
) -> DataFrame:
    """Percentile interval of a statistic of sums under resampling of whole clusters.

    Rows are summed per cluster, clusters numbered in hash order, and every (replicate,
    slot) names its cluster by a digest, so the draws repeat on any engine. ``slots``
    draws exactly as many clusters as there are and moves ``resamples x clusters``
    narrow rows; ``poisson`` gives each cluster an independent Poisson(1) weight, needs
    no shuffle of draws, and is the one to use beyond some millions of clusters.
    Replicates without a value are dropped. ``rule`` is ``int`` (both ends cut down) or
    ``floor_ceil``.
    """
    if method not in ("slots", "poisson") or rule not in ("int", "floor_ceil"):
        raise ValueError("unknown method or rule")
    if resamples < 1 or not 0 < alpha < 1:
        raise ValueError("resamples must be positive and alpha inside (0, 1)")
    names = list(sums)
    clusters = df.groupBy(F.col(cluster).cast("string").alias("_c")).agg(
        *[s.alias(n) for n, s in sums.items()]
    )
    replicate = F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("_rep")
    if method == "slots":
        indexed = hash_rank(clusters, "_c", "_i").withColumn("_i", F.col("_i") - 1)
        count = clusters.agg(F.count("*")).scalar()
        draws = indexed.select(F.col("_i").alias("_slot"), replicate).select(
            "_rep",
            (
                hash_number(F.concat_ws(":", F.lit(seed), "_rep", "_slot"), 15)
                % count.cast("decimal(20,0)")
            )
            .cast("bigint")
            .alias("_i"),
        )
        weighted = draws.join(indexed, "_i")
        totals = weighted.groupBy("_rep").agg(*[F.sum(n).alias(n) for n in names])
    else:
        uniform = hash_number(F.concat_ws(":", F.lit(seed), "_rep", "_c"), 13).cast(
            "double"
        ) / F.lit(float(16**13))
        weight, tail, term = F.lit(0), 0.0, math.exp(-1)
        for k in range(20):  # P(X > 19) for Poisson(1) is below 1e-18
            tail += term
            weight = weight + F.when(uniform >= tail, 1).otherwise(0)
            term /= k + 1
        spread = clusters.select("*", replicate).withColumn("_w", weight).where("_w > 0")
        totals = spread.groupBy("_rep").agg(*[F.sum(F.col(n) * F.col("_w")).alias(n) for n in names])
    values = totals.select(statistic({n: F.col(n) for n in names}).alias("v")).where("v is not null")
    # One row per replicate from here on.
    ordered = values.select("v", F.row_number().over(Window.orderBy("v")).alias("_k"))
    valid = values.agg(F.count("*")).scalar()
    last = valid - 1
    low = F.floor(last * (alpha / 2))
    high = F.floor(last * (1 - alpha / 2)) if rule == "int" else F.ceil(last * (1 - alpha / 2))
    interval = ordered.agg(
        F.max(F.when(F.col("_k") - 1 == low, F.col("v"))).alias("lower"),
        F.max(F.when(F.col("_k") - 1 == high, F.col("v"))).alias("upper"),
        F.count("*").alias("valid_resamples"),
    )
    whole = clusters.agg(*[F.sum(n).alias(n) for n in names], F.count("*").alias("_n"))
    point = whole.select(
        F.struct(statistic({n: F.col(n) for n in names}).alias("p"), F.col("_n").alias("n"))
    ).scalar()
    return interval.withColumn("_w", point).select(
        F.col("_w.p").alias("point"), "lower", "upper", "valid_resamples", F.col("_w.n").alias("clusters")
    )


def grouped_bootstrap(
    df: DataFrame,
    group: str,
    cluster: str,
    sums: dict[str, Column],
    statistics: dict[str, Callable[[dict[str, Column]], Column]],
    *,
    fixed: DataFrame | None = None,
    resamples: int = 400,
    seed: int = 1,
    alpha: float = 0.05,
) -> DataFrame:
    """Percentile intervals of several statistics per group, from one resampling of clusters.

    Rows are summed once to a vector of ``sums`` per group and cluster, stored with its number
    in the shared folder, and only these vectors are drawn: as many as the group has clusters, each named by a digest of seed,
    group, replicate and slot, so every group has draws of its own. ``fixed`` has one row per
    group with columns taken from the full data, which statistics may use beside the sums.
    A replicate counts for a statistic where that has a value. Rows without a cluster are
    left out. One row per (group, statistic); a statistic without any value has nulls.
    """
    if resamples < 1 or not 0 < alpha < 1:
        raise ValueError("resamples must be positive and alpha inside (0, 1)")
    names = list(sums)
    vectors = df.where(F.col(cluster).isNotNull()).groupBy(
        F.col(group).alias("group"), F.col(cluster).cast("string").alias("_c")
    ).agg(*[s.alias(n) for n, s in sums.items()])
    # All that follows reads the stored vectors, so the plan has the work on ``df`` once.
    numbered = hash_rank(materialize(vectors, "vectors"), "_c", "_i", within=["group"])
    indexed = materialize(numbered.withColumn("_i", F.col("_i") - 1), "indexed")
    whole = indexed.groupBy("group").agg(*[F.sum(n).alias(n) for n in names], F.count("*").alias("clusters"))
    draw = hash_number(F.concat_ws(":", F.lit(seed), "group", "_rep", "_slot"), 15)
    # A few files of vectors are many draws.
    slots = spread(indexed.select("group", F.col("_i").alias("_slot"))).join(F.broadcast(whole.select("group", "clusters")), "group")
    drawn = (
        slots.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
        .withColumn("_i", (draw % F.col("clusters").cast("decimal(20,0)")).cast("bigint"))
        .groupBy("group", "_rep", "_i")
        .agg(F.count("*").alias("_w"))
    )
    # A cluster drawn several times in a replicate comes once, with its number.
    totals = drawn.join(indexed, ["group", "_i"]).groupBy("group", "_rep").agg(
        *[F.sum(F.col(n) * F.col("_w")).alias(n) for n in names]
    )

    def valued(rows: DataFrame, *carry: str) -> DataFrame:
        if fixed is not None:
            rows = rows.join(F.broadcast(fixed), "group", "left")  # one row per group
        columns = {c: F.col(c) for c in rows.columns}
        cells = [F.struct(F.lit(n).alias("statistic"), f(columns).cast("double").alias("v")) for n, f in statistics.items()]
        return rows.select("group", *carry, F.inline(F.array(*cells)))

    # One row per group, replicate and statistic from here on.
    values = valued(totals).where("v is not null")
    both = Window.partitionBy("group", "statistic")
    ranked = values.withColumn("_k", F.row_number().over(both.orderBy("v")) - 1).withColumn("_last", F.count("*").over(both) - 1)
    ends = ranked.groupBy("group", "statistic").agg(
        F.max(F.when(F.col("_k") == F.floor(F.col("_last") * (alpha / 2)), F.col("v"))).alias("lower"),
        F.max(F.when(F.col("_k") == F.floor(F.col("_last") * (1 - alpha / 2)), F.col("v"))).alias("upper"),
        F.count("*").alias("valid_resamples"),
    )
    return valued(whole, "clusters").withColumnRenamed("v", "point").join(ends, ["group", "statistic"], "left").select(
        "group", "statistic", "point", "lower", "upper", F.coalesce("valid_resamples", F.lit(0)).alias("valid_resamples"), "clusters"
    )


def adjusted_rates(
    rows: DataFrame, strata: Sequence[str], *, group: str = "group", stratum: str = "stratum", score: str = "score",
    cluster: str = "cluster", groups: int = 2, resamples: int = 400, seed: int = 1,
) -> DataFrame:
    """Stratum-adjusted score rates of groups, with intervals under resampling of clusters.

    Strata that all ``groups`` have keep the weights of the full data; a replicate in which
    one of them is empty has no value.
    """
    at = range(len(strata))
    own = [F.coalesce(F.col(stratum) == s, F.lit(False)) for s in strata]
    sums = {f"s{k}": F.sum(F.when(own[k], F.col(score)).otherwise(0.0)) for k in at} | {f"n{k}": F.count_if(own[k]) for k in at}
    cells = rows.groupBy(F.col(group).alias("group")).agg(*[F.count_if(own[k]).alias(f"n{k}") for k in at])
    pooled = cells.agg(
        *[F.when((F.count_if(F.col(f"n{k}") > 0) == groups), F.sum(f"n{k}")).otherwise(0).alias(f"p{k}") for k in at]
    ).select("*", sum(F.col(f"p{k}") for k in at).alias("kept"))
    weights = [pooled.select((F.col(f"p{k}") / F.nullif("kept", F.lit(0))).alias("w")).scalar() for k in at]
    fixed = cells.select("group", *[weights[k].alias(f"w{k}") for k in at])

    def rate(c: dict[str, Column]) -> Column:
        # A stratum of no weight takes no part; an empty one of some weight leaves no value.
        parts = [F.when(c[f"w{k}"] > 0, c[f"w{k}"] * ratio(c[f"s{k}"], c[f"n{k}"])).when(c[f"w{k}"] == 0, 0.0) for k in at]
        return sum(parts[1:], parts[0])

    return grouped_bootstrap(
        rows, group, cluster, sums, {"adjusted_score_rate": rate}, fixed=fixed, resamples=resamples, seed=seed
    )


def ranked_prediction_intervals(
    choices: DataFrame, group: str, cluster: str, *, resamples: int = 400, seed: int = 1
) -> DataFrame:
    """Log-loss, top-1 and top-3 of ranked choices per group, with intervals by clusters."""
    positive = F.col("probability") > 0
    sums = {
        "n": F.count("*"),
        "positive": F.count_if(positive),
        "loss": F.sum(F.when(positive, -F.ln(F.when(positive, F.col("probability")))).otherwise(0.0)),
        "one": F.count_if(positive & (F.col("rank") == 1)),
        "three": F.count_if(positive & (F.col("rank") <= 3)),
    }
    statistics = {
        "log_loss": lambda c: ratio(c["loss"], c["positive"]),
        "top1": lambda c: ratio(c["one"], c["n"]),
        "top3": lambda c: ratio(c["three"], c["n"]),
    }
    return grouped_bootstrap(choices, group, cluster, sums, statistics, resamples=resamples, seed=seed)


# --- classifiers -------------------------------------------------------------------


def confusion(
    scored: DataFrame,
    labels: Sequence,
    fallback: str | None = None,
    label: str = "label",
    prediction: str = "prediction",
) -> DataFrame:
    """Label by prediction in long form, zeros filled in, with row shares."""
    predicted = [*labels, *([fallback] if fallback else [])]
    counts = scored.groupBy(
        F.col(label).cast("string").alias("label"),
        F.col(prediction).cast("string").alias("prediction"),
    ).agg(F.count("*").alias("cases"))
    spark = scored.sparkSession
    grid = spark.range(1).select(
        F.explode(F.array(*[F.lit(str(x)) for x in labels])).alias("label")
    ).select(
        "label", F.explode(F.array(*[F.lit(str(x)) for x in predicted])).alias("prediction")
    )
    filled = grid.join(counts, ["label", "prediction"], "full_outer").withColumn(
        "cases", F.coalesce("cases", F.lit(0))
    )
    total = F.sum("cases").over(Window.partitionBy("label"))  # one row per prediction
    return filled.withColumn("row_share", ratio(F.col("cases"), total))


def accuracy(scored: DataFrame, recall_of, label="label", prediction="prediction") -> DataFrame:
    hit = F.col(label) == F.col(prediction)
    mine = F.col(label) == recall_of
    return scored.agg(
        F.count("*").alias("cases"),
        F.count_if(hit).alias("correct"),
        ratio(F.count_if(hit), F.count("*")).alias("accuracy"),
        ratio(F.count_if(hit & mine), F.count_if(mine)).alias("recall"),
    )


def _step(probability: Column, thresholds: Sequence[float]) -> Column:
    """How many of the ascending thresholds the probability reaches."""
    p = F.coalesce(probability, F.lit(-1.0))
    out = F.lit(0)
    for t in thresholds:
        out = out + F.when(p >= t, 1).otherwise(0)
    return out


def _threshold_sums(
    df: DataFrame, probability: str, thresholds: Sequence[float], sums: dict[str, Column]
) -> DataFrame:
    """Per threshold: sums over rows that reach it (``name``) and over the rest (``name_below``).

    Rows are summed once by the step they fall on, so the work does not grow with the
    number of thresholds and nothing is multiplied.
    """
    marks = sorted(thresholds)
    steps = df.groupBy(_step(F.col(probability), marks).alias("_step")).agg(
        *[s.alias(n) for n, s in sums.items()]
    )
    spine = df.sparkSession.range(len(marks)).select(
        (F.col("id") + 1).alias("_t"), F.element_at(F.array(*[F.lit(float(m)) for m in marks]), (F.col("id") + 1).cast("int")).alias("threshold")
    )
    # At most thresholds + 1 rows on either side; each step feeds the thresholds around it.
    fed = steps.withColumn("_t", F.explode(F.sequence(F.lit(1), F.lit(len(marks))))).withColumn(
        "_t", F.col("_t").cast("bigint")
    )
    above = F.col("_step") >= F.col("_t")
    got = fed.groupBy("_t").agg(
        *[F.coalesce(F.sum(F.when(above, F.col(n))), F.lit(0)).alias(n) for n in sums],
        *[F.coalesce(F.sum(F.when(~above, F.col(n))), F.lit(0)).alias(f"{n}_below") for n in sums],
    )
    return spine.join(got, "_t").drop("_t")


def selective_curve(
    scored: DataFrame,
    thresholds: Sequence[float],
    probability: str = "probability",
    label: str = "label",
    prediction: str = "prediction",
) -> DataFrame:
    """Per threshold: coverage, accepted, errors, error rate and fallbacks."""
    got = _threshold_sums(
        scored,
        probability,
        thresholds,
        {"n": F.count("*"), "hits": F.count_if(F.col(label) == F.col(prediction))},
    )
    return got.select(
        "threshold",
        ratio(F.col("n"), F.col("n") + F.col("n_below")).alias("coverage"),
        F.col("n").alias("accepted"),
        (F.col("n") - F.col("hits")).alias("errors"),
        ratio(F.col("n") - F.col("hits"), F.col("n")).alias("error_rate"),
        F.col("n_below").alias("fallbacks"),
    )


def choose_threshold(curve: DataFrame, minimum_coverage: float = 0.5, errors: int = 0) -> DataFrame:
    """Lowest threshold with few enough errors and enough coverage, or null."""
    fit = (F.col("coverage") >= minimum_coverage) & (F.col("errors") <= errors)
    return curve.agg(F.min(F.when(fit, F.col("threshold"))).alias("threshold"))


def brier(scored: DataFrame, probability: str = "probability", label: str = "label") -> DataFrame:
    """Mean squared error of the probability of a 0/1 label; refusals are counted apart."""
    p = F.col(probability)
    return scored.agg(
        F.avg(F.pow(p - F.col(label), 2)).alias("brier"),
        F.count(p).alias("probabilistic_cases"),
        F.count_if(p.isNull()).alias("refusals"),
    )


def brier_multiclass(
    scored: DataFrame,
    probabilities: dict[str, str],
    label: str = "label",
    prediction: str = "prediction",
    boundary: Sequence[str] = (),
) -> DataFrame:
    """Sum over classes, averaged over predictions of a known class; false boundary refusals too."""
    known = F.col(prediction).isin(*probabilities)
    loss = F.lit(0.0)
    for value, column in probabilities.items():
        hit = F.when(F.col(label) == value, 1.0).otherwise(0.0)
        loss = loss + F.pow(F.col(column) - hit, 2)
    wrong_refusal = F.col(prediction).isin(*boundary) & ~F.col(label).isin(*boundary)
    return scored.agg(
        F.avg(F.when(known, loss)).alias("brier"),
        F.count_if(known).alias("probabilistic_cases"),
        F.count_if(~F.coalesce(known, F.lit(False))).alias("refusals"),
        F.count_if(wrong_refusal if boundary else F.lit(False)).alias("false_boundary_rejections"),
    )


def reliability(
    scored: DataFrame,
    bins: int = 10,
    predicted: str = "probability",
    observed: str = "label",
    count: str | None = None,
) -> DataFrame:
    """Equal-width bins with 1.0 in the last; means weighted by count; empty bins stay, null.

    A probability that is null, not a number or outside 0 to 1 is refused: the job fails.
    """
    weight = F.lit(1) if count is None else F.col(count)
    given = F.col(predicted)
    p = F.when(given.between(0, 1), given).otherwise(
        F.raise_error(F.lit(f"{predicted} must be a number from 0 to 1")).cast("double")
    )
    index = F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")
    sums = (
        scored.groupBy(index.alias("bin"))
        .agg(
            F.sum(weight).alias("count"),
            F.sum(p * weight).alias("_p"),
            F.sum(F.col(observed) * weight).alias("_o"),
        )
    )
    return finish_bins(sums, bins)


def merge_bins(parts: Sequence[DataFrame], bins: int) -> DataFrame:
    """Bins of several parts added up: counts, and means back to sums."""
    out = None
    for part in parts:
        sums = part.select(
            "bin",
            "count",
            (F.coalesce("mean_predicted", F.lit(0.0)) * F.col("count")).alias("_p"),
            (F.coalesce("mean_observed", F.lit(0.0)) * F.col("count")).alias("_o"),
        )
        out = sums if out is None else out.unionByName(sums)
    added = out.groupBy("bin").agg(*[F.sum(c).alias(c) for c in ("count", "_p", "_o")])
    return finish_bins(added, bins)


def finish_bins(sums: DataFrame, bins: int) -> DataFrame:
    spine = sums.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (
        spine.join(sums, "bin", "left")
        .withColumn("count", F.coalesce("count", F.lit(0)).cast("bigint"))
        .select(
            "bin",
            (F.col("bin") / F.lit(bins)).alias("low"),
            ((F.col("bin") + 1) / F.lit(bins)).alias("high"),
            "count",
            ratio(F.col("_p"), F.col("count")).alias("mean_predicted"),
            ratio(F.col("_o"), F.col("count")).alias("mean_observed"),
        )
    )


def ranked_choices(
    candidates: DataFrame,
    keys: Sequence[str],
    weight: str = "weight",
    chosen: str = "chosen",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Per prediction: renormalised probability of the chosen item and its rank.

    Mass at or below zero is not counted. The rank is one more than the items with
    strictly more mass, and 0 where the chosen item has none.
    """
    w = F.when(F.col(weight) > 0, F.col(weight)).otherwise(F.lit(0.0))
    totals = candidates.groupBy(*keys).agg(
        F.sum(w).alias("_total"),
        F.coalesce(F.max(F.when(F.col(chosen), w)), F.lit(0.0)).alias("_mine"),
        F.count("*").alias("_n"),
        *[F.max(c).alias(c) for c in carry],
    )
    bigger = (
        join_back(candidates.select(*keys, w.alias("_w")), totals.select(*keys, "_mine", "_n"), keys, "_n")
        .groupBy(*keys)
        .agg(F.count_if(F.col("_w") > F.col("_mine")).alias("_bigger"))
    )
    return totals.join(bigger, list(keys)).select(
        *keys,
        *carry,
        F.coalesce(ratio(F.col("_mine"), F.col("_total")), F.lit(0.0)).alias("probability"),
        F.when(F.col("_mine") > 0, F.col("_bigger") + 1).otherwise(F.lit(0)).alias("rank"),
    )


def ranked_prediction_scores(choices: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Log-loss on positive mass; top-1 and top-3 with zero as a miss; share of zeros."""
    positive = F.col("probability") > 0
    grouped = choices.groupBy(*by) if by else choices.groupBy()
    return grouped.agg(
        F.count("*").alias("positions"),
        F.avg(F.when(positive, -F.ln(F.when(positive, F.col("probability"))))).alias("log_loss"),
        ratio(F.count_if(positive & (F.col("rank") == 1)), F.count("*")).alias("top1"),
        ratio(F.count_if(positive & (F.col("rank") <= 3)), F.count("*")).alias("top3"),
        F.count_if(~positive).alias("zero_count"),
        ratio(F.count_if(~positive), F.count("*")).alias("zero_share"),
    )


def cascade_policy(
    primary: DataFrame,
    fallback: DataFrame,
    truth: DataFrame,
    thresholds: Sequence[float],
    boundary: Sequence | None = None,
) -> DataFrame:
    """Per threshold: take the primary label if sure enough, else the fallback's.

    ``primary`` has (id, prediction, probability, cost), ``fallback`` (id, prediction,
    cost), ``truth`` (id, label). With ``boundary`` only those primary labels may be taken.
    """
    joined = (
        primary.select(
            "id",
            F.col("prediction").alias("_a"),
            F.col("probability").alias("_p"),
            F.col("cost").alias("_ca"),
        )
        .join(
            fallback.select(
                "id", F.col("prediction").alias("_b"), F.col("cost").alias("_cb")
            ),
            "id",
        )
        .join(truth.select("id", "label"), "id")
    )
    if boundary is not None:
        joined = joined.withColumn("_p", F.when(F.col("_a").isin(*boundary), F.col("_p")))
    got = _threshold_sums(
        joined,
        "_p",
        thresholds,
        {
            "n": F.count("*"),
            "a": F.count_if(F.col("_a") == F.col("label")),
            "b": F.count_if(F.col("_b") == F.col("label")),
            "ca": F.sum("_ca"),
            "cb": F.sum("_cb"),
        },
    )
    correct = F.col("a") + F.col("b_below")
    cost = F.col("ca") + F.col("ca_below") + F.col("cb_below")
    return got.select(
        "threshold",
        F.col("n").alias("accepted"),
        correct.alias("correct"),
        cost.alias("total_cost"),
        ratio(cost, correct).alias("cost_per_correct"),
    )


def changed_between(
    first: DataFrame, repeat: DataFrame, key: str = "id", value: str = "prediction"
) -> DataFrame:
    """Ids whose value differs between two repeats; unequal id sets show as missing."""
    a = first.select(key, F.col(value).alias("first"), F.lit(True).alias("_a"))
    b = repeat.select(key, F.col(value).alias("repeat"), F.lit(True).alias("_b"))
    j = a.join(b, key, "full_outer")
    kind = F.when(F.col("_a").isNull() | F.col("_b").isNull(), "missing").otherwise("changed")
    return j.where(
        F.col("_a").isNull() | F.col("_b").isNull() | ~F.col("first").eqNullSafe(F.col("repeat"))
    ).select(key, "first", "repeat", kind.alias("kind"))


# --- counts and tails --------------------------------------------------------------


def wilson_interval(successes: Column | str, trials: Column | str, z: float = Z_95):
    """Lower and upper Wilson bounds as columns; null without trials."""
    s = (F.col(successes) if isinstance(successes, str) else successes).cast("double")
    n = (F.col(trials) if isinstance(trials, str) else trials).cast("double")
    p = F.try_divide(s, n)
    z2 = z * z
    denom = 1 + F.try_divide(F.lit(z2), n)
    center = (p + F.try_divide(F.lit(z2), 2 * n)) / denom
    margin = (
        z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z2), 4 * n * n)) / denom
    )
    return center - margin, center + margin


def _ln_gamma(x: Column) -> Column:
    """Log of the gamma function for x >= 1, by Stirling's series after a shift of 8."""
    y = x + 8.0
    product = x
    for i in range(1, 8):
        product = product * (x + float(i))
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5))
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - F.ln(product)


def binomial_tails(df: DataFrame, keys: Sequence[str], trials: str, rate: str) -> DataFrame:
    """Lower-tail probabilities P(X <= k) around the mean, one row per key and k.

    Only k within 40 standard deviations below the mean and up to it plus 10 are made:
    all that lies lower adds nothing in double precision. A key costs some multiple of
    the square root of its trials, not its trials.
    """
    n, p = F.col(trials).cast("double"), F.col(rate).cast("double")
    mean, sd = n * p, F.sqrt(n * p * (1 - p))
    low = F.greatest(F.lit(0), F.floor(mean - 40 * sd - 40)).cast("bigint")
    high = F.least(F.col(trials), F.ceil(mean + 10 * sd + 10)).cast("bigint")
    inner = df.where((p > 0) & (p < 1))
    ks = inner.select(*keys, trials, rate, F.explode(F.sequence(low, high)).alias("k"))
    k = F.col("k").cast("double")
    log_pmf = (
        _ln_gamma(n + 1)
        - _ln_gamma(k + 1)
        - _ln_gamma(n - k + 1)
        + k * F.ln(p)
        + (n - k) * F.ln(1 - p)
    )
    w = Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return ks.withColumn("tail", F.least(F.sum(F.exp(log_pmf)).over(w), F.lit(1.0)))


def binomial_alert(
    runs: DataFrame,
    keys: Sequence[str],
    passes: str = "passed",
    trials: str = "trials",
    rate: str = "baseline_rate",
    alpha: float = ALERT_ALPHA,
) -> DataFrame:
    """Largest count whose lower tail is at most alpha, and whether the run is at or under it."""
    tails = binomial_tails(runs, keys, trials, rate)
    cut = tails.where(F.col("tail") <= alpha).groupBy(*keys).agg(F.max("k").alias("_cut"))
    cutoff = (
        F.when(F.col(rate) >= 1, F.col(trials) - 1)
        .otherwise(F.coalesce("_cut", F.lit(-1)))
        .cast("bigint")
    )
    return (
        runs.join(cut, list(keys), "left")
        .withColumn("cutoff", F.least(cutoff, F.col(trials) - 1))
        .withColumn("alert", F.col(passes) <= F.col("cutoff"))
        .drop("_cut")
    )


def paired_sign_test(
    left: DataFrame, right: DataFrame, case: str = "case_id", passed: str = "passed"
) -> DataFrame:
    """Exact two-sided sign test on the pass counts of paired cases.

    Cases must pair with equal numbers of scored repeats; while any does not,
    ``unpaired`` is positive and the p-value is withheld.
    """

    def per_case(df: DataFrame, s: str) -> DataFrame:
        return df.where(F.col(passed).isNotNull()).groupBy(case).agg(
            F.count("*").alias(f"n{s}"), F.count_if(passed).alias(f"p{s}")
        )

    pairs = per_case(left, "l").join(per_case(right, "r"), case, "full_outer")
    one = pairs.agg(
        F.count("*").alias("cases"),
        F.count_if(~F.col("nl").eqNullSafe(F.col("nr"))).alias("unpaired"),
        F.count_if(F.col("pl") > F.col("pr")).alias("favor_left"),
        F.count_if(F.col("pr") > F.col("pl")).alias("favor_right"),
    ).withColumns(
        {
            "discordant": F.col("favor_left") + F.col("favor_right"),
            "ties": F.col("cases") - F.col("favor_left") - F.col("favor_right"),
        }
    )
    tail = binomial_tails(
        one.select("discordant", F.least("favor_left", "favor_right").alias("least")).withColumn(
            "half", F.lit(0.5)
        ),
        ["least"],
        "discordant",
        "half",
    )
    found = tail.where(F.col("k") == F.col("least")).agg(F.max("tail")).scalar()
    p = F.when(F.col("discordant") == 0, 1.0).otherwise(
        F.least(F.lit(1.0), 2 * F.coalesce(found, F.lit(0.0)))
    )
    return one.withColumn("p_value", F.when((F.col("unpaired") == 0) & (F.col("cases") > 0), p))


# --- runs --------------------------------------------------------------------------


def case_stability(rows: DataFrame, by: Sequence[str] = ("run", "case_id")) -> DataFrame:
    """Always, flaky or never per case, and whether a high-severity attempt missed."""
    scored = rows.where(F.col("passed").isNotNull())
    state = (
        F.when(F.bool_and("passed"), "always").when(F.bool_or("passed"), "flaky").otherwise("never")
    )
    return scored.groupBy(*by).agg(
        state.alias("stability"),
        F.count_if("passed").alias("passes"),
        F.count("*").alias("attempts"),
        F.bool_or("high_severity_miss").alias("high_severity_miss"),
    )


def flaky_and_hard_fail(rows: DataFrame) -> DataFrame:
    """Per run: cases always, sometimes and never passed, and the hard-fail flag."""
    return (
        case_stability(rows)
        .groupBy("run")
        .agg(
            *[
                F.count_if(F.col("stability") == s).alias(f"{s}_cases")
                for s in ("always", "flaky", "never")
            ],
            F.bool_or("high_severity_miss").alias("hard_fail"),
        )
    )


def passes_per_repeat(rows: DataFrame) -> DataFrame:
    return rows.groupBy("run", "repeat").agg(
        F.count_if("passed").alias("passed"), F.count("*").alias("attempted")
    )


#: Ranks of approximate quantiles are off by at most rows / ACCURACY.
ACCURACY = 10_000


def exact_median(df: DataFrame, by: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """Exact median per group without bringing a group into one task.

    Approximate quantiles on both sides of the middle bracket it; values below the bracket
    are counted, those above left out, and only the few in it (about rows / 2,500, by
    distinct value) are ordered. Values far out change nothing.
    """
    keys = list(by)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    sides = [0.5 - 2 / ACCURACY, 0.5 + 2 / ACCURACY]
    brackets = rows.groupBy(*keys).agg(
        F.percentile_approx("_v", sides, ACCURACY).alias("_q"), F.count("*").alias("_n")
    )
    # Values are counted first, so a value that many rows share is one row from here on.
    counted = rows.groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
    spread = join_back(counted, brackets.withColumn("_rows", F.col("_n")), keys, "_rows")
    inside = F.when(F.col("_v") >= F.col("_q")[0], F.col("_v"))
    few = (
        spread.where(F.col("_v") <= F.col("_q")[1])
        .groupBy(*keys, inside.alias("_v"))
        .agg(F.sum("_c").alias("_c"), F.max("_n").alias("_n"))
    )
    # The one row of all values below comes first.
    run = (
        Window.partitionBy(*keys)
        .orderBy(F.col("_v").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    placed = few.withColumn("_end", F.sum("_c").over(run)).withColumn(
        "_start", F.col("_end") - F.col("_c")
    )
    low_rank, high_rank = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    hit = lambda r: F.max(F.when((F.col("_start") < r) & (F.col("_end") >= r), F.col("_v")))
    return placed.groupBy(*keys).agg(((hit(low_rank) + hit(high_rank)) / 2).alias(name))


def run_summary(rows: DataFrame, by: Sequence[str] = ("run", "category")) -> DataFrame:
    """Attempts, passes, cost and cost per pass, median time, tokens and repairs."""
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("attempted"),
        F.count("emitted_status").alias("completed"),
        F.count_if("passed").alias("passes"),
        F.sum("cost").alias("cost"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("repair_count").alias("repairs"),
        F.count_if("unsafe_answer").alias("unsafe_answers"),
        F.count_if("over_abstention").alias("over_abstentions"),
        F.count_if("high_severity_miss").alias("high_severity_misses"),
    )
    medians = exact_median(rows, by, "seconds", "median_seconds")
    return (
        sums.join(medians, list(by), "left")
        .withColumn("pass_rate", ratio("passes", "attempted"))
        .withColumn("cost_per_pass", ratio("cost", "passes"))
    )


def failure_modes(rows: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    failed = rows.where(F.col("failure_mode").isNotNull())
    return failed.groupBy(*by, "failure_mode").agg(F.count("*").alias("rows"))


def cost_ledger(rows: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """Known cost, and reservations of completed attempts whose cost is unknown."""
    unsettled = (F.col("status") == "completed") & F.col("cost").isNull()
    return rows.groupBy(*by).agg(
        F.sum("cost").alias("known_cost"),
        F.coalesce(F.sum(F.when(unsettled, F.col("reserved_cost"))), F.lit(0.0)).alias(
            "unsettled_reservation"
        ),
        F.count_if(unsettled).alias("unsettled_attempts"),
    )


def repeat_outcomes(rows: DataFrame, conditions: Sequence[str], repeats: int) -> DataFrame:
    """Outcome of every planned case, condition and repeat, and of any beyond the plan."""
    grid = (
        rows.select("case_id")
        .distinct()
        .select("case_id", F.explode(F.array(*[F.lit(c) for c in conditions])).alias("run"))
        .select("case_id", "run", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat"))
        .withColumn("_planned", F.lit(True))
    )
    seen = rows.select("case_id", "run", "repeat", "passed", F.lit(True).alias("_seen"))
    j = grid.join(seen, ["case_id", "run", "repeat"], "full_outer")
    outcome = (
        F.when(F.col("_seen").isNull(), "not_attempted")
        .when(F.col("passed").isNull(), "not_scored")
        .when(F.col("passed"), "pass")
        .otherwise("fail")
    )
    return j.select(
        "case_id",
        "run",
        "repeat",
        outcome.alias("outcome"),
        F.coalesce("_planned", F.lit(False)).alias("planned"),
    )


PARETO_BINS = 256


def pareto_frontier(runs: DataFrame, cost: str = "cost", rate: str = "rate", key: str = "run"):
    """Runs that no cheaper or equally cheap run matches or beats on the rate.

    One run per cost remains first. Costs are then cut at approximate quantiles, and the
    best rate of all cheaper parts is found before, so a task orders one part of them
    wherever they lie. Runs without a cost or rate are on no frontier.
    """
    known = runs.where(F.col(cost).isNotNull() & F.col(rate).isNotNull())
    best = known.groupBy(F.col(cost).alias("_cost")).agg(
        F.min_by(F.struct(*runs.columns), F.struct((-F.col(rate)).alias("r"), F.col(key).alias("k"))).alias("_row")
    )
    costs = best.agg(
        F.percentile_approx("_cost", [i / PARETO_BINS for i in range(1, PARETO_BINS)], ACCURACY).alias("q")
    ).scalar()
    rows = best.withColumn("_q", costs).select(
        "_cost", "_row", F.size(F.filter("_q", lambda q: q < F.col("_cost"))).alias("_bin")
    )
    value = F.col(f"_row.{rate}")
    tops = rows.groupBy("_bin").agg(F.max(value).alias("_m"))
    before = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    cheaper = tops.select("_bin", F.max("_m").over(before).alias("_before"))
    within = Window.partitionBy("_bin").orderBy("_cost").rowsBetween(Window.unboundedPreceding, -1)
    # At most PARETO_BINS rows.
    joined = rows.join(F.broadcast(cheaper), "_bin").withColumn("_here", F.max(value).over(within))
    top = F.greatest(F.coalesce("_before", F.lit(-1.0)), F.coalesce("_here", F.lit(-1.0)))
    return joined.where(value > top).select("_row.*")


def headline_cohort(rows: DataFrame) -> DataFrame:
    """Runs with their (repeats, id set) group and whether it is the headline one.

    An id set is compared by its size and an order-free sum of digests, so the ids of a
    run are never collected. Most repeats win, then the larger set, then more runs.
    """
    repeats = rows.groupBy("run", "case_id").agg(F.count("*").alias("_r"))
    digest = hash_number(F.col("case_id").cast("string"), 15).cast("decimal(38,0)")
    runs = repeats.groupBy("run").agg(
        F.max("_r").alias("repeats"),
        F.count("*").alias("cases"),
        F.sum(digest).cast("string").alias("id_set"),
    )
    cohorts = runs.groupBy("repeats", "cases", "id_set").agg(F.count("*").alias("runs"))
    first = (
        cohorts.orderBy(
            F.col("repeats").desc(), F.col("cases").desc(), F.col("runs").desc(), "id_set"
        )
        .limit(1)
        .withColumn("_head", F.lit(True))
        .drop("runs")
    )
    return runs.join(F.broadcast(first), ["repeats", "cases", "id_set"], "left").select(
        "run", "repeats", "cases", F.coalesce("_head", F.lit(False)).alias("headline")
    )


def matched_groups(runs: DataFrame, inputs: Sequence[str], key: str = "run") -> DataFrame:
    """Runs whose inputs are all equal, by the digest of the inputs and its first run.

    Pairwise equality of all inputs is an equivalence, so grouping by the inputs gives
    the same groups as joining pairs and following them.
    """
    from tallyboard.functions.scalars import fingerprint

    marked = runs.withColumn("group_digest", fingerprint(*inputs))
    heads = marked.groupBy("group_digest").agg(
        F.min(key).alias("group_first"), F.count("*").alias("group_size")
    )
    return marked.join(heads, "group_digest")


def timing_summary(rows: DataFrame, by: Sequence[str], value: str = "seconds") -> DataFrame:
    ends = rows.groupBy(*by).agg(
        F.min(value).alias("minimum"), F.max(value).alias("maximum"), F.count(value).alias("runs")
    )
    return ends.join(exact_median(rows, by, value), list(by)).withColumn(
        "spread", F.col("maximum") - F.col("minimum")
    )


def attempt_ledger(attempts: DataFrame) -> DataFrame:
    """Per source: attempts, successes, throughput, versions seen and the drift severity.

    ``attempts`` has (source, status, bytes, seconds, checksum, recorded_checksum).
    """
    ok = F.col("status") == "ok"
    mismatch = ok & ~F.col("checksum").eqNullSafe(F.col("recorded_checksum"))
    got = attempts.groupBy("source").agg(
        F.count("*").alias("attempts"),
        F.count_if(ok).alias("completed"),
        ratio(F.sum(F.when(ok, F.col("bytes"))), F.sum(F.when(ok, F.col("seconds")))).alias(
            "bytes_per_second"
        ),
        F.count_if(mismatch).alias("checksum_mismatches"),
        F.count_distinct(F.when(ok, F.col("checksum"))).alias("versions"),
    )
    severity = (
        F.when(F.col("checksum_mismatches") > 0, "error")
        .when(F.col("versions") > 1, "warning")
        .otherwise("ok")
    )
    return got.withColumn("severity", severity)


def audit_pairs(sources: DataFrame, receipts: DataFrame, key: str = "source") -> DataFrame:
    """Sources without a receipt, receipts without a source, and digests that differ."""
    s = sources.select(key, F.col("checksum").alias("_s"), F.lit(True).alias("_a"))
    r = receipts.select(key, F.col("checksum").alias("_r"), F.lit(True).alias("_b"))
    j = s.join(r, key, "full_outer")
    issue = (
        F.when(F.col("_b").isNull(), "missing_receipt")
        .when(F.col("_a").isNull(), "missing_source")
        .when(~F.col("_s").eqNullSafe(F.col("_r")), "checksum_mismatch")
    )
    return j.select(key, issue.alias("issue")).where(F.col("issue").isNotNull())
