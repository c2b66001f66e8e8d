"""Evaluation: one row per gap with all methods, decisions against fixed and oracle choices, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.sql import outcome


def wide(errs: DataFrame, methods: list[str]) -> DataFrame:
    """Per gap and method: applicability, reason, RMSE, MAE and nRMSE as columns; best methods (the first of the
    portfolio on ties) and how many apply. The methods are given, so no pass over the data lists them."""
    reason = F.col("reason") if "reason" in errs.columns else F.lit(None).cast("string")
    cells = {"applicable": F.col("rmse").isNotNull(), "failure_reason": reason, "rmse": F.col("rmse"), "mae": F.col("mae"), "nrmse": F.col("nrmse")}
    of = lambda m, c: F.first(F.when(F.col("method") == m, c), True)
    low = lambda e: F.min(F.when(F.col(e).isNotNull(), F.struct(F.col(e), F.col("method_ord"), F.col("method"))))["method"]
    return errs.groupBy("gap_id", "series_id").agg(
        *[(F.coalesce(of(m, c), F.lit(False)) if k == "applicable" else of(m, c)).alias(f"{m}_{k}") for m in methods for k, c in cells.items()],
        *[low(e).alias(f"best_method_by_{e}") for e in ("rmse", "mae", "nrmse")],
        F.count("rmse").alias("n_applicable"),
    )


def learnable(record: DataFrame, needed: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose needed columns are all finite, and the others with a reason."""
    ok = F.lit(True)
    for c in needed:
        x = F.col(c).cast("double")
        ok = ok & F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))
    return record.where(ok), record.where(~ok).withColumn("reason", F.lit("non_finite_feature_or_method_target"))


def general_oracle(errs: DataFrame, group: str | None = None) -> DataFrame:
    """The fixed method with the lowest mean over all gaps, or over the means of groups; first on ties."""
    m = errs.groupBy("method", "method_ord").agg(F.avg("nrmse").alias("mean")) if group is None else errs.groupBy("method", "method_ord", group).agg(F.avg("nrmse").alias("x")).groupBy("method", "method_ord").agg(F.avg("x").alias("mean"))
    b = m.agg(F.min(F.struct("mean", "method_ord", "method")).alias("b"))
    return b.select(F.col("b.method").alias("method"), F.col("b.mean").alias("mean_nrmse"))


def decisions(errs: DataFrame, predicted: DataFrame, baseline: str) -> DataFrame:
    """Per gap: the method with the lowest predicted error, the true best, both errors and the baseline's,
    improvement over it, regret, whether they match, and the outcome. Ties go by the portfolio's order."""
    both = errs.join(predicted, ["gap_id", "method"])
    low = lambda e: F.min(F.when(F.col(e).isNotNull(), F.struct(F.col(e).alias("e"), F.col("method_ord"), F.col("method"), F.col("nrmse"))))
    d = both.groupBy("gap_id", "series_id").agg(low("predicted").alias("s"), low("nrmse").alias("o"), F.max(F.when(F.col("method") == baseline, F.col("nrmse"))).alias("baseline_nrmse"))
    d = d.select("gap_id", "series_id", F.col("s.method").alias("selected_method"), F.col("o.method").alias("oracle_method"), F.col("s.nrmse").alias("selected_nrmse"), "baseline_nrmse", F.col("o.nrmse").alias("oracle_nrmse"))
    return d.withColumns({
        "improvement": F.col("baseline_nrmse") - F.col("selected_nrmse"), "regret": F.col("selected_nrmse") - F.col("oracle_nrmse"),
        "oracle_match": F.col("selected_method") == F.col("oracle_method"), "outcome": outcome(F.col("selected_nrmse"), F.col("baseline_nrmse")),
    })


def summary(decided: DataFrame, ratio_of_means: bool = False) -> DataFrame:
    """Means per group and a macro row of unweighted means. The macro improvement in percent is the mean of the
    groups' percents, or the ratio of the macro means."""
    means = {c: F.avg(c) for c in ("selected_nrmse", "baseline_nrmse", "oracle_nrmse", "regret")} | {"match_rate": F.avg(F.col("oracle_match").cast("double"))}
    per = decided.groupBy("series_id").agg(F.count("*").alias("n"), *[x.alias(c) for c, x in means.items()])
    percent = lambda a, b: 100 * (F.col(b) - F.col(a)) / F.col(b)
    per = per.withColumn("improvement_percent", percent("selected_nrmse", "baseline_nrmse"))
    # each group's row counts for itself and for the macro row
    per = per.select(F.explode(F.array("series_id", F.lit("macro"))).alias("series_id"), *[c for c in per.columns if c != "series_id"])
    out = per.groupBy("series_id").agg(F.sum("n").alias("n"), *[F.avg(c).alias(c) for c in per.columns if c not in ("series_id", "n")])
    return out.withColumn("improvement_percent", F.when(F.col("series_id") == "macro", percent("selected_nrmse", "baseline_nrmse")).otherwise(F.col("improvement_percent"))) if ratio_of_means else out


def fixed_and_oracle(errs: DataFrame) -> DataFrame:
    """Per group: mean error of each method and of the per-gap best, and a macro row of unweighted means. Every gap's
    errors are one array, whose least is the oracle's, so nothing is computed twice."""
    one = errs.groupBy("gap_id", "series_id").agg(F.collect_list(F.struct("method", "nrmse")).alias("e"))
    oracle = F.array(F.struct(F.lit("oracle").alias("method"), F.array_min(F.transform("e", lambda x: x["nrmse"])).alias("nrmse")))
    per = one.select("series_id", F.explode(F.concat("e", oracle)).alias("x")).groupBy("series_id", "x.method").agg(F.avg("x.nrmse").alias("mean_nrmse"), F.count("x.nrmse").alias("n"))
    both = per.select("method", "mean_nrmse", "n", F.explode(F.array("series_id", F.lit("macro"))).alias("series_id"))
    return both.groupBy("series_id", "method").agg(F.avg("mean_nrmse").alias("mean_nrmse"), F.sum("n").alias("n"))


def method_shares(chosen: DataFrame, methods: list[str], column: str = "best_method", zero_filled: bool = True) -> DataFrame:
    """How often each method is chosen in each group, with its share of the group; zero-filled if asked."""
    g = chosen.groupBy("series_id").agg(F.count("*").alias("total"), *[F.count_if(F.col(column) == m).alias(f"n{i}") for i, m in enumerate(methods)])
    rows = F.array(*[F.struct(F.lit(m).alias(column), F.col(f"n{i}").alias("n")) for i, m in enumerate(methods)])
    out = g.select("series_id", "total", F.explode(rows).alias("x")).select("series_id", f"x.{column}", "x.n", (F.col("x.n") / F.col("total")).alias("share"))
    return out if zero_filled else out.where("n > 0")


def oracle_crosstab(chosen: DataFrame, methods: list[str], column: str = "best_method") -> DataFrame:
    """Row-normalised frequencies of methods: one row per group, one column per method."""
    return chosen.groupBy("series_id").agg(*[F.avg((F.col(column) == m).cast("double")).alias(m) for m in methods])


def coverage(expected: DataFrame, got: DataFrame, keys: list[str]) -> DataFrame:
    """How many rows each expected key has; 0 where there is none."""
    return expected.join(got.groupBy(*keys).agg(F.count("*").alias("n")), keys, "left").fillna(0, ["n"])


def selection_metrics(table: DataFrame, default: str = "pchip") -> DataFrame:
    """One row: error, regret and safety of choices against a default. Needs selected_method, selected_error,
    default_error, oracle_error, best_alternative_gain."""
    gain = F.col("default_error") - F.col("selected_error")
    switched, meaningful = F.col("selected_method") != default, F.col("best_alternative_gain") > 0
    won, false = switched & (gain > 0), switched & (gain <= 0)
    rate = lambda c: F.avg(c.cast("double"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    damage, benefit = F.when(false, -gain), F.when(won, gain)
    mean: Column = F.avg("default_error")
    return table.agg(
        F.count("*").alias("n_gaps"), F.avg("selected_error").alias("mean_nrmse"), F.avg(gain).alias("mean_improvement_vs_default"),
        F.when(mean > 0, (mean - F.avg("selected_error")) / mean).alias("relative_improvement_vs_default"), F.avg(F.col("selected_error") - F.col("oracle_error")).alias("mean_regret_vs_oracle"),
        rate(switched).alias("switch_rate"), (1 - rate(switched)).alias("retain_default_rate"), F.avg(F.when(switched, won.cast("double"))).alias("switch_precision"),
        F.avg(F.when(meaningful, switched.cast("double"))).alias("switch_recall"), rate(false).alias("false_switch_rate"), rate(~switched & meaningful).alias("missed_opportunity_rate"),
        zero(F.avg(damage)).alias("mean_false_switch_damage"), zero(F.median(damage)).alias("median_false_switch_damage"), zero(F.percentile(damage, 0.9)).alias("p90_false_switch_damage"),
        zero(F.max(damage)).alias("max_false_switch_damage"), zero(F.avg(benefit)).alias("mean_successful_switch_benefit"),
        ((zero(F.sum(benefit)) - zero(F.sum(damage))) / F.count("*")).alias("net_benefit_per_gap"),
    )
