"""Published reports, each one query over result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsieve.operators.analytics import mean_ranks


def target_signal(pivoted: DataFrame, group: list[str]) -> DataFrame:
    """(group, models, mean_delta, positive): exp1 against exp3 in percentage points."""
    gap = (F.col("exp1") - F.col("exp3")) * 100
    return pivoted.groupBy(*group).agg(F.count(gap).alias("models"), F.avg(gap).alias("mean_delta"), F.count_if(gap > 0).alias("positive"))


def convergence(a: DataFrame, b: DataFrame, epoch: str, value: str) -> DataFrame:
    """(epoch, a, b, gap) over the epochs of either run."""
    both = a.select(epoch, F.col(value).alias("a")).join(b.select(epoch, F.col(value).alias("b")), epoch, "full")
    return both.withColumn("gap", F.col("a") - F.col("b"))


def last_epoch(log: DataFrame, run: list[str], epoch: str, value: str) -> DataFrame:
    """(run, epoch, value) of each run's last epoch."""
    last = log.groupBy(*run).agg(F.max_by(F.struct(epoch, value), epoch).alias("x"))
    return last.select(*run, "x.*")


def boundary(metrics: DataFrame, keys: list[str], experiment: str, value: str) -> DataFrame:
    """Silhouettes of exp1 and exp3, their difference and verdict."""
    wide = metrics.groupBy(*keys).pivot(experiment, ["exp1", "exp3"]).agg(F.avg(value)).withColumn("gap", F.col("exp1") - F.col("exp3"))
    return wide.withColumn("verdict", F.when(F.col("gap") > 0.02, "collapse").when(F.col("gap") < 0, "reversed").otherwise("none"))


def importance_shift(a: DataFrame, b: DataFrame, feature: str, value: str, artifact: str) -> DataFrame:
    """One row: rank correlation of two importance tables, artifact mass of either, their shift in points and verdict.

    Features of either side count; missing ones have importance 0. Mass is the
    share of the total; ``artifact`` is a pattern of feature names.
    """
    both = a.select(feature, F.col(value).alias("_a")).join(b.select(feature, F.col(value).alias("_b")), feature, "full").fillna(0, ["_a", "_b"])
    ranked = mean_ranks(mean_ranks(both.withColumn("_all", F.lit(1)), ["_all"], "_a", "_ra"), ["_all"], "_b", "_rb")
    marked = F.col(feature).rlike(artifact)

    def share(c: str) -> Column:
        return F.try_divide(F.sum(F.when(marked, F.col(c)).otherwise(0.0)), F.sum(c)) * 100

    out = ranked.agg(F.corr("_ra", "_rb").alias("spearman"), share("_a").alias("mass_a"), share("_b").alias("mass_b"))
    out = out.withColumn("shift", F.col("mass_b") - F.col("mass_a"))
    return out.withColumn("verdict", F.when(F.col("shift") < 0, "reversed").when(F.col("shift") > 5, "strong").otherwise("weak"))


def claims(a: DataFrame, b: DataFrame, keys: list[str], group: list[str], value: str) -> DataFrame:
    """(group, cells, a, b, stronger): means over the cells that both variants finished."""
    both = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys).where("_a IS NOT NULL AND _b IS NOT NULL")
    out = both.groupBy(*group).agg(F.count("*").alias("cells"), F.avg("_a").alias("a"), F.avg("_b").alias("b"))
    return out.withColumn("stronger", F.when(F.abs("a") > F.abs("b"), "a").when(F.abs("a") < F.abs("b"), "b").otherwise("equal"))


def zero_filled(origin: DataFrame, others: dict[str, DataFrame], name: str) -> DataFrame:
    """(name, origin, ...) class counts of several lists in the slots of the first, 0 where a class is gone, largest first."""
    out = origin.groupBy(name).agg(F.count("*").alias("origin"))
    for label, rows in others.items():
        out = out.join(rows.groupBy(name).agg(F.count("*").alias(label)), name, "left")
    return out.fillna(0, list(others)).orderBy(F.desc("origin"), name)


def mean_interval(rows: DataFrame, group: list[str], value: str, point: Column) -> DataFrame:
    """(group, n, mean, low, high, positive): a mean and its interval, ``point`` being the factor for n values."""
    out = rows.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count_if(F.col(value) > 0).alias("positive"))
    half = point * F.col("sd") / F.sqrt("n")
    return out.select(*group, "n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"), "positive")
