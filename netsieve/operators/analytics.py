"""Statistics on results: differences, intervals, lift, overlap, F1, ranks, mass and separation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netsieve.functions.exprs import loose_session

# Two-sided 95 % points of Student's t by degrees of freedom; beyond them 1.96.
T95 = {1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262}


def t95(freedom: Column) -> Column:
    return reduce(lambda column, x: column.when(freedom == x[0], F.lit(x[1])), T95.items(), F.when(freedom < 1, F.lit(None).cast("double"))).otherwise(1.96)


def result_pivot(results: DataFrame, keys: list[str], experiment: str, value: str, experiments: list[str]) -> DataFrame:
    """One column for each experiment; the mean where a cell has several values."""
    return results.groupBy(*keys).pivot(experiment, experiments).agg(F.avg(value))


def delta(pivoted: DataFrame, a: str, b: str) -> DataFrame:
    """pivoted with ``delta`` in percentage points; null where a side is missing."""
    return pivoted.withColumn("delta", (F.col(a) - F.col(b)) * 100)


def seed_statistics(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, sd, least, greatest, half-width of the 95 % interval and verdict of a value over seeds."""
    n, sd = F.count(value), F.stddev_samp(value)
    out = rows.groupBy(*keys).agg(n.alias("n"), F.avg(value).alias("mean"), sd.alias("sd"), F.min(value).alias("least"), F.max(value).alias("greatest"), F.count_if(F.col(value) > 0).alias("positive"))
    half = t95(F.col("n") - 1) * F.col("sd") / F.sqrt(F.col("n"))
    out = out.withColumn("half", half)
    verdict = (
        F.when(F.col("sd").isNull(), "one value")
        .when(F.abs("mean") <= 2 * F.col("sd"), "within error")
        .when(F.col("mean") - F.col("half") > 0, "+")
        .when(F.col("mean") + F.col("half") < 0, "-")
        .otherwise("inconclusive")
    )
    return out.withColumn("verdict", verdict)


def missing_cells(grid: list[DataFrame], present: DataFrame, keys: list[str]) -> DataFrame:
    """The combinations of small key tables that the results lack."""
    every = reduce(lambda a, b: a.join(b, how="cross"), grid)
    return every.select(*keys).join(present.select(*keys).distinct(), keys, "left_anti")


def lift(wrong: DataFrame, noise: DataFrame, every: DataFrame, keys: list[str], group: list[str]) -> DataFrame:
    """(group, wrong, wrong_noise, total, total_noise, lift): noise among errors over noise among all."""
    flag = noise.select(*keys).distinct().withColumn("_noise", F.lit(1))
    bad = wrong.select(*keys).distinct().withColumn("_wrong", F.lit(1))
    marked = every.join(flag, keys, "left").join(bad, keys, "left")
    noisy, missed = F.col("_noise").isNotNull(), F.col("_wrong").isNotNull()
    out = marked.groupBy(*group).agg(F.count_if(missed).alias("wrong"), F.count_if(missed & noisy).alias("wrong_noise"), F.count("*").alias("total"), F.count_if(noisy).alias("total_noise"))
    share, base = F.try_divide(F.col("wrong_noise"), F.col("wrong")), F.try_divide(F.col("total_noise"), F.col("total"))
    return out.withColumn("lift", F.try_divide(share, base))


def lift_verdict(value: Column) -> Column:
    return F.when(value >= 1.3, "strong").when(value >= 1.05, "weak").when(value < 1, "reversed").otherwise("none")


def overlap(rows: DataFrame, a: Column, b: Column, group: list[str]) -> DataFrame:
    """both, precision of b for a, recall and Jaccard of two boolean marks."""
    n_a, n_b, both = F.count_if(a), F.count_if(b), F.count_if(a & b)
    out = rows.groupBy(*group).agg(n_a.alias("n_a"), n_b.alias("n_b"), both.alias("n_both"))
    return out.select(*group, "n_a", "n_b", "n_both", F.try_divide("n_both", "n_b").alias("precision"), F.try_divide("n_both", "n_a").alias("recall"), F.try_divide(F.col("n_both"), F.col("n_a") + F.col("n_b") - F.col("n_both")).alias("jaccard"))


def confusion(rows: DataFrame, true: str, pred: str) -> DataFrame:
    return rows.groupBy(true, pred).agg(F.count("*").alias("n"))


def class_scores(rows: DataFrame, true: str, pred: str) -> DataFrame:
    """(class, tp, fp, fn, precision, recall, f1) from one pass over the pairs."""
    pairs = confusion(rows, true, pred)
    sides = pairs.select(F.explode(F.array(F.struct(F.col(true).alias("class"), F.lit("t").alias("side")), F.struct(F.col(pred).alias("class"), F.lit("p").alias("side")))).alias("x"), "n", (F.col(true) == F.col(pred)).alias("hit"))
    by = sides.groupBy(F.col("x.class").alias("class")).agg(
        F.coalesce(F.sum(F.when(F.col("hit") & (F.col("x.side") == "t"), F.col("n"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(~F.col("hit") & (F.col("x.side") == "p"), F.col("n"))), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.when(~F.col("hit") & (F.col("x.side") == "t"), F.col("n"))), F.lit(0)).alias("fn"),
    )
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return by.select("*", F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"), f1.alias("f1"))


def macro_f1(rows: DataFrame, true: str, pred: str) -> DataFrame:
    """One row: macro F1 over the true classes, accuracy, n."""
    scores = class_scores(rows, true, pred).where(F.col("tp") + F.col("fn") > 0)
    return scores.agg(F.avg("f1").alias("macro_f1"), F.try_divide(F.sum("tp"), F.sum(F.col("tp") + F.col("fn"))).alias("accuracy"), F.sum(F.col("tp") + F.col("fn")).alias("n"))


def mean_ranks(rows: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """rows with the rank of a value within its group, ties sharing their mean rank."""
    w = Window.partitionBy(*group)
    first, same = F.rank().over(w.orderBy(value)), F.count("*").over(Window.partitionBy(*group, value))
    return rows.withColumn(name, first + (same - 1) / 2.0)


def spearman(rows: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    """Rank correlation of two values in each group, ties sharing their mean rank."""
    ranked = mean_ranks(mean_ranks(rows, group, a, "_a"), group, b, "_b")
    return ranked.groupBy(*group).agg(F.corr("_a", "_b").alias("spearman"), F.count("*").alias("n"))


def spearman_ordinal(rows: DataFrame, group: list[str], a: str, b: str, tie: str) -> DataFrame:
    """Rank correlation with ties told apart by a key."""
    w = Window.partitionBy(*group)
    ranked = rows.withColumn("_a", F.row_number().over(w.orderBy(a, tie))).withColumn("_b", F.row_number().over(w.orderBy(b, tie)))
    return ranked.groupBy(*group).agg(F.corr("_a", "_b").alias("spearman"), F.count("*").alias("n"))


def mass(long: DataFrame, row: str, key: list[str], weight: str, n: Column | None = None) -> DataFrame:
    """(key, mass): weights made to sum to 1 in each row, then averaged over the rows."""
    totals = long.groupBy(row).agg(F.sum(F.abs(weight)).alias("_total")).where("_total > 0")
    rows = totals.agg(F.count("*").alias("_rows"))
    share = F.abs(weight) / F.col("_total")
    out = long.join(totals, row).groupBy(*key).agg(F.sum(share).alias("_mass"))
    return out.join(F.broadcast(rows)).select(*key, (F.col("_mass") / F.col("_rows")).alias("mass"))


def histogram(rows: DataFrame, group: list[str], value: Column, bins: int = 256) -> DataFrame:
    """(group, bin, n) of whole values below ``bins``."""
    return rows.select(*group, value.alias("bin")).where(F.col("bin").between(0, bins - 1)).groupBy(*group, "bin").agg(F.count("*").alias("n"))


def centroids(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, centroid, size): the mean vector of each class, from partial sums by position."""
    parts = rows.select(label, F.posexplode(vector).alias("pos", "x")).groupBy(label, "pos").agg(F.avg("x").alias("m"), F.count("*").alias("size"))
    return parts.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"), F.max("size").alias("size"))


def distance(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def scatter(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, size, centroid, inner): the mean distance of a class's rows to its centroid."""
    centres = centroids(rows, label, vector)
    return rows.join(centres, label).groupBy(label).agg(F.count("*").alias("size"), F.first("centroid").alias("centroid"), F.avg(distance(vector, "centroid")).alias("inner"))


def davies_bouldin(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """One row: the Davies-Bouldin index and the separation ratio, from pairs of classes alone."""
    s = scatter(rows, label, vector)
    other = s.select(F.col(label).alias("_other"), F.col("centroid").alias("_centroid"), F.col("inner").alias("_inner"))
    pairs = s.join(F.broadcast(other), F.col(label) != F.col("_other")).withColumn("apart", distance("centroid", "_centroid"))
    worst = pairs.groupBy(label).agg(F.max(F.try_divide(F.col("inner") + F.col("_inner"), F.col("apart"))).alias("r"), F.avg("apart").alias("apart"), F.first("inner").alias("inner"))
    return worst.agg(F.avg("r").alias("davies_bouldin"), F.try_divide(F.avg("apart"), F.avg("inner")).alias("separation"))


def blend(first: DataFrame, rest: DataFrame, keys: list[str], a: str, others: list[str]) -> DataFrame:
    """One column from one variant and the others from another; cells that lack a side are left out."""
    both = first.select(*keys, a).join(rest.select(*keys, *others), keys)
    return both.where(reduce(lambda x, y: x & y, (F.col(c).isNotNull() for c in (a, *others))))


def top_jaccard(a: DataFrame, b: DataFrame, name: str, value: str, k: int) -> DataFrame:
    """One row: the Jaccard index of the k names of highest value on either side."""
    def best(rows: DataFrame, side: str) -> DataFrame:
        return rows.orderBy(F.desc(value), name).limit(k).select(name, F.lit(1).alias(side))

    both = best(a, "_a").join(best(b, "_b"), name, "full")
    return both.agg(F.try_divide(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()), F.count("*")).alias("jaccard"))


def running_max(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """rows with ``running_max``: the greatest value so far of each key."""
    return rows.withColumn("running_max", F.max(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def top_feature(rows: DataFrame, group: list[str], feature: str, value: str) -> DataFrame:
    """(group, feature, value): the feature of the greatest value, the first by name of equals."""
    best = rows.groupBy(*group).agg(F.min_by(F.struct(feature, value), F.struct((-F.col(value)).alias("v"), F.col(feature).alias("f"))).alias("_best"))
    return best.select(*group, F.col("_best")[feature].alias(feature), F.col("_best")[value].alias(value))


def error_composition(rows: DataFrame, group: list[str], truth: str, first: str, second: str, noise: Column) -> DataFrame:
    """Of each group the errors of two predictions, those of the first on noise, and those that only the first makes (and on noise)."""
    one, two = F.col(first) != F.col(truth), F.col(second) != F.col(truth)
    counts = {"e2": one, "e4": two, "e2_noise": one & noise, "gain": one & ~two, "gain_noise": one & ~two & noise}
    return rows.groupBy(*group).agg(*[F.count_if(c).alias(name) for name, c in counts.items()])


def noise_rate(listed: DataFrame, noise: DataFrame, keys: list[str], group: list[str]) -> DataFrame:
    """(group, n, noise, rate): how many of a list's rows are noise."""
    marks = noise.select(*keys).distinct().withColumn("_noise", F.lit(1))
    out = listed.join(marks, keys, "left").groupBy(*group).agg(F.count("*").alias("n"), F.count("_noise").alias("noise"))
    return out.withColumn("rate", F.try_divide("noise", "n"))


def wrong_noise(wrong: DataFrame, noise: DataFrame, name: str, session: str) -> DataFrame:
    """wrong with ``hit``: whether noise has the session, by its id if that has letters and else by its first digits."""
    exact = F.concat(F.lit("id:"), F.col(session))
    digits = F.concat(F.lit("n:"), F.regexp_extract(session, r"\d+", 0))
    known = noise.select(F.col(name), F.explode(F.array(exact, digits)).alias("_name")).distinct().withColumn("_hit", F.lit(True))
    found = wrong.withColumn("_name", loose_session(F.col(session))).join(known, [name, "_name"], "left")
    return found.withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_name", "_hit")


def seed_statistics_by_model(rows: DataFrame, dataset: list[str], model: str, value: str) -> DataFrame:
    """seed_statistics of a dataset over all its values, with the SD within models (mean of theirs) and between them (SD of their means).

    The verdict is 'within error' where the mean is at most twice the SD within;
    ``positive`` and ``negative`` count models by the sign of their mean.
    """
    cells = rows.where(F.col(value).isNotNull()).groupBy(*dataset, model).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.sum(F.pow(value, F.lit(2.0))).alias("squares"))
    n = F.sum("n")
    mean = F.sum(F.col("mean") * F.col("n")) / n
    out = cells.groupBy(*dataset).agg(
        n.alias("n"), mean.alias("mean"), F.avg("sd").alias("within"), F.stddev_samp("mean").alias("between"),
        F.sqrt(F.greatest((F.sum("squares") - n * mean * mean) / F.nullif(n - 1, F.lit(0)), F.lit(0.0))).alias("sd"),
        F.count_if(F.col("mean") > 0).alias("positive"), F.count_if(F.col("mean") < 0).alias("negative"),
    )
    half = t95(F.col("n") - 1) * F.col("sd") / F.sqrt("n")
    low, high = F.col("mean") - half, F.col("mean") + half
    verdict = F.when(F.abs("mean") <= 2 * F.col("within"), "within error").when(low > 0, "+").when(high < 0, "-").otherwise("inconclusive")
    return out.select(*dataset, "n", "mean", "within", "between", low.alias("low"), high.alias("high"), "positive", "negative", verdict.alias("verdict"))
