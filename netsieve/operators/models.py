"""Modelling surface: experiment grids, spark.ml adapters, confident learning, silhouettes."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netsieve.operators.analytics import centroids, distance
from netsieve.operators.lists import folds, order_key

# Which list trains and which tests in each experiment, and the seeds.
EXPERIMENTS = {"exp1": ("denoised", "denoised"), "exp2": ("denoised", "noisy"), "exp3": ("noisy", "denoised"), "exp4": ("noisy", "noisy")}
VARIANTS, SEEDS = ("full", "sizectrl", "strat"), (42, 1, 7, 2024, 31337)


def grid(datasets: list[str], models: list[str], variants: tuple[str, ...] = VARIANTS, seeds: tuple[int, ...] = SEEDS) -> list[dict]:
    """Every run of the design, in order."""
    return [
        {"dataset": d, "model": m, "variant": v, "seed": s, "exp": e, "train": EXPERIMENTS[e][0], "test": EXPERIMENTS[e][1]}
        for d, m, v, s, e in product(datasets, models, variants, seeds, EXPERIMENTS)
    ]


def unfinished(runs: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """Runs that the result log lacks."""
    return runs.join(log.select(*keys).distinct(), keys, "left_anti")


def keep_better(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row for each key, that of the higher value; of equals the old one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(value, -F.col("_new"))).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest])


def fit_forest(train: DataFrame, test: DataFrame, features: list[str], label: str, trees: int = 300, seed: int = 42) -> DataFrame:
    """test with ``prediction``: a random forest on columns, missing values as -1."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    fill = lambda df: df.fillna(-1, subset=features)
    assembled = VectorAssembler(inputCols=features, outputCol="_features")
    forest = RandomForestClassifier(featuresCol="_features", labelCol=label, numTrees=trees, seed=seed, rawPredictionCol="_raw", probabilityCol="_probability")
    model = forest.fit(assembled.transform(fill(train)))
    return model.transform(assembled.transform(fill(test))).drop("_features", "_raw")


def class_probabilities(rows: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """(key, label, class, p): softmax of the negative distances to the class centroids.

    The centroids, one row a class, become one array that every row reads: no
    shuffle of rows, and no join of rows and classes.
    """
    centres = centroids(rows, label, vector).agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("class"), "centroid"))).alias("_centres"))
    scored = rows.select(key, label, vector).join(F.broadcast(centres), how="cross")  # one row on the right side
    apart = F.transform("_centres", lambda c: F.exp(-distance(F.col(vector), c["centroid"])))
    scored = scored.select(key, label, F.col("_centres.class").alias("_classes"), apart.alias("_e"))
    total = F.aggregate("_e", F.lit(0.0), lambda a, e: a + e)
    each = scored.select(key, label, F.explode(F.arrays_zip(F.col("_classes").alias("class"), F.transform("_e", lambda e: e / total).alias("p"))).alias("_c"))
    return each.select(key, label, "_c.class", "_c.p")


def confident_flags(rows: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """(key, label, best, quality, is_issue): confident learning on centroid probabilities.

    A class's threshold is the mean probability of its own rows; the best class
    is the most probable of those at or above their threshold (the label if
    there is none), and a row whose best class is another one is an issue.
    """
    p = class_probabilities(rows, key, label, vector)
    own = F.col(label) == F.col("class")
    thresholds = p.where(own).groupBy("class").agg(F.avg("p").alias("threshold"))
    judged = p.join(F.broadcast(thresholds), "class")
    sure = F.col("p") >= F.col("threshold")
    out = judged.groupBy(key, label).agg(F.max_by(F.when(sure, F.col("class")), F.when(sure, F.struct("p", -F.col("class")))).alias("best"), F.max(F.when(own, F.col("p"))).alias("quality"))
    best = F.coalesce("best", label)
    return out.select(key, label, best.alias("best"), F.round("quality", 6).alias("quality"), (best != F.col(label)).cast("int").alias("is_issue"))


def held_out_probabilities(rows: DataFrame, key: str, label: str, vector: str, folds_: int = 5, seed: int = 42) -> DataFrame:
    """(key, label, classes, p): for each row its probabilities, arrays by class, from the centroids of the other folds.

    Folds are even within classes. A class that only the row's own fold holds is
    left out for it. Sums by class and fold are partial aggregates; the centroids
    of all folds become one array that every row reads.
    """
    dealt = folds(rows.select(key, label, vector), label, folds_, seed, key)
    parts = dealt.select(label, "fold", F.posexplode(vector).alias("pos", "x")).groupBy(label, "fold", "pos").agg(F.sum(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    whole = parts.groupBy(label, "pos").agg(F.sum("x").alias("all_x"), F.sum("n").alias("all_n"))
    every = F.explode(F.sequence(F.lit(0), F.lit(folds_ - 1))).alias("fold")
    rest = whole.select("*", every).join(parts, [label, "pos", "fold"], "left")
    n = F.col("all_n") - F.coalesce("n", F.lit(0))
    rest = rest.where(n > 0).withColumn("m", (F.col("all_x") - F.coalesce("x", F.lit(0.0))) / n)
    centres = rest.groupBy("fold", label).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"))
    by_fold = centres.groupBy("fold").agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("class"), "centroid"))).alias("_centres"))
    scored = dealt.join(F.broadcast(by_fold), "fold")  # one row a fold on the right side
    apart = F.transform("_centres", lambda c: F.exp(-distance(F.col(vector), c["centroid"])))
    scored = scored.select(key, label, F.transform("_centres", lambda c: c["class"]).alias("classes"), apart.alias("_e"))
    total = F.aggregate("_e", F.lit(0.0), lambda a, e: a + e)
    return scored.select(key, label, "classes", F.transform("_e", lambda e: e / total).alias("p"))


def _at(values: Column | str, classes: Column | str, which: Column) -> Column:
    return F.try_element_at(values, F.nullif(F.array_position(classes, which), F.lit(0)).cast("int"))


def confident_issues(probabilities: DataFrame, key: str, label: str) -> DataFrame:
    """(key, label, quality, is_issue): confident learning, pruned by noise rate, on ``held_out_probabilities``.

    A class's threshold is the mean probability of its own rows. A row's guess
    is the class whose threshold it reaches, the most probable one of all if it
    reaches several, none if none. The counts of guesses by label, one at least
    for the label itself, are scaled to the label's rows and rounded, halves to
    even; so many rows of a label as are guessed to be another class, those of
    the widest margin towards it (all of equal margins), are issues, unless
    their label is their most probable class. quality is the label's own probability.
    """
    own = _at("p", "classes", F.col(label))
    scored = probabilities.withColumn("quality", own)
    # one row a class from here on: thresholds, and guesses by label
    limits = scored.groupBy(label).agg(F.avg("quality").alias("t"), F.count("*").alias("rows"))
    known = limits.agg(F.map_from_entries(F.collect_list(F.struct(label, "t"))).alias("_t"))
    scored = scored.join(F.broadcast(known), how="cross")  # one row on the right side
    pairs = F.arrays_zip(F.col("classes").alias("c"), F.col("p").alias("x"))
    sure = F.filter(pairs, lambda z: z["x"] >= F.try_element_at("_t", z["c"]) - 1e-6)
    top = F.get(F.array_sort(pairs, lambda a, b: F.when(a["x"] > b["x"], -1).when(a["x"] < b["x"], 1).when(a["c"] < b["c"], -1).when(a["c"] > b["c"], 1).otherwise(0)), F.lit(0))["c"]
    scored = scored.withColumns({"_top": top, "_sure": sure}).withColumn("_guess", F.when(F.size("_sure") == 1, F.get("_sure", F.lit(0))["c"]).when(F.size("_sure") > 1, F.col("_top")))
    counts = scored.where("_guess IS NOT NULL").groupBy(label, F.col("_guess").alias("guess")).agg(F.count("*").alias("c"))
    counts = counts.unionByName(limits.select(label, F.col(label).alias("guess"), F.lit(1).cast("long").alias("c"))).groupBy(label, "guess").agg(F.max("c").alias("c"))
    joint = counts.join(counts.groupBy(label).agg(F.sum("c").alias("all_c")), label).join(limits, label)
    joint = joint.withColumn("k", F.bround(F.col("c") / F.col("all_c") * F.col("rows")).cast("long")).where(F.col("guess") != F.col(label)).where("k > 0").select(label, "guess", "k")
    towards = scored.join(F.broadcast(joint), label).select(key, label, "guess", "k", (_at("p", "classes", F.col("guess")) - F.col("quality")).alias("margin")).where("margin IS NOT NULL")
    rank = F.rank().over(Window.partitionBy(label, "guess").orderBy(F.desc("margin")))
    hits = towards.withColumn("_rank", rank).where("_rank <= k").select(key).distinct().withColumn("_hit", F.lit(True))
    issue = F.coalesce("_hit", F.lit(False)) & (F.col("_top") != F.col(label))
    return scored.select(key, label, "quality", "_top").join(hits, key, "left").select(key, label, F.round("quality", 6).alias("quality"), issue.cast("int").alias("is_issue"))


def lowest_quality(flags: DataFrame, key: str, m: int) -> DataFrame:
    """The m rows of lowest quality."""
    return flags.orderBy("quality", key).limit(m)


def removal(rows: DataFrame, condition: str, rule: str = "rule_noise", issue: str = "cl_issue", budget: str = "cl_budget", seed: int = 42, key: str = "key") -> DataFrame:
    """Training rows under a removal condition; random drops as many rows as the rules mark, by hash order."""
    if condition == "raw":
        return rows
    if condition in ("rule", "cl_default", "cl_budget"):
        return rows.where(F.col({"rule": rule, "cl_default": issue, "cl_budget": budget}[condition]) == 0)
    if condition == "random":
        n = rows.where(F.col(rule) == 1).count()
        gone = rows.orderBy(order_key(seed, key), key).limit(n).select(key)
        return rows.join(gone, key, "left_anti")
    raise ValueError(condition)


def silhouette(rows: DataFrame, key: str, label: str, vector: str, cap: int, seed: int) -> DataFrame:
    """One row: the mean silhouette of a hash-ordered sample of at most cap rows, and n.

    The cap is part of the measure and bounds the sample that is sent out:
    each task compares its rows to all of the sample at once.
    """
    sample = rows.select(key, label, vector).orderBy(order_key(seed, key), key).limit(cap)
    some = sample.collect()
    if not some:
        return rows.sparkSession.createDataFrame([(None, 0)], "silhouette double, n long")
    points = rows.sparkSession.sparkContext.broadcast((np.array([r[0] for r in some]), np.array([r[1] for r in some]), np.array([r[2] for r in some], float)))

    def measured(parts):
        keys, names, vectors = points.value
        classes, of = np.unique(names, return_inverse=True)
        sizes = np.bincount(of)
        for part in parts:
            x = np.array(part[vector].tolist(), float)
            apart = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (vectors**2).sum(1) - 2 * x @ vectors.T, 0))
            apart[part[key].to_numpy()[:, None] == keys] = 0
            sums = np.stack([apart[:, of == k].sum(1) for k in range(len(classes))], 1)
            at = np.searchsorted(classes, part[label].to_numpy())
            row = np.arange(len(part))
            inner = sums[row, at] / np.maximum(sizes[at] - 1, 1)
            means = sums / sizes
            means[row, at] = np.inf
            outer = means.min(1)
            alone = (sizes[at] == 1) | ~np.isfinite(outer)
            s = np.where(alone, 0.0, (outer - inner) / np.maximum(np.maximum(inner, outer), 1e-300))
            yield pd.DataFrame({"s": s})

    return sample.mapInPandas(measured, "s double").agg(F.round(F.avg("s"), 4).alias("silhouette"), F.count("*").alias("n"))
