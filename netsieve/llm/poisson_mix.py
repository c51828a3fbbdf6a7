"""Mixing sources to target weights by Poisson replication.

A source with target share w of the whole mix and s documents has the mean
repetition rate w * total / s. A document's number of copies inverts the Poisson
distribution with that mean at a uniform number made from a hash of seed, id
and text: the least k whose cumulative probability exceeds it. So each document
is decided alone, by its content and not by its place: no counts are shared
between tasks, a source of any size is dealt like the others, and a retried
task makes the same copies. Copies then get a random place each: rows are
dealt and sorted by a hash of seed, id, text and copy.

A sum of independent Poisson numbers is one with the sum of their means, so a
rate above ``PART`` is cut into equal parts of at most that mean. Each part has
a draw of its own and is dealt to a task of its own, so neither the table of
probabilities nor what one task makes of one document grows with the rate.

The cumulative probabilities are one array for each source, computed natively
from logarithms. The table of sources is written and measured; up to
``MOST_BYTES`` are broadcast, more are joined by shuffle.

Defined results: a null source is a source of its own; weights of sources that
have no documents are left out of the total; sources without a weight get
``other`` each; a weight of 0 or less drops its source; null ids and texts hash
as empty; repeated rows have the same number of copies each, and an input
column named like a helper is kept as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsieve.llm.shared import MOST_BYTES, Tables, broadcast_if_small, partitions

#: Greatest mean of a part, numbers kept for the copies of one part, places over which a join of many sources deals each source, copies of a partition.
PART, NUMBERS, SALTS, COPIES = 64, 1024, 64, 250_000


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 digest."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def cumulative(mean: Column) -> Column:
    """P(X <= k) for k from 0 until the rest is far below 2 ** -52."""
    last = (F.ceil(mean + 12 * F.sqrt(mean)) + 30).cast("int")
    start = F.struct(F.lit(0.0).alias("logs"), F.lit(0.0).alias("p"), F.array().cast("array<double>").alias("all"))

    def step(acc: Column, k: Column) -> Column:
        logs = acc["logs"] + F.when(k > 0, F.ln(k.cast("double"))).otherwise(0.0)
        p = acc["p"] + F.exp(k * F.ln(mean) - mean - logs)
        return F.struct(logs.alias("logs"), p.alias("p"), F.concat(acc["all"], F.array(p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(0), last), start, step, lambda acc: acc["all"])


def rates(docs: DataFrame, weights: dict[str | None, float], source_col: str = "source", other: float = 0.0) -> DataFrame:
    """(source, documents, rate) of each source; shares are weights over the sum of the weights in use."""
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("documents"))
    listed = [F.when(F.col("source").eqNullSafe(F.lit(s)), F.lit(float(w))) for s, w in weights.items()]
    weighed = sizes.withColumn("weight", F.greatest(F.lit(0.0), F.coalesce(*listed, F.lit(float(other)))))
    weighed = Tables(docs.sparkSession, "mix").write(weighed, "sources")
    n, w = weighed.agg(F.sum("documents"), F.sum("weight")).first()
    return weighed.select("source", "documents", (F.col("weight") / F.lit(w or 1.0) * F.lit(float(n or 0)) / F.col("documents")).alias("rate"))


def replicate(
    docs: DataFrame,
    weights: dict[str | None, float],
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    other: float = 0.0,
    copy_col: str | None = "copy",
    most_bytes: int = MOST_BYTES,
) -> DataFrame:
    """Every document as often as its number of copies says, in a random order over all partitions.

    Returns docs' columns and, unless it is None, ``copy_col`` (long), which
    replaces an input column of that name: 1, 2, ... in a document's first
    part, NUMBERS * p + 1, ... in its part p.
    """
    spark, names = docs.sparkSession, [c for c in docs.columns if c != copy_col]
    parts = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1))
    table = rates(docs, weights, source_col, other).where("rate > 0")
    table = table.select(F.struct("source").alias("_of"), "documents", "rate", parts.alias("_parts"), cumulative(F.col("rate") / parts).alias("_cumulative"))
    table = Tables(spark, "mix").write(table, "table")
    expected, most_parts = table.agg(F.coalesce(F.sum(F.col("rate") * F.col("documents")), F.lit(0.0)), F.coalesce(F.max("_parts"), F.lit(1))).first()
    table = table.drop("documents", "rate")
    rows = docs.select(F.struct(*names).alias("_row"), F.struct(F.col(source_col).alias("source")).alias("_of"))
    seeded = F.lit(str(seed)), F.col("_row")[id_col], F.coalesce(F.md5(F.col("_row")[text_col]), F.lit(""))
    measured = 8 * F.size("_cumulative") + F.coalesce(F.octet_length(F.col("_of.source").cast("string")), F.lit(0))
    small = broadcast_if_small(table, measured, most_bytes)
    if small is not table:
        rows = rows.join(small, "_of")
    else:  # a source of very many documents meets its rate in SALTS places
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*seeded), F.lit(SALTS)).cast("int")).join(table.select("*", salts), ["_of", "_salt"])
    if most_parts == 1:
        rows = rows.withColumn("_part", F.lit(0).cast("long")).withColumn("_u", uniform(*seeded))
    else:
        rows = rows.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
        rows = rows.repartition(partitions(spark, int(expected), COPIES), F.xxhash64(*seeded, F.col("_part")))
        rows = rows.withColumn("_u", F.when(F.col("_part") == 0, uniform(*seeded)).otherwise(uniform(*seeded, F.col("_part"))))
    made = (
        rows.withColumn("_n", F.size(F.filter("_cumulative", lambda p: p <= F.col("_u"))))
        .where("_n > 0")
        .select("_row", "_part", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_k"))
        .withColumn("_copy", F.col("_part") * NUMBERS + F.col("_k"))
        .withColumn("_place", F.xxhash64(*seeded, F.col("_copy")))
    )
    mixed = made.repartition(partitions(spark, int(expected), COPIES), "_place").sortWithinPartitions("_place")
    out = [F.col("_row")[c].alias(c) for c in names]
    return mixed.select(*out, *([F.col("_copy").alias(copy_col)] if copy_col else []))
