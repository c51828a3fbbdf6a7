"""Session lists: refine, cap, split, match sizes, inject noise, align copies.

Choices are ordered by a hash of seed and identity, never by place or arrival:
a retried or differently partitioned run makes the same lists. Top-k per class
for a fixed k uses a rank window, which Spark prunes to k rows a class before
the shuffle. Where the number differs by class, or every row needs its rank, a
class is dealt to buckets by the first digits of the hash: the rows in the
buckets before are counted, and only a bucket is ever sorted as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netsieve.functions.exprs import group_key, natural_key, session_parts, split_role
from netsieve.schemas import LIST_COLUMNS


def order_key(seed: int, *parts: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(p).cast("string") for p in parts]))


def refine(marked: DataFrame, noisy: Column, mode: str) -> DataFrame:
    """All rows for mode noisy; those without noise for mode denoised."""
    if mode not in ("noisy", "denoised"):
        raise ValueError(mode)
    return marked if mode == "noisy" else marked.where(~noisy)


def exclude(rows: DataFrame, name: Column, labels: tuple[str, ...]) -> DataFrame:
    return rows.where(~F.lower(name).isin(*labels)) if labels else rows


def class_ranks(rows: DataFrame, group: str, seed: int, *identity: str, most: Column | None = None) -> DataFrame:
    """rows with ``_rank``, their number (from 1) in hash order within their class, and ``_total``, the rows of the class.

    With most (a column that is constant in a class) only buckets that can hold ranks up to it are ranked. Null is a class.
    """
    keyed = rows.withColumns({"_key": order_key(seed, *identity), "_class": F.struct(F.col(group))}).withColumn("_bucket", F.substring("_key", 1, 3))
    counts = keyed.groupBy("_class", "_bucket").agg(F.count("*").alias("_rows"))
    w = Window.partitionBy("_class")  # 4,096 rows a class at most
    before = F.sum("_rows").over(w.orderBy("_bucket")) - F.col("_rows")
    counts = counts.select("_class", "_bucket", before.alias("_before"), F.sum("_rows").over(w).alias("_total"))
    placed = keyed.join(counts, ["_class", "_bucket"])
    if most is not None:
        placed = placed.where(F.col("_before") < most)
    rank = F.row_number().over(Window.partitionBy("_class", "_bucket").orderBy("_key", *identity))
    return placed.withColumn("_rank", F.col("_before") + rank).drop("_key", "_class", "_bucket", "_before")


def top_per_class(rows: DataFrame, group: str, n: int | Column, seed: int, *identity: str) -> DataFrame:
    """n rows of each class in hash order; n may be a column that is constant in a class."""
    if isinstance(n, Column):
        return class_ranks(rows, group, seed, *identity, most=n).where(F.col("_rank") <= n).drop("_rank", "_total")
    rank = F.row_number().over(Window.partitionBy(group).orderBy(order_key(seed, *identity), *identity))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def roles(rows: DataFrame, seed: int, filename: str, session: str, ratio: float = 0.2) -> DataFrame:
    return rows.withColumn("role", split_role(seed, F.col(filename), F.col(session), ratio))


def at_least(rows: DataFrame, group: str, n: int) -> DataFrame:
    """Rows of classes with n rows or more."""
    enough = rows.groupBy(group).count().where(F.col("count") >= n).select(group)
    return rows.join(enough, group, "left_semi")


def label_map(names: DataFrame, name: str, old: DataFrame | None = None) -> DataFrame:
    """(label, id): ids in the order of the sorted labels; with an old map its ids stay and new labels follow."""
    labels = names.select(F.col(name).alias("label")).where("label IS NOT NULL").distinct()
    if old is not None:
        labels = labels.join(old, "label", "left_anti")
    last = None if old is None else old.agg(F.max("id")).first()[0]
    start = 0 if last is None else last + 1
    # a label map has one row a class: it is small by nature, and sorted as a whole
    fresh = labels.select("label", (F.row_number().over(Window.orderBy("label")) - 1 + F.lit(start)).alias("id"))
    return fresh if old is None else old.select("label", F.col("id").cast("int")).unionByName(fresh)


def size_match(rows: DataFrame, target: DataFrame, group: str, seed: int, *identity: str) -> DataFrame:
    """As many rows of each class as the target has, at most."""
    sizes = target.groupBy(group).agg(F.count("*").alias("_n"))
    return top_per_class(rows.join(sizes, group), group, F.col("_n"), seed, *identity).drop("_n")


def inject(clean: DataFrame, noisy: DataFrame, group: str, native: DataFrame, share: float, seed: int, *identity: str) -> DataFrame:
    """Lists of the clean lists' sizes in which a share of each class is marked noise.

    native: (group, rate), a class's own share of noise. A class of N rows gets
    round-half-even(min(1, rate + share) * N) noisy rows, fewer if there are not
    so many, and clean ones for the rest.
    """
    have = noisy.groupBy(group).agg(F.count("*").alias("_have"))
    sizes = clean.groupBy(group).agg(F.count("*").alias("_n")).join(native, group, "left").join(have, group, "left")
    wanted = F.bround(F.least(F.lit(1.0), F.coalesce("rate", F.lit(0.0)) + share) * F.col("_n")).cast("long")
    plan = sizes.select(group, "_n", F.least(wanted, F.coalesce("_have", F.lit(0))).alias("_k"))
    dirty = top_per_class(noisy.join(plan, group), group, F.col("_k"), seed, *identity).withColumn("is_noise", F.lit(1))
    rest = top_per_class(clean.join(plan, group), group, F.col("_n") - F.col("_k"), seed, *identity).withColumn("is_noise", F.lit(0))
    return rest.unionByName(dirty).drop("_n", "_k")


def align(listed: DataFrame, found: DataFrame, key: str, name: str, session: str) -> DataFrame:
    """Listed sessions with the found copy of each.

    A copy of the same name and session is taken first. Of a key's other listed
    sessions, in natural order of the name and then by session, the n-th gets the
    n-th copy that is not taken; when these run out, all get the key's first copy.
    """
    pair = [name, session]
    copies = found.select(key, *pair).distinct()
    natural = [natural_key(F.col(name)), F.col(session)]

    def ranked(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*natural)))

    def as_found(rows: DataFrame) -> DataFrame:
        return rows.select(key, *[F.col(c).alias(f"found_{c}") for c in pair], *[c for c in rows.columns if c == "_k"])

    same = listed.join(copies, [key, *pair], "left_semi").select("*", *[F.col(c).alias(f"found_{c}") for c in pair])
    pending = ranked(listed.join(copies, [key, *pair], "left_anti"))
    free = as_found(ranked(copies.join(same.select(key, *pair).distinct(), [key, *pair], "left_anti")))
    place = F.struct(*[c.alias(f"_{k}") for k, c in enumerate(natural)])
    first = copies.groupBy(key).agg(F.min_by(F.struct(*pair), place).alias("_first"))
    rest = pending.join(free, [key, "_k"], "left").join(first, key, "left")
    rest = rest.withColumns({f"found_{c}": F.when(F.col(f"found_{name}").isNotNull(), F.col(f"found_{c}")).otherwise(F.col("_first")[c]) for c in (session, name)})
    return same.unionByName(rest.select(*same.columns))


def round_robin(rows: DataFrame, group: str, n: int, seed: int, *identity: str) -> DataFrame:
    """n rows, taken from the classes in turn."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(order_key(seed, *identity), *identity))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).orderBy("_rank", group).limit(n).drop("_rank")


def folds(rows: DataFrame, group: str, k: int, seed: int, *identity: str) -> DataFrame:
    """A fold number in [0, k) for each row, even within every class."""
    ranked = class_ranks(rows, group, seed, *identity)
    return ranked.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_rank", "_total")


def validation(rows: DataFrame, group: str, share: float, least: int, seed: int, *identity: str) -> DataFrame:
    """is_validation for max(1, round-half-even(share * n)) rows of each class of ``least`` rows or more."""
    n = F.col("_total")
    chosen = (n >= least) & (F.col("_rank") <= F.greatest(F.lit(1), F.bround(n * share).cast("long")))
    return class_ranks(rows, group, seed, *identity).withColumn("is_validation", chosen.cast("int")).drop("_rank", "_total")


def renumber(rows: DataFrame, group: str, name: str) -> DataFrame:
    """rows with ``new_name``: <class>_<i>, i from 1 in the natural order of the names of each class."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(natural_key(F.col(name)), name))
    return rows.withColumn("new_name", F.concat_ws("_", group, place.cast("string")))


def build(marked: DataFrame, noisy: Column, mode: str, task: str = "full", excluded: tuple[str, ...] = (), cap: int = 0, least: int = 0, ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """The list of a dataset and mode, LIST_COLUMNS and ``role``: exclude, refine, key, leave out small classes, cap, split.

    A class's size for ``least`` is what passes refinement, before the cap; a cap or least of 0 is none.
    """
    rows = refine(marked, noisy, mode).withColumn("group_key", group_key(task))
    rows = exclude(rows, F.col("group_key"), excluded)
    rows = at_least(rows, "group_key", least) if least else rows
    rows = top_per_class(rows, "group_key", cap, seed, "filename", "session_id") if cap else rows
    proto, stream = session_parts(F.col("session_id"))
    return roles(rows.withColumns({"proto": proto, "stream": stream}), seed, "filename", "session_id", ratio).select(*LIST_COLUMNS, "role")


def pruned(rows: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that a list names."""
    return rows.join(listed.select(*keys).distinct(), keys, "left_semi")


def minus(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys others lack, such as the noise: the noisy list without the denoised one."""
    return rows.join(others.select(*keys).distinct(), keys, "left_anti")


def keep_first(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key in an order, by a partial aggregate."""
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return first.select(*[F.col(c) if c in keys else F.col("_first")[c].alias(c) for c in rows.columns])


def with_features(listed: DataFrame, features: DataFrame, keys: list[str]) -> DataFrame:
    """Listed sessions with their features; ``found`` is false, and features null, for those that have none."""
    there = features.withColumn("_there", F.lit(True))
    return listed.join(there, keys, "left").withColumn("found", F.coalesce("_there", F.lit(False))).drop("_there")


def labelled(rows: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """rows with ``id`` from a label map (label, id); rows of unknown labels are dropped. A map has one row a class."""
    return rows.join(F.broadcast(labels.select(F.col("label").alias(name), "id")), name)
