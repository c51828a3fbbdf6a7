"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints that differ in at most ``budget`` bits agree in at least m of
m + budget blocks of bits. So every choice of m blocks deals the different
fingerprints into buckets that agree there, and each bucket is a trie: pairs of
nodes are walked down together from (root, root), a pair's differing bits add
up, and a pair is dropped when they exceed the budget or when both nodes are
known to lie in one component already, which keeps dense groups of near copies
from costing all their pairs. A bucket yields one edge from each linked
fingerprint to its smallest, never all pairs; the edges of all buckets go
through distributed connected components.

m grows with the number of different fingerprints, so buckets keep their size
at any input; a bucket that is still over ``Scheme.bucket`` is dealt again by
blocks of its remaining bits. Exact copies share a fingerprint and count once,
before any bucket is dealt. All choices are exact: they change the work, never
the links.

Defined results: null, empty and blank texts have fingerprint 0, linked like
any other; null ids count as no id (a component of only null ids has a null
component_id); repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from netsieve.llm.components import connected_components
from netsieve.llm.shared import Tables, partitions, release, text_batches

#: Shingles whose bits are counted at once, rows of fingerprints that one pass of the trie takes, pairs of nodes walked down at once, and pairs of leaves compared directly.
SLICE, CHUNK, FRONT, LEAF = 1 << 15, 1 << 17, 1 << 19, 32


@dataclass(frozen=True)
class Scheme:
    """words in a shingle, seed of its hash, bits that may differ, mean and greatest fingerprints of a bucket."""

    words: int = 4
    seed: int = 42
    budget: int = 4
    mean: int = 4096
    bucket: int = 1_000_000


def fingerprint(text: str | None, scheme: Scheme) -> int:
    """The SimHash of a text's shingles as a signed 64-bit integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only 0x20 and 0x09-0x0D split
    if not words:
        return 0
    ends = list(accumulate(map(len, words), lambda end, n: end + n + 1))
    joined, n = b" ".join(words), scheme.words
    starts = [0, *(end + 1 for end in ends[:-n])]
    shingles = [joined[a:b] for a, b in zip(starts, ends[n - 1 :] or ends[-1:], strict=len(words) >= n)]
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(scheme.seed)), np.uint64, len(shingles))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), SLICE):
        part = hashes[at : at + SLICE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def simhash(text: Column | str, scheme: Scheme | None = None) -> Column:
    """The fingerprint (long) of a text column."""
    scheme = scheme or Scheme()

    @F.arrow_udf("long")
    def fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([fingerprint(t.as_py(), scheme) for t in texts], pa.int64())
            release()

    return fingerprints(F.col(text) if isinstance(text, str) else text)


class Forest:
    """Tries over the sorted fingerprints of several buckets, and the components found in them."""

    def __init__(self, bucket: np.ndarray, prints: np.ndarray, budget: int) -> None:
        self.bucket, self.prints, self.budget = bucket, prints, budget
        self.root = np.arange(len(prints))
        self.ones: dict[int, np.ndarray] = {}

    def _middle(self, level: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Where the 1-children of nodes [low, high) begin."""
        if level not in self.ones:
            bits = (self.prints >> np.uint64(63 - level)) & np.uint64(1)
            self.ones[level] = np.concatenate(([0], np.cumsum(bits))).astype(np.int32)
        return high - (self.ones[level][high] - self.ones[level][low])

    def _link(self, left: np.ndarray, right: np.ndarray) -> None:
        near = np.bitwise_count(self.prints[left] ^ self.prints[right]) <= self.budget
        left, right = left[near], right[near]
        while True:
            a, b = self.root[left], self.root[right]
            if not (apart := a != b).any():
                break
            left, right, a, b = left[apart], right[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while (up := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = up
        self.changes = np.concatenate(([0], np.cumsum(self.root[1:] != self.root[:-1])))

    def _joined(self, pairs: np.ndarray) -> np.ndarray:
        """Whether both nodes of a pair lie in one component whole."""
        al, ah, bl, bh = pairs[:4]
        whole = (self.changes[ah - 1] == self.changes[al]) & (self.changes[bh - 1] == self.changes[bl])
        return whole & (self.root[al] == self.root[bl])

    def _down(self, level: int, pairs: np.ndarray) -> np.ndarray:
        al, ah, bl, bh, cost = pairs
        am, bm = self._middle(level, al, ah), self._middle(level, bl, bh)
        cross = np.array([am, ah, bl, bm, cost + 1])
        cross[1, al == bl] = am[al == bl]  # of a node with itself one crossing is enough
        below = np.concatenate([np.array([al, am, bl, bm, cost]), np.array([am, ah, bm, bh, cost]), np.array([al, am, bm, bh, cost + 1]), cross], axis=1)
        keep = (below[0] < below[1]) & (below[2] < below[3]) & (below[4] <= self.budget)
        return below[:, keep & ~((below[0] == below[2]) & (below[1] - below[0] == 1))]

    def _compare(self, pairs: np.ndarray) -> None:
        """All fingerprints of small nodes directly."""
        al, ah, bl, bh = pairs[:4]
        wide = bh - bl
        each = (ah - al) * wide
        at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        left, right = np.repeat(al, each) + at // np.repeat(wide, each), np.repeat(bl, each) + at % np.repeat(wide, each)
        self._link(left[left < right], right[left < right])

    def components(self) -> np.ndarray:
        """For each row the first row of its component within its bucket."""
        n = len(self.prints)
        same = np.flatnonzero(self.bucket[1:] == self.bucket[:-1])
        self._link(same, same + 1)
        starts = np.flatnonzero(np.concatenate(([True], self.bucket[1:] != self.bucket[:-1])))
        ends = np.append(starts[1:], n)
        roots = np.array([starts, ends, starts, ends, np.zeros_like(starts)])[:, ends - starts > 1]
        stack = [(0, roots)]
        while stack:
            level, pairs = stack.pop()
            pairs = pairs[:, ~self._joined(pairs)]
            if pairs.shape[1] > FRONT:
                stack.append((level, pairs[:, FRONT:]))
                pairs = pairs[:, :FRONT]
            small = (pairs[1] - pairs[0]) * (pairs[3] - pairs[2]) <= LEAF
            if small.any():
                self._compare(pairs[:, small])
                pairs = pairs[:, ~small]
            if pairs.shape[1]:
                stack.append((level + 1, self._down(level, pairs)))
        return self.root


def _bucket_edges(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Edges from the rows (mask, value, print), sorted so with print as unsigned; whole buckets are gathered up to CHUNK rows, a larger one alone."""

    def edges(columns: list[np.ndarray]) -> pa.RecordBatch:
        mask, value, prints = columns
        new = np.concatenate(([False], (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])))
        bits = prints.view(np.uint64)
        root = Forest(np.cumsum(new), bits, budget).components()
        linked = root != np.arange(len(root))
        return pa.RecordBatch.from_arrays([pa.array(prints[linked]), pa.array(prints[root[linked]])], ["a", "b"])

    held, rows = [], 0
    for batch in batches:
        held.append([batch.column(k).to_numpy() for k in range(3)])
        rows += batch.num_rows
        if rows >= CHUNK:
            mask, value, prints = (np.concatenate(x) for x in zip(*held, strict=True))
            last = int(np.argmax((mask == mask[-1]) & (value == value[-1])))  # where the last bucket, maybe not whole yet, begins
            if last:
                yield edges([mask[:last], value[:last], prints[:last]])
            held, rows = [[mask[last:], value[last:], prints[last:]]], len(mask) - last
    if rows:
        yield edges([np.concatenate(x) for x in zip(*held, strict=True)])


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _blocks(bits: list[int], n: int) -> list[int]:
    """n masks that split the given bit positions evenly."""
    return [sum(1 << b for b in bits[k * len(bits) // n : (k + 1) * len(bits) // n]) for k in range(n)]


def masks(prints: int, scheme: Scheme) -> list[int]:
    """The masks whose agreeing bits deal the buckets, for a number of different fingerprints."""
    m = 1
    while m < 12 and prints / 2 ** (64 * m / (m + scheme.budget)) > scheme.mean:
        m += 1
    return [sum(x) for x in combinations(_blocks(list(range(64)), m + scheme.budget), m)]


def _dealt(prints: DataFrame, chosen: list[int]) -> DataFrame:
    each = F.explode(F.array(*[F.lit(_signed(x)).cast("long") for x in chosen])).alias("mask")
    return prints.select("print", each).select("mask", F.col("mask").bitwiseAND(F.col("print")).alias("value"), "print")


def _redealt(spark: SparkSession, buckets: DataFrame, scheme: Scheme, chosen: list[int], tables: Tables) -> DataFrame:
    """Buckets of over scheme.bucket fingerprints dealt again by blocks of their remaining bits, while there are any."""
    level = 0
    while True:
        hot = buckets.groupBy("mask", "value").count().where(F.col("count") > scheme.bucket)
        hot = tables.write(hot.select("mask", "value", F.lit(True).alias("hot")), f"hot_{level}")
        finer = {}
        for (mask,) in hot.select("mask").distinct().collect():  # at most one row for each mask in use
            free = [b for b in range(64) if not mask >> b & 1]
            if len(free) > scheme.budget:
                finer[mask] = [_signed((mask | x) & (2**64 - 1)) for x in _blocks(free, scheme.budget + 1)]
        if not finer:
            return buckets
        pairs = spark.createDataFrame([(a, b) for a, x in finer.items() for b in x], "mask long, finer long")
        joined = tables.write(buckets.join(hot, ["mask", "value"], "left"), f"marked_{level}")
        dealt = joined.where("hot").join(F.broadcast(pairs), "mask").select(F.col("finer").alias("mask"), F.col("finer").bitwiseAND(F.col("print")).alias("value"), "print").distinct()
        stay = joined.where(F.col("hot").isNull() | ~F.col("mask").isin(list(finer))).select("mask", "value", "print")
        buckets = tables.write(stay.unionByName(dealt).distinct(), f"buckets_{level}")
        level += 1


def _components(rows: DataFrame, scheme: Scheme, tables: Tables) -> DataFrame:
    """(print, least, first, root) for each different fingerprint: its smallest id and row, and its component's smallest fingerprint.

    rows: (id, print, row), row being a struct by whose order a row is chosen.
    """
    spark = rows.sparkSession
    different = tables.write(rows.groupBy("print").agg(F.min("id").alias("least"), F.min("row").alias("first")), "different")
    n = different.count()
    chosen = masks(n, scheme)
    prints = different.select("print")
    buckets = _dealt(prints, chosen)
    if n > scheme.bucket:
        buckets = _redealt(spark, buckets, scheme, chosen, tables)
    budget, parts = scheme.budget, max(partitions(spark), n * len(chosen) // scheme.bucket)
    edges = (
        buckets.repartition(parts, "mask", "value")
        .sortWithinPartitions("mask", "value", F.col("print").bitwiseXOR(F.lit(-(1 << 63))))  # as unsigned, the order of a trie
        .mapInArrow(lambda batches: _bucket_edges(batches, budget), "a long, b long")
    )
    roots = connected_components(edges, tables).withColumnRenamed("node", "print")
    # every node of a component but its root is in roots; the root stands for itself
    return tables.write(different.join(roots, "print", "left").select("print", "least", "first", F.coalesce("root", "print").alias("root")), "linked")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scheme: Scheme | None = None) -> DataFrame:
    """(id, print long, component_id): component_id is the smallest id reachable over fingerprints within the budget."""
    scheme, spark = scheme or Scheme(), docs.sparkSession
    text_batches(spark)
    tables = Tables(spark, "simhash")
    rows = tables.write(docs.select(F.col(id_col).alias("id"), simhash(text_col, scheme).alias("print")), "prints")
    linked = _components(rows.withColumn("row", F.struct("id")), scheme, tables)
    least = tables.write(linked.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    classes = tables.write(linked.join(least, "root").select("print", "component_id"), "classes")
    return rows.join(classes, "print").select(F.col("id").alias(id_col), "print", "component_id")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scheme: Scheme | None = None) -> DataFrame:
    """near_duplicates with the fingerprint as 16 lowercase hex digits."""
    shown = F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint")
    return near_duplicates(docs, id_col, text_col, scheme).select(id_col, shown, "component_id")


def _hashes(id_col: str, text_col: str) -> list[Column]:
    """Never null: whether there is no id, and hashes of the id and (128 bits) of the text, which together name a row."""
    return [F.col(id_col).isNull().alias("unnamed"), F.xxhash64(id_col).alias("h0"), F.xxhash64(text_col).alias("h1"), F.xxhash64(F.lit(1), F.col(text_col)).alias("h2")]


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scheme: Scheme | None = None) -> DataFrame:
    """One row of each component with all its columns: the one of the smallest id, rows without an id last.

    A row is chosen, not an id: of rows that share the smallest id but hold
    other texts the one with the smallest hash of the text stays, and a text of
    another component stays whatever its id. Rows equal in id and text count
    once, by the smallest hash of their other columns (of maps none is taken).
    """
    scheme, spark = scheme or Scheme(), docs.sparkSession
    text_batches(spark)
    tables = Tables(spark, "simhash")
    name = _hashes(id_col, text_col)
    row = F.struct(name[0], F.col(id_col).alias("id"), *name[1:])  # in the order of choice: null ids last, then by id
    rows = tables.write(docs.select(F.col(id_col).alias("id"), simhash(text_col, scheme).alias("print"), row.alias("row")), "prints")
    chosen = tables.write(_components(rows, scheme, tables).groupBy("root").agg(F.min("first").alias("row")).select("row.*").drop("id"), "chosen")
    hashable = [F.col(c) for c, kind in docs.dtypes if "map<" not in kind]
    named = docs.select(F.struct(*docs.columns).alias("_row"), *name, F.xxhash64(*hashable).alias("_order"))
    # repeated rows meet in the map-side part of the aggregate, so a row of very many copies is no hot group
    single = named.groupBy(*chosen.columns).agg(F.min_by("_row", "_order").alias("_row"))
    return single.join(chosen, chosen.columns, "left_semi").select("_row.*")
