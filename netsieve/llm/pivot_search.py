"""Exact top-k search by inner product with pivot-table elimination.

Vectors are quantised to integers, so scores are exact. A few vectors serve as
pivots; every candidate keeps its distances to all of them in a table made
once for its group. For a query, the greatest difference of a pivot's distances
bounds its distance to a candidate from below, and with both lengths its score
from above. Candidates are scored in the order of that bound and the search
stops when the next bound is under the k-th best score.

Candidates are dealt to cells by their nearest pivot, and a cell of many rows
by a hash of the row into groups of a bounded size. A cell's least and greatest
distances to all pivots bound the score of everything in it, so a query goes
only to the groups of cells whose bound reaches its threshold: the k-th best of
its scores with the sample that the pivots come from, whose rows are candidates
too. A group reads its queries as a stream and sends on at most k rows for
each. Sample and pivots change how much is eliminated, never the result.

Defined results: rows with a null vector, or null or non-finite components take
no part; rows without an id are candidates, last among ties, and no queries; a shorter vector counts as padded with zeros; rows
that repeat an id, with the same or other vectors, are candidates and queries
of their own, and meet each other; ties go to the smaller id; with no other
candidates a query has no rows. Scores are exact while they fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netsieve.llm.shared import Tables, partitions


@dataclass(frozen=True)
class Search:
    """k, pivots, rows they are chosen from, greatest and (for parallel work) least mean rows of a group, factor of the quantisation."""

    k: int = 5
    pivots: int = 32
    sample: int = 2048
    group: int = 32_768
    small_group: int = 4096
    scale: int = 256


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(row, id, v array<long>) of the rows that take part; row is their number, for good once they are written."""
    sound = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vec_col, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    rows = vectors.where(F.col(vec_col).isNotNull() & sound)
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), whole.alias("v"))


def spread(vectors: np.ndarray, n: int) -> np.ndarray:
    """Rows far from each other: each next one is farthest from those before it."""
    chosen, far = [0], np.full(len(vectors), np.inf)
    while len(chosen) < min(n, len(vectors)):
        far = np.minimum(far, ((vectors - vectors[chosen[-1]]) ** 2).sum(1))
        chosen.append(int(far.argmax()))
    return np.unique(chosen)


class Pivots:
    """The sample with its row numbers, and the distances of vectors to the pivots chosen from it."""

    def __init__(self, rows: np.ndarray, sample: np.ndarray, chosen: np.ndarray) -> None:
        self.rows, self.sample, self.pivots = rows, sample, sample[chosen].astype(float)
        self.squares = (self.pivots**2).sum(1)
        self.greatest = int(np.abs(sample).max(initial=0))

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        wide = vectors.astype(float)
        return np.sqrt(np.maximum((wide**2).sum(1)[:, None] + self.squares - 2 * wide @ self.pivots.T, 0))

    def least(self, row: int, query: np.ndarray, k: int) -> int:
        """The k-th best score of a query with the sample, a lower limit of its k-th best of all."""
        found = scores(self.sample, query, self.greatest)[self.rows != row]
        return int(np.partition(found, -k)[-k]) if len(found) >= k else LEAST


LEAST = -(2**63)


def scores(vectors: np.ndarray, query: np.ndarray, greatest: int) -> np.ndarray:
    """Inner products, in floating point (and faster) where that is exact."""
    if max(greatest, int(np.abs(query).max(initial=0))) ** 2 * max(len(query), 1) < 2**52:
        return (vectors.astype(float) @ query.astype(float)).astype(np.int64)
    return vectors @ query


def bounds(apart: np.ndarray, square: np.ndarray | float, squares: np.ndarray) -> np.ndarray:
    """The greatest score of vectors of these squared lengths that are so far apart at least; rounding never hides one."""
    both = square + squares
    return (both - apart**2) / 2 + 1e-6 * both + 1e-3


class Group:
    """A group's candidates, and their table of distances to the pivots."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, pivots: Pivots, k: int) -> None:
        self.rows, self.ids, self.vectors, self.pivots, self.k = rows, ids, vectors, pivots, k
        self.greatest = int(np.abs(vectors).max(initial=0))
        self.squares = (vectors.astype(float) ** 2).sum(1)
        self.table = pivots.distances(vectors).T.copy()

    def search(self, row: int, query: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best of this group that can be among the k best of all."""
        square = float((query.astype(float) ** 2).sum())
        apart = np.zeros(len(self.rows))
        for distances, own in zip(self.table, self.pivots.distances(query[None])[0], strict=True):
            np.maximum(apart, np.abs(distances - own), out=apart)
        bound = bounds(apart, square, self.squares)
        left = np.flatnonzero((bound >= least) & (self.rows != row))
        left = left[np.argsort(-bound[left], kind="stable")]
        ids, found, at, size = np.empty(0, np.int64), np.empty(0, np.int64), 0, 4 * self.k
        while at < len(left) and bound[left[at]] >= least:
            block = left[at : at + size]
            ids = np.concatenate((ids, self.ids[block]))
            found = np.concatenate((found, scores(self.vectors[block], query, self.greatest)))
            best = np.lexsort((ids, -found))[: self.k]
            ids, found = ids[best], found[best]
            if len(found) == self.k:
                least = max(least, int(found[-1]))
            at, size = at + size, min(2 * size, 4096)
        return ids, found


def _vectors(column: pa.Array, wide: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, wide)


def _place(batches: Iterator[pa.RecordBatch], pivots: Pivots, wide: int) -> Iterator[pa.RecordBatch]:
    """Rows (row, id, v) with their cell, the number of the nearest pivot."""
    for batch in batches:
        cells = pivots.distances(_vectors(batch.column("v"), wide)).argmin(1) if batch.num_rows else np.empty(0, int)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int32())], ["row", "id", "v", "cell"])


def _spans(batches: Iterator[pa.RecordBatch], pivots: Pivots, wide: int) -> Iterator[pa.RecordBatch]:
    """Of each cell of a batch: the least and greatest distance to each pivot, and the greatest squared length."""
    for batch in batches:
        cell, vectors = batch.column("cell").to_numpy(), _vectors(batch.column("v"), wide)
        apart, squares = pivots.distances(vectors), (vectors.astype(float) ** 2).sum(1)
        for one in np.unique(cell):
            of, n = cell == one, apart.shape[1]
            columns = np.full(n, one, np.int32), np.arange(n, dtype=np.int32), apart[of].min(0), apart[of].max(0), np.full(n, squares[of].max())
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["cell", "pivot", "low", "high", "square"])


def _route(batches: Iterator[pa.RecordBatch], pivots: Pivots, wide: int, low: np.ndarray, high: np.ndarray, squares: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """Queries (row, id, v) with their threshold, once for each cell whose bound reaches it. low, high: cells x pivots."""
    for batch in batches:
        vectors, rows = _vectors(batch.column("v"), wide), batch.column("row").to_numpy()
        at, cells, least = [], [], []
        for n, (row, query, own) in enumerate(zip(rows, vectors, pivots.distances(vectors), strict=True)):
            threshold = pivots.least(row, query, k)
            apart = np.maximum(np.maximum(own - high, low - own), 0).max(1)
            found = np.flatnonzero(bounds(apart, float((query.astype(float) ** 2).sum()), squares) >= threshold)
            at.append(np.full(len(found), n))
            cells.append(found)
            least.append(np.full(len(found), threshold, np.int64))
        if at:
            taken = batch.take(pa.array(np.concatenate(at)))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(np.concatenate(cells), pa.int32()), pa.array(np.concatenate(least))], ["row", "id", "v", "cell", "least"])


def _search_groups(batches: Iterator[pa.RecordBatch], pivots: Pivots, wide: int, k: int) -> Iterator[pa.RecordBatch]:
    """From rows (g, least, row, id, v), sorted so: each group's candidates first (no least), then its queries."""
    now, group = None, None
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        of, is_query = batch.column("g").to_numpy(), batch.column("least").is_valid().to_numpy(zero_copy_only=False)
        rows, ids, least = (batch.column(c).fill_null(NO_ID).to_numpy() for c in ("row", "id", "least"))
        vectors = _vectors(batch.column("v"), wide)
        cuts = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (is_query[1:] != is_query[:-1]))))
        out: list[tuple[np.ndarray, ...]] = []
        for start, end in zip(cuts, [*cuts[1:], len(of)], strict=True):
            if of[start] != now:
                now, group, held = of[start], None, []
            if not is_query[start]:
                held.append((rows[start:end], ids[start:end], vectors[start:end]))
                continue
            if group is None:
                group = Group(*(np.concatenate(x) for x in zip(*held, strict=True)), pivots, k) if held else None
                held = []
            for n in range(start, end) if group else ():
                found, points = group.search(int(rows[n]), vectors[n], int(least[n]))
                out.append((np.full(len(found), rows[n]), np.full(len(found), ids[n]), found, points))
        if out:
            columns = [np.concatenate(x) for x in zip(*out, strict=True)]
            arrays = [pa.array(x, pa.int64(), mask=(x == NO_ID) if named else None) for x, named in zip(columns, (False, True, True, False), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "query_id", "vec_id", "score"])


#: Stands for a null id inside a group, so that it is last among ties.
NO_ID = 2**63 - 1


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", search: Search | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where is_query holds (a condition on ``id``) its k best other rows."""
    search, spark = search or Search(), vectors.sparkSession
    tables, k = Tables(spark, "pivots"), search.k
    rows = tables.write(quantised(vectors, id_col, vec_col, search.scale), "vectors")
    n, wide = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    wide = max(wide, 1)
    rows = rows.select("row", "id", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(wide) - F.size("v"))).alias("v"))
    sample = rows.orderBy(F.xxhash64("row"), "row").limit(search.sample).collect()
    sampled = np.array([r["v"] for r in sample], np.int64).reshape(-1, wide)
    chosen = spread(sampled.astype(float), search.pivots) if n else np.empty(0, int)
    pivots = Pivots(np.array([r["row"] for r in sample], np.int64), sampled, chosen)
    placed = tables.write(rows.mapInArrow(lambda batches: _place(batches, pivots, wide), "row long, id long, v array<long>, cell int"), "placed")
    # of each cell and pivot one row: both are bounded by search.pivots
    spans = placed.mapInArrow(lambda batches: _spans(batches, pivots, wide), "cell int, pivot int, low double, high double, square double")
    spans = spans.groupBy("cell", "pivot").agg(F.min("low"), F.max("high"), F.max("square")).collect()
    low, high, squares = np.full((len(chosen),) * 2, np.inf), np.full((len(chosen),) * 2, -np.inf), np.full(len(chosen), -np.inf)
    for cell, pivot, least, most, square in spans:
        low[cell, pivot], high[cell, pivot], squares[cell] = least, most, square
    of_group = max(min(search.group, n // partitions(spark)), min(search.group, search.small_group))
    counts = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}
    parts = [-(-counts.get(cell, 0) // of_group) for cell in range(len(chosen))]
    groups = max(sum(parts), 1)
    first = F.get(F.array(*[F.lit(sum(parts[:cell])) for cell in range(len(parts))] or [F.lit(0)]), F.col("cell"))
    many = F.get(F.array(*map(F.lit, parts or [1])), F.col("cell"))
    candidates = placed.select((first + F.pmod(F.xxhash64("row"), many)).cast("int").alias("g"), F.lit(None).cast("long").alias("least"), "row", "id", "v")
    asked = rows.where(is_query).mapInArrow(lambda batches: _route(batches, pivots, wide, low, high, squares, k), "row long, id long, v array<long>, cell int, least long")
    queries = tables.write(asked, "queries").select(F.explode(F.sequence(first, first + many - 1)).alias("g"), "least", "row", "id", "v")
    found = (
        candidates.unionByName(queries)
        .repartitionByRange(groups, "g")
        .sortWithinPartitions("g", F.col("least").isNotNull(), "row")
        .mapInArrow(lambda batches: _search_groups(batches, pivots, wide, k), "row long, query_id long, vec_id long, score long")
    )
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
