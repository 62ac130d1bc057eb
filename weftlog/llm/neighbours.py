"""Approximate nearest neighbours by an inverted multi-index.

Each vector is cut into two halves, and each half is quantised by its own codebook, so a vector lies in the cell of a pair of
centroids.  A query walks through the pairs in order of the summed distance of its halves, by a heap over the two sorted lists,
until the cells hold as many entries as it is to compare; these are ranked by their exact distance.

Codebooks and the share of entries to compare are fitted on a bounded sample; every row is indexed.  Cells in order are cut into
shards of about ``SHARD_ROWS`` entries.  A query is sent to the shards that hold a cell it visits, and a task holds one shard
and streams the queries sent there.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftlog.llm.storage import bounded_memory, written
from weftlog.llm.text import mix

#: Vectors that codebooks and the share are fitted on, and sampled queries that try shares.
SAMPLE, TRIED = 20_000, 400
#: Recall that sampled queries must reach in the sample, and the share that is added to what they need.
RECALL, MARGIN = 0.97, 0.02
#: Centroids of a half: the square root of entries over CELL_ROWS, within these bounds; cells are at most their square.
CELL_ROWS, LEAST_CENTROIDS, MOST_CENTROIDS = 50, 8, 256
#: Entries of a shard, queries that meet a copy of it, and entries that a query compares at least.
SHARD_ROWS, SLOT_QUERIES, LEAST_COMPARED = 20_000, 50_000, 1000
#: Copies of a result row, to which the queries of equal vectors are dealt.
SALTS = 16


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column without nulls, all of one width, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def usable(df: DataFrame, queries: Column, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(vec_id, vector, asked) of rows that take part, and their width: not null, neither empty nor zero, all components finite, and
    of the most frequent width (the larger of equals), as distances between widths are not defined."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = df.where(F.col(id_col).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    rows = kept.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector"), F.coalesce(queries, F.lit(False)).alias("asked"))
    widths = rows.groupBy(F.size("vector").alias("width")).agg(F.count(F.lit(1)).alias("n"))
    most = widths.orderBy(F.desc("n"), F.desc("width")).first()
    return (rows.where(F.size("vector") == most.width), most.width) if most else (rows, 0)


def codebook(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's centroids of sampled half vectors, from evenly spaced points in the order of their first component; one for an empty half."""
    if not points.shape[1]:
        return np.zeros((1, 0))
    order = np.lexsort((points[:, -1], points[:, 0]))
    centres = points[order[np.linspace(0, len(points) - 1, k).astype(int)]]
    for _ in range(rounds):
        own = nearest_centroid(points, centres)
        counts = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def centroid_distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((points**2).sum(1)[:, None] + (centres**2).sum(1)[None] - 2 * points @ centres.T, 0)


def nearest_centroid(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin(centroid_distances(points, centres), axis=1)


@dataclass
class Index:
    """Codebooks of both halves (at most MOST_CENTROIDS each), entries of each cell, and the shards that each cell lies in."""

    first: np.ndarray
    second: np.ndarray
    share: float
    counts: np.ndarray | None = None
    shard: np.ndarray | None = None  # the first shard of each cell
    pieces: np.ndarray | None = None  # and how many it is dealt to

    @property
    def half(self) -> int:
        return self.first.shape[1]

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        return nearest_centroid(vectors[:, : self.half], self.first) * len(self.second) + nearest_centroid(vectors[:, self.half :], self.second)

    def distances(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return centroid_distances(vectors[:, : self.half], self.first), centroid_distances(vectors[:, self.half :], self.second)

    def sharded(self, counts: np.ndarray, rows: int = SHARD_ROWS) -> Index:
        """Cells in order, cut into shards of about ``rows`` entries; a larger cell is dealt to several of its own."""
        pieces = np.maximum(1, -(-counts // rows))
        upto = np.cumsum(np.where(pieces > 1, 0, counts))
        block = (upto - 1).clip(0) // rows
        # a new shard begins with each block, and before and after each divided cell
        starts = np.diff(block, prepend=-1) > 0
        starts |= pieces > 1
        starts[1:] |= pieces[:-1] > 1
        number = np.cumsum(np.where(starts, np.concatenate(([1], pieces[:-1])), 0)) - 1
        return Index(self.first, self.second, self.share, counts, number, pieces)


def traverse(one: np.ndarray, two: np.ndarray, counts: np.ndarray, wanted: int) -> list[int]:
    """Cells in ascending sum of both distances until they hold ``wanted`` entries; empty cells are passed over."""
    order_1, order_2 = np.argsort(one, kind="stable").tolist(), np.argsort(two, kind="stable").tolist()
    d1, d2, width = one[order_1].tolist(), two[order_2].tolist(), len(order_2)
    heap, cells, have = [(d1[0] + d2[0], 0, 0)], [], 0
    while heap and have < wanted:
        _, i, j = heapq.heappop(heap)
        cell = order_1[i] * width + order_2[j]
        if counts[cell]:
            cells.append(cell)
            have += counts[cell]
        # (i, j) is reached from (i, j - 1), and a first column from the row before
        if j + 1 < width:
            heapq.heappush(heap, (d1[i] + d2[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(order_1):
            heapq.heappush(heap, (d1[i + 1] + d2[0], i + 1, 0))
    return cells


def needed_share(index: Index, sample: np.ndarray, k: int, recall: float = RECALL) -> float:
    """Share of the sample's entries that its own queries must compare to find ``recall`` of their k nearest."""
    picked = sample[np.linspace(0, len(sample) - 1, min(TRIED, len(sample))).astype(int)]
    cell, places = index.cells(sample), []
    k = min(k + 1, len(sample))
    for lo in range(0, len(picked), 40):
        part = picked[lo : lo + 40]
        one, two = index.distances(part)
        sums = one[:, cell // len(index.second)] + two[:, cell % len(index.second)]
        near = np.argpartition(centroid_distances(part, sample), k - 1, axis=1)[:, :k]
        order = np.argsort(np.argsort(sums, axis=1, kind="stable"), axis=1)
        places.append(np.take_along_axis(order, near, axis=1))
    places = np.sort(np.concatenate(places), axis=None)
    return min(1.0, (places[min(len(places) - 1, int(np.ceil(recall * len(places))))] + 1) / len(sample) + MARGIN)


def fit(entries: DataFrame, width: int, n: int, k: int) -> Index:
    """Codebooks and share from a hash sample of about SAMPLE entries, at most twice as many."""
    keep = F.pmod(F.xxhash64("vec_id", "vector", F.lit(5)), F.lit(max(1, n // SAMPLE))) == 0
    rows = entries.where(keep).select("vector").limit(2 * SAMPLE).toArrow()
    sample = matrix(rows.column(0), width)
    sample = sample[np.lexsort(sample.T[::-1])]  # the fit depends on the rows alone, not on their order
    centroids = int(min(MOST_CENTROIDS, len(sample), max(LEAST_CENTROIDS, np.sqrt(n / CELL_ROWS))))
    half = (width + 1) // 2
    index = Index(codebook(sample[:, :half], centroids), codebook(sample[:, half:], centroids), 1.0)
    index.share = needed_share(index, sample, k)
    return index


def nearest(vectors: DataFrame, queries: Column, k: int = 10, share: float | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest found of each query row: query_id, rank, vec_id, score (Euclidean distance of the original vectors).

    ``queries`` is a condition on ``vectors``; candidates are all rows but those of the query's own id.  Rows without id, and vectors that
    are null, empty, zero, hold null or non-finite components or have another width than most, take no part, as query or
    as candidate.  A row that is repeated with the same id and vector counts once; ties go to smaller ids; fewer candidates
    than k give them all; an empty table gives no rows; other columns are not read.

    Of equal vectors only the k + 1 smallest ids can be among the k nearest of any query, so only they are indexed, and queries of
    equal vectors are searched once.  This loses nothing, and no number of copies makes a large group.
    """
    spark = vectors.sparkSession
    bounded_memory(spark)
    empty = "query_id long, rank int, vec_id long, score double"
    rows, width = usable(vectors, queries, id_col, vector_col)
    if not width:
        return spark.createDataFrame([], empty)
    # copies: both hashes of a vector stand for it
    both = [F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(7), "vector").alias("h2")]
    distinct = rows.select("vec_id", *both, "vector").groupBy("vec_id", "h1", "h2").agg(F.first("vector").alias("vector"))
    nth = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    entries = written(distinct.withColumn("nth", nth).where(F.col("nth") <= k + 1).drop("nth"), "entries")
    n = entries.count()
    index = fit(entries, width, n, k)
    if share is not None:
        index.share = share
    index = _counted(spark, entries, index, width)
    asked = written(rows.where("asked").select("vec_id", *both, "vector"), "asked")
    first_of = asked.groupBy("h1", "h2").agg(F.min_by("vector", "vec_id").alias("vector"))
    found = _search(spark, entries, first_of, index, width, n, k)
    # each query row takes its vector's result, without its own id
    results = found.groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("found"))  # k + 1 each
    results = results.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = asked.select(F.col("vec_id").alias("query_id"), "h1", "h2").distinct().withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(SALTS)).cast("int"))
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = salted.join(results, ["h1", "h2", "salt"]).select("query_id", F.posexplode(others).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def _counted(spark: SparkSession, entries: DataFrame, index: Index, width: int) -> Index:
    """The index with entries of each cell; a row for each cell (at most MOST_CENTROIDS squared) reaches the driver."""

    def count(batches):
        out = np.zeros(len(index.first) * len(index.second), np.int64)
        for batch in batches:
            if batch.num_rows:
                np.add.at(out, index.cells(matrix(batch.column(0), width)), 1)
        some = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(out[some])], names=["cell", "n"])

    counts = np.zeros(len(index.first) * len(index.second), np.int64)
    for r in entries.select("vector").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        counts[r.cell] = r.n
    return index.sharded(counts)


def _search(spark: SparkSession, entries: DataFrame, queries: DataFrame, index: Index, width: int, n: int, k: int) -> DataFrame:
    """(h1, h2, vec_id, score): the k + 1 nearest found entries of each query vector, by distance and id."""
    shared = spark.sparkContext.broadcast(index)
    wanted = max(LEAST_COMPARED, int(np.ceil(index.share * n)))

    def visits(batches):
        """A row for each shard that a query's cells lie in, with those cells."""
        own = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = own.distances(matrix(batch.column(2), width))
            for i in range(batch.num_rows):
                cells = np.sort(np.array(traverse(one[i], two[i], own.counts, wanted), np.int64))
                shards, at = np.unique(own.shard[cells], return_index=True)
                parts = np.split(cells, at[1:])
                # a divided cell is alone in its shards, and all of them are visited
                every = [(s + p, part) for s, part in zip(shards, parts, strict=True) for p in range(own.pieces[part[0]] if len(part) == 1 else 1)]
                m = len(every)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(s) for s, _ in every], pa.int64()), pa.array(np.repeat(batch.column(0).to_numpy()[i], m)), pa.array(np.repeat(batch.column(1).to_numpy()[i], m)), batch.column(2).take(pa.array([i] * m)), pa.array([part.astype("<i4").tobytes() for _, part in every], pa.binary())],
                    names=["shard", "h1", "h2", "vector", "cells"],
                )

    def placed(batches):
        own = shared.value
        for batch in batches:
            if batch.num_rows:
                cell = own.cells(matrix(batch.column(1), width))
                ids = batch.column(0).to_numpy()
                shard = own.shard[cell] + (mix(ids.astype(np.uint64)) % own.pieces[cell].astype(np.uint64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(shard), batch.column(0), batch.column(1), pa.array(cell.astype("<i4"))], names=["shard", "vec_id", "vector", "cell"])

    vector = dict(queries.dtypes)["vector"]
    visited = written(queries.select("h1", "h2", "vector").mapInArrow(visits, f"shard long, h1 long, h2 long, vector {vector}, cells binary"), "visits")
    # a shard that very many queries visit is copied, and its queries are dealt to the copies
    slots = visited.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / SLOT_QUERIES).cast("int").alias("slots"))
    there = entries.select("vec_id", "vector").mapInArrow(placed, f"shard long, vec_id long, vector {vector}, cell int").join(slots, "shard")
    there = there.withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
    there = there.select("shard", "slot", F.lit(0).alias("side"), "vec_id", F.lit(None).cast("long").alias("h1"), F.lit(None).cast("long").alias("h2"), "vector", "cell", F.lit(None).cast("binary").alias("cells"))
    come = visited.join(slots, "shard").withColumn("slot", F.pmod(F.col("h1"), F.col("slots")).cast("int"))
    come = come.select("shard", "slot", F.lit(1).alias("side"), F.lit(None).cast("long").alias("vec_id"), "h1", "h2", "vector", F.lit(None).cast("int").alias("cell"), "cells")

    def compare(batches):
        """Entries of a shard come first and are held; then its queries stream by."""
        at, held, ids, x, cell = None, [], None, None, None
        for batch in batches:
            shard, slot, side = (batch.column(i).to_numpy() for i in range(3))
            edges = np.flatnonzero((np.diff(shard) != 0) | (np.diff(slot) != 0) | (np.diff(side) != 0)) + 1
            for lo, hi in zip(np.concatenate(([0], edges)), np.concatenate((edges, [len(shard)])), strict=True):
                if lo == hi:
                    continue
                part, place = batch.slice(lo, hi - lo), (shard[lo], slot[lo])
                if place != at:
                    at, held, x = place, [], None
                if side[lo] == 0:
                    held.append((part.column(3).to_numpy(), matrix(part.column(6), width), part.column(7).to_numpy()))
                    continue
                if not held:
                    continue
                if x is None:
                    ids, x, cell = (np.concatenate(c) for c in zip(*held, strict=True))
                    order = np.argsort(ids, kind="stable")
                    ids, x, cell = ids[order], x[order], cell[order]
                    held = [(ids, x, cell)]
                yield compared(part, ids, x, cell)

    def compared(part, ids, x, cell):
        asked, rows = matrix(part.column(6), width), []
        most = int(cell.max()) + 1
        for i, wanted_cells in enumerate(part.column(8)):
            visited_cells = np.frombuffer(wanted_cells.as_buffer(), "<i4")
            open_ = np.zeros(most, bool)
            open_[visited_cells[visited_cells < most]] = True
            near = np.flatnonzero(open_[cell])
            distance = np.sqrt(((x[near] - asked[i]) ** 2).sum(axis=1))
            if len(near) > k + 1:
                limit = np.partition(distance, k)[k]
                kept = np.flatnonzero(distance <= limit)
                near, distance = near[kept], distance[kept]
            best = np.argsort(distance, kind="stable")[: k + 1]  # entries are in order of their ids
            rows.append((np.full(len(best), i), ids[near[best]], distance[best]))
        query, found, distance = (np.concatenate(c) for c in zip(*rows, strict=True))
        take = pa.array(query.astype(np.int64))
        return pa.RecordBatch.from_arrays([part.column(4).take(take), part.column(5).take(take), pa.array(found), pa.array(distance)], names=["h1", "h2", "vec_id", "score"])

    both = there.unionByName(come).repartition("shard", "slot").sortWithinPartitions("shard", "slot", "side")
    found = both.mapInArrow(compare, "h1 long, h2 long, vec_id long, score double")
    order = Window.partitionBy("h1", "h2").orderBy("score", "vec_id")
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1).select("h1", "h2", "vec_id", "score")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact (query_id, vec_id) pairs that were found."""
    total = exact.count()
    return found.join(exact.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").count() / total if total else 1.0


def op13_inverted_multi_index(spark, sf_dir: str) -> DataFrame:
    """The 10 nearest found of every vector whose id is divisible by 100, among all others; edge cases as in ``nearest``."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, F.col("vec_id") % 100 == 0)
