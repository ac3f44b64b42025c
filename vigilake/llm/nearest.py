"""Approximate nearest neighbours: inverted lists, scanned dimension by dimension.

Vectors are dealt to the lists of their nearest centroids. A search probes the lists nearest to it. Inside a list vectors are
rotated at random, so that any few dimensions estimate a whole distance, and lie in column blocks: block by block the partial
distances grow, and a hypothesis test gives up candidates whose partial distance is too large to end among the nearest.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from vigilake.session import cut_lineage

#: Vectors (smallest hashes of their numbers) that the centroids are fitted on, and rounds of the fit.
SAMPLE, FIT_ROUNDS, SEED = 20_000, 8, 20240601
MOST_LISTS = 4096
#: Searches that tell how many lists to probe, and the share of true neighbours these lists must hold.
TRIALS, HELD = 256, 0.96
#: Vectors and searches that meet in one task call at most; larger lists are dealt to several.
CELL_VECTORS, CELL_SEARCHES = 8192, 2048
DIMENSIONS = 16
#: Doubt of the test: larger gives up fewer candidates.
DOUBT = 2.1


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, v) that take part: finite, not zero, of the most common length, with a number."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.where(F.size("v") == (sizes[0].n if sizes else -1))


def _matrix(column, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(1) - 2 * x @ centroids.T, axis=1)


def fit_lists(rows: DataFrame, lists: int, k: int) -> tuple[np.ndarray, int]:
    """Centroids by K-means on at most ``SAMPLE`` vectors, the ones with the smallest hashes, and how many to probe.

    ``TRIALS`` vectors of the sample are searched exactly within the sample; the lists to probe are as many as hold the
    share ``HELD`` of their nearest. In the whole table the nearest are nearer still, so the share there is no less as a
    rule. Vectors that fall into clear groups need few lists, vectors without any need most.
    """
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
    x = np.unique(_matrix(sample.column("v"), len(sample.column("v")[0])), axis=0)
    rng = np.random.default_rng(SEED)
    centroids = x[rng.permutation(len(x))[:lists]]
    for _ in range(FIT_ROUNDS):
        owner = np.concatenate([_nearest(x[i : i + 4096], centroids) for i in range(0, len(x), 4096)])
        sums, counts = np.zeros_like(centroids), np.bincount(owner, minlength=len(centroids))
        np.add.at(sums, owner, x)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    owner = np.concatenate([_nearest(x[i : i + 4096], centroids) for i in range(0, len(x), 4096)])
    places = []
    for trial in rng.permutation(len(x))[:TRIALS]:
        distance = ((x - x[trial]) ** 2).sum(axis=1)
        near = np.argsort(distance, kind="stable")[1 : k + 1]
        turn = np.empty(len(centroids), dtype=np.int64)
        turn[np.argsort(((centroids - x[trial]) ** 2).sum(axis=1), kind="stable")] = np.arange(len(centroids))
        places.append(turn[owner[near]])
    reach = np.concatenate(places)
    return centroids, int(np.quantile(reach, HELD, method="higher")) + 1 if len(reach) else len(centroids)


def _listed(rows: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """Rows with the ``probes`` nearest lists, as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                x = _matrix(part.column("v"), centroids.shape[1])
                far = (centroids**2).sum(1) - 2 * x @ centroids.T
                near = np.argsort(far, axis=1, kind="stable")[:, :probes] if probes > 1 else np.argmin(far, axis=1)[:, None]
                lists = pa.ListArray.from_arrays(np.arange(0, near.size + 1, near.shape[1], dtype=np.int32), pa.array(near.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("v"), lists], names=["vec_id", "v", "lists"])

    return rows.mapInArrow(run, f"vec_id {dict(rows.dtypes)['vec_id']}, v array<double>, lists array<int>")


def adaptive_scan(query: np.ndarray, columns: np.ndarray, k: int, doubt: float | None = DOUBT) -> np.ndarray:
    """Candidates (columns of the rotated matrix) that may be among the ``k`` nearest to a rotated query.

    Without ``doubt`` only those are given up whose partial distance is over the bound already, so none is lost.
    """
    width, count = columns.shape
    if count <= k:
        return np.arange(count)
    first = min(DIMENSIONS, width)
    alive = np.arange(count)
    partial = ((columns[:first] - query[:first, None]) ** 2).sum(0)
    seeds = np.argpartition(partial, k - 1)[: 2 * k] if count > 2 * k else alive
    whole = ((columns[:, seeds] - query[:, None]) ** 2).sum(0)
    bound = np.partition(whole, k - 1)[k - 1]
    for done in range(first, width, DIMENSIONS):
        share = 1.0 if doubt is None else (done / width) * (1 + doubt / np.sqrt(done)) ** 2
        keep = partial <= bound * share + 1e-12
        alive, partial = alive[keep], partial[keep]
        stop = min(width, done + DIMENSIONS)
        partial = partial + ((columns[done:stop, alive] - query[done:stop, None]) ** 2).sum(0)
    return np.union1d(alive[partial <= bound * (1 + 1e-9) + 1e-12], seeds)


def _cell_search(k: int, width: int, doubt: float | None):
    """Searches and vectors of one cell to the nearest of each search, by exact distance on the vectors as given."""
    rotation = np.linalg.qr(np.random.default_rng(SEED).normal(size=(width, width)))[0]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = right.column("vec_id").to_numpy()
        names = left.column("vec_id").to_numpy()
        out = [[], [], []]
        if len(ids) and len(names):
            x, q = _matrix(right.column("v"), width), _matrix(left.column("v"), width)
            columns, turned = np.ascontiguousarray((x @ rotation).T), q @ rotation
            for i, name in enumerate(names):
                own = ids == name  # rows that repeat its vec_id are no candidates of a query
                near = np.flatnonzero(~own)[adaptive_scan(turned[i], columns[:, ~own], k, doubt)] if own.any() else adaptive_scan(turned[i], columns, k, doubt)
                distance = np.sqrt(((x[near] - q[i]) ** 2).sum(axis=1))
                best = np.lexsort((ids[near], distance))[:k]
                out[0] += [name] * len(best)
                out[1] += ids[near[best]].tolist()
                out[2] += distance[best].tolist()
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    return run


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, lists: int | None = None, probes: int | None = None, doubt: float | None = DOUBT) -> DataFrame:
    """The ``k`` nearest found of every row whose vec_id is divisible by ``every``: query_id, rank, vec_id, score.

    Score is the Euclidean distance in double precision on the vectors as given; nearest first, ties to the smaller
    vec_id. Candidates are all rows but those with the query's own vec_id. Null, zero and non-finite vectors, vectors of
    another length than most, and rows without a number take no part. Of rows that repeat a query's vec_id one is the
    query; repeated candidates each count. An empty table gives no rows.

    Lists follow the table (about the square root of its rows, ``MOST_LISTS`` at most); a list of any size is dealt to
    cells of bounded size. How many lists are probed is measured on the sample that the lists are fitted on. With as many
    ``probes`` as lists and no ``doubt`` the search is exact.
    """
    rows = cut_lineage(usable(vectors.withColumn("vec_id", F.col("vec_id").cast("long"))))
    spark, n = rows.sparkSession, rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lists = lists or min(MOST_LISTS, max(8, 1 << ceil(np.log2(np.sqrt(n)))))
    centroids, needed = fit_lists(rows, lists, k)
    lists, width = centroids.shape
    probes = min(lists, probes or needed)
    placed = cut_lineage(_listed(rows, centroids, 1).select("vec_id", "v", F.get("lists", F.lit(0)).alias("list")))
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = cut_lineage(_listed(asked, centroids, probes).select("vec_id", "v", F.explode("lists").alias("list")))
    # a row per list: how many cells its vectors and its searches are dealt to
    sizes = placed.groupBy("list").agg(F.ceil(F.count("*") / CELL_VECTORS).alias("blocks")).join(
        asked.groupBy("list").agg(F.ceil(F.count("*") / CELL_SEARCHES).alias("turns")), "list"
    )
    sizes = F.broadcast(cut_lineage(sizes))
    part = lambda c: F.pmod(F.xxhash64("vec_id", F.lit(c)), F.col(c))
    every_of = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    v = placed.join(sizes, "list").select("vec_id", "v", "list", part("blocks").alias("block"), every_of("turns").alias("turn"))
    q = asked.join(sizes, "list").select("vec_id", "v", "list", every_of("blocks").alias("block"), part("turns").alias("turn"))
    cell = ["list", "block", "turn"]
    found = q.groupBy(*cell).cogroup(v.groupBy(*cell)).applyInArrow(_cell_search(k, width, doubt), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
