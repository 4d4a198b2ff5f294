"""Clustering of vectors around centroids, the nearest one found by Orchard's search."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm import shared
from panelweave.sources.workspace import pin

LONGEST = 2**63 - 1


def largest_component(dims: int) -> int:
    """Components up to this size keep every squared distance below 2**62."""
    return min(isqrt(2**62 // dims) // 2, 2**30)


def neighbours(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per centroid, all centroids from the nearest on, and how near a vector must be to skip the rest.

    A vector at squared distance d from centroid c can only be as near to another centroid n if their
    squared distance D is at most 4 d. The second array holds D / 4, rounded up: the search of the list may stop at n
    once d is below it.
    """
    between = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    order = np.argsort(between, axis=1, kind="stable")
    return order, -(-np.take_along_axis(between, order, axis=1) // 4)


def nearest(x: np.ndarray, centroids: np.ndarray, lists: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid of each row, the smaller number on ties.

    Every row walks the list of its best centroid so far. A centroid that is nearer, or as near with a smaller
    number, becomes the best one, and its list is walked from the start; centroids seen before are not measured again.
    """
    order, stop = lists
    count = len(centroids)
    best = np.zeros(len(x), np.int64)
    least = ((x - centroids[0]) ** 2).sum(axis=1)
    seen = np.zeros((len(x), count), bool)
    seen[:, 0] = True
    place = np.zeros(len(x), np.int64)
    rows = np.arange(len(x))
    while True:
        rows = rows[place[rows] < count]
        rows = rows[least[rows] >= stop[best[rows], place[rows]]]
        if not len(rows):
            return best, least
        other = order[best[rows], place[rows]]
        place[rows] += 1
        new = ~seen[rows, other]
        row, other = rows[new], other[new]
        seen[row, other] = True
        apart = x[row] - centroids[other]
        distance = np.einsum("ij,ij->i", apart, apart)
        better = (distance < least[row]) | ((distance == least[row]) & (other < best[row]))
        row = row[better]
        best[row], least[row], place[row] = other[better], distance[better], 0


def _components(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("components").flatten().to_numpy().astype(np.int64).reshape(-1, dims)


def _summing(centroids: np.ndarray) -> Callable:
    """Per task, the sum and the number of the vectors nearest to each centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = neighbours(centroids)
        sums, counts = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for batch in batches:
            x = _components(batch, centroids.shape[1])
            best, _ = nearest(x, centroids, lists)
            np.add.at(sums, best, x)
            counts += np.bincount(best, minlength=len(centroids))
        found = np.flatnonzero(counts)
        columns = {
            "cluster": pa.array(found, pa.int32()),
            "n": pa.array(counts[found]),
            "sums": pa.array(sums[found].tolist(), pa.list_(pa.int64())),
        }
        yield pa.RecordBatch.from_pydict(columns)

    return run


def _assigning(centroids: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = neighbours(centroids)
        for batch in batches:
            best, least = nearest(_components(batch, centroids.shape[1]), centroids, lists)
            columns = {"id": batch.column("id"), "cluster": pa.array(best, pa.int32()), "distance": pa.array(least)}
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _usable(vector: Column, dims: int) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (F.size(vector) == dims) & finite


def _moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: the mean of the vectors nearest to each, rounded down; empty ones stay."""
    parts = shared.map_arrow(vectors, _summing(centroids), "cluster int, n long, sums array<bigint>")
    parts = parts.select("cluster", "n", F.posexplode("sums").alias("component", "sum"))
    totals = parts.groupBy("cluster", "component").agg(F.sum("sum"), F.sum("n"))
    centroids = centroids.copy()
    # One row for each component of a centroid.
    for cluster, component, total, n in totals.collect():
        centroids[cluster, component] = total // n
    return centroids


def cluster_vectors(
    vectors: DataFrame,
    k: int,
    rounds: int,
    seed: int,
    dims: int = 64,
    scale: int = 256,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """Cluster of every usable vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid.

    A vector is usable if it has exactly ``dims`` components, none NULL or non-finite; others have no row. Components
    become floor(scale * x), whole numbers, so every sum is exact whatever its order; those beyond
    ``largest_component(dims)`` in size (2**27 for 64) count as that. The first centroids are the vectors with
    the smallest SHA-256 of ``<seed>:<id>``; equal hashes go by components, a NULL id comes last. Each round
    assigns all vectors to the nearest centroid by squared Euclidean distance, the smaller number on ties, and moves
    every centroid that has vectors to their mean, rounded down. Fewer vectors than ``k`` give as many
    centroids, equal vectors stay separate centroids, and repeated ids are vectors of their own. No usable vector gives no
    rows. Sums of distances beyond a long are NULL. Other columns are not read.

    A round is one scan of the whole numbers, written once: tasks send one row per centroid. Centroids
    (``k`` times ``dims`` numbers) pass through the driver.
    """
    most = largest_component(dims)
    whole = F.transform(
        embedding, lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(most)), F.lit(-most)).cast("int")
    )
    kept = vectors.select(F.col(vec_id).alias("id"), F.when(_usable(F.col(embedding), dims), whole).alias("components"))
    kept = pin(kept.filter("components IS NOT NULL"), "vectors")
    start = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    seeds = kept.select(start.alias("hash"), "components").orderBy(F.asc_nulls_last("hash"), "components").limit(k)
    centroids = np.array([row.components for row in seeds.collect()], np.int64).reshape(-1, dims)
    id_type = kept.schema["id"].dataType.simpleString()
    result = f"{vec_id} {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<bigint>"
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], result)
    for _ in range(rounds):
        centroids = _moved(kept, centroids)
    assigned = shared.map_arrow(kept, _assigning(centroids), f"id {id_type}, cluster int, distance long")
    assigned = pin(assigned, "assigned")
    inertia = dict(assigned.groupBy("cluster").agg(F.try_sum("distance")).collect())
    parts = list(inertia.values())
    total = None if None in parts or sum(parts) > LONGEST else sum(parts)
    clusters = [(c, part, total, centroids[c].tolist()) for c, part in inertia.items()]
    clusters = vectors.sparkSession.createDataFrame(
        clusters, "cluster int, cluster_inertia long, inertia long, centroid array<bigint>"
    )
    # One row for each centroid, k at most.
    out = assigned.join(F.broadcast(clusters), "cluster")
    return out.select(F.col("id").alias(vec_id), "cluster", "distance", "cluster_inertia", "inertia", "centroid")
