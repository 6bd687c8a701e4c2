"""An inverted-file index over dense vectors: lists around centroids, a few of which are searched for a query.

Centroids and the number of lists to search are fitted on a bounded sample; every row is put into the list of its
nearest centroid. What a search finds is ranked by the exact cosine. A list of many rows is searched in parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procaudit.operators import tfidf as I
from procaudit.sources.tables import saved

#: Rows that centroids are fitted on, those of the least hashes; lists at most; steps of the fit.
SAMPLE_ROWS, MAX_LISTS, ROUNDS = 50_000, 4096, 12
#: Sample rows that are searched to set the number of lists, and the share of them that must find their neighbour.
TRIAL_ROWS, TRIAL_RECALL = 1000, 0.97


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = np.asarray(vectors, np.float64)
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit vectors by spherical k-means; an empty list takes the vector that is farthest from its own."""
    rng = np.random.default_rng(seed)
    centroids = sample[np.sort(rng.choice(len(sample), lists, replace=False))]
    for _ in range(rounds):
        near, best = nearest_lists(sample, centroids, 1)
        near = near[:, 0]
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        empty = np.flatnonzero(np.bincount(near, minlength=lists) == 0)
        sums[empty] = sample[np.argsort(best[:, 0], kind="stable")[: len(empty)]]
        centroids = unit(sums)
    return centroids


def nearest_lists(vectors: np.ndarray, centroids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(lists, cosines) of each unit vector's ``n`` nearest centroids, the nearest first."""
    lists, cosines = [], []
    for a in range(0, len(vectors), 4096):
        s = vectors[a : a + 4096] @ centroids.T
        order = np.argsort(-s, axis=1, kind="stable")[:, :n]
        lists.append(order)
        cosines.append(np.take_along_axis(s, order, axis=1))
    return np.concatenate(lists), np.concatenate(cosines)


def lists_to_search(sample: np.ndarray, centroids: np.ndarray, recall: float = TRIAL_RECALL, trials: int = TRIAL_ROWS) -> int:
    """How many lists a search must look at so that ``recall`` of the first sample rows find their nearest neighbour in
    the sample."""
    own = nearest_lists(sample, centroids, 1)[0][:, 0]
    places = []
    for i in range(0, min(trials, len(sample)), 256):
        asked = sample[i : min(i + 256, trials)]
        s = asked @ sample.T
        s[np.arange(len(asked)), i + np.arange(len(asked))] = -np.inf
        order = nearest_lists(asked, centroids, len(centroids))[0]
        places.append((order == own[s.argmax(axis=1)][:, None]).argmax(axis=1))
    return 1 + int(np.quantile(np.concatenate(places), recall, method="higher"))


@dataclass
class VectorIndex:
    """(list, id, v) rows, their centroids, and the number of lists that a search looks at."""

    rows: DataFrame
    centroids: np.ndarray
    probes: int

    def search(self, queries: DataFrame) -> DataFrame:
        """(q_id, id, score) of the best row that the lists hold for each query (id, v), by exact cosine, of equal ones
        the smallest id; a query is no neighbour of its own."""
        sizes = self.rows.groupBy("list").agg(F.ceil(F.count("*") / I.BLOCK_ROWS).alias("parts"))
        asked = _listed(queries, self.centroids, self.probes).join(sizes, "list").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
        blocks = sizes.select(F.col("list").alias("l"), "parts")
        held = self.rows.join(blocks, F.col("list") == F.col("l")).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("l", "parts")
        found = asked.groupBy("list", "part").cogroup(held.groupBy("list", "part")).applyInPandas(I._dense_best, I.FOUND.format(q_id=queries.schema["id"].dataType.simpleString(), id=self.rows.schema["id"].dataType.simpleString()))
        return I._nearest(found)


def _listed(vectors: DataFrame, centroids: np.ndarray, n: int) -> DataFrame:
    """(list, id, v): each row once for each of its ``n`` nearest lists. MAX_LISTS centroids go with the task."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lists = nearest_lists(unit(np.stack(batch.column(1).to_numpy(zero_copy_only=False))), shared.value, n)[0]
                at = pa.array(np.repeat(np.arange(batch.num_rows), lists.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(lists.ravel(), pa.int32()), batch.column(0).take(at), batch.column(1).take(at)], names=["list", "id", "v"])

    kind = {c: vectors.schema[c].dataType.simpleString() for c in ("id", "v")}
    return vectors.select("id", "v").mapInArrow(run, f"list int, id {kind['id']}, v {kind['v']}")


def build_index(vectors: DataFrame, lists: int | None = None, sample_rows: int = SAMPLE_ROWS, recall: float = TRIAL_RECALL) -> VectorIndex:
    """The index of all rows (id, v), vectors of one width without null; ``lists`` is the square root of their number by
    default, MAX_LISTS at most. The fit sees ``sample_rows`` rows at most; lists and probes come from them, all rows are
    indexed."""
    rows = vectors.where(F.col("id").isNotNull() & F.col("v").isNotNull())
    sample = [r["v"] for r in rows.select("v", F.xxhash64("id").alias("h")).orderBy("h").limit(sample_rows).collect()]
    if not sample:
        raise ValueError("no vectors to index")
    sample = unit(np.array(sample))
    lists = min(lists or int(rows.count() ** 0.5) or 1, MAX_LISTS, len(sample))
    centroids = fit_centroids(sample, lists)
    return VectorIndex(saved(_listed(rows, centroids, 1), "vector-index"), centroids, lists_to_search(sample, centroids, recall) if len(sample) > 1 else lists)
