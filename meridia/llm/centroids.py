"""Centroid clustering in whole numbers by a tournament of bisectors.

Vectors become whole numbers once and are written; a round then sends all of them through a tournament: for each pair of
centroids the plane between them is a whole normal and a threshold, and k - 1 signs leave one centroid to each vector.
Only the winner's distance is worked out, exactly. A task adds its vectors up by cluster, so a round shuffles k rows
a task, and the driver holds the k centroids and nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Vectors that are compared together.
AT_ONCE = 1 << 14


def small(dim: int) -> int:
    """Components up to this size leave room in 64 bits for every sum over dim of them; others are reckoned with numbers of any length."""
    return isqrt((1 << 59) // max(dim, 1))


def whole(batch: pa.RecordBatch, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that count, their components as whole numbers): exactly dim components, none null or not finite."""
    lists = batch.column(1).cast(pa.large_list(pa.float64()))
    rows = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(lists), dim), False).to_numpy(zero_copy_only=False))
    flat = lists.take(pa.array(rows)).flatten()
    x = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dim)
    good = np.isfinite(x).all(1)
    y = np.floor(x[good] * scale)
    if y.size and not np.abs(y).max() < 2.0**63:
        raise ValueError("a component does not fit 64 bits")
    return rows[good], y.astype(np.int64)


def _whole(batches: Iterator[pa.RecordBatch], dim: int, scale: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, y = whole(batch, dim, scale)
        yield pa.record_batch([batch.column(0).take(pa.array(rows)), as_lists(y)], names=["id", "v"])


def as_lists(y: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.ravel(), pa.int64()))


class Bisectors:
    """For each pair i < j of centroids the plane between them: a vector is nearer to j where normal . x > threshold; on the plane i wins."""

    def __init__(self, centroids: list[list[int]]):
        self.small = small(len(centroids[0]))
        self.big = max((abs(x) for c in centroids for x in c), default=0) > self.small
        c = np.array(centroids, object if self.big else np.int64).reshape(len(centroids), -1)
        self.centroids = c
        self.normals = 2 * (c[None, :, :] - c[:, None, :])
        self.thresholds = (c * c).sum(1)[None, :] - (c * c).sum(1)[:, None]

    def winners(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, of equals the least; squared distance) for each row of whole numbers."""
        if self.big or len(x) and np.abs(x).max() > self.small:
            x = x.astype(object)
        best = np.zeros(len(x), np.int64)
        for j in range(1, len(self.centroids)):
            # best < j always, so a row is (champion, j) and zero keeps the champion.
            side = (self.normals[best, j] * x).sum(1) - self.thresholds[best, j]
            best[side > 0] = j
        d = x - self.centroids[best]
        return best, (d * d).sum(1)


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    for k in range(0, len(batch), AT_ONCE):
        part = batch.slice(k, AT_ONCE).column(1)
        yield k, part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)


def _sums(batches: Iterator[pa.RecordBatch], centroids: list[list[int]]) -> Iterator[pa.RecordBatch]:
    planes, dim = Bisectors(centroids), len(centroids[0])
    total, count = [[0] * dim for _ in centroids], [0] * len(centroids)
    for batch in batches:
        for _, x in _vectors(batch):
            best, _ = planes.winners(x)
            for c in range(len(centroids)):
                own = x[best == c]
                count[c] += len(own)
                if len(own):
                    add = (own.astype(object) if np.abs(own).max() > planes.small else own).sum(0)
                    total[c] = [a + int(b) for a, b in zip(total[c], add, strict=True)]
    met = [c for c, n in enumerate(count) if n]
    sums = pa.array([[Decimal(s) for s in total[c]] for c in met], pa.list_(pa.decimal128(38, 0)))
    yield pa.record_batch([pa.array(met, pa.int32()), pa.array([count[c] for c in met], pa.int64()), sums], names=["cluster", "n", "sums"])


def _assigned(batches: Iterator[pa.RecordBatch], centroids: list[list[int]]) -> Iterator[pa.RecordBatch]:
    planes = Bisectors(centroids)
    for batch in batches:
        for k, x in _vectors(batch):
            best, distance = planes.winners(x)
            yield pa.record_batch([batch.column(0).slice(k, len(x)), pa.array(best.astype(np.int32)), pa.array(distance.tolist() if distance.dtype == object else distance, pa.int64())], names=["id", "cluster", "distance"])


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """One round: every centroid that has vectors becomes floor(sum / count) of theirs. The driver gets k x dimensions numbers."""
    rows = vectors.mapInArrow(lambda it: _sums(it, centroids), "cluster int, n long, sums array<decimal(38,0)>")
    each = rows.select("cluster", "n", F.posexplode("sums").alias("at", "s")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    new = [list(c) for c in centroids]
    for r in each.collect():
        new[r.cluster][r.at] = int(r.s) // int(r.n)
    return new


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """((id_col, cluster, distance) for each vector that counts, the centroids): rounds of Lloyd's algorithm over floor(scale * x), then each vector's
    nearest centroid, of equals the least, and its squared distance. It ends sooner where a round moves nothing, which changes no result.

    Vectors that are null, have not exactly dim components, or have one that is null or not finite, do not count and give no
    row. The first centroids are the k vectors with the least SHA-256 of "seed:id"; of equal ids (ties) the lesser vector comes first,
    null ids come last; fewer vectors than k are so many centroids. Rows that repeat an id are vectors of their own. A component or a
    distance that does not fit 64 bits is an error, as the result is a long; all that fit are exact. No vectors give no
    rows; further columns are not read, whatever their names.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    kind = rows.schema["id"].dataType.simpleString()
    kept = written(rows.mapInArrow(lambda it: _whole(it, dim, scale), f"id {kind}, v array<long>"), "whole-vectors")
    first = kept.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).asc_nulls_last(), "v").limit(k).collect()
    centroids = [list(r.v) for r in first]
    if not centroids:
        return kept.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), []
    for _ in range(rounds):
        before, centroids = centroids, moved(kept, centroids)
        if before == centroids:
            break
    last = kept.mapInArrow(lambda it: _assigned(it, centroids), f"id {kind}, cluster int, distance long")
    return written(last, "assigned").withColumnRenamed("id", id_col), centroids


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = cluster(table(spark, sf_dir, "embeddings"))
    digests = [(c, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids)]
    inertia = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))  # k rows
    whole_sum = inertia.agg(F.sum("cluster_inertia").alias("s")).first().s or 0
    named = inertia.join(F.broadcast(spark.createDataFrame(digests, "cluster int, centroid_sha256 string")), "cluster").withColumn("inertia", F.lit(int(whole_sum)).cast("long"))
    return found.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """Plain distances to every centroid, a table for each round."""
    parts = [
        f"kept AS MATERIALIZED (SELECT vec_id, embedding AS e FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"v AS MATERIALIZED (SELECT vec_id, unnest(range(1, {dim + 1})) AS p, CAST(floor({scale} * CAST(unnest(e) AS DOUBLE)) AS BIGINT) AS x FROM kept)",
        f"s AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c FROM kept)",
        f"c0 AS MATERIALIZED (SELECT CAST(s.c AS INTEGER) AS c, v.p, v.x FROM s JOIN v USING (vec_id) WHERE s.c < {k})",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, min_by(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.vec_id, k.c, CAST(sum((v.x - k.x) * (v.x - k.x)) AS BIGINT) AS d FROM v JOIN c{r} k ON k.p = v.p GROUP BY v.vec_id, k.c) GROUP BY vec_id)")
        if r < rounds:
            floor = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT k.c, k.p, coalesce({floor}, k.x) AS x FROM c{r} k LEFT JOIN (SELECT a.c, v.p, CAST(sum(v.x) AS BIGINT) AS s, count(*) AS n FROM a{r} a JOIN v USING (vec_id) GROUP BY a.c, v.p) m ON m.c = k.c AND m.p = k.p)")
    parts.append(f"h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p)) AS h FROM c{rounds} GROUP BY c)")
    return f"WITH {', '.join(parts)} SELECT a.vec_id, a.c AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, h.h AS centroid_sha256 FROM a{rounds} a JOIN h ON h.c = a.c"


OP11_SQL = _sql()
