"""Centroid clustering by delta Lloyd: exact integer k-means that redoes only what a round changed.

Vectors, owners and distances are a table in the shared folder, one version a round; counts and component sums of the
clusters are global and stay between rounds. A round looks at the centroids that moved: a vector whose owner moved is
compared with all centroids, any other one only with those that moved, since its distance to its owner still holds.
The vectors that change hands are summed by (old owner, new owner, component); these at most k * k * dim sums reach the
driver and are taken off the one and put on the other cluster's sums. Nothing else is shuffled, so hot values make no hot task,
and a lost executor costs one round's partitions at most. Rounds end early when no centroid moves.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, plain, staged_at

#: Components below this size make sums and products of 64 of them exact in doubles; others are done in Python's integers.
EXACT = 1 << 22


def quantized(embedding: Column, scale: int) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * float(scale)))


def usable(embedding: Column, dim: int) -> Column:
    """Exactly ``dim`` components, none null or not finite."""
    odd = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(embedding) == dim) & ~odd, F.lit(False))


def squares(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, a column a centroid."""
    if max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT:
        v, c = vectors.astype(np.float64), centroids.astype(np.float64)
        return ((v * v).sum(1)[:, None] - 2.0 * (v @ c.T) + (c * c).sum(1)).astype(np.int64)
    v, c = vectors.astype(object), centroids.astype(object)
    return np.stack([((v - x) ** 2).sum(1) for x in c], axis=1)


def _assign(centroids: list[list[int]], moved: list[int], dim: int):
    """Rows (id, vector, owner, distance) with the owner before the round kept as ``old``; a null owner has been compared with none."""

    def run(batches):
        every = np.array(centroids, dtype=np.int64)
        again = np.isin(np.arange(len(centroids)), moved)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids, held = batch.column(0), batch.column(1)
            v = np.asarray(held.flatten()).reshape(n, dim)
            old = np.asarray(batch.column(2).fill_null(-1)).astype(np.int64)
            best = np.array(batch.column(3).fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
            owner = old.copy()
            whole = (old < 0) | again[old]
            if whole.any():
                d = squares(v[whole], every)
                owner[whole] = nearest = np.argmin(d, axis=1)  # the first of equals is the smaller number
                best[whole] = d[np.arange(len(d)), nearest].astype(np.int64)
            rest = np.flatnonzero(~whole)
            if len(rest) and len(moved):
                d = squares(v[rest], every[moved])
                j = np.argmin(d, axis=1)
                new, near = d[np.arange(len(d)), j].astype(np.int64), np.asarray(moved)[j]
                takes = (new < best[rest]) | ((new == best[rest]) & (near < owner[rest]))
                owner[rest[takes]], best[rest[takes]] = near[takes], new[takes]
            columns = [ids, held, pa.array(owner, pa.int32()), pa.array(best, pa.int64()), pa.array(old, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "vector", "owner", "distance", "old"])

    return run


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dim: int = 64, scale: int = 1024) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable row of ``vectors``.

    Starts at the ``k`` rows with the smallest sha256 of ``<seed>:<vec_id>`` (fewer rows: as many clusters); null ids come last, equal
    ids by their components. Rows with a null embedding, another length, or null or non-finite components are left out;
    repeated rows each count and all get a row; an empty table gives an empty result. Extra columns are ignored. A distance
    or an inertia beyond a long fails the job rather than wrap.
    """
    spark = vectors.sparkSession
    rows = plain(vectors, "vec_id", "embedding").where(usable(F.col("embedding"), dim))
    rows = rows.select(F.col("vec_id").alias("id"), quantized(F.col("embedding"), scale).alias("vector"))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.orderBy(key.asc_nulls_last(), "vector").limit(k).select("vector").collect()
    centroids = [list(r.vector) for r in first]
    counts, sums = [0] * len(centroids), [[0] * dim for _ in centroids]
    blank = rows.withColumns({"owner": F.lit(None).cast("int"), "distance": F.lit(None).cast("long")})
    schema = f"id {rows.schema['id'].dataType.simpleString()}, vector array<long>, owner int, distance long, old int"
    state, path, moved = blank, None, list(range(len(centroids)))
    for done in range(rounds + 1):
        before = path
        step = state.select("id", "vector", "owner", "distance").mapInArrow(_assign(centroids, moved, dim), schema)
        state, path = staged_at(step, "lloyd")
        if before:
            discard(spark, before)
        if done == rounds:
            break
        given = state.where("owner <> old").select("old", "owner", F.posexplode("vector").alias("i", "x"))
        transfers = given.groupBy("old", "owner", "i").agg(F.count("*").alias("n"), F.sum(F.col("x").cast("decimal(20,0)")).alias("s"))
        for t in transfers.collect():  # at most k * k * dim rows
            for side, sign in ((t.old, -1), (t.owner, 1)):
                if side >= 0:
                    counts[side] += sign * t.n * (t.i == 0)
                    sums[side][t.i] += sign * int(t.s)
        new = [[x // n for x in s] if n else c for c, s, n in zip(centroids, sums, counts)]
        moved = [i for i, (a, b) in enumerate(zip(centroids, new)) if a != b]
        centroids = new
        if not moved:
            break
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    shown = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    sizes = state.groupBy(F.col("owner").alias("cluster")).agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("d"))
    sizes = [(r.cluster, int(r.d)) for r in sizes.collect()]  # at most k rows
    total = sum(d for _, d in sizes)
    inertia = spark.createDataFrame([(i, d, total) for i, d in sizes], "cluster int, cluster_inertia long, inertia long")
    about = F.broadcast(shown.join(inertia, "cluster"))
    out = state.select(F.col("id").alias("vec_id"), F.col("owner").alias("cluster"), "distance")
    return out.join(about, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int = 8, rounds: int = 10, seed: int = 3, dim: int = 64, scale: int = 1024) -> str:
    """DuckDB's SQL for the same, every round in full."""
    near = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    parts = [
        f"""v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda e: CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
 WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dim})""",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h NULLS LAST, x) - 1 AS INT) AS k, x FROM (SELECT sha256('{seed}:' || vec_id) AS h, x FROM v) ORDER BY h NULLS LAST, x LIMIT {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, min(k) AS k, min(d) AS d FROM (SELECT v.r, c.k, {near} AS d, min({near}) OVER (PARTITION BY v.r) AS least FROM v, c{i} c) WHERE d = least GROUP BY r)")
        if i < rounds:
            parts.append(f"""s{i} AS (SELECT k, i, CAST(floor_of AS BIGINT) AS y FROM (SELECT a.k, t.i, (sum(v.x[t.i]) - ((sum(v.x[t.i]) % count(*)) + count(*)) % count(*)) // count(*) AS floor_of
 FROM a{i} a JOIN v USING (r), range(1, {dim + 1}) t(i) GROUP BY 1, 2)),
c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(n.x, c.x) AS x FROM c{i} c LEFT JOIN (SELECT k, list(y ORDER BY i) AS x FROM s{i} GROUP BY k) n USING (k))""")
    last = rounds
    return f"""WITH {', '.join(parts)}
SELECT v.vec_id, a.k AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
 sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{last} a JOIN v USING (r) JOIN c{last} c USING (k)"""
