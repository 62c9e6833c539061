"""Centroid clustering: exact integer Lloyd rounds over distinct quantised vectors with multiplicities.

Vectors are turned into integers first, so sums, means (floor of sum over count) and squared distances are exact and do
not depend on how rows are dealt out. Identical quantised vectors become one row with the number of its copies, summed
before the shuffle, so a vector that a third of all rows have is no hot key; each round reads only the distinct vectors
and gives one row of weighted sums for each centroid and task. To the driver go as many rows as there are centroids times
components, whatever the table. Assignments are joined back to the ids by a 128-bit digest of the vector; those of vectors
with more than one in ``HOT_SHARE`` of the rows, of which there are fewer than ``HOT_SHARE``, are broadcast.

Defined results: a null vector, one of another length, and one with a null or non-finite component are left out; a
component beyond 2^27 after scaling counts as that bound, which keeps distances within 64 bits; a null id is clustered but
starts no centroid; repeated ids are rows of their own, and of those that start centroids each of the rows counts (equal
hashes: the smaller vector first); with fewer rows than centroids there are as many centroids as rows; inertias beyond 64
bits stop at the largest number; an empty table gives an empty one; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelumen.llm.common import stored, table

#: Components stay within this, so that a sum of 64 squared differences fits in 64 bits.
MOST = 1 << 27
#: Vectors assigned at once by a worker.
ROWS = 8192
#: A vector with over 1 / HOT_SHARE of all rows is joined by broadcast.
HOT_SHARE = 1024


def quantised(vectors: DataFrame, id_column: str, vector_column: str, size: int, scale: int) -> DataFrame:
    """``(id, v)``: the integer vectors of the rows that are kept."""
    x = F.col(f"`{vector_column}`").cast("array<double>")
    sound = F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
    whole = F.transform("x", lambda e: F.floor(F.greatest(F.least(e * float(scale), F.lit(float(MOST))), F.lit(float(-MOST)))).cast("int"))
    kept = vectors.select(F.col(f"`{id_column}`").cast("long").alias("id"), x.alias("x")).where((F.size(x) == size) & sound)
    return kept.select("id", whole.alias("v"))


def digest(vector: Column) -> Column:
    """128 bits of a vector."""
    return F.struct(F.xxhash64(vector).alias("a"), F.xxhash64(F.lit(1), vector).alias("b"))


def first_centroids(rows: DataFrame, k: int, label: str) -> np.ndarray:
    """The k vectors whose ids have the smallest SHA-256 of ``label:id``, in that order; k rows reach the driver."""
    named = rows.where("id IS NOT NULL").select(F.sha2(F.concat(F.lit(f"{label}:"), F.col("id").cast("string")), 256).alias("h"), "v")
    return np.array([r["v"] for r in named.orderBy("h", "v").limit(k).collect()], np.int64)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector (ties: the smaller number) and the squared distance, in exact integers.

    Sums of products below 2^53 are exact as floating-point numbers too, and then one matrix product gives them all.
    """
    largest = int(max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)))
    if 4 * largest * largest * vectors.shape[1] < 1 << 53:
        v, c = vectors.astype(np.float64), centroids.astype(np.float64)
        far = (v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)[None, :]
    else:
        far = np.stack([((vectors - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    at = far.argmin(axis=1)
    return at, far[np.arange(len(at)), at].astype(np.int64)


def weighted_sums(vectors: np.ndarray, weights: np.ndarray) -> list[int]:
    """Component sums of the vectors times their weights; wide integers where 64 bits might not do."""
    wide = int(np.abs(vectors).max(initial=0)) * sum(weights.tolist()) >= 1 << 62
    return ((vectors.astype(object) if wide else vectors) * (weights.astype(object) if wide else weights)[:, None]).sum(axis=0).tolist()


def _matrix(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(i, ROWS) for batch in batches for i in range(0, len(batch), ROWS))


def moved(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round over ``distinct(v, n)``; those without vectors stay."""
    k, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [[0] * size for _ in range(k)], [0] * k
        for batch in _slices(batches):
            vectors, weights = _matrix(batch, size), batch.column(1).to_numpy()
            at, _ = nearest(vectors, centroids)
            for c in np.unique(at).tolist():
                own = at == c
                sums[c] = [a + b for a, b in zip(sums[c], weighted_sums(vectors[own], weights[own]), strict=True)]
                counts[c] += sum(weights[own].tolist())
        used = [c for c in range(k) if counts[c]]
        wide = pa.decimal128(38, 0)
        columns = [pa.array(used, pa.int32()), pa.array([[str(x) for x in sums[c]] for c in used], pa.list_(pa.string())), pa.array([counts[c] for c in used], pa.int64())]
        columns[1] = pa.ListArray.from_arrays(columns[1].offsets, columns[1].values.cast(wide))
        yield pa.record_batch(columns, ["c", "sums", "n"])

    parts = distinct.select("v", "n").mapInArrow(run, "c int, sums array<decimal(38,0)>, n long")
    each = parts.select("c", "n", F.posexplode("sums").alias("at", "part"))
    found = each.groupBy("c", "at").agg(F.sum("part").alias("total"), F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()
    after = centroids.copy()
    for r in found:
        after[r["c"], r["at"]] = int(r["total"]) // int(r["n"])
    return after


def assigned(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``(v, n, cluster, distance)`` of the distinct vectors."""
    size = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            at, far = nearest(_matrix(batch, size), centroids)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(at.astype(np.int32)), pa.array(far)], ["v", "n", "cluster", "distance"])

    return distinct.select("v", "n").mapInArrow(run, "v array<int>, n long, cluster int, distance long")


def centroid_clusters(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 40, rounds: int = 5, size: int = 64, scale: int = 256, label: str = "2") -> tuple[DataFrame, np.ndarray]:
    """``(id, cluster, distance, cluster_inertia, inertia)`` of every kept row, and the final centroids."""
    spark = vectors.sparkSession
    rows = quantised(vectors, id_column, vector_column, size, scale)
    distinct = stored(rows.groupBy("v").agg(F.count("*").alias("n")))
    centroids = first_centroids(rows, k, label)
    if not len(centroids):  # no rows, or none with an id
        if distinct.isEmpty():
            return spark.createDataFrame([], "id long, cluster int, distance long, cluster_inertia long, inertia long"), centroids
        centroids = np.array([r["v"] for r in distinct.orderBy("v").select("v").limit(k).collect()], np.int64)
    for _ in range(rounds):
        centroids = moved(distinct, centroids)
    placed = stored(assigned(distinct, centroids).withColumn("key", digest(F.col("v"))).drop("v"))
    spread = placed.groupBy("cluster").agg(F.sum(F.col("n").cast("decimal(38,0)") * F.col("distance")).alias("far"), F.sum("n").alias("n")).collect()
    most, count = (1 << 63) - 1, sum(r["n"] for r in spread)
    inertia = {r["cluster"]: int(r["far"]) for r in spread}  # a row a centroid
    of_cluster = spark.createDataFrame([(c, min(x, most)) for c, x in inertia.items()], "cluster int, cluster_inertia long")
    places = placed.select("key", "n", "cluster", "distance")
    frequent = F.col("n") * HOT_SHARE > count
    hot = F.broadcast(places.where(frequent).drop("n"))
    keyed = rows.select("id", digest(F.col("v")).alias("key"))
    common = keyed.join(hot, "key")
    rare = keyed.join(F.broadcast(places.where(frequent).select("key")), "key", "left_anti").join(places.where(~frequent).drop("n"), "key")
    met = common.unionByName(rare).join(F.broadcast(of_cluster), "cluster")
    return met.select("id", "cluster", "distance", "cluster_inertia", F.lit(min(sum(inertia.values()), most)).cast("long").alias("inertia")), centroids


def centroid_digests(centroids: np.ndarray) -> list[str]:
    """SHA-256 of each centroid's components, in decimal, joined by commas."""
    return [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]


def op11_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    """Cluster, squared distance, inertias and the centroid's digest of every vector of 64 finite components."""
    found, centroids = centroid_clusters(table(spark, sf_dir, "embeddings"))
    named = spark.createDataFrame(list(enumerate(centroid_digests(centroids))), "cluster int, centroid_sha256 string")
    return found.withColumnRenamed("id", "vec_id").join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(rounds: int = 5, k: int = 40) -> str:
    far = "list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    parts = [
        "kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings"
        " WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT sha256('2:' || CAST(vec_id AS VARCHAR)) AS h, v FROM kept ORDER BY h LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT k.vec_id, any_value(k.v) AS v, min({{'d': CAST({far} AS BIGINT), 'c': c.c}}) AS best FROM kept k CROSS JOIN c{i} c GROUP BY k.vec_id)")
        if i < rounds:
            parts.append(f"s{i} AS (SELECT best.c AS c, p, CAST(sum(v[p]) AS BIGINT) AS s, count(*) AS n FROM a{i}, range(1, 65) r(p) GROUP BY ALL)")
            parts.append(f"m{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY p) AS v FROM s{i} GROUP BY c)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING (c))")
    return f"""WITH {", ".join(parts)}
        SELECT a.vec_id, CAST(a.best.c AS INTEGER) AS cluster, a.best.d AS distance, CAST(sum(a.best.d) OVER (PARTITION BY a.best.c) AS BIGINT) AS cluster_inertia,
               CAST(sum(a.best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} c ON c.c = a.best.c"""


ORACLE = _oracle()
