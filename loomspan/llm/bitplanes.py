"""Centroid clustering of 64-component vectors by the popcount of bit planes.

A vector of 64 integers is turned on its side: the k-th bits of all components make
one 64-bit number, its k-th plane. The product of two vectors is then a sum over
pairs of planes of the number of bits that both have, times the planes' weights, and
so are squared distances, all exact. Vectors are packed once and stay packed; each
round hands the driver sums over clusters, never rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm._base import dropped, stored, table

SIZE = 64  # components, one for each bit of a plane


def weights(planes: int) -> np.ndarray:
    """What a bit of each plane counts in two's complement: the last plane has the signs."""
    out = np.int64(1) << np.arange(planes, dtype=np.int64)
    out[-1] = -out[-1]
    return out


def pack(values: np.ndarray) -> np.ndarray:
    """Planes (n x planes, uint64) of n x 64 integers, as few as hold all of them."""
    widest = int((values ^ (values >> 63)).max(initial=0)).bit_length() + 1
    out = np.empty((len(values), widest), np.uint64)
    for k in range(widest):
        bits = ((values >> k) & 1).astype(np.uint8)
        out[:, k] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def unpack(planes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(planes), SIZE), np.int64)
    for k, weight in enumerate(weights(planes.shape[1])):
        out += weight * _bits(planes[:, k])
    return out


def _bits(plane: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(plane).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of packed vectors, each of ``x`` with each of ``y``."""
    out = np.zeros((len(x), len(y)), np.int64)
    for i, a in enumerate(weights(x.shape[1])):
        for j, b in enumerate(weights(y.shape[1])):
            out += np.bitwise_count(x[:, i, None] & y[None, :, j]) * (a * b)
    return out


def squares(x: np.ndarray) -> np.ndarray:
    """The product of each packed vector with itself."""
    out = np.zeros(len(x), np.int64)
    for i, a in enumerate(weights(x.shape[1])):
        for j, b in enumerate(weights(x.shape[1])):
            out += np.bitwise_count(x[:, i] & x[:, j]) * (a * b)
    return out


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each packed vector the nearest packed centroid, the first of several, and its squared distance."""
    own, away, norm = np.empty(len(x), np.int32), np.empty(len(x), np.int64), squares(centroids)
    step = max(1, (1 << 18) // len(centroids))
    for low in range(0, len(x), step):
        part = x[low : low + step]
        distance = squares(part)[:, None] - 2 * products(part, centroids) + norm
        own[low : low + step] = distance.argmin(axis=1)
        away[low : low + step] = distance.min(axis=1)
    return own, away


def _groups(column):
    """Rows of a batch with equally many planes, as (indexes, planes)."""
    rows = column.to_pylist()
    sizes = np.array([len(r) for r in rows])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, np.frombuffer(b"".join(rows[i] for i in at), "<u8").reshape(len(at), -1)


def _pack(scale: float):
    def run(batches):
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            planes = pack(np.floor(scale * flat.reshape(-1, SIZE)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p.tobytes() for p in planes], pa.binary())], ["id", "planes"])

    return run


def _sums(centroids: np.ndarray):
    """Per task: of every cluster the sum of each component, and at place ``SIZE`` how many vectors it has."""

    def run(batches):
        total, some = np.zeros((len(centroids), SIZE + 1), np.int64), False
        for batch in batches:
            for _, x in _groups(batch.column(1)):
                own, _ = nearest(x, centroids)
                order = np.argsort(own, kind="stable")
                cluster, first = np.unique(own[order], return_index=True)
                for k, weight in enumerate(weights(x.shape[1])):
                    total[cluster, :SIZE] += weight * np.add.reduceat(_bits(x[order, k]), first, axis=0, dtype=np.int64)
                total[:, SIZE] += np.bincount(own, minlength=len(centroids))
                some = True
        if some:
            cluster, place = np.nonzero(np.broadcast_to(total[:, SIZE:] > 0, total.shape))
            yield pa.RecordBatch.from_arrays([pa.array(cluster.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(total[cluster, place])], ["cluster", "place", "total"])

    return run


def _assigned(centroids: np.ndarray):
    def run(batches):
        for batch in batches:
            own, away = np.empty(batch.num_rows, np.int32), np.empty(batch.num_rows, np.int64)
            for at, x in _groups(batch.column(1)):
                own[at], away[at] = nearest(x, centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own), pa.array(away)], ["id", "cluster", "distance"])

    return run


def clusters(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 40, rounds: int = 5, scale: float = 256.0, seed: str = "2"
) -> DataFrame:
    """One row per vector that is kept: its id, cluster, distance, cluster_inertia, inertia and
    centroid_sha256.

    Vectors of exactly 64 components, none null or non-finite, are kept, and component x counts
    as floor(scale * x). The first centroids are the ``k`` vectors with the smallest SHA-256 of
    ``seed:id``, in that order (equal hashes by the vector; rows without an id after all others); fewer
    vectors are as many centroids. Each of ``rounds`` rounds assigns every vector to the nearest centroid
    (of several the smaller number) and moves each centroid that has vectors to the floor of their
    mean. The last assignment gives the rows; an empty table gives none.

    Repeated rows count as often as they come. Squared distances are longs, so integers beyond
    27 bits (scale * x outside -2**27 to 2**27) can't be expressed: such vectors are left out too.
    """
    spark = vectors.sparkSession
    widest = float(1 << 27)
    fits = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (x * scale >= -widest) & (x * scale < widest))
    raw = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where((F.size("v") == SIZE) & fits)
    first = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    start = raw.orderBy(first.asc_nulls_last(), "v").limit(k).select("v").collect()  # k vectors
    kind = dict(vectors.dtypes)[id_col]
    if not start:
        start = [([0.0] * SIZE,)]  # no vector will ask for it
    now = np.floor(scale * np.array([r[0] for r in start], float)).astype(np.int64)
    packed = stored(raw.mapInArrow(_pack(scale), f"id {kind}, planes binary"), "planes")
    for _ in range(rounds):
        sums = packed.mapInArrow(_sums(pack(now)), "cluster int, place int, total long").groupBy("cluster", "place").agg(F.sum("total").alias("total"))
        total = np.zeros((len(now), SIZE + 1), np.int64)
        for r in sums.collect():  # k * 65 numbers at most
            total[r.cluster, r.place] = r.total
        filled = total[:, SIZE] > 0
        now[filled] = total[filled, :SIZE] // total[filled, SIZE:]
    out = stored(packed.mapInArrow(_assigned(pack(now)), f"id {kind}, cluster int, distance long"), "clusters")
    dropped(spark, packed)
    inertia = {r[0]: r[1] for r in out.groupBy("cluster").agg(F.sum("distance")).collect()}  # k rows
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now.tolist()]
    facts = spark.createDataFrame([(c, n, sum(inertia.values()), digest[c]) for c, n in sorted(inertia.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(facts), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def op12_centroid_clusters(spark, sf_dir):
    """The 40 clusters of all of ``embeddings`` after five rounds. Null vectors, those of other lengths and those with null,
    non-finite or very large components have no row; repeated rows have equal rows; an empty table gives none."""
    return clusters(table(spark, sf_dir, "embeddings"))


def _oracle(k: int = 40, rounds: int = 5) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""d{r} AS (
  SELECT p.row, c.cluster, sum((p.x - c.x) * (p.x - c.x)) AS distance FROM parts p JOIN c{r} c ON p.place = c.place GROUP BY ALL
), a{r} AS (SELECT row, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance FROM d{r} GROUP BY row)""")
        if r < rounds:
            steps.append(f"""m{r} AS (
  SELECT a.cluster, p.place, sum(p.x) AS s, count(*) AS n FROM a{r} a JOIN parts p ON a.row = p.row GROUP BY ALL
), c{r + 1} AS (
  SELECT c.cluster, c.place, CAST(CASE WHEN m.n IS NULL THEN c.x ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS BIGINT) AS x
  FROM c{r} c LEFT JOIN m{r} m ON c.cluster = m.cluster AND c.place = m.place
)""")
    return f"""
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (SELECT row, vec_id, unnest(range(64)) AS place, CAST(floor(256 * unnest(v)) AS BIGINT) AS x FROM e),
starts AS (SELECT row, row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS cluster FROM e QUALIFY cluster < {k}),
c0 AS (SELECT cluster, place, x FROM starts JOIN parts USING (row)),
{''','''.join(x.replace(' AS (', ' AS MATERIALIZED (', 1) for x in steps)},
digests AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY place)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
SELECT e.vec_id, CAST(a.cluster AS INTEGER) AS cluster, CAST(a.distance AS BIGINT) AS distance,
  CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM e JOIN a{rounds} a USING (row) JOIN digests USING (cluster)
"""


ORACLE = _oracle()
