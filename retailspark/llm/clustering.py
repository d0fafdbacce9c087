"""Centroid clustering with heap-ordered bounds, exact on integers.

A vector assigned to a cluster keeps its gap: the distance to the second nearest
centroid (lower bound) less that to its own (upper bound).  When centroids move,
the gap shrinks by no more than its own centroid's move plus the largest move of
another one.  Each cluster adds these up in an offset, and a vector's key is its
gap plus the offset of the round in which it was measured: it expires when the
offset reaches the key, whatever the rounds in between.

So a cluster's vectors form a heap by key, of which a round pops the top.  On a
cluster the heap is a table sorted by cluster and key: popping is a read of the
range between the last offset and the new one, which reaches the Parquet scan as
a filter.  Only popped vectors are read, rescanned against all centroids and
written to the next part with new keys; the others aren't touched, and the sums
of the clusters change only by the vectors that move.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from retailspark.llm.common import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED = 40, 5, 64, 256, 2
#: Integers beyond this are read as it, so that squared distances fit a long.
MOST = 1 << 27
#: Up to this size all terms of a squared distance are exact in double precision.
_EXACT = 1 << 21


def integer_points(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """``id`` and ``point`` (floor(scale * x) of each component) of the vectors
    with that many components, none null or non-finite."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    as_integer = lambda x: F.greatest(F.least(F.floor(x * F.lit(float(scale))), F.lit(MOST)), F.lit(-MOST)).cast("int")
    return vectors.where((F.size(v) == dimensions) & finite).select(F.col(id_col).alias("id"), F.transform(v, as_integer).alias("point"))


def first_centroids(points: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The points with the smallest sha256 of ``seed:id`` (a null id as empty
    text; ties by id, then by components): at most ``clusters`` rows."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = points.orderBy(digest, "id", "point").select("point").limit(clusters).collect()
    return np.array([r["point"] for r in rows], dtype=np.int64)


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to all centroids."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) <= _EXACT:
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * (a @ c.T)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def _matrix(points: pa.Array) -> np.ndarray:
    return points.flatten().to_numpy().reshape(len(points), -1).astype(np.int64)


def _scanned(rows: DataFrame, centroids: np.ndarray, offsets: np.ndarray) -> DataFrame:
    """``id``, ``point``, ``was`` (the cluster until now), ``cluster`` and ``key``
    of every row, by exact distances to all centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            far = squared_distances(_matrix(batch.column("point")), centroids)
            here = np.arange(len(far))
            nearest = far.argmin(axis=1)
            own = np.sqrt(far[here, nearest])
            if far.shape[1] > 1:
                far[here, nearest] = np.iinfo(np.int64).max
                second = np.sqrt(far.min(axis=1))
                # Rounding may only make a key expire too early.
                key = second - own - 1e-6 - 1e-12 * second + offsets[nearest]
            else:
                key = np.full(len(far), np.inf)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("point"), batch.column("was"), pa.array(nearest.astype(np.int32)), pa.array(key)],
                names=["id", "point", "was", "cluster", "key"],
            )

    schema = StructType([*rows.schema.fields, StructField("cluster", IntegerType()), StructField("key", DoubleType())])
    return rows.mapInArrow(run, schema)


def _part(rows: DataFrame, centroids: np.ndarray, offsets: np.ndarray) -> DataFrame:
    """The scanned rows as a table whose files are ordered by cluster and key."""
    return materialize(_scanned(rows, centroids, offsets).sortWithinPartitions("cluster", "key"), "heap")


def _beyond(offsets: np.ndarray) -> Column:
    """Rows whose key the offset of their cluster hasn't reached."""
    return reduce(Column.__or__, [(F.col("cluster") == c) & (F.col("key") > float(o)) for c, o in enumerate(offsets)])


def _reached(offsets: np.ndarray) -> Column:
    return reduce(Column.__or__, [(F.col("cluster") == c) & (F.col("key") <= float(o)) for c, o in enumerate(offsets)])


def _moved(part: DataFrame, clusters: int, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """What the part's rows add to the sums and counts of the clusters: a row that
    changed its cluster adds to the new one and takes from the old one.

    Each map task gives one row a cluster.  Sums are longs: enough for 2 ** 36
    vectors of the largest integers."""
    to, away = F.struct(F.col("cluster").alias("c"), F.lit(1).alias("sign")), F.struct(F.col("was").alias("c"), F.lit(-1).alias("sign"))
    rows = part.where("was is null or was <> cluster").select("point", F.explode(F.when(F.col("was").isNull(), F.array(to)).otherwise(F.array(to, away))).alias("m"))
    sign = F.col("m.sign").cast("long")
    totals = rows.groupBy("m.c").agg(F.sum(sign).alias("n"), F.array(*[F.sum(sign * F.col("point")[i]) for i in range(dimensions)]).alias("sums")).collect()
    sums, counts = np.zeros((clusters, dimensions), dtype=object), np.zeros(clusters, dtype=object)
    for r in totals:
        sums[r["c"]], counts[r["c"]] = np.array(r["sums"], dtype=object), r["n"]
    return sums, counts


def _shrinkage(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """How much gaps of each cluster may have shrunk, rounded up."""
    move = np.sqrt(((after - before) ** 2).sum(axis=1).astype(np.float64)) * (1 + 1e-12)
    order = np.argsort(-move, kind="stable")
    other = np.full(len(move), move[order[0]])
    other[order[0]] = move[order[1]] if len(move) > 1 else 0.0
    return move + other


def cluster(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS,
            dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """The members (``id``, ``cluster``, ``distance``: squared, to its centroid) and
    the final centroids, after that many rounds of assigning every vector to the
    nearest centroid (ties: the smaller number) and moving the centroids to the
    floor of their vectors' mean (one without vectors stays), and one more assignment.

    Vectors that are null, of another length or hold null or non-finite
    components aren't returned.  Rows that repeat an id or a vector are rows of
    their own; a null id is kept.  Fewer vectors than clusters: each starts one.
    An empty table gives no rows and no centroids.  Other columns are not read."""
    points = integer_points(vectors, id_col=id_col, vector_col=vector_col, dimensions=dimensions, scale=scale).withColumn("was", F.lit(None).cast("int"))
    centroids = first_centroids(points, clusters, seed)
    if not len(centroids):
        return points.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), centroids
    k = len(centroids)
    offsets = np.zeros(k)
    parts = [_part(points, centroids, offsets)]
    sums, counts = _moved(parts[0], k, dimensions)
    for _ in range(rounds):
        before, moved = offsets, centroids.copy()
        for c in np.flatnonzero(counts > 0):
            moved[c] = sums[c] // counts[c]
        offsets = offsets + _shrinkage(centroids, moved)
        centroids = moved
        # A part's keys up to the last offset were popped before; the newest part wasn't popped yet.
        popped = [p.where(_reached(offsets)) for p in parts[-1:]] + [p.where(_reached(offsets) & _beyond(before)) for p in parts[:-1]]
        again = reduce(DataFrame.unionAll, [p.select("id", "point", F.col("cluster").alias("was")) for p in popped])
        parts.append(_part(again, centroids, offsets))
        more, change = _moved(parts[-1], k, dimensions)
        sums, counts = sums + more, counts + change

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, c = _matrix(batch.column("point")), batch.column("cluster").to_numpy()
            far = ((x - centroids[c]) ** 2).sum(axis=1) if len(c) else np.array([], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("cluster"), pa.array(far)], names=["id", "cluster", "distance"])

    # The rows that no later round popped.
    left = reduce(DataFrame.unionAll, [p.where(_beyond(offsets)) for p in parts[:-1]] + [parts[-1]])
    schema = StructType([points.schema["id"], StructField("cluster", IntegerType()), StructField("distance", LongType())])
    return left.select("id", "point", "cluster").mapInArrow(measure, schema), centroids


def clustered(vectors: DataFrame, *, id_col: str = "vec_id", **options) -> DataFrame:
    """Every clustered vector's id, ``cluster``, ``distance``, ``cluster_inertia``
    and ``inertia`` (distances summed over its cluster and over all) and
    ``centroid_sha256`` (of the centroid's components in decimal, comma-joined)."""
    members, centroids = cluster(vectors, id_col=id_col, **options)
    members = materialize(members, "members")
    inertia = {r["cluster"]: r["inertia"] for r in members.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    about = [(c, total, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, total in sorted(inertia.items())]
    # One row a cluster: a bounded broadcast.
    about = members.sparkSession.createDataFrame(about, "_cluster int, cluster_inertia long, centroid_sha256 string")
    joined = members.join(F.broadcast(about), F.col("cluster") == F.col("_cluster"))
    return joined.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", F.lit(sum(inertia.values())).cast("long").alias("inertia"), "centroid_sha256")


def _oracle() -> str:
    """The rounds written out, every vector against every centroid."""
    near = lambda c: f"""SELECT i, arg_min(c, struct_pack(d := d, c := c)) AS c, min(d) AS d FROM (
    SELECT p.i, k.c, list_sum(list_transform(list_zip(p.v, k.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p, {c} k) GROUP BY i"""  # noqa: E731
    steps = [f"""p AS MATERIALIZED (
  SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""", f"""k0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')), vec_id NULLS FIRST, v) - 1 AS c, v FROM p QUALIFY c < {CLUSTERS}
)"""]
    for r in range(ROUNDS):
        steps.append(f"a{r} AS MATERIALIZED ({near(f'k{r}')})")
        steps.append(f"""k{r + 1} AS MATERIALIZED (
  SELECT k{r}.c, coalesce(m.v, k{r}.v) AS v FROM k{r} LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS v FROM (
      SELECT c, pos, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT a.c, unnest(p.v) AS x, generate_subscripts(p.v, 1) AS pos FROM a{r} a JOIN p USING (i)) GROUP BY c, pos
    ) GROUP BY c
  ) m ON k{r}.c = m.c
)""")
    steps.append(f"a{ROUNDS} AS MATERIALIZED ({near(f'k{ROUNDS}')})")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, a.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(k.v, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN p USING (i) JOIN k{ROUNDS} k ON a.c = k.c
"""


#: What ``clustered`` gives over the test tables, for DuckDB.
ORACLE = _oracle()
