"""Centroid clustering in exact whole numbers, with Hamerly's bounds.

Every vector keeps, from round to round, its cluster, an upper bound on the distance to its centroid and a lower bound on the
distance to any other. Centroids drift from one round to the next, and the bounds are loosened by as much. A vector whose
upper bound stays below its lower bound, or below half of the way from its centroid to the nearest other one, keeps its
cluster unseen; all others are held against every centroid in whole numbers. Bounds are floating-point numbers and only choose
whom to look at: they are widened by more than rounding could take, so no assignment depends on rounding.

A round is one pass over the vectors without a shuffle. Rows and bounds go from one table of the shared folder to another and
back, so a lost executor costs the tasks it ran. What the driver gets a round is a sum for each centroid and component.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from docveil.llm.common import shared_dir, table

#: Whole numbers a component is scaled to lie within -LARGEST and LARGEST: squared distances of 64 such fit a long.
LARGEST = 1 << 27
#: Bounds are widened by this much of themselves; rounding of a 64-bit square root is below 2 ** -51 of it.
SLACK = 1e-12
#: Vectors compared with centroids at a time.
ROWS = 1 << 14


def scaled(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) by component, as whole numbers."""
    return np.clip(np.floor(x.astype(np.float64) * scale), -LARGEST, LARGEST).astype(np.int32)


def squared(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    apart = vectors.astype(np.int64) - centroid
    return np.einsum("ij,ij->i", apart, apart)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of and squared distance to the nearest centroid (of equals, the first), and the squared distance to the nearest
    other one (the largest long if there is none)."""
    n = len(vectors)
    best, first, second = np.zeros(n, np.int32), np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).max)
    for k, c in enumerate(centroids):
        d = squared(vectors, c)
        closer = d < first
        second = np.where(closer, first, np.minimum(second, d))
        best[closer], first = k, np.minimum(first, d)
    return best, first, second


class Bounds:
    """What is known of a round's centroids: where they are, how far each has drifted, how far the nearest other one is."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None) -> None:
        k = len(centroids)
        self.centroids = centroids
        self.first = before is None
        self.drift = np.zeros(k) if before is None else np.sqrt(squared(centroids, before).astype(float)) * (1 + SLACK)
        others = self.drift[None, :] * (1 - np.eye(k))
        self.others_drift = others.max(axis=1, initial=0.0)
        apart = np.stack([np.sqrt(squared(centroids, c).astype(float)) for c in centroids]) * (1 - SLACK)
        np.fill_diagonal(apart, np.inf)
        self.half = apart.min(axis=1) / 2

    def loosened(self, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bounds after the drift, and which vectors may have to move."""
        upper = (upper + self.drift[cluster]) * (1 + SLACK)
        lower = np.maximum(0.0, lower - self.others_drift[cluster]) * (1 - SLACK)
        return upper, lower, upper >= np.maximum(lower, self.half[cluster])

    def assigned(self, vectors: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """cluster, upper, lower, and how many vectors were held against every centroid."""
        if self.first:
            unsure = np.ones(len(vectors), bool)
            cluster, upper, lower = np.zeros(len(vectors), np.int32), np.zeros(len(vectors)), np.zeros(len(vectors))
        else:
            upper, lower, unsure = self.loosened(cluster, upper, lower)
        at = np.flatnonzero(unsure)
        cluster = cluster.copy()
        for i in range(0, len(at), ROWS):
            some = at[i : i + ROWS]
            best, first, second = nearest(vectors[some], self.centroids)
            cluster[some] = best
            upper[some] = np.sqrt(first.astype(float)) * (1 + SLACK)
            lower[some] = np.sqrt(second.astype(float)) * (1 - SLACK)
        return cluster, upper, lower, len(at)


def _matrix(column: pa.Array, components: int) -> np.ndarray:
    """A binary column of equally long values as a matrix of 32-bit whole numbers."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(np.int32).reshape(len(column), components) if len(column) else np.zeros((0, components), np.int32)


def _pass(bounds: Bounds):
    """Assigns vectors, and sends after a task's rows one with what its clusters gain: counts and sums of the vectors that came,
    less those of the vectors that left, and how many vectors were looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, d = bounds.centroids.shape
        sums, schema = np.zeros((k, d + 2), np.int64), None
        for batch in batches:
            vectors, was = _matrix(batch.column(1), d), batch.column(2).to_numpy()
            schema = batch.schema
            cluster, upper, lower, looked = bounds.assigned(vectors, was, batch.column(3).to_numpy(), batch.column(4).to_numpy())
            moved = np.flatnonzero((cluster != was) | bounds.first)
            for sign, of in ((1, cluster), (-1, was)):
                for c in np.unique(of[moved]):
                    if c >= 0:
                        some = moved[of[moved] == c]
                        sums[c, 0] += sign * len(some)
                        sums[c, 1:-1] += sign * vectors[some].sum(axis=0, dtype=np.int64)
            sums[0, -1] += looked
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster), pa.array(upper), pa.array(lower), pa.nulls(len(cluster), pa.binary())], schema=schema)
        if schema is not None:
            columns = [pa.nulls(1, schema.field(i).type) for i in range(5)] + [pa.array([sums.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _gains(state: DataFrame, k: int, d: int) -> np.ndarray:
    """The sums of all tasks. Only their rows, and only that column, are read."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sums in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * (d + 2), dtype=np.int32)), pa.array(np.frombuffer(sums, np.int64))], names=["cell", "n"])

    got = state.where("sums IS NOT NULL").select("sums").mapInArrow(cells, "cell int, n bigint").groupBy("cell").agg(F.sum(F.col("n").cast("decimal(28,0)")).alias("n")).collect()
    out = np.zeros(k * (d + 2), dtype=object)
    for r in got:
        out[r["cell"]] = int(r["n"])
    return out.reshape(k, d + 2)


def usable(vector: Column, components: int) -> Column:
    """Exactly so many components, none null or non-finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) == components) & fine, F.lit(False))


def cluster(df: DataFrame, keys: tuple[str, ...] = ("vec_id",), vector: str = "embedding", k: int = 8, components: int = 64, scale: int = 1024, rounds: int = 10, seed: str = "3", log: list | None = None) -> DataFrame:
    """keys, cluster, distance, cluster_inertia, inertia, centroid (its components) of every usable vector.

    Starts from the k vectors with the smallest hashes of seed and first key; of equal hashes (repeated keys), the vector with
    smaller components comes first, and a null key counts as empty text. With fewer vectors than k, there are as many
    clusters; without any, no row. A vector that is null, has another length, or a null or non-finite component has no row.
    Repeated rows are vectors of their own. Components beyond LARGEST after scaling count as LARGEST, since their squared
    distances would not fit a long. Other columns are not looked at. Rounds end early once no centroid moves any more, as
    all further ones would be the same. `log` gets, for every round, how many vectors were held against all centroids.
    """
    spark = df.sparkSession
    if clash := {"cluster", "distance", "cluster_inertia", "inertia", "centroid"}.intersection(keys):
        raise ValueError(f"keys named like results: {sorted(clash)}")
    rows = df.where(usable(F.col(vector), components)).select(F.struct(*keys).alias("key"), F.col(vector).cast("array<double>").alias("x"))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"key.{keys[0]}").cast("string"), F.lit("")))
    first = rows.orderBy(F.sha2(name, 256), "x").limit(k).select("x").collect()
    centroids = scaled(np.array([r["x"] for r in first], dtype=np.float64).reshape(len(first), components), scale).astype(np.int64)
    if not len(centroids):
        none = {c: F.lit(0).cast("long") for c in ("distance", "cluster_inertia", "inertia")}
        return rows.where("false").select("key.*").withColumns({"cluster": F.lit(0), **none, "centroid": F.array().cast("array<long>")})

    def prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            v = scaled(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, components), scale)
            blob = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(4 * components)), pa.py_buffer(v.tobytes())])
            columns = [batch.column(0), blob, pa.array(np.full(n, -1, np.int32)), pa.array(np.zeros(n)), pa.array(np.zeros(n)), pa.nulls(n, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "v", "cluster", "upper", "lower", "sums"])

    own = StructField("key", rows.schema["key"].dataType)
    kinds = StructType([own, *StructType.fromDDL("v binary, cluster int, upper double, lower double, sums binary").fields])
    state = rows.mapInArrow(prepared, kinds)
    base, sums, before = f"{shared_dir(spark)}/hamerly-{uuid.uuid4().hex}", np.zeros((len(centroids), components + 1), dtype=object), None
    for turn in range(rounds + 1):
        # two tables in turn: the one before last is written over
        path = f"{base}-{turn % 2}"
        state.mapInArrow(_pass(Bounds(centroids, before)), kinds).write.mode("overwrite").parquet(path, compression="zstd")
        written = spark.read.schema(kinds).parquet(path)
        gains = _gains(written, *centroids.shape)
        state = written.where("sums IS NULL")
        if log is not None:
            log.append(gains[0, -1])
        sums = sums + gains[:, :-1]
        before = centroids
        if turn < rounds:
            now = [[s // n for s in added] if n else list(c) for (n, *added), c in zip(sums.tolist(), centroids)]
            centroids = np.array(now, dtype=np.int64)
            if (centroids == before).all():
                break
    # where rounds ended early, a last assignment would be the same; each vector's cluster is that of the centroids it was held against
    final = before

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column(2).to_numpy()
            v = _matrix(batch.column(1), components)
            parts = [squared(v[i : i + ROWS], final[of[i : i + ROWS]]) for i in range(0, len(of), ROWS)]
            d = np.concatenate([np.zeros(0, np.int64), *parts])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(d)], names=["key", "cluster", "distance"])

    told = state.select("key", "v", "cluster").mapInArrow(distances, StructType([own, *StructType.fromDDL("cluster int, distance bigint").fields]))
    totals = {r["cluster"]: int(r["d"]) for r in told.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(28,0)")).alias("d")).collect()}
    per = [(c, totals.get(c, 0), sum(totals.values()), [int(x) for x in v]) for c, v in enumerate(final)]
    per = spark.createDataFrame(per, "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    return told.join(F.broadcast(per), "cluster").select("key.*", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def op11(spark, sf_dir: str) -> DataFrame:
    out = cluster(table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def _sql(k: int = 8, d: int = 64, rounds: int = 10) -> str:
    """The same by its definition, every distance in every round."""
    parts = [
        f"r AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings WHERE len(embedding) = {d} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {d})",
        f"v AS MATERIALIZED (SELECT rid, i, floor(1024 * x::DOUBLE)::BIGINT AS x FROM (SELECT rid, unnest(range({d})) AS i, unnest(embedding) AS x FROM r))",
        f"s AS (SELECT rid, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k FROM r), c0 AS MATERIALIZED (SELECT k, i, x FROM v JOIN s USING (rid) WHERE k < {k})",
    ]
    for t in range(rounds + 1):
        far = f"SELECT rid, k, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d FROM v JOIN c{t} c USING (i) GROUP BY ALL"
        parts.append(f"a{t} AS MATERIALIZED (SELECT rid, k, d FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY d, k) AS n FROM ({far})) WHERE n = 1)")
        mean = "SELECT k, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x FROM v JOIN a{t} USING (rid) GROUP BY ALL".format(t=t)
        parts.append(f"c{t + 1} AS MATERIALIZED (SELECT k, i, coalesce(m.x, c.x) AS x FROM c{t} c LEFT JOIN ({mean}) m USING (k, i))")
    return f"""WITH {", ".join(parts)},
    h AS (SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k),
    n AS (SELECT k, sum(d)::BIGINT AS own FROM a{rounds} GROUP BY k)
    SELECT vec_id, k::INT AS cluster, d AS distance, own AS cluster_inertia, (SELECT sum(own)::BIGINT FROM n) AS inertia, centroid_sha256
    FROM a{rounds} JOIN r USING (rid) JOIN n USING (k) JOIN h USING (k)"""


SQL = _sql()
