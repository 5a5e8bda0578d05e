"""Exact centroid clustering of integer vectors by bit-plane popcounts.

A vector of 64 integers is kept as one 64-bit word per bit of two's complement: word b holds bit b of every component.
The dot product of two vectors is the sum over pairs of words of popcount(word & word), weighted by the two bits'
values (the top bit's is negative), so distances are exact integers; words of a vector and its squared length are all
that a round reads. Each round is one pass: tasks add up their vectors per cluster, Spark adds the tasks' sums, and
clusters x 65 numbers reach the driver, which takes the floors and packs the next centroids. Nothing else is gathered.

Cases: a vector is kept if it has exactly 64 components, none null, NaN or infinite; others (null vectors too) have
no row. Ties between centroids go to the smaller number, ties between starting vectors (repeated rows) to the least
words. Repeated rows count each; a null id is clustered as any other and starts no cluster before those with an id.
With fewer vectors than clusters there are as many clusters as vectors; an empty table gives an empty result. Extra
columns, whatever their names, are not carried on. Components are limited to 2**19 in size, so that every
squared distance is a long: beyond that it is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabletwin.llm.store import map_arrow, written

WIDTH = 64
SCALE = 256
LARGEST = 1 << 27
BLOCK = 4096


def pack(v: np.ndarray) -> np.ndarray:
    """(n, 64) integers -> (n, bits) words; bits suffices for the largest of them in two's complement."""
    bits = int(np.abs(v + (v < 0)).max(initial=0)).bit_length() + 1
    out = np.empty((len(v), bits), "<u8")
    for b in range(bits):
        out[:, b] = np.packbits((v >> b & 1).astype(np.uint8), axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def values(bits: int) -> list[int]:
    """What each bit of two's complement stands for."""
    return [1 << b for b in range(bits - 1)] + [-(1 << bits - 1)]


def unpack(planes: np.ndarray) -> np.ndarray:
    n, bits = planes.shape
    each = np.unpackbits(np.ascontiguousarray(planes).view(np.uint8).reshape(n, bits, 8), axis=2, bitorder="little")
    out = np.zeros((n, WIDTH), np.int64)
    for b, w in enumerate(values(bits)):
        out += each[:, b].astype(np.int64) * w
    return out


def dots(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Dot products of all pairs of packed vectors: counts of equal weight are added before they are weighted."""
    p, q = x.shape[1], c.shape[1]
    total = np.zeros((len(x), len(c)), np.int64)
    for s in range(p + q - 1):
        count = np.zeros(total.shape, np.int16)
        for i in range(max(0, s - q + 1), min(p, s + 1)):
            both = np.bitwise_count(x[:, i, None] & c[None, :, s - i])
            if (i == p - 1) == (s - i == q - 1):
                count += both
            else:
                count -= both
        total += count.astype(np.int64) << s
    return total


def nearest(x: np.ndarray, norm: np.ndarray, centroids: np.ndarray, planes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each packed vector."""
    d = norm[:, None] - 2 * dots(x, planes) + (centroids * centroids).sum(1)[None, :]
    at = d.argmin(1)
    return at, d[np.arange(len(x)), at]


def _blocks(batch: pa.RecordBatch):
    """(row numbers, words, squared lengths) of a batch's vectors, by number of words and in blocks."""
    words, norm = batch.column(batch.schema.get_field_index("planes")), batch.column(batch.schema.get_field_index("norm")).to_numpy()
    bits = pc.binary_length(words).to_numpy() // 8
    for b in np.unique(bits):
        rows = np.flatnonzero(bits == b)
        for lo in range(0, len(rows), BLOCK):
            part = rows[lo:lo + BLOCK]
            data = b"".join(words.take(pa.array(part)).to_pylist())
            yield part, np.frombuffer(data, "<u8").reshape(-1, b), norm[part]


def packed(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, norm long, planes binary) of every kept vector: components floor(256 x), as bit planes."""
    x = F.col("_x")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.select(vectors[key].alias("_key"), vectors[column].cast("array<double>").alias("_x")).where((F.size(x) == WIDTH) & fine)
    schema = T.StructType([vectors.schema[key], T.StructField("norm", T.LongType()), T.StructField("planes", T.BinaryType())])

    def work(batches):
        for batch in batches:
            whole = np.asarray(pc.list_flatten(batch.column(1))).astype(np.float64).reshape(-1, WIDTH)
            for lo in range(0, len(whole), BLOCK):
                v = np.floor(whole[lo:lo + BLOCK] * SCALE)
                if np.abs(v).max(initial=0) >= LARGEST:
                    raise ValueError("a component is too large for squared distances in 64 bits")
                v = v.astype(np.int64)
                planes = pack(v)
                raw = np.ascontiguousarray(planes).tobytes()
                step = planes.shape[1] * 8
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, BLOCK), pa.array((v * v).sum(1)), pa.array([raw[i:i + step] for i in range(0, len(raw), step)], pa.binary())], [key, "norm", "planes"])

    return map_arrow(rows, work, schema)


def starts(table: DataFrame, clusters: int, salt: str, key: str = "vec_id") -> np.ndarray:
    """The vectors of least sha256 of salt and id (a bounded top-k, at most ``clusters`` rows)."""
    code = F.coalesce(F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")), 256), F.lit("~"))
    rows = table.select(code.alias("code"), "planes").orderBy("code", "planes").limit(clusters).collect()
    return np.array([unpack(np.frombuffer(bytes(r.planes), "<u8").reshape(1, -1))[0] for r in rows], np.int64).reshape(-1, WIDTH)


def moved(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: the floors of the means of the vectors nearest to each centroid; empty clusters stay."""
    planes = pack(centroids)

    def work(batches):
        count, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), WIDTH), np.int64)
        for batch in batches:
            for _, x, norm in _blocks(batch):
                at, _ = nearest(x, norm, centroids, planes)
                order = np.argsort(at, kind="stable")
                found, first = np.unique(at[order], return_index=True)
                count += np.bincount(at, minlength=len(centroids))
                total[found] += np.add.reduceat(unpack(x)[order], first)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some], pa.int64()), pa.array(total[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    sums = map_arrow(table.select("norm", "planes"), work, "cluster int, n long, total array<long>")
    exact = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"t{i}") for i in range(WIDTH)]
    out = centroids.copy()
    for r in sums.groupBy("cluster").agg(F.sum("n").alias("n"), *exact).collect():
        out[r.cluster] = [int(r[f"t{i}"]) // r.n for i in range(WIDTH)]
    return out


def assigned(table: DataFrame, centroids: np.ndarray, key: str = "vec_id") -> DataFrame:
    """(key, cluster int, distance long) of every packed vector."""
    planes = pack(centroids)
    schema = T.StructType([table.schema[key], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def work(batches):
        for batch in batches:
            cluster, distance = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for rows, x, norm in _blocks(batch):
                cluster[rows], distance[rows] = nearest(x, norm, centroids, planes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster), pa.array(distance)], [key, "cluster", "distance"])

    return map_arrow(table.select(key, "norm", "planes"), work, schema)


def cluster(vectors: DataFrame, clusters: int, rounds: int, salt: str, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>) of every kept vector."""
    spark = vectors.sparkSession
    table = written(packed(vectors, key, column), "planes")
    centroids = starts(table, clusters, salt, key)
    for _ in range(rounds if len(centroids) else 0):
        new = moved(table, centroids)
        settled, centroids = np.array_equal(new, centroids), new
        if settled:
            break  # further rounds would change nothing
    rows = written(assigned(table, centroids, key), "clusters") if len(centroids) else assigned(table.limit(0), np.zeros((1, WIDTH), np.int64), key)
    per = {r.cluster: int(r.d) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    info = [(k, per.get(k, 0), sum(per.values()), [int(x) for x in c]) for k, c in enumerate(centroids)]
    side = spark.createDataFrame(info, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return rows.join(F.broadcast(side), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def cluster_sql(clusters: int = 40, rounds: int = 5, salt: str = "2:") -> str:
    """The same clustering in DuckDB SQL: one step per round over all pairs of vector and centroid."""
    parts = [
        "kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings "
        "WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = 64)",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{salt}' || vec_id)) - 1 AS INTEGER) AS cluster, v AS c FROM kept ORDER BY sha256('{salt}' || vec_id) LIMIT {clusters})",
    ]
    for r in range(rounds + 1):
        square = "CAST(list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS BIGINT)"
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, v, cluster, d FROM (SELECT vec_id, v, cluster, {square} AS d FROM kept CROSS JOIN c{r}) "
                     "QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) = 1)")
        if r < rounds:
            mean = ", ".join(f"CAST(floor(CAST(sum(v[{i}]) AS DOUBLE) / count(*)) AS BIGINT)" for i in range(1, 65))
            parts.append(f"m{r} AS MATERIALIZED (SELECT cluster, [{mean}] AS c FROM a{r} GROUP BY cluster)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT o.cluster, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN m{r} m ON o.cluster = m.cluster)")
    return (f"WITH {', '.join(parts)} SELECT vec_id, a.cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, "
            f"CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} k ON a.cluster = k.cluster")
