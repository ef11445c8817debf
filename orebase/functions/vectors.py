"""Distances of vectors and exact nearest neighbours. Sums are taken in double precision."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def _zipped(a: Column, b: Column, f) -> Column:
    same = F.when(F.size(a) == F.size(b), a).otherwise(F.raise_error(F.lit("vectors differ in length")))
    return _sum(F.zip_with(same.cast("array<double>"), b.cast("array<double>"), f))


def l1(a: Column, b: Column) -> Column:
    return _zipped(a, b, lambda x, y: F.abs(x - y))


def inner_product(a: Column, b: Column) -> Column:
    """The negated product, so that nearer is smaller."""
    return -_zipped(a, b, lambda x, y: x * y)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_zipped(a, b, lambda x, y: (x - y) * (x - y)))


def cosine(a: Column, b: Column) -> Column:
    """1 minus the cosine; 1 if either vector is zero."""
    norms = F.sqrt(_zipped(a, a, lambda x, y: x * y) * _zipped(b, b, lambda x, y: x * y))
    return F.when(norms == 0, F.lit(1.0)).otherwise(1 + inner_product(a, b) / norms)


DISTANCES = {"l1": l1, "l2": l2, "inner_product": inner_product, "cosine": cosine}


#: Bytes of query vectors that every task holds at a time.
QUERY_BYTES = 32 << 20


def by_name(name: str):
    """The distance of a stored name."""
    if name not in DISTANCES:
        raise ValueError(f"unknown distance {name}: one of {', '.join(DISTANCES)}")
    return DISTANCES[name]


def nearest(rows: DataFrame, vector: str, query: list[float], k: int, distance: str = "l2", id_col: str = "id") -> DataFrame:
    """The k nearest rows with their distance; ids break ties."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.withColumn("distance", by_name(distance)(F.col(vector), q)).orderBy("distance", id_col).limit(k)


def _matrix(distance: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of all rows of q (first axis) and x."""
    if distance == "l1":
        return np.stack([np.abs(x - one).sum(1) for one in q])
    if distance == "l2":
        return np.stack([np.sqrt(((x - one) ** 2).sum(1)) for one in q])
    products = q @ x.T
    if distance == "inner_product":
        return -products
    norms = np.sqrt((q**2).sum(1)[:, None] * (x**2).sum(1)[None, :])
    return np.where(norms == 0, 1.0, 1 - products / np.where(norms == 0, 1, norms))


def nearest_batch(rows: DataFrame, vector: str, queries: DataFrame, k: int, distance: str = "l2", id_col: str = "id", digits: int = 12) -> DataFrame:
    """(qid, rank, id, distance) of each query's k nearest rows; queries: (qid, q).

    Distances count to `digits` decimals, ids break ties. Queries are a stated set, met by all rows in blocks of QUERY_BYTES;
    rows stay where they are, and a task gives k rows a query and batch at most. Null vectors are left out.
    """
    by_name(distance)
    queries = queries.where("q is not null")
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("dims")).first()
    blocks = max(1, -(-size.n * 8 * (size.dims or 1) // QUERY_BYTES))
    data = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    found = None
    for block in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block).select(F.col("qid").cast("bigint").alias("qid"), F.col("q").cast("array<double>").alias("q")).toArrow()  # bounded by QUERY_BYTES
        names = part["qid"].to_numpy()
        box = rows.sparkSession.sparkContext.broadcast((names, np.array(part["q"].to_pylist(), float).reshape(len(names), -1)))

        def run(batches, box=box):
            names, q = box.value
            for batch in batches:
                ids, flat = batch.column(0).to_numpy(), batch.column(1)
                if not len(ids) or not len(names):
                    continue
                if set(np.diff(np.asarray(flat.offsets)).tolist()) != {q.shape[1]}:
                    raise ValueError("vectors differ in length")
                x = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                for a in range(0, len(names), 256):
                    d = np.round(_matrix(distance, x, q[a : a + 256]), digits) + 0.0
                    best = np.lexsort((np.broadcast_to(ids, d.shape), d))[:, :k]
                    at = np.repeat(np.arange(len(d)), best.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(names[a + at]), pa.array(ids[best.ravel()]), pa.array(d[at, best.ravel()])], ["qid", "id", "distance"])

        own = data.mapInArrow(run, "qid bigint, id bigint, distance double")
        found = own if found is None else found.union(own)
    rank = Window.partitionBy("qid").orderBy("distance", "id")
    return found.select("qid", F.row_number().over(rank).alias("rank"), "id", "distance").where(F.col("rank") <= k)


def centroid(rows: DataFrame, vector: str, by: str) -> DataFrame:
    """(by, pos, value): the mean vector of each group, place by place."""
    return rows.select(by, F.posexplode(vector).alias("pos", "x")).groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("value"))
