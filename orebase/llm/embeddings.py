"""Near-duplicate vectors by tiled comparison of PCA-ordered coordinates.

All vectors are turned by one orthogonal matrix that puts the directions of most variance
first. A pair's cosine is the product over the leading coordinates plus the rest, and the rest
is at most the product of the two suffix norms. Tiles are compared over a few leading
coordinates; only pairs whose bound reaches the threshold go on to the next block of
coordinates, and what is left is decided on the vectors themselves in double precision.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, only
from .components import components

#: Vectors that the turn is fitted on: any orthogonal matrix gives right results, a fitted one stops earlier.
SAMPLE = 20_000
#: Vectors in a tile, and in the numpy step within a pair of tiles.
TILE, STEP = 6144, 1024


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (id, v) that can be compared: v not null or zero, its components finite and not null."""
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ok)


def leading_axes(vectors: DataFrame) -> np.ndarray:
    """Orthogonal matrix, directions of most variance first, of a sample by a hash of the id."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toPandas()["v"]  # bounded
    x = np.stack(rows.to_list()).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return np.linalg.eigh(x.T @ x)[1][:, ::-1]


class Tile:
    def __init__(self, vectors: np.ndarray, axes: np.ndarray, cuts: tuple[int, ...]):
        self.unit = vectors / np.abs(vectors).max(1, keepdims=True)  # keeps squares within double's range
        self.unit /= np.sqrt((self.unit**2).sum(1, keepdims=True))
        turned = self.unit @ axes
        rest = np.sqrt(np.maximum(np.cumsum(turned[:, ::-1] ** 2, 1)[:, ::-1], 0))
        self.turned = turned
        self.rest = np.concatenate([rest, np.zeros((len(rest), 1))], 1)
        # The suffix norm as one more coordinate makes the bound a single matrix product.
        self.head = np.concatenate([turned[:, : cuts[0]], self.rest[:, cuts[0], None]], 1).astype(np.float32)


def links(one: Tile, two: Tile, threshold: float, cuts: tuple[int, ...], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with cosine >= threshold; the bounds have room for rounding, the decision is in double precision."""
    first, second = [], []
    for a in range(0, len(one.unit), STEP):
        for b in range(a if same else 0, len(two.unit), STEP):
            bound = one.head[a : a + STEP] @ two.head[b : b + STEP].T
            i, j = np.divmod(np.flatnonzero(bound.ravel() >= threshold - 1e-4), bound.shape[1])
            i, j = i + a, j + b
            if same and a == b:
                i, j = i[i < j], j[i < j]
            for s in range(0, len(i), 65536):
                x, y = i[s : s + 65536], j[s : s + 65536]
                so_far = np.einsum("ij,ij->i", one.turned[x, : cuts[0]], two.turned[y, : cuts[0]])
                for low, high in zip(cuts, cuts[1:]):
                    so_far = so_far + np.einsum("ij,ij->i", one.turned[x, low:high], two.turned[y, low:high])
                    open_ = so_far + one.rest[x, high] * two.rest[y, high] >= threshold - 1e-9
                    x, y, so_far = x[open_], y[open_], so_far[open_]
                good = np.einsum("ij,ij->i", one.unit[x], two.unit[y]) >= threshold
                first.append(x[good])
                second.append(y[good])
    return (np.concatenate(first), np.concatenate(second)) if first else (np.zeros(0, int), np.zeros(0, int))


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Enough of the links (a, b) to connect what all of them connect."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = top(x), top(y)
        if p != q:
            up[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


def _comparison(axes: np.ndarray, cuts: tuple[int, ...], threshold: float):
    """What is done with a pair of tiles: rows (row, id, n, None) with numbers of links and (row, id, 0, other) with edges."""

    def compare(table):
        t = table["t"].to_numpy()
        ids, row = table["id"].to_numpy(), table["row"].to_numpy()
        values = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1).astype(float)
        low = np.flatnonzero(t == table["lo"][0].as_py())
        high = np.flatnonzero(t == table["hi"][0].as_py())
        same = table["lo"][0].as_py() == table["hi"][0].as_py()
        one = Tile(values[low], axes, cuts)
        two = one if same else Tile(values[high], axes, cuts)
        a, b = links(one, two, threshold, cuts, same)
        a, b = low[a], high[b]
        counts = np.bincount(a, minlength=len(t)) + np.bincount(b, minlength=len(t))
        some = np.flatnonzero(counts)
        edges = forest(a, b)
        e = np.array(edges, np.int64).reshape(-1, 2)
        kinds = np.concatenate([row[some], row[e[:, 0]]]), np.concatenate([ids[some], ids[e[:, 0]]]), np.concatenate([counts[some], np.zeros(len(e), np.int64)])
        other = np.ma.concatenate([np.ma.masked_all(len(some), np.int64), np.ma.array(ids[e[:, 1]], dtype=np.int64)])
        return pa.table({"row": pa.array(kinds[0], pa.int64()), "id": pa.array(kinds[1], pa.int64()), "n": pa.array(kinds[2], pa.int64()), "other": pa.array(other.filled(0), pa.int64(), mask=np.ma.getmaskarray(other))})

    return compare


def near_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", lead: tuple[int, ...] = (16, 32), tile: int = TILE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors with a cosine of at least threshold are linked. Null and zero vectors, those that
    hold null or non-finite components, and rows with a null id are linked with nothing; vectors of
    different lengths are compared only within their length. Rows that repeat an id are each
    compared, so links to them count each, and share a component. Other columns are ignored; an
    empty table gives an empty result.

    Vectors are dealt into tiles by a hash; each pair of tiles is one group of bounded size. What
    leaves it are numbers of links per vector and the edges of a spanning forest, never all links
    of a dense group.
    """
    rows = only(vectors, id=id_col, v=vector_col)
    rows = materialise(rows.select("id", F.monotonically_increasing_id().alias("row"), F.col("v").cast("array<double>").alias("v")), "vectors")
    good = usable(rows).withColumn("dims", F.size("v"))
    sizes = {r.dims: r["count"] for r in good.groupBy("dims").count().collect()}  # one row per length of vector
    found = None
    for dims, count in sorted(sizes.items()):
        part = good.where(F.col("dims") == dims)
        axes = leading_axes(part)
        cuts = (*[c for c in lead if c < dims], dims)
        tiles = max(1, -(-count // tile))
        dealt = part.withColumn("t", F.pmod(F.xxhash64("row"), F.lit(tiles)).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
        dealt = dealt.select(F.least("t", "o").alias("lo"), F.greatest("t", "o").alias("hi"), "t", "id", "row", F.col("v").cast("array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>").alias("v"))

        out = dealt.groupBy("lo", "hi").applyInArrow(_comparison(axes, cuts, threshold), "row bigint, id bigint, n bigint, other bigint")
        found = out if found is None else found.union(out)
    if found is None:
        return rows.select(F.col("id").alias("vec_id"), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = materialise(found, "vector_links")
    joined = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("row").agg(F.sum("n").alias("n_links"))
    out = rows.select("id", "row").join(counts, "row", "left").join(joined, "id", "left")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce(F.coalesce("component_id", "id") == F.col("id"), F.lit(True)).alias("kept"))
