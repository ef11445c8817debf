"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (id, component_id) for every id in an edge; component_id is the smallest id reachable.

    Each round points every node's larger neighbours at its smallest neighbour, then does the
    same downwards, so paths halve and the table ends as stars around the smallest ids. Edges
    with a null end and loops are ignored; an empty table gives an empty result. Rounds are
    written to the shared folder, so the plan stays short.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    e = materialise(e, "edges")
    state = _state(e)
    while state[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = small.union(low.select("u", F.col("m").alias("v"))).where("u <> v")
        old, e = e, materialise(new.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        discard(old)
        now = _state(e)
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(e.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
