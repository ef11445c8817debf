"""References, their inverses, and bounded walks over a graph of objects."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class NotTracked(ValueError):
    """An inverse read over a reference that does not track its inverse."""


def follow(rows: DataFrame, ref: str, target: DataFrame, target_id: str, required: bool = False) -> DataFrame:
    """rows with the columns of the object that ref points at; without one they are null, or the row goes if required."""
    return rows.join(target, rows[ref] == target[target_id], "inner" if required else "left")


def follow_many(rows: DataFrame, refs: str, target: DataFrame, target_id: str) -> DataFrame:
    """One row per element of an array of references, with its place `pos`."""
    out = rows.select("*", F.posexplode(refs).alias("pos", "__ref"))
    return out.join(target, F.col("__ref") == target[target_id]).drop("__ref")


def inverse(target: DataFrame, target_id: str, rows: DataFrame, ref: str, tracked: bool = True) -> DataFrame:
    """(target_id, columns of rows) for every row that refers to an object; an array refers once per element."""
    if not tracked:
        raise NotTracked(ref)
    if dict(rows.dtypes)[ref].startswith("array"):
        rows = rows.withColumn("__ref", F.explode(ref))
    else:
        rows = rows.withColumn("__ref", F.col(ref))
    return target.select(target_id).join(rows, F.col(target_id) == F.col("__ref")).drop("__ref")


def inverse_count(target: DataFrame, target_id: str, rows: DataFrame, ref: str) -> DataFrame:
    """(target_id, n), 0 where nothing refers to the object."""
    n = inverse(target, target_id, rows, ref).groupBy(target_id).agg(F.count("*").alias("n"))
    return target.select(target_id).join(n, target_id, "left").select(target_id, F.coalesce("n", F.lit(0)).alias("n"))


def inverse_contains(target: DataFrame, target_id: str, rows: DataFrame, ref: str, row_id: str, pairs: DataFrame) -> DataFrame:
    """Those of pairs (target_id, row_id) of which the row refers to the object."""
    return pairs.join(inverse(target, target_id, rows, ref).select(target_id, row_id).distinct(), [target_id, row_id], "left_semi")


def add_to_inverse(rows: DataFrame, row_id: str, ref: str, pairs: DataFrame) -> DataFrame:
    """rows with the reference of those in pairs (row_id, target) set to target: what adding to an inverse set means."""
    new = pairs.select(F.col(row_id).alias("__row"), F.col("target").alias("__target"))
    out = rows.join(new, rows[row_id] == F.col("__row"), "left")
    return out.select(*[F.when(F.col("__row").isNotNull(), F.col("__target")).otherwise(rows[c]).alias(c) if c == ref else rows[c] for c in rows.columns])


def remove_from_inverse(rows: DataFrame, row_id: str, ref: str, pairs: DataFrame) -> DataFrame:
    """rows with the reference of those in pairs (row_id, target) nulled where it is target."""
    gone = pairs.select(F.col(row_id).alias("__row"), F.col("target").alias("__target"))
    out = rows.join(gone, (rows[row_id] == F.col("__row")) & (rows[ref] == F.col("__target")), "left")
    return out.select(*[F.when(F.col("__row").isNull(), rows[c]).alias(c) if c == ref else rows[c] for c in rows.columns])


def clear_inverse(rows: DataFrame, ref: str, targets: DataFrame, target_id: str) -> DataFrame:
    """rows with references to any of targets nulled."""
    out = rows.join(targets.select(F.col(target_id).alias("__target")).distinct(), rows[ref] == F.col("__target"), "left")
    return out.select(*[F.when(F.col("__target").isNull(), rows[c]).alias(c) if c == ref else rows[c] for c in rows.columns])


def inverse_sets(target: DataFrame, target_id: str, rows: DataFrame, ref: str, fields: list[str], name: str) -> DataFrame:
    """target with the referring rows as an array of structs, empty where there are none."""
    sets = inverse(target, target_id, rows, ref).groupBy(target_id).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    out = target.join(sets, target_id, "left")
    return out.withColumn(name, F.coalesce(name, F.array().cast(out.schema[name].dataType)))


def both_ways(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Links and their reverses, as a bag."""
    return edges.select(F.col(a).alias("a"), F.col(b).alias("b")).union(edges.select(F.col(b).alias("a"), F.col(a).alias("b")))


def reliable(df: DataFrame) -> DataFrame:
    """df cut off from its plan by a checkpoint in the cluster's shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir("file://" + tempfile.gettempdir() + "/orebase-checkpoints")
    return df.checkpoint()


def reach(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(id, hops): ids within `depth` hops over edges (a, b) of the ids in start, without these.

    The set is defined by the shortest way, so it does not depend on the order of edges. Each
    round joins only the newest ids and is checkpointed.
    """
    seen = start.select(F.col(start.columns[0]).alias("id"), F.lit(0).alias("hops")).distinct()
    newest = seen
    for hop in range(1, depth + 1):
        newest = edges.join(newest.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("hops", F.lit(hop))
        newest = reliable(newest)
        if newest.isEmpty():
            break
        seen = seen.union(newest)
    return seen.where("hops > 0")


def reach_through(links: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(id, hops): ids within `depth` hops of start, a hop being from an id to all ids with a common `via` in links (id, via).

    Each round goes to the newest ids' new vias and on to their new ids, so a via with many ids never becomes its pairs.
    """
    seen = start.select(F.col(start.columns[0]).alias("id"), F.lit(0).alias("hops")).distinct()
    newest, passed = seen, None
    for hop in range(1, depth + 1):
        vias = links.join(newest.select("id"), "id", "left_semi").select("via").distinct()
        vias = reliable(vias if passed is None else vias.join(passed, "via", "left_anti"))
        passed = vias if passed is None else passed.union(vias)
        newest = reliable(links.join(vias, "via", "left_semi").select("id").distinct().join(seen, "id", "left_anti").withColumn("hops", F.lit(hop)))
        if newest.isEmpty():
            break
        seen = seen.union(newest)
    return seen.where("hops > 0")


def object_graph(start: dict[str, DataFrame], refs: list[tuple[str, str, str, DataFrame]], depth: int) -> dict[str, DataFrame]:
    """Ids of all objects within `depth` references of start, by class: (id, hops), each object once.

    refs: (class, reference, its target's class, rows (id, reference)). Cycles end, and an object that many refer to is there once,
    so nested shapes keep references as ids into these tables.
    """
    seen = {c: df.select(F.col(df.columns[0]).alias("id"), F.lit(0).alias("hops")).distinct() for c, df in start.items()}
    newest = dict(seen)
    for hop in range(1, depth + 1):
        found: dict[str, DataFrame] = {}
        for name, ref, target, rows in refs:
            if name in newest:
                own = rows.withColumn("__ref", F.explode(ref) if dict(rows.dtypes)[ref].startswith("array") else F.col(ref))
                new = own.join(newest[name].select("id"), "id", "left_semi").where("__ref is not null").select(F.col("__ref").alias("id"))
                found[target] = found[target].union(new) if target in found else new
        newest = {}
        for name, new in found.items():
            new = new.distinct()
            new = reliable((new.join(seen[name], "id", "left_anti") if name in seen else new).withColumn("hops", F.lit(hop)))
            if not new.isEmpty():
                newest[name] = new
                seen[name] = seen[name].union(new) if name in seen else new
        if not newest:
            break
    return seen
