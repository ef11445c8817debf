"""Objects as transfer rows: references as ids, selected objects nested, subclasses told apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .integrity import DataError, orphans, with_new_ids


def scalars(rows: DataFrame, wanted: list[str], ignored: tuple[str, ...] = ()) -> DataFrame:
    """The columns that both sides have, without ignored ones."""
    return rows.select(*[c for c in rows.columns if c in wanted and c not in ignored])


def reference_ids(rows: DataFrame, refs: dict[str, str]) -> DataFrame:
    """References under the names given, a null reference as 0."""
    return rows.select(*[F.coalesce(c, F.lit(0)).alias(refs[c]) if c in refs else F.col(c) for c in rows.columns])


def references_from_ids(rows: DataFrame, refs: dict[str, str], targets: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """The way back: id columns under their references' names, 0 as null; an id that its target (rows, id column) lacks is an error."""
    out = rows.select(*[F.when(F.col(c) != 0, F.col(c)).alias(refs[c]) if c in refs else F.col(c) for c in rows.columns])
    for ref, (target, target_id) in targets.items():
        if not (bad := orphans(out, ref, target, target_id)).isEmpty():
            raise DataError("unknown_id", bad)
    return out


def inserted(rows: DataFrame, top: int, id_col: str = "id") -> DataFrame:
    """Transfer rows as new objects: their ids are ignored, new ones follow top."""
    return with_new_ids(rows.drop(id_col), top, id_col).select(*rows.columns)


def nested(rows: DataFrame, ref: str, selected: DataFrame, selected_id: str, fields: list[str], name: str) -> DataFrame:
    """rows with the referenced object as a struct where it is among the selected, else null."""
    objects = selected.select(F.col(selected_id).alias("__id"), F.struct(*fields).alias(name))
    return rows.join(objects, rows[ref] == F.col("__id"), "left").drop("__id")


def nested_many(rows: DataFrame, row_id: str, refs: str, selected: DataFrame, selected_id: str, fields: list[str], name: str) -> DataFrame:
    """rows with the selected ones of an array's objects, in order; others are left out, so arrays shrink."""
    objects = selected.select(F.col(selected_id).alias("__id"), F.struct(*fields).alias("__o"))
    parts = rows.select(row_id, F.posexplode(refs).alias("pos", "__ref")).join(objects, F.col("__ref") == F.col("__id"))
    sets = parts.groupBy(row_id).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "__o"))), lambda x: x["__o"]).alias(name))
    out = rows.join(sets, row_id, "left")
    return out.withColumn(name, F.coalesce(name, F.array().cast(out.schema[name].dataType)))


def polymorphic(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows of several classes with `kind`; columns that a class lacks are null."""
    out = None
    for kind, df in parts.items():
        df = df.withColumn("kind", F.lit(kind))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
