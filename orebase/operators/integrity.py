"""Set-level writes: change sets, referential integrity, uniqueness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.model import CASCADE, MANY, ONE, OPTIONAL, PREVENT, SET_NULL, Index, Model, ModelError, Reference
from .lookup import duplicates
from .navigate import reliable


class DataError(ValueError):
    """A change set that the data forbids; `kind` tells why."""

    def __init__(self, kind: str, rows: DataFrame):
        super().__init__(kind)
        self.kind, self.rows = kind, rows


def _ensure_none(kind: str, rows: DataFrame) -> None:
    if not rows.isEmpty():
        raise DataError(kind, rows)


def orphans(rows: DataFrame, ref: str, target: DataFrame, target_id: str) -> DataFrame:
    """Rows whose reference (or an element of it) points at no object; null is no reference."""
    if dict(rows.dtypes)[ref].startswith("array"):
        bad = rows.withColumn("__row", F.monotonically_increasing_id()).select("*", F.explode(ref).alias("__ref")).where("__ref is not null")
        return bad.join(target, F.col("__ref") == target[target_id], "left_anti").dropDuplicates(["__row"]).drop("__ref", "__row")
    return rows.where(F.col(ref).isNotNull()).join(target, rows[ref] == target[target_id], "left_anti")


def missing_required(rows: DataFrame, ref: str) -> DataFrame:
    """Rows without a required reference, or with a null element in an array of references."""
    if dict(rows.dtypes)[ref].startswith("array"):
        return rows.where(F.exists(ref, lambda x: x.isNull()))
    return rows.where(F.col(ref).isNull())


def prevented(deleted: DataFrame, deleted_id: str, rows: DataFrame, ref: str, gone: DataFrame | None = None, rows_id: str | None = None) -> DataFrame:
    """Referring rows that forbid a delete; those in `gone` were deleted before and do not count."""
    if gone is not None:
        rows = rows.join(gone.select(F.col(gone.columns[0]).alias("__gone")), F.col(rows_id) == F.col("__gone"), "left_anti")
    return rows.join(deleted.select(F.col(deleted_id).alias("__deleted")), F.col(ref) == F.col("__deleted"), "left_semi")


def cascade(start: dict[str, DataFrame], rules: list[tuple[str, str, str, DataFrame]]) -> dict[str, DataFrame]:
    """Ids that go with start, by class; rules: (parent class, child class, name of the reference, child rows (id, ref)).

    Rounds of joins run until nothing new is found, so cycles end.
    """
    gone = {c: df.select(F.col(df.columns[0]).alias("id")).distinct() for c, df in start.items()}
    newest = dict(gone)
    while newest:
        found: dict[str, DataFrame] = {}
        for parent, child, ref, rows in rules:
            if parent in newest:
                new = rows.join(newest[parent].select(F.col("id").alias("__p")), F.col(ref) == F.col("__p"), "left_semi").select("id")
                found[child] = found[child].union(new) if child in found else new
        newest = {}
        for child, new in found.items():
            new = new.distinct()
            new = reliable(new.join(gone[child], "id", "left_anti") if child in gone else new)
            if not new.isEmpty():
                newest[child] = new
                gone[child] = gone[child].union(new) if child in gone else new
    return gone


def delete_objects(model: Model, tables: dict[str, DataFrame], start: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables (id, properties) by class after a delete of the ids in start, by class.

    In rounds until no round finds more: an object that still refers to one deleted in this round by a preventing
    reference forbids all of it, also if a later round would have deleted it; then cascading references add their
    objects. At the end, other references to deleted objects are nulled, and elements of arrays taken out.
    """
    rules = [(name, ref) for name in tables for ref in model.properties(name).values() if isinstance(ref, Reference)]
    newest = {c: reliable(df.select(F.col(df.columns[0]).alias("id")).distinct()) for c, df in start.items()}
    for name, ids in newest.items():
        _ensure_none("unknown_id", ids.join(tables[name], "id", "left_anti"))
    gone = dict(newest)

    def referring(name: str, ref: Reference, targets: dict[str, DataFrame]) -> DataFrame | None:
        """Ids of a class's living objects that refer to any of targets."""
        dead = [targets[c] for c in model.concrete(ref.target) if c in targets]
        if not dead:
            return None
        rows = tables[name].select("id", (F.explode(ref.name) if ref.cardinality == MANY else F.col(ref.name)).alias("__ref"))
        out = rows.join(reduce(DataFrame.union, dead).select(F.col("id").alias("__ref")), "__ref", "left_semi").select("id").distinct()
        return out.join(gone[name], "id", "left_anti") if name in gone else out

    while newest:
        for name, ref in rules:
            if ref.on_delete == PREVENT and (held := referring(name, ref, newest)) is not None:
                _ensure_none("delete_prevented", held)
        found: dict[str, DataFrame] = {}
        for name, ref in rules:
            if ref.on_delete == CASCADE and (more := referring(name, ref, newest)) is not None:
                found[name] = found[name].union(more) if name in found else more
        newest = {}
        for name, more in found.items():
            more = reliable(more.distinct())
            if not more.isEmpty():
                newest[name] = more
                gone[name] = gone[name].union(more) if name in gone else more
    out = {name: rows.join(gone[name], "id", "left_anti") if name in gone else rows for name, rows in tables.items()}
    for name, ref in rules:
        dead = [gone[c] for c in model.concrete(ref.target) if c in gone]
        if ref.on_delete == SET_NULL and dead:
            out[name] = set_null(out[name], ref.name, reduce(DataFrame.union, dead), "id", "id")
    return out


def create(model: Model, name: str, rows: DataFrame, top: int) -> DataFrame:
    """New objects of a class from rows of some of its properties: ids above top, defaults or null for the rest."""
    if model.classes[name].abstract:
        raise ModelError("abstract_class", name)
    unknown = [c for c in rows.columns if c not in model.properties(name)]
    if unknown:
        raise ModelError("unknown_property", f"{name}.{unknown[0]}")
    values = [(F.col(p.name) if p.name in rows.columns else F.lit(getattr(p, "default", None))).cast(p.field().dataType).alias(p.name) for p in model.properties(name).values()]
    out = with_new_ids(rows.select(*values), top)
    for p in model.properties(name).values():
        if isinstance(p, Reference) and p.cardinality == ONE:
            _ensure_none("missing_reference", missing_required(out, p.name))
    return out.select("id", *model.properties(name))


def ensure_unique(parts: dict[str, DataFrame], index: Index) -> None:
    """Raises where a key of a unique index is held twice among all classes that have it, given as rows by class."""
    rows = reduce(DataFrame.unionByName, [df.select(*[k for k, _ in index.keys]) for df in parts.values()])
    _ensure_none("not_unique", duplicates(rows, index))


def violations(model: Model, tables: dict[str, DataFrame]) -> dict[tuple[str, str, str], DataFrame]:
    """What a model forbids in stored rows, by (rule, class, reference or index): only entries with rows."""
    out = {}
    for name, rows in tables.items():
        for p in model.properties(name).values():
            if isinstance(p, Reference):
                targets = [tables[c].select(F.col("id").alias("__target")) for c in model.concrete(p.target) if c in tables]
                if targets:
                    out["unknown_reference", name, p.name] = orphans(rows, p.name, reduce(DataFrame.union, targets), "__target")
                if p.cardinality != OPTIONAL:
                    out["missing_reference", name, p.name] = missing_required(rows, p.name)
    for c in model.classes.values():
        for index in c.indexes:
            parts = [tables[k].select(*[n for n, _ in index.keys]) for k in model.concrete(c.name) if k in tables]
            if index.unique and parts:
                out["not_unique", c.name, index.name] = duplicates(reduce(DataFrame.union, parts), index)
    return {k: v for k, v in out.items() if not v.isEmpty()}


def copies(rows: DataFrame, ids: DataFrame, top: int, id_col: str = "id") -> DataFrame:
    """New objects with the values of those in ids and ids above top."""
    return with_new_ids(rows.join(ids, id_col, "left_semi").drop(id_col), top, id_col).select(*rows.columns)


def set_null(rows: DataFrame, ref: str, deleted: DataFrame, deleted_id: str, row_key: str | None = None) -> DataFrame:
    """rows with references to deleted objects nulled; elements of arrays are taken out, all occurrences."""
    dead = deleted.select(F.col(deleted_id).alias("__dead")).distinct()
    if dict(rows.dtypes)[ref].startswith("array"):
        parts = rows.select(row_key, F.posexplode(ref).alias("pos", "__ref")).join(dead, F.col("__ref") == F.col("__dead"), "left_anti")
        kept = parts.groupBy(row_key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "__ref"))), lambda x: x["__ref"]).alias("__kept"))
        none = F.when(F.col(ref).isNull(), F.lit(None)).otherwise(F.array().cast(rows.schema[ref].dataType))
        return rows.join(kept, row_key, "left").withColumn(ref, F.coalesce("__kept", none)).select(*rows.columns)
    out = rows.join(dead, rows[ref] == F.col("__dead"), "left")
    return out.select(*[F.when(F.col("__dead").isNull(), F.col(ref)).alias(ref) if c == ref else rows[c] for c in rows.columns])


def upsert(rows: DataFrame, changes: DataFrame, id_col: str = "id") -> DataFrame:
    """rows after changes, which bring ids, or null for new objects (0 is an id like any other); new ids follow the largest present.

    An update takes every column that changes has and leaves the others; an unknown id is an error, an id
    twice in one change set too. New rows get null for columns that changes lacks.
    """
    updates = changes.where(F.col(id_col).isNotNull())
    _ensure_none("unknown_id", updates.join(rows, id_col, "left_anti"))
    _ensure_none("id_not_unique", updates.groupBy(id_col).count().where("count > 1"))
    fields = [c for c in changes.columns if c != id_col]
    new = changes.where(F.col(id_col).isNull())
    marked = updates.select(id_col, F.struct(*fields).alias("__new"))
    old = rows.join(marked, id_col, "left")
    kept = old.select(*[F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(rows[c]).alias(c) if c in fields else F.col(c) for c in rows.columns])
    top = rows.agg(F.coalesce(F.max(id_col), F.lit(0))).first()[0]
    return kept.unionByName(with_new_ids(new.drop(id_col), top, id_col), allowMissingColumns=True)


def with_new_ids(rows: DataFrame, top: int, id_col: str = "id") -> DataFrame:
    """rows with ids above top: unique, not dense, handed out by partitions without a shuffle."""
    return rows.withColumn(id_col, F.monotonically_increasing_id() + F.lit(top + 1))


def delete(rows: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """rows without the given ids, all of which must be there."""
    _ensure_none("unknown_id", ids.join(rows, id_col, "left_anti"))
    return rows.join(ids, id_col, "left_anti")
