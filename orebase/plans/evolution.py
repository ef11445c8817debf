"""Changes between two models and what they do to stored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model import MANY, ONE, Model, ModelError, Reference


def diff(old: Model, new: Model) -> list[tuple[str, str, str]]:
    """(change, class, property) in order of class and property; raises ModelError for what is not allowed."""
    out = [("drop_class", c, "") for c in old.classes if c not in new.classes]
    out += [("add_class", c, "") for c in new.classes if c not in old.classes]
    for c in (c for c in new.classes if c in old.classes):
        was, now = old.properties(c), new.properties(c)
        for name, p in now.items():
            if name not in was:
                if isinstance(p, Reference) and p.cardinality == ONE:
                    raise ModelError("add_required_reference", f"{c}.{name}")
                out.append(("add_property", c, name))
            elif isinstance(p, Reference) != isinstance(was[name], Reference) or p.field().dataType != was[name].field().dataType:
                raise ModelError("change_type", f"{c}.{name}")
            elif p != was[name]:
                out.append(("change_property", c, name))
        out += [("drop_property", c, name) for name in was if name not in now]
        for name, index in new.indexes(c).items():
            before = old.indexes(c).get(name)
            if before is None and any(name in old.indexes(k) for k in old.classes) and any(key not in was for key, _ in index.keys):
                raise ModelError("index_new_property", f"{c}.{name}")
            if before != index:
                out.append(("add_index" if before is None else "change_index", c, name))
        out += [("drop_index", c, name) for name in old.indexes(c) if name not in new.indexes(c)]
    return sorted(out)


def migrate(rows: DataFrame, old: Model, new: Model, name: str) -> DataFrame:
    """Stored rows of a class in the new layout: added properties get their default or null, dropped ones go."""
    diff(old, new)
    was, columns = old.properties(name), [F.col("id")]
    for p in new.properties(name).values():
        kind = p.field().dataType
        columns.append(F.col(p.name) if p.name in was else F.lit(getattr(p, "default", None)).cast(kind).alias(p.name))
    return rows.select(*columns)


def required_references(model: Model, name: str) -> list[Reference]:
    return [p for p in model.properties(name).values() if isinstance(p, Reference) and p.cardinality == ONE]


def many_references(model: Model, name: str) -> list[Reference]:
    return [p for p in model.properties(name).values() if isinstance(p, Reference) and p.cardinality == MANY]
