"""Predicates and orders over index keys.

Keys compare one after the other, each ascending or descending; nulls come before all values of
an ascending key. "Before" and "after" mean places in that order. The predicates keep the form
`k1 <= a and (k1 < a or ...)`, whose first part a Parquet scan can use.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .model import Index, Model, ModelError


def _key(index: Index, name: str) -> Column:
    c = F.col(name)
    return F.collate(c, index.collation) if index.collation else c


def equal(index: Index, values: Sequence[Any]) -> Column:
    out = F.lit(True)
    for (name, _), v in zip(index.keys, values):
        out = out & _key(index, name).eqNullSafe(F.lit(v))
    return out


def _side(index: Index, at: int, v: Any, after: bool, closed: bool) -> Column:
    """Key `at` stands after (before) v in the index order, or also at v."""
    name, ascending = index.keys[at]
    k = _key(index, name)
    larger = after == ascending
    if v is None:  # null is the smallest value
        if larger:
            return F.lit(True) if closed else k.isNotNull()
        return k.isNull() if closed else F.lit(False)
    if larger:
        return (k >= F.lit(v)) if closed else (k > F.lit(v))
    less = (k <= F.lit(v)) if closed else (k < F.lit(v))
    return k.isNull() | less


def beyond(index: Index, values: Sequence[Any], after: bool, closed: bool) -> Column:
    """Rows whose key prefix stands after (before) values; closed also takes those at values."""

    def rest(at: int) -> Column:
        last = at == len(values) - 1
        if last:
            return _side(index, at, values[at], after, closed)
        here = _key(index, index.keys[at][0]).eqNullSafe(F.lit(values[at]))
        return _side(index, at, values[at], after, True) & (_side(index, at, values[at], after, False) | (here & rest(at + 1)))

    return rest(0)


def order(index: Index, backward: bool = False, id_col: str = "id") -> list[Column]:
    """Sort columns; ids break ties upwards, whatever the keys' directions. Backward turns everything round."""
    out = []
    for name, ascending in index.keys:
        k = _key(index, name)
        out.append(k.asc_nulls_first() if ascending != backward else k.desc_nulls_last())
    return [*out, F.col(id_col).desc() if backward else F.col(id_col).asc()]


def index_by_name(model: Model, class_name: str, name: str, kinds: Sequence[str]) -> Index:
    """The index of a class, its own or inherited; kinds are the key types that the caller will give."""
    index = model.indexes(class_name).get(name)
    if index is None:
        raise ModelError("unknown_index", f"{class_name}.{name}")
    properties = model.properties(class_name)
    have = [getattr(properties[key], "kind", "long") for key, _ in index.keys]  # a reference is a long
    if have != list(kinds):
        raise ModelError("key_types", f"{name} has keys {have}, {list(kinds)} given")
    return index


def check_arity(index: Index, values: Sequence[Any], exact: bool = False) -> None:
    if not 1 <= len(values) <= len(index.keys) or exact and len(values) != len(index.keys):
        raise ModelError("key_arity", f"{index.name} has {len(index.keys)} keys, {len(values)} given")
