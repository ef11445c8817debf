"""Typed classes declared once: properties, references, indexes, and the rules they must keep."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

SCALARS: dict[str, T.DataType] = {
    "byte": T.ShortType(), "short": T.ShortType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(),
    "double": T.DoubleType(), "bool": T.BooleanType(), "datetime": T.TimestampNTZType(), "string": T.StringType(),
}

PREVENT, CASCADE, SET_NULL = "prevent", "cascade", "set_null"
ONE, OPTIONAL, MANY = "1", "0..1", "*"


class ModelError(ValueError):
    """A model that breaks a rule; `code` tells which."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class Property:
    """A scalar or, with array, a list of scalars. Only non-string scalars can have a default."""

    name: str
    kind: str
    array: bool = False
    default: Any = None

    def field(self) -> T.StructField:
        kind = SCALARS[self.kind]
        meta = {} if self.default is None else {"default": str(self.default)}
        return T.StructField(self.name, T.ArrayType(kind, self.kind == "string") if self.array else kind, self.array or self.kind == "string", meta)


@dataclass(frozen=True)
class Reference:
    """A link to objects of a class: one, at most one, or many."""

    name: str
    target: str
    cardinality: str = OPTIONAL
    on_delete: str = PREVENT
    tracked: bool = True

    def field(self) -> T.StructField:
        kind = T.ArrayType(T.LongType(), False) if self.cardinality == MANY else T.LongType()
        return T.StructField(self.name, kind, self.cardinality != ONE, {"target": self.target})


@dataclass(frozen=True)
class Index:
    """One to four keys, (name, ascending); sorted indexes give ranges, hash indexes equality only."""

    name: str
    keys: tuple[tuple[str, bool], ...]
    sorted: bool = False
    unique: bool = False
    collation: str | None = None


@dataclass(frozen=True)
class ClassDef:
    name: str
    properties: tuple[Property | Reference, ...] = ()
    base: str | None = None
    abstract: bool = False
    indexes: tuple[Index, ...] = ()


@dataclass(frozen=True)
class Model:
    classes: dict[str, ClassDef] = field(default_factory=dict)

    @classmethod
    def of(cls, *defs: ClassDef) -> Model:
        model = cls({d.name: d for d in defs})
        model.validate()
        return model

    def lineage(self, name: str) -> list[ClassDef]:
        """The class and its bases, outermost base first."""
        out = []
        while name is not None:
            out.insert(0, self.classes[name])
            name = out[0].base
        return out

    def properties(self, name: str) -> dict[str, Property | Reference]:
        return {p.name: p for c in self.lineage(name) for p in c.properties}

    def indexes(self, name: str) -> dict[str, Index]:
        return {i.name: i for c in self.lineage(name) for i in c.indexes}

    def schema(self, name: str) -> T.StructType:
        return T.StructType([T.StructField("id", T.LongType(), False), *[p.field() for p in self.properties(name).values()]])

    def concrete(self, name: str) -> list[str]:
        """Names of the non-abstract classes that are `name` or derive from it."""
        return [c for c, d in self.classes.items() if not d.abstract and name in {x.name for x in self.lineage(c)}]

    def references_to(self, name: str) -> list[tuple[str, Reference]]:
        """(referring class, reference) for every reference that may point at an object of class `name`."""
        own = {x.name for x in self.lineage(name)}
        return [(c, p) for c in self.classes if not self.classes[c].abstract for p in self.properties(c).values() if isinstance(p, Reference) and p.target in own]

    def validate(self) -> None:
        for c in self.classes.values():
            if c.base is not None and c.base not in self.classes:
                raise ModelError("unknown_base", f"{c.name} derives from {c.base}")
            if c.abstract and c.base is not None and not self.classes[c.base].abstract:
                raise ModelError("abstract_base", f"abstract {c.name} derives from {c.base}, which is not")
            names = [p.name for x in self.lineage(c.name) for p in x.properties]
            if len(set(names)) < len(names) or "id" in names:
                raise ModelError("duplicate_property", c.name)
            for p in c.properties:
                if isinstance(p, Reference):
                    if p.target not in self.classes:
                        raise ModelError("unknown_target", f"{c.name}.{p.name}")
                    if p.cardinality == ONE and p.on_delete == SET_NULL:
                        raise ModelError("set_null_on_one", f"{c.name}.{p.name}")
                elif p.kind not in SCALARS or p.default is not None and (p.array or p.kind == "string"):
                    raise ModelError("invalid_property", f"{c.name}.{p.name}")
            for i in c.indexes:
                if not 1 <= len(i.keys) <= 4:
                    raise ModelError("index_arity", f"{c.name}.{i.name}")
                for key, _ in i.keys:
                    p = self.properties(c.name).get(key)
                    if p is None or getattr(p, "array", False) or getattr(p, "cardinality", "") == MANY:
                        raise ModelError("index_key", f"{c.name}.{i.name}: {key}")
