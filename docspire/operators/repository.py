"""Typed repositories: dataclasses over a collection."""

from __future__ import annotations

import dataclasses
from typing import Any, Generic, TypeVar, get_args, get_type_hints

from pyspark.sql import DataFrame

from ..plans.filters import Equal, Filter, and_
from ..plans.find import FindOptions
from ..sources.store import Collection, ConstraintError, Database
from . import cursor

E = TypeVar("E")


def entity(name: str | None = None, id_field: str | None = None, embedded: tuple[str, ...] = (), indexes: tuple[tuple[str, tuple[str, ...]], ...] = (), generated: bool = False):
    """Mark a dataclass: its name, id field, the id's inner fields if it is a document, indexes as (kind, fields), and whether the id is the row's own, which the store gives."""

    def mark(cls: type) -> type:
        cls = cls if dataclasses.is_dataclass(cls) else dataclasses.dataclass(cls)
        cls.__entity__ = {"name": name or cls.__name__, "id": id_field, "embedded": embedded, "indexes": indexes, "generated": generated}
        return cls

    return mark


class Repository(Generic[E]):
    def __init__(self, db: Database, cls: type[E], key: str | None = None):
        self.cls, self.spec = cls, getattr(cls, "__entity__", {"name": cls.__name__, "id": None, "embedded": (), "indexes": (), "generated": False})
        name = self.spec["name"] if key is None else f"{self.spec['name']}+{key}"
        self.collection: Collection = db.collection(name)
        if not db.has_collection(name):
            meta = self.collection.meta
            meta.entity, meta.key = self.spec["name"], key
            db.commit({name: meta})
            if self.spec["id"]:
                self.collection.create_index(self._id_paths(), "unique")
            for kind, fields in self.spec["indexes"]:
                self.collection.create_index(list(fields), kind)

    def _id_paths(self) -> list[str]:
        return [f"{self.spec['id']}.{f}" for f in self.spec["embedded"]] or [self.spec["id"]]

    def _document(self, item: E) -> dict[str, Any]:
        out = dataclasses.asdict(item)  # type: ignore[call-overload]
        if self.spec["id"] and out.get(self.spec["id"]) is None:
            raise ConstraintError(f"the id {self.spec['id']} is null")
        return out

    def id_filter(self, id_: Any) -> Filter:
        """By id; of a document id by all its inner fields."""
        if not self.spec["id"]:
            raise ConstraintError(f"{self.spec['name']} has no id")
        if id_ is None:
            raise ConstraintError("an id is never null")
        if self.spec["embedded"]:
            inner = dataclasses.asdict(id_) if dataclasses.is_dataclass(id_) else id_
            return and_(*[Equal(f"{self.spec['id']}.{f}", inner[f]) for f in self.spec["embedded"]])
        return Equal(self.spec["id"], id_)

    def insert(self, *items: E) -> list[int]:
        if not self.spec["generated"]:
            return self.collection.insert([self._document(i) for i in items])
        name = self.spec["id"]
        if any(getattr(i, name) is not None for i in items):
            raise ConstraintError(f"{name} is given by the store, not on insert")
        documents = []
        for item, own in zip(items, self.collection.db.next_ids(len(items)), strict=True):
            setattr(item, name, own)
            documents.append(self._document(item) | {"_id": own})
        return self.collection.insert(documents)

    def find(self, node: Filter | None = None, options: FindOptions | None = None) -> DataFrame:
        return self.collection.find(node, options)

    def project(self, rows: DataFrame, template: type) -> DataFrame:
        return cursor.project(rows, template)

    def join(self, rows: DataFrame, foreign: DataFrame, local: str, other: str, target: str, template: type | None = None) -> DataFrame:
        """Rows with the array `target` of the other repository's rows of equal key, projected if a template is given."""
        joined = cursor.lookup_join(rows, foreign, local, other, target)
        return joined if template is None else cursor.project(joined, template)

    def entities(self, rows: DataFrame) -> list[E]:
        """Rows as objects, for results that fit the driver."""
        return [_build(self.cls, r.asDict(recursive=True)) for r in rows.toLocalIterator()]

    def get_by_id(self, id_: Any) -> E | None:
        found = self.entities(self.collection.find(self.id_filter(id_)).limit(1))
        return found[0] if found else None

    def update(self, item: E, insert_if_absent: bool = False) -> int:
        doc = self._document(item)
        return self.collection.update(self.id_filter(doc[self.spec["id"]]), doc, insert_if_absent=insert_if_absent)

    def update_document(self, node: Filter, document: dict[str, Any], just_once: bool = False) -> int:
        return self.collection.update(node, document, just_once)

    def update_by_row_id(self, id_: int, item: E) -> int:
        return self.collection.update_by_id(id_, self._document(item))

    def remove(self, item: E) -> int:
        return self.collection.remove(self.id_filter(self._document(item)[self.spec["id"]]))

    def size(self) -> int:
        return self.collection.size()


def _build(cls: type, values: dict[str, Any]) -> Any:
    # Annotations may be strings.
    hints = get_type_hints(cls)
    out = {}
    for f in dataclasses.fields(cls):
        v = values.get(f.name)
        # The dataclass itself, or the one in a union or a list.
        hint = hints[f.name]
        inner = next((t for t in (hint, *get_args(hint)) if isinstance(t, type) and dataclasses.is_dataclass(t)), None)
        if inner and isinstance(v, dict):
            v = _build(inner, v)
        elif inner and isinstance(v, list):
            v = [_build(inner, x) if isinstance(x, dict) else x for x in v]
        out[f.name] = v
    return cls(**out)
