"""Schema migrations: steps that rewrite documents, and paths between versions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class AddField:
    """Set a field of every row, also where it exists; a value, a Column, or a function of the frame."""

    name: str
    value: Any = None

    def apply(self, df: DataFrame) -> DataFrame:
        value = self.value(df) if callable(self.value) and not isinstance(self.value, Column) else self.value
        return df.withColumn(self.name, value if isinstance(value, Column) else F.lit(value))


@dataclass(frozen=True)
class RenameField:
    """Rename a top-level field; nothing happens if it is missing."""

    old: str
    new: str

    def apply(self, df: DataFrame) -> DataFrame:
        if self.old not in df.columns:
            return df
        return (df.drop(self.new) if self.new in df.columns else df).withColumnRenamed(self.old, self.new)


@dataclass(frozen=True)
class DeleteField:
    """Delete a field, also inside documents."""

    path: str

    def apply(self, df: DataFrame) -> DataFrame:
        first, _, rest = self.path.partition(".")
        if not rest or self.path in df.columns:
            return df.drop(self.path)
        return df.withColumn(first, F.col(f"`{first}`").dropFields(rest)) if first in df.columns else df


@dataclass(frozen=True)
class ChangeDataType:
    name: str
    convert: Callable[[Column], Column]

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.name, self.convert(F.col(f"`{self.name}`"))) if self.name in df.columns else df


@dataclass(frozen=True)
class ChangeIdField:
    """Another field identifies entities: its unique index replaces the old one's."""

    old: list[str]
    new: list[str]


@dataclass(frozen=True)
class CreateIndex:
    kind: str
    fields: list[str]


@dataclass(frozen=True)
class DropIndex:
    fields: list[str]


@dataclass(frozen=True)
class DropAllIndexes:
    pass


@dataclass(frozen=True)
class Rename:
    """Rename the collection."""

    new: str


@dataclass(frozen=True)
class Drop:
    """Drop the collection."""


@dataclass(frozen=True)
class Custom:
    """Any function of the database."""

    run: Callable[[Any], None]


Rewriting = AddField | RenameField | DeleteField | ChangeDataType


def rewrite(df: DataFrame, steps: list[Rewriting]) -> DataFrame:
    """All steps in one plan, so one pass over the rows."""
    for step in steps:
        df = step.apply(df)
    return df


@dataclass
class Migration:
    """Steps from one schema version to another, for each collection; `None` is the database."""

    start: int
    end: int
    steps: list[tuple[str | None, Any]] = field(default_factory=list)

    def on(self, collection: str, *steps: Any) -> Migration:
        self.steps += [(collection, s) for s in steps]
        return self

    def run(self, f: Callable[[Any], None]) -> Migration:
        self.steps.append((None, Custom(f)))
        return self


def path(migrations: list[Migration], start: int, end: int) -> list[Migration]:
    """Migrations from one version to another, at each version the longest hop that doesn't overshoot."""
    out, at, up = [], start, end > start
    while at != end:
        hops = [m for m in migrations if m.start == at and (at < m.end <= end if up else end <= m.end < at)]
        if not hops:
            raise ValueError(f"no migration leads from version {at} to {end}")
        best = (max if up else min)(hops, key=lambda m: m.end)
        out.append(best)
        at = best.end
    return out
