"""A database of document collections in a folder that Spark can read.

Rows lie in Parquet folders, the parts, that never change; a manifest names the
parts of each collection, and putting the next manifest file in its place is the
one commit point, for one collection or many. Inserts add a part, updates and
removals replace the parts that hold matches, `compact` merges all. Writers are
optimistic: the second of two that start from one version reads the newest one and
does its write again, a few times.

Text indexes are tables beside each part. A commit's change events are written
before it and named by its manifest, so the events of a driver that was lost after
the commit are delivered by whoever opens the database next.
"""

from __future__ import annotations

import functools
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import resolve
from ..functions.spatial import Stored, hilbert_index
from ..operators import migrate as M
from ..operators import write as W
from ..operators.write import ConstraintError
from . import schema as S
from .indexers import INDEXERS
from .shared import scratch
from ..plans.filters import All, Filter, all_, by_id, field_
from ..plans.find import Context, FindOptions, find
from ..streaming import changes

RESERVED = "|>"
#: How often a write that met another writer is done again.
TRIES = 5
#: Manifests that `compact` keeps, and how old in seconds a part that none names must be to go.
KEPT_VERSIONS, GRACE_S = 20, 24 * 3600
_EPOCH_MS = 1_288_834_974_657
REPLICATOR = "replicator"


class Conflict(RuntimeError):
    """Another writer committed first."""


@dataclass
class Index:
    kind: str  # unique, non_unique, spatial, vector, or one of INDEXERS
    fields: list[str]
    options: dict[str, Any] = field(default_factory=dict)

    @property
    def name(self) -> str:
        return "|".join([*self.fields, self.kind])


@dataclass
class Meta:
    """What the manifest holds of a collection."""

    parts: list[str] = field(default_factory=list)
    schema: str | None = None
    #: Schemas of parts whose types differ from the collection's.
    narrow: dict[str, str] = field(default_factory=dict)
    indexes: list[dict[str, Any]] = field(default_factory=list)
    attributes: dict[str, Any] = field(default_factory=dict)
    entity: str | None = None
    key: str | None = None


class _Files:
    """The few file operations that aren't a DataFrame's."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.jvm, self.root = spark, spark._jvm, root.rstrip("/")
        self.fs = self.jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def names(self, name: str) -> list[str]:
        p = self.path(name)
        return [x.getPath().getName() for x in self.fs.listStatus(p)] if self.fs.exists(p) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Put a file in its place, whole or not at all; False if there is one."""
        aside = self.path(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(aside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        hadoop = self.jvm.org.apache.hadoop.fs
        try:
            options = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
            options[0] = getattr(hadoop, "Options$Rename").NONE
            hadoop.FileContext.getFileContext(self.fs.getUri(), self.fs.getConf()).rename(aside, self.path(name), options)
        except Exception as e:  # the JVM's exception of an existing file
            self.fs.delete(aside, False)
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        return True

    def move(self, name: str, to: str) -> None:
        """Move a file unless it is gone or there already."""
        if self.fs.exists(self.path(name)):
            self.fs.mkdirs(self.path(to).getParent())
            self.fs.rename(self.path(name), self.path(to))

    def age_s(self, name: str) -> float:
        return time.time() - self.fs.getFileStatus(self.path(name)).getModificationTime() / 1000

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class Database:
    """A folder of collections at one version."""

    def __init__(self, spark: SparkSession, root: str, separator: str = "."):
        if len(separator) != 1:
            raise ValueError("a path separator is one character")
        self.spark, self.root, self.separator = spark, root.rstrip("/"), separator
        self.files = _Files(spark, self.root)
        self.listeners: dict[str, list[Callable[[dict[str, Any]], None]]] = {}
        self.store_listeners: list[Callable[[str], None]] = []
        self.processors: dict[str, list[tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame]]]] = {}
        self.closed = False
        self.pending: list[tuple[str, DataFrame, str, str]] | None = None
        if not self.refresh():
            self.version = -1
            self.state = {"created_ms": W.now_ms(), "schema_version": 1, "collections": {}}
            try:
                self._publish(self.state)
            except Conflict:  # another writer made the database meanwhile
                self.refresh()
        self._last_id = 0
        self._told("opened")

    def _versions(self) -> list[int]:
        return sorted(int(v.split(".")[0]) for v in self.files.names("manifest") if v.endswith(".json") and v.split(".")[0].isdigit())

    def refresh(self) -> bool:
        """Go to the newest version; False if there is none."""
        versions = self._versions()
        if versions:
            self.version = versions[-1]
            self.state = json.loads(self.files.read(f"manifest/{self.version:020d}.json"))
            self._deliver()
        return bool(versions)

    @classmethod
    def temporary(cls, spark: SparkSession) -> Database:
        """A database that goes when the application ends."""
        return cls(spark, scratch(spark))

    def load(self, *modules: Callable[[Database], None]) -> Database:
        """Run modules on this database: functions that register indexers, tokenizers, processors or listeners."""
        for module in modules:
            module(self)
        return self

    def is_closed(self) -> bool:
        return self.closed

    def has_unsaved_changes(self) -> bool:
        """Writes are committed as they are made, so only a transaction has any."""
        return bool(self.pending)

    def config(self) -> dict[str, Any]:
        return {"root": self.root, "separator": self.separator, "tries": TRIES, "kept_versions": KEPT_VERSIONS}

    # Catalog.
    def meta(self, name: str) -> Meta:
        return Meta(**self.state["collections"].get(name, asdict(Meta())))

    def collection(self, name: str) -> Collection:
        if not name or " " in name or any(c in name for c in RESERVED):
            raise ValueError(f"not a collection name: {name!r}")
        return Collection(self, name)

    def list_collections(self) -> list[str]:
        return sorted(n for n, m in self.state["collections"].items() if not m["entity"])

    def list_repositories(self) -> list[str]:
        return sorted(n for n, m in self.state["collections"].items() if m["entity"] and not m["key"])

    def list_keyed_repositories(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for m in self.state["collections"].values():
            if m["entity"] and m["key"]:
                out.setdefault(m["key"], []).append(m["entity"])
        return out

    def has_collection(self, name: str) -> bool:
        return name in self.state["collections"]

    def destroy(self, name: str) -> None:
        self.commit({name: None})

    def metadata(self) -> dict[str, Any]:
        return {"created_ms": self.state["created_ms"], "schema_version": self.state["schema_version"], "version": self.version, "engine": self.spark.version}

    # Commits.
    def _publish(self, state: dict[str, Any]) -> None:
        if not self.files.create(f"manifest/{self.version + 1:020d}.json", json.dumps(state)):
            raise Conflict(f"version {self.version + 1} exists")
        self.version += 1
        self.state = state
        self._deliver()

    def _deliver(self) -> None:
        """Move the events of this version's commit to the change log, if they aren't there."""
        for events in self.state.get("events", []):
            for name in self.files.names(f"events/{events}"):
                if name.startswith("part-"):
                    self.files.move(f"events/{events}/{name}", f"changes/{events}-{name}")
            self.files.delete(f"events/{events}")

    def commit(self, changed: dict[str, Meta | None], events: list[str] | None = None, **more: Any) -> None:
        """Replace the entries of some collections, all at once; `events`: folders of change events that become visible with it."""
        if self.closed:
            raise RuntimeError("the database is closed")
        self._deliver()
        collections = dict(self.state["collections"])
        for name, meta in changed.items():
            if meta is None:
                collections.pop(name, None)
            else:
                collections[name] = asdict(meta)
        self._publish({**self.state, "collections": collections, "events": events or [], **more})
        self._told("commit")

    def retried(self, write: Callable[[], Any]) -> Any:
        """A write on the newest version, done again as long as another writer comes first; in a transaction on the version that it began with."""
        for left in range(TRIES - 1, -1, -1):
            if self.pending is None:
                self.refresh()
            try:
                return write()
            except Conflict:
                if not left or self.pending is not None:
                    raise

    def compact(self, keep: int = KEPT_VERSIONS, grace_s: float = GRACE_S) -> None:
        """Merge each collection's parts; drop all manifests but the last `keep`, and parts that none of these names and that are older than `grace_s`."""
        self.refresh()
        for name in list(self.state["collections"]):
            c = self.collection(name)
            self.retried(lambda c=c: c.replace(c.raw()) if len(c.meta.parts) > 1 else None)
        versions = self._versions()
        for v in versions[:-keep] if keep else []:
            self.files.delete(f"manifest/{v:020d}.json")
        live = set()
        for v in versions[-keep:]:
            state = json.loads(self.files.read(f"manifest/{v:020d}.json"))
            live |= {p for m in state["collections"].values() for p in m["parts"]}
        for folder in ("data", "index"):
            for part in self.files.names(folder):
                if part not in live and self.files.age_s(f"{folder}/{part}") >= grace_s:
                    self.files.delete(f"{folder}/{part}")

    def close(self) -> None:
        self.closed = True
        self._told("closed")

    def subscribe(self, listener: Callable[[str], None]) -> None:
        self.store_listeners.append(listener)

    def _told(self, what: str) -> None:
        for f in self.store_listeners:
            f(what)

    def next_ids(self, n: int) -> range:
        """Fresh ids in order of time."""
        start = max((W.now_ms() - _EPOCH_MS) << 22, self._last_id + 1)
        self._last_id = start + n - 1
        return range(start, start + n)

    def transaction(self) -> Transaction:
        return Transaction(self)

    def change_log(self) -> DataFrame:
        if not self.files.names("changes"):
            return self.spark.createDataFrame([], changes.SCHEMA)
        return changes.read(self.spark, f"{self.root}/changes")

    def migrate(self, migrations: list[M.Migration], to: int) -> None:
        """Run the steps that lead to a schema version; its number is part of the last commit."""
        for m in M.path(migrations, self.state["schema_version"], to):
            by_name: dict[str, list[Any]] = {}
            for name, step in m.steps:
                if name is None:
                    step.run(self)
                else:
                    by_name.setdefault(name, []).append(step)
            for name, steps in by_name.items():
                self._migrate(name, steps)
            self.commit({}, schema_version=m.end)

    def _migrate(self, name: str, steps: list[Any]) -> None:
        c = self.collection(name)
        rewriting = [s for s in steps if hasattr(s, "apply")]
        if rewriting and self.has_collection(name):
            c.replace(M.rewrite(c.raw(), rewriting))
        for s in steps:
            if isinstance(s, M.CreateIndex):
                c.create_index(s.fields, s.kind)
            elif isinstance(s, M.DropIndex):
                c.drop_index(s.fields)
            elif isinstance(s, M.DropAllIndexes):
                for i in c.indexes():
                    c.drop_index(i.fields)
            elif isinstance(s, M.ChangeIdField):
                if c.has_index(s.old):
                    c.drop_index(s.old)
                c.create_index(s.new, "unique")
            elif isinstance(s, M.Drop):
                self.destroy(name)
            elif isinstance(s, M.Rename):
                if self.has_collection(s.new):
                    raise ConstraintError(f"a collection {s.new} exists")
                self.commit({s.new: c.meta, name: None})
                c = self.collection(s.new)


class Collection:
    """A named table of documents with an `_id`."""

    def __init__(self, db: Database, name: str):
        self.db, self.name = db, name

    @property
    def meta(self) -> Meta:
        return self.db.meta(self.name)

    # Reading.
    def schema(self) -> T.StructType:
        meta = self.meta
        return T.StructType.fromJson(json.loads(meta.schema)) if meta.schema else T.StructType([T.StructField("_id", T.LongType())])

    def raw(self, parts: list[str] | None = None, named: bool = False) -> DataFrame:
        """The stored rows, of some parts or all; `named`: with the part of each in `_part`."""
        meta, spark, schema = self.meta, self.db.spark, self.schema()
        parts = meta.parts if parts is None else parts
        path = lambda p: f"{self.db.root}/data/{p}"
        plain = [p for p in parts if p not in meta.narrow]
        frames = []
        if plain:
            rows = spark.read.schema(schema).parquet(*map(path, plain))
            frames.append(rows.withColumn("_part", F.regexp_extract("_metadata.file_path", "/data/([0-9a-f]{32})/", 1)) if named else rows)
        for p in parts:
            if p in meta.narrow:
                rows = S.aligned(spark.read.schema(T.StructType.fromJson(json.loads(meta.narrow[p]))).parquet(path(p)), schema)
                frames.append(rows.withColumn("_part", F.lit(p)) if named else rows)
        return functools.reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], schema)

    def frame(self) -> DataFrame:
        """The rows as readers see them, after the read processors."""
        out = self.raw().drop("_fields")
        for _, after in self.db.processors.get(self.name, []):
            out = after(out)
        return out

    def index_tables(self, fields: list[str]) -> Any:
        """What queries ask of an index that has tables beside each part."""
        return self._opened(next(i for i in self.indexes() if i.fields == fields and i.kind in INDEXERS))

    def _opened(self, index: Index) -> Any:
        return INDEXERS[index.kind].open(self.db.spark, [self._index_path(p, index) for p in self.meta.parts], index.options)

    def context(self) -> Context:
        indexes = self.indexes()
        full = frozenset(f for i in indexes if i.kind == "full_text" for f in i.fields)
        metrics = {i.fields[0]: i.options.get("metric", "cosine") for i in indexes if i.kind.startswith("vector")}
        tables: dict[str, dict[str, Any]] = {"text": {}, "vector": {}}
        for i in indexes:
            if i.kind in INDEXERS and len(i.fields) == 1 and self.meta.parts:
                tables[INDEXERS[i.kind].slot][i.fields[0]] = self._opened(i)
        return Context("_id", self.db.separator, full, "_fields" if "_fields" in self.schema().names else None, metrics, tables["text"], tables["vector"])

    def find(self, node: Filter | None = None, options: FindOptions | None = None) -> DataFrame:
        rows = self.raw()
        out = find(rows, node, options, self.context()).drop("_fields")
        for _, after in self.db.processors.get(self.name, []):
            out = after(out)
        return out

    def get_by_id(self, id_: int) -> Row | None:
        return self.find(by_id(id_)).first()

    def size(self) -> int:
        return self.raw().count()

    def attributes(self) -> dict[str, Any]:
        return self.meta.attributes

    def set_attributes(self, values: dict[str, Any]) -> None:
        meta = self.meta
        meta.attributes = values
        self.db.commit({self.name: meta})

    # Writing.
    def add_processor(self, before_write: Callable[[DataFrame], DataFrame] | None = None, after_read: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Functions of frames, run in the order of registration."""
        self.db.processors.setdefault(self.name, []).append((before_write or (lambda d: d), after_read or (lambda d: d)))

    def _prepared(self, documents: list[dict[str, Any]] | dict[str, Any] | DataFrame, source: str | None) -> DataFrame:
        spark = self.db.spark
        if isinstance(documents, DataFrame):
            rows = documents
            if "_id" not in rows.columns:
                start = self.db.next_ids(1)[0]
                rows = rows.withColumn("_id", F.lit(start) + F.monotonically_increasing_id())
        else:
            items = [documents] if isinstance(documents, dict) else documents
            ids = iter(self.db.next_ids(len(items)))
            items = [{"_id": next(ids)} | d for d in items]
            names = [n for n in dict.fromkeys(k for d in items for k in d) if n != "_source"]
            made = [d | {"_fields": W.leaf_paths({k: v for k, v in d.items() if not k.startswith("_")}, separator=self.db.separator)} for d in items]
            rows = S.frame(spark, made, [*names, "_fields"])
        rows = rows.drop("_source")
        if source != REPLICATOR:
            rows = rows.withColumns({"_revision": F.lit(1), "_modified": F.lit(W.now_ms())})
        for before, _ in self.db.processors.get(self.name, []):
            rows = before(rows)
        return rows.withColumn("_id", F.col("_id").cast("bigint"))

    def insert(self, documents: list[dict[str, Any]] | dict[str, Any] | DataFrame, source: str | None = None) -> list[int]:
        """Add documents; the ids, for a DataFrame none. All or nothing."""
        part = self._write(self._prepared(documents, source))

        def write() -> None:
            fresh = self._read_part(part)
            self._check(fresh)
            meta, schema = self._with_part(self.meta, part, fresh.schema)
            meta.parts = [*meta.parts, part]
            self._commit(meta, [(S.aligned(fresh, schema), "insert")], source)

        self.db.retried(write)
        return [] if isinstance(documents, DataFrame) else [r[0] for r in self._read_part(part).select("_id").collect()]  # as many as were given

    def _touched(self, node: Filter) -> list[str]:
        """The parts that hold matches."""
        parts = self.meta.parts
        if len(parts) < 2:
            return parts
        rows = self.raw(named=True)
        hit = rows.filter(W.matching(rows, node, self.context().present)).select("_part").distinct().collect()  # a name for each part at most
        return sorted((r[0] for r in hit), key=parts.index)

    def _rewrite(self, touched: list[str], rows: DataFrame) -> tuple[str, DataFrame, list[str]]:
        """Rows written in place of some parts: the new part, its rows, and the parts that stay."""
        part = self._write(rows)
        return part, self._read_part(part), [p for p in self.meta.parts if p not in touched]

    def update(self, node: Filter, document: dict[str, Any], just_once: bool = False, insert_if_absent: bool = False, source: str | None = None) -> int:
        """Merge a document into the matching ones; how many there were."""
        changes_ = {k: v for k, v in document.items() if k not in ("_id", "_revision", "_modified", "_source")}

        def write() -> int:
            touched = self._touched(node)
            rows = self.raw(touched)
            hits = rows.filter(W.matching(rows, node, self.context().present))
            n = hits.count() if touched else 0
            if not n:
                return 0
            if just_once:
                first = hits.agg(F.min("_id")).first()[0]
                target: Filter = by_id(first)
                touched, n = self._touched(target), 1
                rows = self.raw(touched)
            else:
                target = node
            if not changes_:
                return n
            # Values of a new kind widen their columns first.
            wide = S.merge_rows(rows.schema, T.StructType([T.StructField(k, S.type_of([v])) for k, v in changes_.items() if not isinstance(v, Column)]))
            rows = S.aligned(rows, wide)
            before = rows.filter(W.matching(rows, target, self.context().present)).select(F.col("_id").alias("_hit_id"))
            part, fresh, kept = self._rewrite(touched, W.merged(rows, target, document, present=self.context().present))
            meta, schema = self._with_part(self.meta, part, fresh.schema, kept)
            self._check_unique(fresh, self.raw(kept) if kept else None)
            changed = S.aligned(fresh, schema).join(before, F.col("_id") == F.col("_hit_id"), "left_semi")
            self._commit(meta, [(changed, "update")], source)
            return n

        n = self.db.retried(write)
        if not n and insert_if_absent:
            return len(self.insert({k: v for k, v in document.items() if k != "_id"}, source))
        return n

    def update_with_ids(self, node: Filter, document: dict[str, Any], just_once: bool = False) -> list[int]:
        """As `update`; the ids of the documents that it changed, for a bounded number of them."""
        rows = self.raw()
        ids = sorted(r[0] for r in rows.filter(W.matching(rows, node, self.context().present)).select("_id").collect())
        ids = ids[:1] if just_once else ids
        return ids if self.update(field_("_id").in_array(ids), document) else []

    def update_one(self, document: dict[str, Any], insert_if_absent: bool = False) -> int:
        if document.get("_id") is None:
            if insert_if_absent:
                return len(self.insert(document))
            raise ConstraintError("a document without id can't be updated")
        n = self.update(by_id(document["_id"]), document)
        return n or (len(self.insert(document)) if insert_if_absent else 0)

    def update_by_id(self, id_: int, document: dict[str, Any], insert_if_absent: bool = False) -> int:
        return self.update_one({**document, "_id": id_}, insert_if_absent)

    def remove(self, node: Filter, just_once: bool = False, source: str | None = None) -> int:
        if just_once and isinstance(node, All):
            raise ConstraintError("removing one of all rows is not defined")

        def write() -> int:
            touched = self._touched(node)
            rows = self.raw(touched)
            hit = W.matching(rows, node, self.context().present)
            if just_once and touched:
                first = rows.filter(hit).agg(F.min("_id")).first()[0]
                hit = F.col("_id").eqNullSafe(F.lit(first))
                touched = self._touched(by_id(first)) if first is not None else []
                rows = self.raw(touched)
            gone = rows.filter(hit)
            n = gone.count() if touched else 0
            if n:
                part, fresh, kept = self._rewrite(touched, rows.filter(~hit))
                meta, _ = self._with_part(self.meta, part, fresh.schema, kept)
                self._commit(meta, [(gone.withColumn("_revision", F.col("_revision") + 1) if "_revision" in gone.columns else gone, "remove")], source)
            return n

        return self.db.retried(write)

    def remove_one(self, document: dict[str, Any]) -> int:
        if document.get("_id") is None:
            raise ConstraintError("a document without id can't be removed")
        return self.remove(by_id(document["_id"]))

    def clear(self) -> None:
        def write() -> None:
            meta = self.meta
            meta.parts, meta.narrow = [], {}
            self.db.commit({self.name: meta})

        self.db.retried(write)

    def drop(self) -> None:
        self.db.retried(lambda: self.db.destroy(self.name))

    dispose = drop

    def replace(self, rows: DataFrame) -> None:
        """Other rows in place of all."""
        part, fresh, _ = self._rewrite(self.meta.parts, rows)
        meta, _ = self._with_part(self.meta, part, fresh.schema, [])
        self.db.commit({self.name: meta})

    # A text index is a table beside each part; others are constraints and entries of the catalog, and layout serves reads.
    def indexes(self) -> list[Index]:
        return [Index(**i) for i in self.meta.indexes]

    def has_index(self, fields: list[str]) -> bool:
        return any(i.fields == fields for i in self.indexes())

    def create_index(self, fields: list[str], kind: str = "non_unique", **options: Any) -> None:
        for i in self.indexes():
            if i.fields == fields:
                if i.kind != kind:
                    raise ConstraintError(f"{fields} has an index of kind {i.kind}")
                return
        if kind == "unique" and not W.violations(self.raw(), fields).isEmpty():
            raise ConstraintError(f"{fields} is not unique")
        index = Index(kind, fields, options)
        self._event("index_start", None, None)

        def write() -> None:
            for part in self.meta.parts if kind in INDEXERS else ():
                self._index(part, index)
            meta = self.meta
            meta.indexes = [*meta.indexes, asdict(index)]
            self.db.commit({self.name: meta})

        self.db.retried(write)
        self._event("index_end", None, None)

    def drop_index(self, fields: list[str]) -> None:
        meta = self.meta
        meta.indexes = [i for i in meta.indexes if i["fields"] != fields]
        self.db.commit({self.name: meta})

    def rebuild_index(self, fields: list[str]) -> None:
        """Check the constraint anew and lay the rows out by the index's fields."""
        index = next((i for i in self.indexes() if i.fields == fields), None)
        if index is None:
            raise ConstraintError(f"no index on {fields}")
        rows = self.raw()
        if index.kind == "unique" and not W.violations(rows, fields).isEmpty():
            raise ConstraintError(f"{fields} is not unique")
        self._event("index_start", None, None)
        self.db.retried(lambda: self.replace(self._laid_out(index, self.raw())))
        self._event("index_end", None, None)

    def _laid_out(self, index: Index, rows: DataFrame) -> DataFrame:
        """Rows in ranges of the index's fields, of places along a Hilbert curve, so that files and row groups hold neighbours."""
        found = [f for f in (resolve(rows.schema, f, separator=self.db.separator) for f in index.fields) if f.known]
        keys = [f.column for f in found if not isinstance(f.type, (T.ArrayType, T.MapType, T.VariantType, T.StructType))]
        place = Stored.of(found[0].column, found[0].type) if index.kind == "spatial" and found else None
        if place is not None:
            x, y = (place.min_x + place.max_x) / 2, (place.min_y + place.max_y) / 2
            box = rows.agg(F.min(x), F.min(y), F.max(x), F.max(y)).first()
            if None in box:
                return rows
            keys = [hilbert_index(x, y, tuple(box))]
        if not keys:
            return rows
        names = [f"_key{i}" for i in range(len(keys))]
        keyed = rows.withColumns(dict(zip(names, keys, strict=True)))
        return keyed.repartitionByRange(*names).sortWithinPartitions(*names).drop(*names)

    # Events.
    def subscribe(self, listener: Callable[[dict[str, Any]], None]) -> Callable[[dict[str, Any]], None]:
        self.db.listeners.setdefault(self.name, []).append(listener)
        return listener

    def unsubscribe(self, listener: Callable[[dict[str, Any]], None]) -> None:
        self.db.listeners.get(self.name, []).remove(listener)

    def _event(self, kind: str, source: str | None, rows: DataFrame | None) -> None:
        """Tell listeners; `rows` is the lazy frame of the items."""
        for f in self.db.listeners.get(self.name, []):
            f({"kind": kind, "collection": self.name, "rows": rows, "at_ms": W.now_ms(), "originator": source or self.name})

    def _commit(self, meta: Meta, events: list[tuple[DataFrame, str]], source: str | None) -> None:
        """Commit an entry of the catalog with its change events, which lie written before."""
        if self.db.pending is not None:
            self.db.commit({self.name: meta})
            self.db.pending += [(self.name, rows, kind, source or self.name) for rows, kind in events]
            return
        names = [self.write_events(rows, kind, source) for rows, kind in events]
        self.db.commit({self.name: meta}, names)
        for rows, kind in events:
            self._event(kind, source, rows)

    def write_events(self, rows: DataFrame, kind: str, source: str | None) -> str:
        name = uuid.uuid4().hex
        shown = [c for c in rows.columns if c != "_fields"]
        log = rows.select(
            F.lit(time.time_ns()).alias("seq"), F.lit(self.name).alias("collection"), F.lit(kind).alias("kind"), "_id",
            F.to_json(F.struct(*[F.col(f"`{c}`") for c in shown])).alias("document"),
            F.lit(W.now_ms()).alias("at_ms"), F.lit(source or self.name).alias("originator"),
        )
        changes.append(log, f"{self.db.root}/events/{name}")
        return name

    # Parts.
    def _write(self, rows: DataFrame) -> str:
        """A new part with its text indexes."""
        part = uuid.uuid4().hex
        rows.write.option("compression", "zstd").parquet(f"{self.db.root}/data/{part}")
        for index in self.indexes():
            if index.kind in INDEXERS:
                self._index(part, index)
        return part

    def _index_path(self, part: str, index: Index) -> str:
        return f"{self.db.root}/index/{part}/{uuid.uuid5(uuid.NAMESPACE_OID, index.name).hex}"

    def _index(self, part: str, index: Index) -> None:
        if not self.db.files.names(f"index/{part}/{self._index_path(part, index).rpartition('/')[2]}"):
            INDEXERS[index.kind].build(self._read_part(part), index.fields[0], "_id", self._index_path(part, index), index.options)

    def _read_part(self, part: str) -> DataFrame:
        return self.db.spark.read.parquet(f"{self.db.root}/data/{part}")

    def _with_part(self, meta: Meta, part: str, stored: T.StructType, kept: list[str] | None = None) -> tuple[Meta, T.StructType]:
        """`meta` with types that hold a new part's; with `kept`, of these parts and the new one."""
        old = self.schema() if meta.schema and (kept is None or kept) else stored
        schema = S.merge_rows(old, stored)
        narrow = dict(meta.narrow)
        for p in meta.parts if kept is None else kept:
            if p not in narrow and not S.readable_as(old, schema):
                narrow[p] = old.json()
        if not S.readable_as(stored, schema):
            narrow[part] = stored.json()
        if kept is not None:
            meta.parts = [*kept, part]
            narrow = {p: x for p, x in narrow.items() if p in meta.parts}
        meta.schema, meta.narrow = schema.json(), narrow
        return meta, schema

    def _check(self, fresh: DataFrame) -> None:
        ids = fresh.groupBy("_id").count().filter("count > 1 OR _id IS NULL")
        if not ids.isEmpty():
            raise ConstraintError("two documents have one id")
        if not self.meta.parts:
            return self._check_unique(fresh)
        old = self.raw()
        if not fresh.select("_id").join(old.select(F.col("_id").alias("_old")), F.col("_id") == F.col("_old"), "left_semi").isEmpty():
            raise ConstraintError("a document with this id exists")
        return self._check_unique(fresh, old)

    def _check_unique(self, fresh: DataFrame, old: DataFrame | None = None) -> None:
        if old is not None:
            wide = S.merge_rows(old.schema, fresh.schema)
            fresh, old = S.aligned(fresh, wide), S.aligned(old, wide)
        for i in self.indexes():
            if i.kind != "unique":
                continue
            keys = W.index_keys(fresh, i.fields)
            if not keys.groupBy("k").count().filter("count > 1").isEmpty():
                raise ConstraintError(f"{i.fields} is not unique")
            if old is not None and not keys.join(W.index_keys(old, i.fields).select(F.col("k").alias("o")), F.col("k").eqNullSafe(F.col("o")), "left_semi").isEmpty():
                raise ConstraintError(f"{i.fields} is not unique")


class Transaction:
    """Writes to any collections that become visible together, or not at all."""

    def __init__(self, db: Database):
        self.base = db
        self.db = Database.__new__(Database)
        self.db.__dict__.update(db.__dict__)
        self.db.pending = []
        self.db.commit = self._stage  # type: ignore[method-assign]
        self.changed: dict[str, Meta | None] = {}
        self.state = "active"

    def _stage(self, changed: dict[str, Meta | None], events: list[str] | None = None, **_: Any) -> None:
        if self.state != "active":
            raise RuntimeError(f"the transaction is {self.state}")
        collections = dict(self.db.state["collections"])
        for name, meta in changed.items():
            if meta is None:
                collections.pop(name, None)
            else:
                collections[name] = asdict(meta)
        self.db.state = {**self.db.state, "collections": collections}
        self.changed |= changed

    def collection(self, name: str) -> Collection:
        return self.db.collection(name)

    def commit(self) -> None:
        """Publish all staged changes as one version; fails if another writer came first."""
        if self.state != "active":
            raise RuntimeError(f"the transaction is {self.state}")
        if self.base.version != self.db.version:
            self.state = "failed"
            raise Conflict("another writer committed first")
        told = self.db.pending or []
        events = [self.base.collection(name).write_events(rows, kind, source) for name, rows, kind, source in told]
        self.base.commit(self.changed, events)
        self.state = "committed"
        for name, rows, kind, source in told:
            self.base.collection(name)._event(kind, source, rows)

    def rollback(self) -> None:
        """Staged folders are left to `compact`."""
        self.state = "rolled back"
        self.changed = {}

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_: Any) -> None:
        if self.state == "active":
            self.rollback() if kind else self.commit()


__all__ = ["Collection", "Conflict", "ConstraintError", "Database", "Index", "Transaction", "all_", "field_"]
