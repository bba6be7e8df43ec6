"""The catalog: one manifest per committed state.

A manifest names each table's columns, constraints and folders, and the views and
indexes. Committing state n+1 means creating the file of that number, which only
one writer can do: the first committer wins, and readers always see a whole state.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql.types import StructField, StructType

from ..plans.ast import ColumnDef, ForeignKey
from ..types import data_type
from .storage import Storage


class Conflict(RuntimeError):
    """Another transaction committed first."""


@dataclass
class TableInfo:
    name: str
    columns: list[ColumnDef]
    primary_key: list[str] = field(default_factory=list)
    unique: dict[str, list[str]] = field(default_factory=dict)
    foreign_keys: list[ForeignKey] = field(default_factory=list)
    folders: list[str] = field(default_factory=list)

    @property
    def schema(self) -> StructType:
        return StructType([StructField(c.name, data_type(c.type)) for c in self.columns])

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def column(self, name: str) -> ColumnDef:
        for c in self.columns:
            if c.name == name:
                return c
        raise ValueError(f"unknown column: {self.name}.{name}")

    @property
    def required(self) -> set[str]:
        return {c.name for c in self.columns if c.not_null or c.primary_key} | set(self.primary_key)


@dataclass
class Manifest:
    number: int = 0
    tables: dict[str, TableInfo] = field(default_factory=dict)
    views: dict[str, str] = field(default_factory=dict)
    indexes: dict[str, dict] = field(default_factory=dict)

    def children(self, parent: str) -> list[tuple[TableInfo, ForeignKey]]:
        return [(t, fk) for t in self.tables.values() for fk in t.foreign_keys if fk.parent == parent]

    def sort_columns(self, table: str) -> list[str]:
        """The first column of the table's first index, else of its key."""
        for index in self.indexes.values():
            if index["table"] == table:
                return index["columns"][:1]
        return self.tables[table].primary_key[:1]

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1)

    @staticmethod
    def from_json(text: str) -> Manifest:
        raw = json.loads(text)
        tables = {}
        for name, t in raw["tables"].items():
            t["columns"] = [ColumnDef(**c) for c in t["columns"]]
            t["foreign_keys"] = [ForeignKey(**f) for f in t["foreign_keys"]]
            tables[name] = TableInfo(**t)
        return Manifest(raw["number"], tables, raw["views"], raw["indexes"])


class Catalog:
    def __init__(self, storage: Storage):
        self.storage = storage
        self.folder = f"{storage.warehouse}/_manifests"

    def latest(self) -> Manifest:
        names = [n for n in self.storage.names(self.folder) if n.endswith(".json")]
        return Manifest.from_json(self.storage.read_text(f"{self.folder}/{names[-1]}")) if names else Manifest()

    def commit(self, change: Callable[[Manifest], None]) -> Manifest:
        """Apply *change* to the latest state and publish it.

        *change* may raise :class:`Conflict`; it runs again if another writer
        publishes in between.
        """
        while True:
            manifest = copy.deepcopy(self.latest())
            change(manifest)
            manifest.number += 1
            if self.storage.create_text(f"{self.folder}/{manifest.number:012d}.json", manifest.to_json()):
                return manifest

    def vacuum(self) -> int:
        """Delete table folders and manifests that the latest state doesn't name."""
        manifest = self.latest()
        used = {f.rsplit("/", 1)[-1] for t in manifest.tables.values() for f in t.folders}
        gone = 0
        for table in self.storage.names(self.storage.warehouse):
            if table.startswith("_"):
                continue
            for folder in self.storage.names(f"{self.storage.warehouse}/{table}"):
                if folder not in used:
                    self.storage.delete(f"{self.storage.warehouse}/{table}/{folder}")
                    gone += 1
        for name in self.storage.names(self.folder)[:-1]:
            self.storage.delete(f"{self.folder}/{name}")
        return gone
