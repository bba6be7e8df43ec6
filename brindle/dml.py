"""INSERT, UPDATE and DELETE over immutable snapshots, with foreign key actions.

A statement works on a private map from tables to folders. Nothing it reads ever
changes under it, so cascades can go on reading the rows as they were.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .constraints import ConstraintError, check_new_keys, check_not_null, check_parents, check_unique
from .plans.ast import ForeignKey
from .sources import Manifest, Storage, TableInfo
from .types import store_cast


class Work:
    """The state that a statement or transaction sees and changes."""

    def __init__(self, storage: Storage, manifest: Manifest, folders: dict[str, list[str]] | None = None, touched: set[str] | None = None):
        self.storage, self.manifest = storage, manifest
        self.folders = dict(folders or {})
        #: Tables whose rows a decision rested on.
        self.touched = touched if touched is not None else set()

    def info(self, table: str) -> TableInfo:
        if table not in self.manifest.tables:
            raise ValueError(f"unknown table: {table}")
        return self.manifest.tables[table]

    def at(self, table: str) -> list[str]:
        return self.folders.get(table, self.info(table).folders)

    def read(self, table: str) -> DataFrame:
        return self.storage.read(self.at(table), self.info(table).schema)

    def _write(self, table: str, df: DataFrame) -> str:
        return self.storage.write(table, df, self.manifest.sort_columns(table))

    # -- statements

    def insert(self, table: str, rows: DataFrame) -> None:
        """Append *rows*, which have the table's columns in order, already cast."""
        info = self.info(table)
        folder = self._write(table, rows)
        new, old = self.storage.read([folder], info.schema), self.read(table)
        self.touched.add(table)
        check_not_null(new, table, sorted(info.required))
        for name, columns in self._keys(info).items():
            check_new_keys(new, old, columns, name)
        self.folders[table] = [*self.at(table), folder]
        for fk in info.foreign_keys:
            self._check_child(info, fk, new)

    def update(self, table: str, assignments: dict[str, Column], condition: Column | None) -> int:
        info = self.info(table)
        for column in assignments:
            info.column(column)
        hit = F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))
        old = self.read(table)
        count = old.where(hit).count()
        if not count:
            return 0
        casts = {c: store_cast(v, info.column(c).type, info.column(c).length) for c, v in assignments.items()}

        def changed(df: DataFrame) -> DataFrame:
            return df.select(*[F.when(hit, casts[c]).otherwise(F.col(c)).alias(c) if c in casts else F.col(c) for c in info.names])

        moves = {}
        for _, fk in self.manifest.children(table):
            if fk.parent_column in casts:
                key = fk.parent_column
                moved = old.where(hit).select(F.col(key).alias("__old"), casts[key].alias("__new")).where("__old is not null and not (__old <=> __new)")
                moves[key] = moved.distinct()
        self._rewrite(table, hit, changed)
        self._check_changed(info, list(casts))
        for child, fk in self.manifest.children(table):
            if fk.parent_column in moves:
                self._parent_updated(child, fk, moves[fk.parent_column])
        return count

    def delete(self, table: str, condition: Column | None) -> int:
        hit = F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))
        doomed = self.read(table).where(hit)
        count = doomed.count()
        if count:
            self._rewrite(table, hit, lambda df: df.where(~hit))
            self._parents_deleted(table, doomed)
        return count

    # -- parts

    def _keys(self, info: TableInfo) -> dict[str, list[str]]:
        keys = dict(info.unique)
        if info.primary_key:
            keys[f"pk_{info.name}"] = info.primary_key
        return keys

    def _rewrite(self, table: str, hit: Column, change: Callable[[DataFrame], DataFrame]) -> None:
        """Write anew those folders of *table* that hold rows with *hit*."""
        self.touched.add(table)
        info = self.info(table)
        # Which folders these are is told by one job, a name for each.
        folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        names = {r[0] for r in self.storage.read(self.at(table), info.schema).where(hit).select(folder).distinct().collect()} if self.at(table) else set()
        stale = [f for f in self.at(table) if f.rsplit("/", 1)[-1] in names]
        kept = [f for f in self.at(table) if f not in stale]
        if stale:
            kept.append(self._write(table, change(self.storage.read(stale, info.schema))))
        self.folders[table] = kept

    def _replace(self, table: str, df: DataFrame) -> None:
        self.touched.add(table)
        self.folders[table] = [self._write(table, df)]

    def _check_changed(self, info: TableInfo, columns: Sequence[str]) -> None:
        new = self.read(info.name)
        check_not_null(new, info.name, sorted(info.required & set(columns)))
        for name, key in self._keys(info).items():
            if set(key) & set(columns):
                check_unique(new, key, name)
        for fk in info.foreign_keys:
            if fk.column in columns:
                self._check_child(info, fk, new)

    def _check_child(self, info: TableInfo, fk: ForeignKey, rows: DataFrame) -> None:
        self.touched.add(fk.parent)
        check_parents(rows, fk.column, self.read(fk.parent), fk.parent_column, info.name, fk.parent)

    def _parents_deleted(self, table: str, doomed: DataFrame) -> None:
        """Act on the children of deleted rows, then on theirs, until none is left."""
        frontier = [(table, doomed)]
        while frontier:
            parent, gone = frontier.pop(0)
            for child, fk in self.manifest.children(parent):
                keys = gone.select(F.col(fk.parent_column).alias("__key")).dropna().distinct()
                old = self.read(child.name)
                hit = old.join(keys, old[fk.column] == F.col("__key"), "left_semi")
                if hit.isEmpty():
                    continue
                if fk.on_delete == "RESTRICT":
                    raise ConstraintError(f"Constraint Violation: rows of '{child.name}' still refer to '{parent}' (fk_{child.name}_{parent}, RESTRICT)")
                if fk.on_delete == "CASCADE":
                    # Written, so that the next level doesn't compute all levels before it again.
                    folder = self._write(child.name, hit)
                    self._replace(child.name, old.join(keys, old[fk.column] == F.col("__key"), "left_anti"))
                    frontier.append((child.name, self.storage.read([folder], child.schema)))
                else:
                    self._move(child, fk, keys.withColumn("__new", F.lit(None).cast(old.schema[fk.column].dataType)).withColumnRenamed("__key", "__old"))

    def _parent_updated(self, child: TableInfo, fk: ForeignKey, moved: DataFrame) -> None:
        if self.read(child.name).join(moved, F.col(fk.column) == F.col("__old"), "left_semi").isEmpty():
            return
        if fk.on_update == "RESTRICT":
            raise ConstraintError(f"Constraint Violation: rows of '{child.name}' still refer to '{fk.parent}' (fk_{child.name}_{fk.parent}, RESTRICT)")
        if fk.on_update == "SET NULL":
            moved = moved.withColumn("__new", F.lit(None).cast(moved.schema["__new"].dataType))
        self._move(child, fk, moved)

    def _move(self, child: TableInfo, fk: ForeignKey, moved: DataFrame) -> None:
        """Change a child's references from __old to __new, and what refers to those."""
        old = self.read(child.name)
        met = old.join(moved.withColumn("__hit", F.lit(True)), old[fk.column] == F.col("__old"), "left")
        new = [F.when(F.col("__hit"), F.col("__new")).otherwise(F.col(c)).cast(old.schema[c].dataType).alias(c) if c == fk.column else F.col(c) for c in child.names]
        self._replace(child.name, met.select(*new))
        self._check_changed(child, [fk.column])
        for grandchild, further in self.manifest.children(child.name):
            if further.parent_column == fk.column:
                self._parent_updated(grandchild, further, moved)
