"""Engine and sessions: statements of the dialect over a warehouse of snapshots."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .constraints import check_unique
from .dml import Work
from .plans import Lowering, ast, explain_text, parse
from .plans.lower import quoted
from .sources import Catalog, Conflict, Storage, TableInfo
from .types import data_type, store_cast


class EngineError(RuntimeError):
    pass


class Result:
    """What a statement gives: rows as a lazy DataFrame (if any) and a status line."""

    def __init__(self, status: str | None, df: DataFrame | None = None, count: int | None = None):
        self._status, self.df, self.count = status, df, count

    @property
    def status(self) -> str:
        """``SELECT n`` counts the rows when it is asked for."""
        return self._status if self._status is not None else f"SELECT {self.df.count()}"

    def rows(self) -> list[tuple]:
        return [] if self.df is None else [tuple(r) for r in self.df.collect()]


class Engine:
    """A warehouse. ``session()`` gives independent sessions; ``sql`` uses one of its own."""

    def __init__(self, spark: SparkSession, warehouse: str):
        self.spark = spark
        self.storage = Storage(spark, warehouse)
        self.catalog = Catalog(self.storage)
        self._session: Session | None = None

    def session(self) -> Session:
        return Session(self)

    def sql(self, text: str, params: Sequence[Any] = ()) -> Result:
        self._session = self._session or self.session()
        return self._session.sql(text, params)

    def compact(self, table: str) -> None:
        """Write *table* as one folder; of use after many small INSERTs."""
        work = Work(self.storage, self.catalog.latest())
        before = work.at(table)
        if len(before) < 2:
            return
        folder = self.storage.write(table, work.read(table), work.manifest.sort_columns(table))

        def change(m) -> None:
            if table not in m.tables or m.tables[table].folders != before:
                raise Conflict(f"Transaction Aborted: '{table}' was changed by another transaction")
            m.tables[table].folders = [folder]

        self.catalog.commit(change)

    def register(self, name: str, df: DataFrame) -> None:
        """Create the table *name* from a DataFrame, without constraints.

        Decimals are refused: the dialect's DECIMAL is a double, so the caller decides
        by a cast what is lost.
        """
        kinds = {"boolean": "BOOLEAN", "tinyint": "TINYINT", "smallint": "SMALLINT", "int": "INTEGER", "bigint": "BIGINT", "float": "DOUBLE", "double": "DOUBLE", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "date": "DATE"}
        columns = [ast.ColumnDef(c, kinds.get(t, "")) for c, t in df.dtypes]
        if unknown := [c.name for c in columns if not c.type]:
            raise ValueError(f"columns of types the dialect doesn't have: {unknown}")
        df = df.select(*[F.col(quoted(c.name)).cast(data_type(c.type)).alias(c.name) for c in columns])
        folder = self.storage.write(name, df)

        def change(m) -> None:
            if name in m.tables or name in m.views:
                raise EngineError(f"table already exists: {name}")
            m.tables[name] = TableInfo(name, columns, folders=[folder])

        self.catalog.commit(change)


class _Transaction:
    def __init__(self, engine: Engine):
        self.manifest = engine.catalog.latest()
        self.folders: dict[str, list[str]] = {}
        self.touched: set[str] = set()
        self.savepoints: list[tuple[str, dict[str, list[str]]]] = []
        self.poisoned = False


class Session:
    """One client. Statements outside BEGIN commit by themselves.

    Reads see the state at BEGIN plus the session's own writes. COMMIT fails if
    another session has committed to a table that this one wrote or checked.
    An error inside a transaction poisons it: only ROLLBACK, ROLLBACK TO and COMMIT
    (which then rolls back) are taken after it.
    """

    def __init__(self, engine: Engine):
        self.engine, self.spark = engine, engine.spark
        self.transaction: _Transaction | None = None

    def close(self) -> None:
        """An open transaction is rolled back."""
        self.transaction = None

    def sql(self, text: str, params: Sequence[Any] = ()) -> Result:
        try:
            statement = parse(text)
            if isinstance(statement, ast.Transaction):
                return self._control(statement)
            if self.transaction and self.transaction.poisoned:
                raise EngineError("current transaction is aborted, commands are ignored until it ends")
            return self._run(statement, params)
        except Exception:
            if self.transaction:
                self.transaction.poisoned = True
            raise

    # -- transactions

    def _control(self, t: ast.Transaction) -> Result:
        active = self.transaction
        if t.action == "BEGIN":
            if active:
                raise EngineError("Transaction already in progress")
            self.transaction = _Transaction(self.engine)
            return Result("BEGIN")
        if t.action == "ROLLBACK":
            self.transaction = None
            return Result("ROLLBACK")
        if t.action == "COMMIT":
            self.transaction = None
            if active is None:
                return Result("COMMIT")
            if active.poisoned:
                return Result("ROLLBACK")
            self._publish(active)
            return Result("COMMIT")
        if active is None:
            raise EngineError(f"{t.action.split()[0]} needs a transaction")
        if t.action == "SAVEPOINT":
            if active.poisoned:
                raise EngineError("current transaction is aborted, commands are ignored until it ends")
            active.savepoints.append((t.name, dict(active.folders)))
            return Result("SAVEPOINT")
        at = next((i for i in reversed(range(len(active.savepoints))) if active.savepoints[i][0] == t.name), None)
        if at is None:
            raise EngineError(f"no such savepoint: {t.name}")
        if t.action == "ROLLBACK TO":
            active.folders, active.poisoned = active.savepoints[at][1], False
        # Released or rolled back to, a savepoint and all later ones are gone.
        del active.savepoints[at:]
        return Result("ROLLBACK" if t.action == "ROLLBACK TO" else "RELEASE")

    def _publish(self, t: _Transaction) -> None:
        if not t.folders:
            return

        def change(m) -> None:
            for name in t.touched | set(t.folders):
                before, now = t.manifest.tables.get(name), m.tables.get(name)
                if now is None or before is None or now.folders != before.folders:
                    raise Conflict(f"Transaction Aborted: '{name}' was changed by another transaction")
            for name, folders in t.folders.items():
                m.tables[name].folders = folders

        self.engine.catalog.commit(change)

    # -- statements

    def _lowering(self, work: Work, params: Sequence[Any]) -> Lowering:
        views = work.manifest.views
        return Lowering(self.spark, lambda n: work.read(n) if n in work.manifest.tables else None, lambda n: parse(views[n]) if n in views else None, params)

    def _run(self, statement: Any, params: Sequence[Any]) -> Result:
        if isinstance(statement, ast.CreateTable | ast.CreateIndex | ast.CreateView | ast.Drop):
            return self._define(statement)
        active = self.transaction or _Transaction(self.engine)
        if self.transaction:
            # Tables defined since BEGIN are there too; definitions aren't transactional.
            for name, info in self.engine.catalog.latest().tables.items():
                active.manifest.tables.setdefault(name, info)
        work = Work(self.engine.storage, active.manifest, active.folders, set(active.touched))
        lowering = self._lowering(work, params)
        if isinstance(statement, ast.Query):
            return Result(None, lowering.query(statement))
        if isinstance(statement, ast.Explain):
            return self._explain(statement.statement, work, lowering)
        result = self._change(statement, work, lowering)
        active.folders, active.touched = work.folders, work.touched
        if not self.transaction:
            self._publish(active)
        return result

    def _change(self, s: Any, work: Work, lowering: Lowering) -> Result:
        if isinstance(s, ast.Insert):
            work.insert(s.table, self._values(s, work, lowering))
            return Result(f"INSERT 0 {len(s.rows)}", count=len(s.rows))
        df = work.read(s.table)
        condition = lowering.expr(s.where, df) if s.where is not None else None
        if isinstance(s, ast.Update):
            n = work.update(s.table, {c: lowering.expr(e, df) for c, e in s.assignments}, condition)
            return Result(f"UPDATE {n}", count=n)
        n = work.delete(s.table, condition)
        return Result(f"DELETE {n}", count=n)

    def _values(self, s: ast.Insert, work: Work, lowering: Lowering) -> DataFrame:
        info = work.info(s.table)
        for row in s.rows:
            if len(row) != len(info.columns):
                raise EngineError(f"INSERT has {len(row)} values for {len(info.columns)} columns of '{s.table}'")
        structs = [F.struct(*[store_cast(lowering.expr(e, None), c.type, c.length).alias(c.name) for e, c in zip(row, info.columns, strict=True)]) for row in s.rows]
        return self.spark.range(1, numPartitions=1).select(F.inline(F.array(*structs)))

    def _explain(self, s: Any, work: Work, lowering: Lowering) -> Result:
        """The plan as one row; nothing is run or changed."""
        if isinstance(s, ast.Query):
            text = explain_text(lowering.query(s))
        elif isinstance(s, ast.Insert):
            text = f"Insert [{s.table}]\n" + explain_text(self._values(s, work, lowering))
        elif isinstance(s, ast.Update | ast.Delete):
            df = work.read(s.table)
            rows = df if s.where is None else df.where(lowering.expr(s.where, df))
            text = f"{type(s).__name__} [{s.table}]\n" + explain_text(rows)
        else:
            raise EngineError("Unsupported statement type")
        return Result("EXPLAIN", self.spark.createDataFrame([(text,)], "EXPLAIN string"))

    def append(self, table: str, df: DataFrame) -> None:
        """INSERT the rows of a DataFrame, by position, under all constraints."""
        active = self.transaction or _Transaction(self.engine)
        work = Work(self.engine.storage, active.manifest, active.folders, set(active.touched))
        info = work.info(table)
        if len(df.columns) != len(info.columns):
            raise EngineError(f"INSERT has {len(df.columns)} values for {len(info.columns)} columns of '{table}'")
        work.insert(table, df.select(*[store_cast(F.col(quoted(name)), c.type, c.length).alias(c.name) for name, c in zip(df.columns, info.columns, strict=True)]))
        active.folders, active.touched = work.folders, work.touched
        if not self.transaction:
            self._publish(active)

    # -- definitions

    def _define(self, s: Any) -> Result:
        catalog, storage = self.engine.catalog, self.engine.storage
        if isinstance(s, ast.CreateTable):
            info = self._table_info(s)

            def change(m) -> None:
                if s.name in m.tables or s.name in m.views:
                    raise EngineError(f"table already exists: {s.name}")
                for fk in s.foreign_keys:
                    info.column(fk.column)
                    parent = info if fk.parent == s.name else m.tables.get(fk.parent)
                    if parent is None:
                        raise EngineError(f"unknown table: {fk.parent}")
                    parent.column(fk.parent_column)
                m.tables[s.name] = info

            catalog.commit(change)
            return Result("CREATE TABLE")
        if isinstance(s, ast.CreateView):

            def change(m) -> None:
                if s.name in m.tables or s.name in m.views:
                    raise EngineError(f"table already exists: {s.name}")
                m.views[s.name] = s.text

            catalog.commit(change)
            return Result("CREATE VIEW")
        if isinstance(s, ast.CreateIndex):

            def change(m) -> None:
                if s.name in m.indexes:
                    raise EngineError(f"index already exists: {s.name}")
                if s.table not in m.tables:
                    raise EngineError(f"unknown table: {s.table}")
                info = m.tables[s.table]
                for c in s.columns:
                    info.column(c)
                if s.unique:
                    check_unique(storage.read(info.folders, info.schema), s.columns, s.name)
                    info.unique[s.name] = list(s.columns)
                m.indexes[s.name] = {"table": s.table, "columns": list(s.columns), "unique": s.unique}

            catalog.commit(change)
            return Result("CREATE INDEX")

        def change(m) -> None:
            known = {"TABLE": m.tables, "INDEX": m.indexes, "VIEW": m.views}[s.kind]
            if s.name not in known:
                raise EngineError(f"unknown {s.kind.lower()}: {s.name}")
            if s.kind == "TABLE":
                users = [t.name for t, _ in m.children(s.name) if t.name != s.name]
                if users:
                    raise EngineError(f"cannot drop '{s.name}': referenced by {', '.join(sorted(users))}")
                for name in [n for n, i in m.indexes.items() if i["table"] == s.name]:
                    del m.indexes[name]
            elif s.kind == "INDEX":
                m.tables[m.indexes[s.name]["table"]].unique.pop(s.name, None)
            del known[s.name]

        catalog.commit(change)
        if self.transaction and s.kind == "TABLE":
            self.transaction.manifest.tables.pop(s.name, None)
            self.transaction.folders.pop(s.name, None)
        return Result(f"DROP {s.kind}")

    def _table_info(self, s: ast.CreateTable) -> TableInfo:
        names = [c.name for c in s.columns]
        if len(set(names)) < len(names):
            raise EngineError("column names must differ")
        for c in s.columns:
            data_type(c.type)
        unique = {f"unique_{s.name}_{c.name}": [c.name] for c in s.columns if c.unique}
        info = TableInfo(s.name, list(s.columns), list(s.primary_key), unique, list(s.foreign_keys))
        for c in info.primary_key:
            info.column(c)
        return info
