"""A DB-API 2.0 facade over the engine, in process.

The connection follows the engine's autocommit: statements commit by themselves
unless BEGIN was sent. As a context manager it commits, or rolls back on an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql import SparkSession

from .engine import Engine, Result, Session
from .session import get_session

apilevel = "2.0"
threadsafety = 1
paramstyle = "qmark"


class Warning(Exception):  # noqa: A001
    pass


class Error(Exception):
    pass


class InterfaceError(Error):
    pass


class DatabaseError(Error):
    pass


class DataError(DatabaseError):
    pass


class OperationalError(DatabaseError):
    pass


class IntegrityError(DatabaseError):
    pass


class InternalError(DatabaseError):
    pass


class ProgrammingError(DatabaseError):
    pass


class NotSupportedError(DatabaseError):
    pass


def connect(warehouse: str | None = None, *, engine: Engine | None = None, spark: SparkSession | None = None) -> Connection:
    if engine is None:
        if warehouse is None:
            raise InterfaceError("a warehouse or an engine is needed")
        engine = Engine(spark or get_session(), warehouse)
    return Connection(engine)


class Connection:
    def __init__(self, engine: Engine):
        self.engine = engine
        self._session: Session | None = engine.session()

    @property
    def session(self) -> Session:
        if self._session is None:
            raise InterfaceError("the connection is closed")
        return self._session

    def cursor(self) -> Cursor:
        return Cursor(self)

    def begin(self) -> None:
        self.cursor().execute("BEGIN")

    def commit(self) -> None:
        if self.session.transaction:
            self.cursor().execute("COMMIT")

    def rollback(self) -> None:
        if self.session.transaction:
            self.cursor().execute("ROLLBACK")

    def close(self) -> None:
        if self._session:
            self._session.close()
        self._session = None

    def __enter__(self) -> Connection:
        return self

    def __exit__(self, kind: type | None, *_: Any) -> None:
        if kind is None:
            self.commit()
        else:
            self.rollback()


class Cursor:
    arraysize = 1

    def __init__(self, connection: Connection):
        self.connection = connection
        self._reset()

    def _reset(self) -> None:
        self.description: list[tuple] | None = None
        self.rowcount = -1
        self.status: str | None = None
        self._rows: Iterator[tuple] | None = None

    def execute(self, sql: str, params: Sequence[Any] = ()) -> Cursor:
        """Parameters are ``?`` or ``$n``; those inside string literals are text."""
        self._reset()
        try:
            result: Result = self.connection.session.sql(sql, params)
            if result.df is not None:
                # One pass: the rows are fetched partition by partition as they are read.
                self.description = [(f.name, f.dataType.simpleString(), None, None, None, None, f.nullable) for f in result.df.schema.fields]
                self._rows = (tuple(r) for r in result.df.toLocalIterator())
            else:
                self.status = result.status
                found = re.findall(r"\d+", result.status)
                self.rowcount = int(found[-1]) if found and result.count is not None else -1
        except Error:
            raise
        except Exception as e:
            raise DatabaseError(f"[!] Error: {e}") from e
        return self

    def executemany(self, sql: str, many: Sequence[Sequence[Any]]) -> Cursor:
        total = 0
        for params in many:
            self.execute(sql, params)
            total += max(self.rowcount, 0)
        self.rowcount = total
        return self

    def _next(self) -> tuple | None:
        if self._rows is None:
            raise InterfaceError("there is no result to fetch")
        try:
            return next(self._rows, None)
        except Exception as e:
            raise DatabaseError(f"[!] Error: {e}") from e

    def fetchone(self) -> tuple | None:
        return self._next()

    def fetchmany(self, size: int | None = None) -> list[tuple]:
        found = []
        for _ in range(self.arraysize if size is None else size):
            row = self._next()
            if row is None:
                break
            found.append(row)
        return found

    def fetchall(self) -> list[tuple]:
        found = []
        while (row := self._next()) is not None:
            found.append(row)
        self.rowcount = len(found)
        return found

    def __iter__(self) -> Iterator[tuple]:
        while (row := self._next()) is not None:
            yield row

    def setinputsizes(self, sizes: Any) -> None:
        pass

    def setoutputsize(self, size: Any, column: Any = None) -> None:
        pass

    def close(self) -> None:
        self._reset()
