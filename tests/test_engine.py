"""DDL, DML, constraints, transactions and the DB-API facade."""

from __future__ import annotations

import pytest

from brindle import dbapi
from brindle.constraints import ConstraintError
from brindle.engine import Engine, EngineError
from brindle.sources import Conflict


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/wh")


def run(engine, *texts):
    result = None
    for t in texts:
        result = engine.sql(t)
    return result


def rows(engine, text):
    return sorted(engine.sql(text).rows(), key=repr)


def test_insert_update_delete(engine):
    assert run(engine, "CREATE TABLE users (id INTEGER PRIMARY KEY, name VARCHAR(50))").status == "CREATE TABLE"
    assert engine.sql("INSERT INTO users VALUES (1, 'Alice'), (2, 'Bob'), (3, 'Charlie')").status == "INSERT 0 3"
    assert engine.sql("UPDATE users SET name = 'Alice Updated' WHERE id = 1").status == "UPDATE 1"
    assert engine.sql("DELETE FROM users WHERE id = 3 OR name IS NULL").status == "DELETE 1"
    assert rows(engine, "SELECT * FROM users") == [(1, "Alice Updated"), (2, "Bob")]
    assert engine.sql("SELECT * FROM users").status == "SELECT 2"
    assert run(engine, "DROP TABLE users").status == "DROP TABLE"
    with pytest.raises(ValueError):
        engine.sql("SELECT * FROM users")


def test_update_reads_old_values(engine):
    run(engine, "CREATE TABLE t (a INT PRIMARY KEY, b INT)", "INSERT INTO t VALUES (1, 10), (2, 20)", "UPDATE t SET a = a + 1, b = a")
    assert rows(engine, "SELECT * FROM t") == [(2, 1), (3, 2)]


def test_delete_where_null_keeps_rows(engine):
    run(engine, "CREATE TABLE t (a INT, b INT)", "INSERT INTO t VALUES (1, NULL), (2, 5)")
    assert engine.sql("DELETE FROM t WHERE b = 5 OR b = NULL").status == "DELETE 1"
    assert rows(engine, "SELECT a FROM t") == [(1,)]


def test_types_on_store(engine):
    run(engine, "CREATE TABLE t (a BIGINT, b DECIMAL, c VARCHAR(3), d TIMESTAMP, e BOOL, f TEXT, g DOUBLE, h CHAR(2), i TINYINT, j DATE)")
    engine.sql("INSERT INTO t VALUES (-1, 2, 'abc', '2024-06-15', TRUE, 'long text', 1, 'x  ', 7, '2024-06-15 10:00:00')")
    row = engine.sql("SELECT a, b, c, e, f, g, h, i FROM t").rows()[0]
    assert row == (-1, 2.0, "abc", True, "long text", 1.0, "x", 7)
    for bad in ("'toolong'", "'abcd'"):
        with pytest.raises(Exception, match="too long"):
            engine.sql(f"INSERT INTO t VALUES (1, 1, {bad}, NULL, NULL, NULL, NULL, NULL, NULL, NULL)")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        engine.sql("INSERT INTO t VALUES ('x', 1, 'a', NULL, NULL, NULL, NULL, NULL, NULL, NULL)")
    with pytest.raises(Exception, match="OVERFLOW"):
        engine.sql("INSERT INTO t VALUES (1, 1, 'a', NULL, NULL, NULL, NULL, NULL, 300, NULL)")
    with pytest.raises(EngineError):
        engine.sql("INSERT INTO t VALUES (1)")


def test_keys(engine):
    run(engine, "CREATE TABLE t (a INT PRIMARY KEY, b INT NOT NULL, c INT UNIQUE)", "INSERT INTO t VALUES (1, 1, NULL), (2, 1, NULL), (3, 1, 5)")
    for bad in ("(1, 1, 1)", "(NULL, 1, 1)", "(4, NULL, 1)", "(4, 1, 5)", "(5, 1, 1), (5, 1, 2)"):
        with pytest.raises(ConstraintError):
            engine.sql(f"INSERT INTO t VALUES {bad}")
    with pytest.raises(ConstraintError, match="pk_t"):
        engine.sql("UPDATE t SET a = 1 WHERE a = 2")
    with pytest.raises(ConstraintError):
        engine.sql("UPDATE t SET b = NULL WHERE a = 2")
    engine.sql("UPDATE t SET a = a + 1")
    assert rows(engine, "SELECT a FROM t") == [(2,), (3,), (4,)]


def test_composite_key_compares_all_columns(engine):
    run(engine, "CREATE TABLE t (a INT, b INT, PRIMARY KEY (a, b))", "INSERT INTO t VALUES (1, 1), (1, 2)")
    with pytest.raises(ConstraintError):
        engine.sql("INSERT INTO t VALUES (1, 2)")


def test_indexes(engine):
    run(engine, "CREATE TABLE t (a INT, b INT)", "INSERT INTO t VALUES (1, 1), (1, 2)", "CREATE INDEX i ON t (a)")
    with pytest.raises(ConstraintError):
        engine.sql("CREATE UNIQUE INDEX u ON t (a)")
    run(engine, "CREATE UNIQUE INDEX u ON t (a, b)")
    with pytest.raises(ConstraintError):
        engine.sql("INSERT INTO t VALUES (1, 2)")
    run(engine, "DROP INDEX u", "INSERT INTO t VALUES (1, 2)")
    with pytest.raises(EngineError):
        engine.sql("DROP INDEX u")


@pytest.fixture
def todo(engine):
    run(
        engine,
        "CREATE TABLE users (id INTEGER PRIMARY KEY, name VARCHAR(50) NOT NULL UNIQUE)",
        "CREATE TABLE todo_lists (id INTEGER PRIMARY KEY, user_id INTEGER NOT NULL, title VARCHAR(100) NOT NULL, FOREIGN KEY (user_id) REFERENCES users (id) ON DELETE CASCADE ON UPDATE RESTRICT)",
        "CREATE TABLE todos (id INTEGER PRIMARY KEY, list_id INTEGER NOT NULL, title VARCHAR(200) NOT NULL, is_done BOOLEAN NOT NULL, FOREIGN KEY (list_id) REFERENCES todo_lists (id) ON DELETE CASCADE ON UPDATE CASCADE)",
        "CREATE TABLE activity_logs (id INTEGER PRIMARY KEY, todo_id INTEGER, action VARCHAR(30), FOREIGN KEY (todo_id) REFERENCES todos (id) ON UPDATE SET NULL ON DELETE SET NULL)",
        "CREATE INDEX todos_by_list ON todos (list_id, is_done)",
        "CREATE VIEW v_open_todos AS SELECT id, list_id, title FROM todos WHERE is_done = FALSE",
        "INSERT INTO users VALUES (1, 'ann'), (2, 'bo')",
        "INSERT INTO todo_lists VALUES (10, 1, 'home'), (20, 2, 'work')",
        "INSERT INTO todos VALUES (100, 10, 'a', FALSE), (101, 10, 'b', TRUE), (200, 20, 'c', FALSE)",
        "INSERT INTO activity_logs VALUES (1, 100, 'made'), (2, 200, 'made'), (3, NULL, 'login')",
    )
    return engine


def test_cascades_over_three_hops(todo):
    assert todo.sql("DELETE FROM users WHERE id = 1").status == "DELETE 1"
    assert rows(todo, "SELECT id FROM todo_lists") == [(20,)]
    assert rows(todo, "SELECT id FROM todos") == [(200,)]
    assert rows(todo, "SELECT id, todo_id FROM activity_logs") == [(1, None), (2, 200), (3, None)]
    assert rows(todo, "SELECT title FROM v_open_todos") == [("c",)]


def test_update_actions(todo):
    with pytest.raises(ConstraintError, match="RESTRICT"):
        todo.sql("UPDATE users SET id = 9 WHERE id = 1")
    todo.sql("UPDATE todo_lists SET id = 11 WHERE id = 10")
    assert rows(todo, "SELECT id, list_id FROM todos") == [(100, 11), (101, 11), (200, 20)]
    todo.sql("UPDATE todos SET id = id + 1000 WHERE id = 100")
    assert rows(todo, "SELECT id, todo_id FROM activity_logs") == [(1, None), (2, 200), (3, None)]


def test_child_needs_parent(todo):
    with pytest.raises(ConstraintError, match="Foreign key"):
        todo.sql("INSERT INTO todos VALUES (300, 99, 'x', FALSE)")
    with pytest.raises(ConstraintError, match="Foreign key"):
        todo.sql("UPDATE todos SET list_id = 99 WHERE id = 100")
    with pytest.raises(EngineError, match="referenced"):
        todo.sql("DROP TABLE users")


def test_set_null_respects_not_null(engine):
    run(engine, "CREATE TABLE p (id INT PRIMARY KEY)", "CREATE TABLE c (id INT, p INT NOT NULL, FOREIGN KEY (p) REFERENCES p (id) ON DELETE SET NULL)", "INSERT INTO p VALUES (1)", "INSERT INTO c VALUES (1, 1)")
    with pytest.raises(ConstraintError):
        engine.sql("DELETE FROM p")
    assert rows(engine, "SELECT * FROM c") == [(1, 1)]


def test_self_reference(engine):
    run(engine, "CREATE TABLE e (id INT PRIMARY KEY, boss INT, FOREIGN KEY (boss) REFERENCES e (id) ON DELETE CASCADE)", "INSERT INTO e VALUES (1, NULL), (2, 1), (3, 2), (4, NULL)", "DELETE FROM e WHERE id = 1")
    assert rows(engine, "SELECT id FROM e") == [(4,)]


def test_savepoint_rollback(engine):
    run(engine, "CREATE TABLE t (id INTEGER PRIMARY KEY, val INTEGER)", "BEGIN", "INSERT INTO t VALUES (1, 100)", "SAVEPOINT sp", "INSERT INTO t VALUES (2, 200)", "INSERT INTO t VALUES (3, 300)", "ROLLBACK TO SAVEPOINT sp")
    assert rows(engine, "SELECT * FROM t") == [(1, 100)]
    run(engine, "COMMIT")
    assert rows(engine, "SELECT * FROM t") == [(1, 100)]


def test_savepoint_release(engine):
    run(engine, "CREATE TABLE t (id INTEGER PRIMARY KEY)", "BEGIN", "INSERT INTO t VALUES (1)", "SAVEPOINT sp", "INSERT INTO t VALUES (2)", "RELEASE SAVEPOINT sp")
    with pytest.raises(EngineError):
        engine.sql("ROLLBACK TO sp")
    assert engine.sql("COMMIT").status == "ROLLBACK"
    assert rows(engine, "SELECT * FROM t") == []


def test_savepoints_nested(engine):
    run(engine, "CREATE TABLE t (id INTEGER PRIMARY KEY)", "BEGIN", "INSERT INTO t VALUES (1)", "SAVEPOINT sp1", "INSERT INTO t VALUES (2)", "SAVEPOINT sp2", "INSERT INTO t VALUES (3)", "ROLLBACK TO sp1")
    assert rows(engine, "SELECT * FROM t") == [(1,)]
    with pytest.raises(EngineError):
        engine.sql("ROLLBACK TO sp2")
    run(engine, "ROLLBACK")
    assert rows(engine, "SELECT * FROM t") == []


def test_savepoint_needs_transaction(engine):
    with pytest.raises(EngineError):
        engine.sql("SAVEPOINT sp")


def test_commit_after_partial_rollback(engine):
    run(engine, "CREATE TABLE t (id INTEGER PRIMARY KEY)", "BEGIN", "INSERT INTO t VALUES (1), (2)", "SAVEPOINT sp", "INSERT INTO t VALUES (3)", "ROLLBACK TO sp", "INSERT INTO t VALUES (4)", "COMMIT")
    assert rows(engine, "SELECT * FROM t") == [(1,), (2,), (4,)]


def test_inner_then_outer(engine):
    run(engine, "CREATE TABLE t (id INTEGER PRIMARY KEY)", "BEGIN", "INSERT INTO t VALUES (1)", "SAVEPOINT a", "INSERT INTO t VALUES (2)", "SAVEPOINT b", "INSERT INTO t VALUES (3)", "ROLLBACK TO b")
    assert rows(engine, "SELECT * FROM t") == [(1,), (2,)]
    run(engine, "ROLLBACK TO a", "COMMIT")
    assert rows(engine, "SELECT * FROM t") == [(1,)]


def test_poisoned_transaction(engine):
    run(engine, "CREATE TABLE t (id INTEGER PRIMARY KEY)", "BEGIN", "INSERT INTO t VALUES (1)", "SAVEPOINT ok")
    with pytest.raises(ConstraintError):
        engine.sql("INSERT INTO t VALUES (1)")
    with pytest.raises(EngineError, match="aborted"):
        engine.sql("SELECT * FROM t")
    run(engine, "ROLLBACK TO ok", "INSERT INTO t VALUES (2)")
    assert run(engine, "COMMIT").status == "COMMIT"
    assert rows(engine, "SELECT * FROM t") == [(1,), (2,)]
    with pytest.raises(EngineError, match="in progress"):
        run(engine, "BEGIN", "BEGIN")


def test_failed_statement_changes_nothing(engine):
    run(engine, "CREATE TABLE t (id INTEGER PRIMARY KEY)", "INSERT INTO t VALUES (1)")
    with pytest.raises(ConstraintError):
        engine.sql("INSERT INTO t VALUES (2), (1)")
    assert rows(engine, "SELECT * FROM t") == [(1,)]


def test_snapshot_isolation_and_conflicts(engine):
    run(engine, "CREATE TABLE t (id INTEGER PRIMARY KEY)", "INSERT INTO t VALUES (1)")
    a, b = engine.session(), engine.session()
    a.sql("BEGIN")
    b.sql("BEGIN")
    a.sql("INSERT INTO t VALUES (2)")
    assert sorted(b.sql("SELECT * FROM t").rows()) == [(1,)]
    a.sql("COMMIT")
    assert sorted(b.sql("SELECT * FROM t").rows()) == [(1,)]
    b.sql("INSERT INTO t VALUES (2)")
    with pytest.raises(Conflict):
        b.sql("COMMIT")
    assert rows(engine, "SELECT * FROM t") == [(1,), (2,)]


def test_reopen_and_vacuum(spark, engine, tmp_path):
    run(engine, "CREATE TABLE t (id INTEGER PRIMARY KEY, v VARCHAR(3))", "INSERT INTO t VALUES (1, 'a')", "UPDATE t SET v = 'b'", "CREATE VIEW w AS SELECT v FROM t")
    again = Engine(spark, engine.storage.warehouse)
    assert again.catalog.vacuum() == 1
    assert again.sql("SELECT * FROM w").rows() == [("b",)]
    with pytest.raises(Exception, match="too long"):
        again.sql("INSERT INTO t VALUES (2, 'abcd')")


def test_dbapi(engine):
    with dbapi.connect(engine=engine) as connection:
        cursor = connection.cursor()
        cursor.execute("CREATE TABLE accounts (id INT PRIMARY KEY, name VARCHAR, balance INT)")
        cursor.executemany("INSERT INTO accounts VALUES (?, ?, ?)", [(1, "Dustin's", 5000), (2, "what?", None)])
        assert cursor.rowcount == 2
        cursor.execute("SELECT * FROM accounts WHERE id = $1", (2,))
        assert cursor.fetchall() == [(2, "what?", None)] and cursor.rowcount == 1
        assert [d[0] for d in cursor.description] == ["id", "name", "balance"]
        cursor.execute("SELECT name FROM accounts WHERE name != '?' ORDER BY id")
        assert cursor.fetchone() == ("Dustin's",) and cursor.fetchmany(5) == [("what?",)] and cursor.fetchone() is None
        cursor.execute("UPDATE accounts SET balance = 0")
        assert cursor.rowcount == 2
        with pytest.raises(dbapi.DatabaseError, match="Error"):
            cursor.execute("SELECT nothing FROM accounts")
        connection.begin()
        cursor.execute("DELETE FROM accounts")
        connection.rollback()
        assert list(cursor.execute("SELECT COUNT(*) FROM accounts")) == [(2,)]
    connection.close()
    with pytest.raises(dbapi.InterfaceError):
        connection.cursor().execute("SELECT * FROM accounts")


def test_connection_rolls_back_on_error(engine):
    run(engine, "CREATE TABLE t (id INT)")
    with pytest.raises(RuntimeError), dbapi.connect(engine=engine) as connection:
        connection.begin()
        connection.cursor().execute("INSERT INTO t VALUES (1)")
        raise RuntimeError
    assert rows(engine, "SELECT * FROM t") == []


def test_only_touched_folders_are_rewritten(engine):
    run(engine, "CREATE TABLE t (id INT PRIMARY KEY, v INT)", "INSERT INTO t VALUES (1, 1), (2, 2)", "INSERT INTO t VALUES (3, 3)", "INSERT INTO t VALUES (4, NULL)")
    before = engine.catalog.latest().tables["t"].folders
    assert engine.sql("UPDATE t SET v = 30 WHERE v = 3").status == "UPDATE 1"
    after = engine.catalog.latest().tables["t"].folders
    assert before[0] in after and before[2] in after and before[1] not in after
    assert engine.sql("DELETE FROM t WHERE v > 1000").status == "DELETE 0"
    assert engine.catalog.latest().tables["t"].folders == after
    engine.compact("t")
    assert len(engine.catalog.latest().tables["t"].folders) == 1
    assert rows(engine, "SELECT * FROM t") == [(1, 1), (2, 2), (3, 30), (4, None)]
