"""Semantics of the dialect on small literal fixtures."""

from __future__ import annotations

import random
import re
import statistics
import time

import pytest
from pyspark.sql import functions as F

from brindle import operators
from brindle.engine import Engine
from brindle.operators import relational
from brindle.plans import Lowering, ParseError, explain_text, parse


@pytest.fixture(scope="module")
def run(spark):
    tables = {
        "nulls": spark.createDataFrame([(1, 10, "a"), (1, None, "b"), (2, None, None), (None, 5, "a"), (None, None, None), (None, None, None)], "k int, v int, s string"),
        "x": spark.createDataFrame([(1,), (1,), (2,), (None,), (None,)], "a int"),
        "y": spark.createDataFrame([(1,), (2,), (2,), (None,)], "a int"),
        "ints": spark.createDataFrame([(-7, 2), (7, 2), (2147483647, 1), (-2147483648, 3)], "a int, b int"),
        "wide": spark.createDataFrame([(1, "one"), (2, "two")], "a long, name string"),
        "strings": spark.createDataFrame([("O'Brien",), ("50%",), ("a_b",), ("a\\b",), ("Ünïcode",), ("",)], "s string"),
        "dates": spark.sql("SELECT timestamp_ntz'2024-06-15 00:00:00' AS t UNION ALL SELECT timestamp_ntz'2024-06-15 12:30:00'"),
        "a3": spark.createDataFrame([(1, "a1"), (2, "a2")], "id int, name string"),
        "b3": spark.createDataFrame([(1, "b1"), (2, "b2")], "id int, name string"),
        "c3": spark.createDataFrame([(1, "c1"), (2, "c2")], "id int, name string"),
        "none": spark.createDataFrame([], "id int, val int"),
    }
    views = {"v1": parse("SELECT k, v FROM nulls WHERE v IS NOT NULL")}

    def go(text, *params):
        return [tuple(r) for r in Lowering(spark, tables.get, views.get, params).query(parse(text)).collect()]

    return go


def bag(rows):
    return sorted(rows, key=repr)


def test_three_valued_predicates(run):
    assert run("SELECT COUNT(*) FROM nulls WHERE NOT (v = 10)") == [(1,)]
    assert run("SELECT COUNT(*) FROM nulls WHERE v <= 10") == [(2,)]
    assert run("SELECT COUNT(*) FROM nulls WHERE v BETWEEN 1 AND 9") == [(1,)]
    assert run("SELECT COUNT(*) FROM nulls WHERE s IN ('a', NULL)") == [(2,)]
    assert run("SELECT COUNT(*) FROM nulls WHERE s NOT IN ('b', NULL)") == [(0,)]
    assert run("SELECT COUNT(*) FROM nulls WHERE k IS NULL OR v > 100") == [(3,)]


def test_aggregates_ignore_nulls(run):
    assert run("SELECT COUNT(*), COUNT(v), SUM(v), MIN(v), MAX(v), AVG(v), MEDIAN(v) FROM nulls") == [(6, 2, 15, 5, 10, 7.5, 7.5)]
    assert bag(run("SELECT k, SUM(v) FROM nulls GROUP BY k")) == bag([(1, 10), (2, None), (None, 5)])


def test_aggregates_over_nothing(run):
    assert run("SELECT COUNT(*), SUM(val), AVG(val), MEDIAN(val), MIN(val) FROM none") == [(0, None, None, None, None)]
    assert run("SELECT val, COUNT(*) FROM none GROUP BY val") == []


def test_distinct_and_set_operations_treat_nulls_as_equal(run):
    assert bag(run("SELECT DISTINCT a FROM x")) == bag([(1,), (2,), (None,)])
    assert bag(run("SELECT a FROM x EXCEPT SELECT a FROM y")) == []
    assert bag(run("SELECT a FROM x EXCEPT ALL SELECT a FROM y")) == bag([(1,), (None,)])
    assert bag(run("SELECT a FROM x INTERSECT ALL SELECT a FROM y")) == bag([(1,), (2,), (None,)])
    assert len(run("SELECT a FROM x UNION ALL SELECT a FROM y")) == 9


def test_set_operations_are_left_associative(run):
    assert bag(run("SELECT a FROM x UNION SELECT a FROM y INTERSECT SELECT a FROM y WHERE a = 2")) == [(2,)]
    with pytest.raises(ParseError):
        run("SELECT a FROM x UNION SELECT a, name FROM wide")


def test_not_in_with_nulls(run):
    assert run("SELECT a FROM wide WHERE a NOT IN (SELECT a FROM y)") == []
    assert bag(run("SELECT a FROM wide WHERE a NOT IN (SELECT a FROM y WHERE a IS NOT NULL AND a < 2)")) == [(2,)]
    assert len(run("SELECT a FROM x WHERE a NOT IN (SELECT a FROM y WHERE a > 100)")) == 5
    assert bag(run("SELECT a FROM x WHERE a IN (SELECT a FROM y) AND a > 1")) == [(2,)]
    assert bag(run("SELECT a FROM wide WHERE a = 2 OR a IN (SELECT a FROM x)")) == [(1,), (2,)]


def test_integer_division_truncates(run):
    assert run("SELECT a / b FROM ints ORDER BY a LIMIT 2") == [(-715827882,), (-3,)]
    assert run("SELECT a / 2.0 FROM ints WHERE a = 7") == [(3.5,)]


def test_errors_at_run_time(run):
    for text in ("SELECT a / 0 FROM ints", "SELECT a + 1 FROM ints"):
        with pytest.raises(Exception, match="DIVIDE_BY_ZERO|ARITHMETIC_OVERFLOW"):
            run(text)


def test_like_has_no_escape(run):
    assert run("SELECT s FROM strings WHERE s LIKE 'a\\%'") == [("a\\b",)]
    assert run("SELECT s FROM strings WHERE s LIKE 'a_b' ORDER BY s") == [("a\\b",), ("a_b",)]
    assert run("SELECT s FROM strings WHERE s ILIKE 'o''b%'") == [("O'Brien",)]
    assert run("SELECT COUNT(*) FROM strings WHERE s NOT LIKE '%'") == [(0,)]


def test_like_many_wildcards(spark):
    tables = {"t": spark.createDataFrame([("a" * 5000 + "b",), (None,)], "s string")}
    low = Lowering(spark, tables.get)

    def count(pattern, op="LIKE"):
        return low.query(parse(f"SELECT COUNT(*) FROM t WHERE s {op} '{pattern}'")).first()[0]

    assert count("%a" * 1000 + "%b") == 1 and count("%A" * 1000 + "%B", "ILIKE") == 1
    assert count("%a" * 1000 + "%c") == 0 and count("%a" * 1000 + "%b", "NOT LIKE") == 0
    assert count("a%a_a%a%a%_b") == 1 and count("b%a%a%a%b") == 0


def test_strings(run):
    assert run("SELECT LENGTH(s), OCTET_LENGTH(s), UPPER(s), LOWER(s) FROM strings WHERE s LIKE 'Ü%'") == [(7, 9, "ÜNÏCODE", "ünïcode")]
    assert run("SELECT SUBSTRING(s, 0, 2), SUBSTRING(s, 2, -1), SUBSTRING(s, 99, 1), CONCAT(s, NULL), CONCAT(s, 1, '!') FROM strings WHERE s = '50%'") == [("50", "", "", None, "50%1!")]


def test_timestamps_compare_with_text(run):
    assert run("SELECT COUNT(*) FROM dates WHERE t = '2024-06-15'") == [(1,)]
    assert run("SELECT COUNT(*) FROM dates WHERE t >= '2024-06-15 12:00:00'") == [(1,)]


def test_literals_keep_their_types(run):
    assert run("SELECT '123', 'true', 2147483648, 1.5, TRUE, NULL, -5 FROM x LIMIT 1") == [("123", "true", 2147483648, 1.5, True, None, -5)]


def test_three_way_join_with_equal_names(run):
    text = "SELECT a3.name, b3.name, c3.name AS last FROM a3 JOIN b3 ON a3.id = b3.id JOIN c3 ON c3.id = b3.id WHERE b3.name = 'b2'"
    assert run(text) == [("a2", "b2", "c2")]
    with pytest.raises(Exception, match="AMBIGUOUS"):
        run("SELECT name FROM a3 JOIN b3 ON a3.id = b3.id")
    assert run("SELECT b3.id, COUNT(*) AS n FROM a3 JOIN b3 ON a3.id = b3.id GROUP BY b3.id ORDER BY id") == [(1, 1), (2, 1)]


def test_keys_of_different_width_join(run):
    assert bag(run("SELECT wide.a FROM x JOIN wide ON x.a = wide.a")) == [(1,), (1,), (2,)]


def test_aggregate_expressions(run):
    assert run("SELECT SUM(v) + COUNT(*) AS t, SUM(k) AS k FROM nulls") == [(21, 4)]
    assert run("SELECT k FROM nulls GROUP BY k HAVING SUM(v) > 5") == [(1,)]
    assert run("SELECT k + 1 AS up, COUNT(*) AS n FROM nulls WHERE k IS NOT NULL GROUP BY k + 1 ORDER BY n DESC") == [(2, 2), (3, 1)]
    with pytest.raises(ParseError):
        run("SELECT k, v FROM nulls GROUP BY k")


def test_distinct_then_limit(run):
    assert run("SELECT DISTINCT a FROM x ORDER BY a LIMIT 2") == [(1,), (2,)]
    assert run("SELECT DISTINCT a FROM x ORDER BY a DESC OFFSET 1") == [(1,), (None,)]


def test_nulls_sort_last(run):
    assert [r[0] for r in run("SELECT a FROM x ORDER BY a")] == [1, 1, 2, None, None]
    assert [r[0] for r in run("SELECT a FROM x ORDER BY a DESC")] == [2, 1, 1, None, None]


def test_ctes_hide_views_and_tables(run):
    assert run("WITH x AS (SELECT a FROM y WHERE a = 1) SELECT * FROM x") == [(1,)]
    assert run("WITH p AS (SELECT 1 AS one FROM x LIMIT 1), q AS (SELECT one + 1 AS two FROM p) SELECT two FROM q") == [(2,)]
    assert bag(run("SELECT * FROM v1")) == bag([(1, 10), (None, 5)])


def test_parameters(run):
    assert run("SELECT a FROM wide WHERE name = $1 AND a < $2", "two", 10) == [(2,)]
    assert run("SELECT a FROM wide WHERE name != '?' AND a = ?", 1) == [(1,)]
    with pytest.raises(ParseError):
        run("SELECT a FROM wide WHERE a = $3", 1)


@pytest.mark.parametrize(
    "text",
    ["SELECT 1", "SELECT a FROM x WHERE", "SELECT a FROM x GROUP BY", "SELECT FOO(a) FROM x", "SELECT a FROM x; SELECT a FROM y", "SELECT a FROM x extra words", "SELECT a FROM x LIMIT 1.5", "SELEC a FROM x", "SELECT a FROM nowhere", "SELECT a FROM x WHERE SUM(a) > 1", "SELECT 'open FROM x", "SELECT UPPER(a, a) FROM x"],
)
def test_rejected(run, text):
    with pytest.raises(ValueError):
        run(text)


def test_comments_case_and_quotes(run):
    assert run('select "a" as "A b" from x -- all of it\n where a = 2;') == [(2,)]


def test_explain(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/wh")
    engine.sql("CREATE TABLE t (id INT PRIMARY KEY, v INT)")
    engine.sql("INSERT INTO t VALUES (1, 2)")
    rows = engine.sql("EXPLAIN SELECT v FROM t WHERE id = 1").rows()
    assert len(rows) == 1 and "Filter" in rows[0][0]
    assert engine.sql("EXPLAIN DELETE FROM t").rows()[0][0].startswith("Delete [t]")
    assert engine.sql("SELECT * FROM t").rows() == [(1, 2)]
    with pytest.raises(Exception, match="Unsupported statement type"):
        engine.sql("EXPLAIN DROP TABLE t")


def test_like_with_many_wildcards_is_linear(run):
    """Also where the pattern is a parameter or a column."""
    text, pattern = "a" * 5000, "%a" * 25 + "%b"
    began = time.monotonic()
    for how in ("LIKE", "ILIKE"):
        assert run(f"SELECT COUNT(*) FROM x WHERE $1 {how} $2", text, pattern) == [(0,)]
        assert run(f"SELECT COUNT(*) FROM x WHERE ? {how} ?", text + "b", pattern) == [(5,)]
        assert run(f"SELECT COUNT(*) FROM (SELECT $2 AS p FROM x) AS t WHERE $1 {how} p", text, pattern) == [(0,)]
    assert time.monotonic() - began < 60


def test_like_by_row(spark):
    patterns = ["%a%_%c%d%", "a%.%*%+%", "%(%)%[%]%", "%\\%\\%a%", "%%%%", "", "%", "_%_%_%_%_", "%É%é%x%", "% % % %", "a%a%a%a", "a%b", "_b%"]
    values = ["abxcd", "a.x*y+z", "x(y)z[w]", "q\\w\\ea", "", "abcde", "É é x", "a b c d", "aaa", "aaaa", "a\na\naba", "%", "(%)%[]", "AbxCD"]
    pairs = spark.createDataFrame([(v, p) for v in values for p in patterns], "v string, p string")

    def fits(value, pattern):
        return bool(re.fullmatch("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern), value, re.S))

    def met(how):
        return sorted(tuple(r) for r in Lowering(spark, {"t": pairs}.get).query(parse(f"SELECT v, p FROM t WHERE v {how} p")).collect())

    assert met("LIKE") == sorted((v, p) for v in values for p in patterns if fits(v, p))
    assert met("ILIKE") == sorted((v, p) for v in values for p in patterns if fits(v.lower(), p.lower()))


def test_in_under_or_keeps_three_values(run):
    """NOT IN over a query with a null is never true, over no rows always; the other side of OR still counts."""
    assert run("SELECT COUNT(*) FROM x WHERE a = 2 OR a NOT IN (SELECT a FROM y)") == [(1,)]
    assert run("SELECT COUNT(*) FROM x WHERE a = 2 OR a NOT IN (SELECT a FROM y WHERE a = 2)") == [(3,)]
    assert run("SELECT COUNT(*) FROM x WHERE a = 2 OR a NOT IN (SELECT a FROM y WHERE a > 9)") == [(5,)]
    assert run("SELECT COUNT(*) FROM x WHERE a IS NULL OR a IN (SELECT a FROM y WHERE a = 1)") == [(4,)]
    assert run("SELECT COUNT(*) FROM x WHERE NOT (a IN (SELECT a FROM y WHERE a = 1) OR a IN (SELECT a FROM y WHERE a = 2))") == [(0,)]
    assert run("SELECT COUNT(*) FROM x WHERE NOT (a = 1 OR a IN (SELECT a FROM y WHERE a = 7))") == [(1,)]


def test_median_in_two_passes(spark, monkeypatch):
    """Ties, nulls, null keys, groups of one row, and groups of nulls only."""
    rng = random.Random(2)
    rows = [(k, rng.choice([None, float(rng.randrange(5)), rng.random() * 10**rng.randrange(-3, 6)])) for k in (None, 1, 2) for _ in range(3001 + (k or 0))]
    rows += [(3, 4.5), (4, None), (5, 1.0), (5, 2.0), *[(6, 7.0)] * 50]
    df = spark.createDataFrame(rows, "k int, v double")
    out = operators.group_with_medians(df, ["k"], [F.count("v").alias("n")], {"m": F.col("v"), "twice": F.col("v") * 2}).collect()
    assert len(out) == 7
    for r in out:
        own = [v for k, v in rows if k == r.k and v is not None]
        assert r.n == len(own) and r.m == (statistics.median(own) if own else None) and r.twice == (2 * r.m if own else None)
    monkeypatch.setattr(relational, "SMALL_BYTES", 0)
    run = lambda text: Lowering(spark, {"t": df}.get).query(parse(text)).collect()
    every = statistics.median(v for _, v in rows if v is not None)
    assert [tuple(r) for r in run("SELECT MEDIAN(v) AS m, COUNT(*) AS n FROM t")] == [(every, len(rows))]
    assert {r[0]: r[1] for r in run("SELECT k, MED(v) + 1 FROM t GROUP BY k HAVING MEDIAN(v) > 4")}[6] == 8.0
    assert [tuple(r) for r in run("SELECT MEDIAN(v) FROM t WHERE k > 100")] == [(None,)]


@pytest.mark.parametrize("offset", [0, 1, 250, 999, 1000, 5000])
def test_offset_without_limit_in_parts(spark, monkeypatch, offset):
    monkeypatch.setattr(relational, "SMALL_BYTES", 0)
    assert spark.sparkContext.getCheckpointDir()
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v")).repartition(7).orderBy("v")
    out = operators.limit(df, None, offset)
    assert [r.v for r in out.collect()] == list(range(1000))[offset:]
    assert "Limit" not in explain_text(out)


def test_decimals_are_not_registered(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}")
    with pytest.raises(ValueError, match="d"):
        engine.register("t", spark.sql("SELECT CAST(1 AS DECIMAL(38, 10)) AS d"))
