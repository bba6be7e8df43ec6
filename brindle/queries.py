"""One query per operator over the driver tables, with equivalent SQL for DuckDB.

Queries come in three styles: DataFrame operators, text of the dialect lowered over
the tables, and statements run by the engine in a warehouse of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions as fn
from . import operators as op
from .engine import Engine
from .plans import Lowering, parse
from .session import TABLES, load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    """Register a function under its name, with its oracle."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def run_sql(spark: SparkSession, sf_dir: str, text: str, params: tuple = ()) -> DataFrame:
    """A query of the dialect over the driver tables."""
    lowering = Lowering(spark, lambda name: load(spark, sf_dir, name) if name in TABLES else None, params=params)
    return lowering.query(parse(text))


def dialect(name: str, text: str, oracle: str | None = None, params: tuple = ()) -> None:
    QUERIES[name] = lambda spark, sf_dir: run_sql(spark, sf_dir, text, params)
    ORACLE_SQL[name] = oracle or text


col, lit = F.col, F.lit


def dec_sum(value) -> object:
    """A sum of doubles that doesn't depend on the order of rows."""
    return F.sum(value.cast("decimal(28,8)")).cast("double")


DEC = "CAST(SUM(CAST({} AS DECIMAL(28,8))) AS DOUBLE)".format

# ------------------------------------------------------------ scans, projection


@query("SELECT * FROM nation")
def scan_star(spark, d):
    return op.scan(spark, f"{d}/nation.parquet")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS revenue, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, l_quantity + 1 AS more, l_quantity - 1 AS less FROM lineitem")
def project_arith(spark, d):
    price, disc, tax, qty = (col(f"l_{c}") for c in ("extendedprice", "discount", "tax", "quantity"))
    revenue = fn.multiply(price, fn.subtract(lit(1), disc))
    return op.project(load(spark, d, "lineitem"), "l_orderkey", "l_linenumber", revenue.alias("revenue"), fn.multiply(revenue, fn.add(lit(1), tax)).alias("charge"), fn.add(qty, lit(1)).alias("more"), fn.subtract(qty, lit(1)).alias("less"))


dialect("int_division", "SELECT p_partkey, p_size / 7 AS sevenths, -p_size / 7 AS negative, (p_size - 25) / 4 AS around FROM part", "SELECT p_partkey, p_size // 7 AS sevenths, CAST(trunc(-p_size / 7.0) AS INTEGER) AS negative, CAST(trunc((p_size - 25) / 4.0) AS INTEGER) AS around FROM part")
dialect("unary_minus", "SELECT c_custkey, -c_acctbal AS debt FROM customer")
dialect("parentheses", "SELECT s_suppkey, (s_acctbal + 1) * 2 - s_acctbal * 2 AS two FROM supplier", "SELECT s_suppkey, (s_acctbal + 1.0::DOUBLE) * 2 - s_acctbal * 2 AS two FROM supplier")

# --------------------------------------------------------------- predicates


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 10 AND o_totalprice <= 200000 AND o_orderstatus <> 'F' AND o_custkey < 1000 AND o_orderkey >= 11")
def filter_cmp(spark, d):
    df = load(spark, d, "orders")
    cond = (col("o_orderkey") > 10) & (col("o_totalprice") <= 200000) & (col("o_orderstatus") != "F") & (col("o_custkey") < 1000) & (col("o_orderkey") >= 11)
    return op.project(op.filter_(df, cond), "o_orderkey", "o_totalprice")


dialect("filter_bool", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'O' OR o_orderstatus = 'P') AND NOT o_totalprice > 150000")
dialect("filter_between", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20")
dialect("filter_not_between", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity NOT BETWEEN 5 AND 45")
dialect("filter_in_list", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
dialect("filter_not_in_list", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
dialect("filter_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%e%l_'")
dialect("filter_not_like", "SELECT p_partkey, p_name FROM part WHERE p_name NOT LIKE '%e%'")
dialect("filter_ilike", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%E_L%'")
dialect("filter_not_ilike", "SELECT p_partkey, p_name FROM part WHERE p_name NOT ILIKE '%A%'")


@query("SELECT k, v FROM (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END AS v FROM orders) WHERE v IS NULL OR NOT (v < 100000)")
def filter_null(spark, d):
    df = load(spark, d, "orders").select(col("o_orderkey").alias("k"), F.when(col("o_orderstatus") != "F", col("o_totalprice")).alias("v"))
    return op.filter_(df, fn.is_null(col("v")) | ~(col("v") < 100000))


dialect("filter_is_not_null", "SELECT n_nationkey FROM nation WHERE n_name IS NOT NULL AND NOT n_regionkey IS NULL")
dialect("filter_timestamp", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= '1996-01-01' AND o_orderdate < '1997-06-01 00:00:00'")
dialect("params_positional", "SELECT o_orderkey FROM orders WHERE o_totalprice > $2 AND o_orderstatus = $1", "SELECT o_orderkey FROM orders WHERE o_totalprice > 250000 AND o_orderstatus = 'O'", ("O", 250000))
dialect("params_qmark", "SELECT c_custkey FROM customer WHERE c_mktsegment = ? AND c_acctbal < ?", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal < 1000", ("BUILDING", 1000))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 42")
def index_point_lookup(spark, d):
    """No index: the equality reaches the reader, which skips row groups by their statistics."""
    return op.scan(spark, f"{d}/orders.parquet", ["o_orderkey", "o_custkey", "o_totalprice"], col("o_orderkey") == 42)


dialect("in_subquery", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
dialect("not_in_subquery", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_totalprice > 100000")
dialect("in_subquery_or", "SELECT n_nationkey FROM nation WHERE n_regionkey = 0 OR n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")

dialect("not_in_subquery_or", "SELECT o_orderkey FROM orders WHERE o_totalprice > 300000 OR o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
dialect("like_parameter", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE $1 OR p_name ILIKE $2", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%e%i%o%' OR p_name ILIKE '%S%T%N%L%'", ("%a%e%i%o%", "%S%T%N%L%"))
dialect("like_column", "SELECT a.n_name AS name, b.r_name AS pattern FROM nation AS a JOIN region AS b ON a.n_regionkey = b.r_regionkey WHERE CONCAT('x', b.r_name, 'y') LIKE CONCAT('%', SUBSTRING(b.r_name, 1, 1), '%', SUBSTRING(b.r_name, 2, 1), '%_%', SUBSTRING(b.r_name, 4, 1), '%')", "SELECT a.n_name AS name, b.r_name AS pattern FROM nation AS a JOIN region AS b ON a.n_regionkey = b.r_regionkey WHERE 'x' || b.r_name || 'y' LIKE '%' || substring(b.r_name, 1, 1) || '%' || substring(b.r_name, 2, 1) || '%_%' || substring(b.r_name, 4, 1) || '%'")

# ------------------------------------------------------------------ sources

dialect("derived_table", "SELECT d.status AS status, d.n AS n FROM (SELECT o_orderstatus AS status, COUNT(*) AS n FROM orders GROUP BY o_orderstatus) AS d WHERE d.n > 1")
dialect("cte", "WITH big AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000) SELECT COUNT(*) AS n FROM big")
dialect("cte_multi", "WITH a AS (SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 5000), b AS (SELECT a.c_custkey AS k, n_name FROM a JOIN nation ON a.c_nationkey = n_nationkey) SELECT n_name, COUNT(*) AS n FROM b GROUP BY n_name")


def _warehouse(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", "") or "file:///tmp/brindle-work"
    return f"{base.rstrip('/')}/warehouse-{uuid.uuid4().hex}"


def _engine(spark: SparkSession, d: str, *tables: str) -> Engine:
    engine = Engine(spark, _warehouse(spark))
    for t in tables:
        engine.register(t, load(spark, d, t))
    return engine


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 5000 AND s_nationkey < 10")
def view(spark, d):
    engine = _engine(spark, d, "supplier")
    engine.sql("CREATE VIEW rich AS SELECT * FROM supplier WHERE s_acctbal > 5000")
    return engine.sql("SELECT s_suppkey, s_name FROM rich WHERE s_nationkey < 10").df


# -------------------------------------------------------------------- joins


@query("SELECT o_orderkey, l_linenumber, l_quantity, o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def join_equi(spark, d):
    df = op.join(load(spark, d, "lineitem"), load(spark, d, "orders"), col("l_orderkey") == col("o_orderkey"))
    return op.project(df, "o_orderkey", "l_linenumber", "l_quantity", "o_totalprice")


dialect("join_multi", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 0")
dialect("join_self", "SELECT a.n_name AS first, b.n_name AS second FROM nation AS a JOIN nation AS b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey")
dialect("join_subquery", "SELECT c_custkey, t.total AS orders FROM customer JOIN (SELECT o_custkey, COUNT(*) AS total FROM orders GROUP BY o_custkey) AS t ON c_custkey = t.o_custkey")
dialect("join_mixed_keys", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_suppkey = n_nationkey")
dialect("join_theta_lt", "SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_suppkey < n_nationkey")
dialect("join_theta_ne", "SELECT r_regionkey, n_nationkey FROM region JOIN nation ON r_regionkey != n_regionkey")
dialect("join_and_condition", "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 45")
dialect("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000")

# --------------------------------------------------------------- aggregation


@query(f"SELECT COUNT(*) AS n, {DEC('l_quantity')} AS sum_qty, MIN(l_shipdate) AS first, MAX(l_shipdate) AS last, {DEC('l_quantity')} / COUNT(*) AS avg_qty, MEDIAN(l_quantity) AS med_qty FROM lineitem")
def agg_global(spark, d):
    qty = dec_sum(col("l_quantity"))
    made = [fn.aggregate("COUNT", None).alias("n"), qty.alias("sum_qty"), F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"), (qty / F.count(lit(1))).alias("avg_qty")]
    return op.group_with_medians(load(spark, d, "lineitem"), [], made, {"med_qty": col("l_quantity")})


@query("SELECT l_returnflag, l_suppkey, COUNT(*) AS n, MEDIAN(l_extendedprice) AS price, MEDIAN(l_quantity) AS qty FROM lineitem GROUP BY l_returnflag, l_suppkey")
def agg_median_two_pass(spark, d):
    """As MEDIAN runs on inputs that are not small: no task holds a group's values."""
    return op.group_with_medians(load(spark, d, "lineitem"), ["l_returnflag", "l_suppkey"], [F.count(lit(1)).alias("n")], {"price": col("l_extendedprice"), "qty": col("l_quantity")})


dialect("agg_empty", "SELECT COUNT(*) AS n, SUM(l_quantity) AS s, MIN(l_quantity) AS lo, MAX(l_quantity) AS hi, AVG(l_quantity) AS a, MEDIAN(l_quantity) AS m FROM lineitem WHERE l_quantity < 0")
dialect("agg_empty_group", "SELECT l_returnflag, COUNT(*) AS n FROM lineitem WHERE l_quantity < 0 GROUP BY l_returnflag")


@query("SELECT COUNT(*) AS n_rows, COUNT(v) AS n_values, SUM(v) AS total FROM (SELECT CASE WHEN p_size > 25 THEN p_size END AS v FROM part)")
def agg_count_star_vs_col(spark, d):
    df = load(spark, d, "part").select(F.when(col("p_size") > 25, col("p_size")).alias("v"))
    return op.group(df, [], [F.count(lit(1)).alias("n_rows"), F.count("v").alias("n_values"), F.sum("v").alias("total")])


ORACLE_SQL["agg_count_star_vs_col"] = ORACLE_SQL["agg_count_star_vs_col"].replace("SUM(v)", "CAST(SUM(v) AS BIGINT)")
dialect("agg_group", "SELECT c_mktsegment, COUNT(*) AS n, SUM(c_nationkey) AS s FROM customer GROUP BY c_mktsegment", "SELECT c_mktsegment, COUNT(*) AS n, CAST(SUM(c_nationkey) AS BIGINT) AS s FROM customer GROUP BY c_mktsegment")
dialect("agg_multi_key", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")


@query(f"SELECT l_suppkey, {DEC('l_extendedprice * l_discount')} AS saved FROM lineitem GROUP BY l_suppkey")
def agg_expr(spark, d):
    return op.group(load(spark, d, "lineitem"), ["l_suppkey"], [dec_sum(col("l_extendedprice") * col("l_discount")).alias("saved")])


dialect("agg_group_expr", "SELECT p_size / 10 AS tens, COUNT(*) AS n FROM part GROUP BY p_size / 10", "SELECT p_size // 10 AS tens, COUNT(*) AS n FROM part GROUP BY p_size // 10")
dialect("agg_min_max_string", "SELECT o_orderstatus, MIN(o_orderpriority) AS lo, MAX(o_orderpriority) AS hi FROM orders GROUP BY o_orderstatus")
dialect("agg_avg", "SELECT p_brand, AVERAGE(p_size) AS a FROM part GROUP BY p_brand", "SELECT p_brand, AVG(p_size) AS a FROM part GROUP BY p_brand")
dialect("agg_median", "SELECT l_returnflag, MED(l_extendedprice) AS m FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, MEDIAN(l_extendedprice) AS m FROM lineitem GROUP BY l_returnflag")
dialect("agg_two_sums", "SELECT p_type, SUM(p_size) AS sizes, SUM(p_partkey) AS keys, SUM(p_size) + COUNT(*) AS both FROM part GROUP BY p_type", "SELECT p_type, CAST(SUM(p_size) AS BIGINT) AS sizes, CAST(SUM(p_partkey) AS BIGINT) AS keys, CAST(SUM(p_size) + COUNT(*) AS BIGINT) AS both FROM part GROUP BY p_type")
dialect("having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12 AND MAX(o_totalprice) > 100000")
dialect("having_alias", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING n > 12")
dialect("distinct", "SELECT DISTINCT o_orderpriority FROM orders")
dialect("distinct_multi", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
dialect("distinct_limit", "SELECT DISTINCT p_size FROM part ORDER BY p_size LIMIT 7")

# ----------------------------------------------------- sort, limit, set operations

dialect("order_multi", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey")
dialect("order_unselected", "SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
dialect("order_alias", "SELECT p_partkey, p_retailprice * 2 AS twice FROM part ORDER BY twice DESC, p_partkey LIMIT 10")
dialect("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20")
dialect("offset_only", "SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def topn(spark, d):
    return op.top_n(op.project(load(spark, d, "orders"), "o_orderkey", "o_totalprice"), [("o_totalprice", False), "o_orderkey"], 20)


dialect("topn_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
_A, _B = "SELECT c_nationkey AS k FROM customer WHERE c_custkey < 200", "SELECT s_nationkey AS k FROM supplier"
for _name, _op in (("union", "UNION"), ("union_all", "UNION ALL"), ("intersect", "INTERSECT"), ("intersect_all", "INTERSECT ALL"), ("except", "EXCEPT"), ("except_all", "EXCEPT ALL")):
    dialect(_name, f"{_A} {_op} {_B}")
dialect("setop_chain", f"{_A} UNION {_B} INTERSECT SELECT n_nationkey FROM nation WHERE n_regionkey = 1 ORDER BY k LIMIT 4", f"SELECT k FROM (({_A} UNION {_B}) INTERSECT SELECT n_nationkey FROM nation WHERE n_regionkey = 1) ORDER BY k LIMIT 4")

# ----------------------------------------------------------------- functions

dialect("fn_upper", "SELECT c_custkey, UPPER(c_name) AS u FROM customer")
dialect("fn_lower", "SELECT c_custkey, LOWER(c_name) AS l FROM customer")


@query("SELECT p_partkey, CAST(length(p_name) AS INTEGER) AS n, CAST(strlen(p_name) AS INTEGER) AS bytes FROM part")
def fn_length(spark, d):
    return load(spark, d, "part").select("p_partkey", fn.length(col("p_name")).alias("n"), fn.octet_length(col("p_name")).alias("bytes"))


dialect("fn_concat", "SELECT p_partkey, CONCAT(p_brand, '/', p_type) AS both, CONCAT(p_brand, NULL) AS nothing FROM part", "SELECT p_partkey, p_brand || '/' || p_type AS both, CAST(NULL AS VARCHAR) AS nothing FROM part")
dialect("fn_substring", "SELECT p_partkey, SUBSTRING(p_name, 2, 4) AS a, SUBSTRING(p_name, 0, 3) AS b, SUBSTRING(p_name, 3, -1) AS c, SUBSTRING(p_name, 1000, 2) AS d FROM part", "SELECT p_partkey, substring(p_name, 2, 4) AS a, substring(p_name, 1, 3) AS b, '' AS c, '' AS d FROM part")

# --------------------------------------------- statements, constraints, transactions


@query("SELECT * FROM nation UNION ALL SELECT 100, 'ATLANTIS', 1 UNION ALL SELECT 101, 'O''Land', 2")
def dml_insert(spark, d):
    engine = _engine(spark, d, "nation")
    engine.sql("INSERT INTO nation VALUES (100, 'ATLANTIS', 1), (100 + 1, $1, 2)", ("O'Land",))
    return engine.sql("SELECT * FROM nation").df


@query("SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_nationkey = 3 OR s_acctbal < 0 THEN s_acctbal + 100 ELSE s_acctbal END AS s_acctbal FROM supplier")
def dml_update(spark, d):
    engine = _engine(spark, d, "supplier")
    engine.sql("UPDATE supplier SET s_acctbal = s_acctbal + 100 WHERE s_nationkey = 3 OR s_acctbal < 0")
    return engine.sql("SELECT * FROM supplier").df


@query("SELECT * FROM supplier WHERE NOT (s_acctbal < 2000)")
def dml_delete(spark, d):
    engine = _engine(spark, d, "supplier")
    engine.sql("DELETE FROM supplier WHERE s_acctbal < 2000")
    return engine.sql("SELECT * FROM supplier").df


def _family(spark: SparkSession, d: str, on_nation: str, on_supplier: str) -> Engine:
    """region, nation and supplier with foreign keys between them."""
    engine = Engine(spark, _warehouse(spark))
    engine.sql("CREATE TABLE region (r_regionkey INT PRIMARY KEY, r_name VARCHAR(25) NOT NULL UNIQUE)")
    engine.sql(f"CREATE TABLE nation (n_nationkey INT PRIMARY KEY, n_name VARCHAR(25), n_regionkey INT, FOREIGN KEY (n_regionkey) REFERENCES region (r_regionkey) {on_nation})")
    engine.sql(f"CREATE TABLE supplier (s_suppkey BIGINT PRIMARY KEY, s_name VARCHAR(40), s_nationkey INT, s_acctbal DOUBLE, FOREIGN KEY (s_nationkey) REFERENCES nation (n_nationkey) {on_supplier})")
    work = engine.session()
    work.sql("BEGIN")
    for t in ("region", "nation", "supplier"):
        work.append(t, load(spark, d, t))
    work.sql("COMMIT")
    return engine


@query("SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 1)")
def fk_cascade(spark, d):
    engine = _family(spark, d, "ON DELETE CASCADE", "ON DELETE CASCADE")
    engine.sql("DELETE FROM region WHERE r_regionkey = 1")
    return engine.sql("SELECT s_suppkey, s_nationkey FROM supplier").df


@query("SELECT s_suppkey, CASE WHEN s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) THEN NULL ELSE s_nationkey END AS s_nationkey FROM supplier")
def fk_set_null(spark, d):
    engine = _family(spark, d, "ON DELETE CASCADE", "ON DELETE SET NULL")
    engine.sql("DELETE FROM region WHERE r_regionkey = 2")
    return engine.sql("SELECT s_suppkey, s_nationkey FROM supplier").df


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 3 THEN 33 ELSE n_regionkey END AS n_regionkey FROM nation")
def fk_update_cascade(spark, d):
    engine = _family(spark, d, "ON UPDATE CASCADE", "")
    engine.sql("UPDATE region SET r_regionkey = 33 WHERE r_regionkey = 3")
    return engine.sql("SELECT n_nationkey, n_regionkey FROM nation").df


@query("SELECT * FROM (VALUES (1, 100), (4, 400)) AS t(id, val)")
def txn_savepoint(spark, d):
    engine = Engine(spark, _warehouse(spark))
    for s in ("CREATE TABLE t (id INTEGER PRIMARY KEY, val INTEGER)", "BEGIN", "INSERT INTO t VALUES (1, 100)", "SAVEPOINT a", "INSERT INTO t VALUES (2, 200)", "SAVEPOINT b", "INSERT INTO t VALUES (3, 300)", "ROLLBACK TO SAVEPOINT a", "INSERT INTO t VALUES (4, 400)", "COMMIT"):
        engine.sql(s)
    return engine.sql("SELECT * FROM t").df


# ------------------------------------------- what a statement refuses or undoes


def _told(spark: SparkSession, session, *statements: str) -> list[str]:
    """For each statement ``ok`` or the kind of error it ends with; for a query its one value."""
    out = []
    for text in statements:
        try:
            result = session.sql(text)
            out.append(str(result.rows()[0][0]) if result.df is not None else "ok")
        except Exception as e:
            out.append(type(e).__name__)
    return out


def _steps(spark: SparkSession, told: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(told, 1)), "step int, told string")


def _expect(*told: str) -> str:
    """The oracle of steps; what begins with SELECT is asked of the tables."""
    parts = [f"SELECT {i} AS step, CAST(({t}) AS VARCHAR) AS told" if t.startswith("SELECT") else f"SELECT {i} AS step, '{t}' AS told" for i, t in enumerate(told, 1)]
    return " UNION ALL ".join(parts)


def steps(name: str, setup: Callable[[SparkSession, str], Engine], *pairs: tuple[str, str]) -> None:
    """Statements, each with what it must tell."""
    QUERIES[name] = lambda spark, d: _steps(spark, _told(spark, setup(spark, d), *[text for text, _ in pairs]))
    ORACLE_SQL[name] = _expect(*[told for _, told in pairs])


def _bare(spark: SparkSession, d: str) -> Engine:
    return Engine(spark, _warehouse(spark))


def _with_nations(on_nation: str = "", on_supplier: str = "") -> Callable[[SparkSession, str], Engine]:
    return lambda spark, d: _family(spark, d, on_nation, on_supplier)


_N_REGIONS, _N_NATIONS = "SELECT COUNT(*) FROM region", "SELECT COUNT(*) FROM nation"
steps(
    "check_keys",
    _with_nations(),
    ("INSERT INTO region VALUES (0, 'AGAIN')", "ConstraintError"),
    ("INSERT INTO region VALUES (70, 'X'), (70, 'Y')", "ConstraintError"),
    ("INSERT INTO region VALUES (71, 'EUROPE')", "ConstraintError"),
    ("UPDATE region SET r_regionkey = 1 WHERE r_regionkey = 2", "ConstraintError"),
    (_N_REGIONS, _N_REGIONS),
    ("INSERT INTO region VALUES (72, 'ATLANTIS')", "ok"),
    (_N_REGIONS, "SELECT COUNT(*) + 1 FROM region"),
)
steps("check_not_null", _with_nations(), ("INSERT INTO region VALUES (70, NULL)", "ConstraintError"), ("UPDATE region SET r_name = NULL", "ConstraintError"), ("INSERT INTO region VALUES (NULL, 'X')", "ConstraintError"), (_N_REGIONS, _N_REGIONS))
steps(
    "check_child_needs_parent",
    _with_nations(),
    ("INSERT INTO nation VALUES (100, 'LOST', 77)", "ConstraintError"),
    ("UPDATE nation SET n_regionkey = 77 WHERE n_nationkey = 3", "ConstraintError"),
    ("INSERT INTO nation VALUES (100, 'FREE', NULL), (101, 'BOUND', 1)", "ok"),
    ("SELECT COUNT(*) FROM nation WHERE n_regionkey = 1", "SELECT COUNT(*) + 1 FROM nation WHERE n_regionkey = 1"),
    (_N_NATIONS, "SELECT COUNT(*) + 2 FROM nation"),
)
steps("fk_delete_restrict", _with_nations("ON DELETE RESTRICT"), ("DELETE FROM region WHERE r_regionkey = 1", "ConstraintError"), (_N_REGIONS, _N_REGIONS), ("DELETE FROM nation WHERE n_regionkey = 1 AND n_nationkey > 1000", "ok"), (_N_NATIONS, _N_NATIONS))
steps("fk_update_restrict", _with_nations("ON UPDATE RESTRICT"), ("UPDATE region SET r_regionkey = 33 WHERE r_regionkey = 3", "ConstraintError"), ("SELECT COUNT(*) FROM nation WHERE n_regionkey = 3", "SELECT COUNT(*) FROM nation WHERE n_regionkey = 3"))


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 3 THEN NULL ELSE n_regionkey END AS n_regionkey FROM nation")
def fk_update_set_null(spark, d):
    engine = _family(spark, d, "ON UPDATE SET NULL", "")
    engine.sql("UPDATE region SET r_regionkey = 33 WHERE r_regionkey = 3")
    return engine.sql("SELECT n_nationkey, n_regionkey FROM nation").df


steps(
    "drop_objects",
    _with_nations(),
    ("DROP TABLE region", "EngineError"),
    ("CREATE VIEW v AS SELECT * FROM region", "ok"),
    ("SELECT COUNT(*) FROM v", _N_REGIONS),
    ("DROP VIEW v", "ok"),
    ("SELECT COUNT(*) FROM v", "ParseError"),
    ("CREATE INDEX i ON supplier (s_nationkey)", "ok"),
    ("DROP INDEX i", "ok"),
    ("DROP INDEX i", "EngineError"),
    ("DROP TABLE supplier", "ok"),
    ("SELECT COUNT(*) FROM supplier", "ParseError"),
)
steps(
    "index_unique",
    _with_nations(),
    ("CREATE UNIQUE INDEX by_region ON nation (n_regionkey)", "ConstraintError"),
    ("CREATE UNIQUE INDEX by_name ON nation (n_name)", "ok"),
    ("CREATE UNIQUE INDEX by_name ON nation (n_name)", "EngineError"),
    ("INSERT INTO nation (SELECT 1)", "ParseError"),
    ("INSERT INTO nation VALUES (200, 'NEW', 1), (201, 'NEW', 1)", "ConstraintError"),
    ("INSERT INTO nation VALUES (200, NULL, 1), (201, NULL, 1)", "ok"),
    (_N_NATIONS, "SELECT COUNT(*) + 2 FROM nation"),
)
_T = ("CREATE TABLE t (id INTEGER PRIMARY KEY, val INTEGER)", "ok")
_COUNT, _SUM = "SELECT COUNT(*) FROM t", "SELECT SUM(val) FROM t"
steps("txn_rollback", _bare, _T, ("INSERT INTO t VALUES (1, 10)", "ok"), ("BEGIN", "ok"), ("INSERT INTO t VALUES (2, 20)", "ok"), ("UPDATE t SET val = 11", "ok"), (_SUM, "22"), ("ROLLBACK", "ok"), (_SUM, "10"), ("BEGIN", "ok"), ("BEGIN", "EngineError"), ("COMMIT", "ok"))
steps(
    "txn_release",
    _bare,
    *[_T, ("SAVEPOINT a", "EngineError"), ("BEGIN", "ok"), ("SAVEPOINT a", "ok"), ("INSERT INTO t VALUES (1, 10)", "ok"), ("RELEASE SAVEPOINT a", "ok")],
    *[("ROLLBACK TO SAVEPOINT a", "EngineError"), ("ROLLBACK", "ok"), (_COUNT, "0"), ("BEGIN", "ok"), ("SAVEPOINT b", "ok"), ("INSERT INTO t VALUES (2, 5)", "ok"), ("RELEASE SAVEPOINT b", "ok"), ("COMMIT", "ok"), (_SUM, "5")],
)
steps(
    "txn_poisoned",
    _bare,
    *[_T, ("BEGIN", "ok"), ("INSERT INTO t VALUES (1, 10)", "ok"), ("SAVEPOINT a", "ok"), ("INSERT INTO t VALUES (1, 11)", "ConstraintError"), (_COUNT, "EngineError"), ("ROLLBACK TO SAVEPOINT a", "ok"), (_COUNT, "1")],
    *[("SELECT nothing FROM t", "AnalysisException"), ("INSERT INTO t VALUES (3, 3)", "EngineError"), ("COMMIT", "ok"), (_COUNT, "0")],
)


@query(_expect("ok", "ok", "0", "1", "0", "ok", "Conflict", "1", "10"))
def txn_isolation(spark, d):
    """A session reads as of its BEGIN; of two that change one table the first to commit wins."""
    engine = _bare(spark, d)
    one, two = engine.session(), engine.session()
    told = _told(spark, one, _T[0], "BEGIN", _COUNT)
    two.sql("INSERT INTO t VALUES (1, 10)")
    told += _told(spark, two, _COUNT) + _told(spark, one, _COUNT, "INSERT INTO t VALUES (2, 20)", "COMMIT", _COUNT, _SUM)
    return _steps(spark, told)


@query(_expect("ok", "ok", "ok", "ok", "0", "ok", "2", "12", "EngineError", "ConstraintError"))
def recovery(spark, d):
    """Another engine over the same warehouse has what was committed: rows, definitions, keys; and no more."""
    place = _warehouse(spark)
    told = _told(spark, Engine(spark, place), "CREATE TABLE t (id INTEGER PRIMARY KEY, val INTEGER)", "BEGIN", "CREATE TABLE u (a INTEGER)", "INSERT INTO t VALUES (9, 9)")
    told += _told(spark, Engine(spark, place), "SELECT COUNT(*) FROM u", "INSERT INTO t VALUES (1, 5), (2, 7)")
    return _steps(spark, told + _told(spark, Engine(spark, place), _COUNT, _SUM, "CREATE TABLE u (a INTEGER)", "INSERT INTO t VALUES (1, 6)"))


@query(_expect("ok", "ok", "ok", "1", "0"))
def session_close(spark, d):
    """A session that ends inside a transaction leaves nothing behind."""
    engine = _bare(spark, d)
    session = engine.session()
    told = _told(spark, session, _T[0], "BEGIN", "INSERT INTO t VALUES (1, 1)", _COUNT)
    session.close()
    return _steps(spark, told + _told(spark, engine.session(), _COUNT))


@query("SELECT TRUE AS planned, TRUE AS names_the_table, 0 AS changed")
def explain_statement(spark, d):
    """EXPLAIN gives a plan as one row and runs nothing."""
    engine = _engine(spark, d, "nation")
    (text,) = engine.sql("EXPLAIN SELECT n_name FROM nation WHERE n_regionkey = 1").rows()[0]
    (delete,) = engine.sql("EXPLAIN DELETE FROM nation WHERE n_regionkey = 1").rows()[0]
    changed = load(spark, d, "nation").count() - engine.sql("SELECT COUNT(*) FROM nation").rows()[0][0]
    return spark.createDataFrame([("Physical Plan" in text and "Filter" in text, "nation" in delete, changed)], "planned boolean, names_the_table boolean, changed int")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def dbapi_rows(spark, d):
    """Rows as the DB-API gives them."""
    from . import dbapi

    place = _warehouse(spark)
    Engine(spark, place).register("nation", load(spark, d, "nation"))
    connection = dbapi.connect(place, spark=spark)
    cursor = connection.cursor()
    cursor.execute("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = ?", (2,))
    return spark.createDataFrame([tuple(r) for r in cursor.fetchall()], load(spark, d, "nation").select(*[c[0] for c in cursor.description]).schema)


# -------------------------------------------------------------------- flagship

_Q3 = """SELECT o_orderkey, {rev} AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < '1998-03-15' AND l_shipdate > '1998-03-15' GROUP BY o_orderkey, o_orderdate ORDER BY revenue DESC, o_orderkey LIMIT 10"""


@query(_Q3.format(rev=DEC("l_extendedprice * (1 - l_discount)")))
def flagship_q3(spark, d):
    customer = op.filter_(load(spark, d, "customer"), col("c_mktsegment") == "BUILDING")
    orders = op.filter_(load(spark, d, "orders"), col("o_orderdate") < lit("1998-03-15"))
    lines = op.filter_(load(spark, d, "lineitem"), col("l_shipdate") > lit("1998-03-15"))
    df = op.join(op.join(customer, orders, col("c_custkey") == col("o_custkey")), lines, col("l_orderkey") == col("o_orderkey"))
    revenue = dec_sum(col("l_extendedprice") * (1 - col("l_discount"))).alias("revenue")
    df = op.group(df, ["o_orderkey", "o_orderdate"], [revenue])
    return op.project(op.top_n(df, [("revenue", False), "o_orderkey"], 10), "o_orderkey", "revenue", "o_orderdate")


@query(f"""SELECT l_returnflag, l_linestatus, {DEC('l_quantity')} AS sum_qty, {DEC('l_extendedprice')} AS sum_base, {DEC('l_extendedprice * (1 - l_discount)')} AS sum_disc,
{DEC('l_extendedprice * (1 - l_discount) * (1 + l_tax)')} AS sum_charge, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= '2000-09-01' GROUP BY l_returnflag, l_linestatus""")
def pricing_summary_q1(spark, d):
    disc = col("l_extendedprice") * (1 - col("l_discount"))
    sums = {"sum_qty": col("l_quantity"), "sum_base": col("l_extendedprice"), "sum_disc": disc, "sum_charge": disc * (1 + col("l_tax"))}
    df = op.filter_(load(spark, d, "lineitem"), col("l_shipdate") <= lit("2000-09-01"))
    return op.group(df, ["l_returnflag", "l_linestatus"], [*[dec_sum(v).alias(k) for k, v in sums.items()], F.count(lit(1)).alias("n")])
