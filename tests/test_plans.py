"""The plans are the ones that scale."""

from __future__ import annotations

from brindle.plans import explain_text
from brindle.queries import QUERIES


def plan(spark, sf_dir, name):
    return explain_text(QUERIES[name](spark, sf_dir))


def test_filters_and_columns_reach_the_reader(spark, sf_dir):
    text = plan(spark, sf_dir, "index_point_lookup")
    assert "EqualTo(o_orderkey,42)" in text and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double>" in text


def test_topn_keeps_no_full_sort(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan(spark, sf_dir, "topn_offset")


def test_equi_joins_never_become_products(spark, sf_dir):
    for name in ("join_equi", "join_multi", "flagship_q3", "in_subquery", "join_and_condition"):
        text = plan(spark, sf_dir, name)
        assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_not_in_stays_an_equi_join(spark, sf_dir):
    text = plan(spark, sf_dir, "not_in_subquery")
    assert "LeftAnti" in text and "Left keys [1]" in text


def test_no_python_in_the_engine(spark, sf_dir):
    told = ("dml", "fk", "txn", "view", "check", "drop", "index_unique", "recovery", "session", "explain", "dbapi")  # rows that the driver makes
    for name in QUERIES:
        if not name.startswith(told):
            assert "Python" not in plan(spark, sf_dir, name), name


def test_in_under_or_stays_an_equi_join(spark, sf_dir):
    for name in ("not_in_subquery_or", "in_subquery_or"):
        text = plan(spark, sf_dir, name)
        assert "Left keys [1]" in text and "ExistenceJoin" not in text


def test_median_of_large_inputs_holds_no_group(spark, sf_dir, monkeypatch):
    from brindle import operators
    from brindle.operators import relational

    assert "percentile_approx" not in plan(spark, sf_dir, "agg_median")
    monkeypatch.setattr(relational, "SMALL_BYTES", 0)
    assert not operators.is_small(spark.range(3))
    text = plan(spark, sf_dir, "agg_median")
    assert "percentile_approx" in text and "median(" not in text
