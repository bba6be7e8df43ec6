"""Relational operators over DataFrames. Every one is a lazy plan; Catalyst picks
the physical strategy (broadcast, sort-merge or hashed joins, partial aggregation,
top-n, pushed-down filters)."""

from .relational import (
    anti_join,
    count_rows,
    derived,
    distinct,
    except_,
    except_all,
    filter_,
    group,
    group_with_medians,
    having,
    intersect,
    intersect_all,
    is_small,
    join,
    limit,
    mark_in,
    not_in,
    project,
    scan,
    semi_join,
    sort,
    top_n,
    union,
    union_all,
    values,
)

__all__ = [
    "anti_join",
    "count_rows",
    "derived",
    "distinct",
    "except_",
    "except_all",
    "filter_",
    "group",
    "group_with_medians",
    "having",
    "intersect",
    "intersect_all",
    "is_small",
    "join",
    "limit",
    "mark_in",
    "not_in",
    "project",
    "scan",
    "semi_join",
    "sort",
    "top_n",
    "union",
    "union_all",
    "values",
]
