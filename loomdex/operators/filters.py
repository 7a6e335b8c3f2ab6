"""Metadata filters: a dict becomes a predicate over columns.

The same compiler serves Spark columns (one filter for a whole job) and pandas
series (one filter per query, inside the nearest-chunk kernel), since both
spell comparisons alike. Nulls mean the same in both: a null is equal to null
only, so it passes ``$ne`` and ``$nin`` and fails every other test.
"""

from __future__ import annotations

import operator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

#: Tests of a value that is there, and what a null gives.
COMPARE = {
    "$eq": operator.eq,
    "$ne": operator.ne,
    "$gt": operator.gt,
    "$gte": operator.ge,
    "$lt": operator.lt,
    "$lte": operator.le,
    "$in": lambda column, values: column.isin(list(values)),
    "$nin": lambda column, values: ~column.isin(list(values)),
}
OF_NULL = {"$ne": True, "$nin": True}
JOIN = {"$and": operator.and_, "$or": operator.or_}


def test(column, op: str, value):
    """One comparison of a Spark column or a pandas series."""
    series = isinstance(column, pd.Series)
    if op not in COMPARE:
        raise ValueError(f"unknown filter operator {op}")
    if value is None:
        if op not in ("$eq", "$ne"):
            raise ValueError(f"{op} needs a value")
        missing = column.isna() if series else column.isNull()
        return missing if op == "$eq" else ~missing
    if op in ("$in", "$nin") and None in value:
        known = test(column, op, [v for v in value if v is not None])
        return known | test(column, "$eq", None) if op == "$in" else known & test(column, "$ne", None)
    if not series:
        return F.coalesce(COMPARE[op](column, value), F.lit(OF_NULL.get(op, False)))
    there = column.notna()
    result = np.full(len(column), OF_NULL.get(op, False))
    if comparable(column[there], op, value):
        result[there.to_numpy()] = COMPARE[op](column[there], value).to_numpy(dtype=bool)
    return pd.Series(result, index=column.index)


def comparable(column: pd.Series, op: str, value) -> bool:
    """Whether ``op`` can tell anything; a value of another kind than the column's is neither more nor less."""
    if op not in ("$gt", "$gte", "$lt", "$lte"):
        return True
    kind = pd.api.types.infer_dtype(column)
    if kind in ("datetime64", "datetime", "date"):
        return not isinstance(value, (int, float)) and not pd.isna(pd.to_datetime(value, errors="coerce"))
    return (kind == "string") if isinstance(value, str) else kind in ("integer", "floating", "mixed-integer-float", "decimal", "boolean")


def columns_of(where: dict | None) -> set[str]:
    """The columns a filter names."""
    named = set()
    for key, wanted in (where or {}).items():
        named |= set().union(*map(columns_of, wanted)) if key in JOIN else {key}
    return named


def compile_filter(where: dict | None, column_of):
    """Predicate of ``where``, or None when it asks for nothing.

    Several keys, or several operators on one key, must all hold. An empty
    part asks for nothing, so it makes a whole ``$or`` ask for nothing.
    """
    parts = []
    for key, wanted in (where or {}).items():
        if key in JOIN:
            inner = [compile_filter(w, column_of) for w in wanted]
            asked = [p for p in inner if p is not None]
            if asked and (key == "$and" or len(asked) == len(inner)):
                parts.append(reduce(JOIN[key], asked))
        elif key.startswith("$"):
            raise ValueError(f"unknown filter operator {key}")
        else:
            tests = wanted if isinstance(wanted, dict) else {"$eq": wanted}
            parts += [test(column_of(key), op, value) for op, value in tests.items()]
    return reduce(operator.and_, parts) if parts else None


def metadata_filter(df, where: dict | None):
    """Rows of ``df`` that pass ``where``."""
    predicate = compile_filter(where, lambda name: df[name])
    return df if predicate is None else df.where(predicate)
