"""Column bookkeeping, sorting rules and reshaping."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def rename_positional(df: DataFrame, names: Sequence[str]) -> DataFrame:
    if len(names) != len(df.columns):
        raise ValueError(f"{len(names)} names for {len(df.columns)} columns")
    return df.toDF(*names)


def relocate(
    df: DataFrame,
    columns: Sequence[str] = (),
    prefix: str | None = None,
    before: str | None = None,
    after: str | None = None,
) -> DataFrame:
    """Move columns, named or found by prefix, to the front or next to another one."""
    moved = [c for c in df.columns if c in columns or (prefix and c.startswith(prefix))]
    rest = [c for c in df.columns if c not in moved]
    if before is not None:
        at = rest.index(before)
    elif after is not None:
        at = rest.index(after) + 1
    else:
        at = 0
    return df.select(*rest[:at], *moved, *rest[at:])


def ascending(column: str) -> Column:
    return F.col(column).asc_nulls_last()


def descending(column: str) -> Column:
    return F.col(column).desc_nulls_last()


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*[ascending(c) for c in order]).limit(n)


def tail(df: DataFrame, n: int, *order: str) -> DataFrame:
    last = df.orderBy(*[F.col(c).desc_nulls_first() for c in order]).limit(n)
    return last.orderBy(*[ascending(c) for c in order])


def sorted_counts(df: DataFrame, *by: str) -> DataFrame:
    """Most frequent first; ties in the order of the key."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *by)


def bind_rows(*parts: DataFrame) -> DataFrame:
    """All rows; columns are matched by name and filled with NULL where absent."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def unpivot_matching(
    df: DataFrame, ids: Sequence[str], contains: str, name: str = "name", value: str = "value"
) -> DataFrame:
    """Columns whose name holds the given text become rows."""
    columns = [c for c in df.columns if c not in ids and contains in c]
    return df.unpivot(list(ids), columns, name, value)
