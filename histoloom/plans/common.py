"""Helpers of the query modules. Doubles are rounded to 6 places on both engines before they are compared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import dealt
from .views import oracle, table, tables_by_commit

Query = Callable[[SparkSession, str], DataFrame]


def r6(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{n}`"), 6).alias(n) if t in ("double", "float") else F.col(f"`{n}`") for n, t in df.dtypes])


def rs(*names: str) -> str:
    """SQL that rounds the named columns."""
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def query(fn: Callable[..., DataFrame], *tables: str) -> Query:
    """``fn`` of the named tables or views."""
    return lambda spark, sf_dir: r6(fn(*[table(spark, sf_dir, t) for t in tables]))


def query_by_commit(fn: Callable[..., DataFrame], *views: str, used: tuple[str, ...] | None = None) -> Query:
    """``fn`` of the named views, which join and group by commit over and over: their sources are dealt by commit once. Of ``used``, if given; ``fn``
    reads no rows of the others."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        there = tables_by_commit(spark, sf_dir, [v for v in views if used is None or v in used])
        return r6(fn(*[there[v] if v in there else table(spark, sf_dir, v) for v in views]))

    return run


def unwritten(views: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Those of the views that are not written yet, to be dealt by commit where they name one."""
    left = {name: v for name, v in views.items() if not getattr(v, "_kept", False)}
    key = lambda v: next((c for c in ("commit_hash", "hash") if c in v.columns), None)
    return {name: dealt(v, key(v)) if key(v) else v for name, v in left.items()}


__all__ = ["Query", "oracle", "query", "query_by_commit", "r6", "rs", "table", "unwritten"]
