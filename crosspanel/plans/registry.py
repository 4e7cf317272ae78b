"""The query registry: each query pairs a Spark job with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosspanel.sources.tables import Tables


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    columns: tuple[tuple[str, str], ...]
    sql: str | None


# Rounding used on both sides of a comparison.  The extra 1e-5 keeps exact decimal ties
# (prices are cents over a quantity) from going up in one engine and down in the other.
HALF_UP = 0.50001

# From here on every double is whole; Spark's floor() gives a bigint, which ends not far above.
ALL_WHOLE = 2.0**53

REGISTRY: dict[str, Query] = {}


def _columns(spec: str) -> tuple[tuple[str, str], ...]:
    """Parse ``"date:d symbol n:i x:6"`` into (name, format) pairs.

    d = DATE written as text, i = BIGINT, s = unchanged, a number = digits kept.
    """
    pairs = []
    for item in spec.split():
        name, _, fmt = item.partition(":")
        pairs.append((name, fmt or "s"))
    return tuple(pairs)


def _spark_column(name: str, fmt: str):
    col = F.col(name)
    if fmt == "d":
        col = F.date_format(col, "yyyy-MM-dd")
    elif fmt == "i":
        col = col.cast("bigint")
    elif fmt.isdigit():
        scale = 10.0 ** int(fmt)
        col = col.cast("double") * scale + HALF_UP
        col = F.when(F.abs(col) < ALL_WHOLE, F.floor(col).cast("double")).otherwise(col) / F.lit(scale)
    return col.alias(name)


def _sql_column(name: str, fmt: str) -> str:
    ref = f'"{name}"'
    if fmt == "d":
        return f"strftime({ref}, '%Y-%m-%d') AS {ref}"
    if fmt == "i":
        return f"CAST({ref} AS BIGINT) AS {ref}"
    if fmt.isdigit():
        scale = f"1e{fmt}"
        return f"FLOOR(CAST({ref} AS DOUBLE) * {scale} + {HALF_UP}) / {scale} AS {ref}"
    return ref


def query(name: str, spec: str, sql: str | None = None, ctes: str = ""):
    """Register a job under ``name``.

    ``spec`` fixes the output columns and the digits compared; ``sql`` is the body of
    the equivalent SQL, with the shared CTEs it needs listed in ``ctes``.
    """

    def register(build):
        from crosspanel.plans.sql import with_clause

        columns = _columns(spec)
        full = None
        if sql is not None:
            picked = ", ".join(_sql_column(n, f) for n, f in columns)
            full = f"{with_clause(ctes.split())}SELECT {picked} FROM (\n{sql}\n) AS result"
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, build, columns, full)
        return build

    return register


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    q = REGISTRY[name]
    tables = Tables(spark, folder)
    tables.size_shuffles()
    df = q.build(tables)
    return df.select(*[_spark_column(n, f) for n, f in q.columns])
