"""The few operations that the catalogue's queries are put together from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def desc(name: str) -> Column:
    """Descending as the graph language orders: null first."""
    return F.col(name).desc_nulls_first()


def asc(name: str) -> Column:
    """Ascending as the graph language orders: null last."""
    return F.col(name).asc_nulls_last()


def distinct_offers(df: DataFrame, *keys: str, name: str = "ofertas") -> DataFrame:
    return df.groupBy(*keys).agg(F.countDistinct("oferta").alias(name))


def top(df: DataFrame, k: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first k rows with their rank. Only those k rows meet in one task: every partition sends its own
    first k."""
    return df.orderBy(*order).limit(k).withColumn(rank, F.row_number().over(Window.orderBy(*order)).cast("long"))


def top_of_each(df: DataFrame, k: int, per: list[str], *order: Column, rank: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank."""
    w = Window.partitionBy(*per).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("long")).filter(F.col(rank) <= k)


def with_total(df: DataFrame, column: str, name: str = "total_assignments", per: list[str] | None = None) -> DataFrame:
    """Adds the column's sum over all rows or over each group. A sum over all is one broadcast row, not a
    window that would gather the rows."""
    if per:
        return df.withColumn(name, F.sum(column).over(Window.partitionBy(*per)))
    return df.crossJoin(F.broadcast(df.agg(F.sum(column).alias(name))))


def share(part: str, whole: str) -> Column:
    """part / whole as a double; null where whole is 0 or null."""
    return F.try_divide(F.col(part).cast("double"), F.col(whole))


def gate(status: DataFrame, rows: DataFrame) -> DataFrame:
    """The status row alone unless its availability is 'available'; then it beside each row."""
    return F.broadcast(status).join(rows, F.col("availability") == "available", "left")


def only_if_available(*names: str) -> list[Column]:
    return [F.when(F.col("availability") == "available", F.col(n)).alias(n) for n in names]


def nothing(name: str, kind: str = "long") -> Column:
    return F.lit(None).cast(kind).alias(name)


def union_of(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of either."""
    return a.unionByName(b).distinct()


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of both, such as what is taught and also asked for."""
    return a.intersect(b)


def without(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Rows of a that b doesn't have, such as what is asked for and not taught."""
    return a.join(b, on, "left_anti")
