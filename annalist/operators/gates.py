"""Checks that run before anything is written: each returns its violations as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class GateError(RuntimeError):
    pass


def require_empty(problems: DataFrame, what: str, show: int = 5) -> None:
    """Raises with a few of the rows, if there are any."""
    found = [r.asDict() for r in problems.limit(show).collect()]
    if found:
        raise GateError(f"{what}: {found}")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).count().where("count > 1")


def orphans(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose key no parent has."""
    return rows.where(F.col(key).isNotNull()).join(parents.select(key).distinct(), key, "left_anti")


def not_in_set(rows: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    return rows.where(F.col(column).isNotNull() & ~F.col(column).isin(allowed))


def floor_problems(counts: DataFrame, years: tuple[int, int], groups: DataFrame, group: str, least: int, year: str = "y", n: str = "n") -> DataFrame:
    """Cells of the dense grid years x groups (both bounded by nature) below ``least``; a missing cell counts 0."""
    spark = counts.sparkSession
    grid = spark.range(years[0], years[1] + 1).select(F.col("id").alias(year)).crossJoin(F.broadcast(groups.select(group).distinct()))
    return grid.join(counts, [year, group], "left").select(year, group, F.coalesce(n, F.lit(0)).alias(n)).where(F.col(n) < least)


def conservation(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """One row if the sums differ."""
    return before.agg(F.sum(column).alias("a")).crossJoin(after.agg(F.sum(column).alias("b"))).where("NOT (a <=> b)")


def agreement(rows: DataFrame, a: Column, b: Column, tolerance: float) -> DataFrame:
    """checked, disagree: how many rows have both values, and how many of these differ by more."""
    return rows.where(a.isNotNull() & b.isNotNull()).agg(F.count("*").alias("checked"), F.count_if(F.abs(a - b) > tolerance).alias("disagree"))


def require_agreement(found: DataFrame, share: float = 0.02) -> None:
    r = found.first()
    if r.checked and r.disagree > share * r.checked:
        raise GateError(f"{r.disagree} of {r.checked} rows disagree")


def outcome_sums(index: DataFrame) -> DataFrame:
    """People whose outcomes do not add up to their matches (n, w, l, d, nc)."""
    return index.where("n <> w + l + d + nc")
