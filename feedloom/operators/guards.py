"""Checks that count violations instead of raising, and small conversions: each is an aggregation or an expression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checks(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """(check, violations): rows for which each condition holds, all in one pass; a null condition is no violation."""
    one = rows.agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])
    return one.unpivot([], list(conditions), "check", "violations")


def lost_rows(before: DataFrame, after: DataFrame, name: str) -> DataFrame:
    """(check, violations): by how many rows a join that should keep the number of rows changed it."""
    n = before.agg(F.count("*").alias("a")).crossJoin(after.agg(F.count("*").alias("b")))
    return n.select(F.lit(name).alias("check"), F.abs(F.col("a") - F.col("b")).alias("violations"))


def not_within(part: DataFrame, whole: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(check, violations): keys of ``part`` that ``whole`` lacks."""
    return part.select(*keys).distinct().join(whole.select(*keys).distinct(), keys, "left_anti").agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")


def repeated(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(check, violations): rows beyond the first of each key."""
    n = rows.groupBy(*keys).agg((F.count("*") - 1).alias("more"))
    return n.agg(F.coalesce(F.sum("more"), F.lit(0)).alias("violations")).select(F.lit(name).alias("check"), "violations")


def differing(runs: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """(check, violations): groups of runs in which a column that must agree has several values (null counts as one)."""
    per = runs.groupBy(*group).agg(*[(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in columns])
    return checks(per, {c: F.col(c) > 1 for c in columns})


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def drop_constants(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """``rows`` without the columns of a single value, null being a value, and their names."""
    n = rows.agg(*[(F.count_distinct(F.col(f"`{c}`")) + F.max(F.col(f"`{c}`").isNull().cast("int"))).alias(c) for c in rows.columns]).first()
    gone = [c for c in rows.columns if (n[c] or 0) <= 1]
    return rows.drop(*gone), gone


def end_of_local_day(date: Column, hours: int = 8) -> Column:
    """Last millisecond, in UTC, of a local day written YYYYMMDD."""
    start = F.unix_seconds(F.to_timestamp(F.concat(date.cast("string"), F.lit(" UTC")), "yyyyMMdd z"))
    return (start + 24 * 3600 - hours * 3600) * 1000 - 1


def days_since_epoch(date: Column) -> Column:
    """Days since 1970-01-01 of a day written YYYYMMDD; 0, null and what is no day give 0."""
    return F.coalesce(F.datediff(F.try_to_date(date.cast("string"), "yyyyMMdd"), F.lit("1970-01-01").cast("date")), F.lit(0))


def hour_of(hourmin: Column) -> Column:
    """Hour of hour * 100 + minute, held between 0 and 23."""
    return F.least(F.greatest(F.floor(hourmin / 100), F.lit(0)), F.lit(23)).cast("int")


def whole_or_zero(text: Column) -> Column:
    """The number a text spells when its hyphens are left out, else 0."""
    return F.coalesce(F.replace(text, F.lit("-"), F.lit("")).try_cast("int"), F.lit(0))


def fingerprint(*columns: str) -> Column:
    """SHA-256 of a row's columns as JSON, keys in ascending order, nulls left out."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)
