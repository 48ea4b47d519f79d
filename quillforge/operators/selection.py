"""What is built and what is reported: overrides, output filters, message levels and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _any(text: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(F.lower(text), F.lit(p.lower()))
    return out


def ignored(keys: DataFrame, item: str, group: str, key: str, wanted: dict[str, list[str]]) -> DataFrame:
    """(item, ignore): an item is ignored if in some group every key of it is; a key is if none of the group's wanted parts is in it.

    A group without wanted parts ignores nothing.
    """
    hit = F.lit(False)
    for name, parts in wanted.items():
        if parts:
            hit = hit | ((F.col(group) == name) & ~_any(F.col(key), parts))
    by = keys.groupBy(item, group).agg(F.bool_and(hit).alias("all"))
    return by.groupBy(item).agg(F.bool_or("all").alias("ignore"))


def output_ignored(output: Column, wanted: list[str]) -> Column:
    """Whether an output is left out: there are wanted parts and none is in it; a part with a dot counts only for outputs with more than one dot."""
    if not wanted:
        return F.lit(False)
    dots = F.length(output) - F.length(F.replace(output, F.lit("."), F.lit("")))
    hit = F.lit(False)
    for p in wanted:
        one = F.contains(F.lower(output), F.lit(p.lower()))
        hit = hit | ((one & (dots > 1)) if "." in p else one)
    return ~hit


def image_ignored(path: Column, listed: list[str]) -> Column:
    """Whether an image is listed, by itself or by its folder with a star."""
    p = F.lower(F.translate(path, "\\", "/"))
    out = F.lit(False)
    for x in (y.lower().replace("\\", "/") for y in listed):
        out = out | (p.startswith(x[:-1]) if x.endswith("/*") else p == x)
    return out


def at_level(errors: DataFrame, severity: str, level: int) -> DataFrame:
    """Errors that are as severe as the level, or more (0 is the most severe)."""
    return errors.filter(F.col(severity) <= level)


def distinct_errors(errors: DataFrame, line: str = "line", column: str = "column", message: str = "message") -> DataFrame:
    """Each error once by its place and message."""
    return errors.dropDuplicates([line, column, message])


def messages(errors: DataFrame, text: Column) -> DataFrame:
    """Each formatted message once."""
    return errors.select(text.alias("message")).distinct()


def path_order(path: Column) -> list[Column]:
    """Paths by code point ignoring case; equal ones by the path itself."""
    return [F.lower(path), path]


def false_first_then_most(flag: Column, amount: Column) -> list[Column]:
    return [flag.asc(), amount.desc()]


def but_first(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """All rows of a key but the first."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__r > 1").drop("__r")


def top(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of a total order (each task keeps its own n; no full sort)."""
    return rows.orderBy(*order).limit(n)


def backwards(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The place of each row of a key from the end, from 1."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order))))


def at_least(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Keys with at least n rows."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= n).drop("n")


def members(rows: DataFrame, column: str, listed: DataFrame) -> DataFrame:
    """rows whose value is in a set."""
    return rows.join(listed.select(column).distinct(), column, "left_semi")
