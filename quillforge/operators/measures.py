"""Timings of sections: groups, sums, self time, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def build_groups(rows: DataFrame, section: str, name: str, count: str, duration: str) -> DataFrame:
    """(label, count, duration): first sums by section, then by name; a name with sections in parallel (two or more) says so."""
    first = rows.groupBy(section, name).agg(F.sum(count).alias("c"), F.sum(duration).alias("d"))
    g = first.groupBy(name).agg(F.sum("c").alias("count"), F.sum("d").alias("duration"), F.count(F.lit(1)).alias("n"))
    return g.select(F.concat(name, F.when(F.col("n") >= 2, " - Multi-Threaded").otherwise("")).alias("label"), "count", "duration")


def summary(rows: DataFrame, name: str, count: str, duration: str) -> DataFrame:
    """By the first part of dotted names: the least count and the sum of durations."""
    return rows.groupBy(F.split(name, "[.]")[0].alias("part")).agg(F.min(count).alias("count"), F.sum(duration).alias("duration"))


def add_maps(*maps: DataFrame, key: str, value: str) -> DataFrame:
    """Maps (key, value) added key by key."""
    rows = maps[0]
    for m in maps[1:]:
        rows = rows.unionByName(m)
    return rows.groupBy(key).agg(F.sum(value).alias(value))


def elapsed_ms(began: Column, ended: Column) -> Column:
    return (F.unix_micros(ended.cast("timestamp")) - F.unix_micros(began.cast("timestamp"))) / F.lit(1000.0)


def self_times(log: DataFrame, thread: str, at: str, order: str, opens: str, name: str) -> DataFrame:
    """(thread, name, ms): exclusive time of nested sections of a log of openings and closings.

    The time from each entry to the next belongs to the section on top of the stack: the last one that was
    opened at the depth that the entry leaves.
    """
    line = Window.partitionBy(thread).orderBy(at, order)
    rows = log.withColumn("depth", F.sum(F.when(F.col(opens), 1).otherwise(-1)).over(line)).withColumn("until", F.lead(at).over(line))
    owner = F.last(F.when(F.col(opens), F.col(name)), ignorenulls=True).over(Window.partitionBy(thread, "depth").orderBy(at, order))
    rows = rows.withColumn("owner", F.when(F.col("depth") > 0, owner)).filter("owner is not null and until is not null")
    return rows.groupBy(thread, F.col("owner").alias("name")).agg(F.sum(elapsed_ms(F.col(at), F.col("until"))).alias("ms"))


def roll_up(rows: DataFrame, parent: str, name: str, duration: str) -> DataFrame:
    """Durations by section and by its parent, and all together."""
    return rows.rollup(parent, name).agg(F.count(F.lit(1)).alias("n"), F.sum(duration).alias("duration"))


def csv_lines(report: DataFrame, name: str, duration: str, percent: str, count: str, mean: str) -> DataFrame:
    """A quoted line for each row of a report: type, duration, share, count, mean."""
    cell = lambda c: F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))
    return report.select(F.concat_ws(",", *[cell(c) for c in (name, duration, percent, count, mean)]).alias("line"))


def text_lines(report: DataFrame, name: str, duration: str, count: str, width: int = 40) -> DataFrame:
    """A padded line for each row of a report."""
    return report.select(F.concat(F.rpad(name, width, " "), F.lpad(F.col(duration).cast("string"), 14, " "), F.lpad(F.col(count).cast("string"), 10, " ")).alias("line"))
