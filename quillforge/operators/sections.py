"""Cached sections of a build as tables: results, skip and restore tests, execution by tiers, expiry, folders.

sections: section, parent (null at a root), loaded. results: section, path, hash, category, is_end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def section_key(version: str, category: str, hashes: Column, settings: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(version), F.lit(category), hashes, settings))


def descendants(sections: DataFrame, most: int = 64) -> DataFrame:
    """(root, section, depth) of each section with itself and all below it, by doubling: log2 of the depth in joins."""
    up = sections.filter("parent is not null").select("section", F.col("parent").alias("above"), F.lit(1).alias("step"))
    reach, step = up, up
    while most > 1:
        longer = reach.alias("a").join(step.alias("b"), F.col("a.above") == F.col("b.section")).select("a.section", "b.above", (F.col("a.step") + F.col("b.step")).alias("step"))
        reach = reach.unionByName(longer).distinct()
        step = step.alias("a").join(step.alias("b"), F.col("a.above") == F.col("b.section")).select("a.section", "b.above", (F.col("a.step") + F.col("b.step")).alias("step"))
        most //= 2
    own = sections.select(F.col("section").alias("root"), "section", F.lit(0).alias("depth"))
    return own.unionByName(reach.select(F.col("above").alias("root"), "section", F.col("step").alias("depth")))


def all_results(tree: DataFrame, results: DataFrame, category: str | None = None, end: bool | None = None) -> DataFrame:
    """(root, ...) results of each section and of all below it, of a category and kind if asked for."""
    rows = tree.select("root", "section").join(results, "section")
    rows = rows.filter(F.col("category") == category) if category is not None else rows
    return rows.filter(F.col("is_end") == end) if end is not None else rows


def can_skip(tree: DataFrame, sections: DataFrame, results: DataFrame, present: DataFrame, changed: DataFrame) -> DataFrame:
    """(root, can_skip): every section below is loaded, there is an end result, all end results lie at their place with equal hash, nothing it depends on changed.

    present: path, hash now. changed: section (with a dependency that changed).
    """
    loaded = tree.join(sections.select("section", "loaded"), "section").groupBy("root").agg(F.bool_and("loaded").alias("loaded"))
    ends = all_results(tree, results, end=True).join(present.select("path", F.col("hash").alias("now")), "path", "left")
    ends = ends.groupBy("root").agg(F.bool_and(F.coalesce(F.col("now") == F.col("hash"), F.lit(False))).alias("there"))
    moved = tree.join(changed.select("section").distinct(), "section", "left_semi").select("root").distinct().withColumn("moved", F.lit(True))
    out = loaded.join(ends, "root", "left").join(moved, "root", "left")
    return out.select("root", (F.col("loaded") & F.coalesce("there", F.lit(False)) & F.col("moved").isNull()).alias("can_skip"))


def can_restore(tree: DataFrame, results: DataFrame, cached: DataFrame, changed: DataFrame) -> DataFrame:
    """(root, can_restore): every result is in the cache (hash), and nothing it depends on changed."""
    rows = all_results(tree, results).join(cached.select("hash", F.lit(True).alias("held")).distinct(), "hash", "left")
    held = rows.groupBy("root").agg(F.bool_and(F.coalesce("held", F.lit(False))).alias("held"))
    moved = tree.join(changed.select("section").distinct(), "section", "left_semi").select("root").distinct().withColumn("moved", F.lit(True))
    out = tree.select("root").distinct().join(held, "root", "left").join(moved, "root", "left")
    return out.select("root", (F.coalesce("held", F.lit(True)) & F.col("moved").isNull()).alias("can_restore"))


def tiers(skip: DataFrame, restore: DataFrame) -> DataFrame:
    """(root, tier): skip, else restore, else run."""
    tier = F.when(F.coalesce("can_skip", F.lit(False)), "skip").when(F.coalesce("can_restore", F.lit(False)), "restore").otherwise("run")
    return skip.join(restore, "root", "full_outer").select("root", tier.alias("tier"))


def expired(files: DataFrame, written: str, hours: int, now: Column | None = None) -> DataFrame:
    """Files older than so many hours, before now or before the newest of them."""
    if now is None:
        newest = files.agg(F.max(written).alias("__now"))
        return files.crossJoin(F.broadcast(newest)).filter(F.col(written) < F.col("__now") - F.expr(f"interval {hours} hours")).drop("__now")  # one row beside each
    return files.filter(F.col(written) < now - F.expr(f"interval {hours} hours"))


def free_folders(used: DataFrame, folder: str, wanted: int, prefix: str = "CF") -> DataFrame:
    """The first so many unused names CF1, CF2, ...: among the first n + used numbers n are free."""
    n = used.select(folder).distinct().filter(F.col(folder).rlike(f"^{prefix}[0-9]+$"))
    numbers = used.sparkSession.range(1, wanted + n.count() + 1).select("id", F.concat(F.lit(prefix), F.col("id").cast("string")).alias(folder))
    return numbers.join(n, folder, "left_anti").orderBy("id").limit(wanted).select(folder)


def same_hash(length: Column, modified: Column, seen_length: Column, seen_modified: Column, seen_hash: Column) -> Column:
    """The hash seen before if length and time are unchanged, else null: the file must be read."""
    return F.when((length == seen_length) & (modified == seen_modified), seen_hash)


def dependency_graph(sections: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, target, kind): distinct links from sections to parts and to the files they read."""
    parts = sections.filter("parent is not null").select(F.col("parent").cast("string").alias("source"), F.col("section").cast("string").alias("target"), F.lit("section").alias("kind"))
    return parts.unionByName(sources.select(F.col("section").cast("string").alias("source"), F.col("path").cast("string").alias("target"), F.lit("file").alias("kind"))).distinct()
