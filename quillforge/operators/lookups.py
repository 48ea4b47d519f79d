"""Joins by which assets find each other: lookups with fallbacks, rename logs, tokens, resolutions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(rows: DataFrame, table: DataFrame, key: str, value: str, fallback: Column | None = None, must: bool = False) -> DataFrame:
    """rows with the value of their key (table has one row a key), else the fallback; where both lack and it must be there, reading the row raises."""
    out = rows.join(table.select(key, F.col(value).alias("__value")), key, "left")
    found = F.coalesce("__value", fallback) if fallback is not None else F.col("__value")
    if must:
        kind = table.schema[value].dataType
        found = F.when(found.isNull(), F.raise_error(F.concat(F.lit("nothing found for "), F.col(key).cast("string"))).cast(kind)).otherwise(found)
    return out.select(*rows.columns, found.alias(value))


def lookup_first(rows: DataFrame, table: DataFrame, keys: list[str], order: list[str], values: list[str], fold: list[str] = ()) -> DataFrame:
    """rows with the values of the first table row, in a stated order, of their composite key; keys in fold ignore case."""
    k = [(F.lower(c) if c in fold else F.col(c)).alias(f"__{c}") for c in keys]
    first = table.withColumn("__r", F.row_number().over(Window.partitionBy(*[F.lower(c) if c in fold else F.col(c) for c in keys]).orderBy(*order))).filter("__r = 1").select(*k, *values)
    on = [(F.lower(c) if c in fold else F.col(c)) == F.col(f"__{c}") for c in keys]
    return rows.join(first, on, "left").select(*rows.columns, *values)


def reverse_lookup(log: DataFrame, wanted: DataFrame, output: str, source: str, group: str) -> DataFrame:
    """(group, output): outputs of a log whose inputs are, as a multiset, those of a wanted group."""

    def inputs(df: DataFrame, key: str) -> DataFrame:
        return df.groupBy(key).agg(F.sort_array(F.collect_list(source)).alias("inputs"))

    return inputs(wanted, group).join(inputs(log, output), "inputs").select(group, output)


def product(*parts: DataFrame) -> DataFrame:
    """Every combination of a few groups of a few keys each, the first group outermost."""
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)


def by_resolution(groups: DataFrame, dpis: DataFrame, resources: DataFrame, name: Column, key: str = "resolution") -> DataFrame:
    """groups x dpis (a few), each with the resources of its resolution's name, if there are any."""
    return groups.crossJoin(F.broadcast(dpis)).withColumn(key, name).join(resources, key, "left")


def used_tokens(texts: DataFrame, text: str, known: DataFrame, token: str) -> DataFrame:
    """texts' columns but the text, and each token it uses that some variant knows (case matters)."""
    rest = [c for c in texts.columns if c != text]
    uses = texts.select(*rest, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"%([-./\w]+)(?::\w*)?%"), F.lit(1)))).alias(token))
    return uses.join(known.select(token).distinct(), token, "left_semi")


def unlogged(renames: DataFrame, log: DataFrame, source: str, target: str, skip: bool = False) -> DataFrame:
    """Renames that a log lacks. A source that the log sends elsewhere raises when it is read, or is skipped."""
    held = log.groupBy(F.col(source).alias("__source")).agg(F.collect_set(target).alias("__targets"))
    rows = renames.join(held, F.col(source) == F.col("__source"), "left").filter(F.col("__targets").isNull() | ~F.array_contains("__targets", F.col(target)))
    clash = F.col("__targets").isNotNull()
    if skip:
        return rows.filter(~clash).select(*renames.columns)
    checked = F.when(clash, F.raise_error(F.concat(F.lit("renamed elsewhere before: "), F.col(source).cast("string"))).cast(renames.schema[source].dataType)).otherwise(F.col(source))
    return rows.withColumn(source, checked).select(*renames.columns)


def conflicting(renames: DataFrame, source: str, target: str) -> DataFrame:
    """(source, outputs): sources with more than one target."""
    return renames.groupBy(source).agg(F.countDistinct(target).alias("outputs")).filter("outputs > 1")


def merge_log(old: DataFrame, new: DataFrame, present: DataFrame, output: str) -> DataFrame:
    """A rename log with new rows: of the old ones those stay whose output still exists; each row once."""
    return old.join(present.select(output).distinct(), output, "left_semi").unionByName(new).distinct()


def in_listed_order(listed: DataFrame, known: DataFrame, name: str, order: str, can: Column | None = None) -> DataFrame:
    """known rows whose name (ignoring case) is listed, in the list's order (column place), and which can do the work."""
    l = listed.select(F.lower(name).alias("__name"), F.col(order).alias("__order"))
    rows = known.join(l, F.lower(F.col(name)) == F.col("__name"))
    rows = rows.filter(can) if can is not None else rows
    return rows.withColumn("place", F.row_number().over(Window.orderBy("__order"))).drop("__name", "__order")  # a handful of engines


def several_names(items: DataFrame, text: str, names: str) -> DataFrame:
    """(hash, name, first): each content once with all its logical names; the first name (by code point) writes it, the others are only logged."""
    g = items.groupBy(F.md5(F.coalesce(F.col(text), F.lit(""))).alias("hash")).agg(F.sort_array(F.collect_set(names)).alias("all"))
    return g.select("hash", F.posexplode("all").alias("at", "name")).select("hash", "name", (F.col("at") == 0).alias("first"))


def hashed_urls(sheets: DataFrame, css: str, images: DataFrame, path: str, hashed: str, missing: str | None = None) -> DataFrame:
    """sheets with each url(hash(path)) replaced by url(its hashed name), by the missing image's name if it has none, or raising without either.

    URLs with an unresolved %token% stay. Each sheet's distinct paths are joined once, whatever their uses.
    """
    pattern = r"url\(\s*['\"]?hash\(([^)]*)\)['\"]?\s*\)"
    rows = sheets.withColumn("__key", F.md5(F.coalesce(F.col(css), F.lit(""))))
    uses = rows.select("__key", css).dropDuplicates(["__key"]).select("__key", F.explode(F.array_distinct(F.regexp_extract_all(css, F.lit(pattern), F.lit(1)))).alias("__path")).filter(~F.col("__path").rlike("%[^%]+%"))
    found = uses.join(images.select(F.lower(path).alias("__image"), F.col(hashed).alias("__hashed")), F.lower("__path") == F.col("__image"), "left")
    fall = F.lit(missing) if missing is not None else F.raise_error(F.concat(F.lit("no image "), "__path")).cast("string")
    map_ = found.groupBy("__key").agg(F.map_from_entries(F.collect_list(F.struct("__path", F.coalesce(F.col("__hashed"), fall)))).alias("__map"))
    rows = rows.join(map_, "__key", "left")
    pieces, whole, names = F.split(css, pattern, -1), F.regexp_extract_all(css, F.lit(pattern), F.lit(0)), F.regexp_extract_all(css, F.lit(pattern), F.lit(1))
    made = F.zip_with(whole, names, lambda w, n: F.coalesce(F.concat(F.lit("url("), F.try_element_at("__map", n), F.lit(")")), w))
    woven = F.array_join(F.zip_with(pieces, made, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return rows.withColumn(css, F.when(F.col("__map").isNull(), F.col(css)).otherwise(woven)).select(*sheets.columns)


def image_catalogue(files: DataFrame, path: str, root: str) -> DataFrame:
    """(name, path): lower-cased path below the root to lower-cased path; a name twice raises when it is read."""
    low = F.lower(F.translate(path, "\\", "/"))
    name = F.ltrim(F.replace(low, F.lit(root.lower()), F.lit("")), F.lit("/"))
    g = files.groupBy(name.alias("name")).agg(F.min(low).alias("path"), F.count(F.lit(1)).alias("n"))
    return g.select(F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("image twice: "), "name")).cast("string")).otherwise(F.col("name")).alias("name"), "path")
