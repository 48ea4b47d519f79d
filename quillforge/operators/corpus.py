"""Set-oriented operators over corpora of text assets. All are DataFrame compositions; none collects rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def manifest(assets: DataFrame, output: Column, source: Column) -> DataFrame:
    """One row for each output name with its inputs, sorted."""
    return assets.groupBy(output.alias("output")).agg(F.array_join(F.sort_array(F.collect_list(source)), ",").alias("inputs"), F.count(F.lit(1)).alias("n_inputs"))


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a stated order; one shuffle, with a limit pushed below it by the rank filter."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__r = 1").drop("__r")


def bundle(rows: DataFrame, key: str, order: str, text: str, separator: bool) -> DataFrame:
    """Texts of a key joined in order, each after two newlines, with a semicolon before it where the one before lacks it."""
    line = Window.partitionBy(key).orderBy(order)
    before = F.lag(text).over(line)
    semi = F.when(before.isNotNull() & ~before.rlike(r";\s*$"), ";").otherwise("") if separator else F.lit("")
    parts = rows.select(key, F.col(order).alias("__o"), F.concat(F.lit("\n\n"), semi, F.coalesce(F.col(text), F.lit(""))).alias("__p"))
    return parts.groupBy(key).agg(F.concat(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__o", "__p"))), lambda x: x["__p"]), ""), F.lit("\n")).alias("bundle"))


def precedence(layers: list[tuple[DataFrame, bool]], keys: list[str]) -> DataFrame:
    """Layers of values merged by key: layers that may be overridden come last and overwrite; of the others the first stays."""
    rows = None
    for i, (layer, over) in enumerate(layers):
        x = layer.withColumn("__layer", F.lit((1000 + i) if over else -i))
        rows = x if rows is None else rows.unionByName(x)
    return first_by(rows, keys, [F.col("__layer").desc()]).drop("__layer")


def last_wins(rows: DataFrame, keys: list[str], important: Column, order: list[Column]) -> DataFrame:
    """The declaration of each key that stands: important ones first, then the latest."""
    return first_by(rows, keys, [important.desc(), *[c.desc() for c in order]])


def collapse_variants(rows: DataFrame, key: str, variant: str, token: str, value: str) -> DataFrame:
    """Variants of a key whose values are identical become one row that lists them."""
    print_ = rows.groupBy(key, variant).agg(F.md5(F.to_json(F.sort_array(F.collect_list(F.struct(token, value))))).alias("fingerprint"))
    return print_.groupBy(key, "fingerprint").agg(F.array_join(F.sort_array(F.collect_list(variant)), ",").alias("variants"), F.count(F.lit(1)).alias("n_variants"))


def shared_pairs(decls: DataFrame, rule: str, items: list[str], least: int = 2) -> DataFrame:
    """Pairs of rules that share at least ``least`` equal declarations, or the only one that either has."""
    d = decls.select(rule, *items).distinct()
    size = d.groupBy(rule).agg(F.count(F.lit(1)).alias("n"))
    a, b = d.alias("a"), d.alias("b")
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in items] + [F.col(f"a.{rule}") < F.col(f"b.{rule}")]
    pairs = a.join(b, on).groupBy(F.col(f"a.{rule}").alias("a"), F.col(f"b.{rule}").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    pairs = pairs.join(size.select(F.col(rule).alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col(rule).alias("b"), F.col("n").alias("nb")), "b")
    return pairs.filter((F.col("shared") >= least) | ((F.col("shared") == 1) & ((F.col("na") == 1) | (F.col("nb") == 1)))).select("a", "b", "shared")


def ban_substrings(rows: DataFrame, text: str, banned: list[str]) -> DataFrame:
    """Comma lists without the members that hold a banned string; rows without members go."""
    hit = F.lit(False)
    parts = F.filter(F.split(F.col(text), ","), lambda s: ~_any(s, banned))
    return rows.withColumn(text, F.array_join(parts, ",")).filter(F.size(parts) > 0) if banned else rows.filter(~hit)


def _any(s: Column, banned: list[str]) -> Column:
    out = F.lit(False)
    for b in banned:
        out = out | s.contains(b)
    return out


def pack_vertical(images: DataFrame, sprite: str, width: str, height: str, position: str, order: str, padding: int = 50) -> DataFrame:
    """Places of images in sprites: widest first, one below the other; y is negative; x by alignment."""
    line = Window.partitionBy(sprite).orderBy(F.col(width).desc(), order)
    whole = F.max(width).over(Window.partitionBy(sprite))
    above = F.coalesce(F.sum(F.col(height) + padding).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = F.when(F.col(position) == "Right", whole - F.col(width)).when(F.col(position) == "Center", F.floor((whole - F.col(width) + 1) / 2)).otherwise(F.lit(0))
    return images.withColumn("x", x.cast("long")).withColumn("y", -above).withColumn("sprite_width", whole.cast("long"))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """added, removed, changed or same for each key."""
    b, a = before.select(F.col(key).alias("k"), F.col(digest).alias("was")), after.select(F.col(key).alias("k"), F.col(digest).alias("now"))
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed").otherwise("same")
    return b.join(a, "k", "full_outer").select(F.col("k").alias(key), status.alias("status"))


def measure_report(rows: DataFrame, name: str, duration: str) -> DataFrame:
    """Count, total, share of all and mean of each name; the share is over the few grouped rows."""
    g = rows.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(duration), 4).alias("total"))
    return g.withColumn("percent", F.round(100 * F.col("total") / F.sum("total").over(Window.partitionBy()), 4)).withColumn("mean", F.round(F.col("total") / F.col("n"), 4))
