"""Images and their sprites as relations: duplicates, packing, names, logs, and the rewriting of declarations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: reasons in the order in which they are reported
REASONS = ["NoUrl", "IgnoreUrl", "BackgroundRepeatInvalid", "IncorrectPosition", "MultipleUrls", "SpritingIgnore", "NoRepeat", "BackgroundSizeIsSetToNonDefaultValue"]


def without_duplicates(images: DataFrame, digest: str, position: str, path: str, order: str) -> DataFrame:
    """(digest, position, path, duplicates): of images with one content and position the first stays, the others are listed in order."""
    g = images.groupBy(digest, position).agg(F.array_sort(F.collect_list(F.struct(order, path))).alias("all"))
    return g.select(digest, position, F.col("all")[0][path].alias(path), F.transform(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), lambda x: x[path]).alias("duplicates"))


def canvas(images: DataFrame, sprite: str, width: str, height: str, padding: int = 50, vertical: bool = True) -> DataFrame:
    """(sprite, width, height): one side is the largest, the other the sum with padding after each image."""
    side = lambda c: F.sum(F.col(c) + padding).cast("long")
    most = lambda c: F.max(c).cast("long")
    return images.groupBy(sprite).agg((most(width) if vertical else side(width)).alias("width"), (side(height) if vertical else most(height)).alias("height"))


def pack_horizontal(images: DataFrame, sprite: str, width: str, height: str, order: str, padding: int = 50) -> DataFrame:
    """Places side by side, tallest first; x is negative, as a background position is."""
    line = Window.partitionBy(sprite).orderBy(F.col(height).desc(), order).rowsBetween(Window.unboundedPreceding, -1)
    return images.withColumn("x", -F.coalesce(F.sum(F.col(width) + padding).over(line), F.lit(0)).cast("long")).withColumn("y", F.lit(0).cast("long"))


def sprite_names(images: DataFrame, sprite: str, path: str) -> DataFrame:
    """(sprite, name, n): the name is the digest of the paths in order; a single image is passed on under its own path."""
    g = images.groupBy(sprite).agg(F.sort_array(F.collect_list(path)).alias("paths"))
    return g.select(sprite, F.when(F.size("paths") == 1, F.col("paths")[0]).otherwise(F.md5(F.array_join("paths", "|"))).alias("name"), F.size("paths").cast("long").alias("n"))


def image_type(forced: Column, photo: Column, frames: Column, indexed: Column) -> Column:
    """The kind of sprite an image goes to."""
    return F.when(forced.isNotNull(), forced).when(photo, "Photo").when(frames > 1, "NotSupported").when(indexed, "NonphotoIndexed").otherwise("NonphotoNonindexed")


def supported(images: DataFrame, kind: str) -> DataFrame:
    """images; one that is not supported raises when it is read."""
    return images.withColumn(kind, F.when(F.col(kind) == "NotSupported", F.raise_error(F.lit("an image has several frames")).cast("string")).otherwise(F.col(kind)))


def wanted(uses: DataFrame, url: str, position: str, fit: str, check: bool = True) -> DataFrame:
    """Distinct (url, position) of uses that are fit; an image that is fit in one place and not in another raises when it is read."""
    g = uses.groupBy(url, position).agg(F.bool_or(fit).alias("some"))
    every = uses.groupBy(F.col(url).alias("__url")).agg((F.bool_or(fit) & ~F.bool_and(fit)).alias("mixed"))
    rows = g.filter("some").join(every, F.col(url) == F.col("__url"))
    name = F.when(F.col("mixed"), F.raise_error(F.concat(F.lit("fit in one place only: "), url)).cast("string")).otherwise(F.col(url)) if check else F.col(url)
    return rows.select(name.alias(url), position, *([] if check else ["mixed"]))


def reason_rank(reason: Column) -> Column:
    """The place of a reason in reports; others come last."""
    at = F.array_position(F.array(*[F.lit(r) for r in REASONS]), reason)
    return F.when(at > 0, at - 1).otherwise(len(REASONS)).cast("int")


def analysis_log(uses: DataFrame, reason: str, sprite: str, kind: str) -> DataFrame:
    """(outcome, detail, n): failed uses by reason, ignored ones, and those in sprites by sprite and kind."""
    skip = F.col(reason).isin("SpritingIgnore", "IgnoreUrl")
    outcome = F.when(F.col(reason).isNull(), "sprited").when(skip, "ignored").otherwise("failed")
    detail = F.when(F.col(reason).isNull(), F.concat_ws("/", sprite, kind)).otherwise(F.col(reason))
    return uses.groupBy(outcome.alias("outcome"), detail.alias("detail")).agg(F.count(F.lit(1)).alias("n"))


def indexable(pixels: DataFrame, image: str, rgb: str, alpha: str, most: int = 256) -> DataFrame:
    """(image, colours, indexable): distinct opaque colours; a half-transparent pixel rules it out."""
    g = pixels.groupBy(image).agg(F.countDistinct(F.when(F.col(alpha) == 255, F.col(rgb))).alias("colours"), F.bool_or((F.col(alpha) > 0) & (F.col(alpha) < 255)).alias("half"))
    return g.select(image, "colours", ((F.col("colours") <= most) & ~F.col("half")).alias("indexable"))


def palette(pixels: DataFrame, image: str, red: str, green: str, blue: str, colours: int = 256) -> DataFrame:
    """(image, red, green, blue, pixels): a palette by an octree: the deepest level with at most ``colours`` occupied cells, each with its mean colour."""
    cell = lambda c, bits: F.shiftright(F.col(c).cast("int"), 8 - bits)
    levels = F.explode(F.array(*[F.struct(F.lit(b).alias("bits"), F.struct(cell(red, b), cell(green, b), cell(blue, b)).alias("cell")) for b in range(1, 9)])).alias("l")
    rows = pixels.groupBy(image, red, green, blue).agg(F.count(F.lit(1)).alias("n")).select("*", levels)
    cells = rows.groupBy(image, "l").agg(*[(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in (red, green, blue)], F.sum("n").alias("pixels"))
    fit = cells.groupBy(F.col(image).alias("__image"), F.col("l.bits").alias("__bits")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= colours).groupBy("__image").agg(F.max("__bits").alias("__bits"))
    out = cells.join(fit, (F.col(image) == F.col("__image")) & (F.col("l.bits") == F.col("__bits")))
    return out.select(image, *[F.bround(c, 0).cast("int").alias(c) for c in (red, green, blue)], "pixels")


def rewrite(decls: DataFrame, places: DataFrame, url: str, position: str, dpi: Column) -> DataFrame:
    """decls (with url and position) with the sprite's url, its offset and size in place of their own; others stay as they are.

    places: url, position, sprite, x, y, width, height.
    """
    p = places.select(F.lower(url).alias("__url"), F.col(position).alias("__position"), "sprite", "x", "y", "width", "height")
    px = lambda c: F.concat(F.regexp_replace(F.bround(F.col(c) / dpi, 3).cast("string"), r"\.?0+$", ""), F.lit("px"))
    rows = decls.join(p, (F.lower(url) == F.col("__url")) & F.col(position).eqNullSafe(F.col("__position")), "left")
    zero = lambda c: F.when(F.col(c) == 0, "0").otherwise(px(c))
    own = [c for c in decls.columns if c != url]
    return rows.select(*own, F.coalesce("sprite", url).alias(url), F.when(F.col("sprite").isNotNull(), F.concat(zero("x"), F.lit(" "), zero("y"))).alias("offset"), F.when(F.col("sprite").isNotNull(), F.concat(px("width"), F.lit(" "), px("height"))).alias("size"))


def sprite_map(places: DataFrame, sprite: str, path: str, x: str, y: str, width: str, height: str) -> DataFrame:
    """(sprite, xml): the map of a sprite as XML text, its inputs in order of their place."""
    item = F.concat(F.lit('<input originalfile="'), path, F.lit('" width="'), width, F.lit('" height="'), height, F.lit('" xposition="'), x, F.lit('" yposition="'), y, F.lit('"/>'))
    g = places.groupBy(sprite).agg(F.array_sort(F.collect_list(F.struct(F.col(x).alias("__x"), F.col(y).alias("__y"), F.col(path).alias("__p"), item.alias("i")))).alias("all"))
    return g.select(sprite, F.concat(F.lit('<output file="'), sprite, F.lit('">'), F.array_join(F.transform("all", lambda a: a["i"]), ""), F.lit("</output>")).alias("xml"))


def read_sprite_map(maps: DataFrame, xml: str) -> DataFrame:
    """(sprite, path, x, y, width, height) of sprite maps."""
    item = r'<input originalfile="([^"]*)" width="([^"]*)" height="([^"]*)" xposition="([^"]*)" yposition="([^"]*)"/>'
    rows = maps.select(F.regexp_extract(xml, '<output file="([^"]*)"', 1).alias("sprite"), F.explode(F.regexp_extract_all(xml, F.lit("(<input [^>]*/>)"), F.lit(1))).alias("i"))
    num = lambda k: F.regexp_extract("i", item, k).cast("long")
    return rows.select("sprite", F.regexp_extract("i", item, 1).alias("path"), num(4).alias("x"), num(5).alias("y"), num(2).alias("width"), num(3).alias("height"))
