"""Preprocessing engines: a registry of DataFrame steps, includes, and imports of folders."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (key, text) -> (key, text)
Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Engine:
    """name, what rows it can process (a condition), and its step."""

    name: str
    can: Column
    step: Step


class Registry:
    """Engines by name; names ignore case."""

    def __init__(self, engines: list[Engine]):
        self.engines = {e.name.lower(): e for e in engines}

    def run(self, rows: DataFrame, names: list[str], text: str = "text") -> DataFrame:
        """Rows through the named engines in the order of the names; unknown names are skipped, a null result raises when it is read."""
        for n in names:
            e = self.engines.get(n.lower())
            if e is None:
                continue
            done = e.step(rows.filter(e.can))
            checked = F.when(F.col(text).isNull(), F.raise_error(F.lit(f"engine {e.name} gave nothing")).cast("string")).otherwise(F.col(text))
            rows = done.withColumn(text, checked).select(*rows.columns).unionByName(rows.filter(~F.coalesce(e.can, F.lit(False))))
        return rows


def expand_includes(rows: DataFrame, files: DataFrame, key: str, text: str, path: str, content: str) -> DataFrame:
    """wgInclude('path') and wgInclude('path','pattern') replaced by the files below the path (or the file), in path order, each after a comment.

    A pattern is of file names, with * and ?. Included text is not searched again. A path without files gives nothing.
    """
    pattern = r"wgInclude\(\s*['\"]([^'\"]*)['\"]\s*(?:,\s*['\"]([^'\"]*)['\"]\s*)?\)\s*;?"
    calls = rows.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)))).alias("call"))
    calls = calls.select(key, "call", F.rtrim(F.translate(F.regexp_extract("call", pattern, 1), "\\", "/"), F.lit("/")).alias("from"), F.regexp_extract("call", pattern, 2).alias("mask"))
    like = F.replace(F.replace(F.when(F.col("mask") == "", "%").otherwise(F.replace(F.replace("mask", F.lit("%"), F.lit("\\%")), F.lit("_"), F.lit("\\_"))), F.lit("*"), F.lit("%")), F.lit("?"), F.lit("_"))
    f = files.select(F.translate(path, "\\", "/").alias("__path"), F.col(content).alias("__content"))
    # each file under each of its folders: an equality join in place of one on prefixes
    steps = F.split("__path", "/")
    f = f.select("*", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))).alias("__under"))
    found = calls.withColumn("like", like).join(f, (F.lower("from") == F.lower("__under"))).filter(F.expr("lower(element_at(split(__path, '/'), -1)) like lower(like)"))
    part = F.concat(F.lit("/* "), F.col("__path"), F.lit(" */\n"), F.coalesce("__content", F.lit("")), F.lit("\n"))
    made = found.groupBy(key, "call").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.lower("__path").alias("o"), part.alias("p")))), lambda x: x["p"]), "").alias("made"))
    map_ = made.groupBy(F.col(key).alias("__key")).agg(F.map_from_entries(F.collect_list(F.struct("call", "made"))).alias("__map"))
    out = rows.join(map_, F.col(key) == F.col("__key"), "left")
    pieces, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    woven = F.array_join(F.zip_with(pieces, whole, lambda a, w: F.concat(a, F.when(w.isNull(), "").otherwise(F.coalesce(F.try_element_at("__map", w), F.lit(""))))), "")
    return out.withColumn(text, woven).select(*rows.columns)


def expand_imports(rows: DataFrame, files: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """@imports "folder/*" replaced by an @import of each file right in the folder, in path order."""
    pattern = r"@imports\s+['\"]([^'\"]*)/\*['\"]\s*;"
    f = files.select(F.translate(path, "\\", "/").alias("__path")).withColumn("__under", F.regexp_replace("__path", "/[^/]*$", ""))
    calls = rows.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))).alias("from"))
    lines = calls.join(f, F.lower("from") == F.lower("__under")).groupBy(key, "from").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct(F.lower("__path").alias("o"), F.col("__path").alias("p")))), lambda x: F.concat(F.lit('@import "'), x["p"], F.lit('";\n'))), "").alias("made"))
    map_ = lines.groupBy(F.col(key).alias("__key")).agg(F.map_from_entries(F.collect_list(F.struct("from", "made"))).alias("__map"))
    out = rows.join(map_, F.col(key) == F.col("__key"), "left")
    pieces, names = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    woven = F.array_join(F.zip_with(pieces, names, lambda a, n: F.concat(a, F.when(n.isNull(), "").otherwise(F.coalesce(F.try_element_at("__map", n), F.lit(""))))), "")
    return out.withColumn(text, woven).select(*rows.columns)


def sass_tokens(text: Column) -> Column:
    """After compilation: token('x') -> x, and ___x___ -> %x%."""
    return F.regexp_replace(F.regexp_replace(text, r"token\(\s*['\"]?([^'\")]*)['\"]?\s*\)", "$1"), r"___(\w+?)___", "%$1%")
