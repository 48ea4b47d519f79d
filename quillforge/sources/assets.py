"""Reading text assets and the XML files beside them; writing content-addressed assets. All reads are by Spark's readers."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Spec:
    """Files to read: a file, or a folder with a name pattern."""

    path: str
    pattern: str = "*"
    recursive: bool = True
    optional: bool = False


_FILES = "spec long, path string, length long, content binary"


def scan(spark: SparkSession, specs: list[Spec]) -> DataFrame:
    """(spec, path, length, content) of the files of each specification. Blank ones are skipped; a missing path raises unless it is optional.

    The order of the reference is that of (spec, lower(path), path): sort by it where it matters.
    """
    parts = []
    for at, spec in enumerate(specs):
        if spec is None or not spec.path.strip():
            continue
        try:
            files = spark.read.format("binaryFile").option("pathGlobFilter", spec.pattern).option("recursiveFileLookup", spec.recursive).load(spec.path)
        except AnalysisException as e:
            if spec.optional and e.getCondition() == "PATH_NOT_FOUND":
                continue
            raise
        parts.append(files.select(F.lit(at).cast("long").alias("spec"), "path", "length", "content"))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], _FILES)


def decoded(content: Column) -> Column:
    """UTF-8 text without its byte order mark."""
    return F.regexp_replace(F.decode(content, "UTF-8"), "^﻿", "")


def file_hash(content: Column) -> Column:
    """MD5 of the bytes as they are, byte order mark included."""
    return F.md5(content)


def _xml(spark: SparkSession, path: str, row: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row).schema(schema).load(path).withColumn("file", F.input_file_name())


def read_resources(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, value, comment) of string resources. Blank names are skipped, a missing value is empty, a name twice in a file (ignoring case) raises when the rows are read."""
    rows = _xml(spark, path, "data", "_name string, value string, comment string").filter(F.trim("_name") != "")
    rows = rows.groupBy("file", F.lower("_name").alias("key")).agg(F.first("_name").alias("name"), F.first("value").alias("value"), F.first("comment").alias("comment"), F.count(F.lit(1)).alias("n"))
    name = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("resource twice in a file: "), "key")).cast("string")).otherwise(F.col("name"))
    return rows.select("file", name.alias("name"), F.coalesce("value", F.lit("")).alias("value"), "comment")


def write_resources(rows: DataFrame, path: str) -> None:
    """(name, value) as resource files."""
    rows.select(F.col("name").alias("_name"), "value").write.format("xml").option("rootTag", "root").option("rowTag", "data").save(path)


def read_rename_log(spark: SparkSession, path: str) -> DataFrame:
    """(output, inputs) of a rename log; no rows if it does not exist."""
    try:
        rows = _xml(spark, path, "File", "Output string, Input array<string>")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "output string, inputs array<string>")
    return rows.select(F.col("Output").alias("output"), F.col("Input").alias("inputs"))


def write_rename_log(rows: DataFrame, path: str, prefix: str = "/") -> None:
    """(output, input) as a rename log, one File for each output with its inputs sorted."""
    log = rows.groupBy(F.concat(F.lit(prefix), "output").alias("Output")).agg(F.sort_array(F.collect_set(F.concat(F.lit(prefix), "input"))).alias("Input"))
    log.sort("Output").write.format("xml").option("rootTag", "RenamedFiles").option("rowTag", "File").save(path)


def read_file_sets(spark: SparkSession, path: str, kind: str = "CssFileSet") -> DataFrame:
    """(file, output, config_source, inputs) of the file sets of job configurations; an input has path, search_pattern, search_option and optional."""
    item = T.StructType([T.StructField("_VALUE", T.StringType()), *[T.StructField(f"_{n}", T.StringType()) for n in ("searchPattern", "searchOption", "optional")]])
    inputs = T.StructType([T.StructField("Input", T.ArrayType(item))])
    schema = T.StructType([T.StructField("_output", T.StringType()), T.StructField("_configSource", T.StringType()), T.StructField("Inputs", inputs)])
    rows = spark.read.format("xml").option("rowTag", kind).schema(schema).load(path).withColumn("file", F.input_file_name())
    each = F.transform("Inputs.Input", lambda x: F.struct(x["_VALUE"].alias("path"), x["_searchPattern"].alias("search_pattern"), x["_searchOption"].alias("search_option"), F.coalesce(F.lower(x["_optional"]) == "true", F.lit(False)).alias("optional")))
    return rows.select("file", F.col("_output").alias("output"), F.col("_configSource").alias("config_source"), each.alias("inputs"))


def store(rows: DataFrame, path: str, category: str, text: str) -> DataFrame:
    """Adds contents that a content-addressed store lacks, and returns what was added: (category, hash, content)."""
    new = rows.select(F.lit(category).alias("category"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("hash"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    new = new.groupBy("category", "hash").agg(F.first("content").alias("content"))
    try:
        held = rows.sparkSession.read.parquet(path).filter(F.col("category") == category).select("hash")
        new = new.join(held, "hash", "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    new.select("category", "hash", "content").write.mode("append").partitionBy("category").parquet(path)
    return new.select("category", "hash", "content")


def read_resources_loose(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, value) of string resources; of a name twice in a file the first by value stays."""
    rows = _xml(spark, path, "data", "_name string, value string").filter(F.trim("_name") != "")
    return rows.groupBy("file", F.lower("_name").alias("key")).agg(F.min(F.struct(F.coalesce("value", F.lit("")).alias("value"), F.col("_name").alias("name"))).alias("x")).select("file", "x.name", "x.value")


def read_settings(spark: SparkSession, path: str, tag: str = "Settings") -> DataFrame:
    """(file, name, value) of the settings elements of job configurations, whatever their names."""
    files = spark.read.format("binaryFile").load(path).select("path", decoded(F.col("content")).alias("text"))
    blocks = files.select("path", F.explode(F.regexp_extract_all("text", F.lit(f"(?s)<{tag}[^>]*>(.*?)</{tag}>"), F.lit(1))).alias("b"))
    item = r"(?s)(<([A-Za-z][\w.-]*)[^>]*>([^<]*)</\2>)"
    each = blocks.select("path", F.explode(F.arrays_zip(F.regexp_extract_all("b", F.lit(item), F.lit(2)).alias("n"), F.regexp_extract_all("b", F.lit(item), F.lit(3)).alias("v"))).alias("x"))
    return each.select(F.col("path").alias("file"), F.col("x.n").alias("name"), F.trim("x.v").alias("value"))


def config_files(spark: SparkSession, path: str, most: int = 100) -> list[str]:
    """The configuration at path and those it includes by ConfigSource elements, each once, an includer before what it includes.

    Paths are relative to the includer. Only the paths come to the driver, a level at a time.
    """
    seen, level = [path], [path]
    while level and len(seen) <= most:
        files = spark.read.format("binaryFile").load(level).select("path", decoded(F.col("content")).alias("text"))
        names = files.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"<ConfigSource>\s*([^<]+?)\s*</ConfigSource>"), F.lit(1))).alias("n")).collect()
        found = [f"{r.path.rsplit('/', 1)[0]}/{r.n.replace(chr(92), '/')}" for r in sorted(names)]
        level = [f for f in dict.fromkeys(found) if f not in seen]
        seen += level
    return seen


def write_named(rows: DataFrame, path: str, name: str, content: str) -> int:
    """Writes each content under its name, a folder for each, and leaves names alone that are there; returns how many were new."""
    new = rows.select(F.col(name).alias("name"), F.coalesce(F.col(content), F.lit("")).alias("value")).dropDuplicates(["name"])
    try:
        held = rows.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.url_decode(F.regexp_extract("path", "/name=([^/]*)/", 1)).alias("name")).distinct()
        new = new.join(held, "name", "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    n = new.count()
    new.write.mode("append").partitionBy("name").text(path)
    return n


def write_lines(lines: DataFrame, path: str) -> None:
    """A report's lines (column line) as text."""
    lines.select("line").write.text(path)
