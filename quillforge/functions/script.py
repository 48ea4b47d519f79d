"""Scalar functions of the script side: short names, source map numbers, JSON, literals. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: letters of short names, in order; the first letter has its own list
FIRST_LETTERS = "ntirufeoshclavypwbkdg"
PART_LETTERS = "tirufeoshclavypwbkdgn"
# fixed value: digits of source map numbers
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

#: letters that a 63-bit number can need
_LENGTH = 15


def short_name(index: Column) -> Column:
    """The name with a number, from 0: all of one letter, then all of two, and so on (bijective base 21); empty below 0."""
    start = F.struct((index.cast("long") + 1).alias("rest"), F.lit("").alias("name"))

    def letter(state: Column, at: Column) -> Column:
        digit = (F.pmod(state["rest"] - 1, F.lit(len(FIRST_LETTERS))) + 1).cast("int")
        pick = F.when(at == 0, F.substr(F.lit(FIRST_LETTERS), digit, F.lit(1))).otherwise(F.substr(F.lit(PART_LETTERS), digit, F.lit(1)))
        more = state["rest"] > 0
        rest = F.when(more, F.floor((state["rest"] - 1) / len(FIRST_LETTERS)).cast("long")).otherwise(F.lit(0).cast("long"))
        return F.struct(rest.alias("rest"), F.when(more, F.concat(state["name"], pick)).otherwise(state["name"]).alias("name"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(_LENGTH)), start, letter)["name"]


def vlq(value: Column) -> Column:
    """A number in base 64 with variable length: the sign in the lowest bit, five bits a digit, lowest first."""
    v = F.abs(value.cast("long")) * 2 + (value < 0).cast("long")
    last = F.greatest(F.lit(0), F.floor((F.length(F.bin(v)) - 1) / 5)).cast("int")
    digits = F.transform(
        F.sequence(F.lit(0), last),
        lambda p: F.substr(F.lit(BASE64), (F.call_function("shiftright", v, p * 5).bitwiseAND(F.lit(31)) + F.when(p < last, 33).otherwise(1)).cast("int"), F.lit(1)),
    )
    return F.array_join(digits, "")


def json_text(text: Column) -> Column:
    """JSON without white space outside strings; null if it is not valid."""
    packed = F.regexp_replace(text, r'("[^"\\]*+(?:\\.[^"\\]*+)*+")|\s+', "$1")
    return F.when(F.try_parse_json(text).isNotNull(), packed)


def quoted(text: Column) -> Column:
    """A script string: in the quotes that need fewer escapes (double on a tie), controls escaped."""
    double, single = F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit(""))), F.length(text) - F.length(F.replace(text, F.lit("'"), F.lit("")))
    s = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, name in (("\b", "b"), ("\t", "t"), ("\n", "n"), ("\x0b", "v"), ("\f", "f"), ("\r", "r")):
        s = F.replace(s, F.lit(raw), F.lit("\\" + name))
    for code in [*range(0x00, 0x08), *range(0x0E, 0x20), 0x7F, 0x2028, 0x2029]:  # the other controls, and two line ends of scripts
        s = F.replace(s, F.lit(chr(code)), F.lit(f"\\x{code:02x}" if code < 0x100 else f"\\u{code:04x}"))
    return F.when(double <= single, F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("\\'")), F.lit("'")))


_FOLDS = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": lambda a, b: F.try_divide(a, b),
    "%": lambda a, b: F.try_mod(a, b),
    "&": lambda a, b: _int32(a).bitwiseAND(_int32(b)).cast("double"),
    "|": lambda a, b: _int32(a).bitwiseOR(_int32(b)).cast("double"),
    "^": lambda a, b: _int32(a).bitwiseXOR(_int32(b)).cast("double"),
    "<<": lambda a, b: F.call_function("shiftleft", _int32(a), _shift(b)).cast("double"),
    ">>": lambda a, b: F.call_function("shiftright", _int32(a), _shift(b)).cast("double"),
    ">>>": lambda a, b: F.call_function("shiftright", _int32(a).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)), _shift(b)).cast("double"),
}

_TESTS = {
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "===": lambda a, b: a == b,
    "!==": lambda a, b: a != b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
}


def _int32(x: Column) -> Column:
    """A script number as a 32-bit integer, wrapped around."""
    low = F.pmod(F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("long"), F.lit(1 << 32))
    return F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low).cast("int")


def _shift(x: Column) -> Column:
    return _int32(x).bitwiseAND(F.lit(31))


def fold(operator: str, left: Column, right: Column) -> Column:
    """The value of an operator on two number literals, null where it is not folded (a division by zero, no finite value). Comparisons give booleans."""
    if operator in _TESTS:
        return _TESTS[operator](left.cast("double"), right.cast("double"))
    value = _FOLDS[operator](left.cast("double"), right.cast("double"))
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(None)).otherwise(value)


def fold_text(operator: str, left: Column, right: Column) -> Column:
    """The value of an operator on two string literals: + joins them, comparisons go by code unit order of plain text."""
    return F.concat(left, right) if operator == "+" else _TESTS[operator](left, right)


def truthy(number: Column) -> Column:
    """Whether a number literal counts as true."""
    return ~(F.isnan(number.cast("double")) | (number == 0))


def fold_logical(operator: str, left: Column, right: Column) -> Column:
    """left && right, left || right on number literals: one of the two."""
    return F.when(truthy(left), right if operator == "&&" else left).otherwise(left if operator == "&&" else right)


def fold_choice(test: Column, yes: Column, no: Column) -> Column:
    return F.when(truthy(test), yes).otherwise(no)


def fold_unary(operator: str, value: Column) -> Column:
    """-, +, ~ and ! of a number literal."""
    return {"-": lambda v: -v.cast("double"), "+": lambda v: v.cast("double"), "~": lambda v: (-_int32(v).cast("double") - 1), "!": lambda v: ~truthy(v)}[operator](value)


def fold_join(items: Column, separator: Column) -> Column:
    """The join of an array of string literals."""
    return F.array_join(items, separator) if isinstance(separator, str) else F.aggregate(items, F.lit(None).cast("string"), lambda a, x: F.when(a.isNull(), x).otherwise(F.concat(a, separator, x)))


def segments(places: DataFrame, sheet: str, line: str, column: str, source: str, source_line: str, source_column: str) -> DataFrame:
    """(sheet, mappings): the mappings of source maps: lines apart by ;, segments by commas, each number relative to the one before."""
    whole = Window.partitionBy(sheet).orderBy(line, column)
    inline = Window.partitionBy(sheet, line).orderBy(column)
    step = lambda c, w: F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0))
    rows = places.select(sheet, line, column, F.concat(vlq(step(column, inline)), vlq(step(source, whole)), vlq(step(source_line, whole)), vlq(step(source_column, whole))).alias("s"))
    lines = rows.groupBy(sheet, line).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(column).alias("o"), "s"))), lambda x: x["s"]), ",").alias("s"))
    gap = F.col(line) - F.coalesce(F.lag(line).over(Window.partitionBy(sheet).orderBy(line)), F.lit(0))
    lines = lines.withColumn("s", F.concat(F.repeat(F.lit(";"), gap.cast("int")), "s"))
    return lines.groupBy(sheet).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(line).alias("o"), "s"))), lambda x: x["s"]), "").alias("mappings"))


def source_map(mapped: DataFrame, sheet: str, file: Column, sources: Column) -> DataFrame:
    """(sheet, json): version 3 maps around mappings."""
    body = F.struct(F.lit(3).alias("version"), file.alias("file"), F.col("mappings"), sources.alias("sources"), F.array().cast("array<string>").alias("names"))
    return mapped.select(sheet, F.to_json(body).alias("json"))
