"""Scalar functions on strings, paths, numbers and colours, as Column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(text: Column) -> Column:
    """Lower-case hex MD5 of the UTF-8 bytes; null hashes as the empty string."""
    return F.md5(F.coalesce(text, F.lit("")))


def hash_path(text: Column, extension: str = "txt") -> Column:
    """hh/hhh...ext: the first two digits of the hash name the folder."""
    h = content_hash(text)
    return F.concat(F.substring(h, 1, 2), F.lit("/"), F.substring(h, 3, 30), F.lit("." + extension))


def normalize_url(url: Column) -> Column:
    """Without quotes, without a hash(...) or hash:// wrapper, slashes one way, lower case. The separator is /."""
    u = F.btrim(url, F.lit("'\""))
    u = F.regexp_replace(u, r"(?is)^hash\((.*)\)$", "$1")
    u = F.regexp_replace(u, "(?i)^hash://", "")
    return F.lower(F.ltrim(F.translate(u, "\\", "/"), F.lit("/")))


def change_extension(path: Column, extension: str) -> Column:
    return F.when(path.rlike(r"\.[^./\\]*$"), F.regexp_replace(path, r"\.[^./\\]*$", "." + extension)).otherwise(F.concat(path, F.lit("." + extension)))


def path_template(template: str, groups: dict[str, Column], output: Column) -> Column:
    """{group} places take the lower-cased key of the group and {output} the path; a place left over raises."""
    out = F.lit(template)
    for name, key in groups.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.lower(key))
    out = F.replace(out, F.lit("{output}"), output)
    return F.when(F.instr(out, "{") > 0, F.raise_error(F.concat(F.lit("unresolved place in "), out))).otherwise(out)


def trim_number(value: Column) -> Column:
    """001.2400px -> 1.24px, 0.50 -> .5, 0px -> 0; only lengths and percentages lose the unit of zero."""
    pattern = r"^([+-]?)0*([0-9]*)(?:\.([0-9]*?)0*)?([a-zA-Z%]*)$"
    sign, whole, part, unit = (F.regexp_extract(value, pattern, i) for i in range(1, 5))
    digits = F.when(part != "", F.concat(whole, F.lit("."), part)).otherwise(whole)
    zero = (whole == "") & (part == "")
    keeps = ~F.lower(unit).isin("", "%", "px", "em", "ex", "rem", "cm", "mm", "in", "pt", "pc", "ch", "vw", "vh", "vmin", "vmax")
    body = F.when(zero, F.when(keeps, F.concat(F.lit("0"), unit)).otherwise("0")).otherwise(F.concat(F.when(sign == "-", "-").otherwise(""), digits, unit))
    return F.when(value.rlike(pattern) & value.rlike("[0-9]"), body).otherwise(value)


def rgb_to_hex(r: Column, g: Column, b: Column) -> Column:
    """#rrggbb of whole numbers from 0 to 255; null outside."""
    ok = r.between(0, 255) & g.between(0, 255) & b.between(0, 255)
    return F.when(ok, F.lower(F.concat(F.lit("#"), *[F.lpad(F.hex(c.cast("long")), 2, "0") for c in (r, g, b)])))


def collapse_hex(colour: Column) -> Column:
    """#aabbcc -> #abc, lower case."""
    c = F.lower(colour)
    same = (F.length(c) == 7) & (F.substring(c, 2, 1) == F.substring(c, 3, 1)) & (F.substring(c, 4, 1) == F.substring(c, 5, 1)) & (F.substring(c, 6, 1) == F.substring(c, 7, 1))
    return F.when(same, F.concat(F.lit("#"), F.substring(c, 2, 1), F.substring(c, 4, 1), F.substring(c, 6, 1))).otherwise(c)


def percent_channel(percent: Column) -> Column:
    """A colour channel of a percentage, rounded half to even."""
    return F.bround(percent / F.lit(100.0) * F.lit(255.0), 0).cast("int")


def clamp_channel(value: Column) -> Column:
    return F.least(F.greatest(F.bround(value, 0), F.lit(0)), F.lit(255)).cast("int")


def vendor_prefix(name: Column) -> Column:
    """-moz-x -> -moz-; empty where there is none."""
    return F.regexp_extract(name, "^(-[^-]+-).+", 1)


def property_key(name: Column, value: Column) -> Column:
    """The key under which declarations replace each other: values with a vendor prefix are apart."""
    return F.concat(vendor_prefix(value), name)


def parse_bool(text: Column) -> Column:
    """True unless the text says false: what cannot be read counts as true."""
    return F.lower(F.btrim(text)).eqNullSafe(F.lit("false")) == F.lit(False)


def parse_int(text: Column) -> Column:
    return F.coalesce(F.btrim(text).try_cast("int"), F.lit(0))


def parse_float(text: Column) -> Column:
    return F.btrim(text).try_cast("float")


def split_list(text: Column) -> Column:
    """Parts between semicolons, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")


def dpi_name(dpi: Column) -> Column:
    """1.5 -> Resolution15X, 2 -> Resolution2X."""
    digits = F.regexp_replace(dpi.cast("double").cast("string"), r"\.0$", "")
    return F.concat(F.lit("Resolution"), F.replace(digits, F.lit("."), F.lit("")), F.lit("X"))


def expand_tokens(text: Column, values: Column) -> Column:
    """%name% and %name:default% from a map with lower-case keys, in one pass; unknown ones stay as they are."""
    pattern = r"%([-./\w]+)(?::\w*)?%"
    pieces = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    names = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    made = F.zip_with(whole, names, lambda w, n: F.coalesce(F.try_element_at(values, F.lower(n)), w))
    return F.array_join(F.zip_with(pieces, made, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def expand_tokens_deep(text: Column, values: Column, depth: int = 10) -> Column:
    """expand_tokens over and over, at most depth times (there may be cycles)."""
    for _ in range(depth):
        text = expand_tokens(text, values)
    return text


def classify_term(text: Column) -> Column:
    """number, hex (a colour), or string."""
    return F.when(text.rlike("^-?[0-9.]"), "number").when(text.rlike("^#[0-9A-Fa-f]{3,}$"), "hex").otherwise("string")


def classify_selector(text: Column) -> Column:
    return F.when(text.startswith("#"), "id").when(text.startswith("."), "class").otherwise("at-name")
