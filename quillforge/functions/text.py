"""Paths, escapes, colour names, comments and parsing helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the named colours of the public CSS colour module, in order of their names
COLOUR_NAMES = """
aliceblue f0f8ff antiquewhite faebd7 aqua 00ffff aquamarine 7fffd4 azure f0ffff beige f5f5dc bisque ffe4c4 black 000000
blanchedalmond ffebcd blue 0000ff blueviolet 8a2be2 brown a52a2a burlywood deb887 cadetblue 5f9ea0 chartreuse 7fff00
chocolate d2691e coral ff7f50 cornflowerblue 6495ed cornsilk fff8dc crimson dc143c cyan 00ffff darkblue 00008b darkcyan 008b8b
darkgoldenrod b8860b darkgray a9a9a9 darkgreen 006400 darkgrey a9a9a9 darkkhaki bdb76b darkmagenta 8b008b darkolivegreen 556b2f
darkorange ff8c00 darkorchid 9932cc darkred 8b0000 darksalmon e9967a darkseagreen 8fbc8f darkslateblue 483d8b darkslategray 2f4f4f
darkslategrey 2f4f4f darkturquoise 00ced1 darkviolet 9400d3 deeppink ff1493 deepskyblue 00bfff dimgray 696969 dimgrey 696969
dodgerblue 1e90ff firebrick b22222 floralwhite fffaf0 forestgreen 228b22 fuchsia ff00ff gainsboro dcdcdc ghostwhite f8f8ff
gold ffd700 goldenrod daa520 gray 808080 green 008000 greenyellow adff2f grey 808080 honeydew f0fff0 hotpink ff69b4 indianred cd5c5c
indigo 4b0082 ivory fffff0 khaki f0e68c lavender e6e6fa lavenderblush fff0f5 lawngreen 7cfc00 lemonchiffon fffacd lightblue add8e6
lightcoral f08080 lightcyan e0ffff lightgoldenrodyellow fafad2 lightgray d3d3d3 lightgreen 90ee90 lightgrey d3d3d3 lightpink ffb6c1
lightsalmon ffa07a lightseagreen 20b2aa lightskyblue 87cefa lightslategray 778899 lightslategrey 778899 lightsteelblue b0c4de
lightyellow ffffe0 lime 00ff00 limegreen 32cd32 linen faf0e6 magenta ff00ff maroon 800000 mediumaquamarine 66cdaa mediumblue 0000cd
mediumorchid ba55d3 mediumpurple 9370db mediumseagreen 3cb371 mediumslateblue 7b68ee mediumspringgreen 00fa9a mediumturquoise 48d1cc
mediumvioletred c71585 midnightblue 191970 mintcream f5fffa mistyrose ffe4e1 moccasin ffe4b5 navajowhite ffdead navy 000080 oldlace fdf5e6
olive 808000 olivedrab 6b8e23 orange ffa500 orangered ff4500 orchid da70d6 palegoldenrod eee8aa palegreen 98fb98 paleturquoise afeeee
palevioletred db7093 papayawhip ffefd5 peachpuff ffdab9 peru cd853f pink ffc0cb plum dda0dd powderblue b0e0e6 purple 800080 red ff0000
rosybrown bc8f8f royalblue 4169e1 saddlebrown 8b4513 salmon fa8072 sandybrown f4a460 seagreen 2e8b57 seashell fff5ee sienna a0522d
silver c0c0c0 skyblue 87ceeb slateblue 6a5acd slategray 708090 slategrey 708090 snow fffafa springgreen 00ff7f steelblue 4682b4 tan d2b48c
teal 008080 thistle d8bfd8 tomato ff6347 turquoise 40e0d0 violet ee82ee wheat f5deb3 white ffffff whitesmoke f5f5f5 yellow ffff00 yellowgreen 9acd32
""".split()

#: code point of each name's colour; of names for one colour the shorter, then the earlier, stands for it
NAMED = dict(zip(COLOUR_NAMES[::2], COLOUR_NAMES[1::2]))
SHORTEST: dict[str, str] = {}
for _name in sorted(NAMED, key=lambda n: (len(n), n)):
    SHORTEST.setdefault(NAMED[_name], _name)
# fixed value: the names that every browser has known from the first level on
MAJOR = ("aqua black blue fuchsia gray green lime maroon navy olive orange purple red silver teal white yellow").split()


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def colour_of(name: Column) -> Column:
    """#rrggbb of a colour's name (ignoring case), null if it is none."""
    return F.concat(F.lit("#"), F.try_element_at(_map(NAMED), F.lower(name)))


def shortest_colour(colour: Column, every: bool = False) -> Column:
    """The shorter of a colour's hexadecimal form (three digits where they do) and its name: one of the first names, or of all."""
    names = {k: v for k, v in SHORTEST.items() if every or v in MAJOR}
    low = F.lower(colour)
    pair = (F.substring(low, 2, 1) == F.substring(low, 3, 1)) & (F.substring(low, 4, 1) == F.substring(low, 5, 1)) & (F.substring(low, 6, 1) == F.substring(low, 7, 1))
    short = F.when((F.length(low) == 7) & pair, F.concat(F.lit("#"), F.substring(low, 2, 1), F.substring(low, 4, 1), F.substring(low, 6, 1))).otherwise(low)
    name = F.try_element_at(_map(names), F.substring(low, 2, 6))
    return F.when(F.length(name) < F.length(short), name).otherwise(short)


def decode_escapes(text: Column) -> Column:
    r"""\26 and \000026 as the characters they stand for, with the white space that ends them; other escaped characters without the backslash."""
    pattern = r"\\(?:([0-9A-Fa-f]{1,6})(?:\r\n|[ \t\r\n\f])?|([^\r\n\f0-9A-Fa-f]))"
    pieces = F.split(text, pattern, -1)
    codes, plain = (F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2))
    ok = lambda c: F.conv(c, 16, 10).cast("long").between(1, 0x10FFFF) & ~F.conv(c, 16, 10).cast("long").between(0xD800, 0xDFFF)
    one = lambda c, p: F.when(c == "", p).when(ok(c), F.decode(F.unhex(F.lpad(c, 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd"))
    made = F.zip_with(codes, plain, one)
    return F.array_join(F.zip_with(pieces, made, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def with_separator(path: Column) -> Column:
    """The path of a folder, with a slash at its end."""
    p = F.translate(path, "\\", "/")
    return F.when(p.endswith("/"), p).otherwise(F.concat(p, F.lit("/")))


def full_path(folder: Column, path: Column) -> Column:
    """A lower-cased path in a folder unless it has a root of its own; . and .. steps are taken."""
    p = F.translate(path, "\\", "/")
    joined = F.when(p.startswith("/") | p.rlike("^[A-Za-z]:"), p).otherwise(F.concat(with_separator(folder), p))
    steps = F.filter(F.split(F.lower(joined), "/"), lambda s: (s != "") & (s != "."))
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda a, s: F.when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, s)))
    return F.concat(F.when(joined.startswith("/"), "/").otherwise(""), F.array_join(walked, "/"))


def relative_to(path: Column, start: Column) -> Column:
    """A lower-cased path as seen from the file at start; unchanged if even their first steps differ."""
    split = lambda c: F.split(F.lower(F.translate(c, "\\", "/")), "/")
    a, b = split(path), split(start)
    least = F.least(F.size(a), F.size(b)) - 1
    same = F.aggregate(F.sequence(F.lit(0), F.greatest(least, F.lit(0))), F.lit(0), lambda n, i: F.when((n == i) & (i < least) & (F.get(a, i) == F.get(b, i)), n + 1).otherwise(n))
    ups = F.repeat(F.lit("../"), F.size(b) - 1 - same)
    return F.when(same == 0, path).otherwise(F.concat(ups, F.array_join(F.slice(a, same + 1, F.size(a) - same), "/")))


def relative_to_folder(path: Column, folder: Column) -> Column:
    return relative_to(path, F.concat(with_separator(folder), F.lit("x")))


def replace_comments(css: Column, values: Column) -> Column:
    """Each value after a /*[id]*/ comment, up to the next ; or }, replaced by the map's value of its id; others stay."""
    pattern = r"(/\*\[([^\]]+)\]\*/)([^;}]*)"
    pieces = F.split(css, pattern, -1)
    ids, old = F.regexp_extract_all(css, F.lit(pattern), F.lit(2)), F.regexp_extract_all(css, F.lit(pattern), F.lit(3))
    made = F.zip_with(ids, old, lambda i, o: F.coalesce(F.try_element_at(values, i), o))
    return F.array_join(F.zip_with(pieces, made, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def null_if_blank(text: Column) -> Column:
    return F.when(F.trim(text) != "", text)


def is_blank(text: Column) -> Column:
    return F.coalesce(F.trim(text) == "", F.lit(True))


def parse_float(text: Column) -> Column:
    """0 where the text is no number."""
    return F.coalesce(F.btrim(text).try_cast("double"), F.lit(0.0))


def parse_enum(text: Column, names: list[str]) -> Column:
    """The name as it is defined, ignoring case; null if it is not."""
    out = F.lit(None).cast("string")
    for n in names:
        out = F.when(F.lower(F.btrim(text)) == n.lower(), F.lit(n)).otherwise(out)
    return out


def with_unit(value: Column, unit: str) -> Column:
    """A number with its sign and unit; 0 has none."""
    digits = F.regexp_replace(F.abs(value).cast("decimal(30,6)").cast("string"), r"\.?0+$", "")
    return F.when(value == 0, "0").otherwise(F.concat(F.when(value < 0, "-").otherwise(""), digits, F.lit(unit)))


def join_but_last(items: Column, after: str) -> Column:
    """Items joined, each but the last followed by a text; index and length decide."""
    return F.array_join(F.transform(items, lambda x, i: F.when(i < F.size(items) - 1, F.concat(x, F.lit(after))).otherwise(x)), "")


def merged_maps(*maps: Column) -> Column:
    """Maps together; a key in two of them raises."""
    return F.map_concat(*maps)


def value_or(values: Column, key: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(values, key), default)
