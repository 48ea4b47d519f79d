"""Stylesheets: parsing into declarations, optimising and printing, as Arrow-batched functions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType

_COMMENT = re.compile(r"/\*.*?(?:\*/|$)", re.S)
_TOKEN = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|url\(\s*[^'\")\s][^)]*\)|[{};]", re.S | re.I)
_NUMBER = re.compile(r"(?<![\w#.%-])([+-]?)0*([0-9]*)(?:\.([0-9]*?)0*)?(px|em|ex|rem|cm|mm|in|pt|pc|ch|vw|vh|vmin|vmax|%|[a-zA-Z]*)(?![\w.%-])")
_HEX = re.compile(r"#([0-9a-fA-F]{6})(?![0-9a-zA-Z])")
_RGB = re.compile(r"rgb\(\s*([0-9]+)\s*,\s*([0-9]+)\s*,\s*([0-9]+)\s*\)", re.I)


class CssError(ValueError):
    pass


def parse(text: str) -> list:
    """A tree: rules are (prelude, children or declarations), statements are strings."""
    text = _COMMENT.sub(" ", text.lstrip("﻿"))
    root: list = []
    stack: list[tuple[str, list]] = [("", root)]
    part, at = "", 0
    for m in _TOKEN.finditer(text):
        part += text[at : m.start()]
        at = m.end()
        mark = m[0]
        if mark == "{":
            stack.append((part.strip(), []))
            part = ""
        elif mark == "}":
            if len(stack) == 1:
                raise CssError("a brace too many")
            if part.strip():
                stack[-1][1].append(part.strip())
            name, body = stack.pop()
            stack[-1][1].append((name, body))
            part = ""
        elif mark == ";":
            if part.strip():
                stack[-1][1].append(part.strip())
            part = ""
        else:
            part += mark
    part += text[at:]
    if len(stack) > 1:
        raise CssError("a brace too few")
    if part.strip():
        root.append(part.strip())
    return root


def _outside(text: str, change) -> str:
    """change applied to what is outside strings and url()."""
    out, at = [], 0
    for m in re.finditer(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|url\([^)]*\)", text, re.S | re.I):
        out += [change(text[at : m.start()]), m[0].replace("\\\r\n", "").replace("\\\n", "")]
        at = m.end()
    return "".join([*out, change(text[at:])])


def selector(text: str) -> str:
    text = _outside(text, lambda s: re.sub(r"\s*([,>+~=|^$*]=?|\[|\])\s*", lambda m: m[1] if m[1] not in "[]*" else m[0], re.sub(r"\s+", " ", s)))
    text = _outside(text, lambda s: re.sub(r"\[\s+", "[", re.sub(r"\s+\]", "]", s)))
    return text.strip()


def prelude(text: str) -> str:
    if not text.startswith("@"):
        return selector(text)
    text = _outside(text, lambda s: re.sub(r"\s*([,:])\s*", r"\1", re.sub(r"\(\s+|\s+\)", lambda m: m[0].strip(), re.sub(r"\s+", " ", s))))
    return text.strip()


def colour(text: str) -> str:
    def channels(m):
        c = [int(m[i]) for i in (1, 2, 3)]
        return "#" + "".join(f"{x:02x}" for x in c) if max(c) < 256 else m[0]

    def short(m):
        h = m[1].lower()
        return "#" + (h[0] + h[2] + h[4] if h[0] == h[1] and h[2] == h[3] and h[4] == h[5] else h)

    return _HEX.sub(short, _RGB.sub(channels, text))


def number(m: re.Match) -> str:
    sign, whole, part, unit = m[1], m[2], m[3] or "", m[4]
    if not re.search("[0-9]", m[0]):
        return m[0]
    if not whole and not part:
        return "0" + ("" if unit.lower() in {"", "px", "em", "ex", "rem", "cm", "mm", "in", "pt", "pc", "ch", "vw", "vh", "vmin", "vmax", "%"} else unit)
    return ("-" if sign == "-" else "") + whole + ("." + part if part else "") + unit


def value(text: str, optimise: bool = True) -> str:
    def tidy(s: str) -> str:
        s = re.sub(r"\s+", " ", s)
        s = re.sub(r"\s*!\s*important", "!important", s, flags=re.I)
        s = re.sub(r"\s*,\s*", ",", re.sub(r"\(\s+", "(", re.sub(r"\s+\)", ")", s)))
        return _NUMBER.sub(number, colour(s)) if optimise else s

    return _outside(text, tidy).strip()


def declaration(text: str, optimise: bool = True) -> tuple[str, str]:
    name, mark, rest = text.partition(":")
    if not mark or not name.strip():
        raise CssError(f"not a declaration: {text[:40]}")
    return name.strip(), value(rest, optimise)


def merged(decls: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The later of two declarations of one property stands, at the end; an important one is not replaced by one that is not."""
    kept: dict[str, tuple[str, str]] = {}
    for name, v in decls:
        prefix = re.match(r"(-[^-]+-)", v)
        key = (prefix[1] if prefix else "") + name
        if key in kept and kept[key][1].endswith("!important") and not v.endswith("!important"):
            continue
        kept.pop(key, None)
        kept[key] = (name, v)
    return list(kept.values())


def printed(nodes: list, optimise: bool, pretty: bool, depth: int = 0) -> str:
    pad, end = ("  " * depth, "\r\n") if pretty else ("", "")
    out = []
    decls = [n for n in nodes if isinstance(n, str) and not n.startswith("@")]
    if depth and decls:
        pairs = [declaration(d, optimise) for d in decls]
        out.append((";" + end).join(f"{pad}{a}:{b}" for a, b in (merged(pairs) if optimise else pairs)) + end)
    elif decls:
        raise CssError(f"not a rule: {decls[0][:40]}")
    for n in nodes:
        if isinstance(n, str):
            if n.startswith("@"):
                if not n.lower().startswith("@-wg-dpi"):
                    out.append(f"{pad}{prelude(n)};{end}")
            continue
        head, body = n
        if not head:
            raise CssError("a rule without a selector")
        inside = printed(body, optimise, pretty, depth + 1)
        if not inside and optimise:
            continue
        name = re.sub(r"^@page\s+:", "@page:", prelude(head))
        out.append(f"{pad}{name}{end}{pad}{{{end}{inside or end}{pad}}}{end}" if pretty else f"{name}{{{inside}}}")
    return "".join(out)


def minified(text: str | None, optimise: bool = True, pretty: bool = False) -> str | None:
    """The stylesheet without needless characters; null for null and for what cannot be parsed."""
    if text is None:
        return None
    try:
        return printed(parse(text), optimise, pretty)
    except CssError:
        return None


def _batches(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(minified, na_action="ignore")


def minify(text: Column) -> Column:
    """minified() over a column, in Arrow batches."""
    return F.pandas_udf(_batches, "string", PandasUDFType.SCALAR_ITER)(text)
