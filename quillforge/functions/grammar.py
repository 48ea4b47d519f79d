"""A stylesheet grammar: tokens, a tree with places, errors as rows, rewriting visitors, and a printer.

Sheets are parsed in Arrow batches; declarations and errors come out as rows, which the relational
optimiser (operators/rules.py) works on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKENS = re.compile(
    r"(?P<space>[ \t\r\n\f]+)|(?P<comment>/\*.*?\*/)|(?P<open>/\*.*\Z)|(?P<string>\"(?:[^\"\\\r\n\f]|\\(?:\r\n|.))*\"|'(?:[^'\\\r\n\f]|\\(?:\r\n|.))*')|(?P<broken>[\"'][^\r\n\f]*)"
    r"|(?P<url>url\(\s*[^\s\"'()]*\s*\))|(?P<token>%[-./\w]+(?::\w*)?%)|(?P<number>[+-]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)(?:%|-?[a-zA-Z_][\w-]*)?)"
    r"|(?P<hash>#[\w-]+)|(?P<at>@-?[a-zA-Z_][\w-]*)|(?P<function>-?(?:[a-zA-Z_]|[^\x00-\x7f]|\\.)(?:[\w-]|[^\x00-\x7f]|\\.)*\()|(?P<word>-{0,2}(?:[a-zA-Z_]|[^\x00-\x7f]|\\.)(?:[\w-]|[^\x00-\x7f]|\\.)*)"
    r"|(?P<mark>[~|^$*]=|[{}();:,>+~*=.\[\]!/|&-])|(?P<odd>.)",
    re.S,
)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    line: int
    column: int


@dataclass(frozen=True)
class Error:
    line: int
    column: int
    message: str


@dataclass(frozen=True)
class Declaration:
    name: str
    value: str
    important: bool
    line: int = 0
    column: int = 0


@dataclass(frozen=True)
class Rule:
    selectors: tuple[str, ...]
    body: tuple[Declaration, ...]
    line: int = 0
    column: int = 0


@dataclass(frozen=True)
class At:
    """An at-rule: a statement (body is None), with declarations, or with rules."""

    name: str
    prelude: str
    body: tuple | None
    line: int = 0
    column: int = 0


@dataclass
class Sheet:
    items: tuple = ()
    errors: list[Error] = field(default_factory=list)


def scan(text: str) -> tuple[list[Token], list[Error]]:
    """Tokens with their places (from 1), and what is no token."""
    out, errors, line, start = [], [], 1, 0
    for m in _TOKENS.finditer(text):
        kind, at = m.lastgroup, m.start()
        column = at - start + 1
        if kind == "open":
            errors.append(Error(line, column, "comment without an end"))
        elif kind == "broken":
            errors.append(Error(line, column, "string without an end"))
        elif kind == "odd":
            errors.append(Error(line, column, f"unexpected character {m[0]!r}"))
        elif kind != "comment":
            out.append(Token(kind, m[0], line, column))
        ends = m[0].count("\n")
        if ends:
            line += ends
            start = at + m[0].rindex("\n") + 1
    return out, errors


#: at-rules whose block holds rules
GROUPS = ("@media", "@document", "@supports", "@keyframes", "@layer", "@container", "@scope", "@starting-style")


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.errors = scan(text.lstrip("\ufeff"))
        self.at = 0

    def peek(self) -> Token | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def fail(self, token: Token | None, message: str) -> None:
        token = token or (self.tokens[-1] if self.tokens else Token("", "", 1, 1))
        self.errors.append(Error(token.line, token.column, message))

    def until(self, stops: str) -> list[Token]:
        """Tokens up to one of the stops outside brackets, which stays."""
        out, depth = [], 0
        while (t := self.peek()) is not None:
            if t.kind == "mark" and depth == 0 and t.text in stops:
                break
            if t.text in ("(", "[") or t.kind == "function":
                depth += 1
            elif t.text in (")", "]"):
                depth = max(0, depth - 1)
            elif t.text in "{}" and t.kind == "mark":
                break
            out.append(t)
            self.at += 1
        if depth:
            self.fail(out[-1], "bracket without an end")
        return out

    def items(self, inside: bool, frames: bool = False) -> tuple:
        out = []
        while (t := self.peek()) is not None:
            if t.kind == "space" or t.text == ";":
                self.at += 1
            elif t.text == "}":
                if inside:
                    break
                self.fail(t, "brace without a block")
                self.at += 1
            elif t.kind == "at":
                out.append(self.at_rule())
            else:
                rule = self.rule()
                if rule is not None:
                    out.append(rule)
        return tuple(out)

    def block(self, parse):
        """What is between braces; the one at hand opens them."""
        opened = self.peek()
        self.at += 1
        body = parse()
        if self.peek() is None:
            self.fail(opened, "block without an end")
        else:
            self.at += 1
        return body

    def at_rule(self) -> At:
        first = self.peek()
        self.at += 1
        head = self.until(";{}")
        t = self.peek()
        name = first.text.lower()
        if t is None or t.text != "{":
            if t is not None and t.text == ";":
                self.at += 1
            return At(first.text, spelt(head), None, first.line, first.column)
        bare = "@" + name.split("-")[-1] if name.startswith("@-") else name
        body = self.block(lambda: self.items(True)) if bare in GROUPS else self.block(self.declarations)
        return At(first.text, spelt(head), body, first.line, first.column)

    def rule(self) -> Rule | None:
        first = self.peek()
        head = self.until("{;")
        t = self.peek()
        if t is None or t.text != "{":
            self.fail(first, "selector without a block")
            if t is not None and t.text == ";":
                self.at += 1
            return None
        selectors = tuple(spelt(part, True) for part in parts(head, ","))
        if not all(selectors):
            self.fail(t, "empty selector")
        body = self.block(self.declarations)
        return Rule(selectors, body, first.line, first.column) if all(selectors) else None

    def declarations(self) -> tuple[Declaration, ...]:
        out = []
        while (t := self.peek()) is not None and t.text != "}":
            if t.kind == "space" or t.text == ";":
                self.at += 1
                continue
            whole = self.until(";}")
            if (n := self.peek()) is not None and n.text == "{":
                self.fail(n, "block in a block")
                self.block(self.declarations)
                continue
            pieces = parts(whole, ":", 1)
            name = spelt(pieces[0])
            if len(pieces) < 2 or not re.fullmatch(r"[*_]?(?:-{0,2}[a-zA-Z_%][\w.%:/-]*)", name):
                self.fail(t, "not a declaration")
                continue
            words = [x for x in pieces[1] if x.kind != "space"]
            important = len(words) >= 2 and words[-1].text.lower() == "important" and words[-2].text == "!"
            value = spelt(pieces[1][: pieces[1].index(words[-2])] if important else pieces[1])
            if not value:
                self.fail(t, "declaration without a value")
                continue
            out.append(Declaration(name, value, important, t.line, t.column))
        return tuple(out)


def parts(tokens: list[Token], mark: str, most: int = -1) -> list[list[Token]]:
    """Tokens between marks outside brackets."""
    out, depth = [[]], 0
    for t in tokens:
        depth += (t.text in ("(", "[") or t.kind == "function") - (t.text in (")", "]"))
        if t.text == mark and t.kind == "mark" and depth <= 0 and most != 0:
            out.append([])
            most -= 1
        else:
            out[-1].append(t)
    return out


def spelt(tokens: list[Token], selector: bool = False) -> str:
    """Tokens as text, with single spaces where they count: in calculations around binary + and -, between words and terms."""
    out, stack = [], []
    for i, t in enumerate(tokens):
        if t.kind == "function":
            stack.append(t.text.lower())
        elif t.text == "(":
            stack.append("(")
        elif t.text == ")" and stack:
            stack.pop()
        counts = any(s in ("calc(", "min(", "max(", "clamp(") for s in stack)
        if t.kind == "space":
            before, after = (tokens[i - 1].text if i else ""), (tokens[i + 1].text if i + 1 < len(tokens) else "")
            if not before or not after:
                continue
            if counts and (before in "+-" or after in "+-"):
                out.append(" ")
                continue
            tight = ",>~=|^$" + ("+" if selector else "") + ("*/" if counts else ":" if not selector else "")
            if before[-1] in tight + "([" or before in ("~=", "|=", "^=", "$=", "*=") or after in tuple(tight + ")]") or after in ("~=", "|=", "^=", "$=", "*=") or after == "!" or before == "!":
                continue
            out.append(" ")
        else:
            out.append(re.sub(r"\\(?:\r\n|[\r\n\f])", "", t.text) if t.kind == "string" else t.text)
    return "".join(out)


def parse(text: str) -> Sheet:
    """The tree of a sheet; what cannot be parsed is left out and listed."""
    p = _Parser(text)
    items = p.items(False)
    return Sheet(items, sorted(set(p.errors), key=lambda e: (e.line, e.column, e.message)))


class Rewriter:
    """Walks a tree and builds it anew; a method of a node kind returns the node, another, or None to drop it."""

    def sheet(self, node: Sheet) -> Sheet:
        return Sheet(self.each(node.items), node.errors)

    def each(self, nodes: tuple) -> tuple:
        return tuple(x for x in map(self.visit, nodes) if x is not None)

    def visit(self, node):
        return {Declaration: self.declaration, Rule: self.rule, At: self.at}[type(node)](node)

    def declaration(self, node: Declaration):
        return node

    def rule(self, node: Rule):
        return replace(node, body=self.each(node.body))

    def at(self, node: At):
        return node if node.body is None else replace(node, body=self.each(node.body))


class WithoutText(Rewriter):
    """Drops declarations that hold a text."""

    def __init__(self, text: str):
        self.text = text

    def declaration(self, node: Declaration):
        return None if self.text in f"{node.name}:{node.value}" else node


class WithoutSelectors(Rewriter):
    """Drops the selectors that hold a banned text, and rules of which none is left, also in media blocks."""

    def __init__(self, banned: list[str]):
        self.banned = banned

    def rule(self, node: Rule):
        left = tuple(s for s in node.selectors if not any(b in s for b in self.banned))
        return replace(node, selectors=left) if left else None


class WithoutEmpty(Rewriter):
    def rule(self, node: Rule):
        return node if node.body else None

    def at(self, node: At):
        node = super().at(node)
        return node if node.body is None or node.body else None


def rewritten(sheet: Sheet, *visitors: Rewriter) -> Sheet:
    """Visitors one after the other."""
    for v in visitors:
        sheet = v.sheet(sheet)
    return sheet


def printed(nodes: tuple) -> str:
    out = []
    for i, n in enumerate(nodes):
        if isinstance(n, Declaration):
            out.append(f"{n.name}:{n.value}{'!important' if n.important else ''}" + (";" if i + 1 < len(nodes) else ""))
        elif isinstance(n, Rule):
            out.append(",".join(n.selectors) + "{" + printed(n.body) + "}")
        elif n.name.lower() != "@-wg-dpi":
            head = n.name + (("" if n.prelude.startswith(":") and n.name.lower() == "@page" else " ") + n.prelude if n.prelude else "")
            out.append(head + (";" if n.body is None else "{" + printed(n.body) + "}"))
    return "".join(out)


def _flat(nodes: tuple, media: str | None, rows: list, place: list[int]) -> None:
    for n in nodes:
        if isinstance(n, Rule):
            place[0] += 1
            for k, d in enumerate(n.body):
                rows.append((media, place[0], ",".join(n.selectors), k, d.name, d.value, d.important))
        elif isinstance(n, At) and n.body is not None:
            if n.body and isinstance(n.body[0], Declaration):
                place[0] += 1
                rows += [(media, place[0], f"{n.name} {n.prelude}".strip(), k, d.name, d.value, d.important) for k, d in enumerate(n.body)]
            else:
                _flat(n.body, n.prelude if n.name.lower() == "@media" else f"{n.name} {n.prelude}".strip(), rows, place)


_ROWS = (("media", pa.string()), ("rule", pa.int64()), ("selector", pa.string()), ("decl", pa.int64()), ("property", pa.string()), ("value", pa.string()), ("important", pa.bool_()))


def _emit(batch: pa.RecordBatch, of: list[int], rows: list[tuple], names) -> pa.RecordBatch:
    columns = [pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(names)]
    return pa.RecordBatch.from_arrays([batch.column("sheet").take(pa.array(of, pa.int64())), *columns], ["sheet", *(n for n, _ in names)])


def _declare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        of, rows = [], []
        for i, text in enumerate(batch.column("css").to_pylist()):
            mine: list[tuple] = []
            _flat(parse(text or "").items, None, mine, [0])
            rows += mine
            of += [i] * len(mine)
        yield _emit(batch, of, rows, _ROWS)


def _fault(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = (("line", pa.int64()), ("column", pa.int64()), ("message", pa.string()))
    for batch in batches:
        of, rows = [], []
        for i, text in enumerate(batch.column("css").to_pylist()):
            found = parse(text or "").errors
            rows += [(e.line, e.column, e.message) for e in found]
            of += [i] * len(found)
        yield _emit(batch, of, rows, names)


def declarations(sheets: DataFrame, key: str, css: str) -> DataFrame:
    """(sheet, media, rule, selector, decl, property, value, important) of stylesheets."""
    kind = sheets.schema[key].dataType.simpleString()
    return sheets.select(F.col(key).alias("sheet"), F.col(css).cast("string").alias("css")).mapInArrow(_declare, f"sheet {kind}, media string, rule long, selector string, decl long, property string, value string, important boolean")


def errors(sheets: DataFrame, key: str, css: str) -> DataFrame:
    """(sheet, line, column, message) of what cannot be parsed."""
    kind = sheets.schema[key].dataType.simpleString()
    return sheets.select(F.col(key).alias("sheet"), F.col(css).cast("string").alias("css")).mapInArrow(_fault, f"sheet {kind}, line long, column long, message string")


def _tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = [None if t is None else printed(parse(t).items) for t in batch.column("css").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("sheet"), pa.array(text, pa.string())], ["sheet", "css"])


def tolerant(sheets: DataFrame, key: str, css: str) -> DataFrame:
    """(sheet, css): minified text of what can be parsed; errors() lists the rest."""
    kind = sheets.schema[key].dataType.simpleString()
    return sheets.select(F.col(key).alias("sheet"), F.col(css).cast("string").alias("css")).mapInArrow(_tidy, f"sheet {kind}, css string")
