"""Scripts: a scanner with errors as rows, and a small minifier on its tokens.

The minifier drops comments and needless space, folds arithmetic on number literals, and gives locals of functions short
names: arguments first by position, then the others by use. It leaves a script's names alone where they can be seen from outside
or by means it does not follow (eval, with, arrow functions, classes, templates).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .script import FIRST_LETTERS, PART_LETTERS

KEYWORDS = set(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if implements import in instanceof interface let new null package private "
    "protected public return static super switch this throw true try typeof var void while with yield".split()
)
_PLAIN = re.compile(
    r"(?P<end>\r\n|[\r\n\u2028\u2029])|(?P<space>[ \t\x0b\f\xa0\ufeff]+)|(?P<comment>//[^\r\n\u2028\u2029]*|/\*.*?\*/)|(?P<open>/\*.*\Z)"
    r"|(?P<number>0[xX][0-9a-fA-F]+|0[bB][01]+|0[oO]?[0-7]+(?![.0-9])|(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
    r"|(?P<string>\"(?:[^\"\\\r\n]|\\(?:\r\n|.))*\"|'(?:[^'\\\r\n]|\\(?:\r\n|.))*')|(?P<broken>[\"'][^\r\n]*)|(?P<template>`(?:[^`\\]|\\.)*`)"
    r"|(?P<name>(?:[A-Za-z_$]|[^\x00-\x7f]|\\u[0-9a-fA-F]{4})(?:[\w$]|[^\x00-\x7f]|\\u[0-9a-fA-F]{4})*)"
    r"|(?P<mark>>>>=|\.\.\.|===|!==|>>>|<<=|>>=|\*\*=?|=>|==|!=|<=|>=|&&|\|\||\+\+|--|<<|>>|[-+*/%&|^]=|[{}()\[\];,<>+\-*/%&|^!~?:=.])|(?P<odd>.)",
    re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\r\n]|\\.|\[(?:[^\]\\\r\n]|\\.)*\])+/[A-Za-z]*")


@dataclass
class Token:
    kind: str
    text: str
    line: int
    column: int
    fresh: bool = False  # first on its line


def scan(text: str) -> tuple[list[Token], list[tuple[int, int, str]]]:
    """Tokens without space and comments, and errors (line, column, message)."""
    out: list[Token] = []
    errors: list[tuple[int, int, str]] = []
    at, line, start, fresh, brackets = 0, 1, 0, False, []
    while at < len(text):
        last = out[-1] if out else None
        # after a value a slash divides; elsewhere it begins a regular expression
        value = last is not None and (last.kind in ("number", "string", "regex", "template") or (last.kind == "name" and last.text not in KEYWORDS - {"this", "super", "null", "true", "false"}) or last.text in (")", "]", "}"))
        m = _REGEX.match(text, at) if text[at] == "/" and not value else None
        kind = "regex" if m else None
        m = m or _PLAIN.match(text, at)
        kind = kind or m.lastgroup
        column = at - start + 1
        if kind == "open":
            errors.append((line, column, "comment without an end"))
        elif kind == "broken":
            errors.append((line, column, "string without an end"))
        elif kind == "odd":
            errors.append((line, column, "unexpected character"))
        elif kind not in ("end", "space", "comment"):
            out.append(Token(kind, m[0], line, column, fresh))
            fresh = False
            if m[0] in ("(", "[", "{") and kind == "mark":
                brackets.append(out[-1])
            elif m[0] in (")", "]", "}") and kind == "mark":
                if not brackets or "([{".index(brackets[-1].text) != ")]}".index(m[0]):
                    errors.append((line, column, f"unexpected {m[0]}"))
                else:
                    brackets.pop()
        ends = len(re.findall(r"\r\n|[\r\n\u2028\u2029]", m[0]))
        if ends:
            line += ends
            start = at + max(m[0].rfind(c) for c in "\r\n\u2028\u2029") + 1
            fresh = True
        at = m.end()
    errors += [(t.line, t.column, f"{t.text} without an end") for t in brackets]
    return out, sorted(errors)


def short(n: int) -> str:
    """The name with a number, from 0; reserved words are not passed over here."""
    out, n = FIRST_LETTERS[n % 21], n // 21 - 1
    while n >= 0:
        out, n = out + PART_LETTERS[n % 21], n // 21 - 1
    return out


def _closing(tokens: list[Token], at: int) -> int:
    """The place of the bracket that closes the one at hand."""
    depth = 0
    for k in range(at, len(tokens)):
        if tokens[k].kind == "mark":
            depth += (tokens[k].text in "([{") - (tokens[k].text in ")]}")
            if not depth:
                return k
    return len(tokens) - 1


def _reference(tokens: list[Token], k: int) -> bool:
    """Whether a name stands for a variable: not a member, not the key of an object, not a label."""
    t = tokens[k]
    if t.kind != "name" or t.text in KEYWORDS:
        return False
    before = tokens[k - 1].text if k else ""
    after = tokens[k + 1].text if k + 1 < len(tokens) else ""
    return before != "." and not (after == ":" and before in ("{", ",", ";", "}", "", ")"))


def rename(tokens: list[Token]) -> None:
    """Short names for the locals of functions, from the outermost function in; each function names what is declared in it."""
    if any(t.text in ("eval", "with", "=>", "class", "let", "const", "...", "get", "set") or t.kind == "template" for t in tokens):
        return
    functions = []
    for k, t in enumerate(tokens):
        if t.text == "function" and t.kind == "name":
            a = k + 1 + (tokens[k + 1].kind == "name")
            b = _closing(tokens, a)
            functions.append((k, a, b, _closing(tokens, b + 1)))
    taken: dict[tuple[int, int], dict[str, str]] = {}
    for k, a, b, end in functions:
        inner = [f for f in functions if f[0] > b and f[3] <= end]
        own = lambda i: not any(f[1] <= i <= f[3] for f in inner)  # noqa: B023, E731
        arguments = [t.text for t in tokens[a + 1 : b] if t.kind == "name"]
        declared = list(dict.fromkeys(arguments))
        i = b
        while i < end:
            if own(i) and tokens[i].text == "var" and tokens[i].kind == "name":
                depth, i = 0, i + 1
                expect = True
                while i < end:
                    x = tokens[i]
                    if depth == 0 and expect and x.kind == "name":
                        declared.append(x.text)
                        expect = False
                    if x.kind == "mark":
                        depth += (x.text in "([{") - (x.text in ")]}")
                        expect = depth == 0 and x.text == ","
                    if depth < 0 or (depth == 0 and (x.text == ";" or (x.kind == "name" and x.text in ("in", "var")))) or (depth == 0 and x.fresh and not expect and tokens[i - 1].text != ","):
                        break
                    i += 1
                continue
            if own(i) and tokens[i].text == "function" and tokens[i].kind == "name" and tokens[i + 1].kind == "name" and tokens[i - 1].text in ("{", "}", ";"):
                declared.append(tokens[i + 1].text)
            i += 1
        names = [n for n in dict.fromkeys(declared) if not n.startswith("L_")]
        uses = Counter(tokens[i].text for i in range(a, end + 1) if _reference(tokens, i))
        first = {n: i for i, n in reversed(list(enumerate(declared)))}
        order = [n for n in names if n in arguments] + sorted((n for n in names if n not in arguments), key=lambda n: (-uses[n], first[n], n))
        # what is seen in the function and not declared in it keeps its name, so that name is not given away
        seen = {tokens[i].text for i in range(a, end + 1) if tokens[i].kind == "name"} - set(names)
        given, n = {}, 0
        for name in order:
            while short(n) in seen or short(n) in KEYWORDS:
                n += 1
            given[name] = short(n)
            n += 1
        taken[a, end] = given
        # an inner function that declares a name of its own hides ours there
        hidden = {name: [f for f in inner if name in {t.text for t in tokens[f[1] + 1 : f[2]] if t.kind == "name"}] for name in given}
        for i in range(a, end + 1):
            t = tokens[i]
            named = tokens[i - 1].text == "function" and i - 1 in {f[0] for f in inner}
            if t.text in given and (_reference(tokens, i) or named) and not any(f[1] <= i <= f[3] for f in hidden[t.text]):
                t.text = given[t.text]


_BEFORE = {"", "(", "[", "{", ",", ";", ":", "?", "=", "return", "+=", "-=", "&&", "||", "}"}
_AFTER = {"", ")", "]", "}", ",", ";", ":", "?", "&&", "||"}


def fold(tokens: list[Token]) -> list[Token]:
    """Number op number -> its value, where the neighbours bind less; only whole numbers that stay exact."""
    out = list(tokens)
    k = 0
    while k + 2 < len(out):
        a, op, b = out[k : k + 3]
        before, after = (out[k - 1].text if k else ""), (out[k + 3].text if k + 3 < len(out) else "")
        if a.kind == b.kind == "number" and a.text.isdigit() and b.text.isdigit() and op.text in "+-*%" and before in _BEFORE and after in _AFTER and not (b.fresh or op.fresh):
            x, y = int(a.text), int(b.text)
            v = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "%": lambda: x % y if y else -1}[op.text]()
            if 0 <= v < 1 << 53 and not (a.text.startswith("0") and len(a.text) > 1) and not (b.text.startswith("0") and len(b.text) > 1):
                out[k : k + 3] = [Token("number", str(v), a.line, a.column, a.fresh)]
                k = max(0, k - 2)
                continue
        k += 1
    return out


def printed(tokens: list[Token]) -> str:
    """Tokens with the space they need; line ends stay where a statement may end there."""
    out = []
    for k, t in enumerate(tokens):
        last = tokens[k - 1] if k else None
        if last is not None:
            if t.text == "}" and out and out[-1] == ";":
                # not the empty statement of a loop or branch: that follows its closing bracket
                if k >= 2 and tokens[k - 2].text not in (")", "else", "do"):
                    out.pop()
            ends = last.kind != "mark" or last.text in (")", "]", "}", "++", "--")
            starts = t.kind != "mark" or t.text in ("(", "[", "{", "++", "--", "+", "-", "/", "!", "~")
            if t.fresh and ends and starts and not (last.text == "}" and t.text == "{"):
                out.append("\n")
            elif last.kind in ("name", "number", "regex") and t.kind in ("name", "number"):
                out.append(" ")
            elif last.text and t.text and last.text[-1] in "+-" and t.text[0] == last.text[-1]:
                out.append(" ")
        out.append(t.text)
    return "".join(out)


def minified(text: str | None) -> str | None:
    """The script without needless characters; null for null and for what cannot be scanned."""
    if text is None:
        return None
    tokens, errors = scan(text)
    if errors:
        return None
    rename(tokens)
    return printed(fold(tokens))


def _minify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("script"), pa.array([minified(t) for t in batch.column("text").to_pylist()], pa.string())], ["script", "text"])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        of, rows = [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            found = Counter(t.kind for t in scan(text or "")[0])
            rows += sorted(found.items())
            of += [i] * len(found)
        yield pa.RecordBatch.from_arrays([batch.column("script").take(pa.array(of, pa.int64())), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["script", "kind", "n"])


def _errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        of, rows = [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            found = scan(text or "")[1]
            rows += found
            of += [i] * len(found)
        cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
        yield pa.RecordBatch.from_arrays([batch.column("script").take(pa.array(of, pa.int64())), *cols], ["script", "line", "column", "message"])


def _over(scripts: DataFrame, key: str, text: str, run, columns: str) -> DataFrame:
    kind = scripts.schema[key].dataType.simpleString()
    return scripts.select(F.col(key).alias("script"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"script {kind}, {columns}")


def minify(scripts: DataFrame, key: str, text: str) -> DataFrame:
    """(script, text): minified scripts."""
    return _over(scripts, key, text, _minify, "text string")


def token_counts(scripts: DataFrame, key: str, text: str) -> DataFrame:
    """(script, kind, n) of tokens."""
    return _over(scripts, key, text, _tokens, "kind string, n long")


def script_errors(scripts: DataFrame, key: str, text: str) -> DataFrame:
    """(script, line, column, message) of what cannot be scanned."""
    return _over(scripts, key, text, _errors, "line long, column long, message string")
