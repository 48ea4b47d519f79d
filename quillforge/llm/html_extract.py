"""Main text of web pages by union-free regular-expression inference over same-host pages.

A page is read as a stream of text blocks, each with the path of its elements; runs of blocks with
one path are a repeated group, with its first and last block apart. Streams of one host are aligned one after the other: where a
path is in both, equal texts stay constant and different texts make a text slot; where it is in
one only, it becomes optional. The result is the host's wrapper. Pages of a large host are
aligned in groups of about GROUP, and wrappers are aligned with each other until one is left.

The main text of a page is what its wrapper calls a slot. Names check that afterwards: of the
slots those in an article (or main) element stay, if there are any, without elements that are menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles or reader comments by name, role or class.
Where classes would take all slots of a page away, they are overruled.

Defined cases. Null html is an empty page; a page without text gives "". A null or odd url is
a host of its own. A host of fewer than PAGES pages has no constants. If all of a page is
constant, or all of its article, that is not taken away. Repeated pages get a row each. Empty tables give no rows.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import split_join, written

GROUP = 500
#: constants of all hosts, at most, for those of large hosts to be broadcast
BROADCAST_ITEMS = 500_000
#: after the path of the first and the last block of a repeated group
HEAD, TAIL = "^", "$"
PAGES = 4

_PIECE = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
_ATTR = re.compile(r"(?:^|[\s/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?", re.I)
_SPACE = re.compile(r"[\s ]+")

RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
DROP = {"nav", "header", "footer", "aside", "form", "script", "style", "head", "title", "button", "select", "option", "textarea", "noscript", "iframe", "template", "svg", "menu", "dialog", "object", "canvas", "fieldset", "input"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog"}
#: words of classes and ids of what is not the article
NAMES = set(
    "ad ads adv advert adverts advertisement advertising adslot sponsor sponsored promo promoted banner sidebar side aside menu nav navbar navigation breadcrumb breadcrumbs "
    "header masthead footer notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe signup login share sharing social related recommended "
    "comment comments commentlist respond replies reply disqus discussion widget toolbar pagination pager skip copyright disclaimer".split()
)
#: words that may stand beside them in one name
BESIDE = set(
    "area bar block bottom box button buttons col column container content footer form global group holder icons inner item items layer left link links list main message news outer page panel "
    "posts primary right row secondary section site slot stories strip text thread title to top unit wrap wrapper".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


def marked(name: str, label: str, ident: str) -> bool:
    """Whether a class or id says that an element is not the article: a name whose words are all known, one of them from NAMES.

    Of headings only a class that is such a word itself counts: their ids and longer classes tell what they are about.
    """
    if name in HEADINGS:
        return any(t in NAMES for t in label.lower().split())
    for token in f"{label} {ident}".lower().split():
        words = [w for w in re.split(r"[_-]|[0-9]+", token) if w]
        if any(w in NAMES for w in words) and all(w in NAMES or w in BESIDE for w in words):
            return True
    return False


def blocks(page: str) -> list[tuple[str, str, int, bool]]:
    """(path, text, dropped: 1 by class or id alone, 2 by name or role, in an article) of each block of text, in page order."""
    out: list[tuple[str, str, int, bool]] = []
    stack: list[tuple[str, str, int, bool]] = []  # name, label, dropped, in an article
    text: list[str] = []
    state = ("", 0, False)

    def flush():
        if text:
            joined = _SPACE.sub(" ", "".join(text)).strip()
            text.clear()
            if joined:
                out.append((state[0], joined, state[1], state[2]))

    def current():
        names = [s[1] for s in stack if s[0] not in INLINE]
        top = stack[-1] if stack else ("", "", 0, False)
        return "/".join(names), top[2], top[3]

    at, n = 0, len(page)
    while at < n:
        m = _PIECE.search(page, at)
        end = m.start() if m else n
        if end > at:
            if not text:
                state = current()
            text.append(html.unescape(page[at:end]))
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                text.append(m[0][9:].removesuffix("]]>"))
            continue
        if m[1]:
            if any(s[0] == name for s in stack):
                if name not in INLINE or next(s for s in reversed(stack) if s[0] == name)[2] != (stack[-2][2] if len(stack) > 1 else 0):
                    flush()
                while stack and stack.pop()[0] != name:
                    pass
            elif name not in INLINE:
                flush()
            continue
        if name == "br":
            text.append(" ")
            continue
        attrs = {a.lower(): (v or "").strip("\"'") for a, v in _ATTR.findall(m[3] or "")}
        drop = 2 * (name in DROP or attrs.get("role", "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true")
        drop = drop or int(name not in {"html", "body", "article", "main"} and marked(name, attrs.get("class", ""), attrs.get("id", "")))
        if name not in INLINE or drop:
            flush()
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6"):
            # an open paragraph, item or cell ends where the next begins
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p" or stack[k][0] == name:
                    del stack[k:]
                    break
                if stack[k][0] not in INLINE:
                    break
        if name in VOID:
            continue
        if name in RAW:
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = close.end() if close else n
            continue
        above = stack[-1] if stack else ("", "", 0, False)
        inside = above[3] or name in ("article", "main") or attrs.get("role", "").lower() == "main"
        first = attrs.get("class", "").split(" ")[0]
        stack.append((name, f"{name}.{first}" if first else name, max(above[2], drop), inside))
    flush()
    return out


def stream(found: list[tuple[str, str, int, bool]]) -> list[list]:
    """Wrapper items of one page: [path, hash of the text or -1 for a slot, repeated, pages]."""
    items: list[list] = []
    for path, run in groupby(found, lambda x: x[0]):
        h = [zlib.crc32(x[1].encode()) for x in run]
        if len(h) == 1:
            items.append([path, h[0], False, 1])
            continue
        # what all pages of a host have before or after the texts of a group would be lost in it
        items.append([path + HEAD, h[0], False, 1])
        if len(h) > 2:
            items.append([path, h[1] if len(set(h[1:-1])) == 1 else -1, True, 1])
        items.append([path + TAIL, h[-1], False, 1])
    return items


def align(a: list[list], b: list[list]) -> list[list]:
    """The wrapper of what two wrappers stand for."""

    def both(x: list, y: list) -> list:
        return [x[0], x[1] if x[1] == y[1] else -1, x[2] or y[2], x[3] + y[3]]

    pa_, pb = [x[0] for x in a], [x[0] for x in b]
    if pa_ == pb:
        return [both(x, y) for x, y in zip(a, b)]
    out = []
    for kind, i, j, k, m in SequenceMatcher(None, pa_, pb, autojunk=False).get_opcodes():
        out += [both(x, y) for x, y in zip(a[i:j], b[k:m])] if kind == "equal" else a[i:j] + b[k:m]
    return out


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            items = [stream(blocks(x or "")) for x in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("host"), *_columns(items), pa.array([1] * len(items), pa.int64())], ["host", "paths", "texts", "repeats", "counts", "pages"])


def _columns(wrappers: list[list[list]]) -> list[pa.Array]:
    types = (pa.string(), pa.int64(), pa.bool_(), pa.int64())
    return [pa.array([[x[i] for x in w] for w in wrappers], pa.list_(t)) for i, t in enumerate(types)]


def _merge(table: pa.Table) -> pa.Table:
    wrapper: list[list] = []
    pages = 0
    for row in sorted(table.select(["paths", "texts", "repeats", "counts", "pages"]).to_pylist(), key=lambda r: (-r["pages"], r["paths"], r["texts"])):  # one order, whatever comes first
        other = [list(x) for x in zip(row["paths"], row["texts"], row["repeats"], row["counts"])]
        wrapper = align(wrapper, other) if pages else other
        pages += row["pages"]
    return pa.Table.from_arrays([table.column("host").slice(0, 1).combine_chunks(), *_columns([wrapper]), pa.array([pages], pa.int64())], names=["host", "paths", "texts", "repeats", "counts", "pages"])


SCHEMA = "host string, paths array<string>, texts array<long>, repeats array<boolean>, counts array<long>, pages long"


def wrappers(pages: DataFrame) -> DataFrame:
    """pages (host, html) -> a wrapper for each host."""
    streams = pages.select("host", "html").mapInArrow(_streams, SCHEMA)
    # pages with one stream of blocks count together, so copies of a page make no large group
    once = streams.groupBy("host", "paths", "texts", "repeats").agg(F.sum("pages").alias("pages"))
    parts = written(once.select("host", "paths", "texts", "repeats", F.array_repeat("pages", F.size("paths")).alias("counts"), "pages"), "html-streams")
    while True:
        most = parts.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
        top = most.agg(F.max("n")).first()[0] or 0
        if top <= 1:
            return parts
        groups = F.floor((F.col("n") - 1) / GROUP) + 1
        sized = split_join(parts, most, "host", "n", parts.count())
        group = F.pmod(F.xxhash64("paths", "texts", "counts", "pages"), groups)
        parts = written(sized.withColumn("part", group).groupBy("host", "part").applyInArrow(_merge, SCHEMA), "html-wrappers")


def main_text(page: str, constants: set[tuple[str, int]]) -> str:
    every = blocks(page)
    found = [x for x in every if x[2] < 2]
    slots = []
    for path, group in groupby(every, lambda x: x[0]):
        run = list(group)
        for k, x in enumerate(run):
            end = "" if len(run) == 1 else HEAD if k == 0 else TAIL if k == len(run) - 1 else ""
            if x[2] < 2 and (path + end, zlib.crc32(x[1].encode())) not in constants:
                slots.append(x)
    if not any(not x[2] for x in slots) and (constants or any(x[3] for x in slots)) and slots:
        found = slots = [(*x[:2], 0, x[3]) for x in slots]  # classes that would take all away say nothing
    slots, found = ([x for x in some if not x[2]] for some in (slots, found))
    for some in ([x for x in slots if x[3]], [x for x in found if x[3]], slots):
        if some:
            return "\n".join(x[1] for x in some)
    return "\n".join(x[1] for x in found)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            texts = [main_text(x or "", set(zip(p or (), t or ()))) for x, p, t in zip(part.column("html").to_pylist(), part.column("paths").to_pylist(), part.column("texts").to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row for each page: page_id, url, text, n_chars."""
    url = F.col(url_col).cast("string")
    host = F.coalesce(F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host"))
    made = wrappers(rows)
    constant = F.filter(F.arrays_zip("paths", "texts", "counts"), lambda x: (x["texts"] >= 0) & (x["counts"] >= F.greatest(F.lit(PAGES), F.col("pages") / 2)))
    made = written(made.select("host", "pages", constant.alias("c")).select("host", "pages", F.col("c.paths").alias("paths"), F.col("c.texts").alias("texts")), "html-constants")
    items = made.agg(F.sum(F.size("paths"))).first()[0] or 0
    total = rows.count() if items <= BROADCAST_ITEMS else 1 << 62  # with more, no host's constants are broadcast
    return split_join(rows, made, "host", "pages", total).select("page_id", "url", "html", "paths", "texts").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
