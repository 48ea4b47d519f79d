"""Benchmark decontamination by winnowing.

Words are lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII characters. A window
is WINDOW consecutive words of an item, or a whole shorter item. For windows of L words the
fingerprints of a text are its k-gram hashes (k = (L + 1) // 2) that are least in some run of
L - k + 1 k-grams; an occurrence of a window and the window itself pick the same k-gram, so
every shared span of L words shares a fingerprint. Document fingerprints are joined with those
of the items, and each hit is extended to the windows around it and compared byte by byte.

The benchmark is a stated query set. It is taken in blocks of about BLOCK_BYTES of text, each
broadcast to one scan of the documents; more than one block costs one scan each.

Defined cases. Null or wordless texts have no words and no hits. Items without words have no
windows. Items that repeat an id count once; a null id reads "null". Repeated documents get a
row each. Empty tables give no rows, or no hits. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk

WINDOW = 10
BLOCK_BYTES = 8 << 20
SCHEMA = "id long, tx long, n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def fingerprints(h: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """k-gram hashes, which of them are picked for windows of ``length`` words, and which window starts are valid."""
    k = (length + 1) // 2
    w = length - k + 1
    g = tk.runs(h, k)
    ok = tk.valid_runs(doc, length, max(0, h.size - length + 1))
    if not ok.size:
        return g, np.zeros(g.size, bool), ok
    least = g[: ok.size].copy()
    for i in range(1, w):
        np.minimum(least, g[i : i + ok.size], out=least)
    least[~ok] = 0
    padded = np.zeros(g.size + w - 1, np.uint64)
    padded[w - 1 : w - 1 + ok.size] = least
    most = padded[: g.size].copy()
    for i in range(1, w):
        np.maximum(most, padded[i : i + g.size], out=most)
    return g, (most == g) & (g != 0), ok


def found(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values are in a sorted table."""
    if not table.size or not values.size:
        return np.zeros(values.size, bool)
    at = np.minimum(np.searchsorted(table, values), table.size - 1)
    return table[at] == values


class Index:
    """Windows and fingerprints of a block of items."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.fp: dict[int, np.ndarray] = {}
        self.win: dict[int, np.ndarray] = {}
        self.texts: dict[int, dict[bytes, set[str]]] = {}
        fp: dict[int, list[np.ndarray]] = {}
        for item, text in items:
            raw = (text or "").encode()
            data = np.frombuffer(raw, np.uint8)
            words = tk.Words(data, np.array([0, data.size]), tk.ALNUM)
            n = words.start.size
            if not n:
                continue
            length = min(window, n)
            g, picked, _ = fingerprints(words.hashes(), words.doc, length)
            fp.setdefault(length, []).append(g[picked])
            spelt = [words.low[a:b].tobytes() for a, b in zip(words.start, words.end)]
            texts = self.texts.setdefault(length, {})
            for i in range(n - length + 1):
                texts.setdefault(b" ".join(spelt[i : i + length]), set()).add(item)
        for length, parts in fp.items():
            self.fp[length] = np.unique(np.concatenate(parts))
            hashes = []
            for key in self.texts[length]:
                data = np.frombuffer(key, np.uint8)
                w = tk.Words(data, np.array([0, data.size]), tk.ALNUM)
                hashes.append(tk.runs(w.hashes(), length))
            self.win[length] = np.unique(np.concatenate(hashes))

    def hits(self, words: tk.Words) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Which words of a slice are hit, and the items found in each document."""
        h = words.hashes()
        cover = np.zeros(h.size + 1, np.int32)
        items: dict[int, set[str]] = {}
        for length, table in self.fp.items():
            g, picked, ok = fingerprints(h, words.doc, length)
            at = np.flatnonzero(picked)
            at = at[found(g[at], table)]
            if not at.size:
                continue
            w = length - (length + 1) // 2 + 1
            p = np.unique((at[:, None] - np.arange(w)[None, :]).ravel())
            p = p[(p >= 0) & (p < ok.size)]
            p = p[ok[p]]
            with np.errstate(over="ignore"):
                full = h[p] * tk.U(1)
                for i in range(1, length):
                    full = full * tk._BASE + h[p + i]
                full = tk.mix(full + tk.U(length) * tk._MULT)
            p = p[found(full, self.win[length])]
            doc = np.searchsorted(words.doc, p, side="right") - 1
            for a, d in zip(p.tolist(), doc.tolist()):
                key = b" ".join([words.low[words.start[i] : words.end[i]].tobytes() for i in range(a, a + length)])
                got = self.texts[length].get(key)
                if got:
                    cover[a] += 1
                    cover[a + length] -= 1
                    items.setdefault(d, set()).update(got)
        return np.cumsum(cover[:-1]) > 0, items


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        schema = pa.schema([("id", pa.int64()), ("tx", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string()))])
        for batch in batches:
            for a, b, data, offsets in tk.slices(batch.column("text")):
                words = tk.Words(data, offsets, tk.ALNUM)
                hit, items = index.hits(words)
                edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
                begin, end = edge[:-1] == 1, edge[1:] == -1
                inner = words.doc[(words.doc > 0) & (words.doc < hit.size)]
                begin[inner] |= hit[inner]
                end[inner - 1] |= hit[inner - 1]
                begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
                of = np.searchsorted(words.doc, begin, side="right") - 1
                base = words.doc[of]
                count = np.bincount(of, minlength=b - a)
                spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.StructArray.from_arrays([pa.array((begin - base).astype(np.int32)), pa.array((end - base).astype(np.int32))], ["start", "end"]))
                rows = pa.array([sorted(items.get(i, ())) for i in range(b - a)], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), batch.column("tx").slice(a, b - a), pa.array(words.count.astype(np.int64)), spans, rows], schema=schema)

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document: id, tx, n_words, spans (hit words, [start, end)), items (ids found)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(item_text), F.lit(""))
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), text.alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tx"), F.col(text_col).cast("string").alias("text"))
    if blocks > 1:
        rows = rows.withColumn("row", F.monotonically_increasing_id())
    parts = []
    for k in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        index = Index([(r.item, r.text) for r in block.collect()], window)  # about block_bytes
        parts.append(rows.select("id", "tx", "text").mapInArrow(tk.lean(_scan(spark.sparkContext.broadcast(index))), SCHEMA))
    if len(parts) == 1:
        return parts[0]
    # every block returns a row for each document, so repeated rows are counted by blocks
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    one = every.groupBy("id", "tx", "n_words").agg(F.flatten(F.collect_set("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"), (F.count(F.lit(1)) / len(parts)).cast("int").alias("times"))
    merged = F.expr(
        """aggregate(array_sort(spans), cast(array() as array<struct<start:int,end:int>>),
        (a, s) -> case when size(a) > 0 and a[size(a) - 1].end >= s.start
          then concat(slice(a, 1, size(a) - 1), array(struct(a[size(a) - 1].start as start, greatest(a[size(a) - 1].end, s.end) as end)))
          else concat(a, array(s)) end)"""
    )
    return one.select("id", "tx", "n_words", merged.alias("spans"), F.array_sort("items").alias("items"), F.explode(F.sequence(F.lit(1), "times")).alias("time")).drop("time")
