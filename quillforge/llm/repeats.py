"""Removal of every byte that a repeated 400-byte string covers.

Column-wise construction of a collection's Burrows-Wheeler transform takes one sequential pass
over everything for each symbol of the longest document (over 120,000 passes), so another
method is used (see README): minimisers pick the places worth comparing, and windows are
compared by hash there.

Each window of SPAN bytes is named by its least GRAM-byte hash. Equal windows have equal names, so
only windows whose name is picked at two or more places can repeat. Those names are found by
one join; the windows under them are hashed and sent, packed, to shards by name (and by their
own hash where a name is frequent), and each shard reports the spans of windows that are equal
to another, in the hash of all their bytes and in their name, 128 bits together. Whole copies of a text need no windows: one of them stands for all, and each is
covered wholly if it is long enough.

Defined cases. Null text is empty. Texts under SPAN bytes lose nothing and remove nothing. Rows
that repeat an id and a text are copies of each other. Strings are judged on the input.
Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .keep import pick_texts
from .scratch import mark, split_join, sweep, written

SPAN, GRAM = 400, 64
WIDTH = SPAN - GRAM + 1
#: bytes of packed windows in a shard, about, and places of a name that stay in one shard
SHARD_BYTES, PLACES = 24 << 20, 5000
GATHER = 1 << 20

_INV = tk.U(pow(0x100000001B3, -1, 1 << 64))
_down = np.ones(1, np.uint64)


def _inverse(n: int) -> np.ndarray:
    global _down
    while _down.size < n:
        with np.errstate(over="ignore"):
            _down = np.concatenate([_down, _down * (_down[-1] * _INV)])
    return _down[:n]


class Windows:
    """Names of the windows of a slice and what is needed to hash any of them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = data.size
        self.n = max(0, n - SPAN + 1)
        with np.errstate(over="ignore"):
            self.sum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tk._CODE[data] * tk.powers(n))]) if n else np.zeros(1, np.uint64)
        self.ok = np.zeros(n + 1, np.int32)
        size = np.diff(offsets)
        long = size >= SPAN
        self.ok[offsets[:-1][long]] += 1
        self.ok[offsets[1:][long] - SPAN + 1] -= 1
        self.ok = np.cumsum(self.ok)[: self.n] > 0
        if not self.n:
            self.gram = self.name = np.zeros(0, np.uint64)
            return
        self.gram = self.hash(np.arange(n - GRAM + 1), GRAM)
        # least of WIDTH neighbours: from block ends to the left, and from block starts to the right
        m = -(-self.gram.size // WIDTH) * WIDTH
        g = np.full(m, np.uint64(0xFFFFFFFFFFFFFFFF))
        g[: self.gram.size] = self.gram
        g = g.reshape(-1, WIDTH)
        right = np.minimum.accumulate(g, axis=1).ravel()
        left = np.minimum.accumulate(g[:, ::-1], axis=1)[:, ::-1].ravel()
        self.name = np.minimum(left[: self.n], right[WIDTH - 1 : WIDTH - 1 + self.n])

    def hash(self, at: np.ndarray, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return tk.mix((self.sum[at + size] - self.sum[at]) * _inverse(self.sum.size)[at])


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each place at which a name is picked."""
    for batch in batches:
        for a, b, data, offsets in tk.slices(batch.column("text")):
            w = Windows(data, offsets)
            if not w.n:
                continue
            # a place is picked if its hash is the name of a valid window around it
            least = np.where(w.ok, w.name, tk.U(0))
            m = w.gram.size
            padded = np.zeros(-(-(m + WIDTH - 1) // WIDTH) * WIDTH, np.uint64)
            padded[WIDTH - 1 : WIDTH - 1 + w.n] = least
            p = padded.reshape(-1, WIDTH)
            right = np.maximum.accumulate(p, axis=1).ravel()
            left = np.maximum.accumulate(p[:, ::-1], axis=1)[:, ::-1].ravel()
            keep = min(m, right.size - WIDTH + 1)
            most = np.zeros(m, np.uint64)
            most[:keep] = np.maximum(left[:keep], right[WIDTH - 1 : WIDTH - 1 + keep])
            at = np.flatnonzero((most == w.gram) & (w.gram != 0))
            doc = pa.array(np.searchsorted(offsets, at, side="right") - 1 + a)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(doc), batch.column("tx").take(doc), pa.array(w.gram[at].view(np.int64))], ["id", "tx", "name"])


def _windows(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            shard, key, uid, pos, name = (np.concatenate([x[i] for x in held]) for i in range(5))
            held.clear()
            order = np.argsort(shard, kind="stable")
            shard, key, uid, pos, name = shard[order], key[order], uid[order], pos[order], name[order]
            which, first = np.unique(shard, return_index=True)
            last = np.append(first[1:], shard.size)
            # windows of one name follow each other, so all but the keys takes little room
            packed = [pa.array([tk.squeeze(np.diff(pos[a:b], prepend=0).astype(np.int32)) if x is pos else x[a:b].tobytes() if x is key else tk.squeeze(x[a:b]) for a, b in zip(first, last)], pa.binary()) for x in (key, uid, pos, name)]
            return pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), *packed], ["shard", "keys", "uids", "places", "names"])

        held: list[tuple] = []
        for batch in batches:
            uids, names, parts = batch.column("uid").to_numpy(), batch.column("names"), batch.column("parts")
            for a, b, data, offsets in tk.slices(batch.column("text")):
                w = Windows(data, offsets)
                table, at = np.unique(names.slice(a, b - a).flatten().to_numpy().view(np.uint64), return_index=True)
                share = parts.slice(a, b - a).flatten().to_numpy()[at].astype(np.uint64)
                if not w.n or not table.size:
                    continue
                step = np.flatnonzero(np.concatenate([[True], w.name[1:] != w.name[:-1]]))  # runs of one name
                value = w.name[step]
                at = np.minimum(np.searchsorted(table, value), table.size - 1)
                size = np.diff(np.append(step, w.n))
                mine = np.repeat(table[at] == value, size) & w.ok
                pos = np.flatnonzero(mine)
                share = np.repeat(share[at], size)[pos]
                key = w.hash(pos, SPAN)
                with np.errstate(over="ignore"):
                    shard = (tk.mix(w.name[pos] + (key % share) * tk._MULT) % tk.U(shards)).astype(np.int64)
                doc = np.searchsorted(offsets, pos, side="right") - 1
                held.append((shard, key, uids[doc + a], (pos - offsets[doc]).astype(np.int32), w.name[pos]))
                if sum(x[0].size for x in held) >= GATHER:
                    yield flush()
        if held:
            yield flush()

    return run


def _equal(table: pa.Table) -> pa.Table:
    """The spans of windows of one shard that are equal to another window."""
    keys = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
    key = np.concatenate(keys)
    uid, pos, name = (np.concatenate([tk.unsqueeze(x, k.size, t) for k, x in zip(keys, table.column(c).to_pylist())]) for c, t in (("uids", np.int64), ("places", np.int32), ("names", np.uint64)))
    at = np.cumsum([0] + [k.size for k in keys])[:-1]
    run = np.cumsum(pos.astype(np.int64))
    pos = (run - np.repeat(run[at] - pos[at], [k.size for k in keys])).astype(np.int32)
    order = np.argsort(key, kind="stable")
    k, m = key[order], name[order]
    if ((k[1:] == k[:-1]) & (m[1:] != m[:-1])).any():  # one hash for different windows
        order = np.lexsort((name, key))
        k, m = key[order], name[order]
    same = (k[1:] == k[:-1]) & (m[1:] == m[:-1])
    again = np.zeros(k.size, bool)
    again[1:] |= same
    again[:-1] |= same
    at = order[again]
    uid, pos = uid[at], pos[at]
    order = np.lexsort((pos, uid))
    uid, pos = uid[order], pos[order]
    new = np.ones(uid.size, bool)
    new[1:] = (uid[1:] != uid[:-1]) | (pos[1:] > pos[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], uid.size) - 1
    begin, end, of = pos[first], pos[last] if uid.size else pos, uid[first]
    # a row for each document: spans stay packed
    doc = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if of.size else np.zeros(0, np.int64)
    cut = pa.array(np.append(doc, of.size).astype(np.int32))
    return pa.Table.from_arrays([pa.array(of[doc]), pa.ListArray.from_arrays(cut, pa.array(begin)), pa.ListArray.from_arrays(cut, pa.array(end))], names=["uid", "starts", "ends"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, count, removed = [], [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            raw, last, parts, n = (text or "").encode(), 0, [], 0
            end = -1
            for s, e in sorted((x["start"], x["end"] + SPAN) for x in spans):
                if s > end:
                    n += 1
                    parts.append(raw[max(end, 0) : s])
                end = max(end, e)
            parts.append(raw[max(end, 0) :])
            left = b"".join(parts)
            kept.append(hashlib.sha256(left).hexdigest())
            count.append(n)
            removed.append(len(raw) - len(left))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tx"), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.string()), batch.column("spans")], ["id", "tx", "n_removed", "n_spans", "sha", "spans"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, tx, n_bytes, n_removed, n_spans, sha (of what is left)."""
    spark, since = docs.sparkSession, mark()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tx"), F.col(text_col).cast("string").alias("text"))
    text = F.coalesce("text", F.lit(""))
    base = written(rows.select("id", "tx", F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("whole")), "rep-digests")
    copies = base.filter(F.col("n_bytes") >= SPAN).groupBy("whole").agg(F.min(F.struct("id", "tx")).alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    total = base.count()
    base = written(split_join(base, copies, "whole", "n", total), "rep-copies")
    spare = base.filter(F.col("rep").isNotNull() & ~F.struct("id", "tx").eqNullSafe(F.col("rep"))).select("id", "tx").distinct()
    names = rows.mapInArrow(_names, "id long, tx long, name long").alias("n")
    spare = spare.alias("s")
    names = written(names.join(spare, F.col("n.id").eqNullSafe(F.col("s.id")) & (F.col("n.tx") == F.col("s.tx")), "left_anti"), "rep-names")
    shared = names.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    named = split_join(names, shared, "name", "n", names.count()).filter("n is not null").select("id", "tx", "name", (F.floor(F.col("n") / PLACES) + 1).cast("long").alias("parts"))
    wanted = named.groupBy("id", "tx").agg(F.collect_set(F.struct("name", "parts")).alias("of"))
    wanted = written(wanted.select("id", "tx", F.col("of.name").alias("names"), F.col("of.parts").alias("parts")), "rep-wanted")
    texts = pick_texts(docs, wanted, id_col, text_col, ("names", "parts")).select("id", "tx", F.xxhash64("id", "tx").alias("uid"), "text", "names", "parts")
    texts = written(texts, "rep-texts")
    sweep(spark, since, base, texts)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(12, 10 * size // SHARD_BYTES)
    packed = texts.select("uid", "text", "names", "parts").mapInArrow(_windows(shards), "shard int, keys binary, uids binary, places binary, names binary")
    spans = packed.repartition(shards, "shard").groupBy("shard").applyInArrow(_equal, "uid long, starts array<int>, ends array<int>")
    spans = spans.groupBy("uid").agg(F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))).cast("array<struct<start:int,end:int>>").alias("spans"))
    cut = texts.select("id", "tx", "uid", "text").join(spans, "uid").select("id", "tx", "text", "spans")
    done = written(cut.mapInArrow(_cut, "id long, tx long, n_removed long, n_spans long, sha string, spans array<struct<start:int,end:int>>"), "rep-cut")
    sweep(spark, since, base, done)
    cut = done.alias("c")
    b = base.alias("b")
    out = b.join(cut, F.col("b.id").eqNullSafe(F.col("c.id")) & (F.col("b.tx") == F.col("c.tx")), "left")
    copy = F.col("b.rep").isNotNull()
    return out.select(
        "b.id",
        "b.tx",
        "b.n_bytes",
        F.when(copy, F.col("b.n_bytes")).otherwise(F.coalesce("c.n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("c.n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("c.sha", F.lower(F.hex("b.whole")))).alias("sha"),
    )
