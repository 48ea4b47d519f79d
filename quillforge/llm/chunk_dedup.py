"""Substring dedup by content-defined chunking with a gear rolling hash.

A chunk ends where the gear hash of the last 32 bytes has its low bits zero, but not before
LEAST bytes nor after MOST; boundaries depend on the bytes around them alone, so an insertion
shifts no chunk beyond its own. Chunks are told apart by a 128-bit digest; of equal chunks the
one in the smallest (id, hash of the text, place) is the first, and the others are repeats. Repeats that follow
each other in RUN bytes or more, or make up a whole text, are removed; shorter ones, mostly phrases that many
texts share by chance, stay.

Each task sends every digest once, packed, with its first place there (later places in the same task are repeats
for sure), so a chunk that all documents share sends one entry a task and never gathers in one place.

Defined cases. Null and empty texts have no chunks. Of rows that repeat an id and a text one
is judged by its chunks and the others are removed whole. A null id is the smallest. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as tk
from .keep import pick_texts
from .scratch import mark, sweep, written

LEAST, MOST = 40, 1024
MASK = np.uint32((1 << 5) - 1) << np.uint32(27)
RUN = 120
#: chunks that a task gathers before it sends them on, and bytes of text for each shard of the digests, about
GATHER, SHARD_BYTES = 1 << 18, 16 << 20

_GEAR = (tk.mix(np.arange(5001, 5257, dtype=np.uint64)) & tk.U(0xFFFFFFFF)).astype(np.uint32)


def cuts(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """For each text of a slice the ends of its chunks, from the slice's start."""
    h = _GEAR[data]
    place = np.arange(data.size) - np.repeat(offsets[:-1], np.diff(offsets))
    for step in (1, 2, 4, 8, 16):
        shifted = np.zeros_like(h)
        shifted[step:] = h[:-step] << np.uint32(step)
        shifted[place < step] = 0
        h = h + shifted
    ends = (np.flatnonzero((h & MASK) == 0) + 1).tolist()
    ends.append(1 << 62)
    out, at = [], 0
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        own, last = [], a
        while ends[at] <= a:
            at += 1
        while last < b:
            while ends[at] < last + LEAST:
                at += 1
            last = min(ends[at], last + MOST, b)
            own.append(last)
        out.append(own)
    return out


#: an entry: digest, whether the id is null, id, hash of the text, place of the chunk
_ENTRY = np.dtype([("d1", "<u8"), ("d0", "<u8"), ("id", "<i8"), ("tx", "<i8"), ("place", "<i4"), ("named", "u1")])
_SENT = "shard int, entries binary, id long, tx long, places array<int>"


def _later(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first entry of each digest, and those that repeat one elsewhere."""
    e = e[np.lexsort((e["place"], e["tx"], e["id"], e["named"], e["d1"], e["d0"]))]
    new = np.ones(e.size, bool)
    new[1:] = (e["d0"][1:] != e["d0"][:-1]) | (e["d1"][1:] != e["d1"][:-1])
    first = e[np.maximum.accumulate(np.where(new, np.arange(e.size), 0))] if e.size else e
    same = np.ones(e.size, bool)
    for c in ("named", "id", "tx", "place"):
        same &= e[c] == first[c]
    return e[new], e[~same]


def _by_text(e: np.ndarray) -> tuple[list[pa.Array], int]:
    """Repeats as a row for each text: id, tx, places."""
    e = np.unique(e[["named", "id", "tx", "place"]])
    new = np.ones(e.size, bool)
    new[1:] = (e["named"][1:] != e["named"][:-1]) | (e["id"][1:] != e["id"][:-1]) | (e["tx"][1:] != e["tx"][:-1])
    at = np.flatnonzero(new)
    cut = pa.array(np.append(at, e.size).astype(np.int32))
    return [pa.array(e["id"][at].copy(), mask=e["named"][at] == 0), pa.array(e["tx"][at].copy()), pa.ListArray.from_arrays(cut, pa.array(e["place"].copy()))], at.size


def _chunks(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            first, again = _later(np.concatenate(held))
            held.clear()
            shard = (first["d0"] % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            first, which = first[order], np.unique(shard)
            cut = np.searchsorted(shard[order], np.append(which, shards))
            columns, n = _by_text(again)
            packed = [first[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]
            none = lambda kind, k: pa.nulls(k, kind)
            k = which.size
            return pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array(which.astype(np.int32)), none(pa.int32(), n)]),
                    pa.concat_arrays([pa.array(packed, pa.binary()), none(pa.binary(), n)]),
                    pa.concat_arrays([none(pa.int64(), k), columns[0]]),
                    pa.concat_arrays([none(pa.int64(), k), columns[1]]),
                    pa.concat_arrays([none(pa.list_(pa.int32()), k), columns[2]]),
                ],
                ["shard", "entries", "id", "tx", "places"],
            )

        size = 0
        for batch in batches:
            ids = batch.column("id")
            named, ids, tx = np.asarray(ids.is_valid()), np.asarray(ids.fill_null(0)), np.asarray(batch.column("tx"))
            for a, b, data, offsets in tk.slices(batch.column("text")):
                raw, found, digest = data.tobytes(), cuts(data, offsets), []
                for own, last in zip(found, offsets.tolist()):
                    for end in own:
                        digest.append(hashlib.blake2b(raw[last:end], digest_size=16).digest())
                        last = end
                if not digest:
                    continue
                count = [len(x) for x in found]
                e = np.zeros(len(digest), _ENTRY)
                two = np.frombuffer(b"".join(digest), np.uint64).reshape(-1, 2)
                e["d0"], e["d1"] = two[:, 0], two[:, 1]
                of = np.repeat(np.arange(a, b), count)
                e["id"], e["named"], e["tx"] = ids[of], named[of], tx[of]
                e["place"] = np.concatenate([np.arange(n) for n in count])
                held.append(e)
                size += e.size
                if size >= GATHER:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


def _meet(table: pa.Table) -> pa.Table:
    """The repeats among the entries of one shard."""
    e = np.concatenate([np.frombuffer(x, _ENTRY) for x in table.column("entries").to_pylist()])
    columns, _ = _by_text(_later(e)[1])
    return pa.Table.from_arrays(columns, names=["id", "tx", "places"])


def spans(own: list[int], begin: int, drop: set[int], least: int) -> list[tuple[int, int]]:
    """The byte ranges that go: runs of dropped chunks of enough bytes, or of the whole text."""
    out, last, start = [], begin, None
    end = own[-1] if own else begin
    for k, cut in enumerate([*own, None]):
        gone = cut is not None and k in drop
        if gone and start is None:
            start = last
        if not gone and start is not None:
            if last - start >= least or (start == begin and last == end):
                out.append((start, last))
            start = None
        last = cut
    return out


def _rebuild(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = batch.column("places").to_pylist()
            for a, b, data, offsets in tk.slices(batch.column("text")):
                raw, kept, count, removed = data.tobytes(), [], [], []
                for i, own in enumerate(cuts(data, offsets)):
                    begin, end = int(offsets[i]), int(offsets[i + 1])
                    out = spans(own, begin, set(gone[a + i]), least)
                    edges = [begin, *(x for s in out for x in s), end]
                    kept.append(b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2])))
                    count.append(len(out))
                    removed.append(end - begin - len(kept[-1]))
                sha = [hashlib.sha256(x).hexdigest() for x in kept]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), batch.column("tx").slice(a, b - a), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary()), pa.array(sha)], ["id", "tx", "n_removed", "n_spans", "kept", "sha"])

    return run


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN) -> DataFrame:
    """A row for each document: id, tx, n_bytes, n_removed, n_spans, kept (binary; null where nothing was removed), sha."""
    spark, since = docs.sparkSession, mark()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tx"), F.col(text_col).cast("string").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    total = rows.agg(F.sum(size)).first()[0] or 0
    shards = max(12, total // SHARD_BYTES + 1)
    sent = written(rows.mapInArrow(_chunks(shards), _SENT), "cdc-entries")
    met = sent.filter("shard is not null").select("shard", "entries").repartition(shards, "shard").groupBy("shard").applyInArrow(_meet, "id long, tx long, places array<int>")
    gone = sent.filter("shard is null").select("id", "tx", "places").unionByName(met).groupBy("id", "tx").agg(F.flatten(F.collect_list("places")).alias("places"))
    gone = written(gone, "cdc-gone")
    texts = pick_texts(docs.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col)), gone, id_col, text_col, ("places",))
    cut = written(texts.mapInArrow(_rebuild(run), "id long, tx long, n_removed long, n_spans long, kept binary, sha string").filter("n_removed > 0"), "cdc-kept")
    base = rows.select("id", "tx", size.alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("whole"))
    again = base.groupBy("id", "tx").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = written(again, "cdc-again")
    sweep(spark, since, cut, again)
    c = cut.select(F.col("id").alias("c_id"), F.col("tx").alias("c_tx"), "n_removed", "n_spans", "kept", "sha")
    out = base.join(c, F.col("id").eqNullSafe(F.col("c_id")) & (F.col("tx") == F.col("c_tx")), "left")
    whole = F.lit(False)
    if not again.isEmpty():
        g = again.select(F.col("id").alias("a_id"), F.col("tx").alias("a_tx"), "n")
        g = F.broadcast(g) if again.count() <= 500_000 else g
        out = out.join(g, F.col("id").eqNullSafe(F.col("a_id")) & (F.col("tx") == F.col("a_tx")), "left")
        ranked = out.filter("n is not null").withColumn("rank", F.row_number().over(Window.partitionBy("id", "tx").orderBy("n_bytes")))
        out = out.filter("n is null").withColumn("rank", F.lit(1)).unionByName(ranked)
        whole = (F.col("rank") > 1) & (F.col("n_bytes") > 0)
    return out.select(
        "id",
        "tx",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha", "whole")).alias("sha"),
    )
