"""Language-model scoring with sharded log-frequency Bloom filters.

Tokens are white-space separated words (A-Z lower-cased) and one end for each text. Unigram
counts are exact. A bigram of count c is stored as the levels 1..1+floor(log2 c) in the Bloom
filter of its shard; its level is read back by probing levels until one is absent, and its count c'
is the mean count of the bigrams stored at that level. The model interpolates:
log10 P(w | h) = log10((min(c'(hw), c(h)) + MU * base(w)) / (c(h) + MU)), where base(w) is the
unigram estimate. For the true counts these add up to 1 over all words; with c' they do so on the
average over histories, but for false hits of the filters (about 1 % of absent bigrams).

The filters grow with the corpus, so they are not copied to every worker: the n-grams of a
run of documents (GATHER tokens) travel, packed and each once, to the shard that holds their filter
and counts, are probed there, and the levels travel back to the run. The corpus is read once whatever
the model's size; a shard's size does not grow with the corpus, and only one number a level comes to the driver.
A bigram's shard depends on both its words, so a frequent history is spread over all shards.

Defined cases. Null and empty texts have the end as their only token. A null id counts as the
text "null" for the fold. Repeated rows are scored alike and counted each. Empty tables
give no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .scratch import written

FOLDS, HELD = 5, 1
MU = 300.0
BITS, HASHES = 10, 5
LEVELS = 40
#: bytes of text for each shard, about
SHARD_BYTES = 12 << 20
#: tokens of a run of documents (a longer document is a run of its own)
GATHER = 3 << 19

END = np.array([0x1F3A95C7D2E4B681], np.uint64)
START = np.array([0x7C15F39B4E8D2A67], np.uint64)

#: kinds of packed rows: one row for each (run, shard) of unigrams and bigrams, and one for the run itself
RUN, UNI, BI, STAT = 0, 1, 2, 3
PACKED = "run string, shard int, kind int, keys binary, counts binary"
PROBED = "run string, shard int, kind int, body binary, more binary, size long, total long"


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a slice, ends included, and how many each document has."""
    words = tk.Words(data, offsets, tk.SPACED)
    return np.insert(words.hashes(), words.doc[1:], END[0]), words.count + 1


def pair(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return tk.mix(before * tk.U(0xD6E8FEB86659FD93) + h)


def _four(key: np.ndarray) -> bytes:
    """The low 32 bits of each key. The shard is told by other bits; a shard's keys are few beside 2^32, so fewer are confused than by its filter."""
    return key.astype(np.uint32).tobytes()


def _eight(body: bytes) -> np.ndarray:
    return np.frombuffer(body, np.uint32).astype(np.uint64)


def bigrams(index: np.ndarray, count: np.ndarray, salt: np.ndarray, shards: int):
    """Distinct bigrams of a run in the order of their shards: (histories, words, cuts between shards, place of each token's bigram).

    Words are numbers below salt.size, and salt.size is the start.
    """
    n = salt.size
    before = np.empty(index.size, np.int64)
    before[1:] = index[:-1]
    before[np.cumsum(count) - count] = n
    code, place = np.unique(before * (n + 1) + index, return_inverse=True)
    hist, word = code // (n + 1), code % (n + 1)
    salted = np.append(salt, np.uint16(START[0] & tk.U(0xFFFF))).astype(np.uint64)
    with np.errstate(over="ignore"):
        shard = (tk.mix((salted[hist] << tk.U(16)) ^ salted[word]) % tk.U(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    back = np.empty(order.size, np.int64)
    back[order] = np.arange(order.size)
    return hist[order], word[order], np.searchsorted(shard[order], np.arange(shards + 1)), back[place]


def _pack(shards: int, gather: int):
    """Runs of documents as packed rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            h, count, docs = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), pa.concat_tables([x[2] for x in held]).combine_chunks()
            held.clear()
            name = hashlib.blake2b(h.tobytes(), digest_size=12)
            ids = docs.column("id").combine_chunks()
            fixed = [np.asarray(ids.fill_null(0)), np.asarray(ids.is_null()), np.asarray(docs.column("tx")), np.asarray(docs.column("held"))]
            name.update(b"".join(x.tobytes() for x in fixed))
            key, index = np.unique(h, return_inverse=True)
            shard = ((key >> tk.U(32)) % tk.U(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            back = np.empty(order.size, np.int64)
            back[order] = np.arange(order.size)
            key, shard, index = key[order], shard[order], back[index]
            salt = key.astype(np.uint16)
            train = np.repeat(~fixed[3].astype(bool), count)
            seen = np.bincount(index[train], minlength=key.size).astype(np.uint32)
            cut = np.searchsorted(shard, np.arange(shards + 1))
            rows = [(s, UNI, key[a:b].tobytes(), tk.squeeze(seen[a:b])) for s, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
            hist, word, cut, place = bigrams(index, count, salt, shards)
            seen = np.bincount(place[train], minlength=hist.size).astype(np.uint32)
            two = pair(np.append(key, START)[hist], key[word])
            rows += [(s, BI, _four(two[a:b]), tk.squeeze(seen[a:b])) for s, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
            head = np.array([count.size, h.size, key.size], np.int64)
            body = b"".join(x.tobytes() for x in (head, fixed[0].astype(np.int64), fixed[2].astype(np.int64), count.astype(np.int64), salt, fixed[1].astype(np.uint8), fixed[3].astype(np.uint8)))
            rows.append((int(name.hexdigest()[:8], 16) % shards, RUN, tk.squeeze(index.astype(np.uint32)), body))
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))]
            return pa.RecordBatch.from_arrays([pa.array([name.hexdigest()] * len(rows)), *columns], ["run", "shard", "kind", "keys", "counts"])

        size = 0
        for batch in batches:
            for a, b, data, offsets in tk.slices(batch.column("text")):
                h, count = tokens(data, offsets)
                if held and size + h.size > gather:
                    yield flush()
                    size = 0
                held.append((h, count, pa.table({c: batch.column(c).slice(a, b - a) for c in ("id", "tx", "held")})))
                size += h.size
        if held:
            yield flush()

    return run


class Filter:
    """A log-frequency Bloom filter: keys with their counts' levels."""

    def __init__(self, key: np.ndarray, count: np.ndarray, bits: int = BITS):
        key, count = key[count > 0], count[count > 0]
        self.levels = np.minimum(np.frexp(count.astype(np.float64))[1], LEVELS)
        self.size = int(self.levels.sum()) * bits + 64
        table = np.zeros(self.size, bool)
        for level in range(1, int(self.levels.max(initial=0)) + 1):
            k = key[self.levels >= level]
            for i in range(HASHES):
                table[self._at(k, level, i)] = True
        self.bits = np.packbits(table, bitorder="little")

    def _at(self, key: np.ndarray, level: int, i: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (tk.mix(key + tk.U(level * HASHES + i + 1) * tk._MULT) % tk.U(self.size)).astype(np.int64)

    def level(self, key: np.ndarray) -> np.ndarray:
        """The highest level to which each key is present, 0 if it is absent."""
        level = np.zeros(key.size, np.uint8)
        live = np.arange(key.size)
        for j in range(1, LEVELS + 1):
            for i in range(HASHES):
                at = self._at(key[live], j, i)
                live = live[(self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
            if not live.size:
                break
            level[live] = j
        return level


def _probe(bits: int):
    """One shard: the counts of its unigrams and the levels of its bigrams for each run; runs pass through; statistics by level."""

    def run(table: pa.Table) -> pa.Table:
        out: list[tuple] = []
        shard = table.column("shard")[0].as_py()
        kinds = table.column("kind").to_numpy()
        for kind in (UNI, BI):
            part = table.filter(pa.array(kinds == kind))
            if not part.num_rows:
                continue
            keys = [np.frombuffer(x, np.uint64) if kind == UNI else _eight(x) for x in part.column("keys").to_pylist()]
            counts = [tk.unsqueeze(x, k.size, np.uint32) for k, x in zip(keys, part.column("counts").to_pylist())]
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(at, np.concatenate(counts), key.size).astype(np.int64)
            if kind == UNI:
                value = total
                out.append(("", 0, STAT, None, None, int((total > 0).sum()), int(total.sum())))
            else:
                found = Filter(key, total, bits)
                value = found.level(key)
                own = total[total > 0]
                out += [("", j, STAT, None, None, int((found.levels == j).sum()), int(own[found.levels == j].sum())) for j in np.unique(found.levels).tolist()]
            cut = np.cumsum([k.size for k in keys])[:-1]
            for name, v in zip(part.column("run").to_pylist(), np.split(value[at], cut)):
                out.append((name, shard, kind, tk.squeeze(v), None, v.size, 0))
        for r in table.filter(pa.array(kinds == RUN)).select(["run", "keys", "counts"]).to_pylist():
            out.append((r["run"], shard, RUN, r["keys"], r["counts"], 0, 0))
        types = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        return pa.Table.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["run", "shard", "kind", "body", "more", "size", "total"])

    return run


def _score(shards: int, n: int, v: int, means: list[float]):
    mean = np.array(means)

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        back: dict[tuple[int, int], bytes] = {(r["kind"], r["shard"]): r for r in rows if r["kind"] != RUN}  # equal runs have equal answers

        def answers(kind: int, cut: np.ndarray, dtype: type) -> np.ndarray:
            parts = []
            for s in np.flatnonzero(np.diff(cut)).tolist():
                r = back.get((kind, s))
                if r is None or r["size"] != cut[s + 1] - cut[s]:
                    raise ValueError("the documents were read again in another order; pass a table that is stored")
                parts.append(tk.unsqueeze(r["body"], r["size"], dtype))
            return np.concatenate(parts)

        sizes = {k: np.array([back[k, s]["size"] if (k, s) in back else 0 for s in range(shards)]) for k in (UNI,)}
        out = []
        for r in rows:
            if r["kind"] != RUN:
                continue
            raw = r["more"]
            docs, size, words = np.frombuffer(raw, np.int64, 3).tolist()
            ids, tx, count = (np.frombuffer(raw, np.int64, docs, 24 + 8 * docs * i) for i in range(3))
            at = 24 + 24 * docs
            salt = np.frombuffer(raw, np.uint16, words, at)
            none, held = (np.frombuffer(raw, np.uint8, docs, at + 2 * words + docs * i).astype(bool) for i in range(2))
            index = tk.unsqueeze(r["body"], size, np.uint32).astype(np.int64)
            c = answers(UNI, np.concatenate([[0], np.cumsum(sizes[UNI])]), np.int64)
            if c.size != words:
                raise ValueError("the documents were read again in another order; pass a table that is stored")
            hist, word, cut, place = bigrams(index, count, salt, shards)
            level = answers(BI, cut, np.uint8)
            begin = np.cumsum(count) - count
            texts = c[index[begin[0] + count[0] - 1]]  # ends are as many as training texts
            ch = np.append(c, texts)[hist].astype(np.float64)
            base = (c + 0.5) / (n + 0.5 * (v + 1))
            p = np.log10((np.minimum(mean[level], ch) + MU * base[word]) / (ch + MU))
            out.append(
                pa.table(
                    {
                        "id": pa.array(ids, mask=none),
                        "tx": pa.array(tx),
                        "held_out": pa.array(held),
                        "n_tokens": pa.array(count),
                        "n_known": pa.array(np.add.reduceat((c > 0)[index].astype(np.int64), begin)),
                        "base_score": pa.array(np.add.reduceat(np.log10(base)[index], begin)),
                        "score": pa.array(np.add.reduceat(p[place], begin)),
                    }
                )
            )
        return pa.concat_tables(out)

    return run


def held_out(id_col):
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("null")).cast("binary")), F.lit(FOLDS)) == HELD


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, bits: int = BITS, gather: int = GATHER) -> DataFrame:
    """A row for each document: id, tx, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    key = F.col(id_col).cast("long")
    rows = docs.select(key.alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tx"), held_out(key).alias("held"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(12, size // shard_bytes + 1)
    packed = rows.mapInArrow(_pack(shards, gather), PACKED)
    probed = written(packed.repartition(shards, "shard").groupBy("shard").applyInArrow(_probe(bits), PROBED), "lm-probed")
    stats = {r.shard: r for r in probed.filter(F.col("kind") == STAT).groupBy("shard").agg(F.sum("size").alias("size"), F.sum("total").alias("total")).collect()}  # a row a level
    n, v = (stats[0].total, stats[0].size) if stats else (0, 0)
    means = [0.0] + [stats[j].total / stats[j].size if j in stats else 0.0 for j in range(1, LEVELS + 1)]
    schema = "id long, tx long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    out = probed.filter(F.col("kind") != STAT).groupBy("run").applyInArrow(_score(shards, n, v, means), schema)
    return out.select("id", "tx", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
