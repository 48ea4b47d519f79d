"""Trigrams of a whole corpus, counted and looked up by shards of n-grams.

A document belongs to a run of GATHER words. What a run asks travels, packed and each thing once, to the shard that its
hash names, is answered there, and the answers travel back to the run; nothing of the model is copied to all
workers, shards do not grow with the corpus, and n-grams are compared whole.

First words get numbers: a shard numbers its words by frequency, so numbers are dense and frequent words' small; runs are
stored with them. Then trigrams are asked for, with their counts in training texts. Their shards tell the
shards of bigrams what trigrams end in each and what follows each; bigrams tell words the same. Every n-gram has five
numbers (STATS): n, its count (trigrams) or the number of n-grams one longer that end in it, and, as a
history, the sum of n of what follows it and how many of these have n = 1, 2 and more. What a shard tells
another is added up first, so frequent n-grams have one row a run or shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .scratch import drop_part, mark, settled, sweep

#: bytes of text for each shard, about, and words of a run (a longer document is a run of its own)
SHARD_BYTES = 8 << 20
GATHER = 1 << 19
#: shares of the shards of trigrams and bigrams, and of the runs, that are on their way one after the other: less disk for more passes over the stored runs
PASSES = 4
JUDGED = 8
STATS = 5

#: kinds of packed rows; facts for shards of pass k are of kind FACT + k
ASK, ANSWER, STAT, RUN, FACT = range(5)
PACKED = "kind int, run string, shard int, level int, size long, grams array<binary>, stats array<binary>, docs binary"
_NAMES = [x.split()[0] for x in PACKED.split(", ")]
_TYPES = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.binary()]


def _rows(rows: list[tuple], make=pa.RecordBatch):
    return make.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], _NAMES)


def _squeezed(arrays: list[np.ndarray]) -> list[bytes]:
    return [tk.squeeze(s) if s.any() else b"" for s in arrays]


def _loose(body: bytes, size: int, kind: type = np.int64) -> np.ndarray:
    return tk.unsqueeze(body, size, kind).astype(np.int64, copy=False) if body else np.zeros(size, np.int64)


def _width(v: int) -> type:
    return np.int32 if v < 1 << 31 else np.int64


def _kinds(stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns of numbers, the most frequent first, and the place of each column among them."""
    if len(stats) == 1:
        most = int(stats.max(initial=0))
        if most <= 4 * stats.size + 64:
            return np.arange(most + 1)[None], stats[0]
    code = stats[0].astype(np.uint64)
    with np.errstate(over="ignore"):
        for x in stats[1:]:
            code = tk.mix(code * tk.U(0xD6E8FEB86659FD93) + x.astype(np.uint64))
    first, at = _group(code)
    if any((x[first][at] != x).any() for x in stats):  # one hash for different columns
        return stats, np.arange(stats.shape[1])
    often = np.argsort(-np.bincount(at, minlength=first.size), kind="stable")
    place = np.empty(often.size, np.int64)
    place[often] = np.arange(often.size)
    return stats[:, first[often]], place[at]


def _pack_stats(values: np.ndarray, kinds: np.ndarray) -> list[bytes]:
    """Numbers of n-grams as places in their distinct columns (values by kind, and each n-gram's kind); nothing if all are 0."""
    if values.shape[1] > 4 * kinds.size + 64:
        first, at = _group(kinds)
        some = kinds[first]
    else:
        there = np.zeros(values.shape[1], bool)
        there[kinds] = True
        some = np.flatnonzero(there)
        at = (np.cumsum(there) - 1)[kinds]
    values = values[:, some]
    if not values.any():
        return []
    return [tk.squeeze(at.astype(np.int32)), tk.squeeze(values.ravel()), np.int64(some.size).tobytes()]


def _stats(r: dict) -> np.ndarray:
    """The numbers of the n-grams of a row: of trigrams n alone."""
    lines = 1 if r["level"] == 3 else STATS
    out = np.zeros((lines, r["size"]), np.int64)
    if r["stats"]:
        at, values, n = r["stats"]
        n = int(np.frombuffer(n, np.int64)[0])
        at = tk.unsqueeze(at, r["size"], np.int32)
        for x, y in zip(out, tk.unsqueeze(values, lines * n, np.int64).reshape(lines, n)):
            np.take(y, at, out=x)
    return out


def _packed(columns: list[np.ndarray], v: int) -> list[bytes]:
    """Sorted n-grams of word numbers under v."""
    head = columns[0].astype(np.int64, copy=False)
    head = head * v + columns[1] if len(columns) == 3 else head
    return _squeezed([np.diff(head, prepend=0), *(c.astype(_width(v)) for c in columns[max(1, len(columns) - 1) :])])


def _unpacked(r: dict, v: int) -> list[np.ndarray]:
    first, *last = (_loose(x, r["size"], k) for x, k in zip(r["grams"], (np.int64, _width(v))))
    first = np.cumsum(first)
    return [c.astype(_width(v), copy=False) for c in [*(np.divmod(first, v) if r["level"] == 3 else [first]), *last]]


def _group(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct value, by value, and the distinct value of each place."""
    order = np.argsort(code)
    ordered = code[order]
    new = np.ones(code.size, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    at = np.empty(code.size, np.int64)
    at[order] = np.cumsum(new) - 1
    return order[new], at


def _code(columns: list[np.ndarray], v: int) -> np.ndarray:
    """A number for each n-gram, in their order; v * v is under 2^63."""
    out = columns[0].astype(np.int64, copy=False)
    for i, c in enumerate(columns[1:], 2):
        out = (_group(out)[1] if v**i >= 1 << 63 else out) * v + c
    return out


def _share(mixed: np.ndarray) -> np.ndarray:
    """What a word, mixed, adds to the pass of its n-grams."""
    return ((mixed >> tk.U(40)).astype(np.uint16) % np.uint16(PASSES)).astype(np.uint8)


def _pass_of(shares: list[np.ndarray]) -> np.ndarray:
    """The pass of each n-gram, from what its words add."""
    out = shares[0]
    for c in shares[1:]:
        out = out + c
    return out % np.uint8(PASSES)


def _shard_of(mixed: list[np.ndarray], own: np.ndarray | int, shards: int) -> np.ndarray:
    """The shard of each n-gram from its words' numbers, each mixed, and its pass, which is the remainder of the shard by PASSES."""
    out = mixed[0]
    with np.errstate(over="ignore"):
        for c in mixed[1:]:
            out = out * tk.U(0xD6E8FEB86659FD93) + c
        out = out * tk.U(0xBF58476D1CE4E5B9)
    out ^= out >> tk.U(29)
    size = (shards + PASSES - 1 - np.arange(PASSES, dtype=np.uint64)) // tk.U(PASSES)  # shards of each pass
    kind = np.uint16 if shards < 1 << 16 else np.int64
    return (out % size[own]).astype(kind) * kind(PASSES) + (own if isinstance(own, int) else own.astype(kind))


def _cuts(shard: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order by shard, and where each shard begins."""
    return np.argsort(shard, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(shard, minlength=shards))])


def runs(batches: Iterator[pa.RecordBatch], gather: int) -> Iterator[tuple]:
    """(name, word hashes, place of each word, words of each document, documents) of runs of documents."""
    held: list[tuple] = []
    size = 0

    def flush() -> tuple:
        h, count, docs = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), pa.concat_tables([x[2] for x in held]).combine_chunks()
        held.clear()
        name = hashlib.blake2b(h.tobytes(), digest_size=12)
        ids = docs.column("id").combine_chunks()
        for x in (count, np.asarray(ids.fill_null(0)), np.asarray(ids.is_null()), np.asarray(docs.column("tx")), np.asarray(docs.column("good"))):
            name.update(np.ascontiguousarray(x).tobytes())
        words, index = _group(h)
        return name.hexdigest(), h[words], index, count, docs

    for batch in batches:
        for a, b, data, offsets in tk.slices(batch.column("text")):
            words = tk.Words(data, offsets, tk.SPACED)
            if held and size + words.start.size > gather:
                yield flush()
                size = 0
            held.append((words.hashes(), words.count, pa.Table.from_batches([batch.slice(a, b - a)]).drop_columns(["text"])))
            size += words.start.size
    if held:
        yield flush()


def _held(index: np.ndarray, doc: np.ndarray, size: int) -> np.ndarray:
    """How many documents hold each word."""
    pairs = np.sort(doc * size + index)
    return np.bincount(pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] % size, minlength=size) if pairs.size else np.zeros(size, np.int64)


def _ask_numbers(shards: int, gather: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, words, index, count, docs in runs(batches, gather):
            order, cut = _cuts((words % tk.U(shards)).astype(np.int64), shards)
            doc, n = np.repeat(np.arange(count.size), count), [np.bincount(index, minlength=words.size)]
            for c in ("bad", "good"):
                some = np.asarray(docs.column(c))[doc]
                n.append(_held(index[some], doc[some], words.size))
            words, n = words[order], [x[order] for x in n]
            rows = [(ASK, name, s, 0, b - a, [tk.squeeze(np.diff(words[a:b], prepend=tk.U(0)))], _squeezed([x[a:b] for x in n]), None) for s, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
            if rows:
                yield _rows(rows)

    return run


def _number(shards: int, pick):
    """One shard of words: the numbers shard + 1, shard + 1 + shards and so on, by falling frequency; and the words that pick(bad, good) picks by how many documents hold them."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        words = np.concatenate([np.cumsum(tk.unsqueeze(r["grams"][0], r["size"], np.uint64), dtype=np.uint64) for r in rows])
        first, at = _group(words)
        n, bad, good = (np.bincount(at, np.concatenate([_loose(r["stats"][i], r["size"]) for r in rows])).astype(np.int64) for i in range(3))
        number = np.empty(first.size, np.int64)
        number[np.argsort(-n, kind="stable")] = np.arange(first.size) * shards + rows[0]["shard"] + 1
        cut = np.cumsum([0] + [r["size"] for r in rows])
        out = [(ANSWER, r["run"], r["shard"], 0, r["size"], [], _squeezed([number[at[a:b]]]), None) for r, a, b in zip(rows, cut[:-1], cut[1:])]
        some = pick(bad, good)
        out.append((STAT, "", 0, 0, int(number.max()), [words[first][some].tobytes()], [bad[some].tobytes(), good[some].tobytes()], None))
        return _rows(out, pa.Table)

    return run


def _to_bytes(docs: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
        to.write_table(docs)
    return sink.getvalue().to_pybytes()


def _documents(shards: int, gather: int, more):
    """Runs as rows; more(words, index, count, documents) are further columns of the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, words, index, count, docs in runs(batches, gather):
            docs = docs.append_column("n_words", pa.array(count.astype(np.int64)))
            for c, values in more(words, index, count, docs).items():
                docs = docs.append_column(c, pa.array(values))
            order, cut = _cuts((words % tk.U(shards)).astype(np.int64), shards)
            back = np.empty(order.size, np.int64)
            back[order] = np.arange(order.size)
            yield _rows([(RUN, name, 0, 0, index.size, [tk.squeeze(back[index].astype(np.int32)), cut.tobytes()] if index.size else [], [], _to_bytes(docs))])

    return run


class Lost(ValueError):
    def __init__(self):
        super().__init__("the documents were read again in another order; pass a table that is stored")


def _answers(back: dict[tuple[int, int], dict], level: int, cut: np.ndarray) -> np.ndarray:
    """Numbers of the things of one run, in the order of its shards."""
    parts = []
    for s in np.flatnonzero(np.diff(cut)).tolist():
        r = back.get((level, s))
        if r is None or r["size"] != cut[s + 1] - cut[s]:
            raise Lost
        parts.append(_loose(r["stats"][0], r["size"])[None] if level == 0 else _stats(r))
    return np.concatenate(parts, axis=1) if parts else np.zeros((STATS, 0), np.int64)


def _split(table: pa.Table) -> tuple[list[dict], dict[tuple[int, int], dict]]:
    rows = table.to_pylist()
    found = [r for r in rows if r["kind"] == RUN]
    if not found:
        raise Lost
    return found, {(r["level"], r["shard"]): r for r in rows if r["kind"] == ANSWER}  # equal runs have equal answers


def _store(table: pa.Table) -> pa.Table:
    """Runs with the numbers of their words, in their order; places of words are among them."""
    found, back = _split(table)
    out = []
    for r in found:
        if r["size"]:
            numbers = _answers(back, 0, np.frombuffer(r["grams"][1], np.int64))[0]
            order = np.argsort(numbers)
            place = np.empty(order.size, np.int32)
            place[order] = np.arange(order.size, dtype=np.int32)
            index = place[tk.unsqueeze(r["grams"][0], r["size"], np.int32)]
            r["grams"] = [tk.squeeze(index), tk.squeeze(np.diff(numbers[order], prepend=0)), np.int64(order.size).tobytes()]
        out.append(tuple(r[c] for c in _NAMES))
    return _rows(out, pa.Table)


class Grams:
    """The distinct n-grams of a stored run, each level in the order of its shards, and where each word's lie.

    With a part, only those of the shards of that pass, and rows are the words whose n-grams these are."""

    def __init__(self, r: dict, shards: int, levels: tuple[int, ...] = (1, 2, 3), part: int | None = None):
        self.docs = pa.ipc.open_stream(r["docs"]).read_all()
        self.count = count = np.asarray(self.docs.column("n_words"))
        self.cuts, self.columns, self.places = {}, {}, {}
        self.size = r["size"]
        if not self.size:
            return
        self.numbers = np.concatenate([[0], np.cumsum(tk.unsqueeze(r["grams"][1], int(np.frombuffer(r["grams"][2], np.int64)[0]), np.int64))])  # the start is 0
        self.mixed = tk.mix(self.numbers.astype(np.uint64))
        self.share = _share(self.mixed)
        n = self.numbers.size
        self.word = word = tk.unsqueeze(r["grams"][0], r["size"], np.int32).astype(np.int64) + 1
        self.first = first = (np.cumsum(count) - count)[count > 0]
        self.one = one = np.concatenate([[0], word[:-1]])
        one[first] = 0
        two = np.concatenate([[0], one[:-1]])
        two[first] = 0
        if 1 in levels:
            self._set(1, [np.arange(n)], shards, np.arange(n), None)
        if 2 in levels:
            # the histories of trigrams are bigrams, but for that of two starts, the first
            columns = self._part([np.concatenate([[0], c]) for c in (one, word)], part)
            some, at = _group(_code(columns, n))
            self._set(2, [c[some] for c in columns], shards, at, part)
        if 3 in levels:
            columns = self._part([two, one, word], part)
            some, at = _group(_code(columns, n))
            self._set(3, [c[some] for c in columns], shards, at, part)

    def _part(self, columns: list[np.ndarray], part: int | None) -> list[np.ndarray]:
        self.rows = slice(None)
        if part is None:
            return columns
        self.rows = np.flatnonzero(_pass_of([self.share[c] for c in columns]) == part)
        return [c[self.rows] for c in columns]

    def _set(self, level: int, columns: list[np.ndarray], shards: int, at: np.ndarray, part: int | None) -> None:
        own = _pass_of([self.share[c] for c in columns]) if part is None else part
        order, self.cuts[level] = _cuts(_shard_of([self.mixed[c] for c in columns], own, shards), shards)
        columns = [self.numbers[c] for c in columns]
        back = np.empty(order.size, np.int64)
        back[order] = np.arange(order.size)
        self.columns[level], self.places[level] = [c[order] for c in columns], back[at]


def _ask(level: int, shards: int, v: int, part: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                g = Grams(r, shards, (level,), part)
                if not g.size:
                    continue
                columns, cut = g.columns[level], g.cuts[level]
                n = np.zeros(columns[0].size, np.int64)
                if level == 3:
                    own = np.repeat(np.asarray(g.docs.column("good")), g.count)[g.rows]
                    n = np.bincount(g.places[3][own], minlength=n.size)
                values, kinds = _kinds(n[None])
                rows = [(ASK, r["run"], s, level, b - a, _packed([c[a:b] for c in columns], v), _pack_stats(values, kinds[a:b]), None) for s, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
                if rows:
                    yield _rows(rows)

    return run


def _tell(level: int, columns: list[np.ndarray], n: np.ndarray, shards: int, v: int) -> list[tuple]:
    """What the n-grams of a shard with n > 0 tell those one shorter."""
    both = [np.concatenate([e, b]) for e, b in zip(columns[1:], columns[:-1])]
    zero = np.zeros(n.size, np.int64)
    stats = [np.concatenate([x, y]) for x, y in ((zero + 1, zero), (zero, n), (zero, n == 1), (zero, n == 2), (zero, n >= 3))]
    first, at = _group(_code(both, v))
    both = [c[first] for c in both]
    mixed = [tk.mix(c.astype(np.uint64)) for c in both]
    order, cut = _cuts(_shard_of(mixed, _pass_of([_share(c) for c in mixed]), shards), shards)
    stats = np.stack([np.bincount(at, s, first.size)[order].astype(np.int64) for s in stats])
    both, (values, kinds) = [c[order] for c in both], _kinds(stats)
    return [(FACT + s % PASSES, "", s, level - 1, b - a, _packed([c[a:b] for c in both], v), _pack_stats(values, kinds[a:b]), None) for s, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]


def _answer(level: int, shards: int, v: int):
    """One shard of a level: its n-grams' numbers go to the runs that ask, and on to the level below."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        columns = [np.concatenate(c) for c in zip(*(_unpacked(r, v) for r in rows))]
        first, at = _group(_code(columns, v))
        columns = [c[first] for c in columns]
        told = np.zeros((1 if level == 3 else STATS, first.size), np.int64)
        cut = np.cumsum([0] + [r["size"] for r in rows])
        for r, a, b in zip(rows, cut[:-1], cut[1:]):
            if r["stats"]:
                for x, y in zip(told, _stats(r)):
                    x[at[a:b]] += y  # n-grams of a row are distinct
        values, kinds = _kinds(told)
        out = [(ANSWER, r["run"], r["shard"], level, r["size"], [], _pack_stats(values, kinds[at[a:b]]), None) for r, a, b in zip(rows, cut[:-1], cut[1:]) if r["kind"] == ASK]
        n = told[0]
        seen = n > 0
        if level > 1 and seen.any():
            out += _tell(level, [c[seen] for c in columns], n[seen], shards, v)
        marks = np.array([(n == k).sum() for k in range(1, 5)] + [seen.sum(), n.sum()], np.int64)
        out.append((STAT, "", 0, level, 0, [], [marks.tobytes()], None))
        return _rows(out, pa.Table)

    return run


def _by_shard(asks: DataFrame, shards: int, answer, name: str) -> DataFrame:
    return settled(asks.repartition(shards, "shard").groupBy("shard").applyInArrow(tk.lean_group(answer), PACKED), name, by="kind", compression="none")


def _only(kinds: Iterable[int], tables: list[DataFrame]) -> DataFrame:
    out = tables[0].filter(F.col("kind").isin(*kinds))
    for t in tables[1:]:
        out = out.unionByName(t.filter(F.col("kind").isin(*kinds)))
    return out


def _pairs(doc: np.ndarray, place: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, n-gram): n-gram, a row of each pair, and the pair of each row."""
    first, at = _group(doc * size + place)
    return place[first], first, at


def _history(ctx: np.ndarray, d: np.ndarray, place: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
    """The count of what follows each history, and the share of it that discounting frees."""
    return ctx[0][place], ((d[1] * ctx[1] + d[2] * ctx[2] + d[3] * ctx[3]) / np.maximum(ctx[0], 1))[place]


def probabilities(g: Grams, of: dict[int, np.ndarray], doc: np.ndarray, own: np.ndarray, d: dict[int, np.ndarray], types: int, mass: int, left: float) -> np.ndarray:
    """The interpolated modified Kneser-Ney probability of each word of a run. Words of training texts (own)
    are judged by the counts without their own document; discounts and totals over all words stay."""
    tri, bi, uni = g.places[3], g.places[2][1:], g.places[1]
    hist = np.concatenate([bi[:1], bi[:-1]])
    hist[g.first] = g.places[2][0]
    word, before = uni[g.word], uni[g.one]
    n3, n2, n1 = (of[k][0][p] for k, p in ((3, tri), (2, bi), (1, word)))
    after = [_history(of[k - 1][1:], d[k], p) for k, p in ((3, hist), (2, before))]
    mine = np.flatnonzero(own)
    if mine.size:
        who = doc[mine]
        ctx3, ctx2 = of[2][1:, hist[mine]], of[1][1:, before[mine]]

        def take(level: int, place: np.ndarray, lost: np.ndarray, row: np.ndarray, history: np.ndarray, ctx: np.ndarray) -> np.ndarray:
            """Takes what documents add to n-grams (lost, of a pair each) from the numbers of their histories; the pairs that nothing is left of."""
            n = of[level][0][place]
            less = [lost] + [x(n).astype(np.int64) - x(n - lost) for x in (lambda v: v == 1, lambda v: v == 2, lambda v: v >= 3)]
            _, _, at = _pairs(who, history, of[level - 1].shape[1])
            for i, x in enumerate(less):
                ctx[i] -= np.bincount(at[row], x, mine.size).astype(np.int64)[at]
            return (n == lost).astype(np.int64)

        place, row, at = _pairs(who, tri[mine], of[3].shape[1])
        lost = np.bincount(at)
        n3[mine] -= lost[at]
        gone = take(3, place, lost, row, hist[mine], ctx3)
        place, next_row, at = _pairs(who, bi[mine], of[2].shape[1])
        lost = np.bincount(at[row], gone, place.size).astype(np.int64)  # trigrams that no other document has
        n2[mine] -= lost[at]
        gone, row = take(2, place, lost, next_row, before[mine], ctx2), next_row
        place, _, at = _pairs(who, word[mine], of[1].shape[1])
        n1[mine] -= np.bincount(at[row], gone, place.size).astype(np.int64)[at]
        for x, ctx, k in zip(after, (ctx3, ctx2), (3, 2)):
            x[0][mine], x[1][mine] = _history(ctx, d[k])
    p = np.maximum(n1 - d[1][np.minimum(n1, 3)], 0) / max(1, mass) + max(left, 1e-3) / (types + 1)
    for n, (total, freed), k in ((n2, after[1], 2), (n3, after[0], 3)):
        p = np.where(total > 0, np.maximum(n - d[k][np.minimum(n, 3)], 0) / np.maximum(total, 1) + freed * p, p)
    return np.maximum(p, 1e-12)


def discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more, from how many n-grams have 1, 2, 3 and 4."""
    n = [max(1, int(x)) for x in n[:4]]
    y = n[0] / (n[0] + 2 * n[1])
    d = [0.0, *(k + 1 - (k + 2) * y * n[k + 1] / n[k] for k in range(3))]
    return np.clip(np.array(d), [0, 0.05, 0.05, 0.05], [0, 0.95, 1.9, 2.8])


def _judge(shards: int, totals: dict[int, np.ndarray], columns: list[str]):
    d = {k: discounts(x) for k, x in totals.items()}
    one = totals[1]
    types, mass = int(one[4]), int(one[5])
    left = float((d[1][1] * one[0] + d[1][2] * one[1] + d[1][3] * (one[4] - one[0] - one[1])) / max(1, mass))

    def run(table: pa.Table) -> pa.Table:
        found, back = _split(table)
        out = []
        for r in found:
            g = Grams(r, shards)
            some = g.count > 0
            sums = np.zeros(some.size)
            if g.size:
                doc = np.repeat(np.arange(some.size), g.count)
                of = {k: _answers(back, k, cut) for k, cut in g.cuts.items()}
                p = probabilities(g, of, doc, np.asarray(g.docs.column("good"))[doc], d, types, mass, left)
                sums[some] = np.add.reduceat(-np.log(p), g.first)  # equal texts give equal sums
            perplexity = np.exp(sums / np.maximum(g.count, 1))
            out.append(g.docs.append_column("perplexity", pa.array(perplexity, mask=~some)).select(columns))
        return pa.concat_tables(out)

    return run


def perplexities(rows: DataFrame, schema: str, name: str, pick=lambda bad, good: bad < 0, more=lambda *_: lambda *_: {}, shard_bytes: int = SHARD_BYTES, gather: int = GATHER) -> list[DataFrame]:
    """rows (id, tx, text, good: whether it is a training text, bad, others; stored, as they are read twice) -> written tables of schema: columns
    of rows, n_words, and the perplexity under a model of all good texts; good texts are judged by the model without them.

    pick(bad, good) picks words, few, by the bad and good documents that hold them; more(words, bad, good) of the
    picked gives a function of runs whose columns are added."""
    spark, since = rows.sparkSession, mark()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(12, size // shard_bytes + 1)
    found = _by_shard(rows.mapInArrow(tk.lean(_ask_numbers(shards, gather)), PACKED), shards, _number(shards, pick), "kn-numbers")
    stats = found.filter(F.col("kind") == STAT).select("size", "grams", "stats").collect()  # a row a shard, with what is picked
    v = max((r["size"] for r in stats), default=0) + 1
    picked = (np.frombuffer(b"".join(x), t) for x, t in (([r.grams[0] for r in stats], np.uint64), ([r.stats[0] for r in stats], np.int64), ([r.stats[1] for r in stats], np.int64)))
    more = more(*picked)
    stored = rows.mapInArrow(tk.lean(_documents(shards, gather, more)), PACKED).unionByName(_only([ANSWER], [found]))
    stored = settled(stored.groupBy("run").applyInArrow(tk.lean_group(_store), PACKED), "kn-runs", compression="none")
    sweep(spark, since, stored)
    tables, totals = [], {}
    for level in (3, 2, 1):
        new = []
        for part in range(PASSES) if level > 1 else [None]:
            asks = stored.mapInArrow(tk.lean(_ask(level, shards, v, part)), PACKED)
            if level < 3:
                asks = asks.unionByName(_only(range(FACT, FACT + PASSES) if part is None else [FACT + part], tables[-PASSES:]))
            new.append(_by_shard(asks, shards, _answer(level, shards, v), f"kn-{level}"))
            for t in tables[-PASSES:]:  # the facts just used
                for k in range(PASSES) if part is None else [part]:
                    drop_part(spark, t, f"kind={FACT + k}")
        stats = _only([STAT], new).select("stats").collect()  # a row a shard
        totals[level] = sum((np.frombuffer(r.stats[0], np.int64) for r in stats), np.zeros(6, np.int64))
        tables += new
    columns = [x.split()[0] for x in schema.split(", ")]
    out = []
    for part in range(JUDGED):
        mine = stored.unionByName(_only([ANSWER], tables)).filter(F.pmod(F.crc32("run"), F.lit(JUDGED)) == part)
        out.append(settled(mine.groupBy("run").applyInArrow(tk.lean_group(_judge(shards, totals, columns)), schema), name))
    sweep(spark, since, *out)
    return out
