"""MinHash near-dedup by an inverted join over signature coordinates.

A document's set is its distinct 5-word shingles. Documents with equal sets form a class; a
signature of K least values stands for each class. Pairs are sought that agree in at least
matches(least) of K coordinates: at the similarity asked for a pair fails that with a probability
under MISSED. By pigeonhole such a pair agrees within the first K - matches + 1 coordinates of both, in
any one order of coordinate values, so only that prefix is posted; the order puts values
that a count sketch finds frequent last, so long posting lists are skipped unless a document
has little else.

Posting lists are not expanded into pairs. In each of ROUNDS rounds every class is paired with
one member of its lists, the one it meets in most of them, links are confirmed on the full
sets, and components are merged; leaders are by turns the members that meet most others (a group's
common origin, if it is there) and members taken by hash. What remains are lists that hold several components; their
members are compared across components by signature, in blocks of bounded size; those that match,
with all they lead to, make groups whose members are compared on their full sets. No link between different
components is left out by a cap.

Defined cases. Null, empty and wordless texts have empty sets and link with nothing; texts of
fewer than five words have their whole sequence as one shingle. A null id is not linked and is
kept. Repeated rows have equal sets, so they share a component, named by the smallest id.
Empty input gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .components import components
from .keep import pick_texts
from .scratch import mark, split_join, sweep, written

K = 64
MISSED = 1e-8
WORDS = 5
SLOTS = 1 << 18
CHUNK = 1 << 12
ROUNDS = 2
#: members of a list or group that one task compares with as many others, and shingles in a block, about
BLOCK, BLOCK_SHINGLES = 1000, 1 << 20

_A = tk.mix(np.arange(1, K + 1, dtype=np.uint64)) | tk.U(1)
_B = tk.mix(np.arange(1001, 1001 + K, dtype=np.uint64))


def matches(least: int) -> int:
    """In how many of K coordinates a pair at a similarity of least / 100 agrees at least, but for a probability under MISSED."""
    p, missed = least / 100, 0.0
    for m in range(K):
        missed += comb(K, m) * p**m * (1 - p) ** (K - m)
        if missed >= MISSED:
            return max(1, m)
    return K


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a slice."""
    words = tk.Words(data, offsets, tk.SPACED)
    h = words.hashes()
    g = tk.runs(h, k)
    out = []
    for a, n in zip(words.doc[:-1].tolist(), words.count.tolist()):
        if n >= k:
            out.append(np.unique(g[a : a + n - k + 1]))
        else:
            out.append(tk.runs(h[a : a + n], n) if n else np.zeros(0, np.uint64))
    return out


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.int64()), ("tx", pa.int64()), ("n", pa.int64()), ("cls", pa.binary()), ("sig", pa.binary()), ("short", pa.binary())])
    for batch in batches:
        for a, b, data, offsets in tk.slices(batch.column("text")):
            sets = shingle_sets(data, offsets)
            count = np.array([s.size for s in sets])
            full = np.flatnonzero(count)
            sig = np.zeros((b - a, K), np.uint32)
            digest = np.zeros((b - a, 2), np.uint64)
            if full.size:
                g = np.concatenate([sets[i] for i in full])
                at = np.concatenate([[0], np.cumsum(count[full])[:-1]])
                with np.errstate(over="ignore"):
                    for k in range(K):
                        sig[full, k] = np.minimum.reduceat(((g * _A[k] + _B[k]) >> tk.U(32)).astype(np.uint32), at)
                    digest[full, 0] = np.add.reduceat(tk.mix(g ^ tk.U(0x5851F42D4C957F2D)), at)
                    digest[full, 1] = np.add.reduceat(tk.mix(g + tk.U(0x14057B7EF767814F)), at)
            none = count == 0
            cls, s, low = digest.tobytes(), sig.tobytes(), sig.astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").slice(a, b - a),
                    batch.column("tx").slice(a, b - a),
                    pa.array(count.astype(np.int64)),
                    pa.array([None if none[i] else cls[16 * i : 16 * i + 16] for i in range(b - a)], pa.binary()),
                    pa.array([None if none[i] else s[4 * K * i : 4 * K * (i + 1)] for i in range(b - a)], pa.binary()),
                    pa.array([None if none[i] else low[K * i : K * (i + 1)] for i in range(b - a)], pa.binary()),
                ],
                schema=schema,
            )


def _matrix(column: pa.Array) -> np.ndarray:
    """Signatures as a matrix of uint32."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), K)


def _short(column: pa.Array) -> np.ndarray:
    """Short signatures as a matrix of bytes. Coordinates that agree agree in their low bytes, so no match is lost."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), K)


def _tokens(sig: np.ndarray) -> np.ndarray:
    """A 64-bit token for each coordinate and value."""
    with np.errstate(over="ignore"):
        return tk.mix((sig.astype(np.uint64) << tk.U(8)) + np.arange(K, dtype=np.uint64))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SLOTS, np.int64)
    for batch in batches:
        if batch.num_rows:
            total += np.bincount((_tokens(_matrix(batch.column("sig"))) & tk.U(SLOTS - 1)).astype(np.int64).ravel(), minlength=SLOTS)
    parts = [total[i : i + CHUNK].tobytes() for i in range(0, SLOTS, CHUNK)]
    yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["chunk", "counts"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for c, x in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
            x = np.frombuffer(x, np.int64)
            total[c] = total[c] + x if c in total else x
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["chunk", "counts"])


def sketch(reps: DataFrame) -> np.ndarray:
    """How many classes have a token in each of SLOTS slots: 2 MB, whatever the input."""
    parts = reps.select("sig").mapInArrow(tk.lean(_count), "chunk int, counts binary")
    # many tasks' counts are added in two steps, so no task adds more than their square root
    for n in (SLOTS // CHUNK * 4, SLOTS // CHUNK):
        key = [F.col("chunk")] if n == SLOTS // CHUNK else [F.col("chunk"), F.pmod(F.spark_partition_id(), F.lit(4))]
        parts = parts.repartition(min(n, 32), *key).mapInArrow(_add, "chunk int, counts binary")
    out = np.zeros(SLOTS, np.int64)
    for r in parts.collect():  # SLOTS numbers
        out[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] += np.frombuffer(r.counts, np.int64)
    return out


def _post(shared, prefix: int):
    """A row for each posted token of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 4000):
                part = batch.slice(i, 4000)
                token = _tokens(_matrix(part.column("sig")))
                freq = counts[(token & tk.U(SLOTS - 1)).astype(np.int64)].astype(np.uint64)
                with np.errstate(over="ignore"):
                    # frequency by powers of two, then by value: one order for all documents
                    rank = (np.log2(np.maximum(freq, 1).astype(np.float64)).astype(np.uint64) << tk.U(58)) | (tk.mix(token) >> tk.U(6))
                pick = np.argpartition(rank, prefix - 1, axis=1)[:, :prefix]
                chosen = np.take_along_axis(token, pick, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(chosen.ravel()), part.column("num").take(pa.array(np.repeat(np.arange(part.num_rows), prefix)))], ["token", "num"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in tk.slices(batch.column("text")):
            yield pa.RecordBatch.from_arrays([batch.column("num").slice(a, b - a), batch.column("to").slice(a, b - a), pa.array([s.tobytes() for s in shingle_sets(data, offsets)], pa.binary())], ["num", "to", "shingles"])


def sent(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The sets of wanted (id, tx, num, to: array of structs), a row for each struct: its fields, num and shingles. Texts are shuffled once."""
    kind = wanted.schema["to"].dataType.simpleString()
    made = pick_texts(docs, wanted, id_col, text_col, ("num", "to")).select("num", "to", "text").mapInArrow(tk.lean(_sets), f"num long, to {kind}, shingles binary")
    return made.select("num", F.explode("to").alias("to"), "shingles").select("num", "to.*", "shingles")


def _confirm(least: int):
    """The links of a leader u (side 0) to the members of one part of its pairs."""

    def run(part: pa.Table) -> pa.Table:
        side, num = part.column("side").to_numpy(), part.column("num").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in part.column("shingles")]
        u, v = [], []
        for lead in np.flatnonzero(side == 0)[:1].tolist():
            a = sets[lead]
            for i in np.flatnonzero(side == 1).tolist():
                b = sets[i]
                if 100 * min(a.size, b.size) < least * max(a.size, b.size):
                    continue
                both = np.sort(np.concatenate([a, b]))
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= least * (a.size + b.size - common):
                    u.append(int(num[lead]))
                    v.append(int(num[i]))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _alike(least: int):
    """Pairs whose signatures match in enough coordinates."""
    need = matches(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                same = (_short(batch.column("x")) == _short(batch.column("y"))).sum(axis=1)
                yield batch.select(["u", "v"]).filter(pa.array(same >= need))

    return run


def beside(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """Pairs (u, v) with the values x of u and y of v. A class in many pairs is dealt out in parts of 500."""
    degree = pairs.groupBy("u").agg(F.count(F.lit(1)).alias("pairs")).withColumn("parts", (F.floor(F.col("pairs") / 500) + 1).cast("long"))
    many = degree.filter("parts > 1")
    p = split_join(pairs, many, "u", "pairs", pairs.count()).withColumn("part", F.pmod(F.xxhash64("v"), F.coalesce("parts", F.lit(1))) + 1).drop("parts", "pairs")
    left = table.join(degree.withColumnRenamed("u", "num"), "num").select(F.col("num").alias("u"), F.col(value).alias("x"), F.explode(F.sequence(F.lit(1).cast("long"), "parts")).alias("part"))
    return p.join(table.select(F.col("num").alias("v"), F.col(value).alias("y")), "v").join(left, ["u", "part"]).select("u", "v", "x", "y")


def confirmed(docs: DataFrame, pairs: DataFrame, reps: DataFrame, least: int, id_col: str, text_col: str) -> DataFrame:
    """Pairs of classes (u, v), each v once, whose full sets are similar enough; sets are made from the texts of the classes in question.

    The set of v is sent to a part of u's pairs, that of u to every part; a part has about BLOCK_SHINGLES shingles.
    """
    since, total = mark(), pairs.count()
    own = reps.select("num", "id", "tx", "n")
    members = pairs.join(own.withColumnRenamed("num", "v"), "v")
    parts = members.groupBy("u").agg(F.count(F.lit(1)).alias("pairs"), (F.floor(F.sum("n") / BLOCK_SHINGLES) + F.floor(F.count(F.lit(1)) / BLOCK) + 1).cast("long").alias("parts"))
    many = parts.filter("parts > 1")
    dealt = split_join(members, many, "u", "pairs", total).select(F.col("v").alias("num"), F.col("u").alias("grp"), F.pmod(F.xxhash64("v"), F.coalesce("parts", F.lit(1))).alias("part"), F.lit(1).alias("side"))
    leads = parts.select(F.col("u").alias("num"), F.col("u").alias("grp"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"))
    to = dealt.unionByName(leads).groupBy("num").agg(F.collect_list(F.struct("grp", "part", "side")).alias("to"))  # once as v, and once for each part as u
    wanted = written(own.drop("n").join(to, "num"), "near-wanted")
    links = written(sent(docs, wanted, id_col, text_col).groupBy("grp", "part").applyInArrow(tk.lean_group(_confirm(least)), "u long, v long"), "near-links")
    sweep(docs.sparkSession, since, links)
    return links


class Sets:
    """Disjoint sets of small numbers; every number's root is at hand as an array."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, numbers: np.ndarray) -> None:
        roots = np.unique(self.root[numbers])
        if roots.size > 1:
            self.root[np.isin(self.root, roots)] = roots[0]


def _sides(part: pa.Table):
    """Both blocks of a pair (the same one twice if there is one), the numbers of their labels, and the labels by number."""
    side = part.column("side").to_numpy()
    left, right = part.filter(pa.array(side == 0)), part.filter(pa.array(side == 1))
    same = not right.num_rows
    right = left if same else right
    names, number = np.unique(np.concatenate([left.column("label").to_numpy(), right.column("label").to_numpy()]), return_inverse=True)
    return left, right, same, number[: left.num_rows], number[left.num_rows :], names


def _meeting(least: int):
    """Members of one pair of blocks of one list that match a member of another component, with a root that all they lead to share."""
    need = matches(least)

    def run(part: pa.Table) -> pa.Table:
        left, right, same, la, lb, names = _sides(part)
        a, b = _short(left.column("sig")), _short(right.column("sig"))
        na, nb = left.column("n").to_numpy(), right.column("n").to_numpy()
        joined = Sets(names.size)
        met_a = np.zeros(left.num_rows, bool)
        met_b = met_a if same else np.zeros(right.num_rows, bool)
        for i in range(left.num_rows if right.num_rows else 0):
            at = np.flatnonzero((lb != la[i]) & (100 * np.minimum(nb, na[i]) >= least * np.maximum(nb, na[i])))
            if same:
                at = at[at > i]
            at = at[(b[at] == a[i]).sum(axis=1) >= need]
            if at.size:
                met_a[i] = True
                met_b[at] = True
                joined.join(np.append(lb[at], la[i]))
        out = [(left, la, met_a)] if same else [(left, la, met_a), (right, lb, met_b)]
        num = np.concatenate([x.column("num").to_numpy()[m] for x, _, m in out])
        of = np.concatenate([n[m] for _, n, m in out])
        return pa.table({"num": pa.array(num, pa.int64()), "label": pa.array(names[of], pa.int64()), "root": pa.array(names[joined.root[of]], pa.int64())})

    return run


def _verified(least: int):
    """Links between components among two blocks of members, by their full sets; links that others imply are left out."""

    def run(part: pa.Table) -> pa.Table:
        left, right, same, la, lb, names = _sides(part)
        na, nb = left.column("n").to_numpy(), right.column("n").to_numpy()
        u: list[int] = []
        v: list[int] = []
        if left.num_rows and right.num_rows:
            tables = [left] if same else [left, right]
            code = np.unique(np.concatenate([np.frombuffer(b"".join(x.column("shingles").to_pylist()), np.uint64) for x in tables]), return_inverse=True)[1]
            ca = code[: na.sum()]
            cb = ca if same else code[na.sum() :]
            sa, sb = (np.concatenate([[0], np.cumsum(x)]) for x in (na, nb))
            mark = np.zeros(int(code.max()) + 1, np.int32)
            joined = Sets(names.size)
            for i in range(left.num_rows):
                mine = joined.root[la[i]]
                at = np.flatnonzero((joined.root[lb] != mine) & (100 * np.minimum(nb, na[i]) >= least * np.maximum(nb, na[i])))
                if same:
                    at = at[at > i]
                if not at.size:
                    continue
                own = ca[sa[i] : sa[i + 1]]
                mark[own] = 1
                if at.size * 8 < nb.size:
                    common = np.array([mark[cb[sb[k] : sb[k + 1]]].sum() for k in at])
                else:
                    common = np.add.reduceat(mark[cb], sb[:-1])[at]
                mark[own] = 0
                at = at[100 * common >= least * (na[i] + nb[at] - common)]
                if at.size:
                    at = at[np.unique(joined.root[lb[at]], return_index=True)[1]]  # one for each component
                    u += [i] * at.size
                    v += at.tolist()
                    joined.join(np.append(lb[at], la[i]))
        return pa.table({"u": left.column("num").take(pa.array(u, pa.int64())), "v": right.column("num").take(pa.array(v, pa.int64()))})

    return run


def _blocks(rows: DataFrame, key: str, blocks, *more: str) -> DataFrame:
    """Every pair of blocks of a key's members, as (key, i, j, side)."""
    rows = rows.withColumn("own", F.pmod(F.xxhash64("num"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return rows.select(key, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "num", "label", F.col("m").alias("n"), *more)


def _across(docs: DataFrame, shared: DataFrame, labels: DataFrame, reps: DataFrame, posts: int, least: int, id_col: str, text_col: str) -> DataFrame | None:
    """Links between components that share a posting list, enough of them to join all that belong together.

    Members that match one of another component by signature are gathered, with all that
    they lead to, into groups; a group's members are compared on their full sets, in
    pairs of blocks. What is written grows with the members, not with their pairs.
    """
    since = mark()
    rows = shared.select("token", "num").join(labels, "num", "left").withColumn("label", F.coalesce("label", "num"))
    mixed = rows.groupBy("token").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count(F.lit(1)).alias("c")).filter("a <> b").select("token", "c")
    rows = split_join(rows, mixed, "token", "c", posts).filter("c is not null")
    rows = rows.join(reps.select("num", F.col("n").alias("m"), F.col("short").alias("sig")), "num")
    rows = _blocks(rows, "token", (F.floor((F.col("c") - 1) / BLOCK) + 1).cast("long"), "sig")
    met = written(rows.groupBy("token", "i", "j").applyInArrow(tk.lean_group(_meeting(least)), "num long, label long, root long"), "near-met")
    if met.isEmpty():
        return None
    groups = components(met.select(F.col("label").alias("u"), F.col("root").alias("v")))
    members = written(met.select("num", "label").distinct(), "near-members")
    total = members.count()
    groups = groups.select(F.col("node").alias("of"), F.col("label").alias("grp")).join(members.groupBy(F.col("label").alias("of")).agg(F.count(F.lit(1)).alias("c")), "of")
    members = split_join(members.select("num", "label", F.col("label").alias("of")), groups, "of", "c", total).select("num", "label", "grp")
    members = written(members.join(reps.select("num", "id", "tx", F.col("n").alias("m")), "num"), "near-members")
    size = members.groupBy("grp").agg(F.count(F.lit(1)).alias("c"), F.sum("m").alias("all"))
    rows = split_join(members.select("num", "label", "grp", "m"), size, "grp", "c", total)
    rows = _blocks(rows, "grp", F.greatest(F.floor((F.col("c") - 1) / BLOCK), F.floor(F.col("all") / BLOCK_SHINGLES)).cast("long") + 1)
    to = rows.groupBy("num").agg(F.collect_list(F.struct("grp", "i", "j", "side", "label", "n")).alias("to"))  # one for each block of its group
    rows = sent(docs, written(members.select("num", "id", "tx").join(to, "num"), "near-wanted"), id_col, text_col)
    links = written(rows.groupBy("grp", "i", "j").applyInArrow(tk.lean_group(_verified(least)), "u long, v long"), "near-links")
    sweep(docs.sparkSession, since, links)
    return links


def _stars(shared: DataFrame, labels: DataFrame, reps: DataFrame, k: int, total: int, least: int) -> DataFrame:
    """For each class the leader, of another component, that it meets in most lists, if their signatures match."""
    own = shared.select("token", "num", "met").join(labels, "num", "left").withColumn("label", F.coalesce("label", "num"))
    lead = own.groupBy("token").agg(F.min(F.struct((-F.col("met") if k % 2 == 0 else F.xxhash64("num", "token", F.lit(k))).alias("h"), "num", "label")).alias("l"), F.count(F.lit(1)).alias("size"), F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b")
    lead = lead.select("token", F.col("l.num").alias("lead"), F.col("l.label").alias("lead_label"), "size")
    met = split_join(own, lead, "token", "size", total).filter("lead is not null and lead_label <> label")
    met = met.select("num", "lead").repartition("num").groupBy("num", "lead").agg(F.count(F.lit(1)).alias("met"))  # both groupings by one shuffle
    pairs = met.groupBy("num").agg(F.max(F.struct("met", "lead")).alias("best")).select(F.col("best.lead").alias("u"), F.col("num").alias("v"))
    pairs = written(pairs, "near-stars")
    return beside(pairs, reps.select("num", "short"), "short").mapInArrow(tk.lean(_alike(least)), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 85) -> DataFrame:
    """A row for each row of docs: id, tx, n_shingles, component_id, kept."""
    spark, since = docs.sparkSession, mark()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tx"), F.col(text_col).cast("string").alias("text"))
    sigs = written(rows.mapInArrow(tk.lean(_signatures), "id long, tx long, n long, cls binary, sig binary, short binary"), "near-sigs")
    linked = sigs.filter("id is not null and cls is not null")
    reps = linked.groupBy("cls").agg(F.min("id").alias("id"), F.min_by("tx", "id").alias("tx"), F.min("n").alias("n"), F.first("sig").alias("sig"), F.first("short").alias("short"), F.count(F.lit(1)).alias("rows"))
    reps = written(reps.withColumn("num", F.monotonically_increasing_id()), "near-classes")
    order = spark.sparkContext.broadcast(sketch(reps))
    posted = written(reps.select("sig", "num").mapInArrow(tk.lean(_post(order, K - matches(least) + 1)), "token long, num long"), "near-posts")
    total = posted.count()
    lists = posted.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    listed = written(split_join(posted, lists, "token", "n", total).filter("n is not null").select("token", "num", "n"), "near-lists")
    met = listed.groupBy("num").agg(F.sum("n").alias("met"))
    shared = written(listed.select("token", "num").join(met, "num"), "near-lists")
    posts = shared.count()
    sweep(spark, since, sigs, reps, shared)
    links, found, known = None, [], None
    labels = spark.sql("select cast(0 as bigint) as num, cast(0 as bigint) as label where false")
    for k in range(ROUNDS + 1):
        if k < ROUNDS:
            pairs = written(_stars(shared, labels, reps, k, posts, least), "near-pairs")
            new = None if pairs.isEmpty() else confirmed(docs, pairs, reps, least, id_col, text_col)
        else:
            new = _across(docs, shared, labels, reps, posts, least, id_col, text_col)
        if new is not None and not new.isEmpty():
            links = new if links is None else links.unionByName(new)
            found.append(new)
            known = components(links)
            labels = known.withColumnRenamed("node", "num")
        sweep(spark, since, sigs, reps, shared, known, *found)
    # a class is labelled by its component, a row by its class
    sized = reps.select("num", "id", "cls", "rows").join(labels, "num", "left").withColumn("label", F.coalesce("label", "num"))
    least_id = sized.groupBy("label").agg(F.min("id").alias("component"), F.count(F.lit(1)).alias("classes"))
    sized = written(split_join(sized.select("cls", "rows", "label"), least_id, "label", "classes", reps.count()).filter("rows > 1 or classes > 1").select("cls", "rows", "component"), "near-components")
    sweep(spark, since, sigs, sized)
    out = split_join(sigs.select("id", "tx", "n", "cls"), sized, "cls", "rows", sigs.count())
    component = F.when(F.col("cls").isNull() | F.col("component").isNull() | F.col("id").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select("id", "tx", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
