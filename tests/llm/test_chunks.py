import hashlib
import random

from quillforge.llm import chunk_dedup as cd

SCHEMA = "doc_id long, text string, places string, shard int"


def chunked(raw):
    """Chunks by a plain rolling hash, byte by byte."""
    out, last, h = [], 0, 0
    for i, byte in enumerate(raw):
        h = ((h << 1) + int(cd._GEAR[byte])) & 0xFFFFFFFF
        n = i + 1 - last
        if (n >= cd.LEAST and h & int(cd.MASK) == 0) or n == cd.MOST or i + 1 == len(raw):
            out.append((last, i + 1))
            last = i + 1
    return out


def brute(rows):
    """rows (id, text), each different; what is left of each."""
    texts = [(d is not None, d or 0, (t or "").encode()) for d, t in rows]
    tx = {i: chunked(r[2]) for i, r in enumerate(texts)}
    first = {}
    for i, (named, d, raw) in enumerate(texts):
        for k, (a, b) in enumerate(tx[i]):
            key = hashlib.sha256(raw[a:b]).digest()
            if key not in first or (named, d, k) < first[key][:3]:
                first[key] = (named, d, k, i)
    out = {}
    for i, (_, _, raw) in enumerate(texts):
        drop = [first[hashlib.sha256(raw[a:b]).digest()][2:] != (k, i) for k, (a, b) in enumerate(tx[i])]
        left, k = b"", 0
        while k < len(drop):
            e = k
            while e < len(drop) and drop[e]:
                e += 1
            a, b = tx[i][k][0], tx[i][max(k, e - 1)][1]
            if e == k:
                left += raw[a:b]
                k += 1
                continue
            if not (b - a >= cd.RUN or (a == 0 and b == len(raw))):
                left += raw[a:b]
            k = e
        out[rows[i][0]] = hashlib.sha256(left).hexdigest(), len(raw) - len(left)
    return out


def test_against_a_plain_chunker(spark):
    rng = random.Random(3)
    words = [f"word{i}" for i in range(2000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, phrase = text(70), text(9)
    long = text(90000)  # beyond a slice
    rows = [(i, f"{text(40)} {passage} {text(rng.randrange(1, 60))}") for i in range(2, 40)]
    rows += [(i, f"{text(30)} {phrase} {text(30)}") for i in range(50, 70)]
    rows += [(100, long), (101, "x" + long + "y"), (102, None), (103, ""), (104, "short"), (105, "é" * 300), (106, "z" * 5000), (None, f"{text(5)} {passage}")]
    df = spark.createDataFrame([(d, t, "p", 1) for d, t in rows], SCHEMA).repartition(5)
    got = {r.id: (r.sha, r.n_removed) for r in cd.dedup(df).collect()}
    assert got == brute(rows)
    assert sum(n > 0 for _, n in got.values()) >= 38 and got[101][1] > 0.99 * len(long)


def test_repeated_rows_and_short_copies(spark):
    df = spark.createDataFrame([(1, "only a few words", "", 0)] * 3 + [(2, "only a few words", "", 0), (3, None, "", 0), (3, None, "", 0)], SCHEMA).repartition(3)
    got = sorted((r.id, r.n_removed, r.n_spans, r.kept) for r in cd.dedup(df).collect() if r.id < 3)
    assert [g[:3] for g in got] == [(1, 0, 0), (1, 16, 1), (1, 16, 1), (2, 16, 1)] and all(g[3] == b"" for g in got[1:])
