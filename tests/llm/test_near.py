import random
import re

from quillforge.llm import near_dedup

SCHEMA = "doc_id long, text string, kept string"


def brute(rows, least=85):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= least * (len(sets[i]) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    return {d: (len(sets[i]), min(groups[root(i)]) if sets[i] else d) for i, (d, _) in enumerate(rows)}


def test_groups_of_near_copies(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([6, 60, 200]))]
        for _ in range(1 + 8 * (g % 3)):
            w = list(base)
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((len(rows) * 3 % 1009, " ".join(w)))
    passage = " ".join(rng.choice(words) for _ in range(40))
    rows += [(2000 + i, passage + " " + " ".join(rng.choice(words) for _ in range(30))) for i in range(60)]
    rows += [(3000, None), (3001, ""), (3002, " \t"), (3003, "a b"), (3004, "A  b"), (3005, "x" * 100000), (3006, "X" * 100000)]
    df = spark.createDataFrame([(d, t, "z") for d, t in rows], SCHEMA).repartition(5)
    got = {r.id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_empty_repeated_and_null_ids(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f", None), (1, "a b c d e f", None), (None, "a b c d e f", None)], SCHEMA)
    got = sorted((str(r.id), str(r.component_id), r.kept) for r in near_dedup.near_duplicates(df).collect())
    assert got == [("1", "1", True), ("1", "1", True), ("None", "None", True)]


def test_variants_of_one_text_in_several_blocks(spark, monkeypatch):
    """Most pairs share half of their shingles, few enough to link; blocks are small."""
    monkeypatch.setattr(near_dedup, "BLOCK", 40)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for _ in range(200):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 5, 7, 9])):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        rows.append((len(rows) * 7 % 1009, " ".join(w)))
    df = spark.createDataFrame([(d, t, None) for d, t in rows], SCHEMA).repartition(4)
    got = {r.id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect()}
    want = brute(rows)
    assert got == want
    assert len({c for _, c in want.values()}) > 5


def test_blocks_report_only_links_that_join():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    base = np.arange(100, dtype=np.uint64)
    sets = [np.sort(np.concatenate([base[rng.permutation(100)[: 100 - k]], (1000 + 100 * i + np.arange(k)).astype(np.uint64)])) for i, k in enumerate(rng.integers(0, 12, 60))]
    side = [0] * 30 + [1] * 30
    table = pa.table({"grp": [1] * 60, "i": [0] * 60, "j": [1] * 60, "side": side, "num": list(range(60)), "label": list(range(60)), "n": [s.size for s in sets], "shingles": pa.array([s.tobytes() for s in sets], pa.binary())})
    links = near_dedup._verified(85)(table).to_pylist()
    assert 0 < len(links) < 60
    every = [(a, b) for a in range(30) for b in range(30, 60) if 100 * np.intersect1d(sets[a], sets[b]).size >= 85 * np.union1d(sets[a], sets[b]).size]
    assert {(r["u"], r["v"]) for r in links} <= set(every)

    def components(edges):
        root = list(range(60))
        for a, b in edges:
            x, y = root[a], root[b]
            root = [y if r == x else r for r in root]
        return {frozenset(i for i in range(60) if root[i] == r) for r in root}

    assert components((r["u"], r["v"]) for r in links) == components(every)
