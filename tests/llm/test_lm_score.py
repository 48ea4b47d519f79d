import math
import random
import re
import zlib
from collections import Counter

from quillforge.llm import lm_score


def plain(rows):
    """Scores by plain dictionaries; the levels' mean counts in place of the filters."""
    toks = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})), "\n"] for _, t in rows]
    held = [zlib.crc32(("null" if d is None else str(d)).encode()) % 5 == 1 for d, _ in rows]
    uni, bi, texts = Counter(), Counter(), 0
    for t, out in zip(toks, held):
        if not out:
            texts += 1
            uni.update(t)
            bi.update(zip(["\r", *t], t))
    level = lambda c: c.bit_length()
    by = Counter(level(c) for c in bi.values())
    mass = Counter()
    for c in bi.values():
        mass[level(c)] += c
    n, v = sum(uni.values()), len(uni)
    out = []
    for t in toks:
        score = 0.0
        for h, w in zip(["\r", *t], t):
            ch, j = texts if h == "\r" else uni[h], level(bi[h, w])
            base = (uni[w] + 0.5) / (n + 0.5 * (v + 1))
            score += math.log10((min(mass[j] / by[j] if j else 0.0, ch) + lm_score.MU * base) / (ch + lm_score.MU))
        out.append(score)
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_scores_of_a_plain_model(spark):
    """With roomy filters there are no false hits, so scores are those of dictionaries, however many shards and runs."""
    rng = random.Random(4)
    words = [f"W{int(rng.paretovariate(0.9))}" for _ in range(3000)]
    rows = [(i, " ".join(["the", *(rng.choice(words) for _ in range(rng.randrange(0, 60)))])) for i in range(300)] + [(400, None), (401, ""), (401, ""), (None, "the w1"), (402, "the " * 5000)]
    want = sorted(zip([(r[0] is None, r[0] or 0, r[1] or "") for r in rows], plain(rows)))
    want = sorted((*k[:2], round(s, 6)) for k, s in want)
    for shard_bytes in (lm_score.SHARD_BYTES, 5000):
        got = sorted((r.id is None, r.id or 0, round(r.score, 6)) for r in lm_score.scores(table(spark, rows), shard_bytes=shard_bytes, bits=60).collect())
        assert len(got) == len(want)
        assert all(a[:2] == b[:2] and math.isclose(a[2], b[2], abs_tol=1e-4) for a, b in zip(got, want))


def test_runs_do_not_change_scores(spark):
    rows = [(i, " ".join(["the", *(f"w{i * k % 89}" for k in range(1, 30))])) for i in range(400)] + [(i, "same text again") for i in range(500, 540)]
    one = sorted(map(tuple, lm_score.scores(table(spark, rows)).select("id", "n_tokens", "n_known", "score").collect()))
    many = sorted(map(tuple, lm_score.scores(table(spark, rows).repartition(60), gather=200).select("id", "n_tokens", "n_known", "score").collect()))
    assert len(one) == len(rows)
    assert all(a[:3] == b[:3] and math.isclose(a[3], b[3], rel_tol=1e-9) for a, b in zip(one, many))
