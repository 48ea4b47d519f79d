import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from quillforge.llm import quality
from quillforge.llm import textkernel as tk


def plain(train, texts):
    """Interpolated modified Kneser-Ney by dictionaries: minus the log probability of each text's words."""
    pad = lambda t: ["<", "<", *t.split()]
    tri = Counter(tuple(p[i - 2 : i + 1]) for p in map(pad, train) for i in range(2, len(p)))
    seen = {t[1:] for t in tri}
    bi, uni = Counter(t[1:] for t in tri), Counter(b[1] for b in seen)

    def discounts(counts):
        n = [max(1, sum(c == k for c in counts.values())) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        return [0.0] + [min(max(k + 1 - (k + 2) * y * n[k + 1] / n[k], 0.05), m) for k, m in zip(range(3), (0.95, 1.9, 2.8))]

    d3, d2, d1 = discounts(tri), discounts(bi), discounts(uni)

    def contexts(counts, d):
        total, freed = Counter(), defaultdict(float)
        for k, c in counts.items():
            total[k[:-1]] += c
            freed[k[:-1]] += d[min(c, 3)]
        return total, freed

    t3, f3 = contexts(tri, d3)
    t2, f2 = contexts(bi, d2)
    mass = sum(uni.values())
    left = sum(d1[min(c, 3)] for c in uni.values()) / mass
    out = []
    for text in texts:
        p, total = pad(text), 0.0
        for i in range(2, len(p)):
            a, b, w = p[i - 2 : i + 1]
            q = max(uni[w] - d1[min(uni[w], 3)], 0) / mass + max(left, 1e-3) / (len(uni) + 1)
            if t2[(b,)]:
                q = max(bi[b, w] - d2[min(bi[b, w], 3)], 0) / t2[(b,)] + f2[(b,)] / t2[(b,)] * q
            if t3[a, b]:
                q = max(tri[a, b, w] - d3[min(tri[a, b, w], 3)], 0) / t3[a, b] + f3[a, b] / t3[a, b] * q
            total -= math.log(max(q, 1e-12))
        out.append(total)
    return out


def test_the_model_of_plain_dictionaries(spark):
    rng = random.Random(8)
    word = lambda: f"w{int(rng.paretovariate(0.9))}"
    train = [" ".join(word() for _ in range(rng.randrange(1, 60))) for _ in range(120)]
    texts = [" ".join(word() for _ in range(rng.randrange(1, 40))) for _ in range(20)] + train[:3] + ["new words only"]
    counts = quality.counted(spark.createDataFrame([(t,) for t in train], "text string").repartition(3))
    words = next(iter([tk.Words(d, o, tk.SPACED) for _, _, d, o in tk.slices(pa.array(texts))]))
    total = np.concatenate([[0.0], np.cumsum(quality.Model(counts).nll(words))])
    got = total[words.doc[1:]] - total[words.doc[:-1]]
    assert np.allclose(got, plain(train, texts), rtol=1e-4)


def test_repeated_rows_and_clashing_columns(spark):
    rng = random.Random(1)
    words = [f"w{int(rng.paretovariate(0.8))}" for _ in range(3000)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(60)), "en" if i % 2 else None, 1.0, True) for i in range(200)]
    rows += [rows[0]] * 3 + [(None, None, None, None, None), (999, "", "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, perplexity double, kept boolean")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)] + [(5, None, None)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows) and len({(r.perplexity, r.kept) for r in got if r.id == 0}) == 1
    assert not any(r.kept for r in got if not r.n_words)
