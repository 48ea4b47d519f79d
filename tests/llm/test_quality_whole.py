import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quillforge.llm import ngrams, quality
from tests.llm.test_quality_model import plain

SCHEMA = "id long, n_words long, perplexity double, good boolean"


def make(seed, n, long):
    rng = random.Random(seed)
    return [" ".join(f"w{int(rng.paretovariate(0.9))}" for _ in range(rng.randrange(0, long))) for _ in range(n)]


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "id long, text string, good boolean").repartition(3).localCheckpoint().select("*", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tx"), F.lit(False).alias("bad"))


def without(texts, own):
    """The perplexity of texts[own] by dictionaries of the others, with the discounts and totals of all."""
    pad = lambda t: ["<", "<", *t.split()]

    def count(some):
        tri = Counter(tuple(p[i - 2 : i + 1]) for p in map(pad, some) for i in range(2, len(p)))
        bi = Counter(t[1:] for t in tri)
        return tri, bi, Counter(b[1] for b in bi)

    everything = count(texts)
    d3, d2, d1 = (ngrams.discounts([sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]) for c in everything)
    uni, tri, bi, one = everything[2], *count(texts[:own] + texts[own + 1 :])
    mass, left = sum(uni.values()), sum(d1[min(c, 3)] for c in uni.values())
    out = 0.0
    p = pad(texts[own])
    for i in range(2, len(p)):
        gram = tuple(p[i - 2 : i + 1])
        q = max(one[gram[2]] - d1[min(one[gram[2]], 3)], 0) / mass + max(left / mass, 1e-3) / (len(uni) + 1)
        for counts, d, g in ((bi, d2, gram[1:]), (tri, d3, gram)):
            after = [c for k, c in counts.items() if k[:-1] == g[:-1] and c]
            if after:
                q = (max(counts[g] - d[min(counts[g], 3)], 0) + sum(d[min(c, 3)] for c in after) * q) / sum(after)
        out -= math.log(max(q, 1e-12))
    return math.exp(out / max(1, len(p) - 2))


def test_all_trusted_text_by_shards(spark):
    """The shards give the plain model of every trusted text, whatever the runs."""
    train, texts = make(3, 150, 50), make(4, 30, 40) + ["new words only", ""]
    rows = [(i, t, True) for i, t in enumerate(train)] + [(1000 + i, t, False) for i, t in enumerate(texts)] + [(None, None, False)]
    want = plain(train, texts)
    for gather in (200, ngrams.GATHER):
        got = [r for part in ngrams.perplexities(rows_of(spark, rows), SCHEMA, "t", gather=gather) for r in part.collect()]
        assert len(got) == len(rows)
        got = {r.id: r for r in got}
        for i, t in enumerate(texts):
            n = len(t.split())
            assert got[1000 + i].n_words == n
            assert got[1000 + i].perplexity is None if not n else math.isclose(got[1000 + i].perplexity, math.exp(want[i] / n), rel_tol=1e-9)


def test_trusted_texts_without_themselves(spark):
    texts = make(5, 40, 60)
    texts += [texts[1], " ".join([texts[2]] * 3), "a a a a a a"]
    rows = rows_of(spark, [(i, t, True) for i, t in enumerate(texts)])
    got = {r.id: r.perplexity for part in ngrams.perplexities(rows, SCHEMA, "t", gather=500) for r in part.collect()}
    for i, t in enumerate(texts):
        assert got[i] is None if not t.split() else math.isclose(got[i], without(texts, i), rel_tol=1e-9), i


def test_no_trusted_text_is_left_out(spark):
    """What the last of more trusted and rejected documents than a sample of 3000 says counts."""
    n = 6500
    rows = [(i, f"one{i} two{i} three{i} four{i}", "en") for i in range(n)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(n)], "doc_id long, quality int, toxic int")
    copies = [(n + i, r[1], "en") for i, r in enumerate(rows)]
    got = defaultdict(list)
    for r in quality.classify(spark.createDataFrame(rows + copies, "doc_id long, text string, lang string"), labels).collect():
        got[r.id >= n].append(r.perplexity)
    assert max(got[True]) < min(got[False])  # every copy is known to the model, no document is to its own
