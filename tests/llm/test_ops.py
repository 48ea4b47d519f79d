"""Operators against brute force on small tables with nulls, empty and long texts, repeated rows and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillforge.llm import chunk_dedup, decontaminate, exact_dedup, html_extract, lm_score, mixing, pseudonyms, quality, repeats
from quillforge.llm.keep import keep_rows

SCHEMA = "doc_id long, text string, lang string, source string, kept string, digest string, id string"
LONG = " ".join(f"word{i}" for i in range(900))
TEXTS = [None, "", "a b c", "A B c", "x" * 50000, LONG, LONG + " tail", "head " + LONG, "é ü É", "Ä b", "a b c", " \t\n"]


def low(s):
    return (s or "").translate({c: c + 32 for c in range(65, 91)})


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, None if i == 3 else f"s{i % 4}", "k", "d", "i") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[2]], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables(spark, empty):
    bench, labels, pages = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([], "page_id long, url string, html string")
    assert exact_dedup.decisions(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert decontaminate.contamination(empty, bench).count() == 0
    assert quality.classify(empty, labels).count() == 0
    assert repeats.remove_repeats(empty).count() == 0
    assert chunk_dedup.dedup(empty).count() == 0
    assert lm_score.scores(empty).count() == 0
    assert pseudonyms.pseudonymise(empty, "k").count() == 0
    assert html_extract.extract(pages).count() == 0


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_exact(docs, digest_bytes):
    rows = docs.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[low(r.text)].append(r.doc_id)
    got = exact_dedup.decisions(docs, digest_bytes=digest_bytes)
    for r in got.collect():
        own = groups[low(TEXTS[r.id])]
        assert (r.keep_id, r.group_size, r.sha) == (max(own), len(own), hashlib.sha256(low(TEXTS[r.id]).encode()).hexdigest())
    assert got.filter("kept").count() == len(groups)
    assert keep_rows(docs, got).count() == len(groups)


def test_mix(docs):
    got = mixing.mix(docs).collect()
    assert len(got) == len(TEXTS) + 1
    total = sum(r.size for r in got)
    assert math.isclose(sum({r.source: r.target for r in got}.values()), total)
    for r in got:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", TEXTS[r.id] or ""))
        assert r.taken <= 3 * r.size and r.target <= 3 * r.source_size


def test_mix_is_near_target(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7919 % 90)), None, f"s{i % 5}", "", "", "") for i in range(1500)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df).groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("n")).collect()
    assert all(abs(r.n - r.t) <= 0.01 * r.t for r in got)
    assert sorted(mixing.mix(df).collect()) == sorted(mixing.mix(df.repartition(7)).collect())


def test_decontaminate(spark, docs):
    bench = spark.createDataFrame([(1, LONG[40:200]), (1, "A, b; C!"), (2, None), (3, "é ü é"), (None, "b")], "item_id long, text string")
    for block in (decontaminate.BLOCK_BYTES, 60):
        got = {r.id: (r.n_words, sum(s.end - s.start for s in r.spans), sorted(r["items"])) for r in decontaminate.contamination(docs, bench, block_bytes=block).collect()}
        word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
        for i, t in enumerate(TEXTS):
            w, hit, items = word.findall(low(t)), set(), set()
            for r in bench.collect():
                b = word.findall(low(r.text))
                n = min(10, len(b))
                for k in range(len(b) - n + 1 if n else 0):
                    for a in range(len(w) - n + 1):
                        if w[a : a + n] == b[k : k + n]:
                            hit |= set(range(a, a + n))
                            items.add("null" if r.item_id is None else str(r.item_id))
            assert got[i] == (len(w), len(hit), sorted(items))


def test_repeats(docs):
    seen = Counter()
    raws = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    for _, r in raws:
        seen.update(r[a : a + 400] for a in range(len(r) - 399))
    got = {r.id: r for r in repeats.remove_repeats(docs).collect()}
    for d, r in raws:
        mark = bytearray(len(r))
        for a in range(len(r) - 399):
            if seen[r[a : a + 400]] > 1:
                mark[a : a + 400] = b"\1" * 400
        left = bytes(b for b, m in zip(r, mark) if not m)
        assert (got[d].n_bytes, got[d].n_removed, got[d].sha) == (len(r), sum(mark), hashlib.sha256(left).hexdigest())
        assert got[d].n_spans == len(re.findall(b"\1+", bytes(mark)))


def test_chunks(docs):
    got = {r.id: r for r in chunk_dedup.dedup(docs).collect()}
    assert got[5].n_removed == 0 and got[6].n_removed > 0.9 * len(LONG) and got[7].n_removed > 0.9 * len(LONG)
    for d, r in got.items():
        assert r.n_bytes - r.n_removed == (len(r.kept) if r.kept is not None else r.n_bytes)


@pytest.mark.parametrize("shard_bytes", [lm_score.SHARD_BYTES, 900])
def test_scores(docs, shard_bytes):
    toks = {i: [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None] for i, t in enumerate(TEXTS)}
    fold = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    count = Counter(x for r in docs.collect() if not fold(r.doc_id) for x in toks[r.doc_id])
    n, v = sum(count.values()), len(count)
    for r in lm_score.scores(docs, shard_bytes=shard_bytes).collect():
        base = sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in toks[r.id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(r.id), len(toks[r.id]), sum(count[x] > 0 for x in toks[r.id]), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0


def test_pseudonyms(spark):
    text = "+1 (578) 555-6437 x@mail0.example.com 4111 1111 1111 1111 4111 1111 1111 1112 27.35.230.171 1984-02-29 1983-02-29 03.11.1999"
    df = spark.createDataFrame([(1, text), (2, "again x@mail0.example.com"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.id: r for r in pseudonyms.pseudonymise(df, "k").collect()}
    made = {f.value: f.pseudonym for f in got[1].found}
    assert set(made) == {"+1 (578) 555-6437", "x@mail0.example.com", "4111 1111 1111 1111", "27.35.230.171", "1984-02-29", "03.11.1999"}
    assert all(re.sub("[0-9]", "9", a) == re.sub("[0-9]", "9", b) for a, b in made.items() if not re.search("[@]|27", a))
    digits = [int(c) for c in made["4111 1111 1111 1111"] if c != " "][::-1]
    assert sum(d if i % 2 == 0 else d * 2 // 10 + d * 2 % 10 for i, d in enumerate(digits)) % 10 == 0
    assert got[2].text == "again " + made["x@mail0.example.com"] and got[3].text is None and got[4].text == ""


def test_permutation_is_one_to_one(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("s"))
    assert df.select(F.expr(pseudonyms.feistel("s", "k", "t")).alias("p")).distinct().count() == 1000


def test_html(spark):
    page = "<html><head><title>t</title><style>p{}</style></head><body><nav><a>menu</a></nav><div class='cookie-notice'>ok?</div><article><h1>Head&amp;line</h1><p>One <b>two</b>\n three<p>four<br>five<div class=ad>buy</div><form><input>send</form><section id='comments'><p>first!</p></section></article><aside>side</aside><script>var a='<p>x</p>'</script><footer>f</footer></body></html>"
    plain = "<body><div class=top>Site name</div><div class=c><p>Text {0}</p><p>More {0}</p></div><div>Imprint</div></body>"
    rows = [(1, "http://a.example/x", page), (2, None, None), (3, "http://b.example", "")] + [(10 + i, "http://c.example/", plain.format(i)) for i in range(6)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "Head&line\nOne two three\nfour five" and got[2] == "" and got[3] == ""
    assert all(got[10 + i] == f"Text {i}\nMore {i}" for i in range(6))


def test_quality(spark):
    import random

    rng = random.Random(1)
    words = [f"w{int(rng.paretovariate(0.8))}" for _ in range(5000)]
    good = [(i, " ".join(rng.choice(words) for _ in range(80)), "en") for i in range(300)]
    bad = [(1000 + i, " ".join(f"{rng.random():.9f}" for _ in range(80)), "en") for i in range(20)]
    df = spark.createDataFrame([*good, *bad, (2000, None, "en"), (2001, " ", None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(250)] + [(None, 1, 0), (9999, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.id: r.kept for r in quality.classify(df, labels).collect()}
    assert sum(got[i] for i in range(300)) >= 295 and not any(got[1000 + i] for i in range(20)) and not got[2000] and not got[2001]
