"""Stages of the pipeline on small tables."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from quillforge.llm import mixing, near_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], SCHEMA).repartition(3)


def test_near_stage_takes_pairs_from_80_to_85(spark):
    """Other k last words leave 100 - k of 100 + k shingles: similarities 0.852, 0.835, 0.802 and 0.786."""
    rows, gone = [], set()
    for k in (8, 9, 11, 12):
        base = [f"k{k}w{i}" for i in range(104)]
        rows += [(10 * k, " ".join(base), "s"), (10 * k + 1, " ".join(base[:-k] + [f"k{k}n{i}" for i in range(k)]), "s")]
        if 100 * (100 - k) >= 80 * (100 + k):
            gone.add(10 * k + 1)
    left = {r.doc_id for r in corpus_pipeline.near_stage(spark, table(spark, rows), "").collect()}
    assert gone == {81, 91, 111} and left == {r[0] for r in rows} - gone


def test_matches_miss_under_one_in_1e8():
    assert near_dedup.matches(85) == 36 and near_dedup.matches(80) == 31


def test_mixing_stage_gives_each_row_its_own_copies(spark):
    """Null ids, an id with several texts, repeated rows and texts of size 0; the copies are those of the mix."""
    rows = [(None, f"word{i} " * (1 + i % 7), f"s{i % 3}") for i in range(300)]
    rows += [(7, f"other{i} " * (2 + i % 5), f"s{i % 3}") for i in range(60)] + [(8, "again and again", "s0")] * 9 + [(None, "", "s1"), (7, None, "s0"), (None, "x y", None)]
    docs = table(spark, rows)
    got, want = Counter(), Counter()
    for r in corpus_pipeline.mixing_stage(spark, docs, "").collect():
        got[r.doc_id, r.text, r.source] += 1
        assert r.text and 1 <= r.mix_copy <= 3
    text = {r.tx: r.text for r in docs.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tx")).collect()}
    for r in mixing.mix(docs).collect():
        want[r.id, text[r.tx], r.source] += r.copies
    assert got == +want and any(v == 0 for v in want.values())
