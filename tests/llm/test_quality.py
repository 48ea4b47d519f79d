import random

from quillforge.llm import quality


def test_a_few_words_of_toxic_documents(spark):
    """One word of 80 marks toxic documents; it hardly moves the perplexity, and single new words do not count."""
    rng = random.Random(2)
    words = [f"w{int(rng.paretovariate(0.8))}" for _ in range(5000)]

    def text(*more):
        return " ".join([rng.choice(words) for _ in range(79)] + list(more))

    rows = [(i, text(f"once{i}"), "en") for i in range(400)] + [(1000 + i, text(rng.choice(["vile", "scum"])), "en") for i in range(80)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(350)] + [(1000 + i, 1, 1) for i in range(60)], "doc_id long, quality int, toxic int")
    got = {r.id: r.kept for r in quality.classify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels).collect()}
    assert not any(got[1000 + i] for i in range(80)) and sum(got[i] for i in range(400)) >= 388
