"""How often decisions are made, and workers that give memory back."""

import pyarrow as pa
from pyspark.sql import functions as F

from quillforge.llm import textkernel as tk
from quillforge.llm.keep import keep_rows


def test_decisions_are_made_once(spark):
    docs = spark.createDataFrame([(i, f"text {i % 50}") for i in range(100)], "doc_id long, text string").repartition(3).localCheckpoint()
    seen = spark.sparkContext.accumulator(0)

    def judge(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("tx"), (F.col("doc_id") % 3 > 0).alias("kept"))
    left = keep_rows(docs, rows.mapInArrow(judge, "id long, tx long, kept boolean")).collect()
    assert sorted(r.doc_id for r in left) == [i for i in range(100) if i % 3] and seen.value == 100


def test_lean_functions_change_nothing():
    batches = [pa.RecordBatch.from_pydict({"x": [i, i + 1]}) for i in range(5)]
    assert list(tk.lean(iter)(iter(batches))) == batches
    table = pa.Table.from_batches(batches)
    assert tk.lean_group(lambda t: t.slice(1, 3))(table) == table.slice(1, 3)
