"""Tables of packed rows hold little at a time."""

import glob

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from quillforge.llm import ngrams
from quillforge.llm.scratch import PACKED_SETTINGS, settled


def test_packed_tables_have_small_row_groups_and_all_rows(spark):
    before = {k: spark.conf.get(k, None) for k in PACKED_SETTINGS}
    rows = spark.range(120, numPartitions=1).select("id", (F.col("id") % 3).cast("int").alias("kind"), F.expr("cast(repeat(uuid(), 10000) as binary)").alias("body"))
    out = settled(rows, "t", by="kind", compression="none")
    assert {k: spark.conf.get(k, None) for k in PACKED_SETTINGS} == before
    files = glob.glob(out._scratch.removeprefix("file://") + "/kind=*/*.parquet")
    groups = [g.total_byte_size for f in files for m in [pq.ParquetFile(f).metadata] for g in map(m.row_group, range(m.num_row_groups))]
    assert len(files) == 3 and max(groups) < 8 << 20 and sum(groups) > 120 * 360_000
    got = out.select("id", "kind", F.length("body").alias("n")).collect()
    assert sorted((r.id, r.kind, r.n) for r in got) == [(i, i % 3, 360_000) for i in range(120)]


def test_ngrams_of_many_words_stay_whole():
    """Numbers are held in 32 bits where they fit; products of them never are."""
    rng = np.random.default_rng(5)
    for v in (50, 1 << 20, (1 << 31) - 1, 1 << 31):
        for level in (1, 2, 3):
            columns = [rng.integers(0, v, 500) for _ in range(level)]
            columns = [c[np.lexsort(columns[::-1])] for c in columns]
            held = columns
            for _ in range(2):  # unpacked columns are packed again
                held = ngrams._unpacked({"grams": ngrams._packed(held, v), "size": 500, "level": level}, v)
                assert all((a == b).all() and b.dtype == ngrams._width(v) for a, b in zip(columns, held))
                code = ngrams._code(held, v)
                assert code.dtype == np.int64 and (np.diff(code) >= 0).all()
