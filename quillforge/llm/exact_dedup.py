"""Exact dedup by a log-structured merge index of text digests, in DataFrame operations only.

Memtables are tasks: each flushes a run of (digest, id) sorted by digest, as Parquet with a
bloom filter for each row group (level 0). Compaction merges the runs by digest into level 1,
which keeps one winner and the size of each group. Groups of one row need nothing more;
the rows of larger groups are hits, and their texts are compared byte by byte with the
winner's. A hit that differs (a digest collision) is grouped again by its text.

Defined cases. Null text counts as empty. A null id counts as smaller than any other. Rows
that repeat an id and a text are separate rows of one group; exactly one row of a group is
kept. Empty input gives an empty result. Other columns are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keep import pick_texts
from .scratch import ascii_lower, split_join, written

#: group members that one copy of the winner's text is compared with
MEMBERS = 2000


def normalised(col):
    return ascii_lower(F.coalesce(col, F.lit("")))


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32) -> DataFrame:
    """Level 0: a row for each document, in runs sorted by digest."""
    norm = normalised(F.col(text_col))
    level0 = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tx"),
        F.unhex(F.sha2(norm, 256)).alias("sha"),
        F.monotonically_increasing_id().alias("rid"),
    ).withColumn("digest", F.substring("sha", 1, digest_bytes))
    return written(level0, "lsm0", ["digest"], **{"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.max.bytes": "65536"})


def compact(level0: DataFrame) -> DataFrame:
    """Level 1: for each digest the winner (largest id; null smallest) and the number of rows."""
    merged = level0.groupBy("digest").agg(F.max(F.struct("id", "rid", "tx")).alias("top"), F.count(F.lit(1)).alias("n"))
    return written(merged.select("digest", F.col("top.id").alias("keep"), F.col("top.rid").alias("keep_rid"), F.col("top.tx").alias("keep_tx"), "n"), "lsm1", ["digest"], **{"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.max.bytes": "65536"})


def verify(docs: DataFrame, level0: DataFrame, level1: DataFrame, total: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The hits whose bytes differ from their winner's: (id, tx, digest, norm). Empty unless digests collide."""
    groups = level1.filter("n > 1")
    hits = split_join(level0.select("id", "tx", "rid", "digest"), groups, "digest", "n", total).filter("n is not null")
    hits = written(hits, "lsm-hits")
    texts = written(pick_texts(docs, hits, id_col, text_col).select("id", "tx", normalised(F.col("text")).alias("norm")), "lsm-text")
    salts = (F.floor(F.col("n") / MEMBERS) + 1).cast("long")
    member = hits.filter("rid != keep_rid").withColumn("salt", F.pmod(F.xxhash64("id", "tx"), salts)).select("id", "tx", "digest", "salt")
    m, t = member.alias("m"), texts.alias("t")
    member = m.join(t, F.col("m.id").eqNullSafe(F.col("t.id")) & (F.col("m.tx") == F.col("t.tx"))).select("m.*", "t.norm")
    win = groups.select("digest", F.col("keep").alias("id"), F.col("keep_tx").alias("tx"), F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt")).alias("w")
    win = win.join(t, F.col("w.id").eqNullSafe(F.col("t.id")) & (F.col("w.tx") == F.col("t.tx"))).select("w.digest", "w.salt", F.col("t.norm").alias("top"))
    return member.join(win, ["digest", "salt"]).filter("norm != top").select("id", "tx", "digest", "norm")


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32) -> DataFrame:
    """A row for each row of docs: id, tx (xxhash64 of the text), keep_id, group_size, kept, sha."""
    level0 = index(docs, id_col, text_col, digest_bytes)
    level1 = compact(level0)
    total = level0.count()
    bad = verify(docs, level0, level1, total, id_col, text_col)
    groups = level1.filter("n > 1").select("digest", "keep", "keep_rid", "n")
    if not bad.isEmpty():
        bad = written(bad, "lsm-bad")
        hit = bad.select("digest").distinct()
        loose = pick_texts(docs, level0.join(hit, "digest", "left_semi"), id_col, text_col).select("id", "tx", normalised(F.col("text")).alias("norm")).alias("t")
        rows = level0.join(hit, "digest", "left_semi").alias("m")
        rows = rows.join(loose, F.col("m.id").eqNullSafe(F.col("t.id")) & (F.col("m.tx") == F.col("t.tx"))).select("m.*", "t.norm")
        again = rows.groupBy("norm").agg(F.max(F.struct("id", "rid")).alias("top"), F.count(F.lit(1)).alias("n"))
        fixed = rows.join(again, "norm").select("id", "tx", "sha", "rid", "digest", F.col("top.id").alias("keep"), F.col("top.rid").alias("keep_rid"), "n")
        level0, groups = level0.join(hit, "digest", "left_anti"), groups.join(hit, "digest", "left_anti")
        out = split_join(level0, groups, "digest", "n", total).unionByName(fixed)
    else:
        out = split_join(level0, groups, "digest", "n", total)
    single = F.col("n").isNull()
    return out.select(
        "id",
        "tx",
        F.when(single, F.col("id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("rid") == F.col("keep_rid"))).alias("kept"),
        F.lower(F.hex("sha")).alias("sha"),
    )
