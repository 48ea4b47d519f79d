"""Applying decisions to documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

#: ids in a broadcast list of dropped documents, at most (16 MB); longer lists are joined by a shuffle
BROADCAST_IDS = 1_000_000

#: words of 64 bits in the filter of pick_texts: 2 MB as rows, whatever the input
FILTER_WORDS = 1 << 17


def pick_texts(docs: DataFrame, wanted: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, tx, text, and the columns of wanted in carry, which are one value for each id and tx), one row for each (id, tx) of wanted. A bit filter of fixed size keeps most other texts out of the shuffle.

    The second join is an inner one with distinct rows: a semi join would be pushed below the
    filter and shuffle every text. Both it and the grouping are by one hash, so texts are shuffled once.
    """
    slot = F.pmod(F.col("tx"), F.lit(FILTER_WORDS)).alias("slot")
    bit = F.expr("shiftleft(1L, cast(pmod(shiftright(tx, 20), 64) as int))")
    words = wanted.groupBy(slot).agg(F.bit_or(bit).alias("mask"))  # FILTER_WORDS rows at most
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tx"), F.col(text_col).alias("text"))
    rows = rows.withColumn("slot", slot).join(F.broadcast(words), "slot").filter(F.col("mask").bitwiseAND(bit) != 0)
    rows = rows.select(F.xxhash64("tx", "id").alias("at"), "id", "tx", "text")
    wanted = wanted.select(F.xxhash64("tx", "id").alias("w_at"), F.col("id").alias("w_id"), F.col("tx").alias("w_tx"), *carry)
    wanted = wanted if carry else wanted.distinct()
    same = F.when(F.col("id").isNull(), F.col("w_id").isNull()).otherwise(F.col("id") == F.col("w_id")) & (F.col("tx").bitwiseXOR(F.col("w_tx")) == 0)
    rows = rows.join(wanted, (F.col("at") == F.col("w_at")) & same)
    return rows.groupBy("at", "id", "tx").agg(F.first("text").alias("text"), *(F.first(c).alias(c) for c in carry)).select("id", "tx", "text", *carry)


def keep_rows(docs: DataFrame, decisions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs without those that decisions (id, tx, kept) reject; tx is xxhash64 of the text, null as empty.

    Rows that repeat an id and a text share their decisions: as many of them stay as there are
    kept decisions. Docs keeps its columns, whatever their names.
    """
    names = docs.columns
    gone = decisions.groupBy("id", "tx").agg(F.count(F.lit(1)).alias("all"), F.sum(F.col("kept").cast("int")).alias("stay")).filter("stay < all")
    gone = gone.select(F.col("id").alias("__qf_id"), F.col("tx").alias("__qf_tx"), F.col("stay").alias("__qf_stay"))
    gone = written(gone, "keep-gone")  # decisions are made once
    tx = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    on = docs[id_col].cast("long").eqNullSafe(gone["__qf_id"]) & (tx == gone["__qf_tx"])
    some = gone.filter("`__qf_stay` > 0")
    small = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    out = docs.join(F.broadcast(gone) if small else gone, on, "left_anti")
    if some.isEmpty():
        return out.select(*[docs[c] for c in names])
    part = docs.join(some, on)
    order = Window.partitionBy("__qf_id", "__qf_tx").orderBy(F.xxhash64(*[docs[c] for c in names]))
    part = part.withColumn("__qf_rank", F.row_number().over(order)).filter("`__qf_rank` <= `__qf_stay`")
    return out.select(*[docs[c] for c in names]).unionByName(part.select(*[docs[c] for c in names]))
