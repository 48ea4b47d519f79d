"""Quality classifier: an interpolated modified Kneser-Ney trigram model of trusted text.

Trusted text is what labels call good and not toxic. The model is fitted on all of it (ngrams: n-grams
travel to shards, are counted and joined there, and the numbers travel back), and scores every document. A
trusted document is scored by the model without it: its own part is taken from all counts of the n-grams that judge
it, exactly; only the discounts and the totals over all words are those of all texts. A document is rejected
if its perplexity is above its language's limit: the QUANTILE of the perplexities of all trusted documents of the
language, or of all languages together where a language has under LEAST of them.

A perplexity is a mean, which a few words hardly move. So a second score, the contrast, is the
largest log ratio, over a document's words, of the share of rejected documents (labelled bad or
toxic) with the word to the share of trusted ones, over all of each, a trusted document without itself; words in
under SEEN rejected documents, or with a ratio under e^FLOOR, count as 0. A document is rejected if it is above
the QUANTILE of the contrasts of all trusted documents.

Defined cases. Null, empty and wordless texts have no perplexity and are rejected. A null
language is a language. Without trusted text nothing is rejected but wordless texts. Repeated
rows are judged alike. Labels for unknown documents, and null labels, are ignored. Empty
documents give an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ngrams
from . import textkernel as tk
from .keep import BROADCAST_IDS
from .scratch import mark, sweep, written

#: share of trusted documents, each unseen by the model that scores it, that each score lets pass
QUANTILE = 0.99
LEAST = 50
SEEN, FLOOR = 5, 3.0
SHARDS = 16
ORDER = 3

_START = np.array([0x51D7348B5F3A2C11], np.uint64)


def _grams(words: tk.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each word of a slice: its hash, bigram and trigram hash, and the hashes of their histories (document starts are padded)."""
    h = words.hashes()
    one = np.concatenate([_START, h])[: h.size]
    first = words.doc[:-1][words.count > 0]
    one[first] = _START[0]
    two = np.concatenate([_START, one])[: h.size]
    two[first] = _START[0]
    with np.errstate(over="ignore"):
        bi = tk.mix(one * tk.U(0xD6E8FEB86659FD93) + h)
        hist2 = tk.mix(two * tk.U(0xD6E8FEB86659FD93) + one)
        tri = tk.mix(hist2 * tk.U(0xA0761D6478BD642F) + h)
    return h, bi, tri, one, hist2


class Table:
    """Values by 64-bit key, kept as ranges of the key."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        order = np.argsort(keys)
        keys = keys[order]
        cut = np.searchsorted(keys >> tk.U(60), np.arange(1, SHARDS, dtype=np.uint64))
        self.keys = np.split(keys, cut)
        self.values = [np.split(v[order], cut) for v in values]

    def find(self, keys: np.ndarray) -> list[np.ndarray]:
        """Each value for each key, 0 where there is none."""
        order = np.argsort(keys)
        ordered = keys[order]
        cut = np.concatenate([[0], np.searchsorted(ordered >> tk.U(60), np.arange(1, SHARDS, dtype=np.uint64)), [keys.size]])
        out = [np.zeros(keys.size, v[0].dtype) for v in self.values]
        for s in range(SHARDS):
            mine, own = ordered[cut[s] : cut[s + 1]], self.keys[s]
            if mine.size and own.size:
                at = np.minimum(np.searchsorted(own, mine), own.size - 1)
                hit = own[at] == mine
                for o, v in zip(out, self.values):
                    o[order[cut[s] : cut[s + 1]][hit]] = v[s][at[hit]]
        return out


def discounts(count: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more."""
    return ngrams.discounts(np.array([(count == k).sum() for k in (1, 2, 3, 4)]))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigrams (kind 3: with bigram, history, count) and bigrams (kind 2: with word, history) of slices."""
    for batch in batches:
        for _, _, data, offsets in tk.slices(batch.column("text")):
            h, bi, tri, one, hist2 = _grams(tk.Words(data, offsets, tk.SPACED))
            for kind, key, first, second in ((3, tri, bi, hist2), (2, bi, h, one)):
                k, at, n = np.unique(key, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k.size, kind, np.int32)), *(pa.array(x.view(np.int64)) for x in (k, first[at], second[at])), pa.array(n)], ["kind", "key", "a", "b", "n"])


def counted(sample: DataFrame) -> dict[str, pa.Table]:
    """The counts of texts that fit one process, which classify does not assume: trigrams, continuation counts of bigrams and words, and the contexts of both orders."""
    grams = sample.select("text").mapInArrow(_count, "kind int, key long, a long, b long, n long")
    grams = written(grams.groupBy("kind", "key").agg(F.first("a").alias("a"), F.first("b").alias("b"), F.sum("n").cast("int").alias("n")), "kn-counts")
    tri, seen = grams.filter("kind = 3"), grams.filter("kind = 2").select("key", "a", "b")
    bi = written(tri.groupBy(F.col("a").alias("key")).agg(F.count(F.lit(1)).cast("int").alias("n")), "kn-bigrams")

    def contexts(rows: DataFrame) -> DataFrame:
        each = [F.sum((F.col("n") == k if k < 3 else F.col("n") >= 3).cast("int")).cast("int").alias(f"c{k}") for k in (1, 2, 3)]
        return rows.groupBy(F.col("b").alias("key")).agg(F.sum("n").cast("int").alias("total"), *each)

    out = {"tri": tri.select("key", "n"), "bi": bi, "uni": seen.groupBy(F.col("a").alias("key")).agg(F.count(F.lit(1)).cast("int").alias("n")), "ctx3": contexts(tri), "ctx2": contexts(seen.join(bi, "key"))}
    return {name: df.toArrow() for name, df in out.items()}


class Model:
    """The model of such counts in one process. classify uses the shards of ngrams; tests hold them against this."""

    def __init__(self, counts: dict[str, pa.Table]):
        def column(table: str, name: str) -> np.ndarray:
            return counts[table].column(name).to_numpy()

        tri_n, bi_n, uni_n = (column(t, "n") for t in ("tri", "bi", "uni"))
        self.d3, self.d2, self.d1 = discounts(tri_n), discounts(bi_n), discounts(uni_n)
        self.size = int(tri_n.sum())
        self.tri, self.bi, self.uni = (Table(column(t, "key").view(np.uint64), column(t, "n")) for t in ("tri", "bi", "uni"))
        self.types, self.mass = int(uni_n.size), int(uni_n.sum())
        self.uni_left = float(self.d1[np.minimum(uni_n, 3)].sum() / max(1, self.mass))

        def context(table: str, d: np.ndarray) -> Table:
            """For each history: its total count and the mass that discounting frees."""
            total = column(table, "total")
            freed = sum(d[k] * column(table, f"c{k}") for k in (1, 2, 3))
            return Table(column(table, "key").view(np.uint64), total.astype(np.float32), (freed / np.maximum(total, 1)).astype(np.float32))

        self.ctx3, self.ctx2 = context("ctx3", self.d3), context("ctx2", self.d2)

    def nll(self, words: tk.Words) -> np.ndarray:
        """Minus the natural log probability of each word of a slice."""
        h, bi, tri, one, hist2 = _grams(words)
        (c,) = self.uni.find(h)
        p = np.maximum(c - self.d1[np.minimum(c, 3)], 0) / max(1, self.mass) + max(self.uni_left, 1e-3) / (self.types + 1)
        (c,), (total, left) = self.bi.find(bi), self.ctx2.find(one)
        known = total > 0
        p = np.where(known, np.maximum(c - self.d2[np.minimum(c, 3)], 0) / np.maximum(total, 1) + left * p, p)
        (c,), (total, left) = self.tri.find(tri), self.ctx3.find(hist2)
        known = total > 0
        p = np.where(known, np.maximum(c - self.d3[np.minimum(c, 3)], 0) / np.maximum(total, 1) + left * p, p)
        return -np.log(np.maximum(p, 1e-12))


def _ratios(n_bad: int, n_good: int, bad: np.ndarray, good: np.ndarray) -> list[np.ndarray]:
    """The log ratio of words by the documents that hold them, and that for a trusted document with the word, which is left out; 0 for words that mark none."""
    share = np.log((bad + 0.5) / (n_bad + 1))
    both = share - np.log((good + 0.5) / (n_good + 1)), share - np.log((np.maximum(good - 1, 0) + 0.5) / max(n_good, 1))
    return [np.where((bad >= max(SEEN, n_bad // 500)) & (n_good > 0) & (r >= FLOOR), r, 0.0) for r in both]


def _contrast(n_bad: int, n_good: int):
    """What ngrams picks for the contrast, and the function of what is picked that gives it.

    Words in a 500th of the rejected documents number at most 500 times the words of one."""

    def pick(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
        return np.maximum(*_ratios(n_bad, n_good, bad, good)) > 0

    def more(words: np.ndarray, bad: np.ndarray, good: np.ndarray):
        marks = Table(words, *_ratios(n_bad, n_good, bad, good))

        def run(words: np.ndarray, index: np.ndarray, count: np.ndarray, docs: pa.Table) -> dict[str, np.ndarray]:
            out = np.zeros(count.size)
            if index.size:
                ratio, own = marks.find(words)
                some = count > 0
                each = np.where(np.repeat(np.asarray(docs.column("good")), count), own[index], ratio[index])
                out[some] = np.maximum.reduceat(each, (np.cumsum(count) - count)[some])
            return {"contrast": out}

        return run

    return pick, more


def trusted(labels: DataFrame) -> DataFrame:
    """Ids that labels call good, and not toxic."""
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    return labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min(F.coalesce(good, F.lit(False))).alias("good")).filter("good").select("id")


def rejected(labels: DataFrame) -> DataFrame:
    """Ids that labels call bad or toxic."""
    return labels.filter(F.col("doc_id").isNotNull() & ((F.col("quality") == 0) | (F.col("toxic") == 1))).select(F.col("doc_id").cast("long").alias("id")).distinct()


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE, gather: int = ngrams.GATHER) -> DataFrame:
    """A row for each document: id, tx, lang, n_words, perplexity, limit, kept. Runs of fewer words (gather) take less memory and more disk."""
    spark, since = docs.sparkSession, mark()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tx"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    known = written(trusted(labels).withColumn("bad", F.lit(False)).unionByName(rejected(labels).withColumn("bad", F.lit(True))), "kn-labels")
    small = known.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    rows = rows.join(F.broadcast(known) if small else known, "id", "left").select("id", "tx", "lang", "text", F.coalesce(~F.col("bad"), F.lit(False)).alias("good"), F.coalesce("bad", F.lit(False)).alias("bad"))
    rows = rows if small else written(rows, "kn-rows")  # rows are read more than once, in one order
    n_bad, n_good = rows.agg(*(F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)) for c in ("bad", "good"))).first()
    parts = ngrams.perplexities(rows, "id long, tx long, lang string, good boolean, n_words long, perplexity double, contrast double", "kn-scores", *_contrast(n_bad, n_good), gather=gather)
    sweep(spark, since, *parts)
    scored = reduce(DataFrame.unionByName, parts)
    held = scored.filter("good and perplexity is not null")
    limits = held.groupBy("lang").agg(F.percentile_approx("perplexity", F.lit(quantile), F.lit(10000)).alias("own"), F.count(F.lit(1)).alias("held"))
    limits = limits.filter(F.col("held") >= LEAST).select(F.col("lang").alias("lim_lang"), "own")
    limits = written(limits, "kn-limits")
    any_limit, contrast_limit = held.agg(*(F.percentile_approx(c, F.lit(quantile), F.lit(10000)) for c in ("perplexity", "contrast"))).first()
    # languages with enough trusted text number at most n / LEAST; more than a thousand are joined by a shuffle
    limits = F.broadcast(limits) if limits.count() <= 1000 else limits
    out = scored.join(limits, scored.lang.eqNullSafe(limits["lim_lang"]), "left")
    limit = F.coalesce("own", F.lit(any_limit).cast("double"), F.lit(float("inf")))
    return out.select("id", "tx", "lang", "n_words", "perplexity", limit.alias("limit"), F.coalesce((F.col("perplexity") <= limit) & (F.col("contrast") <= F.coalesce(F.lit(contrast_limit).cast("double"), F.lit(float("inf")))), F.lit(False)).alias("kept"))
