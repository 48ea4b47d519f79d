"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Rates minimise the relative entropy (over tokens) against the corpus as it is, subject to
token totals for each value of one or more columns. The dual is convex and smooth; its
solution gives each document the rate exp(sum of the multipliers of its values), and
Newton steps on the multipliers need only the tilted token sums of each value, which are
sums over pre-aggregated cells. Rates are then rounded into whole copies.

Defined cases. Null text has size 0, null sources form a source of their own, last in order.
Documents of size 0 take nothing. Empty input gives an empty result. Repeated rows are
separate documents. Other columns are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import mark, sweep, written

#: documents of one source and size class that are counted together, about
GROUP = 4000
#: rows of a broadcast table, at most (a few dozen MB)
BROADCAST_ROWS = 500_000
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *more) -> DataFrame:
    """id, tx, source, key (sorts by code point, null last), size in words, and more columns."""
    return docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tx"),
        F.col(source_col).cast("string").alias("source"),
        F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col).cast("string"))).alias("key"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        *more,
    )


def targets(cells: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """key, total -> also target: shares by repeating weights, none above ``most`` times the source's own size.

    Reshared excess ends with one level L and targets min(most * total, L * weight); L follows
    from running sums in order of the level at which a source is full.
    """
    line = Window.orderBy("key")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(line) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = cells.withColumn("w", w).withColumn("full", F.lit(most) * F.col("total") / F.col("w"))
    before = Window.orderBy("full", "key").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("full", "key").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("total").over(every) - F.lit(most) * F.coalesce(F.sum("total").over(before), F.lit(0))
    rest = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    t = t.withColumn("level", left / rest)  # if all before are full and this and later ones are not
    t = t.withColumn("level", F.min(F.when(F.col("level") <= F.col("full"), F.struct("full", "level"))).over(every)["level"])
    return t.withColumn("target", F.least(F.lit(most) * F.col("total"), F.coalesce("level", "full") * F.col("w"))).drop("full", "level")


def balance(cells: DataFrame, margins: dict[str, DataFrame], most: float = 3.0, tolerance: float = 1e-10, rounds: int = 40) -> DataFrame:
    """cells (columns of margins, total) with their rate.

    margins: for each column of cells a table (that column, target). Each round takes a Newton
    step for each margin in turn: within a margin the Hessian is diagonal, so the step of a
    value is (target - tilted sum) / tilted sum, at most 1. Only one row, the largest
    relative gap, comes to the driver.
    """
    state = cells.withColumn("lam", F.lit(0.0))
    for column, goal in margins.items():
        state = state.join(goal.select(column, F.col("target").cast("double").alias(f"__goal_{column}")), column, "left")
    state = written(state, "mix-cells")
    for _ in range(rounds):
        for _ in range(4):
            for column in margins:
                goal = F.col(f"__goal_{column}")
                tilted = F.sum(F.col("total") * F.exp("lam")).over(Window.partitionBy(column))
                step = F.when((tilted > 0) & goal.isNotNull(), F.least((goal - tilted) / tilted, F.lit(1.0))).otherwise(0.0)
                state = state.withColumn("lam", F.greatest(F.col("lam") + step, F.lit(-60.0)))
        gap = F.lit(0.0)
        for column in margins:
            goal = F.col(f"__goal_{column}")
            tilted = F.sum(F.col("total") * F.exp("lam")).over(Window.partitionBy(column))
            gap = F.greatest(gap, F.abs(F.coalesce(goal, tilted) - tilted) / F.greatest(goal, F.lit(1.0)))
        state = written(state.withColumn("gap", gap), "mix-cells")
        worst = state.agg(F.max("gap")).first()[0]
        state = state.drop("gap")
        if worst is None or worst <= tolerance:
            break
    empty = F.lit(False)
    for column in margins:
        empty = empty | (F.col(f"__goal_{column}") <= 0)
    return state.withColumn("rate", F.when(empty, 0.0).otherwise(F.least(F.exp("lam"), F.lit(float(most))))).select(*cells.columns, "rate")


def small(table: DataFrame) -> DataFrame:
    """A written table, broadcast if its size is under BROADCAST_ROWS rows; else joined by a shuffle."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def placed(rows: DataFrame, seed: str = "mix") -> DataFrame:
    """rows (id, tx, size, ...) with their size class (2 % wide) and their place in a fixed random order."""
    cls = F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double")) * 32).cast("int")).otherwise(-1)
    return rows.withColumn("cls", cls).withColumn("u", F.xxhash64(F.lit(seed), "id", "tx").bitwiseAND(F.lit((1 << 63) - 1)))


def thresholds(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """How many copies rows (placed) get that follow rates (key, rate): key, cls, whole, edge, left.

    Every row gets ``whole`` copies, those before the edge one more, and ``left`` of the rows at the edge (which
    repeat an id and a text) one more too. How many rows of each size class get one more
    is settled from the largest class to the smallest, each passing its remainder on, so
    a source misses its total by less than its smallest documents. The edge is found by counts of about GROUP
    rows in random order, then within the one count that it falls in, so no task ranks a whole class.
    """
    count = rows.groupBy("key", "cls").agg(F.count(F.lit(1)).alias("cnt"), F.sum("size").alias("words"))
    listed = count.filter("cls >= 0").join(rates, "key").withColumn("frac", F.col("rate") - F.floor("rate"))
    listed = listed.groupBy("key").agg(F.first("rate").alias("rate"), F.first("frac").alias("frac"), F.sort_array(F.collect_list(F.struct("cls", "cnt", "words")), asc=False).alias("classes"))  # a thousand classes at most
    want = "a.carry + frac * x.words"
    take = f"least(x.cnt, greatest(0L, cast(round(({want}) * x.cnt / x.words) as bigint)))"
    picked = listed.withColumn(
        "got",
        F.expr(
            f"""aggregate(classes, struct(cast(0 as double) as carry, cast(array() as array<struct<cls:int,cnt:bigint,extra:bigint>>) as out),
            (a, x) -> struct({want} - {take} * x.words / x.cnt as carry, concat(a.out, array(struct(x.cls as cls, x.cnt as cnt, {take} as extra))) as out)).out"""
        ),
    ).select("key", F.floor("rate").cast("long").alias("whole"), F.explode("got").alias("g")).select("key", "whole", "g.cls", "g.cnt", "g.extra")
    picked = written(picked, "mix-classes")
    rows = rows.select("key", "cls", "u").join(small(picked), ["key", "cls"]).withColumn("b", F.expr(f"cast(u / {float(1 << 63)!r} * (cnt div {GROUP} + 1) as bigint)"))
    line = Window.partitionBy("key", "cls").orderBy("b")
    bins = rows.groupBy("key", "cls", "b").agg(F.count(F.lit(1)).alias("c"), F.first("extra").alias("extra")).withColumn("upto", F.sum("c").over(line))
    bins = written(bins.filter("upto > extra and upto - c <= extra").select("key", "cls", "b", (F.col("extra") - F.col("upto") + F.col("c")).alias("left")), "mix-bins")
    units = rows.join(small(bins), ["key", "cls", "b"]).groupBy("key", "cls", "u").agg(F.count(F.lit(1)).alias("m"), F.first("left").alias("left"))
    units = units.withColumn("upto", F.sum("m").over(Window.partitionBy("key", "cls").orderBy("u")))
    edges = units.filter("upto > left and upto - m <= left").select("key", "cls", F.col("u").alias("edge"), (F.col("left") - F.col("upto") + F.col("m")).alias("left"))
    return written(picked.select("key", "cls", "whole").join(edges, ["key", "cls"], "left"), "mix-edges")


def copied(rows: DataFrame, edges: DataFrame, key: str = "key", cls: str = "cls", u: str = "u", out: str = "copies") -> DataFrame:
    """rows (placed, whatever their other columns) with their copies. Only rows that tie at an edge are shuffled."""
    e = small(edges.select(F.col("key").alias("__e_key"), F.col("cls").alias("__e_cls"), F.col("whole").alias("__e_whole"), F.col("edge").alias("__e_edge"), F.col("left").alias("__e_left")))
    names = rows.columns
    joined = rows.join(e, (rows[key] == e["__e_key"]) & (rows[cls] == e["__e_cls"]), "left")
    whole, edge, left = (F.col(f"__e_{x}") for x in ("whole", "edge", "left"))
    more = (edge.isNull() | (rows[u] < edge)).cast("long")
    plain = F.when(whole.isNull(), F.lit(0)).otherwise(whole + more).cast("long")
    if edges.filter("`left` > 0").isEmpty():
        return joined.select(*[rows[c] for c in names], plain.alias(out))
    tied = F.coalesce((rows[u] == edge) & (left > 0), F.lit(False))
    rank = F.row_number().over(Window.partitionBy("__e_key", "__e_cls").orderBy(rows[u]))
    ties = joined.filter(tied).withColumn("__e_rank", rank).select(*[rows[c] for c in names], (whole + (F.col("__e_rank") <= left).cast("long")).cast("long").alias(out))
    return joined.filter(~tied).select(*[rows[c] for c in names], plain.alias(out)).unionByName(ties)


def settle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents as placed rows, the targets of their sources, and the edges that settle their copies."""
    since = mark()
    rows = written(placed(sizes(docs, id_col, text_col, source_col)), "mix-sizes")
    cells = written(targets(rows.groupBy("key").agg(F.sum("size").alias("total")), weights, most), "mix-targets")
    rates = balance(cells.select("key", "total"), {"key": cells.select("key", "target")}, most)
    edges = thresholds(rows, rates)
    sweep(docs.sparkSession, since, rows, cells, edges)
    return rows, cells, edges


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """A row for each document: id, tx, source, size, source_size, target, copies, taken."""
    rows, cells, edges = settle(docs, id_col, text_col, source_col, weights, most)
    out = copied(rows, edges).join(small(cells.select("key", F.col("total").alias("source_size"), "target")), "key", "left")
    return out.select("id", "tx", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, number: str = "mix_copy", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs, each row as often as the mix takes it, with the copy's number from 1. Texts are not shuffled.

    A column of docs named as ``number`` is replaced.
    """
    _, _, edges = settle(docs, id_col, text_col, source_col)
    names = [c for c in docs.columns if c != number]
    own = placed(sizes(docs, id_col, text_col, source_col, *[F.col(f"`{c}`").alias(f"__d_{c}") for c in names]))
    out = copied(own, edges).filter("copies > 0")
    return out.select(*[F.col(f"`__d_{c}`").alias(c) for c in names], F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(number))
