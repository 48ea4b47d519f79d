"""The stylesheet optimiser as relations.

A declaration is a row: sheet, media (null outside media blocks), rule (its place in the sheet), selector,
decl (its place in the rule), property, value, important. A sheet is the unit of every window, so nothing
is shuffled but by sheet.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

GROUP = ["sheet", "media", "selector"]
COLUMNS = ["sheet", "media", "rule", "selector", "decl", "property", "value", "important"]


def merge_rules(decls: DataFrame) -> DataFrame:
    """Rules with one selector become one, at the last one's place; of each property key the declaration that stands keeps its order."""
    line = Window.partitionBy(*GROUP, "key").orderBy(F.desc("important"), F.desc("rule"), F.desc("decl"))
    rows = decls.withColumn("key", S.property_key(F.col("property"), F.col("value"))).withColumn("at", F.max("rule").over(Window.partitionBy(*GROUP)))
    rows = rows.withColumn("stands", F.row_number().over(line) == 1).filter("stands")
    place = F.row_number().over(Window.partitionBy(*GROUP).orderBy("rule", "decl"))
    return rows.withColumn("decl", place).withColumn("rule", F.col("at")).select(*COLUMNS)


def merge_media(decls: DataFrame) -> DataFrame:
    """Blocks with one media query become one at the place of the last: their rules follow each other in their old order from there.

    Adds block (the place of the merged block, or of the rule outside media) and rule (the order inside it).
    """
    block = F.when(F.col("media").isNull(), F.col("rule")).otherwise(F.max("rule").over(Window.partitionBy("sheet", "media")))
    rows = decls.withColumn("block", block)
    return rows.withColumn("rule", F.dense_rank().over(Window.partitionBy("sheet", "block").orderBy("rule"))).select("block", *COLUMNS)


def equal_blocks(blocks: DataFrame) -> DataFrame:
    """(sheet, at, media, body): of blocks with equal text one stays, at the place of the first."""
    return blocks.groupBy("sheet", "media", "body").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("copies"))


def apart(decls: DataFrame, selectors: list[str]) -> Column:
    """Whether a rule's selector is listed (ignoring case) as one that is never merged."""
    return F.lower("selector").isin(*[s.lower() for s in selectors]) if selectors else F.lit(False)


def merge_but(decls: DataFrame, selectors: list[str]) -> DataFrame:
    """merge_rules of all rules but those listed, which stay as they are."""
    return merge_rules(decls.filter(~apart(decls, selectors))).unionByName(decls.filter(apart(decls, selectors)).select(*COLUMNS))


def first_shared_differs(own: Column, other: Column, order: Column) -> Column:
    """An aggregate: whether the first property that two rules share has different values (later ones are not looked at)."""
    return F.min_by(own != other, order)


def collapse_guard(decls: DataFrame) -> DataFrame:
    """(sheet, media, selector, rule, previous, may_collapse) of each rule with an earlier one of its selector.

    Between the two, the latest declaration of each property is compared with the earlier rule's: if the first
    shared one differs, moving the earlier rule's declarations would change what wins.
    """
    rules = decls.select("sheet", "media", "selector", "rule").distinct()
    pairs = rules.withColumn("previous", F.lag("rule").over(Window.partitionBy(*GROUP).orderBy("rule"))).filter("previous is not null")
    m = decls.select(F.col("sheet").alias("ms"), F.col("media").alias("mm"), F.col("rule").alias("mr"), F.col("decl").alias("md"), F.col("property").alias("p"), F.col("value").alias("between"))
    same = (F.col("sheet") == F.col("ms")) & F.col("media").eqNullSafe(F.col("mm"))
    latest = pairs.join(m, same & (F.col("mr") > F.col("previous")) & (F.col("mr") < F.col("rule"))).groupBy(*GROUP, "rule", "previous", "p").agg(F.max_by("between", F.struct("mr", "md")).alias("between"))
    own = decls.select(F.col("sheet").alias("os"), F.col("media").alias("om"), F.col("rule").alias("orule"), F.col("decl").alias("od"), F.col("property").alias("op"), F.col("value").alias("own"))
    met = latest.join(own, (F.col("sheet") == F.col("os")) & F.col("media").eqNullSafe(F.col("om")) & (F.col("previous") == F.col("orule")) & (F.col("p") == F.col("op")))
    bad = met.groupBy(*GROUP, "rule").agg(first_shared_differs(F.col("own"), F.col("between"), F.col("od")).alias("bad")).select(F.col("sheet").alias("bs"), F.col("media").alias("bm"), F.col("selector").alias("bsel"), F.col("rule").alias("br"), "bad")
    out = pairs.join(bad, (F.col("sheet") == F.col("bs")) & F.col("media").eqNullSafe(F.col("bm")) & (F.col("selector") == F.col("bsel")) & (F.col("rule") == F.col("br")), "left")
    return out.select(*GROUP, "rule", "previous", (~F.coalesce("bad", F.lit(False))).alias("may_collapse"))


def merge_segments(decls: DataFrame) -> DataFrame:
    """merge_rules that never moves a rule across a conflict: rules of a selector are merged in runs between guards."""
    guard = collapse_guard(decls).filter("not may_collapse").select(F.col("sheet").alias("gs"), F.col("media").alias("gm"), F.col("selector").alias("gsel"), F.col("rule").alias("gr"))
    starts = decls.join(guard, (F.col("sheet") == F.col("gs")) & F.col("media").eqNullSafe(F.col("gm")) & (F.col("selector") == F.col("gsel")) & (F.col("rule") == F.col("gr")), "left")
    run = F.sum(F.when(F.col("gr").isNotNull() & (F.col("decl") == F.min("decl").over(Window.partitionBy(*GROUP, "rule"))), 1).otherwise(0)).over(Window.partitionBy(*GROUP).orderBy("rule", "decl"))
    rows = starts.withColumn("plain", F.col("selector")).withColumn("selector", F.concat("selector", F.lit("\u0001"), run.cast("string"))).select(*COLUMNS, "plain")
    merged = merge_rules(rows.select(*COLUMNS))
    return merged.withColumn("selector", F.split("selector", "\u0001")[0])


def _share(sheet: pd.DataFrame, least: int) -> pd.DataFrame:
    rules: list[list] = []
    for (rule, selector), g in sheet.sort_values(["rule", "decl"]).groupby(["rule", "selector"], sort=False):
        rules.append([rule, [selector], list(zip(g.property, g.value, g.important))])
    at = 0
    while at < len(rules):
        other = at + 1
        while other < len(rules):
            a, b = rules[at], rules[other]
            both = [x for x in a[2] if x in b[2]]
            if a[2] != b[2] and (len(both) >= least or (len(both) == 1 and 1 in (len(a[2]), len(b[2])))):
                a[2], b[2] = [x for x in a[2] if x not in both], [x for x in b[2] if x not in both]
                rules.insert(other, [b[0], a[1] + [s for s in b[1] if s not in a[1]], both])
                other += 1
            elif a[2] == b[2]:
                b[1] = a[1] + [s for s in b[1] if s not in a[1]]
                a[2] = []
            other += 1
        at += 1
    out = [(i, ",".join(s), k, *d) for i, (_, s, ds) in enumerate(r for r in rules if r[2]) for k, d in enumerate(ds)]
    return pd.DataFrame(out, columns=["rule", "selector", "decl", "property", "value", "important"]).assign(sheet=sheet.sheet.iloc[0] if len(sheet) else None)


def share_declarations(decls: DataFrame, least: int = 2) -> DataFrame:
    """Declarations that two rules of a sheet share move to a rule of both selectors, from the first pair on.

    Each step changes the rules that later steps see, so a sheet is worked off in one task (a sheet is one file).
    """
    kind = decls.schema["sheet"].dataType.simpleString()
    return decls.groupBy("sheet").applyInPandas(lambda d: _share(d, least), f"rule long, selector string, decl long, property string, value string, important boolean, sheet {kind}")


def print_rules(decls: DataFrame) -> DataFrame:
    """(sheet, css): rules in order as minified text; media blocks around their rules."""
    text = F.concat("property", F.lit(":"), "value", F.when(F.col("important"), "!important").otherwise(""))
    block = F.col("block") if "block" in decls.columns else F.col("rule")
    rows = decls.withColumn("b", block).withColumn("text", text)
    body = rows.groupBy("sheet", "b", "media", "rule", "selector").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("decl", "text"))), lambda x: x["text"]), ";").alias("body"))
    body = body.withColumn("css", F.concat("selector", F.lit("{"), "body", F.lit("}")))
    inner = body.groupBy("sheet", "b", "media").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rule", "css"))), lambda x: x["css"]), "").alias("css"))
    inner = inner.withColumn("css", F.when(F.col("media").isNull(), F.col("css")).otherwise(F.concat(F.lit("@media "), "media", F.lit("{"), "css", F.lit("}"))))
    return inner.groupBy("sheet").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "css"))), lambda x: x["css"]), "").alias("css"))


def without_property_text(decls: DataFrame, text: str = "Exclude") -> DataFrame:
    """Drops declarations whose minified text holds a string (case matters)."""
    return decls.filter(~F.concat("property", F.lit(":"), "value").contains(text))


def first_hack(rows: DataFrame, selector: str, hacks: list[str]) -> DataFrame:
    """Rows whose selector holds a hack, with the first one in list order."""
    found = F.coalesce(*[F.when(F.col(selector).contains(h), F.lit(h)) for h in hacks]) if hacks else F.lit(None).cast("string")
    return rows.withColumn("hack", found).filter("hack is not null")


def check_hacks(rows: DataFrame, selector: str, hacks: list[str]) -> DataFrame:
    """The rows as they are; one with a hack raises when it is read."""
    found = F.coalesce(*[F.when(F.col(selector).contains(h), F.lit(h)) for h in hacks])
    text = F.when(found.isNotNull(), F.raise_error(F.concat(F.lit("selector hack: "), found)).cast("string")).otherwise(F.col(selector))
    return rows.withColumn(selector, text)


def ban_exact(rows: DataFrame, selector: str, banned: list[str]) -> DataFrame:
    """Drops rules whose whole selector group is listed."""
    return rows.filter(~F.col(selector).isin(*banned)) if banned else rows


def upper_case(rows: DataFrame, parts: dict[str, Column]) -> DataFrame:
    """(columns, part): the parts of each row that are not lower case once tokens are taken out."""
    bare = [F.when(F.regexp_replace(c, r"%[-./\w]+(?::\w*)?%", "") != F.lower(F.regexp_replace(c, r"%[-./\w]+(?::\w*)?%", "")), F.lit(n)) for n, c in parts.items()]
    return rows.withColumn("part", F.explode(F.filter(F.array(*bare), lambda x: x.isNotNull())))
