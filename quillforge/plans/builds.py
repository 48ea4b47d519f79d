"""Queries of the build side: stylesheet rules, lookups, selection, measures, images, cached sections, text. Each has an equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grammar as G
from ..functions import scanner as N
from ..functions import script as J
from ..functions import text as X
from ..operators import images as I
from ..operators import lookups as L
from ..operators import measures as M
from ..operators import preprocess as E
from ..operators import rules as R
from ..operators import sections as C
from ..operators import selection as K

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        _QUERIES[f.__name__] = run
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


#: conversations as stylesheets: a conversation is a sheet, a turn a rule, its role the selector, with two declarations
_DECLS = """d AS (SELECT conv_id AS sheet, CASE WHEN turn % 4 = 3 THEN 'print' END AS media, turn AS rule, role AS selector, k AS decl,
CASE k WHEN 1 THEN 'p' || (n % 3) ELSE 'q' || (n % 2) END AS property,
CASE WHEN k = 2 AND n % 7 = 0 THEN '-ms-' ELSE '' END || CASE k WHEN 1 THEN n % 2 ELSE n % 5 END AS value, n % 4 = 0 AS important
FROM (SELECT *, length(coalesce(text, '')) AS n FROM conversations), (VALUES (1), (2)) AS v(k))"""


def _decls(t) -> DataFrame:
    n = F.length(F.coalesce("text", F.lit("")))
    rows = t("conversations").withColumn("n", n).withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    return rows.select(
        F.col("conv_id").alias("sheet"),
        F.when(F.col("turn") % 4 == 3, "print").alias("media"),
        F.col("turn").alias("rule"),
        F.col("role").alias("selector"),
        F.col("k").alias("decl"),
        F.when(F.col("k") == 1, F.concat(F.lit("p"), F.col("n") % 3)).otherwise(F.concat(F.lit("q"), F.col("n") % 2)).alias("property"),
        F.concat(F.when((F.col("k") == 2) & (F.col("n") % 7 == 0), "-ms-").otherwise(""), F.when(F.col("k") == 1, F.col("n") % 2).otherwise(F.col("n") % 5)).alias("value"),
        (F.col("n") % 4 == 0).alias("important"),
    )


_MERGED = """k AS (SELECT *, CASE WHEN value LIKE '-ms-%' THEN '-ms-' ELSE '' END || property AS key, max(rule) OVER (PARTITION BY sheet, media, selector) AS pl FROM {0}),
s AS (SELECT *, row_number() OVER (PARTITION BY sheet, media, selector, key ORDER BY important DESC, rule DESC, decl DESC) AS r FROM k),
m AS (SELECT sheet, media, pl AS rule, selector, row_number() OVER (PARTITION BY sheet, media, selector ORDER BY rule, decl) AS decl, property, value, important FROM s WHERE r = 1)"""


@_query(f"WITH {_DECLS}, {_MERGED.format('d')} SELECT * FROM m")
def rules_merged(t):
    return R.merge_rules(_decls(t))


@_query(f"WITH {_DECLS}, b AS (SELECT CASE WHEN media IS NULL THEN rule ELSE max(rule) OVER (PARTITION BY sheet, media) END AS block, * FROM d) SELECT block, sheet, media, dense_rank() OVER (PARTITION BY sheet, block ORDER BY rule) AS rule, selector, decl, property, value, important FROM b")
def media_merged(t):
    return R.merge_media(_decls(t))


@_query("SELECT conv_id AS sheet, role AS media, length(coalesce(text, '')) % 3 AS body, min(turn) AS at, count(*) AS copies FROM conversations GROUP BY 1, 2, 3")
def media_blocks_once(t):
    return R.equal_blocks(t("conversations").select(F.col("conv_id").alias("sheet"), F.col("role").alias("media"), (F.length(F.coalesce("text", F.lit(""))) % 3).alias("body"), F.col("turn").alias("at")))


@_query(f"WITH {_DECLS}, o AS (SELECT * FROM d WHERE lower(selector) <> 'user'), {_MERGED.format('o')} SELECT * FROM m UNION ALL SELECT sheet, media, rule, selector, decl, property, value, important FROM d WHERE lower(selector) = 'user'")
def rules_never_merged(t):
    return R.merge_but(_decls(t), ["USER"])


@_query(f"""WITH {_DECLS}, r AS (SELECT DISTINCT sheet, media, selector, rule FROM d), p AS (SELECT * FROM (SELECT *, lag(rule) OVER (PARTITION BY sheet, media, selector ORDER BY rule) AS previous FROM r) WHERE previous IS NOT NULL),
m AS (SELECT p.sheet, p.media, p.selector, p.rule, p.previous, x.property, arg_max(x.value, x.rule * 10 + x.decl) AS btw FROM p JOIN d x ON x.sheet = p.sheet AND x.media IS NOT DISTINCT FROM p.media AND x.rule > p.previous AND x.rule < p.rule GROUP BY ALL),
b AS (SELECT m.sheet, m.media, m.selector, m.rule, arg_min(o.value <> m.btw, o.decl) AS bad FROM m JOIN d o ON o.sheet = m.sheet AND o.media IS NOT DISTINCT FROM m.media AND o.rule = m.previous AND o.property = m.property GROUP BY ALL)
SELECT p.sheet, p.media, p.selector, p.rule, p.previous, NOT coalesce(b.bad, false) AS may_collapse FROM p LEFT JOIN b ON b.sheet = p.sheet AND b.media IS NOT DISTINCT FROM p.media AND b.selector = p.selector AND b.rule = p.rule""")
def order_conflict_guard(t):
    return R.collapse_guard(_decls(t))


@_query(f"""WITH {_DECLS}, {_MERGED.format('d')}, c AS (SELECT sheet, media, rule, selector || '{{' || string_agg(property || ':' || value || CASE WHEN important THEN '!important' ELSE '' END, ';' ORDER BY decl) || '}}' AS css FROM m GROUP BY sheet, media, rule, selector)
SELECT sheet, string_agg(CASE WHEN media IS NULL THEN css ELSE '@media ' || media || '{{' || css || '}}' END, '' ORDER BY rule) AS css FROM c GROUP BY sheet""")
def sheet_printed(t):
    return R.print_rules(R.merge_rules(_decls(t)))


@_query(f"WITH {_DECLS} SELECT * FROM d WHERE NOT contains(property || ':' || value, 'q1:')")
def properties_excluded(t):
    return R.without_property_text(_decls(t), "q1:").select(*R.COLUMNS)


@_query("SELECT p_partkey, p_type, CASE WHEN contains(p_type, 'BRASS') THEN 'BRASS' ELSE 'SMALL' END AS hack FROM part WHERE contains(p_type, 'BRASS') OR contains(p_type, 'SMALL')")
def selector_hacks(t):
    return R.first_hack(t("part").select("p_partkey", "p_type"), "p_type", ["BRASS", "SMALL"])


@_query("SELECT p_partkey, p_brand FROM part WHERE p_brand NOT IN ('Brand#1', 'Brand#2', 'Brand#11', 'Brand#12')")
def selectors_banned_exactly(t):
    return R.ban_exact(t("part").select("p_partkey", "p_brand"), "p_brand", ["Brand#1", "Brand#2", "Brand#11", "Brand#12"])


@_query("SELECT n_nationkey, part FROM (SELECT n_nationkey, unnest(list_filter([CASE WHEN n_nationkey % 2 = 0 AND n_name <> lower(n_name) THEN 'selector' END, CASE WHEN n_nationkey % 5 = 0 THEN 'media' END], lambda x: x IS NOT NULL)) AS part FROM nation)")
def not_lower_case(t):
    k = F.col("n_nationkey")
    selector = F.when(k % 2 == 0, F.col("n_name")).otherwise(F.concat(F.lit("a%"), "n_name", F.lit("%")))
    media = F.when(k % 5 == 0, "Screen").otherwise("screen")
    return R.upper_case(t("nation"), {"selector": selector, "media": media}).select("n_nationkey", "part")


@_query("SELECT c_custkey, coalesce(o, -1) AS target FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def missing_fallback(t):
    first = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("target"))
    return L.lookup(t("customer").select("c_custkey"), first, "c_custkey", "target", F.lit(-1).cast("long"), must=True)


@_query("""SELECT c_custkey, c_mktsegment, r.o_orderkey AS first_order FROM customer LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1) r
ON r.o_custkey = c_custkey AND lower(r.o_orderstatus) = CASE WHEN c_custkey % 2 = 0 THEN 'o' ELSE 'f' END""")
def composite_lookup(t):
    rows = t("customer").select("c_custkey", "c_mktsegment", F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_custkey") % 2 == 0, "O").otherwise("f").alias("o_orderstatus"))
    table = t("orders").withColumn("first_order", F.col("o_orderkey"))
    return L.lookup_first(rows, table, ["o_custkey", "o_orderstatus"], ["o_orderdate", "o_orderkey"], ["first_order"], fold=["o_orderstatus"]).select("c_custkey", "c_mktsegment", "first_order")


@_query("""WITH a AS (SELECT user_id AS grp, string_agg(event_type, ',' ORDER BY event_type) AS i FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id AS output, string_agg(event_type, ',' ORDER BY event_type) AS i FROM events WHERE event_id % 2 = 1 GROUP BY 1)
SELECT grp, output FROM a JOIN b USING (i) WHERE grp % 10 = 0""")
def reverse_lookup(t):
    e = t("events").select("event_type", "user_id", "event_id")
    wanted = e.filter("event_id % 2 = 0 and user_id % 10 = 0").withColumnRenamed("user_id", "grp")
    return L.reverse_lookup(e.filter("event_id % 2 = 1").withColumnRenamed("user_id", "output"), wanted, "output", "event_type", "grp")


@_query("""SELECT r_name, 'Resolution' || replace(CAST(d AS VARCHAR), '.', '') || 'X' AS resolution, n_name FROM region CROSS JOIN (VALUES ('1'), ('1.5'), ('2')) AS v(d) LEFT JOIN (SELECT 'Resolution' || (n_nationkey % 4) || 'X' AS res, n_name FROM nation) ON res = 'Resolution' || replace(CAST(d AS VARCHAR), '.', '') || 'X'""")
def dpi_product(t):
    from ..functions.scalars import dpi_name

    n = t("nation")
    dpis = n.sparkSession.createDataFrame([(1.0,), (1.5,), (2.0,)], "d double")
    found = n.select(F.concat(F.lit("Resolution"), F.col("n_nationkey") % 4, F.lit("X")).alias("resolution"), "n_name")
    return L.by_resolution(t("region").select("r_name"), dpis, found, dpi_name(F.col("d"))).select("r_name", "resolution", "n_name")


@_query("""SELECT c_custkey, token FROM (SELECT c_custkey, n_name AS token FROM customer JOIN nation ON n_nationkey = c_nationkey UNION SELECT c_custkey, c_mktsegment FROM customer) WHERE token IN (SELECT n_name FROM nation WHERE n_nationkey % 3 <> 0)""")
def used_tokens(t):
    named = t("nation").select("n_nationkey", "n_name")
    texts = t("customer").join(named, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat(F.lit("a %"), "n_name", F.lit("% b %"), "c_mktsegment", F.lit("% %"), "n_name", F.lit("%")).alias("text"))
    known = named.filter("n_nationkey % 3 <> 0").select(F.col("n_name").alias("token"))
    return L.used_tokens(texts, "text", known, "token").select("c_custkey", "token")


@_query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def anti_unlogged(t):
    new = t("orders").select("o_orderkey", F.lit("R").alias("flag"))
    log = t("lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("flag"))
    return L.unlogged(new, log, "o_orderkey", "flag").select("o_orderkey")


@_query("SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_linenumber > 3 AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber <= 3)")
def renames_skipped(t):
    rows = t("lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    return L.unlogged(rows.filter("l_linenumber > 3").select("l_orderkey", "l_suppkey").distinct(), rows.filter("l_linenumber <= 3"), "l_orderkey", "l_suppkey", skip=True)


@_query("SELECT l_orderkey, count(DISTINCT l_suppkey) AS outputs FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def rename_conflict(t):
    return L.conflicting(t("lineitem"), "l_orderkey", "l_suppkey")


@_query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A') UNION SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 = 0")
def log_merged(t):
    o = t("orders").select("o_orderkey", "o_custkey")
    present = t("lineitem").filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"))
    return L.merge_log(o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 3 = 0"), present, "o_orderkey")


@_query("SELECT n_name, row_number() OVER (ORDER BY k) AS place FROM nation JOIN (VALUES ('FRANCE', 1), ('china', 2), ('Brazil', 3), ('nowhere', 4)) AS v(name, k) ON lower(n_name) = lower(name) WHERE n_regionkey <> 1")
def engine_order_join(t):
    n = t("nation").select("n_name", "n_regionkey")
    listed = n.sparkSession.createDataFrame([("FRANCE", 1), ("china", 2), ("Brazil", 3), ("nowhere", 4)], "n_name string, k int")
    return L.in_listed_order(listed, n, "n_name", "k", F.col("n_regionkey") != 1).select("n_name", "place")


@_query("SELECT hash, name, row_number() OVER (PARTITION BY hash ORDER BY name) = 1 AS first FROM (SELECT DISTINCT md5(coalesce(text, '')) AS hash, CAST(doc_id AS VARCHAR) AS name FROM documents)")
def names_of_contents(t):
    return L.several_names(t("documents").select("text", F.col("doc_id").cast("string").alias("n")), "text", "n")


@_query("""SELECT p_partkey, 'a{b:url(' || CASE WHEN p_size % 5 = 0 THEN 'none.png' ELSE md5('i' || p_size % 5) END || ') url(x.png) url(hash(%t%)) url(' || md5('i1') || ')}' AS css FROM part""")
def urls_hashed(t):
    k = F.col("p_size") % 5
    sheets = t("part").select("p_partkey", F.concat(F.lit("a{b:url(hash(I"), k, F.lit(")) url(x.png) url(hash(%t%)) url( 'hash(i1)' )}")).alias("css"))
    images = t("part").select(k.alias("k")).distinct().filter("k > 0").select(F.concat(F.lit("i"), "k").alias("path")).withColumn("hashed", F.md5("path"))
    return L.hashed_urls(sheets, "css", images, "path", "hashed", "none.png")


@_query("SELECT lower(p_brand) || '/' || p_partkey || '.png' AS name, 'root/' || lower(p_brand) || '/' || p_partkey || '.png' AS path FROM part")
def image_catalogue(t):
    return L.image_catalogue(t("part").select(F.concat(F.lit("Root\\"), "p_brand", F.lit("\\"), "p_partkey", F.lit(".PNG")).alias("path")), "path", "ROOT")


@_query("""SELECT l_orderkey, bool_or(every) AS ignore FROM (SELECT l_orderkey, g, bool_and(CASE g WHEN 'flag' THEN NOT contains(lower(k), 'r') ELSE NOT contains(lower(k), 'f') END) AS every FROM (
SELECT l_orderkey, 'flag' AS g, l_returnflag AS k FROM lineitem UNION ALL SELECT l_orderkey, 'status', l_linestatus FROM lineitem) GROUP BY 1, 2) GROUP BY 1""")
def overrides_ignored(t):
    li = t("lineitem")
    keys = li.select("l_orderkey", F.lit("flag").alias("g"), F.col("l_returnflag").alias("k")).unionByName(li.select("l_orderkey", F.lit("status").alias("g"), F.col("l_linestatus").alias("k")))
    return K.ignored(keys, "l_orderkey", "g", "k", {"flag": ["R"], "status": ["f"]})


@_query("SELECT p_partkey, NOT (contains(lower(p_name || '.a' || CASE WHEN p_size % 2 = 0 THEN '.css' ELSE '' END), 'green') OR (p_size % 2 = 0)) AS left_out FROM part")
def outputs_left_out(t):
    output = F.concat(F.regexp_replace("p_name", "[.]", ""), F.lit(".a"), F.when(F.col("p_size") % 2 == 0, ".css").otherwise(""))
    return t("part").select("p_partkey", K.output_ignored(output, ["GREEN", ".a"]).alias("left_out"))


@_query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#1' OR p_brand || '/' || p_partkey = 'Brand#2/7'")
def images_ignored(t):
    return t("part").filter(K.image_ignored(F.concat("p_brand", F.lit("\\"), "p_partkey"), ["brand#1/*", "BRAND#2\\7"])).select("p_partkey")


@_query("SELECT event_id, event_type FROM events WHERE user_id % 5 <= 2")
def errors_at_level(t):
    return K.at_level(t("events").withColumn("severity", F.col("user_id") % 5), "severity", 2).select("event_id", "event_type")


@_query("SELECT DISTINCT user_id % 20 AS line, CAST(length(props) AS BIGINT) AS \"column\", event_type AS message FROM events")
def errors_once(t):
    return K.distinct_errors(t("events").select((F.col("user_id") % 20).alias("line"), F.length("props").cast("long").alias("column"), F.col("event_type").alias("message")))


@_query("SELECT DISTINCT event_type || ' at ' || (user_id % 20) AS message FROM events")
def messages_once(t):
    return K.messages(t("events"), F.concat("event_type", F.lit(" at "), F.col("user_id") % 20))


@_query("SELECT page_id, url FROM pages ORDER BY lower(url), url, page_id LIMIT 100")
def first_paths(t):
    return K.top(t("pages").select("page_id", "url"), 100, *K.path_order(F.col("url")), F.col("page_id"))


@_query("SELECT o_custkey, open, total, row_number() OVER (PARTITION BY o_custkey ORDER BY open, total DESC) AS place FROM (SELECT o_custkey, o_orderstatus = 'O' AS open, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2)")
def flags_then_sums(t):
    from pyspark.sql import Window

    g = t("orders").groupBy("o_custkey", (F.col("o_orderstatus") == "O").alias("open")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("o_custkey").orderBy(*K.false_first_then_most(F.col("open"), F.col("total")))))


@_query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(coalesce(text, '')) ORDER BY doc_id) AS r FROM documents) WHERE r > 1")
def later_copies(t):
    return K.but_first(t("documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("h")), ["h"], F.col("doc_id")).select("doc_id")


@_query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS place FROM conversations")
def turns_backwards(t):
    return K.backwards(t("conversations").select("conv_id", "turn"), ["conv_id"], "turn")


@_query("SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 12")
def at_least_twelve(t):
    return K.at_least(t("orders"), ["o_custkey"], 12)


@_query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def set_members(t):
    return K.members(t("orders").select("o_orderkey", "o_custkey"), "o_custkey", t("customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))).select("o_orderkey", "o_custkey")


@_query("""SELECT event_type || CASE WHEN count(*) >= 2 THEN ' - Multi-Threaded' ELSE '' END AS label, CAST(sum(c) AS BIGINT) AS count, round(sum(d), 3) AS duration FROM (SELECT user_id, event_type, count(*) AS c, sum(value) AS d FROM events GROUP BY 1, 2) GROUP BY event_type""")
def measure_groups(t):
    g = M.build_groups(t("events").withColumn("one", F.lit(1).cast("long")), "user_id", "event_type", "one", "value")
    return g.withColumn("duration", F.round("duration", 3))


@_query("""SELECT event_type, min(n) AS n, round(sum(total), 4) AS total FROM (SELECT event_type, user_id, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2) GROUP BY 1""")
def measure_summary(t):
    g = t("events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    s = M.summary(g.withColumn("name", F.concat_ws(".", "event_type", "user_id")), "name", "n", "total")
    return s.select(F.col("part").alias("event_type"), F.col("count").alias("n"), F.round("duration", 4).alias("total"))


@_query("SELECT k, CAST(sum(v) AS BIGINT) AS v FROM (SELECT o_custkey % 50 AS k, 1 AS v FROM orders UNION ALL SELECT c_custkey % 50, 2 FROM customer) GROUP BY k")
def maps_added(t):
    a = t("orders").select((F.col("o_custkey") % 50).alias("k"), F.lit(1).cast("long").alias("v"))
    return M.add_maps(a, t("customer").select((F.col("c_custkey") % 50).alias("k"), F.lit(2).cast("long").alias("v")), key="k", value="v")


@_query("SELECT user_id, max(ts) AS last, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000.0::DOUBLE AS ms FROM events GROUP BY 1")
def elapsed(t):
    return t("events").groupBy("user_id").agg(F.max("ts").alias("last"), M.elapsed_ms(F.min("ts"), F.max("ts")).alias("ms"))


@_query("""SELECT thread, name, CAST(sum(ms) AS DOUBLE) AS ms FROM (SELECT conv_id AS thread, role AS name, length(coalesce(text, '')) AS ms FROM conversations
UNION ALL SELECT conv_id, 'whole', (max(turn) + 2) * 100000 - sum(length(coalesce(text, ''))) FROM conversations GROUP BY 1) GROUP BY 1, 2""")
def self_time(t):
    c = t("conversations").select(F.col("conv_id").alias("thread"), "turn", F.col("role").alias("name"), F.length(F.coalesce("text", F.lit(""))).alias("n"))
    at = lambda ms: F.timestamp_millis(ms.cast("long"))
    opened = c.select("thread", at((F.col("turn") + 1) * 100000).alias("at"), (F.col("turn") * 2 + 1).alias("o"), F.lit(True).alias("opens"), "name")
    closed = c.select("thread", at((F.col("turn") + 1) * 100000 + F.col("n")).alias("at"), (F.col("turn") * 2 + 2).alias("o"), F.lit(False).alias("opens"), "name")
    ends = c.groupBy("thread").agg(F.max("turn").alias("last"))
    whole = ends.select("thread", at(F.lit(0)).alias("at"), F.lit(-1).cast("long").alias("o"), F.lit(True).alias("opens"), F.lit("whole").alias("name"))
    end = ends.select("thread", at((F.col("last") + 2) * 100000).alias("at"), (F.col("last") * 2 + 9).alias("o"), F.lit(False).alias("opens"), F.lit("whole").alias("name"))
    return M.self_times(opened.unionByName(closed).unionByName(whole).unionByName(end), "thread", "at", "o", "opens", "name")


@_query("SELECT user_id % 10 AS parent, event_type, count(*) AS n, round(sum(value), 3) AS duration FROM events GROUP BY ROLLUP (user_id % 10, event_type)")
def timers_rolled_up(t):
    return M.roll_up(t("events").select((F.col("user_id") % 10).alias("parent"), "event_type", "value"), "parent", "event_type", "value").withColumn("duration", F.round("duration", 3))


@_query("SELECT '\"' || replace(o_orderpriority, '\"', '\"\"') || '\",\"' || n || '\",\"' || c || '\",\"' || n || '\",\"' || c || '\"' AS line FROM (SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS c FROM orders GROUP BY 1)")
def report_csv(t):
    g = t("orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("c"))
    return M.csv_lines(g, "o_orderpriority", "n", "c", "n", "c")


@_query("SELECT rpad(o_orderpriority, 40, ' ') || lpad(CAST(n AS VARCHAR), 14, ' ') || lpad(CAST(c AS VARCHAR), 10, ' ') AS line FROM (SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS c FROM orders GROUP BY 1)")
def report_text(t):
    g = t("orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("c"))
    return M.text_lines(g, "o_orderpriority", "n", "c")


@_query("SELECT h, position, path[1] AS path, array_to_string(path[2:], ',') AS duplicates FROM (SELECT md5(coalesce(text, '')) AS h, lang AS position, list(CAST(doc_id AS VARCHAR) ORDER BY doc_id) AS path FROM documents GROUP BY 1, 2)")
def image_duplicates(t):
    rows = t("documents").select(F.md5(F.coalesce("text", F.lit(""))).alias("h"), F.col("lang").alias("position"), F.col("doc_id").cast("string").alias("path"), F.col("doc_id").alias("o"))
    return I.without_duplicates(rows, "h", "position", "path", "o").withColumn("duplicates", F.array_join("duplicates", ","))


@_query("SELECT p_brand, CAST(max(p_size) AS BIGINT) AS width, CAST(sum(p_size + 50) AS BIGINT) AS height, 'v' AS way FROM part GROUP BY 1 UNION ALL SELECT p_brand, CAST(sum(p_size + 50) AS BIGINT), CAST(max(p_size) AS BIGINT), 'h' FROM part GROUP BY 1")
def sprite_canvas(t):
    p = t("part")
    return I.canvas(p, "p_brand", "p_size", "p_size").withColumn("way", F.lit("v")).unionByName(I.canvas(p, "p_brand", "p_size", "p_size", vertical=False).withColumn("way", F.lit("h")))


@_query("SELECT p_partkey, p_brand, CAST(-coalesce(sum(p_size + 50) OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS x, CAST(0 AS BIGINT) AS y FROM part")
def sprite_horizontal(t):
    return I.pack_horizontal(t("part"), "p_brand", "p_size", "p_size", "p_partkey").select("p_partkey", "p_brand", "x", "y")


@_query("SELECT p_type, CASE WHEN count(*) = 1 THEN min(p_name) ELSE md5(string_agg(p_name, '|' ORDER BY p_name)) END AS name, count(*) AS n FROM part GROUP BY 1")
def sprite_names(t):
    return I.sprite_names(t("part"), "p_type", "p_name")


@_query("SELECT p_partkey, CASE WHEN p_brand LIKE '%3' THEN 'forced' WHEN contains(p_type, 'STEEL') THEN 'Photo' WHEN p_size > 45 THEN 'NotSupported' WHEN p_size <= 16 THEN 'NonphotoIndexed' ELSE 'NonphotoNonindexed' END AS kind FROM part")
def image_type(t):
    kind = I.image_type(F.when(F.col("p_brand").endswith("3"), "forced"), F.col("p_type").contains("STEEL"), F.when(F.col("p_size") > 45, 2).otherwise(1), F.col("p_size") <= 16)
    return t("part").select("p_partkey", kind.alias("kind"))


@_query("SELECT user_id, event_type, (SELECT bool_or(e.value > 50) AND NOT bool_and(e.value > 50) FROM events e WHERE e.user_id = g.user_id) AS mixed FROM (SELECT user_id, event_type FROM events GROUP BY 1, 2 HAVING bool_or(value > 50)) g")
def sprite_wanted(t):
    return I.wanted(t("events").withColumn("fit", F.col("value") > 50), "user_id", "event_type", "fit", check=False)


_REASONS = "['NoUrl', 'IgnoreUrl', 'BackgroundRepeatInvalid', 'IncorrectPosition', 'MultipleUrls', 'SpritingIgnore', 'NoRepeat', 'BackgroundSizeIsSetToNonDefaultValue']"
_USES = f"u AS (SELECT p_partkey, p_brand, p_type, CASE WHEN p_size % 9 < 8 THEN {_REASONS}[p_size % 9 + 1] END AS reason FROM part)"


def _uses(t) -> DataFrame:
    reason = F.get(F.array(*[F.lit(r) for r in I.REASONS]), F.col("p_size") % 9)
    return t("part").select("p_partkey", "p_brand", "p_type", reason.alias("reason"))


@_query(f"WITH {_USES} SELECT p_partkey, CAST(coalesce(list_position({_REASONS}, reason) - 1, 8) AS INTEGER) AS place FROM u")
def reason_order(t):
    return _uses(t).select("p_partkey", I.reason_rank(F.col("reason")).alias("place"))


@_query(f"""WITH {_USES} SELECT CASE WHEN reason IS NULL THEN 'sprited' WHEN reason IN ('SpritingIgnore', 'IgnoreUrl') THEN 'ignored' ELSE 'failed' END AS outcome, coalesce(reason, p_brand || '/' || p_type) AS detail, count(*) AS n FROM u GROUP BY 1, 2""")
def sprite_log(t):
    return I.analysis_log(_uses(t), "reason", "p_brand", "p_type")


@_query("SELECT p_brand, count(DISTINCT CASE WHEN p_size % 10 < 9 THEN p_partkey * 17 % 16777216 END) AS colours, count(DISTINCT CASE WHEN p_size % 10 < 9 THEN p_partkey * 17 % 16777216 END) <= 256 AND NOT bool_or(p_size = 49) AS indexable FROM part GROUP BY 1")
def colours_indexable(t):
    alpha = F.when(F.col("p_size") == 49, 128).when(F.col("p_size") % 10 == 9, 0).otherwise(255)
    return I.indexable(t("part").withColumn("rgb", F.col("p_partkey") * 17 % 16777216).withColumn("a", alpha), "p_brand", "rgb", "a").select("p_brand", "colours", "indexable")


@_query("""WITH p AS (SELECT p_brand, CAST(p_partkey * 7 % 256 AS INTEGER) AS r, CAST(p_size * 5 AS INTEGER) AS g, CAST(p_partkey * p_size % 256 AS INTEGER) AS b FROM part),
c AS (SELECT p_brand, bits, r >> (8 - bits) AS x, g >> (8 - bits) AS y, b >> (8 - bits) AS z, round_even(avg(r), 0) AS r, round_even(avg(g), 0) AS g, round_even(avg(b), 0) AS b, count(*) AS pixels FROM p, (SELECT CAST(unnest(range(1, 9)) AS INTEGER) AS bits) GROUP BY p_brand, bits, x, y, z),
f AS (SELECT p_brand, max(bits) AS bits FROM (SELECT p_brand, bits, count(*) AS n FROM c GROUP BY 1, 2) WHERE n <= 16 GROUP BY 1)
SELECT p_brand, CAST(r AS INTEGER) AS red, CAST(g AS INTEGER) AS green, CAST(b AS INTEGER) AS blue, pixels FROM c JOIN f USING (p_brand, bits)""")
def image_palette(t):
    k, s = F.col("p_partkey"), F.col("p_size")
    pixels = t("part").select("p_brand", (k * 7 % 256).cast("int").alias("red"), (s * 5).cast("int").alias("green"), (k * s % 256).cast("int").alias("blue"))
    return I.palette(pixels, "p_brand", "red", "green", "blue", 16)


@_query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'sprite' ELSE p_brand END AS url, CASE WHEN p_size % 2 = 0 THEN CASE WHEN p_size = 10 THEN '0' ELSE (10 - p_size) // 2 || 'px' END || ' ' || (-p_size // 2) || 'px' END AS "offset", CASE WHEN p_size % 2 = 0 THEN '50px 25px' END AS size FROM part""")
def sprite_rewrite(t):
    decls = t("part").select("p_partkey", F.col("p_brand").alias("url"), F.col("p_size").alias("position"))
    places = decls.filter("position % 2 = 0").select("url", "position").distinct()
    places = places.select("url", "position", F.lit("sprite").alias("sprite"), (10 - F.col("position")).alias("x"), (-F.col("position")).alias("y"), F.lit(100).alias("width"), F.lit(50).alias("height"))
    return I.rewrite(decls, places, "url", "position", F.lit(2.0)).select("p_partkey", "url", "offset", "size")


@_query("SELECT p_brand AS sprite, 'i' || p_partkey AS path, CAST(p_size AS BIGINT) AS x, CAST(p_partkey AS BIGINT) AS y, CAST(p_size * 2 AS BIGINT) AS width, CAST(7 AS BIGINT) AS height FROM part")
def sprite_map_round_trip(t):
    places = t("part").select("p_brand", F.concat(F.lit("i"), "p_partkey").alias("path"), F.col("p_size").alias("x"), F.col("p_partkey").alias("y"), (F.col("p_size") * 2).alias("width"), F.lit(7).alias("height"))
    return I.read_sprite_map(I.sprite_map(places, "p_brand", "path", "x", "y", "width", "height"), "xml")


#: suppliers as sections: a tree of two branches at each; orders as their results
_TREE = """s AS (SELECT s_suppkey AS section, CASE WHEN s_suppkey > 1 THEN s_suppkey // 2 END AS parent, s_suppkey % 13 <> 0 AS loaded FROM supplier),
tree AS (WITH RECURSIVE w AS (SELECT section AS root, section, 0 AS depth FROM s UNION ALL SELECT w.root, s.section, w.depth + 1 FROM w JOIN s ON s.parent = w.section) SELECT * FROM w),
r AS (SELECT o_custkey % (SELECT count(*) FROM supplier) + 1 AS section, o_orderkey AS path, md5(CAST(o_orderkey AS VARCHAR)) AS hash, o_orderstatus AS category, o_orderpriority LIKE '1%' AS is_end FROM orders)"""


def _tree(t):
    n = t("supplier").count()
    s = t("supplier").select(F.col("s_suppkey").alias("section"), F.when(F.col("s_suppkey") > 1, F.expr("s_suppkey div 2")).alias("parent"), (F.col("s_suppkey") % 13 != 0).alias("loaded"))
    r = t("orders").select((F.col("o_custkey") % n + 1).alias("section"), F.col("o_orderkey").alias("path"), F.md5(F.col("o_orderkey").cast("string")).alias("hash"), F.col("o_orderstatus").alias("category"), F.col("o_orderpriority").startswith("1").alias("is_end"))
    return C.descendants(s, 16), s, r


@_query(f"WITH {_TREE} SELECT root, section, depth FROM tree")
def section_tree(t):
    return _tree(t)[0]


@_query(f"WITH {_TREE} SELECT root, path FROM tree JOIN r USING (section) WHERE category = 'F' AND is_end")
def section_results(t):
    tree, _, r = _tree(t)
    return C.all_results(tree, r, "F", True).select("root", "path")


_TESTS = f"""{_TREE}, p AS (SELECT path, CASE WHEN path % 97 = 0 THEN 'x' ELSE hash END AS now FROM r WHERE path % 89 <> 0), ch AS (SELECT section FROM s WHERE section % 11 = 0),
skip AS (SELECT root, (SELECT bool_and(loaded) FROM tree JOIN s USING (section) WHERE root = a.root) AND coalesce((SELECT bool_and(coalesce(now = hash, false)) FROM tree JOIN r USING (section) LEFT JOIN p USING (path) WHERE is_end AND root = a.root), false)
AND NOT EXISTS (SELECT 1 FROM tree JOIN ch USING (section) WHERE root = a.root) AS can_skip FROM (SELECT DISTINCT root FROM tree) a),
restore AS (SELECT root, coalesce((SELECT bool_and(path % 101 <> 0) FROM tree JOIN r USING (section) WHERE root = a.root), true) AND NOT EXISTS (SELECT 1 FROM tree JOIN ch USING (section) WHERE root = a.root) AS can_restore FROM (SELECT DISTINCT root FROM tree) a)"""


def _tests(t):
    tree, s, r = _tree(t)
    present = r.filter("path % 89 <> 0").select("path", F.when(F.col("path") % 97 == 0, "x").otherwise(F.col("hash")).alias("hash"))
    changed = s.filter("section % 11 = 0")
    return C.can_skip(tree, s, r, present, changed), C.can_restore(tree, r, r.filter("path % 101 <> 0"), changed)


@_query(f"WITH {_TESTS} SELECT * FROM skip")
def skip_test(t):
    return _tests(t)[0]


@_query(f"WITH {_TESTS} SELECT * FROM restore")
def restore_test(t):
    return _tests(t)[1]


@_query(f"WITH {_TESTS} SELECT root, CASE WHEN can_skip THEN 'skip' WHEN can_restore THEN 'restore' ELSE 'run' END AS tier FROM skip JOIN restore USING (root)")
def section_tiers(t):
    return C.tiers(*_tests(t))


@_query("SELECT md5('1.0.11|css|' || md5(text) || '|' || lang) AS section, doc_id FROM documents")
def section_key(t):
    return t("documents").select(C.section_key("1.0.11", "css", F.md5("text"), F.col("lang")).alias("section"), "doc_id")


@_query("SELECT event_id FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 48 HOUR")
def cache_expiry(t):
    return C.expired(t("events"), "ts", 48).select("event_id")


@_query("SELECT 'CF' || k AS folder FROM (SELECT unnest(range(1, 1000)) AS k) WHERE k NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 2 = 1) ORDER BY k LIMIT 20")
def free_folders(t):
    return C.free_folders(t("nation").filter("n_nationkey % 2 = 1").select(F.concat(F.lit("CF"), "n_nationkey").alias("folder")), "folder", 20)


@_query("SELECT doc_id, CASE WHEN doc_id % 3 > 0 AND doc_id % 5 > 0 THEN md5(text) END AS hash FROM documents")
def hash_shortcut(t):
    d, k = t("documents"), F.col("doc_id")
    return d.select("doc_id", C.same_hash(F.col("n_chars"), k, F.when(k % 3 > 0, F.col("n_chars")).otherwise(-1), F.when(k % 5 > 0, k).otherwise(-1), F.md5("text")).alias("hash"))


@_query(f"WITH {_TREE} SELECT CAST(parent AS VARCHAR) AS source, CAST(section AS VARCHAR) AS target, 'section' AS kind FROM s WHERE parent IS NOT NULL UNION SELECT CAST(section AS VARCHAR), CAST(path AS VARCHAR), 'file' FROM r")
def dependency_graph(t):
    _, s, r = _tree(t)
    return C.dependency_graph(s, r)


_HEX = "['#ff0000', '#000080', '#f0ffff', '#aabbcc', '#123456', '#d2b48c', '#ffffff']"


@_query(f"""SELECT p_partkey, c, CASE c WHEN '#ff0000' THEN 'red' WHEN '#000080' THEN 'navy' WHEN '#aabbcc' THEN '#abc' WHEN '#ffffff' THEN '#fff' ELSE c END AS major,
CASE c WHEN '#ff0000' THEN 'red' WHEN '#000080' THEN 'navy' WHEN '#f0ffff' THEN 'azure' WHEN '#aabbcc' THEN '#abc' WHEN '#d2b48c' THEN 'tan' WHEN '#ffffff' THEN '#fff' ELSE c END AS every, CASE p_size % 2 WHEN 0 THEN '#d2b48c' END AS named FROM (SELECT *, {_HEX}[p_partkey % 7 + 1] AS c FROM part)""")
def colour_names(t):
    c = F.get(F.array(*[F.lit(x) for x in ("#ff0000", "#000080", "#f0ffff", "#aabbcc", "#123456", "#d2b48c", "#ffffff")]), (F.col("p_partkey") % 7).cast("int"))
    return t("part").select("p_partkey", c.alias("c"), X.shortest_colour(c).alias("major"), X.shortest_colour(F.upper(c), True).alias("every"), X.colour_of(F.when(F.col("p_size") % 2 == 0, "Tan").otherwise("nothing")).alias("named"))


@_query("SELECT p_partkey, chr(CAST(160 + p_partkey % 5000 AS INTEGER)) || 'x&:' AS text FROM part")
def unicode_escapes(t):
    text = F.concat(F.lit("\\"), F.lower(F.hex(160 + F.col("p_partkey") % 5000)), F.lit(" x\\000026\\:"))
    return t("part").select("p_partkey", X.decode_escapes(text).alias("text"))


@_query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '../../img/' || p_partkey || '.png' ELSE 'x/img/a.png' END AS path, CASE WHEN p_size % 2 = 0 THEN '../img/' || p_partkey || '.png' ELSE 'x/img/a.png' END AS below FROM part")
def relative_paths(t):
    path = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("Site\\img\\"), "p_partkey", F.lit(".PNG"))).otherwise("x/img/a.png")
    return t("part").select("p_partkey", X.relative_to(path, F.lit("site/css/main/a.css")).alias("path"), X.relative_to_folder(path, F.lit("site/css")).alias("below"))


@_query("SELECT p_partkey, '/site/' || p_partkey || '/b.css' AS path FROM part")
def full_paths(t):
    return t("part").select("p_partkey", X.full_path(F.lit("/Site\\css"), F.concat(F.lit("./../"), "p_partkey", F.lit("/x/../B.css"))).alias("path"))


@_query("SELECT n_nationkey, 'a{b:' || n_name || ';c:2;d:/*3}' AS css FROM nation")
def comments_replaced(t):
    css = F.lit("a{b:/*[name]*/red;c:/*[none]*/2;d:/*3}")
    return t("nation").select("n_nationkey", X.replace_comments(css, F.create_map(F.lit("name"), F.col("n_name"))).alias("css"))


@_query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 0.0::DOUBLE ELSE CAST(p_size AS DOUBLE) END AS number, CASE p_size % 3 WHEN 0 THEN 'Hacks' WHEN 1 THEN 'Important' END AS enum,
CASE WHEN p_size % 3 <> 0 THEN 'v' END AS text, p_size % 3 = 0 AS blank, CASE WHEN p_size = 25 THEN '0' ELSE CASE WHEN p_size < 25 THEN '-' ELSE '' END || abs(p_size - 25) || '.5em' END AS unit FROM part""")
def parsing_helpers(t):
    s = F.col("p_size")
    text = F.when(s % 3 == 0, "  ").otherwise("v")
    return t("part").select(
        "p_partkey",
        X.parse_float(F.when(s % 3 == 0, "x1").otherwise(F.concat(F.lit(" "), s))).alias("number"),
        X.parse_enum(F.when(s % 3 == 0, "HACKS").when(s % 3 == 1, "important").otherwise("other"), ["Hacks", "Important"]).alias("enum"),
        X.null_if_blank(text).alias("text"),
        X.is_blank(text).alias("blank"),
        X.with_unit(F.when(s == 25, 0).when(s > 25, s - 24.5).otherwise(s - 25.5), "em").alias("unit"),
    )



@_query("SELECT p_partkey, 'a, b, c' AS list, CASE WHEN p_size % 2 = 0 THEN 'even' ELSE 'none' END AS found, CAST(2 AS BIGINT) AS keys FROM part")
def maps_and_lists(t):
    s = F.col("p_size")
    m = X.merged_maps(F.create_map(F.lit("k0"), F.lit("even")), F.create_map(F.lit("x"), F.lit("y")))
    return t("part").select("p_partkey", X.join_but_last(F.array(F.lit("a"), F.lit("b"), F.lit("c")), ", ").alias("list"), X.value_or(m, F.concat(F.lit("k"), s % 2), F.lit("none")).alias("found"), F.size(m).cast("long").alias("keys"))


@_query("""WITH f AS (SELECT n_regionkey, '/* inc/' || n_regionkey || '/' || n_name || '.css */' || chr(10) || 'n' || n_nationkey || chr(10) AS p, lower(n_name) AS o, n_name FROM nation)
SELECT r_regionkey, 'a' || coalesce((SELECT string_agg(p, '' ORDER BY o) FROM f WHERE n_regionkey = r_regionkey), '') || 'b' || coalesce((SELECT string_agg(p, '' ORDER BY o) FROM f WHERE n_regionkey = r_regionkey AND n_name LIKE 'I%'), '') || 'c' AS text FROM region""")
def includes_expanded(t):
    rows = t("region").select("r_regionkey", F.concat(F.lit("awgInclude('inc\\"), "r_regionkey", F.lit("');bwgInclude('inc/"), "r_regionkey", F.lit("', 'I*.css')wgInclude('nothing')c")).alias("text"))
    files = t("nation").select(F.concat(F.lit("inc/"), "n_regionkey", F.lit("/"), "n_name", F.lit(".css")).alias("path"), F.concat(F.lit("n"), "n_nationkey").alias("content"))
    return E.expand_includes(rows, files, "r_regionkey", "text", "path", "content")


@_query("SELECT r_regionkey, (SELECT string_agg('@import \"inc/' || n_regionkey || '/' || n_name || '.scss\";' || chr(10), '' ORDER BY lower(n_name)) FROM nation WHERE n_regionkey = r_regionkey) || 'a{}' AS text FROM region")
def imports_expanded(t):
    rows = t("region").select("r_regionkey", F.concat(F.lit('@imports "inc/'), "r_regionkey", F.lit('/*";a{}')).alias("text"))
    return E.expand_imports(rows, t("nation").select(F.concat(F.lit("inc/"), "n_regionkey", F.lit("/"), "n_name", F.lit(".scss")).alias("path")), "r_regionkey", "text", "path")


@_query("SELECT r_regionkey, CASE WHEN r_regionkey % 2 = 0 THEN upper('a:' || r_regionkey || ';b:%x_y%') ELSE 'a:token(''' || r_regionkey || ''');b:___x_y___' END AS text FROM region")
def engines_in_order(t):
    even = F.col("r_regionkey") % 2 == 0
    engines = [E.Engine("upper", even, lambda d: d.withColumn("text", F.upper("text"))), E.Engine("Sass", even, lambda d: d.withColumn("text", E.sass_tokens(F.col("text"))))]
    rows = t("region").select("r_regionkey", F.concat(F.lit("a:token('"), "r_regionkey", F.lit("');b:___x_y___")).alias("text"))
    return E.Registry(engines).run(rows, ["SASS", "none", "Upper"])


@_query("SELECT p_partkey, p_brand || p_type AS joined, p_brand < p_type AS less, CASE WHEN p_size % 2 <> 0 THEN p_size % 2 ELSE p_partkey END AS either, CASE WHEN p_size % 2 = 0 THEN p_size ELSE p_partkey END AS choice, CAST(-p_size AS DOUBLE) AS minus, CAST(-p_size - 1 AS DOUBLE) AS complement, p_size % 2 = 0 AS neither, p_brand || '-' || p_type AS list FROM part")
def literal_operators(t):
    s, k = F.col("p_size"), F.col("p_partkey")
    return t("part").select("p_partkey", J.fold_text("+", F.col("p_brand"), F.col("p_type")).alias("joined"), J.fold_text("<", F.col("p_brand"), F.col("p_type")).alias("less"), J.fold_logical("||", s % 2, k).alias("either"), J.fold_choice(1 - s % 2, s, k).alias("choice"), J.fold_unary("-", s).alias("minus"), J.fold_unary("~", s).alias("complement"), J.fold_unary("!", s % 2).alias("neither"), J.fold_join(F.array("p_brand", "p_type"), F.lit("-")).alias("list"))


@_query("""SELECT conv_id, string_agg(repeat(';', CAST(turn - coalesce(b, 0) AS BIGINT)) || 'AA' || CASE WHEN turn = coalesce(b, 0) THEN 'A' WHEN turn - coalesce(b, 0) = 1 THEN 'C' ELSE 'E' END || 'A', '' ORDER BY turn) AS mappings FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) GROUP BY 1""")
def source_map_segments(t):
    rows = t("conversations").select("conv_id", F.col("turn").alias("line"), F.lit(0).alias("col"), F.lit(0).alias("source"), F.col("turn").alias("sl"), F.lit(0).alias("sc"))
    return J.segments(rows, "conv_id", "line", "col", "source", "sl", "sc")


def _sheets(t) -> DataFrame:
    css = F.concat(F.lit("/* c */ a , ."), F.translate("p_brand", "#", "-"), F.lit(" > b { margin : "), "p_size", F.lit("px 0 ; color : red ! important } @media print { p { width : calc( 1px + "), "p_size", F.lit("px ) } } "))
    odd = F.when(F.col("p_size") % 3 == 0, "\n } d{e}").otherwise("")
    return t("part").select("p_partkey", F.concat(css, odd).alias("css"))


@_query("""SELECT p_partkey AS sheet, media, CAST(r AS BIGINT) AS rule, replace(selector, '?', replace(p_brand, '#', '-')) AS selector, CAST(k AS BIGINT) AS decl, property, replace(value, '?', CAST(p_size AS VARCHAR)) AS value, important
FROM part, (VALUES (NULL, 1, 'a,.?>b', 0, 'margin', '?px 0', false), (NULL, 1, 'a,.?>b', 1, 'color', 'red', true), ('print', 2, 'p', 0, 'width', 'calc(1px + ?px)', false)) AS v(media, r, selector, k, property, value, important)""")
def sheet_declarations(t):
    return G.declarations(_sheets(t), "p_partkey", "css")


@_query("SELECT p_partkey AS sheet, CAST(2 AS BIGINT) AS line, CAST(c AS BIGINT) AS \"column\", message FROM part, (VALUES (2, 'brace without a block'), (6, 'not a declaration')) AS v(c, message) WHERE p_size % 3 = 0")
def sheet_errors(t):
    return G.errors(_sheets(t), "p_partkey", "css")


@_query("SELECT p_partkey AS sheet, 'a,.' || replace(p_brand, '#', '-') || '>b{margin:' || p_size || 'px 0;color:red!important}@media print{p{width:calc(1px + ' || p_size || 'px)}}' || CASE WHEN p_size % 3 = 0 THEN 'd{}' ELSE '' END AS css FROM part")
def sheet_tolerant(t):
    return G.tolerant(_sheets(t), "p_partkey", "css")


def _scripts(t) -> DataFrame:
    text = F.concat(F.lit("function add ( first , second ) { // c\n var total = first + second , unit = "), "p_size", F.lit(" * 3 ; return total + total / unit }"), F.when(F.col("p_size") % 4 == 0, " )").otherwise(""))
    return t("part").select("p_partkey", text.alias("js"))


@_query("SELECT p_partkey AS script, CASE WHEN p_size % 4 > 0 THEN 'function add(n,t){var i=n+t,r=' || p_size * 3 || chr(59) || 'return i+i/r}' END AS text FROM part")
def scripts_minified(t):
    return N.minify(_scripts(t), "p_partkey", "js")


@_query("SELECT p_partkey AS script, kind, CAST(n + CASE WHEN kind = 'mark' AND p_size % 4 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n FROM part, (VALUES ('mark', 13), ('name', 13), ('number', 2)) AS v(kind, n)")
def script_tokens(t):
    return N.token_counts(_scripts(t), "p_partkey", "js")


@_query("SELECT p_partkey AS script, CAST(2 AS BIGINT) AS line, CAST(length(' var total = first + second , unit = ' || p_size || ' * 3 ; return total + total / unit } )') AS BIGINT) AS \"column\", 'unexpected )' AS message FROM part WHERE p_size % 4 = 0")
def script_errors(t):
    return N.script_errors(_scripts(t), "p_partkey", "js")


@_query(None)
def declarations_shared(t):
    return R.share_declarations(_decls(t).filter("media is null").drop("media"))


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
