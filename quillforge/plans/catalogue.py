"""The query catalogue: each behaviour of the engine as a query on the standard tables, beside an equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import script as J
from ..functions.css import minify
from ..operators import corpus as C
from ..operators import sprites as P
from . import builds

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"), spark)

        _QUERIES[f.__name__] = run
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


@_query("SELECT doc_id, substr(h, 1, 2) || '/' || substr(h, 3) || '.txt' AS path FROM (SELECT doc_id, md5(coalesce(text, '')) AS h FROM documents)")
def hash_path(t, spark):
    return t("documents").select("doc_id", S.hash_path(F.col("text")).alias("path"))


@_query("""SELECT substr(h, 1, 2) || '/' || substr(h, 3) || '.txt' AS output, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS inputs, count(*) AS n_inputs
FROM (SELECT md5(coalesce(text, '')) AS h, doc_id FROM documents) GROUP BY 1""")
def manifest(t, spark):
    return C.manifest(t("documents"), S.hash_path(F.col("text")), F.col("doc_id"))


@_query("SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def dedup_first(t, spark):
    docs = t("documents").select("doc_id", "lang", "source", F.md5("text").alias("h"))
    return C.first_by(docs, ["h"], [F.col("doc_id")]).drop("h")


@_query(r"""SELECT conv_id, string_agg(p, '' ORDER BY turn) || chr(10) AS bundle FROM (
SELECT conv_id, turn, chr(10) || chr(10) || CASE WHEN b IS NOT NULL AND NOT regexp_matches(b, ';\s*$') THEN ';' ELSE '' END || coalesce(text, '') AS p
FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations)) GROUP BY conv_id""")
def bundle_semicolon(t, spark):
    return C.bundle(t("conversations"), "conv_id", "turn", "text", True)


@_query("SELECT r_name, n_name, dpi FROM region, nation, (VALUES (1.0), (1.5), (2.0)) AS v(d), LATERAL (SELECT 'Resolution' || replace(CASE d WHEN 1.0 THEN '1' WHEN 1.5 THEN '1.5' ELSE '2' END, '.', '') || 'X' AS dpi)")
def pivot_cross(t, spark):
    dpi = spark.createDataFrame([(1.0,), (1.5,), (2.0,)], "d double").select(S.dpi_name(F.col("d")).alias("dpi"))
    return t("region").select("r_name").crossJoin(t("nation").select("n_name")).crossJoin(dpi)  # variants: a few groups of a few keys each


@_query("""SELECT token, value FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY layer DESC) AS r FROM (
SELECT n_name AS token, 'base' || n_regionkey AS value, 0 AS layer FROM nation UNION ALL
SELECT n_name, 'feature' || n_nationkey, -1 FROM nation WHERE n_nationkey % 2 = 0 UNION ALL
SELECT n_name, 'site' || n_nationkey, 1002 FROM nation WHERE n_nationkey % 3 = 0)) WHERE r = 1""")
def precedence_merge(t, spark):
    n = t("nation")
    rows = lambda p, c: n.select(F.col("n_name").alias("token"), F.concat(F.lit(p), F.col(c).cast("string")).alias("value"), "n_nationkey")
    layers = [(rows("base", "n_regionkey"), False), (rows("feature", "n_nationkey").filter("n_nationkey % 2 = 0"), False), (rows("site", "n_nationkey").filter("n_nationkey % 3 = 0"), True)]
    return C.precedence(layers, ["token"]).select("token", "value")


@_query("""SELECT l_orderkey, l_returnflag, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag
ORDER BY l_linestatus = 'O' DESC, l_linenumber DESC, l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS r FROM lineitem) WHERE r = 1""")
def last_wins(t, spark):
    order = [F.col(c) for c in ("l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")]
    return C.last_wins(t("lineitem"), ["l_orderkey", "l_returnflag"], F.col("l_linestatus") == "O", order).select("l_orderkey", "l_returnflag", "l_extendedprice")


@_query("""WITH v AS (SELECT n_regionkey AS k, n_name AS variant, string_agg(tok || '=' || val, ';' ORDER BY tok) AS f FROM (
SELECT n_regionkey, n_name, 'a' AS tok, CAST(n_nationkey % 2 AS VARCHAR) AS val FROM nation UNION ALL SELECT n_regionkey, n_name, 'b', CAST(length(n_name) % 2 AS VARCHAR) FROM nation) GROUP BY 1, 2)
SELECT k, string_agg(variant, ',' ORDER BY variant) AS variants, count(*) AS n_variants FROM v GROUP BY k, f""")
def variant_collapse(t, spark):
    n = t("nation")
    a = n.select(F.col("n_regionkey").alias("k"), F.col("n_name").alias("variant"), F.lit("a").alias("tok"), (F.col("n_nationkey") % 2).cast("string").alias("val"))
    b = n.select(F.col("n_regionkey").alias("k"), F.col("n_name").alias("variant"), F.lit("b").alias("tok"), (F.length("n_name") % 2).cast("string").alias("val"))
    return C.collapse_variants(a.unionByName(b), "k", "variant", "tok", "val").drop("fingerprint")


@_query("""WITH d AS (SELECT DISTINCT l_orderkey AS r, l_partkey AS p, l_returnflag AS v FROM lineitem), z AS (SELECT r, count(*) AS n FROM d GROUP BY r),
j AS (SELECT a.r AS a, b.r AS b, count(*) AS shared FROM d a JOIN d b ON a.p = b.p AND a.v = b.v AND a.r < b.r GROUP BY 1, 2)
SELECT a, b, shared FROM j JOIN z x ON x.r = a JOIN z y ON y.r = b WHERE shared >= 2 OR (shared = 1 AND (x.n = 1 OR y.n = 1))""")
def shared_decl_pairs(t, spark):
    d = t("lineitem").select(F.col("l_orderkey").alias("r"), F.col("l_partkey").alias("p"), F.col("l_returnflag").alias("v"))
    return C.shared_pairs(d, "r", ["p", "v"])


@_query("""SELECT p_partkey, array_to_string(list_filter(s, lambda x: NOT (contains(x, 'STEEL') OR contains(x, '#1'))), ',') AS selectors
FROM (SELECT p_partkey, string_split(p_type || ',' || p_brand, ',') AS s FROM part) WHERE len(list_filter(s, lambda x: NOT (contains(x, 'STEEL') OR contains(x, '#1')))) > 0""")
def selector_ban(t, spark):
    rows = t("part").select("p_partkey", F.concat_ws(",", "p_type", "p_brand").alias("selectors"))
    return C.ban_substrings(rows, "selectors", ["STEEL", "#1"])


@_query("""SELECT p_partkey, p_brand, CASE WHEN p_partkey % 3 = 0 THEN mx - p_size WHEN p_partkey % 3 = 1 THEN (mx - p_size + 1) // 2 ELSE 0 END AS x,
-coalesce(sum(p_size + 50) OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS y, mx AS sprite_width
FROM (SELECT *, CAST(max(p_size) OVER (PARTITION BY p_brand) AS BIGINT) AS mx FROM part)""")
def sprite_offsets(t, spark):
    side = F.when(F.col("p_partkey") % 3 == 0, "Right").when(F.col("p_partkey") % 3 == 1, "Center").otherwise("Left")
    return C.pack_vertical(t("part").withColumn("side", side), "p_brand", "p_size", "p_size", "side", "p_partkey").select("p_partkey", "p_brand", "x", "y", "sprite_width")


@_query("""SELECT p_partkey, '#' || lower(lpad(to_hex(p_partkey % 256), 2, '0') || lpad(to_hex(p_size), 2, '0') || lpad(to_hex((p_partkey * 17) % 256), 2, '0')) AS colour,
CASE WHEN h[2] = h[3] AND h[4] = h[5] AND h[6] = h[7] THEN '#' || h[2] || h[4] || h[6] ELSE h END AS short
FROM (SELECT *, '#' || lower(lpad(to_hex((p_partkey * 17) % 16777216), 6, '0')) AS h FROM part)""")
def colours(t, spark):
    k = F.col("p_partkey")
    long = F.concat(F.lit("#"), F.lower(F.lpad(F.hex(k * 17 % 16777216), 6, "0")))
    return t("part").select("p_partkey", S.rgb_to_hex(k % 256, F.col("p_size"), k * 17 % 256).alias("colour"), S.collapse_hex(long).alias("short"))


@_query("SELECT p_partkey, CAST(round_even(p_size / 100.0::DOUBLE * 255.0::DOUBLE, 0) AS INTEGER) AS channel, CAST(least(greatest(round_even(p_retailprice - 1000, 0), 0), 255) AS INTEGER) AS clamped FROM part")
def pct_bround(t, spark):
    return t("part").select("p_partkey", S.percent_channel(F.col("p_size")).alias("channel"), S.clamp_channel(F.col("p_retailprice") - 1000).alias("clamped"))


@_query(r"""SELECT p_partkey, CASE WHEN z THEN '0' || CASE WHEN u = 's' THEN 's' ELSE '' END ELSE w || CASE WHEN f <> '' THEN '.' || f ELSE '' END || u END AS value FROM (
SELECT p_partkey, u, ltrim(CAST(p_size % 7 AS VARCHAR), '0') AS w, rtrim(lpad(CAST(p_partkey % 4 * 250 AS VARCHAR), 3, '0'), '0') AS f, p_size % 7 = 0 AND p_partkey % 4 = 0 AS z
FROM (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN 'px' ELSE 's' END AS u FROM part))""")
def float_trim(t, spark):
    k = F.col("p_partkey")
    text = F.concat(F.lit("00"), (F.col("p_size") % 7).cast("string"), F.lit("."), F.lpad((k % 4 * 250).cast("string"), 3, "0"), F.lit("00"), F.when(k % 2 == 0, "px").otherwise("s"))
    return t("part").select("p_partkey", S.trim_number(text).alias("value"))


@_query("SELECT n_nationkey, 'x ' || upper(n_name) || ' %none% y ' || n_regionkey AS text FROM nation")
def token_expand(t, spark):
    text = F.lit("x %Name% %none% y %region:d%")
    values = F.create_map(F.lit("name"), F.upper("n_name"), F.lit("region"), F.col("n_regionkey").cast("string"))
    return t("nation").select("n_nationkey", S.expand_tokens(text, values).alias("text"))


@_query("SELECT page_id, lower(ltrim(replace(url, '\\', '/'), '/')) AS url FROM pages")
def normalize_url(t, spark):
    return t("pages").select("page_id", S.normalize_url(F.concat(F.lit("'hash(/"), "url", F.lit(")'"))).alias("url"))


@_query("SELECT page_id, 'p' AS selector, 'margin' AS property, '0' AS value FROM pages WHERE contains(html, '<style>p{margin:0}</style>')")
def style_decl(t, spark):
    css = F.regexp_extract("html", "(?s)<style>(.*?)</style>", 1)
    rules = F.explode(F.regexp_extract_all(css, F.lit(r"([^{}]+\{[^{}]*\})"), F.lit(1)))
    rows = t("pages").select("page_id", rules.alias("rule"))
    decl = F.explode(F.split(F.regexp_extract("rule", r"\{([^{}]*)\}", 1), ";"))
    rows = rows.select("page_id", F.trim(F.split("rule", r"\{")[0]).alias("selector"), decl.alias("d")).filter("trim(d) <> ''")
    return rows.select("page_id", "selector", F.trim(F.split("d", ":")[0]).alias("property"), F.trim(F.split("d", ":")[1]).alias("value"))


@_query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def props_extract(t, spark):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@_query("SELECT event_type, n, total, round(100 * total / sum(total) OVER (), 4) AS percent, round(total / n, 4) AS mean FROM (SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1)")
def measure_report(t, spark):
    return C.measure_report(t("events"), "event_type", "value")


@_query("SELECT event_type, user_id % 10 AS part, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ROLLUP (event_type, user_id % 10)")
def measure_rollup(t, spark):
    return t("events").withColumn("part", F.col("user_id") % 10).rollup("event_type", "part").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"))


@_query("""SELECT doc_id, CASE WHEN b.h IS NULL THEN 'added' WHEN a.h IS NULL THEN 'removed' WHEN a.h <> b.h THEN 'changed' ELSE 'same' END AS status
FROM (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 5 <> 0) b FULL JOIN (SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN text || 'x' ELSE text END) AS h FROM documents WHERE doc_id % 7 <> 0) a USING (doc_id)""")
def snapshot_diff(t, spark):
    d = t("documents")
    was = d.filter("doc_id % 5 <> 0").select("doc_id", F.md5("text").alias("h"))
    now = d.filter("doc_id % 7 <> 0").select("doc_id", F.md5(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))).alias("h"))
    return C.snapshot_diff(was, now, "doc_id", "h")


@_query("SELECT event_type, user_id, n, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, f, user_id) AS place FROM (SELECT event_type, user_id, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2)")
def freq_rank(t, spark):
    g = t("events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("f"))
    return g.select("event_type", "user_id", "n", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("n"), "f", "user_id")).alias("place"))


@_query("""WITH f AS (SELECT l_orderkey AS k, list_sort(list_distinct(list(l_returnflag))) AS a, list_sort(list_distinct(list(l_linestatus))) AS b FROM lineitem GROUP BY 1)
SELECT k, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS all_of, array_to_string(list_filter(a, lambda x: NOT list_contains(b, x)), ',') AS only_a, array_to_string(list_filter(a, lambda x: list_contains(b, x)), ',') AS both_of FROM f""")
def selector_sets(t, spark):
    f = t("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set("l_returnflag").alias("a"), F.collect_set("l_linestatus").alias("b"))
    text = lambda x: F.array_join(F.array_sort(x), ",")
    return f.select("k", text(F.array_union("a", "b")).alias("all_of"), text(F.array_except("a", "b")).alias("only_a"), text(F.array_intersect("a", "b")).alias("both_of"))


@_query("SELECT count(DISTINCT p_partkey * 17 % 16777216) AS colours, count(DISTINCT p_partkey * 17 % 16777216) <= 256 AS indexable FROM part")
def distinct_colours(t, spark):
    n = F.countDistinct(F.col("p_partkey") * 17 % 16777216)
    return t("part").agg(n.alias("colours"), (n <= 256).alias("indexable"))


@_query("SELECT p_partkey, '.' || replace(p_brand, '#', '-') || '>a,b{margin:' || p_size || '.5px' || chr(59) || 'color:#abc!important}@media screen and (width:1px){p{top:0}}' AS css FROM part")
def css_minify(t, spark):
    css = F.concat(F.lit("/* c */ ."), F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit(" > a , b { margin : 0"), F.col("p_size"), F.lit(".50px ; color : #AABBCC ! important ; } @media screen and ( width : 1px ) { p { top : 0px } }"))
    return t("part").select("p_partkey", minify(css).alias("css"))


@_query("""SELECT p_partkey, CASE WHEN i < 21 THEN substr(a, i + 1, 1)
WHEN i < 462 THEN substr(a, i % 21 + 1, 1) || substr(b, (i - 21) // 21 + 1, 1)
WHEN i < 9723 THEN substr(a, i % 21 + 1, 1) || substr(b, (i // 21 - 1) % 21 + 1, 1) || substr(b, (i // 21 - 1) // 21, 1)
ELSE substr(a, i % 21 + 1, 1) || substr(b, (i // 21 - 1) % 21 + 1, 1) || substr(b, ((i // 21 - 1) // 21 - 1) % 21 + 1, 1) || substr(b, ((i // 21 - 1) // 21 - 1) // 21, 1) END AS name
FROM (SELECT p_partkey, p_partkey - 1 AS i, 'ntirufeoshclavypwbkdg' AS a, 'tirufeoshclavypwbkdgn' AS b FROM part)""")
def short_names(t, spark):
    return t("part").select("p_partkey", J.short_name(F.col("p_partkey") - 1).alias("name"))


@_query("""WITH v AS (SELECT p_partkey, abs(n) * 2 + CASE WHEN n < 0 THEN 1 ELSE 0 END AS v FROM (SELECT p_partkey, (p_partkey - 100) * p_size AS n FROM part)),
d AS (SELECT p_partkey, v, CASE WHEN v = 0 THEN 0 ELSE (length(bin(v)) - 1) // 5 END AS last FROM v)
SELECT p_partkey, array_to_string(list_transform(range(0, last + 1), lambda p: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/', CAST(((v >> CAST(5 * p AS BIGINT)) & 31) + CASE WHEN p < last THEN 33 ELSE 1 END AS BIGINT), 1)), '') AS code FROM d""")
def source_map_numbers(t, spark):
    return t("part").select("p_partkey", J.vlq((F.col("p_partkey") - 100) * F.col("p_size")).alias("code"))


@_query("SELECT event_id, replace(props, ' ', '') AS packed FROM events")
def json_pack(t, spark):
    return t("events").select("event_id", J.json_text(F.col("props")).alias("packed"))


@_query("""SELECT p_partkey, CAST(p_partkey + p_size AS DOUBLE) AS plus, CAST(p_partkey AS DOUBLE) / nullif(p_size % 3, 0) AS quotient, CAST(p_partkey & p_size AS DOUBLE) AS both,
CAST(p_partkey >> (p_size % 8) AS DOUBLE) AS shifted, p_partkey < p_size AS less FROM part""")
def literal_folds(t, spark):
    k, s = F.col("p_partkey"), F.col("p_size")
    return t("part").select("p_partkey", J.fold("+", k, s).alias("plus"), J.fold("/", k, s % 3).alias("quotient"), J.fold("&", k, s).alias("both"), J.fold(">>", k, s % 8).alias("shifted"), J.fold("<", k, s).alias("less"))


@_query("""SELECT p_partkey, CASE WHEN p_size % 7 > 1 AND p_size % 7 < 4 THEN 'MultipleUrls' WHEN p_size % 11 = 0 THEN 'SpritingIgnore' WHEN p_size % 7 = 0 THEN 'NoUrl'
WHEN p_size % 2 = 0 THEN CASE WHEN p_size % 3 <> 0 THEN 'BackgroundRepeatInvalid' WHEN NOT (p_partkey % 5 = 0 OR p_size > 25) THEN 'IncorrectPosition' END
ELSE CASE WHEN p_size % 5 = 0 THEN 'NoRepeat' WHEN p_size % 3 <> 0 THEN 'BackgroundRepeatInvalid' WHEN NOT (p_partkey % 5 = 0 OR p_size > 25) THEN 'IncorrectPosition' END END AS reason FROM part""")
def sprite_candidates(t, spark):
    k, s = F.col("p_partkey"), F.col("p_size")
    urls = F.when((s % 7 > 1) & (s % 7 < 4), 2).when(s % 7 == 0, 0).otherwise(1)
    repeat = F.when((s % 2 == 1) & (s % 5 == 0), F.lit(None)).when(s % 3 == 0, "no-repeat").otherwise("repeat")
    vertical = P.vertical_candidate(F.lit(0), F.lit("px"), k % 5, F.when(s > 25, "px").otherwise("%"))
    reason = P.failure_reason(urls, s % 11 == 0, s % 2 == 0, s % 2 == 1, F.lit(False), repeat, F.lit(True), vertical)
    return t("part").select("p_partkey", reason.alias("reason"))


def queries() -> dict:
    return _QUERIES | builds.queries()


def oracle_sql() -> dict[str, str]:
    return _SQL | builds.oracle_sql()
