"""QUERIES and SQL: operators of the engine on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specloom.functions import display, text, values, web
from specloom.operators import columns, extract, verify
from specloom.operators import relational as rel
from specloom.plans import flows

QUERIES = {}
SQL = {}


def _query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@_query("""SELECT s_suppkey AS supplier_id, s_name AS supplier, coalesce(n_name, 'unknown') AS country, coalesce(r_name, 'unknown') AS region
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def catalog_flatten(spark, d):
    s, n, r = _t(spark, d, "supplier"), _t(spark, d, "nation"), _t(spark, d, "region")
    out = s.join(n, s.s_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
    return out.select(F.col("s_suppkey").alias("supplier_id"), F.col("s_name").alias("supplier"), F.coalesce("n_name", F.lit("unknown")).alias("country"), F.coalesce("r_name", F.lit("unknown")).alias("region"))


@_query("""SELECT p_partkey, p_name FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'a') AND contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'brand#1')""")
def search_tokens(spark, d):
    p = _t(spark, d, "part")
    return p.where(text.has_all_tokens(text.search_text("p_name", "p_brand", "p_type"), "a  Brand#1")).select("p_partkey", "p_name")


@_query("""WITH t AS (SELECT c_custkey, max(o_totalprice) AS top FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1)
SELECT c_custkey, top, row_number() OVER (ORDER BY top DESC NULLS LAST, c_custkey) AS pos FROM t""")
def sort_missing_last(spark, d):
    c, o = _t(spark, d, "customer"), _t(spark, d, "orders")
    t = c.select("c_custkey").join(o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("top")), "c_custkey", "left")
    return rel.positions(t, [F.col("top").isNull(), F.coalesce(-F.col("top"), F.lit(0.0)), F.col("c_custkey")], "pos")


@_query("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS pos, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, o_orderkey, pos, greatest(n - 4, 0) AS folded FROM r WHERE pos <= 4""")
def group_topn(spark, d):
    o = _t(spark, d, "orders")
    top = rel.first_rows(o.withColumn("pos", F.lit(0)), ["o_custkey"], F.desc("o_totalprice"), F.col("o_orderkey"), n=4)
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    n = o.groupBy("o_custkey").agg(F.greatest(F.count("*") - 4, F.lit(0)).alias("folded"))
    return top.withColumn("pos", F.row_number().over(w)).join(n, "o_custkey").select("o_custkey", "o_orderkey", "pos", "folded")


@_query("SELECT event_id, event_type, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 2000")
def changes_latest(spark, d):
    return rel.newest(_t(spark, d, "events"), "ts", "event_id").select("event_id", "event_type", "user_id")


@_query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_hash(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.sha256_hex(F.col("text").cast("binary")).alias("sha256"))


_CHAIN = """WITH c AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice AS new, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS old FROM orders),
p AS (SELECT *, CASE WHEN old IS NULL OR new IS NULL THEN false WHEN old = 0 OR new = 0 THEN old = new ELSE (old > 0) = (new > 0) AND new / old BETWEEN 0.5 AND 2 END AS plausible FROM c) """


def _chain(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = _t(spark, d, "orders").withColumn("previous", F.lag("o_totalprice").over(w))
    return o.withColumn("plausible", values.plausible_change(F.col("previous"), F.col("o_totalprice")))


@_query(_CHAIN + "SELECT o_orderkey, plausible FROM p")
def plausible_change(spark, d):
    return _chain(spark, d).select("o_orderkey", "plausible")


@_query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'O')""")
def fk_orphans(spark, d):
    return rel.orphans(_t(spark, d, "lineitem"), "l_orderkey", _t(spark, d, "orders").where("o_orderstatus = 'O'"), "o_orderkey").select("l_orderkey", "l_linenumber")


@_query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return rel.duplicates(_t(spark, d, "orders"), "o_custkey")


@_query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') OR c_mktsegment IS NULL")
def domain_check(spark, d):
    return rel.outside_domain(_t(spark, d, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY"]).select("c_custkey", "c_mktsegment")


@_query("""SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'item') AS slug FROM part""")
def slugify(spark, d):
    return _t(spark, d, "part").select("p_partkey", text.slugify(F.concat_ws(" ", "p_name", "p_type")).alias("slug"))


@_query("""SELECT p_partkey, trim(regexp_replace(p_name || ' ' || p_type, '[^A-Za-z0-9._-]+', '-', 'g'), '-.') || '.pdf' AS file FROM part""")
def safe_filename(spark, d):
    return _t(spark, d, "part").select("p_partkey", text.safe_filename(F.concat(F.lit("a/b/"), F.concat_ws(" ", "p_name", "p_type"))).alias("file"))


@_query(r"""SELECT n_nationkey, CASE WHEN regexp_matches(t, '\bUL\b') THEN 'UL variant' WHEN regexp_matches(t, '\bIEC\b') THEN 'IEC variant' END AS market
FROM (SELECT n_nationkey, n_name || CASE WHEN n_nationkey % 3 = 0 THEN ' (UL)' WHEN n_nationkey % 3 = 1 THEN ' IEC 62109' ELSE ' ULTRA' END AS t FROM nation)""")
def market_from_title(spark, d):
    k = F.col("n_nationkey") % 3
    t = F.concat("n_name", F.when(k == 0, " (UL)").when(k == 1, " IEC 62109").otherwise(" ULTRA"))
    return _t(spark, d, "nation").select("n_nationkey", text.market_from_title(t).alias("market"))


def _weights(spark, d):
    li = _t(spark, d, "lineitem")
    q = F.col("l_quantity").cast("long").cast("string")
    return li.select("l_orderkey", "l_linenumber", F.concat(F.lit("≤ 1,"), F.lpad(q, 3, "0"), F.lit(" kVA / "), q, F.lit(" MVA at "), q, F.lit(" kg")).alias("t"), F.concat(q, F.lit(" – "), (F.col("l_quantity").cast("long") + 10).cast("string"), F.lit(" V")).alias("r"))


_Q = "SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS q FROM lineitem"


@_query(f"SELECT l_orderkey, l_linenumber, '≤1' || lpad(q, 3, '0') AS first_text, CAST('1' || lpad(q, 3, '0') AS DOUBLE) AS first_number, CAST(q AS DOUBLE) AS second_number, 2 AS n FROM ({_Q})")
def number_with_unit(spark, d):
    w = rel.once(_weights(spark, d), "v", values.number_with_unit(F.col("t"), "kVA|MVA"))
    return w.select("l_orderkey", "l_linenumber", F.col("v")[0]["text"].alias("first_text"), F.col("v")[0]["number"].alias("first_number"), F.col("v")[1]["number"].alias("second_number"), F.size("v").alias("n"))


@_query(f"SELECT l_orderkey, l_linenumber, CAST('1' || lpad(q, 3, '0') AS DOUBLE) AS largest, CAST(q AS DOUBLE) AS smallest FROM ({_Q})")
def pick_max(spark, d):
    w = rel.once(_weights(spark, d), "v", values.number_with_unit(F.col("t"), "kVA|MVA"))
    return w.select("l_orderkey", "l_linenumber", values.pick(F.col("v"), F.lit("max"))["number"].alias("largest"), values.pick(F.col("v"), F.lit("min"))["number"].alias("smallest"))


@_query(f"SELECT l_orderkey, l_linenumber, q || '–' || CAST(CAST(q AS BIGINT) + 10 AS VARCHAR) AS range FROM ({_Q})")
def range_value(spark, d):
    w = rel.once(_weights(spark, d), "v", values.range_value(F.col("r"), "V|VDC"))
    return w.select("l_orderkey", "l_linenumber", F.col("v")[0]["text"].alias("range"))


@_query("""SELECT l_orderkey, l_linenumber, CAST(CAST(round(l_extendedprice) AS BIGINT) AS VARCHAR) AS cleaned FROM lineitem""")
def clean_number(spark, d):
    shown = F.concat(F.lit("+"), F.format_number(F.round("l_extendedprice").cast("long"), 0))
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", values.clean_number(shown).alias("cleaned"))


@_query(r"""SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host FROM pages""")
def url_host(spark, d):
    return _t(spark, d, "pages").select("page_id", web.url_host(F.col("url")).alias("host"))


@_query(r"""SELECT page_id, regexp_replace(url, '#.*$', '') AS url FROM pages""")
def canonical_url(spark, d):
    messy = F.concat(F.regexp_replace("url", "^(https?)://([^/?#]*)", "$1://$2:"), F.lit("#top"))
    port = F.when(F.startswith("url", F.lit("https")), F.lit("443")).otherwise(F.lit("80"))
    p = _t(spark, d, "pages").select("page_id", F.regexp_replace(messy, F.lit(r"^(https?://[^/?#]*:)"), F.concat(F.lit("$1"), port)).alias("u"))
    return p.select("page_id", web.canonical_url(F.col("u")).alias("url"))


@_query("""SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS header FROM events""")
def header_fill(spark, d):
    e = _t(spark, d, "events")
    return rel.carry_forward(e, ["user_id"], [F.col("ts"), F.col("event_id")], F.when(F.col("event_type") == "signup", F.col("event_id")), "header").select("event_id", "header")


@_query("""SELECT o_custkey, coalesce(arg_min(o_orderkey, (o_orderdate, o_orderkey)) FILTER (WHERE o_orderpriority = '1-URGENT'), arg_min(o_orderkey, (o_orderdate, o_orderkey))) AS o_orderkey FROM orders GROUP BY 1""")
def dedupe_prefer(spark, d):
    return rel.preferred_rows(_t(spark, d, "orders"), ["o_custkey"], F.col("o_orderpriority") == "1-URGENT", F.col("o_orderdate"), F.col("o_orderkey")).select("o_custkey", "o_orderkey")


@_query("""SELECT event_type, CAST(date_diff('second', max(ts), TIMESTAMP '2024-06-01') > 2 * 24 * 3600 AS BOOLEAN) AS stale, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM events GROUP BY 1""")
def freshness(spark, d):
    e = _t(spark, d, "events").groupBy("event_type").agg(F.max("ts").cast("timestamp").alias("at"))
    return e.select("event_type", display.is_stale(F.col("at"), F.lit(24.0), F.lit("2024-06-01").cast("timestamp")).alias("stale"), F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("last"))


@_query("""SELECT doc_id, CASE WHEN n < 1048576 THEN CAST(round(CAST(n AS DOUBLE) / 1024) AS BIGINT) || ' KB' ELSE printf('%.1f MB', CAST(n AS DOUBLE) / 1048576) END AS size FROM (SELECT doc_id, strlen(text) AS n FROM documents)""")
def size_units(spark, d):
    return _t(spark, d, "documents").select("doc_id", display.file_size(F.octet_length("text")).alias("size"))


@_query("SELECT p_partkey, format('{:,}', p_partkey * 7919) AS text FROM part")
def grouped_digits(spark, d):
    return _t(spark, d, "part").select("p_partkey", display.group_digits((F.col("p_partkey") * 7919).cast("string")).alias("text"))


@_query(_CHAIN + """SELECT o_orderkey, CASE WHEN old = new THEN CASE WHEN o_orderstatus = 'O' THEN 'extracted' ELSE 'confirmed' END WHEN plausible THEN 'updated' ELSE 'needs-check' END AS status FROM p""")
def status_transition(spark, d):
    c = _chain(spark, d)
    outcome = F.when(F.col("previous") == F.col("o_totalprice"), "confirmed").when(F.col("plausible"), "updated").otherwise("needs-check")
    old = F.when(F.col("o_orderstatus") == "O", "extracted").otherwise("reviewed")
    return c.select("o_orderkey", verify.next_status(old, outcome).alias("status"))


_NATURAL = r"array_to_string(list_transform(regexp_extract_all(model, '(\d+|\D+)'), lambda x: CASE WHEN regexp_matches(x, '^\d') THEN lpad(CAST(length(ltrim(x, '0')) AS VARCHAR), 4, '0') || ltrim(x, '0') ELSE lower(x) END), '')"


@_query(f"""WITH k AS (SELECT DISTINCT p_brand || '-' || p_size || CASE WHEN p_size % 5 = 0 THEN '/' || (p_size * 12345678901 + 3) WHEN p_size % 5 = 1 THEN '/00' || p_size ELSE '' END AS model FROM part)
SELECT model, {_NATURAL} AS key, row_number() OVER (ORDER BY {_NATURAL}, model) AS pos FROM k""")
def natural_order(spark, d):
    """Digit runs of up to 13 digits, leading zeros too."""
    size = F.col("p_size").cast("long")
    tail = F.when(size % 5 == 0, F.concat(F.lit("/"), (size * 12345678901 + 3).cast("string"))).when(size % 5 == 1, F.concat(F.lit("/00"), size.cast("string"))).otherwise(F.lit(""))
    m = _t(spark, d, "part").select(F.concat("p_brand", F.lit("-"), size.cast("string"), tail).alias("model")).distinct()
    m = m.withColumn("key", text.natural_key(F.col("model")))
    return rel.positions(m, [F.col("key"), F.col("model")], "pos")


@_query("""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"[^>]*>[^<]*</a>', 1)) AS h FROM pages)
SELECT page_id, count(DISTINCT CASE WHEN h LIKE '/%' THEN regexp_extract(url, '^[a-z]+://[^/?#]*') || h ELSE h END) AS n_links,
  min(CASE WHEN h LIKE '/%' THEN regexp_extract(url, '^[a-z]+://[^/?#]*') || h ELSE h END) AS first_link FROM l GROUP BY 1""".replace("\\\\", "\\"))
def link_extract(spark, d):
    return web.anchors(_t(spark, d, "pages"), "page_id", "url", "html").groupBy("page_id").agg(F.count_distinct("url").alias("n_links"), F.min("url").alias("first_link"))


@_query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
SELECT doc_id, line_no, len(c) AS n_cells, c[1] AS first_cell, length(line) - length(ltrim(line, ' ')) AS first_at FROM (SELECT doc_id, line_no, replace(line, chr(9), '    ') AS line, regexp_extract_all(replace(line, chr(9), '    '), '[^ ]+(?: [^ ]+)*') AS c FROM l) WHERE len(c) > 0""")
def cell_split(spark, d):
    lines = _t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    cells = rel.once(lines.select("doc_id", (F.col("p") + 1).cast("long").alias("line_no"), "line"), "c", extract.placed_cells(F.col("line")))
    return cells.where(F.size("c") > 0).select("doc_id", "line_no", F.size("c").cast("long").alias("n_cells"), F.col("c")[0]["text"].alias("first_cell"), F.col("c")[0]["start"].cast("long").alias("first_at"))


@_query("""WITH RECURSIVE o AS (SELECT l_orderkey, list(l_linenumber * 20 + l_quantity / 10 ORDER BY l_linenumber * 20 + l_quantity / 10) AS x, max(l_linenumber) + 1 AS n FROM lineitem GROUP BY 1),
cut(l_orderkey, i, j, cost, starts, back) AS (SELECT l_orderkey, 0, 0, CAST(0 AS DOUBLE), CAST([] AS INTEGER[]), CAST([] AS INTEGER[]) FROM o
  UNION ALL SELECT c.l_orderkey, c.i + 1, e, c.cost + (o.x[c.i + 1] - (c.j + 1 + e) * 10.0) * (o.x[c.i + 1] - (c.j + 1 + e) * 10.0), list_append(c.starts, c.j), list_prepend(c.j, c.back)
  FROM cut c JOIN o USING (l_orderkey), LATERAL (SELECT unnest(generate_series(c.j + 1, CASE WHEN c.i + 1 = len(o.x) THEN o.n ELSE o.n - (len(o.x) - c.i - 1) END)) AS e) t WHERE c.i < len(o.x) AND (c.i + 1 < len(o.x) OR e = o.n)),
best AS (SELECT c.l_orderkey, arg_min(c.starts, (c.cost, c.back)) AS starts, any_value(o.n) AS n, any_value(o.x) AS x FROM cut c JOIN o USING (l_orderkey) WHERE c.i = len(o.x) AND c.j = o.n AND len(o.x) <= o.n GROUP BY 1),
both_ AS (SELECT *, list_transform(generate_series(1, len(starts)), lambda k: CASE WHEN k < len(starts) THEN starts[k + 1] - 1 ELSE n - 1 END) AS lasts FROM best)
SELECT l_orderkey, array_to_string(starts, ',') AS firsts, array_to_string(lasts, ',') AS lasts FROM both_
WHERE list_bool_and(list_transform(generate_series(1, len(starts)), lambda k: x[k] >= (starts[k] + 1) * 20.0 - 20.0 AND x[k] <= (lasts[k] + 1) * 20.0 + 20.0))""")
def assign_columns(spark, d):
    """The SQL tries all cuts of the columns."""
    li = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.col("l_linenumber") * 20 + F.col("l_quantity") / 10)).alias("cells"), (F.max("l_linenumber") + 1).alias("n"))
    li = li.select("l_orderkey", "cells", F.transform(F.sequence(F.lit(1), F.col("n")), lambda x: x * 20.0).alias("centers"))
    out = columns.assign_columns(li, ["l_orderkey"], "cells", "centers")
    return out.select("l_orderkey", F.array_join(F.transform("firsts", lambda x: x.cast("string")), ",").alias("firsts"), F.array_join(F.transform("lasts", lambda x: x.cast("string")), ",").alias("lasts"))


_TAKEN = """WITH p AS (SELECT p_partkey, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '-') AS base FROM part),
held AS (SELECT DISTINCT base || CASE WHEN p_partkey % 7 = 0 THEN '-' || (2 + p_partkey % 5) ELSE '' END AS id, base, CASE WHEN p_partkey % 7 = 0 THEN 2 + p_partkey % 5 ELSE 1 END AS n FROM p WHERE p_partkey % 7 < 2),
fresh AS (SELECT p_partkey, base, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS j FROM p WHERE p_partkey % 7 >= 2),
free AS (SELECT base, n, row_number() OVER (PARTITION BY base ORDER BY n) AS j FROM (SELECT b.base, unnest(generate_series(1, b.m + 7)) AS n FROM (SELECT base, max(j) AS m FROM fresh GROUP BY 1) b) g
  WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.base = g.base AND h.n = g.n)) """


@_query(_TAKEN + """SELECT p_partkey, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS id FROM fresh JOIN free USING (base, j)""")
def unique_document_ids(spark, d):
    """Some ids are taken, with holes in their numbers."""
    p = _t(spark, d, "part").select("p_partkey", text.ascii_slug(F.col("p_type")).alias("base"))
    k = F.col("p_partkey") % 7
    taken = p.where(k < 2).select(F.when(k == 0, F.concat_ws("-", "base", (F.col("p_partkey") % 5 + 2).cast("string"))).otherwise(F.col("base")).alias("id")).distinct()
    return rel.unique_ids(p.where(k >= 2), "base", "p_partkey", taken).select("p_partkey", "id")


QUERIES |= flows.QUERIES
SQL |= flows.SQL
