"""Whole operators on catalogs made from the driver's tables: extraction, rechecks, discovery, locating, the views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.functions import display, text, values, web
from specloom.operators import catalog as cat
from specloom.operators import extract, locate, publish, validate, verify
from specloom.plans import query
from specloom.schemas import CHANGES, DOCUMENTS, FIELDS, MODELS, SPECS, SUPPLIERS
from specloom.streaming import passes

QUERIES = {}
SQL = {}


def _query(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        SQL[fn.__name__] = sql
        return fn

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _as(df: DataFrame, schema) -> DataFrame:
    """df with all columns of a table's schema; those it lacks are null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def _empty(spark: SparkSession, schema) -> DataFrame:
    return spark.createDataFrame([], schema)


@_query("""WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS document, p_size * 10 AS kva, p_size + 900 AS v, p_brand, p_partkey FROM part)
SELECT document, 'rated_kva' AS field, CAST(kva AS VARCHAR) AS value, CAST(kva AS DOUBLE) AS numeric FROM p
UNION ALL SELECT document, 'dc_max_v', CAST(v AS VARCHAR), CAST(v AS DOUBLE) FROM p
UNION ALL SELECT document, 'cooling', p_brand, NULL FROM p
UNION ALL SELECT document, 'weight_kg', CAST(p_partkey AS VARCHAR), CAST(p_partkey AS DOUBLE) FROM p""")
def extract_values(spark, d):
    s = lambda c: c.cast("string")
    text = F.concat(F.lit("Rated power      "), s(F.col("p_size") * 10), F.lit(" kVA\nMaximum DC voltage     "), s(F.col("p_size") + 900), F.lit(" V\nCooling     "), F.col("p_brand"), F.lit("\nWeight (kg)      "), s(F.col("p_partkey")), F.lit("\n"))
    pages = _t(spark, d, "part").select(s(F.col("p_partkey")).alias("document"), F.lit(1).alias("page"), text.alias("text"))
    return extract.candidates(pages).select("document", "field", "value", "numeric")


_RECHECK = """SELECT CAST(p_partkey AS VARCHAR) AS id,
CASE p_partkey % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'updated' ELSE 'needs-check' END AS status,
CAST(p_size * 10 + CASE p_partkey % 4 WHEN 1 THEN 1 ELSE 0 END AS VARCHAR) AS value,
CAST(p_size * 10 + CASE p_partkey % 4 WHEN 1 THEN 1 ELSE 0 END AS DOUBLE) AS numeric,
CAST(CASE WHEN p_partkey % 4 < 2 THEN 1 ELSE 7 END AS BIGINT) AS page FROM part"""


@_query(_RECHECK)
def recheck_values(spark, d):
    k, v = F.col("p_partkey"), F.col("p_size") * 10
    line = lambda label, n: F.concat(F.lit(f"other 1 V\n{label}   "), n.cast("string"), F.lit("  kVA\nmore"))
    new = F.when(k % 4 == 0, line("RATED  power", v)).when(k % 4 == 1, line("Rated power", v + 1)).when(k % 4 == 2, line("Rated power", v * 5)).otherwise(line("Nominal power", v))
    p = _t(spark, d, "part")
    key = k.cast("string")
    specs = p.select(key.alias("id"), key.alias("document"), v.cast("string").alias("value"), v.cast("double").alias("numeric"), F.lit(7).cast("long").alias("page"), F.concat(F.lit("Rated power "), v.cast("string"), F.lit(" kVA")).alias("evidence"), F.lit(None).cast("string").alias("anchor"))
    pages = p.select(key.alias("document"), F.lit(1).alias("page"), F.lit(0).alias("variant"), new.alias("text"))
    return verify.recheck_quoted(specs, pages).select("id", "status", "value", "numeric", "page")


@_query("""WITH t AS (SELECT p_brand, min(p_partkey) AS first FROM part GROUP BY 1), known AS (SELECT DISTINCT p_brand FROM part WHERE p_size > 48)
SELECT CAST(p.p_partkey AS VARCHAR) AS document, CASE WHEN known.p_brand IS NULL THEN 'maker-' || lower(replace(p.p_brand, '#', '-')) ELSE p.p_brand END AS product
FROM part p LEFT JOIN known USING (p_brand)""")
def resolve_models(spark, d):
    """Brands are model tokens; those of the largest parts are products already, the others are discovered."""
    p = _t(spark, d, "part")
    key = F.col("p_partkey").cast("string")
    cands = p.select(key.alias("document"), F.col("p_brand").alias("model"), F.lit("f").alias("field"), F.lit(1).alias("ord"))
    docs = p.select(key.alias("id"), F.lit("maker").alias("supplier"), F.lit("family").alias("product"), F.col("p_name").alias("title"), F.col("p_partkey").alias("ord"))
    known = p.where("p_size > 48").select("p_brand").distinct()
    products = known.select(F.col("p_brand").alias("id"), F.lit("maker").alias("supplier"), F.concat(F.lit("The "), "p_brand").alias("model"), F.lit("Inverter").alias("kind"), F.lit(1).alias("ord"))
    suppliers = spark.createDataFrame([("maker", "Maker")], "id string, name string")
    resolved, _ = publish.resolve(cands, docs, products, suppliers, F.lit("2024-01-01"))
    return resolved.select("document", "product")


@_query("""SELECT CAST(c_custkey AS VARCHAR) AS id, round(CAST(48.5 AS DOUBLE) / 600, 4) AS x0, round((c_custkey % 500 + 98.5) / 800, 4) AS y0,
round((CAST(200 AS DOUBLE) + length(c_name) + 1.5) / 600, 4) AS x1, round((c_custkey % 500 + 111.5) / 800, 4) AS y1 FROM customer""")
def locate_rows(spark, d):
    c = _t(spark, d, "customer")
    key, y = F.col("c_custkey").cast("string"), (F.col("c_custkey") % 500 + 100).cast("double")
    line = lambda n, x0, y0, x1, text: F.struct(F.lit(n).alias("line_no"), x0.cast("double").alias("x0"), y0.alias("y0"), x1.cast("double").alias("x1"), (y0 + 10).alias("y1"), text.alias("text"))
    at = F.array(line(0, F.lit(50), y, F.lit(120), F.lit("Name of customer")), line(1, F.lit(200), y, F.lit(200) + F.length("c_name"), F.col("c_name")), line(2, F.lit(50), y + 100, F.lit(90), F.lit("Something else")))
    lines = c.select(key.alias("document"), F.lit(1).alias("page"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"), F.inline(at))
    specs = c.select(key.alias("id"), key.alias("document"), F.lit(1).alias("page"), F.col("c_name").alias("value"), F.concat(F.lit("Name of customer — A: "), "c_name").alias("evidence"), F.lit(None).cast("string").alias("model"))
    got = locate.locate(specs, lines)
    return got.select("id", *[F.get("row", F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


def _code(kind: str, key):
    """Two capital letters of a small number."""
    return F.concat(F.lit(kind), F.chr(key + 65))


def _catalog(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Nations as makers, suppliers as their products; a value of each is the whole part of its balance, every third is reviewed.

    A maker's country is A and its number, its parent's R and that of its region.
    """
    s = _t(spark, d, "supplier").join(_t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    makers = s.groupBy("n_nationkey", "n_regionkey", F.col("n_name").alias("id")).agg(F.sort_array(F.collect_list(F.struct(F.col("s_name").alias("id"), F.col("s_name").alias("model"), F.lit("Inverter").alias("kind")))).alias("ps"))
    blank = {"summary": None, "market": None, "notes": None, "family": None}
    product = SUPPLIERS["products"].dataType.elementType
    company = SUPPLIERS["company"].dataType
    full = F.transform("ps", lambda p: F.struct(*[(p[f.name] if f.name in ("id", "model", "kind") else F.lit(blank.get(f.name))).cast(f.dataType).alias(f.name) for f in product.fields]))
    parent = F.struct(*[{"country": _code("R", F.col("n_regionkey")), "name": F.lit("Owner")}.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in company["parent"].dataType.fields])
    own = F.struct(*[{"hq_country": _code("A", F.col("n_nationkey")), "parent": parent}.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in company.fields])
    suppliers = _as(makers.select("id", F.col("id").alias("name"), full.alias("products"), own.alias("company")), SUPPLIERS)
    value = F.floor(F.abs("s_acctbal")).cast("long")
    specs = s.select(F.concat("s_name", F.lit(":rated_kva")).alias("id"), F.col("s_name").alias("product"), F.lit("rated_kva").alias("field"), value.cast("string").alias("value"), value.cast("double").alias("numeric"), F.when(F.col("s_suppkey") % 3 == 0, "reviewed").otherwise("extracted").alias("status"))
    fields = spark.createDataFrame([("rated_kva", "Rated power", "kVA", "number", "Power", None)], FIELDS).withColumn("ord", F.lit(0))
    return {"suppliers": suppliers, "models": _empty(spark, MODELS), "fields": fields, "documents": _empty(spark, DOCUMENTS), "specs": _as(specs, SPECS), "changes": _empty(spark, CHANGES)}


_MAKERS = """WITH s AS (SELECT s_name AS id, n_name AS group_key, s_suppkey % 3 = 0 AS reviewed, CAST(floor(abs(s_acctbal)) AS BIGINT) AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT id, group_key, CAST(row_number() OVER (PARTITION BY group_key ORDER BY {order}) AS INTEGER) AS entry_no, CASE WHEN reviewed THEN 'Reviewed' ELSE 'Auto-read' END AS pill,
'Inverter' AS subline, CASE WHEN v >= 1000 THEN (v // 1000) || ',' || lpad(CAST(v % 1000 AS VARCHAR), 3, '0') ELSE CAST(v AS VARCHAR) END || ' kVA' AS power, {row_no} AS row_no FROM s{where}"""


_GROUPS = _MAKERS.replace(" FROM s{where}", " FROM (SELECT *, sum(CASE WHEN reviewed THEN 1001 ELSE 1 END) OVER (PARTITION BY group_key) AS weight FROM s){where}")


@_query(_GROUPS.format(order="reviewed DESC, id", where="", row_no="row_number() OVER (ORDER BY weight DESC, group_key, reviewed DESC, id)"))
def catalog_view(spark, d):
    return query.catalog(_catalog(spark, d)).select("id", "group_key", "entry_no", "pill", "subline", "power", "row_no")


@_query(_MAKERS.replace("group_key, CAST", "'_all' AS group_key, CAST").replace("PARTITION BY group_key ", "").format(order="v DESC, id", where=" WHERE reviewed", row_no="row_number() OVER (ORDER BY v DESC, id)"))
def catalog_by_column(spark, d):
    spec = query.QuerySpec(sort="power", show="reviewed")
    return query.catalog(_catalog(spark, d), spec).select("id", "group_key", "entry_no", "pill", "subline", "power", "row_no")


_PLACES = "SELECT s_name AS id, n_name AS supplier FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE {no}(n_nationkey IN (3, 7, 11, 19) OR n_regionkey = 3)"
_CODES = ("AD", "AH", "AL", "AT", "RD")


@_query(_PLACES.format(no="NOT "))
def facet_country_hide(spark, d):
    return query.catalog(_catalog(spark, d), query.QuerySpec(countries=_CODES, hide=True)).select("id", "supplier")


@_query(_PLACES.format(no=""))
def facet_country_only(spark, d):
    return query.catalog(_catalog(spark, d), query.QuerySpec(countries=_CODES)).select("id", "supplier")


@_query("""WITH c AS (SELECT DISTINCT n_name, unnest(['A' || chr(65 + n_nationkey), 'R' || chr(65 + n_regionkey)]) AS country FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT country, count(*) AS n_suppliers, string_agg(n_name, ', ' ORDER BY n_name) AS suppliers FROM c GROUP BY 1""")
def country_facet(spark, d):
    return cat.country_facet(_catalog(spark, d)["suppliers"]).select("country", "n_suppliers", F.array_join("suppliers", ", ").alias("suppliers"))


@_query("""SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'reviewed' ELSE 'auto' END AS show, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1
UNION ALL SELECT 'all', count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def facet_counts(spark, d):
    return query.facets(_catalog(spark, d))


@_query("""SELECT s_name AS id, n_name AS supplier, CAST(row_number() OVER (PARTITION BY n_name ORDER BY s_name) AS INTEGER) AS entry_no FROM supplier JOIN nation ON s_nationkey = n_nationkey
WHERE contains(lower(s_name || ' ' || n_name), 'a') AND contains(lower(s_name || ' ' || n_name), '1')""")
def search_and_name_order(spark, d):
    return query.catalog(_catalog(spark, d), query.QuerySpec(q=" A 1 ", sort="name")).select("id", "supplier", "entry_no")


def _family(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Brands as families without values, parts as their members: voltages of two fields, a frequency, power and efficiency of some."""
    p = _t(spark, d, "part")
    product = SUPPLIERS["products"].dataType.elementType
    row = lambda pid, model, family, kind: F.struct(*[{"id": pid, "model": model, "family": family, "kind": kind}.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in product.fields])
    key, k = F.col("p_partkey").cast("string"), F.col("p_partkey")
    parts = p.select(row(key, F.concat(F.lit("M-"), key), F.col("p_brand"), F.lit("Inverter")).alias("p"))
    brands = p.select("p_brand").distinct().select(row(F.col("p_brand"), F.col("p_brand"), F.lit(None), F.lit("Inverter family")).alias("p"))
    suppliers = _as(parts.unionByName(brands).agg(F.lit("maker").alias("id"), F.lit("Maker").alias("name"), F.collect_list("p").alias("products")), SUPPLIERS)
    spec = lambda field, value, number, when: p.where(when).select(F.concat(key, F.lit(":" + field)).alias("id"), key.alias("product"), F.lit(field).alias("field"), value.cast("string").alias("value"), number.cast("double").alias("numeric"), F.lit("extracted").alias("status"), F.concat(F.lit("Rated @ 40 °C "), value.cast("string")).alias("evidence"))
    size = F.col("p_size")
    specs = spec("rated_kva", size * 10, size * 10, k % 2 == 0).unionByName(spec("mv_voltage_kv", size, size, k % 3 == 0)).unionByName(spec("ac_voltage_v", size + 600, size + 600, k % 3 == 1)).unionByName(spec("frequency_hz", size % 2 * 10 + 50, size % 2 * 10 + 50, k % 4 == 0)).unionByName(spec("cooling", F.col("p_brand"), F.lit(None), k % 5 == 0)).unionByName(spec("efficiency_with_mvt_pct", size % 9 + 90, size % 9 + 90, k % 2 == 1))
    rows = [("rated_kva", "Rated power", "kVA", "number", "Power"), ("mv_voltage_kv", "MV", "kV", "number", "AC side"), ("ac_voltage_v", "AC", "V", "number", "AC side"), ("frequency_hz", "Frequency", "Hz", "number", "AC side"), ("efficiency_with_mvt_pct", "Efficiency", "%", "number", "Efficiency"), ("cooling", "Cooling", "", "text", "Build")]
    fields = _as(spark.createDataFrame(rows, "key string, label string, unit string, kind string, group string"), FIELDS).withColumn("ord", F.array_position(F.array(*[F.lit(r[0]) for r in rows]), F.col("key")))
    return {"suppliers": suppliers, "models": _empty(spark, MODELS), "fields": fields, "documents": _empty(spark, DOCUMENTS), "specs": _as(specs, SPECS), "changes": _empty(spark, CHANGES)}


_MEMBERS = """WITH m AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_brand, p_size, CASE WHEN p_partkey % 2 = 0 THEN p_size * 10 END AS kva, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS mv,
  CASE WHEN p_partkey % 3 = 1 THEN p_size + 600 END AS ac, CASE WHEN p_partkey % 4 = 0 THEN p_size % 2 * 10 + 50 END AS hz, CASE WHEN p_partkey % 2 = 1 THEN p_size % 9 + 90 END AS eff, CASE WHEN p_partkey % 5 = 0 THEN p_brand END AS cooling FROM part) """


@_query(_MEMBERS + """SELECT id, p_brand AS entry, true AS is_member, kva || ' kVA @40°C' AS power,
  nullif(concat_ws(', ', coalesce(mv || ' kV', ac || ' V'), hz || ' Hz'), '') AS grid, eff || ' % w/ MVT' AS eff FROM m
UNION ALL SELECT p_brand, p_brand, false, CASE WHEN min(kva) = max(kva) THEN format('{:,}', min(kva)) ELSE format('{:,}', min(kva)) || '-' || format('{:,}', max(kva)) END || ' kVA',
  nullif(concat_ws(', ', CASE WHEN min(mv) = max(mv) THEN min(mv) || ' kV' WHEN min(mv) IS NOT NULL THEN min(mv) || '-' || max(mv) || ' kV' WHEN min(ac) = max(ac) THEN min(ac) || ' V' ELSE min(ac) || '-' || max(ac) || ' V' END,
    CASE WHEN min(hz) = max(hz) THEN min(hz) || ' Hz' ELSE min(hz) || '-' || max(hz) || ' Hz' END), ''),
  CASE WHEN min(eff) = max(eff) THEN '' || min(eff) ELSE min(eff) || '-' || max(eff) END || ' % w/ MVT' FROM m GROUP BY p_brand""")
def families_view(spark, d):
    """Containers with the ranges of their members, which stand under them."""
    return query.catalog(_family(spark, d)).select("id", "entry", "is_member", "power", "grid", "eff")


@_query(_MEMBERS + """, n AS (SELECT p_brand AS id, count(kva) + count(mv) + count(ac) + count(hz) + count(eff) + count(cooling) AS n_specs, count(*) AS members FROM m GROUP BY 1)
SELECT id, members, true AS is_container, CASE WHEN n_specs > 0 THEN 'auto' ELSE 'none' END AS review FROM n
UNION ALL SELECT id, NULL, false, CASE WHEN coalesce(kva, mv, ac, hz, eff) IS NOT NULL OR cooling IS NOT NULL THEN 'auto' ELSE 'none' END FROM m""")
def rolled_review(spark, d):
    return query.models_view(_family(spark, d)).select("id", "members", "is_container", "review")


@_query(_MEMBERS + """, four AS (SELECT * FROM m WHERE id IN ('10', '12', '15', '30')), u AS (
  SELECT id, 'rated_kva' AS field, format('{:,}', kva) || ' kVA' AS v, kva AS x FROM four WHERE kva IS NOT NULL UNION ALL SELECT id, 'mv_voltage_kv', mv || ' kV', mv FROM four WHERE mv IS NOT NULL
  UNION ALL SELECT id, 'ac_voltage_v', ac || ' V', ac FROM four WHERE ac IS NOT NULL UNION ALL SELECT id, 'frequency_hz', hz || ' Hz', hz FROM four WHERE hz IS NOT NULL
  UNION ALL SELECT id, 'efficiency_with_mvt_pct', eff || ' %', eff FROM four WHERE eff IS NOT NULL UNION ALL SELECT id, 'cooling', cooling, hash(cooling) FROM four WHERE cooling IS NOT NULL)
SELECT field, max(v) FILTER (WHERE id = '10') AS a, max(v) FILTER (WHERE id = '12') AS b, max(v) FILTER (WHERE id = '15') AS c, max(v) FILTER (WHERE id = '30') AS d, count(DISTINCT x) > 1 AS differs FROM u GROUP BY 1""")
def compare_models(spark, d):
    ids = ["10", "12", "15", "30"]
    return query.compare(_family(spark, d), ids).select("field", *[F.col(f"`{i}`").alias(n) for i, n in zip(ids, "abcd", strict=True)], "differs")


@_query(_MEMBERS + """, one AS (SELECT * FROM m WHERE id = '60') SELECT 'rated_kva' AS field, 'Power' AS "group", format('{:,}', kva) || ' kVA' AS text, '40 °C' AS condition FROM one
UNION ALL SELECT 'mv_voltage_kv', 'AC side', mv || ' kV', '40 °C' FROM one UNION ALL SELECT 'frequency_hz', 'AC side', hz || ' Hz', '40 °C' FROM one UNION ALL SELECT 'cooling', 'Build', cooling, '40 °C' FROM one""")
def model_values(spark, d):
    return query.model_values(_family(spark, d), "60").select("field", "group", "text", "condition")


@_query(_MEMBERS + """SELECT 'Rated power' AS label, 'rated_kva' AS field, format('{:,}', kva) || ' kVA' AS text FROM m WHERE id = '60' UNION ALL SELECT 'Grid', 'mv_voltage_kv', mv || ' kV' FROM m WHERE id = '60'""")
def headline(spark, d):
    return query.headline(_family(spark, d), "60")


@_query("""SELECT CAST(p_partkey AS VARCHAR) AS id, 'M-' || p_partkey AS model FROM part WHERE p_brand = (SELECT p_brand FROM part WHERE p_partkey = 60) AND p_partkey <> 60""")
def relatives(spark, d):
    return query.relatives(_family(spark, d), "60")


@_query(_MEMBERS + "SELECT id FROM m WHERE coalesce(kva, mv, ac, hz, eff) IS NOT NULL AND id NOT IN ('10', '12') OR cooling IS NOT NULL AND id NOT IN ('10', '12')")
def compare_candidates(spark, d):
    return query.compare_candidates(_family(spark, d), ["10", "12"]).select("id")


def _revised(spark: SparkSession, d: str) -> DataFrame:
    """Users as documents, their events as revisions."""
    e = _t(spark, d, "events")
    kind = DOCUMENTS["revisions"].dataType.elementType
    rev = F.struct(*[{"sha256": F.col("event_id"), "captured_at": F.col("ts"), "extracted": F.when(F.col("event_type") == "signup", F.lit("rules-2")), "bytes": F.col("event_id") * 1000}.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields])
    docs = e.groupBy(F.col("user_id").cast("string").alias("id")).agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", rev.alias("r")))).alias("x"))
    return _as(docs.select("id", F.concat(F.lit("Title "), "id").alias("title"), F.transform("x", lambda x: x["r"]).alias("revisions")), DOCUMENTS)


@_query("""SELECT CAST(user_id AS VARCHAR) AS document, CAST(event_id AS VARCHAR) AS sha256, CAST(row_number() OVER w AS INTEGER) AS rev_no, CAST(lag(event_id) OVER w AS VARCHAR) AS previous,
lead(event_id) OVER w IS NULL AS is_current FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def revision_sequence(spark, d):
    return cat.revisions(_revised(spark, d)).select("document", "sha256", "rev_no", "previous", "is_current")


@_query("""SELECT CAST(user_id AS VARCHAR) AS document, CAST(arg_max(event_id, (ts, event_id)) AS VARCHAR) AS sha256 FROM events GROUP BY 1""")
def current_revision(spark, d):
    return cat.current_revision(_revised(spark, d)).select("document", "sha256")


@_query("SELECT CAST(user_id AS VARCHAR) AS document, CAST(event_id AS VARCHAR) AS sha256 FROM events WHERE event_type <> 'signup' OR event_type IS NULL")
def incremental_gate(spark, d):
    """Revisions that the extractor hasn't read."""
    return passes.unread(cat.revisions(_revised(spark, d))).select("document", "sha256")


@_query("""WITH u AS (SELECT CAST(user_id AS VARCHAR) AS id, count(*) AS n, arg_max(event_id, (ts, event_id)) * 1000 AS b FROM events GROUP BY 1)
SELECT id, n AS n_revisions, CASE WHEN b < 1048576 THEN CAST(round(CAST(b AS DOUBLE) / 1024) AS BIGINT) || ' KB' ELSE printf('%.1f MB', CAST(b AS DOUBLE) / 1048576) END AS size FROM u WHERE contains(lower('Title ' || id), 'e 1')""")
def library(spark, d):
    t = {"suppliers": _empty(spark, SUPPLIERS), "models": _empty(spark, MODELS), "documents": _revised(spark, d)}
    return query.library(t, "E 1").select("id", F.col("n_revisions").cast("long").alias("n_revisions"), "size")


@_query("""WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS rev_no, lead(event_id) OVER (ORDER BY ts, event_id) AS next FROM events WHERE user_id = (SELECT min(user_id) FROM events))
SELECT CAST(rev_no AS INTEGER) AS rev_no, CAST(event_id AS VARCHAR) AS sha256 FROM r WHERE next IS NOT NULL""")
def older_revisions(spark, d):
    first = _t(spark, d, "events").agg(F.min("user_id").cast("string")).first()[0]
    return query.older_revisions({"documents": _revised(spark, d)}, first).select("rev_no", "sha256")


@_query("SELECT count(*) AS n FROM events")
def revision_count(spark, d):
    return query.revision_count({"documents": _revised(spark, d)})


@_query("""SELECT CAST(user_id AS VARCHAR) AS document, 'Title ' || user_id AS title FROM events WHERE event_id = 77""")
def revision_of_digest(spark, d):
    return query.revision_of({"documents": _revised(spark, d)}, "77").select("document", "title")


@_query("""SELECT n_name AS supplier, string_agg(s_name, ',' ORDER BY s_name) AS models FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey > 2 GROUP BY 1""")
def candidate_groups(spark, d):
    chosen = [r.s_name for r in _t(spark, d, "supplier").where("s_suppkey <= 2").select("s_name").collect()]
    return query.candidate_groups(_catalog(spark, d), chosen).select("supplier", F.array_join(F.transform("models", lambda m: m["id"]), ",").alias("models"))


@_query("""SELECT DISTINCT sha256(text) AS sha256 FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en')""")
def content_dedupe(spark, d):
    """Contents that the archive lacks, once each."""
    docs = _t(spark, d, "documents").select("lang", text.sha256_hex(F.col("text").cast("binary")).alias("sha256"))
    return passes.unseen(docs, docs.where("lang = 'en'").select("sha256").distinct()).select("sha256")


# --- extraction ----------------------------------------------------------------------------------


def _cell(value, at: int):
    """value, padded to begin at a column; only for short texts before it."""
    return F.rpad(value, at, " ")


@_query("""WITH p AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS document, p_size AS s FROM part),
m AS (SELECT document, k, s, unnest(['KV-1', 'KV-2', 'KV-3']) AS model, unnest([0, 1, 2]) AS c FROM p)
SELECT document, model, 'weight_kg' AS field, CAST(s * 10 + c AS VARCHAR) AS value, CAST(s * 10 + c AS DOUBLE) AS numeric FROM m
UNION ALL SELECT document, model, 'dc_min_v', CAST(CASE WHEN c < 2 THEN s + 300 ELSE s + 400 END AS VARCHAR), CASE WHEN c < 2 THEN s + 300 ELSE s + 400 END FROM m
UNION ALL SELECT document, model, 'cooling', 'Air ' || s, NULL FROM m
UNION ALL SELECT document, model, 'rated_kva', CAST(s + 100 AS VARCHAR), s + 100 FROM m""")
def extract_tables(spark, d):
    """Three models: a cell each, one merged cell over two, one over all, the 40-degree row of two, its value below its label."""
    s = F.col("p_size")
    t = lambda c: c.cast("string")
    row = lambda label, *cells: F.concat(*[F.rpad(x, n, " ") for x, n in zip([F.lit(label), *[c for c, _ in cells]], [cells[0][1], *[b - a for (_, a), (_, b) in zip(cells, cells[1:], strict=False)], 30], strict=True)])
    lines = [
        row("Model", (F.lit("KV-1"), 40), (F.lit("KV-2"), 60), (F.lit("KV-3"), 80)),
        row("Weight (kg)", (t(s * 10), 40), (t(s * 10 + 1), 60), (t(s * 10 + 2), 80)),
        row("Min. DC voltage", (F.concat(t(s + 300), F.lit(" V")), 50), (F.concat(t(s + 400), F.lit(" V")), 80)),
        row("Cooling", (F.concat(F.lit("Air "), t(s)), 60)),
        row("Rated power @ 25 °C", (F.concat(t(s + 200), F.lit(" kVA")), 60)),
        F.lit("Rated power @ 40 °C"),
        row("", (F.concat(t(s + 100), F.lit(" kVA")), 60)),
    ]
    pages = _t(spark, d, "part").select(t(F.col("p_partkey")).alias("document"), F.lit(1).alias("page"), F.array_join(F.array(*lines), "\n").alias("text"))
    patterns = pages.select("document", F.lit(r"\bKV-[123]\b").alias("model_pattern"))
    return extract.candidates(pages, patterns).select("document", "model", "field", "value", "numeric")


#: Label, value around the part's size, and what is read of it: field, text around the size, how the number is made of it (SQL).
_LINES = (
    ("Real power", "{} kW", (("rated_kw", "{}", "s"),)),
    ("AC output power (kVA/kW)", "{}", (("rated_kw", "{}", "s"), ("rated_kva", "{}", "s"))),
    ("Max. DC voltage", "1,0{0} V", ()),
    ("DC voltage range full power", "{} to 999 V", (("full_power_dc_range", "{}–999", "NULL"),)),
    ("DC voltage range", "{} ~ 998 V", (("dc_voltage_range", "{}–998", "NULL"),)),
    ("Max. DC current (A)", "{}", (("max_dc_current_a", "{}", "s"),)),
    ("Number of DC inputs", "{}", (("dc_inputs", "{}", "s"),)),
    ("Nominal LV/MV voltage", "0.5 kV / {} kV", (("mv_voltage_kv", "{}", "s"), ("ac_voltage_v", "500", "500"))),
    ("Nominal grid frequency", "{} Hz", (("frequency_hz", "{}", "s"),)),
    ("Efficiency (max)", "{} %", (("efficiency_max_pct", "{}", "s"),)),
    ("Max. efficiency with MVT", "{} %", (("efficiency_with_mvt_pct", "{}", "s"),)),
    ("CEC efficiency", "{} %", (("efficiency_weighted_pct", "{}", "s"),)),
    ("Power factor", "0.{} leading to lagging", (("power_factor", "0.{} leading to lagging", "NULL"),)),
    ("Grid forming (virtual {})", "Yes", (("gfm", "Yes (virtual {})", "NULL"),)),
    ("Black start", "Optional ({})", (("black_start", "Optional ({})", "NULL"),)),
    ("Overload", "{} % for 10 s", (("overload", "{} % for 10 s", "NULL"),)),
    ("Operating temperature", "-{} to {} °C, derating above 45 °C", (("temp_min_c", "-{}", "-s"), ("temp_max_c", "{}", "s"), ("derating", "Above 45 °C", "NULL"))),
    ("Ventilation", "Fan {}", (("cooling", "Fan {}", "NULL"),)),
    ("Degree of protection", "IP {}", (("enclosure", "IP {}", "NULL"),)),
    ("Weight", "< {} kg", (("weight_kg", "<{}", "s"),)),
    ("Communication protocol", "Bus {}", (("communications", "Bus {}", "NULL"),)),
)


def _rules_sql() -> str:
    one = lambda x: "'" + x.replace("{0}", "{}").replace("{}", "' || s || '") + "'"
    parts = [f"SELECT document, '{field}' AS field, {one(v)} AS value, CAST({n} AS DOUBLE) AS numeric FROM p" for _, _, read in _LINES for field, v, n in read]
    parts.append("SELECT document, 'dc_max_v', '10' || s, CAST('10' || s AS DOUBLE) FROM p")
    # both power rows are rated_kw: the one before, of equal preference, is kept
    return "WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS document, p_size + 10 AS s FROM part) SELECT DISTINCT * FROM (" + " UNION ALL ".join(parts) + ")"


@_query(_rules_sql())
def extract_rules(spark, d):
    """A line for each rule."""
    size = (F.col("p_size") + 10).cast("string")

    def filled(x: str):
        parts = x.replace("{0}", "{}").split("{}")
        out = [F.lit(parts[0])]
        for p in parts[1:]:
            out += [size, F.lit(p)]
        return F.concat(*out)

    lines = F.array_join(F.array(*[F.concat(F.rpad(filled(label), 44, " "), filled(value)) for label, value, _ in _LINES]), "\n")
    pages = _t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("document"), F.lit(1).alias("page"), lines.alias("text"))
    return extract.candidates(pages).select("document", "field", "value", "numeric")


# --- revisions -----------------------------------------------------------------------------------

_RUN = """WITH p AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS id, p_size AS s FROM part),
o AS (SELECT *, CASE k % 5 WHEN 0 THEN s WHEN 1 THEN s + 1 WHEN 2 THEN s * 10 END AS new FROM p),
r AS (SELECT *, CASE WHEN new IS NULL THEN 'needs-check' WHEN new = s THEN 'confirmed' WHEN s > 0 AND CAST(new AS DOUBLE) / s BETWEEN 0.5 AND 2 THEN 'updated' ELSE 'needs-check' END AS outcome FROM o) """


def _rechecked(spark: SparkSession, d: str):
    """Specs that the extractor made, candidates of the new revisions (none for two of five parts), the outcomes."""
    p = _t(spark, d, "part")
    k, size, key = F.col("p_partkey"), F.col("p_size"), F.col("p_partkey").cast("string")
    model = F.when(k % 2 == 0, F.lit("M"))
    specs = _as(p.select(key.alias("id"), key.alias("document"), key.alias("product"), F.lit("weight_kg").alias("field"), size.cast("string").alias("value"), size.cast("double").alias("numeric"), F.lit(7).alias("page"), F.lit("old").alias("evidence"), F.lit("r1").alias("revision"), F.when(k % 3 == 0, "extracted").otherwise("reviewed").alias("status"), F.struct(F.lit("rules-2").alias("version"), model.alias("model")).alias("extractor")), SPECS)
    new = F.when(k % 5 == 0, size).when(k % 5 == 1, size + 1).when(k % 5 == 2, size * 10)
    cands = p.where(k % 5 < 3).select(key.alias("document"), model.alias("model"), F.lit("weight_kg").alias("field"), new.cast("string").alias("value"), new.cast("double").alias("numeric"), F.lit(1).alias("page"), F.lit("new").alias("evidence"), F.lit(None).cast("string").alias("anchor"), F.lit(1).alias("ord"))
    revs = p.select(key.alias("document"), F.lit("r2").alias("sha256"), F.lit("r1").alias("previous"), F.lit("2024-02-02").alias("captured_at"))
    return specs, verify.recheck_extracted(specs, cands), revs


@_query(_RUN + "SELECT id, outcome AS status, CAST(CASE WHEN outcome = 'needs-check' THEN s ELSE new END AS VARCHAR) AS value, CAST(CASE WHEN outcome = 'needs-check' THEN 7 ELSE 1 END AS BIGINT) AS page FROM r")
def recheck_made_values(spark, d):
    return _rechecked(spark, d)[1].select("id", "status", "value", "page")


@_query(_RUN + """SELECT id, CASE WHEN outcome = 'confirmed' AND k % 3 = 0 THEN 'extracted' ELSE outcome END AS status, CAST(CASE WHEN outcome = 'updated' THEN new ELSE s END AS VARCHAR) AS value,
CASE WHEN outcome = 'needs-check' THEN 'r1' ELSE 'r2' END AS revision, CASE WHEN outcome = 'needs-check' THEN 'old' ELSE 'new' END AS evidence, CAST(s AS VARCHAR) AS previous_value, 'r1' AS previous_revision FROM r""")
def applied_outcomes(spark, d):
    specs, found, revs = _rechecked(spark, d)
    out = verify.apply_outcomes(specs, found, revs)
    old = F.get("history", F.lit(0))
    return out.select("id", "status", "value", "revision", "evidence", old["value"].alias("previous_value"), old["revision"].alias("previous_revision"))


@_query(_RUN + """SELECT 'needs-check' AS type, id AS document, 'Weight was not found in the new datasheet; showing the previous value' AS summary FROM r WHERE outcome = 'needs-check'
UNION ALL SELECT 'value-changed', id, 'Weight: ' || s || ' → ' || new || ' kg' FROM r WHERE outcome = 'updated'
UNION ALL SELECT 'datasheet-revised', id, 'Datasheet changed: T' || id || ' (' || CAST(outcome = 'confirmed' AS INTEGER) || ' values confirmed, ' || CAST(outcome = 'updated' AS INTEGER) || ' updated, ' || CAST(outcome = 'needs-check' AS INTEGER) || ' need checking)' FROM r""")
def recheck_changes(spark, d):
    specs, found, revs = _rechecked(spark, d)
    docs = _as(specs.select("id", F.col("id").alias("product"), F.concat(F.lit("T"), "id").alias("title")), DOCUMENTS)
    fields = _as(spark.createDataFrame([("weight_kg", "Weight", "kg")], "key string, label string, unit string"), FIELDS)
    return verify.recheck_changes(specs, found, revs, docs, fields).select("type", "document", "summary")


@_query("""WITH c AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_size % 3 ORDER BY p_partkey) AS r FROM part WHERE NOT (p_size % 3 = 0 AND p_brand LIKE '%1'))
SELECT p_brand || ':f' || p_size % 3 AS id, CAST(p_partkey AS VARCHAR) AS document, CAST(p_size AS VARCHAR) AS value, 'h' || p_partkey AS revision, 'extracted' AS status FROM c WHERE r = 1""")
def published_values(spark, d):
    """The first document's value of each product and field that has none."""
    p = _t(spark, d, "part")
    key, field = F.col("p_partkey").cast("string"), F.concat(F.lit("f"), (F.col("p_size") % 3).cast("string"))
    resolved = p.select(F.col("p_brand").alias("product"), field.alias("field"), key.alias("document"), F.col("p_partkey").alias("doc_ord"), F.lit(1).alias("ord"), F.lit(None).cast("string").alias("model"), F.col("p_size").cast("string").alias("value"), F.lit(None).cast("double").alias("numeric"), F.lit(1).alias("page"), F.lit("e").alias("evidence"), F.lit(None).cast("string").alias("anchor"), F.lit("").alias("conditions"))
    have = p.where(F.endswith("p_brand", F.lit("1"))).select(F.col("p_brand").alias("product"), F.lit("f0").alias("field"))
    current = p.select(key.alias("document"), F.concat(F.lit("h"), key).alias("sha256"))
    return publish.new_specs(resolved, have, current, F.lit("2024-01-01")).select("id", "document", "value", "revision", "status")


@_query("""SELECT CAST(c_custkey AS VARCHAR) AS id, round((400 + c_custkey % 2 * 100 - 1.5) / 800, 4) AS x0, round((430 + c_custkey % 2 * 100 + 1.5) / 800, 4) AS x1 FROM customer""")
def locate_cells(spark, d):
    """The cell of the value's model: two columns hold the number, the header says which is whose."""
    c = _t(spark, d, "customer")
    key = F.col("c_custkey").cast("string")
    line = lambda n, x0, x1, y, words: F.struct(F.lit(n).alias("line_no"), F.lit(x0).cast("double").alias("x0"), F.lit(y).cast("double").alias("y0"), F.lit(x1).cast("double").alias("x1"), F.lit(y + 10.0).alias("y1"), words.alias("text"))
    at = F.array(line(0, 400, 430, 50.0, F.lit("QA-0")), line(1, 500, 530, 50.0, F.lit("QA-1")), line(2, 50, 150, 90.0, F.lit("Output of it")), line(3, 400, 430, 91.0, F.lit("77 kW")), line(4, 500, 530, 91.0, F.lit("77 kW")))
    lines = c.select(key.alias("document"), F.lit(1).alias("page"), F.lit(800.0).alias("width"), F.lit(600.0).alias("height"), F.inline(at))
    model = F.concat(F.lit("QA-"), (F.col("c_custkey") % 2).cast("string"))
    specs = c.select(key.alias("id"), key.alias("document"), F.lit(1).alias("page"), F.lit("77").alias("value"), F.concat(F.lit("Output of it — "), model, F.lit(": 77 kW")).alias("evidence"), model.alias("model"))
    return locate.locate(specs, lines).select("id", F.get("cell", F.lit(0)).alias("x0"), F.get("cell", F.lit(2)).alias("x1"))


# --- validation ----------------------------------------------------------------------------------


@_query("""WITH p AS (SELECT p_partkey AS k, p_partkey % 20 AS f, CAST(p_partkey AS VARCHAR) AS id FROM part)
SELECT 'spec-product' AS rule, id AS subject FROM p WHERE f = 1 UNION ALL SELECT 'spec-field', id FROM p WHERE f = 2 UNION ALL SELECT 'spec-status', id FROM p WHERE f IN (3, 4)
UNION ALL SELECT 'spec-revision', id FROM p WHERE f IN (5, 6) UNION ALL SELECT 'spec-evidence', id FROM p WHERE f IN (7, 8) UNION ALL SELECT 'highlight-image', id FROM p WHERE f IN (9, 10)
UNION ALL SELECT 'highlight-row', id FROM p WHERE f = 11 UNION ALL SELECT 'highlight-cell', id FROM p WHERE f = 12 UNION ALL SELECT 'history-revision', id FROM p WHERE f = 13
UNION ALL SELECT 'id-duplicate', 'twice' FROM p WHERE f = 14 GROUP BY 1 HAVING count(*) > 1
UNION ALL SELECT 'document-supplier', 'd' || id FROM p WHERE f = 15 UNION ALL SELECT 'document-product', 'd' || id FROM p WHERE f = 16 UNION ALL SELECT 'document-revisions', 'd' || id FROM p WHERE f = 17
UNION ALL SELECT 'model-supplier', 'm' || id FROM p WHERE f = 18 UNION ALL SELECT 'id-missing', NULL FROM p WHERE f = 19
UNION ALL SELECT 'company-country', 'bad' UNION ALL SELECT 'company-parent', 'bad' UNION ALL SELECT 'company-source', 'bad' UNION ALL SELECT 'company-review', 'bad'
UNION ALL SELECT 'file-missing', 'd' || id FROM p WHERE f NOT IN (17, 19) AND k % 3 = 0 UNION ALL SELECT 'file-digest', 'd' || id FROM p WHERE f NOT IN (17, 19) AND k % 3 = 1 UNION ALL SELECT 'highlight-missing', id FROM p WHERE f IN (11, 12)""")
def validation_report(spark, d):
    """A catalog in which every kind of fault occurs."""
    p = _t(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 20).alias("f"), F.col("p_partkey").cast("string").alias("id"))
    f, k = F.col("f"), F.col("p_partkey")
    bad = lambda *n: f.isin(*n)
    struct = lambda kind, **c: F.struct(*[c.get(x.name, F.lit(None)).cast(x.dataType).alias(x.name) for x in kind.fields])
    company, product = SUPPLIERS["company"].dataType, SUPPLIERS["products"].dataType.elementType
    source = company["sources"].dataType.elementType
    owner = struct(company["parent"].dataType, name=F.lit("Owner"), country=F.lit("Spain"))
    own = struct(company, hq_country=F.lit("de"), parent=owner, sources=F.array(struct(source, title=F.lit(""), url=F.lit("http://x"))), reviewed_by=F.lit("x"))
    makers = spark.range(1).select(F.lit("maker").alias("id"), F.lit("Maker").alias("name"), F.array(struct(product, id=F.lit("prod"), model=F.lit("P"))).alias("products"), F.lit(None).cast(company).alias("company"))
    makers = makers.unionByName(spark.range(1).select(F.lit("bad").alias("id"), F.lit("Bad").alias("name"), F.array().cast(SUPPLIERS["products"].dataType).alias("products"), own.alias("company")))
    rev = struct(DOCUMENTS["revisions"].dataType.elementType, sha256=F.concat(F.lit("h"), "id"), file=F.concat(F.lit("datasheets/"), "id"))
    docs = p.where(~bad(19)).select(F.concat(F.lit("d"), "id").alias("id"), F.when(bad(15), "none").otherwise("maker").alias("supplier"), F.when(bad(16), "none").otherwise("prod").alias("product"), F.when(bad(17), F.array().cast(DOCUMENTS["revisions"].dataType)).otherwise(F.array(rev)).alias("revisions"))
    docs = docs.unionByName(p.where(bad(19)).select(F.lit(" ").alias("id"), F.lit("maker").alias("supplier"), F.lit("prod").alias("product"), F.array(rev).alias("revisions")))
    models = p.where(bad(18)).select(F.concat(F.lit("m"), "id").alias("id"), F.lit("none").alias("supplier"), F.lit("x").alias("model"))
    high = SPECS["highlight"].dataType
    box = lambda n, part: F.when(bad(n), F.array(F.lit(0.1), F.lit(7.0), F.lit(0.2), F.lit(0.3))).otherwise(F.lit(None))
    image = F.when(bad(9), "else/x.jpg").when(bad(10), "datasheets/../x.jpg").otherwise("datasheets/x.jpg")
    light = F.when(bad(9, 10, 11, 12), struct(high, image=image, row=box(11, "row"), cell=box(12, "cell")))
    past = SPECS["history"].dataType.elementType
    history = F.when(bad(13), F.array(struct(past, revision=F.lit("none")))).otherwise(F.array().cast(SPECS["history"].dataType))
    home = p.where(~bad(17, 19)).select(F.min("id")).first()[0]
    specs = p.where(~bad(17, 19)).select(F.when(bad(14), "twice").otherwise(F.col("id")).alias("id"), F.when(bad(1), "none").otherwise("prod").alias("product"), F.when(bad(2), "none").otherwise("weight_kg").alias("field"), F.when(bad(3), "odd").when(bad(4), F.lit(None)).otherwise("reviewed").alias("status"), F.when(bad(5), F.lit("d" + home)).otherwise(F.concat(F.lit("d"), "id")).alias("document"), F.when(bad(6), "none").otherwise(F.concat(F.lit("h"), "id")).alias("revision"), F.when(bad(7), " ").when(bad(8), F.lit(None)).otherwise("e").alias("evidence"), light.alias("highlight"), history.alias("history"))
    files = p.where(~bad(17)).where(~bad(19)).where(k % 3 > 0).select(F.concat(F.lit("datasheets/"), "id").alias("path"), F.when(k % 3 == 1, F.lit("other")).otherwise(F.concat(F.lit("h"), "id")).alias("sha256"))
    files = files.unionByName(p.where(bad(19)).select(F.concat(F.lit("datasheets/"), "id").alias("path"), F.lit(None).cast("string").alias("sha256")))
    fields = _as(spark.createDataFrame([("weight_kg", "Weight", "kg")], "key string, label string, unit string"), FIELDS)
    t = {"suppliers": _as(makers, SUPPLIERS), "models": _as(models, MODELS), "documents": _as(docs, DOCUMENTS), "specs": _as(specs, SPECS), "fields": fields}
    return validate.problems(t, files).select("rule", F.when(F.col("rule") != "id-missing", F.col("subject")).alias("subject"))


# --- scalar functions -----------------------------------------------------------------------------


@_query("""WITH o AS (SELECT o_orderkey, o_orderdate AS t, CAST(date_diff('second', o_orderdate, TIMESTAMP '2001-06-01') AS DOUBLE) AS s FROM orders),
u AS (SELECT *, CAST(round(s / 31536000) AS BIGINT) AS y, CAST(round(s / 2592000) AS BIGINT) AS m, CAST(round(s / 604800) AS BIGINT) AS w, CAST(round(s / 86400) AS BIGINT) AS d FROM o)
SELECT o_orderkey, strftime(t, '%-d %b') AS short, strftime(t, '%-d %b %Y') AS long, strftime(t, '%A, %-d %B %Y') AS day,
CASE WHEN s >= 31536000 THEN CASE WHEN y = 1 THEN 'last year' ELSE y || ' years ago' END WHEN s >= 2592000 THEN CASE WHEN m = 1 THEN 'last month' ELSE m || ' months ago' END
  WHEN s >= 604800 THEN CASE WHEN w = 1 THEN 'last week' ELSE w || ' weeks ago' END WHEN s >= 86400 THEN CASE WHEN d = 1 THEN 'yesterday' ELSE d || ' days ago' END ELSE 'just now' END AS ago FROM u""")
def display_dates(spark, d):
    t = F.col("o_orderdate").cast("timestamp")
    return _t(spark, d, "orders").select("o_orderkey", display.short_date(t).alias("short"), display.long_date(t).alias("long"), display.day_label(t).alias("day"), display.time_ago(t, F.lit("2001-06-01").cast("timestamp")).alias("ago"))


@_query(r"""SELECT s_suppkey, s_name || CASE WHEN s_name LIKE '%s' THEN '’' ELSE '’s' END AS owner, upper(substring(CASE WHEN length(regexp_replace(s_name, '[^A-Z0-9]', '', 'g')) > 1 THEN regexp_replace(s_name, '[^A-Z0-9]', '', 'g') ELSE s_name END, 1, 2)) AS initials,
  s_name || CASE WHEN s_nationkey = 1 THEN ' · 1 item' ELSE ' · ' || s_nationkey || ' items' END AS counted, translate(regexp_replace('a-' || s_name || '_x.pdf', '\.[^.]*$', ''), '-_', '  ') AS title FROM supplier""")
def display_names(spark, d):
    n = F.col("s_name")
    return _t(spark, d, "supplier").select("s_suppkey", text.possessive(n).alias("owner"), text.initials(n).alias("initials"), F.concat(n, F.lit(" · "), display.plural(F.col("s_nationkey"), "item")).alias("counted"), text.title_from_filename(F.concat(F.lit("a-"), n, F.lit("_x.pdf"))).alias("title"))


@_query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'my file.pdf' WHEN 1 THEN 'plain' || page_id || '.pdf' WHEN 2 THEN 'a b' || page_id || '.pdf' ELSE 'datasheet.pdf' END AS file FROM pages""")
def file_names(spark, d):
    k, n = F.col("page_id") % 4, F.col("page_id").cast("string")
    said = F.when(k == 0, F.lit("attachment; filename*=UTF-8''my%20file.pdf")).when(k == 1, F.concat(F.lit('inline; filename="plain'), n, F.lit('.pdf"')))
    url = F.when(k == 2, F.concat(F.lit("https://h/x/a%20b"), n, F.lit(".pdf?q=1"))).otherwise(F.lit("https://h/"))
    return _t(spark, d, "pages").select("page_id", web.filename_for(said, url).alias("file"))


@_query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'Above ' || p_size || ' °C' END AS derating, CAST(-p_size AS DOUBLE) AS low, CAST(p_size + 1 AS DOUBLE) AS high,
CAST(p_size AS DOUBLE) AS kilovolts, CAST(p_size * 100 AS DOUBLE) AS volts, p_size || ' ±5%' AS spread FROM part""")
def value_parsers(spark, d):
    s = F.col("p_size").cast("string")
    one = lambda c, n: F.get(c, F.lit(0))[n]
    heat = F.concat(F.lit("From -"), s, F.lit(" °C to +"), (F.col("p_size") + 1).cast("string"), F.lit(" °C"), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(", > "), s, F.lit(" °C derating"))).otherwise(F.lit("")))
    volts = F.concat((F.col("p_size") / 10).cast("string"), F.lit(" kV / "), s, F.lit(" kV"))
    return _t(spark, d, "part").select("p_partkey", one(values.derating(heat), "text").alias("derating"), one(values.temp_min(heat), "number").alias("low"), one(values.temp_max(heat), "number").alias("high"), one(values.mv_voltage(volts), "number").alias("kilovolts"), one(values.lv_voltage(volts), "number").alias("volts"), one(values.mv_voltage(F.concat(s, F.lit(" kV ± 5 %"))), "text").alias("spread"))


@_query("""WITH c AS (SELECT CAST(ts AS DATE) AS day, event_id, CAST(user_id AS VARCHAR) AS product, event_id % 7 AS cnt,
['needs-check', 'value-changed', 'datasheet-revised', 'new-datasheet', 'new-model', 'values-extracted', 'import'][CAST(event_id % 7 AS INTEGER) + 1] AS type, 's' || (user_id % 3) AS supplier FROM events)
SELECT strftime(day, '%Y-%m-%d') AS day, type, supplier, product, CAST(1 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS total FROM c WHERE type IN ('needs-check', 'value-changed', 'import')
UNION ALL SELECT strftime(day, '%Y-%m-%d'), type, supplier, NULL, count(*), CAST(sum(cnt) AS BIGINT) FROM c WHERE type NOT IN ('needs-check', 'value-changed', 'import') GROUP BY 1, 2, 3""")
def updates_feed(spark, d):
    e = _t(spark, d, "events")
    kinds = F.array(*map(F.lit, ("needs-check", "value-changed", "datasheet-revised", "new-datasheet", "new-model", "values-extracted", "import")))
    user = F.col("user_id").cast("string")
    changes = e.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), F.get(kinds, (F.col("event_id") % 7).cast("int")).alias("type"), user.alias("product"), (F.col("event_id") % 7).alias("count"))
    models = e.select(user.alias("id"), F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("supplier")).distinct().withColumn("model", F.col("id"))
    suppliers = models.select(F.col("supplier").alias("id")).distinct()
    t = {"suppliers": _as(suppliers, SUPPLIERS), "models": _as(models, MODELS), "documents": _empty(spark, DOCUMENTS), "changes": _as(changes, CHANGES)}
    return query.updates(t).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "type", "supplier", "product", "n", "total")
