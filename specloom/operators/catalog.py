"""Views of the catalog: suppliers unnested to products and sources, configured and discovered models, families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specloom.functions import display

PRODUCT_COLUMNS = ["id", "supplier", "model", "summary", "kind", "market", "family"]


def configured_products(suppliers: DataFrame) -> DataFrame:
    """(id, supplier, model, ..., ord): products of the suppliers in their order."""
    each = suppliers.select(F.col("id").alias("supplier"), F.posexplode("products").alias("pos", "p"))
    each = each.select("supplier", "pos", "p.*").withColumn("ord", F.struct(F.lit(0).alias("src"), F.col("supplier"), F.col("pos")))
    return each.select(*PRODUCT_COLUMNS, F.lit(False).alias("auto"), "ord")


def product_sources(suppliers: DataFrame) -> DataFrame:
    """A row for each source: supplier, product, name, url, hosts it may use (its own too), patterns of wanted links."""
    each = suppliers.select(F.col("id").alias("supplier"), F.explode("products").alias("p")).select("supplier", F.col("p.id").alias("product"), F.explode("p.sources").alias("s"))
    host = F.lower(F.regexp_extract("s.url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    patterns = F.filter(F.transform(F.split(F.coalesce("s.link_pattern", F.lit("")), ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return each.select("supplier", "product", F.coalesce("s.name", "s.url").alias("name"), "s.url", F.array_union(F.coalesce("s.allowed_hosts", F.array().cast("array<string>")), F.array(host)).alias("hosts"), patterns.alias("patterns"))


def all_products(suppliers: DataFrame, models: DataFrame) -> DataFrame:
    """Configured products, then discovered models of known suppliers; a configured id wins over a discovered one."""
    own = configured_products(suppliers)
    seen = models.join(suppliers.select(F.col("id").alias("supplier")), "supplier", "left_semi").join(own.select("id"), "id", "left_anti")
    seen = seen.withColumn("ord", F.struct(F.lit(1).alias("src"), F.col("supplier"), F.dense_rank().over(Window.partitionBy("supplier").orderBy("first_seen", "id")).alias("pos")))
    return own.unionByName(seen.select(*PRODUCT_COLUMNS, F.coalesce("auto", F.lit(True)).alias("auto"), "ord"))


def document_products(documents: DataFrame) -> DataFrame:
    """(document, product): a document's own product and the models that it lists, each once."""
    ids = F.array_distinct(F.array_compact(F.concat(F.array("product"), F.coalesce("models", F.array().cast("array<string>")))))
    return documents.select(F.col("id").alias("document"), F.explode(ids).alias("product"))


def revisions(documents: DataFrame) -> DataFrame:
    """(document, rev_no from 1, previous: the sha256 before, is_current, ...)."""
    each = documents.select(F.col("id").alias("document"), F.size("revisions").alias("n"), F.col("revisions").alias("rs"), F.posexplode("revisions").alias("pos", "r"))
    previous = F.when(F.col("pos") > 0, F.get("rs", F.col("pos") - 1)["sha256"])
    return each.select("document", (F.col("pos") + 1).alias("rev_no"), previous.alias("previous"), (F.col("pos") + 1 == F.col("n")).alias("is_current"), "r.*")


def current_revision(documents: DataFrame) -> DataFrame:
    """(document, ...): the last revision of each document that has any."""
    some = documents.where(F.size(F.coalesce("revisions", F.array())) > 0)
    return some.select(F.col("id").alias("document"), F.element_at("revisions", -1).alias("r")).select("document", "r.*")


def is_family(kind: Column) -> Column:
    return F.contains(F.lower(F.coalesce(kind, F.lit(""))), F.lit("family"))


def families(products: DataFrame, specs: DataFrame) -> DataFrame:
    """(id, family, is_container): a container is a product that others name as family and that has no values of its own."""
    parents = products.where("family IS NOT NULL").select(F.col("family").alias("id")).distinct().join(products.select("id"), "id", "left_semi")
    bare = parents.join(specs.select(F.col("product").alias("id")), "id", "left_anti").withColumn("is_container", F.lit(True))
    return products.select("id", "family").join(bare, "id", "left").select("id", "family", F.coalesce("is_container", F.lit(False)).alias("is_container"))


def spec_counts(products: DataFrame, specs: DataFrame) -> DataFrame:
    """Values, reviewed values and values that need attention of each product, and its review kind (reviewed, auto or none)."""
    n = specs.groupBy(F.col("product").alias("id")).agg(
        F.count("*").alias("n_specs"),
        F.count_if(F.col("status") != "extracted").alias("n_reviewed"),
        F.count_if(F.col("status") == "needs-check").alias("n_check"),
        F.count_if(F.col("status").isin("needs-check", "updated")).alias("n_attention"),
    )
    out = products.join(n, "id", "left").na.fill(0, ["n_specs", "n_reviewed", "n_check", "n_attention"])
    return out.withColumn("review", F.when(F.col("n_reviewed") > 0, "reviewed").when(F.col("n_specs") > 0, "auto").otherwise("none"))


def rolled_review(counts: DataFrame, fams: DataFrame) -> DataFrame:
    """(id, review, n_check, n_specs, n_reviewed, members) of containers from their members: any reviewed, else any auto, else none."""
    members = counts.where("family IS NOT NULL").groupBy(F.col("family").alias("id")).agg(
        F.max(F.when(F.col("review") == "reviewed", 2).when(F.col("review") == "auto", 1).otherwise(0)).alias("rank"),
        F.sum("n_check").alias("n_check"),
        F.sum("n_specs").alias("n_specs"),
        F.sum("n_reviewed").alias("n_reviewed"),
        F.count("*").alias("members"),
    )
    own = fams.where("is_container").select("id")
    return members.join(own, "id").select("id", F.when(F.col("rank") == 2, "reviewed").when(F.col("rank") == 1, "auto").otherwise("none").alias("review"), "n_check", "n_specs", "n_reviewed", "members")


def supplier_countries(suppliers: DataFrame) -> DataFrame:
    """(supplier, country): headquarters and parent, each country once."""
    return suppliers.select(F.col("id").alias("supplier"), F.explode(display.countries()).alias("country"))


def country_facet(suppliers: DataFrame) -> DataFrame:
    """(country, name, n_suppliers, suppliers): the facet of the catalog, by the countries' names."""
    own = supplier_countries(suppliers).groupBy("country").agg(F.count("*").alias("n_suppliers"), F.sort_array(F.collect_set("supplier")).alias("suppliers"))
    return own.select("country", display.country_name(F.col("country")).alias("name"), "n_suppliers", "suppliers").orderBy("name", "country")


def field_order(fields: DataFrame) -> DataFrame:
    """fields with field_ord: groups in the order of their first field, fields in theirs. fields: key, group, ord."""
    first = F.min("ord").over(Window.partitionBy("group"))
    ranked = fields.withColumn("group_ord", first)
    return ranked.withColumn("field_ord", F.row_number().over(Window.orderBy("group_ord", "ord")))  # a table of field definitions: one small partition


def with_field(specs: DataFrame, fields: DataFrame) -> DataFrame:
    """specs with their field's label and unit; an unknown field is labelled by its key and has no unit."""
    f = fields.select(F.col("key").alias("field"), "label", "unit")
    return specs.join(f, "field", "left").withColumns({"label": F.coalesce("label", "field"), "unit": F.coalesce("unit", F.lit(""))})


def last_checked(documents: DataFrame, status: DataFrame) -> DataFrame:
    """(last_checked): the end of the last run, else the latest check of any document."""
    docs = documents.agg(F.max("last_checked").alias("d"))
    run = status.agg(F.max("last_run_finished").alias("s"))
    return docs.join(run).select(F.coalesce("s", "d").alias("last_checked"))  # one row each
