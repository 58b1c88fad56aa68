"""Candidates to published values: models resolved or discovered, values added where the catalog has none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.fixed import EXTRACTED, EXTRACTOR_VERSION, MODEL_SUMMARY, SUMMARY_NEW_MODEL, SUMMARY_READ
from specloom.functions import text as tx
from specloom.operators.catalog import is_family
from specloom.operators.relational import first_rows
from specloom.schemas import SPECS


def names_model(model: Column, token: Column) -> Column:
    """The model is the token, or holds it as a word of its own."""
    return (model == token) | F.regexp_like(model, F.concat(F.lit(r"(?U)(?<![\w-])\Q"), token, F.lit(r"\E(?![\w-])")))


def resolve(candidates: DataFrame, documents: DataFrame, products: DataFrame, suppliers: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(candidates with their product, new models).

    A candidate without a model goes to its document's product, unless that is a family. A model token goes to the
    first product of the supplier that it names; a token without one makes a model, from the first document that
    holds it. Distinct tokens alone meet the supplier's products.
    """
    docs = documents.select(F.col("id").alias("document"), "supplier", F.col("product").alias("doc_product"), "title", F.col("ord").alias("doc_ord"))
    met = candidates.join(docs, "document")
    tokens = met.where("model IS NOT NULL").groupBy("supplier", F.col("model").alias("token")).agg(F.min(F.struct("doc_ord", "document", "title", "doc_product")).alias("first"))
    known = products.select(F.col("id").alias("pid"), F.col("supplier").alias("ps"), F.col("model").alias("pm"), F.col("ord").alias("po"))
    hits = tokens.select("supplier", "token").join(known, (F.col("supplier") == F.col("ps")) & names_model(F.col("pm"), F.col("token")))
    hits = hits.groupBy("supplier", "token").agg(F.min_by("pid", "po").alias("pid"))

    sup = suppliers.select(F.col("id").alias("supplier"), F.col("name").alias("supplier_name"))
    src = products.select(F.col("id").alias("source_id"), F.col("kind").alias("source_kind"))
    fresh = tokens.join(hits, ["supplier", "token"], "left_anti").join(sup, "supplier").join(src, F.col("first.doc_product") == F.col("source_id"), "left")
    models = fresh.select(
        tx.slugify(F.concat_ws(" ", "supplier", "token")).alias("id"),
        "supplier",
        F.col("token").alias("model"),
        F.concat(F.lit(MODEL_SUMMARY[0]), tx.possessive(F.col("supplier_name")), F.lit(" “"), F.col("first.title"), F.lit(MODEL_SUMMARY[1])).alias("summary"),
        F.when(~is_family(F.col("source_kind")), F.col("source_kind")).alias("kind"),
        tx.market_from_title(F.col("first.title")).alias("market"),
        F.col("source_id").alias("family"),
        F.lit(True).alias("auto"),
        F.col("first.document").alias("found_in"),
        at.cast("string").alias("first_seen"),
    )
    named = hits.unionByName(models.select("supplier", F.col("model").alias("token"), F.col("id").alias("pid")))
    own = products.where(~is_family(F.col("kind"))).select(F.col("id").alias("own_id"))
    with_token = met.where("model IS NOT NULL").join(named.withColumnRenamed("token", "model"), ["supplier", "model"]).select(*met.columns, F.col("pid").alias("product"))
    without = met.where("model IS NULL").join(own, F.col("doc_product") == F.col("own_id")).select(*met.columns, F.col("own_id").alias("product"))
    return with_token.unionByName(without), models


def new_specs(resolved: DataFrame, specs: DataFrame, current: DataFrame, at: Column) -> DataFrame:
    """Rows for specs: (product, field) pairs that specs lacks, from the first document and candidate that offer them."""
    open_ = resolved.join(specs.select("product", "field").distinct(), ["product", "field"], "left_anti")
    first = first_rows(open_, ["product", "field"], F.col("doc_ord"), F.col("ord")).join(current.select("document", "sha256"), "document")
    to = {
        "id": F.concat_ws(":", "product", "field"),
        "revision": F.col("sha256"),
        "page": F.col("page").cast("long"),
        "status": F.lit(EXTRACTED),
        "extracted_by": F.lit(f"Rules-based extractor ({EXTRACTOR_VERSION})"),
        "extractor": F.struct(F.lit(EXTRACTOR_VERSION).alias("version"), F.col("model").alias("model")),
        "checked_at": at.cast("string"),
        "history": F.array(),
    }
    have = set(first.columns)
    return first.select(*[(to[f.name] if f.name in to else F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in SPECS.fields])


def mark_extracted(documents: DataFrame, resolved: DataFrame, done: DataFrame) -> DataFrame:
    """documents whose current revision is marked with the extractor's version, with the products they gave values to.

    done: the documents that were read, with or without values.
    """
    touched = resolved.groupBy(F.col("document").alias("_d")).agg(F.collect_set("product").alias("_p"))
    read = done.select(F.col("document").alias("_done")).distinct()
    met = documents.join(touched, documents["id"] == F.col("_d"), "left").join(read, documents["id"] == F.col("_done"), "left")
    last = F.size("revisions")
    marked = F.transform("revisions", lambda r, i: F.when(i == last - 1, r.withField("extracted", F.lit(EXTRACTOR_VERSION))).otherwise(r))
    names = F.sort_array(F.array_union(F.coalesce("models", F.array().cast("array<string>")), F.coalesce("_p", F.array().cast("array<string>"))))
    to = {"revisions": F.when(F.col("_done").isNotNull(), marked).otherwise(F.col("revisions")), "models": F.when(F.col("_p").isNotNull(), names).otherwise(F.col("models"))}
    return met.select(*[to.get(c, F.col(c)).alias(c) for c in documents.columns])


def publish_changes(models: DataFrame, added: DataFrame, documents: DataFrame, suppliers: DataFrame, at: Column) -> DataFrame:
    """Change entries: a row for each new model, and one for each document with added values."""
    names = suppliers.select(F.col("id").alias("supplier"), F.col("name").alias("sn"))
    found = models.join(names, "supplier", "left").select(
        F.lit("new-model").alias("type"),
        F.concat(F.lit(SUMMARY_NEW_MODEL), F.coalesce("sn", "supplier"), F.lit(" "), F.col("model")).alias("summary"),
        F.col("id").alias("product"),
        F.col("found_in").alias("document"),
        F.lit(None).cast("string").alias("revision"),
        F.lit(None).cast("long").alias("count"),
    )
    n = added.groupBy("document").agg(F.count("*").alias("count"), F.any_value("revision").alias("revision"))
    docs = documents.select(F.col("id").alias("document"), "product", "title")
    read = n.join(docs, "document").select(F.lit("values-extracted").alias("type"), F.format_string(SUMMARY_READ, "count", "title").alias("summary"), "product", "document", "revision", "count")
    both = found.unionByName(read)
    none = lambda c: F.lit(None).cast("string").alias(c)
    return both.select(at.cast("string").alias("at"), "type", "summary", "product", "document", none("field"), "revision", none("previous_revision"), none("value"), none("previous_value"), "count")
