"""One collection pass as a chain of tables: responses, new revisions, rechecks, new values, changes, status.

Inputs are the catalog's tables, the responses to the requests of the pass, and the page texts and layouts of new
files; outputs are the tables after the pass. A pass has one new revision of a document at most. What several later
steps read is written once and read again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.fixed import ERROR_CHARS, EXTRACTOR_VERSION, ID_CHARS, SUMMARY_NEW_DATASHEET
from specloom.functions import text, web
from specloom.operators import catalog as cat
from specloom.operators import extract, locate, publish, verify
from specloom.operators import relational as rel
from specloom.schemas import CHANGES, DOCUMENTS, REVISION
from specloom.sources.archive import archive_path, is_pdf
from specloom.sources.tables import cut

NO_LINKS = "no-links: none of the page's links is a wanted file; a script may load them, then name the file itself as a source"
NO_PDF = "no-pdf: the answer is no PDF file but perhaps a form"


@dataclass
class Pass:
    """Tables after a pass, and what it did."""

    tables: dict[str, DataFrame]
    files: DataFrame
    results: DataFrame
    new_changes: DataFrame


def source_requests(suppliers: DataFrame) -> DataFrame:
    """First requests: the sources' own addresses, once each. Pages are always asked for in full."""
    s = cat.product_sources(suppliers).groupBy("url").agg(F.array_distinct(F.flatten(F.collect_list("hosts"))).alias("hosts"))
    none = lambda c: F.lit(None).cast("string").alias(c)
    return s.select("url", "hosts", none("etag"), none("last_modified"), none("referer"))


def found_files(suppliers: DataFrame, responses: DataFrame) -> DataFrame:
    """(supplier, product, name, source_url, url, direct, error): the file of a source that is one, the links of one that is a page.

    A source without an answer, or whose page has no wanted link, is a row with an error and no url.
    """
    s = cat.product_sources(suppliers).withColumnRenamed("url", "source_url")
    s = s.withColumn("key", F.sha2(F.to_json(F.struct("supplier", "product", "name", "source_url")), 256)).dropDuplicates(["key"])
    r = responses.select(F.col("url").alias("source_url"), "final_url", "status", "body", F.col("error").alias("failed"))
    met = s.join(r, "source_url", "left")
    bad = F.when(F.col("failed").isNotNull(), F.col("failed")).when(F.col("status").isNull(), F.lit("No answer")).when(F.col("status") != 200, F.concat(F.lit("HTTP "), F.col("status").cast("string")))
    met = met.withColumns({"bad": bad, "pdf": F.coalesce(is_pdf(F.col("body")), F.lit(False))})
    base = ["supplier", "product", "name", "source_url"]
    direct = met.where("bad IS NULL AND pdf").select(*base, web.canonical_url(F.col("source_url")).alias("url"), F.lit(True).alias("direct"), F.lit(None).cast("string").alias("error"))
    pages = met.where("bad IS NULL AND NOT pdf").select("key", *base, "hosts", "patterns", "final_url", F.decode("body", "UTF-8").alias("html"))
    links = web.anchors(pages, "key", "final_url", "html").withColumn("url", web.canonical_url(F.col("url"))).where("url IS NOT NULL")
    links = links.join(pages.select("key", *base, "hosts", "patterns"), "key")
    hay = F.lower(F.concat_ws(" ", web._decoded(F.col("url")), "label"))
    wanted = (F.size("patterns") == 0) | F.exists("patterns", lambda p: F.contains(hay, p))
    path = F.lower(F.regexp_extract("url", web._URL, 3))
    kept = links.where(F.array_contains("hosts", web.url_host(F.col("url"))) & (F.endswith(path, F.lit(".pdf")) | F.col("download")) & wanted)
    first = kept.groupBy("key", *base, "url").agg(F.min("ord").alias("ord"))
    linked = first.select(*base, "url", F.lit(False).alias("direct"), F.lit(None).cast("string").alias("error"))
    empty = pages.join(first.select("key"), "key", "left_anti").select(*base, F.lit(None).cast("string").alias("url"), F.lit(False).alias("direct"), F.lit(NO_LINKS).alias("error"))
    failed = met.where("bad IS NOT NULL").select(*base, F.lit(None).cast("string").alias("url"), F.lit(False).alias("direct"), F.col("bad").alias("error"))
    return direct.unionByName(linked).unionByName(empty).unionByName(failed)


def file_requests(found: DataFrame, suppliers: DataFrame, documents: DataFrame) -> DataFrame:
    """Requests for linked files, with what the current revision is known by, so that an unchanged file isn't sent again."""
    hosts = cat.product_sources(suppliers).groupBy(F.col("url").alias("source_url")).agg(F.array_distinct(F.flatten(F.collect_list("hosts"))).alias("hosts"))
    d = documents.select("url", F.element_at("revisions", -1).alias("r")).select("url", "r.etag", "r.last_modified")
    want = found.where("url IS NOT NULL AND NOT direct").join(hosts, "source_url")
    want = want.groupBy("url").agg(F.array_distinct(F.flatten(F.collect_list("hosts"))).alias("hosts"), F.min("source_url").alias("referer"))
    return want.join(d, "url", "left").select("url", "hosts", "etag", "last_modified", "referer")


def classify(found: DataFrame, responses: DataFrame, documents: DataFrame) -> DataFrame:
    """A row for each found file: document (null: new), digest, outcome: new, revised, same or error."""
    r = responses.select(F.col("url").alias("_u"), "final_url", "status", "headers", "body", F.col("error").alias("failed"))
    d = documents.select(F.col("url").alias("_du"), F.col("id").alias("document"), F.element_at("revisions", -1)["sha256"].alias("now"))
    met = found.where("url IS NOT NULL").join(r, F.col("url") == F.col("_u"), "left").join(d, F.col("url") == F.col("_du"), "left")
    pdf = F.coalesce(is_pdf(F.col("body")), F.lit(False))
    same = (F.col("status") == 304) & F.col("document").isNotNull()
    problem = F.when(F.col("failed").isNotNull(), F.col("failed")).when(F.col("status").isNull(), F.lit("No answer")).when(same, F.lit(None)).when(F.col("status") != 200, F.concat(F.lit("HTTP "), F.col("status").cast("string"))).when(~pdf, F.lit(NO_PDF))
    met = met.withColumns({"sha256": F.sha2("body", 256), "problem": problem})
    outcome = F.when(F.col("problem").isNotNull(), "error").when(same | (F.col("sha256") == F.col("now")), "same").when(F.col("document").isNull(), "new").otherwise("revised")
    name = web.filename_for(F.element_at("headers", "content-disposition"), F.col("final_url"))
    return met.select("supplier", "product", "name", "source_url", "url", "document", "sha256", "body", "headers", name.alias("filename"), outcome.alias("outcome"), "problem")


def revise(documents: DataFrame, files: DataFrame, page_counts: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(documents with their new revisions and new documents, revisions of the pass).

    An address that several sources found is one file. New ids are the file's name, with -2, -3 ... where it is taken.
    page_counts: (sha256, pages).
    """
    at = at.cast("string")
    one = rel.first_rows(files.where("outcome <> 'error'"), ["url"], F.col("source_url"), F.col("product")).join(page_counts, "sha256", "left")
    header = lambda k: F.element_at("headers", k)
    rev = F.struct(F.col("sha256"), archive_path(F.col("sha256"), F.col("filename")).alias("file"), F.length("body").cast("long").alias("bytes"), F.coalesce("pages", F.lit(0)).cast("long").alias("pages"), at.alias("captured_at"), header("etag").alias("etag"), header("last-modified").alias("last_modified"), F.lit(None).cast("string").alias("extracted"))
    one = one.withColumn("rev", rev.cast(REVISION))
    seen = one.where("document IS NOT NULL").select(F.col("document").alias("_d"), F.when(F.col("outcome") == "revised", F.col("rev")).alias("_rev"))
    met = documents.join(seen, documents["id"] == F.col("_d"), "left")
    to = {"revisions": F.when(F.col("_rev").isNotNull(), F.concat("revisions", F.array("_rev"))).otherwise(F.col("revisions")), "last_checked": F.when(F.col("_d").isNotNull(), at).otherwise(F.col("last_checked"))}
    old = met.select(*[to.get(c, F.col(c)).alias(c) for c in documents.columns])

    fresh = one.where("outcome = 'new'").withColumn("base", F.substring(text.slugify(F.regexp_replace("filename", r"\.[^.]*$", "")), 1, ID_CHARS))
    fresh = rel.unique_ids(fresh, "base", "url", documents.select("id"), "new_id")
    new = fresh.select(F.col("new_id").alias("id"), "supplier", "product", text.title_from_filename(F.col("filename")).alias("title"), "url", "source_url", at.alias("first_seen"), at.alias("last_checked"), F.array("rev").alias("revisions"), F.lit(None).cast("array<string>").alias("models"))
    new = new.select(*[F.col(f.name).cast(f.dataType) for f in DOCUMENTS.fields])
    if "ord" in documents.columns:
        new = new.withColumn("ord", F.monotonically_increasing_id() + F.lit(1 << 60))
    after = old.unionByName(new)
    last = after.select(F.col("id").alias("document"), F.element_at("revisions", -1).alias("r"), F.get("revisions", F.size("revisions") - 2)["sha256"].alias("previous"), F.size("revisions").alias("n"))
    of_pass = last.where(F.col("r.captured_at") == at).select("document", "r.sha256", "previous", "r.captured_at", "n")
    return after, of_pass


def run(t: dict[str, DataFrame], found: DataFrame, responses: DataFrame, pages: DataFrame, layout: DataFrame, at: Column, interval_hours: float = 24.0, positions: DataFrame | None = None) -> Pass:
    """The catalog after a pass. pages: (sha256, page, variant, text), layout: (sha256, page, text), of the files of the responses.

    positions: lines with their boxes as of locate.refresh(); with them, values are located on their pages.

    Revised documents' values are rechecked first; then every document whose current revision this version of the
    extractor hasn't read gives the values that are still missing.
    """
    at_text = at.cast("string")
    found = cut(found, "found")
    files = cut(classify(found, responses, t["documents"]), "files")
    counts = pages.groupBy("sha256").agg(F.max("page").alias("pages"))
    after, of_pass = revise(t["documents"], files, counts, at)
    documents = cut(after, "documents")
    revs = cut(of_pass, "revisions")
    suppliers = t["suppliers"]
    current = cat.current_revision(documents).select("document", "sha256", "extracted")
    patterns = documents.select(F.col("id").alias("document"), F.col("supplier")).join(suppliers.select(F.col("id").alias("supplier"), "model_pattern"), "supplier", "left").select("document", "model_pattern")
    of_doc = lambda df: df.join(current.select("document", "sha256"), "sha256").drop("sha256")
    texts, laid = of_doc(pages), of_doc(layout)
    cands = cut(extract.candidates(laid, patterns), "candidates")

    revised = revs.where("n > 1")
    touched = t["specs"].join(revised.select("document"), "document", "left_semi").select(*t["specs"].columns)
    outcome = cut(verify.outcomes(touched, texts, cands), "outcomes")
    specs = cut(verify.apply_outcomes(t["specs"], outcome, revised), "specs")
    changed = verify.recheck_changes(touched, outcome, revised, documents, t["fields"])
    new_docs = revs.where("n = 1").join(documents.select(F.col("id").alias("document"), "product", "title"), "document")
    none = lambda c: F.lit(None).cast("string").alias(c)
    new_rows = new_docs.select(at_text.alias("at"), F.lit("new-datasheet").alias("type"), F.concat(F.lit(SUMMARY_NEW_DATASHEET), "title").alias("summary"), "product", "document", none("field"), F.col("sha256").alias("revision"), none("previous_revision"), none("value"), none("previous_value"), F.lit(None).cast("long").alias("count"))

    unread = current.where(~F.col("extracted").eqNullSafe(F.lit(EXTRACTOR_VERSION)))
    products = cat.all_products(suppliers, t["models"])
    ordered = documents if "ord" in documents.columns else documents.withColumn("ord", F.monotonically_increasing_id())
    offered = cands.join(unread.select("document"), "document", "left_semi")
    tied, made = publish.resolve(offered, ordered, products, suppliers, at)
    resolved, models = cut(tied, "resolved"), cut(made, "models")
    added = cut(publish.new_specs(resolved, specs, current, at), "added")
    log = publish.publish_changes(models, added, documents, suppliers, at)
    new_changes = cut(new_rows.unionByName(changed).unionByName(log).select(*[F.col(f.name).cast(f.dataType) for f in CHANGES.fields]), "changes")
    documents = cut(publish.mark_extracted(documents, resolved, unread.join(laid.select("document").distinct(), "document", "left_semi")), "documents")

    errors = files.where("problem IS NOT NULL").groupBy("source_url", "product").agg(F.substring(F.array_join(F.sort_array(F.collect_list(F.concat_ws(": ", "url", "problem"))), "; "), 1, ERROR_CHARS).alias("file_error"))
    good = files.where("problem IS NULL").groupBy("source_url", "product").agg(F.count("*").alias("files"))
    src = found.groupBy("supplier", "product", "name", "source_url").agg(F.max("error").alias("own_error"))
    results = src.join(errors, ["source_url", "product"], "left").join(good, ["source_url", "product"], "left").select("supplier", "product", "name", F.col("source_url").alias("url"), F.coalesce("files", F.lit(0)).cast("long").alias("files"), F.coalesce("own_error", "file_error").isNull().alias("ok"), F.coalesce("own_error", "file_error").alias("error"))

    values = specs.unionByName(added.select(*specs.columns))
    if positions is not None:
        values = cut(locate.refresh(values, positions), "located")
    status = _status(results, revs, outcome, added, models, at, interval_hours)
    tables = t | {"documents": documents, "specs": values, "models": t["models"].unionByName(models.select(*t["models"].columns)), "changes": t["changes"].unionByName(new_changes.select(*t["changes"].columns)), "status": status}
    return Pass(tables, files, results, new_changes)


def _status(results, revs, outcome, added, models, at: Column, interval_hours: float) -> DataFrame:
    """The run's one row: sums of sources, files, documents, values, models."""
    a = results.agg(F.count("*").alias("sources_checked"), F.coalesce(F.sum("files"), F.lit(0)).alias("files_checked"), F.count_if(~F.col("ok")).alias("errors"), F.sort_array(F.collect_list(F.struct("supplier", "product", "name", "url", "files", "ok", "error"))).alias("sources"))
    b = revs.agg(F.count_if(F.col("n") == 1).alias("new_documents"), F.count_if(F.col("n") > 1).alias("new_revisions"))
    c = outcome.agg(F.count_if(F.col("status") == "updated").alias("values_updated"), F.count_if(F.col("status") == "needs-check").alias("values_need_check"))
    d = added.agg(F.count("*").alias("values_extracted"))
    e = models.agg(F.count("*").alias("models_added"))
    one = a.join(b).join(c).join(d).join(e)  # one row each
    parts = ("sources_checked", "files_checked", "new_documents", "new_revisions", "values_updated", "values_need_check", "values_extracted", "models_added", "errors")
    return one.select(at.cast("string").alias("last_run_started"), at.cast("string").alias("last_run_finished"), F.lit(float(interval_hours)).alias("interval_hours"), F.struct(*[F.col(p).cast("long").alias(p) for p in parts]).alias("summary"), "sources")


def message(status: DataFrame) -> DataFrame:
    """(message): what a run changed, in a line."""
    s = lambda c: F.col(f"summary.{c}")
    part = lambda c, words: F.when(s(c) > 0, F.concat(s(c).cast("string"), F.lit(f" {words}")))
    parts = F.concat_ws(", ", part("new_documents", "new datasheet(s)"), part("new_revisions", "revised datasheet(s)"), part("values_updated", "value(s) updated"), part("values_need_check", "value(s) need checking"), part("models_added", "new model(s)"), part("values_extracted", "value(s) extracted"))
    changed = (s("new_documents") + s("new_revisions") + s("values_extracted") + s("models_added")) > 0
    problems = F.when(s("errors") > 0, F.format_string(", %d source problem(s)", s("errors"))).otherwise(F.lit(""))
    nothing = F.concat(F.lit("checked "), s("sources_checked").cast("string"), F.lit(" sources, no datasheet changes"))
    return status.select(F.concat(F.lit("Collector: "), F.when(changed, parts).otherwise(nothing), problems).alias("message"))
