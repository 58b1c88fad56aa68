"""Constraints of the catalog: a row (rule, subject, problem) for each violation, none for a sound catalog."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.fixed import STATUSES
from specloom.operators.catalog import all_products, configured_products, revisions
from specloom.operators.relational import duplicates, orphans, outside_domain

BOX_LOW, BOX_HIGH = -0.05, 1.05


def _rows(rule: str, df: DataFrame, subject: Column | str, problem: Column) -> DataFrame:
    s = F.col(subject) if isinstance(subject, str) else subject
    return df.select(F.lit(rule).alias("rule"), s.cast("string").alias("subject"), problem.alias("problem"))


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def _bad_country(c: Column) -> Column:
    return ~F.coalesce(F.regexp_like(c, F.lit("^[A-Z]{2}$")), F.lit(False))


def ids(table: DataFrame, what: str) -> list[DataFrame]:
    missing = table.where(_blank(F.col("id")))
    twice = duplicates(table.where(~_blank(F.col("id"))), "id")
    return [_rows("id-missing", missing, F.lit(what), F.lit(f"{what} without id")), _rows("id-duplicate", twice, "id", F.lit(f"duplicate {what} id"))]


def company(suppliers: DataFrame) -> list[DataFrame]:
    own = suppliers.where("company IS NOT NULL")
    parent = own.where("company.parent IS NOT NULL")
    named = parent.where(~_blank(F.col("company.parent.name")))
    sources = own.select("id", F.explode("company.sources").alias("s"))
    return [
        _rows("company-country", own.where(_bad_country(F.col("company.hq_country"))), "id", F.lit("hq_country must be two capital letters")),
        _rows("company-parent", parent.where(_blank(F.col("company.parent.name"))), "id", F.lit("parent without a name")),
        _rows("company-parent", named.where(_bad_country(F.col("company.parent.country"))), "id", F.lit("country of the parent must be two capital letters")),
        _rows("company-source", sources.where(_blank(F.col("s.title")) | ~F.coalesce(F.startswith("s.url", F.lit("https://")), F.lit(False))), "id", F.lit("a source needs a title and an https:// url")),
        _rows("company-review", own.where(_blank(F.col("company.reviewed_by")) != _blank(F.col("company.reviewed_at"))), "id", F.lit("reviewed_by and reviewed_at go together")),
    ]


def references(child: DataFrame, column: str, parent: DataFrame, key: str, rule: str, subject: str = "id") -> DataFrame:
    """Rows of child whose column names no row of parent; null names nothing and is no problem of this kind."""
    lost = orphans(child, column, parent, key)
    return _rows(rule, lost, subject, F.concat(F.lit("unknown "), F.lit(column), F.lit(" "), F.col(column)))


def _bad_box(c: Column) -> Column:
    inside = F.forall(c, lambda v: v.isNotNull() & v.between(BOX_LOW, BOX_HIGH))
    return c.isNotNull() & ~((F.size(c) == 4) & inside)


def problems(t: dict[str, DataFrame], files: DataFrame | None = None, images: bool = True) -> DataFrame:
    """All violations of the tables suppliers, models, fields, documents, specs.

    files: (path, sha256) of the archived files; sha256 may be null where it wasn't computed. Without it, files
    aren't looked at; images: whether page images are among them.
    """
    suppliers, models, documents, specs = t["suppliers"], t["models"], t["documents"], t["specs"]
    products = all_products(suppliers, models)
    revs = revisions(documents)
    out = [*ids(suppliers, "supplier"), *ids(configured_products(suppliers).select("id").unionByName(models.select("id")), "product"), *ids(documents, "document"), *company(suppliers)]
    out.append(references(models, "supplier", suppliers, "id", "model-supplier"))
    out.append(references(documents, "supplier", suppliers, "id", "document-supplier"))
    out.append(references(documents, "product", products, "id", "document-product"))
    out.append(_rows("document-revisions", documents.where(F.size(F.coalesce("revisions", F.array())) == 0), "id", F.lit("no revision")))
    out.append(_rows("id-duplicate", duplicates(specs, "id"), "id", F.lit("duplicate value id")))
    out.append(references(specs, "product", products, "id", "spec-product"))
    out.append(references(specs, "field", t["fields"], "key", "spec-field"))
    out.append(_rows("spec-status", outside_domain(specs, "status", STATUSES), "id", F.lit("unknown status")))
    keys = revs.select(F.col("document").alias("_d"), F.col("sha256").alias("_s"))
    lost = specs.join(keys, F.col("document").eqNullSafe(F.col("_d")) & F.col("revision").eqNullSafe(F.col("_s")), "left_anti")
    out.append(_rows("spec-revision", lost, "id", F.lit("its document has no such revision")))
    out.append(_rows("spec-evidence", specs.where(_blank(F.col("evidence"))), "id", F.lit("no evidence")))
    marked = specs.where("highlight IS NOT NULL")
    image = F.col("highlight.image")
    out.append(_rows("highlight-image", marked.where(~F.coalesce(F.startswith(image, F.lit("datasheets/")) & ~F.contains(image, F.lit("..")), F.lit(False))), "id", F.lit("image outside the archive")))
    for part in ("row", "cell"):
        out.append(_rows(f"highlight-{part}", marked.where(_bad_box(F.col(f"highlight.{part}"))), "id", F.lit(f"{part} must be four fractions of the page")))
    old = specs.select("id", F.explode("history").alias("h")).select("id", F.col("h.revision").alias("revision"))
    out.append(references(old, "revision", revs.select("sha256").distinct(), "sha256", "history-revision"))
    if files is not None:
        f = files.select(F.col("path").alias("_p"), F.col("sha256").alias("_f"))
        met = revs.join(f, F.col("file") == F.col("_p"), "left")
        out.append(_rows("file-missing", met.where("_p IS NULL"), "document", F.concat(F.lit("missing file "), F.coalesce("file", F.lit("")))))
        out.append(_rows("file-digest", met.where("_f IS NOT NULL AND _f <> sha256"), "document", F.concat(F.lit("digest differs: "), F.col("file"))))
    if files is not None and images:
        safe = marked.where(F.startswith(image, F.lit("datasheets/")) & ~F.contains(image, F.lit("..")))
        out.append(_rows("highlight-missing", safe.join(f, image == F.col("_p"), "left_anti"), "id", F.lit("missing image")))
    return reduce(DataFrame.unionByName, out)
