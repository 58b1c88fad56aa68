"""Published values against a new revision of their document: found again, read anew, or to be checked.

Specs meet the pages of their own document only (an equi-join). Pages are compacted once each. Patterns are built per
row from the quoted text, and only for values whose quote wasn't found as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.fixed import CONFIRMED, EVIDENCE_NUMBER, EXTRACTED, NEEDS_CHECK, SUMMARY_NOT_FOUND, SUMMARY_REVISED, UPDATED
from specloom.functions import text as tx
from specloom.functions.values import decimal_comma_number, plausible_change

MIN_CONTEXT = 6
TAIL_CHARS = 40
UNIT_CHARS = 4
OUTCOME = ["status", "value", "numeric", "page", "evidence", "anchor"]


def _extract(text: Column, pattern: Column, group: int) -> Column:
    """regexp_extract with a pattern of the row's own."""
    return F.call_function("regexp_extract", text, pattern, F.lit(group))


def loose_pattern(compacted: Column) -> Column:
    """A pattern for the characters of a compacted text with any white space between them."""
    each = F.transform(F.split(compacted, "(?!^)"), lambda c: F.concat(F.lit(r"\Q"), c, F.lit(r"\E")))
    return F.when(F.length(compacted) > 0, F.array_join(each, r"\s*")).otherwise(F.lit(""))


def split_on_value(evidence: Column, value: Column) -> Column:
    """struct(prefix, unit, suffix) around a plain number in a quote; both compacted. Null if it isn't there.

    The number may not be part of a longer one.
    """
    rx = F.concat(F.lit(r"(?U)^(.*?)(?<!\d)\Q"), value, F.lit(r"\E(?![\d.,])"))
    prefix = _extract(evidence, rx, 1)
    suffix = F.substring(evidence, F.length(prefix) + F.length(value) + 1, F.length(evidence))
    number = F.regexp_like(value, F.lit(rf"(?U)^{EVIDENCE_NUMBER}$"))
    unit = F.regexp_extract(suffix, rf"(?U)^\D{{0,{UNIT_CHARS}}}", 0)
    return F.when(number & F.regexp_like(evidence, rx), F.struct(prefix.alias("prefix"), unit.alias("unit"), suffix.alias("suffix")))


def reading_pattern(parts: Column) -> Column:
    """Where the new number stands: behind the old label and before the old unit, else before the old text; null if both are short."""
    behind = F.concat(loose_pattern(parts["prefix"]), F.lit(rf"\s*({EVIDENCE_NUMBER})"), F.when(F.length(parts["unit"]) > 0, F.concat(F.lit(r"\s*"), loose_pattern(parts["unit"]))).otherwise(F.lit("")))
    before = F.concat(F.lit(rf"({EVIDENCE_NUMBER})\s*"), loose_pattern(parts["suffix"]))
    return F.concat(F.lit("(?iuU)"), F.when(F.length(parts["prefix"]) >= MIN_CONTEXT, behind).when(F.length(parts["suffix"]) >= MIN_CONTEXT, before))


def recheck_quoted(specs: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, status, value, numeric, page, evidence, anchor): outcome of each spec by its quoted text.

    specs: id, document, value, numeric, page, evidence, anchor. pages: (document, page, variant, text) of the new
    revisions. A spec whose document has no pages is to be checked. The first page, then variant, that matches counts.
    """
    flat = pages.select("document", F.col("page").alias("page_no"), "variant", tx.normalize(F.col("text")).alias("flat"))
    flat = flat.withColumn("packed", F.lower(F.regexp_replace("flat", r"(?U)\s+", "")))
    quoted = specs.select("id", "document", "value", "numeric", "page", "evidence", tx.compact(F.coalesce(F.nullif("anchor", F.lit("")), F.col("evidence"))).alias("quote"), tx.compact(F.col("value")).alias("packed_value"))
    quoted = quoted.withColumn("pattern", reading_pattern(split_on_value(F.col("quote"), F.col("packed_value"))))
    met = quoted.join(flat, "document", "left")
    found = F.contains("packed", "quote")
    whole = F.concat(F.col("pattern"), F.lit(rf"([^\n]{{0,{TAIL_CHARS}}})"))
    read = F.when(~found & F.regexp_like("flat", F.col("pattern")), F.struct("page_no", "variant", F.regexp_replace(_extract(F.col("flat"), F.col("pattern"), 1), r"(?U)\s+", "").alias("text"), tx.squeeze(_extract(F.col("flat"), whole, 0)).alias("snippet")))
    best = met.groupBy("id").agg(
        *[F.any_value(c).alias(c) for c in ("value", "numeric", "page", "evidence")],
        F.min(F.when(found, F.struct("page_no", "variant"))).alias("found"),
        F.min(read).alias("read"),
    )
    old, new = decimal_comma_number(F.col("value")), decimal_comma_number(F.col("read.text"))
    same = F.col("found").isNotNull()
    kept = ~same & F.col("read").isNotNull() & (new == old)
    moved = ~same & ~F.coalesce(kept, F.lit(False)) & F.col("read").isNotNull() & plausible_change(old, new)
    kept, moved = F.coalesce(kept, F.lit(False)), F.coalesce(moved, F.lit(False))
    return best.select(
        "id",
        F.when(same | kept, CONFIRMED).when(moved, UPDATED).otherwise(NEEDS_CHECK).alias("status"),
        F.when(moved, F.regexp_replace("read.text", r"^\++", "")).otherwise(F.col("value")).alias("value"),
        F.when(moved, new).otherwise(F.col("numeric")).alias("numeric"),
        F.when(same, F.col("found.page_no")).when(kept | moved, F.col("read.page_no")).otherwise(F.col("page")).cast("long").alias("page"),
        F.when(kept | moved, F.col("read.snippet")).otherwise(F.col("evidence")).alias("evidence"),
        F.lit(None).cast("string").alias("anchor"),
    )


def recheck_extracted(specs: DataFrame, candidates: DataFrame) -> DataFrame:
    """The same outcome for values that the extractor made: the candidate of their field and model in the new revision.

    Equal text confirms. Other text updates, unless both have numbers and the change isn't plausible. No candidate
    asks for a check.
    """
    first = candidates.groupBy("document", "field", "model").agg(F.min_by(F.struct("value", "numeric", "page", "evidence", "anchor"), "ord").alias("c"))
    s, c = specs.alias("s"), first.alias("f")
    met = s.join(c, (F.col("s.document") == F.col("f.document")) & (F.col("s.field") == F.col("f.field")) & F.col("s.extractor.model").eqNullSafe(F.col("f.model")), "left")
    same = F.col("f.c.value") == F.col("s.value")
    wild = ~same & F.col("f.c.numeric").isNotNull() & F.col("s.numeric").isNotNull() & ~plausible_change(F.col("s.numeric"), F.col("f.c.numeric"))
    check = F.col("f.c").isNull() | F.coalesce(wild, F.lit(False))
    pick = lambda n: F.when(check, F.col(f"s.{n}")).otherwise(F.col(f"f.c.{n}"))
    return met.select(
        "s.id",
        F.when(check, NEEDS_CHECK).when(same, CONFIRMED).otherwise(UPDATED).alias("status"),
        pick("value").alias("value"),
        pick("numeric").alias("numeric"),
        pick("page").cast("long").alias("page"),
        pick("evidence").alias("evidence"),
        F.when(~check, F.col("f.c.anchor")).alias("anchor"),
    )


def outcomes(specs: DataFrame, pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each spec's outcome: extractor-made values by candidates, all others by their quotes."""
    return recheck_extracted(specs.where("extractor IS NOT NULL"), candidates).unionByName(recheck_quoted(specs.where("extractor IS NULL"), pages))


def next_status(old: Column, outcome: Column) -> Column:
    """A confirmed value that nobody has reviewed stays extracted; any other outcome is the new status."""
    return F.when((outcome == CONFIRMED) & (old == EXTRACTED), F.lit(EXTRACTED)).otherwise(outcome)


def apply_outcomes(specs: DataFrame, found: DataFrame, revisions: DataFrame) -> DataFrame:
    """specs after a recheck: the replaced state is put before the history; specs without an outcome stay as they are.

    revisions: (document, sha256, captured_at) of the new revisions. A value to be checked keeps its old revision,
    page and quote. reviewed_at and conditions stay as they were.
    """
    names = specs.columns
    rev = revisions.select(F.col("document").alias("_d"), F.col("sha256").alias("_sha"), F.col("captured_at").alias("_at"))
    new = found.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in OUTCOME])
    met = specs.join(new, specs["id"] == F.col("_id"), "left").join(rev, specs["document"] == F.col("_d"), "left")
    hit = F.col("_id").isNotNull()
    moved = hit & (F.col("_status") != NEEDS_CHECK)
    updated = hit & (F.col("_status") == UPDATED)
    state = F.struct("value", "numeric", "page", "evidence", "anchor", "revision", "status", "reviewed_by", "checked_at")
    kind = specs.schema["history"].dataType.simpleString()
    to = {
        "history": F.when(hit, F.concat(F.array(state).cast(kind), F.coalesce("history", F.array().cast(kind)))).otherwise(F.col("history")),
        "status": F.when(hit, next_status(F.col("status"), F.col("_status"))).otherwise(F.col("status")),
        "checked_at": F.when(hit, F.col("_at")).otherwise(F.col("checked_at")),
        "reviewed_by": F.when(~hit, F.col("reviewed_by")),
        "revision": F.when(moved, F.col("_sha")).otherwise(F.col("revision")),
        "page": F.when(moved, F.col("_page")).otherwise(F.col("page")),
        "evidence": F.when(moved, F.col("_evidence")).otherwise(F.col("evidence")),
        "anchor": F.when(moved & F.col("_anchor").isNotNull(), F.col("_anchor")).when(updated, F.lit(None)).otherwise(F.col("anchor")),
        "value": F.when(updated, F.col("_value")).otherwise(F.col("value")),
        "numeric": F.when(updated, F.col("_numeric")).otherwise(F.col("numeric")),
    }
    return met.select(*[to.get(c, F.col(c)).alias(c) for c in names])


def outcome_counts(specs: DataFrame, found: DataFrame) -> DataFrame:
    """(document, confirmed, updated, needs_check) of a recheck."""
    met = specs.select("id", "document").join(found.select("id", F.col("status").alias("_s")), "id")
    count = lambda s: F.count_if(F.col("_s") == s)
    return met.groupBy("document").agg(count(CONFIRMED).alias("confirmed"), count(UPDATED).alias("updated"), count(NEEDS_CHECK).alias("needs_check"))


def recheck_changes(specs: DataFrame, found: DataFrame, revisions: DataFrame, documents: DataFrame, fields: DataFrame) -> DataFrame:
    """Change entries of a recheck: needs-check and value-changed by value, datasheet-revised by document.

    revisions: (document, sha256, previous, captured_at). A field without a definition is named by its key.
    """
    fd = fields.select(F.col("key").alias("field"), "label", "unit")
    rev = revisions.select("document", F.col("sha256").alias("revision"), F.col("previous").alias("previous_revision"), F.col("captured_at").alias("at"))
    old = specs.select("id", "product", "field", "document", F.col("value").alias("previous_value"))
    met = found.select("id", "status", "value").join(old, "id").join(rev, "document").join(fd, "field", "left")
    label = F.coalesce("label", "field")
    check = met.where(F.col("status") == NEEDS_CHECK).select("at", F.lit("needs-check").alias("type"), F.concat(label, F.lit(SUMMARY_NOT_FOUND)).alias("summary"), "product", "document", "field", "revision", "previous_revision", F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("previous_value"))
    text = F.trim(F.concat(label, F.lit(": "), F.col("previous_value"), F.lit(" → "), F.col("value"), F.lit(" "), F.coalesce("unit", F.lit(""))))
    changed = met.where(F.col("status") == UPDATED).select("at", F.lit("value-changed").alias("type"), text.alias("summary"), "product", "document", "field", "revision", "previous_revision", "value", "previous_value")
    counts = rev.join(outcome_counts(specs, found), "document", "left").join(documents.select(F.col("id").alias("document"), "product", "title"), "document", "left").na.fill(0, ["confirmed", "updated", "needs_check"])
    said = F.format_string(SUMMARY_REVISED, "title", "confirmed", "updated", "needs_check")
    revised = counts.select("at", F.lit("datasheet-revised").alias("type"), said.alias("summary"), "product", "document", F.lit(None).cast("string").alias("field"), "revision", "previous_revision", F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("previous_value"))
    return check.unionByName(changed).unionByName(revised).withColumn("count", F.lit(None).cast("long"))
