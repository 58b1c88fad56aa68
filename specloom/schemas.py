"""Schemas of the catalog's tables. Nothing is inferred: inference reorders columns and drops keys that no row has."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D, _B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _row(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def _list(of: T.DataType) -> T.ArrayType:
    return T.ArrayType(of)


SOURCE = _row(name=_S, url=_S, allowed_hosts=_list(_S), link_pattern=_S)
PRODUCT = _row(id=_S, model=_S, summary=_S, kind=_S, market=_S, notes=_S, family=_S, sources=_list(SOURCE))
COMPANY = _row(
    hq_country=_S,
    hq_city=_S,
    parent=_row(name=_S, country=_S, note=_S),
    sources=_list(_row(title=_S, url=_S)),
    reviewed_by=_S,
    reviewed_at=_S,
)
SUPPLIERS = _row(id=_S, name=_S, website=_S, notes=_S, model_pattern=_S, company=COMPANY, products=_list(PRODUCT))
MODELS = _row(id=_S, supplier=_S, model=_S, summary=_S, kind=_S, market=_S, family=_S, auto=_B, found_in=_S, first_seen=_S)
FIELDS = _row(key=_S, label=_S, unit=_S, kind=_S, group=_S, short=_S)
REVISION = _row(sha256=_S, file=_S, bytes=_L, pages=_L, captured_at=_S, etag=_S, last_modified=_S, extracted=_S)
DOCUMENTS = _row(id=_S, supplier=_S, product=_S, title=_S, url=_S, source_url=_S, first_seen=_S, last_checked=_S, revisions=_list(REVISION), models=_list(_S))
HISTORY = _row(value=_S, numeric=_D, page=_L, evidence=_S, anchor=_S, revision=_S, status=_S, reviewed_by=_S, checked_at=_S)
HIGHLIGHT = _row(revision=_S, page=_L, image=_S, row=_list(_D), cell=_list(_D))
SPECS = _row(
    id=_S,
    product=_S,
    field=_S,
    value=_S,
    numeric=_D,
    conditions=_S,
    evidence=_S,
    anchor=_S,
    document=_S,
    revision=_S,
    page=_L,
    status=_S,
    extracted_by=_S,
    extractor=_row(version=_S, model=_S),
    reviewed_by=_S,
    reviewed_at=_S,
    checked_at=_S,
    history=_list(HISTORY),
    highlight=HIGHLIGHT,
)
CHANGES = _row(at=_S, type=_S, summary=_S, product=_S, document=_S, field=_S, revision=_S, previous_revision=_S, value=_S, previous_value=_S, count=_L)
STATUS = _row(
    last_run_started=_S,
    last_run_finished=_S,
    interval_hours=_D,
    summary=_row(sources_checked=_L, files_checked=_L, new_documents=_L, new_revisions=_L, values_updated=_L, values_need_check=_L, values_extracted=_L, models_added=_L, errors=_L),
    sources=_list(_row(supplier=_S, product=_S, name=_S, url=_S, files=_L, ok=_B, error=_S)),
)

TABLES = {"suppliers": SUPPLIERS, "models": MODELS, "fields": FIELDS, "documents": DOCUMENTS, "specs": SPECS, "changes": CHANGES, "status": STATUS}
#: Tables that the engine writes; the others belong to people.
OWNED = ("models", "documents", "specs", "changes", "status")
