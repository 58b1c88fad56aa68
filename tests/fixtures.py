"""A small catalog: two suppliers, a family, one document with two revisions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from specloom import schemas as sc


def table(spark: SparkSession, name: str, rows: list[dict]):
    schema = sc.TABLES[name]

    def fill(v, t):
        if v is None:
            return None
        if t.typeName() == "struct":
            return tuple(fill(v.get(f.name), f.dataType) for f in t.fields)
        if t.typeName() == "array":
            return [fill(x, t.elementType) for x in v]
        return v

    return spark.createDataFrame([fill(r, schema) for r in rows], schema)


def suppliers():
    return [
        {
            "id": "acme",
            "name": "Acme Drives",
            "model_pattern": r"\bAX\d{3}\b",
            "company": {"hq_country": "DE", "hq_city": "Kiel", "parent": {"name": "Acme Group", "country": "JP"}, "sources": [{"title": "About", "url": "https://acme.example/about"}], "reviewed_by": "me", "reviewed_at": "2024-01-01"},
            "products": [
                {"id": "ax", "model": "AX series", "kind": "Inverter family", "summary": "All of AX", "sources": [{"name": "AX page", "url": "https://acme.example/ax", "allowed_hosts": ["files.acme.example"], "link_pattern": "datasheet, ax"}]},
                {"id": "bx10", "model": "BX10", "kind": "Inverter", "market": "EU", "summary": "Small", "sources": [{"name": "BX10 file", "url": "https://acme.example/bx10.pdf", "allowed_hosts": []}]},
            ],
        },
        {"id": "zeta", "name": "Zeta Works", "company": {"hq_country": "US"}, "products": [{"id": "z1", "model": "Z1", "kind": "Inverter", "sources": []}]},
    ]


def fields():
    return [
        {"key": "rated_kva", "label": "Rated power", "unit": "kVA", "kind": "number", "group": "Power"},
        {"key": "dc_max_v", "label": "Max DC voltage", "unit": "V", "kind": "number", "group": "DC side"},
        {"key": "mv_voltage_kv", "label": "MV voltage", "unit": "kV", "kind": "number", "group": "AC side"},
        {"key": "frequency_hz", "label": "Frequency", "unit": "Hz", "kind": "number", "group": "AC side"},
        {"key": "efficiency_max_pct", "label": "Max efficiency", "unit": "%", "kind": "number", "group": "Efficiency"},
        {"key": "cooling", "label": "Cooling", "unit": "", "kind": "text", "group": "Other"},
    ]


def models():
    return [{"id": f"acme-ax{n}", "supplier": "acme", "model": f"AX{n}", "family": "ax", "auto": True, "found_in": "doc", "first_seen": "2024-01-02"} for n in (300, 1000, 200)]


def value(product, field, text, numeric=None, status="extracted", **more):
    return {"id": f"{product}:{field}", "product": product, "field": field, "value": text, "numeric": numeric, "evidence": f"{field} {text}", "document": "doc", "revision": "r2", "page": 1, "status": status, "checked_at": "2024-01-03", "history": []} | more


def specs():
    return [
        value("acme-ax200", "rated_kva", "200", 200.0),
        value("acme-ax300", "rated_kva", "300", 300.0, "reviewed"),
        value("acme-ax1000", "rated_kva", "1000", 1000.0, "needs-check"),
        value("acme-ax200", "cooling", "air"),
        value("acme-ax300", "cooling", "water"),
        value("bx10", "rated_kva", "10", 10.0, "confirmed", evidence="Rated power 10 kVA @ 40 °C"),
        value("bx10", "dc_max_v", "900", 900.0, "updated", history=[{"value": "800", "numeric": 800.0, "revision": "r1", "status": "reviewed"}]),
        value("bx10", "mv_voltage_kv", "20", 20.0),
    ]


def documents():
    rev = lambda s: {"sha256": s, "file": f"datasheets/{s}/x.pdf", "bytes": 1_500_000, "pages": 3, "captured_at": "2024-01-02", "extracted": "rules-2"}
    return [{"id": "doc", "supplier": "acme", "product": "bx10", "title": "BX10 sheet", "url": "https://acme.example/bx10.pdf", "source_url": "https://acme.example/bx10.pdf", "first_seen": "2024-01-01", "last_checked": "2024-01-02", "revisions": [rev("r1"), rev("r2")], "models": ["acme-ax200", "bx10"]}]


def changes():
    return [
        {"at": "2024-01-02T10:00:00Z", "type": "new-datasheet", "summary": "x", "document": "doc", "product": "bx10"},
        {"at": "2024-01-02T11:00:00Z", "type": "values-extracted", "summary": "x", "document": "doc", "product": "bx10", "count": 3},
        {"at": "2024-01-02T12:00:00Z", "type": "values-extracted", "summary": "x", "document": "doc", "product": "bx10", "count": 4},
        {"at": "2024-01-03T12:00:00Z", "type": "needs-check", "summary": "x", "product": "acme-ax1000", "field": "rated_kva"},
    ]


def status():
    return [{"last_run_started": "2024-01-03T00:00:00Z", "last_run_finished": "2024-01-03T00:01:00Z", "interval_hours": 24.0, "summary": {"sources_checked": 2}, "sources": [{"supplier": "acme", "product": "ax", "name": "AX page", "url": "u", "files": 0, "ok": False, "error": "No matching PDF links on the page."}]}]


def catalog(spark: SparkSession) -> dict:
    t = {"suppliers": suppliers(), "fields": fields(), "models": models(), "specs": specs(), "documents": documents(), "changes": changes(), "status": status()}
    out = {k: table(spark, k, v) for k, v in t.items()}
    order = spark.createDataFrame([(f["key"], i) for i, f in enumerate(fields())], "key string, ord int")
    out["fields"] = out["fields"].join(order, "key")
    return out
