"""Views and queries of a small catalog, its constraints, and where values stand on pages."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from specloom.operators import catalog as cat
from specloom.operators import locate, validate
from specloom.plans import query as q
from tests import fixtures as fx


@pytest.fixture(scope="module")
def t(spark):
    return {k: v.persist() for k, v in fx.catalog(spark).items()}


def ids(df, *columns):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()]


def test_products_and_families(t):
    products = cat.all_products(t["suppliers"], t["models"])
    assert sorted(ids(products, "id")) == ["acme-ax1000", "acme-ax200", "acme-ax300", "ax", "bx10", "z1"]
    assert ids(cat.families(products, t["specs"]).where("is_container"), "id") == ["ax"]
    assert sorted(ids(cat.country_facet(t["suppliers"]), "country", "n_suppliers")) == [("DE", 1), ("JP", 1), ("US", 1)]
    assert sorted(ids(cat.document_products(t["documents"]), "product")) == ["acme-ax200", "bx10"]
    assert sorted(ids(cat.revisions(t["documents"]), "rev_no", "previous", "is_current")) == [(1, None, False), (2, "r1", True)]


def test_sources_and_their_hosts(t):
    got = {r.product: r for r in cat.product_sources(t["suppliers"]).collect()}
    assert sorted(got["ax"].hosts) == ["acme.example", "files.acme.example"]
    assert got["ax"].patterns == ["datasheet", "ax"]
    assert got["bx10"].patterns == []


def test_catalog_in_order(t):
    rows = q.catalog(t, q.QuerySpec()).collect()
    assert [(r.id, r.is_member) for r in rows] == [("bx10", False), ("ax", False), ("acme-ax300", True), ("acme-ax1000", True), ("acme-ax200", True), ("z1", False)]
    by_id = {r.id: r for r in rows}
    assert by_id["ax"].power == "200-1,000 kVA"
    assert by_id["ax"].pill == "1 under review"
    assert by_id["z1"].group_key == "_collecting"
    assert by_id["bx10"].dc_max_v == "900 V"
    assert [r.id for r in rows][-1] == "z1"


def test_natural_and_column_sorts(t):
    names = lambda s: [r.id for r in q.catalog(t, q.QuerySpec.parse(s)).collect()]
    assert names("sort=name") == ["ax", "acme-ax200", "acme-ax300", "acme-ax1000", "bx10", "z1"]
    assert names("sort=power") == ["ax", "acme-ax1000", "acme-ax300", "acme-ax200", "bx10", "z1"]
    assert names("sort=power&dir=asc") == ["bx10", "ax", "acme-ax200", "acme-ax300", "acme-ax1000", "z1"]


def test_filters(t):
    names = lambda s: sorted(r.id for r in q.catalog(t, q.QuerySpec.parse(s)).collect())
    assert names("q=ax300") == ["acme-ax300", "ax"]
    assert names("q=inverter+eu") == ["bx10"]
    assert names("q=nothing+here") == []
    assert names("supplier=zeta") == ["z1"]
    assert names("only=JP,FR") == ["acme-ax1000", "acme-ax200", "acme-ax300", "ax", "bx10"]
    assert names("hide=JP") == ["z1"]
    assert names("show=none") == ["z1"]
    assert names("show=auto") == ["acme-ax200", "ax"]
    assert {r.show: r.n for r in q.facets(t).collect()} == {"all": 5, "reviewed": 3, "auto": 1, "none": 1}


def test_query_strings_round_trip():
    s = q.QuerySpec.parse("?q=a+b&show=auto&only=DE,JP&cols=cooling,power&sort=power&dir=asc&diff=1&f=x")
    assert s.countries == ("DE", "JP") and not s.hide and s.columns == ("cooling", "power") and s.differing
    assert q.QuerySpec.parse(s.to_query()) == s
    assert q.QuerySpec().to_query() == ""


def test_columns(t):
    known = q.known_columns(t)
    assert [c.id for c in q.shown_columns(known, ())] == ["power", "dc_max_v", "grid", "eff"]
    assert [c.id for c in q.shown_columns(known, ("cooling", "nope", "power"))] == ["power", "cooling"]
    assert "frequency_hz" not in known
    rows = {r.id: r for r in q.catalog(t, q.QuerySpec(columns=("cooling",))).collect()}
    assert rows["ax"].cooling == "Varies" and rows["acme-ax300"].cooling == "water"


def test_compare(t):
    got = {r.field: r.asDict() for r in q.compare(t, ["acme-ax200", "bx10"]).collect()}
    assert got["rated_kva"]["acme-ax200"] == "200 kVA" and got["rated_kva"]["differs"]
    assert got["cooling"]["bx10"] is None and not got["cooling"]["differs"]
    assert ids(q.compare(t, ["acme-ax200", "bx10"], differing=True), "field") == ["rated_kva"]
    with pytest.raises(ValueError, match="compared"):
        q.compare(t, list("abcde"))
    assert sorted(ids(q.compare_candidates(t, ["bx10"]), "id")) == ["acme-ax1000", "acme-ax200", "acme-ax300"]
    assert q.toggled(["a", "b", "c", "d"], "e") == ["a", "b", "c", "d"]
    assert q.only_existing(t, ["bx10", "gone"]) == ["bx10"]


def test_model_view(t):
    rows = q.model_values(t, "bx10").collect()
    assert [r.field for r in rows] == ["rated_kva", "dc_max_v", "mv_voltage_kv"]
    assert rows[0].condition == "40 °C" and rows[1].previous_value == "800" and not rows[1].from_older_revision
    assert ids(q.headline(t, "bx10"), "label", "text") == [("Rated power", "10 kVA"), ("DC range", "900 V"), ("Grid", "20 kV")]
    assert q.headline(t, "acme-ax200").count() == 0
    assert sorted(ids(q.relatives(t, "acme-ax200"), "id")) == ["acme-ax1000", "acme-ax300"]
    assert q.selected_value(t, "bx10", "mv_voltage_kv").first().field == "mv_voltage_kv"
    assert q.selected_value(t, "bx10").first().field == "rated_kva"


def test_library_updates_and_status(t):
    assert ids(q.library(t, "sheet"), "id", "size", "n_revisions") == [("doc", "1.4 MB", 2)]
    assert q.library(t, "nothing").count() == 0
    assert ids(q.waiting_suppliers(t), "id") == ["zeta"]
    got = ids(q.updates(t), "type", "supplier", "n", "total")
    assert got == [("needs-check", "acme", 1, None), ("new-datasheet", "acme", 1, None), ("values-extracted", "acme", 2, 7)]
    s = q.source_status(t, F.to_timestamp(F.lit("2024-01-06T00:00:00Z"))).first()
    assert s.problem == "no matching links" and s.stale


def test_sound_catalog_has_no_problems(t):
    assert validate.problems(t).collect() == []


FAULTS = {
    "id-duplicate": ("specs", lambda rows: [*rows, rows[0]]),
    "id-missing": ("documents", lambda rows: [rows[0], rows[0] | {"id": None}]),
    "company-country": ("suppliers", lambda rows: [rows[0], rows[1] | {"company": {"hq_country": "usa"}}]),
    "company-parent": ("suppliers", lambda rows: [rows[0], rows[1] | {"company": {"hq_country": "US", "parent": {"country": "US"}}}]),
    "company-source": ("suppliers", lambda rows: [rows[0], rows[1] | {"company": {"hq_country": "US", "sources": [{"title": "x", "url": "http://x"}]}}]),
    "company-review": ("suppliers", lambda rows: [rows[0], rows[1] | {"company": {"hq_country": "US", "reviewed_by": "me"}}]),
    "model-supplier": ("models", lambda rows: [*rows, {"id": "m", "supplier": "nobody"}]),
    "document-supplier": ("documents", lambda rows: [rows[0] | {"supplier": "nobody"}]),
    "document-product": ("documents", lambda rows: [rows[0] | {"product": "nothing"}]),
    "document-revisions": ("documents", lambda rows: [*rows, rows[0] | {"id": "empty", "revisions": []}]),
    "spec-product": ("specs", lambda rows: [*rows, fx.value("nothing", "cooling", "x")]),
    "spec-field": ("specs", lambda rows: [*rows, fx.value("bx10", "nothing", "x")]),
    "spec-status": ("specs", lambda rows: [*rows, fx.value("bx10", "cooling", "x", status="odd")]),
    "spec-revision": ("specs", lambda rows: [*rows, fx.value("bx10", "cooling", "x", revision="r9")]),
    "spec-evidence": ("specs", lambda rows: [*rows, fx.value("bx10", "cooling", "x", evidence=" ")]),
    "highlight-image": ("specs", lambda rows: [*rows, fx.value("bx10", "cooling", "x", highlight={"image": "datasheets/../x"})]),
    "highlight-row": ("specs", lambda rows: [*rows, fx.value("bx10", "cooling", "x", highlight={"image": "datasheets/x.jpg", "row": [0.1, 0.2, 0.3, 1.2]})]),
    "history-revision": ("specs", lambda rows: [*rows, fx.value("bx10", "cooling", "x", history=[{"revision": "r9"}])]),
}


@pytest.mark.parametrize("rule", sorted(FAULTS))
def test_one_fault_is_one_problem(spark, t, rule):
    name, break_ = FAULTS[rule]
    bad = t | {name: fx.table(spark, name, break_(getattr(fx, name)()))}
    assert [r.rule for r in validate.problems(bad).collect()] == [rule]


def test_files_are_checked_when_listed(spark, t):
    files = spark.createDataFrame([("datasheets/r1/x.pdf", "other")], "path string, sha256 string")
    assert sorted(r.rule for r in validate.problems(t, files).collect()) == ["file-digest", "file-missing"]


LINES = "document string, page int, width double, height double, line_no int, x0 double, y0 double, x1 double, y1 double, text string"


def at(spark, specs, lines):
    s = spark.createDataFrame([(f"s{i}", "d", 1, *x) for i, x in enumerate(specs)], "id string, document string, page int, value string, evidence string, model string")
    ls = spark.createDataFrame([("d", 1, 600.0, 800.0, i, *x) for i, x in enumerate(lines)], LINES)
    return {r.id: r for r in locate.locate(s, ls).collect()}


def test_boxes(spark):
    lines = [
        (20.0, 100.0, 60.0, 110.0, "GROUP"),
        (100.0, 40.0, 140.0, 50.0, "Model"),
        (300.0, 40.0, 500.0, 50.0, "AX100 AX200"),
        (100.0, 100.0, 200.0, 110.0, "Grid voltage (kV)"),
        (320.0, 100.0, 350.0, 110.0, "33 kV"),
        (430.0, 100.0, 460.0, 110.0, "33 kV"),
        (100.0, 300.0, 200.0, 310.0, "Cooling of the box"),
        (300.0, 318.0, 340.0, 328.0, "forced air"),
    ]
    got = at(spark, [("33", "Grid voltage (kV) — AX200: 33 kV", "AX200"), ("forced air", "Cooling of the box forced air", None), ("1", "Something unknown 1", None)], lines)
    assert set(got) == {"s0", "s1"}
    assert got["s0"].row == [round(98.5 / 600, 4), round(98.5 / 800, 4), round(461.5 / 600, 4), round(111.5 / 800, 4)]
    assert got["s0"].cell == [round(428.5 / 600, 4), round(98.5 / 800, 4), round(461.5 / 600, 4), round(111.5 / 800, 4)]
    assert got["s1"].row == [round(98.5 / 600, 4), round(298.5 / 800, 4), round(341.5 / 600, 4), round(329.5 / 800, 4)]
    assert got["s1"].cell is None
