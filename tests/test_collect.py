"""Passes over a fake web: new documents, nothing new, revised documents; links, archive, streams, settings."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from specloom.config import Settings
from specloom.functions import web
from specloom.plans import collect
from specloom.sources import archive, pdf, tables
from specloom.sources import web as edge
from specloom.streaming import passes
from tests import fixtures as fx

V1 = "Acme BX10 sheet\nRated power            4800 kVA\nEnclosure              NEMA 3R\n"
V2 = "Acme BX10 sheet\nRated power            5000 kVA\nEnclosure rating       IP55\n"
URL = "https://acme.example/bx10.pdf"


def response(spark, text, status=200, etag="e1"):
    body = f"%PDF-1.4 {text}".encode()
    return spark.createDataFrame([(URL, URL, status, {"etag": etag}, body if status == 200 else None, None), ("https://acme.example/ax", "https://acme.example/ax", 200, {}, b"<html><a href='/x.html'>x</a></html>", None)], edge.RESPONSES)


def texts(responses, text):
    digests = responses.where(archive.is_pdf(F.col("body"))).select(F.sha2("body", 256).alias("sha256"))
    pages = digests.select("sha256", F.lit(1).alias("page"), F.lit(0).alias("variant"), F.lit(text).alias("text"))
    return pages, pages.drop("variant")


def one(spark, t, text, at, **kw):
    r = response(spark, text, **kw)
    pages, layout = texts(r, text)
    out = collect.run(t, collect.found_files(t["suppliers"], r), r, pages, layout, F.lit(at))
    return {k: v.persist() for k, v in out.tables.items()}, out


def test_three_passes(spark):
    t = fx.catalog(spark) | {k: fx.table(spark, k, []) for k in ("documents", "specs", "models", "changes", "status")}
    t1, out1 = one(spark, t, V1, "2024-02-01T00:00:00Z")
    doc = t1["documents"].first()
    assert (doc.id, doc.supplier, doc.title, len(doc.revisions)) == ("bx10", "acme", "bx10", 1)
    assert doc.revisions[0].extracted == "rules-2" and doc.models == ["bx10"]
    got = {r.field: (r.value, r.status, r.product) for r in t1["specs"].collect()}
    assert got == {"rated_kva": ("4800", "extracted", "bx10"), "enclosure": ("NEMA 3R", "extracted", "bx10")}
    s = t1["status"].first()
    assert (s.summary.sources_checked, s.summary.files_checked, s.summary.new_documents, s.summary.values_extracted, s.summary.errors) == (2, 1, 1, 2, 1)
    assert collect.message(t1["status"]).first().message == "Collector: 1 new datasheet(s), 2 value(s) extracted, 1 source problem(s)"
    assert sorted(r.type for r in t1["changes"].collect()) == ["new-datasheet", "values-extracted"]

    # a person reviews a value: it is rechecked by its quote from now on
    reviewed = t1["specs"].withColumns({"extractor": F.when(F.col("field") != "enclosure", F.col("extractor")), "status": F.when(F.col("field") == "enclosure", "reviewed").otherwise(F.col("status")), "reviewed_by": F.when(F.col("field") == "enclosure", "me")})
    t1["specs"] = reviewed.persist()
    t2, _ = one(spark, t1, V1, "2024-02-02T00:00:00Z")  # a source that is a file is always asked for in full
    assert t2["documents"].first().last_checked == "2024-02-02T00:00:00Z"
    assert len(t2["documents"].first().revisions) == 1
    assert t2["status"].first().summary.new_revisions == 0 and t2["changes"].count() == 2

    t3, _ = one(spark, t2, V2, "2024-02-03T00:00:00Z", etag="e2")
    doc = t3["documents"].first()
    assert len(doc.revisions) == 2
    got = {r.field: r for r in t3["specs"].collect()}
    assert (got["rated_kva"].status, got["rated_kva"].value, got["rated_kva"].history[0].value) == ("updated", "5000", "4800")
    assert got["rated_kva"].history[0].revision == doc.revisions[0].sha256 and got["rated_kva"].revision == doc.revisions[1].sha256
    assert (got["enclosure"].status, got["enclosure"].value, got["enclosure"].revision, got["enclosure"].reviewed_by) == ("needs-check", "NEMA 3R", doc.revisions[0].sha256, None)
    kinds = sorted(r.type for r in t3["changes"].collect())
    assert kinds == ["datasheet-revised", "needs-check", "new-datasheet", "value-changed", "values-extracted"]
    changed = t3["changes"].where("type = 'value-changed'").first()
    assert (changed.summary, changed.previous_value, changed.value) == ("Rated power: 4800 → 5000 kVA", "4800", "5000")


def test_errors_are_rows(spark):
    t = fx.catalog(spark)
    r = spark.createDataFrame([(URL, None, None, None, None, "acme.example could not be reached"), ("https://acme.example/ax", "https://acme.example/ax", 503, {}, None, None)], edge.RESPONSES)
    got = {x.product: x.error for x in collect.found_files(t["suppliers"], r).collect()}
    assert got == {"bx10": "acme.example could not be reached", "ax": "HTTP 503"}


def test_links_of_a_page(spark):
    html = """<a href="/files/AX%20datasheet 1.pdf?v=1#top">Sheet</a> <a href="https://other.example/ax.pdf">ax</a>
    <a href="https://files.acme.example/get" download>AX  data
    sheet</a> <a href='/manual.pdf'>Manual</a> <a href="/files/AX%20datasheet 1.pdf?v=1">again</a> <a href="mailto:x@y">m</a>"""
    t = fx.catalog(spark)
    r = spark.createDataFrame([("https://acme.example/ax", "https://acme.example/ax", 200, {}, html.encode(), None)], edge.RESPONSES)
    got = collect.found_files(t["suppliers"], r).where("url IS NOT NULL").select("url", "product").distinct().collect()
    assert sorted(x.url for x in got) == ["https://acme.example/files/AX%20datasheet%201.pdf?v=1", "https://files.acme.example/get"]
    assert {x.product for x in got} == {"ax"}


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTPS://Acme.Example.:443/a b/é?q=1 2#x", "https://acme.example/a%20b/%C3%A9?q=1%202"),
        ("http://acme.example", "http://acme.example/"),
        ("http://acme.example:8080/a%20b", "http://acme.example:8080/a%20b"),
        ("ftp://acme.example/x", None),
        ("https://me:secret@acme.example/x", None),
        ("/relative", None),
    ],
)
def test_canonical_url(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(web.canonical_url(F.col("u")).alias("c")).first().c == want


@pytest.mark.parametrize(
    ("disposition", "want"),
    [('attachment; filename="A%20b+1.pdf"', "A b+1.pdf"), ("attachment; filename*=UTF-8''c%C3%A9.pdf", "cé.pdf"), (None, "x y.pdf"), ("inline", "x y.pdf")],
)
def test_file_names(spark, disposition, want):
    df = spark.createDataFrame([(disposition, "https://a.example/d/x%20y.pdf?z")], "d string, u string")
    assert df.select(web.filename_for(F.col("d"), F.col("u")).alias("n")).first().n == want


def test_table_fetch(spark):
    pages = spark.createDataFrame([("https://a.example/x", 200, {"etag": "e"}, b"x")], "url string, status int, headers map<string,string>, body binary")
    req = spark.createDataFrame([("https://a.example/x", ["a.example"], None, None, None), ("https://a.example/x", ["a.example"], "e", None, None), ("https://a.example/y", ["a.example"], None, None, None), ("https://b.example/y", ["a.example"], None, None, None)], edge.REQUESTS)
    assert sorted((r.status or 0) for r in edge.table_fetch(req, pages).collect()) == [0, 200, 304, 404]


def test_refused_requests_are_rows(spark):
    def check(host):
        raise edge.Refused(f"{host} resolves to a non-public address")

    req = spark.createDataFrame([("https://a.example/x", ["a.example"], None, None, None), ("https://b.example/x", ["a.example"], None, None, None)], edge.REQUESTS)
    got = sorted(r.error for r in edge.web_fetch(req, Settings(), check).collect())
    assert got == ["a.example resolves to a non-public address", "b.example is not an allowed host"]


def test_archive_keeps_each_content_once(spark, tmp_path):
    df = spark.createDataFrame([(bytearray(b"one"), "b.pdf"), (bytearray(b"one"), "a b.pdf"), (bytearray(b"two"), "?.doc")], "content binary, filename string")
    got = archive.store(df, str(tmp_path / "a"))
    assert got.count() == 2
    assert sorted(r.path.split("/")[-1] for r in got.collect()) == ["a-b.pdf", "doc.pdf"]
    archive.store(df, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 2


def test_a_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, body in (("a.pdf", b"%PDF-a"), ("b.pdf", b"%PDF-a"), ("c.pdf", b"%PDF-c"), ("d.txt", b"x")):
        (tmp_path / "in" / name).write_bytes(body)
    seen = []
    for _ in range(2):
        stream = passes.archive_stream(passes.file_stream(spark, str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "check"), lambda df, n: seen.append((n, df.count())))
        stream.awaitTermination(120)
    assert seen == [(0, 2)]
    assert spark.read.parquet(str(tmp_path / "store")).count() == 2


def test_tables_round_trip(spark, tmp_path):
    t = fx.catalog(spark)
    tables.save(t, str(tmp_path))
    tables.save(t | {"specs": t["specs"].where("field = 'cooling'")}, str(tmp_path))
    back = tables.load(spark, str(tmp_path))
    assert back["specs"].count() == 2
    assert back["suppliers"].count() == 0  # never written
    assert back["changes"].count() == 4


def test_json_tables(spark, tmp_path):
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "suppliers.json").write_text('[{"id": "a", "products": [{"id": "p", "model": "P"}]}, {"id": "b"}]')
    (tmp_path / "data" / "status.json").write_text('{"interval_hours": 24.0, "sources": []}')
    t = tables.load(spark, str(tmp_path))
    assert t["suppliers"].count() == 2 and t["status"].first().interval_hours == 24.0
    assert t["specs"].count() == 0


def test_positioned_lines(spark):
    text = '<page width="600.0" height="800.5">\n<line xMin="1.5" yMin="2" xMax="3" yMax="4">\n<word a="1">A&amp;B</word>\n<word>c</word></line><line xMin="5" yMin="6" xMax="7" yMax="8"><word>z</word></line>'
    got = pdf.positioned_lines(spark.createDataFrame([("d", 1, text)], "document string, page int, text string")).collect()
    assert [(r.line_no, r.x0, r.y1, r.text, r.height) for r in got] == [(0, 1.5, 4.0, "A&B c", 800.5), (1, 5.0, 8.0, "z", 800.5)]


def test_settings():
    s = Settings.load({"CHECK_INTERVAL_HOURS": "0.2", "REQUEST_DELAY_SECONDS": "", "MAX_FILE_MB": "3"})
    assert (s.check_interval_hours, s.request_delay_seconds, s.max_file_bytes) == (1.0, 2.0, 3 << 20)
