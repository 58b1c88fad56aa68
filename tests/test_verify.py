"""Published values against new pages."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from specloom.operators import verify
from specloom.schemas import SPECS

PAGES = "document string, page int, variant int, text string"


def spec(spark, rows):
    """Specs from dicts; keys that aren't named are null."""
    names = [f.name for f in SPECS.fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], SPECS)


def check(spark, value, evidence, pages, anchor=None, numeric=None):
    s = spec(spark, [{"id": "p:f", "product": "p", "field": "f", "document": "d", "value": value, "numeric": numeric, "evidence": evidence, "anchor": anchor, "page": 1, "status": "reviewed"}])
    texts = [("d", p + 1, v, t) for p, variants in enumerate(pages) for v, t in enumerate(variants)]
    return verify.recheck_quoted(s, spark.createDataFrame(texts, PAGES)).first()


def test_white_space_and_signs_dont_matter(spark):
    r = check(spark, "900", "Rated power 900 kVA @ 40 °C", [["x"], ["RATED  POWER\n900kVA @ 40℃ here"]])
    assert (r.status, r.value, r.page, r.evidence) == ("confirmed", "900", 2, "Rated power 900 kVA @ 40 °C")


def test_a_new_number_behind_the_label(spark):
    r = check(spark, "900", "Rated power 900 kVA", [["foo\nRated power   950 kVA at night\nbar"]], numeric=900.0)
    assert (r.status, r.value, r.numeric, r.page) == ("updated", "950", 950.0, 1)
    assert r.evidence == "Rated power 950 kVA at night"


@pytest.mark.parametrize(
    "text",
    [
        "Rated power 950 kW",  # another unit
        "Rated power 90000 kVA",  # implausible
        "Nominal power 950 kVA",  # another label
        "",
    ],
)
def test_what_cant_be_trusted_needs_a_check(spark, text):
    r = check(spark, "900", "Rated power 900 kVA", [[text]], numeric=900.0)
    assert (r.status, r.value, r.numeric, r.page) == ("needs-check", "900", 900.0, 1)


def test_short_label_reads_before_the_text_behind(spark):
    r = check(spark, "900", "900 kVA @ 40 °C", [["power\n975 kVA @ 40 °C"]], numeric=900.0)
    assert (r.status, r.value) == ("updated", "975")


def test_anchor_goes_before_the_quote(spark):
    r = check(spark, "900", "Power — A1: 900 kVA", [["Power of A1   900 kVA"]], anchor="Power of A1 900 kVA")
    assert r.status == "confirmed"


def test_the_same_number_in_other_words_confirms(spark):
    r = check(spark, "900", "Rated power 900 kVA (continuous)", [["Rated power 900.0 kVA (cont.)"]], numeric=900.0)
    assert (r.status, r.value) == ("confirmed", "900")
    assert r.evidence.startswith("Rated power 900.0 kVA")


def test_numbers_inside_numbers_dont_split(spark):
    df = spark.createDataFrame([("max1900v,900v", "900"), ("abc1900", "900"), ("x900.5", "900"), ("label:-40°cto60", "-40"), ("nonumber", "n/a")], "e string, v string")
    got = [None if r.s is None else (r.s.prefix, r.s.unit, r.s.suffix) for r in df.select(verify.split_on_value(F.col("e"), F.col("v")).alias("s")).collect()]
    assert got == [("max1900v,", "v", "v"), None, None, ("label:", "°cto", "°cto60"), None]


def test_without_pages_all_need_a_check(spark):
    s = spec(spark, [{"id": "a", "document": "gone", "value": "1", "evidence": "Some text 1 V", "page": 3}])
    r = verify.recheck_quoted(s, spark.createDataFrame([], PAGES)).first()
    assert (r.status, r.page) == ("needs-check", 3)


def test_extracted_values_follow_their_model(spark):
    cands = spark.createDataFrame([("d", "M1", "kv", "33", 33.0, 1, "e", "a", "", 1), ("d", "M2", "kv", "90", 90.0, 1, "e", "a", "", 2), ("d", None, "kv", "7", 7.0, 2, "e2", "a2", "", 3)], "document string, model string, field string, value string, numeric double, page int, evidence string, anchor string, conditions string, ord int")
    base = {"field": "kv", "document": "d", "page": 9, "evidence": "old"}
    s = spec(
        spark,
        [
            base | {"id": "same", "value": "33", "numeric": 33.0, "extractor": ("r", "M1")},
            base | {"id": "moved", "value": "34", "numeric": 34.0, "extractor": ("r", "M1")},
            base | {"id": "wild", "value": "30", "numeric": 30.0, "extractor": ("r", "M2")},
            base | {"id": "gone", "value": "30", "numeric": 30.0, "extractor": ("r", "M3")},
            base | {"id": "plain", "value": "7", "numeric": 8.0, "extractor": ("r", None)},
        ],
    )
    got = {r.id: (r.status, r.value, r.page) for r in verify.recheck_extracted(s, cands).collect()}
    assert got == {"same": ("confirmed", "33", 1), "moved": ("updated", "33", 1), "wild": ("needs-check", "30", 9), "gone": ("needs-check", "30", 9), "plain": ("confirmed", "7", 2)}


def test_history_and_status(spark):
    rows = [{"id": f"s{i}", "product": "p", "field": "f", "document": "d", "value": "1", "numeric": 1.0, "revision": "old", "page": 1, "evidence": "e", "anchor": "a", "status": st, "reviewed_by": "me", "reviewed_at": "then", "checked_at": "t0", "history": []} for i, st in enumerate(["reviewed", "extracted", "reviewed", "reviewed"])]
    s = spec(spark, rows)
    out = [("s0", "confirmed", "1", 1.0, 2, "e2", None), ("s1", "confirmed", "1", 1.0, 2, "e2", "a2"), ("s2", "updated", "2", 2.0, 2, "e3", None)]
    found = spark.createDataFrame([*out, ("s3", "needs-check", "1", 1.0, 1, "e", None)], "id string, status string, value string, numeric double, page long, evidence string, anchor string")
    revs = spark.createDataFrame([("d", "new", "t1")], "document string, sha256 string, captured_at string")
    got = {r.id: r for r in verify.apply_outcomes(s, found, revs).collect()}
    assert [(r.status, r.revision, r.value, r.anchor) for _, r in sorted(got.items())] == [("confirmed", "new", "1", "a"), ("extracted", "new", "1", "a2"), ("updated", "new", "2", None), ("needs-check", "old", "1", "a")]
    for r in got.values():
        assert (r.reviewed_by, r.reviewed_at, r.checked_at, len(r.history)) == (None, "then", "t1", 1)
        assert (r.history[0].value, r.history[0].revision, r.history[0].reviewed_by) == ("1", "old", "me")


def test_a_second_look_at_the_same_pages_changes_no_value(spark):
    pages = spark.createDataFrame([("d", 1, 0, "Rated power 950 kVA\nother")], PAGES)
    s = spec(spark, [{"id": "x", "document": "d", "field": "f", "value": "900", "numeric": 900.0, "evidence": "Rated power 900 kVA", "status": "reviewed", "page": 1, "history": []}])
    revs = spark.createDataFrame([("d", "new", "t1")], "document string, sha256 string, captured_at string")
    once = verify.apply_outcomes(s, verify.recheck_quoted(s, pages), revs)
    again = verify.apply_outcomes(once, verify.recheck_quoted(once, pages), revs).first()
    assert once.first().value == again.value == "950"
    assert again.status == "confirmed"
