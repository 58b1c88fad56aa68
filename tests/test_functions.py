"""Display formats, value parsers and text functions on tables of inputs and results."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from specloom.fixed import RULES
from specloom.functions import display, text, values


def one(spark, column, *given):
    row = spark.range(1).select(*[F.lit(x).alias(f"c{i}") for i, x in enumerate(given)])
    return row.select(column(*[F.col(f"c{i}") for i in range(len(given))]).alias("x")).first().x


@pytest.mark.parametrize(
    ("given", "want"),
    [("14000", "14,000"), ("999", "999"), ("1000", "1,000"), ("934–1500", "934-1,500"), ("1234.5", "1234.5"), ("≤17000", "≤17,000"), ("33 ±10%", "33 ±10%"), ("a 12345 b 67", "a 12,345 b 67"), ("1,234", "1,234"), ("", "")],
)
def test_group_digits(spark, given, want):
    assert one(spark, display.group_digits, given) == want


def test_values_with_units(spark):
    assert one(spark, display.format_value, "5000", "kVA") == "5,000 kVA"
    assert one(spark, display.format_value, "5000 kVA", "kVA") == "5,000 kVA"
    assert one(spark, display.format_value, "air", "") == "air"


def test_quotes(spark):
    assert tuple(one(spark, display.quote_parts, "Grid voltage — AX1: 33 kV")) == ("Grid voltage", "AX1", "33 kV")
    assert tuple(one(spark, display.quote_parts, "Grid voltage 33 kV")) == ("Grid voltage 33 kV", None, None)
    assert one(spark, display.condition_of, "900 kVA @ 45 ℃ ( 113 ℉ )") == "45 °C"
    assert one(spark, display.condition_of, "900 kVA") is None


@pytest.mark.parametrize(("n", "want"), [(0, "0 KB"), (1023, "1 KB"), (1 << 20, "1.0 MB"), (1_500_000, "1.4 MB")])
def test_sizes(spark, n, want):
    assert one(spark, display.file_size, n) == want


@pytest.mark.parametrize(("s", "want"), [(5, "just now"), (60, "1 minute ago"), (5400, "2 hours ago"), (86_400, "yesterday"), (259_200, "3 days ago"), (700_000, "last week"), (5_184_000, "2 months ago"), (40_000_000, "last year")])
def test_ages(spark, s, want):
    assert one(spark, lambda a, b: display.time_ago(F.timestamp_seconds(a), F.timestamp_seconds(b)), 1_000_000_000 - s, 1_000_000_000) == want


def test_errors_dates_and_countries(spark):
    assert one(spark, display.error_kind, "HTTP 403") == "refused"
    assert one(spark, display.error_kind, "robots.txt does not allow https://x") == "blocked by robots.txt"
    assert one(spark, display.error_kind, "x" * 300) == "x" * 160
    assert one(spark, lambda a: display.day_label(F.to_timestamp(a)), "2024-02-05 10:00:00") == "Monday, 5 February 2024"
    assert one(spark, display.country_line, "DE", "JP") == "Germany, owned from Japan"
    assert one(spark, display.country_line, "DE", "DE") == "Germany"
    assert one(spark, text.initials, "Acme Drives") == "AD"
    assert one(spark, text.initials, "acme") == "AC"
    assert one(spark, display.status_label, "needs-check") == "Under review"


def parsed(spark, kind, given):
    got = one(spark, values.PARSERS[kind], given)
    return None if got is None else [(v.text, v.number) for v in got]


@pytest.mark.parametrize(
    ("kind", "given", "want"),
    [
        ("kva", "1,500 kVA / ≤ 2.5MVA", [("1500", 1500.0), ("≤2.5", 2.5)]),
        ("kva", "1500 kVAr", None),
        ("volt", "+900 V", [("900", 900.0)]),
        ("number", " 2,740 ", [("2740", 2740.0)]),
        ("number", "2740 A", None),
        ("text", "air cooled [3]", [("air cooled", None)]),
        ("text", "x", None),
        ("volt_range", "934 V – 1,500 V", [("934–1500", None)]),
        ("temp_min", "From -40 °C to +60 °C", [("-40", -40.0)]),
        ("temp_max", "From -40 °C to +60 °C", [("60", 60.0)]),
        ("derating", "power derating above 45 °C", [("Above 45 °C", None)]),
        ("mv_voltage", "0.69 kV / 34.5 kV", [("34.5", 34.5)]),
        ("mv_voltage", "33 kV ± 10 %", [("33 ±10%", 33.0)]),
        ("lv_voltage", "0.69 kV / 34.5 kV", [("690", 690.0)]),
        ("power_factor", "0.8 leading ... 0.8 lagging", [("0.8 leading to 0.8 lagging", None)]),
        ("yes_like", "Optional (on request)", [("Optional (on request)", None)]),
        ("yes_like", "maybe", None),
    ],
)
def test_parsers(spark, kind, given, want):
    got = parsed(spark, kind, given)
    assert (got is None) == (want is None)
    if want:
        assert [t for t, _ in got] == [t for t, _ in want]
        assert [n for _, n in got] == pytest.approx([n for _, n in want]) if want[0][1] is not None else all(n is None for _, n in got)


def test_two_comma_conventions(spark):
    assert one(spark, values.to_double, "14,000") == 14000.0
    assert one(spark, values.decimal_comma_number, "14,000") == 14.0


@pytest.mark.parametrize(("old", "new", "want"), [(10.0, 20.0, True), (10.0, 5.0, True), (10.0, 20.1, False), (10.0, -10.0, False), (0.0, 0.0, True), (0.0, 1.0, False)])
def test_plausible(spark, old, new, want):
    assert one(spark, values.plausible_change, old, new) is want


@pytest.mark.parametrize(("given", "want"), [("Crème Brûlée – 5", "creme-brulee-5"), ("---", "item"), ("A  b", "a-b")])
def test_slugs(spark, given, want):
    assert one(spark, text.slugify, given) == want


def test_natural_order(spark):
    df = spark.createDataFrame([(x,) for x in ("FP10", "fp100", "FP9", "FPA")], "m string")
    assert [r.m for r in df.orderBy(text.natural_key(F.col("m"))).collect()] == ["FP9", "FP10", "fp100", "FPA"]


def test_rules_name_parsers():
    assert len(RULES) == 29
    assert {r.parse for r in RULES} <= set(values.PARSERS)
