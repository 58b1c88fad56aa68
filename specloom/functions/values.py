"""Value parsers. Each gives an array of (text, number) structs in order of occurrence, or null where nothing is read.

Parsers are kept in PARSERS by name, so that an extraction rule names its parser as data; a new parser is a new entry.
Patterns carry Unicode flags, because Java's classes are ASCII without them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from specloom.fixed import CONDITION, DERATING_AFTER, DERATING_BEFORE, NUMBER, TEMPERATURES, UNITS, YES_LIKE
from specloom.functions.text import normalize_dashes, squeeze

RESULT = "array<struct<text:string,number:double>>"


def clean_number(c: Column) -> Column:
    """Thousands commas and a leading plus out."""
    return F.regexp_replace(F.replace(c, F.lit(","), F.lit("")), r"^\+", "")


def to_double(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("")).try_cast("double")


def decimal_comma_number(c: Column) -> Column:
    """First number of a text in which a comma is a decimal point (the verifier's convention, unlike the extractor's)."""
    t = F.replace(F.replace(normalize_dashes(c), F.lit(","), F.lit(".")), F.lit(" "), F.lit(""))
    return F.regexp_extract(t, r"(?U)-?\d+(?:\.\d+)?", 0).try_cast("double")


def _filled(a: Column) -> Column:
    # a lambda's variable holds the matches, which would else be searched for at each mention
    return F.get(F.filter(F.array(a.cast(RESULT)), lambda x: F.size(x) > 0), F.lit(0))


def _one(ok: Column, text: Column, number: Column | None = None) -> Column:
    return F.when(ok, F.array(F.struct(text.alias("text"), (F.lit(None).cast("double") if number is None else number).alias("number"))).cast(RESULT))


def number_with_unit(c: Column, units: str) -> Column:
    """All numbers before one of the units (alternatives of a pattern); a bound sign before a number stays in its text."""
    rx = F.lit(rf"(?iU)([≤<>≥])?\s*({NUMBER})\s*(?:{units})(?![A-Za-z])")
    signs, numbers = F.regexp_extract_all(c, rx, F.lit(1)), F.regexp_extract_all(c, rx, F.lit(2))
    both = F.arrays_zip(signs.alias("s"), numbers.alias("n"))
    return _filled(F.transform(both, lambda x: F.struct(F.concat(x["s"], clean_number(x["n"])).alias("text"), to_double(x["n"]).alias("number"))))


def plain_number(c: Column) -> Column:
    n = F.regexp_extract(c, rf"(?U)^\s*({NUMBER})\s*$", 1)
    return _one(F.length(n) > 0, clean_number(n), to_double(n))


def text_value(c: Column) -> Column:
    v = F.trim(F.regexp_replace(c, r"(?U)\s*\[\d+\]\s*$", ""))
    return _one(F.length(v).between(2, 80), v)


def range_value(c: Column, units: str) -> Column:
    rx = F.lit(rf"(?iU)({NUMBER})\s*(?:{units})?\s*(?:~|to|-)\s*({NUMBER})\s*(?:{units})(?![A-Za-z])")
    t = normalize_dashes(c)
    both = F.arrays_zip(F.regexp_extract_all(t, rx, F.lit(1)).alias("a"), F.regexp_extract_all(t, rx, F.lit(2)).alias("b"))
    return _filled(F.transform(both, lambda x: F.struct(F.concat(clean_number(x["a"]), F.lit("–"), clean_number(x["b"])).alias("text"), F.lit(None).cast("double").alias("number"))))


def _temperature(c: Column, group: int) -> Column:
    n = F.regexp_extract(normalize_dashes(c), "(?iU)" + TEMPERATURES, group)
    return _one(F.length(n) > 0, clean_number(n), to_double(n))


def temp_min(c: Column) -> Column:
    return _temperature(c, 1)


def temp_max(c: Column) -> Column:
    return _temperature(c, 2)


def derating(c: Column) -> Column:
    t = normalize_dashes(c)
    before = F.regexp_extract(t, "(?iU)" + DERATING_BEFORE, 1)
    after = F.regexp_extract(t, "(?iU)" + DERATING_AFTER, 1)
    n = F.when(F.length(before) > 0, before).otherwise(after)
    return _one(F.length(n) > 0, F.concat(F.lit("Above "), n, F.lit(" °C")))


def mv_voltage(c: Column) -> Column:
    """The kilovolts behind a slash, else the first ones with their tolerance."""
    t = normalize_dashes(c)
    second = F.regexp_extract(t, rf"(?U)/\s*({NUMBER})\s*kV", 1)
    rx = rf"(?U)({NUMBER})\s*kV(\s*±\s*\d+\s*%)?"
    first, tail = F.regexp_extract(t, rx, 1), F.regexp_replace(F.regexp_extract(t, rx, 2), r"(?U)\s", "")
    n = F.when(F.length(second) > 0, second).otherwise(first)
    text = F.when((F.length(second) == 0) & (F.length(tail) > 0), F.concat(clean_number(n), F.lit(" "), tail)).otherwise(clean_number(n))
    return _one(F.length(n) > 0, text, to_double(n))


def lv_voltage(c: Column) -> Column:
    """The kilovolts before a slash, in volts."""
    n = F.regexp_extract(normalize_dashes(c), rf"(?U)({NUMBER})\s*kV\s*/\s*{NUMBER}\s*kV", 1)
    volts = to_double(n) * 1000
    return _one(F.length(n) > 0, F.bround(volts, 0).cast("long").cast("string"), volts)


def power_factor(c: Column) -> Column:
    t = normalize_dashes(c)
    ok = F.regexp_like(t, F.lit("(?iu)lead|lag"))
    t = squeeze(F.replace(F.replace(t, F.lit("..."), F.lit(" to ")), F.lit("…"), F.lit(" to ")))
    return _one(ok, F.substring(t, 1, 60))


def yes_like(c: Column) -> Column:
    t = F.trim(c)
    return _one(F.regexp_like(t, F.lit("(?iuU)" + YES_LIKE)), t)


def _of_unit(name: str) -> Callable[[Column], Column]:
    read = range_value if name.endswith("_range") else number_with_unit
    return lambda c: read(c, UNITS[name])


PARSERS: dict[str, Callable[[Column], Column]] = {
    **{name: _of_unit(name) for name in UNITS},
    "number": plain_number,
    "text": text_value,
    "temp_min": temp_min,
    "temp_max": temp_max,
    "derating": derating,
    "mv_voltage": mv_voltage,
    "lv_voltage": lv_voltage,
    "power_factor": power_factor,
    "yes_like": yes_like,
}


def parse(kind: Column, c: Column) -> Column:
    """The result of the parser that the column kind names."""
    out = F.lit(None).cast(RESULT)
    for name, fn in PARSERS.items():
        out = F.when(kind == name, fn(c)).otherwise(out)
    return out


def pick(values: Column, how: Column) -> Column:
    """The first value, or the first of the largest or smallest numbers; text values give the first, no values null."""
    numbers = F.filter(values, lambda v: v["number"].isNotNull())

    def best(larger: bool) -> Column:
        return F.aggregate(numbers, F.get(numbers, F.lit(0)), lambda a, v: F.when((v["number"] > a["number"]) if larger else (v["number"] < a["number"]), v).otherwise(a))

    first = F.get(values, F.lit(0))
    return F.when((how == "first") | first["number"].isNull(), first).when(how == "max", best(True)).otherwise(best(False))


def conditions(c: Column) -> Column:
    """Conditions after an @ sign, each once, comma-joined."""
    found = F.regexp_extract_all(normalize_dashes(c), F.lit("(?U)" + CONDITION), F.lit(1))
    return F.array_join(F.array_distinct(F.transform(found, lambda x: F.btrim(x, F.lit("() ")))), ", ")


def plausible_change(old: Column, new: Column) -> Column:
    """A new reading keeps the sign and stays within a factor of two; zero only follows zero; nulls are never plausible."""
    ratio = new / old
    return F.when(old.isNull() | new.isNull(), F.lit(False)).when((old == 0) | (new == 0), old == new).otherwise(((old > 0) == (new > 0)) & (ratio >= 0.5) & (ratio <= 2))
