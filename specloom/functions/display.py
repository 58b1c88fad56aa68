"""Display formats: numbers with units, sizes, ages, dates, countries, statuses, quotes."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from specloom.fixed import STATUS_LABELS

_countries: dict[str, str] = {}


def country_names() -> dict[str, str]:
    """English names of all two-letter country codes, from the driver's Java locales."""
    if not _countries:
        locale = SparkSession.active()._jvm.java.util.Locale
        for code in locale.getISOCountries():
            _countries[code] = locale("", code).getDisplayCountry(locale.ENGLISH)
    return _countries


def _mapped(c: Column, pairs: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), c)


def status_label(c: Column) -> Column:
    return F.coalesce(_mapped(c, {k: v[1] for k, v in STATUS_LABELS.items()}), c)


def status_tone(c: Column) -> Column:
    return F.coalesce(_mapped(c, {k: v[0] for k, v in STATUS_LABELS.items()}), F.lit("none"))


def country_name(c: Column) -> Column:
    return F.coalesce(_mapped(c, country_names()), c)


def countries(company: str = "company") -> Column:
    """Distinct countries of a company, headquarters first."""
    return F.array_distinct(F.array_compact(F.array(f"{company}.hq_country", f"{company}.parent.country")))


def country_line(hq: Column, parent: Column) -> Column:
    """The country of the headquarters, and the parent's where it is another; empty without headquarters."""
    owned = F.when(parent.isNotNull() & (parent != hq), F.concat(F.lit(", owned from "), country_name(parent))).otherwise(F.lit(""))
    return F.when(hq.isNull(), F.lit("")).otherwise(F.concat(country_name(hq), owned))


def group_digits(c: Column) -> Column:
    """Whole numbers of four and more digits in groups of three, dashes between numbers as '-'; decimals stay."""
    t = F.regexp_replace(c, r"(\d)\s*[–—]\s*(\d)", "$1-$2")
    pieces = F.regexp_extract_all(t, F.lit(r"((?<![\d.,])\d{4,18}(?![\d.,]*\d)|\D+|\d)"), F.lit(1))
    whole = lambda p: F.regexp_like(p, F.lit(r"^\d{4,}$"))
    grouped = F.transform(pieces, lambda p: F.when(whole(p), F.format_number(p.try_cast("long"), 0)).otherwise(p))
    return F.when(F.regexp_like(c, F.lit(r"\d{4}|\d\s*[–—]\s*\d")), F.array_join(grouped, "")).otherwise(c)


def format_value(value: Column, unit: Column) -> Column:
    """Value with its unit, unless the value ends in it."""
    plain = (F.coalesce(unit, F.lit("")) == "") | F.endswith(F.trim(value), unit)
    return F.concat(group_digits(value), F.when(plain, F.lit("")).otherwise(F.concat(F.lit(" "), unit)))


def condition_of(evidence: Column) -> Column:
    """The temperature that a quote names after an @ sign; null if it names none."""
    n = F.regexp_extract(evidence, r"@\s*(\d{2})\s*°?\s*[C℃]", 1)
    return F.when(F.length(n) > 0, F.concat(n, F.lit(" °C")))


def quote_parts(evidence: Column) -> Column:
    """struct(label, model, cell) of a quote from a table of models; any other quote is all label."""
    parts = F.split(evidence, " — ")
    rest = F.get(parts, F.lit(1))
    rx = r"^([^:]+):\s*(.*)$"
    ok = F.coalesce((F.size(parts) == 2) & F.regexp_like(rest, F.lit(rx)), F.lit(False))
    return F.struct(F.when(ok, F.get(parts, F.lit(0))).otherwise(evidence).alias("label"), F.when(ok, F.regexp_extract(rest, rx, 1)).alias("model"), F.when(ok, F.regexp_extract(rest, rx, 2)).alias("cell"))


def file_size(n: Column) -> Column:
    kb = F.concat(F.round(n / 1024).cast("long").cast("string"), F.lit(" KB"))
    return F.when(n < 1 << 20, kb).otherwise(F.concat(F.format_string("%.1f", n / (1 << 20)), F.lit(" MB")))


def time_ago(at: Column, now: Column) -> Column:
    """Age in the largest unit that it reaches, rounded; 'not yet' without a time."""
    s = F.unix_timestamp(now) - F.unix_timestamp(at)

    def unit(size: int, name: str, one: str | None = None) -> Column:
        k = F.round(s / size).cast("long")
        many = F.concat(k.cast("string"), F.lit(f" {name}"), F.when(k == 1, F.lit("")).otherwise(F.lit("s")), F.lit(" ago"))
        return F.when(k == 1, F.lit(one)).otherwise(many) if one else many

    units = ((31_536_000, "year", "last year"), (2_592_000, "month", "last month"), (604_800, "week", "last week"), (86_400, "day", "yesterday"), (3600, "hour", None), (60, "minute", None))
    out = F.when(s.isNull(), F.lit("not yet"))
    for size, name, one in units:
        out = out.when(s >= size, unit(size, name, one))
    return out.otherwise(F.lit("just now"))


def short_date(at: Column) -> Column:
    return F.date_format(at, "d MMM")


def long_date(at: Column) -> Column:
    return F.coalesce(F.date_format(at, "d MMM yyyy"), F.lit("unknown"))


def day_label(at: Column) -> Column:
    return F.date_format(at, "EEEE, d MMMM yyyy")


def is_stale(last: Column, interval_hours: Column, now: Column) -> Column:
    """Never checked, or longer ago than two intervals."""
    return F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(last) > interval_hours * 7200, F.lit(True))


def error_kind(message: Column) -> Column:
    """Classes of fetch errors; any other message as it is, 160 characters at most."""
    like = lambda rx: F.regexp_like(message, F.lit(f"(?i){rx}"))
    return (
        F.when(like("^no-links|no matching pdf links"), F.lit("no matching links"))
        .when(like("^no-pdf"), F.lit("not a PDF file"))
        .when(like("http 403"), F.lit("refused"))
        .when(like("robots"), F.lit("blocked by robots.txt"))
        .when(like("could not reach|resolve"), F.lit("unreachable"))
        .otherwise(F.substring(message, 1, 160))
    )


def country_summary(names: Column) -> Column:
    return F.when(F.size(names) <= 2, F.array_join(names, ", ")).otherwise(F.concat(F.size(names).cast("string"), F.lit(" countries")))


def plural(n: Column, word: str) -> Column:
    return F.concat(F.format_number(n, 0), F.lit(f" {word}"), F.when(n == 1, F.lit("")).otherwise(F.lit("s")))
