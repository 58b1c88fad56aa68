"""Text normalisation and identity, as Column functions. One pandas function: Unicode forms have no Spark built-in."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def _ascii_fold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


def normalize(c: Column) -> Column:
    """NFKC; dashes and minus signs become '-'."""
    return F.translate(_nfkc(c), "–—−", "---")


def normalize_dashes(c: Column) -> Column:
    """normalize() for text that is in NFKC already: stays in code generation."""
    return F.translate(c, "–—− ", "--- ")


def compact(c: Column) -> Column:
    """Normalised, all white space out, lower case."""
    return F.lower(F.regexp_replace(normalize(c), r"(?U)\s+", ""))


def squeeze(c: Column) -> Column:
    """White space collapsed to single blanks and trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def flat(c: Column) -> Column:
    return squeeze(normalize(c))


def ascii_slug(c: Column) -> Column:
    """slugify() for ASCII text."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(F.length(s) > 0, s).otherwise(F.lit("item"))


def slugify(c: Column) -> Column:
    """Letters folded to ASCII, lower case, runs of anything else a dash; 'item' if nothing is left."""
    return ascii_slug(_ascii_fold(c))


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)


def safe_filename(c: Column) -> Column:
    """Base name of safe characters that ends in .pdf, 150 characters at most."""
    base = F.regexp_extract(c, r"([^/]*)/*$", 1)
    base = F.regexp_replace(F.regexp_replace(base, "[^A-Za-z0-9._-]+", "-"), "^[-.]+|[-.]+$", "")
    base = F.when(F.length(base) > 0, base).otherwise(F.lit("datasheet"))
    base = F.when(F.endswith(F.lower(base), F.lit(".pdf")), base).otherwise(F.concat(base, F.lit(".pdf")))
    return F.substring(base, 1, 150)


def possessive(c: Column) -> Column:
    return F.concat(c, F.when(F.endswith(c, F.lit("s")), F.lit("’")).otherwise(F.lit("’s")))


def market_from_title(c: Column) -> Column:
    return F.when(F.regexp_like(c, F.lit(r"\bUL\b")), F.lit("UL variant")).when(F.regexp_like(c, F.lit(r"\bIEC\b")), F.lit("IEC variant"))


def title_from_filename(c: Column) -> Column:
    return F.translate(F.regexp_replace(c, r"\.[^.]*$", ""), "-_", "  ")


def initials(c: Column) -> Column:
    """The first two capitals or digits, else the first two letters."""
    caps = F.regexp_replace(c, "[^A-Z0-9]", "")
    return F.upper(F.substring(F.when(F.length(caps) > 1, caps).otherwise(c), 1, 2))


def natural_key(c: Column) -> Column:
    """Sorts digit runs by value, whatever their length, and letters without case: A9 before A10."""
    parts = F.regexp_extract_all(c, F.lit(r"(\d+|\D+)"), F.lit(1))

    def by_value(x: Column) -> Column:
        digits = F.ltrim(x, F.lit("0"))
        return F.concat(F.lpad(F.length(digits).cast("string"), 4, "0"), digits)

    return F.array_join(F.transform(parts, lambda x: F.when(F.regexp_like(x, F.lit(r"^\d")), by_value(x)).otherwise(F.lower(x))), "")


def search_text(*columns: str) -> Column:
    return F.lower(F.concat_ws(" ", *columns))


def has_all_tokens(text: Column, query: str) -> Column:
    """Every blank-separated token of the query occurs in the text (lower case)."""
    out = F.lit(True)
    for token in query.lower().split():
        out = out & F.contains(text, F.lit(token))
    return out


def drop_nulls_json(*columns: str) -> Column:
    """A JSON object of the columns without its null members."""
    return F.to_json(F.struct(*columns))
