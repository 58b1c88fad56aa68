"""Web addresses and anchors. Addresses are cut by patterns, since parse_url refuses raw blanks."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.fixed import DISPOSITION_NAME, URL_KEPT

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"


def url_scheme(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, _URL, 1))


def url_host(c: Column) -> Column:
    """Lower-case host without user, port and a trailing dot; empty if there is none."""
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(c, _URL, 2), r"^.*@", ""), r":\d*$", "")
    return F.regexp_replace(F.lower(host), r"\.$", "")


def _encoded(c: Column) -> Column:
    """Characters that an address may not hold as they are, percent-encoded; escapes stay."""
    pieces = F.regexp_extract_all(c, F.lit(rf"(?s)([{URL_KEPT}]+|.)"), F.lit(1))
    hexed = F.transform(pieces, lambda p: F.when(F.regexp_like(p, F.lit(rf"^[{URL_KEPT}]")), p).otherwise(F.regexp_replace(F.hex(p.cast("binary")), "(..)", "%$1")))
    return F.array_join(hexed, "")


def _decoded(c: Column) -> Column:
    """Percent escapes decoded, a plus left alone; text with broken escapes stays."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def canonical_url(c: Column) -> Column:
    """http(s) only, no credentials, host in lower case, ports 80 and 443 and fragments out, path '/' at least; else null."""
    c = F.trim(c)
    scheme, authority = url_scheme(c), F.regexp_extract(c, _URL, 2)
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    path, query = F.regexp_extract(c, _URL, 3), F.regexp_extract(c, _URL, 4)
    path = F.when(path == "", F.lit("/")).otherwise(_encoded(path))
    out = F.concat(scheme, F.lit("://"), url_host(c), F.when(port.isin("", "80", "443"), F.lit("")).otherwise(F.concat(F.lit(":"), port)), path, F.when(query == "?", F.lit("")).otherwise(_encoded(query)))
    return F.when(scheme.isin("http", "https") & ~F.contains(authority, F.lit("@")) & (url_host(c) != ""), out)


def url_file_name(url: Column) -> Column:
    """Last part of the path, decoded; datasheet.pdf if it is empty."""
    name = _decoded(F.regexp_extract(F.regexp_extract(url, _URL, 3), r"([^/]*)/*$", 1))
    return F.when(F.length(name) > 0, name).otherwise(F.lit("datasheet.pdf"))


def filename_for(disposition: Column, url: Column) -> Column:
    """The first file name that a Content-Disposition header gives, decoded, else the address's."""
    named = F.regexp_extract(F.coalesce(disposition, F.lit("")), DISPOSITION_NAME, 1)
    return F.when(F.length(named) > 0, _decoded(F.trim(named))).otherwise(url_file_name(url))


def hrefs(html: Column) -> Column:
    """href values of a elements, by pattern: the native form of the anchor parser."""
    return F.regexp_extract_all(html, F.lit(r'<a\s[^>]*?href="([^"]*)"'), F.lit(1))


class _Anchors(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str, bool]] = []
        self.open: tuple[str, list[str], bool] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            own = dict(attrs)
            self.open = (own["href"], [], "download" in own) if own.get("href") else None

    def handle_data(self, data):
        if self.open:
            self.open[1].append(data)

    def handle_endtag(self, tag):
        if tag == "a" and self.open:
            href, label, download = self.open
            self.found.append((href, re.sub(r"\s+", " ", "".join(label)).strip(), download))
            self.open = None


def anchors(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(id, ord, url, label, download): closed anchors of each page in order, addresses resolved against the page's."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            rows = []
            for key, base, html in zip(pdf["k"], pdf["u"], pdf["h"], strict=True):
                p = _Anchors()
                p.feed(html or "")
                rows.extend((key, i, urljoin(base or "", href), label, down) for i, (href, label, down) in enumerate(p.found))
            yield pd.DataFrame(rows, columns=["k", "ord", "url", "label", "download"])

    out = pages.select(F.col(id_col).alias("k"), F.col(url_col).alias("u"), F.col(html_col).alias("h")).mapInPandas(run, f"k {kind}, ord int, url string, label string, download boolean")
    return out.withColumnRenamed("k", id_col)


def datasheet_links(links: DataFrame, allowed_hosts: list[str], patterns: list[str], suffix: str = ".pdf") -> DataFrame:
    """Links to wanted files on allowed hosts, each page's first occurrence of an address only; no patterns accept all."""
    hay = F.lower(F.concat_ws(" ", _decoded(F.col("url")), "label"))
    wanted = F.lit(True) if not patterns else F.exists(F.array(*[F.lit(p.lower()) for p in patterns]), lambda p: F.contains(hay, p))
    path = F.lower(F.regexp_extract("url", _URL, 3))
    kept = links.withColumn("url", canonical_url(F.col("url"))).where(F.col("url").isNotNull() & url_host(F.col("url")).isin(*allowed_hosts) & (F.endswith(path, F.lit(suffix)) | F.col("download")) & wanted)
    key = [c for c in links.columns if c not in ("ord", "url", "label", "download")]
    return kept.groupBy(*key, "url").agg(F.min_by("label", "ord").alias("label"), F.min("ord").alias("ord"))
