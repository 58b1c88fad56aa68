"""The web edge: requests to responses, one host at a time, politely and within bounds. Failures are rows with an error.

requests: (url, hosts, etag, last_modified, referer), hosts being those that may be contacted. responses: (url,
final_url, status, headers, body, error). `table_fetch` answers from a table and needs no network.
"""

from __future__ import annotations

import ipaddress
import socket
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from urllib.parse import urljoin, urlsplit
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.config import Settings
from specloom.fixed import FETCH_TIMEOUT, MAX_REDIRECTS, ROBOTS_BYTES
from specloom.functions.web import url_host

REQUESTS = "url string, hosts array<string>, etag string, last_modified string, referer string"
RESPONSES = "url string, final_url string, status int, headers map<string,string>, body binary, error string"


class Refused(Exception):
    """A request that may not be made, or whose answer may not be taken."""


def public_address(host: str) -> None:
    """Refuse hosts of which any address isn't public."""
    try:
        found = {info[4][0] for info in socket.getaddrinfo(host, 443, type=socket.SOCK_STREAM)}
    except socket.gaierror as e:
        raise Refused(f"cannot resolve {host}: {e}") from e
    if not all(ipaddress.ip_address(a).is_global for a in found):
        raise Refused(f"{host} resolves to a non-public address")


class _Stay(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_args, **_kwargs):
        return None


class HostSession:
    """What one task remembers of the hosts it asks: when it last did, and what their robots.txt allows."""

    def __init__(self, settings: Settings, check: Callable[[str], None] = public_address):
        self.settings, self.check = settings, check
        self.open = urllib.request.build_opener(_Stay).open
        self.asked: dict[str, float] = {}
        self.robots: dict[str, RobotFileParser] = {}

    def once(self, url: str, hosts: set[str], headers: dict[str, str], limit: int) -> tuple[int, dict[str, str], bytes]:
        host = urlsplit(url).hostname or ""
        if host not in hosts:
            raise Refused(f"{host} is not an allowed host")
        self.check(host)
        time.sleep(max(0.0, self.asked.get(host, float("-inf")) + self.settings.request_delay_seconds - time.monotonic()))
        self.asked[host] = time.monotonic()
        try:
            with self.open(urllib.request.Request(url, headers={"User-Agent": self.settings.user_agent} | headers), timeout=FETCH_TIMEOUT) as r:
                body = r.read(limit + 1)
                if len(body) > limit:
                    raise Refused(f"larger than {limit >> 20} MB")
                return r.status, {k.lower(): v for k, v in r.headers.items()}, body
        except urllib.error.HTTPError as e:
            return e.code, {k.lower(): v for k, v in (e.headers or {}).items()}, b""
        except OSError as e:
            raise Refused(f"could not reach {host}: {e}") from e

    def may(self, url: str, hosts: set[str]) -> bool:
        """robots.txt of the origin, asked for once; anything but a good answer allows all."""
        at = urlsplit(url)
        origin = f"{at.scheme}://{at.netloc}"
        if origin not in self.robots:
            status, _, body = self.once(f"{origin}/robots.txt", hosts, {}, ROBOTS_BYTES)
            rules = RobotFileParser()
            rules.parse(body.decode("utf-8", "replace").splitlines() if status == 200 else [])
            self.robots[origin] = rules
        return self.robots[origin].can_fetch(self.settings.user_agent, url)

    def get(self, url: str, hosts: set[str], headers: dict[str, str]) -> dict:
        at = url
        for _ in range(MAX_REDIRECTS + 1):
            if not self.may(at, hosts):
                raise Refused(f"robots.txt does not allow {at}")
            status, got, body = self.once(at, hosts, headers, self.settings.max_file_bytes)
            if status not in (301, 302, 303, 307, 308) or not got.get("location"):
                return {"final_url": at, "status": status, "headers": got, "body": body, "error": None}
            at = urljoin(at, got["location"])
        raise Refused("too many redirects")


def web_fetch(requests: DataFrame, settings: Settings, check: Callable[[str], None] = public_address) -> DataFrame:
    """Responses from the web. All requests to a host are one task's, so its delay and robots.txt hold for all of them."""

    def run(batches):
        session = HostSession(settings, check)
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                headers = {k: v for k, v in (("If-None-Match", r.etag), ("If-Modified-Since", r.last_modified), ("Referer", r.referer)) if v}
                try:
                    rows.append({"url": r.url} | session.get(r.url, set(r.hosts), headers))
                except Refused as e:
                    rows.append({"url": r.url, "final_url": None, "status": None, "headers": None, "body": None, "error": str(e)})
            yield pd.DataFrame(rows, columns=["url", "final_url", "status", "headers", "body", "error"]).astype({"status": "Int32"})

    return requests.repartition(url_host(F.col("url"))).mapInPandas(run, RESPONSES)


def table_fetch(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """Responses from a table (url, status, headers, body): what isn't there is a 404, what the request has already a 304."""
    p = pages.select(F.col("url").alias("_u"), "status", "headers", "body")
    met = requests.join(p, F.col("url") == F.col("_u"), "left")
    etag = F.element_at("headers", "etag")
    fresh = F.col("etag").isNotNull() & (F.col("etag") == etag)
    allowed = F.array_contains("hosts", url_host(F.col("url")))
    status = F.when(~allowed, F.lit(None)).when(F.col("_u").isNull(), 404).when(fresh, 304).otherwise(F.col("status"))
    return met.select("url", F.col("url").alias("final_url"), status.cast("int").alias("status"), "headers", F.when(status == 200, F.col("body")).alias("body"), F.when(~allowed, F.concat(url_host(F.col("url")), F.lit(" is not an allowed host"))).alias("error"))
