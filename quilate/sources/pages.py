"""Captured pages as a batch source; live pages, or whole paged lists, as Python data sources (one partition per address)."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from urllib.parse import urljoin

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quilate.functions.listing import page_address
from quilate.sources import html

RETRIED = {500, 502, 503, 504}


def captured_pages(spark: SparkSession, path: str) -> DataFrame:
    """(url, html) of whole files."""
    from pyspark.sql import functions as F

    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))


def fetch(url: str, timeout: float, tries: int = 3, backoff: float = 1.0, opener=urllib.request.urlopen, sleep=time.sleep) -> tuple[int, str]:
    """(status, body) with retries on timeouts and on server errors; a client error is not retried."""
    for attempt in range(tries):
        last = attempt == tries - 1
        try:
            with opener(url, timeout=timeout) as r:
                return r.status, r.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            if e.code not in RETRIED or last:
                return e.code, ""
        except (urllib.error.URLError, TimeoutError):
            if last:
                raise
        sleep(backoff * 2**attempt)
    raise AssertionError


class _Address(InputPartition):
    def __init__(self, url: str):
        self.url = url


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.urls = [u for u in options.get("urls", "").split(",") if u]
        self.timeout, self.tries = float(options.get("timeout", 10)), int(options.get("tries", 3))

    def partitions(self):
        return [_Address(u) for u in self.urls]

    def read(self, partition):
        status, body = fetch(partition.url, self.timeout, self.tries)
        yield partition.url, status, body


class PageSource(DataSource):
    """``spark.read.format("pages").option("urls", "a,b")``: url, status, html."""

    @classmethod
    def name(cls):
        return "pages"

    def schema(self):
        return "url string, status int, html string"

    def reader(self, schema):
        return _Reader(self.options)


def paged(site: str, base_url: str, get: Callable[[str], tuple[int, str]], start_page: int = 1, max_pages: int = 20, pause: Callable[[], None] = lambda: None) -> Iterator[tuple[str, int, str, int, str, int]]:
    """(base_url, page_no, url, status, html, new_items) of the pages of one list, read until it ends.

    It ends before a 404, a page without cards, and a page whose items all stood on earlier ones, and
    after ``max_pages``. Another error status is an error.
    """
    seen: set[str] = set()
    for page in range(start_page, start_page + max_pages):
        url = page_address(site, base_url, page)
        status, body = get(url)
        if status == 404:
            return
        if status >= 400:
            raise OSError(f"{url} answered {status}")
        fields = [f for f in (html.card_fields(site, c) for c in html.cards(site, html.tree(body))) if f]
        new = {urljoin(base_url, str(f[1])) for f in fields} - seen
        if not new:
            return
        seen |= new
        yield base_url, page, url, status, body, len(new)
        pause()


class _PagedReader(DataSourceReader):
    def __init__(self, options):
        self.site, self.urls = options.get("site", ""), [u for u in options.get("urls", "").split(",") if u]
        self.timeout, self.tries, self.delay = float(options.get("timeout", 10)), int(options.get("tries", 3)), float(options.get("delay", 1.5))
        self.start, self.most = int(options.get("start_page", 1)), int(options.get("max_pages", 20))

    def partitions(self):
        return [_Address(u) for u in self.urls]

    def read(self, partition):
        yield from paged(self.site, partition.url, lambda u: fetch(u, self.timeout, self.tries), self.start, self.most, lambda: time.sleep(self.delay))


class PagedSource(DataSource):
    """``spark.read.format("paged").option("site", "thot").option("urls", "a,b")``: whole lists, a partition each."""

    @classmethod
    def name(cls):
        return "paged"

    def schema(self):
        return "base_url string, page_no int, url string, status int, html string, new_items int"

    def reader(self, schema):
        return _PagedReader(self.options)
