"""Paged sources (REST lists, WFS, feature services) as a Spark data source: a partition per range of pages, retries, and streams that resume at a page."""

from __future__ import annotations

import importlib
import json
import math
import time
import urllib.error
import urllib.parse
import urllib.request

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "page bigint, n bigint, id string, body string"
#: How each kind of service is asked for a page (from {page}, counted from 0, and {size}), where its items are, and which field tells how many there are.
KINDS = {
    "rest": {"ask": {"page": "{next}", "per_page": "{size}"}, "items": "items", "total": "total"},
    "wfs": {"ask": {"service": "WFS", "request": "GetFeature", "outputFormat": "application/json", "startIndex": "{start}", "count": "{size}"}, "items": "features", "total": "numberMatched"},
    "features": {"ask": {"offset": "{start}", "limit": "{size}", "f": "json"}, "items": "features", "total": "numberMatched"},
    "arcgis": {"ask": {"where": "1=1", "outFields": "*", "resultOffset": "{start}", "resultRecordCount": "{size}", "f": "json"}, "items": "features", "total": "count"},
}


class Retry(Exception):
    """A request that may succeed when made again."""


def http(url: str, options: dict) -> bytes:
    """The body of a GET; busy servers and lost connections may be asked again, refusals not."""
    headers = {"Accept": "application/json"}
    if token := options.get("token"):
        headers["Authorization"] = f"Bearer {token}"
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=float(options.get("timeout", 30))) as answer:
            return answer.read()
    except urllib.error.HTTPError as e:
        if e.code == 429 or e.code >= 500:
            raise Retry(f"{e.code} from {url}") from e
        raise
    except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
        raise Retry(str(e)) from e


def folder(url: str, options: dict) -> bytes:
    """Serves pages kept as files (folder/page=N/part-*, an item a line) like a service that tells its size (option matched); with `busy` every so many-th page fails when first asked for in a process."""
    from pyarrow import fs

    ask = {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(url).query).items()}
    page = int(ask["startIndex"]) // int(ask["count"])
    busy = int(options.get("busy", 0))
    if busy and page % busy == busy - 1 and (url, options["folder"]) not in _asked:
        _asked.add((url, options["folder"]))
        raise Retry(f"page {page} is busy")
    at, where = fs.FileSystem.from_uri(options["folder"])
    found = at.get_file_info(fs.FileSelector(f"{where}/page={page}", allow_not_found=True))
    lines = [line for f in found if f.base_name.startswith("part-") for line in at.open_input_stream(f.path).read().decode().splitlines()]
    return ('{"numberMatched": ' + options["matched"] + ', "features": [' + ", ".join(lines) + "]}").encode()


_asked: set = set()


class Pages:
    """Asks a service for pages. Options: url, kind, size, token, timeout, retries, wait (seconds before the second try, doubled after each), items and total (fields), transport (module:function)."""

    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}
        kind = self.options.get("kind", "rest")
        if kind not in KINDS:
            raise ValueError(f"kind is one of {sorted(KINDS)}")
        self.kind = KINDS[kind] | {k: self.options[k] for k in ("items", "total") if k in self.options}
        self.size = int(self.options.get("size", 100))
        if "url" not in self.options or self.size < 1:
            raise ValueError("a paged source needs a url and a size of 1 or more")

    def url(self, page: int) -> str:
        places = {"page": page, "next": page + 1, "start": page * self.size, "size": self.size}
        ask = {k: v.format(**places) for k, v in self.kind["ask"].items()}
        base = self.options["url"]
        return base + ("&" if "?" in base else "?") + urllib.parse.urlencode(ask)

    def fetch(self, page: int) -> dict | list:
        where, name = self.options.get("transport", "lodestar.sources.paged:http").split(":")
        send = getattr(importlib.import_module(where), name)
        retries, wait = int(self.options.get("retries", 4)), float(self.options.get("wait", 0.5))
        for turn in range(retries + 1):
            try:
                return json.loads(send(self.url(page), self.options))
            except Retry:
                if turn == retries:
                    raise
                time.sleep(wait * 2**turn)

    def rows(self, page: int) -> list[tuple]:
        found = self.fetch(page)
        items = found if isinstance(found, list) else found.get(self.kind["items"]) or []
        return [(page, n, None if (i := x.get("id") if isinstance(x, dict) else None) is None else str(i), json.dumps(x, ensure_ascii=False)) for n, x in enumerate(items)]

    def count(self) -> int | None:
        """How many items the service says it has, None if it does not say."""
        found = self.fetch(0)
        total = found.get(self.kind["total"]) if isinstance(found, dict) else None
        return None if total is None else int(total)


class Range(InputPartition):
    def __init__(self, first: int, end: int | None):
        self.first, self.end = first, end


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.pages, self.per = Pages(options), int(options.get("pagesPerPartition", options.get("pagesperpartition", 10)))

    def partitions(self) -> list[Range]:
        total = self.pages.count()
        if total is None:  # pages are asked for one after another, to the first short one
            return [Range(0, None)]
        n = math.ceil(total / self.pages.size)
        return [Range(a, min(a + self.per, n)) for a in range(0, n, self.per)] or [Range(0, 0)]

    def read(self, partition: Range):
        page = partition.first
        while partition.end is None or page < partition.end:
            rows = self.pages.rows(page)
            yield from rows
            if partition.end is None and len(rows) < self.pages.size:
                return
            page += 1


class PagedStream(SimpleDataSourceStreamReader):
    """New items of a growing list: each batch takes whole pages from where the last one ended; the offset is the next page, so a restart resumes there."""

    def __init__(self, options: dict):
        self.pages, self.most = Pages(options), int(options.get("pagesPerBatch", options.get("pagesperbatch", 10)))

    def initialOffset(self) -> dict:
        return {"page": 0}

    def _from(self, start: int, end: int | None):
        rows, page = [], start
        while page < (start + self.most if end is None else end):
            found = self.pages.rows(page)
            if end is None and len(found) < self.pages.size:
                break  # a page that still grows is left for later
            rows += found
            page += 1
        return rows, page

    def read(self, start: dict):
        rows, page = self._from(start["page"], None)
        return iter(rows), {"page": page}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(self._from(start["page"], end["page"])[0])


class PagedSource(DataSource):
    """Rows (page, n, id, body as JSON) of a paged service; see Pages for the options."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(dict(self.options))

    def simpleStreamReader(self, schema) -> PagedStream:
        return PagedStream(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)
