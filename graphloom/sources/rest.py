"""Paged HTTP sources as Python data sources: offset paging (vulnerability feed), cursor paging (collections) and single documents, with rate limit and backoff.

The feed's quota holds for all requests of a client together. Its pages are therefore read by one task, or by a given number of tasks
that share the quota out; every request, retries too, passes the task's limiter. A cursor is one task. The transport is a parameter:
tests give a function of (url, headers), a cluster gives urllib's.
"""

from __future__ import annotations

import importlib
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class FetchError(RuntimeError):
    """A request that failed for good."""


class SlidingWindow:
    """At most `limit` calls in any `seconds`; wait() sleeps as long as needed."""

    def __init__(self, limit: int, seconds: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.limit, self.seconds, self.clock, self.sleep, self.calls = limit, seconds, clock, sleep, deque()

    def wait(self) -> None:
        now = self.clock()
        while self.calls and now - self.calls[0] >= self.seconds:
            self.calls.popleft()
        if len(self.calls) >= self.limit:
            self.sleep(self.seconds - (now - self.calls[0]))
            self.calls.popleft()
        self.calls.append(self.clock())


@dataclass(frozen=True)
class Backoff:
    """Retries after the first attempt, first and longest delay in seconds, HTTP statuses worth another attempt, and whether unreadable JSON is."""

    retries: int = 5
    first: float = 5.0
    longest: float = 60.0
    statuses: tuple[int, ...] = (403, 429)
    unreadable: bool = False

    def call(self, get: Callable[[], bytes], sleep: Callable[[float], None] = time.sleep) -> object:
        """The answer, read as JSON."""
        return self._tried(lambda: json.loads(get()), sleep)

    def bytes(self, get: Callable[[], bytes], sleep: Callable[[float], None] = time.sleep) -> bytes:
        """The answer as it is."""
        return self._tried(get, sleep)

    def _tried(self, get: Callable[[], object], sleep: Callable[[float], None]) -> object:
        delay = self.first
        for left in range(self.retries, -1, -1):
            try:
                return get()
            except urllib.error.HTTPError as e:
                if e.code not in self.statuses or not left:
                    raise FetchError(f"HTTP {e.code}") from e
            except ValueError as e:
                if not self.unreadable or not left:
                    raise FetchError(f"unreadable answer: {e}") from e
            except (urllib.error.URLError, TimeoutError) as e:
                if not left:
                    raise FetchError(str(e)) from e
            sleep(delay)
            delay = min(2 * delay, self.longest)
        raise FetchError("no attempt was allowed")


#: Politeness of the public services: with and without a key for the feed; catalogs retry all but HTTP errors; collections do not retry.
FEED, FEED_KEY = (5, 30.0), (50, 30.0)
CATALOG, ONCE = Backoff(3, 3.0, 30.0, (), unreadable=True), Backoff(0, 0.0, 0.0, ())


def http_get(url: str, headers: dict[str, str] | None = None, timeout: float = 60.0) -> bytes:
    with urllib.request.urlopen(urllib.request.Request(url, headers=headers or {}), timeout=timeout) as response:  # noqa: S310
        return response.read()


def _transport(name: str) -> Callable[[str, dict[str, str]], bytes]:
    module, _, function = name.rpartition(":")
    return getattr(importlib.import_module(module), function)


_HTTP = "graphloom.sources.rest:http_get"


def fetch(url: str, transport: str = _HTTP, backoff: Backoff = CATALOG, agent: str = "graphloom") -> object:
    """One JSON document."""
    return backoff.call(lambda: _transport(transport)(url, {"Accept": "application/json", "User-Agent": agent}))


@dataclass
class Page(InputPartition):
    start: int


class _OffsetReader(DataSourceReader):
    """startIndex pages of one listing, dealt to `parallel` tasks (1 unless told otherwise), each with its share of the quota.

    One task reads on until the listing's total is reached. Several need the total first, which the driver's own request tells.
    """

    def __init__(self, options: dict[str, str]):
        options = {k.lower(): v for k, v in options.items()}  # Spark does not keep the case of option names
        self.url, self.member = options["url"], options.get("member", "vulnerabilities")
        self.size, self.cap = int(options.get("pagesize", 2000)), int(options.get("maxpages", 0))
        self.get, self.agent, self.key = options.get("transport", _HTTP), options.get("useragent", "graphloom"), options.get("apikey")
        self.backoff = Backoff(5, float(options.get("firstdelay", 5)), float(options.get("longestdelay", 60)))
        self.query = dict(urllib.parse.parse_qsl(options.get("query", "")))
        self.limit, self.seconds = FEED_KEY if self.key else FEED
        self.seconds = float(options.get("quotaseconds", self.seconds))
        self.parallel = max(1, min(int(options.get("parallel", 1)), self.limit - 1))
        self.total = 0

    def _page(self, start: int, limiter: SlidingWindow) -> dict:
        url = f"{self.url}?{urllib.parse.urlencode({**self.query, 'startIndex': start, 'resultsPerPage': self.size})}"
        headers = {"Accept": "application/json", "User-Agent": self.agent, **({"apiKey": self.key} if self.key else {})}

        def get() -> bytes:
            limiter.wait()
            return _transport(self.get)(url, headers)

        return self.backoff.call(get)

    def partitions(self) -> list[Page]:
        if self.parallel > 1:
            self.total = int(self._page(0, SlidingWindow(1, self.seconds)).get("totalResults", 0))
        return [Page(i) for i in range(self.parallel)]

    def read(self, partition: Page) -> Iterator[tuple]:
        """Pages partition.start, partition.start + parallel, .. of this listing."""
        # where the driver has asked too, one request of the quota is its own
        share = self.limit if self.parallel == 1 else (self.limit - 1) // self.parallel
        limiter, total, page = SlidingWindow(share, self.seconds), self.total, partition.start
        while (page == 0 or page * self.size < total) and not (self.cap and page >= self.cap):
            body = self._page(page * self.size, limiter)
            total = int(body.get("totalResults", 0)) if self.parallel == 1 else total
            for i, item in enumerate(body.get(self.member, [])):
                yield page * self.size + i, json.dumps(item)
            page += self.parallel


class OffsetPages(DataSource):
    """spark.read.format("offset_pages").options(url=.., apiKey=.., pageSize=.., maxPages=.., parallel=.., member=.., query="lastModStartDate=..").load() -> (pos, raw)."""

    @classmethod
    def name(cls) -> str:
        return "offset_pages"

    def schema(self) -> str:
        return "pos bigint, raw string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _OffsetReader(dict(self.options))


class _CursorReader(DataSourceReader):
    """more/next pages; added_after goes with the first request only."""

    def __init__(self, options: dict[str, str]):
        options = {k.lower(): v for k, v in options.items()}
        self.url, self.after, self.size = options["url"], options.get("addedafter"), options.get("limit")
        self.get, self.cap = options.get("transport", _HTTP), int(options.get("maxpages", 0))

    def partitions(self) -> list[Page]:
        return [Page(0)]

    def read(self, partition: Page) -> Iterator[tuple]:
        query, n, pages = {**({"limit": self.size} if self.size else {}), **({"added_after": self.after} if self.after else {})}, 0, 0
        url = f"{self.url}?{urllib.parse.urlencode(query)}" if query else self.url
        while url:
            body = fetch(url, self.get, ONCE)
            for item in body.get("objects", []):
                yield n, json.dumps(item)
                n += 1
            pages += 1
            nxt = body.get("next")
            if not body.get("more") or not nxt or pages == self.cap:
                return
            keep = {"limit": self.size} if self.size else {}
            url = nxt if str(nxt).startswith("http") else urllib.parse.urljoin(self.url, nxt) if str(nxt).startswith("/") else f"{self.url}?{urllib.parse.urlencode({**keep, 'next': nxt})}"


class CursorPages(DataSource):
    """spark.read.format("cursor_pages").options(url=.., addedAfter=..).load() -> (pos, raw)."""

    @classmethod
    def name(cls) -> str:
        return "cursor_pages"

    def schema(self) -> str:
        return "pos bigint, raw string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _CursorReader(dict(self.options))


def register(spark) -> None:  # noqa: ANN001
    for source in (OffsetPages, CursorPages):
        spark.dataSource.register(source)
