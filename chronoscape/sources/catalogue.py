"""A paged scene catalogue as a Spark data source, with filters pushed into the request, and link signing.

The reader asks an injected `fetch(method, url, body) -> dict` (by default over HTTP), so it can be tested and used
without a network. Days are partitioned: each partition pages through its own part of the range.
"""

from __future__ import annotations

import datetime as dt
import json
import threading
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import urlencode, urlsplit, urlunsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual


class SourceError(Exception):
    """The catalogue or its images cannot be reached or read."""


def http(method: str, url: str, body: dict | None = None, timeout: float = 60) -> dict:
    data = json.dumps(body).encode() if body is not None else None
    request = urllib.request.Request(url, data, {"Content-Type": "application/json"}, method=method)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return json.load(reply)
    except urllib.error.HTTPError as e:
        raise SourceError(f"The catalogue answered with an error ({e.code}).") from e
    except OSError as e:
        raise SourceError("The catalogue cannot be reached.") from e


@dataclass(frozen=True)
class Ask:
    """One request to a catalogue, and the rule by which its reply leads to the next one."""

    url: str
    method: str = "POST"
    body: dict | None = None

    def after(self, reply: dict) -> Ask | None:
        """What the reply's link to a next page asks for. A link may replace the body or, with `merge`, add to it."""
        links = {link.get("rel"): link for link in reply.get("links") or ()}
        if "next" not in links:
            return None
        link = links["next"]
        added = link.get("body")
        return Ask(link["href"], str(link.get("method") or "GET").upper(), {**(self.body or {}), **(added or {})} if link.get("merge") else added)


def search_pages(url: str, collection: str, bounds, start: str, end: str, fetch: Callable = http, page: int = 250):
    """Features of all pages between start and end (exclusive), in the catalogue's order."""
    until = dt.date.fromisoformat(str(end)) - dt.timedelta(days=1)
    ask: Ask | None = Ask(url, body={"collections": [collection], "bbox": list(bounds), "datetime": f"{start}T00:00:00Z/{until}T23:59:59Z", "limit": page})
    while ask is not None:
        reply = fetch(ask.method, ask.url, ask.body)
        yield from reply.get("features") or ()
        ask = ask.after(reply)


class Token:
    """A short-lived token from a service, asked for anew when less than `margin_s` seconds of it are left."""

    def __init__(self, url: str, fetch: Callable = http, now: Callable | None = None, margin_s: int = 300, field: str = "token", expiry: str = "msft:expiry"):
        self.ask = lambda: fetch("GET", url, None)
        self.now = now or (lambda: dt.datetime.now(dt.timezone.utc))
        self.margin, self.field, self.expiry = dt.timedelta(seconds=margin_s), field, expiry
        self.value, self.good_until = "", dt.datetime.min.replace(tzinfo=dt.timezone.utc)
        self.one_at_a_time = threading.Lock()

    def __str__(self) -> str:
        with self.one_at_a_time:
            if self.now() > self.good_until:
                got = self.ask()
                self.value, self.good_until = got[self.field], dt.datetime.fromisoformat(got[self.expiry]) - self.margin
            return self.value


class Signer:
    """Puts a token into the query of web links; links of any other kind stay as they are."""

    def __init__(self, token_url: str, fetch: Callable = http, now: Callable | None = None, margin_s: int = 300):
        self.token = Token(token_url, fetch, now, margin_s)

    def sign(self, href: str) -> str:
        parts = urlsplit(href)
        if parts.scheme not in ("http", "https"):
            return href
        return urlunsplit(parts._replace(query="&".join(filter(None, (parts.query, str(self.token))))))


class _Days(InputPartition):
    def __init__(self, start: str, end: str):
        self.start, self.end = start, end


class _Reader(DataSourceReader):
    def __init__(self, options, fetch):
        self.o, self.fetch = options, fetch
        self.start, self.end = options["start"], options["end"]

    def pushFilters(self, filters):
        """Bounds on day narrow the request; Spark applies all filters again."""
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("day",):
                day = str(f.value)
                if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.start = max(self.start, day)
                elif isinstance(f, LessThan):
                    self.end = min(self.end, day)
                elif isinstance(f, LessThanOrEqual):
                    self.end = min(self.end, str(dt.date.fromisoformat(day) + dt.timedelta(days=1)))
            yield f

    def partitions(self):
        start, end = dt.date.fromisoformat(self.start), dt.date.fromisoformat(self.end)
        n = max(1, min(int(self.o.get("partitions", 1)), (end - start).days))
        cuts = [start + (end - start) * i // n for i in range(n)] + [end]
        return [_Days(str(a), str(b)) for a, b in zip(cuts, cuts[1:], strict=False) if a < b] or [_Days(str(start), str(start))]

    def read(self, part):
        if part.start >= part.end:
            return
        base = dt.date.fromisoformat(part.start).toordinal() << 32
        for i, item in enumerate(search_pages(self.o["url"], self.o.get("collection", ""), json.loads(self.o["bbox"]), part.start, part.end, self.fetch)):
            yield base + i, dt.date.fromisoformat(item["properties"]["datetime"][:10]), json.dumps(item)


class CatalogueSource(DataSource):
    """Options url, collection, bbox (JSON), start, end (exclusive), partitions. Columns seq, day, item (JSON)."""

    fetch = staticmethod(http)

    @classmethod
    def name(cls):
        return "scene_catalogue"

    def schema(self):
        return "seq long, day date, item string"

    def reader(self, schema):
        return _Reader(dict(self.options), type(self).fetch)


def register(spark, source: type[CatalogueSource] = CatalogueSource) -> None:
    """Make the source known to the session, and let it see filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)


def search_places(query: str, url: str, fetch: Callable = http, limit: int = 6) -> list[tuple[str, tuple]]:
    """(name, (west, south, east, north)) of places; the service lists south, north, west, east as text."""
    got = fetch("GET", f"{url}?{urlencode({'q': query, 'format': 'jsonv2', 'limit': limit})}", None)
    boxes = [(x["display_name"], [float(v) for v in x["boundingbox"]]) for x in got]
    return [(name, (w, s, e, n)) for name, (s, n, w, e) in boxes]
