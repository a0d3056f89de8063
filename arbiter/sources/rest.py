"""A paged REST source of notes, with retries, throttling and an injected transport.

`register` makes it available as ``spark.read.format("notes")``. Pages follow a
cursor, so one partition reads them in order and yields rows as they come.
"""

from __future__ import annotations

import email.utils
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from arbiter.errors import DataValidationError
from arbiter.sources.strict import decode, loads

#: Answers that are worth another try, and the longest wait that a site may ask for. Fixed values.
RETRY_STATUS = frozenset({429, 500, 502, 503, 504})
LONGEST_WAIT = 120.0


class TransportError(DataValidationError):
    """The site can't be reached or doesn't answer."""


class ProtocolError(DataValidationError):
    """The site's answer isn't what its API promises."""


@dataclass(frozen=True)
class Response:
    status: int
    headers: Mapping[str, str]
    body: bytes

    def __post_init__(self) -> None:
        if not 100 <= self.status <= 599:
            raise ProtocolError(f"status {self.status}")
        object.__setattr__(self, "headers", {k.lower(): v for k, v in self.headers.items()})


class Transport(Protocol):
    def get(self, url: str, headers: Mapping[str, str], timeout: float, max_bytes: int) -> Response: ...


class _NoRedirects(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args: Any) -> None:
        return None


class HttpsTransport:
    """HTTPS GET without redirects and with a bounded body."""

    def get(self, url: str, headers: Mapping[str, str], timeout: float, max_bytes: int) -> Response:
        if urllib.parse.urlsplit(url).scheme != "https":
            raise TransportError("only https is allowed")
        opener = urllib.request.build_opener(_NoRedirects)
        try:
            with opener.open(urllib.request.Request(url, headers=dict(headers)), timeout=timeout) as r:
                body, status, found = r.read(max_bytes + 1), r.status, dict(r.headers)
        except urllib.error.HTTPError as error:
            body, status, found = error.read(max_bytes + 1), error.code, dict(error.headers)
        except OSError as error:
            raise TransportError(str(error)) from error
        if len(body) > max_bytes:
            raise ProtocolError("the answer is too large")
        return Response(status, found, body)


@dataclass(frozen=True)
class Retry:
    attempts: int = 4
    initial: float = 0.5
    longest: float = 30.0

    def delay(self, tries: int, response: Response | None, now: Callable[[], float]) -> float:
        """What the site asks for in Retry-After, in seconds or as a date, else doubling waits."""
        asked = response.headers.get("retry-after") if response else None
        if asked:
            if asked.strip().isdigit():
                return min(float(asked), LONGEST_WAIT)
            try:
                return min(max(0.0, email.utils.parsedate_to_datetime(asked).timestamp() - now()), LONGEST_WAIT)
            except (TypeError, ValueError):
                pass
        return min(self.initial * 2**tries, self.longest)


@dataclass
class Client:
    """GETs with a request budget, a least distance between requests, and retries."""

    base_url: str
    transport: Transport = field(default_factory=HttpsTransport)
    retry: Retry = field(default_factory=Retry)
    page_size: int = 1000
    max_requests: int = 10_000
    min_interval: float = 0.0
    timeout: float = 30.0
    max_bytes: int = 64 << 20
    token: str | None = None
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.time
    requests: int = 0
    _last: float = float("-inf")

    def __post_init__(self) -> None:
        parts = urllib.parse.urlsplit(self.base_url)
        if parts.scheme != "https" or not parts.netloc or parts.path not in ("", "/") or parts.query or parts.fragment or parts.username:
            raise DataValidationError("base_url must be an https origin")

    def get_json(self, path: str, **query: Any) -> dict[str, Any]:
        url = f"{self.base_url.rstrip('/')}{path}?{urllib.parse.urlencode(query)}"
        headers = {"Accept": "application/json"} | ({"Authorization": f"Bearer {self.token}"} if self.token else {})
        for tries in range(self.retry.attempts):
            if self.requests >= self.max_requests:
                raise TransportError("the request budget is used up")
            if (wait := self._last + self.min_interval - self.clock()) > 0:
                self.sleep(wait)
            self.requests += 1
            self._last = self.clock()
            response, failure = None, None
            try:
                response = self.transport.get(url, headers, self.timeout, self.max_bytes)
            except TransportError as error:
                failure = error
            if response is not None and response.status not in RETRY_STATUS:
                if response.status != 200:
                    raise ProtocolError(f"status {response.status}")
                found = loads(decode(response.body))
                if not isinstance(found, dict):
                    raise ProtocolError("the answer must be an object")
                return found
            if tries + 1 < self.retry.attempts:
                self.sleep(self.retry.delay(tries, response, self.clock))
        raise failure or TransportError(f"status {response.status} after {self.retry.attempts} tries")

    def notes(self, **query: Any) -> Iterator[dict[str, Any]]:
        """All notes by rising id. The first page's count is a promise; short, repeated or surplus pages fail."""
        after, promised, seen = None, None, 0
        while promised is None or seen < promised:
            page = self.get_json("/notes", sort="id", limit=self.page_size, **query, **({"after": after} if after else {}))
            rows, count = page.get("notes"), page.get("count")
            if not isinstance(rows, list) or isinstance(count, bool) or not isinstance(count, int) or count < 0:
                raise ProtocolError("a page has notes and a count")
            promised = count if promised is None else promised
            if count != promised and after is None:
                raise ProtocolError("the count has changed")
            if not rows and seen < promised:
                raise ProtocolError(f"{promised} notes were promised and {seen} came")
            for r in rows:
                name = r.get("id") if isinstance(r, dict) else None
                if not isinstance(name, str) or not name or (after is not None and name <= after):
                    raise ProtocolError("ids must rise")
                after, seen = name, seen + 1
                yield r
            if seen > promised:
                raise ProtocolError(f"{promised} notes were promised and {seen} came")

    def _one(self, path: str, name: str, identifier: str) -> dict[str, Any]:
        rows = self.get_json(path, id=identifier).get(name)
        if not isinstance(rows, list) or len(rows) != 1 or not isinstance(rows[0], dict) or rows[0].get("id") != identifier:
            raise ProtocolError(f"exactly one of {name} must answer for {identifier}")
        return rows[0]

    def group_members(self, identifier: str) -> tuple[str, ...]:
        members = self._one("/groups", "groups", identifier).get("members")
        if not isinstance(members, list) or not all(isinstance(m, str) and m.startswith("~") and "@" not in m and " " not in m for m in members) or len(set(members)) != len(members):
            raise ProtocolError("members must be distinct profile ids")
        return tuple(members)

    def profile(self, identifier: str) -> dict[str, Any]:
        """A profile with the fields that may be kept, and no others."""
        from arbiter.sources.notes import PROFILE_FIELDS

        found = self._one("/profiles", "profiles", identifier)
        content = found.get("content")
        if not isinstance(content, dict):
            raise ProtocolError("a profile has content")
        return {"id": identifier, "content": {k: content[k] for k in PROFILE_FIELDS if k in content}}


#: Transports by name, for readers that are made in worker processes.
TRANSPORTS: dict[str, Callable[[], Transport]] = {"https": HttpsTransport}


class NotesReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.options = dict(options)
        self.make = TRANSPORTS[self.options.get("transport", "https")]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str]]:
        o = self.options
        client = Client(o["baseurl"], self.make(), page_size=int(o.get("pagesize", 1000)))
        for note in client.notes(invitation=o["invitation"]):
            yield note["id"], json.dumps(note, sort_keys=True, ensure_ascii=False)


class NotesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "notes"

    def schema(self) -> str:
        return "id string, note string"

    def reader(self, schema: Any) -> NotesReader:
        return NotesReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NotesSource)
