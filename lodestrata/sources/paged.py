"""A paged service as a Spark source.

``spark.read.format("paged")`` reads partitions that are independent work (a date range, an
owner), each a chain of cursor pages, because a cursor can only be followed. The transport
is a parameter: a function ``(query, cursor, first) -> response``, named as
``module:function``. Requests are retried on transport errors, and a quota is kept per partition.
A response with errors fails the task, which Spark retries; nothing is cut off silently.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestrata.functions.retry import Quota, retrying

#: Records of a page.
PAGE_SIZE = 100


class ResponseError(ValueError):
    """The service answered with errors."""


def checked(response: dict) -> dict:
    """The data of a response; its errors, if any, are raised, whether or not there is data."""
    errors = response.get("errors")
    if errors:
        raise ResponseError("; ".join(str(e.get("message")) for e in errors))
    return response.get("data") or {}


def pages(fetch: Callable, query: str, *, field: str = "search", first: int = PAGE_SIZE, limit: int | None = None, quota: Quota | None = None,
          sleep: Callable[[float], None] = time.sleep, retries: int = 3, errors: tuple = (OSError,)) -> Iterator[dict]:
    """The pages of one query, in order: until the limit, an empty page, or no next page."""
    request = retrying(retries, base=2.0, errors=errors, sleep=sleep)(fetch)
    quota = quota or Quota()
    cursor, got = None, 0
    while limit is None or got < limit:
        wait = quota.pause(datetime.now(timezone.utc))
        if wait > 0:
            quota.waited.append(wait)
            sleep(wait)
            quota.remaining = None  # asked again with the next response
        data = checked(request(query, cursor, first if limit is None else min(first, limit - got)))
        quota.note(data.get("rateLimit"))
        page = data.get(field) or {}
        nodes = page.get("nodes") or []
        if not nodes:
            return
        if limit is not None and got + len(nodes) > limit:
            page = {**page, "nodes": nodes[: limit - got]}
        got += len(nodes)
        yield page
        info = page.get("pageInfo") or {}
        if not info.get("hasNextPage"):
            return
        cursor = info.get("endCursor")


def named(path: str) -> Callable:
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


class QueryPartition(InputPartition):
    def __init__(self, query: str) -> None:
        super().__init__(query)
        self.query = query


class PagedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return [QueryPartition(q) for q in json.loads(self.options["queries"])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        o = self.options
        limit = int(o["limit"]) if "limit" in o else None
        number = 0
        for page in pages(named(o["transport"]), partition.query, field=o.get("field", "search"), first=int(o.get("pagesize", PAGE_SIZE)), limit=limit):
            for node in page["nodes"]:
                if node:
                    yield (partition.query, number, json.dumps(node))
            number += 1


class PagedSource(DataSource):
    """Options: ``transport`` (module:function), ``queries`` (JSON list), ``field``, ``pagesize``, ``limit``."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "query string, page_no int, node string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)
