"""Sources that ask a warehouse or a service: templated scans, and polls of time windows.

Both reach the other side by a function that is named as module:function, so a
worker imports it and no connection travels.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from importlib import import_module
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition

SESSIONS = 1_000  # session ids of one query


def named(path: str) -> Any:
    """The function that module:function names."""
    module, _, name = path.partition(":")
    return getattr(import_module(module), name)


def render(template: str, table: str, shop: str | None = None, by_sessions: bool = False, more: dict[str, str] | None = None) -> str:
    """A query template with its {TABLE}, its {WHERE} of shop and sessions, and other names in braces filled in.

    A shop is a number; anything else raises, since it becomes part of the text.
    Sessions are a parameter of the query, @session_ids.
    """
    clauses = []
    if shop:
        if not str(shop).isdigit():
            raise ValueError("a shop is named by its number")
        clauses.append(f"s.shop_id = {shop}")
    if by_sessions:
        clauses.append("s.session_id IN UNNEST(@session_ids)")
    out = template.replace("{TABLE}", table).replace("{WHERE}", f"WHERE {' AND '.join(clauses)}" if clauses else "")
    for name, value in (more or {}).items():
        out = out.replace("{" + name + "}", value)
    return out


class _Sessions(InputPartition):
    def __init__(self, ids: list[str] | None):
        self.ids = ids


class _TemplateReader(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: list[str]):
        self.options, self.columns = options, columns
        self.shop = options.get("shop")
        self.none = False

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality with a shop goes into the template; all else stays with Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("shop_id",) and str(f.value).isdigit():
                self.none = self.none or self.shop not in (None, str(f.value))
                self.shop = str(f.value)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        if self.none:
            return []
        if "sessions" not in self.options:
            return [_Sessions(None)]
        ids, size = json.loads(self.options["sessions"]), int(self.options.get("chunk", SESSIONS))
        return [_Sessions(ids[at : at + size]) for at in range(0, len(ids), size)]

    def read(self, partition: _Sessions | None) -> Iterator[tuple]:
        if partition is None:  # there was none to read
            return
        sql = render(self.options["template"], self.options["table"], self.shop, partition.ids is not None, json.loads(self.options.get("names", "{}")))
        parameters = {} if partition.ids is None else {"session_ids": partition.ids}
        for row in named(self.options["query"])(sql, parameters):
            yield tuple(row[c] for c in self.columns)


class TemplateSource(DataSource):
    """Rows of a templated query; options: query (module:function of text and parameters, giving rows as mappings), template, table, columns (DDL), shop, sessions (JSON list), chunk, names (JSON of further names)."""

    @classmethod
    def name(cls) -> str:
        return "templated"

    def schema(self) -> str:
        return self.options["columns"]

    def reader(self, schema) -> DataSourceReader:
        return _TemplateReader(dict(self.options), schema.fieldNames())


def warehouse_scan(spark: SparkSession, query: str, template: str, table: str, columns: str, shop: str | None = None, sessions: DataFrame | None = None, chunk: int = SESSIONS, names: dict[str, str] | None = None) -> DataFrame:
    """A warehouse table through a query template; a sample of sessions is asked for in parts of `chunk` ids, each by a task of its own.

    The sample (one column session_id) is what a selection has chosen, so a list
    that a query can name; a whole table of sessions belongs in a join instead.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TemplateSource)
    options = {"query": query, "template": template, "table": table, "columns": columns, "chunk": str(chunk), "names": json.dumps(names or {})}
    if shop is not None:
        options["shop"] = shop
    if sessions is not None:
        options["sessions"] = json.dumps(sorted({str(r[0]) for r in sessions.select("session_id").where("session_id IS NOT NULL").collect()}))
    return spark.read.format("templated").options(**options).load()


class _Window(InputPartition):
    def __init__(self, begin: int, end: int):
        self.begin, self.end = begin, end


class _WindowReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.size = int(options["window_ms"])

    def initialOffset(self) -> dict:
        return {"at": int(self.options["since_ms"])}

    def latestOffset(self) -> dict:
        """The end of the last whole window: a window that still fills is asked for once, when it is over."""
        since, until = int(self.options["since_ms"]), int(named(self.options["now"])())
        return {"at": since + max(0, until - since) // self.size * self.size}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """The windows between two offsets, the newest first."""
        return [_Window(at, at + self.size) for at in reversed(range(start["at"], end["at"], self.size))]

    def read(self, partition: _Window) -> Iterator[tuple]:
        page = 0
        while rows := list(named(self.options["fetch"])(partition.begin, partition.end, page)):
            for row in rows:
                key = next((str(row[k]) for k in ("link", "session_id", "id") if row.get(k)), json.dumps(row, sort_keys=True))
                yield key, partition.begin, json.dumps(row, sort_keys=True)
            page += 1

    def commit(self, end: dict) -> None:
        """Nothing to release: windows are asked for by time."""


class WindowSource(DataSource):
    """A stream of (key, window, record) from a service that is polled by time windows and pages; options: fetch (module:function of begin, end, page), now (module:function), since_ms, window_ms.

    The key is the first that is not empty of link, session_id, id and the record
    itself. Offsets are ends of windows, kept in the query's checkpoint, so a
    restart asks again for the windows that were not written, and for no other.
    """

    @classmethod
    def name(cls) -> str:
        return "windows"

    def schema(self) -> str:
        return "key string, window_ms long, record string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _WindowReader(dict(self.options))


def polled_windows(spark: SparkSession, fetch: str, now: str, since_ms: int, window_ms: int) -> DataFrame:
    """The stream of `WindowSource`; records that come in several windows are still in it, each with its key."""
    spark.dataSource.register(WindowSource)
    return spark.readStream.format("windows").options(fetch=fetch, now=now, since_ms=str(since_ms), window_ms=str(window_ms)).load()
