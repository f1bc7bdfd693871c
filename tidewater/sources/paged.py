"""A polled, paged API as a Python streaming data source: offsets, a loop on the last row, retries, exact replay.

``TableApi`` serves the rows of a table as an exchange serves trades: by time, a page at a time. A
client of a real service replaces it (``PagedStream.api``). A micro-batch covers the times
(start, end] between two offsets, in slices that tasks fetch on their own, so the same offsets
always bring the same rows, and a task that runs again repeats its slice only.
"""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

EPOCH = dt.datetime(1970, 1, 1)


def _batches(path: str, columns: list[str], where: ds.Expression | None = None) -> ds.Scanner:
    """A scan that holds few rows at once."""
    return ds.dataset(path).scanner(columns=columns, filter=where, batch_size=32_768, batch_readahead=2, fragment_readahead=1)


def _micros(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.cast(pa.timestamp("us")).cast(pa.int64()).to_numpy(zero_copy_only=False)


@lru_cache(maxsize=4)
def _edges(path: str, clock: int | None) -> tuple[int, int] | None:
    """The first and the newest time up to ``clock``."""
    first, newest = None, None
    for batch in _batches(path, ["ts"]).to_batches():
        us = _micros(batch.column(0).drop_null())
        us = us if clock is None else us[us <= clock]
        if len(us):
            first, newest = min(int(us.min()), int(us.max()) if first is None else first), max(int(us.max()), int(us.min()) if newest is None else newest)
    return None if first is None else (first, newest)


@lru_cache(maxsize=2)
def _window(path: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray, pa.Table]:
    """Times and ids in order, and the rows, from ``start`` up to before ``end``: all that a process holds of the table."""
    at = lambda us: pa.scalar(us, pa.timestamp("us", tz=getattr(ds.dataset(path).schema.field("ts").type, "tz", None)))
    where = (ds.field("ts") >= at(start)) & (ds.field("ts") < at(end))
    table = _batches(path, ["event_id", "ts", "event_type", "value"], where).to_table().sort_by([("ts", "ascending"), ("event_id", "ascending")])
    return _micros(table["ts"]), table["event_id"].to_numpy(), table


class TableApi:
    """``fetch`` gives at most ``limit`` rows after a cursor, in the order of time and id; ``edges`` the first and the newest time there is at ``clock``.

    It reads the table by windows of ``WINDOW`` microseconds, wider ones where rows are sparse.
    """

    WINDOW = 21_600_000_000

    def __init__(self, path: str, clock: int | None = None):
        self.path, self.clock = path, clock

    def edges(self) -> tuple[int, int] | None:
        return _edges(self.path, self.clock)

    def fetch(self, us: int, after: int | None, limit: int) -> list[tuple]:
        """Rows at ``us`` with an id over ``after`` (none: every row at ``us``), then later ones."""
        edges, rows, width = _edges(self.path, None), [], self.WINDOW
        start = us // width * width
        while edges and len(rows) < limit and start <= edges[1]:
            times, ids, table = _window(self.path, start, start + width)
            first, last = np.searchsorted(times, us, side="left"), np.searchsorted(times, us, side="right")
            at, more = int(first if after is None else first + np.searchsorted(ids[first:last], after, side="right")), limit - len(rows)
            part = table.slice(at, more)
            rows += zip(part["event_id"].to_pylist(), times[at : at + more].tolist(), part["event_type"].to_pylist(), part["value"].to_pylist(), strict=True)
            start, width = start + width, width if len(table) else 2 * width
        return rows


class PagedStream(DataSource):
    """``spark.readStream.format("paged_stream")``; options ``path``, ``page`` (rows), ``slice`` (seconds a task), ``tries``, ``clock`` (epoch microseconds: later rows aren't there yet)."""

    api = TableApi

    @classmethod
    def name(cls) -> str:
        return "paged_stream"

    def schema(self) -> str:
        return "event_id long, ts timestamp_ntz, event_type string, value double"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        o = self.options
        return PagedStreamReader(self.api(o["path"], int(o["clock"]) if o.get("clock") else None), int(o.get("page", 500)), int(o.get("slice", 86_400)) * 1_000_000, int(o.get("tries", 4)))


class PagedStreamReader(DataSourceStreamReader):
    def __init__(self, api: TableApi, page: int, width: int, tries: int):
        self.api, self.page, self.width, self.tries = api, page, width, tries

    def _asked(self, call, *args):
        """The answer, asked for again after a while where the call fails; the last failure is the caller's."""
        for k in range(self.tries):
            try:
                return call(*args)
            except OSError:
                if k == self.tries - 1:
                    raise
                time.sleep(0.05 * 2**k)

    def initialOffset(self) -> dict:
        edges = self._asked(self.api.edges)
        return {"us": edges[0] - 1 if edges else -1}

    def latestOffset(self) -> dict:
        edges = self._asked(self.api.edges)
        return {"us": edges[1] if edges else -1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition((lo, min(lo + self.width, end["us"]))) for lo in range(start["us"], end["us"], self.width)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        start, end = partition.value
        us, after = start + 1, None
        while True:
            rows = self._asked(self.api.fetch, us, after, self.page)
            for event_id, at, kind, value in rows:
                if at > end:
                    return
                yield event_id, EPOCH + dt.timedelta(microseconds=at), kind, value
            if len(rows) < self.page:
                return
            after, us = rows[-1][0], rows[-1][1]

    def commit(self, end: dict) -> None:
        pass
