"""A writer in chunks, ``chunked``: every task sends its rows to a service some hundred at a time.

Options: ``send`` (``module:function``, called with a list of rows as dicts and the options; it must ignore rows that the service has, as an
insert with a unique key does, and give back how many were new), ``chunk`` (rows of one), ``errors`` (``fail``, or ``log`` for
logs whose loss matters to nobody: a chunk that fails is counted and passed over), ``done`` (``module:function``, called
with the totals and the options once all tasks have ended well, or with ``aborted``). All options reach both functions.

A task that fails has sent some of its chunks. It, or the whole load, is simply run again: what is there is ignored, so
each row is left once. Nothing is taken back, since rows that were there before cannot be told from the task's own.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

ROWS = 500


def named(name: str):
    module, _, name = name.partition(":")
    return getattr(importlib.import_module(module), name)


@dataclass
class Sent(WriterCommitMessage):
    chunks: int = 0
    rows: int = 0
    new: int = 0
    failed: int = 0


class ChunkWriter(DataSourceWriter):
    def __init__(self, options):
        self.options = dict(options)
        self.send, self.rows = options["send"], int(options.get("chunk", ROWS))
        self.lenient, self.done = options.get("errors", "fail") == "log", options.get("done")

    def write(self, iterator: Iterator) -> Sent:
        send, out = named(self.send), Sent()
        for chunk in batched(iterator, self.rows):
            rows = [r.asDict(recursive=True) for r in chunk]
            try:
                new = send(rows, self.options)
            except OSError:
                if not self.lenient:
                    raise
                out.failed += len(rows)
                continue
            out.chunks, out.rows, out.new = out.chunks + 1, out.rows + len(rows), out.new + (len(rows) if new is None else new)
        return out

    def commit(self, messages: list) -> None:
        self._ended(messages, False)

    def abort(self, messages: list) -> None:
        self._ended(messages, True)

    def _ended(self, messages: list, aborted: bool) -> None:
        if self.done:
            sent = [m for m in messages if m is not None]
            named(self.done)({n: sum(getattr(m, n) for m in sent) for n in ("chunks", "rows", "new", "failed")} | {"aborted": aborted}, self.options)


class Chunked(DataSource):
    @classmethod
    def name(cls):
        return "chunked"

    def writer(self, schema, overwrite):
        return ChunkWriter(self.options)


def load(rows: DataFrame, send: str, **options) -> None:
    """Sends the rows of a table; may be run again until it ends well."""
    rows.sparkSession.dataSource.register(Chunked)
    rows.write.format("chunked").mode("append").options(send=send, **options).save()
