"""Rows of one file that arrive in any order and over several batches, held in keyed state until the file is whole.

Rules over several rows of a file (level index, order of keys) need all of
them. ``assembled`` keeps what has arrived of each file, gives the file's list
out once all its rows are there, and gives up waiting after a while, when the
list goes out as incomplete. A row that arrives twice counts once, so a source
that repeats rows after a restart changes nothing. Files that are waited for start
batches of their own; a run over what is there (``availableNow``) ends only with
``spark.sql.streaming.noDataMicroBatches.enabled`` false.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import validate

PARTS = "ordinal int, total int, body string"
WHOLE = "path string, kind string, complete boolean, bodies array<string>"
LEVEL = "level int, byte_offset bigint, byte_length bigint, uncompressed_length bigint, expected_size bigint, alignment bigint, sc_scheme bigint, vk_format bigint, images bigint, index_end bigint"
PAIR = "ordinal int, key string"
INCOMPLETE = (0, validate.WARNING, "IncompleteFile")


class Assembler(StatefulProcessor):
    """Lists of the parts of one key, by their ordinals."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getListState("parts", PARTS)

    def _out(self, key: tuple, parts: dict, complete: bool) -> pd.DataFrame:
        return pd.DataFrame({"path": [key[0]], "kind": [key[1]], "complete": [complete], "bodies": [[parts[k][1] for k in sorted(parts)]]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = {int(o): (int(t), b) for o, t, b in self.parts.get()}
        first = not parts
        for pdf in rows:
            for o, t, b in zip(pdf["ordinal"], pdf["total"], pdf["body"], strict=True):
                parts.setdefault(int(o), (int(t), b))
        if len(parts) >= max(t for t, _ in parts.values()):
            self.parts.clear()
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            yield self._out(key, parts, True)
        else:
            self.parts.put([(o, t, b) for o, (t, b) in parts.items()])
            if first:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        parts = {int(o): (int(t), b) for o, t, b in self.parts.get()}
        self.parts.clear()
        if parts:
            yield self._out(key, parts, False)

    def close(self) -> None:
        pass


def parts_of(rows: DataFrame, kind: str, ordinal: str, total: str, columns: list[str]) -> DataFrame:
    """Rows (path, ...) as parts for ``assembled``: what each holds goes into ``body`` as JSON."""
    return rows.select("path", F.lit(kind).alias("kind"), F.col(ordinal).cast("int").alias("ordinal"), F.col(total).cast("int").alias("total"), F.to_json(F.struct(*columns)).alias("body"))


def assembled(parts: DataFrame, wait_ms: int = 600_000) -> DataFrame:
    """(path, kind, complete, bodies) of a stream of parts; the session's state store must be the RocksDB one."""
    schema = T._parse_datatype_string(WHOLE)
    return parts.groupBy("path", "kind").transformWithStateInPandas(statefulProcessor=Assembler(wait_ms), outputStructType=schema, outputMode="Append", timeMode="ProcessingTime")


def issues(whole: DataFrame) -> DataFrame:
    """(path, id, severity, rule) over assembled files: rules of the level index, order of keys, and a warning for incomplete ones."""
    levels = whole.where("kind = 'level'").select("path", F.transform("bodies", lambda b: F.from_json(b, LEVEL)).alias("index"))
    found = validate.level_issues_of_lists(levels, "path").select("path", "id", "severity", "rule")
    pairs = whole.where("kind = 'pair'").select("path", F.transform("bodies", lambda b: F.from_json(b, PAIR)["key"]).alias("keys"))
    n = F.size("keys")
    falls = F.exists(F.zip_with(F.slice("keys", 1, F.greatest(n - 1, F.lit(0))), F.slice("keys", 2, F.greatest(n - 1, F.lit(0))), lambda a, b: a > b), lambda x: x)
    found = found.unionByName(validate.raised(pairs, [(7012, validate.ERROR, "OutOfOrder", falls)], "path"))
    return found.unionByName(validate.raised(whole, [(*INCOMPLETE, ~F.col("complete"))], "path"))
