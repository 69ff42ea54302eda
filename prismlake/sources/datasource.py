"""Python data sources over containers, read by ranges from any store that Arrow opens.

``spark.read.format("texture")``: a row for each file. Options: ``payload``
(false: no level bytes, and none are read), ``metadata`` (false: no key/value
data), ``inflate`` (false: level bytes stay compressed).

``spark.read.format("texture_levels")``: a row for each level. Filters on any of
its columns but ``bytes`` are pushed down: names are filtered before a file is
opened, headers and level indices before any payload is read, so only the
bytes of levels that are asked for are fetched. ``bytes_read`` shows how many
a row took (a file's header counts with its first row). Options: ``payload``
(false, or a schema without ``bytes``: none is read), ``inflate``.

``df.write.format("texture")`` writes rows (name, content). For stores that
only Spark's own readers open use ``container.read``.
"""

from __future__ import annotations

import operator
import posixpath
from dataclasses import dataclass, field

import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from . import ranged
from .container import NAMES, SCHEMA, inflate, parse_ranges

LEVELS = (
    "path string, status string, level int, vk_format bigint, width bigint, height bigint, depth bigint, layers bigint, faces bigint, levels bigint, sc_scheme bigint, "
    "byte_offset bigint, byte_length bigint, uncompressed_length bigint, bytes binary, bytes_read bigint"
)
HEADER = ["vk_format", "width", "height", "depth", "layers", "faces", "levels", "sc_scheme"]


@dataclass
class Files(InputPartition):
    paths: list


def _yes(options: dict, name: str) -> bool:
    return str(options.get(name, "true")).lower() != "false"


def _dealt(found: list[tuple[str, int]], options: dict) -> list[Files]:
    """Files in partitions of at most ``filesPerPartition`` files and about ``bytesPerPartition`` bytes."""
    most, room = int(options.get("filesPerPartition", 64)), int(options.get("bytesPerPartition", 128 << 20))
    out, held = [[]], 0
    for path, size in found:
        if out[-1] and (len(out[-1]) == most or held + size > room):
            out.append([])
            held = 0
        out[-1].append(path)
        held += size
    return [Files(x) for x in out]


class TextureReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return _dealt(ranged.listed(self.options["path"]), self.options)

    def read(self, partition):
        asked = [_yes(self.options, k) for k in ("payload", "metadata", "inflate")]
        for p in partition.paths:
            with ranged.Ranged(p) as r:
                yield parse_ranges(r, r.size, p, *asked)


#: Filters of Spark by their class, as functions of a value that is not null.
COMPARE = {
    ds.EqualTo: operator.eq,
    ds.EqualNullSafe: operator.eq,
    ds.GreaterThan: operator.gt,
    ds.GreaterThanOrEqual: operator.ge,
    ds.LessThan: operator.lt,
    ds.LessThanOrEqual: operator.le,
    ds.In: lambda v, many: v in many,
    ds.StringStartsWith: str.startswith,
    ds.StringEndsWith: str.endswith,
    ds.StringContains: lambda v, part: part in v,
}


def column(f: ds.Filter) -> str | None:
    """The one column that a filter reads; None if the filter is of another kind."""
    if isinstance(f, ds.Not):
        return column(f.child)
    return f.attribute[0] if type(f) in {*COMPARE, ds.IsNull, ds.IsNotNull} and len(f.attribute) == 1 else None


def holds(f: ds.Filter, row: dict) -> bool | None:
    """A filter's value on a row, null as None."""
    if isinstance(f, ds.Not):
        inner = holds(f.child, row)
        return None if inner is None else not inner
    v = row[f.attribute[0]]
    if isinstance(f, (ds.IsNull, ds.IsNotNull)):
        return (v is None) == isinstance(f, ds.IsNull)
    if isinstance(f, ds.EqualNullSafe) and (v is None or f.value is None):
        return v is None and f.value is None
    return None if v is None else COMPARE[type(f)](v, f.value)


class LevelReader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]):
        self.options, self.names = options, names
        self.filters: list[ds.Filter] = []

    def pushFilters(self, filters):
        for f in filters:
            name = column(f)
            if name is None or name in ("bytes", "bytes_read"):
                yield f
            else:
                self.filters.append(f)

    def _passes(self, row: dict) -> bool:
        return all(holds(f, row) for f in self.filters if column(f) in row)

    def partitions(self):
        return _dealt([(p, n) for p, n in ranged.listed(self.options["path"]) if self._passes({"path": p})], self.options)

    def read(self, partition):
        payload, inflated = _yes(self.options, "payload") and "bytes" in self.names, _yes(self.options, "inflate")
        blank = dict.fromkeys([c.split()[0] for c in LEVELS.split(", ")])
        for p in partition.paths:
            with ranged.Ranged(p) as r:
                seen = 0
                whole = dict(zip(NAMES, parse_ranges(r, r.size, p, payload=False, metadata=False), strict=True))
                file = blank | {"path": p, "status": whole["status"]} | {c: whole[c] for c in HEADER}
                for k, at, length, full, _ in whole["level_index"] or [(None,) * 5]:
                    row = file | {"level": k, "byte_offset": at, "byte_length": length, "uncompressed_length": full}
                    if not self._passes(row):
                        continue
                    if payload and k is not None:
                        raw = r(at, length)
                        row["bytes"] = inflate(raw, row["sc_scheme"]) if inflated else raw
                    row["bytes_read"], seen = r.taken - seen, r.taken
                    yield tuple(row[c] for c in self.names)


@dataclass
class Written(WriterCommitMessage):
    paths: list = field(default_factory=list)


class TextureWriter(DataSourceWriter):
    """Rows (name, content) to one file each; files of failed attempts are removed."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, rows):
        system, top, _ = ranged.store(self.path)
        system.create_dir(top, recursive=True)
        done = []
        for r in rows:
            target = posixpath.join(top, r["name"])
            if not self.overwrite and system.get_file_info(target).type != pyarrow.fs.FileType.NotFound:
                raise FileExistsError(target)
            with system.open_output_stream(target + ".part") as f:
                f.write(r["content"])
            system.move(target + ".part", target)
            done.append(target)
        return Written(done)

    def abort(self, messages):
        system, _, _ = ranged.store(self.path)
        for m in messages:
            for p in m.paths if m else []:
                if system.get_file_info(p).type != pyarrow.fs.FileType.NotFound:
                    system.delete_file(p)


class TextureSource(DataSource):
    @classmethod
    def name(cls):
        return "texture"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return TextureReader(self.options)

    def writer(self, schema, overwrite):
        return TextureWriter(self.options, overwrite)


class LevelSource(DataSource):
    @classmethod
    def name(cls):
        return "texture_levels"

    def schema(self):
        return LEVELS

    def reader(self, schema):
        return LevelReader(self.options, schema.names)


def register(spark: SparkSession) -> None:
    """Make both sources known to a session, and let it push filters to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TextureSource)
    spark.dataSource.register(LevelSource)
